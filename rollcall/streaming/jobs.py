"""Structured Streaming jobs over logs: what each batch changes is one version of a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from rollcall.operators.folds import delegation_fold, mappings
from rollcall.sources.versions import VersionedTable
from rollcall.streaming.keyed import OrderedFold, folded

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def log_stream(spark: SparkSession, path: str, schema: T.StructType, files: int = 1) -> DataFrame:
    """Files of a folder as a stream, a bounded number in each batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


@contextmanager
def stateful(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """Settings of queries with keyed state, which take them when they start: RocksDB, and as many partitions of state as keys are worth."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB} | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append", partitions: int | None = None) -> StreamingQuery:
    """Handles all that is there, batch by batch, until nothing is new and no timer is due; a restart goes on after the last batch that was committed."""
    with stateful(stream.sparkSession, partitions):
        query = stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return query


def append_logs(stream: DataFrame, checkpoint: str, table: VersionedTable, name: str = "log", partitions: int | None = None) -> StreamingQuery:
    """Adds rows to a table, of each key the first; a replayed batch adds nothing, and a batch rewrites only the buckets of its rows."""

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            keys = table.keys
            table.change(name, number, table.touched(batch), lambda old: old.unionByName(batch.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(*old.columns)))
        finally:
            batch.unpersist()

    return run_available(stream, checkpoint, each, partitions=partitions)


def keep_folded(stream: DataFrame, checkpoint: str, fold: OrderedFold, delay: str, table: VersionedTable, gone: F.Column | None = None, partitions: int | None = None, name: str = "fold") -> StreamingQuery:
    """Keeps what a keyed fold tells of each key; ``gone`` tells keys that leave the table."""

    def each(batch: DataFrame, number: int) -> None:
        # a key is told twice where its rows and its timer come in one batch; both are the same state or a later one
        latest = batch.withColumn("_nth", F.monotonically_increasing_id())
        latest = latest.withColumn("_rank", F.row_number().over(Window.partitionBy(*table.keys).orderBy(F.desc("_nth")))).where("_rank = 1")
        table.upsert(latest.select(*batch.columns), name, number, gone=gone)

    return run_available(folded(stream, fold, delay), checkpoint, each, "update", partitions)


def block_time(height: str) -> F.Column:
    """Block heights as event time, a second each; block 0 comes a second after the epoch, as what is at the epoch is late from the start."""
    return F.timestamp_seconds(F.col(height) + 1)


def deduplicated(stream: DataFrame, keys: list[str], height: str, blocks: int) -> DataFrame:
    """Each key's first reading; a second one counts for nothing if its block comes no more than ``blocks`` after. Keys leave the state then."""
    return stream.withColumn("block_time", block_time(height)).withWatermark("block_time", f"{blocks} seconds").dropDuplicatesWithinWatermark(keys).drop("block_time")


def promoted(stream: DataFrame, keys: list[str], height: str, confirmations: int) -> DataFrame:
    """Provisional rows as they become final, in append mode: each once, when the log has come ``confirmations`` blocks above it. Rows wait in the state
    until then and leave it; of a key that is read again before, the values that came last in order of the columns count."""
    keys = [k for k in keys if k != height]
    others = [c for c in stream.columns if c not in keys and c != height]
    timed = stream.withColumn("block_time", block_time(height)).withWatermark("block_time", f"{confirmations} seconds")
    rows = timed.groupBy("block_time", height, *keys).agg(F.max(F.struct(*others)).alias("row")) if others else timed.groupBy("block_time", height, *keys).agg(F.count("*").alias("row"))
    return rows.select(*(F.col(f"row.{c}").alias(c) if c in others else F.col(c) for c in stream.columns))


def corrected(stream: DataFrame, checkpoint: str, log: VersionedTable, snapshot: VersionedTable, blocks: int, zero: str, partitions: int | None = None) -> StreamingQuery:
    """Delegations for rows that come in any order, however late.

    The log is a table by ``pos``, bucketed by delegator as the snapshot is. A batch adds its rows to the log and folds the delegators of the batch again from
    their buckets alone. Rows more than ``blocks`` below the height that earlier batches reached are late: the versions before them were told
    without them, and the rows of their delegators are corrections; ``n_late`` counts them, and the commit notes how many a version corrects.
    """

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            height = log.manifest()["told"].get("height", -1) if not log.committed("log", number) else log.manifest()["told"].get("before", -1)
            top = batch.agg(F.max("pos")).first()[0]
            if top is None:
                return
            told = {"before": height, "height": max(height, top)}
            new = batch.dropDuplicates(["pos"]).withColumn("late", F.col("pos") <= height - blocks)
            buckets = log.touched(batch)
            log.change("log", number, buckets, lambda old: old.unionByName(new.join(old.select("pos", "delegator"), ["pos", "delegator"], "left_anti").select(*old.columns)), told)
            history = log.read(buckets=buckets).join(batch.select("delegator").distinct(), "delegator", "left_semi")
            late = history.groupBy("delegator").agg(F.count_if("late").alias("n_late"))
            current = mappings(delegation_fold(history, zero=zero)).withColumn("power", F.col("power").cast("long"))
            rows = late.join(current, "delegator", "left").select("delegator", "delegate", "power", "n_late")
            snapshot.upsert(rows, "snapshot", number, {"late": new.where("late").count()})
        finally:
            batch.unpersist()

    return run_available(stream, checkpoint, each, partitions=partitions)


def windowed_counts(stream: DataFrame, at: str, key: str, width: str, late: str) -> DataFrame:
    """Counts by time window and key, with late rows up to a watermark; for append mode."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), key).agg(F.count("*").alias("n"))
