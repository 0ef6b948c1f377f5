"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the folder ``sf_dir`` (any path that Spark's readers can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; where that is unset, a local session gets a temporary one."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    at = at or tempfile.mkdtemp(prefix="checkpoints")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(at)
    return at


def few(df: DataFrame, per_core: int = 4) -> DataFrame:
    """``df`` in ``per_core`` partitions at most for each core (6 at least) or for 32 shuffle partitions, whichever are more: for tables that are written, which get a file from each.

    Each file that a store without native calls makes costs its executor two processes, one for it and one for its checksum.
    """
    spark = df.sparkSession
    return df.coalesce(per_core * max(6, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 32))


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that lost executors cost no lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """As :func:`checkpointed`, but columnar and compressed: for wide or large intermediate tables."""
    at = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def integer_ids(df: DataFrame, column: str) -> None:
    """An error that says so if the ids of a table aren't integers, before anything runs."""
    if not isinstance(df.schema[column].dataType, T.IntegralType):
        raise TypeError(f"ids must be integers, {column} is {df.schema[column].dataType.simpleString()}")


def utf8(column: str) -> F.Column:
    """The text as UTF-8 bytes; null counts as empty."""
    return F.encode(F.coalesce(F.col(column), F.lit("")), "UTF-8")


def arrow_type(df: DataFrame, column: str) -> pa.DataType:
    """The type that a column has in Arrow tasks."""
    return to_arrow_type(df.schema[column].dataType)


def rows_of(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The rows of some columns as Python values, a few at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield from zip(*(batch.column(n).slice(at, 256).to_pylist() for n in names), strict=True)


def emitted(rows: Iterable[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of at most ``size`` rows."""
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield batch()
            held.clear()
    if held:
        yield batch()
