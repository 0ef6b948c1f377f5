"""Reading and planning of EVM logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.operators.intervals import interval_join

#: A log as it is delivered; timestamps are seconds.
RAW_LOG = T.StructType(
    [
        T.StructField("block_number", T.LongType()), T.StructField("block_hash", T.StringType()), T.StructField("block_timestamp", T.LongType()), T.StructField("transaction_hash", T.StringType()),
        T.StructField("transaction_index", T.LongType()), T.StructField("log_index", T.LongType()), T.StructField("address", T.StringType()), T.StructField("topics", T.ArrayType(T.StringType())),
        T.StructField("data", T.StringType()), T.StructField("removed", T.BooleanType()),
    ]
)


def range_plan(spark: SparkSession, first: int, last: int, limit: int) -> DataFrame:
    """Inclusive chunks (from_block, to_block) of at most ``limit`` blocks."""
    if limit < 1 or first < 0 or first > last:
        raise ValueError(f"no range: {first} to {last} by {limit}")
    starts = spark.range(first, last + 1, limit)
    return starts.select(F.col("id").alias("from_block"), F.least(F.col("id") + limit - 1, F.lit(last)).alias("to_block"))


def split_ranges(ranges: DataFrame, limit: int, first: str = "from_block", last: str = "to_block") -> DataFrame:
    """As :func:`range_plan`, for every row of ``ranges``; a bad row is an error."""
    checked = F.when(F.col(first) > F.col(last), F.raise_error(F.lit("range ends before it begins"))).otherwise(F.col(first))
    steps = F.explode(F.sequence(checked, F.col(last), F.lit(limit).cast("long")))
    return ranges.withColumn("chunk_from", steps).withColumn("chunk_to", F.least(F.col("chunk_from") + limit - 1, F.col(last)))


def log_filter(addresses: list[str] | None = None, topics: list[str] | None = None, first: int | None = None, last: int | None = None) -> Column:
    """What a log request selects; every part reaches the scan."""
    parts = [F.lit(True)]
    if addresses is not None:
        parts.append(F.col("address").isin([a.lower() for a in addresses]))
    if topics is not None:
        parts.append(F.col("topic0").isin([t.lower() for t in topics]))
    if first is not None:
        parts.append(F.col("block_number") >= first)
    if last is not None:
        parts.append(F.col("block_number") <= last)
    return reduce(lambda a, b: a & b, parts)


def selector_union(*requests: dict[str, set[str]]) -> dict[str, list[str]]:
    """One request for several contracts: the topics of each address, without repeats."""
    found: dict[str, set[str]] = {}
    for request in requests:
        for address, topics in request.items():
            found.setdefault(address.lower(), set()).update(t.lower() for t in topics)
    return {a: sorted(t) for a, t in sorted(found.items())}


def unwrapped_pages(pages: DataFrame, payload: str = "payload") -> DataFrame:
    """The logs of JSON pages, each an array of rows or an object with the array ``rows``."""
    plain = F.from_json(payload, T.ArrayType(RAW_LOG))
    wrapped = F.from_json(payload, T.StructType([T.StructField("rows", T.ArrayType(RAW_LOG))]))["rows"]
    is_object = F.ltrim(F.col(payload)).startswith("{")
    return pages.select(F.explode(F.when(is_object, wrapped).otherwise(plain)).alias("log")).select("log.*")


def heads(logs: DataFrame, finality: str = "finality", block: str = "block_number") -> DataFrame:
    """The highest block of each finality."""
    return logs.groupBy(finality).agg(F.max(block).alias("head"))


def provisional_scan(logs: DataFrame, ranges: DataFrame, finality: str, block: str = "block_number") -> DataFrame:
    """Logs of one finality within the asked ranges (from_block, to_block), each with the range that it fills; one in several ranges comes for each."""
    return interval_join(logs.where(F.col("finality") == finality), block, ranges.select("from_block", "to_block"), "from_block", "to_block")


def coverage_segments(scanned: DataFrame, ranges: DataFrame, block: str = "block_number") -> DataFrame:
    """What each asked range is covered by: its rows, and its last block with one."""
    found = scanned.groupBy("from_block", "to_block").agg(F.count("*").alias("rows"), F.max(block).alias("anchor"))
    return ranges.select("from_block", "to_block").join(found, ["from_block", "to_block"], "left").withColumn("rows", F.coalesce("rows", F.lit(0)).cast("long"))
