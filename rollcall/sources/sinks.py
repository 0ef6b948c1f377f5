"""Writes that a plain Parquet table can take: keyed appends and last-writer upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def new_rows(target: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose key isn't in the target, one for each key: what an insert that ignores duplicates adds."""
    same = [target[k].eqNullSafe(incoming[k]) for k in keys]
    return incoming.join(target.select(*keys), same, "left_anti").dropDuplicates(keys)


def appended(target: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    return target.unionByName(new_rows(target, incoming, keys))


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by the given descending order; null keys count as equal."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def upserted(target: DataFrame, incoming: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Target and incoming rows, the highest version of each key; incoming wins ties."""
    both = target.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    return latest(both, keys, [F.desc_nulls_last(version), F.desc("_new")]).drop("_new")


def append_parquet(incoming: DataFrame, path: str, keys: list[str]) -> None:
    """Adds to a Parquet table what it doesn't hold; a replay adds nothing."""
    spark = incoming.sparkSession
    try:
        target = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        incoming.dropDuplicates(keys).write.mode("append").parquet(path)
        return
    new_rows(target, incoming, keys).write.mode("append").parquet(path)


def metrics_text(metrics: DataFrame, name: str, value: str, labels: list[str]) -> DataFrame:
    """A line of exposition text for each metric row."""
    pairs = F.concat_ws(",", *(F.concat(F.lit(f'{c}="'), F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r'(["\\])', r"\\$1"), F.lit('"')) for c in labels))
    return metrics.select(F.concat(F.lit(name + "{"), pairs, F.lit("} "), F.col(value).cast("string")).alias("line"))
