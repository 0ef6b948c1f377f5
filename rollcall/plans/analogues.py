"""The governance entities, read from the driver's tables, and the same as SQL.

Orders are proposals, line items their votes (the first three numbers are durable, the third and later ones
provisional), customers are contributors, and events are the log of delegations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Views for the SQL of every query.
SQL = """
proposal AS (
  SELECT CAST(o_orderkey AS BIGINT) AS proposal_id, CAST(o_custkey AS BIGINT) AS proposer, o_orderstatus AS state, CAST(epoch_us(o_orderdate) // 1000 AS BIGINT) AS created,
    o_orderpriority AS mode, CAST(o_orderkey % 3 AS BIGINT) AS chain_id, CAST(floor(o_totalprice) AS BIGINT) AS quorum FROM orders
), vote AS (
  SELECT CAST(l_orderkey AS BIGINT) AS proposal_id, CAST(l_suppkey AS BIGINT) AS voter, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS support,
    l_linestatus = 'F' AS with_params, CAST(floor(l_quantity) AS BIGINT) AS weight, CAST(l_linenumber AS BIGINT) AS log_index, CAST(epoch_us(l_shipdate) // 1000 AS BIGINT) AS cast_ms FROM lineitem
), durable AS (SELECT * FROM vote WHERE log_index <= 3
), overlay AS (SELECT * FROM vote WHERE log_index >= 3
), overlay_only AS (SELECT o.* FROM overlay o WHERE NOT EXISTS (SELECT 1 FROM durable d WHERE d.proposal_id = o.proposal_id AND d.log_index = o.log_index)
), contributor AS (
  SELECT CAST(c_custkey AS BIGINT) AS account, CAST(floor(c_acctbal) AS BIGINT) AS power, CAST(c_nationkey AS BIGINT) AS scope, c_mktsegment AS segment FROM customer
), live AS (
  SELECT account, power + 1000 AS power, scope, segment FROM contributor WHERE account % 7 = 0
  UNION ALL SELECT account + 1000000000, power, scope, segment FROM contributor WHERE account % 11 = 0
), logged AS (
  SELECT CAST(event_id AS BIGINT) AS pos, CAST(user_id AS BIGINT) AS delegator, event_type AS kind, CAST(epoch_us(ts) // 1000 AS BIGINT) AS at_ms, CAST(floor(value) AS BIGINT) AS value, props FROM events
)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(column: str) -> F.Column:
    return F.unix_millis(F.col(column).cast("timestamp"))


def whole(column: str) -> F.Column:
    return F.floor(F.col(column)).cast("long")


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("long").alias("proposal_id"), F.col("o_custkey").cast("long").alias("proposer"), F.col("o_orderstatus").alias("state"), millis("o_orderdate").alias("created"),
        F.col("o_orderpriority").alias("mode"), (F.col("o_orderkey") % 3).cast("long").alias("chain_id"), whole("o_totalprice").alias("quorum"),
    )


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("long").alias("proposal_id"), F.col("l_suppkey").cast("long").alias("voter"), F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("support"),
        (F.col("l_linestatus") == "F").alias("with_params"), whole("l_quantity").alias("weight"), F.col("l_linenumber").cast("long").alias("log_index"), millis("l_shipdate").alias("cast_ms"),
    )


def durable_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes(spark, sf_dir).where("log_index <= 3")


def overlay_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes(spark, sf_dir).where("log_index >= 3")


def contributors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("account"), whole("c_acctbal").alias("power"), F.col("c_nationkey").cast("long").alias("scope"), F.col("c_mktsegment").alias("segment"))


def live_contributors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live powers of some contributors, and accounts that only the overlay has."""
    c = contributors(spark, sf_dir)
    known = c.where("account % 7 = 0").withColumn("power", F.col("power") + 1000)
    new = c.where("account % 11 = 0").withColumn("account", F.col("account") + 1_000_000_000)
    return known.unionByName(new).withColumns({"status": F.lit("available"), "source": F.lit("live-onchain")})


def logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("long").alias("pos"), F.col("user_id").cast("long").alias("delegator"), F.col("event_type").alias("kind"), millis("ts").alias("at_ms"), whole("value").alias("value"), "props"
    )
