"""Queries of decoding, scalar functions, projectors and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollcall.functions import descriptions, scalars, u256
from rollcall.operators import decode, folds
from rollcall.operators.intervals import interval_join
from rollcall.plans import analogues as a
from rollcall.plans.registry import query
from rollcall.sources import logs, sinks
from rollcall.sources.block_log import block_log
from rollcall.sources.folders import new_folder


def block_events(spark, d, **options):
    """The event log as a source of block ranges, from a copy in the shared folder."""
    at = new_folder(spark, "log")
    a.logged(spark, d).select("pos", "delegator", "kind", "value").repartitionByRange(8, "pos").write.parquet(at)
    return block_log(spark, at, "pos", **options)


@query("SELECT lo + (pos - lo) // 700 * 700 AS from_block, least(lo + (pos - lo) // 700 * 700 + 699, hi) AS to_block, count(*) AS rows FROM logged, (SELECT min(pos) AS lo, max(pos) AS hi FROM logged) GROUP BY ALL")
def src_range_plan(spark, d):
    """The log read by ranges of 700 blocks: what each range has."""
    rows = block_events(spark, d, width=700, rows=200_000)
    ranges = logs.split_ranges(rows.agg(F.min("pos").alias("from_block"), F.max("pos").alias("to_block")).where("to_block IS NOT NULL"), 700)
    return interval_join(rows, "pos", ranges.select("chunk_from", "chunk_to"), "chunk_from", "chunk_to").groupBy(F.col("chunk_from").alias("from_block"), F.col("chunk_to").alias("to_block")).agg(F.count("*").alias("rows"))


@query("SELECT pos, delegator, kind FROM logged WHERE delegator IN (8, 46) AND kind IN ('click', 'view') AND pos BETWEEN 100 AND 9000")
def src_block_scan(spark, d):
    """As src_log_scan, through the source of block ranges, which takes all of the filter."""
    rows = block_events(spark, d, width=1000)
    return rows.where(F.col("delegator").isin(8, 46) & F.col("kind").isin("click", "view") & (F.col("pos") >= 100) & (F.col("pos") <= 9000)).select("pos", "delegator", "kind")


@query("SELECT pos, delegator, kind FROM logged WHERE delegator IN (8, 46) AND kind IN ('click', 'view') AND pos BETWEEN 100 AND 9000")
def src_log_scan(spark, d):
    rows = a.logged(spark, d).withColumns({"address": F.col("delegator").cast("string"), "topic0": F.col("kind"), "block_number": F.col("pos")})
    return rows.where(logs.log_filter(["8", "46"], ["click", "view"], 100, 9000)).select("pos", "delegator", "kind")


@query("SELECT pos, kind FROM logged WHERE (delegator = 8 AND kind IN ('click', 'view')) OR (delegator = 46 AND kind = 'error')")
def src_selector_union(spark, d):
    wanted = logs.selector_union({"8": {"click"}, "46": {"error"}}, {"8": {"view"}})
    pairs = spark.createDataFrame([(int(w), t) for w, ts in wanted.items() for t in ts], "delegator long, kind string")
    return a.logged(spark, d).join(F.broadcast(pairs), ["delegator", "kind"], "left_semi").select("pos", "kind")


@query("SELECT kind AS finality, max(pos) AS head FROM logged GROUP BY kind")
def src_head(spark, d):
    return logs.heads(a.logged(spark, d).withColumn("finality", F.col("kind")), block="pos")


@query("SELECT pos, CASE WHEN h > 0 AND m = 0 THEN 'full_hit' WHEN h > 0 AND m > 0 THEN 'partial_hit' WHEN h = 0 AND m > 0 THEN 'miss' WHEN h = 0 AND m = 0 THEN 'empty' ELSE 'unavailable' END AS outcome FROM (SELECT pos, CASE WHEN kind <> 'error' THEN value % 3 END AS h, pos % 2 AS m FROM logged)")
def src_cache_outcome(spark, d):
    return a.logged(spark, d).select("pos", scalars.cache_outcome(F.when(F.col("kind") != "error", F.col("value") % 3), F.col("pos") % 2).alias("outcome"))


@query("SELECT DISTINCT delegator, kind FROM logged WHERE pos >= 500 AND NOT EXISTS (SELECT 1 FROM logged o WHERE o.pos < 500 AND o.delegator = logged.delegator AND o.kind = logged.kind)")
def snk_append(spark, d):
    rows = a.logged(spark, d)
    return sinks.new_rows(rows.where("pos < 500").select("delegator", "kind"), rows.where("pos >= 500").select("delegator", "kind"), ["delegator", "kind"])


@query("SELECT kind, count(*) AS n FROM (SELECT DISTINCT delegator, kind FROM logged WHERE pos >= 500 AND NOT EXISTS (SELECT 1 FROM logged o WHERE o.pos < 500 AND o.delegator = logged.delegator AND o.kind = logged.kind)) GROUP BY kind")
def snk_insert_new_keys(spark, d):
    return snk_append(spark, d).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT delegator, arg_max(value, pos) AS value FROM logged GROUP BY delegator")
def snk_overlay_upsert(spark, d):
    rows = a.logged(spark, d).select("delegator", "pos", "value")
    return sinks.upserted(rows.where("pos < 500"), rows.where("pos >= 500"), ["delegator"], "pos").select("delegator", "value")


@query("""SELECT 'evm:1:' || CAST(pos AS VARCHAR) || ':0xab:' || CAST(delegator AS VARCHAR) || ':0' AS id, lower(kind) AS address, at_ms // 1000 * 1000 AS block_timestamp_ms FROM logged WHERE kind <> 'error'""")
def dec_normalize(spark, d):
    raw = a.logged(spark, d).select(
        F.col("pos").alias("block_number"), (F.col("at_ms") / 1000).cast("long").alias("block_timestamp"), F.lit("0xAB").alias("transaction_hash"), F.col("delegator").alias("transaction_index"), F.lit(0).cast("long").alias("log_index"),
        F.upper("kind").alias("address"), F.array(F.lit("0xAA")).alias("topics"), F.lit("0x").alias("data"), (F.col("kind") == "error").alias("removed"),
    )
    return decode.normalized(raw, 1).select("id", "address", "block_timestamp_ms")


@query("SELECT DISTINCT delegator, kind FROM logged")
def dec_dedup_conflict(spark, d):
    rows = a.logged(spark, d).select(F.concat_ws(":", F.col("delegator").cast("string"), "kind").alias("id"), "delegator", "kind")
    return decode.deduplicated(rows).select("delegator", "kind")


@query("SELECT count(*) AS n, 1 AS chains FROM logged")
def dec_chain_uniform(spark, d):
    rows = decode.one_chain(a.logged(spark, d).withColumn("chain_id", F.lit(1)))
    return rows.agg(F.count("*").alias("n"), F.countDistinct("chain_id").cast("int").alias("chains"))


@query("SELECT proposal_id, '0x' || lower(to_hex(proposal_id)) AS as_hex, CAST(proposal_id AS VARCHAR) AS as_decimal FROM proposal")
def fn_dec_hex(spark, d):
    text = a.proposals(spark, d).withColumn("as_hex", u256.decimal_to_hex(F.col("proposal_id").cast("string")))
    return text.select("proposal_id", "as_hex", u256.hex_to_decimal("as_hex").alias("as_decimal"))


@query("SELECT proposal_id, CAST(proposal_id AS VARCHAR) || ',0x' || lower(to_hex(proposal_id)) AS variants FROM proposal")
def fn_proposal_id_variants(spark, d):
    return a.proposals(spark, d).select("proposal_id", F.array_join(u256.proposal_id_variants(F.col("proposal_id").cast("string")), ",").alias("variants"))


@query("SELECT account, regexp_full_match(CAST(power AS VARCHAR), '0|[1-9][0-9]{0,77}') AS ok FROM contributor")
def fn_canonical_numeric(spark, d):
    return a.contributors(spark, d).select("account", u256.is_canonical(F.col("power").cast("string")).alias("ok"))


@query("SELECT proposal_id, CASE WHEN created < 1000000000000 THEN created * 1000 ELSE created END AS millis, quorum * 1000 AS scaled FROM proposal")
def fn_to_millis(spark, d):
    return a.proposals(spark, d).select("proposal_id", scalars.to_millis(F.col("created")).alias("millis"), scalars.seconds_to_millis(F.col("quorum")).alias("scaled"))


@query("SELECT proposal_id, CASE WHEN proposal_id >= 1000000000 OR created // 1000 >= 1000000000 THEN 'timestamp' ELSE 'blocknumber' END AS mode FROM proposal")
def fn_clock_mode(spark, d):
    return a.proposals(spark, d).select("proposal_id", scalars.clock_mode(F.col("proposal_id"), F.floor(F.col("created") / 1000)).alias("mode"))


@query("SELECT proposal_id, CASE chain_id WHEN 1 THEN '12' END AS interval FROM proposal")
def fn_block_interval(spark, d):
    return a.proposals(spark, d).select("proposal_id", scalars.block_interval(F.col("chain_id"), F.lit("blocknumber")).alias("interval"))


@query("SELECT proposal_id, CASE WHEN created + (proposal_id - 5000) * 12000 >= 0 THEN created + (proposal_id - 5000) * 12000 ELSE proposal_id END AS millis FROM proposal")
def fn_timepoint_ts(spark, d):
    return a.proposals(spark, d).select("proposal_id", scalars.timepoint_millis(F.col("proposal_id"), F.lit("blocknumber"), F.lit(5000), F.col("created"), F.lit("12")).alias("millis"))


@query("SELECT proposal_id, ['Pending', 'Active', 'Canceled', 'Defeated', 'Succeeded', 'Queued', 'Expired', 'Executed'][proposal_id % 8 + 1] AS state FROM proposal")
def fn_state_label(spark, d):
    return a.proposals(spark, d).select("proposal_id", scalars.proposal_state(F.col("proposal_id") % 8).alias("state"))


@query("SELECT proposal_id, split_part(split_part('dao=x|dataset=' || mode || '|token=y', 'dataset=', 2), '|', 1) AS dataset FROM proposal")
def fn_split_part(spark, d):
    return a.proposals(spark, d).select("proposal_id", scalars.dataset_of(F.concat(F.lit("dao=x|dataset="), "mode", F.lit("|token=y"))).alias("dataset"))


@query("SELECT doc_id FROM documents WHERE text ILIKE '%the and%'")
def fn_ilike(spark, d):
    return a.table(spark, d, "documents").where(scalars.contains_ci(F.col("text"), "the and")).select("doc_id")


@query()
def fn_title(spark, d):
    return a.table(spark, d, "documents").select("doc_id", descriptions.title("text").alias("title"), descriptions.body("text").alias("body"))


@query()
def fn_strip_markup(spark, d):
    return a.table(spark, d, "pages").select("page_id", descriptions.plain_text("html").alias("text"))


@query("SELECT proposal_id, CAST(proposal_id AS VARCHAR) || ':action:' || CAST(i AS VARCHAR) AS id, CASE i WHEN 0 THEN state ELSE mode END AS target FROM proposal, (SELECT unnest([0, 1]) AS i)")
def prj_proposal_actions(spark, d):
    acts = a.proposals(spark, d).select("proposal_id", F.posexplode(F.arrays_zip(F.array("state", "mode").alias("targets"))).alias("i", "x"))
    return acts.select("proposal_id", F.concat_ws(":action:", F.col("proposal_id").cast("string"), F.col("i").cast("string")).alias("id"), F.col("x.targets").alias("target"))


@query("SELECT delegator, pos, kind, lead(pos) OVER (PARTITION BY delegator ORDER BY pos) AS until FROM logged")
def prj_state_epochs(spark, d):
    return folds.state_epochs(a.logged(spark, d), "delegator", "kind").select("delegator", "pos", "kind", "until")


FOLD = """SELECT delegator, arg_max(kind, pos) AS kind, arg_min(kind, pos) FILTER (WHERE kind <> 'view') AS first_kind, max(value) AS value, CAST(sum(value) AS BIGINT) AS total FROM logged GROUP BY delegator"""


@query(FOLD)
def fld_proposal_merge(spark, d):
    rows = a.logged(spark, d).withColumns({"first_kind": F.nullif("kind", F.lit("view")), "total": F.col("value")})
    return folds.merged(rows, ["delegator"], overwrite=["kind"], keep=["first_kind"], greatest=["value"], total=["total"])


@query("SELECT delegator, pos, value, coalesce(lag(value) OVER (PARTITION BY delegator ORDER BY pos), at_ms % 1000) AS previous_deadline FROM logged")
def prj_deadline_ext(spark, d):
    rows = a.logged(spark, d).withColumn("ends", F.col("at_ms") % 1000)
    return folds.deadline_extensions(rows, "delegator", "value", "ends").select("delegator", "pos", "value", "previous_deadline")


@query("SELECT proposal_id, voter, weight, CASE WHEN with_params THEN 'vote-cast-with-params' ELSE 'vote-cast' END AS type FROM vote")
def prj_vote_unify(spark, d):
    v = a.votes(spark, d)
    tagged = lambda rows, t: rows.select("proposal_id", "voter", "weight", F.lit(t).alias("type"))
    return tagged(v.where("NOT with_params"), "vote-cast").unionByName(tagged(v.where("with_params"), "vote-cast-with-params"))


def delegation_log(spark, d):
    """signup, purchase and error change the delegate (error: to none), view and click move power."""
    rows = a.logged(spark, d)
    target = F.when(F.col("kind") == "error", "zero").otherwise(F.concat(F.lit("d"), (F.col("value") % 4).cast("string")))
    change = F.col("kind").isin("signup", "purchase", "error")
    source = F.when(F.col("kind") == "purchase", target).otherwise("zero")
    delta = F.when(F.col("kind") == "view", F.col("value")).otherwise(-F.col("value"))
    of = F.when(F.col("kind") == "click", F.lit("d1"))
    return rows.select(
        "delegator", "pos", F.when(change, "change").otherwise("delta").alias("kind"), F.when(change, source).alias("from_delegate"), F.when(change, target).otherwise(of).alias("to_delegate"), F.when(change, 0).otherwise(delta).cast("long").alias("delta")
    )


DELEGATIONS = """, l AS (
  SELECT delegator, pos, kind IN ('signup', 'purchase', 'error') AS change, CASE WHEN kind = 'error' THEN 'zero' ELSE 'd' || CAST(value % 4 AS VARCHAR) END AS target, kind, CASE WHEN kind = 'view' THEN value ELSE -value END AS delta FROM logged
), b AS (
  SELECT *, last_value(CASE WHEN change THEN target END IGNORE NULLS) OVER (PARTITION BY delegator ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM l
), s AS (
  SELECT *, sum(CASE WHEN change AND NOT (kind = 'purchase' AND target <> 'zero' AND before IS NOT DISTINCT FROM target) THEN 1 ELSE 0 END) OVER (PARTITION BY delegator ORDER BY pos) AS segment FROM b
), t AS (
  SELECT *, first_value(target) OVER (PARTITION BY delegator, segment ORDER BY pos) AS delegate FROM s WHERE segment > 0
), f AS (
  SELECT delegator, segment, delegate, CAST(sum(CASE WHEN NOT change AND (kind = 'view' OR delegate = 'd1') THEN delta ELSE 0 END) AS BIGINT) AS power FROM t GROUP BY delegator, segment, delegate
), g AS (SELECT *, segment = max(segment) OVER (PARTITION BY delegator) AND delegate <> 'zero' AS is_current FROM f)
"""


def folded(spark, d):
    return folds.delegation_fold(delegation_log(spark, d), zero="zero")


@query("SELECT * FROM (WITH" + DELEGATIONS.replace(",", " ", 1) + "SELECT delegator, CAST(segment AS BIGINT) AS segment, delegate, power, is_current FROM g)")
def fld_delegate_change(spark, d):
    return folded(spark, d).select("delegator", "segment", "delegate", F.col("power").cast("long").alias("power"), "is_current")


@query("SELECT * FROM (WITH" + DELEGATIONS.replace(",", " ", 1) + "SELECT delegator, delegate, power FROM g WHERE is_current)")
def fld_mapping_snapshot(spark, d):
    return folds.mappings(folded(spark, d)).select("delegator", "delegate", F.col("power").cast("long").alias("power"))


@query("SELECT * FROM (WITH" + DELEGATIONS.replace(",", " ", 1) + "SELECT delegate, count(*) AS delegates_all, count(*) FILTER (WHERE power <> 0) AS delegates_effective FROM g WHERE is_current GROUP BY delegate)")
def fld_delegate_snapshot(spark, d):
    return folds.delegate_counts(folds.mappings(folded(spark, d)))


@query("SELECT * FROM (WITH" + DELEGATIONS.replace(",", " ", 1) + "SELECT delegate, CAST(sum(power) AS BIGINT) AS power FROM g WHERE is_current GROUP BY delegate)")
def fld_delegate_delta(spark, d):
    return folds.mappings(folded(spark, d)).groupBy("delegate").agg(F.sum("power").cast("long").alias("power"))


@query()
def fld_rolling_match(spark, d):
    rows = delegation_log(spark, d).select(F.lit("set").alias("contract_set_id"), F.floor(F.col("pos") / 20).cast("string").alias("transaction_hash"), F.col("pos").alias("log_index"), "*")
    changes = rows.where("kind = 'change'").select("contract_set_id", "transaction_hash", "log_index", F.col("delegator").cast("string").alias("delegator"), "from_delegate", "to_delegate")
    votes = rows.where("kind = 'delta'").select("contract_set_id", "transaction_hash", "log_index", F.concat(F.lit("d"), (F.col("delegator") % 4).cast("string")).alias("delegate"), F.col("delta").cast("string").alias("delta"))
    return folds.rolling_match(changes, votes)


@query("""SELECT pos, delta, CASE WHEN c AND m THEN 'delegate-change+transfer' WHEN c THEN 'delegate-change' WHEN m THEN 'transfer' ELSE 'delegate-votes-changed' END AS cause FROM (
  SELECT pos, kind, value - 3 AS delta, bool_or(kind IN ('signup', 'error')) OVER (PARTITION BY pos // 5) AS c, bool_or(kind = 'click') OVER (PARTITION BY pos // 5) AS m FROM logged) WHERE kind = 'view'""")
def fld_power_checkpoint(spark, d):
    rows = a.logged(spark, d).withColumns({"tx": F.floor(F.col("pos") / 5), "new_votes": F.col("value"), "previous_votes": F.lit(3).cast("long")})
    return folds.power_checkpoints(rows.where("kind = 'view'"), rows.where("kind IN ('signup', 'error')"), rows.where("kind = 'click'"), ["tx"]).select("pos", "delta", "cause")


@query("SELECT account, min(pos) AS first_seen FROM (SELECT delegator AS account, pos FROM logged UNION ALL SELECT pos % 50, pos FROM logged) GROUP BY account")
def fld_contributor_ensure(spark, d):
    rows = a.logged(spark, d)
    seen = rows.select(F.col("delegator").alias("account"), "pos").union(rows.select((F.col("pos") % 50).alias("account"), "pos"))
    return folds.first_seen(seen, "account")


@query("SELECT DISTINCT lower(segment) AS delegate FROM contributor")
def fld_profile_insert(spark, d):
    return a.contributors(spark, d).select(F.lower("segment").alias("delegate")).distinct()


@query("SELECT delegator, max(CASE kind WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 ELSE 0 END) AS state, CAST(sum(value) AS BIGINT) AS calls, arg_max(kind, pos) AS last_kind FROM logged GROUP BY delegator")
def fld_timelock_op(spark, d):
    rank = F.when(F.col("kind") == "signup", 1).when(F.col("kind") == "purchase", 2).otherwise(0)
    rows = a.logged(spark, d).withColumns({"state": rank, "calls": F.col("value"), "last_kind": F.col("kind")})
    return folds.merged(rows, ["delegator"], overwrite=["last_kind"], keep=[], greatest=["state"], total=["calls"])


@query("SELECT delegator, kind, max(value) AS value, arg_max(props, pos) AS props FROM logged GROUP BY delegator, kind")
def fld_timelock_call(spark, d):
    return folds.merged(a.logged(spark, d), ["delegator", "kind"], overwrite=["props"], keep=[], greatest=["value"])


@query("SELECT v.proposal_id, v.log_index, v.voter, o.weight AS linked FROM durable v LEFT JOIN overlay o ON o.proposal_id = v.proposal_id AND o.voter = v.voter AND o.support = v.support AND o.with_params = v.with_params AND o.log_index = v.log_index AND o.cast_ms = v.cast_ms AND o.weight = v.weight")
def jn_timelock_link(spark, d):
    keys = ["proposal_id", "voter", "support", "with_params", "log_index", "cast_ms", "weight"]
    o = a.overlay_votes(spark, d).select(*keys, F.col("weight").alias("linked"))
    return a.durable_votes(spark, d).join(o, keys, "left").select("proposal_id", "log_index", "voter", "linked")


@query("SELECT delegator, pos, count(*) FILTER (WHERE kind = 'view') OVER w AS views, CAST(sum(value) OVER w AS BIGINT) AS total FROM logged WINDOW w AS (PARTITION BY delegator ORDER BY pos)")
def fld_metric_timeline(spark, d):
    rows = folds.timeline(a.logged(spark, d), ["delegator"], "pos", {"views": F.col("kind") == "view"}, {"total": F.col("value")})
    return rows.select("delegator", "pos", "views", "total")
