"""Queries of the served entities: filters, joins, aggregates, windows, pages and overlays."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rollcall.functions import u256
from rollcall.operators import filters, overlay
from rollcall.operators.status import ranked
from rollcall.plans import analogues as a
from rollcall.plans.registry import query

TOTALS = """count(*) AS n_votes, count(*) FILTER (WHERE NOT with_params) AS n_plain, count(*) FILTER (WHERE with_params) AS n_with_params,
  CAST(coalesce(sum(weight) FILTER (WHERE support = 1), 0) AS BIGINT) AS votes_for, CAST(coalesce(sum(weight) FILTER (WHERE support = 0), 0) AS BIGINT) AS votes_against,
  CAST(coalesce(sum(weight) FILTER (WHERE support = 2), 0) AS BIGINT) AS votes_abstain"""


def totals() -> list:
    """Vote totals of a proposal; other kinds of support count without weight."""
    part = lambda s: F.coalesce(F.sum(F.when(F.col("support") == s, F.col("weight"))), F.lit(0)).cast("long")
    return [
        F.count("*").alias("n_votes"), F.count_if(~F.col("with_params")).alias("n_plain"), F.count_if("with_params").alias("n_with_params"),
        part(1).alias("votes_for"), part(0).alias("votes_against"), part(2).alias("votes_abstain"),
    ]


def overlay_only(spark, d):
    """Provisional votes without a durable twin."""
    return filters.missing(a.overlay_votes(spark, d), a.durable_votes(spark, d).select("proposal_id", "log_index"), {"proposal_id": "proposal_id", "log_index": "log_index"})


def all_votes(spark, d):
    return a.durable_votes(spark, d).unionByName(overlay_only(spark, d))


@query(f"SELECT proposal_id, {TOTALS} FROM durable GROUP BY proposal_id")
def agg_vote_totals(spark, d):
    return a.durable_votes(spark, d).groupBy("proposal_id").agg(*totals())


@query(f"SELECT proposal_id, {TOTALS} FROM overlay_only GROUP BY proposal_id")
def agg_vote_overlay_totals(spark, d):
    return overlay_only(spark, d).groupBy("proposal_id").agg(*totals())


PAGE = f"""SELECT p.proposal_id, p.proposer, p.state, p.created, v.n_votes, v.votes_for, v.votes_against, v.votes_abstain
FROM proposal p JOIN (SELECT proposal_id, {TOTALS} FROM (SELECT * FROM durable UNION ALL SELECT * FROM overlay_only) GROUP BY proposal_id) v USING (proposal_id)
WHERE p.state <> 'P' AND (v.votes_for > v.votes_against OR p.chain_id = 1) ORDER BY v.votes_for DESC, p.created ASC NULLS LAST, p.proposal_id ASC LIMIT 20 OFFSET 20"""


@query(PAGE)
def proposals_page(spark, d):
    served = a.proposals(spark, d).join(all_votes(spark, d).groupBy("proposal_id").agg(*totals()), "proposal_id")
    chosen = served.where(filters.condition({"state_not_eq": "P"}) & ((F.col("votes_for") > F.col("votes_against")) | (F.col("chain_id") == 1)))
    by = filters.ordered(chosen, ["votes_for_DESC_NULLS_LAST", "created_ASC"], tie="proposal_id")
    return filters.page(by, 20, 20).select("proposal_id", "proposer", "state", "created", "n_votes", "votes_for", "votes_against", "votes_abstain")


@query("SELECT proposal_id, CAST(sum(CAST(weight AS HUGEINT)) AS VARCHAR) || '000000000000000000000000000000' AS power FROM vote GROUP BY proposal_id")
def fn_u256_addsub(spark, d):
    wide = a.votes(spark, d).withColumn("units", F.concat(F.col("weight").cast("string"), F.lit("0" * 30)))
    return wide.groupBy("proposal_id").agg(u256.total(F.col("units")).alias("power"))


@query("SELECT account, CAST(power AS VARCHAR) AS power, CASE WHEN power < 0 THEN '-' ELSE '' END || CAST(abs(power) // 1000 AS VARCHAR) AS compact, power <> 0 AS nonzero, power < 0 AS negative FROM contributor")
def fn_u256_normalize(spark, d):
    text = F.when(F.col("power") < 0, F.concat(F.lit("-000"), F.abs("power").cast("string"))).otherwise(F.concat(F.lit("000"), F.col("power").cast("string")))
    c = a.contributors(spark, d).withColumn("text", text)
    return c.select("account", u256.canonical(F.col("text")).alias("power"), u256.compact_amount(u256.canonical(F.col("text")), 3).alias("compact"), u256.is_nonzero(F.col("text")).alias("nonzero"), u256.is_negative(F.col("text")).alias("negative"))


@query("SELECT proposal_id, state, chain_id FROM proposal WHERE chain_id = 2 AND state = 'F'")
def flt_scope_explicit(spark, d):
    return a.proposals(spark, d).where(filters.condition({"chain_id_eq": 2, "state_eq": "F", "proposer_eq": None})).select("proposal_id", "state", "chain_id")


@query("SELECT v.proposal_id, v.voter, v.log_index, v.weight FROM vote v WHERE EXISTS (SELECT 1 FROM proposal p WHERE p.proposal_id = v.proposal_id AND p.state = 'P')")
def flt_event_scope(spark, d):
    inside = a.proposals(spark, d).where("state = 'P'").select(F.col("proposal_id").alias("pid"))
    return filters.exists(a.votes(spark, d), inside, {"proposal_id": "pid"}).select("proposal_id", "voter", "log_index", "weight")


@query("SELECT proposal_id, proposer, state, created FROM proposal WHERE proposal_id > 100 AND created >= 850000000000 AND created < 900000000000 AND (mode ILIKE '%high%' OR state = 'P')")
def flt_proposal(spark, d):
    where = {"proposal_id_gt": 100, "created_gte": 850_000_000_000, "created_lt": 900_000_000_000, "OR": [{"mode_ilike": "high"}, {"state_eq": "P"}]}
    return a.proposals(spark, d).where(filters.condition(where)).select("proposal_id", "proposer", "state", "created")


@query("SELECT proposal_id, state FROM proposal WHERE CAST(proposal_id AS VARCHAR) IN ('255', '0xff', '16') OR '0x' || lower(to_hex(proposal_id)) IN ('255', '0xff', '16')")
def flt_proposal_id(spark, d):
    stored = a.proposals(spark, d).withColumn("as_hex", F.concat(F.lit("0x"), F.lower(F.hex("proposal_id"))))
    variants = ["255", "0xff", "16"]
    return stored.where(F.col("proposal_id").cast("string").isin(variants) | F.col("as_hex").isin(variants)).select("proposal_id", "state")


@query("""SELECT proposal_id, proposer, state FROM proposal p WHERE EXISTS (SELECT 1 FROM durable v WHERE v.proposal_id = p.proposal_id AND v.voter < 4)
  OR EXISTS (SELECT 1 FROM overlay v WHERE v.proposal_id = p.proposal_id AND v.support = 2 AND v.weight > 45)""")
def flt_voters_some(spark, d):
    durable = a.durable_votes(spark, d).where("voter < 4").select(F.col("proposal_id").alias("pid"))
    live = a.overlay_votes(spark, d).where("support = 2 AND weight > 45").select(F.col("proposal_id").alias("pid"))
    return filters.exists_any(a.proposals(spark, d), "proposal_id", (durable, {"proposal_id": "pid"}), (live, {"proposal_id": "pid"})).select("proposal_id", "proposer", "state")


@query("SELECT proposal_id, voter, support, weight, log_index FROM durable WHERE support = 1 AND (voter = 7 OR voter = 9 OR weight = 50)")
def flt_vote_group(spark, d):
    where = {"support_eq": 1, "OR": [{"voter_eq": 7}, {"voter_eq": 9}, {"weight_eq": 50}]}
    return a.durable_votes(spark, d).where(filters.condition(where)).select("proposal_id", "voter", "support", "weight", "log_index")


@query("SELECT account, power, segment FROM contributor WHERE scope = 3 AND segment <> 'BUILDING' AND (power > 5000 OR power < 0)")
def flt_data_metric(spark, d):
    return a.contributors(spark, d).where(filters.condition({"scope_eq": 3, "segment_not_eq": "BUILDING", "OR": [{"power_gt": 5000}, {"power_lt": 0}]})).select("account", "power", "segment")


@query("SELECT account, power FROM contributor WHERE power < 100 AND account NOT IN (5) AND (scope IN (1, 2, 3) OR power > 50)")
def flt_contributor(spark, d):
    return a.contributors(spark, d).where(filters.condition({"power_lt": 100, "account_not_eq": 5, "OR": [{"scope_in": [1, 2, 3]}, {"power_gt": 50}]})).select("account", "power")


@query("SELECT DISTINCT delegator, kind FROM logged WHERE kind = 'click' AND value < 5")
def flt_delegate(spark, d):
    return a.logged(spark, d).where(filters.condition({"kind_eq": "click", "value_lt": 5})).select("delegator", "kind").distinct()


@query("SELECT account, segment FROM contributor WHERE lower(segment) = lower('Automobile')")
def flt_delegate_profile(spark, d):
    return a.contributors(spark, d).where(filters.condition({"segment_ieq": "Automobile"})).select("account", "segment")


@query("SELECT pos, delegator, kind FROM logged WHERE delegator = 8 AND kind = 'view'")
def flt_delegate_mapping(spark, d):
    return a.logged(spark, d).where(filters.condition({"delegator_eq": 8, "kind_eq": "view"})).select("pos", "delegator", "kind")


@query("SELECT proposal_id, proposer FROM proposal WHERE proposer = 77 AND (state = 'F' OR chain_id = 0)")
def flt_or_group(spark, d):
    return a.proposals(spark, d).where(filters.condition({"proposer_eq": 77, "OR": [{"state_eq": "F"}, {"chain_id_eq": 0}]})).select("proposal_id", "proposer")


@query("SELECT proposal_id, quorum FROM proposal WHERE quorum >= 400000")
def flt_numeric78(spark, d):
    least = filters.checked_numeric("400000")
    key = u256.sort_key(F.col("quorum").cast("string"))
    return a.proposals(spark, d).where(key >= u256.sort_key(F.lit(least))).select("proposal_id", "quorum")


@query("SELECT CAST(proposal_id AS VARCHAR) AS proposal_id, CAST(quorum AS VARCHAR) || '000000000000000000' AS quorum FROM proposal")
def prj_text_casts(spark, d):
    return a.proposals(spark, d).select(F.col("proposal_id").cast("string"), F.concat(F.col("quorum").cast("string"), F.lit("0" * 18)).alias("quorum"))


@query("SELECT c.account, coalesce(l.power, c.power, 0) AS power, coalesce(l.segment, c.segment) AS segment FROM contributor c LEFT JOIN live l USING (account)")
def prj_coalesce_chain(spark, d):
    live = a.live_contributors(spark, d).select("account", F.col("power").alias("lp"), F.col("segment").alias("ls"))
    return a.contributors(spark, d).join(live, "account", "left").select("account", F.coalesce("lp", "power", F.lit(0)).cast("long").alias("power"), F.coalesce("ls", "segment").alias("segment"))


@query("SELECT c.account, CASE WHEN l.account IS NULL THEN c.segment END AS segment FROM contributor c LEFT JOIN live l USING (account)")
def prj_conditional_null(spark, d):
    live = a.live_contributors(spark, d).select(F.col("account").alias("la"))
    return a.contributors(spark, d).join(live, F.col("account") == F.col("la"), "left").select("account", F.when(F.col("la").isNull(), F.col("segment")).alias("segment"))


@query("SELECT c.account, c.power, l.power AS live_power FROM contributor c LEFT JOIN live l ON l.account = c.account AND l.scope IS NOT DISTINCT FROM c.scope AND l.segment = 'BUILDING'")
def jn_left_overlay(spark, d):
    live = a.live_contributors(spark, d).where("segment = 'BUILDING'").select(F.col("account").alias("la"), F.col("scope").alias("ls"), F.col("power").alias("live_power"))
    return a.contributors(spark, d).join(live, (F.col("account") == F.col("la")) & F.col("scope").eqNullSafe(F.col("ls")), "left").select("account", "power", "live_power")


@query("SELECT p.proposal_id, p.chain_id, count(v.voter) AS n FROM proposal p LEFT JOIN (SELECT proposal_id, voter, CASE WHEN voter % 2 = 0 THEN voter % 3 END AS chain FROM vote) v ON v.proposal_id = p.proposal_id AND (v.chain IS NOT DISTINCT FROM p.chain_id OR v.chain IS NULL) GROUP BY ALL")
def jn_left_optional_key(spark, d):
    v = a.votes(spark, d).select(F.col("proposal_id").alias("pid"), "voter", F.when(F.col("voter") % 2 == 0, F.col("voter") % 3).alias("chain"))
    on = (F.col("pid") == F.col("proposal_id")) & (F.col("chain").eqNullSafe(F.col("chain_id")) | F.col("chain").isNull())
    return a.proposals(spark, d).join(v, on, "left").groupBy("proposal_id", "chain_id").agg(F.count("voter").alias("n"))


@query("SELECT p.proposal_id, coalesce(v.n, 0) AS n, v.last_ms FROM proposal p LEFT JOIN (SELECT proposal_id, count(*) AS n, max(cast_ms) AS last_ms FROM vote GROUP BY proposal_id) v USING (proposal_id)")
def jn_lateral_agg(spark, d):
    v = a.votes(spark, d).groupBy("proposal_id").agg(F.count("*").alias("n"), F.max("cast_ms").alias("last_ms"))
    return a.proposals(spark, d).join(v, "proposal_id", "left").select("proposal_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "last_ms")


@query("SELECT proposal_id, voter, log_index, weight FROM overlay_only")
def jn_anti_not_exists(spark, d):
    return overlay_only(spark, d).select("proposal_id", "voter", "log_index", "weight")


@query("SELECT account, scope FROM contributor c WHERE EXISTS (SELECT 1 FROM proposal p WHERE p.proposer = c.account AND p.state = 'P')")
def jn_semi_exists(spark, d):
    return filters.exists(a.contributors(spark, d), a.proposals(spark, d).where("state = 'P'").select("proposer"), {"account": "proposer"}).select("account", "scope")


@query("SELECT p.proposal_id, q.log_index AS queued, x.log_index AS executed FROM proposal p JOIN durable q ON q.proposal_id = p.proposal_id AND q.log_index = 1 LEFT JOIN overlay x ON x.proposal_id = q.proposal_id AND x.voter IS NOT DISTINCT FROM q.voter")
def jn_inner_multi(spark, d):
    q = a.durable_votes(spark, d).where("log_index = 1").select(F.col("proposal_id").alias("qp"), F.col("voter").alias("qv"), F.col("log_index").alias("queued"))
    x = a.overlay_votes(spark, d).select(F.col("proposal_id").alias("xp"), F.col("voter").alias("xv"), F.col("log_index").alias("executed"))
    both = a.proposals(spark, d).join(q, F.col("proposal_id") == F.col("qp"))
    return both.join(x, (F.col("xp") == F.col("qp")) & F.col("xv").eqNullSafe(F.col("qv")), "left").select("proposal_id", "queued", "executed")


@query("SELECT c.account, coalesce(l.power, c.power) AS power FROM contributor c LEFT JOIN live l USING (account)")
def jn_update_from(spark, d):
    live = overlay.available(a.live_contributors(spark, d))
    return overlay.patched(a.contributors(spark, d), live, ["account"], ["power"]).select("account", "power")


@query("SELECT pos, delegator, value, last_value(CASE WHEN kind = 'signup' OR kind = 'purchase' THEN kind END IGNORE NULLS) OVER (PARTITION BY delegator ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mapping FROM logged")
def jn_asof_current(spark, d):
    w = Window.partitionBy("delegator").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    change = F.when(F.col("kind").isin("signup", "purchase"), F.col("kind"))
    return a.logged(spark, d).select("pos", "delegator", "value", F.last(change, ignorenulls=True).over(w).alias("mapping"))


@query("SELECT v.proposal_id, v.log_index, coalesce('orders:' || CAST(p.proposal_id AS VARCHAR), 'unknown') AS ref FROM vote v LEFT JOIN proposal p ON p.proposal_id = v.proposal_id AND p.state <> 'P'")
def jn_resolve_ref(spark, d):
    p = a.proposals(spark, d).where("state <> 'P'").select(F.col("proposal_id").alias("pid"))
    return a.votes(spark, d).join(p, F.col("pid") == F.col("proposal_id"), "left").select("proposal_id", "log_index", F.coalesce(F.concat(F.lit("orders:"), F.col("pid").cast("string")), F.lit("unknown")).alias("ref"))


@query("SELECT c.account, n.n_name AS name, r.r_name AS region FROM contributor c JOIN nation n ON n.n_nationkey = c.scope JOIN region r ON r.r_regionkey = n.n_regionkey")
def jn_client_lookup(spark, d):
    n, r = a.table(spark, d, "nation"), a.table(spark, d, "region")  # fixed tables of 25 and 5 rows
    names = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("long").alias("scope"), F.col("n_name").alias("name"), F.col("r_name").alias("region"))
    return a.contributors(spark, d).join(F.broadcast(names), "scope").select("account", "name", "region")


@query("SELECT proposal_id, CAST(sum(weight) AS BIGINT) AS weight, count(*) AS n FROM (SELECT * FROM vote QUALIFY row_number() OVER (PARTITION BY proposal_id, voter ORDER BY cast_ms DESC, log_index DESC, weight DESC, support DESC) = 1) GROUP BY proposal_id")
def agg_vote_replace(spark, d):
    """A voter's later vote replaces the earlier one."""
    last = F.max(F.struct("cast_ms", "log_index", "weight", "support")).alias("v")
    return a.votes(spark, d).groupBy("proposal_id", "voter").agg(last).groupBy("proposal_id").agg(F.sum("v.weight").alias("weight"), F.count("*").alias("n"))


@query(f"SELECT p.chain_id, {TOTALS} FROM durable v JOIN proposal p USING (proposal_id) GROUP BY p.chain_id")
def agg_metric_votes(spark, d):
    return a.durable_votes(spark, d).join(a.proposals(spark, d).select("proposal_id", "chain_id"), "proposal_id").groupBy("chain_id").agg(*totals())


@query("SELECT chain_id, count(*) AS proposals FROM proposal GROUP BY chain_id")
def agg_metric_proposals(spark, d):
    return a.proposals(spark, d).groupBy("chain_id").agg(F.count("*").alias("proposals"))


@query("""SELECT scope, CAST(sum(power) AS BIGINT) AS power_sum, count(*) AS contributors, CASE WHEN count(balance) > 0 THEN count(*) FILTER (WHERE balance > 0) ELSE count(*) END AS holders
FROM (SELECT *, CASE WHEN scope % 2 = 0 THEN power END AS balance FROM contributor) GROUP BY scope""")
def agg_metric_contributors(spark, d):
    c = a.contributors(spark, d).withColumn("balance", F.when(F.col("scope") % 2 == 0, F.col("power")))
    holders = F.when(F.count("balance") > 0, F.count_if(F.col("balance") > 0)).otherwise(F.count("*"))
    return c.groupBy("scope").agg(F.sum("power").alias("power_sum"), F.count("*").alias("contributors"), holders.alias("holders"))


@query("""SELECT m.scope, m.n + coalesce(o.n, 0) AS n, CAST(m.power + coalesce(o.power, 0) AS BIGINT) AS power FROM (SELECT scope, count(*) AS n, sum(power) AS power FROM contributor GROUP BY scope) m
LEFT JOIN (SELECT scope, count(*) AS n, sum(power) AS power FROM live l WHERE NOT EXISTS (SELECT 1 FROM contributor c WHERE c.account = l.account) GROUP BY scope) o USING (scope)""")
def agg_metric_overlay(spark, d):
    c = a.contributors(spark, d)
    only = filters.missing(a.live_contributors(spark, d), c.select(F.col("account").alias("known")), {"account": "known"})
    sums = lambda rows, s: rows.groupBy("scope").agg(F.count("*").alias(f"n{s}"), F.sum("power").alias(f"p{s}"))
    both = sums(c, 0).join(sums(only, 1), "scope", "left")
    return both.select("scope", (F.col("n0") + F.coalesce("n1", F.lit(0))).alias("n"), (F.col("p0") + F.coalesce("p1", F.lit(0))).alias("power"))


@query("SELECT c.account, coalesce(h.n, m.n, 0) AS members FROM contributor c LEFT JOIN (SELECT proposer, count(*) AS n FROM proposal WHERE state = 'P' GROUP BY 1) h ON h.proposer = c.account LEFT JOIN (SELECT proposer, count(*) AS n FROM proposal GROUP BY 1) m ON m.proposer = c.account")
def agg_metric_fallbacks(spark, d):
    p = a.proposals(spark, d).groupBy("proposer").agg(F.count_if(F.col("state") == "P").alias("h"), F.count("*").alias("m"))
    return a.contributors(spark, d).join(p, F.col("account") == F.col("proposer"), "left").select("account", F.coalesce(F.nullif("h", F.lit(0)), "m", F.lit(0)).cast("long").alias("members"))


@query("SELECT voter AS delegate, count(*) AS delegates_all, count(*) FILTER (WHERE weight > 25) AS delegates_effective FROM vote GROUP BY voter")
def agg_delegate_counts(spark, d):
    return a.votes(spark, d).groupBy(F.col("voter").alias("delegate")).agg(F.count("*").alias("delegates_all"), F.count_if(F.col("weight") > 25).alias("delegates_effective"))


@query("SELECT count(DISTINCT lower(segment)) AS profiles, count(DISTINCT scope) AS scopes FROM contributor WHERE account <> 0")
def agg_distinct_profiles(spark, d):
    return a.contributors(spark, d).where("account <> 0").agg(F.countDistinct(F.lower("segment")).alias("profiles"), F.countDistinct("scope").alias("scopes"))


@query("SELECT scope, min(power) AS lo, max(power) AS hi, count(power) = count(*) AND min(power) = max(power) AS uniform FROM contributor GROUP BY scope")
def agg_profile_fastpath(spark, d):
    lo, hi = F.min("power"), F.max("power")
    return a.contributors(spark, d).groupBy("scope").agg(lo.alias("lo"), hi.alias("hi"), ((F.count("power") == F.count("*")) & (lo == hi)).alias("uniform"))


@query("SELECT proposal_id, bool_or(with_params) AS any_params, bool_and(with_params) AS all_params FROM vote GROUP BY proposal_id")
def agg_bool_or(spark, d):
    return a.votes(spark, d).groupBy("proposal_id").agg(F.bool_or("with_params").alias("any_params"), F.bool_and("with_params").alias("all_params"))


@query("SELECT segment, min(hi) AS height FROM (SELECT segment, scope, max(power) AS hi FROM contributor GROUP BY segment, scope) GROUP BY segment")
def agg_min_of_max(spark, d):
    from rollcall.operators.status import coverage

    return coverage(a.contributors(spark, d), ["segment"], ["scope"], "power")


@query("SELECT kind, count(*) AS backlog, count(*) FILTER (WHERE value < 10) AS ready FROM logged GROUP BY kind")
def agg_backlog(spark, d):
    return a.logged(spark, d).groupBy("kind").agg(F.count("*").alias("backlog"), F.count_if(F.col("value") < 10).alias("ready"))


@query("SELECT count(*) AS n FROM logged WHERE kind = 'view' OR (kind = 'error' AND value < 3)")
def agg_ready_backlog(spark, d):
    return a.logged(spark, d).where("kind = 'view' OR (kind = 'error' AND value < 3)").agg(F.count("*").alias("n"))


@query("SELECT delegator, greatest(0, CAST(sum(CASE kind WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) AS BIGINT)) AS n FROM logged GROUP BY delegator")
def agg_effective_delta(spark, d):
    step = F.when(F.col("kind") == "signup", 1).when(F.col("kind") == "error", -1).otherwise(0)
    return a.logged(spark, d).groupBy("delegator").agg(F.greatest(F.lit(0).cast("long"), F.sum(step)).alias("n"))


@query("SELECT kind, min(value) AS lo, max(value) AS hi, CAST(sum(value) AS BIGINT) AS total, count(*) FILTER (WHERE value = 0) AS empty FROM logged GROUP BY kind")
def agg_cache_stats(spark, d):
    return a.logged(spark, d).groupBy("kind").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("value").alias("total"), F.count_if(F.col("value") == 0).alias("empty"))


@query("SELECT proposal_id, voter, count(*) AS transfers FROM vote GROUP BY proposal_id, voter")
def agg_tx_transfers(spark, d):
    return a.votes(spark, d).groupBy("proposal_id", "voter").agg(F.count("*").alias("transfers"))


@query("SELECT delegator, min(pos) AS first_pos, arg_max(value, pos) AS last_value, bool_or(kind = 'error') AS failed, string_agg(DISTINCT kind, '+' ORDER BY kind) AS reasons FROM logged GROUP BY delegator")
def agg_power_candidates(spark, d):
    reasons = F.array_join(F.array_sort(F.collect_set("kind")), "+")
    return a.logged(spark, d).groupBy("delegator").agg(F.min("pos").alias("first_pos"), F.max_by("value", "pos").alias("last_value"), F.bool_or(F.col("kind") == "error").alias("failed"), reasons.alias("reasons"))


@query("SELECT mode, count(*) FILTER (WHERE state = 'F') AS f, count(*) FILTER (WHERE state = 'O') AS o, count(*) FILTER (WHERE state = 'P') AS p FROM proposal GROUP BY mode")
def agg_audit_summary(spark, d):
    counted = a.proposals(spark, d).groupBy("mode").pivot("state", ["F", "O", "P"]).count()
    return counted.select("mode", *(F.coalesce(s, F.lit(0)).cast("long").alias(s.lower()) for s in "FOP"))


@query("SELECT count(*) AS n FROM proposal WHERE state = 'O' AND chain_id = 2")
def agg_page_count(spark, d):
    return a.proposals(spark, d).where(filters.condition({"state_eq": "O", "chain_id_eq": 2})).agg(F.count("*").alias("n"))


@query("SELECT account, scope, power, row_number() OVER (PARTITION BY scope ORDER BY power DESC, account ASC) AS rank FROM contributor")
def win_row_number(spark, d):
    return ranked(a.contributors(spark, d), "power", "account", ["scope"]).select("account", "scope", "power", F.col("rank").cast("long").alias("rank"))


@query("SELECT account, scope, count(*) OVER (PARTITION BY scope) AS total FROM contributor")
def win_count_total(spark, d):
    c = a.contributors(spark, d).select("account", "scope")
    return c.join(c.groupBy("scope").agg(F.count("*").alias("total")), "scope").select("account", "scope", "total")


@query("SELECT delegator, arg_max(kind, pos) AS state FROM logged GROUP BY delegator")
def win_latest_epoch(spark, d):
    return a.logged(spark, d).groupBy("delegator").agg(F.max_by("kind", "pos").alias("state"))


@query("SELECT proposal_id, voter, weight FROM vote QUALIFY row_number() OVER (PARTITION BY proposal_id ORDER BY weight DESC, voter, log_index, cast_ms) = 1")
def win_first_per_key(spark, d):
    first = F.min_by(F.struct("voter", "weight"), F.struct(-F.col("weight"), "voter", "log_index", "cast_ms")).alias("v")
    return a.votes(spark, d).groupBy("proposal_id").agg(first).select("proposal_id", "v.voter", "v.weight")


@query("SELECT proposer, CAST(sum(quorum) AS BIGINT) AS quorum, count(*) AS n FROM (SELECT * FROM proposal QUALIFY row_number() OVER (PARTITION BY proposer ORDER BY created DESC, proposal_id DESC) <= 3) GROUP BY proposer")
def win_last_n(spark, d):
    w = Window.partitionBy("proposer").orderBy(F.desc("created"), F.desc("proposal_id"))
    return a.proposals(spark, d).withColumn("k", F.row_number().over(w)).where("k <= 3").groupBy("proposer").agg(F.sum("quorum").alias("quorum"), F.count("*").alias("n"))


@query("SELECT account, power FROM contributor ORDER BY power ASC NULLS LAST, account ASC LIMIT 100")
def ord_enum(spark, d):
    return filters.page(filters.ordered(a.contributors(spark, d), ["power_ASC"], tie="account"), 0, 100).select("account", "power")


@query("SELECT proposal_id, created FROM proposal ORDER BY created DESC NULLS FIRST, proposal_id ASC LIMIT 20 OFFSET 40")
def lim_page(spark, d):
    return filters.page(filters.ordered(a.proposals(spark, d), ["created_DESC"], tie="proposal_id"), 40).select("proposal_id", "created")


@query("SELECT proposal_id, created FROM proposal WHERE proposal_id > 1234 ORDER BY proposal_id ASC LIMIT 25")
def lim_keyset(spark, d):
    after = a.proposals(spark, d).where(filters.condition({"proposal_id_gt": 1234}))
    return filters.page(filters.ordered(after, ["proposal_id_ASC"], tie="proposal_id"), 0, 25).select("proposal_id", "created")


RESOLVED = """SELECT c.account, coalesce(l.power, c.power) AS power, c.scope, c.segment FROM contributor c LEFT JOIN live l USING (account)
  UNION ALL SELECT account, power, scope, segment FROM live l WHERE NOT EXISTS (SELECT 1 FROM contributor c WHERE c.account = l.account)"""


def resolved_contributors(spark, d):
    return overlay.power_overlay(a.contributors(spark, d), a.live_contributors(spark, d), ["account"])


@query(f"SELECT account, power FROM ({RESOLVED}) ORDER BY power DESC NULLS LAST, account ASC LIMIT 30")
def topk_exact_merge(spark, d):
    return filters.page(filters.ordered(resolved_contributors(spark, d), ["power_DESC_NULLS_LAST"], tie="account"), 0, 30).select("account", "power")


@query("SELECT proposal_id, voter, log_index, weight FROM durable UNION ALL SELECT proposal_id, voter, log_index, weight FROM overlay_only")
def set_union_all_overlay(spark, d):
    return all_votes(spark, d).select("proposal_id", "voter", "log_index", "weight")


@query("SELECT proposer AS account FROM proposal UNION SELECT account FROM live")
def set_union_distinct(spark, d):
    return a.proposals(spark, d).select(F.col("proposer").alias("account")).union(a.live_contributors(spark, d).select("account")).distinct()


@query("SELECT coalesce(c.account, l.account) AS account, CASE WHEN c.account IS NULL THEN 'unexpected' WHEN l.account IS NULL THEN 'missing' WHEN c.power = l.power THEN 'matched' ELSE 'mismatched' END AS status FROM contributor c FULL JOIN live l ON l.account = c.account")
def set_diff_parity(spark, d):
    live = a.live_contributors(spark, d).select(F.col("account").alias("la"), F.col("power").alias("lp"))
    status = F.when(F.col("account").isNull(), "unexpected").when(F.col("la").isNull(), "missing").when(F.col("power") == F.col("lp"), "matched").otherwise("mismatched")
    return a.contributors(spark, d).join(live, F.col("account") == F.col("la"), "full").select(F.coalesce("account", "la").alias("account"), status.alias("status"))


@query(RESOLVED)
def ovl_contributors(spark, d):
    return resolved_contributors(spark, d)


@query("""SELECT p.proposal_id, p.state, coalesce(v.n, 0) AS n_votes, coalesce(v.weight, 0) AS weight FROM (
    SELECT proposal_id, CASE WHEN proposal_id % 5 = 0 THEN 'L' ELSE state END AS state FROM proposal UNION ALL SELECT proposal_id + 10000000000, 'T' FROM proposal WHERE proposal_id % 11 = 0
  ) p LEFT JOIN (SELECT proposal_id, count(*) AS n, CAST(sum(weight) AS BIGINT) AS weight FROM (SELECT * FROM durable UNION ALL SELECT * FROM overlay_only) GROUP BY proposal_id) v USING (proposal_id)""")
def ovl_proposals(spark, d):
    """Live overlays patch proposals, others add those without a durable twin; the metrics count the votes of both."""
    durable = a.proposals(spark, d).select("proposal_id", "state")
    tagged = lambda rows, state, source: rows.withColumns({"state": F.lit(state), "source": F.lit(source), "status": F.lit("available")})
    new = durable.where("proposal_id % 11 = 0").withColumn("proposal_id", F.col("proposal_id") + 10_000_000_000)
    over = tagged(durable.where("proposal_id % 5 = 0"), "L", overlay.LIVE).unionByName(tagged(new, "T", "tail")).unionByName(tagged(durable.where("proposal_id % 13 = 0"), "T", "tail"))
    shown = overlay.resolved(durable, over, ["proposal_id"], ["state"])
    cast = all_votes(spark, d).groupBy("proposal_id").agg(F.count("*").alias("n_votes"), F.sum("weight").alias("weight"))
    return shown.join(cast, "proposal_id", "left").na.fill(0, ["n_votes", "weight"])


@query("SELECT proposal_id, log_index, voter FROM durable WHERE with_params UNION ALL SELECT proposal_id, log_index, voter FROM overlay_only WHERE with_params")
def ovl_events(spark, d):
    return all_votes(spark, d).where("with_params").select("proposal_id", "log_index", "voter")


@query(f"SELECT voter, {TOTALS} FROM (SELECT * FROM durable UNION ALL SELECT * FROM overlay_only) GROUP BY voter")
def ovl_votes(spark, d):
    return all_votes(spark, d).groupBy("voter").agg(*totals())


@query("SELECT account, scope, max(power) AS power FROM (" + RESOLVED + ") GROUP BY account, scope")
def ovl_delegates(spark, d):
    return resolved_contributors(spark, d).groupBy("account", "scope").agg(F.max("power").alias("power"))


@query("""SELECT account, power FROM contributor c WHERE NOT EXISTS (SELECT 1 FROM live l WHERE l.account = c.account) UNION ALL SELECT account, power FROM live WHERE scope % 2 = 0""")
def ovl_mappings(spark, d):
    o = a.live_contributors(spark, d).withColumn("is_current", F.col("scope") % 2 == 0)
    return overlay.mapping_overlay(a.contributors(spark, d), o, "account").select("account", "power")


@query("SELECT scope, count(*) AS n, CAST(sum(power) AS BIGINT) AS power FROM (" + RESOLVED + ") GROUP BY scope")
def ovl_metrics(spark, d):
    return resolved_contributors(spark, d).groupBy("scope").agg(F.count("*").alias("n"), F.sum("power").alias("power"))


@query("""SELECT * FROM (WITH r AS (SELECT pos, kind, delegator % 25 AS scope, CAST(delegator % 25 AS VARCHAR) || ':' || CAST(pos // 500 AS VARCHAR) AS segment_id, pos // 500 % 7 = 0 AS bad FROM logged
), s AS (SELECT segment_id, scope, bad, max(pos) AS range_end, max(CASE WHEN kind = 'view' THEN pos + 30 END) AS anchor FROM r GROUP BY ALL
), h AS (SELECT scope, max(pos) - 300 AS height FROM r WHERE kind = 'signup' GROUP BY scope
), f AS (SELECT segment_id FROM s JOIN h USING (scope) WHERE NOT bad AND height >= 0 AND range_end <= height AND coalesce(anchor, range_end) <= height)
SELECT 'segment' AS entity, segment_id AS id, CASE WHEN bad THEN 'invalid' WHEN segment_id IN (SELECT * FROM f) THEN 'finalized' ELSE 'available' END AS status FROM s
UNION ALL SELECT 'overlay', CAST(pos AS VARCHAR), CASE WHEN kind = 'error' THEN 'invalid' WHEN segment_id IN (SELECT * FROM f) THEN 'finalized' ELSE 'available' END FROM r)""")
def ovl_finalize(spark, d):
    """Segments of the log by scope, final once the scope's durable height has passed them, and the overlay rows that follow their segments."""
    rows = a.logged(spark, d).select("pos", "kind", (F.col("delegator") % 25).alias("scope"), F.concat_ws(":", (F.col("delegator") % 25).cast("string"), F.floor(F.col("pos") / 500).cast("string")).alias("segment_id"))
    status = F.when(F.floor(F.col("range_start") / 500) % 7 == 0, "invalid").otherwise("available")
    segments = rows.groupBy(F.col("segment_id").alias("id"), "scope").agg(F.min("pos").alias("range_start"), F.max("pos").alias("range_end"), F.max(F.when(F.col("kind") == "view", F.col("pos") + 30)).alias("anchor")).withColumns({"status": status, "source": F.lit("tail")})
    heights = rows.where("kind = 'signup'").groupBy("scope").agg((F.max("pos") - 300).alias("height"))
    final = overlay.final_segments(segments, heights, ["scope"])
    overlays = rows.select(F.col("pos").cast("string").alias("id"), "scope", "segment_id", F.when(F.col("kind") == "error", "invalid").otherwise("available").alias("status"))
    told = lambda marked, name: marked.select(F.lit(name).alias("entity"), "id", "status")
    return told(overlay.marked_final(segments, final, ["scope"], "id"), "segment").unionByName(told(overlay.marked_final(overlays, final, ["scope"]), "overlay"))


@query("SELECT account, CASE WHEN scope = 4 THEN 'invalid' ELSE 'available' END AS status, CASE WHEN scope = 4 THEN 'reorg' END AS reason FROM live")
def ovl_rollback(spark, d):
    o = a.live_contributors(spark, d).withColumn("reason", F.lit(None).cast("string"))
    return overlay.rolled_back(o, F.col("scope") == 4, "reorg").select("account", "status", "reason")
