"""Queries of status, audits, presentation and backfills."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollcall.functions import descriptions, scalars
from rollcall.operators import filters, status
from rollcall.plans import analogues as a
from rollcall.plans.entities import totals
from rollcall.plans.registry import query
from rollcall.streaming.state import rate_and_eta

SYNC = """, point AS (SELECT delegator, CASE WHEN delegator % 9 <> 0 THEN max(pos) END AS processed, CASE WHEN delegator % 7 <> 0 THEN max(pos) + delegator % 3 * 100 - (delegator % 5 // 4) * 100000 END AS target FROM logged GROUP BY delegator)
"""


def checkpoints(spark, d):
    """A checkpoint for each delegator, some without heights or targets and some with negative targets."""
    m, k = F.max("pos"), F.col("delegator")
    grouped = a.logged(spark, d).groupBy("delegator").agg(m.alias("m"))
    target = F.col("m") + k % 3 * 100 - F.floor(k % 5 / 4) * 100_000
    return grouped.select("delegator", F.when(k % 9 != 0, F.col("m")).alias("processed"), F.when(k % 7 != 0, target).cast("long").alias("target"))


@query("SELECT * FROM (WITH" + SYNC.replace(",", " ", 1) + """SELECT delegator, CASE WHEN target IS NULL THEN NULL WHEN target <= 0 THEN 100.0::DOUBLE WHEN processed IS NULL THEN 0.0::DOUBLE ELSE least(processed::DOUBLE / target::DOUBLE * 100.0::DOUBLE, 100.0::DOUBLE) END AS synced,
  coalesce(processed >= target, false) AS is_synced FROM point)""")
def sts_indexer(spark, d):
    c = checkpoints(spark, d)
    return c.select("delegator", status.synced_percentage(F.col("processed"), F.col("target")).alias("synced"), status.is_synced(F.col("processed"), F.col("target")).alias("is_synced"))


@query("SELECT * FROM (WITH" + SYNC.replace(",", " ", 1) + """, x AS (SELECT delegator, target - 50 + 1 AS total, greatest(0, least(processed - 50 + 1, target - 50 + 1)) AS done FROM point WHERE target IS NOT NULL)
  SELECT delegator, CASE WHEN total <= 0 THEN 0 ELSE total - coalesce(done, 0) END AS remaining, CASE WHEN total <= 0 THEN 100.0::DOUBLE ELSE least(coalesce(done, 0)::DOUBLE / total::DOUBLE * 100.0::DOUBLE, 100.0::DOUBLE) END AS percentage
  FROM (SELECT delegator, total, CASE WHEN done IS NULL OR (SELECT processed FROM point p WHERE p.delegator = x.delegator) IS NULL THEN 0 ELSE done END AS done FROM x))""")
def sts_range_progress(spark, d):
    c = checkpoints(spark, d).where("target IS NOT NULL")
    remaining, percentage = status.range_progress(F.col("processed"), F.lit(50).cast("long"), F.col("target"))
    return c.select("delegator", remaining.alias("remaining"), percentage.alias("percentage"))


@query("SELECT proposal_id, CAST(least(greatest(floor(proposal_id * 10000.0::DOUBLE / quorum::DOUBLE + 0.5::DOUBLE), 0), 10000) AS BIGINT) AS points FROM proposal WHERE quorum > 0")
def sts_sync_basis_points(spark, d):
    return a.proposals(spark, d).where("quorum > 0").select("proposal_id", status.basis_points(F.col("proposal_id"), F.col("quorum")).alias("points"))


@query("SELECT pos, value >= 15 AND pos % 3 > 0 AS stalled, CASE WHEN kind = 'error' THEN 'provider' WHEN kind = 'click' THEN 'database' ELSE 'unknown' END AS class FROM logged")
def sts_stall(spark, d):
    kind = F.when(F.col("kind").rlike("(?i)error"), "provider").when(F.col("kind").rlike("(?i)click"), "database").otherwise("unknown")
    return a.logged(spark, d).select("pos", status.stalled(F.col("value"), F.col("pos") % 3).alias("stalled"), kind.alias("class"))


@query("""SELECT coalesce(c.account, l.account) AS account, c.power AS indexed, l.power AS on_chain, CASE WHEN c.power IS NULL THEN 'missing' WHEN l.power IS NULL THEN 'unexpected' WHEN c.power > l.power THEN 'higher' WHEN c.power < l.power THEN 'lower' ELSE 'equal' END AS status
FROM contributor c FULL JOIN live l ON c.account = l.account""")
def aud_power(spark, d):
    return status.power_audit(a.contributors(spark, d), a.live_contributors(spark, d), "account", "power")


@query("""SELECT pos, CASE WHEN chain IS NULL THEN 'unverified' WHEN i = chain AND t = chain THEN 'all-agree' WHEN i = chain THEN 'third-party-differs' WHEN t = chain THEN 'index-differs' WHEN i = t THEN 'chain-differs' ELSE 'all-differ' END AS conclusion
FROM (SELECT pos, value % 2 AS i, pos % 3 AS t, CASE WHEN kind <> 'error' THEN delegator % 3 END AS chain FROM logged)""")
def aud_three_way(spark, d):
    chain = F.when(F.col("kind") != "error", F.col("delegator") % 3)
    return a.logged(spark, d).select("pos", status.audit_conclusion(F.col("value") % 2, F.col("pos") % 3, chain).alias("conclusion"))


@query()
def agg_table_digest(spark, d):
    return status.table_digest(a.proposals(spark, d))


PROBES = sorted({("governor", "method", n) for n in (*status.GOVERNOR_METHODS, *status.OPTIONAL_METHODS)} | {("token", "method", n) for ns in (*status.TOKEN_METHODS.values(), *status.VOTE_READS.values()) for n in ns}
                | {("governor", "event", n) for n in status.GOVERNOR_EVENTS} | {("token", "event", n) for n in status.TOKEN_EVENTS})


def compat_sql():
    """Every name that is asked of a contract as a row with what is said if it fails, in order."""
    said, k = [], 0

    def add(condition, text, serious=True):
        nonlocal k
        k += 1
        said.append(f"SELECT code, {k} AS k, {str(serious).lower()} AS serious, {text} AS said FROM asked WHERE {condition}")

    names = [f"{o}_{kind}_{n}" for o, kind, n in PROBES]
    answer = lambda o, kind, n: f"coalesce({o}_{kind}_{n}, 'missing')"
    for column, text in (("code", "dao.code missing"), ("governor", "dao.governor missing"), ("token", "dao.token.contract missing")):
        add(f"coalesce({column}, '') = ''", f"'{text}'")
    add("coalesce(standard, '') NOT IN ('ERC20', 'ERC721')", "'dao.token.standard ' || coalesce(standard, '(missing)') || ' unsupported'")
    for n in status.GOVERNOR_METHODS:
        add(f"{answer('governor', 'method', n)} <> 'ok'", f"'governor.{n} ' || {answer('governor', 'method', n)}")
    for n in status.GOVERNOR_EVENTS:
        add(f"{answer('governor', 'event', n)} <> 'ok'", f"'governor.{n} event missing'")
    for standard, methods in status.TOKEN_METHODS.items():
        for n in methods:
            add(f"standard = '{standard}' AND {answer('token', 'method', n)} <> 'ok'", f"'token.{n} ' || {answer('token', 'method', n)}")
        add(f"standard = '{standard}' AND transfer_topics IS DISTINCT FROM {status.TRANSFER_TOPICS[standard]}", f"'dao.token.standard declares {standard} but Transfer has ' || coalesce(CAST(transfer_topics AS VARCHAR), 'unknown') || ' indexed arguments'")
    for n in status.TOKEN_EVENTS:
        add(f"{answer('token', 'event', n)} <> 'ok'", f"'token.{n} event missing'")
    for x, y in status.VOTE_READS.values():
        add(f"{answer('token', 'method', x)} <> 'ok' AND {answer('token', 'method', y)} <> 'ok'", f"'token.{x}/{y} missing'")
    for x, y in status.VOTE_READS.values():
        add(f"{answer('token', 'method', x)} <> 'ok' AND {answer('token', 'method', y)} = 'ok'", f"'token.{x} missing; using {y} fallback'", False)
    for n, then in status.OPTIONAL_METHODS.items():
        add(f"{answer('governor', 'method', n)} <> 'ok'", f"'governor.{n} missing; {then}'", False)
    rows = ", ".join(f"('{o}', '{kind}', '{n}', {i})" for i, (o, kind, n) in enumerate(PROBES))
    answers = ", ".join(f"max(CASE WHEN owner = '{o}' AND kind = '{kind}' AND name = '{n}' THEN CASE WHEN kind = 'event' OR state = 'ok' THEN 'ok' ELSE 'reverts' END END) AS {c}" for (o, kind, n), c in zip(PROBES, names, strict=True))
    return f"""WITH dao AS (SELECT 'd' || CAST(c_custkey AS VARCHAR) AS code, c_custkey AS c, CASE WHEN c_custkey % 10 <> 0 THEN '0xg' END AS governor, '0xt' AS token, CASE c_custkey % 3 WHEN 0 THEN 'ERC20' WHEN 1 THEN 'ERC721' END AS standard,
  CASE WHEN c_custkey % 8 <> 7 THEN CAST(2 + c_custkey % 3 AS INTEGER) END AS transfer_topics FROM customer
), probe AS (SELECT code, owner, kind, name, CASE WHEN (c * 7 + i) % 97 = 0 THEN 'reverts' ELSE 'ok' END AS state FROM dao, (VALUES {rows}) n(owner, kind, name, i) WHERE c % 4 <> 3 AND (c * 5 + i) % 101 > 1
), asked AS (SELECT * FROM dao LEFT JOIN (SELECT code, {answers} FROM probe GROUP BY code) USING (code)
), said AS ({" UNION ALL ".join(said)})
SELECT code, CASE WHEN bool_or(serious) THEN 'unsupported' WHEN count(k) > 0 THEN 'degraded' ELSE 'supported' END AS support, coalesce(string_agg(said, '; ' ORDER BY k) FILTER (WHERE serious), '') AS errors,
  coalesce(string_agg(said, '; ' ORDER BY k) FILTER (WHERE NOT serious), '') AS warnings FROM dao LEFT JOIN said USING (code) GROUP BY code"""


@query(compat_sql(), views=False)
def aud_compat(spark, d):
    """Contracts of all customers, most of which answer most of what is asked."""
    c = F.col("c_custkey").cast("long")
    daos = a.table(spark, d, "customer").select(F.concat(F.lit("d"), c.cast("string")).alias("code"), c.alias("c"), F.when(c % 10 != 0, "0xg").alias("governor"), F.lit("0xt").alias("token"), F.when(c % 3 == 0, "ERC20").when(c % 3 == 1, "ERC721").alias("standard"), F.when(c % 8 != 7, (2 + c % 3).cast("int")).alias("transfer_topics"))
    names = F.explode(F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip((*p, i), ("owner", "kind", "name", "i"), strict=True))) for i, p in enumerate(PROBES)))).alias("n")
    probes = daos.where("c % 4 <> 3").select("code", "c", names).select("code", "c", "n.*").where("(c * 5 + i) % 101 > 1")
    probes = probes.withColumn("state", F.when(F.col("kind") == "event", None).when((F.col("c") * 7 + F.col("i")) % 97 == 0, "reverts").otherwise("ok"))
    found = status.compatibility(daos, probes)
    return found.select("code", "support", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"))


@query("""SELECT proposal_id, current_votes, quorum % 60 <> 0 AND current_votes >= quorum % 60 AS reached FROM (SELECT p.proposal_id, p.quorum, CASE WHEN p.chain_id = 0 THEN coalesce(f, 0) WHEN p.chain_id = 1 THEN coalesce(f, 0) + coalesce(g, 0) ELSE coalesce(f, 0) + coalesce(ab, 0) END AS current_votes
FROM proposal p LEFT JOIN (SELECT proposal_id, CAST(sum(weight) FILTER (WHERE support = 1) AS BIGINT) AS f, CAST(sum(weight) FILTER (WHERE support = 0) AS BIGINT) AS g, CAST(sum(weight) FILTER (WHERE support = 2) AS BIGINT) AS ab FROM vote GROUP BY proposal_id) v USING (proposal_id))""")
def web_quorum(spark, d):
    mode = F.when(F.col("chain_id") == 0, "support=bravo&quorum=for").when(F.col("chain_id") == 1, "quorum=For, against").otherwise("quorum=for,for")
    v = a.votes(spark, d).groupBy("proposal_id").agg(*totals())
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    joined = a.proposals(spark, d).join(v, "proposal_id", "left")
    counted = joined.withColumn("current_votes", status.quorum_votes(mode, zero(F.col("votes_for")), zero(F.col("votes_against")), zero(F.col("votes_abstain"))))
    return counted.select("proposal_id", "current_votes", status.quorum_reached(F.col("current_votes"), F.col("quorum") % 60).alias("reached"))


@query("SELECT voter, count(DISTINCT proposal_id) * 100.0::DOUBLE / 10.0::DOUBLE AS participation FROM vote WHERE proposal_id IN (SELECT proposal_id FROM proposal WHERE EXISTS (SELECT 1 FROM vote v WHERE v.proposal_id = proposal.proposal_id) ORDER BY created DESC, proposal_id DESC LIMIT 10) GROUP BY voter")
def web_participation(spark, d):
    voted = filters.exists(a.proposals(spark, d), a.votes(spark, d).select(F.col("proposal_id").alias("pid")), {"proposal_id": "pid"})
    return status.participation(voted, a.votes(spark, d), 10).select("voter", F.col("participation").cast("double").alias("participation"))


@query("SELECT c.account, coalesce(nullif(p.f, 0), p.n, 0) AS n FROM contributor c LEFT JOIN (SELECT proposer, count(*) FILTER (WHERE state = 'F') AS f, count(*) AS n FROM proposal GROUP BY proposer) p ON p.proposer = c.account")
def web_counts(spark, d):
    p = a.proposals(spark, d).groupBy("proposer").agg(F.count_if(F.col("state") == "F").alias("f"), F.count("*").alias("n"))
    return a.contributors(spark, d).join(p, F.col("account") == F.col("proposer"), "left").select("account", F.coalesce(F.nullif("f", F.lit(0)), "n", F.lit(0)).cast("long").alias("n"))


@query("SELECT account, power, row_number() OVER (ORDER BY power DESC NULLS LAST, account) AS rank FROM (SELECT c.account, max(p.quorum) AS power FROM contributor c LEFT JOIN proposal p ON p.proposer = c.account GROUP BY c.account) ORDER BY rank LIMIT 40")
def web_members(spark, d):
    power = a.proposals(spark, d).groupBy(F.col("proposer").alias("account")).agg(F.max("quorum").alias("power"))
    members = a.contributors(spark, d).select("account").join(power, "account", "left")
    top = filters.page(filters.ordered(members, ["power_DESC_NULLS_LAST"], tie="account"), 0, 40)
    return status.ranked(top, "power", "account").select("account", "power", F.col("rank").cast("long").alias("rank"))


@query("SELECT part, round(value / sum(value) OVER () * 1000000)::BIGINT AS millionths FROM (SELECT CAST(p_partkey AS BIGINT) AS part, CAST(p_size * floor(p_retailprice) AS BIGINT) AS value FROM part)")
def web_treasury(spark, d):
    p = a.table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("part"), F.col("p_size").cast("double").alias("balance"), F.floor("p_retailprice").cast("double").alias("price"), F.lit(0.0).alias("change"))
    return status.treasury(p, "balance", "price", "change").select("part", F.round(F.col("share") * 1_000_000).cast("long").alias("millionths"))


@query("""SELECT pos, CASE WHEN kind = 'view' THEN CASE WHEN value > 0 AND value * 100000 >= 1800000 THEN 'problem' ELSE 'indexing' END WHEN kind = 'click' THEN 'checking' WHEN kind = 'error' AND value % 3 < 2 THEN 'not-found' ELSE 'checking' END AS state FROM logged""")
def web_missing_state(spark, d):
    """Of each row: whether the contract has the proposal (view), is still asked (click), or said that it has none (error, two of three texts)."""
    error = F.when(F.col("kind") == "error", F.element_at(F.array(*map(F.lit, ("execution reverted: governornonexistentproposal()", "Nonexistent Proposal", "timeout"))), (F.col("value") % 3 + 1).cast("int")))
    observed = F.when(F.col("value") > 0, F.col("at_ms") - F.col("value") * 100_000)
    return a.logged(spark, d).select("pos", status.missing_state(F.col("kind") == "view", F.col("kind") == "click", error, observed, F.col("at_ms")).alias("state"))


@query()
def bkf_titles(spark, d):
    """Documents whose stored title (here the first 50 characters) differs from the one that is computed now."""
    rows = a.table(spark, d, "documents").select("doc_id", F.left("text", F.lit(50)).alias("stored"), descriptions.title("text").alias("title"))
    return rows.where(~F.col("stored").eqNullSafe(F.col("title"))).select("doc_id", "title")


@query("SELECT p.proposal_id, c.segment FROM proposal p JOIN contributor c ON c.account = p.proposer WHERE c.segment IS DISTINCT FROM p.mode")
def bkf_reference(spark, d):
    c = a.contributors(spark, d).select("account", "segment")
    return a.proposals(spark, d).join(c, F.col("account") == F.col("proposer")).where(~F.col("segment").eqNullSafe(F.col("mode"))).select("proposal_id", "segment")


@query("SELECT proposal_id FROM proposal p WHERE EXISTS (SELECT 1 FROM durable d WHERE d.proposal_id = p.proposal_id) AND NOT EXISTS (SELECT 1 FROM overlay_only o WHERE o.proposal_id = p.proposal_id)")
def bkf_timelock(spark, d):
    from rollcall.plans.entities import overlay_only

    queued = filters.exists(a.proposals(spark, d), a.durable_votes(spark, d).select(F.col("proposal_id").alias("pid")), {"proposal_id": "pid"})
    return filters.missing(queued, overlay_only(spark, d).select(F.col("proposal_id").alias("pid")), {"proposal_id": "pid"}).select("proposal_id")


@query("SELECT DISTINCT proposer AS account FROM proposal WHERE proposer NOT IN (SELECT account FROM contributor WHERE scope < 20)")
def bkf_profiles(spark, d):
    known = a.contributors(spark, d).where("scope < 20").select("account")
    return a.proposals(spark, d).select(F.col("proposer").alias("account")).distinct().join(known, "account", "left_anti")


@query("SELECT c.account, CASE WHEN l.account IS NULL THEN c.power ELSE l.power END AS power, CASE WHEN l.account IS NOT NULL THEN CAST(l.power <> 0 AS INTEGER) - CAST(c.power <> 0 AS INTEGER) ELSE 0 END AS effective FROM contributor c LEFT JOIN live l USING (account)")
def bkf_balance_edges(spark, d):
    live = a.live_contributors(spark, d).select("account", F.col("power").alias("balance"))
    effective = F.when(F.col("balance").isNotNull(), (F.col("balance") != 0).cast("int") - (F.col("power") != 0).cast("int")).otherwise(0)
    return a.contributors(spark, d).join(live, "account", "left").select("account", F.coalesce("balance", "power").alias("power"), effective.alias("effective"))


@query("SELECT delegator, dh::DOUBLE / dt::DOUBLE AS rate FROM (SELECT delegator, pos - lag(pos) OVER w AS dh, at_ms - lag(at_ms) OVER w AS dt, row_number() OVER (PARTITION BY delegator ORDER BY at_ms DESC) AS k FROM logged WINDOW w AS (PARTITION BY delegator ORDER BY at_ms)) WHERE k = 1 AND dt > 0")
def win_rate_eta(spark, d):
    rows = a.logged(spark, d).withColumn("target", F.lit(100_000).cast("long"))
    return rate_and_eta(rows, "delegator", "at_ms", "pos", "target").where("rate IS NOT NULL").select("delegator", "rate")
