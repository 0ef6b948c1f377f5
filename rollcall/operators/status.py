"""Status, audit and presentation figures."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def synced_percentage(processed: Column, target: Column) -> Column:
    share = processed.cast("double") / F.nullif(target.cast("double"), F.lit(0.0)) * 100.0
    return F.when(target.isNull(), F.lit(None).cast("double")).when(target <= 0, 100.0).when(processed.isNull(), 0.0).otherwise(F.least(share, F.lit(100.0)))


def is_synced(processed: Column, target: Column) -> Column:
    return F.coalesce(processed >= target, F.lit(False))


def coverage(segments: DataFrame, scope: list[str], selector: list[str], end: str) -> DataFrame:
    """How far a scope is covered: the least over its selectors of the greatest end."""
    return segments.groupBy(*scope, *selector).agg(F.max(end).alias("_end")).groupBy(*scope).agg(F.min("_end").alias("height"))


def range_progress(processed: Column, start: Column, target: Column) -> tuple[Column, Column]:
    """Blocks that remain of a configured range, and the percentage that is done."""
    total = target - start + 1
    none = F.lit(0).cast("long")  # greatest and least skip nulls
    done = F.when(processed.isNull(), none).otherwise(F.greatest(none, F.least(processed - start + 1, total)))
    empty = total <= 0
    return F.when(empty, F.lit(0).cast("long")).otherwise(total - done), F.when(empty, 100.0).otherwise(F.least(done.cast("double") / F.nullif(total, F.lit(0).cast("long")).cast("double") * 100.0, F.lit(100.0)))


def basis_points(part: Column, whole: Column) -> Column:
    """Rounded, from 0 to 10000; 0 of an empty whole."""
    return F.when(whole <= 0, F.lit(0).cast("long")).otherwise(F.least(F.greatest(F.floor(part.cast("double") * 10000.0 / F.nullif(whole, F.lit(0)).cast("double") + 0.5), F.lit(0)), F.lit(10000))).cast("long")


def stalled(age_minutes: Column, lag: Column, limit: int = 15) -> Column:
    return (age_minutes >= limit) & (lag > 0)


def quorum_votes(mode: Column, votes_for: Column, votes_against: Column, votes_abstain: Column) -> Column:
    """Votes that count for the quorum: the buckets that the counting mode names, or for and abstain."""
    named = F.filter(F.split(mode, "&"), lambda p: p.startswith("quorum="))
    buckets = F.transform(F.split(F.substring(F.get(named, F.lit(0)), 8, 1_000_000), ","), lambda b: F.lower(F.trim(b)))
    known = F.array(*map(F.lit, ("for", "against", "abstain")))
    good = (F.size(named) > 0) & (F.size(F.array_distinct(buckets)) == F.size(buckets)) & (F.size(F.array_except(buckets, known)) == 0)
    used = F.when(F.coalesce(good, F.lit(False)), buckets).otherwise(F.array(F.lit("for"), F.lit("abstain")))
    part = lambda name, votes: F.when(F.array_contains(used, name), votes).otherwise(F.lit(0).cast("long"))
    return part("for", votes_for) + part("against", votes_against) + part("abstain", votes_abstain)


def quorum_reached(current: Column, required: Column) -> Column:
    return (required != 0) & (current >= required)


def power_share(power: Column, total: Column) -> Column:
    """Percent with two digits, rounded down; 0 of no power."""
    return F.when(total == 0, 0.0).otherwise(F.floor(power * 10000 / F.nullif(total, F.lit(0))).cast("double") / 100.0)


def ranked(rows: DataFrame, power: str, ident: str, scope: list[str] = []) -> DataFrame:  # noqa: B006
    """Rank by power, highest first, within each scope."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*scope).orderBy(F.desc_nulls_last(power), F.asc_nulls_last(ident))))


def participation(proposals: DataFrame, votes: DataFrame, last: int, ident: str = "proposal_id", created: str = "created", voter: str = "voter") -> DataFrame:
    """Per voter: the percentage of the newest ``last`` proposals that it voted on."""
    newest = proposals.orderBy(F.desc(created), F.desc(ident)).limit(last).select(ident)
    counted = newest.withColumn("_n", F.count("*").over(Window.partitionBy(F.lit(0))))  # ``last`` rows at most
    took = votes.join(F.broadcast(counted), ident).select(voter, ident, "_n").distinct()
    return took.groupBy(voter).agg((F.count("*") * 100.0 / F.max("_n")).alias("participation"))


def treasury(assets: DataFrame, balance: str, price: str, change: str) -> DataFrame:
    """Each asset's value and its share of the portfolio (by balances if nothing has a price), with the value's change."""
    value = F.coalesce(F.col(balance) * F.col(price), F.lit(0.0))
    valued = assets.withColumn("value", value).withColumn("change_value", F.coalesce(F.col(change) * F.col(balance), F.lit(0.0)))
    totals = valued.agg(F.coalesce(F.sum(balance), F.lit(0.0)).alias("_b"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("_v"))  # one row
    share = F.when(F.col("_v") != 0, F.col("value") / F.nullif("_v", F.lit(0.0))).when(F.col("_b") != 0, F.col(balance) / F.nullif("_b", F.lit(0.0))).otherwise(0.0)
    return valued.join(F.broadcast(totals)).withColumn("share", share).drop("_b", "_v")


def audit_conclusion(indexed: Column, third: Column, chain: Column) -> Column:
    """Which of three sources agree."""
    return (
        F.when(chain.isNull(), "unverified").when(indexed.eqNullSafe(chain) & third.eqNullSafe(chain), "all-agree").when(indexed.eqNullSafe(chain), "third-party-differs")
        .when(third.eqNullSafe(chain), "index-differs").when(indexed.eqNullSafe(third), "chain-differs").otherwise("all-differ")
    )


def power_audit(indexed: DataFrame, chain: DataFrame, key: str, value: str) -> DataFrame:
    """Indexed against chain values: equal, higher, lower, missing or unexpected."""
    a, b = indexed.select(key, F.col(value).alias("indexed")), chain.select(key, F.col(value).alias("on_chain"))
    status = F.when(F.col("indexed").isNull(), "missing").when(F.col("on_chain").isNull(), "unexpected").when(F.col("indexed") > F.col("on_chain"), "higher").when(F.col("indexed") < F.col("on_chain"), "lower").otherwise("equal")
    return a.join(b, key, "full").withColumn("status", status)


def table_digest(rows: DataFrame) -> DataFrame:
    """Row count and an order-insensitive digest of all columns; a digest of any size is combined from rows' hashes."""
    content = F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256)
    part = lambda k: F.conv(F.substring(content, 1 + 8 * k, 8), 16, 10).cast("decimal(20,0)")  # noqa: E731  sums stay exact for 10^20 rows
    return rows.agg(F.count("*").alias("rows"), F.concat_ws("-", *(F.sum(part(k)).cast("string") for k in range(4))).alias("digest"))


def profile_count(rolled_out: Column) -> Column:
    """Aggregate: the number of profiles, once any of a scope says that counts are in use."""
    return F.when(F.bool_or(rolled_out), F.count("*"))


def parity(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Tables against each other, a row for each: by the number of rows and a digest that doesn't depend on their order."""

    def digested(rows: DataFrame, name: str) -> DataFrame:
        content = F.xxhash64(*sorted(c for c in rows.columns if c not in keys))
        return rows.groupBy(*keys).agg(F.struct(F.count("*").alias("rows"), F.bit_xor(content).alias("xor"), F.sum(content.cast("decimal(20,0)")).alias("sum")).alias(name))

    both = digested(expected, "_a").join(digested(found, "_b"), keys, "full")
    verdict = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "unexpected").when(F.col("_a") == F.col("_b"), "matched").otherwise("mismatched")
    return both.select(*keys, verdict.alias("status"))


def ranked_overall(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """The place of every row from 1 on, without a window over all: sorted ranges, and how many rows the ranges before hold."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = _kept(placed.withColumns({"_range": F.shiftright("_at", 33), "_nth": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_at"))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))  # a row for each range
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    return placed.join(F.broadcast(before), "_range").select(*rows.columns, (F.col("_nth") + F.col("_before") + 1).alias(name))


#: Fixed value: how long a proposal may be missing while its contract has it, in milliseconds.
INDEXING_PROBLEM_MS = 30 * 60 * 1000
#: Fixed value: what errors hold if a contract doesn't know the proposal.
NO_SUCH_PROPOSAL = "(?i)GovernorNonexistentProposal|nonexistent proposal"


def missing_state(exists: Column, pending: Column, error: Column, observed: Column, now: Column) -> Column:
    """What to say of a proposal that isn't indexed: indexing or, after half an hour, problem if its contract has it; not-found if the contract
    says that it hasn't; checking as long as that isn't known."""
    waited = F.when(F.coalesce(observed, F.lit(0)) != 0, now - observed).otherwise(F.lit(0))
    known = F.when(waited >= INDEXING_PROBLEM_MS, "problem").otherwise("indexing")
    gone = F.coalesce(error.rlike(NO_SUCH_PROPOSAL), F.lit(False)) & ~F.coalesce(pending, F.lit(False))
    return F.when(F.coalesce(exists, F.lit(False)), known).when(gone, "not-found").otherwise("checking")


#: What contracts must answer and emit, and how many topics a transfer has besides its name, by token standard.
GOVERNOR_METHODS = ("hashProposal", "proposalDeadline", "proposalSnapshot", "proposalVotes", "quorum", "state", "votingDelay", "votingPeriod")
GOVERNOR_EVENTS = ("ProposalCreated", "ProposalExecuted", "VoteCast")
TOKEN_METHODS = {"ERC20": ("balanceOf", "delegates", "name", "symbol", "totalSupply"), "ERC721": ("balanceOf", "delegates", "name", "ownerOf", "symbol")}
TOKEN_EVENTS = ("DelegateChanged", "DelegateVotesChanged", "Transfer")
TRANSFER_TOPICS = {"ERC20": 2, "ERC721": 3}
VOTE_READS = {"current": ("getVotes", "getCurrentVotes"), "historical": ("getPastVotes", "getPriorVotes")}
#: Governor methods that may be missing, and what is done then.
OPTIONAL_METHODS = {"CLOCK_MODE": "defaulting to block clock", "COUNTING_MODE": "inferring vote bucket semantics", "timelock": "indexing without timelock projection"}


def compatibility(daos: DataFrame, probes: DataFrame) -> DataFrame:
    """Whether contracts can be indexed: code, support (supported, degraded, unsupported), errors, warnings, current and historical (the vote reads).

    ``daos``: code, governor, token, standard, transfer_topics (texts may be null); ``probes``: code, owner (governor or token), kind (method or event), name,
    state (of methods ok, reverts or other; of events null). Only probes of the names that matter are kept, some thirty a code.
    """
    wanted = {("governor", "method", n) for n in (*GOVERNOR_METHODS, *OPTIONAL_METHODS)} | {("token", "method", n) for ns in (*TOKEN_METHODS.values(), *VOTE_READS.values()) for n in ns}
    wanted |= {("governor", "event", n) for n in GOVERNOR_EVENTS} | {("token", "event", n) for n in TOKEN_EVENTS}
    names = sorted(f"{o}.{k}.{n}" for o, k, n in wanted)
    name = F.concat_ws(".", "owner", "kind", "name")
    # a method's best answer counts
    rank = F.when(F.col("kind") == "event", 2).when(F.col("state") == "ok", 2).when(F.col("state") == "reverts", 1).otherwise(0)
    found = probes.where(name.isin(names)).groupBy("code").agg(*(F.max(F.when(name == n, rank)).alias(n.replace(".", "_")) for n in names))
    rows = daos.join(found, "code", "left")
    state = lambda o, k, n: F.coalesce(F.col(f"{o}_{k}_{n}"), F.lit(0))

    def method(owner: str, n: str) -> Column:
        s = state(owner, "method", n)
        return F.when(s == 1, f"{owner}.{n} reverts").when(s == 0, f"{owner}.{n} missing")

    event = lambda owner, n: F.when(state(owner, "event", n) == 0, f"{owner}.{n} event missing")
    reads = {k: F.when(state("token", "method", a) == 2, a).when(state("token", "method", b) == 2, b) for k, (a, b) in VOTE_READS.items()}
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    errors = [F.when(blank("code"), "dao.code missing"), F.when(blank("governor"), "dao.governor missing"), F.when(blank("token"), "dao.token.contract missing")]
    errors.append(F.when(~F.coalesce(F.col("standard").isin(*TOKEN_METHODS), F.lit(False)), F.concat(F.lit("dao.token.standard "), F.coalesce("standard", F.lit("(missing)")), F.lit(" unsupported"))))
    errors += [method("governor", n) for n in GOVERNOR_METHODS] + [event("governor", n) for n in GOVERNOR_EVENTS]
    for standard, methods in TOKEN_METHODS.items():
        here = F.col("standard") == standard
        errors += [F.when(here, method("token", n)) for n in methods]
        topics = F.coalesce(F.col("transfer_topics").cast("string"), F.lit("unknown"))
        errors.append(F.when(here & ~F.col("transfer_topics").eqNullSafe(F.lit(TRANSFER_TOPICS[standard])), F.concat(F.lit(f"dao.token.standard declares {standard} but Transfer has "), topics, F.lit(" indexed arguments"))))
    errors += [event("token", n) for n in TOKEN_EVENTS] + [F.when(reads[k].isNull(), f"token.{a}/{b} missing") for k, (a, b) in VOTE_READS.items()]
    warnings = [F.when(reads[k] == b, f"token.{a} missing; using {b} fallback") for k, (a, b) in VOTE_READS.items()]
    warnings += [F.when(state("governor", "method", n) != 2, f"governor.{n} missing; {then}") for n, then in OPTIONAL_METHODS.items()]
    listed = rows.select("code", F.array_compact(F.array(*errors)).alias("errors"), F.array_compact(F.array(*warnings)).alias("warnings"), *(c.alias(k) for k, c in reads.items()))
    support = F.when(F.size("errors") > 0, "unsupported").when(F.size("warnings") > 0, "degraded").otherwise("supported")
    return listed.select("code", support.alias("support"), "errors", "warnings", *reads)


def comment_tree(comments: DataFrame, ident: str, parent: str, order: list[str] | None = None) -> DataFrame:
    """Depth and root of every comment; comments without a known parent are roots, and so are those on cycles and below them.

    Of rows that repeat an id the first in ``order`` (columns; by default the least parent) counts; null ids are left out. By pointer doubling: each round every comment learns of an ancestor twice as
    far away, so that a thread of any length takes the logarithm of its length in rounds. Each round is checkpointed. A comment that has learned of its root
    leaves the joins, and those right below a root know it from the start, so that no round meets under a root. Once only comments that no root reaches go on, as
    many rounds as there are comments' bits have passed.
    """
    from rollcall.operators.filters import missing

    first = F.struct(*order) if order else F.struct(F.col(parent).isNotNull(), F.col(parent))
    nodes = comments.where(F.col(ident).isNotNull()).groupBy(F.col(ident).alias("id")).agg(F.min_by(F.struct(F.col(parent).alias("parent")), first)["parent"].alias("parent"))
    nodes = _kept(nodes)
    roots = _kept(missing(nodes, nodes.select(F.col("id").alias("known")), {"parent": "known"}).select("id"))
    below = missing(nodes, roots.select(F.col("id").alias("known")), {"id": "known"}).join(roots.select(F.col("id").alias("parent"), F.lit(True).alias("done")), "parent", "left")
    # steps to the ancestor ``at``; those that are done stand at their root
    now = roots.select("id", F.col("id").alias("at"), F.lit(0).cast("long").alias("steps"), F.lit(True).alias("done"))
    now = _kept(now.unionByName(below.select("id", F.col("parent").alias("at"), F.lit(1).cast("long").alias("steps"), F.coalesce("done", F.lit(False)).alias("done"))))
    rounds = max(1, now.count()).bit_length() + 1
    for _ in range(rounds):
        if now.where("NOT done").isEmpty():
            break
        there = now.select(F.col("id").alias("at"), F.col("at").alias("_at"), F.col("steps").alias("_steps"), F.col("done").alias("_done"))
        now = _kept(now.where("done").unionByName(now.where("NOT done").drop("done").join(there, "at").select("id", F.col("_at").alias("at"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_done").alias("done"))))
    return now.select("id", F.when(F.col("done"), F.col("steps")).otherwise(F.lit(0)).cast("int").alias("depth"), F.when(F.col("done"), F.col("at")).otherwise(F.col("id")).alias("root"))


def comment_threads(comments: DataFrame, ident: str, parent: str, order: list[str]) -> DataFrame:
    """Comments in thread order: id, depth, root, parent (null for roots), place (from 1 on, over all).

    Threads come in the order of their roots, answers right after what they answer, and in ``order`` (columns that tell ids apart) among each other. The
    place inside a thread is that in an Euler tour: every comment is entered and left once, each of these steps names the next one, and pointer doubling counts
    the entries up to the end of the tour. Steps have one step before and after them each, so that threads and answers to one comment may be of any number.
    """
    first = _kept(comments.where(F.col(ident).isNotNull()).groupBy(F.col(ident).alias("id")).agg(F.min(F.struct(*order)).alias("order"), F.min_by(F.struct(F.col(parent).alias("parent")), F.struct(*order))["parent"].alias("parent")))
    tree = comment_tree(comments, ident, parent, order)
    nodes = first.join(tree, "id").withColumn("parent", F.when(F.col("root") == F.col("id"), F.lit(None)).otherwise(F.col("parent")))
    nodes = _kept(ranked_overall(nodes, [F.col("parent").asc_nulls_first(), F.col("order").asc(), F.col("id").asc()], "n"))
    children = nodes.where("parent IS NOT NULL")
    eldest = children.groupBy("parent").agg(F.min("n").alias("child")).withColumnRenamed("parent", "id")
    younger = children.select((F.col("n") - 1).alias("n"), F.col("parent").alias("_parent"), F.lit(True).alias("more"))
    numbered = nodes.select(F.col("id").alias("parent"), F.col("n").alias("up"))
    placed = nodes.join(eldest, "id", "left").join(younger, "n", "left").join(numbered, "parent", "left")
    sibling = F.coalesce(F.col("more"), F.lit(False)) & F.coalesce(F.col("_parent") == F.col("parent"), F.lit(False))
    # step 2n enters comment n, step 2n + 1 leaves it
    enter = F.struct((2 * F.col("n")).alias("step"), F.coalesce(2 * F.col("child"), 2 * F.col("n") + 1).alias("next"), F.lit(1).cast("long").alias("left"))
    leave = F.struct((2 * F.col("n") + 1).alias("step"), F.when(sibling, 2 * F.col("n") + 2).otherwise(2 * F.col("up") + 1).alias("next"), F.lit(0).cast("long").alias("left"))
    tour = _kept(placed.select(F.explode(F.array(enter, leave)).alias("s")).select("s.*"))
    while not tour.where("next IS NOT NULL").isEmpty():
        ahead = tour.select(F.col("step").alias("next"), F.col("next").alias("_next"), F.col("left").alias("_left"))
        tour = _kept(tour.where("next IS NULL").unionByName(tour.where("next IS NOT NULL").join(ahead, "next").select("step", F.col("_next").alias("next"), (F.col("left") + F.col("_left")).alias("left"))))
    counted = nodes.join(tour.where("step % 2 = 0").select((F.col("step") / 2).cast("long").alias("n"), "left"), "n")
    sizes = counted.where("parent IS NULL").select("root", F.col("left").alias("size"), F.col("order").alias("root_order"))
    inside = counted.join(sizes, "root").select("id", "depth", "root", "parent", "root_order", (F.col("size") - F.col("left")).alias("inside"))
    return ranked_overall(inside, [F.col("root_order").asc(), F.col("root").asc(), F.col("inside").asc()], "place").select("id", "depth", "root", "parent", "place")


def _kept(rows: DataFrame) -> DataFrame:
    """Rows computed once, in the folder that all executors share."""
    spark = rows.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None)
    if spark.sparkContext.getCheckpointDir() is None:
        if at is None and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(at or tempfile.mkdtemp(prefix="checkpoints"))
    return rows.checkpoint()
