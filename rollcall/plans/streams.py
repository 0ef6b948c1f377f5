"""Queries of block-height streaming state."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollcall.plans import analogues as a
from rollcall.plans.registry import query, query_sql
from rollcall.plans.status_queries import SYNC, checkpoints
from rollcall.sources.block_log import block_stream
from rollcall.sources.folders import new_folder
from rollcall.sources.versions import VersionedTable
from rollcall.streaming import jobs, state
from rollcall.streaming.keyed import DelegationFold, RefreshTasks
from rollcall.streaming.rules import RETRYABLE, Rules

BATCHES = 4


def arriving(spark, rows, height):
    """Rows as a stream by height in a few batches, from a log in the shared folder; also the blocks of a batch, how many partitions their state is worth, and a checkpoint."""
    at = new_folder(spark, "log")
    rows.repartitionByRange(8, height).write.parquet(at)
    log = spark.read.schema(rows.schema).parquet(at)
    n, top = log.agg(F.count("*"), F.max(height)).first()
    batch = max(1, -(-((top or 0) + 1) // BATCHES))
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(12, n // 200_000))  # each task of each batch tells the driver its figures
    checkpoint = new_folder(spark, "state")
    return block_stream(spark, at, height, batch=batch, width=max(1, batch // 4), checkpoint=checkpoint), batch, parts, checkpoint


@query("SELECT delegator, max(pos) AS processed_height, max(pos) + 1 AS next_block, max(pos) + 10 AS target_height, CAST(NULL AS VARCHAR) AS last_error FROM logged GROUP BY delegator")
def str_checkpoint(spark, d):
    commits = a.logged(spark, d).select("delegator", F.col("pos").alias("processed_height"), (F.col("pos") + 1).alias("next_block"), (F.col("pos") + 10).alias("target_height"), F.lit(None).cast("string").alias("last_error"))
    stale = commits.where("processed_height < 300").withColumn("last_error", F.lit("timeout"))
    return state.advanced(stale, commits, ["delegator"])


@query("SELECT * FROM (WITH" + SYNC.replace(",", " ", 1) + "SELECT delegator, processed + 1 AS from_block, least(processed + 40, target) AS to_block FROM point WHERE processed + 1 <= target)")
def str_next_range(spark, d):
    found = checkpoints(spark, d).select("delegator", state.next_range(F.col("processed") + 1, F.col("target"), 40).alias("r"))
    return found.where("r IS NOT NULL").select("delegator", "r.from_block", "r.to_block")


@query("SELECT delegator, greatest(min(pos) + 1, max(pos) - 29) AS from_block, max(pos) AS to_block FROM logged GROUP BY delegator HAVING max(pos) > min(pos)")
def str_tail_tumbling(spark, d):
    ends = a.logged(spark, d).groupBy("delegator").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    return ends.select("delegator", state.tail_window(F.col("hi"), F.col("lo"), 30).alias("r")).where("r IS NOT NULL").select("delegator", "r.from_block", "r.to_block")


@query("SELECT * FROM (WITH" + SYNC.replace(",", " ", 1) + "SELECT delegator, target + 1 AS from_block, target + 5 AS to_block FROM point WHERE processed >= target)")
def str_prov_tail(spark, d):
    c = checkpoints(spark, d).select("delegator", state.provisional_range(F.col("processed"), F.col("target"), F.col("target") + 5).alias("r"))
    return c.where("r IS NOT NULL").select("delegator", "r.from_block", "r.to_block")


@query("SELECT delegator, kind, count(*) AS n FROM logged GROUP BY delegator, kind")
def str_replay(spark, d):
    """A log of which every row is read again in a later batch counts once."""
    rows = a.logged(spark, d).select("pos", "delegator", "kind")
    lag = (rows.agg(F.max("pos")).first()[0] or 0) // 3 + 1
    twice = rows.withColumn("arrival", F.col("pos")).unionByName(rows.withColumn("arrival", F.col("pos") + lag))
    stream, batch, parts, state_at = arriving(spark, twice, "arrival")
    counts = VersionedTable(spark, new_folder(spark, "counts"), ["pos", "batch"], "pos long, batch long, delegator long, kind string")

    def each(new, number):
        counts.upsert(new.select("pos", F.lit(number).cast("long").alias("batch"), "delegator", "kind"), "replay", number)

    jobs.run_available(jobs.deduplicated(stream.select("pos", "delegator", "kind"), ["pos"], "pos", lag + batch), state_at, each, partitions=parts)
    return counts.read().groupBy("delegator", "kind").agg(F.count("*").alias("n"))


CONFIRMATIONS = 50


@query(f"SELECT pos, delegator, kind, value FROM logged WHERE pos <= (SELECT max(pos) FROM logged) - {CONFIRMATIONS}")
def str_promotion(spark, d):
    """Rows that have become final when the log has been read: those that it has come so many blocks above."""
    stream, _, parts, state_at = arriving(spark, a.logged(spark, d).select("pos", "delegator", "kind", "value"), "pos")
    final = VersionedTable(spark, new_folder(spark, "final"), ["pos"], "pos long, delegator long, kind string, value long")
    jobs.run_available(jobs.promoted(stream, ["pos"], "pos", CONFIRMATIONS), state_at, lambda new, number: final.upsert(new, "final", number), partitions=parts)
    return final.read()


@query("SELECT pos, CASE WHEN pos > 600 AND kind = 'view' THEN 'invalid' ELSE 'available' END AS status FROM logged")
def str_retraction(spark, d):
    from rollcall.operators.overlay import rolled_back

    rows = a.logged(spark, d).withColumns({"status": F.lit("available"), "reason": F.lit(None).cast("string")})
    return rolled_back(rows, (F.col("pos") > 600) & (F.col("kind") == "view"), "reorg").select("pos", "status")


ERRORS = [" and ".join(parts) for parts in RETRYABLE] + ["execution reverted", "bad address", ""]
NOW, LEASE, RETRY, ATTEMPTS = "1705500000000", 3_600_000, 600_000, 3


def task_table(spark, d):
    """A task for every row of the event table, with every status and error."""
    at = F.col("at_ms")
    status = F.element_at(F.array(*map(F.lit, ("pending", "failed", "processing", "exhausted", "completed"))), (F.col("pos") % 5 + 1).cast("int"))
    error = F.element_at(F.array(*map(F.lit, ERRORS)), (F.col("value") % len(ERRORS) + 1).cast("int"))
    rows = a.logged(spark, d).select(F.col("pos").alias("id"), status.alias("status"), (F.col("value") % 5).cast("int").alias("attempts"), (at + 1000 * (F.col("value") % 7)).alias("next_run_at"), F.when(F.col("kind") != "view", at).alias("locked_at"), "at_ms", error.alias("error"))
    rows = rows.withColumns({"locked_at": F.when(F.col("status") == "processing", F.col("locked_at")), "processed_at": F.when(F.col("id") % 3 == 0, F.col("at_ms"))})
    return rows.select("id", "status", "attempts", "next_run_at", "locked_at", F.when(F.col("status") == "processing", "worker").alias("locked_by"), F.col("at_ms").alias("updated_at"), "processed_at", F.concat(F.lit("RPC: "), F.upper("error")).alias("error"))


def is_retryable_sql(error):
    return "(" + " OR ".join("(" + " AND ".join(f"lower(coalesce({error}, '')) LIKE '%{p}%'" for p in parts) + ")" for parts in RETRYABLE) + ")"


TASKS = f""", task AS (
  SELECT pos AS id, status, CAST(value % 5 AS INTEGER) AS attempts, at_ms + 1000 * (value % 7) AS next_run_at, CASE WHEN status = 'processing' AND kind <> 'view' THEN at_ms END AS locked_at,
    at_ms AS updated_at, CASE WHEN pos % 3 = 0 THEN at_ms END AS processed_at, 'RPC: ' || upper(([{", ".join(f"'{e}'" for e in ERRORS)}])[value % {len(ERRORS)} + 1]) AS error
  FROM (SELECT *, (['pending', 'failed', 'processing', 'exhausted', 'completed'])[pos % 5 + 1] AS status FROM logged)
)"""
CLAIM = 32


@query(f"""SELECT * FROM (WITH{TASKS.replace(",", " ", 1)}, q AS (
  SELECT *, CASE WHEN status = 'pending' THEN 2 WHEN status = 'failed' AND attempts < {ATTEMPTS} THEN 1 WHEN status = 'processing' AND locked_at <= {NOW} - {LEASE} AND attempts < {ATTEMPTS} THEN 0 END AS queue FROM task WHERE next_run_at <= {NOW}
), r AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY next_run_at, updated_at, id) AS place FROM q WHERE queue IS NOT NULL
), c AS (SELECT count(*) FILTER (WHERE queue = 0) AS c0, count(*) FILTER (WHERE queue = 1) AS c1, count(*) FILTER (WHERE queue = 2) AS c2 FROM r
), f AS (SELECT *, least(11, c0) AS a0, least(11, c1) AS a1, least(11, c2, {CLAIM} - least(11, c0) - least(11, c1)) AS a2 FROM c
), g AS (SELECT *, {CLAIM} - a0 - a1 - a2 AS rest, least(c0 - a0, {CLAIM} - a0 - a1 - a2) AS b0 FROM f
), h AS (SELECT *, least(c1 - a1, rest - b0) AS b1 FROM g
), i AS (SELECT *, least(c2 - a2, rest - b0 - b1) AS b2 FROM h)
SELECT id, 'processing' AS status, attempts + 1 AS attempts, CAST({NOW} AS BIGINT) AS locked_at FROM r, i WHERE place <= CASE queue WHEN 0 THEN a0 + b0 WHEN 1 THEN a1 + b1 ELSE a2 + b2 END)""")
def str_claim(spark, d):
    taken = state.claimed(task_table(spark, d), F.lit(int(NOW)), CLAIM, LEASE, ATTEMPTS)
    return taken.select("id", "status", "attempts", "locked_at")


@query("SELECT account FROM contributor WHERE account % 7 <> 0 AND account NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AND account NOT IN (SELECT delegator FROM logged WHERE kind = 'view')")
def str_coverage_repair(spark, d):
    """Contributors without a live power, a task that is open, and a candidate that waits."""
    tasks = a.proposals(spark, d).where("state = 'P'").select(F.col("proposer").alias("account"))
    waiting = a.logged(spark, d).where("kind = 'view'").select(F.col("delegator").alias("account"))
    return state.uncovered(a.contributors(spark, d).select("account"), "account", a.live_contributors(spark, d), tasks, waiting)


@query(f"""SELECT * FROM (WITH{TASKS.replace(",", " ", 1)}
SELECT id, CASE WHEN status <> 'processing' THEN status WHEN {is_retryable_sql("error")} OR attempts < {ATTEMPTS} THEN 'failed' ELSE 'exhausted' END AS status,
  CASE WHEN status = 'processing' AND {is_retryable_sql("error")} AND attempts >= {ATTEMPTS} THEN {ATTEMPTS - 1} ELSE attempts END AS attempts,
  CASE WHEN status = 'processing' THEN CAST({NOW} + {RETRY} * power(2, greatest(least(attempts - 1, 5), 0)) AS BIGINT) ELSE next_run_at END AS next_run_at, CASE WHEN status = 'processing' THEN NULL ELSE processed_at END AS processed_at FROM task)""")
def str_fail_policy(spark, d):
    tasks = task_table(spark, d)
    return state.failed(tasks, F.col("error"), F.lit(int(NOW)), RETRY, ATTEMPTS).select("id", "status", "attempts", "next_run_at", "processed_at")


@query(f"""SELECT * FROM (WITH{TASKS.replace(",", " ", 1)}, j AS (
  SELECT *, {is_retryable_sql("error")} AS again, attempts >= {ATTEMPTS} AND status = 'processing' AND coalesce(locked_at <= {NOW} - {LEASE}, false) AS stale FROM task
), k AS (SELECT *, again AND (status = 'exhausted' OR stale) AS back, NOT again AND (stale OR status = 'failed' AND attempts >= {ATTEMPTS}) AS done FROM j)
SELECT id, CASE WHEN back THEN 'failed' WHEN done THEN 'exhausted' ELSE status END AS status, CASE WHEN back THEN {ATTEMPTS - 1} ELSE attempts END AS attempts, CASE WHEN back THEN {NOW} + {RETRY} * 4 ELSE next_run_at END AS next_run_at,
  CASE WHEN back OR done THEN NULL ELSE locked_at END AS locked_at, CASE WHEN back THEN NULL WHEN done THEN coalesce(processed_at, {NOW}) ELSE processed_at END AS processed_at FROM k)""")
def str_sweep(spark, d):
    """Retryable tasks that were exhausted come back, others that are out of attempts are exhausted, stale locks among them."""
    return state.swept(task_table(spark, d), F.lit(int(NOW)), LEASE, RETRY, ATTEMPTS).select("id", "status", "attempts", "next_run_at", "locked_at", "processed_at")


RULES = Rules(debounce_ms=3_600_000, lease_ms=172_800_000, retry_ms=1_800_000, max_attempts=3)
DELAY_MS = 21_600_000


def tasks_sql(acts, columns):
    """The task of each account after all its events in order, one recursion a step, and after the leases that ended by the last watermark."""
    lease, most, debounce, held = RULES.lease_ms, RULES.max_attempts, RULES.debounce_ms, "status = 'processing'"
    again = is_retryable_sql("error")
    names = ("status", "attempts", "next_run_at", "locked_at", "again", "again_block", "first_block", "last_block", "error", "processed_at")
    wait = lambda n: f"{RULES.retry_ms} * CAST(power(2, greatest(least({n} - 1, 5), 0)) AS BIGINT)"

    def stage(source, changes):
        return "(SELECT * REPLACE (" + ", ".join(f"CASE {' '.join(f'WHEN {c} THEN {x}' for c, x in cases)} ELSE {n} END AS {n}" for n, cases in changes.items()) + f") FROM {source})"

    def swept(source, stale, now, guard):
        back, over = f"{guard} AND {again} AND (status = 'exhausted' OR attempts >= {most} AND {stale})", f"{guard} AND NOT {again} AND attempts >= {most} AND ({stale} OR status = 'failed')"
        return stage(source, {
            "status": [(back, "'failed'"), (over, "'exhausted'")], "attempts": [(back, str(most - 1))], "next_run_at": [(back, f"{now} + {wait(most)}")], "locked_at": [(f"({back}) OR ({over})", "NULL")],
            "processed_at": [(back, "NULL"), (over, f"coalesce(processed_at, {now})")],
        })

    ended = lambda source, limit: swept(source, f"{held} AND locked_at + {lease} <= {limit}", f"locked_at + {lease}", f"{held} AND attempts >= {most} AND locked_at + {lease} <= {limit}")
    joined = f"(SELECT e.account, e.k, e.at_ms, e.act, e.block, e.err, {', '.join(f'r.{n}' for n in names)} FROM r JOIN e ON e.account = r.account AND e.k = r.k + 1)"
    before = swept(ended(joined, "at_ms"), f"{held} AND locked_at <= at_ms - {lease}", "at_ms", "act = 'run'")
    claim = f"act = 'run' AND next_run_at <= at_ms AND (status = 'pending' OR attempts < {most} AND (status = 'failed' OR {held} AND locked_at <= at_ms - {lease}))"
    first, known = "act = 'seen' AND status IS NULL", "act = 'seen' AND NOT (status = 'completed' AND block <= last_block)"
    noted, rearmed = f"{known} AND {held}", f"{known} AND status <> 'processing'"
    done, broken = f"act = 'ok' AND {held}", f"act = 'error' AND {held}"
    after = stage(before, {
        "status": [(claim, "'processing'"), (first, "'pending'"), (rearmed, "'pending'"), (f"{done} AND again", "'pending'"), (done, "'completed'"), (f"{broken} AND ({is_retryable_sql('err')} OR attempts < {most})", "'failed'"), (broken, "'exhausted'")],
        "attempts": [(claim, "attempts + 1"), (f"({first}) OR ({rearmed}) OR ({done} AND again)", "0"), (f"{broken} AND {is_retryable_sql('err')} AND attempts >= {most}", str(most - 1))],
        "next_run_at": [(f"({first}) OR ({rearmed}) OR ({done} AND again)", f"at_ms + {debounce}"), (broken, f"at_ms + {wait('attempts')}")],
        "locked_at": [(claim, "at_ms"), (f"({done}) OR ({broken})", "NULL")], "again": [(noted, "true"), (done, "false")],
        "again_block": [(noted, "greatest(coalesce(again_block, last_block), block)"), (f"({rearmed}) OR ({done})", "NULL")],
        "first_block": [(first, "block"), (known, "least(first_block, block)")], "last_block": [(first, "block"), (known, "greatest(last_block, block)"), (done, "coalesce(again_block, last_block)")],
        "error": [(f"({rearmed}) OR ({done})", "NULL"), (broken, "coalesce(err, '')")], "processed_at": [(f"{done} AND NOT again", "at_ms"), (f"({rearmed}) OR ({broken})", "NULL")],
    })
    cases = " ".join(f"WHEN kind = '{k}' THEN '{x}'" for k, x in acts.items())
    return f"""SELECT * FROM (WITH RECURSIVE e AS (
  SELECT delegator AS account, pos AS block, at_ms, CASE {cases} END AS act, ([{", ".join(f"'{x}'" for x in ERRORS)}])[value % {len(ERRORS)} + 1] AS err, row_number() OVER (PARTITION BY delegator ORDER BY at_ms, pos) AS k FROM logged
), r AS (
  SELECT DISTINCT account, CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS status, 0 AS attempts, CAST(NULL AS BIGINT) AS next_run_at, CAST(NULL AS BIGINT) AS locked_at, false AS again, CAST(NULL AS BIGINT) AS again_block,
    CAST(NULL AS BIGINT) AS first_block, CAST(NULL AS BIGINT) AS last_block, CAST(NULL AS VARCHAR) AS error, CAST(NULL AS BIGINT) AS processed_at FROM e
  UNION ALL SELECT account, k, {", ".join(names)} FROM {after} AS x
), z AS (SELECT r.* FROM r JOIN (SELECT account, max(k) AS k FROM r GROUP BY account) USING (account, k))
SELECT account, {", ".join(columns)} FROM {ended("z", f"(SELECT max(at_ms) - {DELAY_MS} FROM logged)")} AS y)"""


def kept_tasks(spark, d, acts):
    act = F.lit(None).cast("string")
    for k, x in acts.items():
        act = F.when(F.col("kind") == k, x).otherwise(act)
    error = F.element_at(F.array(*map(F.lit, ERRORS)), (F.col("value") % len(ERRORS) + 1).cast("int"))
    rows = a.logged(spark, d).select(F.col("delegator").alias("account"), "pos", "at_ms", act.alias("kind"), F.col("pos").alias("block"), error.alias("error"))
    stream, _, parts, state_at = arriving(spark, rows, "pos")
    fold = RefreshTasks(RULES)
    kept = VersionedTable(spark, new_folder(spark, "tasks"), ["account"], fold.told)
    jobs.keep_folded(stream, state_at, fold, f"{DELAY_MS} milliseconds", kept, partitions=parts)
    return kept.read()


BURSTS = {"view": "seen", "click": "seen", "error": "seen", "signup": "run", "purchase": "ok"}
TURNS = {"view": "seen", "click": "run", "error": "error", "signup": "run", "purchase": "ok"}


@query(tasks_sql(BURSTS, ("status", "next_run_at", "again", "first_block", "last_block")))
def str_debounce(spark, d):
    """Bursts of events put an account's work off; what comes while it is locked arms it again afterwards. State by account, across batches."""
    return kept_tasks(spark, d, BURSTS).select("account", "status", "next_run_at", "again", "first_block", "last_block")


@query(tasks_sql(TURNS, ("status", "CAST(attempts AS BIGINT) AS attempts", "next_run_at", "locked_at", "error")))
def str_timers(spark, d):
    """Attempts, pauses and leases of an account's work; leases end by timers in the state."""
    return kept_tasks(spark, d, TURNS).select("account", "status", "attempts", "next_run_at", "locked_at", "error")


@query(query_sql("fld_mapping_snapshot"), views=False)
def str_late(spark, d):
    """The delegations after a log of which a seventh came late, far below the height that had been reached."""
    from rollcall.plans.projections import delegation_log

    log = delegation_log(spark, d)
    lag = (log.agg(F.max("pos")).first()[0] or 0) // 2 + 1
    rows = log.withColumn("arrival", F.when(F.col("pos") % 7 == 0, F.col("pos") + lag).otherwise(F.col("pos")))
    stream, _, parts, state_at = arriving(spark, rows, "arrival")
    shape = "delegator long, pos long, kind string, from_delegate string, to_delegate string, delta long, late boolean"
    table = VersionedTable(spark, new_folder(spark, "logged"), ["pos"], shape, ["delegator"])
    snapshot = VersionedTable(spark, new_folder(spark, "snapshot"), ["delegator"], "delegator long, delegate string, power long, n_late long")
    jobs.corrected(stream.drop("arrival"), state_at, table, snapshot, 100, "zero", parts)
    return snapshot.read().where("delegate IS NOT NULL").select("delegator", "delegate", "power")


@query(query_sql("fld_mapping_snapshot"), views=False)
def str_stateful_fold(spark, d):
    """The delegations that a stream over the log has kept, with the state of each delegator between batches."""
    from rollcall.plans.projections import delegation_log

    rows = delegation_log(spark, d).select("delegator", "pos", (F.col("pos") * 1000).alias("at_ms"), "kind", "from_delegate", "to_delegate", F.col("delta").cast("string").alias("delta"))
    stream, batch, parts, state_at = arriving(spark, rows, "pos")
    fold = DelegationFold(zero="zero")
    kept = VersionedTable(spark, new_folder(spark, "delegations"), ["delegator"], fold.told)
    jobs.keep_folded(stream, state_at, fold, f"{batch // 2} seconds", kept, gone=~F.col("is_current"), partitions=parts)
    return kept.read().select("delegator", "delegate", F.col("power").cast("long").alias("power"))
