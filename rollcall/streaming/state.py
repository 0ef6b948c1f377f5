"""Block height as event time: checkpoints, ranges, tails, promotion, queues."""

from __future__ import annotations

import math
import operator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.streaming.rules import ERROR_CHARS, MOST_DOUBLINGS, RETRYABLE


def advanced(checkpoints: DataFrame, commits: DataFrame, keys: list[str]) -> DataFrame:
    """Checkpoints that only ever move forward; a commit clears the error."""
    both = checkpoints.withColumn("_commit", F.lit(False)).unionByName(commits.withColumn("_commit", F.lit(True)), allowMissingColumns=True)
    error = F.when(F.max("_commit"), F.lit(None).cast("string")).otherwise(F.max("last_error"))
    return both.groupBy(*keys).agg(F.max("next_block").alias("next_block"), F.max("processed_height").alias("processed_height"), F.max("target_height").alias("target_height"), error.alias("last_error"))


def next_range(next_block: Column, target: Column, limit: Column | int) -> Column:
    """The next (from_block, to_block); null once the target is reached."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    return F.when(next_block <= target, F.struct(next_block.alias("from_block"), F.least(next_block + limit - 1, target).alias("to_block")))


def tail_window(latest: Column, previous: Column, blocks: int) -> Column:
    """The newest blocks to read at once: from after the previous head, but no more than ``blocks``."""
    return F.when(latest > F.coalesce(previous, F.lit(-1)), F.struct(F.greatest(F.coalesce(previous + 1, F.lit(0)), latest - blocks + 1).alias("from_block"), latest.alias("to_block")))


def provisional_range(processed: Column, target: Column, latest: Column) -> Column:
    """What lies above the durable rows, once those are complete."""
    return F.when((processed >= target) & (latest > target), F.struct((target + 1).alias("from_block"), latest.alias("to_block")))


@dataclass
class ChunkSizer:
    """Chunk sizes that follow what the chunks before took: halved when slow or dense, doubled after stable ones."""

    size: int
    least: int = 100
    most: int = 10_000
    full_hit_floor: int = 1_000
    fast_fill_s: float = 3.0
    slow_s: float = 10.0
    fast_s: float = 1.0
    dense_rows: int = 5_000
    sparse_rows: int = 100
    stable_to_grow: int = 2
    unstable_to_shrink: int = 2
    stable: int = field(default=0, init=False)
    unstable: int = field(default=0, init=False)

    def halved(self, floor: int) -> None:
        self.size = max(min(floor, self.size), math.floor(self.size * 0.5))

    def record(self, rows: int, read_s: float, local_s: float, full_hits: int = 0, fills: int = 0, queries: int = 0) -> str:
        """Takes in one chunk and returns the reason for the new size."""
        only_hits = queries > 0 and full_hits == queries and not fills
        fast = read_s <= self.fast_s and local_s <= self.fast_s
        if local_s > self.slow_s or read_s > self.slow_s or rows >= self.dense_rows:
            self.stable = self.unstable = 0
            self.halved(self.full_hit_floor if local_s > self.slow_s >= read_s and only_hits else self.least)
            return "slow_local_processing" if local_s > self.slow_s else "high_query_duration" if read_s > self.slow_s else "dense_rows"
        if fills and read_s > self.fast_fill_s:
            self.stable, self.unstable = 0, self.unstable + 1
            if self.unstable < self.unstable_to_shrink:
                return "slow_cache_fill_hold"
            self.unstable = 0
            self.halved(self.least)
            return "repeated_slow_cache_fill"
        if fills:
            self.stable = self.unstable = 0
            return "fast_cache_fill"
        hit = full_hits > 0
        steady = only_hits and rows <= self.sparse_rows and local_s <= self.fast_s if hit else fast or rows <= self.sparse_rows
        self.unstable = 0
        self.stable = self.stable + 1 if steady else 0
        if self.stable < self.stable_to_grow:
            return "hold"
        self.stable, self.size = 0, min(2 * self.size, self.most)
        return "stable_full_hit" if hit else "stable_fast_chunk" if fast else "stable_sparse_range"


QUEUES = ("processing", "failed", "pending")


def claimed(tasks: DataFrame, now: Column, n: int, lease_ms: int, max_attempts: int = 3, owner: str = "worker", ident: str = "id") -> DataFrame:
    """The tasks that a worker takes at once, at most n, as they are then.

    ``tasks``: status, attempts, next_run_at, locked_at, locked_by, updated_at and an id. Due ones are taken from stale locks, then from failed tasks, then from
    pending ones: of each a third of n (rounded up) at most, as long as n lasts; what is left of n is filled from the queues in the same order.
    Only the first n of each queue are ranked; a row of three counts says how many each gives.
    """
    stale, left = F.col("locked_at") <= now - lease_ms, F.col("attempts") < max_attempts
    queue = F.when(F.col("status") == "pending", 2).when((F.col("status") == "failed") & left, 1).when((F.col("status") == "processing") & stale & left, 0)
    due = tasks.withColumn("_queue", queue).where(F.col("_queue").isNotNull() & (F.col("next_run_at") <= now))
    order = [F.col(c).asc_nulls_last() for c in ("next_run_at", "updated_at", ident)]
    ranked = due.withColumn("_place", F.row_number().over(Window.partitionBy("_queue").orderBy(*order))).where(F.col("_place") <= n)
    counts = ranked.agg(*(F.count_if(F.col("_queue") == k).cast("int").alias(f"_has{k}") for k in range(len(QUEUES))))
    rest, gives = F.lit(n), []
    for k in range(len(QUEUES)):
        gives.append(F.least(F.lit(math.ceil(n / len(QUEUES))), F.col(f"_has{k}"), rest))
        rest = rest - gives[k]
    for k in range(len(QUEUES)):
        more = F.least(F.col(f"_has{k}") - gives[k], rest)
        gives[k], rest = gives[k] + more, rest - more
    shares = counts.select(F.array(*gives).alias("_gives"))
    taken = ranked.crossJoin(F.broadcast(shares)).where(F.col("_place") <= F.get("_gives", F.col("_queue")))
    return taken.select(*tasks.columns).withColumns({"status": F.lit("processing"), "attempts": F.col("attempts") + 1, "locked_at": now, "locked_by": F.lit(owner), "updated_at": now})


def debounced(events: DataFrame, key: str, at: str, delay: Column | int) -> DataFrame:
    """When each key's work runs: a delay after its last event."""
    return events.groupBy(key).agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count("*").alias("n_events")).withColumn("next_run_at", F.col("last_at") + delay)


def retryable(error: Column) -> Column:
    """Whether an error is one after which a task is always tried again."""
    text = F.lower(F.coalesce(error, F.lit("")))
    return reduce(operator.or_, (reduce(operator.and_, (text.contains(part) for part in parts)) for parts in RETRYABLE))


def pause(attempts: Column, base_ms: int) -> Column:
    """How long a task waits after so many attempts."""
    doublings = F.least(F.greatest(attempts - 1, F.lit(0)), F.lit(MOST_DOUBLINGS)).cast("int")
    return F.lit(base_ms).cast("long") * F.element_at(F.array(*(F.lit(1 << k) for k in range(MOST_DOUBLINGS + 1))), doublings + 1)


def failed(tasks: DataFrame, error: Column, now: Column, base_ms: int, max_attempts: int = 3) -> DataFrame:
    """What becomes of tasks whose worker reports an error: failed and due again after a pause, or exhausted unless the error always is retryable.

    ``tasks``: status, attempts, next_run_at, locked_at, locked_by, processed_at, error, updated_at. Only tasks in process change.
    """
    held, again, spent = F.col("status") == "processing", retryable(error), F.col("attempts") >= max_attempts
    changes = {
        "status": F.when(again | ~spent, "failed").otherwise("exhausted"), "attempts": F.when(again & spent, max(max_attempts - 1, 0)).otherwise(F.col("attempts")), "next_run_at": now + pause(F.col("attempts"), base_ms),
        "locked_at": F.lit(None), "locked_by": F.lit(None), "processed_at": F.lit(None), "error": F.substring(F.coalesce(error, F.lit("")), 1, ERROR_CHARS), "updated_at": now,
    }
    return tasks.withColumns({c: F.when(held, x).otherwise(F.col(c)) for c, x in changes.items()})


def swept(tasks: DataFrame, now: Column, lease_ms: int, base_ms: int, max_attempts: int = 3) -> DataFrame:
    """What becomes of tasks that are out of attempts when a worker looks: exhausted ones and stale locks with a retryable error get their last
    attempt back after a pause, other stale locks and failed tasks are exhausted. All such tasks at once, without a limit."""
    again, spent = retryable(F.col("error")), F.col("attempts") >= max_attempts
    stale = (F.col("status") == "processing") & F.coalesce(F.col("locked_at") <= now - lease_ms, F.lit(False))
    back = again & ((F.col("status") == "exhausted") | stale & spent)
    over = ~again & spent & ((F.col("status") == "failed") | stale)
    change = lambda yes, no, column: F.when(back, yes).when(over, no).otherwise(F.col(column))
    none = F.lit(None)
    return tasks.withColumns({
        "status": change(F.lit("failed"), F.lit("exhausted"), "status"), "attempts": change(F.lit(max(max_attempts - 1, 0)), F.col("attempts"), "attempts"), "next_run_at": change(now + pause(F.lit(max_attempts), base_ms), F.col("next_run_at"), "next_run_at"),
        "locked_at": change(none, none, "locked_at"), "locked_by": change(none, none, "locked_by"), "processed_at": change(none, F.coalesce(F.col("processed_at"), now), "processed_at"), "updated_at": change(now, now, "updated_at"),
    })


def chunk_sizes(chunks: DataFrame, key: str, pos: str, size: int) -> DataFrame:
    """The chunk size of each key after its chunks, in order. ``chunks``: key, pos, read_s, local_s, rows."""
    kind = chunks.schema[key].dataType.simpleString()

    def sized(rows: pd.DataFrame) -> pd.DataFrame:
        sizer = ChunkSizer(size)
        for r in rows.sort_values(pos).itertuples():
            sizer.record(r.rows, r.read_s, r.local_s)
        return pd.DataFrame({key: [rows[key].iloc[0]], "size": [sizer.size]})

    return chunks.groupBy(key).applyInPandas(sized, f"`{key}` {kind}, size long")


def uncovered(accounts: DataFrame, key: str, *others: DataFrame) -> DataFrame:
    """Accounts without a row in any of the other tables."""
    for other in others:
        accounts = accounts.join(other.select(key).distinct(), key, "left_anti")
    return accounts


def rate_and_eta(samples: DataFrame, key: str, at: str, height: str, target: str) -> DataFrame:
    """Blocks per second from each key's last two samples, and the seconds that remain at this rate."""
    w = Window.partitionBy(key).orderBy(at)
    marked = samples.withColumns({"_dt": F.col(at) - F.lag(at).over(w), "_dh": F.col(height) - F.lag(height).over(w), "_last": F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at)))})
    rate = F.when(F.col("_dt") > 0, F.col("_dh").cast("double") / F.col("_dt").cast("double"))
    last = marked.where("_last = 1").withColumn("rate", rate)
    return last.withColumn("eta", F.when(F.col("rate") > 0, F.greatest(F.col(target) - F.col(height), F.lit(0)).cast("double") / F.col("rate"))).drop("_dt", "_dh", "_last")
