"""Proposals from their events: first rows, merges into stored ones, new keys, and what contracts report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions import scalars

#: How a merge treats each column: what an incoming value must be to replace the stored one.
UNLESS_EMPTY = ("proposer", "description", "title")
UNLESS_NO_ITEMS = ("targets", "values", "signatures", "calldatas")
UNLESS_ZERO = ("vote_start_timestamp", "vote_end_timestamp", "quorum", "decimals")
UNLESS_NULL = ("proposal_snapshot", "proposal_deadline", "proposal_eta", "queue_ready_at", "queue_expires_at", "counting_mode", "timelock_address")
GREATEST = ("vote_start", "vote_end")


def created(events: DataFrame) -> DataFrame:
    """Proposal rows of creations: clock, block interval, estimated times and defaults.

    ``events``: proposal_id, chain_id, proposer, vote_start, vote_end, block_number, block_timestamp_ms, description.
    """
    mode = scalars.clock_mode(F.col("vote_start"), F.col("vote_end"))
    rows = events.withColumns({"clock_mode": mode, "proposer": F.lower("proposer")}).withColumn("block_interval", scalars.block_interval(F.col("chain_id"), F.col("clock_mode")))
    return rows.withColumns(
        {f"{b}_timestamp": scalars.timepoint_millis(F.col(b), F.col("clock_mode"), F.col("block_number"), F.col("block_timestamp_ms"), F.col("block_interval")) for b in GREATEST}
        | {"proposal_snapshot": F.col("vote_start"), "proposal_deadline": F.col("vote_end"), "current_state": F.lit("Pending"), "proposal_eta": F.lit("0"), "quorum": F.lit("0"), "decimals": F.lit("0")}
    )


def with_stubs(proposals: DataFrame, lifecycle: DataFrame, key: str) -> DataFrame:
    """Proposals, and a stub (all else null) for each key that only lifecycle events know; ``stub`` tells them apart."""
    known = proposals.withColumn("stub", F.lit(False))
    return known.join(lifecycle.select(key).distinct(), key, "full").withColumn("stub", F.coalesce("stub", F.lit(True)))


def upserted(stored: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """Stored rows after a merge of incoming ones, one for each key; either has any of the columns above.

    Rows without a partner stay as they are. An empty, zero or null value keeps the stored one, by column; bounds of the vote only
    grow; a row without a proposer is one of a later event, whose assumed block clock doesn't replace a known one.
    """
    columns = [c for c in stored.columns if c != key]
    both = stored.select(key, F.lit(True).alias("_old"), *(F.col(c).alias(f"_o_{c}") for c in columns)).join(incoming.select(key, F.lit(True).alias("_new"), *(F.col(c).alias(f"_n_{c}") for c in columns)), key, "full")
    old, new = (lambda c: F.col(f"_o_{c}")), (lambda c: F.col(f"_n_{c}"))

    def merged(c: str) -> Column:
        if c in UNLESS_EMPTY:
            return F.when(new(c) == "", old(c)).otherwise(new(c))
        if c in UNLESS_NO_ITEMS:
            return F.when(F.size(new(c)) == 0, old(c)).otherwise(new(c))
        if c in UNLESS_ZERO:
            return F.when(new(c).cast("string").rlike("^0+$"), old(c)).otherwise(new(c))
        if c in UNLESS_NULL:
            return F.coalesce(new(c), old(c))
        if c in GREATEST:
            return F.greatest(old(c), new(c))
        late = (new("proposer") == "") & (new("clock_mode") == "blocknumber") & (old("clock_mode") != "blocknumber")
        if c == "clock_mode":
            return F.when(late, old(c)).otherwise(new(c))
        if c == "block_interval":
            return F.when(late, F.lit(None)).when(new("clock_mode") != "blocknumber", new(c)).otherwise(F.coalesce(new(c), old(c)))
        if c == "description_hash":
            return F.when((new("proposer") == "") & (new("description") == ""), old(c)).otherwise(F.coalesce(new(c), old(c)))
        return old(c)  # what identifies the row

    return both.select(key, *(F.when(F.col("_new").isNull(), old(c)).when(F.col("_old").isNull(), new(c)).otherwise(merged(c)).alias(c) for c in columns))


def relinked(stored: DataFrame, incoming: DataFrame, lookup: list[str], key: str = "id") -> DataFrame:
    """Stored rows under the key that incoming rows give them; ``lookup`` are the columns by which they are known, where nulls are equal."""
    told = incoming.select(*(F.col(c).alias(f"_{c}") for c in lookup), F.col(key).alias("_key")).distinct()
    found = stored.join(told, [stored[c].eqNullSafe(told[f"_{c}"]) for c in lookup], "left")
    return found.select(*(F.coalesce("_key", key).alias(c) if c == key else F.col(c) for c in stored.columns), F.col(key).alias("former_id"))


def relinked_children(children: DataFrame, relinked_rows: DataFrame, ref: str = "proposal_ref", ident: str = "proposal_id", key: str = "id") -> DataFrame:
    """Child rows that follow their proposal to its new key, in their reference and in their copy of the id."""
    moved = relinked_rows.where(F.col(key) != F.col("former_id")).select(F.col("former_id").alias("_from"), F.col(key).alias("_to"))
    found = children.join(moved, F.col(ref) == F.col("_from"), "left")
    return found.select(*(F.coalesce("_to", c).alias(c) if c in (ref, ident) else F.col(c) for c in children.columns))


def planned_reads(requests: DataFrame, reads: DataFrame, keys: list[str]) -> DataFrame:
    """Contract reads that are asked for, each once, with the value that was read last, if any. ``reads``: keys, read_index, value."""
    last = reads.groupBy(*keys).agg(F.max_by("value", "read_index").alias("value"), F.count("*").alias("answers"))
    return requests.select(*keys).distinct().join(last, keys, "left").withColumn("answers", F.coalesce("answers", F.lit(0)).cast("long"))


def enriched(proposals: DataFrame, reads: DataFrame) -> DataFrame:
    """Proposals with what their contracts report. ``reads``: chain_id, contract, method, arg, read_index, value.

    The last answer counts. Of a governor: clockMode and countingMode for all its proposals, state, snapshot, deadline and
    quorum (by id, or else by the snapshot) for one; decimals of a governor's token for all its proposals, where these have the columns ``token`` and
    ``decimals``; the block times replace estimates.
    """
    last = reads.where("value IS NOT NULL").groupBy("chain_id", F.lower("contract").alias("contract"), "method", "arg").agg(F.max_by("value", "read_index").alias("value"))
    of = lambda method, name: last.where(F.col("method") == method).select(F.col("chain_id").alias("_chain"), F.col("contract").alias("_contract"), F.col("arg").alias("_arg"), F.col("value").alias(name))
    rows = proposals
    here = (F.col("chain_id") == F.col("_chain")) & (F.lower("governor") == F.col("_contract"))

    def joined(rows: DataFrame, method: str, name: str, on: Column) -> DataFrame:
        return rows.join(of(method, name), on, "left").drop("_chain", "_contract", "_arg")

    rows = joined(rows, "clockMode", "_clock", here)
    rows = joined(rows, "countingMode", "_counting", here)
    if {"token", "decimals"} <= set(proposals.columns):
        rows = joined(rows, "decimals", "_decimals", (F.col("chain_id") == F.col("_chain")) & (F.lower("token") == F.col("_contract")))
        decimals = {"decimals": F.coalesce("_decimals", "decimals")}
    else:
        decimals = {}
    for method in ("state", "snapshot", "deadline", "quorum"):
        rows = joined(rows, method, f"_{method}", here & (F.col("proposal_id") == F.col("_arg")))
    rows = joined(rows, "quorum", "_quorum_at", here & (F.col("proposal_snapshot") == F.col("_arg")))
    block_time = lambda name, at: last.where("method = 'blockTimestamp'").select(F.col("chain_id").alias("_chain"), F.col("arg").alias("_arg"), F.col("value").cast("long").alias(name))
    for b in GREATEST:
        rows = rows.join(block_time(f"_{b}", b), (F.col("chain_id") == F.col("_chain")) & (F.col(b).cast("string") == F.col("_arg")), "left").drop("_chain", "_arg")
    mode = F.coalesce("_clock", "clock_mode")
    rows = rows.withColumn("_mode", mode).withColumn("_interval", F.when(F.col("_clock").isNotNull(), scalars.block_interval(F.col("chain_id"), F.col("_mode"))).otherwise(F.col("block_interval")))
    times = {b: F.coalesce(f"_{b}", F.when(F.col("_clock").isNotNull(), scalars.timepoint_millis(F.col(b), F.col("_mode"), F.col("block_number"), F.col("block_timestamp_ms"), F.col("_interval"))).otherwise(F.col(f"{b}_timestamp"))) for b in GREATEST}
    new = {
        "clock_mode": F.col("_mode"), "block_interval": F.col("_interval"), "counting_mode": F.coalesce("_counting", "counting_mode"), "current_state": F.coalesce(scalars.proposal_state(F.col("_state")), "current_state"),
        "proposal_snapshot": F.coalesce("_snapshot", "proposal_snapshot"), "proposal_deadline": F.coalesce("_deadline", "proposal_deadline"), "quorum": F.coalesce("_quorum", "_quorum_at", "quorum"),
    } | {f"{b}_timestamp": c for b, c in times.items()} | decimals
    return rows.select(*(new[c].alias(c) if c in new else F.col(c) for c in proposals.columns))


def bounds_to_fill(proposals: DataFrame, block_times: DataFrame, height: Column) -> DataFrame:
    """Proposals with start_time and end_time, the times of the blocks at their bounds, if they are asked for and known.

    Asked are proposals of the clock ``blocknumber`` with a bound at or below ``height`` that isn't resolved. ``block_times``: chain_id, block, time_ms,
    one row for each block; ``proposals``: id, chain_id, clock_mode, and of vote_start and vote_end the bound, its _timestamp and whether it is _resolved.
    """
    rows, due = proposals, F.lit(False)
    for b, name in zip(GREATEST, ("start_time", "end_time"), strict=True):
        times = block_times.select(F.col("chain_id").alias("_chain"), F.col("block").alias("_block"), F.col("time_ms").alias(name))
        rows = rows.join(times, (F.col("chain_id") == F.col("_chain")) & (F.col(b) == F.col("_block")), "left").drop("_chain", "_block")
        due = due | ((F.col(b) <= height) & ~F.col(f"{b}_resolved"))
    due = (F.col("clock_mode") == "blocknumber") & due
    return rows.withColumns({name: F.when(due, F.col(name)) for name in ("start_time", "end_time")})


def backfilled_times(proposals: DataFrame, block_times: DataFrame, height: Column) -> DataFrame:
    """Proposals with those times in place of their estimates, as resolved, and ``changed``."""
    new, changed = {}, F.lit(False)
    for b, name in zip(GREATEST, ("start_time", "end_time"), strict=True):
        known = F.col(name).isNotNull()
        new |= {f"{b}_timestamp": F.coalesce(name, f"{b}_timestamp"), f"{b}_resolved": F.col(f"{b}_resolved") | known}
        changed = changed | (known & (~F.col(f"{b}_resolved") | ~F.col(name).eqNullSafe(F.col(f"{b}_timestamp"))))
    rows = bounds_to_fill(proposals, block_times, height)
    return rows.select(*(new[c].alias(c) if c in new else F.col(c) for c in proposals.columns), changed.alias("changed"))


def backfilled_epochs(epochs: DataFrame, times: DataFrame) -> DataFrame:
    """State epochs with the times of their proposal's bounds where they begin or end at one. ``epochs``: proposal_id, start_timepoint, end_timepoint
    and their _timestamp; ``times``: id, vote_start, vote_end, and start_time and end_time, which are null if they aren't told."""
    told = times.select(F.col("id").alias("_id"), F.col("vote_start").alias("_start"), F.col("vote_end").alias("_end"), F.col("start_time").alias("_start_time"), F.col("end_time").alias("_end_time"))
    rows = epochs.join(told, F.col("proposal_id") == F.col("_id"), "left")

    def moved(point: str) -> Column:
        at = F.col(f"{point}_timepoint")
        return F.when(F.col("_start_time").isNotNull() & (at == F.col("_start")), F.col("_start_time")).when(F.col("_end_time").isNotNull() & (at == F.col("_end")), F.col("_end_time")).otherwise(F.col(f"{point}_timestamp"))

    return rows.select(*(moved(c.removesuffix("_timestamp")).alias(c) if c.endswith("_timestamp") else F.col(c) for c in epochs.columns))
