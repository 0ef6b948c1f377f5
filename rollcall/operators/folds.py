"""Folds of event streams into snapshots, as windows and aggregates over the whole log.

The position of an event is (block_number, transaction_index, log_index), here any orderable column ``pos``.
Everything is recomputed from the log, so that replays, late rows and chunk bounds don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from rollcall.functions.u256 import ZERO_ADDRESS, subtracted

POSITION = ("block_number", "transaction_index", "log_index")


def with_position(rows: DataFrame) -> DataFrame:
    return rows.withColumn("pos", F.struct(*POSITION))


def last_value(column: str, pos: str = "pos") -> Column:
    """Aggregate: the last value that isn't null."""
    return F.max_by(column, F.when(F.col(column).isNotNull(), F.col(pos)))


def first_value(column: str, pos: str = "pos") -> Column:
    """Aggregate: the first value that isn't null."""
    return F.min_by(column, F.when(F.col(column).isNotNull(), F.col(pos)))


def merged(events: DataFrame, keys: list[str], overwrite: list[str], keep: list[str], greatest: list[str] = (), total: list[str] = (), pos: str = "pos") -> DataFrame:
    """One snapshot row for each key: columns to overwrite take their last value, columns to keep their first,
    both without nulls; others their greatest value or their sum."""
    return events.groupBy(*keys).agg(
        *(last_value(c, pos).alias(c) for c in overwrite), *(first_value(c, pos).alias(c) for c in keep), *(F.max(c).alias(c) for c in greatest), *(F.sum(c).alias(c) for c in total)
    )


def state_epochs(events: DataFrame, key: str, state: str, pos: str = "pos") -> DataFrame:
    """The timeline of a key's states: each with the position at which the next one begins."""
    return events.withColumn("until", F.lead(pos).over(Window.partitionBy(key).orderBy(pos)))


def deadline_extensions(events: DataFrame, key: str, deadline: str, initial: str, pos: str = "pos") -> DataFrame:
    """Each extension with the deadline before it, which at first is the vote's end."""
    before = F.lag(deadline).over(Window.partitionBy(key).orderBy(pos))
    return events.withColumn("previous_deadline", F.coalesce(before, initial))


def delegation_segments(changes: DataFrame, zero: str = ZERO_ADDRESS) -> DataFrame:
    """(delegator, pos, from_delegate, to_delegate) with ``noop`` and the number of the delegation that is current then.

    A change is a no-op if it names the delegate that is current already on both sides. The current delegate is the
    target of the change before, as a no-op's target is the same.
    """
    w = Window.partitionBy("delegator").orderBy("pos")
    before = F.lag("to_delegate").over(w)
    noop = (F.col("from_delegate") == F.col("to_delegate")) & (F.col("to_delegate") != zero) & before.eqNullSafe(F.col("to_delegate"))
    return changes.withColumn("noop", noop).withColumn("segment", F.sum(F.when(F.col("noop"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def delegation_fold(log: DataFrame, zero: str = ZERO_ADDRESS, saturating: bool = False) -> DataFrame:
    """The delegations of every delegator: delegator, segment, delegate, is_current, power.

    ``log``: (delegator, pos, kind, from_delegate, to_delegate, delta): rows of kind ``change``, and of kind
    ``delta`` with the power (a decimal or integer) that a transfer (null to_delegate) or a matched votes change (its
    delegate in to_delegate) moves. A delta counts if its delegate is the current one. With ``saturating`` the
    power never falls below zero on the way.
    """
    w = Window.partitionBy("delegator").orderBy("pos")
    before = F.last(F.when(F.col("kind") == "change", F.col("to_delegate")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    noop = (F.col("from_delegate") == F.col("to_delegate")) & (F.col("to_delegate") != zero) & before.eqNullSafe(F.col("to_delegate"))
    starts = (F.col("kind") == "change") & ~noop
    marked = log.withColumn("starts", F.coalesce(starts, F.lit(False))).withColumn("segment", F.sum(F.when(F.col("starts"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy("delegator", "segment")
    target = F.max(F.when(F.col("starts"), F.col("to_delegate"))).over(own)
    counted = marked.where("segment > 0").withColumn("delegate", target)
    counts = (F.col("kind") == "delta") & (F.col("to_delegate").isNull() | (F.col("to_delegate") == F.col("delegate")))
    counted = counted.withColumn("moved", F.when(counts, F.col("delta")).otherwise(F.lit(0)))
    if saturating:
        running = F.sum("moved").over(own.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
        counted = counted.withColumn("running", running)
        folded = counted.groupBy("delegator", "segment", "delegate").agg((F.max_by("running", "pos") - F.least(F.lit(0), F.min("running"))).alias("power"))
    else:
        folded = counted.groupBy("delegator", "segment", "delegate").agg(F.sum("moved").alias("power"))
    latest = F.max("segment").over(Window.partitionBy("delegator"))
    return folded.withColumn("is_current", (F.col("segment") == latest) & (F.col("delegate") != zero))


def mappings(folded: DataFrame) -> DataFrame:
    """The current edge of each delegator."""
    return folded.where("is_current").select("delegator", "delegate", "power")


def delegate_counts(edges: DataFrame) -> DataFrame:
    """How many delegators each delegate has, and how many of them with power."""
    return edges.groupBy("delegate").agg(F.count("*").alias("delegates_all"), F.count_if(F.col("power") != 0).alias("delegates_effective"))


def rolling_match(changes: DataFrame, votes: DataFrame, keys: list[str] = ["contract_set_id", "transaction_hash"]) -> DataFrame:  # noqa: B006
    """Assigns each votes change to a delegation change of its transaction: the nearest earlier one whose side isn't used yet.

    ``changes``: keys, log_index, delegator, from_delegate, to_delegate; ``votes``: keys, log_index, delegate, delta
    (decimal text). A loss looks at the from side first, a gain at the to side. A match uses up its side. A group is one transaction.
    """
    both = changes.select(*keys, "log_index", "delegator", "from_delegate", "to_delegate", F.lit(None).cast("string").alias("delegate"), F.lit(None).cast("string").alias("delta")).unionByName(
        votes.select(*keys, "log_index", F.lit(None).cast("string").alias("delegator"), F.lit(None).cast("string").alias("from_delegate"), F.lit(None).cast("string").alias("to_delegate"), "delegate", "delta")
    )

    names = both.columns
    kinds = ", ".join(f"`{k}` {changes.schema[k].dataType.simpleString()}" for k in keys)
    out = f"{kinds}, log_index long, change_log_index long, side string, delegator string, from_delegate string, to_delegate string, delta string"
    schema = pa.schema([*((k, to_arrow_type(changes.schema[k].dataType)) for k in keys), ("log_index", pa.int64()), ("change_log_index", pa.int64()), *((c, pa.string()) for c in ("side", "delegator", "from_delegate", "to_delegate", "delta"))])

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Transactions come one after the other, each in the order of its logs; only the one at hand is kept."""
        last, sides = None, []
        for batch in batches:
            found = []
            for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                key, (at, delegator, source, target, delegate, delta) = row[: len(keys)], row[len(keys) :]
                if key != last:
                    last, sides = key, []
                if delegate is None:
                    if source != target:
                        sides.append([source, target, at, delegator, source, target])
                    continue
                order = (0, 1) if delta.startswith("-") and delta.strip("-0") else (1, 0)
                hit = next(((k, o) for k in order for o in reversed(sides) if o[k] == delegate), None)
                if hit:
                    k, o = hit
                    o[k] = None
                    found.append((*key, at, o[2], ("from", "to")[k], *o[3:], delta))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found) if found else [[]] * len(schema), schema, strict=True)], schema=schema)

    return both.repartition(*keys).sortWithinPartitions(*keys, "log_index").mapInArrow(matched, out)


def power_checkpoints(votes: DataFrame, changes: DataFrame, transfers: DataFrame, tx: list[str]) -> DataFrame:
    """Votes changes with their delta and cause, by what else their transaction holds."""
    has = lambda rows, name: rows.select(*tx).distinct().withColumn(name, F.lit(True))
    joined = votes.join(has(changes, "_changed"), tx, "left").join(has(transfers, "_moved"), tx, "left")
    cause = F.when(F.col("_changed") & F.col("_moved"), "delegate-change+transfer").when(F.col("_changed"), "delegate-change").when(F.col("_moved"), "transfer").otherwise("delegate-votes-changed")
    return joined.withColumn("delta", F.col("new_votes") - F.col("previous_votes")).withColumn("cause", cause).drop("_changed", "_moved")


def value_checkpoints(rows: DataFrame, account: str, pos: str, value: str) -> DataFrame:
    """Refreshed values (unsigned decimal text) with the value before and the signed difference."""
    before = F.coalesce(F.lag(value).over(Window.partitionBy(account).orderBy(pos)), F.lit("0"))
    return rows.withColumn("previous", before).withColumn("delta", subtracted(F.col(value), F.col("previous")))


def first_seen(rows: DataFrame, account: str, pos: str = "pos") -> DataFrame:
    """Each account with the position at which it was first seen."""
    return rows.groupBy(account).agg(F.min(pos).alias("first_seen"))


def spread_timeline(rows: DataFrame, scope: list[str], pos: str, counts: dict[str, Column], width: int = 10_000) -> DataFrame:
    """As :func:`timeline` for counts, where a scope may hold a large share of all rows: totals by ranges of ``width`` positions first.

    A window runs within one range; another adds up the ranges, of which there are as many as positions / width.
    """
    marked = rows.withColumn("_range", F.floor(F.col(pos) / width)).withColumns({k: F.when(c, 1).otherwise(0).cast("long") for k, c in counts.items()})
    by = Window.partitionBy(*scope).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = marked.groupBy(*scope, "_range").agg(*(F.sum(k).alias(f"_{k}") for k in counts)).withColumns({f"_{k}": F.coalesce(F.sum(f"_{k}").over(by), F.lit(0)) for k in counts})
    within = Window.partitionBy(*scope, "_range").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    local = marked.withColumns({k: F.sum(k).over(within) for k in counts})
    return local.join(before, [*scope, "_range"]).select(*rows.columns, *((F.col(k) + F.col(f"_{k}")).alias(k) for k in counts))


def spread_previous(rows: DataFrame, scope: list[str], pos: str, value: str, name: str, width: int = 10_000) -> DataFrame:
    """Each row's value before it in its scope, where a scope may hold a large share of all rows: within ranges of positions, and then from the range before."""
    marked = rows.withColumn("_range", F.floor(F.col(pos) / width))
    last = marked.groupBy(*scope, "_range").agg(F.max_by(value, pos).alias("_last"))
    last = last.withColumn("_before", F.lag("_last").over(Window.partitionBy(*scope).orderBy("_range"))).drop("_last")
    within = Window.partitionBy(*scope, "_range").orderBy(pos)
    local = marked.withColumns({"_first": F.row_number().over(within) == 1, "_own": F.lag(value).over(within)})
    return local.join(last, [*scope, "_range"]).select(*rows.columns, F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_own")).alias(name))


PARAMETERS = {"VotingDelaySet": "voting_delay", "VotingPeriodSet": "voting_period", "ProposalThresholdSet": "proposal_threshold", "QuorumNumeratorUpdated": "quorum_numerator", "LateQuorumVoteExtensionSet": "late_quorum_extension", "TimelockChange": "timelock"}


def parameter_changes(events: DataFrame) -> DataFrame:
    """Typed rows of the six parameter events. ``events``: id, event_name, old_value, new_value, as the events tell them."""
    name = F.lit(None).cast("string")
    for event, parameter in PARAMETERS.items():
        name = F.when(F.col("event_name") == event, parameter).otherwise(name)
    return events.withColumn("parameter", name).where("parameter IS NOT NULL").select("id", "event_name", "parameter", "old_value", "new_value")


def token_rows(events: DataFrame, ident: str = "id") -> dict[str, DataFrame]:
    """The raw rows of a token's three events, and the rolling row that each delegation begins. ``events``: id, event_name and the struct ``event``
    of ``decode.typed_events``."""
    of = lambda name: events.where(F.col("event_name") == name)
    changed = of("DelegateChanged").select(ident, "event.delegator", "event.from_delegate", "event.to_delegate")
    none = F.lit(None).cast("string")
    return {
        "delegate_changed": changed,
        "delegate_votes_changed": of("DelegateVotesChanged").select(ident, "event.delegate", "event.previous_votes", "event.new_votes"),
        "token_transfer": of("Transfer").select(ident, "event.from", "event.to", "event.value", "event.standard"),
        "delegate_rolling": changed.withColumns(dict.fromkeys(("from_previous_votes", "from_new_votes", "to_previous_votes", "to_new_votes"), none)),
    }


def transfer_deltas(transfers: DataFrame, zero: str = ZERO_ADDRESS) -> DataFrame:
    """Two rows of the delegation log for each transfer: the sender's loss and the receiver's gain; one ERC-721 token counts as 1.

    ``transfers``: pos, from, to, value, standard.
    """
    unit = F.when(F.col("standard") == "erc721", F.lit(1).cast(transfers.schema["value"].dataType)).otherwise(F.col("value"))
    side = lambda who, k, delta: F.struct(F.col(who).alias("delegator"), F.struct("pos", F.lit(k).alias("side")).alias("pos"), delta.alias("delta"))
    both = transfers.select(F.explode(F.array(side("from", 0, -unit), side("to", 1, unit))).alias("m")).select("m.*")
    return both.where(F.col("delegator") != zero).select("delegator", "pos", F.lit("delta").alias("kind"), F.lit(None).cast("string").alias("from_delegate"), F.lit(None).cast("string").alias("to_delegate"), "delta")


def vote_signals(votes: DataFrame, voter: str, at: str, tx: str, pos: str) -> DataFrame:
    """Per voter: its greatest vote time, the transaction that wrote last, and how many votes it cast."""
    return votes.groupBy(voter).agg(F.max(at).alias("last_vote"), F.max_by(tx, pos).alias("last_tx"), F.count("*").alias("n"))


def timeline(rows: DataFrame, scope: list[str], pos: str, counts: dict[str, Column], sums: dict[str, Column] | None = None) -> DataFrame:
    """Running counts and sums of a scope at every event."""
    w = Window.partitionBy(*scope).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({k: F.count_if(c).over(w) for k, c in counts.items()} | {k: F.sum(c).over(w) for k, c in (sums or {}).items()})
