"""Scalar rules of the governance model as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds per block of the known chains.
BLOCK_SECONDS = {1: "12", 10: "2", 46: "6", 56: "0.45", 1135: "2", 8453: "2", 42161: "0.25"}
#: Names of the states that contracts report as numbers.
PROPOSAL_STATES = ("Pending", "Active", "Canceled", "Defeated", "Succeeded", "Queued", "Expired", "Executed")
OPERATION_STATES = ("Unset", "Waiting", "Ready", "Done")
#: The timelock's roles.
ROLES = {
    "0x" + "0" * 64: "DEFAULT_ADMIN_ROLE",
    "0xb09aa5aeb3702cfd50b6b62bc4532604938f21248a27a1d5ca736082b6819cc1": "PROPOSER_ROLE",
    "0xd8aa0f3194971a2a116679f7c2090f6939c8d4e01a2a8d7e41d55e5351469e63": "EXECUTOR_ROLE",
    "0x5f58e3a2316349923ce3780f8d587db2d72378aed66a8261c916544fa6846ca5": "TIMELOCK_ADMIN_ROLE",
}


def labelled(value: Column, labels: dict, otherwise: Column | None = None) -> Column:
    """The label of a value, or else null or ``otherwise``."""
    found = F.lit(None).cast("string") if otherwise is None else otherwise
    for k, label in labels.items():
        found = F.when(value == F.lit(k), F.lit(label)).otherwise(found)
    return found


def to_millis(value: Column) -> Column:
    """Seconds as milliseconds; what is 10^12 or more is milliseconds already."""
    return F.when(value < 1_000_000_000_000, value * 1000).otherwise(value)


def seconds_to_millis(value: Column) -> Column:
    """Checked: null if it doesn't fit."""
    return F.try_multiply(value.cast("long"), F.lit(1000).cast("long"))


def clock_mode(start: Column, end: Column) -> Column:
    """timestamp if either bound looks like Unix seconds, else blocknumber."""
    return F.when((start >= 1_000_000_000) | (end >= 1_000_000_000), "timestamp").otherwise("blocknumber")


def block_interval(chain_id: Column, mode: Column) -> Column:
    return F.when(mode == "blocknumber", labelled(chain_id, BLOCK_SECONDS))


def timepoint_millis(timepoint: Column, mode: Column, anchor_block: Column, anchor_millis: Column, interval: Column) -> Column:
    """Milliseconds of a timepoint; of a block, estimated from an anchor block, or the timepoint itself where that fails."""
    estimated = F.round(anchor_millis.cast("double") + (timepoint - anchor_block).cast("double") * (F.try_to_number(interval, F.lit("999.99")).cast("double") * 1000))
    usable = estimated.isNotNull() & (estimated >= 0)
    return F.when(mode == "timestamp", seconds_to_millis(timepoint)).when(usable, estimated.cast("long")).otherwise(timepoint)


def proposal_state(number: Column) -> Column:
    return labelled(number.cast("string"), {str(k): s for k, s in enumerate(PROPOSAL_STATES)}, number.cast("string"))


def operation_state(number: Column) -> Column:
    return labelled(number.cast("string"), {str(k): s for k, s in enumerate(OPERATION_STATES)}, number.cast("string"))


def role_label(role: Column) -> Column:
    return labelled(F.lower(role), ROLES)


def dataset_of(contract_set_id: Column) -> Column:
    """The dataset in a contract set's id (key=value|...)."""
    return F.split_part(F.split_part(contract_set_id, F.lit("dataset="), F.lit(2)), F.lit("|"), F.lit(1))


def contains_ci(text: Column, part: str, escaped: bool = False) -> Column:
    """Case-insensitive containment; unless ``escaped``, % and _ in the part are wildcards, as in the served filter."""
    if escaped:
        return F.contains(F.lower(text), F.lower(F.lit(part)))
    return text.ilike(f"%{part}%")


def display_number(value: Column, decimals: int = 2) -> Column:
    """Abbreviated with K, M, B or T and without trailing zeros."""

    def trimmed(x: Column) -> Column:
        text = F.format_string(f"%.{decimals}f", F.round(x, decimals))
        return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")

    size = F.abs(value)
    return (
        F.when(size >= 1e12, F.concat(trimmed(value / 1e12), F.lit("T")))
        .when(size >= 1e9, F.concat(trimmed(value / 1e9), F.lit("B")))
        .when(size >= 1e6, F.concat(trimmed(value / 1e6), F.lit("M")))
        .when(size >= 1e3, F.concat(trimmed(value / 1e3), F.lit("K")))
        .otherwise(trimmed(value))
    )


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of an ASCII text, folded by character."""
    return F.aggregate(
        F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long")), F.lit(2166136261).cast("long"), lambda h, c: F.when(c == 0, h).otherwise((h.bitwiseXOR(c) * 16777619) % 4294967296)
    )


def sampled(items: DataFrame, order: str, text: Column, first: int, more: int, seed: str = "sample") -> DataFrame:
    """The first items in order and ``more`` of the others, those with the least seeded hash; a sampling operator."""
    head = items.orderBy(order).limit(first)
    rest = items.join(F.broadcast(head.select(order)), order, "left_anti").withColumn("_score", fnv1a(F.concat(F.lit(f"{seed}:"), text)))
    return head.unionByName(rest.orderBy("_score", order).limit(more).drop("_score"))


def cache_outcome(hits: Column, missing: Column) -> Column:
    """How a log query met its cache, by its numbers of hit and missing ranges."""
    return (
        F.when((hits > 0) & (missing == 0), "full_hit").when((hits > 0) & (missing > 0), "partial_hit").when((hits == 0) & (missing > 0), "miss").when((hits == 0) & (missing == 0), "empty").otherwise("unavailable")
    )
