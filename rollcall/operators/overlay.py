"""Durable rows under provisional ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.operators.filters import missing

LIVE = "live-onchain"


def available(overlay: DataFrame) -> DataFrame:
    return overlay.where(F.col("status") == "available")


def with_overlay_rows(durable: DataFrame, overlay: DataFrame, keys: list[str]) -> DataFrame:
    """Durable rows and those overlay rows that have no durable twin."""
    return durable.unionByName(missing(overlay, durable, {k: k for k in keys}).select(*durable.columns))


def patched(durable: DataFrame, overlay: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Durable rows with an overlay's values where it has them; null keys are equal."""
    o = overlay.select(*(F.col(k).alias(f"_{k}") for k in keys), *(F.col(c).alias(f"_o_{c}") for c in columns))
    joined = durable.join(o, [durable[k].eqNullSafe(o[f"_{k}"]) for k in keys], "left")
    return joined.select(*(F.coalesce(f"_o_{c}", c).alias(c) if c in columns else F.col(c) for c in durable.columns))


def resolved(durable: DataFrame, overlay: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Live rows patch the durable ones, all other overlay rows are added where there is no durable twin."""
    usable = available(overlay)
    live = usable.where(F.col("source") == LIVE)
    rest = usable.where(~F.col("source").eqNullSafe(F.lit(LIVE)))
    return with_overlay_rows(patched(durable, live, keys, columns), rest, keys)


def power_overlay(durable: DataFrame, overlay: DataFrame, keys: list[str], power: str = "power") -> DataFrame:
    """A live power wins over the durable one; rows that only the overlay has are added."""
    usable = available(overlay)
    return with_overlay_rows(patched(durable, usable, keys, [power]), usable, keys)


def mapping_overlay(durable: DataFrame, overlay: DataFrame, delegator: str = "from") -> DataFrame:
    """Any available overlay of a delegator hides its durable mapping; overlays that are current take its place."""
    usable = available(overlay)
    return missing(durable, usable, {delegator: delegator}).unionByName(usable.where("is_current").select(*durable.columns))


def finalized(overlay: DataFrame, height: int, anchor: str = "block_number") -> DataFrame:
    """The overlay once the durable rows have reached ``height``."""
    done = (F.col("status") == "available") & (F.col(anchor) <= height)
    return overlay.withColumn("status", F.when(done, "finalized").otherwise(F.col("status")))


def final_segments(segments: DataFrame, heights: DataFrame, scope: list[str], source: str | None = None) -> DataFrame:
    """The segments that the durable rows of their scope have overtaken: available ones whose range and anchor lie at or below its height.

    ``segments``: id, scope, source, status, range_start, range_end, anchor (may be null: the range's end); ``heights``: scope, height. Null scopes are equal.
    A range that begins below 0 or ends before it begins is never final.
    """
    known = heights.select(*(F.col(c).alias(f"_{c}") for c in scope), F.col("height").alias("_height"))
    rows = segments.where(F.col("status") == "available") if source is None else segments.where((F.col("status") == "available") & (F.col("source") == source))
    found = rows.join(known, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in scope])
    whole = (F.col("range_start") >= 0) & (F.col("range_end") >= F.col("range_start")) & (F.col("_height") >= 0)
    return found.where(whole & (F.greatest("range_end", F.coalesce("anchor", "range_end")) <= F.col("_height"))).select(*segments.columns)


def marked_final(rows: DataFrame, final: DataFrame, scope: list[str], segment: str = "segment_id") -> DataFrame:
    """Segments (by their ``id``) or overlays (by the segment that they come from), those of final segments marked as final if they are available."""
    done = final.select(*(F.col(c).alias(f"_{c}") for c in scope), F.col("id").alias("_segment")).distinct().withColumn("_final", F.lit(True))
    joined = rows.join(done, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in scope] + [F.col(segment) == F.col("_segment")], "left")
    status = F.when(F.col("_final") & (F.col("status") == "available"), "finalized").otherwise(F.col("status"))
    return joined.select(*(status.alias(c) if c == "status" else F.col(c) for c in rows.columns))


def rolled_back(overlay: DataFrame, scope: Column, reason: str) -> DataFrame:
    """Available rows of a scope become invalid, with a reason."""
    hit = (F.col("status") == "available") & scope
    return overlay.withColumns({"status": F.when(hit, "invalid").otherwise(F.col("status")), "reason": F.when(hit, F.lit(reason)).otherwise(F.col("reason"))})


def delegated_power(edges: DataFrame, balances: DataFrame) -> DataFrame:
    """What delegates get from refreshed balances: the sum over their delegators. ``edges``: delegate, delegator; ``balances``: account, balance."""
    known = balances.select(F.col("account").alias("delegator"), "balance")
    return edges.join(known, "delegator").groupBy("delegate").agg(F.sum("balance").alias("power_of_delegators"))
