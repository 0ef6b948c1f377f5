"""Positions and the intervals that hold them, joined by equal keys only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = 63


def _shifted(value: Column, k: Column) -> Column:
    return F.call_function("shiftright", value, k)


def dyadic_pieces(first: Column, last: Column) -> Column:
    """An interval of whole numbers, both ends included, as aligned pieces: an array of (level, place), each the 2^level numbers
    from place * 2^level on. No two overlap, and of each level there are two at most. An empty or unbounded interval has none."""

    def of_level(k: Column) -> Column:
        # what is left for this level and those above is [low, high) in units of the level
        low, high = -_shifted(-first, k), _shifted(last + 1, k)
        piece = lambda at: F.struct(k.cast("int").alias("level"), at.alias("place"))
        odd = lambda x: x % 2 != 0
        none = F.array().cast("array<struct<level:int,place:bigint>>")
        left, right = F.when(odd(low), F.array(piece(low))).otherwise(none), F.when(odd(high), F.array(piece(high - 1))).otherwise(none)
        return F.when(low < high, F.concat(left, right)).otherwise(none)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), of_level))


def interval_join(points: DataFrame, at: str, intervals: DataFrame, first: str = "first", last: str = "last") -> DataFrame:
    """Each row of ``points`` with each interval that holds its position, both ends included.

    An interval of n numbers becomes 2 log n aligned pieces at most, and a position asks for its ancestor at each level of which some interval has a piece (at
    most 63 numbers, in one row); exactly one of them is a piece of an interval that holds it. Lengths and overlaps of intervals don't matter, and nothing but
    equal keys is joined: the cost is rows times levels, not rows times intervals. Rows with a null position or bound, and intervals that end
    before they begin, meet nothing. Columns of both sides have different names.
    """
    low, high = F.col(first).cast("long"), F.col(last).cast("long")
    pieces = intervals.where(low <= high).withColumn("_piece", F.explode(dyadic_pieces(low, high)))
    levels = pieces.agg(F.collect_set("_piece.level").alias("_levels"))
    asked = points.where(F.col(at).isNotNull()).crossJoin(F.broadcast(levels))  # one row
    asked = asked.withColumn("_piece", F.explode(F.transform("_levels", lambda k: F.struct(k.alias("level"), _shifted(F.col(at).cast("long"), k).alias("place")))))
    return asked.drop("_levels").join(pieces, "_piece").drop("_piece")
