"""Filters, orders and pages of the served entities."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMERIC = re.compile(r"0|[1-9][0-9]{0,77}")
PAGE = 20
_TESTS = {
    "eq": lambda c, v: c == v,
    "not_eq": lambda c, v: c != v,
    "in": lambda c, v: c.isin(list(v)),
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "ilike": lambda c, v: c.ilike(f"%{v}%"),
    "ieq": lambda c, v: F.lower(c) == v.lower(),
}


def checked_numeric(value: str) -> str:
    """A canonical number of at most 78 digits, or an error before any plan is made."""
    if not NUMERIC.fullmatch(value):
        raise ValueError(f"not a canonical number: {value!r}")
    return value


def condition(where: dict, columns: dict[str, str] | None = None, numeric: frozenset[str] = frozenset()) -> Column:
    """The column of a filter: entries <field>_<test> all hold, and one member of OR does, if there are any.

    Null values are ignored; an empty member of OR is true. Fields in ``numeric`` are checked first, in OR too.
    """
    parts = [F.lit(True)]
    for key, value in where.items():
        if key == "OR":
            members = [condition(m, columns, numeric) for m in value or []]
            if members:
                parts.append(reduce(lambda a, b: a | b, members))
        elif value is not None:
            test = next(t for t in sorted(_TESTS, key=len, reverse=True) if key.endswith(f"_{t}"))
            field = key[: -len(test) - 1]
            if field in numeric:
                checked_numeric(str(value))
            parts.append(_TESTS[test](F.col((columns or {}).get(field, field)), value))
    return reduce(lambda a, b: a & b, parts)


def scoped(rows: DataFrame, **scope) -> DataFrame:
    """Rows of a scope; parts that are null don't restrict."""
    return rows.where(condition({f"{k}_eq": v for k, v in scope.items()}))


def exists(rows: DataFrame, other: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Rows with a match, where nulls are equal."""
    return rows.join(other, [rows[a].eqNullSafe(other[b]) for a, b in keys.items()], "left_semi")


def missing(rows: DataFrame, other: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Rows without a match, where nulls are equal."""
    return rows.join(other, [rows[a].eqNullSafe(other[b]) for a, b in keys.items()], "left_anti")


def exists_any(rows: DataFrame, key: str, *others: tuple[DataFrame, dict[str, str]]) -> DataFrame:
    """Rows that match at least one of several tables, by semi joins on equal keys instead of one join on OR."""
    found = reduce(DataFrame.union, (exists(rows, other, keys).select(key) for other, keys in others)).distinct()
    return rows.join(found, key, "left_semi")


def ordered(rows: DataFrame, order: list[str], tie: str = "id") -> DataFrame:
    """By names like ``power_DESC_NULLS_LAST``; ascending puts nulls last unless told otherwise; the tie breaker comes last."""
    by = []
    for name in order:
        found = re.fullmatch(r"(\w+?)_(ASC|DESC)(?:_NULLS_(FIRST|LAST))?", name)
        if not found or found[1] not in rows.columns:
            raise ValueError(f"no such order: {name}")
        way = {"ASC": "asc", "DESC": "desc"}[found[2]]
        nulls = (found[3] or ("LAST" if way == "asc" else "FIRST")).lower()
        by.append(getattr(F.col(found[1]), f"{way}_nulls_{nulls}")())
    return rows.orderBy(*by, F.col(tie).asc_nulls_last())


def page(rows: DataFrame, offset: int | None = None, limit: int | None = PAGE) -> DataFrame:
    """Part of ordered rows; negative numbers count as 0."""
    rows = rows.offset(max(0, offset or 0))
    return rows if limit is None else rows.limit(max(0, limit))
