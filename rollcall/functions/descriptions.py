"""Titles, bodies and tags of proposal descriptions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TITLE_CHARS = 50
_HEADING = re.compile(r"^\s*#(?=\s)(.*)$")
_PREFIX = re.compile(r"^\s*(?:#+|[-*+])(?=\s)\s*")
_RULE = re.compile(r"^\s*[-*_]{3,}\s*$")
_QUOTE = re.compile(r"^\s*>\s?")
_LABEL = re.compile(r"^\s*\[([^\]]*)\]\s*(.*)$", re.S)
_LINK = re.compile(r"!?\[([^\]]*)\]\([^)]*\)")
_TAG = re.compile(r"<[^>]*(?:>|\Z)")


def heading(description: str) -> str | None:
    """The first first-level heading that isn't empty."""
    for line in description.splitlines():
        found = _HEADING.match(line)
        if found and found[1].strip():
            return found[1].strip()
    return None


def cleaned_line(line: str) -> str:
    """A line without markers of headings, lists, rules and quotes; a bracketed prefix becomes a label."""
    line = _PREFIX.sub("", line, count=1)
    if _RULE.match(line):
        line = ""
    line = _QUOTE.sub("", line, count=1)
    label = _LABEL.match(line)
    if label and label[1].strip() and label[2].strip():
        return f"{label[1].strip()}: {label[2]}"
    return line


def title_of(description: str) -> str:
    """The heading, or else the first cleaned line, cut to 50 characters."""
    found = heading(description)
    if found is not None:
        return found
    plain = _LINK.sub(r"\1", _TAG.sub("", description))
    first = next(iter("\n".join(map(cleaned_line, plain.splitlines())).strip().splitlines()), "").strip()
    return first[:TITLE_CHARS] + "..." if len(first) > TITLE_CHARS else first


def body_of(description: str) -> str:
    """The description without its first line, if that gives the title."""
    text = description.strip()
    first, newline, rest = text.partition("\n")
    return rest.strip() if newline and title_of(first.strip()) == title_of(text) else text


#: Texts that a task has as Python strings at once; only memory depends on it.
AT_ONCE = 256


def mapped(text_of: Callable[[str], str], values: pa.Array) -> pa.Array:
    """What becomes of each text, nulls apart. Batches of whole texts may be large: few of them are Python strings at once, the others stay Arrow's."""

    def parts() -> Iterator[pa.Array]:
        for at in range(0, len(values), AT_ONCE):
            yield pa.array([None if x is None else text_of(x) for x in values.slice(at, AT_ONCE).to_pylist()], pa.string())

    return pa.concat_arrays([pa.array([], pa.string()), *parts()])


@F.arrow_udf(T.StringType())
def title(values: pa.Array) -> pa.Array:
    return mapped(lambda x: title_of(x.strip()), values)


@F.arrow_udf(T.StringType())
def body(values: pa.Array) -> pa.Array:
    return mapped(body_of, values)


@F.arrow_udf(T.StringType())
def plain_text(values: pa.Array) -> pa.Array:
    """Without tags, link targets and line markers."""
    return mapped(lambda x: "\n".join(map(cleaned_line, _LINK.sub(r"\1", _TAG.sub("", x)).splitlines())), values)


#: The characters that Unicode calls white space.
WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def taken_out(description: Column, name: str) -> tuple[Column, Column]:
    """(what is left, content) of the first <name>...</name>, both trimmed; the description as it is and null if there is none."""
    opening, closing = f"<{name}>", f"</{name}>"
    start = F.position(F.lit(opening), description)
    begin = start + len(opening)
    end = F.when(start > 0, F.position(F.lit(closing), description, begin)).otherwise(0)
    content = F.when(end > 0, trimmed(F.substring(description, begin, end - begin)))
    left = trimmed(F.concat(F.substring(description, F.lit(1), start - 1), F.substring(description, end + len(closing), F.char_length(description))))
    return F.when(end > 0, left).otherwise(description), content


def with_tags(rows: DataFrame, description: str) -> DataFrame:
    """Adds body (without the first discussion and signature tag, trimmed), discussion (null if there is none) and signature (the JSON array in its
    tag; empty if there is none or it isn't one)."""
    left, discussion = taken_out(F.col(description), "discussion")
    rows = rows.withColumns({"discussion": discussion, "_left": left})
    left, signature = taken_out(F.col("_left"), "signature")
    signature = F.coalesce(F.from_json(signature, "array<string>"), F.array().cast("array<string>"))
    return rows.withColumns({"body": trimmed(left), "signature": signature}).drop("_left")


def tag(description: Column, name: str) -> Column:
    """What stands in <name>...</name>, trimmed; null if there is no such tag."""
    return taken_out(description, name)[1]


def signatures(description: Column) -> Column:
    """The signature tag's JSON array; empty if there is none or it isn't one."""
    return F.coalesce(F.from_json(tag(description, "signature"), "array<string>"), F.array().cast("array<string>"))
