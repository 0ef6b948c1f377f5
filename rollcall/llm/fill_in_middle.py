"""Fill-in-the-middle transformation with counted quantifiers, in built-in expressions.

A text is n units; two hashed cuts a <= b divide it. A pattern of each row's own, in which possessive groups take exactly a and
b - a units, captures prefix, middle and suffix in one match, and the replacement writes them in their new order. Nothing
backtracks: units are possessive too, and Java counts possessive groups in a loop, so that long texts need no deep stack.

Nulls and edges: a null text is empty; a null id is hashed as an empty one; empty texts and texts that hold a marker stay plain;
rows that repeat an id get the same hashes; other columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm.frames import table


@dataclass(frozen=True)
class Markers:
    """The strings before prefix, suffix and middle. None may begin as another ends, so that they are found again."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        every = (self.prefix, self.suffix, self.middle)
        held = any(a != b and a in b for a in every for b in every)
        if not all(every) or len(set(every)) < 3 or held or any(a[:k] == b[-k:] for a in every for b in every for k in range(1, min(len(a), len(b)))):
            raise ValueError("markers must differ, and none may hold another or begin as one ends")


MARKERS = Markers()
#: Words of letters, or single other characters.
UNIT, POSSESSIVE_UNIT = "[A-Za-z]+|[^A-Za-z]", "[A-Za-z]++|[^A-Za-z]"


def hashes(ident: Column, seed: str, n: int) -> list[Column]:
    """The first n groups of 8 hex digits of SHA-256 of the seed, a colon and the id, as unsigned integers."""
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hexed, 8 * k + 1, 8), 16, 10).cast("long") for k in range(n)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", percent: int = 90, spm_percent: int = 20, markers: Markers = MARKERS) -> DataFrame:
    """Per row: doc_id, text, n (units), form (plain, psm or spm), output, prefix_chars and middle_chars (null if plain).

    ``percent`` of the texts are transformed, ``spm_percent`` of those with the suffix first.
    """
    p, s, m = markers.prefix, markers.suffix, markers.middle
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), *(h.alias(f"h{k}") for k, h in enumerate(hashes(F.col(id_col), seed, 4), 1)))
    rows = rows.withColumn("n", F.regexp_count("text", F.lit(UNIT)).cast("long"))
    holds = F.col("text").contains(p) | F.col("text").contains(s) | F.col("text").contains(m)
    plain = (F.col("text") == "") | holds | (F.col("h3") % 100 >= percent)
    rows = rows.withColumn("form", F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm"))
    cuts = [F.col(h) % (F.col("n") + 1) for h in ("h1", "h2")]
    rows = rows.withColumns({"a": F.least(*cuts), "b": F.greatest(*cuts)})
    pattern = F.format_string(rf"(?s)\A((?:{POSSESSIVE_UNIT}){{%d}}+)((?:{POSSESSIVE_UNIT}){{%d}}+)(.*)", "a", F.col("b") - F.col("a"))
    quoted = {x: x.replace("\\", "\\\\").replace("$", "\\$") for x in (p, s, m)}
    order = F.when(F.col("form") == "psm", f"{quoted[p]}$1{quoted[s]}$3{quoted[m]}$2").otherwise(f"{quoted[s]}$3{quoted[p]}$1{quoted[m]}$2")
    rows = rows.withColumn("output", F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace("text", pattern, order)))
    at_middle = F.locate(m, F.col("output"))
    prefix_end = F.when(F.col("form") == "psm", F.locate(s, F.col("output"))).otherwise(at_middle)
    prefix_begin = F.when(F.col("form") == "psm", F.lit(1 + len(p))).otherwise(F.locate(p, F.col("output")) + len(p))
    moved = F.col("form") != "plain"
    chars = {"prefix_chars": F.when(moved, prefix_end - prefix_begin).cast("long"), "middle_chars": F.when(moved, F.char_length("output") - at_middle - len(m) + 1).cast("long")}
    return rows.withColumns(chars).select("doc_id", "text", "n", "form", "output", "prefix_chars", "middle_chars")


def restored(output: Column, form: Column, markers: Markers = MARKERS) -> Column:
    """The text from which an output was made."""
    p, s, m = (re.sub(r"([^A-Za-z0-9])", r"\\\1", x) for x in (markers.prefix, markers.suffix, markers.middle))
    pattern = F.when(form == "psm", rf"(?s)\A{p}(.*?){s}(.*?){m}(.*)").otherwise(rf"(?s)\A{s}(.*?){p}(.*?){m}(.*)")
    return F.when(form == "plain", output).otherwise(F.regexp_replace(output, pattern, F.when(form == "psm", "$1$3$2").otherwise("$2$3$1")))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``; outputs and what is restored from them as SHA-256."""
    found = fill_in_middle(table(spark, sf_dir, "documents"))
    back = F.sha2(F.encode(restored(F.col("output"), F.col("form")), "UTF-8"), 256)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.encode("output", "UTF-8"), 256).alias("output_sha256"), back.alias("restored_sha256"))


SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents
), h AS (
  SELECT doc_id, t, u, len(u) AS n, CAST('0x' || s[1:8] AS BIGINT) AS h1, CAST('0x' || s[9:16] AS BIGINT) AS h2, CAST('0x' || s[17:24] AS BIGINT) AS h3, CAST('0x' || s[25:32] AS BIGINT) AS h4 FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h
), x AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS e FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || e || '<M>' || m ELSE '<S>' || e || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM x
"""
