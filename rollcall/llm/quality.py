"""Host-level quality rules.

Every document is measured on its own; rule failures are then added up by host, each host's failure
rates are shrunk towards an empirical beta prior fitted over all hosts, and the verdicts of the hosts
are joined back to their documents.

Nulls and edges: a null text has no words; a null host is the host with the empty name; a null id is
kept as it is; repeated rows are judged row by row and each counts for its host; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.frames import checkpointed, emitted, few, rows_of, utf8

SYMBOLS = b"#*$%&|<>"
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: Soft rules: a document that breaks one of them only goes if its host is known for that failure.
RULES = ("symbols", "dup_lines", "word_length")
#: A host has a bad name for a rule if its shrunk failure rate is at least this.
HOST_RATE = 0.5
#: Parts into which the documents of each host are dealt to meet their host's verdict.
SALTS = 32


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows of ``window`` words that occur twice or more, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    keys, width = ids, len(seen)
    key, size = keys[:n], width
    for i in range(1, window):
        if size * width >= 1 << 62:
            values, key = np.unique(key, return_inverse=True)
            size = len(values)
        key, size = key * width + keys[i : i + n], size * width
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(key, twice))
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int(np.count_nonzero(np.cumsum(edges)[:-1]))


def measures(text: bytes) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (with a word) of one text."""
    words = text.split()
    marks = len(text) - len(text.translate(None, SYMBOLS))
    tails = len(text) - len(text.translate(None, bytes(range(0x80, 0xC0))))
    chars = len(text.translate(None, SPACES)) - tails
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), chars, marks, len(lines) - len(set(lines)), repeated_words(words), len(lines)


def document_measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per row of ``docs``: id, host and the measures of the whole text; no shuffle."""
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(host_col), F.lit("")).alias("host"), utf8(text_col).alias("body"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
    kind = docs.schema[id_col].dataType.simpleString()
    fields = [("doc_id", pa.int32() if kind == "int" else pa.string() if kind == "string" else pa.int64()), ("host", pa.string())]
    schema = pa.schema(fields + [(n, pa.int64()) for n in names])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return emitted(((i, h, *measures(body)) for i, h, body in rows_of(batches, "doc_id", "host", "body")), schema)

    return chosen.mapInArrow(measured, f"doc_id {kind}, host string, " + ", ".join(f"{n} long" for n in names))


def judged(measured: DataFrame) -> DataFrame:
    """Adds base_failed and one boolean fail_<rule> for each soft rule."""
    n = F.col("n_words")
    return measured.withColumns(
        {
            "base_failed": (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n),
            "fail_symbols": 5 * F.col("n_symbols") > n,
            "fail_dup_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
            "fail_word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n),
        }
    )


def host_rates(judged_docs: DataFrame, rules: tuple[str, ...] = RULES) -> DataFrame:
    """Per host: n_docs and, for every rule, the failure rate shrunk by a beta prior.

    The prior's mean is the failure rate of all documents; its strength follows by moments from how
    much more the hosts' rates vary than documents drawn with that rate would make them vary.
    """
    counts = checkpointed(few(judged_docs.groupBy("host").agg(F.count("*").alias("n_docs"), *(F.count_if(f"fail_{r}").alias(f"failed_{r}") for r in rules))))
    n = F.col("n_docs")
    overall = counts.agg(F.coalesce(F.avg(1 / n), F.lit(1.0)).alias("inverse_n"), *(F.coalesce(F.sum(f"failed_{r}") / F.sum(n), F.lit(0.0)).alias(r) for r in rules)).first()
    apart = counts.agg(*(F.coalesce(F.avg(F.pow(F.col(f"failed_{r}") / n - overall[r], F.lit(2))), F.lit(0.0)).alias(r) for r in rules)).first()
    rates = {}
    for r in rules:
        unit = overall[r] * (1 - overall[r])
        strength = max(unit / max(apart[r] - unit * overall["inverse_n"], 1e-6) - 1, 1.0)
        rates[f"rate_{r}"] = (F.col(f"failed_{r}") + overall[r] * strength) / (n + strength)
    return counts.select("host", "n_docs", *(c.alias(k) for k, c in rates.items()))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", host_rate: float = HOST_RATE) -> DataFrame:
    """One row per document: its measures, base_failed, and kept.

    A document goes if it fails the base rules, if it breaks two soft rules, or if it breaks one for
    which its host has a shrunk failure rate of ``host_rate`` or more. A document that breaks no rule
    stays, whatever its host is like.
    """
    rows = checkpointed(judged(document_measures(docs, id_col, text_col, host_col)))
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))  # a host may have a third of all documents
    dealt = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    joined = dealt.join(host_rates(rows).withColumn("salt", salt), ["host", "salt"], "left")
    broken = sum((F.col(f"fail_{r}").cast("int") for r in RULES), F.lit(0))
    shared = F.lit(False)
    for r in RULES:
        shared = shared | (F.col(f"fail_{r}") & (F.col(f"rate_{r}") >= host_rate))
    return joined.select(
        F.col("doc_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (broken < 2) & ~shared).alias("kept"), broken.alias("n_soft_failures"), *(f"rate_{r}" for r in RULES),
    )


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The rules over all of ``documents``."""
    from rollcall.llm.frames import table

    return quality_rules(table(spark, sf_dir, "documents")).drop(*(f"rate_{r}" for r in RULES))
