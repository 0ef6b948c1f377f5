"""Runs of repeated words, found by a dictionary of basic factors.

Words of a text are numbered. For each power of two the factors of that many words are named by the pairs of names of their
halves; places whose factor occurs once only drop out, as longer factors there occur once too. The next occurrence of the same factor, within
twice its length, proposes a period; neighbouring places with the same distance are a progression of occurrences. What a long enough
progression spans is extended to both sides as far as words a period apart are identical; runs that several
lengths propose count once.

A run whose smallest period q lies between half a factor's length and that length repeats each of its factors q words later and not sooner, so that
its progression is whole: no run of an exponent of 3 or more is missed. A distance is the smallest period of what it spans, or the next
occurrence would come sooner.

Texts are taken together in blocks of words; names tell texts apart, so that nothing crosses them. There is no shuffle.

Nulls and edges: a null or empty text has no words and no runs; a null id is passed through; rows that repeat an id stand for
themselves; other columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm.frames import arrow_type, emitted, rows_of, table, utf8

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
#: Words that are handled together at least, if there are so many; only speed depends on it.
BLOCK = 400_000


class _Numbers(dict):
    """Words by number, in the order in which they are seen."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def named(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names from 0 for the distinct pairs of two arrays of names, and how often each occurs."""
    first, second = keys
    span = int(second.max(initial=0)) + 1
    _, names, counts = np.unique(first * span + second, return_inverse=True, return_counts=True)
    return names, counts


def progressions(places: np.ndarray, names: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of places in ascending order and the names of their factors: (first place, how many neighbours, distance) where the next
    occurrence comes after the same distance, more than half the size and at most twice the size."""
    order = np.argsort(names, kind="stable")
    gaps = np.zeros(len(places), np.int64)
    same = names[order[1:]] == names[order[:-1]]
    gaps[order[:-1][same]] = (places[order[1:]] - places[order[:-1]])[same]
    near = np.flatnonzero((2 * gaps > size) & (gaps <= 2 * size))
    if not len(near):
        return near, near, near
    at, gap = places[near], gaps[near]
    begins = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (gap[1:] != gap[:-1])))
    return at[begins], np.diff(np.append(begins, len(at))), gap[begins]


def reach(words: np.ndarray, at: int, other: int, limit: int, step: int) -> int:
    """How many words agree from ``at`` and ``other`` on, forwards or (step -1) backwards, at most ``limit``."""
    done, block = 0, 64
    while done < limit:
        m = min(block, limit - done)
        a, b = (words[x + done : x + done + m] if step > 0 else words[x - done - m + 1 : x - done + 1][::-1] for x in (at, other))
        same = a == b
        if not same.all():
            return done + int(same.argmin())
        done, block = done + m, 2 * block
    return done


def runs(words: np.ndarray, text: np.ndarray, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least so many words and periods (3 periods or more), by start and period.

    ``words``: numbers; ``text``: the number of the text of each word, ascending.
    """
    if least_exponent < 3:
        raise ValueError("runs are found from three periods on")
    n, size, found = len(words), 1, set()
    names, counts = named(text.astype(np.int64), words.astype(np.int64))
    bounds = np.searchsorted(text, np.arange(int(text.max(initial=-1)) + 2))
    whole = np.full(n, -1, np.int64)
    places = np.flatnonzero(counts[names] > 1)
    names = names[places]
    while len(places):
        for start, many, period in zip(*(x.tolist() for x in progressions(places, names, size)), strict=True):
            stop = start + many - 1 + size + period
            if stop - start < least_exponent * period:
                continue
            low, high = bounds[text[start]], bounds[text[start] + 1]
            stop += reach(words, stop, stop - period, high - stop, 1)
            start -= reach(words, start - 1, start - 1 + period, start - low, -1)
            if stop - start >= least_length:
                found.add((start, stop - start, period))
        whole[:] = -1
        whole[places] = names
        ahead = places + size
        both = ahead < n
        both[both] = whole[ahead[both]] >= 0
        places, ahead = places[both], ahead[both]
        names, counts = named(whole[places], whole[ahead])
        again = counts[names] > 1 if len(places) else np.zeros(0, bool)
        places, names = places[again], names[again]
        size *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
Rewrite = Callable[[object, int], "np.ndarray | None"]


def collapsed(words: list[bytes], of_text: list[tuple[int, int, int]]) -> bytes:
    """The words without those that repeat a run's first period."""
    if not of_text:
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in of_text:
        edges[start + period] += 1
        edges[start + length] -= 1
    kept = np.cumsum(edges[:-1]) == 0
    return b" ".join([words[k] for k in np.flatnonzero(kept).tolist()])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT, rewrite: Rewrite | None = None) -> DataFrame:
    """Per row: doc_id, n_words, runs (structs of start, length and period, by start and period), collapsed (the words that are left, one space apart).

    ``rewrite`` may say for (id, n) from which place each of the n words is taken.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("body"))
    schema = pa.schema([("doc_id", arrow_type(rows, "doc_id")), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])

    def block(held: list[tuple[object, list[bytes]]]) -> Iterator[tuple]:
        numbers = _Numbers()
        sizes = np.array([len(w) for _, w in held], np.int64)
        ends = np.cumsum(sizes)
        words = np.fromiter((numbers[w] for _, ws in held for w in ws), np.int64, int(sizes.sum()))
        of_text: list[list[tuple[int, int, int]]] = [[] for _ in held]
        for start, length, period in runs(words, np.repeat(np.arange(len(held)), sizes), least_length, least_exponent):
            k = int(np.searchsorted(ends, start, "right"))
            of_text[k].append((start - int(ends[k] - sizes[k]), length, period))
        for (ident, ws), rs in zip(held, of_text, strict=True):
            yield ident, len(ws), [{"start": s, "length": n, "period": p} for s, n, p in rs], collapsed(ws, rs).decode()

    def found(rows: Iterator[tuple]) -> Iterator[tuple]:
        held, n = [], 0
        for ident, body in rows:
            words = body.split()  # bytes split at ASCII white space
            places = rewrite(ident, len(words)) if rewrite else None
            held.append((ident, words if places is None else [words[k] for k in places.tolist()]))
            n += len(words)
            if n >= BLOCK:
                yield from block(held)
                held, n = [], 0
        yield from block(held)

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(lambda batches: emitted(found(rows_of(batches, "doc_id", "body")), schema, 512), f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(ident: object, n: int) -> np.ndarray | None:
    """The places that a tenth of the texts take their words from: from one place on, a few words again and again."""
    if ident is None or not n:
        return None
    h = zlib.crc32(str(ident).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return places


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``, a tenth of them with planted periods."""
    found = periodic_runs(table(spark, sf_dir, "documents"), rewrite=planted)
    ahead = lambda x, y: x["length"] * y["period"] - y["length"] * x["period"]
    # runs come by start and period, so that the first of the greatest is the one to tell
    best = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.get("runs", F.lit(0)), lambda x, y: F.when(ahead(y, x) > 0, y).otherwise(x))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))), "")
    told = found.withColumn("best", best)
    return told.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
        F.sha2(F.encode(lines, "UTF-8"), 256).alias("runs_sha256"), F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )
