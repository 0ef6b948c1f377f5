"""Exact passage dedup across documents, over words, with difference-cover anchors.

Every word goes that is covered by a window of ``width`` words whose words also stand in a document with a smaller id, judged on the input.

Anchors are windows of ``width`` - 6 words at the places of a document that are 0, 1 or 3 modulo 7. For any two places some shift below 7
brings both to such a place (the residues are a difference cover), so that two equal windows share an anchor at the same
offset inside them, however they are aligned. Documents are dealt into chunks. 1. Each chunk sends the hashes of its anchors, packed by hash
bucket. 2. Each bucket tells the chunks which of them occur in other documents too. 3. Each chunk extends those to both sides: the windows
around them, equal ones once with their smallest document, go as 128-bit hashes to buckets of their own. 4. Each bucket answers with a bit for each:
whether a smaller document has it. 5. Each chunk cuts its documents. The texts are shuffled once, by chunk; only hashes and bits travel otherwise.

A chunk sends a hash once, however many of its documents hold it, so that a passage that stands in a third of all documents is a row's share
in each chunk and never a group. Chunks and buckets grow with the root of the corpus, so that what a chunk has for a bucket stays worth a row:
4 MB up to some 25 GB, 256 MB at 100 TB (a worker then holds about 4 GB).

Nulls and edges: a null text has no words; a document with a null id neither loses words nor makes others lose any; rows that repeat an id
never cut each other; documents of fewer words than a window stay; other columns are left out unless carried; an empty table gives an empty
result. Ids are integers; others are an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm.frames import integer_ids, table

WIDTH = 13
PERIOD, COVER = 7, (0, 1, 3)
#: Bytes of a chunk and of a bucket's share at least, what a chunk has for a bucket on the average at least, and the least number of either.
LEAST_BYTES, SHARE_BYTES, LEAST_PARTS = 4 << 20, 640, 64
#: Words whose hashes a Python worker remembers at most; only speed depends on it.
REMEMBERED = 500_000
_STEPS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_BLANK = r"[\x20\x09-\x0D]+"


class _Hashes(dict):
    """128-bit hashes by word."""

    def __missing__(self, word: bytes) -> bytes:
        self[word] = h = xxhash.xxh3_128_digest(word)
        return h


_HASHES = _Hashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Two 64-bit hashes of each word."""
    if len(_HASHES) > REMEMBERED:
        _HASHES.clear()
    return np.frombuffer(b"".join(map(_HASHES.__getitem__, words)), np.uint64).reshape(-1, 2)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(_STEPS[1])
    return h ^ (h >> np.uint64(32))


def rolled(h: np.ndarray, width: int, step: int) -> np.ndarray:
    """A hash of each ``width`` neighbouring values, put together from those of powers of two."""
    power, size, whole, length = h, 1, None, 0
    rest = width
    while rest:
        if rest & 1:
            if whole is None:
                whole = power
            else:
                n = max(0, len(h) - length - size + 1)
                whole = whole[:n] * np.uint64(pow(step, size, 1 << 64)) + power[length : length + n]
            length += size
        rest >>= 1
        if rest:
            n = max(0, len(power) - size)
            power = power[:n] * np.uint64(pow(step, size, 1 << 64)) + power[size : size + n]
            size *= 2
    return mixed(whole)


def slices(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, begin, end) of the equal stretches of sorted values."""
    if len(values):
        cuts = np.flatnonzero(np.diff(values)) + 1
        for a, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)], strict=True):
            yield int(values[a]), a, e


def covered(first: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n places lie in stretches of ``size`` places from each first one on; those that would end past n are cut there."""
    edges = np.bincount(np.maximum(first, 0), minlength=n + 1)[: n + 1] - np.bincount(np.minimum(first + size, n), minlength=n + 1)[: n + 1]
    return np.cumsum(edges)[:n] > 0


class Chunk:
    """The documents of a chunk, in a fixed order, and the hashes of their words."""

    def __init__(self, held: pa.Table, buckets: int, width: int):
        rows = sorted(zip(*(held.column(c).to_pylist() for c in ("doc_id", "body", "extra")), strict=True), key=lambda r: (r[0], r[1], r[2]))
        self.bodies, self.extras = [r[1] for r in rows], [r[2] for r in rows]
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.buckets, self.width, self.reach = buckets, width, width - PERIOD + 1
        some = [word_hashes(b.split()) for b in self.bodies]  # bytes split at ASCII white space
        self.counts = np.array([len(h) for h in some], np.int64)
        self.hashes = np.concatenate(some) if some else np.zeros((0, 2), np.uint64)
        self.begins = np.cumsum(self.counts) - self.counts
        self.doc = np.repeat(np.arange(len(rows)), self.counts)
        self.left = np.repeat(self.begins + self.counts, self.counts) - np.arange(len(self.doc))

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where anchors begin, the distinct keys of all (bucket, then 32 bits of the hash), and each anchor's key."""
        n = len(self.doc)
        residue = (np.arange(n) - self.begins[self.doc]) % PERIOD
        at = np.flatnonzero(np.isin(residue, COVER) & (self.left >= self.reach) & (self.counts[self.doc] >= self.width))
        h = rolled(self.hashes[:, 0], self.reach, _STEPS[0])[at]
        keys, back = np.unique(((h >> np.uint64(32)) % np.uint64(self.buckets)) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF)), return_inverse=True)
        return at, keys, back

    def announced(self) -> Iterator[tuple[int, bytes, bytes]]:
        """Per bucket: the hashes of anchors, and of each whether several ids have it here already (2) or one (1)."""
        at, keys, back = self.anchors()
        ids = self.ids[self.doc[at]]
        low, high = np.full(len(keys), np.iinfo(np.int64).max), np.full(len(keys), np.iinfo(np.int64).min)
        np.minimum.at(low, back, ids)
        np.maximum.at(high, back, ids)
        many = (1 + (low != high)).astype(np.uint8)
        for b, a, e in slices((keys >> np.uint64(32)).astype(np.int64)):
            yield b, keys[a:e].astype(np.uint32).tobytes(), many[a:e].tobytes()

    def windows(self, flags: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The windows around shared anchors: where they begin, and each one's number among the distinct ones; of those, in a fixed order, the
        bucket, both hashes and the first document."""
        at, keys, back = self.anchors()
        shared = np.concatenate([np.unpackbits(np.frombuffer(flags[b], np.uint8))[: e - a] for b, a, e in slices((keys >> np.uint64(32)).astype(np.int64))] or [np.zeros(0, np.uint8)])
        near = covered(at[shared[back] > 0] - PERIOD + 1, PERIOD, len(self.doc)) if len(at) else np.zeros(len(self.doc), bool)
        starts = np.flatnonzero(near & (self.left >= self.width))
        pair = np.stack([rolled(self.hashes[:, k], self.width, _STEPS[k])[starts] for k in (0, 1)], axis=1) if len(starts) else np.zeros((0, 2), np.uint64)
        bucket = (pair[:, 1] >> np.uint64(32)) % np.uint64(self.buckets)
        order = np.lexsort((starts, pair[:, 1], pair[:, 0], bucket))
        b, p = bucket[order], pair[order]
        new = np.append(True, (p[1:] != p[:-1]).any(axis=1))[: len(order)]
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        return starts, number, b[new].astype(np.int64), p[new], self.doc[starts[order[new]]]

    def gone(self, flags: dict[int, bytes], answers: dict[int, bytes]) -> np.ndarray:
        """Which of all words go."""
        starts, number, bucket, _, first = self.windows(flags)
        bits = np.concatenate([np.unpackbits(np.frombuffer(answers[b], np.uint8))[: e - a] for b, a, e in slices(bucket)] or [np.zeros(0, np.uint8)])
        elsewhere = (bits[number] > 0) | (self.ids[self.doc[starts]] > self.ids[first[number]]) if len(starts) else np.zeros(0, bool)
        return covered(starts[elsewhere], self.width, len(self.doc))


_ROUTED = "chunk long, bucket int, kind int, a binary, b binary"
_ROUTED_SCHEMA = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])
_FLAGS, _BITS = 0, 1


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def _sent(rows: pa.Table, kind: type, width: int) -> tuple[list[int], list[np.ndarray], np.ndarray, np.ndarray]:
    """What chunks sent to one bucket: the chunks, the slices of their items, and all items' hashes and second values."""
    chunks, a, b = (rows.column(c).to_pylist() for c in ("chunk", "a", "b"))
    hashes = np.frombuffer(b"".join(a), np.uint32 if width == 1 else np.uint64).reshape(-1, width)
    ends = np.cumsum([len(x) // (hashes.itemsize * width) for x in a])
    return chunks, ends[:-1], hashes, np.frombuffer(b"".join(b), kind)


def shared_anchors(rows: pa.Table) -> pa.Table:
    """What each chunk gets to know of its anchors in one bucket: a bit for each, set if several documents have it."""
    chunks, cuts, hashes, many = _sent(rows, np.uint8, 1)
    values, back = np.unique(hashes[:, 0], return_inverse=True)
    shared = np.bincount(back, weights=many, minlength=len(values))[back] > 1
    bucket = rows.column("bucket")[0].as_py()
    return _table([(c, bucket, _FLAGS, np.packbits(s).tobytes(), None) for c, s in zip(chunks, np.split(shared, cuts), strict=True)], _ROUTED_SCHEMA)


def smaller_elsewhere(rows: pa.Table) -> pa.Table:
    """What each chunk gets to know of its windows in one bucket: a bit for each, set if a smaller document than the chunk's smallest has it."""
    chunks, cuts, pairs, ids = _sent(rows, np.int64, 2)
    order = np.lexsort((ids, pairs[:, 1], pairs[:, 0]))
    p = pairs[order]
    new = np.append(True, (p[1:] != p[:-1]).any(axis=1))
    least = np.empty(len(order), np.int64)
    least[order] = ids[order][np.flatnonzero(new)[np.cumsum(new) - 1]]
    bucket = rows.column("bucket")[0].as_py()
    return _table([(c, bucket, _BITS, np.packbits(s).tobytes(), None) for c, s in zip(chunks, np.split(least < ids, cuts), strict=True)], _ROUTED_SCHEMA)


def parts(total: int) -> int:
    """How many chunks, and buckets, a corpus of so many bytes has."""
    return max(LEAST_PARTS, math.ceil(total / max(LEAST_BYTES, math.isqrt(total * SHARE_BYTES))))


def removed_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, n_words, spans (the (begin, end) stretches of words that go), kept (the other words, one space apart), and extra, the
    columns to carry along as JSON."""
    integer_ids(docs, id_col)
    if width < PERIOD:
        raise ValueError(f"a window has {PERIOD} words at least")
    extra = F.to_json(F.struct(*carry)) if carry else F.lit("")
    body = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    n = parts(docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0)
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), body.alias("body"), extra.alias("extra"))
    texts = texts.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(n)))

    def announce(held: pa.Table) -> pa.Table:
        chunk = held.column("chunk")[0].as_py()
        return _table([(chunk, b, _FLAGS, h, m) for b, h, m in Chunk(held, n, width).announced()], _ROUTED_SCHEMA)

    def told_of(told: pa.Table, kind: int) -> dict[int, bytes]:
        return {b: a for b, k, a in zip(*(told.column(c).to_pylist() for c in ("bucket", "kind", "a")), strict=True) if k == kind}

    def extend(held: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        if held.num_rows:
            chunk = Chunk(held, n, width)
            _, _, bucket, pairs, first = chunk.windows(told_of(told, _FLAGS))
            at = held.column("chunk")[0].as_py()
            out = [(at, b, _BITS, pairs[a:e].tobytes(), chunk.ids[first[a:e]].tobytes()) for b, a, e in slices(bucket)]
        return _table(out, _ROUTED_SCHEMA)

    def finish(held: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        if held.num_rows:
            chunk = Chunk(held, n, width)
            gone = chunk.gone(told_of(told, _FLAGS), told_of(told, _BITS))
            for ident, text, carried, at, size in zip(chunk.ids.tolist(), chunk.bodies, chunk.extras, chunk.begins.tolist(), chunk.counts.tolist(), strict=True):
                own, words = gone[at : at + size], text.split()
                turns = np.flatnonzero(np.diff(own, prepend=False, append=False)).tolist()
                edges = [0, *turns, size]
                kept = b" ".join(w for a, e in zip(edges[::2], edges[1::2], strict=True) for w in words[a:e]) if turns else b" ".join(words)
                out.append((ident, size, [{"begin": a, "end": e} for a, e in zip(turns[::2], turns[1::2], strict=True)], kept.decode(), carried))
        return _table(out, result)

    result = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), ("kept", pa.string()), ("extra", pa.string())])
    by_chunk = texts.groupBy("chunk")
    flags = by_chunk.applyInArrow(announce, _ROUTED).groupBy("bucket").applyInArrow(shared_anchors, _ROUTED)
    sent = by_chunk.cogroup(flags.groupBy("chunk")).applyInArrow(extend, _ROUTED)
    bits = sent.groupBy("bucket").applyInArrow(smaller_elsewhere, _ROUTED)
    found = by_chunk.cogroup(flags.union(bits).groupBy("chunk")).applyInArrow(finish, "doc_id long, n_words long, spans array<struct<begin:long,end:long>>, kept string, extra string")
    words = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), _BLANK), lambda w: w != "")
    alone = docs.where(F.col(id_col).isNull()).select(F.lit(None).cast("long").alias("doc_id"), words.alias("words"), extra.alias("extra"))
    alone = alone.select("doc_id", F.size("words").cast("long").alias("n_words"), F.array().cast("array<struct<begin:long,end:long>>").alias("spans"), F.array_join("words", " ").alias("kept"), "extra")
    return found.unionByName(alone)


def op11_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``; what is kept as its SHA-256."""
    found = removed_passages(table(spark, sf_dir, "documents"))
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["begin"])
    return found.select("doc_id", "n_words", n_removed.alias("n_removed"), F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


SQL = rf"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '{_BLANK}'), lambda x: x <> '') AS w FROM documents
), x AS (
  SELECT doc_id, i, array_to_string(w[i:i + {WIDTH - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WIDTH - 2})) AS i FROM d WHERE len(w) >= {WIDTH})
), hit AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM x) WHERE least < doc_id
), gone AS (
  SELECT doc_id, list(DISTINCT i + k) AS places FROM hit, (SELECT unnest(range(0, {WIDTH})) AS k) GROUP BY doc_id
), kept AS (
  SELECT p.doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d) p
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, unnest(places) AS i FROM gone) g WHERE g.doc_id = p.doc_id AND g.i = p.i) GROUP BY p.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
