"""Exact substring dedup across documents with bucket-pointer refinement.

Every byte goes that is covered by a string of ``length`` bytes which also starts in a document with a
smaller id, judged on the input.

Two equal strings have the same minimizer: of the q-grams in them, the leftmost with the least hash. Documents
are dealt into chunks. 1. Each chunk sends the hashes of its minimizers, packed by hash bucket. 2. Each
bucket tells the chunks which of them occur in other documents too. 3. Each chunk sends the runs of strings
around those, equal ones once, with their smallest document, to the bucket of the minimizer; strings around a
minimizer that occurs very often go each to a bucket of its own hash instead. 4. Each bucket sorts the suffixes of its runs
by bucket-pointer refinement: first buckets of 8 bytes, then bucket after bucket by the bucket pointers of a later offset, which
reuse at once what other buckets have been refined to, down to the full length; equal strings stand together, and their smallest document
answers. An answer is a bit for each string. 5. Each chunk cuts its documents.
The texts are shuffled once, by chunk; only hashes, runs and bits travel otherwise.

Nulls and edges: a null text is empty and stays null; a document with a null id neither loses bytes nor
makes others lose any; rows that repeat an id never cut each other; shorter texts than ``length`` stay; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.frames import integer_ids

LENGTH = 50
QGRAM = 24
#: Bytes that a bucket's places agree in at first, and into how many blocks the buckets of a round are dealt.
Q, BLOCKS = 8, 8
#: Bytes of text in a chunk, and in a hash bucket's share of the corpus; but there are at least LEAST_PARTS of either.
CHUNK_BYTES, BUCKET_BYTES, LEAST_PARTS = 4 << 20, 12 << 20, 64
#: Occurrences from which on a minimizer's strings are dealt by their own hash.
FREQUENT = 2000
BATCH = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_HIGH = np.uint64(0xFFFFFFFF00000000)


def qgram_hashes(text: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the QGRAM (24) bytes from each place on."""
    grams = {1: text.astype(np.uint64) + np.uint64(1)}
    for n in (1, 2, 4, 8):
        g = grams[n]
        grams[2 * n] = g[: len(g) - n] * np.uint64(pow(_BASE, n, 1 << 64)) + g[n:]
    n = len(text) - QGRAM + 1
    h = grams[16][:n] * np.uint64(pow(_BASE, 8, 1 << 64)) + grams[8][16 : 16 + n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring keys."""
    n, least = 1, keys
    while 2 * n <= width:
        least = np.minimum(least[:-n], least[n:])
        n *= 2
    return np.minimum(least[: len(keys) - width + 1], least[width - n : width - n + len(keys) - width + 1])


def runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs of neighbouring strings of LENGTH bytes with one minimizer: document, first start, last start, the minimizer's place and hash."""
    found = []
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= BATCH):
            size += len(texts[end])
            end += 1
        some = texts[at:end]
        joined = np.frombuffer(b"".join(some), np.uint8)
        if len(joined) >= LENGTH:
            hashes = qgram_hashes(joined)
            keys = (hashes & _HIGH) | np.arange(len(hashes), dtype=np.uint64)
            places = (window_minima(keys, LENGTH - QGRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            sizes = np.array([len(t) for t in some])
            ends = np.cumsum(sizes)
            starts = ends - sizes
            doc = np.repeat(np.arange(len(some)), sizes)[: len(places)]
            inside = np.zeros(len(joined), bool)
            for a, n in zip(starts.tolist(), sizes.tolist(), strict=True):
                inside[a : max(a, a + n - LENGTH + 1)] = True
            inside = inside[: len(places)]
            new = inside.copy()
            new[1:] &= (places[1:] != places[:-1]) | (doc[1:] != doc[:-1]) | ~inside[:-1]
            first = np.flatnonzero(new)
            stops = np.flatnonzero(inside & ~np.append(inside[1:] & ~new[1:], False))
            d = doc[first]
            found.append((d + at, first - starts[d], stops - starts[d], places[first] - starts[d], hashes[places[first]]))
        at = end
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def bucket_pointers(blob: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The places of ``blob`` in the order of their suffixes, and the pointer of each place to its bucket in that order.

    Buckets begin as those of the first 8 bytes. A bucket whose places agree in d bytes is sorted by the pointers of the places d further on,
    and what still falls together agrees in as many bytes more as that later bucket does. Buckets are refined in blocks, from the greatest pointer
    on; a block sees at once what the blocks before it have refined. Places that are alone in their bucket, or agree in ``length`` bytes, drop out.
    The blob's end counts as zero bytes without end.
    """
    n = len(blob)
    gram = np.concatenate([blob, np.zeros(Q, np.uint8)]).astype(np.uint64)
    have = 1
    while have < Q:
        gram = np.concatenate([gram[: len(gram) - have] << np.uint64(8 * have) | gram[have:], np.zeros(have, np.uint64)])
        have *= 2
    order = np.argsort(gram[:n], kind="stable")
    new = np.append(True, np.diff(gram[order]) != 0)
    begin = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    pointers, depths = np.full(n + length + 1, -1), np.full(n, Q)  # a pointer for each place, a depth for each bucket
    pointers[order] = begin
    size = np.zeros(n, np.int64)  # of the bucket that begins here
    np.add.at(size, begin, 1)
    while True:
        open_ = np.flatnonzero((size > 1) & (depths < length))
        if not len(open_):
            return order, pointers[:n]
        ends = np.cumsum(size[open_])
        for block in reversed(np.split(open_, np.searchsorted(ends, np.arange(1, BLOCKS) * ends[-1] / BLOCKS))):
            if not len(block):
                continue
            sizes = size[block]
            first = np.cumsum(sizes) - sizes
            slots = np.repeat(block - first, sizes) + np.arange(sizes.sum())
            places, bucket = order[slots], np.repeat(np.arange(len(block)), sizes)
            later = pointers[np.minimum(places + np.repeat(depths[block], sizes), n)]
            sorted_ = np.argsort(bucket * (n + 1) + later + 1, kind="stable")
            places, later = places[sorted_], later[sorted_]
            new = np.append(True, (later[1:] != later[:-1]) | (bucket[1:] != bucket[:-1]))
            at = np.flatnonzero(new)
            order[slots], heads = places, slots[at]
            deeper = np.where(later[at] < 0, length, np.minimum(depths[block][bucket[at]] + depths[later[at]], length))
            size[heads] = np.diff(np.append(at, len(slots)))
            depths[heads] = deeper
            pointers[places] = np.repeat(heads, size[heads])


def agreeing(blob: np.ndarray, places: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Whether each of these places and the one before it begin the same ``length`` bytes (false for the first)."""
    same = np.append(False, np.ones(max(0, len(places) - 1), bool))
    for k in range(length):
        at = np.flatnonzero(same)
        same[at] = blob[places[at] + k] == blob[places[at - 1] + k]
    return same


def smallest_documents(pieces: list[bytes], docs: np.ndarray) -> list[np.ndarray]:
    """For every string in each of some different pieces, the smallest document over all pieces that hold it."""
    sizes = np.array([len(p) for p in pieces])
    blob = np.frombuffer(b"".join(pieces), np.uint8)
    stops = np.cumsum(sizes)
    piece = np.repeat(np.arange(len(pieces)), sizes)
    order, _ = bucket_pointers(blob)
    order = order[stops[piece[order]] - order >= LENGTH]  # in the order of suffixes, equal strings stand together
    string = np.cumsum(~agreeing(blob, order)) - 1
    least = np.full(string[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, string, docs[piece[order]])
    answers = np.zeros(len(blob), np.int64)
    answers[order] = least[string]
    answers = answers[stops[piece] - np.arange(len(blob)) >= LENGTH]
    cuts = np.cumsum(sizes - LENGTH + 1)[:-1]
    return np.split(answers, cuts)


class Chunk:
    """The documents of a chunk, in a fixed order."""

    def __init__(self, held: pa.Table, buckets: int):
        rows = sorted(zip(*(held.column(c).to_pylist() for c in ("doc_id", "body", "extra")), strict=True), key=lambda r: (r[0], r[1] or b"", r[2]))
        self.ids, self.texts, self.extras = ([r[k] for r in rows] for k in range(3))
        self.buckets = buckets
        self.doc, self.first, self.last, self.place, hashes = runs([t or b"" for t in self.texts])
        keys = ((hashes >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (hashes & np.uint64(0xFFFFFFFF))
        self.keys, self.back = np.unique(keys, return_inverse=True)

    def announced(self) -> Iterator[tuple[int, bytes, bytes]]:
        """Per bucket: the hashes, and of each in how many documents it is here, up to 255."""
        by_doc = np.unique(self.back.astype(np.int64) * len(self.ids) + self.doc) // len(self.ids) if len(self.back) else self.back
        n = np.minimum(np.bincount(by_doc, minlength=len(self.keys)), 255).astype(np.uint8)
        of, low = (self.keys >> np.uint64(32)).astype(np.int64), self.keys.astype(np.uint32)
        for b, a, e in slices(of):
            yield b, low[a:e].tobytes(), n[a:e].tobytes()

    def strings(self, flags: dict[int, bytes]) -> dict[int, dict[bytes, list]]:
        """Per bucket the different runs to look up: [minimizer's place or 255, smallest document, [(document, first start)]]."""
        flag = np.frombuffer(b"".join(flags[b] for b in sorted(flags)), np.uint8)[self.back] if len(self.back) else self.back
        key_bucket = (self.keys >> np.uint64(32)).astype(np.int64)[self.back] if len(self.back) else self.back
        found: dict[int, dict[bytes, list]] = {}
        chosen = np.flatnonzero(flag)
        for k, b, d, i, j, p in zip(flag[chosen].tolist(), *(x[chosen].tolist() for x in (key_bucket, self.doc, self.first, self.last, self.place)), strict=True):
            text = self.texts[d]
            if k == 1:
                whole = text[i : j + LENGTH]
                found.setdefault(b, {}).setdefault(whole, [p - i, d, []])[2].append((d, i))
            else:
                for s in range(i, j + 1):
                    whole = text[s : s + LENGTH]
                    found.setdefault(zlib.crc32(whole) % self.buckets, {}).setdefault(whole, [255, d, []])[2].append((d, s))
        return found

    def removed(self, flags: dict[int, bytes], answers: dict[int, bytes]) -> dict[int, np.ndarray]:
        """Of each document with hits, (first, end) of the starts of its strings that a smaller document has."""
        starts: dict[int, list[tuple[int, int]]] = {}
        for b, pieces in self.strings(flags).items():
            bits = np.unpackbits(np.frombuffer(answers[b], np.uint8))
            sizes = np.array([len(p) - LENGTH + 1 for p in pieces], np.int64)
            ends, before = np.cumsum(sizes), np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])
            marked = before[ends] - before[ends - sizes]
            for (_, least, places), end, n, m in zip(pieces.values(), ends.tolist(), sizes.tolist(), marked.tolist(), strict=True):
                elsewhere = stretches(bits[end - n : end]) if 0 < m < n else [(0, n)] if m else []
                for d, i in places:
                    if self.ids[d] > self.ids[least]:
                        starts.setdefault(d, []).append((i, i + n))
                    elif elsewhere:
                        starts.setdefault(d, []).extend([(i + a, i + e) for a, e in elsewhere])
        return {d: np.array(x, np.int64) for d, x in starts.items()}


def slices(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, begin, end) of the equal stretches of sorted values."""
    if len(values):
        cuts = np.flatnonzero(np.diff(values)) + 1
        for a, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)], strict=True):
            yield int(values[a]), a, e


def stretches(flags: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of the stretches that are set."""
    turns = np.flatnonzero(np.diff(flags != 0, prepend=False, append=False))
    return list(zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True))


def cut(text: bytes, starts: np.ndarray) -> list[tuple[int, int]]:
    """The maximal stretches that strings cover; of their starts (first, end) are given."""
    edges = np.zeros(len(text) + 1, np.int32)
    np.add.at(edges, starts[:, 0], 1)
    np.add.at(edges, starts[:, 1] + LENGTH - 1, -1)
    return stretches(np.cumsum(edges)[:-1])


_ROUTED = "chunk long, bucket int, kind int, a binary, b binary, c binary"
_ROUTED_SCHEMA = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
_FLAGS, _BITS = 0, 1


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def shared_minimizers(rows: pa.Table) -> pa.Table:
    """What each chunk gets to know of one bucket: for each of its hashes 0 (in no other document), 1, or 2 (very frequent)."""
    order = sorted(range(rows.num_rows), key=rows.column("chunk").to_pylist().__getitem__)
    chunks = [rows.column("chunk")[k].as_py() for k in order]
    hashes = [np.frombuffer(rows.column("a")[k].as_py(), np.uint32) for k in order]
    counts = [np.frombuffer(rows.column("b")[k].as_py(), np.uint8) for k in order]
    values, back = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(back, weights=np.concatenate(counts), minlength=len(values))
    flag = ((total > 1).astype(np.uint8) + (total > FREQUENT).astype(np.uint8))[back]
    bucket = rows.column("bucket")[0].as_py()
    parts = np.split(flag, np.cumsum([len(h) for h in hashes])[:-1])
    return _table([(c, bucket, _FLAGS, p.tobytes(), None, None) for c, p in zip(chunks, parts, strict=True)], _ROUTED_SCHEMA)


def answered(rows: pa.Table) -> pa.Table:
    """What each chunk gets to know of the strings that it sent to one bucket: a bit for each, set if a smaller document than the chunk's smallest has it."""
    chunks, blobs, shapes, least = (rows.column(c).to_pylist() for c in ("chunk", "a", "b", "c"))
    number: dict[bytes, int] = {}
    docs: list[int] = []
    by_gram: dict[bytes, set[int]] = {}
    sent: list[list[int]] = []
    for blob, shape, ids in zip(blobs, shapes, least, strict=True):
        at, own = 0, []
        for (size, place), doc in zip(np.frombuffer(shape, np.uint8).reshape(-1, 2).tolist(), np.frombuffer(ids, np.int64).tolist(), strict=True):
            piece = blob[at : at + size]
            at += size
            k = number.setdefault(piece, len(docs))
            if k == len(docs):
                docs.append(doc)
                if place < 255:
                    by_gram.setdefault(piece[place : place + QGRAM], set()).add(k)
            elif doc < docs[k]:
                docs[k] = doc
            own.append(k)
        sent.append(own)
    pieces = list(number)
    best: dict[int, np.ndarray] = {}
    mixed = [k for ks in by_gram.values() if len(ks) > 1 for k in sorted(ks)]
    if mixed:
        best = dict(zip(mixed, smallest_documents([pieces[k] for k in mixed], np.array(docs)[mixed]), strict=True))
    lengths, smallest, refined = np.array([len(p) - LENGTH + 1 for p in pieces]), np.array(docs), np.zeros(len(pieces), bool)
    refined[mixed] = True
    bucket, out = rows.column("bucket")[0].as_py(), []
    for chunk, own, ids in zip(chunks, sent, least, strict=True):
        its = np.frombuffer(ids, np.int64)
        sizes = lengths[own]
        bits = np.repeat(smallest[own] < its, sizes)
        ends = np.cumsum(sizes)
        for at in np.flatnonzero(refined[own]).tolist():
            bits[ends[at] - sizes[at] : ends[at]] = best[own[at]] < its[at]
        out.append((chunk, bucket, _BITS, np.packbits(bits).tobytes(), None, None))
    return _table(out, _ROUTED_SCHEMA)


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), whole_characters: bool = False) -> DataFrame:
    """Per row: doc_id, kept (the text's remaining bytes, null for a null text), n_bytes, spans (the (begin, end) byte
    stretches that go), and extra, the columns to carry along as JSON. With ``whole_characters`` a character
    that loses a byte isn't kept in part. Ids are integers; others are an error."""
    integer_ids(docs, id_col)
    extra = F.to_json(F.struct(*carry)) if carry else F.lit("")
    body = F.encode(F.col(text_col), "UTF-8")
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    chunks, buckets = (max(LEAST_PARTS, math.ceil(total / size)) for size in (CHUNK_BYTES, BUCKET_BYTES))
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), body.alias("body"), extra.alias("extra"))
    texts = texts.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)))

    def announce(held: pa.Table) -> pa.Table:
        chunk = held.column("chunk")[0].as_py()
        return _table([(chunk, b, _FLAGS, h, n, None) for b, h, n in Chunk(held, buckets).announced()], _ROUTED_SCHEMA)

    def flags_of(told: pa.Table, kind: int) -> dict[int, bytes]:
        return {b: a for b, k, a in zip(*(told.column(c).to_pylist() for c in ("bucket", "kind", "a")), strict=True) if k == kind}

    def send(held: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        if held.num_rows:
            chunk = Chunk(held, buckets)
            for b, pieces in chunk.strings(flags_of(told, _FLAGS)).items():
                shapes = np.array([(len(p), v[0]) for p, v in pieces.items()], np.uint8)
                least = np.array([chunk.ids[v[1]] for v in pieces.values()], np.int64)
                out.append((held.column("chunk")[0].as_py(), b, _BITS, b"".join(pieces), shapes.tobytes(), least.tobytes()))
        return _table(out, _ROUTED_SCHEMA)

    def finish(held: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        if held.num_rows:
            chunk = Chunk(held, buckets)
            gone = chunk.removed(flags_of(told, _FLAGS), flags_of(told, _BITS))
            for d, (doc_id, text, carried) in enumerate(zip(chunk.ids, chunk.texts, chunk.extras, strict=True)):
                spans = cut(text, gone[d]) if d in gone else []
                kept = text
                if spans:
                    edges = [0, *(x for s in spans for x in s), len(text)]
                    kept = b"".join(text[a:e] for a, e in zip(edges[::2], edges[1::2], strict=True))
                    kept = kept.decode("utf-8", "ignore").encode() if whole_characters else kept
                out.append((doc_id, kept, len(text or b""), [{"begin": a, "end": e} for a, e in spans], carried))
        return _table(out, result)

    result = pa.schema([("doc_id", pa.int64()), ("kept", pa.binary()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), ("extra", pa.string())])
    by_chunk = texts.groupBy("chunk")
    flags = by_chunk.applyInArrow(announce, _ROUTED).groupBy("bucket").applyInArrow(shared_minimizers, _ROUTED)
    sent = by_chunk.cogroup(flags.groupBy("chunk")).applyInArrow(send, _ROUTED)
    bits = sent.groupBy("bucket").applyInArrow(answered, _ROUTED)
    told = flags.union(bits).groupBy("chunk")
    found = by_chunk.cogroup(told).applyInArrow(finish, "doc_id long, kept binary, n_bytes long, spans array<struct<begin:long,end:long>>, extra string")
    alone = docs.where(F.col(id_col).isNull()).select(F.lit(None).cast("long").alias("doc_id"), body.alias("kept"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.array().cast("array<struct<begin:long,end:long>>").alias("spans"), extra.alias("extra"))
    return found.unionByName(alone)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without the repeated stretches in their texts; a character that loses a byte goes as a whole."""
    others = tuple(c for c in docs.columns if c not in (id_col, text_col))
    found = removed_spans(docs, id_col, text_col, others, whole_characters=True)
    opened = found.select(F.col("doc_id").cast(docs.schema[id_col].dataType).alias(id_col), F.col("kept").cast("string").alias(text_col), F.from_json("extra", docs.select(*others).schema).alias("extra"))
    return opened.select(*(F.col(c) if c in (id_col, text_col) else F.col("extra")[c].alias(c) for c in docs.columns))


def op1_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """All of ``documents``; what is kept as its SHA-256."""
    from rollcall.llm.frames import table

    found = removed_spans(table(spark, sf_dir, "documents"))
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["begin"])
    return found.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2(F.coalesce("kept", F.lit(b"")), 256).alias("kept_sha256"))
