"""Byte-level BPE encoding and decoding.

Texts are split in Arrow tasks by the tokenizer's pattern. Bytes that stand together in no token never merge, so words are
cut there into blocks. Each task numbers the distinct blocks of its texts, a chunk at a time, and keeps its documents as block
numbers. The distinct blocks of all chunks meet by a shuffle, and each is encoded once by higher-order functions over its
bytes: of the neighbouring pairs of parts the one whose concatenation has the lowest rank is merged, the leftmost of equals,
until no pair has a rank. The ranks are a literal table, in slots by hash so that a look-up doesn't scan. The ids go back
to the chunks that have the block. Decoding concatenates the tokens' bytes.

Nulls and edges: a null or empty text has no tokens and decodes to nothing; null and repeated ids are kept row
by row; an empty table gives an empty result. The ranks must hold each single byte. The time of a block of n bytes grows
with n times the number of its different merges; blocks are short unless a run of letters has no end.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterable, Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.llm.frames import arrow_type

SLOTS = 1 << 17
#: Rank of a pair that doesn't merge.
NEVER = 2**31 - 1
#: Pairs from which on all occurrences of the best pair are merged at once.
MANY = 32
#: Distinct blocks and characters of text of a chunk, at most (the text that reaches them is its last).
CHUNK_BLOCKS, CHUNK_CHARS = 400_000, 64 << 20
#: Distinct stretches of text that a task holds before it empties its memory, and the longest; only speed depends on them.
HELD, HELD_CHARS = 400_000, 64
#: Below this, str.isalpha and the pattern agree on what a letter is.
KNOWN_LETTERS = "\u0250"
#: Texts that travel together.
TEXTS = 256
#: In the packed numbers: two more 16-bit parts follow.
LARGE = 0xFFFF


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


def literal(value: object, kind: str) -> Column:
    """A constant from JSON, in which bytes are base64."""
    return F.from_json(F.lit(json.dumps(value, separators=(",", ":"))), kind)


def rank_table(ranks: dict[bytes, int]) -> Column:
    """A literal array of slots: the token and rank of a key are in the slot of its hash."""
    held: list[list] = [[] for _ in range(SLOTS)]
    for token, rank in ranks.items():
        held[xxhash.xxh64_intdigest(token, seed=42) % SLOTS].append({"t": base64.b64encode(token).decode(), "r": rank})
    return literal(held, "array<array<struct<t:binary,r:int>>>")


def looked_up(table: Column, key: Column) -> Column:
    slot = F.get(table, F.xxhash64(key).bitwiseAND(F.lit(SLOTS - 1)).cast("int"))
    return F.get(F.filter(slot, lambda e: e["t"] == key), 0)["r"]


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def folded(word: Column, table: Column) -> Column:
    """The token ids of a block of two bytes or more, by merging its bytes.

    What is folded are the neighbouring pairs: the rank of the whole, where it starts, where its second part does, and its end.
    Merges of one pair at several places at once are the same as one after the other if no pair that a merge makes on the
    way has a lower rank; where one has, only the leftmost is merged.
    """

    def token(start: Column, end: Column) -> Column:
        return looked_up(table, F.substring(word, start + 1, end - start))

    def rank(start: Column, end: Column) -> Column:
        return F.coalesce(token(start, end), F.lit(NEVER))

    def pair(start: Column, middle: Column, end: Column) -> Column:
        return F.struct(rank(start, end).alias("rank"), start.alias("start"), middle.alias("middle"), end.alias("end"))

    def state(pairs: Column) -> Column:
        return bound(pairs, lambda p: F.struct(F.array_min(p).alias("best"), p.alias("pairs")))

    def leftmost(s: Column) -> Column:
        best = s["best"]
        others = F.filter(s["pairs"], lambda p: p["start"] != best["start"])
        return F.transform(others, lambda p: F.when(p["middle"] == best["start"], pair(p["start"], p["middle"], best["end"])).when(p["start"] == best["middle"], pair(best["start"], p["middle"], p["end"])).otherwise(p))

    def everywhere(s: Column, marks: Column) -> Column:
        """All places that ``marks`` has a 1 at, never two neighbours; an empty array if that isn't the same as one by one."""
        pairs = s["pairs"]

        def marked(i: Column) -> Column:
            return F.coalesce(F.get(marks, i) == "1", F.lit(False))

        def after(p: Column, i: Column) -> Column:
            start = F.when(marked(i - 1), F.get(pairs, i - 1)["start"]).otherwise(p["start"])
            end = F.when(marked(i + 1), F.get(pairs, i + 1)["end"]).otherwise(p["end"])
            return F.when(marked(i), F.lit(None)).when(marked(i - 1) | marked(i + 1), pair(start, p["middle"], end)).otherwise(p)

        def on_the_way(p: Column, i: Column) -> Column:
            """The rank of the new part with the old one after it."""
            return F.when(marked(i) & F.get(pairs, i + 1).isNotNull(), rank(p["start"], F.get(pairs, i + 1)["end"])).otherwise(F.lit(NEVER))

        def checked(made: Column) -> Column:
            lowest = F.least(F.coalesce(F.array_min(made)["rank"], F.lit(NEVER)), F.array_min(F.transform(pairs, on_the_way)))
            return F.when(lowest > s["best"]["rank"], made).otherwise(F.slice(made, 1, 0))

        return bound(F.filter(F.transform(pairs, after), lambda p: p.isNotNull()), checked)

    def at_once(s: Column) -> Column:
        flags = F.array_join(F.transform(s["pairs"], lambda p: F.when(p["rank"] == s["best"]["rank"], "1").otherwise("0")), "")
        marks = F.split(F.replace(flags, F.lit("11"), F.lit("10")), "")
        made = bound(marks, lambda m: everywhere(s, m))
        return bound(made, lambda m: F.when(F.size(m) > 0, m).otherwise(leftmost(s)))

    def step(s: Column, _: Column) -> Column:
        done = s["best"].isNull() | (s["best"]["rank"] == NEVER)
        return F.when(done, s).otherwise(state(F.when(F.size(s["pairs"]) < MANY, leftmost(s)).otherwise(at_once(s))))

    def tokens(s: Column) -> Column:
        pairs = s["pairs"]
        last = F.get(pairs, F.size(pairs) - 1)
        return F.concat(F.transform(pairs, lambda p: token(p["start"], p["middle"])), F.array(F.coalesce(token(last["middle"], last["end"]), looked_up(table, word))))

    n = F.octet_length(word)
    first = F.transform(F.sequence(F.lit(0), n - 2), lambda i: pair(i, i + 1, i + 2))
    return F.aggregate(F.sequence(F.lit(2), n), state(first), step, tokens)


class Texts:
    """Splits texts into stretches that the pattern never looks across.

    For the default pattern these begin at single spaces between other characters; for any other a stretch is the text.
    """

    def __init__(self, pattern: str):
        self.words, self.spaced = regex.compile(pattern).findall, pattern == default_pattern()

    def stretches(self, text: str) -> tuple[list[str], str]:
        """The stretches and the white space after them."""
        if not self.spaced or "\0" in text:
            return [text], ""
        body = text.rstrip(" \t\r\n")
        return body.replace(" ", "\0 ").split("\0"), text[len(body) :]


def odd(stretch: str) -> bool:
    """Whether white space meets other white space at the ends of a stretch, so that it can't be split alone."""
    return stretch[-1:].isspace() or stretch[:1] == " " and (len(stretch) < 2 or stretch[1].isspace())


class OddSpaces(Exception):
    """A text has to be split as a whole."""


def gathered(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of some stretches, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class Numbered(dict):
    """Numbers words as they come, as 32-bit integers; ``fresh`` has those that are new."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> bytes:
        self[word] = n = pack("<i", len(self))
        self.fresh.append(word)
        return n


class Blocks(dict):
    """Word numbers by stretch, and the blocks of words. ``numbers`` has the distinct blocks in the order of their numbers."""

    def __init__(self, texts: Texts, tokens: Iterable[bytes]):
        super().__init__()
        self.texts = texts
        self.joins = np.zeros(1 << 16, bool)
        for t in tokens:
            for a, b in zip(t, t[1:]):
                self.joins[a << 8 | b] = True
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.words, self.numbers = Numbered(), {}
        self.starts, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def of_words(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.texts.words(text)))

    def __missing__(self, stretch: str) -> bytes:
        if self.texts.spaced and (stretch[1:] if stretch[:1] == " " else stretch).isalpha() and max(stretch) < KNOWN_LETTERS:
            n = self.words[stretch]  # letters, perhaps after one space, are a word
        elif odd(stretch):
            raise OddSpaces
        else:
            n = self.of_words(stretch)
        if len(stretch) <= HELD_CHARS:
            self[stretch] = n
        return n

    def of_text(self, text: str) -> bytes:
        """The numbers of a text's words."""
        stretches, rest = self.texts.stretches(text)
        if len(stretches) > 1:
            try:
                return b"".join([*map(self.__getitem__, stretches), self.of_words(rest)])
            except OddSpaces:
                pass
        return self.of_words(text)

    def learn(self) -> None:
        """Cuts the new words into blocks, between bytes that stand together in no token."""
        words = [w.encode("utf-8") for w in self.words.fresh]
        self.words.fresh = []
        if not words:
            return
        raw = b"".join(words)
        held = np.frombuffer(raw, np.uint8).astype(np.int64)
        ends = np.cumsum([len(w) for w in words])
        starts = ends - [len(w) for w in words]
        begins = np.ones(len(held), bool)
        begins[1:] = ~self.joins[held[:-1] << 8 | held[1:]]
        begins[starts] = True
        at = np.flatnonzero(begins)
        blocks = map(raw.__getitem__, map(slice, at.tolist(), [*at[1:].tolist(), len(raw)]))
        numbers = self.numbers
        own = np.fromiter((numbers.setdefault(b, len(numbers)) for b in blocks), np.int32, len(at))
        first = np.searchsorted(at, starts)
        self.starts = np.concatenate([self.starts, len(self.flat) + first])
        self.sizes = np.concatenate([self.sizes, np.diff([*first, len(at)])])
        self.flat = np.concatenate([self.flat, own])

    def of_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The block numbers of some texts, and how many each text has."""
        found = [self.of_text(t) for t in texts]
        self.learn()
        words = np.frombuffer(b"".join(found), np.int32)
        sizes = self.sizes[words]
        bounds = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *(len(f) // 4 for f in found)])]
        return self.flat[gathered(self.starts[words], sizes)], np.diff(bounds)


def packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2^30, compressed: as 16-bit parts, the high bytes first and then the low ones of each high byte."""
    large = numbers >= LARGE
    at = np.arange(len(numbers)) + 2 * (np.cumsum(large) - large)
    parts = np.empty(len(numbers) + 2 * int(large.sum()), np.uint16)
    parts[at] = np.minimum(numbers, LARGE)
    parts[at[large] + 1] = numbers[large] & 0x7FFF
    parts[at[large] + 2] = numbers[large] >> 15
    high = (parts >> 8).astype(np.uint8)
    raw = high.tobytes() + parts.astype(np.uint8)[np.argsort(high, kind="stable")].tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(raw: bytes) -> np.ndarray:
    high, low = np.frombuffer(pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True), np.uint8).reshape(2, -1)
    parts = high.astype(np.int64) << 8
    parts[np.argsort(high, kind="stable")] |= low
    large = np.flatnonzero(parts == LARGE)
    parts[large] = parts[large + 1] | parts[large + 2] << 15
    keep = np.ones(len(parts), bool)
    keep[large + 1] = keep[large + 2] = False
    return parts[keep]


def joined(words: list[bytes]) -> bytes:
    """Byte strings and their lengths, compressed."""
    sizes = np.array([len(w) for w in words], np.uint32).tobytes()
    raw = len(words).to_bytes(8, "little") + sizes + b"".join(words)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def parted(raw: bytes) -> list[bytes]:
    raw = pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)
    n = int.from_bytes(raw[:8], "little")
    ends = (8 + 4 * n + np.cumsum(np.frombuffer(raw, np.uint32, n, 8), dtype=np.int64)).tolist()
    return [raw[a:e] for a, e in zip([8 + 4 * n, *ends[:-1]], ends)]


def in_bytes(ids: Column) -> Column:
    """Ids as four bytes each, so that they take less room on their way."""
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.lpad(F.hex(i), 8, "0")), ""))


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Per row: id and ids, the token ids of the whole text. The vocabulary is read by the driver."""
    ranks, pattern = read_ranks(ranks_path or default_ranks()), pattern or default_pattern()
    kind, id_type = docs.schema[id_col].dataType.simpleString(), arrow_type(docs, id_col)
    vocabulary = docs.sparkSession.sparkContext.broadcast(ranks)  # a fixed file
    chunk_schema = pa.schema([("chunk", pa.int64()), ("doc_ids", pa.list_(id_type)), ("sizes", pa.list_(pa.int32())), ("numbers", pa.binary()), ("words", pa.binary())])

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per row some documents of a chunk, or all its distinct blocks."""
        blocks, part, count, chars = Blocks(Texts(pattern), vocabulary.value), TaskContext.get().partitionId(), 0, 0

        def row(doc_ids: list | None, sizes: list | None, numbers: bytes | None, words: bytes | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(((part << 24) + count, doc_ids, sizes, numbers, words), chunk_schema)], schema=chunk_schema)

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                some = batch.slice(at, TEXTS)
                numbers, sizes = blocks.of_texts(texts := some.column("text").to_pylist())
                yield row(some.column("id").to_pylist(), sizes.tolist(), packed(numbers), None)
                at, chars = at + TEXTS, chars + sum(map(len, texts))
                if len(blocks) > HELD:
                    blocks.clear()
                if len(blocks.numbers) >= CHUNK_BLOCKS or chars >= CHUNK_CHARS:
                    yield row(None, None, None, joined(list(blocks.numbers)))
                    blocks.forget()
                    count, chars = count + 1, 0
        if blocks.numbers:
            yield row(None, None, None, joined(list(blocks.numbers)))

    def words_of(held: pa.Table) -> pa.Table:
        """The distinct blocks of a chunk that aren't tokens, with their numbers."""
        words = [w for raw in held.column("words").to_pylist() if raw is not None for w in parted(raw)]
        tokens = vocabulary.value
        found = [(w, n) for n, w in enumerate(words) if w not in tokens]
        chunk = np.full(len(found), held.column("chunk")[0].as_py(), np.int64)
        return pa.table({"chunk": chunk, "n": pa.array([n for _, n in found], pa.int32()), "word": pa.array([w for w, _ in found], pa.binary())})

    def finish(held: pa.Table, told: pa.Table) -> pa.Table:
        words = [w for raw in held.column("words").to_pylist() if raw is not None for w in parted(raw)]
        at, tokens = told.column("n").to_numpy(), vocabulary.value
        ids = told.column("ids").to_pylist()
        flat, offsets = np.frombuffer(b"".join(ids), ">i4").astype(np.int32), np.cumsum([0, *(len(i) // 4 for i in ids)])
        own = np.array([tokens.get(w, -1) for w in words], np.int32)
        starts, sizes = len(flat) + np.arange(len(words)), np.ones(len(words), np.int64)
        starts[at], sizes[at] = offsets[:-1], np.diff(offsets)
        flat = np.concatenate([flat, own])
        doc_ids, found = [], []
        for some, lengths, raw in zip(*(held.column(c).to_pylist() for c in ("doc_ids", "sizes", "numbers"))):
            if raw is None:
                continue
            numbers = unpacked(raw)
            taken = sizes[numbers]
            ends = np.concatenate([[0], np.cumsum(taken)])[np.cumsum([0, *lengths])]
            found.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat[gathered(starts[numbers], taken)])))
            doc_ids += some
        return pa.Table.from_arrays([pa.array(doc_ids, id_type), pa.chunked_array(found, pa.list_(pa.int32()))], ["id", "ids"])

    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chunks = texts.mapInArrow(chunked, f"chunk long, doc_ids array<{kind}>, sizes array<int>, numbers binary, words binary").groupBy("chunk")  # one shuffle for both uses
    words = chunks.applyInArrow(words_of, "chunk long, n int, word binary")
    same = Window.partitionBy("word").orderBy("chunk")
    # one literal, bound once: each copy of it would go into every task
    once = words.withColumn("first", F.row_number().over(same) == 1).withColumn("ids", F.when(F.col("first"), bound(rank_table(ranks), lambda t: in_bytes(folded(F.col("word"), t)))))
    told = once.select("chunk", "n", F.first("ids", ignorenulls=True).over(same).alias("ids"))
    return chunks.cogroup(told.groupBy("chunk")).applyInArrow(finish, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def concatenated(pieces: Column, step: int = 64) -> Column:
    """All pieces of binary in one, by blocks of blocks, so that long arrays aren't copied again for each piece."""

    def in_one(some: Column) -> Column:
        return F.aggregate(some, F.lit(b""), lambda s, x: F.concat(s, x))

    def blocks(some: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), ((F.size(some) - 1) / step).cast("int")), lambda k: in_one(F.slice(some, k * step + 1, F.lit(step))))

    return bound(pieces, lambda p: F.when(F.size(p) == 0, F.lit(b"")).otherwise(bound(blocks(p), lambda q: in_one(blocks(q)))))


def decoded(ids: Column, ranks_path: str | None = None) -> Column:
    """The bytes of token ids."""
    by_rank = {r: t for t, r in read_ranks(ranks_path or default_ranks()).items()}
    tokens = literal([base64.b64encode(by_rank[r]).decode() if r in by_rank else None for r in range(max(by_rank) + 1)], "array<binary>")
    return concatenated(F.transform(ids, lambda i: F.get(tokens, i)))


def op10_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """All of ``documents``, encoded and decoded again, as digests."""
    from rollcall.llm.frames import table

    encoded = encode_texts(table(spark, sf_dir, "documents"))
    text = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.encode(text, "UTF-8"), 256).alias("ids_sha256"), F.sha2(decoded(F.col("ids")), 256).alias("decoded_sha256"))
