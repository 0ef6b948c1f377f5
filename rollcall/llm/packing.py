"""Bounded-space online packing of token sequences.

Every input partition keeps a fixed number of open windows. A document's full windows go out at once;
its rest is placed best-fit. When no open window has room and no more may be opened, the fullest one is
topped up from the document's head and emitted. At its end a partition merges its open windows, and what
is left of each partition (less than one window) is merged across partitions by running totals.

A window is only emitted full, as documents may be cut freely, so that no window but the last has padding.

Nulls and edges: a null text is an empty document and holds only the end id; null and repeated ids are
packed row by row; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollcall.llm.frames import arrow_type, emitted, utf8, written

CAPACITY = 4096
OPEN_WINDOWS = 64
END_ID = 2
#: Sequence ids of windows that were merged across partitions start here; below, the high half is the partition.
MERGED_FROM = 1 << 62
#: Words whose ids a Python worker remembers at most; only speed depends on it.
REMEMBERED_WORDS = 800_000
REMEMBERED_PIECES = 150_000
#: Pieces that are tokenized as one text.
JOINED = 64
WORD_END = "</w>"
#: Fixed value: the pattern by which the tokenizer splits a text after lower-casing it, here for either case.
PIECE = r"'[sS]|'[tT]|'[rR][eE]|'[vV][eE]|'[mM]|'[lL][lL]|'[dD]|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: A mark that ends a word and is followed by white space is a piece of its own.
LONE_MARK = re.compile(rb"(?<=[a-z0-9])([.,])(?=[ \n])")
#: A letter whose lower case is not a letter alone.
ODD_LETTER = "\u0130"


class Numbered(dict):
    """Numbers words as they come; ``fresh`` has those that are new."""

    def __init__(self):
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


class WordIds:
    """Token ids of whole texts, from the ids of their words.

    The tokenizer never joins anything across white space, nor the pieces of ``PIECE``; each distinct piece is tokenized once.
    Texts that hold a special token's string, in whatever case, are tokenized whole: the library takes it for the token.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split = regex.compile(PIECE).findall
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True
        self.forget()

    def forget(self) -> None:
        self.known = Numbered()
        self.pieces: dict[str, list[int]] = {}
        self.starts, self.lengths, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn_pieces(self, fresh: list[str]) -> None:
        groups = [fresh[at : at + JOINED] for at in range(0, len(fresh), JOINED)]
        for group, ids in zip(groups, self.whole([" ".join(g) for g in groups]), strict=True):
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(group) and cuts[-1] == len(ids):
                at = 0
                for piece, end in zip(group, cuts.tolist(), strict=True):
                    self.pieces[piece], at = ids[at:end], end
            else:
                self.pieces.update(zip(group, self.whole(group), strict=True))

    def learn(self, fresh: list[bytes]) -> None:
        """Adds the ids of new words, in the order of their numbers."""
        if len(self.pieces) > REMEMBERED_PIECES:
            self.pieces = {}
        split: list[list[str]] = []
        for w in fresh:
            text = w.decode("utf-8")
            odd = not text.isascii() and (ODD_LETTER in text or not is_normalized("NFC", text))
            split.append([text] if odd else self.split(text))
        self.learn_pieces(list({p for ps in split for p in ps if p not in self.pieces}))
        flat: list[int] = []
        ends = [0]
        for ps in split:
            for p in ps:
                flat += self.pieces[p]
            ends.append(len(flat))
        bounds = np.array(ends, np.int64)
        self.starts = np.concatenate([self.starts, len(self.ids) + bounds[:-1]])
        self.lengths = np.concatenate([self.lengths, np.diff(bounds)])
        self.ids = np.concatenate([self.ids, np.array(flat, np.uint32)])

    def encode(self, texts: list[bytes], end_id: int) -> list[np.ndarray]:
        """The ids of each text and the end id, as unsigned 32-bit integers."""
        if len(self.known) > REMEMBERED_WORDS:
            self.forget()
        number = self.known.__getitem__
        lowered = [t.lower() for t in texts]
        whole = [k for k, t in enumerate(lowered) if any(x in t for x in self.special)]
        for k in whole:
            lowered[k] = b""
        split = [LONE_MARK.sub(rb" \1 ", t).split() for t in lowered]
        numbers = [np.fromiter(map(number, words), np.int64, len(words)) for words in split]
        self.learn(self.known.fresh)
        self.known.fresh = []
        found = []
        for at in numbers:
            lengths = self.lengths[at]
            ends = np.cumsum(lengths)
            n = int(ends[-1]) if len(ends) else 0
            ids = np.empty(n + 1, np.uint32)
            ids[:n] = self.ids[np.repeat(self.starts[at] - ends + lengths, lengths) + np.arange(n)]
            ids[n] = end_id
            found.append(ids)
        for k in whole:
            found[k] = np.array([*self.whole([texts[k].decode("utf-8")])[0], end_id], np.uint32)
        return found


_WORD_IDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One per Python worker and file."""
    if path not in _WORD_IDS:
        _WORD_IDS[path] = WordIds(path)
    return _WORD_IDS[path]


class Packer:
    """Places id arrays of documents into windows. A piece is (doc_id, start, doc_tokens, ids)."""

    def __init__(self, capacity: int, open_windows: int):
        self.capacity, self.most = capacity, open_windows
        self.windows: list[list] = []
        self.room: list[int] = []

    def place(self, doc_id, ids: np.ndarray) -> Iterator[list[tuple]]:
        """Yields the windows that got full, each as its list of pieces."""
        start, total = 0, len(ids)
        while total - start >= self.capacity:
            yield [(doc_id, start, total, ids[start : start + self.capacity])]
            start += self.capacity
        while start < total:
            rest = total - start
            fitting = [(r, k) for k, r in enumerate(self.room) if r >= rest]
            if fitting:
                k = min(fitting)[1]
            elif len(self.windows) < self.most:
                k = len(self.windows)
                self.windows.append([])
                self.room.append(self.capacity)
            else:
                k = min(range(len(self.room)), key=self.room.__getitem__)
            taken = min(rest, self.room[k])
            self.windows[k].append((doc_id, start, total, ids[start : start + taken]))
            self.room[k] -= taken
            start += taken
            if not self.room[k]:
                self.room[k] = self.room[-1]
                self.room.pop()
                full, self.windows[k] = self.windows[k], self.windows[-1]
                self.windows.pop()
                yield full

    def merged(self) -> Iterator[list[tuple]]:
        """The open windows one after the other, cut into full windows; the last may be short."""
        held: list[tuple] = []
        room = self.capacity
        for doc_id, start, total, ids in (p for w in self.windows for p in w):
            while len(ids):
                taken = min(room, len(ids))
                held.append((doc_id, start, total, ids[:taken]))
                start, ids, room = start + taken, ids[taken:], room - taken
                if not room:
                    yield held
                    held, room = [], self.capacity
        if held:
            yield held


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, open_windows: int = OPEN_WINDOWS, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, with
    ``keep_ids``, the piece's ids as little-endian unsigned 32-bit binary.

    ``tokenizer`` is the path, on every executor, of a word-level BPE file.
    """
    path, kind = tokenizer or default_tokenizer(), docs.schema[id_col].dataType.simpleString()
    schema = pa.schema(
        [("doc_id", arrow_type(docs, id_col))]
        + [(n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
        + [("part", pa.int64()), ("ids", pa.binary())]
    )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, packer, count = TaskContext.get().partitionId(), Packer(capacity, open_windows), 0

        def pieces(window: list[tuple], left: bool = False) -> Iterator[tuple]:
            nonlocal count
            offset = 0
            for doc_id, start, total, ids in window:
                raw = ids.tobytes()
                yield doc_id, start, len(ids), zlib.crc32(raw), total, (part << 32) + count, offset, part if left else None, raw if left or keep_ids else None
                offset += len(ids)
            count += 1

        def rows() -> Iterator[tuple]:
            encode = word_ids(path).encode
            for batch in batches:
                ids, texts = batch.column("doc_id").to_pylist(), batch.column("body")
                for at in range(0, len(ids), 256):
                    for doc_id, tokens in zip(ids[at : at + 256], encode(texts[at : at + 256].to_pylist(), end_id), strict=True):
                        for window in packer.place(doc_id, tokens):
                            yield from pieces(window)
            word_ids(path).forget()  # the worker's memory is for other tasks now
            for window in packer.merged():
                yield from pieces(window, left=sum(len(p[3]) for p in window) < capacity)

        return emitted(rows(), schema, 1024)

    out = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part long, ids binary"
    both = written(docs.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("body")).mapInArrow(packed, out))
    placed, left = both.where("part is null"), both.where("part is not null")
    totals = left.groupBy("part").agg(F.sum("length").alias("held"))  # a row for each input partition
    before = totals.select("part", (F.sum("held").over(Window.orderBy("part")) - F.col("held")).alias("before"))
    spread = left.join(before, "part").withColumn("at", F.col("before") + F.col("offset"))
    spread = spread.withColumn("k", F.explode(F.sequence(F.floor(F.col("at") / capacity), F.floor((F.col("at") + F.col("length") - 1) / capacity))))
    head = F.greatest(F.col("at"), F.col("k") * capacity)
    size = F.least(F.col("at") + F.col("length"), (F.col("k") + 1) * capacity) - head
    cut = F.expr("substring(ids, int(4 * (head - at) + 1), int(4 * size))")
    merged = (
        spread.withColumns({"head": head, "size": size})
        .withColumn("ids", cut)
        .select("doc_id", (F.col("start") + F.col("head") - F.col("at")).alias("start"), F.col("size").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", (F.lit(MERGED_FROM) + F.col("k")).alias("sequence_id"), (F.col("head") - F.col("k") * capacity).alias("offset"), "ids")
    )
    columns = [F.col("doc_id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if keep_ids else [])]
    return placed.select(*columns).unionByName(merged.select(*columns))


def op9_packing(spark, sf_dir: str) -> DataFrame:
    """All of ``documents`` in windows of 4096 tokens."""
    from rollcall.llm.frames import table

    return pack_documents(table(spark, sf_dir, "documents"), keep_ids=False)
