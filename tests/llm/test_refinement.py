"""Bucket-pointer refinement and the training sample against plain Python."""

import random
from collections import Counter

import numpy as np
import pytest

from rollcall.llm.substring_dedup import LENGTH, bucket_pointers, smallest_documents


def some_pieces(pick):
    base = bytes(pick.choice(pick.choice([b"a", b"ab", b"\0a", b"abcdefgh"])) for _ in range(400))
    if pick.random() < 0.3:
        base = b"\0" * pick.randrange(1, 80) + b"ab" * 150
    cuts = [bytearray(base[i : i + pick.randrange(50, 130)]) for i in (pick.randrange(300) for _ in range(12))]
    for x in cuts[::2]:
        x[pick.randrange(len(x))] = pick.choice(b"\0ax")
    return list({bytes(x) for x in cuts if len(x) >= LENGTH} | {b"\0" * LENGTH})


@pytest.mark.parametrize("seed", range(20))
def test_suffixes_in_order_and_equal_strings_together(seed):
    pick = random.Random(seed)
    pieces = some_pieces(pick)
    docs = [pick.randrange(1000) for _ in pieces]
    best = {}
    for p, d in zip(pieces, docs, strict=True):
        for i in range(len(p) - LENGTH + 1):
            best[p[i : i + LENGTH]] = min(d, best.get(p[i : i + LENGTH], d))
    found = smallest_documents(pieces, np.array(docs))
    assert [x.tolist() for x in found] == [[best[p[i : i + LENGTH]] for i in range(len(p) - LENGTH + 1)] for p in pieces]
    blob = b"".join(pieces)
    order, pointers = bucket_pointers(np.frombuffer(blob, np.uint8))
    padded = blob + b"\0" * LENGTH
    begins = [padded[k : k + LENGTH] for k in order.tolist()]
    assert sorted(order.tolist()) == list(range(len(blob))) and begins == sorted(begins)
    assert all(pointers[k] <= at for at, k in enumerate(order.tolist())) and (np.diff(pointers[order]) >= 0).all()


def test_the_sample_is_the_first_by_hash(spark):
    from pyspark.sql import functions as F

    from rollcall.llm.language import held_out, training_rows

    rows = [(k, f"text {k % 700}", "ab"[k % 3 == 0]) for k in range(1500)] + [(None, None, "a"), (3, "x", None)] + [(4, "text 4", "a")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    hashed = docs.where(~held_out("doc_id") & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64(F.col("doc_id").cast("string"), "text").alias("key")).distinct().collect()
    expected = Counter((lang, r.text) for lang in "ab" for r in sorted((r for r in hashed if r.lang == lang), key=lambda r: r.key)[:40])
    assert Counter((r.lang, r.text) for r in training_rows(docs, "doc_id", "text", "lang", 40).collect()) == expected
