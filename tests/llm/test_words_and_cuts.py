"""Passage dedup, fill-in-the-middle and periodic runs against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollcall.llm import passage_dedup, registry
from rollcall.llm.fill_in_middle import Markers, fill_in_middle, restored
from rollcall.llm.passage_dedup import removed_passages
from rollcall.llm.periodic_runs import periodic_runs, runs

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, chunk string, form string, words int"


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcde") for _ in range(3))
    say = lambda n: " ".join(word() for _ in range(n))
    passage, copy = say(30), say(60)
    texts = [None, "", " \n\t\x0b ", "x", "a b", "<P> in the text", "one <S", "S> two", "<<M<", copy, copy, copy + " end", "start " + copy]
    texts += [f"{say(r.randrange(20))} {passage} {say(r.randrange(20))}" for _ in range(12)]
    texts += [" ".join(passage.split()[k : k + 14]) + " z" for k in range(8)] + [" ".join(passage.split()[3:16]), " ".join(passage.split()[3:15])]
    texts += ["na " * 40, "la la la lo " * 9 + "la la", "a b a b a b a", "x x x x x", "y y y y y y", "ab c   \x1c d é😀 😀é" * 5, say(3000) + " tail" * 50]
    texts += [" ".join(r.choice("ab") for _ in range(r.randrange(60))) for _ in range(80)]
    table = [(i, t, "en", "s", None, 1, "c", "f", 2) for i, t in enumerate(texts)]
    return [*table, table[9], (9, texts[13], None, None, None, None, None, None, None), (-5, passage, None, None, None, None, None, None, None), (None, copy, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    return at


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("none"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{at}/documents.parquet")
    return at


def test_passages(spark, folder, rows):
    first = defaultdict(lambda: float("inf"))
    for i, t, *_ in rows:
        w = split(t)
        for k in range(len(w) - 12 if i is not None else 0):
            first[tuple(w[k : k + 13])] = min(first[tuple(w[k : k + 13])], i)
    expected = []
    for i, t, *_ in rows:
        w = split(t)
        gone = {k + d for k in range(len(w) - 12 if i is not None else 0) if first[tuple(w[k : k + 13])] < i for d in range(13)}
        expected.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    found = [tuple(r) for r in registry.QUERIES["op11_passage_dedup"](spark, folder).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr) and sum(e[2] for e in expected) > 400


@pytest.mark.parametrize("width", [7, 8, 20])
def test_passages_of_other_widths(spark, folder, rows, width):
    first = {}
    for i, t, *_ in rows:
        w = split(t)
        for k in range(len(w) - width + 1 if i is not None else 0):
            first[tuple(w[k : k + width])] = min(first.get(tuple(w[k : k + width]), i), i)
    for r in removed_passages(spark.read.parquet(f"{folder}/documents.parquet"), width=width, carry=("chunk",)).where("doc_id IS NOT NULL").collect():
        assert any(r.doc_id == i and (w := split(t)) is not None and len(w) == r.n_words and sorted(k for s in r.spans for k in range(s.begin, s.end))
                   == sorted({k + d for k in range(len(w) - width + 1) if first[tuple(w[k : k + width])] < i for d in range(width)}) for i, t, *_ in rows)


def test_difference_cover_and_parts():
    cover = set(passage_dedup.COVER)
    for i in range(7):
        for j in range(7):
            assert any((i + s) % 7 in cover and (j + s) % 7 in cover for s in range(7))
    assert passage_dedup.parts(0) == passage_dedup.parts(10**8) == 64
    assert 10**14 // passage_dedup.parts(10**14) < 260e6 and 10**14 // passage_dedup.parts(10**14) ** 2 > 600


def test_passages_of_text_ids(spark):
    with pytest.raises(TypeError):
        removed_passages(spark.createDataFrame([("x1", "a")], "doc_id string, text string"))


def cut(i, text):
    s = sha(f"1:{'' if i is None else i}")
    h = [int(s[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, e = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return i, n, "plain", None, None, sha(text), sha(text)
    form = "spm" if h[3] % 100 < 20 else "psm"
    return i, n, form, len(p), len(m), sha(f"<S>{e}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{e}<M>{m}"), sha(text)


def test_fill_in_middle(spark, folder, rows):
    found = [tuple(r) for r in registry.QUERIES["op12_fill_in_middle"](spark, folder).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256").collect()]
    expected = [cut(r[0], r[1] or "") for r in rows]
    assert sorted(found, key=repr) == sorted(expected, key=repr) and {e[2] for e in expected} == {"plain", "psm", "spm"}


def test_fill_in_middle_of_long_texts(spark):
    rows = [(k, x) for k, x in enumerate(["ab, " * 400_000, "é😀" * 300_000, "q" * 1_000_000, "\n" * 200_000, "$1 \\2 <P <S"])]
    found = fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), percent=100).withColumn("back", restored(F.col("output"), F.col("form")))
    assert [(r.doc_id, r.form == "plain", r.back == r.text) for r in found.orderBy("doc_id").collect()] == [(k, False, True) for k in range(5)]


def test_fill_in_middle_with_other_markers(spark):
    docs = spark.createDataFrame([(k, f"some text. {k} of [pre] or $0") for k in range(40)], "key long, body string")
    marks = Markers("[[P$1]", "\\S)", "(M|")
    found = fill_in_middle(docs, "key", "body", percent=100, spm_percent=50, markers=marks)
    assert found.where(F.col("text") != restored(F.col("output"), F.col("form"), marks)).count() == 0 and found.where("form = 'plain'").count() == 0
    for bad in (("a", "a", "b"), ("ab", "ba", "c"), ("", "x", "y"), ("abc", "b", "d")):
        with pytest.raises(ValueError):
            Markers(*bad)


def plain_runs(w):
    found, n = [], len(w)
    for q in range(1, n // 4 + 1):
        k = 0
        while k + q < n:
            if w[k] != w[k + q]:
                k += 1
                continue
            e = k
            while e + q < n and w[e] == w[e + q]:
                e += 1
            size = e - k + q
            if size >= max(6, 4 * q) and not any(all(w[x] == w[x + d] for x in range(k, k + size - d)) for d in range(1, q)):
                found.append((k, size, q))
            k = e + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    r = random.Random(1)
    for _ in range(400):
        texts = [[r.randrange(r.choice((1, 2, 3))) for _ in range(r.randrange(40))] for _ in range(4)]
        base = [r.randrange(5) for _ in range(r.randrange(1, 14))]
        texts.append(texts[0] + base * r.randrange(3, 9) + base[: r.randrange(len(base) + 1)] + texts[1])
        words = np.array([x for t in texts for x in t], np.int64)
        starts = np.cumsum([0, *map(len, texts)])
        expected = [(int(starts[k]) + s, n, p) for k, t in enumerate(texts) for s, n, p in plain_runs(t)]
        assert runs(words, np.repeat(np.arange(len(texts)), [len(t) for t in texts])) == sorted(expected, key=lambda x: (x[0], x[2]))


def test_runs_of_three_periods_and_fewer():
    assert runs(np.array([1, 2, 3] * 3), np.zeros(9, int), 1, 3) == [(0, 9, 3)]
    with pytest.raises(ValueError):
        runs(np.zeros(3, int), np.zeros(3, int), 1, 2)


def test_periodic_runs(spark, folder, rows):
    expected = []
    for i, t, *_ in rows:
        w = split(t)
        h = 1 if i is None else zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        if len(w) > 1000:
            assert h % 10 or i == 42
            found = plain_runs(w[-100:])
            found = [(s + len(w) - 100, n, q) for s, n, q in found]
        else:
            found = plain_runs(w)
        dropped = {k for s, n, q in found for k in range(s + q, s + n)}
        best = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        top = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
        expected.append((i, len(found), *top, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for k, x in enumerate(w) if k not in dropped))))
    df = registry.QUERIES["op13_periodic_runs"](spark, folder)
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(expected, key=repr) and sum(e[1] for e in expected) > 20


def test_blocks_of_words_do_not_matter(spark, folder, monkeypatch):
    from rollcall.llm import periodic_runs as module

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    whole = sorted(map(repr, periodic_runs(docs, least_exponent=3).collect()))
    monkeypatch.setattr(module, "BLOCK", 10)
    assert sorted(map(repr, periodic_runs(docs, least_exponent=3).collect())) == whole


@pytest.mark.parametrize("name", ["op11_passage_dedup", "op12_fill_in_middle", "op13_periodic_runs"])
def test_empty_table(spark, empty, name):
    assert registry.QUERIES[name](spark, empty).collect() == []
