"""The operators on texts against plain Python, over a table with every awkward row."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

import brute

WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, key string, v int"


def sentence(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def edited(r, text):
    words = text.split(" ")
    words[r.randrange(len(words))] = "changed"
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    base = [sentence(r, 80) for _ in range(6)]
    passage = sentence(r, 20)
    texts = [None, "", " \n\t ", "x", "same words here ok"]
    texts += base + base[:2] + [edited(r, b) for b in base for _ in range(4)]
    texts += [f"{sentence(r, 30)} {passage} {sentence(r, 30)}" for _ in range(8)]
    texts += ["\n".join(sentence(r, 6) for _ in range(5)) for _ in range(6)]
    texts += ["A first line that is long enough\nshort", "a first line that is long enough\nA first line that is long enogh\nshort", "A first line that is long enough \n"]
    texts += ["Ünïcödé façade naïve. MIT License, Apache License; the GNU General Public License", sentence(r, 3000), "spam spam " * 300, "don't 'S ’tis ½ ² ١٢٣ 日本語 x" * 3, "a" * 400, "é İx.   y"]
    table = [(i, t, "en", f"src{i % 3}" if i % 5 else None, None, "w", "k", 1) for i, t in enumerate(texts)]
    return table + [table[7], (None, base[0], None, "src1", None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def as_multiset(rows):
    return Counter(tuple(r) for r in rows)


def test_substrings(docs, rows, empty):
    from rollcall.llm.substring_dedup import removed_spans

    expected = brute.substrings(rows)
    found = [(r.doc_id, None if r.kept is None else bytes(r.kept), r.n_bytes, tuple(map(tuple, r.spans))) for r in removed_spans(docs).collect()]
    assert Counter(found) == Counter(expected)
    assert sum(len(e[3]) for e in expected) > 10
    assert removed_spans(empty).collect() == []


def test_substrings_around_frequent_minimizers(spark, monkeypatch):
    from rollcall.llm import substring_dedup as m

    r = random.Random(8)
    passage = sentence(r, 25)
    texts = [f"{sentence(r, 9)} {passage} {sentence(r, 9)}" for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = {r.doc_id: r.spans for r in m.removed_spans(df).collect()}
    monkeypatch.setattr(m, "FREQUENT", 3)
    assert {r.doc_id: r.spans for r in m.removed_spans(df).collect()} == plain
    assert sum(map(bool, plain.values())) == 39


def test_dedup_substrings_keeps_columns_and_characters(docs, spark):
    from rollcall.llm.substring_dedup import dedup_substrings

    out = dedup_substrings(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    two = spark.createDataFrame([(1, "é" * 40, None), (2, "x" + "é" * 40 + "y", "b")], "doc_id long, text string, source string")
    assert [tuple(r) for r in dedup_substrings(two).orderBy("doc_id").collect()] == [(1, "é" * 40, None), (2, "xy", "b")]


def test_lines(docs, rows, empty):
    from rollcall.llm.line_dedup import dedup_lines

    expected = [(i, t, n, k) for i, t, _, n, k in brute.lines([(r[0], r[1], r[3]) for r in rows])]
    found = [(r.doc_id, r.text, r.n_lines, r.n_removed) for r in dedup_lines(docs).collect()]
    assert Counter(found) == Counter(expected) and sum(e[3] for e in expected) > 3
    assert dedup_lines(empty).collect() == []


def test_lines_within_one_edit(spark):
    from rollcall.llm.line_dedup import dedup_lines

    r = random.Random(4)
    texts = []
    for _ in range(12):
        line = sentence(r, r.randrange(4, 40))
        at = r.randrange(len(line))
        texts += [line, line[:at] + line[at + 1 :], line[:at] + "#" + line[at:], line[:at] + "#" + line[at + 1 :], line[:at] + "##" + line[at:]]
    r.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = {i: any(brute.levenshtein(t, texts[j]) <= 1 for j in range(i)) for i, t in enumerate(texts)}
    assert {r.doc_id: r.n_removed == 1 for r in dedup_lines(df).collect()} == expected


def test_quality(docs, rows, empty):
    from rollcall.llm.quality import quality_rules

    expected = []
    for i, t, *_ in rows:
        m = brute.measures(t or "")
        expected.append((i, *m[:5], m[0] < 10 or 100 * m[4] > 20 * m[0]))
    found = quality_rules(docs).collect()
    assert Counter(tuple(r)[:7] for r in found) == Counter(expected)
    assert all(not (r.base_failed and r.kept) for r in found) and all(r.kept for r in found if not r.base_failed and r.n_soft_failures == 0)
    assert quality_rules(empty).collect() == []


def test_bad_hosts_lose_documents_that_share_their_failure(spark):
    from rollcall.llm.quality import quality_rules

    good, marked = " ".join(WORDS), " ".join(w + "$" for w in WORDS)
    rows = [(i, marked if i % 10 else good, "bad") for i in range(60)] + [(100 + i, good if i else marked, "good") for i in range(60)]
    kept = {r.doc_id: r.kept for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not kept[1] and kept[0] and kept[100] and kept[101]


def test_licenses(docs, rows, empty):
    from rollcall.llm.licenses import PHRASES, scan_licenses

    expected = []
    for i, t, *_ in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        at = [(k, label) for p, label in PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        expected.append((i, len(words), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at}))))
    found = scan_licenses(docs).collect()
    assert Counter(tuple(r)[:6] for r in found) == Counter(expected)
    assert any(e[5] == "apache,gpl,mit" for e in expected) and all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in found)
    assert scan_licenses(empty).collect() == []


def test_only_ascii_letters_are_lowered(spark):
    """As the contract says: other capitals make another word."""
    from rollcall.llm.licenses import scan_licenses

    found = scan_licenses(spark.createDataFrame([(1, "MIT LICENSE"), (2, "mİt license"), (3, "MİT LICENSE \u212a")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_base) for r in found] == [(2, 1), (2, 0), (3, 0)]


def test_notices(spark):
    from rollcall.llm.licenses import NOTICES, scan_licenses

    full = [(k, f"{sentence(random.Random(k), 5)} {text}") for k, (_, text, _) in enumerate(NOTICES)]
    torn = (90, "Permission is hereby granted, free of charge, to any person")
    found = {r.doc_id: r.labels.split(",") for r in scan_licenses(spark.createDataFrame([*full, torn], "doc_id long, text string")).collect()}
    assert all(NOTICES[k][0] in found[k] for k, _ in full) and found[90] == [""]


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(docs, rows, empty, percent):
    from rollcall.llm.minhash import near_duplicates

    component, linked = brute.near_components(rows, percent)
    expected = [(i, len(brute.shingles(t)), None if i is None else component[i], i is None or component[i] == i) for i, t, *_ in rows]
    assert as_multiset(near_duplicates(docs, percent=percent).collect()) == Counter(expected)
    assert len(linked) > 10 and near_duplicates(empty).collect() == []


def test_words_that_a_polynomial_confuses_stay_apart(spark):
    """The two complementary Thue-Morse words have the same polynomial modulo 2^64."""
    from rollcall.llm.minhash import near_duplicates

    for n in (10, 11, 12):
        one = "".join("ab"[k.bit_count() % 2] for k in range(1 << n))
        two = one.translate(str.maketrans("ab", "ba"))
        rows = [(1, f"{one} {one} x {one} y {one}"), (2, f"{two} {two} x {two} y {two}")]
        found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {r.doc_id: r.component_id for r in found} == {1: 1, 2: 2}


def test_near_duplicates_of_rows_that_repeat_an_id(spark):
    """Each by its own text; the id is one node."""
    from rollcall.llm.minhash import near_duplicates

    r = random.Random(4)
    a, b = sentence(r, 90), sentence(r, 90)
    rows = [(2, a), (2, b), (3, edited(r, a)), (4, edited(r, b)), (5, sentence(r, 90))]
    found = Counter((x.doc_id, x.component_id) for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == {(2, 2): 2, (3, 2): 1, (4, 2): 1, (5, 5): 1}


def test_near_duplicates_in_a_large_loose_group(spark, monkeypatch):
    from rollcall.llm import minhash as m

    r = random.Random(6)
    base = sentence(r, 120).split(" ")
    texts = []
    for _ in range(90):
        words = list(base)
        for _ in range(r.randrange(1, 6)):
            words[r.randrange(len(words))] = f"w{r.randrange(1000)}"
        texts.append(" ".join(words))
    component, _ = brute.near_components(list(enumerate(texts)), 85)
    monkeypatch.setattr(m, "TILE", 16)
    monkeypatch.setattr(m, "SIGNATURE_TILE", 8)
    found = m.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), percent=85).collect()
    assert {x.doc_id: x.component_id for x in found} == component and 1 < len(set(component.values())) < 90


def test_tiles_meet_but_for_the_largest_component(spark):
    """Every pair of members of different components meets in one pair of tiles at least."""
    from rollcall.llm.minhash import dealt_tiles

    r = random.Random(2)
    members = [(g, k + 100 * g, c) for g, n in enumerate((1, 5, 40)) for k in range(n) for c in [r.choice([7, 7, 7, 7, k])]] + [(9, 900 + k, 3) for k in range(6)]
    found = defaultdict(list)
    for x in dealt_tiles(spark.createDataFrame(members, "g int, rep long, c long"), "g", 4).collect():
        found[x.g, x.lo, x.hi].append((x.rep, x.tile))
    met = {(a, b) for (_, lo, hi), xs in found.items() for a, ta in xs for b, tb in xs if a != b and {ta, tb} == {lo, hi}}
    groups = {g: {c for h, _, c in members if h == g} for g in {m[0] for m in members}}
    assert {k[0] for k in found} == {g for g, cs in groups.items() if len(cs) > 1}
    assert all((a, b) in met for g, a, ca in members for h, b, cb in members if g == h and ca != cb)


@pytest.mark.parametrize("name", ["near_duplicates", "removed_spans"])
def test_text_ids_are_an_error_at_once(spark, name):
    from rollcall.llm import minhash, substring_dedup

    with pytest.raises(TypeError, match="integers"):
        getattr(minhash if name == "near_duplicates" else substring_dedup, name)(spark.createDataFrame([("x1", "a")], "doc_id string, text string"))


def test_packing(docs, rows, empty):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from rollcall.llm.packing import pack_documents

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {}
    for i, t, *_ in rows:
        ids[i, t or ""] = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
    pieces = pack_documents(docs, open_windows=4).collect()
    by_id = defaultdict(list)
    for p in pieces:
        by_id[p.doc_id].append(p)
    copies = Counter(i for i, *_ in rows)
    for (i, _), whole in ids.items():
        own = sorted(by_id[i], key=lambda p: p.start)
        assert sum(p.length for p in own) == len(whole) * copies[i]
        for p in own:
            part = whole[p.start : p.start + p.length].tobytes()
            assert p.ids_crc32 == zlib.crc32(part) and bytes(p.ids) == part and p.doc_tokens == len(whole)
    windows = defaultdict(list)
    for p in pieces:
        windows[p.sequence_id].append((p.offset, p.length))
    for held in windows.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))] and sum(n for _, n in held) <= 4096
    assert sum(sum(n for _, n in h) < 4096 for h in windows.values()) <= 1
    assert pack_documents(empty).collect() == []


def test_packing_of_special_strings(spark):
    """As the library tokenizes them by default: a special token's string is the token, in that case only."""
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from rollcall.llm.packing import pack_documents

    tokenizer, r = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), random.Random(5)
    parts = ["<|startoftext|>", "<|endoftext|>", "<|EndOfText|>", "<|endof", "text|>", " ", "Word", "é", "İ", ".", "\n", "it's", "9"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(12))) for _ in range(600)]
    held = defaultdict(list)
    for p in pack_documents(spark.createDataFrame([(float(k), t) for k, t in enumerate(texts)], "doc_id double, text string")).collect():
        held[p.doc_id].append((p.start, bytes(p.ids)))
    for k, t in enumerate(texts):
        assert b"".join(b for _, b in sorted(held[k])) == np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes(), t


def plain_languages(rows, k):
    """Language and score of each text, by dictionaries: TF-IDF trigrams, k-means by cosine, nearest centroid. ``rows``: (text, language to learn or None)."""
    import math

    def counts(text):
        raw = [b if b > 127 or chr(b).isalpha() else 32 for b in f" {text.lower()} ".encode()]
        return Counter(((a << 16 | b << 8 | c) * 2654435761 % 2**32) >> 20 for a, b, c in zip(raw, raw[1:], raw[2:]) if (a, b, c) != (32, 32, 32))

    def unit(v):
        size = math.sqrt(sum(x * x for x in v.values()))
        return {c: x / size for c, x in v.items()}

    dot = lambda v, w: sum(x * w.get(c, 0) for c, x in v.items())
    by = defaultdict(list)
    for t, lang in sorted(rows, key=lambda r: r[0]):
        if lang:
            by[lang].append(counts(t))
    n, often = sum(map(len, by.values())), Counter(c for cs in by.values() for x in cs for c in x)
    weigh = lambda c: unit({x: math.log1p(y) * (math.log((1 + n) / (1 + often[x])) + 1) for x, y in c.items()})
    model = []
    for lang, cs in by.items():
        vectors = [weigh(c) for c in cs]
        own = [vectors[0]]
        while len(own) < min(k, len(vectors)):
            own.append(min(vectors, key=lambda v: max(dot(v, w) for w in own)))
        for _ in range(12):
            near = [max(range(len(own)), key=lambda c: dot(v, own[c])) for v in vectors]
            for c in range(len(own)):
                mine = [v for v, at in zip(vectors, near, strict=True) if at == c]
                if mine:
                    total = Counter()
                    for v in mine:
                        total.update(v)
                    own[c] = unit(total)
        model += [(lang, w) for w in own]
    return [max(((dot(weigh(counts(t)), w), lang) for lang, w in model)) for t, _ in rows]


def test_languages_as_plain_centroids(spark):
    from rollcall.llm.language import CENTROIDS, identify_language

    r = random.Random(12)
    lexicon = {f"l{k:03}": ["".join(r.choice("aeiouäöxyzbdfgklmnprst") for _ in range(r.randrange(2, 9))) for _ in range(25)] for k in range(3)}
    rows = [(k, " ".join(r.choice(lexicon[lang]) for _ in range(r.randrange(3, 60))), lang) for k, lang in enumerate(r.choice(list(lexicon)) for _ in range(90))]
    learned = lambda k: zlib.crc32(str(k).encode()) % 3 != 1
    expected = plain_languages([(t, lang if learned(k) else None) for k, t, lang in rows], CENTROIDS)
    found = {x.doc_id: x for x in identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()}
    for (k, _, _), (score, lang) in zip(rows, expected, strict=True):
        assert found[k].lang_pred == lang and found[k].score == pytest.approx(score, abs=2e-3)


def test_training_rows_are_bounded(spark):
    """Rows are bounded, not ids; more labels than any bound are learned; a null id is for training."""
    from rollcall.llm.language import language_model, training_rows

    i = next(k for k in range(20) if zlib.crc32(str(k).encode()) % 3 != 1)
    rows = [(i, f"many texts of one id {k}", "aa") for k in range(60)] + [(i, "the same row", "bb")] * 50 + [(None, "without an id", "cc")] + [(i, f"label {k}", f"l{k}") for k in range(450)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    n = Counter(x.lang for x in training_rows(docs, "doc_id", "text", "lang", 20).collect())
    assert n["aa"] == 20 and n["bb"] == 1 and n["cc"] == 1 and len(n) == 453
    assert len(set(language_model(docs, per_language=20).languages)) == 453


def test_language(docs, empty, spark, sf_dir):
    from rollcall.llm.frames import table
    from rollcall.llm.language import has_letter, identify_language

    found = identify_language(docs).collect()
    assert all((r.lang_pred == "en") == has_letter(t) for r in found for t in [next(x for i, x, *_ in rows_of(docs) if i == r.doc_id)])
    assert identify_language(empty).collect() == []
    real = table(spark, sf_dir, "documents")
    truth = {r.doc_id: r.lang for r in real.collect()}
    judged = [r for r in identify_language(real).collect() if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in judged) >= 0.97 * len(judged) and all(0 <= r.score <= 1 for r in judged)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in judged)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_byte_bpe(docs, rows, empty):
    import base64

    import public_tokenizers as p
    import tiktoken

    from rollcall.llm.byte_bpe import decoded, encode_texts

    with open(p.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    known = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {i: t or "" for i, t, *_ in rows}
    out = encode_texts(docs)
    found = out.select("doc_id", "ids", decoded(out.ids).alias("bytes")).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.ids == known.encode_ordinary(texts[r.doc_id] if r.doc_id is not None else texts[5]) and bytes(r.bytes).decode() == (texts[r.doc_id] if r.doc_id is not None else texts[5])
    assert encode_texts(empty).collect() == []


def test_pipeline(spark, docs, rows):
    """All stages against plain versions of them, down to the token ids."""
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline as c

    now = docs.where("doc_id IS NOT NULL").select(*c.COLUMNS)
    expected = brute.quality([(r[0], r[1], r[3]) for r in rows if r[0] is not None])
    for name, stage in c.STAGES[:-1]:
        now = stage(spark, now, "")
        assert now.columns == list(c.COLUMNS)
        now = now.checkpoint()
        if name == "line_dedup":
            expected = [(i, t, s) for i, t, s, *_ in brute.lines(expected)]
        elif name == "minhash_near_dedup":
            component, _ = brute.near_components(expected, 80)
            expected = [r for r in expected if component[r[0]] == r[0]]
        elif name == "suffix_array_dedup":
            kept = {i: b for i, b, *_ in brute.substrings(expected)}
            expected = [(i, kept[i].decode("utf-8", "ignore"), s) for i, _, s in expected]
        assert Counter((r.doc_id, r.text, r.source) for r in now.collect()) == Counter(expected), name
        assert all(r.n_chars == len(r.text) for r in now.collect()) or name == "quality_rules"
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    held = defaultdict(list)
    for p in c.STAGES[-1][1](spark, now, "").collect():
        held[p.doc_id].append((p.start, bytes(p.ids)))
    copies = Counter(i for i, *_ in expected)
    for i, t, _ in expected:
        whole = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()
        assert sum(len(b) for _, b in held[i]) == copies[i] * len(whole) and all(whole[4 * a : 4 * a + len(b)] == b for a, b in held[i])
    assert set(held) == set(copies) and len(copies) < len(rows) - 10


def test_pipeline_of_awkward_tables(spark, tmp_path):
    """Nulls in every column, a column that isn't one of documents, and an empty table."""
    import corpus_pipeline as c

    r = random.Random(5)
    clean = [" ".join(f"w{r.randrange(10**6)}" for _ in range(40)) for _ in range(3)]
    table = [(None, clean[0], None, None, None, "w"), (1, None, None, None, None, None), (2, "", "en", "s", 0, None), (3, clean[1], None, None, None, None), (4, clean[2], "en", "s", 1, "w")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, body string"
    for name, some, ids in (("some", table, [None, 3, 4]), ("none", [], [])):
        spark.createDataFrame(some, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        found = c.run(spark, str(tmp_path / name)).collect()
        assert sorted({p.doc_id for p in found}, key=lambda i: i or 0) == ids
        assert all(p.start == 0 and p.length == p.doc_tokens for p in found)


def test_byte_bpe_of_long_runs_and_awkward_texts(spark):
    """Runs that the pattern doesn't split, and random texts of awkward characters, as the tiktoken library encodes them."""
    import base64

    import public_tokenizers as p
    import tiktoken

    from rollcall.llm.byte_bpe import decoded, encode_texts

    with open(p.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    known = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(7)
    parts = ["a", "b", "the", "ing", "Zebra", "é", "日本", " ", "  ", "   ", "\n", "\t", "\x1c", "\x85", "　", ".", "'s", "1", "!?", "\0", " b", "😀", "aaaa"]
    texts = ["".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(30_000)), "a" * 9001, "ab" * 2000, "aaab" * 500, "".join(r.choice("abcdefgh") for _ in range(1500)), "", " ", "a ", "x\n"]
    texts += ["".join(r.choice(parts) for _ in range(r.randrange(60))) for _ in range(1500)]
    out = encode_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id string, text string").repartition(3))
    found = {int(x.doc_id): (x.ids, bytes(x.b).decode()) for x in out.select("doc_id", "ids", decoded(out.ids).alias("b")).collect()}
    assert found == {k: (known.encode_ordinary(t), t) for k, t in enumerate(texts)}


def test_byte_bpe_stretches():
    """Split at single spaces or not, a text has the same words; packed numbers come back."""
    import numpy as np
    import public_tokenizers as p
    import regex

    from rollcall.llm.byte_bpe import Blocks, Texts, packed, read_ranks, unpacked

    rng = random.Random(5)
    parts = ["a", "the", "Zebra", "日本", " ", "  ", "   ", "\n", "\t", "\x1c", "\x85", "　", ".", "'s", "1", "!?", "\0", " b", "😀"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + ["", " ", "a ", "x\n"]
    blocks = Blocks(Texts(p.PATTERN), read_ranks(p.path("byte_bpe_50k.tiktoken")))
    numbers, sizes = blocks.of_texts(texts)
    own, ends = list(blocks.numbers), np.cumsum(sizes).tolist()
    for t, a, e in zip(texts, [0, *ends], ends):
        assert b"".join(own[n] for n in numbers[a:e]) == t.encode()
        words = np.frombuffer(blocks.of_text(t), np.int32)
        assert [b"".join(own[n] for n in blocks.flat[blocks.starts[w] : blocks.starts[w] + blocks.sizes[w]]).decode() for w in words] == regex.findall(p.PATTERN, t)
    some = np.array([0, 65534, 65535, 65536, 1, (1 << 30) - 1, 32767, 98303], np.int32)
    assert unpacked(packed(some)).tolist() == some.tolist() and len(unpacked(packed(some[:0]))) == 0
