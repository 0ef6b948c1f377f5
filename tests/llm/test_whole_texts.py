"""Rows that a cap or a least length would lose."""

import math

import pytest


def notices_of(text):
    """label: greatest aligned share, of every notice, by trying each at every place; its key phrases stand word by word where they would be."""
    from rollcall.llm.licenses import ALIGNED, COMMON, notices, words

    held, found = words(text), {}
    for label, notice, keys in notices():
        told = words(notice)
        keyed = {k + d for p in map(words, keys) for k in [next(k for k in range(len(told)) if told[k : k + len(p)] == p)] for d in range(len(p))}
        posted = [k for k, w in enumerate(told) if k in keyed or w not in COMMON]
        for s in range(-len(told), len(held)):
            stands = {k for k in posted if 0 <= s + k < len(held) and held[s + k] == told[k]}
            if keyed <= stands and len(stands) >= math.ceil(ALIGNED * len(posted)):
                found[label] = max(found.get(label, 0), len(stands) / len(posted))
    return found


def test_every_notice_of_a_file_is_tried(spark):
    from rollcall.llm.licenses import NOTICES, scan_licenses

    text = {label: t for label, t, _ in reversed(NOTICES)}
    rows = ["\n".join(t for _, t, _ in NOTICES), f"{text['mit']}. {text['mpl']}", f"{text['isc']} {text['bsd']} {text['mit']}", text["mit"].replace("obtaining", "getting").replace("dealing", "trading"), text["mit"][:60], " ".join(sorted(text["mit"].split()))]
    rows += [text["mit"]] * 20  # the words of MPL are the rare ones
    rows += ["software without restriction " + text["mit"].replace("without restriction", "with limits"), text["mit"] + " " + text["mit"]]  # a key phrase elsewhere
    expected = []
    for i, t in enumerate(rows, 1):
        found = notices_of(t)
        base = {w: label for w, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")) if w in t.lower()}
        expected.append((i, ",".join(sorted(set(found) | set(base.values()))), 1.0 if base else max(found.values(), default=0.0)))
    out = scan_licenses(spark.createDataFrame(list(enumerate(rows, 1)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.doc_id, r.labels) for r in out] == [e[:2] for e in expected]
    assert [r.score for r in out] == pytest.approx([e[2] for e in expected])
    assert len(out[0].labels.split(",")) > 30 and out[1].labels == "mit,mpl" and out[-2].labels == "" and len([s for s in out[-1].spans if s.label == "mit"]) == 2


def test_each_licence_by_its_passage_and_its_identifier(spark):
    """Every notice alone, amid other words; torn apart it is none."""
    from rollcall.llm.licenses import notices, scan_licenses

    every = notices()
    assert len({label for label, _, _ in every}) >= 30
    rows = [(k, f"x1 x2\n{t.upper()}\nx3") for k, (_, t, _) in enumerate(every)] + [(1000 + k, " y ".join(reversed(t.split()))) for k, (_, t, _) in enumerate(every)]
    rows += [(2000, "// SPDX-License-Identifier: BSD-3-Clause"), (2001, "SPDX-License-Identifier: BSD-4"), (2002, "BSD-3-Clause"), (2003, "Distributed under the Boost Software License, Version 1.0. (See accompanying file)")]
    found = {r.doc_id: set(r.labels.split(",")) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(label in found[k] for k, (label, _, _) in enumerate(every))
    base = {"mit", "apache", "gpl"}
    assert all(found[1000 + k] <= base | {""} for k in range(len(every)))
    assert found[2000] == {"bsd"} and found[2001] == found[2002] == {""} and found[2003] == {"boost"}


def test_copies_of_short_lines_go(spark, tmp_path):
    """From one code point on, in the query and in the pipeline's stage; variants only of longer lines."""
    import brute
    import corpus_pipeline
    from rollcall.llm.line_dedup import op3_line_dedup

    texts = ["# 目录\n这是一个完整的句子。\n\nx", " 这是一个完整的句子。\t\nshort\n \nx\nshort", "shord\nshort\n\n", "This is a line of more than 20\nshort", "This is a line of more than 2O\nx\n", None, ""]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    expected = {i: t for i, t, *_ in brute.lines([(i, t, "s") for i, t in enumerate(texts)])}
    assert expected[1] == "short\n " and expected[2] == "shord\n\n" and expected[3].startswith("This") and expected[4] == ""
    assert {r.doc_id: r.text for r in op3_line_dedup(spark, str(tmp_path)).collect()} == expected
    assert {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, docs, "").collect()} == expected


def test_rows_that_repeat_an_id_keep_their_own_lines(spark):
    """By the operator, a plain version and the SQL: lines belong to rows, not to ids."""
    import brute
    import duckdb
    from rollcall.llm.line_dedup import SQL, dedup_lines

    long = "a line that is long enough to have variants"
    rows = [(1, long), (2, "unique alpha, which is a long line too\nsecond unique line of this row"), (2, f"{long}\nsecond unique\nthird of all"), (2, f"{long}!\nx\nx"), (3, "x\nfourth"), (3, "fourth\nx"), (3, "fourth\nx"), (None, long), (4, None), (4, ""), (4, long[:-1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted(map(tuple, dedup_lines(docs).collect()), key=str)
    assert found == sorted(((i, t, n, k) for i, t, _, n, k in brute.lines([(*r, "s") for r in rows])), key=str)
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    assert found == sorted(con.execute(SQL).fetchall(), key=str)
    assert (2, rows[1][1], 2, 0) in found


def test_long_lines_that_differ_by_a_character(spark):
    """Long pieces are taken apart again, and whole lines are compared."""
    import random

    from rollcall.llm.line_dedup import dedup_lines

    r = random.Random(2)
    line = "".join(r.choice("abcdefgh ") for _ in range(40_000)).strip()
    texts = [line, line[:7] + "é" + line[8:], line[:39_000] + line[39_001:], line[:20_000] + "xx" + line[20_000:], line[:20_000] + "x" + line[20_000:]]
    found = {x.doc_id: x.n_removed for x in dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert found == {0: 0, 1: 1, 2: 1, 3: 0, 4: 1}
