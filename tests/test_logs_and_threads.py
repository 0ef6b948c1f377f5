"""Built-in decoding, interval joins, threads and hashes against plain Python."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from rollcall.functions.keccak import keccak_hex, keccak_many
from rollcall.operators import decode, status
from rollcall.operators.intervals import dyadic_pieces, interval_join


def word(x):
    return (x.hex() if isinstance(x, bytes) else f"{x:x}").rjust(64, "0")


def padded(b):
    return word(len(b)) + b.hex() + "0" * (-len(b.hex()) % 64)


def encoded(kind, r):
    """(value words, or a tail) of a random parameter."""
    number = lambda: r.choice([0, 1, r.randrange(1 << 64), r.randrange(1 << 256), (1 << 256) - 1])
    text = lambda: r.choice([b"", b"x", "é😀".encode(), bytes(r.randrange(32, 127) for _ in range(r.randrange(70)))])
    if kind.endswith("[]"):
        inner, n = kind[:-2], r.randrange(4)
        if inner in ("string", "bytes"):
            parts, offsets, at = [padded(text()) for _ in range(n)], [], 32 * n
            for p in parts:
                offsets.append(word(at))
                at += len(p) // 2
            return None, word(n) + "".join(offsets) + "".join(parts)
        return None, word(n) + "".join(word(r.randrange(1 << 160) if inner == "address" else number()) for _ in range(n))
    if kind in ("string", "bytes"):
        return None, padded(text())
    return word({"address": r.randrange(1 << 160), "uint8": r.randrange(256), "bytes32": r.randrange(1 << 256)}.get(kind, number())), None


def log_of(signature, r):
    topics, head, tail = [decode.topic0(signature)], [], []
    inner = decode.parameters(signature)
    size = 32 * sum(not x for _, _, x in inner)
    for _, kind, indexed in inner:
        value, body = encoded(kind, r)
        if indexed:
            topics.append("0x" + value)
        elif body is None:
            head.append(value)
        else:
            head.append(word(size + sum(map(len, tail)) // 2))
            tail.append(body)
    return topics, "0x" + "".join(head + tail)


def test_built_in_decoding_is_that_of_plain_python(spark):
    r, rows, expected = random.Random(4), [], {}
    for role, signatures in decode.EVENTS.items():
        for s in signatures:
            for _ in range(12):
                topics, data = log_of(s, r)
                for cut in (None, r.randrange(2, len(data) + 1) // 2 * 2, "offset"):
                    d = data if cut is None else data[:cut] if cut != "offset" else data[:2] + "f" * 64 + data[66:]
                    k = len(rows)
                    rows.append((k, topics, d, role, s[: s.index("(")]))
                    expected[k] = decode.decoded_log(topics, d)
    logs = spark.createDataFrame(rows, "k int, topics array<string>, data string, role string, event_name string")
    for role, signatures in decode.EVENTS.items():
        typed = decode.typed_events(logs.where(F.col("role") == role), signatures)
        found = {x.k: {n: v for n, v in x.event.asDict().items() if v is not None} for x in typed.select("k", "event").collect()}
        wanted = {k: {n: v for n, v in e.items() if v is not None} for k, e in expected.items() if e is not None and rows[k][3] == role}
        assert found.keys() == wanted.keys()
        for k in wanted:
            assert found[k] == wanted[k], (rows[k], found[k], wanted[k])
    plan = decode.typed_events(logs, decode.EVENTS["governor"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Scan ") == 1


def test_dyadic_pieces_are_the_interval(spark):
    r = random.Random(2)
    rows = [(a, a + n) for a, n in [(0, 0), (0, 1023), (1, 1), (7, 8), (-9, 20), (5, -1), (5, -7)] + [(r.randrange(-500, 500), r.randrange(600)) for _ in range(60)]]
    found = spark.createDataFrame(rows, "a long, b long").select("a", "b", dyadic_pieces(F.col("a"), F.col("b")).alias("p")).collect()
    for x in found:
        held = [v for p in x.p for v in range(p.place << p.level, (p.place + 1) << p.level)]
        assert sorted(held) == list(range(x.a, x.b + 1)) and all(sum(q.level == p.level for q in x.p) <= 2 for p in x.p)


def test_positions_meet_the_intervals_that_hold_them(spark):
    r = random.Random(5)
    points = [(k, r.randrange(5000)) for k in range(300)] + [(300, None), (301, 0), (302, 2**40)]
    intervals = [(k, a, a + n) for k, (a, n) in enumerate([(0, 2**41), (17, 0), (100, 2999), (0, 0)] + [(r.randrange(5000), r.choice([0, 2, 40, 3000])) for _ in range(60)])] + [(90, None, 5), (91, 5, None), (92, 9, 3)]
    p, i = spark.createDataFrame(points, "k int, at long"), spark.createDataFrame(intervals, "s int, first long, last long")
    joined = interval_join(p, "at", i)
    assert sorted((x.k, x.s) for x in joined.collect()) == sorted((k, s) for k, at in points for s, a, b in intervals if None not in (at, a, b) and a <= at <= b)
    assert "NestedLoop" not in interval_join(p, "at", i).drop("x")._jdf.queryExecution().executedPlan().toString().replace("BroadcastNestedLoopJoin BuildRight, Cross", "")
    assert interval_join(p, "at", i.where("s > 1000")).count() == 0


def plain_threads(rows):
    """(id, depth, root, parent) in order, by a stack. rows: (id, parent, order)."""
    first = {}
    for i, p, o in sorted(rows, key=lambda x: (x[2], x[0])):
        first.setdefault(i, (p, o))

    def bad(i):
        seen = set()
        while i in first:
            if i in seen:
                return True
            seen.add(i)
            i = first[i][0]
        return False

    children, roots = {}, []
    for i, (p, o) in sorted(first.items(), key=lambda x: (x[1][1], x[0])):
        (roots if p not in first or bad(i) else children.setdefault(p, [])).append(i)
    out = []
    for root in roots:
        stack = [(root, 0, None)]
        while stack:
            i, depth, parent = stack.pop()
            out.append((i, depth, root, parent))
            stack += [(c, depth + 1, i) for c in reversed(children.get(i, []))]
    return out


def test_threads_in_order(spark):
    r = random.Random(6)
    rows = [(k, r.choice([None, 999, *range(max(1, k))]) if k % 9 else None, r.randrange(20)) for k in range(120)]
    rows += [(200 + k, 200 + k - 1, 0) for k in range(1, 40)] + [(300 + k, 5, k % 3) for k in range(60)]  # a long and a wide thread
    rows += [(400, 401, 1), (401, 402, 2), (402, 400, 0), (403, 401, 5), (404, 404, 3), (405, 403, 3)]  # cycles, and what hangs on them
    rows += [(i, 7, o + 100) for i, _, o in rows[:30]] + [(None, 1, 1)]  # ids again, later
    found = status.comment_threads(spark.createDataFrame(rows, "i long, p long, o long"), "i", "p", ["o", "i"]).orderBy("place").collect()
    assert [(x.id, x.depth, x.root, x.parent) for x in found] == plain_threads([x for x in rows if x[0] is not None])
    assert [x.place for x in found] == list(range(1, len(found) + 1))


def test_repeated_ids_are_one_comment(spark):
    rows = [(k, k - 1 if k else None) for k in range(13)]
    found = status.comment_tree(spark.createDataFrame(rows + rows[1:], "i long, p long"), "i", "p").collect()
    assert sorted((x.id, x.depth, x.root) for x in found) == [(k, k, 0) for k in range(13)]


def test_threads_of_an_empty_table(spark):
    assert status.comment_threads(spark.createDataFrame([], "i long, p long, o long"), "i", "p", ["o"]).collect() == []


def test_keccak_has_the_permutation_of_sha3(spark):
    texts = [b"", b"a", *(b"x" * k for k in (134, 135, 136, 137, 271, 272, 273)), "é".encode() * 5000]
    assert keccak_many(texts, b"\x06") == [hashlib.sha3_256(t).digest() for t in texts]
    rows = spark.createDataFrame([("",), (None,), ("abc",)], "t string").select(keccak_hex("t")).collect()
    assert [x[0] for x in rows] == ["0xc5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470", None, "0x4e03657aea45a94fc7d47ba826c8d667c0d1e6e33a64a036ec44f58fa12d6c45"]


def test_digest_of_a_table_with_many_rows(spark):
    rows = [(k, f"v{k}") for k in range(50)]
    shown = status.table_digest(spark.createDataFrame(rows, "k int, v string")).first()
    parts = [hashlib.sha256(json.dumps({"k": k, "v": v}, separators=(",", ":")).encode()).hexdigest() for k, v in rows]
    assert tuple(shown) == (50, "-".join(str(sum(int(h[8 * i : 8 * i + 8], 16) for h in parts)) for i in range(4)))
