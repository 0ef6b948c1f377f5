"""Folds against sequential rules, and streaming against batch."""

import random

import pytest
from pyspark.sql import functions as F

from rollcall.operators import folds, status
from rollcall.streaming import state

SCHEMA = "delegator string, pos long, kind string, from_delegate string, to_delegate string, delta long"


def history(seed, n=400):
    r = random.Random(seed)
    rows, current = [], {}
    for pos in range(n):
        who = f"a{r.randrange(6)}"
        if r.random() < 0.35:
            to = r.choice(["zero", "d1", "d2", "d3", current.get(who, "d1")])
            source = r.choice([current.get(who, "zero"), to])
            rows.append((who, pos, "change", source, to, 0))
            current[who] = to
        else:
            rows.append((who, pos, "delta", None, r.choice([None, None, "d1", "d2"]), r.randrange(-9, 10)))
    return rows


def sequential(rows, saturating=False):
    """The rules one event at a time: (delegator -> (delegate, power))."""
    held = {}
    for who, _, kind, source, to, delta in rows:
        if kind == "change":
            if who in held and held[who][0] == to and source == to:
                continue
            held.pop(who, None)
            if to != "zero":
                held[who] = (to, 0)
        elif who in held and (to is None or to == held[who][0]):
            power = held[who][1] + delta
            held[who] = (held[who][0], max(0, power) if saturating else power)
    return held


@pytest.mark.parametrize("saturating", [False, True])
def test_delegations(spark, saturating):
    for seed in range(3):
        rows = history(seed)
        shuffled = random.Random(1).sample(rows, len(rows))
        found = folds.mappings(folds.delegation_fold(spark.createDataFrame(shuffled, SCHEMA), zero="zero", saturating=saturating)).collect()
        assert {r.delegator: (r.delegate, r.power) for r in found} == sequential(rows, saturating)


def test_rolling_match_consumes(spark):
    changes = spark.createDataFrame([("s", "t", 1, "a", "x", "y"), ("s", "t", 2, "b", "x", "y"), ("s", "u", 1, "c", "x", "x")], "contract_set_id string, transaction_hash string, log_index long, delegator string, from_delegate string, to_delegate string")
    votes = spark.createDataFrame([("s", "t", 3, "x", "-5"), ("s", "t", 4, "y", "5"), ("s", "t", 5, "y", "2"), ("s", "t", 6, "y", "1"), ("s", "u", 2, "x", "1")], "contract_set_id string, transaction_hash string, log_index long, delegate string, delta string")
    found = folds.rolling_match(changes, votes).orderBy("log_index").select("log_index", "change_log_index", "side").collect()
    assert [tuple(r) for r in found] == [(3, 2, "from"), (4, 2, "to"), (5, 1, "to")]


def test_rolling_match_as_one_by_one(spark):
    """Random transactions against the rules, one votes change after the other."""
    r = random.Random(8)
    changes, votes, expected = [], [], []
    for tx in range(60):
        held = []
        for at in range(r.randrange(2, 14)):
            if r.random() < 0.5:
                row = ("s", f"t{tx}", at, f"a{r.randrange(4)}", r.choice("xyz"), r.choice("xyz"))
                changes.append(row)
                held.append({"row": row, "from": row[4], "to": row[5], "live": row[4] != row[5]})
                continue
            who, delta = r.choice("xyz"), str(r.randrange(-3, 4))
            votes.append(("s", f"t{tx}", at, who, delta))
            found = None
            for side in ("from", "to") if int(delta) < 0 else ("to", "from"):
                for h in reversed(held):
                    if found is None and h["live"] and h[side] == who:
                        found = (side, h)
            if found:
                side, h = found
                h[side] = None
                expected.append(("s", f"t{tx}", at, h["row"][2], side, *h["row"][3:], delta))
    c = spark.createDataFrame(changes, "contract_set_id string, transaction_hash string, log_index long, delegator string, from_delegate string, to_delegate string")
    v = spark.createDataFrame(votes, "contract_set_id string, transaction_hash string, log_index long, delegate string, delta string")
    assert sorted(map(tuple, folds.rolling_match(c.repartition(3), v.repartition(2)).collect())) == sorted(expected) and len(expected) > 50


def test_threads_of_any_depth_and_cycles(spark):
    rows = [(k, k - 1 if k else None) for k in range(150)] + [(1000, 1001), (1001, 1002), (1002, 1000), (1003, 1000), (1004, 1004)]
    found = {r.id: (r.depth, r.root) for r in status.comment_tree(spark.createDataFrame(rows, "id long, parent long"), "id", "parent").collect()}
    assert found == {k: (k, 0) for k in range(150)} | {k: (0, k) for k in range(1000, 1005)}


def test_digest_is_that_of_the_rows(spark):
    """Counts and sums of the parts of each row's SHA-256, plainly."""
    import hashlib
    import json

    rows = [(1, "a", None), (2, None, 0.5), (2, None, 0.5)]
    content = [hashlib.sha256(json.dumps({k: v for k, v in zip("ikx", r, strict=True) if v is not None}, separators=(",", ":")).encode()).hexdigest() for r in rows]
    sums = "-".join(str(sum(int(h[8 * k : 8 * k + 8], 16) for h in content)) for k in range(4))
    assert tuple(status.table_digest(spark.createDataFrame(rows, "i long, k string, x double")).first()) == (3, sums)


def test_sizer():
    s = state.ChunkSizer(1000, stable_to_grow=2)
    assert s.record(6000, 1, 1) == "dense_rows" and s.size == 500
    assert s.record(10, 20, 1) == "high_query_duration" and s.size == 250
    assert s.record(10, 0.5, 0.5) == "hold" and s.record(10, 0.5, 0.5) == "stable_fast_chunk" and s.size == 500
    assert s.record(10, 5, 0.5, fills=1, queries=1) == "slow_cache_fill_hold" and s.record(10, 5, 0.5, fills=1, queries=1) == "repeated_slow_cache_fill" and s.size == 250


def test_comment_cycles_become_roots(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 99), (5, 6), (6, 5)], "id long, parent long")
    assert dict(status.comment_tree(df, "id", "parent").select("id", "depth").collect()) == {1: 0, 2: 1, 3: 2, 4: 0, 5: 0, 6: 0}


def test_zero_denominators(spark):
    df = spark.createDataFrame([("a", 0.0, 0.0, None), ("b", 0.0, None, 1.0)], "k string, balance double, price double, change double")
    assert [r.share for r in status.treasury(df, "balance", "price", "change").collect()] == [0.0, 0.0]
    digests = {tuple(status.table_digest(df.orderBy(F.col("k").desc() if d else F.col("k"))).first()) for d in (0, 1)}
    assert len(digests) == 1


def test_no_progress_without_a_height(spark):
    df = spark.createDataFrame([(None, 10, 20), (12, 10, 20), (30, 10, 20), (5, 10, 9)], "p long, s long, t long")
    remaining, done = status.range_progress(F.col("p"), F.col("s"), F.col("t"))
    assert [tuple(r) for r in df.select(remaining, F.round(done, 1)).collect()] == [(11, 0.0), (8, 27.3), (0, 100.0), (0, 100.0)]
