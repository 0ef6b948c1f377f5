"""Exact numbers, hashes, descriptions and decoding against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from rollcall.functions import descriptions, scalars, u256
from rollcall.functions.keccak import keccak256
from rollcall.operators import decode
from rollcall.operators.filters import checked_numeric, condition
from rollcall.sources import logs, sinks


def numbers(n=60):
    r = random.Random(5)
    return [r.randrange(10 ** r.randrange(1, 77)) for _ in range(n)] + [0, 2**256 - 1, 10**26, 10**26 - 1, 10**52]


def test_arithmetic(spark):
    pairs = list(zip(numbers(), reversed(numbers()), strict=True))
    df = spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "a string, b string")
    a, b = F.col("a"), F.col("b")
    out = df.select(u256.subtracted(a, b), u256.saturating_sub(a, b), u256.compared(a, b), u256.signed_added(F.concat(F.lit("-"), a), b)).collect()
    assert [tuple(r) for r in out] == [(str(x - y), str(max(0, x - y)), (x > y) - (x < y), str(y - x)) for x, y in pairs]


def test_total_is_exact(spark):
    values = [(k % 3, (-1) ** k * n) for k, n in enumerate(numbers() * 3)]
    df = spark.createDataFrame([(k, str(v)) for k, v in values], "k int, v string")
    found = dict(df.groupBy("k").agg(u256.total(F.col("v"))).collect())
    assert found == {k: str(sum(v for j, v in values if j == k)) for k in range(3)}


def test_normalize_and_sort(spark):
    df = spark.createDataFrame([("000",), ("-0012",), ("0105",), ("-0",), ("7",)], "v string")
    assert [r[0] for r in df.select(u256.canonical(F.col("v"))).collect()] == ["0", "-12", "105", "0", "7"]
    ordered = df.select(u256.canonical(F.col("v")).alias("v")).orderBy(u256.sort_key(F.col("v")), "v").collect()
    assert [int(r.v) for r in ordered] == sorted(int(r.v) for r in ordered)


def test_hexadecimal(spark):
    df = spark.createDataFrame([(str(n),) for n in numbers()], "v string").select("v", u256.decimal_to_hex("v").alias("h"))
    for r in df.select("v", "h", u256.hex_to_decimal("h").alias("d")).collect():
        assert r.d == r.v and int(r.h, 16) == int(r.v)


def test_keccak_vectors():
    assert keccak256(b"").hex().startswith("c5d2460186f7233c")
    assert decode.topic0(decode.EVENTS["token"][2]) == "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"
    assert keccak256(b"a" * 136) != keccak256(b"a" * 137)


def word(n):
    return f"{n:064x}"


def test_decodes_dynamic_parameters():
    text = "# Title\nBody".encode()
    head = [word(9001), word(0xAB), *(word(k) for k in (288, 352, 416, 544)), word(10), word(20)]
    parts = [
        word(1) + word(0xC0), word(1) + word(5), word(1) + word(32) + word(3) + b"f()".hex().ljust(64, "0"), word(1) + word(32) + word(2) + "beef".ljust(64, "0"), word(len(text)) + text.hex().ljust(64, "0"),
    ]
    at, offsets = 9 * 32, []
    for p in parts:
        offsets.append(at)
        at += len(p) // 2
    head = [word(9001), word(0xAB), *(word(o) for o in offsets[:4]), word(10), word(20), word(offsets[4])]
    found = decode.decoded_log([decode.topic0(decode.EVENTS["governor"][0])], "0x" + "".join(head + parts))
    assert found["proposal_id"] == "9001" and found["signatures"] == ["f()"] and found["calldatas"] == ["0xbeef"] and found["values"] == ["5"] and found["description"] == "# Title\nBody"


def test_decodes_both_transfers_and_rejects_the_rest():
    topic = decode.topic0(decode.EVENTS["token"][2])
    a, b = "0x" + word(1), "0x" + word(2)
    assert decode.decoded_log([topic, a, b], "0x" + word(7))["standard"] == "erc20"
    assert decode.decoded_log([topic, a, b, "0x" + word(9)], "0x")["value"] == "9"
    assert decode.decoded_log(["0x" + "1" * 64], "0x") is None
    assert decode.decoded_log([topic, a], "0x") is None


def test_route_and_decode(spark):
    topic = decode.topic0(decode.EVENTS["token"][1])
    rows = [(5, "0xh", 100, "0xT", 0, 1, "0xTOKEN", [topic, "0x" + word(3)], "0x" + word(1) + word(8), False), (5, "0xh", None, "0xT", 0, 2, "0xTOKEN", ["0x" + "2" * 64], "0x", False), (5, "0xh", 1, "0xT", 0, 3, "0xTOKEN", [topic], "0x", True)]
    raw = spark.createDataFrame(rows, logs.RAW_LOG)
    typed = decode.decoded(decode.routed(decode.normalized(raw, 1), spark.createDataFrame([("0xtoken", "token")], "address string, role string")))
    assert typed.count() == 2
    event = decode.events_of(typed, decode.EVENTS["token"][1]).select("id", "event.new_votes", "block_timestamp_ms").collect()
    assert [tuple(r) for r in event] == [("evm:1:5:0xt:0:1", "8", 100_000)]


def test_duplicates_must_agree(spark):
    same = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "id string, v int")
    assert decode.deduplicated(same).count() == 2
    with pytest.raises(Exception, match="differ"):
        decode.deduplicated(same.union(spark.createDataFrame([("a", 3)], same.schema))).collect()


def test_titles():
    assert descriptions.title_of("intro\n#  Real title \nrest") == "Real title"
    assert descriptions.title_of("<b>[RFC] Pay  the [team](http://x)</b>\nmore") == "RFC: Pay  the team"
    assert descriptions.title_of("- " + "x" * 60) == "x" * 50 + "..."
    assert descriptions.title_of("") == "" and descriptions.body_of("# A\nb\n") == "b" and descriptions.body_of("a") == "a"


def test_tags(spark):
    df = spark.createDataFrame([('x <discussion> http://d </discussion><signature>["f()"]</signature>',), ("none",), (None,)], "t string")
    out = df.select(descriptions.tag(F.col("t"), "discussion"), descriptions.signatures(F.col("t"))).collect()
    assert [tuple(r) for r in out] == [("http://d", ["f()"]), (None, []), (None, [])]


def test_scalars(spark):
    df = spark.createDataFrame([("seed:1",)], "t string")

    def fnv(s):
        h = 2166136261
        for c in s:
            h = (h ^ ord(c)) * 16777619 % 2**32
        return h

    assert df.select(scalars.fnv1a(F.col("t"))).first()[0] == fnv("seed:1")
    shown = spark.createDataFrame([(1234567.0,), (999.5,), (0.0,), (2.5e12,)], "v double").select(scalars.display_number(F.col("v"))).collect()
    assert [r[0] for r in shown] == ["1.23M", "999.5", "0", "2.5T"]


def test_filters_check_numbers_first():
    with pytest.raises(ValueError):
        checked_numeric("007")
    with pytest.raises(ValueError):
        condition({"OR": [{"power_lt": "-1"}]}, numeric=frozenset(["power"]))


def test_ranges(spark):
    assert [tuple(r) for r in logs.range_plan(spark, 10, 25, 10).orderBy("from_block").collect()] == [(10, 19), (20, 25)]
    with pytest.raises(ValueError):
        logs.range_plan(spark, 5, 4, 10)


def test_pages_come_in_two_shapes(spark):
    row = '{"block_number": 1, "log_index": 0, "address": "0xA", "topics": ["0x1"], "data": "0x"}'
    df = spark.createDataFrame([(f"[{row}]",), ('{"rows": [' + row + "]}",), ("[]",)], "payload string")
    assert logs.unwrapped_pages(df).count() == 2


def test_append_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, "b"), (2, "b")], "k int, s string")
    for _ in range(2):
        sinks.append_parquet(rows, str(tmp_path / "t"), ["k", "s"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_few_texts_are_strings_at_once():
    import tracemalloc

    import pyarrow as pa

    texts = pa.array([None, *(f"# Title {k}\n" + "x" * 10_000 for k in range(3000))])
    tracemalloc.start()
    try:
        bodies = descriptions.body.func(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(bodies) == 3001 and bodies[0].as_py() is None and set(bodies[1:].to_pylist()) == {"x" * 10_000}
    assert peak < 15e6  # of 30 MB of texts
