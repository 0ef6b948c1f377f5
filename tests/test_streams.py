"""Streams with state, versions and block ranges against batch results and plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from rollcall.operators import folds
from rollcall.sources import block_log as source
from rollcall.sources.block_log import BlockReader, Options, block_log, block_stream, planned
from rollcall.sources.versions import VersionedTable
from rollcall.streaming import jobs, state
from rollcall.streaming.keyed import DelegationFold, RefreshTasks
from rollcall.streaming.rules import RETRYABLE, Rules, is_retryable
from test_folds import SCHEMA, history, sequential

LOG = "delegator long, pos long, at_ms long, kind string, from_delegate string, to_delegate string, delta string"


def delegations(rows):
    return [(int(w[1:]), p, 1000 * p, k, s, t, str(d)) for w, p, k, s, t, d in rows]


def split_files(spark, rows, schema, parts, at):
    """Each part as a file of its own, in this order."""
    for k, part in enumerate(parts):
        spark.createDataFrame([rows[i] for i in part], schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
        import os
        import time

        for name in os.listdir(f"{at}/in"):
            path = f"{at}/in/{name}"
            if name.endswith(".parquet") and not os.path.exists(f"{at}/seen-{name}"):
                open(f"{at}/seen-{name}", "w").close()
                os.utime(path, (time.time() - 1000 + k, time.time() - 1000 + k))


@pytest.mark.parametrize("seed", [1, 2])
def test_keyed_state_over_any_split(spark, tmp_path, seed):
    rows = history(seed, 120)
    r = random.Random(seed)
    order = sorted(range(len(rows)), key=lambda k: k + r.randrange(25))  # out of order within the watermark's delay
    parts = [order[k : k + 40] for k in range(0, len(order), 40)] + [order[80:90], []]  # some rows come again
    split_files(spark, delegations(rows), LOG, [p for p in parts if p], str(tmp_path))
    stream = jobs.log_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], LOG).schema)
    fold = DelegationFold(zero="zero")
    kept = VersionedTable(spark, str(tmp_path / "kept"), ["delegator"], fold.told, buckets=4)
    query = jobs.keep_folded(stream, str(tmp_path / "cp"), fold, "60 seconds", kept, gone=~F.col("is_current"), partitions=2)
    assert {f"a{r.delegator}": (r.delegate, int(r.power)) for r in kept.read().collect()} == sequential(rows)
    assert len(kept.versions()) >= 4
    assert sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in query.recentProgress if p["stateOperators"]) <= 10  # second readings
    before = kept.versions()
    jobs.keep_folded(stream, str(tmp_path / "cp"), fold, "60 seconds", kept, gone=~F.col("is_current"), partitions=2)  # a restart finds nothing new
    assert kept.versions() == before


def test_delegation_steps_as_in_batch(spark):
    for seed in range(4):
        rows = history(seed, 200)
        for saturating in (False, True):
            fold, states = DelegationFold("zero", saturating), {}
            for who, _, kind, source_, to, delta in rows:
                fold.step(states.setdefault(who, fold.start()), {"kind": kind, "from_delegate": source_, "to_delegate": to, "delta": str(delta)})
            assert {w: (t["delegate"], int(t["power"])) for w, s in states.items() if (t := fold.tell(w, s))["is_current"]} == sequential(rows, saturating)


def test_a_dead_batch_leaves_one_version(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), ["k"], "k long, v string", buckets=3)
    rows = lambda xs: spark.createDataFrame(xs, "k long, v string")
    assert table.read().count() == 0 and table.upsert(rows([(k, "a") for k in range(20)]), "s", 0)

    def dies():
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        table.upsert(rows([(3, "b"), (99, "b")]), "s", 1, before_commit=dies)
    assert table.versions() == [0] and table.read().where("v = 'b'").count() == 0
    reader = table.read()
    assert table.upsert(rows([(3, "b"), (99, "b")]), "s", 1) and not table.upsert(rows([(3, "c")]), "s", 1)  # the replay is one version, a second replay none
    assert reader.where("k = 3").first().v == "a" and dict(map(tuple, table.read().collect())) == {k: "a" for k in range(20)} | {3: "b", 99: "b"}
    untouched = set(table.manifest(0)["folders"].items()) & set(table.manifest(1)["folders"].items())
    assert table.versions() == [0, 1] and len(untouched) >= 1  # other buckets keep their files
    assert table.upsert(rows([(3, None)]), "s", 2, gone=F.col("v").isNull()) and table.read().where("k = 3").isEmpty()
    table.clear(keep=1)
    import os

    assert table.versions() == [2] and set(os.listdir(tmp_path / "t" / "data")) == set(table.manifest()["folders"].values())
    assert table.read().count() == 20


def test_of_two_writers_one_fails(spark, tmp_path):
    one, two = (VersionedTable(spark, str(tmp_path / "t"), ["k"], "k long") for _ in range(2))
    with pytest.raises(RuntimeError, match="another writer"):
        one.upsert(spark.createDataFrame([(1,)], "k long"), "s", 0, before_commit=lambda: two.upsert(spark.createDataFrame([(2,)], "k long"), "x", 0))
    assert [r.k for r in one.read().collect()] == [2]


def test_append_takes_each_key_once(spark, tmp_path):
    rows = [(k % 7, k, "x") for k in range(30)]
    split_files(spark, rows, "d long, pos long, v string", [range(20), range(10, 30)], str(tmp_path))
    table = VersionedTable(spark, str(tmp_path / "t"), ["pos"], "d long, pos long, v string", ["d"], 4)
    jobs.append_logs(jobs.log_stream(spark, str(tmp_path / "in"), table.schema), str(tmp_path / "cp"), table)
    assert sorted(map(tuple, table.read().collect())) == sorted(rows)


def test_promotion_leaves_state_when_the_height_passes(spark, tmp_path):
    rows = [(k, "v") for k in range(0, 300)]
    split_files(spark, rows, "pos long, v string", [range(100), range(100, 200), range(200, 300)], str(tmp_path))
    out = []
    stream = jobs.log_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], "pos long, v string").schema)
    query = jobs.run_available(jobs.promoted(stream, ["pos"], "pos", 30), str(tmp_path / "cp"), lambda b, n: out.append((n, sorted(r.pos for r in b.collect()))), partitions=2)
    assert [p for _, ps in out for p in ps] == list(range(270))
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert held[-1] == 30 and max(held) <= 130


def test_second_readings_count_for_nothing_and_state_is_bounded(spark, tmp_path):
    rows = [(k, "v") for k in range(400)]
    parts = [range(k, k + 50) for k in range(0, 400, 50)]
    split_files(spark, rows, "pos long, v string", [p for k, q in enumerate(parts) for p in ([q, parts[k - 1]] if k else [q])], str(tmp_path))
    out = []
    stream = jobs.log_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], "pos long, v string").schema)
    query = jobs.run_available(jobs.deduplicated(stream, ["pos"], "pos", 120), str(tmp_path / "cp"), lambda b, n: out.extend(r.pos for r in b.collect()), partitions=2)
    assert sorted(out) == list(range(400))
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) <= 300


def test_late_rows_correct_what_was_told(spark, tmp_path):
    rows = [(int(w[1:]), *rest) for w, *rest in history(5, 150)]
    order = [k for k in range(150) if k % 5] + [k for k in range(150) if k % 5 == 0]
    split_files(spark, rows, SCHEMA.replace("delegator string", "delegator long"), [order[:50], order[50:110], order[110:150], order[140:]], str(tmp_path))
    log = VersionedTable(spark, str(tmp_path / "log"), ["pos"], "delegator long, pos long, kind string, from_delegate string, to_delegate string, delta long, late boolean", ["delegator"], 4)
    snapshot = VersionedTable(spark, str(tmp_path / "snap"), ["delegator"], "delegator long, delegate string, power long, n_late long", buckets=4)
    stream = jobs.log_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA.replace("delegator string", "delegator long")).schema)
    jobs.corrected(stream, str(tmp_path / "cp"), log, snapshot, 10, "zero")
    found = snapshot.read().collect()
    assert {f"a{r.delegator}": (r.delegate, r.power) for r in found if r.delegate is not None} == sequential(history(5, 150))
    top = max(order[:50])
    late = {k for k in order[50:110] if k <= top - 10} | {k for k in order[110:150] if k <= max(order[:110]) - 10}
    assert sum(r.n_late for r in found) == len(late) > 20 and log.read().count() == 150


def tasks_of(rows, rules, watermark):
    """Each account's events one by one; leases end in between and up to the watermark."""
    fold, held = RefreshTasks(rules), {}
    for account, pos, at, kind, block, error in sorted(rows, key=lambda r: (r[2], r[1])):
        fold.taken(held.setdefault(account, fold.start()), [{"pos": pos, "at_ms": at, "kind": kind, "block": block, "error": error}])
    return {a: fold.taken(s, [], watermark) for a, s in held.items()}


def test_tasks_in_state(spark, tmp_path):
    r = random.Random(3)
    rows = [(r.randrange(5), k, 1000 * k, r.choice(["seen", "seen", "run", "run", "ok", "error"]), k, r.choice(["Rate Limit hit", "reverted", None])) for k in range(240)]
    rules = Rules(debounce_ms=3000, lease_ms=9000, retry_ms=2000, max_attempts=2)
    split_files(spark, rows, "account long, pos long, at_ms long, kind string, block long, error string", [range(80), range(80, 160), range(160, 240)], str(tmp_path))
    fold = RefreshTasks(rules)
    kept = VersionedTable(spark, str(tmp_path / "kept"), ["account"], fold.told)
    jobs.keep_folded(jobs.log_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], "account long, pos long, at_ms long, kind string, block long, error string").schema), str(tmp_path / "cp"), fold, "5 seconds", kept, partitions=2)
    expected = tasks_of(rows, rules, 1000 * 239 - 5000)
    assert {x.account: (x.status, x.attempts, x.next_run_at, x.again, x.last_block, x.error) for x in kept.read().collect()} == {a: tuple(s[c] for c in ("status", "attempts", "next_run_at", "again", "last_block", "error")) for a, s in expected.items()}


def test_a_stale_lock_ends_by_its_timer(spark, tmp_path):
    rows = [(1, 0, 0, "seen", 0, None), (1, 1, 2000, "run", 0, None), (2, 2, 30_000, "seen", 7, None)]  # account 1 has no rows after its lock
    split_files(spark, rows, "account long, pos long, at_ms long, kind string, block long, error string", [[0, 1], [2]], str(tmp_path))
    fold = RefreshTasks(Rules(debounce_ms=1000, lease_ms=5000, retry_ms=100, max_attempts=1))
    kept = VersionedTable(spark, str(tmp_path / "kept"), ["account"], fold.told)
    jobs.keep_folded(jobs.log_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], "account long, pos long, at_ms long, kind string, block long, error string").schema), str(tmp_path / "cp"), fold, "1 second", kept, partitions=2)
    assert {x.account: (x.status, x.locked_at) for x in kept.read().collect()} == {1: ("exhausted", None), 2: ("pending", None)}


def test_burst_lock_and_rearm():
    rules, task = Rules(debounce_ms=10, lease_ms=50, retry_ms=5, max_attempts=3), RefreshTasks(Rules()).start()
    for at in (0, 4, 8):
        rules.enqueued(task, at, at)
    rules.claimed(task, 17)
    assert task["status"] == "pending" and task["next_run_at"] == 18  # the burst put it off
    rules.claimed(task, 18)
    rules.enqueued(task, 20, 30)
    assert (task["status"], task["again"], task["again_block"], task["next_run_at"]) == ("processing", True, 30, 18)
    rules.completed(task, 25)
    assert (task["status"], task["attempts"], task["next_run_at"], task["last_block"], task["again"]) == ("pending", 0, 35, 30, False)
    rules.claimed(task, 35)
    rules.completed(task, 40)
    rules.enqueued(task, 41, 30)
    assert task["status"] == "completed"  # nothing newer
    rules.enqueued(task, 42, 31)
    assert task["status"] == "pending"


def test_pauses_and_restored_tasks(spark):
    rules = Rules(retry_ms=10, lease_ms=100, max_attempts=3)
    assert [rules.pause(k) for k in (-1, 0, 1, 2, 3, 6, 7, 99)] == [10, 10, 10, 20, 40, 320, 320, 320]
    shown = spark.createDataFrame([(k,) for k in (-1, 0, 1, 2, 3, 6, 7, 99)], "k int").select(state.pause(F.col("k"), 10).alias("p")).collect()
    assert [r.p for r in shown] == [10, 10, 10, 20, 40, 320, 320, 320]
    shape = "id int, status string, attempts int, next_run_at long, locked_at long, locked_by string, updated_at long, processed_at long, error string"
    rows = [
        (1, "exhausted", 3, 5, None, None, 0, 7, "HISTORICAL state of block is Not Available"), (2, "exhausted", 3, 5, None, None, 0, 7, "historical state"), (3, "processing", 3, 5, 900, "w", 0, None, "rate limit"), (4, "processing", 3, 5, 901, "w", 0, None, "x"),
        (5, "processing", 3, 5, 900, "w", 0, None, None), (6, "failed", 3, 5, None, None, 0, None, "x"), (7, "processing", 2, 5, 1, "w", 0, None, "x"), (8, "failed", 2, 5, None, None, 0, None, "x"),
    ]
    found = {r.id: tuple(r)[1:] for r in state.swept(spark.createDataFrame(rows, shape), F.lit(1000), 100, 10, 3).collect()}
    assert found[1] == ("failed", 2, 1040, None, None, 1000, None, rows[0][-1]) and found[2] == rows[1][1:] and found[3] == ("failed", 2, 1040, None, None, 1000, None, "rate limit")
    assert found[4] == rows[3][1:] and found[5] == ("exhausted", 3, 5, None, None, 1000, 1000, None) and found[6] == ("exhausted", 3, 5, None, None, 1000, 1000, "x") and found[7] == rows[6][1:] and found[8] == rows[7][1:]


def test_errors_after_which_tasks_go_on():
    for parts in RETRYABLE:
        assert is_retryable("RPC: " + " x ".join(parts).upper()) and not is_retryable(parts[0][1:])
    assert not is_retryable(None) and not is_retryable("header not found") and not is_retryable("timeout") and not is_retryable("historical state")


def test_claims_by_queue(spark):
    shape = "id int, status string, attempts int, next_run_at long, locked_at long, locked_by string, updated_at long"
    rows = [(k, "pending", 0, k, None, None, 0) for k in range(20)] + [(100 + k, "failed", 1, k, None, None, 0) for k in range(3)] + [(200 + k, "processing", 1, 0, 10 + k, "w", 0) for k in range(9)]
    rows += [(300, "failed", 3, 0, None, None, 0), (301, "processing", 3, 0, 1, "w", 0), (302, "pending", 0, 5000, None, None, 0), (303, "processing", 1, 0, None, "w", 0), (304, "completed", 0, 0, None, None, 0)]
    tasks = spark.createDataFrame(rows, shape)

    def plain(n):
        queues = [sorted((r[3], r[6], r[0]) for r in rows if (r[1] == "processing" and r[4] is not None and r[4] <= 16 and r[2] < 3 if q == 0 else r[1] == "failed" and r[2] < 3 if q == 1 else r[1] == "pending") and r[3] <= 116) for q in range(3)]
        rest, taken = n, []
        for share in (-(-n // 3), n):
            for q in queues:
                k = min(share, rest, len(q))
                taken += q[:k]
                del q[:k]
                rest -= k
        return sorted(x[2] for x in taken)

    for n in (1, 2, 3, 4, 7, 10, 16, 17, 29, 60):
        found = state.claimed(tasks, F.lit(116), n, 100).collect()
        assert sorted(r.id for r in found) == plain(n) and all((r.status, r.locked_at, r.locked_by, r.updated_at) == ("processing", 116, "worker", 116) for r in found)


def test_ranges_are_planned_and_pruned():
    spans = [("a", 0, 99), ("b", 100, 149), ("c", 5000, 5010)]
    parts = planned(spans, 0, 5010, 100)
    assert [(p.first, p.last, p.files) for p in parts] == [(0, 99, ("a",)), (100, 199, ("b",)), (5000, 5010, ("c",))]
    assert planned(spans, 200, 4000, 10) == [] and [(p.first, p.last) for p in planned(spans, 95, 105, 4)] == [(95, 98), (99, 102), (103, 105)]


def test_block_source_in_batch(spark, tmp_path):
    rows = [(k, k % 3, f"k{k % 4}") for k in range(1000)]
    spark.createDataFrame(rows, "pos long, d long, kind string").repartitionByRange(5, "pos").write.parquet(str(tmp_path / "log"))
    log = block_log(spark, str(tmp_path / "log"), "pos", width=100)
    assert sorted(map(tuple, log.collect())) == rows and log.rdd.getNumPartitions() >= 10
    some = log.where((F.col("pos") > 149) & (F.col("pos") < 320) & F.col("kind").isin("k1", "k2") & (F.col("d") == 1))
    assert some.rdd.getNumPartitions() <= 3 and sorted(r.pos for r in some.collect()) == [k for k in range(150, 320) if k % 4 in (1, 2) and k % 3 == 1]
    assert [r.pos for r in block_log(spark, str(tmp_path / "log"), "pos", from_=990, to=991).collect()] == [990, 991] and log.where("pos = 5").count() == 1 and log.where("pos > 5000").count() == 0
    with pytest.raises(ValueError):
        Options.of({"path": "x", "from": "5", "to": "4"})
    reader = BlockReader(Options.of({"path": "x", "height": "pos"}), log.schema)
    left = list(reader.pushFilters([source.GreaterThan(("pos",), 9), source.EqualTo(("kind",), "a"), source.LessThan(("d",), 3)]))
    assert left == [source.LessThan(("d",), 3)] and reader.options.first == 10


def test_block_source_as_a_stream(spark, tmp_path):
    shape = "pos long, v string"
    spark.createDataFrame([(k, "a") for k in range(250)], shape).repartition(3).write.parquet(str(tmp_path / "log"))
    seen = []
    stream = lambda **o: block_stream(spark, str(tmp_path / "log"), "pos", batch=100, width=30, **o)
    bounded = {"checkpoint": str(tmp_path / "cp")}
    each = lambda b, n: seen.append((n, sorted(r.pos for r in b.collect())))
    jobs.run_available(stream(**bounded), str(tmp_path / "cp"), each)
    assert [p for _, p in seen] == [list(range(100)), list(range(100, 200)), list(range(200, 250))]
    spark.createDataFrame([(k, "b") for k in range(250, 470)], shape).write.mode("append").parquet(str(tmp_path / "log"))
    jobs.run_available(stream(**bounded), str(tmp_path / "cp"), each)  # goes on after what was committed, in bounded batches
    assert [p for _, p in seen[3:]] == [list(range(250, 350)), list(range(350, 450)), list(range(450, 470))]
    spark.createDataFrame([(k, "c") for k in range(470, 700)], shape).write.mode("append").parquet(str(tmp_path / "log"))
    jobs.run_available(stream(), str(tmp_path / "cp"), each)
    assert [x for _, p in seen[6:] for x in p] == list(range(470, 700))


def test_batch_and_stream_folds_agree(spark):
    rows = history(9, 200)
    batch = folds.mappings(folds.delegation_fold(spark.createDataFrame(rows, SCHEMA), zero="zero")).collect()
    assert {r.delegator: (r.delegate, r.power) for r in batch} == sequential(rows)


class CountedState:
    """A key's state as a handle gives it, with a note of each call."""

    def __init__(self):
        self.value, self.calls = None, []

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def registerTimer(self, at):
        self.calls.append(at)


def test_a_key_costs_one_reading_and_one_writing_of_its_state():
    fold, handle = RefreshTasks(Rules(debounce_ms=1, lease_ms=100, retry_ms=1, max_attempts=1)), CountedState()
    fold.init(handle)
    row = lambda pos, kind: {"pos": pos, "at_ms": 10 * pos, "kind": kind, "block": pos, "error": None}
    told = fold.moved(1, [row(2, "run"), row(1, "seen"), row(3, "seen")], 10)
    assert (told.status, told.locked_at, told.again) == ("processing", 20, True) and handle.calls == ["get", "update", 121]  # rows wait, the one timer is that of the lease
    told = fold.moved(1, [row(3, "seen"), row(4, "ok")], 35)  # one row comes again
    assert (told.status, told.last_block) == ("pending", 3) and handle.calls[3:] == ["get", "update"]


def test_short_ranges_share_a_partition(spark, tmp_path):
    rows = [(k, k % 3) for k in range(1000)]
    spark.createDataFrame(rows, "pos long, d long").repartitionByRange(3, "pos").write.parquet(str(tmp_path / "log"))
    log = block_log(spark, str(tmp_path / "log"), "pos", width=7, rows=300)
    assert log.rdd.getNumPartitions() == 4 and sorted(map(tuple, log.collect())) == rows  # of 294 blocks each, where one for each range is 143
    assert source.widened([("a", 0, 99, 2.0), ("b", 50, 149, 1.0)], 10, 100) == 30 and source.widened([("a", 0, 9, 50.0)], 10, 100) == 10
