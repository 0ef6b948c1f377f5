"""Components of graphs with hubs, long chains, loops and nulls."""

import random
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rollcall.llm import shingles
from rollcall.llm.graph import components
from rollcall.llm.minhash import signatures


def plain_components(edges):
    low = {}

    def root(x):
        while low.setdefault(x, x) != x:
            x = low[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = root(a), root(b)
            low[max(a, b)] = min(a, b)
    return {x: root(x) for x in low}


def test_components_with_hubs(spark):
    pick = random.Random(5)
    edges = [(50, k) for k in range(100, 400)] + [(k, k + 1) for k in range(1000, 1030)] + [(pick.randrange(2000, 2200), pick.randrange(2000, 2200)) for _ in range(150)]
    edges += [(k, 5000) for k in range(4900, 5000)] + [(7, 7), (None, 8), (9, None), (50, 100), (120, 4950)]
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(found) == len({r.node for r in found})
    assert {r.node: r.component for r in found} == plain_components(edges)


def test_components_without_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_search_takes_few_shuffles(spark):
    """A shuffle costs the driver a plan and the disk a file from each task, however few its rows are; two stars and a short chain once took 159 stages, now 13."""
    edges = spark.createDataFrame([(1, k) for k in range(100, 400)] + [(k, 5000) for k in range(4900, 5000)] + [(k, k + 1) for k in range(1000, 1008)], "a long, b long")
    context, group = spark.sparkContext, "components"
    context.setJobGroup(group, group)
    try:
        found = {r.node: r.component for r in components(edges).collect()}
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    assert found == plain_components([tuple(r) for r in edges.collect()]) and len(stages) <= 40


@pytest.fixture()
def many_partitions(spark):
    """As where shuffles have many partitions, and none are put together."""
    put = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    had = {k: spark.conf.get(k) for k in put}
    for k, v in put.items():
        spark.conf.set(k, v)
    yield
    for k, v in had.items():
        spark.conf.set(k, v)


def test_a_search_writes_few_files(spark, many_partitions):
    """Each file that an executor makes costs it processes; with a file for each partition of each round, a check saw an executor twice while it made one."""
    files = lambda: sum(1 for _ in Path(spark.conf.get("spark.checkpoint.dir")).rglob("part-*"))
    edges = [(1, k) for k in range(100, 400)] + [(k, 5000) for k in range(4900, 5000)] + [(k, k + 1) for k in range(1000, 1008)]
    before = files()
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == plain_components(edges) and files() - before <= 64


def test_stages_of_the_pipeline_leave_few_partitions(spark, many_partitions):
    docs = spark.createDataFrame([(k, f"text {k}", "en", "host", 6) for k in range(500)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.chosen(docs, docs.select("doc_id", (F.col("doc_id") % 3 == 0).alias("kept")).repartition(64, "doc_id"))
    assert kept.rdd.getNumPartitions() <= 24 and sorted(r.doc_id for r in kept.collect()) == list(range(0, 500, 3))


def test_workers_forget_words(spark):
    """Words remembered by tasks that are over stay in an executor's memory for all later stages."""
    docs = spark.createDataFrame([(k, " ".join(f"w{k * 100 + i}" for i in range(100))) for k in range(200)], "doc_id long, text string").repartition(4)
    assert signatures(docs, "doc_id", "text").where("n_shingles = 96").count() == 200

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(shingles._HASHES)] * batch.num_rows, pa.int64())})

    assert {r.n for r in spark.range(40, numPartitions=4).mapInArrow(held, "n long").collect()} == {0}
