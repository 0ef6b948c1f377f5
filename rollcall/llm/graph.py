"""Connected components of an undirected graph whose edges are rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.frames import few, written

#: Edges that a task connects at once; only speed and memory depend on it.
CHUNK = 500_000
_SCHEMA = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def connected(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges, ascending, and the smallest node that each is connected to by them."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x, y in zip(at[: len(u)].tolist(), at[len(u) :].tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return nodes, nodes[[root(x) for x in range(len(nodes))]]


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) as stars: a row (node, smallest node connected to it) for each node but the smallest ones, chunk by chunk.

    Where a chunk ends between the edges of one u, the next one has that u's row of it too, so that of edges sorted by u all of a node meet.
    """
    held, n = [], 0

    def told() -> tuple[pa.RecordBatch, list[tuple[np.ndarray, np.ndarray]]]:
        u, v = (np.concatenate(x) for x in zip(*held, strict=True))
        nodes, least = connected(u, v)
        moved, last = nodes != least, u[-1:]
        rows = pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(least[moved])], schema=_SCHEMA)
        return rows, [(last, least[np.searchsorted(nodes, last)])]

    for batch in batches:
        if batch.num_rows:
            held.append((batch.column("u").to_numpy(), batch.column("v").to_numpy()))
            n += batch.num_rows
        if n >= CHUNK:
            rows, held = told()
            n = 0
            yield rows
    if n:
        yield told()[0]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge between different nodes; the component is its smallest node.

    Tasks make stars of the edges that they have, then of all edges of the nodes dealt to them; a star whose centre belongs to another one is
    hung on the smallest centre that it has there. That is repeated until no node has two centres and no centre another one. Each task sends
    a row for a node at most, so that a hub's edges come together only as one row from each task. Rows with a null end and loops are
    ignored; repeated edges don't matter. What a round leaves is written in few files, however many partitions shuffles have.
    """
    found = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u != v")
    now = found.mapInArrow(stars, "u long, v long")
    while True:
        now = written(few(now.repartition("u").sortWithinPartitions("u").mapInArrow(stars, "u long, v long"), 1))
        centres = now.select(F.col("v").alias("node")).distinct().withColumns({"n": F.lit(0), "least": F.lit(None).cast("long"), "centre": F.lit(True)})
        nodes = now.select(F.col("u").alias("node"), F.lit(1).alias("n"), F.col("v").alias("least"), F.lit(False).alias("centre")).union(centres)
        roles = nodes.groupBy("node").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("centre").alias("centre"))
        unsettled = written(few(roles.where("n > 1 OR n = 1 AND centre"), 1))
        if unsettled.isEmpty():
            break
        hung = unsettled.where("centre").select("node", "least")
        now = now.join(hung, now.v == hung.node, "left").select("u", F.coalesce("least", "v").alias("v"))
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
