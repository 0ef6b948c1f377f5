"""Near-duplicate embeddings by quantised tile products.

Equal vectors of a label first become one class. The classes are sorted into tiles; pairs of tiles of one label
meet in one task, which gets int8 codes, scales and the norms of the rounding errors, multiplies the codes and adds a
rigorous bound of each pair's quantisation error. It returns a compressed bitmap of the pairs that may reach the threshold.
Only the vectors that stand in such pairs are fetched in double precision, and those pairs are computed again. That task returns
link counts and a spanning forest of its links, never the links themselves.

Nulls and edges: a vector that is null, empty, zero or holds null or non-finite components, or whose
label or id is null, links with nothing and is its own component. Vectors of different lengths don't
link. A repeated row is another vector with the same id. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.frames import checkpointed, emitted, rows_of, written
from rollcall.llm.graph import components

THRESHOLD = 0.98
TILE = 2048
PROJECTIONS = 8
#: For rounding in double precision, so that the bounds stay rigorous.
SLACK = 1e-9
#: Into how many groups the tiles of a label are dealt where pairs of them are sought.
GROUPS = 64
#: Pairs that are computed again at once.
AGAIN = 1 << 17


def quantised(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, the scale of each vector, and the norm of its rounding error, for unit rows."""
    scale = np.abs(rows).max(axis=1) / 127
    codes = np.rint(rows / scale[:, None])
    return codes.astype(np.int8), scale, np.linalg.norm(rows - codes * scale[:, None], axis=1)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision."""
    rows = vectors.astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def possible(a: tuple[np.ndarray, np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray, np.ndarray], threshold: float, same: bool) -> np.ndarray:
    """Which pairs of quantised rows may reach the threshold (only i < j if both tiles are the same): no other pair can."""
    (ca, sa, ea), (cb, sb, eb) = a, b
    kind = np.float32 if ca.shape[1] * 127 * 127 < 1 << 24 else np.float64  # either holds the integer products exactly
    ca, cb = ca.astype(kind), cb.astype(kind)
    bound = (ca @ cb.T).astype(np.float64)
    bound *= sa[:, None]
    bound *= sb[None, :]
    na, nb = (np.sqrt(np.einsum("ij,ij->i", c, c, dtype=np.float64)) * s for c, s in ((ca, sa), (cb, sb)))
    bound += ea[:, None] * (nb + eb)[None, :]
    bound += na[:, None] * eb[None, :]
    maybe = bound >= threshold - SLACK
    if same:
        maybe &= np.tri(len(ca), k=-1, dtype=bool).T
    return maybe


def reaching(ua: np.ndarray, ub: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the cosine of each pair (i, j) of unit rows reaches the threshold, in double precision."""
    sure = np.zeros(len(i), bool)
    for at in range(0, len(i), AGAIN):
        part = slice(at, at + AGAIN)
        sure[part] = np.einsum("ij,ij->i", ua[i[part]], ub[j[part]]) >= threshold
    return sure


def linked_pairs(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD, same: bool = False) -> tuple[np.ndarray, np.ndarray, int]:
    """Index pairs of rows whose cosine reaches the threshold (only i < j if both tiles are the same), and how many were computed again."""
    ua, ub = unit(a), unit(b)
    i, j = np.nonzero(possible(quantised(ua), quantised(ub), threshold, same))
    sure = reaching(ua, ub, i, j, threshold)
    return i[sure], j[sure], len(i)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that it is connected with."""
    low = np.arange(n)
    while True:
        least = np.minimum(low[i], low[j])
        new = low.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        np.minimum.at(new, low, new)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def projections(dim: int) -> np.ndarray:
    """Fixed unit directions, a column each."""
    grid = np.cos(np.outer(np.arange(1, dim + 1) ** 2, np.arange(1, PROJECTIONS + 1)) * 0.7)
    return grid / np.linalg.norm(grid, axis=0, keepdims=True)


def tiles(classes: DataFrame, tile: int) -> DataFrame:
    """The classes, ordered by label, length and a projection, in tiles of at most ``tile`` vectors; a row for each tile."""
    n = classes.count()
    # by the greatest component first, so that no square of a tiny or huge one is lost
    scaled = classes.withColumn("top", F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double")))))
    size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + (x.cast("double") / F.col("top")) * (x.cast("double") / F.col("top"))))
    along = F.aggregate(F.transform("embedding", lambda x, k: x.cast("double") / F.col("top") * F.cos(0.7 * (k + 1) * (k + 1))), F.lit(0.0), lambda s, x: s + x) / size
    placed = scaled.select("cid", "n", F.col("label").cast("string").alias("label"), "embedding", F.size("embedding").alias("dim"), along.alias("along"))
    placed = placed.repartitionByRange(max(1, math.ceil(n / tile)), "label", "dim", "along", "cid").sortWithinPartitions("label", "dim", "along", "cid")
    schema = pa.schema([("tile", pa.int64()), ("label", pa.string()), ("dim", pa.int32()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("ids", pa.binary()), ("counts", pa.binary()), ("codes", pa.binary()), ("scales", pa.binary()), ("errors", pa.binary()), ("vectors", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32

        def rows() -> Iterator[tuple]:
            held: list[tuple] = []
            count = 0

            def made() -> tuple:
                vectors = np.array([r[3] for r in held], np.float64)
                rows = unit(vectors)
                along = rows @ projections(vectors.shape[1])
                return first + count, held[0][2], held[0][4], along.min(axis=0).tolist(), along.max(axis=0).tolist(), np.array([r[0] for r in held], np.int64).tobytes(), np.array([r[1] for r in held], np.int64).tobytes(), *(x.tobytes() for x in quantised(rows)), vectors.tobytes()

            for row in rows_of(batches, "cid", "n", "label", "embedding", "dim"):
                if held and (len(held) >= tile or row[2] != held[0][2] or row[4] != held[0][4]):
                    yield made()
                    count += 1
                    held.clear()
                held.append(row)
            if held:
                yield made()

        return emitted(rows(), schema, 4)

    return placed.mapInArrow(cut, "tile long, label string, dim int, lo array<double>, hi array<double>, ids binary, counts binary, codes binary, scales binary, errors binary, vectors binary")


def opened(packed: bytes, na: int, nb: int) -> np.ndarray:
    """The bitmap of a pair of tiles."""
    return np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8), count=na * nb).reshape(na, nb).astype(bool)


def tile_rows(raw: list[bytes], dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, counts and vectors of a tile."""
    return np.frombuffer(raw[0], np.int64), np.frombuffer(raw[1], np.int64), np.frombuffer(raw[2], np.float64).reshape(-1, dim)


def tile_links(made: DataFrame, threshold: float) -> DataFrame:
    """(cid, n_links, root) for every class with links, once for each pair of tiles that holds some."""
    near = math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    meta = made.select("tile", "label", "dim", "lo", "hi")
    a = meta.select("label", "dim", F.pmod(F.xxhash64("tile"), F.lit(GROUPS)).cast("int").alias("dealt"), F.col("tile").alias("ta"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"))
    b = meta.select("label", "dim", F.explode(F.sequence(F.lit(0), F.lit(GROUPS - 1))).alias("dealt"), F.col("tile").alias("tb"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"))
    meet = F.forall(F.arrays_zip("lo_a", "hi_a", "lo_b", "hi_b"), lambda z: (z["lo_a"] <= z["hi_b"] + near) & (z["lo_b"] <= z["hi_a"] + near))
    pairs = a.join(b, ["label", "dim", "dealt"]).where((F.col("ta") <= F.col("tb")) & meet).select("ta", "tb", "dim")
    side = lambda x, *columns: made.select(F.col("tile").alias(f"t{x}"), *(F.col(c).alias(f"{c}_{x}") for c in columns))
    coded = pairs.join(side("a", "codes", "scales", "errors"), "ta").join(side("b", "codes", "scales", "errors"), "tb")
    coded = coded.select("ta", "tb", "dim", "codes_a", "scales_a", "errors_a", "codes_b", "scales_b", "errors_b")

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for k in range(batch.num_rows):
                    ta, tb, dim, *raw = (c[k].as_py() for c in batch.columns)
                    a, b = ((np.frombuffer(c, np.int8).reshape(-1, dim), np.frombuffer(s, np.float64), np.frombuffer(e, np.float64)) for c, s, e in (raw[:3], raw[3:]))
                    maybe = possible(a, b, threshold, ta == tb)
                    if maybe.any():
                        yield ta, tb, dim, maybe.shape[0], maybe.shape[1], zlib.compress(np.packbits(maybe).tobytes(), 1)

        return emitted(rows(), pa.schema([("ta", pa.int64()), ("tb", pa.int64()), ("dim", pa.int32()), ("na", pa.int32()), ("nb", pa.int32()), ("maybe", pa.binary())]), 256)

    maybe = written(coded.mapInArrow(bounded, "ta long, tb long, dim int, na int, nb int, maybe binary"))
    of_a = maybe.join(side("a", "ids", "counts", "vectors"), "ta").select("ta", "tb", "dim", "na", "nb", "maybe", "ids_a", "counts_a", "vectors_a")

    halves = pa.schema([("ta", pa.int64()), ("tb", pa.int64()), ("dim", pa.int32()), ("na", pa.int32()), ("nb", pa.int32()), *((c, pa.binary()) for c in ("maybe", "ids_a", "counts_a", "vectors_a"))])

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the first tile only the rows that stand in pairs."""

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for k in range(batch.num_rows):
                    ta, tb, dim, na, nb, packed, *own = (c[k].as_py() for c in batch.columns)
                    at = np.flatnonzero(opened(packed, na, nb).any(axis=1))
                    ids, counts, vectors = tile_rows(own, dim)
                    yield ta, tb, dim, na, nb, packed, ids[at].tobytes(), counts[at].tobytes(), vectors[at].tobytes()

        return emitted(rows(), halves, 8)

    met = of_a.mapInArrow(needed, of_a.schema).join(side("b", "ids", "counts", "vectors"), "tb")
    met = met.select("dim", "na", "nb", "maybe", "ids_a", "counts_a", "vectors_a", "ids_b", "counts_b", "vectors_b")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for k in range(batch.num_rows):
                    dim, na, nb, packed, *raw = (c[k].as_py() for c in batch.columns)
                    pairs = opened(packed, na, nb)
                    pairs = pairs[pairs.any(axis=1)]
                    (ids_a, counts_a, va), (ids_b, counts_b, vb) = tile_rows(raw[:3], dim), tile_rows(raw[3:], dim)
                    at = np.flatnonzero(pairs.any(axis=0))
                    i, j = np.nonzero(pairs[:, at])
                    ids_b, counts_b = ids_b[at], counts_b[at]
                    sure = reaching(unit(va), unit(vb[at]), i, j, threshold)
                    i, j = i[sure], j[sure]
                    if not len(i):
                        continue
                    ids, back = np.unique(np.concatenate([ids_a[i], ids_b[j]]), return_inverse=True)
                    n_links = np.zeros(len(ids), np.int64)
                    np.add.at(n_links, back, np.concatenate([counts_b[j], counts_a[i]]))
                    yield from zip(ids.tolist(), n_links.tolist(), ids[forest(len(ids), back[: len(i)], back[len(i) :])].tolist(), strict=True)

        return emitted(rows(), pa.schema([("cid", pa.int64()), ("n_links", pa.int64()), ("root", pa.int64())]), 8192)

    return met.mapInArrow(links, "cid long, n_links long, root long")


def embedding_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """Per row: id, n_links (other vectors with the same label and a cosine of ``threshold`` or more),
    component_id (the smallest id that links reach) and kept (whether it is its component's smallest).
    """
    e = F.col(vector_col)
    good = F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & F.coalesce(F.forall(e, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("vid"), F.col(label_col).alias("label"), e.alias("embedding"), good.alias("good"))
    keyed = rows.withColumns({"k1": F.xxhash64("label", "embedding"), "k2": F.xxhash64(F.lit(1), "embedding", "label")})
    classes = keyed.where("good").groupBy("k1", "k2").agg(F.min(F.col("vid").cast("long")).alias("cid"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    classes = written(classes)
    found = checkpointed(tile_links(written(tiles(classes.select("cid", "n", "label", "embedding"), tile)), threshold))
    linked = found.groupBy("cid").agg(F.sum("n_links").alias("linked"))
    reached = components(found, "cid", "root")
    of_class = classes.select("k1", "k2", "cid", "n").join(linked, "cid", "left").join(reached, F.col("cid") == F.col("node"), "left")
    of_class = of_class.select("k1", "k2", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "cid").alias("component"))
    members = keyed.where("good").select("vid", "k1", "k2").join(of_class, ["k1", "k2"]).select("vid", "n_links", F.col("component").cast(vectors.schema[id_col].dataType).alias("component_id"))
    alone = keyed.where("not good").select("vid", F.lit(0).cast("long").alias("n_links"), F.col("vid").alias("component_id"))
    both = members.unionByName(alone)
    return both.select(F.col("vid").alias(id_col), "n_links", "component_id", F.col("vid").eqNullSafe(F.col("component_id")).alias("kept"))


def op6_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    """All of ``embeddings`` against each other within their labels."""
    from rollcall.llm.frames import table

    return embedding_duplicates(table(spark, sf_dir, "embeddings"))
