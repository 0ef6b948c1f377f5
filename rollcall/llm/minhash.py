"""MinHash near-duplicates with b-bit signatures.

A document's set of word shingles gets 160 minima. Bands of five minima generate candidates; of each minimum
only the two low bits are kept, packed into longs, and the similarity of a candidate pair is
estimated from bit counts, corrected for chance collisions. Whatever may reach the threshold is
confirmed on the full sets.

No group of documents becomes rows of pairs. Equal sets are one class. In a first round each class meets the most
popular member of its buckets. Then only buckets are left whose members links don't connect yet. Their members' signatures alone meet in tiles, inside tasks, which
return a forest of the likely pairs; what likely pairs connect is a cluster, however many chance buckets join it to others. Only the members of clusters meet again with their
texts, in tiles, inside tasks that return the links which connect them. In either step members of the group's largest component meet the others, not each other. A pair at
the threshold shares no bucket with a probability of about 7e-9.

Nulls and edges: a document without words or text is empty and links with nothing; one with a null id
too, and its component is null; rows that repeat an id are judged by their own texts, where the id is one node of the
graph; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm.frames import checkpointed, emitted, few, integer_ids, rows_of, utf8, written
from rollcall.llm.graph import components
from rollcall.llm.shingles import forget, mixed, shared, shingle_sets

BANDS, ROWS = 32, 5
MINIMA = BANDS * ROWS
BITS = 2
LONGS = MINIMA * BITS // 64
#: Classes in a tile of a cluster, and of a bucket, whose members come without texts.
TILE, SIGNATURE_TILE = 256, 2048
#: By how much the estimate of a pair at the threshold may fall short: six standard deviations.
MARGIN = 0.2
_RANDOM = np.random.default_rng(20)
_FACTORS = _RANDOM.integers(0, 1 << 31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_TERMS = _RANDOM.integers(0, 1 << 32, MINIMA, dtype=np.uint32)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set that is not empty."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        values = x[at : at + 2048, None] * _FACTORS
        values ^= values >> np.uint32(15)
        values += _TERMS
        np.minimum(least, values.min(axis=0), out=least)
    return least


def packed(least: np.ndarray) -> list[int]:
    """The low bits of the minima in signed 64-bit integers."""
    bits = (least.astype(np.uint64) & np.uint64((1 << BITS) - 1)).reshape(LONGS, -1)
    return np.bitwise_or.reduce(bits << (np.arange(bits.shape[1], dtype=np.uint64) * np.uint64(BITS)), axis=1).view(np.int64).tolist()


def band_keys(least: np.ndarray) -> list[int]:
    key = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T.astype(np.uint64):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + row)
    return key.view(np.int64).tolist()


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: doc_id, text_key, n_shingles, a digest of the set (d1, d2), the packed signature and the band keys."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    some = list(rows_of([batch.slice(at, 64)], "doc_id", "text_key", "body"))
                    for (doc_id, text_key, _), s in zip(some, shingle_sets([r[2] for r in some]), strict=True):
                        if len(s):
                            least = minima(s)
                            digest = (int(x.sum(dtype=np.uint64).astype(np.int64)) for x in (mixed(s), mixed(s ^ np.uint64(0x5851F42D4C957F2D))))
                            yield doc_id, text_key, len(s), *digest, packed(least), band_keys(least)
                        else:
                            yield doc_id, text_key, 0, 0, 0, None, None
            forget()  # the worker's memory is for other tasks now

        return emitted(rows(), schema, 2048)

    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("signature", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))])
    return keyed_texts(docs, id_col, text_col).mapInArrow(signed, "doc_id long, text_key long, n_shingles long, d1 long, d2 long, signature array<long>, bands array<long>")


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key, body): rows that repeat an id are told apart by a hash of the text."""
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("body"))
    return chosen.select("doc_id", F.xxhash64("body").alias("text_key"), "body")


def estimate(a: str, b: str) -> Column:
    """Similarity of two packed signatures, corrected for low bits that agree by chance."""
    differs = None
    for k in range(LONGS):
        x = F.col(a)[k].bitwiseXOR(F.col(b)[k])
        n = F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
        differs = n if differs is None else differs + n
    chance = 2.0**-BITS
    return ((1 - differs / MINIMA) - chance) / (1 - chance)


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    mine = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("body").alias("body_a")), "a").select("a", "b", "body_a")
    met = mine.join(texts.select(F.col("doc_id").alias("b"), F.col("body").alias("body_b")), "b").select("a", "b", "body_a", "body_b")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            last, theirs = None, None
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    some = batch.slice(at, 64)
                    ids_a, ids_b, bodies_b = some.column("a").to_pylist(), some.column("b").to_pylist(), some.column("body_b")
                    for k, own in enumerate(shingle_sets(some.column("body_a").to_pylist())):
                        if ids_b[k] != last:
                            last, theirs = ids_b[k], shingle_sets([bodies_b[k].as_py()])[0]
                        n = shared(own, theirs)
                        if 100 * n >= percent * (len(own) + len(theirs) - n):
                            yield ids_a[k], ids_b[k]
            forget()

        return emitted(rows(), schema)

    return met.mapInArrow(compared, "a long, b long")


def star_pairs(met: DataFrame) -> DataFrame:
    """Each class with the most popular other class of its buckets. ``met``: (key, rep, n), n classes in the bucket."""
    popular = met.groupBy("rep").agg(F.sum("n").alias("popular"))
    ranked = met.select("key", "rep").join(popular, "rep")
    pivots = ranked.groupBy("key").agg(F.max(F.struct("popular", (-F.col("rep")).alias("minus"))).alias("pivot"))
    offered = met.select("key", "rep").join(pivots, "key").where(F.col("rep") != -F.col("pivot.minus"))
    best = offered.groupBy("rep").agg(F.max("pivot").alias("pivot"))
    return best.select(F.col("rep").alias("a"), (-F.col("pivot.minus")).alias("b"))


def dealt_tiles(members: DataFrame, group: str, tile: int) -> DataFrame:
    """Members of groups with several components ``c``, a row for each pair (lo, hi) of tiles of their group that they meet in.

    The members of a group's largest component have tiles of their own, which meet those of the others but not each other, so that a member
    is copied once for each tile of others.
    """
    sizes = members.groupBy(group, "c").agg(F.count("*").alias("n"))
    most = sizes.groupBy(group).agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n_all")).where("n_main < n_all")
    tiles = most.select(group, "main", F.ceil((F.col("n_all") - F.col("n_main")) / tile).cast("int").alias("others"), F.ceil(F.col("n_main") / tile).cast("int").alias("mains"))
    rows = members.join(tiles, group)
    is_main, place = F.col("c") == F.col("main"), F.xxhash64(F.col("rep"), F.lit(7))
    own = F.when(is_main, F.col("others") + F.pmod(place, F.col("mains"))).otherwise(F.pmod(place, F.col("others"))).cast("int")
    meets = F.sequence(F.lit(0), F.when(is_main, F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1)
    rows = rows.withColumn("tile", own).withColumn("other", F.explode(meets))
    return rows.withColumns({"lo": F.least("tile", "other"), "hi": F.greatest("tile", "other")}).drop("main", "others", "mains", "other")


def likely_pairs(packs: np.ndarray, c: np.ndarray, tiles: np.ndarray, lo: int, hi: int, low: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, js, how many minima differ) for each member i of the tile ``lo`` and those of ``hi`` in other components whose estimate reaches ``low``."""
    most = int((1 - low) * (1 - 2.0**-BITS) * MINIMA)  # minima that may differ
    others = np.flatnonzero(tiles == hi)
    for i in np.flatnonzero(tiles == lo).tolist():
        rest = others[(c[others] != c[i]) & ((lo != hi) | (others > i))]
        x = packs[rest] ^ packs[i]
        differ = np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(axis=1, dtype=np.int64)
        near = differ <= most
        yield i, rest[near], differ[near]


class Forest:
    """Which of some nodes are connected."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def joined(self, x: int, y: int) -> bool:
        """Connects two nodes; false if they were connected."""
        x, y = self.root(x), self.root(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


def likely_clusters(met: DataFrame, reached: DataFrame, classes: DataFrame, low: float) -> DataFrame:
    """(cluster, rep, c) of the classes that likely pairs of different components c connect, by their signatures alone.

    Each open bucket's members meet in tiles; a task returns a forest of its likely pairs, a pair for each member at most.
    """
    component = reached.withColumnRenamed("node", "rep")
    placed = met.select("key", "rep").join(component, "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("c"))
    opened = placed.join(placed.groupBy("key").agg(F.min("c").alias("least"), F.max("c").alias("greatest")).where("least < greatest"), "key").select("key", "rep", "c")
    dealt = dealt_tiles(opened.join(classes.select("rep", "signature"), "rep"), "key", SIGNATURE_TILE)

    def forest(rows: pa.Table) -> pa.Table:
        rows = rows.take(pa.array(np.argsort(rows.column("rep").to_numpy())))
        reps, tiles, c = (rows.column(n).to_numpy() for n in ("rep", "tile", "c"))
        packs = np.array(rows.column("signature").to_pylist(), np.int64).view(np.uint64).reshape(-1, LONGS)
        known, pairs = Forest(len(reps)), []
        for i, js, _ in likely_pairs(packs, c, tiles, rows.column("lo")[0].as_py(), rows.column("hi")[0].as_py(), low):
            pairs += [(i, j) for j in js.tolist() if known.joined(i, j)]
        return pa.table({x: pa.array(reps[[p[k] for p in pairs]] if pairs else [], pa.int64()) for k, x in enumerate("ab")})

    edges = dealt.select("key", "lo", "hi", "tile", "rep", "c", "signature").groupBy("key", "lo", "hi").applyInArrow(forest, "a long, b long")
    clusters = components(written(few(edges)))  # else a task has two Python workers, and an executor keeps them all
    return clusters.select(F.col("node").alias("rep"), F.col("component").alias("cluster")).join(component, "rep", "left").select("cluster", "rep", F.coalesce("component", "rep").alias("c"))


def cluster_links(opened: DataFrame, classes: DataFrame, texts: DataFrame, percent: int, low: float) -> DataFrame:
    """Links (a, b) that connect whatever belongs together in the clusters.

    A cluster's members are dealt to tiles, and each pair of tiles meets in one task. That compares the packed signatures,
    and confirms likely pairs on the full sets, best estimates first, unless they are connected already.
    """
    dealt = dealt_tiles(opened, "cluster", TILE).join(classes.select("rep", "text_key", "signature"), "rep").join(texts.withColumnRenamed("doc_id", "rep"), ["rep", "text_key"])
    dealt = dealt.select("cluster", "lo", "hi", "tile", "rep", "c", "signature", "body")

    def linked(rows: pa.Table) -> pa.Table:
        rows = rows.take(pa.array(np.argsort(rows.column("rep").to_numpy())))
        reps, tiles = rows.column("rep").to_pylist(), rows.column("tile").to_numpy()
        packs = np.array(rows.column("signature").to_pylist(), np.int64).view(np.uint64).reshape(-1, LONGS)
        names, c = np.unique(rows.column("c").to_numpy(), return_inverse=True)
        known, bodies, sets = Forest(len(names)), rows.column("body"), {}

        def of(k: int) -> np.ndarray:
            if k not in sets:
                sets[k] = shingle_sets([bodies[k].as_py()])[0]
            return sets[k]

        near = [(d, i, j) for i, js, differ in likely_pairs(packs, c, tiles, rows.column("lo")[0].as_py(), rows.column("hi")[0].as_py(), low) for d, j in zip(differ.tolist(), js.tolist(), strict=True)]
        found = []
        for _, i, j in sorted(near):
            if known.root(c[i]) != known.root(c[j]):
                a, b = of(i), of(j)
                n = shared(a, b)
                if 100 * n >= percent * (len(a) + len(b) - n):
                    known.joined(c[i], c[j])
                    found.append((reps[i], reps[j]))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return dealt.groupBy("cluster", "lo", "hi").applyInArrow(linked, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, margin: float = MARGIN) -> DataFrame:
    """Per row: id, n_shingles, component_id (the smallest id that links reach) and kept (whether it is that one).

    Two documents are linked if their sets share ``percent`` of their union or more. Ids are integers; others are an error.
    """
    integer_ids(docs, id_col)
    signed = written(signatures(docs, id_col, text_col))
    usable = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = written(few(usable.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "text_key")).alias("rep"), F.first("signature").alias("signature"), F.first("bands").alias("bands")).select("d1", "d2", F.col("rep.doc_id").alias("rep"), "rep.text_key", "signature", "bands")))
    in_bands = classes.select("rep", F.explode("bands").alias("key"))
    filled = in_bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = written(few(in_bands.join(filled, "key").select("key", "rep", "n")))
    taking_part = met.select("rep").distinct().join(classes.select("rep", "text_key"), "rep").select(F.col("rep").alias("doc_id"), "text_key")
    texts = written(few(keyed_texts(docs, id_col, text_col).join(taking_part, ["doc_id", "text_key"], "left_semi").dropDuplicates(["doc_id", "text_key"])))
    low = percent / 100 - margin

    def likely(pairs: DataFrame) -> DataFrame:
        for x in "ab":
            pairs = pairs.join(classes.select(F.col("rep").alias(x), F.col("signature").alias(f"s_{x}")), x)
        return pairs.where(estimate("s_a", "s_b") >= low).select("a", "b")

    first = checkpointed(few(confirmed(likely(star_pairs(met)), texts, percent)))
    second = checkpointed(few(cluster_links(likely_clusters(met, components(first), classes, low), classes, texts, percent, low)))
    reached = components(first.union(second))
    of_class = classes.select("d1", "d2", "rep").join(reached, F.col("rep") == F.col("node"), "left").select("d1", "d2", F.coalesce("component", "rep").alias("component"))
    known = usable.select("doc_id", "n_shingles", "d1", "d2").join(of_class, ["d1", "d2"]).select("doc_id", "n_shingles", "component")
    alone = signed.where("NOT (n_shingles > 0 AND doc_id IS NOT NULL)").select("doc_id", "n_shingles", F.col("doc_id").alias("component"))
    return known.unionByName(alone).select(F.col("doc_id").alias(id_col), "n_shingles", F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))


def op8_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """All of ``documents``, linked from 85 per cent on."""
    from rollcall.llm.frames import table

    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)
