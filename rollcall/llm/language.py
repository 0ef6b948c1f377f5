"""Language ID by nearest centroid.

Texts become normalised TF-IDF vectors of hashed byte trigrams. Each language has several centroids from
spherical k-means; a text takes the language of the centroid with the highest cosine. A text that is
farther from its centroid than almost all training texts is marked as rejected.

The model is fitted on a bounded sample: the ``PER_LANGUAGE`` labelled training rows of each language that come
first by a hash of their id and their text. Each language is clustered in a task of its own. Prediction reads every whole text.

Nulls and edges: a text that is null or has no letter gets ``und`` and score 0; so does every text if no
row can be learned from; rows without a language are not learned from; repeated rows get equal answers and are learned once; a null id is held for
training like the text 'null' would be and predicted like any other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollcall.llm.frames import arrow_type, emitted, rows_of, written

#: Training rows of one language, at most.
PER_LANGUAGE = 400
#: Parts of a language where its rows meet its level.
LEVEL_PARTS = 64
CENTROIDS = 4
BITS = 12
#: Share of the training texts that lie beyond the distance at which a text is rejected.
REJECTED_SHARE = 0.01
UNKNOWN = "und"
SEGMENT = 1 << 20
_SPACE = np.arange(256, dtype=np.uint8)
_SPACE[[b for b in range(128) if not chr(b).isalpha()]] = 32


def trigram_counts(texts: list[str], bits: int = BITS) -> np.ndarray:
    """A row of hashed trigram counts for each text; very long texts are added up by segments."""
    counts = np.zeros((len(texts), 1 << bits), np.float32)
    for k, text in enumerate(texts):
        raw = _SPACE[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)]
        for at in range(0, len(raw) - 2, SEGMENT):
            part = raw[at : at + SEGMENT + 2].astype(np.uint32)
            code = (part[:-2] << 16) | (part[1:-1] << 8) | part[2:]
            code = code[code != 0x202020]
            counts[k] += np.bincount((code * np.uint32(2654435761)) >> np.uint32(32 - bits), minlength=1 << bits)
    return counts


def unit_rows(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF with damped counts."""
    return unit_rows(np.log1p(counts) * idf)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    limits: np.ndarray  # least cosine of each centroid's language
    idf: np.ndarray

    def predict(self, texts: list[str | None]) -> Iterator[tuple[str, float, bool]]:
        """Language, score and whether the text is rejected, for each text."""
        good = [k for k, t in enumerate(texts) if has_letter(t)] if self.languages else []
        found: list[tuple[str, float, bool]] = [(UNKNOWN, 0.0, True)] * len(texts)
        if good:
            cosines = weighted(trigram_counts([texts[k] for k in good]), self.idf) @ self.centroids.T
            best = cosines.argmax(axis=1)
            for k, b, c in zip(good, best, cosines[np.arange(len(good)), best], strict=True):
                found[k] = self.languages[b], float(min(max(c, 0.0), 1.0)), bool(c < self.limits[b])
        yield from found


def clustered(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of spherical k-means; the first row, then always the one farthest from all chosen, are the seeds."""
    chosen = [0]
    while len(chosen) < min(k, len(rows)):
        chosen.append(int((rows @ rows[chosen].T).max(axis=1).argmin()))
    centroids = rows[chosen]
    for _ in range(rounds):
        nearest = (rows @ centroids.T).argmax(axis=1)
        centroids = unit_rows(np.stack([rows[nearest == c].mean(axis=0) if (nearest == c).any() else centroids[c] for c in range(len(centroids))]))
    return centroids


def centroids(counts: np.ndarray, idf: np.ndarray, k: int = CENTROIDS) -> tuple[np.ndarray, float]:
    """The centroids of one language's training texts, and the least cosine of a text that isn't rejected."""
    rows = weighted(counts, idf)
    own = clustered(rows, k).astype(np.float32)
    return own, float(np.quantile((rows @ own.T).max(axis=1), REJECTED_SHARE))


def held_out(id_col: str) -> F.Column:
    """Whether a row is kept from training: by the checksum of its id's text."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int) -> DataFrame:
    """(lang, text) of at most ``per_language`` rows of each language; rows that repeat an id and a text count once. No text of a held-out row is read.

    A row's level is the length in bits of its hash, so that each level down holds half as many rows. Counts by level tell up to which one
    a language has enough rows; only those rows, about twice as many as are taken, are ranked. Languages are dealt to parts where rows meet their level.
    """
    text = F.col(text_col)
    usable = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & text.isNotNull())
    usable = usable.select(F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col).cast("string"), text).alias("key"), text.alias("text"))
    level = F.length(F.bin(F.col("key").bitwiseXOR(F.lit(-(1 << 63)))))  # the least hash counts from 0 on
    keys = written(usable.select("lang", "key").distinct().withColumn("level", level))
    up_to = Window.partitionBy("lang").orderBy("level")
    filled = keys.groupBy("lang", "level").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(up_to) - F.col("n"))
    parts = F.explode(F.sequence(F.lit(0), F.lit(LEVEL_PARTS - 1))).alias("part")
    limits = filled.where(F.col("before") < per_language).groupBy("lang").agg(F.max("level").alias("most")).select("lang", "most", parts)
    few = keys.withColumn("part", F.pmod("key", F.lit(LEVEL_PARTS)).cast("int")).join(limits, ["lang", "part"]).where("level <= most")
    first = Window.partitionBy("lang").orderBy("key")
    chosen = few.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= per_language).select("lang", "key").distinct()
    return usable.join(written(chosen), ["lang", "key"], "left_semi").groupBy("lang", "key").agg(F.first("text").alias("text"))


def language_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Fits on at most ``per_language`` rows of each language. Texts stay in tasks; the driver gets document frequencies and centroids."""

    def counted(rows: pa.Table) -> pa.Table:
        lang, texts = rows.column("lang")[0].as_py(), sorted(t for t in rows.column("text").to_pylist() if has_letter(t))
        found = [(np.flatnonzero(c), c[c > 0]) for t in texts for c in trigram_counts([t])]
        return pa.table({"lang": pa.array([lang] * len(found), pa.string()), "nth": pa.array(range(len(found)), pa.int32()), "codes": pa.array([a.tolist() for a, _ in found], pa.list_(pa.int32())), "n": pa.array([n.tolist() for _, n in found], pa.list_(pa.float32()))})

    counts = written(training_rows(docs, id_col, text_col, lang_col, per_language).groupBy("lang").applyInArrow(counted, "lang string, nth int, codes array<int>, n array<float>"))
    often = np.zeros(1 << BITS)
    for r in counts.select(F.explode("codes").alias("code")).groupBy("code").count().collect():  # 2^BITS rows at most
        often[r["code"]] = r["count"]
    idf = (np.log((1 + counts.count()) / (1 + often)) + 1).astype(np.float32)

    def learned(rows: pa.Table) -> pa.Table:
        dense = np.zeros((rows.num_rows, 1 << BITS), np.float32)
        for k, codes, n in sorted(zip(*(rows.column(c).to_pylist() for c in ("nth", "codes", "n")), strict=True)):
            dense[k, codes] = n
        own, limit = centroids(dense, idf)
        return pa.table({"lang": [rows.column("lang")[0].as_py()], "limit": [limit], "centroids": [own.tobytes()]})

    found = sorted(counts.groupBy("lang").applyInArrow(learned, "lang string, limit double, centroids binary").collect())  # CENTROIDS rows of a fixed size for each language
    own = [np.frombuffer(r["centroids"], np.float32).reshape(-1, 1 << BITS) for r in found]
    languages = [r["lang"] for r, c in zip(found, own, strict=True) for _ in c]
    limits = [r["limit"] for r, c in zip(found, own, strict=True) for _ in c]
    return Model(languages, np.concatenate([np.zeros((0, 1 << BITS), np.float32), *own]), np.array(limits), idf)


def identify_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Model | None = None) -> DataFrame:
    """Per row: id, held_out, lang_pred, score and rejected. Predictions see nothing but the text."""
    model = model or language_model(docs, id_col, text_col, lang_col)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = pa.schema([("doc_id", arrow_type(docs, id_col)), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    some = list(rows_of([batch.slice(at, 64)], "doc_id", "held_out", "body"))
                    for (doc_id, held, _), answer in zip(some, model.predict([r[2] for r in some]), strict=True):
                        yield doc_id, held, *answer

        return emitted(rows(), schema)

    chosen = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("body"))
    return chosen.mapInArrow(predicted, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean").withColumnRenamed("doc_id", id_col)


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document."""
    from rollcall.llm.frames import table

    return identify_language(table(spark, sf_dir, "documents"))
