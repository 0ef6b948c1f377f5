"""A corpus pipeline of five operators: quality rules, line dedup, near-dedup, substring dedup, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its result is
written as Parquet and read again. All but the last return the columns of ``documents``, in few partitions, as each becomes a file.

Nulls and edges: a null or empty text breaks the base rules (it has fewer than 10 words), so the first stage drops it. A null
source is the host with the empty name in the rules; a null lang passes through. Rows that repeat an id are one document to the
stages that drop documents: all of them stay if one is kept. A null id stays a null id, and the near and substring stages
leave its rows as they are. Other columns than those of ``documents`` are left out. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm.frames import few, table, written
from rollcall.llm.line_dedup import MIN_COPY, dedup_lines
from rollcall.llm.minhash import near_duplicates
from rollcall.llm.packing import pack_documents
from rollcall.llm.quality import quality_rules
from rollcall.llm.substring_dedup import dedup_substrings

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def chosen(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id has a row in ``verdicts`` that says kept."""
    kept = verdicts.where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return few(docs.select(*COLUMNS).join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return chosen(docs, quality_rules(docs))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that stand earlier in the corpus."""
    found = dedup_lines(docs, carry=("lang", "source"), min_copy=MIN_COPY)
    return few(found.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars")))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates."""
    return chosen(docs, near_duplicates(docs))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the stretches of 50 bytes and more that an earlier one has."""
    found = dedup_substrings(docs.select(*COLUMNS))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in windows, a row for each piece."""
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("minhash_near_dedup", near_stage),
    ("suffix_array_dedup", substring_stage),
    ("packing", packing_stage),
]

#: The stages rest on hashes, tokenizers and graph searches; they are tested against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs
