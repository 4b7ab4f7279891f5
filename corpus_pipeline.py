"""A corpus cleaned and packed by five of the operators, one stage after the other.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next stage's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mutspan.llm import exact_dedup, ngram_join, packing, quality, substring_dedup
from mutspan.llm.common import staged, table, vocabulary_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    rated = quality.rated(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))
    return rated.where(F.col("score") >= 0.7).select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the largest id of each group of equal texts."""
    return exact_dedup.without_copies(docs.select(*COLUMNS), keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of similar documents: five words a shingle, 0.8."""
    found = ngram_join.similar_documents(docs, gram=5, percent=80)
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("first")).distinct()
    rows = docs.select(*COLUMNS)
    return rows.join(first, rows["doc_id"].eqNullSafe(first["first"]), "left_semi")


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated passages; one that loses no word keeps its text, one that loses all goes."""
    cleaned = substring_dedup.cleaned(docs.select(*COLUMNS))
    changed = F.col("n_removed") > 0
    left = cleaned.where(~changed | (F.col("kept") != "")).withColumn("text", F.when(changed, F.col("kept")).otherwise(F.col("row.text")))
    return left.select("row.doc_id", "text", "row.lang", "row.source", F.length("text").cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 ids."""
    return packing.packed_documents(docs, vocabulary_path())


STAGES = [
    ("quality", keep_good),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("substring_dedup", drop_repeats),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
