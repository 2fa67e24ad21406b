"""The corpus pipeline: quality filter, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; its result is
written as Parquet and read again as the next one's docs. All stages but the last return the columns of
documents. Extra columns of docs go through unchanged, whatever their names. A null text is an empty one: scored
by the classifier, without lines to drop, of fingerprint zero, clean, and one end token. Rows with equal ids are
separate documents until near-dedup, where the smallest id (then any one row) of a group stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchpulse.llm import decontamination, line_dedup, packing, quality_classifier, simhash_dedup
from matchpulse.llm.common import numbered
from matchpulse.sources.staging import staged


def _folded(docs: DataFrame) -> DataFrame:
    """doc_id, text, rest (the other columns of docs), so that no other column's name can clash."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*(others or [F.lit(None).cast("string").alias("none")]))
    return docs.select("doc_id", "text", rest.alias("rest"))


def _unfolded(folded: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of docs again; ``changed`` gives some of them anew."""
    return folded.select(
        *(changed.get(c, F.col(c if c in ("doc_id", "text") else f"rest.`{c}`")).alias(c) for c in docs.columns)
    )


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    trees = quality_classifier.fit_documents(numbered(docs.select("doc_id", "text")), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _unfolded(quality_classifier.accepted(_folded(docs), trees), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many others hold; a document may lose all its text."""
    kept = line_dedup.deduplicated_lines(staged(numbered(_folded(docs)), "pipeline-lines"))
    if "n_chars" not in docs.columns:
        return _unfolded(kept, docs)
    length = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("rest.n_chars")).cast("long")
    return _unfolded(kept, docs, n_chars=length)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates."""
    return _unfolded(simhash_dedup.first_of_each(_folded(docs)), docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _unfolded(decontamination.clean_documents(_folded(docs), items), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.packed(numbered(docs.select("doc_id", "text")))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("best-fit packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after the other over documents; the last one's result, written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
