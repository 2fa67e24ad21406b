"""The registered queries of the operators, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchpulse.llm import (
    byte_bpe,
    chat_format,
    decontamination,
    language_id,
    line_dedup,
    merkle,
    packing,
    quality_classifier,
    quality_rules,
    ranked_search,
    simhash_dedup,
    suffix_dedup,
    warc,
)
from matchpulse.llm.common import numbered, remainder
from matchpulse.sources.staging import new_folder, staged

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def sha256(column) -> F.Column:
    return F.sha2(F.coalesce(column, F.lit("")).cast("binary"), 256)


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words hit in every document, and the items found there."""
    documents, items = _documents(spark, sf_dir), _read(spark, sf_dir, "benchmark")
    return decontamination.contamination(documents, items, window=10).drop("row")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    documents = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = remainder("doc_id", 4) == 2
    model = language_id.fit(documents, train=~held_out)
    found = language_id.identified(documents.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes removed from every document because 100 bytes around them stand earlier too."""
    table = staged(_documents(spark, sf_dir), "repeats-documents")
    kept = suffix_dedup.without_repeats(table, length=100)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash_dedup.near_duplicates(_documents(spark, sf_dir), shingle=4, distance=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from its examples."""
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = _read(spark, sf_dir, "conversations").select(own.columns).unionByName(own)
    return chat_format.conversation_digests(chat_format.examples(turns))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines dropped from every document, and the digest of the lines that stay."""
    rest = F.struct(F.lit(None).cast("string").alias("none"))
    table = staged(_documents(spark, sf_dir).withColumn("rest", rest), "lines-documents")
    kept = line_dedup.deduplicated_lines(table, least=40, least_documents=5)
    return kept.select("doc_id", "n_lines", "n_dropped", sha256(F.col("text")).alias("kept_sha256"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score and prediction of every document."""
    documents = _documents(spark, sf_dir)
    return quality_classifier.quality_scores(documents, _read(spark, sf_dir, "labels")).drop("row")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return packing.packed(_documents(spark, sf_dir))


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of the archives written from all pages, read back."""
    folder = new_folder(spark, "warc")
    warc.write_archives(_read(spark, sf_dir, "pages"), folder, least=100)
    return warc.read_archives(spark, folder).drop("url")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    documents = _documents(spark, sf_dir)
    found = quality_rules.rule_verdicts(documents, _read(spark, sf_dir, "labels"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return found.select("doc_id", *counts, "base_failed", "kept")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document; a third shows a text with lowered letters."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.coalesce(remainder("doc_id", 3) == 0, F.lit(False))
    shown = merkle.leaves(_read(spark, sf_dir, "documents").select(*fields), fields, tampered)
    proof = merkle.proof_digest(F.col("proof")).alias("proof_sha256")
    verified = F.col("folded_root") == F.col("root")
    return merkle.manifest(shown).select("doc_id", "leaf", "subroot", "root", proof, "folded_root", verified.alias("verified"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    items = numbered(_read(spark, sf_dir, "benchmark").select("item_id", "text"), "item")
    return ranked_search.search(_documents(spark, sf_dir), items, best=10).drop("item")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the bytes decoded from them."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = byte_bpe.round_trip(_documents(spark, sf_dir), path, public_tokenizers.PATTERN)
    ids = F.sha2(F.col("ids_text").cast("binary"), 256).alias("ids_sha256")
    return found.select("doc_id", "n_tokens", ids, F.sha2("decoded", 256).alias("decoded_sha256"))


REGISTRY: dict[str, Query] = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_language_id": op2_language_id,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_line_dedup": op6_line_dedup,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_warc_revisits": op9_warc_revisits,
    "op10_quality_rules": op10_quality_rules,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_ranked_search": op12_ranked_search,
    "op13_byte_bpe": op13_byte_bpe,
}
