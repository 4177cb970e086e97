"""Queries of the training-data operators and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm.fingerprints import fingerprint_neighbours
from tessera.llm.language_crf import identify_languages
from tessera.llm.lattice_lm import score_documents
from tessera.llm.mixing import mix_sources
from tessera.llm.near_dups import near_duplicates
from tessera.llm.ordinal import grade_documents, train_ordinal
from tessera.llm.packing import best_fit_pack
from tessera.llm.quality_rules import quality_rules
from tessera.llm.secrets import scan_secrets, span_text
from tessera.llm.wrappers import extract_pages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rated_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, grade): 0 toxic, 1 of low quality, 2 good; documents without a label aren't in it."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    marks = labels.select(F.col("doc_id").alias("rated_id"), grade.alias("grade"))
    return docs.join(marks, docs["doc_id"] == marks["rated_id"]).select("text", "grade")


def op1_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_ordinal(rated_documents(docs, _table(spark, sf_dir, "labels")), 3)
    graded = grade_documents(docs, model)
    return graded.select("doc_id", "expected_grade", F.col("tails")[0].alias("p_not_toxic"), F.col("tails")[1].alias("p_good"), "kept")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(_table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base_found", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(span_text(F.col("base_found")), 256).alias("base_sha256"), span_text(F.col("found")).alias("spans"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance"
    )


def op7_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents"))


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_neighbours(_table(spark, sf_dir, "documents"))


def op9_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_table(spark, sf_dir, "documents"))


def op10_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ordinal_quality": op1_ordinal_quality,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_mix_sources": op4_mix_sources,
    "op5_secret_scan": op5_secret_scan,
    "op6_quality_rules": op6_quality_rules,
    "op7_lattice_lm": op7_lattice_lm,
    "op8_order_minhash": op8_order_minhash,
    "op9_language_crf": op9_language_crf,
    "op10_wrapper_extraction": op10_wrapper_extraction,
}

ORACLES: dict[str, str] = {}
