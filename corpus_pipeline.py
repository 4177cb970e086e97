"""The training-corpus pipeline: quality rules, near-dedup, secret scan, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last return
the columns of ``documents``.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.llm.mixing import BLOCK, mix_draws
from tessera.llm.near_dups import BROADCAST_IDS, near_duplicates
from tessera.llm.packing import best_fit_pack
from tessera.llm.quality_rules import quality_rules
from tessera.llm.secrets import redact, scan_secrets
from tessera.llm.text import word_array
from tessera.session import cut, ensure_checkpoint_dir, remove_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the divergence rules keep.

    Null, empty and blank texts have no words and go. Every row is judged for itself: repeated rows stay or go
    together, nulls in other columns don't matter. No tie can arise.
    """
    # packed and unpacked, so that the verdict isn't pushed into the scan and worked out once a reference
    judged = quality_rules(docs).select(F.explode(F.array(F.struct(*COLUMNS, "kept"))).alias("row"))
    return judged.where("row.kept").select(*[F.col(f"row.{c}").alias(c) for c in COLUMNS])


def _sent(ids: DataFrame) -> DataFrame:
    """Ids to be met by the texts: sent to them up to ``BROADCAST_IDS``, else joined by shuffle."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the smallest doc_id.

    Rows without a doc_id, or that share one, are documents by their text: of those alike in doc_id and
    text one row stays, different texts of one doc_id both stay unless they are near duplicates. Null and
    blank texts are near duplicates of nothing. Ties in all else go by the smallest row.
    """
    again = cut(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1 and doc_id is not null").select("doc_id"))
    marked = docs.join(_sent(again.withColumn("_again", F.lit(True))), "doc_id", "left")
    by_text = F.col("_again").isNotNull() | F.col("doc_id").isNull()
    # above all ids, so that a real doc_id is the one that stays
    own = F.lit(2**62) + F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.coalesce("text", F.lit(""))), F.lit(2**62))
    noded = marked.withColumn("_node", F.when(by_text, own).otherwise(F.col("doc_id"))).withColumn("_again", by_text)
    found = near_duplicates(noded.select(F.col("_node").alias("doc_id"), "text"))
    gone = cut(found.where("not kept").select(F.col("doc_id").alias("_node")).distinct())
    held = noded.join(_sent(gone), "_node", "left_anti")
    alike = held.where("_again").groupBy("_node").agg(F.min(F.struct(*COLUMNS)).alias("r"))
    return held.where("not _again").select(*COLUMNS).unionByName(alike.select("r.*").select(*COLUMNS))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; n_chars follows the text.

    Null texts stay null; texts without a secret and all other columns stay as they are, null or not.
    Overlapping spans are one mask. Every row is judged for itself, repeated ones alike.
    """
    masked = redact(scan_secrets(docs))
    return masked.withColumn("n_chars", F.when(F.size("found") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


#: runs of adjacent draws of one pass, (start, n) in words of the document
PASSAGES = """transform(array(draws), d -> zip_with(
    filter(d, (x, i) -> i = 0 or get(d, i - 1).pass <> x.pass or get(d, i - 1).start + get(d, i - 1).take <> x.start),
    filter(d, (x, i) -> i = size(d) - 1 or get(d, i + 1).pass <> x.pass or x.start + x.take <> get(d, i + 1).start),
    (a, b) -> struct(a.start as start, b.start + b.take - a.start as n)))[0]"""


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The word ranges that the mix drew: a row for each run of adjacent drawn words of a pass.

    A pass over the whole source gives whole documents, in their own white space; the partial pass
    gives passages of drawn blocks, words joined by one space. Rows of one document share the
    doc_id. Rows without a doc_id go by their text and source.
    """
    key = F.coalesce(F.col("doc_id"), -1 - F.abs(F.xxhash64("text", "source") % 2**62))
    # rows of one _row are alike in all columns, so any of them can stand for each
    row = F.xxhash64(key, "text", "source", F.isnull("source"), "lang", F.isnull("lang"), "n_chars", F.isnull("n_chars"))
    keyed = docs.withColumn("_key", key).withColumn("_row", row)
    draws = mix_draws(keyed.select(F.col("_key").alias("doc_id"), "text", "source", "_row"), BLOCK, "_row")
    drawn = cut(draws.where("size(draws) > 0").select("_row", F.col("size").alias("_size"), F.expr(PASSAGES).alias("_passages")))
    if not drawn.groupBy("_row").count().where("count > 1").isEmpty():
        keyed = keyed.dropDuplicates(["_row"])
    held = keyed.join(drawn, "_row")
    cut_up = F.exists("_passages", lambda p: p["n"] < F.col("_size"))
    words = F.when(cut_up, word_array(F.col("text"))).otherwise(F.expr("cast(array() as array<string>)"))

    def passage(w: Column, p: Column) -> Column:
        some = F.array_join(F.slice(w, (p["start"] + 1).cast("int"), p["n"].cast("int")), " ")
        return F.when(p["n"] == F.col("_size"), F.col("text")).otherwise(some)

    # the words are bound once a row, not once a passage
    texts = F.transform(F.array(words), lambda w: F.transform("_passages", lambda p: passage(w, p)))[0]
    rows = held.select("doc_id", F.explode(texts).alias("text"), "lang", "source")
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences and offsets.

    Null and empty texts give the end id alone. Repeated rows, and rows without a doc_id, are packed each for
    itself; pieces of one length are ordered by doc_id, piece and ids. Other columns are not read.
    """
    return best_fit_pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("mixing", mixing),
    ("packing", packing),
]

#: Near-dedup, the permutations of the mix and the tokenizer are beyond SQL; tests/llm has brute-force twins.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read back.

    A stage's folder goes when the next one is written, the last when the program ends.
    """
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    atexit.register(remove_path, spark, folder)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for number, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before is not None:
            remove_path(spark, before)
        before = out
    return docs
