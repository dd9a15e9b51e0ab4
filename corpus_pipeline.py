"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, token ids.

Each stage gets the documents that its predecessor kept; all but the last return the columns of
``documents``. ``run`` writes each stage as Parquet to the shared folder and reads it for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pageloom.llm.bpe import bpe_decode, bpe_encode
from pageloom.llm.decontaminate import contamination
from pageloom.llm.line_dedup import drop_common_lines
from pageloom.llm.quality import quality
from pageloom.llm.queries import TOKENIZER, bpe_digest
from pageloom.llm.simhash import fingerprints, near_duplicates
from pageloom.llm.text import text_key, wide_rows
from pageloom.session import scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _same(left: str, right: str):
    return F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id")) & (F.col(f"{left}.row") == F.col(f"{right}.row"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    wide_rows(spark)
    return quality(docs, keep=COLUMNS).where("kept").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that stand in many of them; n_chars is that of the text left."""
    # rows repeated whole are one row here: what is left of them is the same
    left = drop_common_lines(docs).select("doc_id", "row", "kept").dropDuplicates(["doc_id", "row"])
    docs = docs.select(*COLUMNS).withColumn("row", text_key())
    return docs.alias("d").join(left.alias("k"), _same("d", "k")).select(
        "d.doc_id", F.col("k.kept").alias("text"), "d.lang", "d.source",
        F.char_length("k.kept").cast("long").alias("n_chars"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id (of rows with that id, one)."""
    wide_rows(spark)
    path = scratch_path(spark, "prints")
    docs = docs.select(*COLUMNS).withColumn("row", text_key())
    fingerprints(docs, keep=("doc_id", "row")).write.parquet(path)
    prints = spark.read.parquet(path)
    groups = near_duplicates(docs, prints.select("doc_id", "fp")).where("doc_id <=> component_id").distinct()
    first = (
        prints.join(groups.select(F.col("doc_id").alias("of"), F.col("fp").alias("print"), "component_id"),
                    F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("fp") == F.col("print")))
        .groupBy("doc_id").agg(F.min("row").alias("row")))
    return (
        docs.alias("d").join(first.alias("f"), _same("d", "f"), "left_semi")
        .dropDuplicates(["doc_id", "row"]).select(*COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates."""
    wide_rows(spark)
    docs = docs.select(*COLUMNS)
    bad = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated").select("doc_id", "row")
    return docs.withColumn("row", text_key()).alias("d").join(bad.alias("b"), _same("d", "b"), "left_anti").select(*COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document, as op8_bpe gives them, and its ids."""
    wide_rows(spark)
    path = public_tokenizers.path(TOKENIZER)
    return bpe_digest(bpe_decode(bpe_encode(docs, path), path))


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near-dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("BPE encoding", token_stage),
]
#: SQL cannot express fingerprints, histogram distances or BPE; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    wide_rows(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
