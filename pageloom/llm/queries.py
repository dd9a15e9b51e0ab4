"""The registered queries opN_<name> of this package, each over its whole tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pageloom.llm import chat, language, line_dedup, merkle, repair
from pageloom.llm.bpe import bpe_decode, bpe_encode
from pageloom.llm.chat import chat_digest, format_chats
from pageloom.llm.decontaminate import contamination
from pageloom.llm.line_dedup import drop_common_lines
from pageloom.llm.main_text import main_text
from pageloom.llm.quality import quality
from pageloom.llm.secrets import find_secrets
from pageloom.llm.simhash import hex_digits, near_duplicates
from pageloom.llm.text import wide_rows
from pageloom.llm.token_file import read_tokens, write_tokens
from pageloom.llm.toxicity import held_out, toxicity
from pageloom.session import scratch_path

TOKENIZER = "word_bpe_49k.json"
CONTRACT_QUALITY = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    wide_rows(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_common_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def token_file_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER))
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def simhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def main_text_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_repeated")


def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def chat_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    two = spark.range(2).select(
        F.lit(-1).alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    extra = two.select(*[F.col(f.name).cast(f.dataType) for f in turns.schema])
    return chat_digest(format_chats(turns.unionByName(extra)))


def secrets_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("secrets", lambda s: s["kind"].isin("assign", "access", "hex"))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
                        F.sha2(told(base), 256).alias("base_sha256"), told(F.col("secrets")).alias("spans"))


def bpe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(TOKENIZER)
    return bpe_digest(bpe_decode(bpe_encode(table(spark, sf_dir, "documents"), path), path))


def bpe_digest(decoded: DataFrame) -> DataFrame:
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def decontamination_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).select("doc_id", *CONTRACT_QUALITY)


def merkle_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), merkle.tampered_text(F.col("doc_id"), F.col("text")))


def language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    told = language.predict(docs, language.fit(docs))
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def repair_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_report(repair.damaged(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": line_dedup_query,
    "op2_token_file": token_file_query,
    "op3_simhash": simhash_query,
    "op4_main_text": main_text_query,
    "op5_toxicity": toxicity_query,
    "op6_chat_format": chat_query,
    "op7_secrets": secrets_query,
    "op8_bpe": bpe_query,
    "op9_decontamination": decontamination_query,
    "op10_quality": quality_query,
    "op11_merkle": merkle_query,
    "op12_language": language_query,
    "op13_repair": repair_query,
}
ORACLES: dict[str, str] = {
    "op1_line_dedup": line_dedup.QUERY_SQL, "op6_chat_format": chat.QUERY_SQL, "op11_merkle": merkle.QUERY_SQL,
    "op13_repair": repair.QUERY_SQL}
