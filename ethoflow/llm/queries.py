"""The numbered queries over the standard tables, and their SQL where DuckDB can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ethoflow.llm import bpe, conversation_repair, decontaminate, feistel, hard_negatives, license_scan, line_dedup, ngram_lm, quality_crf, simhash, substring_dedup, topk_bsi, url_filter
from ethoflow.llm._common import OWN, crc_of_id, table

THRESHOLD = 0.7


def rank_file() -> tuple[str, str]:
    """(path, pattern) of the production tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_bsi.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = rank_file()
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return bpe.round_trip(docs, path, pattern).select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.passages(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_crf.train(docs, table(spark, sf_dir, "labels"), crc_of_id() % 4 != 2)
    scored = quality_crf.score(docs.select("doc_id", "text"), model, out="score")
    return scored.select("doc_id", (crc_of_id() % 4 == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op7_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = ngram_lm.train(docs, crc_of_id() % 5 != 1)
    scored = ngram_lm.score(docs, model)
    return scored.select("doc_id", (crc_of_id() % 5 == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs)
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(OWN + "removed_chunks").alias("removed_chunks"), F.col(OWN + "removed_lines").alias("removed_lines"), F.md5("text").alias("text_md5"), "text"
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(url_filter.RULES), "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel.shard_documents(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.labelled(license_scan.scan_licenses(table(spark, sf_dir, "documents")))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repaired(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_topk, op2_decontaminate, op3_bpe, op4_simhash, op5_passages, op6_quality, op7_ngram_lm, op8_line_dedup, op9_url_filter, op10_shards,
        op11_hard_negatives, op12_licenses, op13_conversations,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    from ethoflow.llm import sql

    return sql.ORACLE
