"""The corpus pipeline: five stages over ``documents``, each an operator at work.

Every stage takes (spark, docs, sf_dir) and returns rows; the caller may write
them and read them again.  All but the last return the columns they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ethoflow.llm import bpe, decontaminate, line_dedup, quality_crf, simhash
from ethoflow.llm._common import OWN, Scratch, crc_of_id, free_name, release, table
from ethoflow.llm.queries import THRESHOLD, rank_file


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold go."""
    model = quality_crf.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_of_id() % 4 != 2)
    score = free_name(docs, OWN + "quality")
    return quality_crf.score(docs, model, out=score).where(F.col(score) >= THRESHOLD).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines go from the texts; documents of nothing else go too."""
    out = line_dedup.dedup_lines(docs)
    gone = (F.col(OWN + "removed_chunks") > 0) & (F.col("text") == "")
    return out.where(~gone | F.col("text").isNull()).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, with a check that they decode to it."""
    path, pattern = rank_file()
    back = bpe.round_trip(docs, path, pattern)
    return back.select(
        "doc_id", "lang", "source", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.col("ids"),
        F.sha2("ids", 256).alias("ids_sha256"), (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("decodes"),
    )


STAGES = [("quality", quality), ("line_dedup", lines), ("simhash", near_duplicates), ("decontaminate", decontaminated), ("bpe", tokens)]

#: The classifier is trained, which SQL cannot express; tests compare each stage and run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written to the shared folder and read again.

    Once a stage's result is written, what the stage kept on its way goes, and so does its input if a stage wrote it.
    """
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, made = docs, len(Scratch.made())
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        release(spark, since=made)
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
