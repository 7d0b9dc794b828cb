"""The numbered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinotable.llm import decontamination, fill_in_middle, fingerprints, jaccard_join, line_dedup, mixing, packing, quality, simhash, suffix_dedup, token_alignment, token_counts, toxicity
from kinotable.llm.oracles import ORACLES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"), width=3, percent=90)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_likeness(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    out = toxicity.held_out(F.col("doc_id"), 3, 1)
    model = toxicity.fit(docs, labels.filter(~out))
    return toxicity.toxicity_scores(docs, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "spans")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_order(_table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(_table(spark, sf_dir, "documents"), whole=False).drop("kept", "removed")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_report(_table(spark, sf_dir, "documents"))
    return found.withColumn("removed_lines", F.array_join(F.transform("removed_lines", lambda i: i.cast("string")), ","))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    out = toxicity.held_out(F.col("doc_id"), 5, 0)
    model = quality.fit(docs, labels.filter(~out))
    return quality.quality_scores(docs, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _table(spark, sf_dir, "benchmark").filter(F.col("item_id").isNotNull())  # as in its SQL
    found = decontamination.contamination(_table(spark, sf_dir, "documents"), named)
    return found.drop("text_hash", "item_ids")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_rows(_table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.fill_in_middle(_table(spark, sf_dir, "documents"))
    digest = lambda text: F.sha2(text, 256)
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(back).alias("restored_sha256"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.aligned(_table(spark, sf_dir, "documents"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(_table(spark, sf_dir, "documents"))


__all__ = ["ORACLES", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_ngram_jaccard_join, op2_fingerprints, op3_toxicity, op4_mixing, op5_suffix_dedup, op6_token_counts, op7_line_dedup, op8_quality, op9_decontamination, op10_packing, op11_fill_in_middle, op12_token_alignment, op13_simhash)
}
