"""The corpus pipeline: toxicity, line dedup, n-gram near-duplicates, best-fit packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns
the columns of ``documents``; the last one returns packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.llm.common import stage
from daybook.llm.line_dedup import BLANKS, dedup_lines
from daybook.llm.ngram_join import jaccard_components
from daybook.llm.packing import best_fit_pack
from daybook.llm.toxicity import train

TOXIC = 0.3


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more go; the model is learned from the labels that are not held out."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return model.score(docs, out="toxicity_score").where(F.col("toxicity_score") < TOXIC).drop("toxicity_score")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines similar to an earlier one go, and documents of which nothing but dropped lines was there."""
    kept = dedup_lines(docs).where((F.col("n_dropped") == 0) | (F.btrim("text", F.lit(f"\n{BLANKS}")) != ""))
    counted = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    return kept.select(*[counted.cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at a similarity of 0.8 of five-word shingles, the one with the smallest id stays."""
    found = jaccard_components(docs, words=5, threshold="0.8")
    away = stage(found.where("component_id <> id").select(F.col("id").alias("doc_id")).distinct(), "away")
    return docs.join(away, "doc_id", "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, in sequences of at most 4096 tokens."""
    return best_fit_pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("packing", packing)]

#: SQL expresses neither the learned scores nor the packing; tests hold the stages against brute force, run() against planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
