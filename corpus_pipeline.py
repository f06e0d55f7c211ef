"""A cleaning pipeline over ``documents``; every stage works on what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelasflow.llm import decontamination, exact_dedup, mixing, near_dup, quality
from kelasflow.llm.common import id_bucket, materialize, table
from kelasflow.llm.queries import QUALITY_THRESHOLD


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is below the threshold go."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), id_bucket(F.col("id"), 5) != 0)
    return quality.score(docs, model, name="_score").where(F.col("_score") >= QUALITY_THRESHOLD).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal after lower-casing A-Z, the one with the largest id stays."""
    return exact_dedup.drop_exact_duplicates(docs, keep="max")


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 0.8 of their 5-word shingles connect, the one
    with the smallest id stays."""
    return near_dup.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated with benchmark text go."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, with the numbers of its source."""
    return mixing.mix(docs)


STAGES = [("quality classifier", quality_classifier), ("exact dedup", exact), ("n-gram Jaccard join", ngram_jaccard),
          ("benchmark decontamination", decontaminate), ("mixing sources", mix_sources)]

ORACLE_SQL = None       # a trained classifier and random rounding are not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
