"""A training-corpus pipeline over the documents table: five stages, each one operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from labelweave.llm import decontaminate, exact_dedup, pieces, quality, simhash
from labelweave.llm.queries import PIECE_MODEL
from labelweave.session import materialise


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose most likely grade, by the fitted ordinal model, is good."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies."""
    return simhash.drop_near_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each remaining text, with the byte span of each."""
    return pieces.encode(docs, PIECE_MODEL)


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_exact),
    ("simhash near-dedup", drop_near),
    ("benchmark decontamination", drop_leaks),
    ("sentencepiece encoding", tokenize),
]

#: SQL cannot express fitting, fingerprints and tokens; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are stored before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
