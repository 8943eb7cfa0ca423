"""The stages of the corpus pipeline: (spark, docs, sf_dir) to a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import toxicity as _toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic, with their columns."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _toxicity.keep_clean(docs, _toxicity.fit(docs, labels))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    from . import exact_dedup as op

    return op.keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest id."""
    from . import near_dedup as op

    return op.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    from . import decontamination as op

    return op.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of every document left, their count, the scores of the best segmentations and the round trip."""
    from . import pieces as op

    return op.digest(docs, ids=True)
