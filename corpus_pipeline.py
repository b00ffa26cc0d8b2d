"""A corpus from raw documents to packed sequences: each stage works on all that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankwell.llm import exact_dedup, jaccard_join, packing, quality, toxicity
from rankwell.sources.scratch import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below a half, by a model learnt from the labelled documents of ``sf_dir``.

    Where the labels that can be learnt from are all of one class, or there are none, every document stays.
    """
    model = toxicity.fit_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.3 or more, by a model learnt from the labelled documents of ``sf_dir``.

    Null texts are scored as empty ones. Where the labels are all of one class, or there are none, every document stays.
    """
    model = quality.fit_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id; a null text equals the empty one, rows that repeat an id and a text
    leave one, and a null id stays only where no equal text has an id."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect the one with the smallest id; documents without words stay."""
    return jaccard_join.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full sequences, neighbours along the curve together; null texts count as empty, repeated rows each."""
    return packing.query(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_low_quality),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("packing", pack),
]

ORACLE_SQL = None  # no SQL states the trained models or the tokenizer


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the documents of ``sf_dir``; each result but the last is written and reread."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
