"""One registered query per operator, over the whole of its table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rankwell.llm import (
    exact_dedup,
    jaccard_join,
    license_scan,
    nearest,
    packing,
    quality,
    sentencepiece_viterbi,
    sharding,
    spelling_variants,
    token_counts,
    toxicity,
    url_filters,
    whitening,
)


def _over(table: str, query: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def _learnt(query: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": _over("documents", token_counts.query),
    "op2_jaccard_join": _over("documents", jaccard_join.query),
    "op3_nearest": _over("embeddings", nearest.query),
    "op4_license_scan": _over("documents", license_scan.query),
    "op5_toxicity": _learnt(toxicity.query),
    "op6_quality": _learnt(quality.query),
    "op7_sentencepiece": _over("documents", sentencepiece_viterbi.query),
    "op8_packing": _over("documents", packing.query),
    "op9_exact_dedup": _over("documents", exact_dedup.query),
    "op10_url_filter": _over("pages", url_filters.query),
    "url_redirects": _over("pages", url_filters.query_with_redirects),
    "op11_whitening": _over("embeddings", whitening.query),
    "op12_sharding": _over("documents", sharding.query),
    "op13_spelling_variants": _over("documents", spelling_variants.query),
}

ORACLE_SQL: dict[str, str] = {
    "op4_license_scan": license_scan.SQL,
    "op9_exact_dedup": exact_dedup.SQL,
    "op10_url_filter": url_filters.SQL,
    "url_redirects": url_filters.SQL_WITH_REDIRECTS,
    "op12_sharding": sharding.SQL,
    "op13_spelling_variants": spelling_variants.SQL,
}
