"""Analysis chains: text column -> positioned tokens, and query text -> positioned query terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwell.functions.text import lower, positioned, query_chunks, remove_stopwords, tokenize
from rankwell.operators.postings import token_rows
from rankwell.operators.synonyms import SynonymRules, expand_synonyms

CHAINS = ("standard", "nostop", "synonym")


def analyze(
    df: DataFrame,
    col: str,
    chain: str = "standard",
    synonyms: SynonymRules | DataFrame | None = None,
    key: list[str] | None = None,
) -> DataFrame:
    """Add ``tokens ARRAY<STRUCT<pos, term>>`` for the text in ``col``.

    ``standard``: tokenize, lower-case, drop stop words. ``nostop``: the same without the last step. ``synonym``:
    synonyms are expanded before stop words are dropped; ``key`` names the columns that identify a row.
    """
    if chain not in CHAINS:
        raise ValueError(f"chain must be one of {CHAINS}, got {chain!r}")
    words = tokenize(lower(col))
    if chain == "nostop":
        return df.withColumn("tokens", positioned(words))
    if chain == "standard":
        return df.withColumn("tokens", remove_stopwords(positioned(words)))
    if synonyms is None or not key:
        raise ValueError("the synonym chain needs synonyms and key")
    return expand_synonyms(df.withColumn("words", words), "words", synonyms, key).withColumn(
        "tokens", remove_stopwords("tokens")
    )


def chunk_rows(queries: DataFrame) -> DataFrame:
    """``(query_ord, chunk, text)``: the whitespace-separated pieces of each body, keyed by the query's ordinal."""
    return queries.select(F.col("ord").alias("query_ord"), F.posexplode(query_chunks("body")).alias("chunk", "text"))


def query_terms(
    queries: DataFrame, chain: str = "standard", synonyms: SynonymRules | DataFrame | None = None
) -> DataFrame:
    """``(query_ord, chunk, pos, term)``: each chunk analysed alone, so no rule or phrase spans two chunks."""
    analyzed = analyze(chunk_rows(queries), "text", chain, synonyms, ["query_ord", "chunk"])
    return token_rows(analyzed, "query_ord", "chunk")
