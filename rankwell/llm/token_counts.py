"""Token counts by way of a digest cache."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwell.llm.common import documents_of, text_or_empty
from rankwell.operators.skew import lookup_join
from rankwell.sources.scratch import materialize, scratch_path, shuffle_clean_up

CACHE_SCHEMA = "digest string, n_tokens long, tokenizer string"
MEMO_WORDS = 700_000  # words whose counts a Python worker remembers; only speed depends on it

_ODD_SPACE = re.compile("[\x1c-\x1f]")  # white space for str.split, not for the tokenizer
_WORKER: dict = {}


def _tokenizer(path: str):
    """The tokenizer at ``path``, loaded once per Python worker, and what it has counted so far."""
    if path not in _WORKER:
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_file(path)
        loaded.no_truncation()
        loaded.no_padding()
        _WORKER[path] = (loaded, {})
    return _WORKER[path]


def _count_each(tokenizer, texts: list[str]) -> list[int]:
    return [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def count_words_apart(texts: list[str], path: str) -> list[int]:
    """Counts of a tokenizer that drops white space, so that a text has the tokens of its words; words are remembered.

    Special strings hold no white space, so a word that holds one is counted like any other. Texts with control
    characters that Python takes for white space and the tokenizer does not are encoded whole.
    """
    tokenizer, known = _tokenizer(path)
    split = [None if _ODD_SPACE.search(text) else text.split() for text in texts]
    fresh = {word for words in split if words for word in words if word not in known}
    if len(known) + len(fresh) > MEMO_WORDS:
        known.clear()
        fresh = {word for words in split if words for word in words}
    fresh = sorted(fresh)
    for start in range(0, len(fresh), 20_000):
        part = fresh[start : start + 20_000]
        known.update(zip(part, _count_each(tokenizer, part), strict=True))
    count = known.__getitem__
    return [
        _count_each(tokenizer, [text])[0] if words is None else sum(map(count, words))
        for text, words in zip(texts, split, strict=True)
    ]


def count_whole(texts: list[str], path: str) -> list[int]:
    return _count_each(_tokenizer(path)[0], texts)


def drops_white_space(path: str) -> bool:
    """Whether the tokenizer removes white space before it splits, and so counts word by word."""
    import json

    with open(path, encoding="utf-8") as file:
        described = json.load(file)
    first = ((described.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    pattern = (first.get("pattern") or {}).get("Regex", "")
    return first.get("type") == "Split" and first.get("invert", False) and first.get("behavior") == "Removed" and r"[^\s" in pattern


def tokenizer_version(path: str) -> str:
    """sha256 of the tokenizer's file: counts of one vocabulary are never taken for those of another."""
    import hashlib

    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def _normalised(text: Column, words_apart: bool) -> Column:
    """What the count depends on: for tokenizers that drop white space, runs of it become one space."""
    return F.trim(F.regexp_replace(text, "[ \t\r\n]+", " ")) if words_apart else text


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """(digest, n_tokens) stored for one tokenizer; a digest that was appended twice counts once."""
    stored = spark.read.schema(CACHE_SCHEMA).parquet(path).filter(F.col("tokenizer") == version)
    return stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(
    docs: DataFrame,
    *,
    tokenizer: str | None = None,
    cache: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens), one row for every row of ``docs``; null counts as the empty text.

    ``tokenizer`` is the path of a tokenizers file, at the same place on every machine. ``cache`` is a folder all
    machines share; by default a new one below the shared scratch folder. Digests of the normalised contents that the
    cache lacks are reduced to one content each, encoded, and appended; counts then come from the cache. If a job is
    lost half-way nothing is appended, and running it again is harmless: counts are looked up once per digest. A digest of
    which many documents are copies is looked up in parts.
    """
    spark = docs.sparkSession
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    version, words_apart = tokenizer_version(path), drops_white_space(path)
    cache = cache or scratch_path(spark, "token-counts")
    rows = documents_of(docs, id_col, text_col).withColumn("text", text_or_empty(F.col("text")))
    rows = rows.withColumn("content", _normalised(F.col("text"), words_apart))
    rows = rows.withColumn("digest", F.sha2(F.col("content").cast("binary"), 256))

    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache)
    wanted = rows.groupBy("digest").agg(F.min("content").alias("content"))  # in every task first, so hot copies are few
    missing = wanted.join(read_cache(spark, cache, version), "digest", "left_anti").select("digest", "content")
    counter = count_words_apart if words_apart else count_whole

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 1000):
                part = batch.iloc[start : start + 1000]
                yield pd.DataFrame({"digest": part["digest"], "n_tokens": counter(part["content"].tolist(), path), "tokenizer": version})

    with shuffle_clean_up(spark):
        missing.mapInPandas(encode, CACHE_SCHEMA).write.mode("append").parquet(cache)
    keyed = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest", F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("spread"))
    keyed = materialize(keyed, "token-digests")  # short rows: counted for hot digests, then joined
    return lookup_join(keyed, read_cache(spark, cache, version), "digest", "spread").select("doc_id", "n_bytes", "n_tokens")


def query(docs: DataFrame) -> DataFrame:
    return count_tokens(docs).withColumn("over_limit", F.col("n_tokens") > 2048)
