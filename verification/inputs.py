"""The driver's tables in the shapes the engine takes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankwell import SynonymRules, analyze, read_synonym_rules, token_rows
from rankwell.sources.scratch import scratch_path as scratch


QUIRKY_DOCS = 50  # documents in a file


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as questions."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"),
        F.concat_ws(" ", "lang", "source").alias("topic"),
        F.col("text").alias("body"),
        F.col("doc_id").alias("ord"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as questions."""
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"),
        F.col("role").alias("topic"),
        F.col("text").alias("body"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"),
    )


def batch(spark: SparkSession, sf_dir: str, body: Column | None = None) -> DataFrame:
    """Benchmark texts as queries."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("string").alias("id"),
        F.lit("benchmark").alias("topic"),
        (F.col("text") if body is None else body).alias("body"),
        F.col("item_id").alias("ord"),
    )


def operator_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts with their punctuation turned into operators; those with a line break become malformed."""
    body = F.replace(F.col("text"), F.lit(", "), F.lit(" AND "))
    body = F.replace(body, F.lit(". "), F.lit(" NOT "))
    return batch(spark, sf_dir, F.replace(body, F.lit(".\n"), F.lit(" OR OR ")))


def two_sided_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts joined by AND with their topic source word, so that some documents hold every must."""
    words = F.split("text", " ")
    return batch(spark, sf_dir, F.concat_ws(" ", "text", F.lit("AND"), F.element_at(words, 1), F.lit("NOT"), F.element_at(words, 2)))


def topic_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every topic of the corpus as a query; the number is that of the topic's first document."""
    topics = corpus(spark, sf_dir).groupBy("topic").agg(F.min("ord").alias("ord"))
    return topics.select(F.col("ord").cast("string").alias("id"), F.lit("topic").alias("topic"), F.col("topic").alias("body"), "ord")


def bracket_file(spark: SparkSession, sf_dir: str) -> str:
    """Documents written as bracket-delimited text, in document order."""
    path = scratch(spark, "questions")
    text = F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit("] "), F.concat_ws(" ", "lang", "source"), F.lit("\n"), "text")
    (
        table(spark, sf_dir, "documents")
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id")
        .select(text.alias("value"))
        .write.text(path)
    )
    return path


def quirky_file(spark: SparkSession, sf_dir: str) -> str:
    """``bracket_file`` with leading text, headers without an id, reversed brackets, brackets inside lines, short lines
    and control characters; a file for every ``QUIRKY_DOCS`` documents, because text may belong to the header after it in
    a file."""
    path = scratch(spark, "quirks")

    def every(n: int, rest: int, *parts: Column | str) -> Column:
        text = F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
        return F.when(F.col("doc_id") % n == rest, text).otherwise("")

    text = F.concat(
        F.when(F.col("doc_id") == 0, "leading text\n").otherwise(""),
        every(7, 1, "[]ghost\n ghost body \n"),
        F.lit("["), F.col("doc_id").cast("string"), F.lit("]\x01 "), "lang", every(5, 2, "\t", F.col("source"), "\x02"), F.lit("\n"),
        every(11, 3, "] wrong [ way ", F.col("doc_id").cast("string"), "\n"),
        every(13, 4, "see [", F.col("source"), "] inside\n"),
        "text",
        every(17, 5, "\nab\n[] last ghost\nlost or carried on"),
    )
    documents = table(spark, sf_dir, "documents")
    part = F.format_string("%012d", F.floor(F.col("doc_id") / QUIRKY_DOCS)).alias("part")
    rows = documents.select(part, "doc_id", text.alias("value")).repartition("part").sortWithinPartitions("part", "doc_id")
    rows.select("part", "value").write.partitionBy("part").text(path)
    return path


def _prolog(synsets: DataFrame) -> DataFrame:
    quoted = F.replace("word", F.lit("'"), F.lit("''"))
    return (
        synsets.repartitionByRange("synset")
        .sortWithinPartitions("synset", "word")
        .select(F.concat(F.lit("s("), F.col("synset").cast("string"), F.lit(",1,'"), quoted, F.lit("',n,1,0).")).alias("value"))
    )


def benchmark_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    analyzed = analyze(table(spark, sf_dir, "benchmark"), "text", "nostop")
    return token_rows(analyzed, "item_id")


def synonym_file(spark: SparkSession, sf_dir: str) -> str:
    """One-word synsets: benchmark words of one length that first appear in the same text."""
    path = scratch(spark, "synonyms")
    first = benchmark_words(spark, sf_dir).groupBy(F.col("term").alias("word")).agg(F.min("item_id").alias("item"))
    synset = 100_000_000 + F.col("item") * 100 + F.least(F.length("word"), F.lit(99))
    _prolog(first.select(synset.alias("synset"), "word")).write.text(path)
    return path


def phrase_file(spark: SparkSession, sf_dir: str) -> str:
    """Synsets of benchmark words that follow one another, written apart and as one word: two from every second word on,
    three from every fifth, four from every seventh."""
    path = scratch(spark, "phrases")
    following = Window.partitionBy("item_id").orderBy("pos")
    words = benchmark_words(spark, sf_dir).select("item_id", "pos", *(F.lead("term", i).over(following).alias(f"w{i}") for i in range(4)))
    synsets = []
    for count, every in ((2, 2), (3, 5), (4, 7)):
        found = words.filter((F.col("pos") % every == 0) & F.col(f"w{count - 1}").isNotNull())
        synset = (100_000_000 * count + F.col("item_id") * 1000 + F.col("pos")).alias("synset")
        of = [f"w{i}" for i in range(count)]
        synsets += [found.select(synset, F.concat_ws(" ", *of).alias("word")), found.select(synset, F.concat(*of).alias("word"))]
    _prolog(reduce(DataFrame.unionByName, synsets)).write.text(path)
    return path


def synonyms(spark: SparkSession, sf_dir: str) -> SynonymRules:
    return read_synonym_rules(spark, synonym_file(spark, sf_dir))


def phrases(spark: SparkSession, sf_dir: str) -> SynonymRules:
    return read_synonym_rules(spark, phrase_file(spark, sf_dir))
