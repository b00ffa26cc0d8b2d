"""WordNet synonyms in Prolog form: ``s(synset,n,'word',type,sense,tag).``"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwell.functions.text import lower, tokenize
from rankwell.operators.synonyms import SynonymRules
from rankwell.sources.lines import read_lines, with_running
from rankwell.sources.scratch import materialize

_ENTRY = r"^s\((\d+),\d+,'(.*)',"


def parse_synsets(lines: DataFrame) -> DataFrame:
    """Ordered lines -> ``(file, run, words ARRAY<STRING>)``: one row per distinct word of each run of lines that
    share a synset number. The lines are read once and their entries written."""
    entries = lines.select(
        "file",
        "block",
        "line_no",
        F.regexp_extract("value", _ENTRY, 1).alias("synset"),
        F.replace(F.regexp_extract("value", _ENTRY, 2), F.lit("''"), F.lit("'")).alias("word"),
    ).filter(F.col("synset") != "")
    entries = materialize(entries, "synset-entries")
    previous = with_running(entries, F.lit(0), F.col("synset"), inclusive=False)
    changed = F.coalesce((F.col("running_last") != F.col("synset")).cast("int"), F.lit(1))
    starts = materialize(previous.select(*entries.columns, changed.alias("starts")), "synset-starts")
    runs = with_running(starts, F.col("starts"), F.when(F.col("starts") == 1, True))
    words = runs.select("file", F.col("running_count").alias("run"), tokenize(lower("word")).alias("words"))
    return words.filter(F.size("words") > 0).distinct()


def synonym_rules(synsets: DataFrame) -> DataFrame:
    """Synset members -> rules ``(input, output)``: every word of a synset gives every word of it, itself included.

    A synset of one word gives no rule. As many rows as the words of a synset squared: ``SynonymRules.of_synsets``
    expands the same without them.
    """
    inputs = synsets.select("file", "run", F.col("words").alias("input"))
    outputs = synsets.select("file", "run", F.col("words").alias("output"))
    sizes = synsets.groupBy("file", "run").count().filter(F.col("count") > 1).drop("count")
    return inputs.join(sizes, ["file", "run"]).join(outputs, ["file", "run"]).select("input", "output").distinct()


def read_synsets(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Prolog files -> ``(file, run, words ARRAY<STRING>)``, written once."""
    return materialize(parse_synsets(read_lines(spark, path)), "synsets")


def read_synonyms(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Prolog files -> ``(input ARRAY<STRING>, output ARRAY<STRING>)``."""
    return synonym_rules(read_synsets(spark, path))


def read_synonym_rules(spark: SparkSession, path: str | list[str]) -> SynonymRules:
    """Prolog files -> rules for expansion, linear in the words whatever the size of a synset."""
    return SynonymRules.of_synsets(read_synsets(spark, path))
