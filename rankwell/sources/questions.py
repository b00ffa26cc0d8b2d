"""Bracket-delimited question text: ``[id] topic`` headers followed by body lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankwell.functions.text import is_header, long_enough, parse_header, trim_control
from rankwell.sources.lines import read_lines, split_totals, with_running


def drop_short_lines(lines: DataFrame, min_len: int = 3) -> DataFrame:
    """Skip lines shorter than ``min_len``, measured before trimming."""
    return lines.filter(long_enough("value", min_len))


def _marked(lines: DataFrame) -> DataFrame:
    """Kept lines with their parsed header (null on body lines) and ``opens``: header with an id / without / body."""
    header = parse_header("value")
    return (
        drop_short_lines(lines)
        .withColumn("header", F.when(is_header("value"), header))
        .withColumn("opens", F.when(F.col("header.id").isNotNull(), F.col("header.id") != ""))
    )


def parse_questions(lines: DataFrame) -> DataFrame:
    """Ordered lines -> ``(id, topic, body, ord)``.

    Text below a header with an id belongs to that header. Text with no such header above it (the top of a file, or
    below an ``[]`` header) goes in front of the next question of the file, and is lost if there is none. Question
    number = headers with an id so far, plus one while the latest header has none.
    """
    marked = _marked(lines).filter(F.col("header.reject").isNull())
    opened = F.coalesce(F.col("opens").cast("int"), F.lit(0))
    numbered = with_running(marked, opened, F.col("opens")).withColumn(
        "number", F.col("running_count") + F.when(F.coalesce("running_last", F.lit(False)), 0).otherwise(1)
    )
    # Join the lines inside each split first (same partitioning as the window, no extra shuffle), then the few pieces
    # that one question can have in neighbouring splits.
    text = F.when(F.col("header").isNull(), F.struct("line_no", trim_control("value").alias("text")))
    pieces = numbered.groupBy("file", "block", "number").agg(
        F.array_join(F.array_sort(F.collect_list(text))["text"], "").alias("text"),
        F.max(F.when(F.col("opens"), F.struct("header.id", "header.topic"))).alias("header"),
    )
    questions = (
        pieces.groupBy("file", "number")
        .agg(
            F.array_join(F.array_sort(F.collect_list(F.struct("block", "text")))["text"], "").alias("body"),
            F.max("header").alias("header"),
        )
        .filter(F.col("header").isNotNull())
    )
    # One row per file: questions in the files before it.
    per_file = split_totals(marked, opened, F.col("opens")).groupBy("file").agg(F.sum("split_count").alias("n"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_file.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    return questions.join(starts, "file").select(
        "header.id", "header.topic", "body", (F.col("start") + F.col("number") - 1).cast("long").alias("ord")
    )


def read_questions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Bracket text files -> ``(id, topic, body, ord)``; ``ord`` is dense from 0, in file and line order."""
    return parse_questions(read_lines(spark, path))


def rejected_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Header lines whose closing bracket comes first: they give no question and add no text."""
    marked = _marked(read_lines(spark, path))
    return marked.filter(F.col("header.reject").isNotNull()).select("file", "line_no", F.col("header.reject").alias("value"))


def question_count(questions: DataFrame) -> DataFrame:
    """One row: number of questions."""
    return questions.agg(F.count(F.lit(1)).alias("questions"))
