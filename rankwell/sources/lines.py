"""Ordered text lines, and running values over them without one task per file.

A running value over a file is found in two levels: a window inside each input split (bounded by the split size), and
a second window over one small summary row per split. No window ever holds a whole file's lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPLIT = ("file", "block")


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Text files -> ``(file, block, line_no, value)``; ``(block, line_no)`` sorts a file's lines."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_no"),
        "value",
    )


def split_totals(lines: DataFrame, count: Column, last: Column) -> DataFrame:
    """Per split: its own total and last non-null value, and those of the file's earlier splits."""
    mark = F.when(last.isNotNull(), F.col("line_no"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return (
        lines.groupBy(*SPLIT)
        .agg(F.sum(count).alias("split_count"), F.max_by(last, mark).alias("split_last"))
        .select(
            *SPLIT,
            "split_count",
            F.coalesce(F.sum("split_count").over(earlier), F.lit(0)).alias("count_before"),
            F.last("split_last", ignorenulls=True).over(earlier).alias("last_before"),
        )
    )


def with_running(lines: DataFrame, count: Column, last: Column, inclusive: bool = True) -> DataFrame:
    """Add ``running_count`` and ``running_last``: the sum of ``count`` and the last non-null ``last`` of the file up
    to each line (``inclusive``) or up to the line before it."""
    inside = Window.partitionBy(*SPLIT).orderBy("line_no")
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    local = lines.withColumn("local_count", F.coalesce(F.sum(count).over(inside), F.lit(0)))
    local = local.withColumn("local_last", F.last(last, ignorenulls=True).over(inside))
    return local.join(split_totals(lines, count, last).drop("split_count", "split_last"), list(SPLIT)).select(
        *lines.columns,
        (F.col("count_before") + F.col("local_count")).alias("running_count"),
        F.coalesce("local_last", "last_before").alias("running_last"),
    )
