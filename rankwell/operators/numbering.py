"""Dense numbers for sparse ordinals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwell.sources.scratch import materialize


def dense_positions(df: DataFrame, ord_col: str = "ord") -> DataFrame:
    """``(ord_col, position)``: the 0-based rank of every ordinal, which must be unique.

    Only the ordinals are sorted, by ranges, and written with their place in their range: the ranges come from a sample,
    so they must be dealt once. The sums of the ranges before, one number per task, give the rest.
    """
    ranged = df.select(ord_col).repartitionByRange(ord_col).sortWithinPartitions(ord_col)
    # the lower 33 bits count inside a task
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = materialize(ranged.select(ord_col, F.spark_partition_id().alias("part"), within.alias("within")), "positions")
    starts, total = [], 0
    for row in ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        starts.append((row["part"], total))
        total += row["n"]
    offsets = df.sparkSession.createDataFrame(starts, "part int, start long")
    return ranged.join(F.broadcast(offsets), "part").select(ord_col, (F.col("start") + F.col("within")).alias("position"))
