"""Seeded sampling of query sets with replacement, and bag union of corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwell.operators.numbering import dense_positions
from rankwell.operators.sizing import BROADCAST_ROWS

def draws(queries: DataFrame, n: int, seed: int) -> DataFrame:
    """``(draw, position)``: ``n`` uniform positions, each a hash of seed and draw number, so any engine can redo it."""
    spark = queries.sparkSession
    count = queries.agg(F.count(F.lit(1)).alias("count"))
    numbers = spark.range(n).select(
        F.col("id").alias("draw"),
        F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "id")), 1, 8), 16, 10).cast("long").alias("hash"),
    )
    total = count.first()[0]
    if total == 0:
        raise ValueError("cannot draw from an empty query set")
    return numbers.select("draw", (F.col("hash") % total).alias("position"))


def sample_queries(queries: DataFrame, n: int = 100, seed: int = 10) -> DataFrame:
    """``n`` queries drawn with replacement; ``ord`` becomes the draw number, so repeats stay apart.

    Only the ordinals are numbered and drawn from; the drawn ones then meet the bodies.
    """
    drawn = draws(queries, n, seed)
    few = n <= BROADCAST_ROWS
    picked = dense_positions(queries).join(F.broadcast(drawn) if few else drawn, "position").select("ord", "draw")
    bodies = queries.join(F.broadcast(picked) if few else picked, "ord")
    return bodies.select("id", "topic", "body", F.col("draw").alias("ord"))


def append_corpora(first: DataFrame, second: DataFrame) -> DataFrame:
    """Bag union: duplicates stay, the second corpus continues the ordinals of the first."""
    last = first.agg(F.coalesce(F.max("ord") + 1, F.lit(0)).alias("next")).first()[0]
    return first.unionByName(second.withColumn("ord", F.col("ord") + last))
