"""Joins that spread hot keys: a key with many rows is cut into sub-keys, and what it meets is copied to each.

How many sub-keys a key gets follows its own number of rows, so nothing depends on a list of known hot keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOOKUP_SHARE = 1000  # a key with more than 1/LOOKUP_SHARE of all rows is split; there are fewer than that many
LEAST_HOT = 100  # rows that are never worth splitting


def sub_key(spread: Column, parts: Column) -> Column:
    """One of ``parts`` sub-keys, by the hash of what the rows of a key differ in."""
    return F.pmod(F.xxhash64(spread), parts).cast("int")


def every_sub_key(parts: Column) -> Column:
    """A row for each sub-key."""
    return F.explode(F.sequence(F.lit(0), parts - 1))


def hot_keys(rows: DataFrame, key: str, share: int = LOOKUP_SHARE, least: int = LEAST_HOT) -> DataFrame:
    """``(key, parts)`` of the keys with over 1/``share`` of all rows, each part at most so many; fewer than ``share`` rows.

    The rows are evaluated once for this, beside the join that uses it: callers write rows that cost much.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    per = F.greatest(F.ceil(F.col("total") / share), F.lit(least))
    hot = counts.crossJoin(F.broadcast(counts.agg(F.sum("rows").alias("total")))).filter(F.col("rows") > per)
    return hot.select(key, F.ceil(F.col("rows") / per).cast("int").alias("parts"))


def lookup_join(rows: DataFrame, table: DataFrame, key: str, spread: str, how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """``rows`` joined with ``table``, which has one row per ``key``, where any key may hold any share of ``rows``.

    Hot keys (``hot_keys`` of the rows, unless ``hot`` gives them) are split by the hash of ``spread``, and their row of
    the table is copied to each part: at most twice ``LOOKUP_SHARE`` copies in all. ``how`` is inner or left; null keys
    meet nothing, and are spread too.
    """
    hot = F.broadcast(hot_keys(rows.filter(F.col(key).isNotNull()), key) if hot is None else hot)
    parts = F.coalesce("parts", F.lit(1))
    dealt = rows.join(hot, key, "left").withColumn("__sub", F.when(F.col(key).isNull(), sub_key(F.col(spread), F.lit(LOOKUP_SHARE))).otherwise(sub_key(F.col(spread), parts)))
    copies = table.join(hot, key, "left").withColumn("__sub", every_sub_key(parts)).drop("parts")
    return dealt.drop("parts").join(copies, [key, "__sub"], how).drop("__sub")
