"""Top-k hits per query, hit totals, stored fields and report lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankwell.functions.text import render_question

# Scores are compared at ten significant digits, so that equal documents tie however their sums were ordered, and small
# scores are told apart like large ones.
SCORE_DIGITS = 10

SUB_RANGES = 64  # parts of a query's matches that are cut apart where k is large
_LIMITED = 1000  # largest k for which a limit on row_number is applied before the shuffle
_HELD = 1 << 20  # best rows a task holds before it passes them on


def score_key(score: Column | str) -> Column:
    """Whole number that orders scores, equal for scores that differ by rounding noise only: power of ten, then digits."""
    score = F.col(score) if isinstance(score, str) else score
    ten = 10**SCORE_DIGITS
    power = F.floor(F.log10(F.abs(score)))
    digits = F.floor(F.abs(score) / F.pow(F.lit(10.0), power - (SCORE_DIGITS - 1)) + 0.5)
    full = digits >= ten  # rounded up to the next power
    key = (power + F.when(full, 401).otherwise(400)) * (10 * ten) + F.when(full, ten // 10).otherwise(digits)
    return F.when(F.abs(score) < 1e-300, F.lit(0)).otherwise(F.signum(score).cast("long") * key.cast("long"))


def top_k(scores: DataFrame, k: int = 3) -> DataFrame:
    """Best ``k`` documents per query with their ``rank``; equal scores rank by insertion order.

    The limit on ``row_number`` is applied in each task before the shuffle, so a query never sends more than ``k``
    rows per task. Beyond the k for which that is done, matches are first cut in ``SUB_RANGES`` parts of each query.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    scores = scores.withColumn("score_key", score_key("score"))
    if k > _LIMITED:
        part = F.pmod(F.xxhash64("ord"), F.lit(SUB_RANGES))
        scores = _cut(scores.withColumn("part", part), k, "query_ord", "part").drop("part", "rank")
    return _cut(scores, k, "query_ord").drop("score_key")


def _cut(scores: DataFrame, k: int, *group: str) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc("score_key"), "ord")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _best_of_task(k: int):
    """Of the rows of a task, the ``k`` best of each query, with the number of its rows on the first of them (``n``)."""

    def best(rows: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((rows["ord"].to_numpy(), -rows["score_key"].to_numpy(), rows["query_ord"].to_numpy()))
        rows = rows.iloc[order]
        query = rows["query_ord"].to_numpy()
        starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.empty(0, int)
        place = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
        totals = np.add.reduceat(rows["n"].to_numpy(), starts) if len(query) else np.empty(0, "int64")
        kept = rows[place < k].copy()
        n = np.zeros(len(kept), "int64")
        n[place[place < k] == 0] = totals
        kept["n"] = n
        return kept

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            batch["n"] = np.ones(len(batch), "int64")
            held = best(batch if held is None else pd.concat([held, batch]))
            if len(held) > _HELD:
                yield held
                held = None
        if held is not None and len(held):
            yield held

    return run


def top_hits(scores: DataFrame, k: int = 3) -> DataFrame:
    """``top_k`` with ``total_hits``, the documents that matched before the cut, from one pass over ``(query_ord, ord,
    score)``, both keys whole numbers.

    A task counts the matches of each query and keeps its ``k`` best; tasks' results are merged by parts, then all.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    rows = scores.select(F.col("query_ord").cast("long"), F.col("ord").cast("long"), "score", score_key("score").alias("score_key"))
    parts = rows.mapInPandas(_best_of_task(k), "query_ord long, ord long, score double, score_key long, n long")

    def merged(parts: DataFrame, *group: str) -> DataFrame:
        whole = Window.partitionBy(*group)
        rank = F.row_number().over(whole.orderBy(F.desc("score_key"), "ord"))
        return parts.select("*", rank.alias("rank"), F.sum("n").over(whole).alias("total")).filter(F.col("rank") <= k)

    if k > _LIMITED:
        parts = merged(parts.withColumn("part", F.pmod(F.xxhash64("ord"), F.lit(SUB_RANGES))), "query_ord", "part")
        parts = parts.withColumn("n", F.when(F.col("rank") == 1, F.col("total")).otherwise(0)).drop("rank", "total", "part")
    best = merged(parts, "query_ord")
    return best.select("query_ord", "ord", "score", "rank", F.col("total").alias("total_hits"))


def total_hits(scores: DataFrame) -> DataFrame:
    """``(query_ord, total_hits)``: matching documents before the top-k cut. Needs no score, so none is worked out."""
    return scores.groupBy("query_ord").agg(F.count(F.lit(1)).alias("total_hits"))


def fetch_fields(hits: DataFrame, docs: DataFrame, *fields: str, small: bool = False) -> DataFrame:
    """Add stored fields (``doc_id`` at least) to the hits; runs after the cut, so nothing else carries them.

    ``small``: the hits have a checked size and are written out. They are then broadcast, and of stored documents
    (laid out in ``ord_block`` directories) only the directories that hold hits are read.
    """
    if small and "ord_block" in docs.columns:
        block = F.floor(F.col("ord") / docs_per_block()).alias("ord_block")
        blocks = [row["ord_block"] for row in hits.select(block).distinct().collect()]
        docs = docs.filter(F.col("ord_block").isin(blocks))
    wanted = docs.select("ord", *{"doc_id": None, **dict.fromkeys(fields)})
    return wanted.join(F.broadcast(hits) if small else hits, "ord")


def docs_per_block() -> int:
    """Documents per directory of a stored ``docs`` table."""
    return 1_000_000


def report(hits: DataFrame, docs: DataFrame, queries: DataFrame, field: str = "question", small: bool = False) -> DataFrame:
    """``(query_ord, rank, line)``: a heading per query at rank 0, then one line per hit."""
    heading = F.format_string(
        "Found %d document(s) that matched query '%s':",
        F.coalesce("total_hits", F.lit(0)),
        render_question("id", "topic", "body"),
    )
    totals = hits.filter(F.col("rank") == 1).select(F.col("query_ord").alias("ord"), "total_hits")
    headings = queries.join(totals, "ord", "left").select(
        F.col("ord").alias("query_ord"), F.lit(0).alias("rank"), heading.alias("line")
    )
    shown = fetch_fields(hits.drop("doc_id"), docs, field, small=small)
    lines = shown.select(
        "query_ord", "rank", F.format_string("(%d) [%s] %s", "rank", "doc_id", field).alias("line")
    )
    return headings.unionByName(lines)
