"""Connected components by contraction, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwell.sources.scratch import materialize

ROWS_PER_TASK = 200_000


def _jump(pointers: DataFrame) -> DataFrame:
    """Every node to where the node it points to points."""
    onward = pointers.select(F.col("node").alias("root"), F.col("root").alias("next"))
    return pointers.join(onward, "root").select("node", F.col("next").alias("root"))


def _written(df: DataFrame, rows: int, name: str, rows_per_task: int) -> DataFrame:
    """``df`` written by as many tasks as its rows, of which a bound is known, are worth."""
    return materialize(df.coalesce(max(1, -(-rows // rows_per_task))), name)


def smallest_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the edges: every node that is not the smallest of its component here, and that smallest one."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low < high
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (onward := root[root] != root).any():
            root[onward] = root[root[onward]]
    moved = root < np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _contracted(most: int):
    """Edges (a, b) of a task as (node, root), at most about ``most`` of them at a time."""

    def stars(held: list[pd.DataFrame]) -> pd.DataFrame:
        together = pd.concat(held)
        node, root = smallest_ends(together["a"].to_numpy(), together["b"].to_numpy())
        return pd.DataFrame({"node": node, "root": root})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0
        for batch in batches:
            if rows and rows + len(batch) > most:
                yield stars(held)
                held, rows = [], 0
            held.append(batch)
            rows += len(batch)
        if rows:
            yield stars(held)

    return run


def connected_components(edges: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b), both whole numbers; component is the smallest node in it.

    A node's rank is xxhash64 of its number, which maps 64-bit numbers one to one, so paths that lead to ever smaller
    ranks are short whatever the order of the numbers. Each round first contracts the edges inside each task, of
    ``rows_per_task`` rows: every node to the best-ranked one it is connected with there. Edges that fit one task are done
    with that. Else the round points every node to its best-ranked neighbour, follows the pointers to their ends, and
    contracts the edges to those ends; edges left run into the next round. Hubs cost no more than their edges: neighbours
    are only ever reduced to a minimum, and the joins that follow pointers are plain ones on their own shuffles, whose
    large partitions adaptive execution splits. Every round is a written table, so no lineage builds up; at the end nodes
    follow the pointers of all rounds. Each join and write leaves the driver threads and buffers, so few edges must not
    cost many of them. Self-loops, repeated edges and null ends are harmless; nodes without edges are not listed.
    """
    pairs = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).dropna().distinct()
    pairs = materialize(pairs, "component-pairs")
    rows = pairs.count()
    left = pairs.filter("a <> b").select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"))
    both = F.explode(F.array(F.struct(F.col("node").alias("a"), F.col("root").alias("b")), F.struct(F.col("root").alias("a"), F.col("node").alias("b"))))
    rounds = []
    while rows:
        dealt = left.coalesce(-(-rows // rows_per_task))
        stars = materialize(dealt.mapInPandas(_contracted(rows_per_task), "node long, root long"), "component-stars")
        if rows <= rows_per_task:
            rounds.append(stars)
            break
        pointers = stars.select(both.alias("e")).select("e.*").groupBy("a").agg(F.min("b").alias("b"))
        pointers = _written(pointers.select(F.col("a").alias("node"), F.least("a", "b").alias("root")), 2 * rows, "pointers", rows_per_task)
        while True:
            pointers = _written(_jump(_jump(pointers)), 2 * rows, "pointers", rows_per_task)
            ends = pointers.select(F.col("node").alias("root"), F.col("root").alias("next"))
            if pointers.join(ends, "root").filter("next <> root").isEmpty():
                break
        rounds.append(pointers)
        a = pointers.select(F.col("node").alias("a"), F.col("root").alias("x"))
        b = pointers.select(F.col("node").alias("b"), F.col("root").alias("y"))
        left = stars.select(F.col("node").alias("a"), F.col("root").alias("b")).join(a, "a").join(b, "b").filter("x <> y")
        left = _written(left.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), rows, "component-edges", rows_per_task)
        rows = left.count()
    labels = pairs.select(F.explode(F.array("a", "b")).alias("number")).distinct().withColumn("node", F.xxhash64("number"))
    for pointers in rounds:
        labels = labels.join(pointers, "node", "left").select("number", F.coalesce("root", "node").alias("node"))
    smallest = labels.groupBy("node").agg(F.min("number").alias("component"))
    return labels.join(smallest, "node").select(F.col("number").alias("node"), "component")
