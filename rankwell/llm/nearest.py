"""Approximate nearest neighbours by a forest of random-projection trees."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankwell.sources.scratch import materialize, shuffle_clean_up

SAMPLE_ROWS = 20_000  # vectors that the trees' planes are fitted on; every vector is indexed
SAMPLE_LEAF = 16  # sampled vectors in a leaf at least, which bounds the number of leaves
SHARD_ROWS = 16_384  # vectors, and queries, that one task compares at a time
MOST_SHARDS = 65_536  # beyond that many, shards hold more vectors
REGIONS = 4096  # runs of neighbouring shards, at most, that a query visits or not
SAMPLE_QUERIES = 200  # queries that the share of the index to compare is measured with, at most
_PORTION = 1 << 22  # components multiplied at a time


@dataclass
class Tree:
    """Inner node i tests ``normal[i] @ x >= cut[i]``; children are nodes, or leaf k as -k - 1."""

    normals: np.ndarray
    cuts: np.ndarray
    children: np.ndarray  # (nodes, 2): below the cut, at or above it
    leaves: int

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        node = np.full(len(vectors), 0 if len(self.cuts) else -1)
        while (inner := np.flatnonzero(node >= 0)).size:
            at = node[inner]
            side = np.einsum("ij,ij->i", vectors[inner], self.normals[at]) >= self.cuts[at]
            node[inner] = self.children[at, side.astype(int)]
        return -node - 1


def grow_tree(sample: np.ndarray, leaf_rows: int, rng: np.random.Generator) -> Tree:
    """Splits at the median of the projection on the difference of two random vectors, until leaves hold ``leaf_rows``."""
    normals, cuts, children, leaves = [], [], [], 0
    open_parts = [(np.arange(len(sample)), -1, 0)]
    while open_parts:
        rows, parent, side = open_parts.pop()
        split = None
        if len(rows) > leaf_rows:
            a, b = sample[rng.choice(rows, 2, replace=False)]
            normal = a - b if np.any(a != b) else rng.normal(size=sample.shape[1])
            normal = normal / np.linalg.norm(normal)
            projected = sample[rows] @ normal
            cut = np.median(projected)
            above = projected >= cut
            if 0 < above.sum() < len(rows):
                split = normal, cut, above
        if split is None:
            here, leaves = -leaves - 1, leaves + 1
        else:
            here = len(cuts)
            normals.append(split[0])
            cuts.append(split[1])
            children.append([0, 0])
            open_parts += [(rows[~split[2]], here, 0), (rows[split[2]], here, 1)]
        if parent >= 0:
            children[parent][side] = here
    width = sample.shape[1]
    return Tree(np.array(normals).reshape(-1, width), np.array(cuts), np.array(children, int).reshape(-1, 2), leaves)


def search_forest(trees: list[Tree], sizes: list[np.ndarray], query: np.ndarray, share: float) -> list[tuple[int, int, float]]:
    """(tree, leaf, cover before) in the order of one priority queue over all trees, until leaves cover ``share`` of the rows.

    A node's priority is the smallest margin on its path, from the right side of every plane. The cover is what the
    leaves taken hold together, as if trees were independent: one minus the product of what each tree leaves out.
    """
    total = max(1, int(sizes[0].sum()))
    queue = [(0.0, t, 0 if len(tree.cuts) else -1) for t, tree in enumerate(trees)]
    margins = [tree.normals @ query - tree.cuts for tree in trees]
    left_out = [1.0] * len(trees)
    found = []
    cover = 0.0
    while queue and cover < share:
        worst, t, node = heapq.heappop(queue)
        if node < 0:
            found.append((t, -node - 1, cover))
            left_out[t] -= sizes[t][-node - 1] / total
            cover = 1 - float(np.prod(left_out))
            continue
        below, above = trees[t].children[node]
        margin = margins[t][node]
        heapq.heappush(queue, (max(worst, margin), t, int(below)))
        heapq.heappush(queue, (max(worst, -margin), t, int(above)))
    return found


def usable(vector: Column, width: int | None = None) -> Column:
    """Whether a vector has a direction: not null, no null or non-finite component, not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)
    return F.coalesce(fine if width is None else fine & (F.size(vector) == width), F.lit(False))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def _first_hits(ids: np.ndarray, scores: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Places by query and score, ties to smaller ids; of those with one query, id and score only the first."""
    order = np.lexsort((ids, -scores, query))
    new = np.diff(ids[order]) != 0
    for column in (scores, query):
        new |= np.diff(column[order]) != 0
    return order[np.r_[True, new][: len(order)]]


def _scores(
    queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, candidate: np.ndarray | None = None
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the ``k`` largest inner products, ties to smaller ids; equal vectors have equal scores to the bit.

    ``candidate`` (queries, vectors) says which vectors count for which query. Rows with the query's ``own`` id take no place, and neither do those that repeat an id and a score.
    """
    rough = queries @ vectors.T
    rough[own[:, None] == ids] = -np.inf
    if candidate is not None:
        rough[~candidate] = -np.inf
    others = (rough > -np.inf).sum(axis=1)
    best: list[tuple[np.ndarray, np.ndarray]] = [(ids[:0], np.zeros(0))] * len(queries)
    still, taken = np.arange(len(queries)), k
    while len(still):
        row, least = rough[still], np.full(len(still), -np.inf)
        if len(ids) > taken:
            least = np.partition(row, len(ids) - taken, axis=1)[:, len(ids) - taken]
        slack = 1e-9 * np.maximum(1.0, np.abs(least))
        near = (row >= (least - slack)[:, None]) & (row > -np.inf)
        counts, again = near.sum(axis=1), []
        portion = np.cumsum(counts * vectors.shape[1]) // _PORTION
        for part in np.split(np.arange(len(still)), np.flatnonzero(np.diff(portion)) + 1):
            q, v = np.nonzero(near[part])
            exact, hit = (vectors[v] * queries[still[part]][q]).sum(axis=1), ids[v]
            order = _first_hits(hit, exact, q)
            q, hit, exact = q[order], hit[order], exact[order]
            starts = np.searchsorted(q, np.arange(len(part) + 1))
            for i, a, b in zip(part, starts, np.minimum(starts[1:], starts[:-1] + k), strict=False):
                if counts[i] == others[still[i]] or (b - a == k and exact[b - 1] >= least[i] - slack[i] / 2):
                    best[still[i]] = hit[a:b], exact[a:b]
                else:  # repetitions of an id and a score have filled the list
                    again.append(still[i])
        still, taken = np.array(again, dtype=int), taken * 4
    return best


def _truth(wide: DataFrame, asked: pd.DataFrame, k: int) -> pd.DataFrame:
    """(query, v) of the ``k`` nearest of all vectors to each of a few queries: the best of every task, then of all."""
    queries, own = _matrix(asked["v"]), asked["id"].to_numpy()
    kind = wide.schema["v"].dataType.simpleString()

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                vectors, ids = _matrix(batch["v"]), batch["id"].to_numpy()
                order = np.argsort(ids, kind="stable")
                place = {int(i): at for at, i in zip(order[::-1], ids[order[::-1]], strict=True)}
                for q, (hits, scores) in enumerate(_scores(queries, own, vectors[order], ids[order], k)):
                    yield pd.DataFrame({"query": q, "id": hits, "score": scores, "v": [batch["v"].iloc[place[int(i)]] for i in hits]})

    found = wide.mapInPandas(best, f"query int, id long, score double, v {kind}")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query", "v").toPandas()


def share_for(trees: list[Tree], sizes: list[np.ndarray], queries: np.ndarray, truth: list[np.ndarray], recall: float) -> float:
    """The least share of the index whose leaves hold ``recall`` of the true neighbours of the queries.

    A neighbour is found once one of its leaves is taken, so it needs what the leaves before cover. All vectors levelled.
    """
    needs = []
    for query, neighbours in zip(queries, truth, strict=True):
        if len(neighbours):
            before = {(t, leaf): cover for t, leaf, cover in search_forest(trees, sizes, query, 2.0)}
            leaves = [tree.leaf_of(neighbours) for tree in trees]
            needs += [min(before[t, int(own[i])] for t, own in enumerate(leaves)) for i in range(len(neighbours))]
    return sorted(needs)[max(0, int(np.ceil(recall * len(needs))) - 1)] + 1e-9 if needs else 1.0


def nearest_neighbours(
    vectors: DataFrame,
    queries: DataFrame,
    *,
    k: int = 20,
    trees: int = 4,
    leaf_rows: int = 256,
    recall: float = 0.97,
    share: float | None = None,
    sample_rows: int = SAMPLE_ROWS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    seed: int = 3,
) -> DataFrame:
    """(query_id, rank, vec_id, score): up to ``k`` vectors with the largest inner product found for every query.

    ``queries`` has the columns of ``vectors``; a query is not its own neighbour. The planes of the trees are fitted on
    ``sample_rows`` vectors (those with the smallest hash of the id), then every vector has a leaf in every tree. Vectors
    get one more component that makes all lengths equal, so that the largest inner product is the smallest angle.
    Queries walk the forest with one priority queue until the leaves cover ``share`` of the index. All vectors in those
    leaves are candidates, each once however many trees name it, and are compared exactly, in double precision.

    Unless given, ``share`` is what at most ``SAMPLE_QUERIES`` queries (by hash of the id; a tenth of them, but 50 at
    least) need for ``recall`` of their true neighbours among all vectors. Vectors without structure need a large share,
    clustered ones a small one; a query is never compared with a vector twice.

    Vectors are held once, in shards of ``SHARD_ROWS`` by their leaf in the first tree. A leaf that is larger, because
    many vectors are equal or the sample bounds the number of leaves, is spread over several shards; so no task holds
    more, and nothing is capped. A query visits the regions (runs of shards) that hold some vector of its leaves; where
    more than ``SHARD_ROWS`` queries visit a shard, they are split and its vectors copied. Rows without an id and vectors
    that are null, zero, or hold null or non-finite components take no part, nor do those of another width than most.
    Rows that repeat an id and a vector are indexed once, and repeated ids count once per different score, before any
    list is cut to ``k``. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    wide = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast(kind).alias("v"))
    wide = materialize(wide.filter(usable(F.col("v")) & F.col("id").isNotNull()).distinct(), "ann-vectors")
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    shape = wide.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"), F.max(squares).alias("longest"))
    with shuffle_clean_up(spark):
        largest = shape.orderBy(F.desc("n"), "width").first()  # one row
    if largest is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, total, longest = largest.width, largest.n, largest.longest
    wide = wide.filter(F.size("v") == width)

    def levelled(rows: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0.0, longest - (rows * rows).sum(axis=1)))
        return np.hstack([rows, rest[:, None]])

    def asking(rows: np.ndarray) -> np.ndarray:
        return np.hstack([rows, np.zeros((len(rows), 1))])

    with shuffle_clean_up(spark):
        sampled = wide.orderBy(F.xxhash64("id"), "id").select("v").limit(sample_rows).toPandas()
    sample, rng = levelled(_matrix(sampled["v"])), np.random.default_rng(seed)
    in_sample = max(SAMPLE_LEAF, int(leaf_rows * len(sample) / max(total, 1)))
    forest = [grow_tree(sample, in_sample, rng) for _ in range(trees)]
    shared = spark.sparkContext.broadcast(forest)  # at most trees * sample_rows / SAMPLE_LEAF * 2 planes
    base = np.cumsum([0, *(tree.leaves for tree in forest)])  # leaves of all trees, numbered through

    def leaves_of(column: pd.Series) -> np.ndarray:
        rows = levelled(_matrix(column))
        return np.stack([tree.leaf_of(rows) for tree in shared.value], axis=1) + base[:-1]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(base[-1], dtype=np.int64)
        for batch in batches:
            if len(batch):
                n += np.bincount(leaves_of(batch["v"]).ravel(), minlength=base[-1])
        held = np.flatnonzero(n)
        yield pd.DataFrame({"leaf": held, "n": n[held]})

    counted = wide.mapInPandas(count, "leaf int, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect()  # one row per leaf
    flat = np.zeros(base[-1], dtype=np.int64)
    for row in counted:
        flat[row.leaf] = row.n
    sizes = [flat[a:b] for a, b in zip(base, base[1:], strict=False)]

    shard_rows = max(SHARD_ROWS, total // MOST_SHARDS)
    first, several, shards, filled = np.zeros_like(sizes[0]), np.ones_like(sizes[0]), 0, 0
    for leaf, n in enumerate(sizes[0]):
        if filled and filled + n > shard_rows:
            shards, filled = shards + 1, 0
        first[leaf], several[leaf] = shards, max(1, -(-int(n) // shard_rows))
        filled += int(n)
        if several[leaf] > 1:
            shards, filled = shards + int(several[leaf]), 0
    shards += 1
    per_region = -(-shards // REGIONS)
    regions = -(-shards // per_region)

    def shard_of(leaves: np.ndarray, ids: np.ndarray) -> np.ndarray:
        home = leaves[:, 0]
        block = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
        return first[home] + block % several[home]

    def regions_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for batch in batches:
            if len(batch):
                leaves = leaves_of(batch["v"])
                region = shard_of(leaves, batch["id"].to_numpy()) // per_region
                seen.update(np.unique(leaves * regions + region[:, None]).tolist())
        yield pd.DataFrame({"pair": sorted(seen)}, dtype="int64")

    # of each leaf the regions that hold one of its vectors: at most leaves * REGIONS bits
    pairs = wide.mapInPandas(regions_of, "pair long").distinct().groupBy(F.floor(F.col("pair") / regions).alias("leaf"))
    present = np.zeros((base[-1], regions), dtype=bool)
    for row in pairs.agg(F.collect_list(F.col("pair") % regions).alias("regions")).toLocalIterator():
        present[row["leaf"], row["regions"]] = True

    asked = queries.select(queries[id_col].cast("long").alias("id"), queries[vector_col].cast(kind).alias("v"))
    asked = asked.filter(usable(F.col("v"), width) & F.col("id").isNotNull())
    if share is None:
        few = max(50, min(SAMPLE_QUERIES, asked.count() // 10))
        trial = asked.orderBy(F.xxhash64("id"), "id").limit(few).toPandas()
        truth = _truth(wide, trial, k) if len(trial) else pd.DataFrame({"query": [], "v": []})
        near = [truth["v"][truth["query"] == q] for q in range(len(trial))]
        near = [levelled(_matrix(v)) if len(v) else np.empty((0, width + 1)) for v in near]
        share = share_for(forest, sizes, asking(_matrix(trial["v"])) if len(trial) else np.empty((0, width + 1)), near, recall)
    layout = spark.sparkContext.broadcast((sizes, present))

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, held = layout.value
        for batch in batches:
            rows = []
            for query_id, vector in zip(batch["id"], batch["v"], strict=True):
                taken = [base[t] + leaf for t, leaf, _ in search_forest(shared.value, counts, np.append(vector, 0.0), share)]
                chosen = np.zeros(base[-1], dtype=bool)
                chosen[taken] = True
                packed, nearest = np.packbits(chosen).tobytes(), int(taken[0])
                for region in np.flatnonzero(held[taken].any(axis=0)):
                    for shard in range(region * per_region, min(shards, (region + 1) * per_region)):
                        rows.append((shard, query_id, nearest, packed, vector))
            yield pd.DataFrame(rows, columns=["shard", "query_id", "nearest", "leaves", "v"])

    visits = asked.mapInPandas(visit, f"shard long, query_id long, nearest int, leaves binary, v {kind}")
    visits = materialize(visits, "ann-visits")
    blocks = np.ones(shards, dtype=np.int64)
    for row in visits.groupBy("shard").count().collect():  # one row per shard
        blocks[row["shard"]] = -(-row["count"] // SHARD_ROWS)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                leaves = leaves_of(batch["v"])
                shard = shard_of(leaves, batch["id"].to_numpy())
                for block in range(int(blocks[shard].max())):
                    own = np.flatnonzero(blocks[shard] > block)
                    part = batch.iloc[own]
                    yield pd.DataFrame({"shard": shard[own], "block": block, "leaves": list(leaves[own]), "id": part["id"], "v": part["v"]})

    def join_block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            mixed = (batch["query_id"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            yield batch.assign(block=mixed % blocks[batch["shard"].to_numpy()])

    def compare(held: pd.DataFrame, visiting: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(held) and len(visiting):
            order = np.argsort(held["id"].to_numpy(), kind="stable")
            vectors_, ids = _matrix(held["v"])[order], held["id"].to_numpy()[order]
            leaves = np.stack(held["leaves"].to_numpy())[order]
            visiting = visiting.sort_values(["nearest", "query_id"])  # neighbouring queries share their candidates
            asking_, asking_ids, packed = _matrix(visiting["v"]), visiting["query_id"].to_numpy(), visiting["leaves"].to_numpy()
            for start in range(0, len(visiting), 256):
                part = slice(start, start + 256)
                chosen = np.unpackbits(np.frombuffer(b"".join(packed[part]), np.uint8).reshape(len(asking_ids[part]), -1), axis=1).astype(bool)
                candidate = np.zeros((len(chosen), len(ids)), dtype=bool)
                for t in range(leaves.shape[1]):
                    candidate |= chosen[:, leaves[:, t]]
                some = np.flatnonzero(candidate.any(axis=0))
                found = _scores(asking_[part], asking_ids[part], vectors_[some], ids[some], k, candidate[:, some])
                out += [(q, *hit) for q, hit in zip(asking_ids[part], found, strict=True)]
        return pd.DataFrame(out, columns=["query_id", "ids", "scores"])

    held = wide.mapInPandas(place, f"shard long, block long, leaves array<int>, id long, v {kind}")
    visits = visits.mapInPandas(join_block, f"shard long, query_id long, nearest int, leaves binary, v {kind}, block long")
    keys = ["shard", "block"]
    best = held.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInPandas(compare, "query_id long, ids array<long>, scores array<double>")
    each = best.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("hit"))
    each = each.select("query_id", F.col("hit.ids").alias("vec_id"), F.col("hit.scores").alias("score")).distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(embeddings: DataFrame) -> DataFrame:
    return nearest_neighbours(embeddings, embeddings.filter(F.col("vec_id") % 20 == 0))
