"""Near duplicates by an n-gram Jaccard join with rare-first prefix filtering."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwell.llm.common import documents_of
from rankwell.llm.components import connected_components
from rankwell.llm.shingles import shingle_sets
from rankwell.operators.skew import lookup_join
from rankwell.sources.scratch import materialize

CELL_BITS = 22  # 2**22 counters of shingle frequency, whatever the corpus; results never depend on them
_CHUNK = 1 << 16
HOT = 200_000  # rows of one shingle, above which it is dealt over several keys
BLOCK_ROWS = 1_000  # documents that one task compares with each other, or with as many others
BLOCK_SHINGLES = 4_000_000  # and their shingles on average, which bounds a block of very long documents
_TASKS = 256  # whose counts of shingles are added up first
_CLASSES = 16  # of shingles, for the suffix filter
_MANY = 16  # sets left to verify for one, from which their overlaps are counted together
_PART = 200  # documents whose sets are worked out at a time,
_PART_CHARS = 4_000_000  # and their characters, but for a text that is longer by itself


class SetNames:
    """Names of sets, whose documents are one class: the first 64 bits of a 128-bit digest, or, where these belong to
    several sets of the corpus (``shared``), the last 64. ``bits`` of the first are used, fewer than 64 only in tests."""

    def __init__(self, bits: int = 64, shared: frozenset[int] = frozenset()):
        self.bits, self.shared = bits, shared

    def both(self, shingles: np.ndarray) -> tuple[int, int]:
        digest = blake2b(shingles.tobytes(), digest_size=16).digest()
        first = int.from_bytes(digest[:8], "little", signed=True)
        return first >> (64 - self.bits), int.from_bytes(digest[8:], "little", signed=True)

    def __call__(self, shingles: np.ndarray) -> int:
        first, last = self.both(shingles)
        return last if first in self.shared else first


def least_overlap(n: int, percent: int) -> int:
    """What a set of ``n`` shares at least with any set that links to it."""
    return -(-n * percent // 100)


def _portions(texts: pd.Series) -> Iterator[slice]:
    start, size = 0, 0
    for at, text in enumerate(texts):
        size += len(text or "")
        if at > start and (at - start == _PART or size > _PART_CHARS):
            yield slice(start, at)
            start, size = at, len(text or "")
    yield slice(start, len(texts))


def _parts(batch: pd.DataFrame, words: int) -> Iterator[tuple[pd.DataFrame, list[np.ndarray]]]:
    for portion in _portions(batch["text"]):
        part = batch.iloc[portion]
        yield part, shingle_sets(part["text"].tolist(), words)


def _first_pass(rows: DataFrame, words: int, names: SetNames, id_type: str) -> DataFrame:
    """Per document its number of shingles and its set's name; per task its counts of shingles by cell, compressed."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        cells = np.zeros(1 << CELL_BITS, np.uint32)
        for batch in batches:
            for part, sets in _parts(batch, words):
                joined = np.concatenate([*sets, np.zeros(0, np.uint64)])
                np.add.at(cells, (joined >> np.uint64(64 - CELL_BITS)).astype(np.int64), np.uint32(1))
                keys = [names.both(s) if len(s) else (None, None) for s in sets]
                yield pd.DataFrame({
                    "doc_id": part["doc_id"], "n": [len(s) for s in sets], "key": pd.array([k for k, _ in keys], "Int64"),
                    "last": pd.array([k for _, k in keys], "Int64"), "chunk": -1, "counts": None,
                })
        packed = zstandard.ZstdCompressor(level=1)
        for chunk in range(len(cells) // _CHUNK if cells.any() else 0):
            counts = packed.compress(cells[chunk * _CHUNK : (chunk + 1) * _CHUNK].tobytes())
            no = pd.array([None], "Int64")
            yield pd.DataFrame({"doc_id": [None], "n": [0], "key": no, "last": no, "chunk": [chunk], "counts": [counts]})

    return rows.mapInPandas(count, f"doc_id {id_type}, n long, key long, last long, chunk int, counts binary")


def _cell_counts(passed: DataFrame) -> np.ndarray:
    """Counts of all documents' shingles by cell: 2**CELL_BITS numbers."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        unpacked, sums = zstandard.ZstdDecompressor(), {}
        for batch in batches:
            for chunk, counts in zip(batch["chunk"], batch["counts"], strict=True):
                here = np.frombuffer(unpacked.decompress(counts), np.uint32).astype(np.uint64)
                sums[chunk] = sums[chunk] + here if chunk in sums else here
        packed = zstandard.ZstdCompressor(level=1)
        for chunk, total in sums.items():
            total = np.minimum(total, 0xFFFFFFFF).astype(np.uint32)
            yield pd.DataFrame({"chunk": [chunk], "counts": [packed.compress(total.tobytes())]})

    import zstandard

    group = F.floor(F.spark_partition_id() / _TASKS).alias("tasks")
    summed = passed.filter("chunk >= 0").select("chunk", "counts", group).repartition("chunk", "tasks").drop("tasks")
    summed = summed.mapInPandas(add, "chunk int, counts binary").repartition("chunk").mapInPandas(add, "chunk int, counts binary")
    cells = np.zeros(1 << CELL_BITS, np.uint32)
    for row in summed.collect():  # a fixed number of rows of a fixed size
        cells[row.chunk * _CHUNK : (row.chunk + 1) * _CHUNK] = np.frombuffer(zstandard.ZstdDecompressor().decompress(row.counts), np.uint32)
    return cells


def rare_first(shingles: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Places of a sorted set's shingles in the order of their cell's count, ties by hash: the same for every document."""
    counts = np.minimum(cells[(shingles >> np.uint64(64 - CELL_BITS)).astype(np.int64)], (1 << 24) - 1).astype(np.uint64)
    return np.argsort((counts << np.uint64(40)) | (shingles >> np.uint64(24)), kind="stable")


def _prefix(shingles: np.ndarray, cells: np.ndarray, percent: int) -> np.ndarray:
    return shingles[rare_first(shingles, cells)[: len(shingles) - least_overlap(len(shingles), percent) + 1]]


def _prefixes(rows: DataFrame, cells, names: SetNames, words: int, percent: int, hot: int) -> DataFrame:
    """(shingle, salt, key, n): the prefix of every set, once per class and task.

    Two sets that link share a shingle of their prefixes, the rarest n - least_overlap(n) + 1 shingles. A shingle whose
    cell counts more than ``hot`` rows beyond the average cell is dealt over as many salts as it takes.
    """

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counted, seen = cells.value, set()
        usual = 4 * int(counted.mean())
        for batch in batches:
            for _, sets in _parts(batch, words):
                shingles, keys, sizes = [], [], []
                for s in sets:
                    if not len(s) or (key := names(s)) in seen:
                        continue
                    seen.add(key)
                    prefix = _prefix(s, counted, percent)
                    shingles.append(prefix)
                    keys.append(np.full(len(prefix), key))
                    sizes.append(np.full(len(prefix), len(s)))
                if not shingles:
                    continue
                shingle, key, n = (np.concatenate(x) for x in (shingles, keys, sizes))
                salts = 1 + np.maximum(counted[(shingle >> np.uint64(64 - CELL_BITS)).astype(np.int64)].astype(np.int64) - usual, 0) // hot
                salt = np.where(salts > 1, key % salts, -1)
                yield pd.DataFrame({"shingle": shingle.view(np.int64), "salt": salt, "key": key, "n": n})

    return rows.select("text").mapInPandas(emit, "shingle long, salt long, key long, n long")


def _sharing(prefixes: DataFrame, percent: int) -> DataFrame:
    """(a, b, shingle): chains through the classes that share a prefix shingle; b is null for one to be chained further.

    Rows of a shingle come in order of size, so any two of them whose sizes may link (length filter) are joined by the
    chain, which breaks where a size is too far above the one before. A shingle that is dealt over salts is chained
    within each, and the first class of each salt comes out again, for a chain over the salts.
    """

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = None
        for batch in batches:
            if not len(batch):
                continue
            if before is not None:
                batch = pd.concat([before, batch], ignore_index=True)
            shingle, salt, key, n = (batch[c].to_numpy() for c in ("shingle", "salt", "key", "n"))
            together = (shingle[1:] == shingle[:-1]) & (salt[1:] == salt[:-1])
            linked = together & (key[1:] != key[:-1]) & ((salt[1:] >= 0) | (n[:-1] * 100 >= n[1:] * percent))
            edges = pd.DataFrame({"a": key[:-1][linked], "b": key[1:][linked]}).drop_duplicates()
            yield edges.assign(b=edges["b"].astype("Int64"), shingle=0)
            opens = np.flatnonzero(~together & (salt[1:] >= 0)) + 1
            if before is None and salt[0] >= 0:
                opens = np.r_[0, opens]
            if len(opens):
                yield pd.DataFrame({"a": key[opens], "b": pd.array([None] * len(opens), "Int64"), "shingle": shingle[opens]})
            before = batch.iloc[-1:]

    dealt = prefixes.repartition("shingle", "salt").sortWithinPartitions("shingle", "salt", "n", "key")
    return dealt.mapInPandas(chain, "a long, b long, shingle long")


def _clusters(prefixes: DataFrame, percent: int) -> DataFrame:
    """(key, cluster): classes that share prefix shingles with one another, directly or not; others are not listed."""
    sharing = materialize(_sharing(prefixes, percent), "jaccard-sharing")
    across = sharing.filter("b is null").select("shingle", "a").distinct()
    centres = across.groupBy("shingle").agg(F.min("a").alias("b"))
    edges = sharing.filter("b is not null").select("a", "b").unionByName(across.join(centres, "shingle").select("a", "b"))
    found = connected_components(edges.filter("a <> b").distinct())
    return found.select(F.col("node").alias("key"), F.col("component").alias("cluster"))


def _meetings(large: DataFrame, cells, names: SetNames, words: int, percent: int) -> DataFrame:
    """(key, other): the further blocks of its cluster that hold a shingle of a class's prefix, in a set of a size that
    may link to it; from rows (cluster, block, key, text)."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, sets in _parts(batch, words):
                for cluster, block, key, s in zip(part["cluster"], part["block"], part["key"], sets, strict=True):
                    if len(s) and names(s) == key:
                        prefix = _prefix(s, cells.value, percent).view(np.int64)
                        yield pd.DataFrame({"shingle": prefix, "cluster": cluster, "block": block, "key": key, "n": len(s)})

    emitted = large.mapInPandas(emit, "shingle long, cluster long, block int, key long, n long")
    held = materialize(emitted, "jaccard-block-shingles")
    blocks = held.groupBy("shingle", F.col("cluster").alias("of"), F.col("block").alias("other"))
    blocks = blocks.agg(F.min("n").alias("least"), F.max("n").alias("most"))
    met = lookup_join(held, blocks, "shingle", "key").filter("cluster = of and block <> other")
    met = met.filter((F.col("n") * 100 >= F.col("least") * percent) & (F.col("most") * 100 >= F.col("n") * percent))
    return met.select("key", "other").distinct()


class _Forest:
    def __init__(self, n: int):
        self.label, self.members = np.arange(n), {i: [i] for i in range(n)}

    def join(self, a: int, b: int) -> None:
        a, b = self.label[a], self.label[b]
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        moved = self.members.pop(b)
        self.label[moved] = a
        self.members[a] += moved


class _Postings:
    """Which sets hold a token, and where: built from (tokens, place of the first of them) per set."""

    def __init__(self, sets: list[tuple[np.ndarray, int]]):
        token = np.concatenate([t for t, _ in sets])
        owner = np.repeat(np.arange(len(sets)), [len(t) for t, _ in sets])
        place = np.concatenate([first + np.arange(len(t)) for t, first in sets])
        order = np.lexsort((owner, token))
        self.owner, self.place = owner[order], place[order]
        new = np.r_[True, np.diff(token[order]) != 0][: len(order)]
        start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        own = np.argsort(order)  # the sorted places of every set's tokens, in the order of the set
        self.spans = np.split(np.column_stack([start[own], own]), np.cumsum([len(t) for t, _ in sets])[:-1])

    def before(self, x: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every set before ``x``: tokens shared with it, and the places of the last of these in ``x`` and in it."""
        shared, last_x, last_y = (np.zeros(x, np.int64) for _ in range(3))
        for start, end in self.spans[x]:
            if start < end:
                held = self.owner[start:end]
                shared[held] += 1
                last_x[held] = self.place[end]
                last_y[held] = self.place[start:end]
        return shared, last_x, last_y


def link_sets(sets: list[np.ndarray], percent: int, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect all sets which links connect; with ``sides``, only links from one side to the other.

    Sets are taken by size. Each finds those before it that share a shingle of its prefix, in order of frequency here;
    sets too small (length), those whose rest cannot hold enough (positional: shared so far plus the shorter rest after
    the last shared place), those in the same component already, and those whose counts by class of shingle cannot
    overlap enough (suffix) are passed over; every other pair is verified once, on all shingles.
    """
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sizes = np.array([len(sets[i]) for i in order])
    flat, counts = np.unique(np.concatenate([sets[i] for i in order]), return_counts=True)
    rank = np.empty(len(flat), np.int64)
    rank[np.lexsort((flat, counts))] = np.arange(len(flat))
    ranked = [np.sort(rank[np.searchsorted(flat, sets[i])]) for i in order]
    shared_from = int((counts == 1).sum())  # ranks below occur once
    histograms = np.stack([np.bincount(r % _CLASSES, minlength=_CLASSES) for r in ranked])
    side = np.zeros(len(sets), int) if sides is None else np.asarray(sides)[order]
    prefixes = [r[: len(r) - least_overlap(len(r), percent) + 1] for r in ranked]
    by_prefix = _Postings([(r[r >= shared_from], int((r < shared_from).sum())) for r in prefixes])
    by_shingle: _Postings | None = None
    forest, links = _Forest(len(sets)), []
    for x, tokens in enumerate(ranked):
        n = len(tokens)
        shared, last_x, last_y = by_prefix.before(x)
        found = np.flatnonzero(shared)
        # 100 i >= percent (n + m - i)
        needed = -(-percent * (n + sizes[found]) // (100 + percent))
        keep = (sizes[found] * 100 >= n * percent) & (forest.label[found] != forest.label[x])
        keep &= shared[found] + np.minimum(n - last_x[found], sizes[found] - last_y[found]) - 1 >= needed
        if sides is not None:
            keep &= side[found] != side[x]
        found, needed = found[keep], needed[keep]
        fits = np.minimum(histograms[found], histograms[x]).sum(axis=1) >= needed
        found, needed = found[fits], needed[fits]
        overlap = None
        if len(found) > _MANY:  # one walk over the whole sets' postings instead of one comparison each
            if by_shingle is None:
                by_shingle = _Postings([(r[r >= shared_from], 0) for r in ranked])
            overlap = by_shingle.before(x)[0]
        while len(found):
            y = int(found[-1])  # of like size
            both = overlap[y] if overlap is not None else np.isin(tokens, ranked[y], assume_unique=True).sum()
            if both >= needed[-1]:
                links.append((order[x], order[y]))
                forest.join(x, y)
                apart = forest.label[found] != forest.label[x]
                found, needed = found[apart], needed[apart]
            else:
                found, needed = found[:-1], needed[:-1]
    return links


def _verified(members: DataFrame, names: SetNames, words: int, percent: int) -> DataFrame:
    """(a, b): links between classes, from rows (cluster, pair, side, key, text) sorted by cluster and pair."""

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_group, keys, sets, sides = None, [], [], []

        def close() -> list[tuple[int, int]]:
            if len(keys) < 2:
                return []
            return [(keys[i], keys[j]) for i, j in link_sets(sets, percent, np.array(sides) if max(sides) else None)]

        for batch in batches:
            links = []
            for part, found in _parts(batch, words):
                for cluster, pair, side, key, s in zip(part["cluster"], part["pair"], part["side"], part["key"], found, strict=True):
                    if (cluster, pair) != open_group:
                        links += close()
                        open_group, keys, sets, sides = (cluster, pair), [], [], []
                    if len(s) and names(s) == key and key not in keys[-1:]:
                        keys.append(key)
                        sets.append(s)
                        sides.append(side)
            yield pd.DataFrame(links, columns=["a", "b"])
        yield pd.DataFrame(close(), columns=["a", "b"])

    dealt = members.repartition("cluster", "pair").sortWithinPartitions("cluster", "pair", "key")
    return dealt.mapInPandas(link, "a long, b long")


def _paired(texts: DataFrame, cells, names: SetNames, words: int, percent: int) -> DataFrame:
    """(cluster, pair, side, key, text): every class in its own block, and in one pair of blocks for each block it meets."""
    large = texts.filter("blocks > 1")
    met = _meetings(large, cells, names, words, percent)
    low, high = F.least("block", "other"), F.greatest("block", "other")
    side = F.when(F.col("block") < F.col("other"), 1).otherwise(2)
    across = large.join(met, "key").select("cluster", F.concat_ws("-", low, high).alias("pair"), side.alias("side"), "key", "text")
    own = texts.select("cluster", F.concat_ws("-", "block", "block").alias("pair"), F.lit(0).alias("side"), "key", "text")
    return own.unionByName(across)


def _near_duplicates(
    docs: DataFrame, words: int, percent: int, hot: int, block_rows: int, block_shingles: int, key_bits: int, id_col: str, text_col: str
) -> tuple[DataFrame, SetNames]:
    spark, names = docs.sparkSession, SetNames(key_bits)
    rows = documents_of(docs, id_col, text_col).withColumn("text", F.col("text").cast("string"))
    passed = materialize(_first_pass(rows, words, names, docs.schema[id_col].dataType.simpleString()), "jaccard-documents")
    known = passed.filter("chunk < 0").select("doc_id", "n", "key", "last")
    cells = spark.sparkContext.broadcast(_cell_counts(passed))  # 2**CELL_BITS numbers of four bytes
    first = known.filter("key is not null").groupBy("key")
    first = first.agg(F.min("doc_id").alias("first_id"), F.max("n").alias("n"), F.min("last").alias("low"), F.max("last").alias("high"))
    smallest = materialize(first, "jaccard-classes")
    shared = [r.key for r in smallest.filter("low <> high").select("key").collect()]  # squared documents / 2**65 on average
    if shared:
        names = SetNames(key_bits, frozenset(shared))
        known = known.withColumn("key", F.when(F.col("key").isin(shared), F.col("last")).otherwise(F.col("key")))
        smallest = known.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("first_id"), F.max("n").alias("n"))
    smallest = smallest.select("key", "first_id", "n")
    clusters = _clusters(_prefixes(rows, cells, names, words, percent, hot), percent)
    members = materialize(clusters.join(smallest, "key").filter("first_id is not null"), "jaccard-clusters")
    blocks = F.greatest(F.ceil(F.count("*") / block_rows), F.ceil(F.sum("n") / block_shingles)).cast("int").alias("blocks")
    members = lookup_join(members, members.groupBy("cluster").agg(blocks), "cluster", "key")
    members = members.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    # the clusters grow with the corpus, so they are never broadcast, small as they may be here
    texts = rows.withColumnRenamed("doc_id", "first_id").join(members.hint("merge"), "first_id")
    texts = materialize(texts.select("cluster", "blocks", "block", "key", "text"), "jaccard-texts")
    links = connected_components(_verified(_paired(texts, cells, names, words, percent), names, words, percent))
    joined = smallest.join(links.select(F.col("node").alias("key"), "component"), "key", "left")
    joined = joined.withColumn("component", F.coalesce("component", "key"))
    named = joined.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_class = materialize(lookup_join(joined, named, "component", "key").select("key", "component_id"), "jaccard-components")
    own = lookup_join(known.withColumn("spread", F.xxhash64("doc_id")), of_class, "key", "spread", "left")
    component = F.coalesce("component_id", "doc_id").alias("component_id")
    return own.select("doc_id", F.col("n").alias("n_shingles"), component, F.col("key").alias("set_key")), names


def near_duplicates(
    docs: DataFrame,
    *,
    words: int = 5,
    percent: int = 80,
    hot: int = HOT,
    block_rows: int = BLOCK_ROWS,
    block_shingles: int = BLOCK_SHINGLES,
    key_bits: int = 64,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_shingles, component_id, set_key), one row for every row of ``docs``; ``set_key`` names the set.

    Two documents link when the overlap of their sets of ``words``-word shingles is at least ``percent`` of the union;
    component_id is the smallest id that links lead to, the document's own included. Equal sets are one class, of which
    one document is compared. Prefix shingles, rarest first by counts over all documents, tie classes into clusters that
    no link leaves; each cluster is joined by itself. One of over ``block_rows`` classes, or ``block_shingles`` shingles,
    is dealt over blocks, and a class meets another block only where that holds a shingle of its prefix, in a set of a
    size that may link. Only links that connect something new are passed on, so a group of copies costs as many rows as
    it has documents.

    Null, empty and wordless texts have no shingles and link with nothing. Rows that share an id are compared each with
    its text, and belong to the same component only where their texts do. A row without an id gets the component of its
    set, if documents with ids share it. No rows give no rows.
    """
    return _near_duplicates(docs, words, percent, hot, block_rows, block_shingles, key_bits, id_col, text_col)[0]


def keep_one(
    docs: DataFrame, *, words: int = 5, percent: int = 80, key_bits: int = 64, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with one row of every component, that with its smallest id; all columns as they were.

    Of rows that share an id and a set one stays, and so does one of rows without an id whose set no row with an id has.
    Rows without shingles all stay, but for repetitions of an id and a text.
    """
    found, names = _near_duplicates(docs, words, percent, HOT, BLOCK_ROWS, BLOCK_SHINGLES, key_bits, id_col, text_col)
    found = found.filter(F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id")))
    found = found.select(F.col("doc_id").alias("__keep_id"), F.col("set_key").alias("__keep_key")).distinct()

    @F.pandas_udf("long")
    def key_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            keys: list[int | None] = []
            for portion in _portions(texts):
                keys += [names(s) if len(s) else None for s in shingle_sets(texts.iloc[portion].tolist(), words)]
            yield pd.Series(keys, dtype="Int64")

    marked = docs.withColumn("__set_key", key_of(docs[text_col].cast("string")))
    same = marked[id_col].eqNullSafe(found["__keep_id"]) & marked["__set_key"].eqNullSafe(found["__keep_key"])
    kept = marked.join(found, same, "left_semi")
    kept = kept.withColumn("__text_key", F.when(F.col("__set_key").isNull(), F.xxhash64(kept[text_col])))
    return kept.dropDuplicates([id_col, "__set_key", "__text_key"]).drop("__set_key", "__text_key")


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)
