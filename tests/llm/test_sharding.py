import hashlib
import random
import zlib
from collections import defaultdict

import duckdb

from rankwell.llm.sharding import SHARDS, SQL, prefix_sums, query, shard_documents

DOCS = "doc_id long, text string, size string, shard int, part string, place int, digest string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "p", 2, "d") for i, t in rows], DOCS)


def brute(rows, shards):
    """Rows in order of digest and id, each in the shard that holds its middle byte."""
    ordered = sorted(rows, key=lambda r: (hashlib.md5((r[1] or "").encode()).hexdigest(), r[0] is not None, r[0] or 0))
    sizes = [len((t or "").encode()) + 16 for _, t in ordered]
    total, before, out, slots = sum(sizes), 0, [], defaultdict(int)
    for (i, t), size in zip(ordered, sizes, strict=True):
        shard = min(shards - 1, (2 * before + size) * shards // (2 * total))
        out.append((i, size, zlib.crc32((t or "").encode()), shard, slots[shard]))
        slots[shard] += 1
        before += size
    return out


def key(row):
    return [(v is not None, v) for v in row]


def some_rows(seed, n=300):
    dice = random.Random(seed)
    rows = [(i, dice.choice([None, "", "é" * 5, "hot"]) if i % 3 == 0 else "w" * dice.randrange(400)) for i in range(n)]
    return rows + [(None, "no id"), (None, None), (7, "seven"), (7, "seven"), (7, "other"), (n, "long " * 30_000)]


def test_against_brute_force(spark):
    for seed, shards, rows_per_range in ((1, 40, 1_000_000), (2, 7, 25), (3, 1, 10)):
        rows = some_rows(seed)
        got = shard_documents(table(spark, rows), shards=shards, rows_per_range=rows_per_range).collect()
        assert sorted(map(tuple, got), key=key) == sorted(brute(rows, shards), key=key)


def test_shards_are_balanced_contiguous_and_gapless(spark):
    rows = [(i, "x" * (i * 37 % 90)) for i in range(2000)] + [(10_000 + i, "the same text") for i in range(1000)]
    got = shard_documents(table(spark, rows), rows_per_range=100).collect()
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in got:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(sizes) == set(range(SHARDS))
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r.size for r in got)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    hot = {r.shard for r in got if r.doc_id >= 10_000}
    assert hot == set(range(min(hot), max(hot) + 1)) and len(hot) <= 40 * sum(r.size for r in got if r.doc_id >= 10_000) // sum(sizes.values()) + 2


def test_few_and_no_documents(spark):
    assert query(table(spark, [])).collect() == []
    got = query(table(spark, [(1, None)])).collect()
    assert [tuple(r) for r in got] == [(1, 16, 0, "bytes", 20, 0, None)]


def test_a_hot_key_of_repeated_rows_is_split_over_ranges(spark):
    rows = table(spark, [(1, "same")] * 600).selectExpr("doc_id", "1L as size", "xxhash64(monotonically_increasing_id()) as turn")
    placed = prefix_sums(rows, "doc_id", "turn", rows_per_range=50).collect()
    assert sorted(r.place for r in placed) == sorted(r.before for r in placed) == list(range(600))


def test_sql_agrees(spark):
    rows = some_rows(4)
    con = duckdb.connect()
    documents = table(spark, rows).select("doc_id", "text").toArrow()  # noqa: F841 named in the SQL
    con.register("documents", documents)
    got = [tuple(r) for r in query(table(spark, rows)).collect()]
    assert sorted(con.sql(SQL).fetchall(), key=key) == sorted(got, key=key)
