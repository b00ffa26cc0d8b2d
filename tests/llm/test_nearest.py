import numpy as np

from rankwell.llm.nearest import nearest_neighbours

TYPE = "vec_id long, embedding array<float>, leaf int, v string"


def brute(rows, queries, k):
    fine = {}
    for i, v in rows:
        if v is not None and None not in v and np.all(np.isfinite(v)) and np.any(np.array(v)) and i is not None:
            fine[i] = np.float32(v).astype(float)
    out = {}
    for q in queries:
        if q in fine:
            scored = sorted((-(fine[i] * fine[q]).sum(), i) for i in fine if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def run(spark, rows, queries, **options):
    vectors = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], TYPE)
    got = {}
    for r in nearest_neighbours(vectors, vectors.filter(vectors.vec_id.isin(queries)), **options).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


def test_whole_forest_is_exact_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=6) * (1 + i % 4))]) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(40)]
    rows += [(500, None), (501, [0.0] * 6), (502, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (503, [float("nan")] * 6), (504, [float("inf")] + [0.0] * 5)]
    queries = [3, 10, 201, 500, 501, 502, 503]
    got = run(spark, rows, queries, k=20, share=1.1, leaf_rows=8)
    want = brute(rows, queries, 20)
    assert {q: [i for i, _ in hits] for q, hits in got.items()} == {q: [i for i, _ in hits] for q, hits in want.items()}
    assert all(np.allclose([s for _, s in got[q]], [s for _, s in want[q]]) for q in want)


def test_large_leaves_are_spread_and_searched_whole(spark, monkeypatch):
    from rankwell.llm import nearest

    monkeypatch.setattr(nearest, "SHARD_ROWS", 16)
    rows = [(i, [1.0, 2.0, 0.5]) for i in range(100)] + [(1000 + i, [float(i), 1.0, -1.0]) for i in range(30)]
    queries = [5, 1029]
    got, want = run(spark, rows, queries, k=7, share=1.1), brute(rows, queries, 7)
    assert {q: [i for i, _ in h] for q, h in got.items()} == {q: [i for i, _ in h] for q, h in want.items()}


def test_repeated_rows_take_one_place(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=6))]) for i in range(120)]
    near = [float(x) for x in np.float32(np.array(rows[10][1]) * 1.5)]
    rows += [rows[3]] * 50 + [(300, near)] * 50
    queries = [3, 10, 300]
    got, want = run(spark, rows, queries, k=20, share=1.1, leaf_rows=8), brute(rows, queries, 20)
    assert {q: [i for i, _ in h] for q, h in got.items()} == {q: [i for i, _ in h] for q, h in want.items()}
    assert all(len(got[q]) == 20 for q in queries)


def test_repeated_ids_count_once_per_score(spark):
    rows = [(1, [1.0, 0.0, 0.0])] + [(1, [1.0, float(i), 1.0]) for i in range(30)]
    rows += [(2, [5.0, float(i), -1.0]) for i in range(90)] + [(3 + i, [4.0 - i / 8, 0.0, 0.0]) for i in range(8)]
    vectors = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], TYPE)
    asked = spark.createDataFrame([(1, rows[0][1], 0, "x")] * 2, TYPE)
    found = nearest_neighbours(vectors, asked, k=6, share=1.1).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in found] == [(2, 5.0)] + [(3 + i, 4.0 - i / 8) for i in range(5)]


def test_recall(spark):
    rng = np.random.default_rng(1)
    points = rng.normal(size=(1500, 32))
    rows = [(i, [float(x) for x in p / np.linalg.norm(p)]) for i, p in enumerate(points)]
    queries = list(range(0, 1500, 50))
    got, want = run(spark, rows, queries, leaf_rows=32), brute(rows, queries, 20)
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in queries])
    assert recall >= 0.9


def compared(spark, rows, queries, **options):
    """(recall, vectors compared per query): a table in one shard, so that the forest alone decides."""
    from rankwell.llm import nearest

    seen, plain = spark.sparkContext.accumulator(0), nearest._scores

    def counting(asking, own, vectors, ids, k, candidate=None):
        if candidate is not None:
            seen.add(int(candidate.sum()))
        return plain(asking, own, vectors, ids, k, candidate)

    nearest._scores = counting
    try:
        got = run(spark, rows, queries, **options)
    finally:
        nearest._scores = plain
    want = brute(rows, queries, 20)
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in queries])
    return recall, seen.value / len(queries)


def test_no_more_is_compared_than_there_is_and_less_where_vectors_are_clustered(spark):
    rng = np.random.default_rng(4)
    loose = [(i, [float(x) for x in p]) for i, p in enumerate(rng.normal(size=(1200, 24)))]
    centres = rng.normal(size=(30, 24)) * 5
    tight = [(i, [float(x) for x in centres[i % 30] + rng.normal(size=24) * 0.2]) for i in range(1200)]
    queries = list(range(0, 1200, 20))
    recall, each = compared(spark, loose, queries, leaf_rows=32)
    assert recall >= 0.9 and 100 < each <= 1200
    recall, each = compared(spark, tight, queries, leaf_rows=32)
    assert recall >= 0.9 and 20 <= each <= 600


def test_shards_that_many_visit_are_split(spark, monkeypatch):
    from rankwell.llm import nearest

    monkeypatch.setattr(nearest, "SHARD_ROWS", 8)
    monkeypatch.setattr(nearest, "REGIONS", 3)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=5))]) for i in range(100)]
    got, want = run(spark, rows, list(range(60)), k=5, share=1.1, leaf_rows=8), brute(rows, list(range(60)), 5)
    assert {q: [i for i, _ in h] for q, h in got.items()} == {q: [i for i, _ in h] for q, h in want.items()}


def test_few_and_no_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 1.0]), (None, [1.0, 1.0])]
    assert run(spark, rows, [1]) == {1: [(2, 1.0)]}
    empty = spark.createDataFrame([], TYPE)
    assert nearest_neighbours(empty, empty).count() == 0
