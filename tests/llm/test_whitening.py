import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankwell.llm.whitening import fit_whitening, query, vector_length, whiten, whole_numbers

TABLE = "vec_id long, embedding array<float>, component string, n int, x string"


def table(spark, vectors, schema=TABLE):
    return spark.createDataFrame([(i, v, "c", 1, "x") for i, v in vectors], schema)


def expected(vectors):
    """(n, deviations, eigenvalues, directions, trace) by the definition, over the clean vectors."""
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    deviations = [int(((n * row - sums) ** 2).sum()) for row in x]
    centred = np.array([[float(Fraction(int(n * a - s), n)) for a, s in zip(row, sums, strict=True)] for row in x])
    _, singular, directions = np.linalg.svd(np.vstack([centred, np.zeros((x.shape[1], x.shape[1]))]), full_matrices=False)
    return n, deviations, singular**2 / n, directions, centred, (singular**2).sum() / n


def check(spark, vectors, rows=None, tolerance=1e-8):
    clean = [(i, v) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n, deviations, values, directions, centred, trace = expected([v for _, v in clean])
    got = query(rows if rows is not None else table(spark, vectors)).collect()
    k = min(8, len(clean[0][1]))
    assert len(got) == len(clean) * k
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1
    signs = {}
    for at, (i, _) in enumerate(clean):
        for c in range(k):
            r = next(r for r in by[i, c + 1] if r.deviation == deviations[at])
            if values[c] <= values[0] * 1e-20:
                assert r.whitened is None and r.explained <= 1e-18
                continue
            assert r.explained == pytest.approx(values[c] / trace, rel=1e-6) and r.identity_error <= 1e-6
            want = float(centred[at] @ directions[c]) / math.sqrt(values[c])
            if c not in signs and abs(want) > 1e-3:
                signs[c] = np.sign(want * r.whitened)
            assert r.whitened * signs.get(c, 1) == pytest.approx(want, abs=tolerance)
    return got


def spread_vectors(n, scales, seed):
    dice = np.random.default_rng(seed)
    basis = np.linalg.qr(dice.normal(size=(len(scales), len(scales))))[0]
    return [(i, [float(np.float32(c)) for c in row]) for i, row in enumerate(dice.normal(size=(n, len(scales))) * scales @ basis)]


def test_against_the_definition(spark):
    check(spark, spread_vectors(300, np.linspace(3, 0.3, 12), 1))


def test_hot_copies_nulls_and_non_finite_entries(spark):
    vectors = spread_vectors(60, np.linspace(2, 1, 10), 2)
    vectors += [(1000, vectors[0][1])] * 100 + [(None, vectors[1][1])]
    vectors += [(2000, None), (2001, [None] * 10), (2002, [math.nan] + [0.0] * 9), (2003, [math.inf] * 10)]
    check(spark, vectors)


def test_ill_conditioned_vectors_still_come_out_white(spark):
    vectors = spread_vectors(100, np.array([2e3, 1e3, 3e2, 50, 7, 1, 0.2, 0.05, 0.02]), 3)
    rows = table(spark, vectors, TABLE.replace("float", "double"))
    check(spark, vectors, rows, tolerance=1e-5)


def test_dimensions_that_are_constant_or_repeated_have_no_component(spark):
    vectors = [(i, [*v, 7.0, v[0], v[0] + 1.0]) for i, v in spread_vectors(50, np.array([3, 2, 1.5]), 4)]
    got = check(spark, vectors)
    assert {r.component for r in got if r.whitened is None} == {4, 5, 6}


def test_fewer_vectors_than_dimensions(spark):
    got = check(spark, spread_vectors(5, np.linspace(3, 1, 20), 5))
    assert {r.component for r in got if r.whitened is not None} == {1, 2, 3, 4}


def test_equal_vectors_and_a_single_one(spark):
    for vectors in ([(1, [1.0, 2.0])], [(i, [0.5, 0.0]) for i in range(9)]):
        got = query(table(spark, vectors)).collect()
        assert len(got) == 2 * len(vectors)
        assert {(r.whitened, r.explained, r.deviation, r.identity_error) for r in got} == {(None, 0.0, 0, None)}


def test_no_vectors_empty_vectors_and_other_lengths(spark):
    assert query(table(spark, [])).count() == 0
    assert query(table(spark, [(1, None), (2, [])])).count() == 0
    assert query(table(spark, [])).columns == query(table(spark, [(1, [1.0])])).columns
    mixed = spread_vectors(20, np.array([2.0, 1.0]), 6)
    got = query(table(spark, [*mixed, (100, [1.0]), (101, [1.0, 2.0, 3.0])])).collect()
    assert {r.vec_id for r in got} == set(range(20))
    ties = table(spark, [(1, [1.0]), (2, [1.0, 2.0])])
    assert vector_length(whole_numbers(ties.drop("x"), "embedding")) == (2, 1)


def test_huge_entries_are_summed_exactly(spark):
    vectors = [(i, [float(i) * 1e12, float(i % 3)]) for i in range(40)]
    rows = table(spark, vectors, TABLE.replace("float", "double"))
    clean = whole_numbers(rows.drop("x"), "embedding")
    model = fit_whitening(clean)
    assert model.sums[0] == sum(math.floor(1024 * v[0]) + 100_000 for _, v in vectors)
    _, deviations, *_ = expected([v for _, v in vectors])
    found = {r.vec_id: int(r.deviation) for r in whiten(clean, model).collect()}
    assert [found[i] for i, _ in vectors] == deviations
    assert {r.deviation for r in query(rows).collect()} >= {None}
    query(table(spark, [(1, [1e300, 1.0]), (2, [-1e300, 2.0])], TABLE.replace("float", "double"))).collect()


def test_columns_of_the_caller_stay(spark):
    rows = whole_numbers(table(spark, spread_vectors(30, np.array([2.0, 1.0]), 7)).drop("x"), "embedding")
    model = fit_whitening(rows)
    out = whiten(rows.withColumn("deviation", F.lit("old")), model)
    assert out.columns == ["vec_id", "embedding", "component", "n", "deviation", "whitened"]
    assert out.filter("component = 'c'").count() == 30
    assert model.passes <= 4
