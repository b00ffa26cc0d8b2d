"""Embedding whitening by shifted Cholesky QR."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankwell.sources.scratch import materialize

COMPONENTS = 8
SCALE, OFFSET = 1024, 100_000  # of the whole numbers that stand for an entry
PASSES = 10  # Gram passes at most; three are the rule
_UNIT = 2.0**-53
_PORTION = 1 << 21  # entries worked on at a time
_MOST = 1 << 62


@dataclass(frozen=True)
class Whitening:
    """``directions`` (k, d) are unit eigenvectors of the covariance of ``n`` vectors with the exact sums ``sums``.

    A component without variance has an eigenvalue of 0 and no whitened values.
    """

    n: int
    sums: tuple[int, ...]
    directions: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float | None
    passes: int


def whole_numbers(vectors: DataFrame, vector_col: str, *, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """``vectors`` without rows whose vector is null or holds null, NaN or infinity, with ``x`` = floor(scale * c) + offset.

    Whole numbers can be summed without error in any order. Entries beyond 2^61 / scale stand for that bound.
    """
    entry = F.col(vector_col).cast("array<double>")
    finite = F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    bound = float(_MOST // 2)
    x = F.transform(entry, lambda c: F.floor(F.least(F.greatest(c * scale, F.lit(-bound)), F.lit(bound))) + offset)
    return vectors.filter(F.col(vector_col).isNotNull() & finite).withColumn("x", x)


def _portions(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, whole numbers of some rows) of a batch."""
    column = batch.column(batch.schema.get_field_index("x"))
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    step = max(1, _PORTION // dims)
    for start in range(0, len(x), step):
        yield start, x[start : start + step]


def _spread(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - sums, exact: machine integers where they hold it, else Python's."""
    largest = max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0
    if largest * n + max(map(abs, sums), default=0) < _MOST:
        return x * n - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    return _spread(x, n, sums).astype(np.float64) / n


def _squares(spread: np.ndarray) -> pa.Array:
    """Sum of squares of every row, exact; null beyond 38 digits."""
    largest = max(abs(int(spread.min())), abs(int(spread.max()))) if spread.size else 0
    if spread.dtype != object and largest * largest * spread.shape[1] < _MOST:
        return pa.array((spread * spread).sum(axis=1)).cast(pa.decimal128(38, 0))
    totals = (spread.astype(object) ** 2).sum(axis=1)
    return pa.array([Decimal(int(t)) if t < 10**38 else None for t in totals], pa.decimal128(38, 0))


def _solved(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """``rows`` times the inverse of every upper triangular factor in turn, by forward substitution; (d, rows) in and out."""
    for r in factors:
        out = np.empty_like(rows)
        for j in range(len(r)):
            out[j] = (rows[j] - r[:j, j] @ out[:j]) / r[j, j]
        rows = out
    return rows


def _sums(vectors: DataFrame, dims: int) -> tuple[int, ...]:
    """Exact sum of every dimension: one row per task and dimension, added up as decimals."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for _, x in _portions(batch, dims):
                largest = max(abs(int(x.min())), abs(int(x.max())))
                part = x.sum(axis=0) if largest * len(x) < _MOST else x.astype(object).sum(axis=0)
                total = part.astype(object) if total is None else total + part
        if total is not None:
            yield pa.record_batch(
                [pa.array(range(dims), pa.int32()), pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))],
                names=["i", "total"],
            )

    parts = vectors.mapInArrow(add, "i int, total decimal(38,0)")
    found = {r["i"]: int(r["total"]) for r in parts.groupBy("i").agg(F.sum("total").alias("total")).collect()}
    return tuple(found[i] for i in range(dims))


def _gram(vectors: DataFrame, dims: int, width: int, rows_of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all vectors of y y^T, where ``rows_of`` makes the (width, rows) array of y from whole numbers.

    Every task adds up its own matrix; the tasks' matrices are added by entry, so that none gathers in one place.
    The result has width^2 entries whatever the number of vectors.
    """

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for _, x in _portions(batch, dims):
                y = rows_of(x)
                total = y @ y.T if total is None else total + y @ y.T
        if total is not None:
            yield pa.record_batch(
                [pa.array(range(width), pa.int32()), pa.array([total[i, : i + 1] for i in range(width)], pa.list_(pa.float64()))],
                names=["i", "part"],
            )

    parts = vectors.mapInArrow(multiply, "i int, part array<double>").select("i", F.posexplode("part").alias("j", "value"))
    gram = np.zeros((width, width))
    for i, j, value in parts.groupBy("i", "j").agg(F.sum("value").alias("value")).collect():
        gram[i, j] = gram[j, i] = value
    return gram


def _factor(gram: np.ndarray, shift: float) -> np.ndarray:
    """Upper triangular R with R^T R = gram + shift; a larger shift where rounding leaves no such R."""
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(len(gram))).T
        except np.linalg.LinAlgError:
            shift = max(shift * 16, len(gram) ** 2 * 2 * _UNIT * float(np.linalg.norm(gram, 2)))


def _decompose(vectors: DataFrame, n: int, sums: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
    """(squared singular values, right singular vectors in rows, passes) of the centred vectors.

    The first Gram matrix is shifted so that its factor exists whatever the condition; each further pass makes the rows
    more orthogonal, and the factors' product R has the singular values of the rows. Where vectors have no variance in
    some direction, the rows end as orthonormal in the others only, which the last Gram matrix tells.
    """
    dims = len(sums)
    factors: list[np.ndarray] = []
    while True:
        done = list(factors)
        gram = _gram(vectors, dims, dims, lambda x, done=done: _solved(np.ascontiguousarray(_centred(x, n, sums).T), done))
        if not factors:
            if not gram.any():  # all vectors are equal
                return np.zeros(dims), np.eye(dims), 1
            shift = 11 * (n * dims + dims * (dims + 1)) * _UNIT * float(np.linalg.norm(gram, 2))
        factors.append(_factor(gram, 0.0 if len(factors) else shift))
        if len(factors) > 1 and (np.abs(gram @ gram - gram).max() <= 1e-9 or len(factors) == PASSES):
            break
    # what the last pass's rows, solved by the last factor, have as Gram matrix: one where there is variance
    inner = _solved(_solved(gram, factors[-1:]).T.copy(), factors[-1:])
    weights, axes = np.linalg.eigh((inner + inner.T) / 2)
    root = (axes * np.sqrt(np.where(weights > 1e-8, weights, 0.0))) @ axes.T
    product = root
    for r in reversed(factors):
        product = product @ r
    _, values, directions = np.linalg.svd(product)
    values[values <= dims * 2.0**-46 * values[0]] = 0.0
    return values**2, directions, len(factors)


def _projected(x: np.ndarray, model: Whitening) -> np.ndarray:
    """(components, rows) of whitened values; NaN for components without variance."""
    out = model.directions @ _centred(x, model.n, model.sums).T
    roots = np.sqrt(np.where(model.eigenvalues > 0, model.eigenvalues, np.nan))
    return out / roots[:, None]


def vector_length(vectors: DataFrame) -> tuple[int, int]:
    """(length, rows) of the length of ``x`` that most rows have, the larger of several; (0, 0) without rows."""
    sizes = vectors.groupBy(F.size("x").alias("dims")).agg(F.count(F.lit(1)).alias("n"))
    first = sizes.orderBy(F.desc("n"), F.desc("dims")).first()
    return (0, 0) if first is None else (first["dims"], first["n"])


def fit_whitening(vectors: DataFrame, *, components: int = COMPONENTS) -> Whitening | None:
    """Principal directions of the whole-number vectors in ``x``, scaled to a covariance of one.

    Only vectors of the commonest length count; None if there are none, or they have no entries. Covariances have the
    divisor n and are centred with exact sums before anything is multiplied. All passes read all vectors; only matrices
    of the vectors' length squared come to the driver. Fewer than ``components`` dimensions give one component each.
    Directions are the same for all rows, with their largest entry positive.
    """
    dims, n = vector_length(vectors)
    if not dims:
        return None
    rows = vectors.filter(F.size("x") == dims).select("x")
    sums = _sums(rows, dims)
    squared, directions, passes = _decompose(rows, n, sums)
    k = min(components, dims)
    directions = directions[:k]
    largest = np.abs(directions).argmax(axis=1)
    directions = directions * np.sign(directions[np.arange(k), largest])[:, None]
    trace = squared.sum()
    explained = squared[:k] / trace if trace else np.zeros(k)
    model = Whitening(n, sums, directions, squared[:k] / n, explained, None, passes)
    varied = int((model.eigenvalues > 0).sum())
    if not varied:
        return model

    def with_ones(x: np.ndarray) -> np.ndarray:
        y = _projected(x, model)[:varied]
        return np.vstack([y, np.ones((1, y.shape[1]))])

    moments = _gram(rows, dims, varied + 1, with_ones) / n
    means = moments[-1, :-1]
    error = np.abs(moments[:-1, :-1] - np.outer(means, means) - np.eye(varied)).max()
    return replace(model, identity_error=float(error))


def whiten(vectors: DataFrame, model: Whitening) -> DataFrame:
    """Every row of ``vectors`` whose ``x`` has the model's length, with two columns in place of ``x``.

    ``deviation`` decimal(38,0): sum over dimensions of (n * x - sum)^2, exact (null beyond 38 digits); ``whitened``:
    an array of one value per component, null for components without variance. Other columns stay as they are, but for
    those two names.
    """
    dims = len(model.sums)
    rows = vectors.filter(F.size("x") == dims).drop("deviation", "whitened")
    kept = [f for f in rows.schema.fields if f.name != "x"]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others = batch.drop_columns(["x"])
            for start, x in _portions(batch, dims):
                whitened = _projected(x, model).T
                values = pa.array(whitened.ravel(), from_pandas=True)  # NaN becomes null
                offsets = pa.array(np.arange(len(x) + 1) * whitened.shape[1], pa.int32())
                part = others.slice(start, len(x))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, _squares(_spread(x, model.n, model.sums)), pa.ListArray.from_arrays(offsets, values)],
                    names=[*part.schema.names, "deviation", "whitened"],
                )

    schema = T.StructType(kept).add("deviation", T.DecimalType(38, 0)).add("whitened", T.ArrayType(T.DoubleType()))
    return rows.mapInArrow(project, schema)


WHITENED = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened_components(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row per vector and component.

    Rows whose vector is null or holds null or non-finite entries have none, nor have vectors of another length than the
    commonest. Repeated rows and null ids are rows like any other; no vectors give no rows. ``deviation`` is null where
    64 bits do not hold it; ``whitened`` is null for components without variance, ``explained`` is 0 for them, and
    ``identity_error`` covers the others (null if there are none).
    """
    rows = whole_numbers(vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector")), "vector").select("vec_id", "x")
    rows = materialize(rows, "whole-numbers")  # every pass reads them
    model = fit_whitening(rows)
    if model is None:
        kind = vectors.schema[id_col].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, {WHITENED}")
    explained = F.array(*(F.lit(float(e)) for e in model.explained))
    error = F.lit(model.identity_error).cast("double")
    return (
        whiten(rows, model)
        .select("vec_id", F.expr("try_cast(deviation AS long)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
        .select(
            "vec_id",
            (F.col("at") + 1).cast("int").alias("component"),
            F.lit(model.n).cast("long").alias("n"),
            "deviation",
            "whitened",
            F.get(explained, F.col("at")).alias("explained"),
            error.alias("identity_error"),
        )
    )


def query(embeddings: DataFrame) -> DataFrame:
    return whitened_components(embeddings)
