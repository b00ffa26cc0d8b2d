"""Ranking functions as column expressions over one (query clause, posting) row.

Each function takes a mapping of columns: ``tf`` and ``norm`` of the posting, ``df`` and ``ttf`` of the term,
``max_doc``, ``sum_ttf`` and ``avgdl`` of the collection, and (tf-idf only) ``query_norm`` of the query.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

Stats = Mapping[str, Column]

VSM, BM25, LM_DIRICHLET, LM_JM_SHORT, LM_JM_LONG = range(5)

DEFAULTS = {"k1": 1.2, "b": 0.75, "mu": 2000.0, "lam": 0.7}
SHORT_QUERY_LAMBDA = 0.1


def length_norm(dl: Column | str, mode: str = "quantized") -> Column:
    """1/sqrt(dl), by default cut down to a power of two with two mantissa bits, as a one-byte norm holds it."""
    length = F.col(dl) if isinstance(dl, str) else dl
    exact = 1.0 / F.sqrt(length.cast("double"))
    if mode == "exact":
        return F.when(length > 0, exact)
    if mode != "quantized":
        raise ValueError(f"unknown norm mode {mode!r}")
    scale = F.pow(F.lit(2.0), F.floor(F.log2(exact)).cast("double"))
    return F.when(length > 0, F.floor(exact / scale * 4).cast("double") / 4 * scale)


def vsm_idf(df: Column, max_doc: Column) -> Column:
    """Inverse document frequency of the tf-idf model; defined for df = 0 too."""
    return 1.0 + F.log(max_doc / (df + 1.0))


def _vsm(s: Stats, **_) -> Column:
    idf = vsm_idf(s["df"], s["max_doc"])
    return F.sqrt(s["tf"].cast("double")) * idf * idf * s["norm"] * s["query_norm"]


def _bm25(s: Stats, k1: float, b: float, **_) -> Column:
    idf = F.log(1.0 + (s["max_doc"] - s["df"] + 0.5) / (s["df"] + 0.5))
    length = 1.0 / (s["norm"] * s["norm"])
    return idf * (k1 + 1.0) * s["tf"] / (s["tf"] + k1 * (1.0 - b + b * length / s["avgdl"]))


def _collection_probability(s: Stats) -> Column:
    return (s["ttf"] + 1.0) / (s["sum_ttf"] + 1.0)


def _dirichlet(s: Stats, mu: float, **_) -> Column:
    length = 1.0 / (s["norm"] * s["norm"])
    seen = F.log(1.0 + s["tf"] / (mu * _collection_probability(s)))
    return F.greatest(F.lit(0.0), seen + F.log(mu / (length + mu)))


def _jelinek_mercer(s: Stats, lam: float, **_) -> Column:
    length = 1.0 / (s["norm"] * s["norm"])
    return F.log(1.0 + ((1.0 - lam) * s["tf"] / length) / (lam * _collection_probability(s)))


def _jelinek_mercer_short(s: Stats, **params) -> Column:
    return _jelinek_mercer(s, **{**params, "lam": SHORT_QUERY_LAMBDA})


SIMILARITIES: dict[int, Callable[..., Column]] = {
    VSM: _vsm,
    BM25: _bm25,
    LM_DIRICHLET: _dirichlet,
    LM_JM_SHORT: _jelinek_mercer_short,
    LM_JM_LONG: _jelinek_mercer,
}


def resolve_similarity(sim: int | None = None, configured: int | None = None) -> int:
    """An explicit choice beats a configured one; neither means tf-idf; anything outside the table is an error."""
    chosen = sim if sim is not None else configured if configured is not None else VSM
    if chosen not in SIMILARITIES:
        raise ValueError(f"similarity must be one of {sorted(SIMILARITIES)}, got {chosen!r}")
    return chosen


def clause_score(sim: int, stats: Stats, **params: float) -> Column:
    """Score of one matched clause under similarity ``sim``."""
    unknown = set(params) - set(DEFAULTS)
    if unknown:
        raise TypeError(f"unknown ranking parameters {sorted(unknown)}")
    return SIMILARITIES[resolve_similarity(sim)](stats, **{**DEFAULTS, **params})
