"""Linear-chain conditional random fields with two tags, over many chains at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwell.llm.common import held_out

LARGEST = 1e30  # odds are kept within this and its inverse


@dataclass
class Chain:
    """Log-potentials against tag 0 followed by tag 0: of a first tag 1, and of the other three transitions."""

    start: float = 0.0
    t01: float = 0.0
    t10: float = 0.0
    t11: float = 0.0

    def vector(self) -> np.ndarray:
        return np.array([self.start, self.t01, self.t10, self.t11])


def _scan(emission: np.ndarray, first: np.ndarray, start: float, t01: float, t10: float, t11: float) -> np.ndarray:
    """Odds of tag 1 by the recursion r -> e (t01 + t11 r) / (1 + t10 r), begun anew with e * start where ``first``.

    One step is a 2 x 2 matrix on (r, 1), so the sequence is cut into lanes: their products are found side by side, the
    values at the lanes' beginnings one after the other, and then all lanes run side by side once more. A long chain
    costs no more than many short ones.
    """
    n = len(emission)
    steps = max(1, int(np.sqrt(n)))
    lanes = -(-n // steps)
    e, anew = np.ones(lanes * steps), np.zeros(lanes * steps, bool)
    e[:n], anew[:n] = emission, first
    e, anew = (np.ascontiguousarray(x.reshape(lanes, steps).T) for x in (e, anew))
    a, b = np.where(anew, 0.0, e * t11), np.where(anew, e * start, e * t01)
    c = np.where(anew, 0.0, t10)
    p, q, r, s = np.ones(lanes), np.zeros(lanes), np.zeros(lanes), np.ones(lanes)
    for i in range(steps):
        p, q, r, s = a[i] * p + b[i] * r, a[i] * q + b[i] * s, c[i] * p + r, c[i] * q + s
        scale = 1 / (p + q + r + s)
        p, q, r, s = p * scale, q * scale, r * scale, s * scale
    begin, odds = np.empty(lanes), 1.0
    for lane in range(lanes):
        begin[lane] = odds
        odds = min(LARGEST, max(1 / LARGEST, (p[lane] * odds + q[lane]) / max(r[lane] * odds + s[lane], 1 / LARGEST)))
    out, odds = np.empty((steps, lanes)), begin
    for i in range(steps):
        odds = np.clip((a[i] * odds + b[i]) / (c[i] * odds + 1), 1 / LARGEST, LARGEST)
        out[i] = odds
    return out.T.reshape(-1)[:n]


def _messages(scores: np.ndarray, first: np.ndarray, chain: Chain) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Emission odds, forward odds, and backward odds that include the place's own emission."""
    e = np.exp(np.clip(scores, -30, 30))
    start, t01, t10, t11 = np.exp(chain.vector())
    last = np.r_[first[1:], True]
    forward = _scan(e, first, start, t01, t10, t11)
    backward = _scan(e[::-1], last[::-1], 1.0, t10, t01, t11)[::-1]
    return e, forward, backward


def marginals(scores: np.ndarray, first: np.ndarray, chain: Chain) -> np.ndarray:
    """Probability of tag 1 at every place of chains laid end to end; ``first`` marks where one begins."""
    if not len(scores):
        return np.zeros(0)
    e, forward, backward = _messages(scores, first, chain)
    odds = forward * (backward / e)
    return odds / (1 + odds)


@dataclass
class OneHot:
    """Dense features of which each place has one, by its number."""

    codes: np.ndarray
    width: int

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.codes), self.width

    def __getitem__(self, places: slice) -> OneHot:
        return OneHot(self.codes[places], self.width)

    def __matmul__(self, weights: np.ndarray) -> np.ndarray:
        return weights[self.codes]

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.codes, values, minlength=self.width)


def _expected(features, tags: np.ndarray, first: np.ndarray, weights: np.ndarray, chain: Chain) -> np.ndarray:
    """Gradient of the features' weights, then expected counts of a first tag 1 and of the other three transitions."""
    e, forward, backward = _messages(features @ weights, first, chain)
    odds = forward * (backward / e)
    probability = odds / (1 + odds)
    inner = ~first
    _, t01, t10, t11 = np.exp(chain.vector())
    came, here = np.r_[1.0, forward[:-1]][inner], backward[inner]
    pairs = np.stack([t01 * here, t10 * came, t11 * came * here])
    pairs = (pairs / (1 + pairs.sum(axis=0))).sum(axis=1)
    missing = tags - probability
    own = features.sums(missing) if isinstance(features, OneHot) else features.T @ missing
    return np.r_[own, probability[first].sum(), pairs]


def fit(
    features: np.ndarray | OneHot,
    tags: np.ndarray,
    first: np.ndarray,
    *,
    rounds: int = 60,
    rate: float = 0.3,
    decay: float = 1e-6,
    portion: int = 100_000,
) -> tuple[np.ndarray, Chain]:
    """Weights of ``features`` (a row per place) and the chain, by gradient steps (Adam) on the mean likelihood.

    A step adds up the gradients of portions of whole chains, about ``portion`` places each, which bounds its memory.
    """
    weights = np.zeros(features.shape[1] + 4)
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    inner = ~first
    before = np.r_[0, tags[:-1]]
    observed = np.array([
        (tags * first).sum(), ((before == 0) & (tags == 1) & inner).sum(), ((before == 1) & (tags == 0) & inner).sum(),
        ((before == 1) & (tags == 1) & inner).sum(),
    ])
    begins = np.flatnonzero(first)
    cuts = sorted({0, len(tags), *(int(begins[np.searchsorted(begins, at)]) for at in range(portion, len(tags), portion) if at <= begins[-1])})
    parts = [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
    for step in range(1, rounds + 1):
        chain = Chain(*weights[-4:])
        total = sum(_expected(features[part], tags[part], first[part], weights[:-4], chain) for part in parts)
        total[-4:] = observed - total[-4:]
        gradient = total / len(tags) - decay * weights
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        weights = weights + rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
        weights[-4:] = np.clip(weights[-4:], -12, 12)
    return weights[:-4], Chain(*weights[-4:])


def fit_logistic(features: np.ndarray, labels: np.ndarray, *, rounds: int = 30, decay: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression with a constant as the last, by Newton's method."""
    x = np.hstack([features, np.ones((len(features), 1))])
    weights = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x / len(x) + decay * np.eye(len(weights))
        weights = weights + np.linalg.solve(hessian, x.T @ (labels - p) / len(x) - decay * weights)
    return weights


def logistic(features: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(features @ weights[:-1] + weights[-1], -30, 30)))


def training_rows(
    docs: DataFrame, labels: DataFrame, label: str, rows: int, longest_text: int, *, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[list[str], np.ndarray]:
    """Texts and labels to learn from: at most ``rows`` of each class, those with the smallest hash of the id.

    Rows whose crc32 of the id is divisible by five are never among them, nor are texts of over ``longest_text`` bytes,
    so what reaches the driver is bounded: twice ``rows`` times ``longest_text`` bytes. Rows that repeat an id, a text
    and a label are learnt from once; a document with several labels once for each, an id with several texts likewise.
    """
    known = labels.select(labels["doc_id"].alias("doc_id"), labels[label].cast("int").alias("label"))
    known = known.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).distinct()
    order = F.xxhash64("doc_id"), F.col("doc_id")
    texts = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    texts = texts.filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= longest_text)
    picked = [known.filter(F.col("label") == c).orderBy(*order).limit(rows) for c in (0, 1)]
    found = texts.join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id").distinct()
    of_class = [found.filter(F.col("label") == c).orderBy(*order, "text").limit(rows) for c in (0, 1)]
    got = of_class[0].unionByName(of_class[1]).orderBy("doc_id", "label", "text").select("text", "label").toPandas()
    return [t or "" for t in got["text"]], got["label"].to_numpy(dtype=float)
