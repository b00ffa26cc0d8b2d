"""Line tags and document quality by a conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankwell.llm.chain import Chain, fit, fit_logistic, logistic, marginals, training_rows
from rankwell.llm.common import held_out

TRAINING_ROWS = 2_000  # labelled documents of each class at most
LONGEST_TRAINING_TEXT = 50_000  # bytes; longer ones are scored whole, but not learnt from
_BATCH_BYTES = 2 << 20

# byte classes, in order: letters, capitals, digits, space, full stop and comma, exclamation and question mark, bar,
# other ASCII punctuation, bytes beyond ASCII, control characters
_N_CLASSES = 10
_CLASS = np.full(256, 9, np.uint8)
_CLASS[128:] = 8
for _i, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", ".,", "!?", "|")):
    _CLASS[list(_chars.encode())] = _i
_CLASS[list(b"\"#$%&'()*+-/:;<=>@[\\]^_`{}~")] = 7
_LINE_FEED = 10

_FACTOR = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses modulo 2**64
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_BYTE_CODES = np.random.default_rng(6).integers(1, 1 << 62, 256, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[:1] = 1
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line of the texts (with its neighbours'), lines' byte lengths, and lines per text.

    A line's own features: shares of ten byte classes, its length, words and their length, share of words equal to the
    word before, whether it equals the line before, is empty, begins with a capital, and ends with a full stop.
    """
    encoded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    lines_of = np.array([e.count(b"\n") + 1 for e in encoded], dtype=np.int64)
    data = np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8)
    ends = np.flatnonzero(data == _LINE_FEED)
    starts = np.r_[0, ends[:-1] + 1]
    lengths = ends - starts
    n = len(ends)
    line = np.repeat(np.arange(n), lengths + 1)
    counts = np.bincount(line * _N_CLASSES + _CLASS[data], minlength=n * _N_CLASSES).reshape(n, _N_CLASSES).astype(float)
    counts[:, 9] -= 1  # the line feed itself
    size = np.maximum(lengths, 1)

    space = (data == 32) | (data == _LINE_FEED) | (data == 9)
    begins = np.flatnonzero(~space & np.r_[True, space[:-1]])
    finishes = np.flatnonzero(~space & np.r_[space[1:], True]) + 1
    codes = np.cumsum(_BYTE_CODES[data] * _powers(_FACTOR, len(data)))
    codes = np.r_[np.uint64(0), codes]
    inverse = _powers(_INVERSE, len(data) + 1)
    hashes = (codes[finishes] - codes[begins]) * inverse[begins]
    word_line = line[begins]
    words = np.bincount(word_line, minlength=n)
    same = np.r_[False, (hashes[1:] == hashes[:-1]) & (word_line[1:] == word_line[:-1])] if len(begins) else np.zeros(0, bool)
    repeated = np.bincount(word_line[same], minlength=n)
    whole = (codes[ends] - codes[starts]) * inverse[starts]
    last = data[np.maximum(ends - 1, 0)]

    first = np.zeros(n, bool)
    first[np.cumsum(lines_of) - lines_of] = True
    own = np.column_stack([
        counts / size[:, None],
        np.log1p(lengths) / 5,
        np.log1p(words) / 3,
        np.log1p((lengths - counts[:, 3]) / np.maximum(words, 1)) / 2,
        repeated / np.maximum(words, 1),
        np.r_[False, (whole[1:] == whole[:-1]) & (lengths[1:] > 0)] & ~first,
        lengths == 0,
        (counts[:, 1] > 0) & (_CLASS[data[starts]] == 1),
        (last == 46) & (lengths > 0),
        np.minimum(counts[:, [1, 4, 5, 6, 7]] / np.maximum(words, 1)[:, None], 2),
    ])
    final = np.r_[first[1:], True]
    above = np.where(first[:, None], 0.0, np.vstack([own[:1], own[:-1]]))
    below = np.where(final[:, None], 0.0, np.vstack([own[1:], own[-1:]]))
    return np.column_stack([own, above, below, first, final, np.ones(n)]), lengths, lines_of


@dataclass
class QualityModel:
    """``weights`` of the line features for a good line, the chain between lines, and of the document's summary."""

    weights: np.ndarray | None = None
    chain: Chain = field(default_factory=Chain)
    document: np.ndarray = field(default_factory=lambda: np.zeros(5))

    def line_marginals(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        features, lengths, lines_of = line_features(texts)
        first = np.zeros(len(lengths), bool)
        first[np.cumsum(lines_of) - lines_of] = True
        scores = features @ self.weights if self.weights is not None else np.zeros(len(features))
        return marginals(scores, first, self.chain), lengths, lines_of

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = [logistic(_summaries(*self.line_marginals(part)), self.document) for part in _portions(texts)]
        return np.concatenate(out) if out else np.zeros(0)


def _portions(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Whole texts, about as many at a time as memory likes."""
    part, held = [], 0
    for text in texts:
        part.append(text)
        held += len(text or "")
        if held > _BATCH_BYTES:
            yield part
            part, held = [], 0
    if part:
        yield part


def _summaries(good: np.ndarray, lengths: np.ndarray, lines_of: np.ndarray) -> np.ndarray:
    """Per document: the length-weighted mean of its lines' marginals, that as log-odds, the worst line, its length."""
    weight = lengths + 1.0
    begin = np.cumsum(lines_of) - lines_of
    total = np.add.reduceat(weight, begin)
    mean = np.add.reduceat(weight * good, begin) / total
    worst = np.minimum.reduceat(good, begin)
    bounded = np.clip(mean, 1e-4, 1 - 1e-4)
    return np.column_stack([mean, np.log(bounded / (1 - bounded)), worst, np.log(total) / 5])


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    rows: int = TRAINING_ROWS,
    longest_text: int = LONGEST_TRAINING_TEXT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> QualityModel:
    """Learns from ``labels`` (doc_id, quality): at most ``rows`` documents of each class, never those held out.

    Texts of over ``longest_text`` bytes are not learnt from (all are scored whole), so the training texts are bounded.

    Only documents are labelled, so at first every line has its document's label. A second fit gives the lines of bad
    documents that the first holds for good the label good. A logistic function of a document's length-weighted
    marginals is then fitted to the documents' labels. Without labels of both classes every document scores a half.
    """
    texts, good = training_rows(docs, labels, "quality", rows, longest_text, id_col=id_col, text_col=text_col)
    if not 0 < good.sum() < len(good):
        return QualityModel()
    described = [line_features(part) for part in _portions(texts)]
    features, lengths, lines_of = (np.concatenate(x) for x in zip(*described, strict=True))
    first = np.zeros(len(lengths), bool)
    first[np.cumsum(lines_of) - lines_of] = True
    tags = np.repeat(good, lines_of)
    model = QualityModel(*fit(features, tags, first, rounds=150, rate=0.15))
    probable = marginals(features @ model.weights, first, model.chain)
    clearer = np.where((tags == 0) & (probable > 0.5), 1.0, tags)
    if 0 < clearer.sum() < len(clearer):
        model = QualityModel(*fit(features, clearer, first, rounds=150, rate=0.15))
        probable = marginals(features @ model.weights, first, model.chain)
    model.document = fit_logistic(_summaries(probable, lengths, lines_of), good, decay=1e-3)
    return model


def quality_score(model: QualityModel) -> Column:
    """A function of a text column: the probability that a document with this text is good.

    Null scores like the empty text: as one empty line. Texts are scored whole, repeated ones alike.
    """

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.scores(texts.tolist()))

    return score


def keep_good(docs: DataFrame, model: QualityModel, *, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """``docs`` with the rows whose score is ``threshold`` or more; all columns as they were.

    A model that learnt from labels of one class only, or from none, scores a half: every row stays.
    """
    return docs.filter(quality_score(model)(docs[text_col].cast("string")) >= threshold)


def tag_lines(docs: DataFrame, model: QualityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, lines): for every line of the text, in order, the probability that it is good.

    Null and empty texts have one empty line. Every row gives one row.
    """

    @F.pandas_udf("struct<score: double, lines: array<double>>")
    def tag(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [model.line_marginals([t]) for t in texts]
            yield pd.DataFrame({
                "score": np.concatenate([logistic(_summaries(*r), model.document) for r in rows] + [np.zeros(0)]),
                "lines": [r[0] for r in rows],
            })

    tagged = docs.select(docs[id_col].alias("doc_id"), tag(docs[text_col].cast("string")).alias("found"))
    return tagged.select("doc_id", "found.score", "found.lines")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    score = quality_score(fit_quality(docs, labels))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text").cast("string")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
