"""Toxic spans and document scores by a conditional random field over words."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from sys import intern
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankwell.llm.chain import Chain, OneHot, fit, fit_logistic, logistic, marginals, training_rows
from rankwell.llm.common import held_out

TRAINING_ROWS = 1_500  # labelled documents of each class at most
LONGEST_TRAINING_TEXT = 20_000  # bytes; longer ones are scored whole, but not learnt from
MEMO_WORDS = 300_000
_BATCH_WORDS = 1_000_000

_WORD = re.compile(r"[^\W\d_]+")
_PREFIXES = range(3, 9)
_EDGES = np.array([-1.0, 0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 4.5])
_NO_EVIDENCE = len(_EDGES) + 1
_SEEN = 20  # words of the training rows from which a step of evidence has a weight of its own
_LONGER_SHARE = 0.4
_SEED = 2.0  # evidence from which a word of a toxic document is labelled toxic


def _forms(word: str) -> list[str]:
    """A word as itself, and as what begins with its first letters."""
    return [word, *(word[:n] + "*" for n in _PREFIXES if n < len(word))]


@dataclass
class ToxicityModel:
    """``evidence``: log-odds of word forms, less 1.5 standard errors; ``emission``: one weight per step of evidence."""

    evidence: dict[str, float]
    emission: np.ndarray = field(default_factory=lambda: np.zeros(_NO_EVIDENCE + 1))
    chain: Chain = field(default_factory=Chain)
    document: np.ndarray = field(default_factory=lambda: np.zeros(4))
    learnt: bool = True  # false where the labels had one class only, or none: all scores are a half and tell nothing
    _steps: dict[str, int] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_steps": {}}

    def _step(self, word: str) -> int:
        known = [self.evidence[f] for f in (_forms(word) if word not in self.evidence else [word]) if f in self.evidence]
        return int(np.searchsorted(_EDGES, max(known))) if known else _NO_EVIDENCE

    def steps(self, words: list[str]) -> np.ndarray:
        memo = self._steps
        try:
            return np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
        except KeyError:
            if len(memo) > MEMO_WORDS:
                memo.clear()
            for word in words:
                if word not in memo:
                    memo[word] = self._step(word)
            return np.fromiter(map(memo.__getitem__, words), np.int64, len(words))

    def forget(self) -> None:
        """Drops the words met: Python workers live on, and with them the models of earlier jobs."""
        self._steps.clear()

    def word_marginals(self, documents: list[np.ndarray]) -> list[np.ndarray]:
        lengths = np.array([len(d) for d in documents], dtype=np.int64)
        steps = np.concatenate([*documents, np.zeros(0, np.int64)])
        first = np.zeros(len(steps), bool)
        first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
        return np.split(marginals(self.emission[steps], first, self.chain), np.cumsum(lengths)[:-1])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Document scores from the words' marginals; as many words at a time as memory likes."""
        out, part, held = [], [], 0
        for text in texts:
            part.append(self.steps(_WORD.findall((text or "").lower())))
            held += len(part[-1])
            if held > _BATCH_WORDS:
                out.append(logistic(_summaries(self.word_marginals(part)), self.document))
                part, held = [], 0
        if part:
            out.append(logistic(_summaries(self.word_marginals(part)), self.document))
        return np.concatenate(out) if out else np.zeros(0)

    def spans(self, text: str | None) -> list[tuple[int, int, float]]:
        """(start, end, probability) in characters: neighbouring words with a marginal of a half or more."""
        places = [(m.start(), m.end()) for m in _WORD.finditer(text or "")]
        words = [text[a:b].lower() for a, b in places]
        (probability,) = self.word_marginals([self.steps(words)])
        found: list[tuple[int, int, float]] = []
        for i in np.flatnonzero(probability >= 0.5):
            start, end = places[i]
            if found and i and places[i - 1][1] == found[-1][1]:
                start = found.pop()[0]
            found.append((start, end, float(probability[i])))
        return found


def _summaries(documents: list[np.ndarray]) -> np.ndarray:
    """Per document: log-odds of the likeliest toxic word, log of the expected number, and the share of words."""
    rows = np.zeros((len(documents), 3))
    for i, p in enumerate(documents):
        top = np.clip(p.max(), 1e-4, 1 - 1e-4) if len(p) else 1e-4
        rows[i] = np.log(top / (1 - top)), np.log(p.sum() + 0.01), np.log(p.mean() + 1e-4) if len(p) else np.log(1e-4)
    return rows


def _copy_groups(documents: list[list[str]]) -> np.ndarray:
    """A number per document, equal for those that share one of four smallest hashes of three words in a row.

    Words of a text with many near copies would else look bound to its label.
    """
    parent = list(range(len(documents)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    seen: dict[tuple[int, int], int] = {}
    for i, words in enumerate(documents):
        hashes = np.array([crc32(" ".join(words[j : j + 3]).encode()) for j in range(max(1, len(words) - 2))], np.uint64)
        for n, factor in enumerate((0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)):
            smallest = int((hashes * np.uint64(factor) % np.uint64(1 << 32)).min())
            parent[root(i)] = root(seen.setdefault((n, smallest), i))
    return np.array([root(i) for i in range(len(documents))])


def _group_counts(words: list[list[str]], copies: np.ndarray, chosen: np.ndarray, wanted: set[str] | None) -> Counter:
    """Groups of copies, of the chosen documents, that hold a form; one group's forms are held at a time."""
    members: dict[int, list[int]] = {}
    for i in np.flatnonzero(chosen):
        members.setdefault(int(copies[i]), []).append(i)
    counts: Counter = Counter()
    for group in members.values():
        forms = {f for w in {w for i in group for w in words[i]} for f in _forms(w)}
        counts.update(forms if wanted is None else forms & wanted)
    return counts


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    *,
    rows: int = TRAINING_ROWS,
    longest_text: int = LONGEST_TRAINING_TEXT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> ToxicityModel:
    """Learns from ``labels`` (doc_id, toxic): at most ``rows`` documents of each class, never those held out.

    Texts of over ``longest_text`` bytes are not learnt from (all are scored whole), so the training texts are bounded.

    Only documents are labelled, so words get labels first: in toxic documents those whose form (the word, or what
    begins with its first three to eight letters) is bound to such documents: log-odds less 1.5 standard errors of two
    or more, a group of near copies counted once. A beginning of which one longer form makes two fifths is left to that
    form, and a word that is known as such goes by itself. All other words are clean. A chain over the steps of that evidence is then fitted to the labelled words, and a
    logistic function of what its marginals come to in a document to the documents' labels. Without labels of both
    classes every document scores a half.
    """
    texts, toxic = training_rows(docs, labels, "toxic", rows, longest_text, id_col=id_col, text_col=text_col)
    words = [list(map(intern, _WORD.findall(text.lower()))) for text in texts]
    if not 0 < toxic.sum() < len(toxic):
        return ToxicityModel({}, learnt=False)
    copies = _copy_groups(words)
    with_form = {1: _group_counts(words, copies, toxic == 1, None)}
    with_form[1] = Counter({form: a for form, a in with_form[1].items() if a >= 3})
    largest: Counter = Counter()  # of what a beginning of words goes on to, the form that most groups hold
    for form, a in with_form[1].items():
        stem = form.rstrip("*")
        for n in _PREFIXES:
            if n < len(stem) or (n == len(stem) and form == stem):
                largest[stem[:n] + "*"] = max(largest[stem[:n] + "*"], a)
    # a beginning tells something of its own only where no longer form tells most of it
    with_form[1] = Counter({f: a for f, a in with_form[1].items() if largest[f] <= _LONGER_SHARE * a})
    with_form[0] = _group_counts(words, copies, toxic == 0, set(with_form[1]))
    n1, n0 = len(set(copies[toxic == 1])), len(set(copies[toxic == 0]))
    evidence = {}
    for form, a in with_form[1].items():
        c = with_form[0][form]
        odds = np.log((a + 0.5) / (n1 + 1)) - np.log((c + 0.5) / (n0 + 1))
        evidence[form] = float(odds - 1.5 * np.sqrt(1 / (a + 0.5) + 1 / (c + 0.5)))
    model = ToxicityModel({f: e for f, e in evidence.items() if e > _EDGES[0]})
    steps = [model.steps(own) for own in words]
    del texts, words  # the driver holds either the words or the fit
    model.forget()
    seed_step = int(np.searchsorted(_EDGES, _SEED, side="right"))
    tags = [((s >= seed_step) & (s < _NO_EVIDENCE)) * label for s, label in zip(steps, toxic, strict=True)]
    lengths = np.array([len(own) for own in steps])
    if lengths.sum():
        flat = np.concatenate(steps)
        first = np.zeros(len(flat), bool)
        first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
        model.emission, model.chain = fit(OneHot(flat, _NO_EVIDENCE + 1), np.concatenate(tags).astype(float), first)
        seen = np.bincount(flat, minlength=_NO_EVIDENCE + 1) >= _SEEN
        for step in range(_NO_EVIDENCE):  # a step hardly met weighs what the one below does
            if not seen[step]:
                model.emission[step] = model.emission[step - 1 if step else _NO_EVIDENCE]
    model.document = fit_logistic(_summaries(model.word_marginals(steps)), toxic, decay=1e-3)
    return model


def toxicity_score(model: ToxicityModel) -> Column:
    """A function of a text column: the probability that a document with this text is toxic.

    Null scores like the empty text: as a document without words. Texts are scored whole, repeated ones alike.
    """
    shared = _share(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.scores(texts.tolist()))
        shared.value.forget()

    return score


def _share(model):
    from pyspark.sql import SparkSession

    return SparkSession.active().sparkContext.broadcast(model)  # at most the forms of the training rows


def keep_clean(docs: DataFrame, model: ToxicityModel, *, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose score is ``threshold`` or more; all columns as they were.

    A model that learnt from labels of one class only, or from none, knows no toxic document: every row stays.
    """
    if not model.learnt:
        return docs
    return docs.filter(toxicity_score(model)(docs[text_col].cast("string")) < threshold)


def tag_toxic_spans(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, spans): spans are (start, end, probability), in characters of the whole text.

    Null and empty texts have no spans and the score of a document without words. Every row gives one row.
    """
    shared = _share(model)

    @F.pandas_udf("struct<score: double, spans: array<struct<start: long, end: long, probability: double>>>")
    def tag(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            scores = shared.value.scores(texts.tolist())
            spans = [[dict(zip(("start", "end", "probability"), s, strict=True)) for s in shared.value.spans(t)] for t in texts]
            yield pd.DataFrame({"score": scores, "spans": spans})
        shared.value.forget()

    tagged = docs.select(docs[id_col].alias("doc_id"), tag(docs[text_col].cast("string")).alias("found"))
    return tagged.select("doc_id", "found.score", "found.spans")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    score = toxicity_score(fit_toxicity(docs, labels))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text").cast("string")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
