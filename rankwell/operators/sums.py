"""Sums of a small batch of queries over postings that lie together by document, as arrays.

What workers run is kept in closures over numpy and pyarrow, so they need not import this package.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from rankwell.operators.boolean import MUST, MUST_NOT

MATCHES_AT_ONCE = 1 << 16  # of whole documents, in one step of a task: what a processor's cache holds
SPARSE = 4  # cells for each match beyond which matches are sorted instead of counted in place


def sum_by_document(asked: DataFrame, clauses: DataFrame, vsm: bool) -> DataFrame:
    """``(query_ord, ord, score)`` of ``clauses(word, ord, clause)``, whose partitions hold whole documents.

    ``asked``: a row for each word of a query, collected, with its ``word`` number from 0 and a ``weight``. Rows
    ``(query_ord, word, weight, share)``: a score is the sum of weighted clauses, under tf-idf times that of the shares.
    Rows with ``chunk``, ``slot``, ``width``, ``chunks``, ``musts``, ``must`` and ``must_not``: clauses are summed by
    position, chunk and query, with the factors and exclusions of ``score_clauses``.
    """
    types = asked.schema["query_ord"].dataType.simpleString(), clauses.schema["ord"].dataType.simpleString()
    shared = asked.sparkSession.sparkContext.broadcast(_numbered(asked.toArrow()))
    return clauses.mapInArrow(_sums(lambda: shared.value, vsm), f"query_ord {types[0]}, ord {types[1]}, score double")


def _numbered(rows: pa.Table) -> dict:
    """The rows by word, and the place of each: a query, or a position of a chunk of a query. Places are numbered in
    the order of queries and chunks."""
    columns = {name: rows[name].combine_chunks().to_numpy(zero_copy_only=False) for name in rows.column_names if name != "query_ord"}
    queries = pc.unique(rows["query_ord"])
    query = pc.index_in(rows["query_ord"], value_set=queries).combine_chunks().to_numpy(zero_copy_only=False)
    clauses = "chunk" in columns
    parts = [query, columns["chunk"], columns["slot"]] if clauses else [query]
    keys = np.stack([np.asarray(part, "int64") for part in parts], axis=1).reshape(len(query), len(parts))
    places, place = np.unique(keys, axis=0, return_inverse=True)
    place = place.reshape(-1)
    first = np.zeros(len(places), "int64")
    first[place] = np.arange(len(place))  # any row of the place: they agree in what is read from it
    word = columns["word"].astype("int64")
    by_word = np.argsort(word, kind="stable")
    found = {
        "queries": queries,
        "starts": np.searchsorted(word[by_word], np.arange(word.max(initial=-1) + 2)),
        "place": place[by_word],
        "weight": columns["weight"][by_word],
        "query_of_place": places[:, 0],
    }
    if not clauses:
        return found | {"share": columns["share"][by_word]}
    chunk = np.unique(places[:, :2], axis=0, return_inverse=True)[1].reshape(-1)
    operators = bool(columns[MUST].any() or columns[MUST_NOT].any())
    found |= {"chunk_of_place": chunk, "chunks": int(chunk.max(initial=-1)) + 1, "operators": operators}
    return found | {"facts": {name: columns[name][first] for name in ("width", "chunks", "musts", MUST, MUST_NOT)}}


def _sums(held: Callable[[], dict], vsm: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    matches_at_once, sparse, must, must_not = MATCHES_AT_ONCE, SPARSE, MUST, MUST_NOT

    def cells(key: np.ndarray, most: int, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
        """The keys that occur, in order, and the sums of some weights of each."""
        if most > sparse * len(key):
            found, key = np.unique(key, return_inverse=True)
            return found, *(np.bincount(key, weight, len(found)) for weight in weights)
        found = np.flatnonzero(np.bincount(key, minlength=most))
        return found, *(np.bincount(key, weight, most)[found] for weight in weights)

    def runs(*keys: np.ndarray) -> np.ndarray:
        """Where runs of equal keys start."""
        changes = np.zeros(len(keys[0]), bool)
        changes[:1] = True
        for key in keys:
            changes[1:] |= key[1:] != key[:-1]
        return np.flatnonzero(changes)

    def located(found: np.ndarray, docs: int, places: int) -> tuple[np.ndarray, np.ndarray]:
        """Document and place of cells."""
        doc = np.repeat(np.arange(docs), np.diff(np.searchsorted(found, np.arange(docs + 1) * places)))
        return doc, found - doc * places

    def plain(table: dict, key: np.ndarray, row: np.ndarray, value: np.ndarray, docs: int) -> tuple[np.ndarray, ...]:
        places = len(table["query_of_place"])
        shares = [table["share"][row]] if vsm else []
        found, score, *share = cells(key, docs * places, value, *shares)
        doc, place = located(found, docs, places)
        return doc, table["query_of_place"][place], score * share[0] if vsm else score

    def structured(table: dict, key: np.ndarray, row: np.ndarray, value: np.ndarray, docs: int) -> tuple[np.ndarray, ...]:
        places, facts = len(table["query_of_place"]), table["facts"]
        found, part = cells(key, docs * places, value)
        doc, place = located(found, docs, places)
        if table["chunks"] < places:
            at = runs(doc, table["chunk_of_place"][place])
            part, matched, doc, place = np.add.reduceat(part, at), np.diff(np.r_[at, len(part)]), doc[at], place[at]
            if vsm:
                part = part * (matched / facts["width"][place])
        query = table["query_of_place"][place]
        at = runs(doc, query)
        if not table["operators"]:
            total, scoring = np.add.reduceat(part, at), np.diff(np.r_[at, len(part)])
            kept = slice(None)
        else:
            of_must, of_must_not = facts[must][place], facts[must_not][place]
            total = np.add.reduceat(np.where(of_must_not, 0.0, part), at)
            musts, excluded, scoring = (np.add.reduceat(of.astype("int64"), at) for of in (of_must, of_must_not, ~of_must_not))
            kept = (excluded == 0) & (musts == facts["musts"][place[at]]) & (scoring > 0)
        if vsm:
            total = total * (scoring / facts["chunks"][place[at]])
        return doc[at][kept], query[at][kept], total[kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        postings = [batch for batch in batches if batch.num_rows]
        if not postings:
            return
        table = held()
        postings = pa.Table.from_batches(postings)
        ords = postings["ord"].combine_chunks().dictionary_encode()
        doc = ords.indices.to_numpy(zero_copy_only=False).astype("int64")
        word = postings["word"].combine_chunks().to_numpy(zero_copy_only=False).astype("int64")
        clause = postings["clause"].combine_chunks().to_numpy(zero_copy_only=False)
        by_doc = np.argsort(doc, kind="stable")
        doc, word, clause = doc[by_doc], word[by_doc], clause[by_doc]
        first = np.searchsorted(doc, np.arange(len(ords.dictionary) + 1))
        count = np.diff(table["starts"])[word]
        before = np.r_[0, np.cumsum(count)]
        matches = before[first]
        summed = structured if "facts" in table else plain
        places, at = len(table["query_of_place"]), 0
        while at < len(first) - 1:
            to = max(int(np.searchsorted(matches, matches[at] + matches_at_once, "right")) - 1, at + 1)
            inside = slice(first[at], first[to])
            n = count[inside]
            ends = np.cumsum(n)
            row = np.arange(ends[-1]) + np.repeat(table["starts"][word[inside]] - (ends - n), n)
            value = np.repeat(clause[inside], n) * table["weight"][row]
            found, query, score = summed(table, np.repeat((doc[inside] - at) * places, n) + table["place"][row], row, value, to - at)
            columns = [table["queries"].take(pa.array(query)), ords.dictionary.take(pa.array(found + at)), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, ["query_ord", "ord", "score"])
            at = to

    return run
