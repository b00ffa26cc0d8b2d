"""A whole batch of queries against an index, in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwell.functions.scoring import VSM, resolve_similarity
from rankwell.operators.boolean import OPERATORS, SHOULD, analyzed_chunks, assign_occur, valid_queries
from rankwell.operators.matching import score_clauses, score_terms, spread_by_document, with_stats
from rankwell.operators.postings import token_rows
from rankwell.operators.ranking import fetch_fields, top_hits, top_k
from rankwell.operators.sizing import BROADCAST_BYTES, BROADCAST_ROWS
from rankwell.operators.synonyms import SynonymRules
from rankwell.plans.build import Index
from rankwell.schema import QUESTION, QUESTION_FIELD
from rankwell.sources.scratch import materialize


# Punctuation between two word characters of one chunk: only there can a chunk fall into several terms.
_INNER_BREAK = r"[\p{L}\p{M}\p{Nd}_][^\p{L}\p{M}\p{Nd}_ \t\r\n\u3000]++[\p{L}\p{M}\p{Nd}_]"


@dataclass(frozen=True)
class Batch:
    """What one aggregate over the query bodies tells about them."""

    queries: int
    size: int
    longest: int
    operators: bool
    compound: bool

    @property
    def terms(self) -> int:
        """Bound on the query terms: each takes a character, and a separator from the next."""
        return self.size // 2 + self.queries


def inspect(queries: DataFrame) -> Batch:
    """One pass over the query bodies."""
    # a chunk of its own, or joined to another by white space only; a longer word that holds one is none
    operator = rf"(^|[ \t\r\n\u3000])({'|'.join(OPERATORS)})([ \t\r\n\u3000]|$)"
    count, size, longest, operators, compound = queries.agg(
        F.count(F.lit(1)),
        F.coalesce(F.sum(F.octet_length("body").cast("long")), F.lit(0)),
        F.coalesce(F.max(F.length("body")), F.lit(0)),
        F.coalesce(F.some(F.col("body").rlike(operator)), F.lit(False)),
        F.coalesce(F.some(F.col("body").rlike(_INNER_BREAK)), F.lit(False)),
    ).first()
    return Batch(count, size, longest, operators, compound)


def clause_terms(
    queries: DataFrame,
    chain: str = "standard",
    synonyms: SynonymRules | DataFrame | None = None,
    operators: bool = True,
) -> DataFrame:
    """``(query_ord, chunk, occur, pos, term)`` of valid queries; ``operators=False`` when no body can hold one."""
    chunks = analyzed_chunks(queries, chain, synonyms)
    clauses = assign_occur(chunks) if operators else chunks.withColumn("occur", F.lit(SHOULD))
    return token_rows(clauses, "query_ord", "chunk", "occur")


@dataclass(frozen=True)
class Scores:
    """``(query_ord, ord, score)`` of every matching document, and a bound on the query terms if they are few."""

    rows: DataFrame
    terms: int | None


def score(
    queries: DataFrame,
    index: Index,
    sim: int | None = None,
    field: str = QUESTION_FIELD,
    synonyms: SynonymRules | DataFrame | None = None,
    norms: str = "quantized",
    batch: Batch | None = None,
    **params: float,
) -> Scores:
    """Score every matching document of queries already known to be valid."""
    sim = resolve_similarity(sim)
    index = index if index.stored else index.analyzed_once(field)
    batch = batch or inspect(queries)
    terms = clause_terms(queries, "standard" if synonyms is None else "synonym", synonyms, batch.operators)
    if synonyms is not None or index.stored:
        terms = materialize(terms, "query-terms")
    if synonyms is None:
        count, size = batch.terms, batch.size
    else:
        count, size = terms.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("term").cast("long")), F.lit(0))).first()
    small = count <= BROADCAST_ROWS and size <= BROADCAST_BYTES
    postings, stats = index.postings[field], index.term_stats[field]
    if small and index.lookup is not None:
        postings, stats = index.lookup(field, terms)
    plain = not batch.operators and (sim != VSM or (synonyms is None and not batch.compound))
    if plain:
        terms = terms.groupBy("query_ord", "term").agg(F.count(F.lit(1)).alias("qtf"))
    weighted = with_stats(
        terms.withColumn("field", F.lit(field)),
        stats,
        index.collection_stats,
        small,
    )
    together = small and not index.stored
    if together:
        postings = spread_by_document(weighted, postings)
    if plain:
        rows = score_terms(weighted, postings, sim, small, norms, together, **params)
    else:
        rows = score_clauses(weighted, postings, sim, small, norms, synonyms is not None, together, **params)
    return Scores(rows, count if small else None)


def search(
    queries: DataFrame,
    index: Index,
    sim: int | None = None,
    k: int = 3,
    field: str = QUESTION_FIELD,
    synonyms: SynonymRules | DataFrame | None = None,
    norms: str = "quantized",
    totals: bool = True,
    **params: float,
) -> DataFrame:
    """``(query_ord, query_id, rank, ord, doc_id, score, total_hits)``: the ``k`` best documents of each query.

    ``queries(id, topic, body, ord)``: the body is the query, ``ord`` tells repeated ids apart. ``field`` is the
    document field searched. With ``synonyms`` the queries are expanded as the index was. ``params``: k1, b, mu, lam.
    ``totals=False`` leaves the column out and saves counting the matches. Over a stored index the hits, at most ``k``
    rows a query, are worked out at once and written down, whatever the size of the batch: the result stays as it was
    when the index is written to afterwards. Over an index that is not stored everything stays lazy.
    """
    rules = None if synonyms is None else SynonymRules.of(synonyms)
    batch = inspect(queries)
    accepted = valid_queries(queries, "standard" if rules is None else "synonym", rules, batch.longest)
    scores = score(accepted, index, sim, field, rules, norms, batch, **params)
    few = scores.terms is not None and batch.queries * k <= BROADCAST_ROWS
    hits = top_hits(scores.rows, k) if totals else top_k(scores.rows, k)
    if index.stored:
        hits = materialize(hits, "hits")
    hits = fetch_fields(hits, index.docs, small=few)
    ids = accepted.select(F.col("ord").alias("query_ord"), F.col("id").alias("query_id"))
    columns = ["query_ord", "query_id", "rank", "ord", "doc_id", "score"] + (["total_hits"] if totals else [])
    return hits.join(ids, "query_ord").select(*columns)


def adhoc_query(spark: SparkSession, text: str, id: str = "0100") -> DataFrame:
    """One free-text query as a one-row query set."""
    return spark.createDataFrame([(id, "topic", text, 0)], QUESTION)


def search_text(text: str, index: Index, **options) -> DataFrame:
    """``search`` for one text."""
    return search(adhoc_query(index.docs.sparkSession, text), index, **options)
