"""Questions -> index tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwell.operators.analysis import analyze
from rankwell.operators.postings import build_postings, collection_stats, doc_lengths, term_stats, with_average_length
from rankwell.operators.synonyms import SynonymRules
from rankwell.schema import FIELDS
from rankwell.sources.scratch import materialize


@dataclass(frozen=True)
class Index:
    """Index tables, lazy or read from storage; ``postings`` and ``doc_stats`` are kept per field.

    docs: ord, doc_id, topic, question. postings: field, term, ord, tf, positions, dl. doc_stats: field, ord,
    num_tokens, dl. term_stats: field, term, df, ttf. collection_stats: field, max_doc, sum_ttf, avgdl. A stored index has
    a ``lookup``: of a field and a few terms, the postings and term statistics that can matter to them.
    """

    docs: DataFrame
    postings: dict[str, DataFrame]
    doc_stats: dict[str, DataFrame]
    term_stats: dict[str, DataFrame]
    collection_stats: DataFrame
    lookup: Callable[[str, DataFrame], tuple[DataFrame, DataFrame]] | None = None
    once: dict[str, Index] = field(default_factory=dict, repr=False, compare=False)

    @property
    def stored(self) -> bool:
        return self.lookup is not None

    def analyzed_once(self, field: str) -> Index:
        """This index with the postings of one field written, and its statistics taken from them: a search reads them
        several times, and the text is analysed once. Kept for the searches that follow."""
        if field not in self.once:
            columns = "field", "term", "ord", "tf", "dl"
            written = materialize(self.postings[field].select(*columns), "postings")
            stats = materialize(term_stats(written), "term-stats")
            count = self.docs.agg(F.lit(field).alias("field"), F.count(F.lit(1)).alias("max_doc"))
            tokens = stats.agg(F.coalesce(F.sum("ttf"), F.lit(0)).alias("sum_ttf"))
            totals = materialize(with_average_length(count.crossJoin(F.broadcast(tokens))), "collection-stats")
            self.once[field] = replace(self, postings={field: written}, term_stats={field: stats}, collection_stats=totals)
        return self.once[field]

    def all_postings(self) -> DataFrame:
        return _union(self.postings)

    def all_doc_stats(self) -> DataFrame:
        return _union(self.doc_stats)

    def all_term_stats(self) -> DataFrame:
        return _union(self.term_stats)


def _union(tables: dict[str, DataFrame]) -> DataFrame:
    first, *rest = tables.values()
    for table in rest:
        first = first.unionByName(table)
    return first


def to_documents(questions: DataFrame) -> DataFrame:
    """Question -> document: body becomes ``question``, id becomes ``doc_id``; ``ord`` stays the real key."""
    return questions.select("ord", F.col("id").alias("doc_id"), "topic", F.col("body").alias("question"))


def analyze_field(
    docs: DataFrame,
    field: str,
    synonyms: SynonymRules | DataFrame | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """``(field, ord, tokens)`` of one document field, spread by ``ord``.

    The raw text is shuffled once, the smallest form the data has; everything per document or per (term, document)
    then stays where it is.
    """
    text = docs.select(F.lit(field).alias("field"), "ord", F.coalesce(field, F.lit("")).alias("text"))
    rules = None if synonyms is None else SynonymRules.of(synonyms)
    if rules is not None and not rules.small:  # its expansion spreads the words itself
        return analyze(text, "text", "synonym", rules, ["ord"]).select("field", "ord", "tokens")
    spread = text.repartition(partitions, "ord") if partitions else text.repartition("ord")
    chain = "standard" if rules is None else "synonym"
    return analyze(spread, "text", chain, rules, ["ord"]).select("field", "ord", "tokens")


def build_index(
    questions: DataFrame,
    synonyms: SynonymRules | DataFrame | None = None,
    fields: tuple[str, ...] = FIELDS,
    partitions: int | None = None,
) -> Index:
    """Lazy index over ``(id, topic, body, ord)``; nothing runs until a table is used or written."""
    docs = to_documents(questions)
    rules = None if synonyms is None else SynonymRules.of(synonyms)
    analyzed = {field: analyze_field(docs, field, rules, partitions) for field in fields}
    postings = {field: build_postings(rows) for field, rows in analyzed.items()}
    doc_stats = {field: doc_lengths(rows) for field, rows in analyzed.items()}
    return Index(
        docs=docs,
        postings=postings,
        doc_stats=doc_stats,
        term_stats={field: term_stats(rows) for field, rows in postings.items()},
        collection_stats=collection_stats(_union(doc_stats)),
    )


def index_count(index: Index) -> DataFrame:
    """One row: documents in the index."""
    return index.docs.agg(F.count(F.lit(1)).alias("documents"))
