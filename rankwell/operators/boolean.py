"""Must / should / must-not clauses of free-text queries, and which documents they keep.

Only the upper-case words AND, OR and NOT, standing alone, act as operators; every other character is literal text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankwell.functions.text import query_chunks
from rankwell.operators.analysis import analyze, chunk_rows
from rankwell.operators.skew import lookup_join
from rankwell.operators.synonyms import SynonymRules
from rankwell.sources.scratch import materialize

OPERATORS = ("AND", "OR", "NOT")
MUST, SHOULD, MUST_NOT = "must", "should", "must_not"
MAX_CLAUSES = 1024

_S = r"[ \t\r\n\u3000]"
# A leading AND / OR; a trailing operator; two operators in a row other than AND NOT and OR NOT.
_MALFORMED = (
    rf"^{_S}*+(?:AND|OR)(?:{_S}|$)"
    rf"|(?:^|{_S})(?:AND|OR|NOT){_S}*+$"
    rf"|(?:^|{_S})(?:AND|OR|NOT){_S}++(?:AND|OR)(?={_S}|$)"
    rf"|(?:^|{_S})NOT{_S}++NOT(?={_S}|$)"
)


def valid_query(body: Column | str) -> Column:
    """Whether a body is a query at all: some text, operators in their places."""
    text = F.coalesce(F.col(body) if isinstance(body, str) else body, F.lit(""))
    return (F.size(query_chunks(text)) > 0) & ~text.rlike(_MALFORMED)


def analyzed_chunks(
    queries: DataFrame, chain: str = "standard", synonyms: SynonymRules | DataFrame | None = None
) -> DataFrame:
    """``(query_ord, chunk, text, tokens)``: the chunks of each body, operators included, with their terms."""
    return analyze(chunk_rows(queries), "text", chain, synonyms, ["query_ord", "chunk"])


def valid_queries(
    queries: DataFrame,
    chain: str = "standard",
    synonyms: SynonymRules | DataFrame | None = None,
    longest: int | None = None,
) -> DataFrame:
    """Queries that get a result line.

    Bodies that analyse to nothing stay (they find nothing); malformed ones and those with more than 1,024 clauses, or
    as many words in one clause or alternatives at one of its places, go. ``longest``: the longest body, if known.
    """
    well_formed = queries.filter(valid_query("body"))
    long_bodies = well_formed
    if synonyms is None:  # a clause takes at least a character and a separator, so short bodies need no count
        if longest is not None and longest <= 2 * MAX_CLAUSES:
            return well_formed
        long_bodies = well_formed.filter(F.length("body") > 2 * MAX_CLAUSES)
    places = F.col("tokens")["pos"]
    sharing = F.transform(F.array_distinct(places), lambda p: F.size(F.filter(places, lambda q: q == p)))
    sizes = (
        analyzed_chunks(long_bodies, chain, synonyms)
        .filter((F.size("tokens") > 0) & ~F.col("text").isin(*OPERATORS))
        .groupBy("query_ord")
        .agg(
            F.count(F.lit(1)).alias("clauses"),
            F.max(F.greatest(F.size(F.array_distinct(places)), F.array_max(sharing))).alias("words"),
        )
    )
    too_long = sizes.filter(F.greatest("clauses", "words") > MAX_CLAUSES).select(F.col("query_ord").alias("ord"))
    return well_formed.join(too_long, "ord", "left_anti").select(queries.columns)


def assign_occur(chunks: DataFrame) -> DataFrame:
    """``(query_ord, chunk, text, tokens)`` -> ``(query_ord, chunk, occur, tokens)``, one row per clause.

    A clause is a should unless: AND stands before it, or after it and before the next clause (must); NOT stands
    before it (must_not, which AND cannot lift). A chunk that analyses to nothing is no clause, but an AND in front of
    it still lifts the clause before it.
    """
    order = Window.partitionBy("query_ord").orderBy("chunk")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before, before_that = F.lag("text").over(order), F.lag("text", 2).over(order)
    is_clause = ~F.col("text").isin(*OPERATORS) & (F.size("tokens") > 0)
    marked = (
        chunks.withColumn("is_clause", is_clause)
        .withColumn("negated", F.coalesce(before == "NOT", F.lit(False)))
        .withColumn("anded", F.coalesce((before == "AND") | ((before == "NOT") & (before_that == "AND")), F.lit(False)))
        .withColumn("number", F.sum(F.col("is_clause").cast("int")).over(upto))
        .filter(~F.col("text").isin(*OPERATORS))
    )
    lifted = (
        marked.filter("anded")
        .select("query_ord", (F.col("number") - F.col("is_clause").cast("int")).alias("number"))
        .distinct()
        .withColumn("lifted", F.lit(True))
    )
    occur = (
        F.when(F.col("negated"), MUST_NOT)
        .when(F.col("anded") | F.coalesce("lifted", F.lit(False)), MUST)
        .otherwise(SHOULD)
    )
    return (
        marked.filter("is_clause")
        .join(lifted, ["query_ord", "number"], "left")
        .select("query_ord", "chunk", occur.alias("occur"), "tokens")
    )


def boolean_match(clauses: DataFrame, matches: DataFrame) -> DataFrame:
    """``(query_ord, ord)`` of the documents that a query's clauses keep.

    ``clauses(query_ord, chunk, occur)`` lists every clause, ``matches(query_ord, chunk, ord)`` the documents each
    one's terms are in (repeats allowed). A clause that a large share of all matches belongs to is split by document.
    """
    query = Window.partitionBy("query_ord")
    needed = clauses.select(
        "query_ord", "chunk", "occur", F.sum((F.col("occur") == MUST).cast("int")).over(query).alias("musts")
    )
    clause = F.struct("query_ord", "chunk").alias("clause")
    hits = materialize(matches.select("query_ord", "chunk", "ord").distinct().select(clause, "ord"), "clause-matches")
    needed = needed.select(clause, "occur", "musts")
    hits = lookup_join(hits, needed, "clause", "ord").select("clause.*", "ord", "occur", "musts")
    return keep_by_occur(hits).select("query_ord", "ord")


def keep_by_occur(chunk_matches: DataFrame, *aggregates: Column) -> DataFrame:
    """Fold one row per (query, document, matched clause) into one per kept (query, document).

    Kept: all ``musts`` of the query matched, no must-not, and some clause that scores.
    """
    hit = {occur: F.count_if(F.col("occur") == occur) for occur in (MUST, SHOULD, MUST_NOT)}
    return (
        chunk_matches.groupBy("query_ord", "ord")
        .agg(*(count.alias(f"n_{occur}") for occur, count in hit.items()), F.first("musts").alias("musts"), *aggregates)
        .filter((F.col("n_must_not") == 0) & (F.col("n_must") == F.col("musts")) & (F.col("n_must") + F.col("n_should") > 0))
    )
