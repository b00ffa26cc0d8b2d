"""Query terms against postings: the match join, statistics, clause scores and their sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankwell.functions.scoring import VSM, clause_score, length_norm, resolve_similarity, vsm_idf
from rankwell.operators.boolean import MUST, MUST_NOT, SHOULD, keep_by_occur
from rankwell.operators.skew import every_sub_key, lookup_join, sub_key
from rankwell.operators.sums import sum_by_document
from rankwell.sources.scratch import materialize

ROWS_PER_KEY = 1_000_000  # postings of a term that one task takes, in the plan for large batches
QUERIES_PER_KEY = 100_000  # query rows that ask for a term, likewise
MOST_HOT = 1_000_000  # terms that are split at most: beyond that tasks take more rows each
MATCHES_PER_TASK = 2_000_000  # of a small batch, where postings are spread by document
MOST_SLOTS = 63  # positions of a chunk that one number can mark


def with_stats(terms: DataFrame, term_stats: DataFrame, collection_stats: DataFrame, small: bool) -> DataFrame:
    """Attach collection and term statistics to query terms; a term that no document holds gets df = ttf = 0.

    The statistics meet the short query side, before the match: matched postings then need no further lookup. The
    collection has one row per field. ``small``: the query terms have a checked size.
    """
    words = terms.select("field", "term").distinct()
    term_stats = term_stats.join(F.broadcast(words) if small else words, ["field", "term"], "left_semi")
    # No more rows than there are query terms.
    known = F.broadcast(term_stats) if small else term_stats
    return (
        terms.join(known, ["field", "term"], "left")
        .withColumn("df", F.coalesce("df", F.lit(0)))
        .withColumn("ttf", F.coalesce("ttf", F.lit(0)))
        .join(F.broadcast(collection_stats), "field")
    )


def match(terms: DataFrame, postings: DataFrame, small: bool) -> DataFrame:
    """Equi-join of weighted query terms and postings on the term; any shared term is a match.

    ``small`` (a checked size): the terms are broadcast, the postings stay where they are. Otherwise both sides are
    shuffled on the term. A term that is in many documents is cut into sub-keys of ``ROWS_PER_KEY`` by document, with its
    query rows copied to each; a term that many queries ask for is cut likewise by query, with its postings copied.
    """
    postings = postings.select("term", "ord", "tf", "dl")
    if small:
        return postings.join(F.broadcast(terms), "term")
    asked = terms.groupBy("term").agg(F.count(F.lit(1)).alias("asked"), F.first("df").alias("held"), F.first("sum_ttf").alias("all"))
    per_key = F.greatest(F.lit(ROWS_PER_KEY), F.ceil(F.col("all") / MOST_HOT))
    per_query = F.greatest(F.lit(QUERIES_PER_KEY), F.ceil(F.col("all") / MOST_HOT))
    hot = asked.filter((F.col("held") > per_key) | (F.col("asked") > per_query)).select(
        "term",
        F.greatest(F.ceil(F.col("held") / per_key), F.lit(1)).cast("int").alias("doc_parts"),
        F.ceil(F.col("asked") / per_query).cast("int").alias("query_parts"),
    )
    hot = F.broadcast(hot)
    of_docs, of_queries = F.coalesce("doc_parts", F.lit(1)), F.coalesce("query_parts", F.lit(1))
    held = postings.join(hot, "term", "left").select("term", "ord", "tf", "dl", sub_key(F.col("ord"), of_docs).alias("doc_part"), every_sub_key(of_queries).alias("query_part"))
    wanted = terms.join(hot, "term", "left").withColumn("query_part", sub_key(F.col("query_ord"), of_queries))
    wanted = wanted.withColumn("doc_part", every_sub_key(of_docs)).drop("doc_parts", "query_parts")
    return held.join(wanted, ["term", "doc_part", "query_part"]).drop("doc_part", "query_part")


def spread_by_document(terms: DataFrame, postings: DataFrame) -> DataFrame:
    """The postings that few ``terms`` (with statistics) ask for, spread by ``ord``: all that is summed per document then
    stays where it is. The number of parts follows the matches, which are the sum of ``df``, so a task's sums are bounded."""
    matches = terms.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    parts = max(terms.sparkSession.sparkContext.defaultParallelism, -(-matches // MATCHES_PER_TASK))
    words = F.broadcast(terms.select("term").distinct())
    return postings.select("term", "ord", "tf", "dl").join(words, "term", "left_semi").repartition(parts, "ord")


def _scored(matches: DataFrame, sim: int, norms: str, params: dict[str, float]) -> DataFrame:
    columns = ("tf", "df", "ttf", "max_doc", "sum_ttf", "avgdl") + (("query_norm",) if sim == VSM else ())
    stats = {name: F.col(name) for name in columns} | {"norm": F.col("norm")}
    return matches.withColumn("norm", length_norm("dl", norms)).withColumn("clause", clause_score(sim, stats, **params))


def _asked(terms: DataFrame, postings: DataFrame, sim: int, norms: str, params: dict[str, float]) -> tuple[DataFrame, DataFrame]:
    """``terms`` with a number for each word, ``word``, and ``(word, ord, clause)``: the score of a posting is worked out
    once however many queries ask for its word; only tf-idf's ``query_norm`` is left to the query."""
    stats = terms.filter("df > 0").select("term", "df", "ttf", "max_doc", "sum_ttf", "avgdl").distinct()
    words = stats.coalesce(1).withColumn("word", F.monotonically_increasing_id().cast("int"))  # a checked number of rows
    words = materialize(words, "asked-words")
    matches = match(words.withColumn("query_norm", F.lit(1.0)), postings, True)
    return terms.join(F.broadcast(words.select("term", "word")), "term"), _scored(matches, sim, norms, params).select("word", "ord", "clause")


def score_terms(
    terms: DataFrame, postings: DataFrame, sim: int, small: bool, norms: str = "quantized", together: bool = False, **params: float
) -> DataFrame:
    """``(query_ord, ord, score)`` when every clause is a should and nothing but the terms matters.

    ``terms(query_ord, term, qtf, statistics)``: a term that a query holds several times is looked up once and counted
    ``qtf`` times. Postings spread by ``ord`` (a lazy or a bucketed index) are summed where they are. Under tf-idf every
    chunk must hold one term: then the share of chunks that match is the share of terms. ``together``: the terms are
    few, and all postings of a document are in one partition of a bounded size, which is then summed as arrays.
    """
    sim = resolve_similarity(sim)
    coord = F.lit(1.0)
    if sim == VSM:
        query = Window.partitionBy("query_ord")
        idf = vsm_idf(F.col("df"), F.col("max_doc"))
        terms = terms.select(
            "*",
            F.sum("qtf").over(query).alias("chunks"),
            (1.0 / F.sqrt(F.sum(F.col("qtf") * idf * idf).over(query))).alias("query_norm"),
        )
        coord = F.sum("qtf") / F.first("chunks")
    if together:
        asked, clauses = _asked(terms, postings, sim, norms, params)
        weight, share = F.col("qtf").cast("double"), F.lit(0.0)
        if sim == VSM:
            weight, share = weight * F.col("query_norm"), F.col("qtf") / F.col("chunks")
        return sum_by_document(asked.select("query_ord", "word", weight.alias("weight"), share.alias("share")), clauses, sim == VSM)
    scored = _scored(match(terms, postings, small), sim, norms, params)
    return scored.groupBy("query_ord", "ord").agg((F.sum(F.col("clause") * F.col("qtf")) * coord).alias("score"))


def with_shapes(terms: DataFrame) -> DataFrame:
    """Add what a clause must know of its query: positions in its chunk (``width``), scoring chunks (``chunks``), must
    chunks (``musts``) and the tf-idf ``query_norm``, which counts repeats and terms that no document holds. ``slot``:
    the number of a position among those of its chunk."""
    query = Window.partitionBy("query_ord")
    scores = F.col("occur") != MUST_NOT
    idf = vsm_idf(F.col("df"), F.col("max_doc"))
    distinct = lambda when, what: F.size(F.collect_set(F.when(when, F.col(what))).over(query))
    return terms.select(
        "*",
        F.size(F.collect_set("pos").over(Window.partitionBy("query_ord", "chunk"))).alias("width"),
        (F.dense_rank().over(Window.partitionBy("query_ord", "chunk").orderBy("pos")) - 1).alias("slot"),
        distinct(scores, "chunk").alias("chunks"),
        distinct(F.col("occur") == MUST, "chunk").alias("musts"),
        (1.0 / F.sqrt(F.sum(F.when(scores, idf * idf)).over(query))).alias("query_norm"),
    )


def match_rarest_first(terms: DataFrame, postings: DataFrame) -> DataFrame:
    """``match`` for ``terms`` with shapes and statistics, but only in documents that hold the rarest must of a query.

    Of a query's must chunks the one whose words are in the fewest documents is matched on its words. The other words of
    the query are then probed by (word, document) in what was found: rows follow the rarest must, and no two rows of
    postings share a key. Queries without a must are matched as they are.
    """
    terms = materialize(terms, "clause-terms")
    chunk = Window.partitionBy("query_ord", "chunk")
    musts = terms.filter(F.col("occur") == MUST).select("query_ord", "chunk", F.sum("df").over(chunk).alias("held"))
    lead = musts.groupBy("query_ord").agg(F.min(F.struct("held", "chunk"))["chunk"].alias("lead"))
    led = terms.join(lead, "query_ord")
    columns = match(terms.limit(0), postings, False).columns
    first = led.filter(F.col("chunk") == F.col("lead")).drop("lead")
    found = materialize(match(first, postings, False).select(*columns), "rarest-matches")
    others = led.filter(F.col("chunk") != F.col("lead")).drop("lead")
    probes = lookup_join(found.select("query_ord", "ord").distinct(), others, "query_ord", "ord")
    probed = probes.join(postings.select("term", "ord", "tf", "dl"), ["term", "ord"])
    free = match(terms.join(lead, "query_ord", "left_anti"), postings, False)
    return found.unionByName(probed.select(*columns)).unionByName(free.select(*columns))


def score_clauses(
    terms: DataFrame,
    postings: DataFrame,
    sim: int,
    small: bool,
    norms: str = "quantized",
    alternatives: bool = True,
    together: bool = False,
    **params: float,
) -> DataFrame:
    """``(query_ord, ord, score)`` with clause structure: must / must_not, and the tf-idf coordination factors.

    ``terms(query_ord, chunk, occur, pos, term, statistics)``. tf-idf multiplies a chunk's sum by the share of its
    positions that match, and the total by the share of scoring chunks that match. ``alternatives``: whether terms can
    share a position; only tf-idf must then tell positions apart, by the bits of a number where a small batch has at most
    ``MOST_SLOTS`` of them in every chunk, else by a grouping of its own. All groupings hold ``ord``, so postings spread by
    it are never shuffled again. A large batch looks up the rarest must of a query first, and the rest only in the
    documents that hold it. ``together`` as in ``score_terms``.
    """
    sim = resolve_similarity(sim)
    terms = with_shapes(terms)
    if together:
        asked, clauses = _asked(terms, postings, sim, norms, params)
        weight = F.col("query_norm") if sim == VSM else F.lit(1.0)
        facts = "query_ord", "word", "chunk", "slot", "width", "chunks", "musts"
        asked = asked.select(*facts, weight.alias("weight"), *((F.col("occur") == occur).alias(occur) for occur in (MUST, MUST_NOT)))
        return sum_by_document(asked, clauses, sim == VSM)
    matches = match(terms, postings, small) if small else match_rarest_first(terms, postings)
    rows = _scored(matches, sim, norms, params)
    chunk = ["query_ord", "chunk", "occur", "ord"]
    query_facts = [F.first(name).alias(name) for name in ("width", "chunks", "musts")]
    share = F.count(F.lit(1)) / F.first("width") if sim == VSM else F.lit(1.0)
    if alternatives and sim == VSM:
        if small and (terms.agg(F.max("width")).first()[0] or 0) <= MOST_SLOTS:
            share = F.bit_count(F.bit_or(F.expr("shiftleft(1L, slot)"))) / F.first("width")
        else:
            rows = rows.groupBy(*chunk, "pos").agg(F.sum("clause").alias("clause"), *query_facts)
    chunks = rows.groupBy(*chunk).agg((F.sum("clause") * share).alias("part"), *query_facts)
    total = F.sum(F.when(F.col("occur") != MUST_NOT, F.col("part"))).alias("total")
    kept = keep_by_occur(chunks, F.first("chunks").alias("chunks"), total)
    coord = (F.col(f"n_{MUST}") + F.col(f"n_{SHOULD}")) / F.col("chunks") if sim == VSM else F.lit(1.0)
    return kept.select("query_ord", "ord", (F.col("total") * coord).alias("score"))
