import math
import re

import pytest
from pyspark.sql import functions as F

from rankwell import SynonymRules, adhoc_query, build_index, score, search, search_text, with_stats
from rankwell.functions.scoring import length_norm, resolve_similarity
from rankwell.operators import matching

DOCS = [
    (101, "ice", "Sugar free ice cream is not free of carbs."),
    (102, "ice", "Ice cream, ice cream and sugar!"),
    (103, "move", "Exercise lowers blood sugar"),
    (104, "pills", "Metformin 500mg lowers sugar; metformin dose twice daily"),
    (105, "move", "Swimming or weights?"),
]
QUERY = "Is sugar-free ice cream sugar free?"

GOLDEN = {
    (0, "quantized"): (1.704461, 0.746646, 0.080439, 0.050274),
    (1, "quantized"): (5.391319, 2.942504, 0.626634, 0.402711),
    (2, "quantized"): (0.010160, 0.007740, 0.001197, 0),
    (3, "quantized"): (14.761076, 10.901719, 5.083204, 3.434902),
    (4, "quantized"): (2.636785, 2.162157, 0.885705, 0.393819),
    (0, "exact"): (1.855582, 0.763224, 0.080439, 0.056879),
    (1, "exact"): (5.759650, 2.982903, 0.626634, 0.461971),
    (2, "exact"): (0.011766, 0.008164, 0.001197, 0),
    (3, "exact"): (15.690989, 11.065071, 5.083204, 3.848497),
    (4, "exact"): (3.005691, 2.234641, 0.885705, 0.491487),
}


@pytest.fixture(scope="module")
def index(spark):
    from rankwell.schema import QUESTION

    rows = [(str(i), t, b, n) for n, (i, t, b) in enumerate(DOCS)]
    return build_index(spark.createDataFrame(rows, QUESTION))


@pytest.mark.parametrize("sim,norms", GOLDEN)
def test_ranking_golden(spark, index, sim, norms):
    rows = search_text(QUERY, index, sim=sim, norms=norms, k=10).orderBy("rank").collect()
    assert [r["doc_id"] for r in rows] == ["101", "102", "103", "104"]
    assert [r["rank"] for r in rows] == [1, 2, 3, 4]
    assert {r["total_hits"] for r in rows} == {4}
    assert {r["query_id"] for r in rows} == {"0100"}
    for row, expected in zip(rows, GOLDEN[sim, norms]):
        assert row["score"] == pytest.approx(expected, abs=2e-6)


def test_statistics(index):
    lengths = {r["ord"]: r for r in index.doc_stats["question"].collect()}
    assert [lengths[o]["dl"] for o in range(5)] == [6, 5, 4, 8, 2]
    stats = index.collection_stats.filter("field = 'question'").first()
    assert (stats["max_doc"], stats["sum_ttf"], stats["avgdl"]) == (5, 25, 5.0)
    positions = {
        (r["term"], r["ord"]): (r["tf"], r["positions"]) for r in index.postings["question"].collect()
    }
    assert positions["free", 0] == (2, [1, 6])
    assert positions["cream", 1] == (2, [1, 3])
    assert positions["sugar", 1] == (1, [5])


def test_norms(spark):
    golden = {1: 1, 2: 0.625, 3: 0.5, 4: 0.5, 5: 0.4375, 7: 0.375, 10: 0.3125, 16: 0.25, 20: 0.21875, 50: 0.125, 100: 0.09375}
    df = spark.createDataFrame([(d,) for d in golden], "dl long")
    for r in df.select("dl", length_norm("dl").alias("q"), length_norm("dl", "exact").alias("e")).collect():
        assert r["q"] == golden[r["dl"]]
        assert r["q"] <= r["e"] == pytest.approx(1 / math.sqrt(r["dl"]))
    with pytest.raises(ValueError):
        length_norm("dl", "other")


def test_quantized_norms_never_exceed_exact(spark):
    df = spark.range(1, 100_001).select(length_norm("id").alias("q"), length_norm("id", "exact").alias("e"))
    assert df.filter("q > e or q < e * 0.79").count() == 0


def test_ties_rank_by_insertion(spark, questions):
    docs = questions(
        ("X1", "", "insulin one two2 three four five six"), ("X2", "", "insulin one two2 three four five")
    )
    built = build_index(docs)
    quantized = search_text("insulin", built, sim=4).orderBy("rank").collect()
    assert [r["doc_id"] for r in quantized] == ["X1", "X2"]
    assert [r["score"] for r in quantized] == pytest.approx([0.247836, 0.247836], abs=1e-6)
    exact = search_text("insulin", built, sim=4, norms="exact").orderBy("rank").collect()
    assert [r["doc_id"] for r in exact] == ["X2", "X1"]
    assert [r["score"] for r in exact] == pytest.approx([0.287682, 0.251314], abs=1e-6)


def test_field_choice_and_k(spark, index):
    rows = search_text("move", index, field="topic", k=1).collect()
    assert [(r["doc_id"], r["total_hits"]) for r in rows] == [("103", 2)]
    with pytest.raises(ValueError):
        search_text("move", index, k=0)


def test_dispatch():
    assert resolve_similarity() == 0
    assert resolve_similarity(configured=4) == 4
    assert resolve_similarity(1, configured=4) == 1
    for bad in (-1, 5):
        with pytest.raises(ValueError):
            resolve_similarity(bad)


def test_unknown_parameter(index):
    with pytest.raises(TypeError):
        search_text("sugar", index, sim=1, kk=1.0)


@pytest.mark.parametrize("sim", range(5))
def test_large_batch_plan_gives_the_same_hits(spark, index, questions, sim, monkeypatch):
    batch = questions(("a", "", QUERY), ("a", "", "sugar sugar lowers"), ("b", "", "sugar AND lowers NOT metformin"))
    expected = search(batch, index, sim=sim, k=4).orderBy("query_ord", "rank").collect()
    import rankwell.plans.search as plan
    from rankwell.operators import matching

    monkeypatch.setattr(plan, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(matching, "ROWS_PER_KEY", 2)
    monkeypatch.setattr(matching, "QUERIES_PER_KEY", 1)
    monkeypatch.setattr(matching, "MOST_HOT", 1000)
    result = search(batch, index, sim=sim, k=4)
    got = result.orderBy("query_ord", "rank").collect()
    assert len(got) == len(expected) > 6
    for a, b in zip(got, expected):
        assert a["query_id"] == b["query_id"] and a["ord"] == b["ord"] and a["total_hits"] == b["total_hits"]
        assert a["score"] == pytest.approx(b["score"], abs=1e-9)


def test_queries_without_hits_or_text(spark, index, questions):
    assert search(questions(("1", "", "it is the"), ("2", "", "   "), ("3", "", "zebra")), index).count() == 0


def test_vsm_is_the_same_with_and_without_chunk_structure(index, questions):
    plain = [("a", "", "ice cream sugar zebra"), ("b", "", "free free, carbs. the")]
    alone = search(questions(*plain), index, sim=0, k=5).orderBy("query_ord", "rank").collect()
    mixed = search(questions(*plain, ("c", "", "sugar-free")), index, sim=0, k=5)
    mixed = mixed.filter("query_id <> 'c'").orderBy("query_ord", "rank").collect()
    assert [(r["query_id"], r["ord"], r["total_hits"]) for r in alone] == [
        (r["query_id"], r["ord"], r["total_hits"]) for r in mixed
    ]
    assert [r["score"] for r in alone] == pytest.approx([r["score"] for r in mixed], abs=1e-12)


@pytest.mark.parametrize("k", [3, 2000])
def test_hits_and_totals_in_one_pass(spark, k, monkeypatch):
    from rankwell import top_hits, top_k, total_hits
    from rankwell.operators import ranking

    monkeypatch.setattr(ranking, "_HELD", 50)
    rows = spark.range(6000).select((F.col("id") % 3).alias("query_ord"), F.expr("(id * 7919) % 100003").alias("ord"), (F.col("id") % 50 + 1.0).alias("score"))
    got = sorted(tuple(r) for r in top_hits(rows, k).select("query_ord", "rank", "ord", "score", "total_hits").collect())
    expected = top_k(rows, k).join(total_hits(rows), "query_ord").select("query_ord", "rank", "ord", "score", "total_hits")
    ordered = rows.toPandas().sort_values(["query_ord", "score", "ord"], ascending=[True, False, True])
    best = [(q, i + 1, o, s, 2000) for q, part in ordered.groupby("query_ord") for i, (o, s) in enumerate(zip(part["ord"][:k], part["score"][:k]))]
    assert got == sorted(tuple(r) for r in expected.collect()) == best
    assert top_hits(rows.limit(0), k).count() == 0


def test_a_large_k_is_cut_in_parts_first(spark, capsys):
    from rankwell import top_k

    rows = spark.range(10).select((F.col("id") % 2).alias("query_ord"), F.col("id").alias("ord"), F.col("id").cast("double").alias("score"))
    top_k(rows, 2000).explain()
    plan = capsys.readouterr().out
    assert plan.count("Window [") == 2 and "hashpartitioning(query_ord" in plan and "part" in plan


def test_scores_are_compared_relatively(spark):
    from rankwell import top_k
    from rankwell.operators.ranking import score_key

    tiny = [(0, 3e-8), (1, 3.1e-8), (2, 2.9e-8), (3, 3.1e-8 * (1 + 2**-52)), (4, 0.0), (5, 1e-305), (6, 9.99999999999e-9), (7, 1e-8)]
    rows = spark.createDataFrame([(1, o, s) for o, s in tiny], "query_ord long, ord long, score double")
    assert [r["ord"] for r in top_k(rows, 8).orderBy("rank").collect()] == [1, 3, 0, 2, 6, 7, 4, 5]
    keys = [r[0] for r in spark.createDataFrame([(-2.0,), (-1.0,), (0.0,), (1.0,), (9.5,), (10.0,), (1e300,)], "s double").select(score_key("s")).collect()]
    assert keys == sorted(keys) and len(set(keys)) == 7


def test_an_unstored_index_is_analysed_once(spark, index, questions):
    built = build_index(questions(("a", "", "sugar cream"), ("b", "", "sugar")), fields=("question",))
    first = built.analyzed_once("question")
    assert built.analyzed_once("question") is first
    assert [r["doc_id"] for r in search_text("cream sugar", built, sim=1).orderBy("rank").collect()] == ["a", "b"]
    stats = first.collection_stats.first()
    assert (stats["max_doc"], stats["sum_ttf"], stats["avgdl"]) == (2, 3, 1.5)


def test_lookups_of_hot_and_null_keys(spark):
    from rankwell.operators import skew

    rows = spark.range(5000).select(F.when(F.col("id") < 3000, 1).when(F.col("id") < 3500, None).otherwise(F.col("id")).alias("key"), F.col("id").alias("row"))
    table = spark.range(4000).select(F.col("id").alias("key"), (F.col("id") * 2).alias("value"))
    hot = skew.hot_keys(rows.filter("key IS NOT NULL"), "key")
    assert [tuple(r) for r in hot.collect()] == [(1, 30)]
    inner = skew.lookup_join(rows, table, "key", "row")
    assert inner.count() == 3500 and inner.filter("value <> 2 * key").count() == 0
    left = skew.lookup_join(rows, table, "key", "row", "left")
    assert left.count() == 5000 and left.filter("value IS NULL").count() == 1500


def test_conjunctions_follow_the_rarest_must(spark, questions):
    from rankwell import with_stats
    from rankwell.operators import matching
    from rankwell.plans.search import clause_terms

    built = build_index(questions(*((str(i), "", f"common w{i % 5} own{i} {'odd' if i % 2 else 'even'}") for i in range(200))))
    asked = questions(("a", "", "common AND own7 odd NOT even"), ("b", "", "w3 AND common AND odd"), ("c", "", "own5 w4"))
    terms = clause_terms(asked).withColumn("field", F.lit("question"))
    terms = matching.with_shapes(with_stats(terms, built.term_stats["question"], built.collection_stats, False))
    rows = matching.match_rarest_first(terms, built.postings["question"])
    counts = {r["query_ord"]: r["count"] for r in rows.groupBy("query_ord").count().collect()}
    every = {r["query_ord"]: r["count"] for r in matching.match(terms, built.postings["question"], False).groupBy("query_ord").count().collect()}
    assert counts == {0: 3, 1: 40 + 40 + 20, 2: 41} and every == {0: 401, 1: 340, 2: 41}


def test_postings_are_made_inside_a_document(spark, questions):
    bodies = ["sugar free sugar", "", None, "the of and", "b a b a b", "x1 " * 300 + "free"]
    built = build_index(questions(*((str(i), "t", body) for i, body in enumerate(bodies))), fields=("question",))
    rows = built.postings["question"]
    assert "Aggregate" not in rows._jdf.queryExecution().toString()
    expected = {}
    for n, body in enumerate(bodies):
        kept = [(i, w) for i, w in enumerate((body or "").split()) if w not in ("the", "of", "and", "a")]
        for i, word in kept:
            expected.setdefault((word, n, len(kept)), []).append(i)
    got = {(r["term"], r["ord"], r["dl"]): (r["tf"], r["positions"]) for r in rows.collect()}
    assert rows.count() == len(expected) and got == {key: (len(at), at) for key, at in expected.items()}
    assert rows.select("tf").groupBy().sum().first()[0] == sum(map(len, expected.values()))


def test_sums_of_a_lazy_index_stay_with_the_document(spark, questions, monkeypatch):
    docs = questions(*((str(i), "t", f"sugar w{i % 3} free sweet cane w{i % 5}") for i in range(30)))
    asked = questions(("q", "t", "sugar w1 free"), ("r", "t", "w2 sweet-w4"))
    rules = SynonymRules.of(spark.createDataFrame([(["sugar"], ["sugar"]), (["sugar"], ["sweet", "cane"]), (["w1"], ["w1"]), (["w1"], ["w2"])], "input array<string>, output array<string>"))
    built = build_index(docs, rules, ("question",))
    found = score(asked, built, 0, synonyms=rules).rows
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(ord" in plan and "hashpartitioning(query_ord#" not in plan.split("BroadcastExchange")[0]
    monkeypatch.setattr(matching, "MATCHES_PER_TASK", 10)
    many = score(asked, built, 0, synonyms=rules).rows
    assert many.rdd.getNumPartitions() > 10
    monkeypatch.setattr(matching, "MOST_SLOTS", 0)
    grouped = score(asked, built, 0, synonyms=rules).rows
    rows = lambda df: sorted((r["query_ord"], r["ord"], round(r["score"], 9)) for r in df.collect())
    assert rows(found) and rows(found) == rows(many) == rows(grouped)


@pytest.mark.parametrize("sim,sizes", [(0, (1 << 20, 4)), (0, (3, 0)), (4, (3, 0))])
def test_sums_of_whole_documents_equal_joins(spark, questions, monkeypatch, sim, sizes):
    """Clauses with operators, alternatives and many words to a chunk; documents in one step and in many, dense and sparse."""
    import random

    from rankwell.operators import sums
    from rankwell.operators.matching import score_clauses, score_terms
    from rankwell.plans.search import clause_terms

    monkeypatch.setattr(sums, "MATCHES_AT_ONCE", sizes[0])
    monkeypatch.setattr(sums, "SPARSE", sizes[1])
    dice = random.Random(sim)
    words = [f"w{i}" for i in range(12)]
    text = lambda glue, n: "".join(dice.choice(words) + dice.choice(glue) for _ in range(n)) + "w0"
    index = build_index(questions(*((str(i), "", text([" "], dice.randrange(12))) for i in range(40))), fields=("question",))
    queries = questions(*((str(i), "", text([" ", "-", "/", " AND ", " NOT "], 6)) for i in range(15)), ("nothing", "", "none"))
    rules = SynonymRules.of(spark.createDataFrame([(["w1"], [o]) for o in ("w1", "w2", "other")] + [(["w3"], ["w4", "w5"])], "input array<string>, output array<string>"))
    terms = clause_terms(queries, "synonym", rules).localCheckpoint()
    spread = index.postings["question"].repartition(3, "ord").localCheckpoint()
    found = {}
    for together in (False, True):
        plain = terms.groupBy("query_ord", "term").agg(F.count(F.lit(1)).alias("qtf")) if sim else None
        for kind, rows in (("clauses", terms), ("plain", plain)):
            if rows is None:  # tf-idf of several words to a chunk has no plain form
                rows = terms.filter("pos = 0").select("query_ord", "term").distinct().withColumn("qtf", F.lit(2))
            weighted = with_stats(rows.withColumn("field", F.lit("question")), index.term_stats["question"], index.collection_stats, True)
            scored = (score_clauses if kind == "clauses" else score_terms)(weighted, spread, sim, True, together=together)
            found[kind, together] = {(r["query_ord"], r["ord"]): r["score"] for r in scored.collect()}
    for kind in ("clauses", "plain"):
        assert found[kind, True] == pytest.approx(found[kind, False], abs=1e-9) and found[kind, True]


def test_a_lazy_index_scores_a_posting_once(questions, index, capsys):
    """However many queries ask for a word: nothing is joined or grouped for each of them."""
    queries = questions(*((str(i), "", "sugar free ice-cream") for i in range(5)))
    for sim in (0, 1):
        score(queries, index, sim).rows.explain()
        plan = capsys.readouterr().out
        assert "MapInArrow" in plan and not re.search(r"keys=\[[^\]]*\bord#", plan)
