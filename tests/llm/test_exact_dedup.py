import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from rankwell.llm.exact_dedup import exact_duplicates, keep_one

DOCS = "doc_id long, text string, digest string, content int"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[lowered(text)].append(doc_id)
    return sorted(
        (
            i,
            max(g := groups[lowered(t)]),
            len(g),
            i == max(g),
            hashlib.sha256(lowered(t).encode()).hexdigest(),
        )
        for i, t in rows
    )


def random_rows(seed):
    dice = random.Random(seed)
    texts = [None, "", "A", "a", "Ä", "ä", "x" * 100_000, "X" * 100_000, "ß", "İ", "a ", " a", "Straße\n"]
    rows = [(i, dice.choice(texts)) for i in range(120)]
    return rows + [(1000 + i, "hot") for i in range(200)] + rows[:3]


def test_against_brute_force(spark):
    rows = random_rows(1)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)
    assert sorted(tuple(r) for r in exact_duplicates(docs).collect()) == brute(rows)


def test_contents_that_share_a_digest_stay_apart(spark):
    rows = random_rows(2)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)
    got = exact_duplicates(docs, digest=lambda c: (F.length(c) % 2).cast("string")).collect()
    assert sorted(tuple(r)[:4] for r in got) == [r[:4] for r in brute(rows)]


def test_keep_one_keeps_columns_and_repeated_rows_once(spark):
    rows = [(1, "A", "p", 1), (2, "a", "q", 2), (2, "a", "q", 2), (3, None, "r", 3), (3, "other", "s", 4), (4, "", "t", 5)]
    docs = spark.createDataFrame(rows, DOCS)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.collect()) == [(2, "a", "q", 2), (3, "other", "s", 4), (4, "", "t", 5)]


def test_empty_and_null_ids(spark):
    assert exact_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    docs = spark.createDataFrame([(None, "n", "", 0), (5, "N", "", 0), (None, "m", "", 0)], DOCS)
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_duplicates(docs).collect()}
    assert got == {(None, 5, 2, False), (5, 5, 2, True), (None, None, 1, True)}


def test_hot_groups_are_looked_up_in_parts(spark, capsys):
    rows = [(i, "hot") for i in range(3000)] + [(5, "HOT")] * 500 + [(10_000 + i, f"own {i}") for i in range(200)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)
    found = exact_duplicates(docs)
    assert sorted(tuple(r) for r in found.collect()) == brute(rows)
    found.explain()
    assert "__sub" in capsys.readouterr().out
