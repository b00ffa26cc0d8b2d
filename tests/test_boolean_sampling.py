import hashlib

import pytest

from rankwell import assign_occur, analyzed_chunks, build_index, sample_queries, search, valid_queries

VALID = {
    "sugar cream": ["should", "should"],
    "sugar AND cream": ["must", "must"],
    "sugar NOT cream": ["should", "must_not"],
    "sugar AND NOT cream": ["must", "must_not"],
    "sugar OR cream": ["should", "should"],
    "NOT sugar": ["must_not"],
    "it is the": [],
    "sugar AND the": ["must"],
    "sugar the AND cream": ["must", "must"],
    "NOT sugar AND cream": ["must_not", "must"],
    "sugar-free AND(x": ["should", "should"],
    "a OR NOT b and ORANGE": ["must_not", "should"],
}
INVALID = ["AND sugar", "sugar AND", "sugar OR OR cream", "", " \t\n", "NOT NOT a", "a NOT", "x NOT OR y", "OR", "a AND AND NOT b"]


def test_occur_and_grammar(questions):
    rows = questions(*((n, "", body) for n, body in enumerate([*VALID, *INVALID])))
    kept = valid_queries(rows)
    assert {r["body"] for r in kept.collect()} == set(VALID)
    occur = {}
    for r in assign_occur(analyzed_chunks(kept)).orderBy("query_ord", "chunk").collect():
        occur.setdefault(list(VALID)[r["query_ord"]], []).append(r["occur"])
    assert occur == {body: expected for body, expected in VALID.items() if expected}


def test_clause_limit(questions):
    bodies = [" ".join(["x"] * 1024), " ".join(["x"] * 1025), " ".join(["the"] * 3000), "-".join(["x"] * 1025)]
    kept = valid_queries(questions(*((n, "", b) for n, b in enumerate(bodies))))
    assert sorted(r["ord"] for r in kept.collect()) == [0, 2]


@pytest.mark.parametrize("sim", [0, 1])
def test_clauses_choose_documents(questions, sim):
    index = build_index(questions(("sc", "", "sugar cream"), ("s", "", "sugar"), ("c", "", "cream"), ("sf", "", "sugar free")), fields=("question",))
    bodies = {
        "sugar AND cream": {"sc"},
        "sugar NOT cream": {"s", "sf"},
        "sugar AND NOT free": {"sc", "s"},
        "sugar OR cream": {"sc", "s", "c", "sf"},
        "NOT sugar": set(),
        "zebra AND sugar": set(),
        "sugar-cream AND free": {"sf"},
    }
    rows = search(questions(*((n, "", body) for n, body in enumerate(bodies))), index, sim=sim, k=10).collect()
    for n, (body, expected) in enumerate(bodies.items()):
        found = [r for r in rows if r["query_ord"] == n]
        assert {r["doc_id"] for r in found} == expected, body
        assert all(r["total_hits"] == len(expected) for r in found)


def test_sampling(spark, questions):
    rows = questions(*((n * 3, "", f"b{n}") for n in range(40)))
    rows = rows.withColumn("ord", rows["ord"] * 1_000_003_000_007 + 2)  # as sparse as hashes
    drawn = {r["ord"]: r["id"] for r in sample_queries(rows, 100, 10).collect()}
    expected = {d: str(int(hashlib.md5(f"10:{d}".encode()).hexdigest()[:8], 16) % 40 * 3) for d in range(100)}
    assert drawn == expected
    assert sample_queries(rows, 5, 11).count() == 5
    with pytest.raises(ValueError):
        sample_queries(rows.limit(0), 5, 1).count()
