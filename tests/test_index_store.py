import threading
import time
from contextlib import redirect_stdout
from io import StringIO

import pytest
from pyspark.sql import functions as F

from rankwell import append_corpora, build_index, drop_retired, index_count, merge_index, query_terms, read_index, score, search, search_text, write_index
from rankwell.schema import QUESTION
from rankwell.sources import claims, index_store


def many(spark, n, words=200, start=0):
    """Every document holds "common", a word of its own and one that several share."""
    return spark.range(n).select(
        (F.col("id") + start).cast("string").alias("id"),
        F.lit("t").alias("topic"),
        F.concat_ws(" ", F.lit("common"), F.concat(F.lit("own"), F.col("id") + start), F.concat(F.lit("w"), F.col("id") % words)).alias("body"),
        "id",
    ).toDF("id", "topic", "body", "ord")


def shown(hits):
    return [(r["query_id"], r["rank"], r["doc_id"], round(r["score"], 9), r["total_hits"]) for r in hits.orderBy("query_ord", "rank").collect()]


def test_a_reader_keeps_its_index_when_it_is_overwritten(spark, questions, tmp_path):
    path = str(tmp_path / "index")
    write_index(questions(("a", "x", "sugar free"), ("b", "y", "sugar")), path)
    old = read_index(spark, path)
    write_index(questions(("c", "z", "cream")), path, "overwrite")
    assert index_count(old).first()["documents"] == 2
    assert {r["doc_id"] for r in search_text("sugar", old).collect()} == {"a", "b"}
    new = read_index(spark, path)
    assert index_count(new).first()["documents"] == 1 and search_text("sugar", new).count() == 0
    assert drop_retired(spark, path) == []
    time.sleep(0.1)
    assert len(drop_retired(spark, path, older_than=0.05)) == 1
    assert [r["doc_id"] for r in search_text("cream", read_index(spark, path)).collect()] == ["c"]
    with pytest.raises(Exception):  # noqa: B017 Spark's own error, whatever it is called
        index_count(old).collect()


def test_appends_that_start_together_get_ranges_of_their_own(spark, questions, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    first, second = questions(("a", "x", "sugar one"), ("b", "y", "sugar two")), questions(("c", "z", "sugar three"))
    plain, between = index_store._write_batch, []

    def held_up(*args):
        if not between:  # the other writer starts and ends while this one writes
            between.append(True)
            write_index(second, path, "append")
        return plain(*args)

    monkeypatch.setattr(index_store, "_write_batch", held_up)
    write_index(first, path, "append")
    monkeypatch.undo()
    index = read_index(spark, path)
    assert sorted((r["ord"], r["doc_id"]) for r in index.docs.collect()) == [(0, "a"), (1, "b"), (2, "c")]
    hits = search_text("sugar", index, sim=1).orderBy("rank").collect()
    assert [(r["rank"], r["doc_id"], r["total_hits"]) for r in hits] == [(1, "a", 3), (2, "b", 3), (3, "c", 3)]


def test_writers_in_threads(spark, questions, tmp_path):
    path = str(tmp_path / "index")
    batches = [questions((f"{n}a", "x", f"sugar {n}"), (f"{n}b", "x", "sugar")) for n in range(3)]
    threads = [threading.Thread(target=write_index, args=(batch, path, "append")) for batch in batches]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    docs = read_index(spark, path).docs.collect()
    assert sorted(r["ord"] for r in docs) == list(range(6)) and len({r["doc_id"] for r in docs}) == 6


def test_a_claim_is_made_once(spark, tmp_path):
    folder = str(tmp_path / "claims")
    for number in range(3):
        assert claims.claim(spark, folder, lambda n, records: {"n": n, "seen": len(records)}, lambda r: r["n"] % 2 == 0)["n"] == number
    assert not claims.make(spark, folder, f"{1:020d}", {"n": "other"})
    assert claims._read(spark, f"{folder}/{1:020d}") == {"n": 1, "seen": 1}


def test_an_append_that_was_overtaken_by_an_overwrite_is_not_read(spark, questions, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    write_index(questions(("a", "x", "sugar")), path)
    plain, between = index_store._write_batch, []

    def held_up(*args):
        if not between:
            between.append(True)
            write_index(questions(("c", "z", "cream")), path, "overwrite")
        return plain(*args)

    monkeypatch.setattr(index_store, "_write_batch", held_up)
    write_index(questions(("b", "x", "sugar")), path, "append")
    assert [r["doc_id"] for r in read_index(spark, path).docs.collect()] == ["c"]


def test_repeated_or_null_ordinals_are_refused(spark, tmp_path):
    for ords in ([0, 0, 2], [0, None, 1], [5, 5]):
        rows = spark.createDataFrame([("d", "t", "sugar", o) for o in ords], QUESTION)
        with pytest.raises(ValueError, match="ordinals"):
            write_index(rows, str(tmp_path / "index"))


def test_merged_batches_read_like_one(spark, questions, tmp_path):
    path, once = str(tmp_path / "index"), str(tmp_path / "once")
    parts = [many(spark, 20, start=20 * n) for n in range(5)]
    for part in parts:
        write_index(part, path, "append")
    together = parts[0]
    for part in parts[1:]:
        together = append_corpora(together, part)
    write_index(together, once)
    batch = questions(("q", "", "common own7 w3"), ("r", "", "w11 own99"))
    before = read_index(spark, path)
    expected = shown(search(batch, read_index(spark, once), sim=1))
    assert shown(search(batch, before, sim=1)) == expected
    merge_index(spark, path)
    merged = read_index(spark, path)
    assert shown(search(batch, merged, sim=1)) == expected == shown(search(batch, before, sim=1))
    with redirect_stdout(StringIO()) as plan:
        score(batch, merged, 1).rows.explain()
        merged.docs.explain()
    names = [line.split("FileScan parquet ")[1] for line in plan.getvalue().splitlines() if "FileScan parquet" in line]
    assert sum("rankwell_question_" in name for name in names) == 1 and plan.getvalue().count("Union") == 0
    write_index(many(spark, 3, start=1000), path, "append")
    assert index_count(read_index(spark, path)).first()["documents"] == 103
    assert sorted(r["ord"] for r in read_index(spark, path).docs.collect()) == list(range(103))
    merge_index(spark, path)
    time.sleep(0.1)
    assert len(drop_retired(spark, path, older_than=0.05)) == 7
    assert index_count(read_index(spark, path)).first()["documents"] == 103


def test_of_two_merges_at_once_one_counts(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    for n in range(2):
        write_index(many(spark, 4, start=4 * n), path, "append")
    plain, between = index_store._write_batch, []

    def held_up(*args):
        if not between:
            between.append(True)
            merge_index(spark, path)
        return plain(*args)

    monkeypatch.setattr(index_store, "_write_batch", held_up)
    merge_index(spark, path)
    assert index_count(read_index(spark, path)).first()["documents"] == 8


def test_what_is_scanned_grows_with_the_words_asked_for(spark, questions, tmp_path):
    path, plain = str(tmp_path / "index"), str(tmp_path / "plain")
    corpus = many(spark, 3000, words=500)
    write_index(corpus, path, fields=("question",), buckets=2, ranges=64)
    write_index(corpus, plain, fields=("question",), buckets=2)
    index, whole = read_index(spark, path), read_index(spark, plain)
    everything = index.postings["question"].count()
    assert everything == whole.postings["question"].count()
    scanned = []
    for n in (1, 50, 1000):
        batch = questions(("q", "", " ".join(f"own{i * 3}" for i in range(n))))
        terms = query_terms(batch)
        postings, stats = index.lookup("question", terms)
        held = postings.join(terms.select("term").distinct(), "term", "left_semi")
        assert held.count() == n and stats.join(terms.select("term").distinct(), "term", "left_semi").count() == n
        scanned.append(postings.count())
    assert scanned[0] == 1 and scanned[0] < scanned[1] < scanned[2] < everything - 3000  # "common" has a range of its own
    batch = questions(("q", "", "common own5 w7 zzz"), ("r", "", " ".join(f"own{i}" for i in range(300))))
    assert shown(search(batch, index, sim=1)) == shown(search(batch, whole, sim=1)) == shown(search(batch, build_index(corpus), sim=1))


def test_ranges_of_terms(spark):
    firsts = ["b", "b\0", "m", "x"]
    rows = spark.createDataFrame([(t,) for t in ("a", "b", "ba", "m", "n", "x", "zz", "")], "term string")
    got = {r["term"]: r["n"] for r in rows.select("term", index_store.term_range(F.col("term"), firsts).alias("n")).collect()}
    assert got == {"a": 0, "b": 1, "ba": 2, "m": 3, "n": 3, "x": 4, "zz": 4, "": 0}


def test_buckets_follow_the_text(spark, tmp_path):
    mega = spark.range(0, 140, numPartitions=8).select(F.col("id").cast("string"), F.lit("t").alias("topic"), F.concat(F.lit("sugar"), F.expr("repeat(' ', 1 << 20)")).alias("body"), F.col("id").alias("ord"))
    path = str(tmp_path / "index")
    write_index(mega, path, fields=("question",))
    assert index_store._published(spark, path)[0]["buckets"] == 5  # 140 MB, not the 4 of the cores
    assert index_count(read_index(spark, path)).first()["documents"] == 140
    assert search_text("sugar", read_index(spark, path)).first()["total_hits"] == 140
