import random
from contextlib import redirect_stdout
from io import StringIO
from threading import Event, Thread

import duckdb
import pytest
from pyspark.sql import DataFrameWriter

from rankwell import (
    adhoc_query,
    append_corpora,
    index_count,
    read_index,
    read_questions,
    rejected_lines,
    report,
    result_lines,
    results_name,
    score,
    search,
    search_text,
    valid_queries,
    write_index,
    write_results,
    write_xml,
)
from rankwell.schema import QUESTION
from rankwell.sources import index_store, scratch
from verification.oracle import questions_sql

QUIRKS = [
    "preface text", "[1] First ", " body a ", "ok", "", "body b", "[]ghost", "ghost body", "[2]", "see [3] inside",
    "tail one", "ab", "[4] no body", "[] last ghost", "lost",
]
GOLDEN = [
    ("1", "First", "preface textbody abody b", 0),
    ("2", "", "ghost body", 1),
    ("3", "inside", "tail one", 2),
    ("4", "no body", "", 3),
]


@pytest.fixture
def tiny_splits(spark):
    for name, value in (("maxPartitionBytes", "16"), ("openCostInBytes", "1")):
        spark.conf.set(f"spark.sql.files.{name}", value)
    yield
    for name in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.unset(f"spark.sql.files.{name}")


def _questions(spark, path):
    return [tuple(row) for row in read_questions(spark, str(path)).orderBy("ord").collect()]


def test_parser_quirks(spark, tmp_path):
    (tmp_path / "q.txt").write_text("\n".join(QUIRKS) + "\n")
    assert _questions(spark, tmp_path) == GOLDEN


def test_parser_over_many_splits(spark, tmp_path, tiny_splits):
    (tmp_path / "q.txt").write_text("\n".join(QUIRKS) + "\n")
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
    assert _questions(spark, tmp_path) == GOLDEN


def _expected(files):
    """The questions of files, by SQL over numbered lines."""
    connection = duckdb.connect()
    connection.execute("CREATE TABLE lines (file VARCHAR, line_no INTEGER, value VARCHAR)")
    connection.executemany("INSERT INTO lines VALUES (?, ?, ?)", [(f, n, v) for f in files for n, v in enumerate(files[f])])
    return [row[:3] for row in connection.execute(f"SELECT id, topic, body, ord FROM ({questions_sql('lines')}) ORDER BY ord").fetchall()]


def test_random_files_agree_with_sql_over_numbered_lines(spark, tmp_path, tiny_splits):
    rng = random.Random(7)
    pieces = ["[a] t", "[] none", "[b]", "body one", " two ", "x", "][bad", "see [c] d", "long body line here"]
    files = {f"f{n}.txt": [rng.choice(pieces) for _ in range(rng.randint(1, 25))] for n in range(4)}
    for name, lines in files.items():
        (tmp_path / name).write_text("\n".join(lines))
    assert [row[:3] for row in _questions(spark, tmp_path)] == _expected(files)


def test_rejected_headers(spark, tmp_path):
    (tmp_path / "q.txt").write_text("[1] a\nbody\n] wrong [ way\nmore\n")
    assert _questions(spark, tmp_path) == [("1", "a", "bodymore", 0)]
    assert [row["value"] for row in rejected_lines(spark, str(tmp_path)).collect()] == ["] wrong [ way"]


def _contents(index):
    stats = {tuple(r) for r in index.all_term_stats().select("field", "term", "df", "ttf").collect()}
    totals = {tuple(r) for r in index.collection_stats.select("field", "max_doc", "sum_ttf", "avgdl").collect()}
    postings = {(r["term"], r["ord"], r["tf"], tuple(r["positions"])) for r in index.postings["question"].collect()}
    return stats, totals, postings


def test_store_append_equals_one_build(spark, questions, tmp_path):
    first = questions(("a", "x", "sugar free sugar"), ("b", "y", "the"), ("a", "x", ""))
    second = questions(("a", "z", "free cream"), ("c", "x", "cream sugar"))
    both, once = str(tmp_path / "both"), str(tmp_path / "once")
    write_index(first, both, "append")
    write_index(second, both, "append")
    write_index(append_corpora(first, second), once)
    appended, built = read_index(spark, both), read_index(spark, once)
    assert _contents(appended) == _contents(built)
    assert index_count(appended).first()["documents"] == 5
    assert sorted(r["ord"] for r in appended.docs.collect()) == [0, 1, 2, 3, 4]
    lengths = {r["ord"]: (r["num_tokens"], r["dl"]) for r in appended.doc_stats["question"].collect()}
    assert lengths == {0: (3, 3), 1: (0, 0), 2: (0, 0), 3: (2, 2), 4: (2, 2)}

    hits = search_text("sugar cream", appended, sim=1).orderBy("rank").collect()
    assert [r["doc_id"] for r in hits] == ["c", "a", "a"] and hits[0]["total_hits"] == 3
    with redirect_stdout(StringIO()) as plan:
        score(adhoc_query(spark, "sugar"), appended, 4).rows.explain()
    # Only the query side is shuffled: sums stay in their bucket.
    assert "Bucketed: true" in plan.getvalue() and "hashpartitioning(ord" not in plan.getvalue()
    assert "hashpartitioning(query_ord#" not in plan.getvalue().split("BroadcastExchange")[0]

    # A batch that never was published is not there.
    spark.range(3).write.parquet(f"{both}/batches/orphan/docs")
    assert index_count(read_index(spark, both)).first()["documents"] == 5

    write_index(second, both, "overwrite")
    assert index_count(read_index(spark, both)).first()["documents"] == 2
    with pytest.raises(ValueError):
        write_index(second, both, "update")


STEPS = ["docs", "postings_question", "term_stats_question", "doc_stats_question", "postings_topic", "published"]


@pytest.mark.parametrize("step", STEPS)
def test_a_write_that_stops_leaves_the_old_index_whole(spark, questions, tmp_path, monkeypatch, step):
    path = str(tmp_path / "index")
    write_index(questions(("a", "x", "sugar free sugar"), ("b", "y", "the")), path)
    before = _contents(read_index(spark, path))
    plain = DataFrameWriter.parquet

    def stopping(self, target, *more, **options):
        if target.endswith(f"/{step}"):
            raise KeyboardInterrupt
        return plain(self, target, *more, **options)

    saved = DataFrameWriter.saveAsTable

    def stopping_table(self, name, *more, **options):
        if step.startswith("postings_") and step.removeprefix("postings_") in name:
            raise KeyboardInterrupt
        return saved(self, name, *more, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", stopping)
    monkeypatch.setattr(DataFrameWriter, "saveAsTable", stopping_table)
    if step == "published":
        monkeypatch.setattr(index_store, "_publish", lambda *args: stopping(None, "/published"))
    for mode in ("overwrite", "append"):
        with pytest.raises(KeyboardInterrupt):
            write_index(questions(("c", "z", "cream")), path, mode)
    monkeypatch.undo()
    index = read_index(spark, path)
    assert _contents(index) == before and index_count(index).first()["documents"] == 2


def test_empty_index_is_filled_later(spark, questions, tmp_path):
    path = str(tmp_path / "index")
    write_index(questions().limit(0), path)
    assert index_count(read_index(spark, path)).first()["documents"] == 0
    assert search_text("sugar", read_index(spark, path)).count() == 0
    write_index(questions(("a", "x", "sugar")), path, "append")
    assert [r["doc_id"] for r in search_text("sugar", read_index(spark, path)).collect()] == ["a"]
    with pytest.raises(ValueError):
        write_index(questions(("b", "x", "sugar")), path, "append", fields=("question",))
    with pytest.raises(FileNotFoundError):
        read_index(spark, str(tmp_path / "nothing"))


def test_sparse_ordinals_become_dense(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = [(f"d{i}", "t", f"word{i}", (i * 2654435761) % (1 << 60)) for i in range(50)]
    write_index(spark.createDataFrame(rows, QUESTION), path)
    stored = read_index(spark, path).docs.orderBy("ord").collect()
    assert [r["ord"] for r in stored] == list(range(50))
    assert [r["doc_id"] for r in stored] == [r[0] for r in sorted(rows, key=lambda r: r[3])]


def test_a_catalog_that_does_not_know_the_tables(spark, questions, tmp_path):
    path = str(tmp_path / "index")
    write_index(questions(("a", "x", "sugar free sugar"), ("b", "y", "cream")), path)
    whole = _contents(read_index(spark, path))
    for table in spark.catalog.listTables():
        if table.name.startswith("rankwell_"):
            spark.sql(f"DROP TABLE {table.name}")
    assert _contents(read_index(spark, path)) == whole


def test_results_and_report(spark, questions, tmp_path):
    from rankwell import build_index

    index = build_index(questions(("d1", "t", "sugar cream"), ("d2", "t", "sugar"), ("d3", "t", "weights")))
    queries = valid_queries(questions(("7", "q", "sugar cream"), ("7", "q", "it is the"), ("8", "q", " "), ("9", "q", "sugar AND")))
    hits = search(queries, index, sim=4)
    lines = [r["line"] for r in result_lines(hits, queries).orderBy("query_ord").collect()]
    assert lines == ["7,d1,d2", "7"]
    path = write_results(hits, queries, str(tmp_path), 4, 50)
    assert path.endswith("/F4_50.txt") and results_name(0, 1, True) == "S0_1.txt"
    write_results(hits, queries, str(tmp_path), 4, 50)
    assert sorted(r["value"] for r in spark.read.text(path).collect()) == ["7", "7", "7,d1,d2", "7,d1,d2"]

    shown = [tuple(r) for r in report(hits, index.docs, queries).orderBy("query_ord", "rank").collect()]
    assert shown[0] == (0, 0, "Found 2 document(s) that matched query 'ID: 7\nTopic: q\nBody: sugar cream\n':")
    assert shown[1:3] == [(0, 1, "(1) [d1] sugar cream"), (0, 2, "(2) [d2] sugar")]
    assert shown[3][2].startswith("Found 0 document(s)") and len(shown) == 4


def test_xml(spark, questions, tmp_path):
    path = str(tmp_path / "xml")
    write_xml(questions(("1", "a<b", "x & y"), ("2", "", "z")), path)
    text = "".join(f.read_text() for f in (tmp_path / "xml").glob("part-*"))
    assert '<field name="topic">a&lt;b</field>' in text and "<add>" in text and text.count("<doc>") == 2
    write_xml(questions(("3", "", "w")), path)
    back = spark.read.format("xml").option("rowTag", "doc").load(path)
    assert back.count() == 3


def test_threads_inside_together_leave_the_callers_setting(spark):
    def setting():
        return spark.conf.get(scratch._CLEAN_UP, None)

    inside, leave, seen = Event(), Event(), []

    def other():
        with scratch.shuffle_clean_up(spark):
            inside.set()
            leave.wait(60)
            seen.append(setting())

    for before in (None, "false"):
        spark.conf.unset(scratch._CLEAN_UP) if before is None else spark.conf.set(scratch._CLEAN_UP, before)
        outside = setting()
        thread = Thread(target=other)
        with scratch.shuffle_clean_up(spark):
            thread.start()
            assert inside.wait(60)
        assert setting() == "true"  # the other thread is still inside
        leave.set()
        thread.join()
        assert seen.pop() == "true" and setting() == outside
        inside.clear(), leave.clear()
    with pytest.raises(ValueError), scratch.shuffle_clean_up(spark), scratch.shuffle_clean_up(spark):
        raise ValueError
    assert setting() == outside
    spark.conf.unset(scratch._CLEAN_UP)


def test_no_intermediate_tables_in_a_machines_own_folder():
    class Context:
        master = "spark://machine:7077"

        def __init__(self, folder):
            self.getCheckpointDir = lambda: folder

    class Session:
        def __init__(self, setting=None, folder=None):
            self.conf, self.sparkContext = {"spark.checkpoint.dir": setting}, Context(folder)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_folder(Session())
    assert scratch.scratch_path(Session("s3://shared/", "hdfs://other"), "x").startswith("s3://shared/x-")
    assert scratch.shared_folder(Session(None, "hdfs://other")) == "hdfs://other"
