from collections import defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from rankwell.llm import quality, toxicity
from tests.llm.test_exact_dedup import lowered
from tests.llm.test_jaccard_join import brute

SF_DIR = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    clean = {r.doc_id for r in toxicity.query(docs, labels).collect() if not r.predicted}
    good = {r.doc_id for r in quality.query(docs, labels).collect() if r.predicted}
    rows = {r.doc_id: tuple(r) for r in docs.collect()}
    left = {i: r[1] or "" for i, r in rows.items() if i in clean & good}
    last = defaultdict(int)
    for i, text in left.items():
        last[lowered(text)] = max(last[lowered(text)], i)
    left = {i: left[i] for i in last.values()}
    left = {i: left[i] for i, _, component in brute(list(left.items())) if i == component}

    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF_DIR)
        assert kept.columns == docs.columns, name
        kept = spark.createDataFrame(kept.collect(), docs.schema)
    assert sorted(tuple(r) for r in kept.collect()) == sorted(rows[i] for i in left)
    pieces = corpus_pipeline.run(spark, SF_DIR)
    per_doc = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("whole")).collect()
    assert {r.doc_id for r in per_doc} == set(left) and all(r.n == r.whole for r in per_doc)


def test_stage_names_and_operators():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "quality classifier", "exact dedup", "n-gram Jaccard join", "packing",
    ]


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF_DIR).count() == 0, name


@pytest.mark.parametrize("toxic", [None, 0, 1])
def test_toxicity_stage_keeps_all_without_both_classes(spark, tmp_path, toxic):
    docs = spark.createDataFrame([(i, f"a calm text of number {i}") for i in range(30)] + [(30, None)], "doc_id long, text string")
    labels = docs.select("doc_id", F.lit(toxic).cast("int").alias("toxic"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    (labels if toxic is not None else labels.limit(0)).write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == list(range(31))


def test_quality_stage_keeps_all_without_both_classes(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"a text of number {i}") for i in range(30)] + [(30, None)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs.select("doc_id", F.lit(1).alias("quality")).write.parquet(f"{tmp_path}/labels.parquet")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_low_quality(spark, docs, str(tmp_path)).collect()) == list(range(31))


def test_stages_on_nulls_long_texts_repeated_rows_and_clashing_columns(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, content string, digest string"
    rows = [(1, None), (2, ""), (None, "no id here at all"), (3, "one two three four five six seven"), (3, "one two three four five six seven")]
    rows += [(4, "word " * 40_000), (5, "One two three four five six seven"), (6, None)]
    docs = spark.createDataFrame([(i, t, "en", "web", 1, 0.5, "c", "d") for i, t in rows], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF_DIR)
        assert kept.columns == docs.columns, name
        assert {tuple(r) for r in kept.collect()} <= {tuple(r) for r in docs.collect()}, name
        if name == "exact dedup":
            assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
                [(6, None), (None, "no id here at all"), (5, "One two three four five six seven"), (4, "word " * 40_000)], key=str
            )
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert pieces.groupBy().agg(F.count("*")).first()[0] >= len(rows)
