import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankwell import analyze, escape_query, render_doc_xml, render_question, tokenize
from rankwell.functions.text import lower, query_chunks, trim_control

SAMPLES = {
    "can't stop": ["can't", "stop"],
    "www.example.com, 6.5 or 1,000": ["www.example.com", "6.5", "or", "1,000"],
    "1000mg a_b sugar-free and/or": ["1000mg", "a_b", "sugar", "free", "and", "or"],
    "_ __ _a a_ ___b___ .a. a..b": ["_a", "a_", "___b___", "a", "a", "b"],
    "1.a a.1 1'2 a'b' ''c": ["1", "a", "a", "1", "1'2", "a'b", "c"],
    "Ünïcode ÉTÉ naïve": ["Ünïcode", "ÉTÉ", "naïve"],
    "": [],
    "!!! ...": [],
}


def _reference_tokens(text):
    """The same rules over single characters, without a regular expression engine."""
    import unicodedata

    def kind(c):
        if c == "_":
            return "_"
        category = unicodedata.category(c)
        return "L" if category[0] in "LM" else "N" if category == "Nd" else ""

    tokens, current = [], ""
    for i, c in enumerate(text):
        before = kind(text[i - 1]) if i else ""
        after = kind(text[i + 1]) if i + 1 < len(text) else ""
        joins = (c in ".':·’" and before == after == "L") or (c in ".,;'’" and before == after == "N")
        if kind(c) or (current and joins):
            current += c
        elif current:
            tokens.append(current)
            current = ""
    tokens.append(current)
    return [t for t in tokens if t.strip("_")]


def test_tokenize_samples(spark):
    rows = spark.createDataFrame([(t,) for t in SAMPLES], "t string").select("t", tokenize("t").alias("w")).collect()
    assert {r["t"]: r["w"] for r in rows} == SAMPLES
    assert all(_reference_tokens(t) == w for t, w in SAMPLES.items())


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab1é_.,;:'’-·\n 9"), max_size=40), min_size=50, max_size=50))
def test_tokenize_agrees_with_plain_rules(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tokenize("t").alias("w")).collect()
    for row in rows:
        assert row["w"] == _reference_tokens(row["t"])


def test_very_long_runs_do_not_overflow(spark):
    texts = ["ab" * 500_000, "_" * 300_000 + " x", "a.b" * 200_000, "1,2" * 100_000]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(F.size(tokenize("t")).alias("n")).collect()
    assert [r["n"] for r in rows] == [1, 1, 1, 1]


def test_lower_is_per_character(spark):
    row = spark.createDataFrame([("ΑΣ İstanbul ÉTÉ",)], "t string").select(lower("t").alias("l")).first()
    assert row["l"] == "ασ istanbul été"


def test_stop_words_leave_gaps(spark):
    df = spark.createDataFrame([("The sugar and the Cream",)], "t string")
    assert [tuple(t) for t in analyze(df, "t").first()["tokens"]] == [(1, "sugar"), (4, "cream")]
    assert len(analyze(df, "t", "nostop").first()["tokens"]) == 5
    with pytest.raises(ValueError):
        analyze(df, "t", "other")
    with pytest.raises(ValueError):
        analyze(df, "t", "synonym")


def test_chunks_trim_and_escape(spark):
    df = spark.createDataFrame([("\t a\u3000b \r\n c-d\x01",)], "t string")
    row = df.select(query_chunks("t").alias("c"), trim_control("t").alias("t")).first()
    assert row["c"] == ["a", "b", "c-d\x01"]
    assert row["t"] == "a\u3000b \r\n c-d"
    special = '\\+-!():^[]"{}~*?|&/'
    escaped = spark.createDataFrame([(special + "ab",)], "t string").select(escape_query("t").alias("e")).first()["e"]
    assert escaped == re.sub(r"([^ab])", r"\\\1", special + "ab")


def test_rendering(spark):
    row = spark.createDataFrame([("1", "a<b", "x & y")], "id string, topic string, body string").select(
        render_question("id", "topic", "body").alias("q"), render_doc_xml("id", "topic", "body").alias("x")
    ).first()
    assert row["q"] == "ID: 1\nTopic: a<b\nBody: x & y\n"
    assert row["x"] == (
        '<doc>\n<field name="id">1</field>\n<field name="topic">a&lt;b</field>\n<field name="body">x &amp; y</field>\n</doc>\n'
    )
