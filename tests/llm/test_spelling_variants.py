import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from rankwell.llm import spelling_variants as sv

DOCS = "doc_id long, text string, word string, n int, id long, run string"
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def table(spark, rows):
    return spark.createDataFrame([(i, t, "w", 1, 2, "r") for i, t in rows], DOCS)


def brute_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words):
    near = {w: [v for v in words if v != w and one_edit(v, w)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w] or "", root(w), n, len(near[w]), words.get(form[w], 0)) for w, n in words.items())


def rows_of(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


def similar_words(seed, n=250, alphabet="aabé"):
    dice = random.Random(seed)
    words = {"".join(dice.choice(alphabet) for _ in range(dice.randrange(0, 9))): 1 for _ in range(n)}
    words |= {"a" * k: 1 for k in range(1, 12)} | {"x" * 3000: 1, "x" * 3001: 1, "x" * 1500 + "y" + "x" * 1499: 1, "\U0001f600a": 1, "\U0001f601a": 1}
    words.pop("", None)
    return {w: dice.choice([1, 2, 6, 31, 200, 1001]) for w in words}


@pytest.mark.parametrize(("seed", "words_per_range"), [(1, 100_000), (2, 9), (3, 1)])
def test_groups_against_brute_force(spark, seed, words_per_range):
    words = similar_words(seed)
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows_of(sv.group_variants(frame, words_per_range=words_per_range)) == brute(words)


@pytest.mark.parametrize("words_per_range", [1000, 20, 2])
def test_nodes_are_those_of_one_trie(spark, words_per_range):
    words = sorted(similar_words(4))
    got = {r.word: r.nodes for r in sv.trie_nodes(spark.createDataFrame([(w,) for w in words], "word string"), words_per_range=words_per_range).collect()}
    number, prefix_of = {}, {}
    for w in words:
        assert len(got[w]) == len(w) + 1
        for i, node in enumerate(got[w]):
            assert number.setdefault(w[:i], node) == node and prefix_of.setdefault(node, w[:i]) == w[:i]
    whole = [got[w][-1] for w in words]
    assert whole == sorted(whole) and len(set(whole)) == len(whole)


def some_texts(seed):
    dice = random.Random(seed)
    names = ["Wörter", "wÖrter", "letters", "LETTERS", "lettres", "letter", "lettersé", "schließen", "naïveté", "short", "übermäßig", "×÷×÷×÷×"]
    rows = [(i, " ".join(dice.choices(names, k=40)) + dice.choice(["", ".", "\n9x9", "_letters_"])) for i in range(150)]
    rows += [(1000, None), (1001, ""), (None, "letters letters"), (5, rows[5][1]), (5, rows[5][1]), (2000, "letters " * 30_000), (2001, "z" * 50_000)]
    return rows


def test_words_of_texts_against_brute_force_and_sql(spark):
    rows = some_texts(1)
    words = {r.word: r.n for r in sv.count_words(table(spark, rows)).collect()}
    assert words == brute_words(rows)
    got = rows_of(sv.query(table(spark, rows)))
    assert got == brute(words)
    con = duckdb.connect()
    con.register("documents", table(spark, rows).select("doc_id", "text").toArrow())
    columns = ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted((w, f or "", r, n, k, m or 0) for w, f, r, n, k, m in con.sql(f"SELECT {', '.join(columns)} FROM ({sv.SQL})").fetchall()) == got


def test_no_words(spark):
    for rows in ([], [(1, None), (2, "tiny")]):
        got = sv.query(table(spark, rows))
        assert got.collect() == [] and got.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_chains_of_forms_end_at_their_root(spark):
    words = {"abcdefgh"[:k] + "z" * 6: 5 ** (8 - k) * 2 for k in range(1, 8)}
    assert len({r[2] for r in brute(words)}) == 1
    assert rows_of(sv.group_variants(spark.createDataFrame(list(words.items()), "word string, n long"))) == brute(words)


def test_words_that_meet_are_no_more_than_the_alphabet(spark):
    words = spark.createDataFrame([(f"{a}{b}word{c}", 1) for a in "abcdefghij" for b in "abcdefghij" for c in "abcdefghij"], "word string, n long")
    pairs = sv.pair_dictionary(sv.numbered_words(words))
    assert pairs.count() == 1000 * (7 + 8)
    assert pairs.filter("skips").groupBy("prefix", "suffix").count().agg(F.max("count")).first()[0] == 10
