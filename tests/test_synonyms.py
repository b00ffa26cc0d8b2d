import random

import pytest
from pyspark.sql import functions as F

from rankwell import SynonymRules, analyze, build_index, expand_synonyms, query_terms, read_synonyms, search_text

WORDNET = """s(100000001,1,'sugar',n,1,0).
s(100000001,2,'glucose',n,1,0).
s(100000002,1,'heart attack',n,1,0).
s(100000002,2,'infarct',n,1,0).
s(100000003,1,'driver''s license',n,1,0).
"""


@pytest.fixture(scope="module")
def rules(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("wordnet") / "wn_s.pl"
    path.write_text(WORDNET)
    return SynonymRules.of(read_synonyms(spark, str(path)))


def test_rules(spark, tmp_path):
    (tmp_path / "wn.pl").write_text(WORDNET + "s(100000001,1,'late',n,1,0).\ns(100000004,1,'Driver''s Test',n,1,0).\ns(100000004,2,'exam',n,1,0).\n")
    found = {(" ".join(r["input"]), " ".join(r["output"])) for r in read_synonyms(spark, str(tmp_path)).collect()}
    groups = [{"sugar", "glucose"}, {"heart attack", "infarct"}, {"driver's test", "exam"}]
    assert found == {(a, b) for group in groups for a in group for b in group}


def test_documents(spark, rules):
    df = spark.createDataFrame([(0, "Blood Sugar after infarct today"), (1, "a heart attack"), (2, ""), (3, "the")], "ord long, t string")
    rows = {r["ord"]: {tuple(t) for t in r["tokens"]} for r in analyze(df, "t", "synonym", rules, ["ord"]).collect()}
    assert rows[0] == {
        (0, "blood"), (1, "sugar"), (1, "glucose"), (2, "after"), (3, "heart"), (3, "infarct"), (4, "today"), (4, "attack"),
    }
    assert rows[1] == {(1, "heart"), (1, "infarct"), (2, "attack")}
    assert rows[2] == rows[3] == set()


def test_lengths_count_positions(questions, rules):
    index = build_index(questions(("1", "", "Blood Sugar after infarct today"), ("2", "", "a heart attack")), rules, ("question",))
    assert {r["ord"]: (r["num_tokens"], r["dl"]) for r in index.doc_stats["question"].collect()} == {0: (8, 5), 1: (3, 2)}
    hits = search_text("infarct", index, sim=4, synonyms=rules).orderBy("rank").collect()
    assert {r["doc_id"] for r in hits} == {"1", "2"}


def test_queries_expand_inside_chunks_only(questions, rules):
    terms = query_terms(questions(("1", "", "heart attack"), ("2", "", "infarct"), ("3", "", "heart-attack")), "synonym", rules)
    found = {}
    for r in terms.collect():
        found.setdefault(r["query_ord"], set()).add((r["chunk"], r["pos"], r["term"]))
    assert found == {
        0: {(0, 0, "heart"), (1, 0, "attack")},
        1: {(0, 0, "heart"), (0, 0, "infarct"), (0, 1, "attack")},
        2: {(0, 0, "heart"), (0, 0, "infarct"), (0, 1, "attack")},
    }


def _greedy(words, rules):
    """Longest match from the left, one position at a time."""
    tokens, at = [], 0
    longest = max(len(i) for i in rules)
    while at < len(words):
        for size in range(min(longest, len(words) - at), 0, -1):
            outputs = rules.get(tuple(words[at : at + size]))
            if outputs:
                tokens += [(at + i, word) for output in outputs for i, word in enumerate(output)]
                at += size
                break
        else:
            tokens.append((at, words[at]))
            at += 1
    return sorted(tokens)


@pytest.mark.parametrize("broadcast", [True, False])
def test_many_word_rules_against_brute_force(spark, broadcast):
    rng = random.Random(3)
    phrase = lambda most: tuple(rng.choice("abcd") for _ in range(rng.randint(1, most)))
    rules = {}
    while len(rules) < 12:
        rules[phrase(4)] = {phrase(3) for _ in range(rng.randint(1, 3))}
    pairs = [(list(i), list(o)) for i, outputs in rules.items() for o in outputs]
    docs = [(n, [rng.choice("abcde") for _ in range(rng.randint(0, 40))]) for n in range(150)]
    loaded = SynonymRules.of(spark.createDataFrame(pairs, "input array<string>, output array<string>"))
    loaded = SynonymRules(loaded.heads, loaded.rules, loaded.groups, loaded.longest, broadcast)
    rows = expand_synonyms(spark.createDataFrame(docs, "ord long, words array<string>"), "words", loaded, ["ord"]).collect()
    assert len(rows) == len(docs)
    for row in rows:
        assert [tuple(t) for t in row["tokens"]] == _greedy(row["words"], rules)


def test_a_star_expands_like_pairs_and_never_squares(spark, monkeypatch):
    from rankwell.operators import synonyms as module

    monkeypatch.setattr(module, "CHUNK", 7)
    members = [("f", 1, [f"word{i}"]) for i in range(60)] + [("f", 2, ["word3"]), ("f", 2, ["other", "words"]), ("f", 3, ["alone"])]
    synsets = spark.createDataFrame(members, "file string, run long, words array<string>")
    star = SynonymRules.of_synsets(synsets)
    assert star.rules.count() == 61 and star.groups.count() <= 2 + 60
    assert star.groups.select(F.sum(F.size("outputs"))).first()[0] == 62
    texts = spark.createDataFrame([(0, ["word3", "alone", "other", "words"]), (1, [])], "ord long, words array<string>")
    found = {r["ord"]: {tuple(t) for t in r["tokens"]} for r in expand_synonyms(texts, "words", star, ["ord"]).collect()}
    assert found[0] == {(0, f"word{i}") for i in range(60)} | {(0, "other"), (1, "words"), (1, "alone"), (2, "other"), (3, "words"), (2, "word3")}
    assert found[1] == set()


def test_a_hot_first_word_without_broadcasts(spark, monkeypatch):
    """One word heads half of the rules and stands in every text."""
    from dataclasses import replace

    from rankwell.operators import skew

    monkeypatch.setattr(skew, "LEAST_HOT", 5)
    dice = random.Random(9)
    rules = [("hot", f"w{i}") for i in range(40)] + [(f"w{i}", f"w{i + 1}", "hot") for i in range(40)] + [("hot",), ("hot", "w1", "w2")]
    rows = [(list(rule), list(out)) for rule in rules for out in (rule, ("out", rule[-1]))]
    small = SynonymRules.of(spark.createDataFrame(rows, "input array<string>, output array<string>"))
    texts = [(n, [dice.choice(["hot", "hot", f"w{dice.randrange(41)}", "cold"]) for _ in range(dice.randrange(30))]) for n in range(60)]
    texts = spark.createDataFrame(texts, "ord long, words array<string>")
    assert small.small
    plain, spread = (
        sorted((r["ord"], sorted(tuple(t) for t in r["tokens"])) for r in expand_synonyms(texts, "words", of, ["ord"]).collect())
        for of in (small, replace(small, small=False))
    )
    assert plain == spread and any(tokens for _, tokens in plain)


def test_the_file_is_read_once(spark, tmp_path, capsys):
    (tmp_path / "wn.pl").write_text(WORDNET)
    read_synonyms(spark, str(tmp_path)).explain()
    assert "FileScan text" not in capsys.readouterr().out


@pytest.mark.parametrize("longest_out", [1, 3])
def test_small_rules_in_small_pieces_against_brute_force(spark, monkeypatch, longest_out):
    """Rows, batches and merged outputs of more than a task takes at once; several groups to an input."""
    from rankwell.operators import phrases

    monkeypatch.setattr(phrases, "WORDS_AT_ONCE", 11)
    monkeypatch.setattr(phrases, "TOKENS_AT_ONCE", 7)
    monkeypatch.setattr(phrases, "KEPT_OUTPUTS", 5)
    dice = random.Random(longest_out)
    phrase = lambda most: tuple(dice.choice(["a", "b", "ç", "日本"]) for _ in range(dice.randint(1, most)))
    synsets = [{phrase(longest_out) for _ in range(dice.randint(1, 4))} for _ in range(9)]
    rows = [("f", run, list(words)) for run, members in enumerate(synsets) for words in members]
    star = SynonymRules.of_synsets(spark.createDataFrame(rows, "file string, run long, words array<string>"))
    assert star.small
    rules = {}
    for members in (m for m in synsets if len(m) > 1):
        for words in members:
            rules[words] = rules.get(words, set()) | members
    docs = [(n, [dice.choice(["a", "b", "ç", "日本", "x"]) for _ in range(dice.choice([0, 1, 5, 40]))]) for n in range(80)] + [(80, None)]
    texts = spark.createDataFrame(docs, "ord long, words array<string>")
    found = {r["ord"]: [tuple(t) for t in r["tokens"]] for r in expand_synonyms(texts, "words", star, ["ord"]).collect()}
    assert found == {n: _greedy(words or [], rules) for n, words in docs}


def test_small_rules_join_and_group_nothing(questions, rules, capsys):
    """The text is shuffled once, by document, and each text is cut into words once."""
    index = build_index(questions(("1", "", "Blood Sugar after infarct today")), rules, ("question",))
    index.postings["question"].explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Aggregate" not in plan
    assert plan.count("regexp_extract_all") == 1
