import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from rankwell.llm import quality, toxicity
from rankwell.llm.chain import Chain, fit, marginals
from rankwell.llm.common import held_out

SF_DIR = "/root/testdata/sf0.01"


def brute_marginals(scores, chain):
    weights = np.zeros((len(scores), 2))
    step = [[0, chain.t01], [chain.t10, chain.t11]]
    for tags in itertools.product((0, 1), repeat=len(scores)):
        total = chain.start * tags[0] + sum(s * t for s, t in zip(scores, tags, strict=True))
        total += sum(step[a][b] for a, b in itertools.pairwise(tags))
        for i, t in enumerate(tags):
            weights[i, t] += np.exp(total)
    return weights[:, 1] / weights.sum(axis=1)


def test_marginals_against_all_taggings():
    rng = np.random.default_rng(0)
    chain = Chain(0.4, -1.2, 0.7, 1.5)
    lengths = [1, 7, 2, 10, 1, 3]
    scores = rng.normal(size=sum(lengths)) * 2
    first = np.zeros(len(scores), bool)
    first[np.cumsum(lengths) - lengths] = True
    want = np.concatenate([brute_marginals(s, chain) for s in np.split(scores, np.cumsum(lengths)[:-1])])
    assert np.allclose(marginals(scores, first, chain), want)
    assert len(marginals(np.zeros(0), np.zeros(0, bool), chain)) == 0


def test_fit_recovers_a_chain():
    rng = np.random.default_rng(1)
    tags = np.zeros(6000)
    for i in range(1, len(tags)):
        tags[i] = rng.random() < (0.9 if tags[i - 1] else 0.1)
    seen = tags + rng.normal(size=len(tags)) * 1.2
    first = np.arange(len(tags)) % 50 == 0
    weights, chain = fit(np.column_stack([seen, np.ones(len(tags))]), tags, first)
    right = ((marginals(np.column_stack([seen, np.ones(len(tags))]) @ weights, first, chain) > 0.5) == tags).mean()
    assert right > ((seen > 0.5) == tags).mean() + 0.1 and chain.t11 > chain.t01


def accuracy(scored, labels, label):
    judged = scored.filter("held_out").join(labels, "doc_id").select((F.col("predicted") == F.col(label)).cast("int").alias("right"))
    return judged.agg(F.avg("right")).first()[0]


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF_DIR}/documents.parquet"), spark.read.parquet(f"{SF_DIR}/labels.parquet")
    scored = toxicity.query(docs, labels)
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"] and scored.count() == docs.count()
    assert accuracy(scored, labels, "toxic") > 0.92
    assert accuracy(quality.query(docs, labels), labels, "quality") > 0.97


def tables(spark):
    bad = "you awful zorgon of a man"
    dice = random.Random(6)

    def calm():
        return " ".join(dice.choice("abcdefgh") * dice.randrange(1, 4) + dice.choice("mnopqrs") for _ in range(40))

    rows = [(i, f"{calm()}\nSecond line {calm()}", "x", 1.0) for i in range(60)]
    rows += [(100 + i, f"{calm()} {bad} {calm()}\n@@@ ### $$$ !!!! %%%", "x", 1.0) for i in range(40)]
    rows += [(900, None, "x", 1.0), (901, "", "x", 1.0), (902, "zorgon " * 50_000, "x", 1.0), (903, "\n\n", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out string, score double")
    labels = spark.createDataFrame([(r[0], int(r[0] < 100), int(100 <= r[0] < 900)) for r in rows if r[0] < 900], "doc_id long, quality int, toxic int")
    return docs, labels


def test_toxic_spans(spark):
    docs, labels = tables(spark)
    model = toxicity.fit_toxicity(docs, labels)
    tagged = {r.doc_id: r for r in toxicity.tag_toxic_spans(docs, model).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(tagged) == len(texts)
    for i, r in tagged.items():
        found = [texts[i][s.start : s.end] for s in r.spans]
        assert bool(found) == (100 <= i < 900 or i == 902), i
        assert (r.score >= 0.5) == bool(found)
        if 100 <= i < 900:
            assert any("zorgon" in f for f in found)
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in texts if i < 100 or i in (900, 901, 903)}


def test_line_tags(spark):
    docs, labels = tables(spark)
    model = quality.fit_quality(docs, labels)
    tagged = {r.doc_id: r for r in quality.tag_lines(docs, model).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert all(len(r.lines) == texts[i].count("\n") + 1 and 0 <= r.score <= 1 for i, r in tagged.items())
    assert all((r.score >= 0.3) == (i < 100) for i, r in tagged.items() if i < 900)


def test_without_labels_and_empty_tables(spark):
    docs, labels = tables(spark)
    for module in (toxicity, quality):
        assert {r.score for r in module.query(docs.select("doc_id", "text"), labels.limit(0)).collect()} == {0.5}
        assert module.query(docs.select("doc_id", "text").limit(0), labels).count() == 0


def test_held_out_rows(spark):
    import zlib

    got = spark.range(200).select("id", held_out(F.col("id")).alias("held")).collect()
    assert all(r.held == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)


def test_gradients_by_portions_and_by_number_agree():
    from rankwell.llm.chain import OneHot

    rng = np.random.default_rng(3)
    codes = rng.integers(0, 4, 500)
    tags = (rng.random(500) < 0.2 + 0.2 * codes).astype(float)
    first = rng.random(500) < 0.1
    first[0] = True
    whole, chain = fit(np.eye(4)[codes], tags, first, rounds=20)
    for portion in (1, 37, 1000):
        weights, own = fit(OneHot(codes, 4), tags, first, rounds=20, portion=portion)
        assert np.allclose(weights, whole) and np.allclose(own.vector(), chain.vector())


def test_training_rows_are_bounded_distinct_and_not_the_smallest_ids(spark):
    from rankwell.llm.chain import training_rows

    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.lit(1).alias("label"))
    docs = docs.unionByName(docs).unionByName(docs.limit(30).withColumn("text", F.lit("another")))
    labels = spark.range(400).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("toxic"))
    texts, label = training_rows(docs, labels.unionByName(labels), "toxic", 60, 1000)
    assert len(texts) == 120 and label.sum() == 60 and len(set(zip(texts, label, strict=True))) > 100
    ids = [int(t.split()[1]) for t in texts if t != "another"]
    assert max(ids) > 300 and not any(__import__("zlib").crc32(str(i).encode()) % 5 == 0 for i in ids)
    short, _ = training_rows(docs, labels, "toxic", 60, 6)
    assert short and all(len(t) <= 6 for t in short)


def test_repeated_ids_and_rows_beyond_the_bound(spark):
    docs, labels = tables(spark)
    plain = docs.select("doc_id", "text")
    twice = plain.unionByName(plain)
    for module, fitted in ((toxicity, toxicity.fit_toxicity), (quality, quality.fit_quality)):
        model = fitted(twice, labels, rows=25)
        assert model.document.any()
        scored = module.query(twice, labels).collect()
        assert len(scored) == 2 * plain.count()
        scores = {}
        for r in scored:
            scores.setdefault(r.doc_id, set()).add(round(r.score, 12))
        assert all(len(s) == 1 for s in scores.values())


def brute_document_score(model, text):
    """Toxicity of a text by its definition: marginals by all taggings, their summary, the logistic function."""
    words = [w.lower() for w in toxicity._WORD.findall(text)]
    p = brute_marginals([model.emission[s] for s in model.steps(words)], model.chain)
    top = min(max(p.max(), 1e-4), 1 - 1e-4)
    x = [np.log(top / (1 - top)), np.log(p.sum() + 0.01), np.log(p.mean() + 1e-4), 1.0]
    return 1 / (1 + np.exp(-np.clip(np.dot(x, model.document), -30, 30)))


def test_scores_against_brute_force(spark):
    docs, labels = tables(spark)
    model = toxicity.fit_toxicity(docs, labels)
    texts = ["you awful zorgon", "zorgon bm cq dr", "aam bbn", "of a man you awful zorgon of a man", "ccq " * 9]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r[0] for r in frame.select(toxicity.toxicity_score(model)("text")).collect()]
    assert np.allclose(got, [brute_document_score(model, t) for t in texts])
    lines = quality.fit_quality(docs, labels)
    for text in texts:
        features, lengths, lines_of = quality.line_features([text + "\nsecond line here.\n@@@"])
        p = brute_marginals(list(features @ lines.weights), lines.chain)
        weight = lengths + 1.0
        mean = np.clip((weight * p).sum() / weight.sum(), 1e-4, 1 - 1e-4)
        x = [(weight * p).sum() / weight.sum(), np.log(mean / (1 - mean)), p.min(), np.log(weight.sum()) / 5, 1.0]
        assert np.allclose(lines.scores([text + "\nsecond line here.\n@@@"]), 1 / (1 + np.exp(-np.clip(np.dot(x, lines.document), -30, 30))))
