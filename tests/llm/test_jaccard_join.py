import random
import re
from collections import defaultdict

import numpy as np
import pytest

from rankwell.llm.jaccard_join import CELL_BITS, SetNames, _paired, _prefix, keep_one, link_sets, near_duplicates
from rankwell.llm.shingles import shingle_sets

DOCS = "doc_id long, text string, key long, n int"


def shingles(text, words=5):
    found = [w for w in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    return frozenset(tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))) if found else frozenset()


def brute(rows, percent=80):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(x)] = root(y)
    smallest = defaultdict(list)
    for x in range(len(sets)):
        smallest[root(x)].append(sets[x][0])
    return sorted((i, len(s), min(smallest[root(x)])) for x, (i, s) in enumerate(sets))


def near_copies(seed, n=40):
    dice = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    common = [dice.choice(vocabulary) for _ in range(30)]
    rows = []
    for doc in range(n):
        base = [dice.choice(vocabulary) for _ in range(dice.choice([1, 3, 5, 8, 60, 90]))]
        if doc % 3 == 0:
            base += common
        for _ in range(dice.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(dice.choice([0, 1, 1, 2])):
                copy[dice.randrange(len(copy))] = dice.choice(vocabulary)
            rows.append(" ".join(copy).upper() if dice.random() < 0.2 else "\t".join(copy))
    dice.shuffle(rows)
    return [*enumerate([*rows, None, "", " \n", "One", "one", "é É", "É é"], start=10)]


@pytest.mark.parametrize("options", [{}, {"hot": 1, "block_rows": 3}, {"block_shingles": 100, "key_bits": 5}])
def test_components_against_brute_force(spark, options):
    rows = near_copies(1)
    got = near_duplicates(spark.createDataFrame([(i, t, 0, 0) for i, t in rows], DOCS), **options).collect()
    assert sorted(tuple(r)[:3] for r in got) == brute(rows)


def test_local_join_against_all_pairs():
    for seed in range(6):
        sets = [s for s in shingle_sets([t for _, t in near_copies(seed, 60)]) if len(s)]
        for percent in (50, 80, 95):
            links = set()
            for i in range(len(sets)):
                for j in range(i):
                    both = len(np.intersect1d(sets[i], sets[j]))
                    if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                        links.add((i, j))
            parts = []
            for pairs in (links, link_sets(sets, percent)):
                label = list(range(len(sets)))
                for i, j in pairs:
                    a, b = label[i], label[j]
                    label = [b if x == a else x for x in label]
                parts.append({tuple(k for k in range(len(sets)) if label[k] == x) for x in set(label)})
            assert parts[0] == parts[1]
            assert {tuple(sorted(p, reverse=True)) for p in link_sets(sets, percent)} <= links


def test_large_group_of_near_copies_and_copies(spark):
    dice = random.Random(4)
    base = [f"v{dice.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(150):
        copy = list(base)
        for _ in range(i % 6):
            copy[dice.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, rows[3][1]) for i in range(100)]
    got = near_duplicates(spark.createDataFrame([(i, t, 0, 0) for i, t in rows], DOCS), block_rows=40).collect()
    assert sorted(tuple(r)[:3] for r in got) == brute(rows)


def test_empty_repeated_and_null_ids(spark):
    assert near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(1, "a b c d e f", 0, 0)] * 2 + [(None, "A b c d e f", 0, 0), (None, "alone", 0, 0), (0, "a b c d e f", 0, 0)]
    got = near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id if r.n_shingles == 2 else None) for r in got) == [
        (0, 1, None), (0, 2, 0), (0, 2, 0), (1, 2, 0), (1, 2, 0),
    ]


def test_keep_one_without_ids_and_without_words(spark):
    rows = [
        (None, "a b c"), (None, "A b c"), (None, "x y z"), (9, "X y z"), (4, "x y z"), (None, ""), (None, ""), (None, None),
        (7, " "), (7, " "), (7, ""), (8, None), (8, None), (3, "a lone one"), (3, "a lone one"), (3, "another text"),
    ]
    kept = keep_one(spark.createDataFrame([(i, t, 0, 0) for i, t in rows], DOCS))
    assert kept.columns == ["doc_id", "text", *kept.columns[2:]]
    got = sorted(((r.doc_id, r.text.lower() if r.text else r.text) for r in kept.collect()), key=str)
    want = [(None, "a b c"), (4, "x y z"), (None, ""), (None, None), (7, " "), (7, ""), (8, None), (3, "a lone one"), (3, "another text")]
    assert got == sorted(want, key=str)


def test_names_that_several_sets_share(spark):
    rows = near_copies(2)
    docs = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], DOCS)
    kept = sorted(r.doc_id for r in keep_one(docs, key_bits=4).collect())
    assert kept == sorted(i for i, n, component in brute(rows) if i == component or not n)


def test_very_long_texts(spark):
    dice = random.Random(8)
    long = [f"w{dice.randrange(10**6)}" for _ in range(400_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:360_000])), (3, " ".join(long[:200_000])), (4, "short text"), (5, "y" * 2_000_000)]
    got = near_duplicates(spark.createDataFrame([(i, t, 0, 0) for i, t in rows], DOCS)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 5)]


def test_blocks_of_a_chain_of_unlike_documents_meet_by_shingles_alone(spark):
    """A text goes to its own block and to those that hold a shingle of its prefix, however many blocks its cluster has."""
    passages = [[f"p{i}x{j}" for j in range(30)] for i in range(121)]
    texts = [" ".join(passages[i] + passages[i + 1]) for i in range(120)]  # each shares a passage with the next
    names, cells, blocks = SetNames(), np.zeros(1 << CELL_BITS, np.uint32), 40
    sets = shingle_sets(texts)
    keys = [names(s) for s in sets]
    block = {key: i % blocks for i, key in enumerate(keys)}
    prefixes = {key: set(_prefix(s, cells, 80).tolist()) for key, s in zip(keys, sets, strict=True)}
    expected = {(k, block[k], block[k]) for k in keys}
    for k in keys:
        expected |= {(k, *sorted((block[k], block[m]))) for m in keys if block[m] != block[k] and prefixes[k] & prefixes[m]}
    given = spark.createDataFrame([(7, blocks, block[k], k, t) for k, t in zip(keys, texts, strict=True)], "cluster long, blocks int, block int, key long, text string")
    got = _paired(given, spark.sparkContext.broadcast(cells), names, 5, 80).collect()
    assert sorted((r.key, *map(int, r.pair.split("-"))) for r in got) == sorted(expected)
    assert len(got) <= 3 * len(texts) < blocks * len(texts)
