"""Connected components: contracted inside tasks first, against brute force."""

import random

import numpy as np

from rankwell.llm import components


def expected(edges):
    label = {x: x for edge in edges for x in edge}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def graph(seed):
    draw = random.Random(seed)
    chain = [(i, i + 1) for i in range(100, 160)]
    hub = [(7, 1000 + i) for i in range(80)]
    loose = [(draw.randrange(2000, 2300), draw.randrange(2000, 2300)) for _ in range(150)]
    edges = chain + hub + loose + [(5000, 5000), (-3, 2**62)]
    draw.shuffle(edges)
    return edges


def test_contraction_of_a_task_is_that_of_brute_force():
    edges = graph(1)
    node, root = components.smallest_ends(*np.array(edges).T)
    found = dict(zip(node.tolist(), root.tolist(), strict=True))
    want = expected(edges)
    assert {x: found.get(x, x) for x in want} == want
    assert all(a.size == 0 for a in components.smallest_ends(np.zeros(0, "int64"), np.zeros(0, "int64")))


def test_edges_of_many_tasks_meet_over_rounds(spark):
    edges = graph(2)
    rows = spark.createDataFrame(edges, "a long, b long").repartition(16)
    for per_task in (20, 10_000):
        got = components.connected_components(rows, rows_per_task=per_task).collect()
        assert {r.node: r.component for r in got} == expected(edges) and len(got) == len(expected(edges))


def test_few_edges_cost_the_driver_two_writes(spark, monkeypatch):
    written, plain = [], components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, name: (written.append(name), plain(df, name))[1])
    edges = graph(3)
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == expected(edges)
    assert written == ["component-pairs", "component-stars"]
