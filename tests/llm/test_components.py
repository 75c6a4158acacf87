"""Connected components against union-find."""

import random

from keyloom.llm.common import components


def test_random_graphs(spark):
    rng = random.Random(4)
    chain = [(k, k + 1) for k in range(60)]
    star = [(1000, 2000 + k) for k in range(300)]
    some = [(rng.randrange(5000, 5200), rng.randrange(5000, 5200)) for _ in range(110)]
    edges = chain + star + some + [(7, 7), (-5, 3), (-5, 3)]
    root = {}

    def find(a):
        root.setdefault(a, a)
        while root[a] != a:
            a = root[a]
        return a

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: find(n) for n in linked}


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
