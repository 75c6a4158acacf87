"""The grid join against all pairs."""

import math

import numpy as np

from keyloom.llm import grid_join

SCHEMA = "vec_id long, embedding array<float>, label int, node string"


def plain(rows, t=0.9):
    good = {k: np.array(v, float) for k, (_, v) in enumerate(rows) if v and all(c is not None and math.isfinite(c) for c in v) and any(v)}
    dims = max((len(v) for v in good.values()), default=0)
    links, root = {k: 0 for k in range(len(rows))}, list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    x = np.array([np.pad((w := v / np.abs(v).max()) / np.linalg.norm(w), (0, dims - len(v))) for v in good.values()]).reshape(len(good), dims)
    names = list(good)
    for a, b in np.argwhere(np.triu(x @ x.T >= t - 1e-12, 1)):
        a, b = names[a], names[b]
        links[a] += 1
        links[b] += 1
        root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        low[find(k)] = min(low.get(find(k), i), i)
    return sorted((i, links[k], low[find(k)], i == low[find(k)]) for k, (i, _) in enumerate(rows))


def got(df):
    return sorted(tuple(r) for r in grid_join.similar(df).collect())


def test_whole_table(spark, monkeypatch):
    monkeypatch.setattr(grid_join, "BLOCK", 100)
    monkeypatch.setattr(grid_join, "LEAF", 16)
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert got(df) == plain([(r.vec_id, r.embedding) for r in df.collect()])


def test_odd_vectors(spark):
    v = [0.1, 0.9, -0.3]
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0])]
    rows += [(9, v), (8, v), (8, v), (11, [3 * c for c in v]), (10, [-c for c in v]), (12, [1.0]), (13, [2.0, 0.0, 0.1]), (14, [1e-300, 0.0]), (15, [1e300, 1e299])]
    assert got(spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA.replace("float", "double"))) == plain(rows)


def test_empty_and_all_bad(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    assert got(spark.createDataFrame([(1, None, 0, "")], SCHEMA)) == [(1, 0, 1, True)]


def test_chains_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(grid_join, "BLOCK", 7)
    rows = [(k, [math.cos(k / 4), math.sin(k / 4)]) for k in range(60)]
    assert got(spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA.replace("float", "double"))) == plain(rows)
