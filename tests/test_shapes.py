"""Shapes, presets, transforms, chains, reworked drawings."""

import io
import json
import math
import zipfile

import numpy as np
from pyspark.sql import functions as F

from keyloom.functions import geometry as g
from keyloom.functions import shapes
from keyloom.operators import keyframes, restructure


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_curves(spark):
    corners = one(spark, shapes.star(F.lit(0.0), F.lit(0.0), F.lit(4), F.lit(2.0), F.lit(None).cast("double"), F.lit(0.0)))
    assert np.allclose(corners, [[0, -2], [2, 0], [0, 2], [-2, 0]], atol=1e-9)
    assert len(one(spark, shapes.star(F.lit(0.0), F.lit(0.0), F.lit(5), F.lit(2.0), F.lit(1.0), F.lit(0.0)))) == 10
    top, right, *_ = one(spark, shapes.ellipse(F.lit(1.0), F.lit(2.0), F.lit(4.0), F.lit(6.0)))
    assert top.v == [1, -1] and right.v == [3, 2] and math.isclose(top.o[0], 2 * g.ROUND)
    assert len(one(spark, shapes.rectangle(F.lit(0.0), F.lit(0.0), F.lit(4.0), F.lit(6.0), F.lit(99.0)))) == 8


def test_easing_presets(spark):
    assert one(spark, shapes.easing(F.lit("linear"))) == [0, 0, 1, 1] and one(spark, shapes.easing(F.lit("jump"))) == [None] * 4
    assert one(spark, shapes.easing(F.lit("other"))) is None


def test_svg_transform(spark):
    at = one(spark, g.apply(shapes.svg_transform(F.lit("rotate(90 10 10) translate(1)")), F.lit(10.0), F.lit(10.0)))
    assert np.allclose(at, [10, 11])
    assert one(spark, shapes.svg_transform(F.lit(""))) == [1, 0, 0, 1, 0, 0]


def test_chains_keep_their_lengths(spark):
    bones = [[0.0, 0.0], [10.0, 0.0], [20.0, 0.0]]
    rows = spark.createDataFrame([(bones, [5.0, 12.0]), (bones, [0.0, 100.0])], "b array<array<double>>, t array<double>").select(shapes.reach_udf("b", "t").alias("p")).collect()
    near, far = (np.array(r.p) for r in rows)
    assert np.linalg.norm(near[-1] - [5, 12]) <= 0.5 and np.allclose(np.linalg.norm(np.diff(near, axis=0), axis=1), 10, atol=1e-6)
    assert np.allclose(far, [[0, 0], [0, 10], [0, 20]])


def test_positions_lines_and_bundles(spark):
    x = keyframes.merge(spark.createDataFrame([("p", 0, 0.0, 0), ("p", 10, 10.0, 1)], "k string, t long, v double, s int"), "k", "t", "v", "s")
    y = keyframes.merge(spark.createDataFrame([("p", 5, 1.0, 0)], "k string, t long, v double, s int"), "k", "t", "v", "s")
    assert {r.t: r.value for r in restructure.join_position(x, y, "k", "t").collect()} == {0: [0.0, 1.0], 5: [5.0, 1.0], 10: [10.0, 1.0]}
    docs = spark.createDataFrame([(1, "a\nb\nc", "a\nx\nc\nd"), (2, None, "")], "id long, l string, r string")
    got = {r.key: [(c.kind, c.left, c.right) for c in r.changes] for r in restructure.line_changes(docs, "id", "l", "r").collect()}
    assert got == {1: [("replace", ["b"], ["x"]), ("insert", [], ["d"])], 2: []}
    made = restructure.bundles(spark.createDataFrame([(1, "a b", "{}"), (1, "c", "[1]")], "g int, n string, t string"), "g", "n", "t").first()
    with zipfile.ZipFile(io.BytesIO(made.content)) as z:
        assert [a["id"] for a in json.loads(z.read("manifest.json"))["animations"]] == ["a_b", "c"] and z.read("animations/c.json") == b"[1]"
