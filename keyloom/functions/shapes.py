"""Shapes as curves, easing presets, SVG transform lists, chains of bones."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import geometry as g

#: Handles (x1, y1, x2, y2) of the easing presets; a jump has none and holds its value.
EASINGS = {"linear": (0.0, 0.0, 1.0, 1.0), "ease_in": (1 / 3, 0.0, 1.0, 1.0), "ease_out": (0.0, 0.0, 2 / 3, 1.0), "sigmoid": (1 / 3, 0.0, 2 / 3, 1.0), "jump": (None,) * 4}


def easing(name: Column) -> Column:
    """Handles of a preset as an array; nulls for a jump, null for an unknown name."""
    known = F.create_map(*[x for k, v in EASINGS.items() for x in (F.lit(k), F.array(*[F.lit(c).cast("double") for c in v]))])
    return known[name]


def _vertex(x: Column, y: Column, ix: Column, iy: Column, ox: Column, oy: Column) -> Column:
    return F.struct(F.array(x, y).alias("v"), F.array(ix, iy).alias("i"), F.array(ox, oy).alias("o"))


def rectangle(cx: Column, cy: Column, w: Column, h: Column, rounding: Column) -> Column:
    """Vertices (v, i, o) of a rectangle's closed curve, clockwise from the top right; rounded corners have two each."""
    z = F.lit(0.0)
    r = F.greatest(z, F.least(rounding, w / 2, h / 2))
    k = r * g.ROUND
    left, right, top, bottom = cx - w / 2, cx + w / 2, cy - h / 2, cy + h / 2
    sharp = F.array(*[_vertex(x, y, z, z, z, z) for x, y in ((right, top), (right, bottom), (left, bottom), (left, top))])
    soft = F.array(
        _vertex(right, top + r, z, -k, z, z), _vertex(right, bottom - r, z, z, z, k), _vertex(right - r, bottom, k, z, z, z), _vertex(left + r, bottom, z, z, -k, z),
        _vertex(left, bottom - r, z, k, z, z), _vertex(left, top + r, z, z, z, -k), _vertex(left + r, top, -k, z, z, z), _vertex(right - r, top, z, z, k, z),
    )
    return F.when(r > 0, soft).otherwise(sharp)


def ellipse(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    """Four vertices of an ellipse's closed curve."""
    z, rx, ry = F.lit(0.0), w / 2, h / 2
    kx, ky = rx * g.ROUND, ry * g.ROUND
    return F.array(_vertex(cx, cy - ry, -kx, z, kx, z), _vertex(cx + rx, cy, z, -ky, z, ky), _vertex(cx, cy + ry, kx, z, -kx, z), _vertex(cx - rx, cy, z, ky, z, -ky))


def star(cx: Column, cy: Column, points: Column, outer: Column, inner: Column, turn: Column) -> Column:
    """Corners of a star with as many points, or of a polygon where inner is null; turn in degrees, the first point up."""
    n = F.when(inner.isNull(), points).otherwise(points * 2)
    angle = lambda i: F.radians(turn - 90 + i * 360.0 / n)
    reach = lambda i: F.when((i % 2 == 1) & inner.isNotNull(), inner).otherwise(outer)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array(cx + reach(i) * F.cos(angle(i)), cy + reach(i) * F.sin(angle(i))))


def svg_transform(text: Column) -> Column:
    """The affine map of an SVG transform list: matrix, translate, scale, rotate (about a point too), skewX and skewY."""
    steps = F.regexp_extract_all(text, F.lit(r"((?:matrix|translate|scale|rotate|skewX|skewY)\s*\([^)]*\))"), 1)

    def one(step: Column) -> Column:
        name = F.regexp_extract(step, r"^(\w+)", 1)
        args = F.transform(F.regexp_extract_all(step, F.lit(r"([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)"), 1), lambda x: x.cast("double"))
        a = lambda k, missing=0.0: F.coalesce(F.get(args, F.lit(k)), F.lit(missing))
        r = F.radians(a(0))
        c, s, x, y = F.cos(r), F.sin(r), a(1), a(2)
        return (
            F.when(name == "matrix", F.array(*[a(k) for k in range(6)]))
            .when(name == "translate", g.translate(a(0), a(1)))
            .when(name == "scale", g.scaling(a(0, 1.0), F.coalesce(F.get(args, F.lit(1)), a(0, 1.0))))
            .when(name == "rotate", F.array(c, s, -s, c, x - c * x + s * y, y - s * x - c * y))
            .when(name == "skewX", g.skew(a(0), F.lit(0.0)))
            .otherwise(g.skew(F.lit(0.0), a(0)))
        )

    return g.compose_all(F.transform(steps, one))


def reach(bones: np.ndarray, target: np.ndarray, tolerance: float = 0.5, rounds: int = 8) -> np.ndarray:
    """Joints (n, 2) of a chain moved so that its end reaches a target, lengths kept: forward and backward passes."""
    p, length = bones.astype(float).copy(), np.linalg.norm(np.diff(bones, axis=0), axis=1)
    root = p[0].copy()
    far = np.linalg.norm(target - root)
    if far > length.sum():  # out of reach: stretched towards it
        return root + np.concatenate([[0], np.cumsum(length)])[:, None] * (target - root) / far
    for _ in range(rounds):
        if np.linalg.norm(p[-1] - target) <= tolerance:
            break
        for order, end in ((range(len(p) - 2, -1, -1), target), (range(1, len(p)), root)):
            at = -1 if end is target else 0
            p[at] = end
            for i in order:
                j, size = (i + 1, length[i]) if end is target else (i - 1, length[i - 1])
                d = p[i] - p[j]
                p[i] = p[j] + d * size / max(np.linalg.norm(d), 1e-12)
    return p


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def reach_udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The same for a column of joints and one of targets."""
    for bones, targets in batches:
        yield pd.Series([reach(np.stack([np.asarray(x, float) for x in b]), np.asarray(t, float)).tolist() for b, t in zip(bones, targets, strict=True)])


def svg_number(x: float) -> str:
    return f"{x:.3f}".rstrip("0").rstrip(".") if math.isfinite(x) else "0"


cloudpickle.register_pickle_by_value(sys.modules[__name__])
