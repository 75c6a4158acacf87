"""Geometry, colour and easing expressions on arrays of doubles; all of them stay inside code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: D65 white, and the matrix from linear sRGB to XYZ.
WHITE = (0.95047, 1.0, 1.08883)
TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
#: Fixed value: handle length of a rounded corner.
ROUND = 0.5519


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def sub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(a: Column, k: Column) -> Column:
    return F.transform(a, lambda x: x * k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def lerp(a: Column, b: Column, t: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * (1 - t) + y * t)


def cross(a: Column, b: Column) -> Column:
    return F.array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def polar(angle: Column, length: Column) -> Column:
    return F.array(F.cos(angle) * length, F.sin(angle) * length)


def bezier_point(p: list[Column], t: Column) -> Column:
    """Point at t of a cubic with four control points, by repeated interpolation."""
    while len(p) > 1:
        p = [lerp(a, b, t) for a, b in zip(p, p[1:], strict=False)]
    return p[0]


def bezier_split(p: list[Column], t: Column) -> tuple[list[Column], list[Column]]:
    """Control points of the two parts that a cubic falls into at t."""
    left, right = [p[0]], [p[-1]]
    while len(p) > 1:
        p = [lerp(a, b, t) for a, b in zip(p, p[1:], strict=False)]
        left.append(p[0])
        right.insert(0, p[-1])
    return left, right


def bezier_length(p: list[Column], steps: int = 8) -> Column:
    """Length of the polyline through steps + 1 points of a cubic."""
    points = [bezier_point(p, F.lit(k / steps)) for k in range(steps + 1)]
    return reduce(lambda s, x: s + x, [norm(sub(b, a)) for a, b in zip(points, points[1:], strict=False)])


def bezier_angle(p: list[Column], t: Column) -> Column:
    """Direction of the tangent at t, in degrees."""
    d = [sub(b, a) for a, b in zip(p, p[1:], strict=False)]
    v = bezier_point(d, t)
    return F.degrees(F.atan2(v[1], v[0]))


#: An affine map of the plane is [a, b, c, d, e, f]: x' = a x + c y + e, y' = b x + d y + f.
IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def translate(x: Column, y: Column) -> Column:
    return F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), x, y)


def scaling(x: Column, y: Column) -> Column:
    return F.array(x, F.lit(0.0), F.lit(0.0), y, F.lit(0.0), F.lit(0.0))


def rotation(degrees: Column) -> Column:
    r = F.radians(degrees)
    return F.array(F.cos(r), F.sin(r), -F.sin(r), F.cos(r), F.lit(0.0), F.lit(0.0))


def skew(x: Column, y: Column) -> Column:
    return F.array(F.lit(1.0), F.tan(F.radians(y)), F.tan(F.radians(x)), F.lit(1.0), F.lit(0.0), F.lit(0.0))


def compose(m: Column, n: Column) -> Column:
    """First n, then m."""
    return F.array(
        m[0] * n[0] + m[2] * n[1], m[1] * n[0] + m[3] * n[1], m[0] * n[2] + m[2] * n[3], m[1] * n[2] + m[3] * n[3],
        m[0] * n[4] + m[2] * n[5] + m[4], m[1] * n[4] + m[3] * n[5] + m[5],
    )


def compose_all(maps: Column) -> Column:
    """Product of an array of maps, the outermost first."""
    return F.aggregate(maps, F.array(*map(F.lit, IDENTITY)), compose)


def apply(m: Column, x: Column, y: Column) -> Column:
    return F.array(m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5])


def layer_transform(anchor: Column, size: Column, angle: Column, position: Column) -> Column:
    """A layer's map: to its anchor, scaled in percent, turned, moved to its position."""
    steps = F.array(translate(position[0], position[1]), rotation(angle), scaling(size[0] / 100, size[1] / 100), translate(-anchor[0], -anchor[1]))
    return compose_all(steps)


def linear(c: Column) -> Column:
    return F.when(c > 0.04045, F.pow((c + 0.055) / 1.055, F.lit(2.4))).otherwise(c / 12.92)


def gamma(c: Column) -> Column:
    return F.when(c > 0.0031308, F.pow(c, F.lit(1 / 2.4)) * 1.055 - 0.055).otherwise(c * 12.92)


def rgb_to_xyz(rgb: Column) -> Column:
    c = [linear(rgb[k]) for k in range(3)]
    return F.array(*[row[0] * c[0] + row[1] * c[1] + row[2] * c[2] for row in TO_XYZ])


def xyz_to_lab(xyz: Column) -> Column:
    def f(c: Column, white: float) -> Column:
        r = c / white
        return F.when(r > 0.008856, F.cbrt(r)).otherwise(r * 7.787 + 16 / 116)

    x, y, z = (f(xyz[k], WHITE[k]) for k in range(3))
    return F.array(y * 116 - 16, (x - y) * 500, (y - z) * 200)


def rgb_to_hsv(rgb: Column) -> Column:
    """Hue, saturation, value, all 0 to 1."""
    high, low = F.array_max(rgb), F.array_min(rgb)
    d = high - low
    r, g, b = (rgb[k] for k in range(3))
    hue = F.when(d == 0, 0.0).when(high == r, F.pmod((g - b) / d, F.lit(6.0))).when(high == g, (b - r) / d + 2).otherwise((r - g) / d + 4) / 6
    return F.array(hue, F.when(high == 0, 0.0).otherwise(d / high), high)


def rgb_to_hsl(rgb: Column) -> Column:
    high, low = F.array_max(rgb), F.array_min(rgb)
    light = (high + low) / 2
    d = high - low
    return F.array(rgb_to_hsv(rgb)[0], F.when(d == 0, 0.0).otherwise(d / (1 - F.abs(light * 2 - 1))), light)


def color_255(color: Column) -> Column:
    """Four whole numbers 0 to 255: clamped, rounded half to even, missing channels 0 and a missing alpha 1."""
    whole = lambda k, missing: F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.get(color, F.lit(k)), F.lit(missing)))) * 255, 0).cast("int")
    return F.array(*[whole(k, 0.0) for k in range(3)], whole(3, 1.0))


def ease(x1: Column, y1: Column, x2: Column, y2: Column, ratio: Column, halvings: int = 24) -> Column:
    """Easing factor of a cubic from (0, 0) to (1, 1) with two handles: the curve's y where its x is the ratio.

    Handles on the diagonal ease nothing. Otherwise the parameter is found by bisection, in one expression.
    """
    at = lambda a, b, t: ((1 - t) * (1 - t) * t * 3 * a) + ((1 - t) * t * t * 3 * b) + t * t * t
    state = F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["low"] + s["high"]) / 2
        left = at(x1, x2, mid) < ratio
        return F.struct(F.when(left, mid).otherwise(s["low"]).alias("low"), F.when(left, s["high"]).otherwise(mid).alias("high"))

    solved = F.aggregate(F.sequence(F.lit(1), F.lit(halvings)), state, halve, lambda s: (s["low"] + s["high"]) / 2)
    return F.when((ratio <= 0) | (ratio >= 1) | ((x1 == y1) & (x2 == y2)), ratio).otherwise(at(y1, y2, solved))


def gradient_stops(k: Column, colors: Column) -> Column:
    """Stops (offset, [r, g, b, a]) of a packed gradient: four numbers a stop, and after them two for each stop of alpha if there are any."""
    has_alpha = F.size(k) >= colors * 6
    one = lambda i: F.struct(F.get(k, 4 * i).alias("offset"), F.array(F.get(k, 4 * i + 1), F.get(k, 4 * i + 2), F.get(k, 4 * i + 3), F.when(has_alpha, F.get(k, colors * 4 + 2 * i + 1)).otherwise(F.lit(1.0))).alias("color"))
    return F.transform(F.sequence(F.lit(0), colors - 1), one)
