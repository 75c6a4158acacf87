"""Numbers rounded as SQL engines over doubles round them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_double(x: Column | str, digits: int) -> Column:
    """A double times the power of ten, rounded half away from zero, divided again; what overflows on the way stays.

    Spark's own round works on the shortest decimal text instead: it moves other values that lie beside a tie, and loses the sign of a zero.
    """
    x = F.col(x) if isinstance(x, str) else x
    y = x * F.lit(10.0**digits)
    even = F.rint(F.abs(y))
    out = F.signum(y) * F.when(F.abs(y) - even == 0.5, even + 1).otherwise(even) / F.lit(10.0**digits)
    return F.when(F.abs(out) < float("inf"), out).otherwise(x)
