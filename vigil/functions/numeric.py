"""Rounding on the binary value.

``F.round`` rounds the shortest decimal representation half-up, so a double
such as 0.35105 (binary 0.351049999…) becomes 0.3511, while SQL engines and
Python round the binary value (0.351).  ``rnd`` scales in floating point and
rounds half away from zero, which reproduces SQL ``round(x, n)``; values too
large to carry the requested digits are returned unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(c, digits: int = 0) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    p = float(10 ** digits)
    scaled = F.abs(x) * F.lit(p)
    r = F.signum(x) * F.floor(scaled + F.lit(0.5)).cast("double") / F.lit(p)
    return F.when(scaled < F.lit(4.0e15), r).otherwise(x)
