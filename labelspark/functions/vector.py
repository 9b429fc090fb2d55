"""Vector math on ARRAY<DOUBLE> columns (F-9 .. F-12).

Spark 4.1 has no vector_* functions, so these are higher-order array
expressions.  Plans should normalise each vector once (per row of its own
table) and leave only one dot product per scored pair.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double_array(c) -> Column:
    return _c(c).cast("array<double>")


def dot(a, b) -> Column:
    prod = F.zip_with(_c(a), _c(b), lambda x, y: x * y)
    return F.aggregate(prod, F.lit(0.0), lambda acc, x: acc + x)


def sq_norm(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x * x)


def l2_norm(a) -> Column:
    return F.sqrt(sq_norm(a))


def l2_normalize(a) -> Column:
    """F-12: x / max(||x||, eps); a zero vector stays zero."""
    n = F.greatest(l2_norm(a), F.lit(EPS))
    return F.transform(_c(a), lambda x: x / n)


def logit_scale(scale: float = 2.0) -> float:
    """exp(clamp(scale, -10, 10)); the reference initialises scale to 2.0."""
    return math.exp(min(max(scale, -10.0), 10.0))
