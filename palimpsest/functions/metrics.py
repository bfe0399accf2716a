"""Vector distances as column expressions, in double precision.

Vectors of unequal length are compared over the shorter one; a null vector gives null. The three
metrics are squared L2, cosine distance (1 for a zero vector) and the negated dot product, so that
smaller is nearer for each.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1.1920928955078125e-07  #: fixed value: the norm product's lower bound, single precision epsilon


def _sum_of(a: Column, b: Column, term) -> Column:
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, 1, n), F.slice(b, 1, n)
    zipped = F.zip_with(a, b, lambda x, y: term(x.cast("double"), y.cast("double")))
    return F.when(a.isNotNull() & b.isNotNull(), F.aggregate(zipped, F.lit(0.0), lambda acc, x: acc + x))


def dot(a: Column, b: Column) -> Column:
    return _sum_of(a, b, lambda x, y: x * y)


def l2_squared(a: Column, b: Column) -> Column:
    return _sum_of(a, b, lambda x, y: (x - y) * (x - y))


def cosine_distance(a: Column, b: Column) -> Column:
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return 1.0 - dot(a, b) / F.greatest(norms, F.lit(EPSILON))


def negated_dot(a: Column, b: Column) -> Column:
    return -dot(a, b)


METRICS = {"l2": l2_squared, "cosine": cosine_distance, "dot": negated_dot}


def metric_name(name: str) -> str:
    """The canonical name of a metric; an unknown one is an error."""
    key = name.lower() if name in ("l2", "L2", "cosine", "Cosine", "dot", "Dot") else None
    if key is None:
        raise ValueError(f"unknown metric {name!r}")
    return key


def distance(metric: str, a: Column, b: Column) -> Column:
    return METRICS[metric_name(metric)](a, b)
