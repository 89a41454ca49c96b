"""Vector and box functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalise(a: Column) -> Column:
    """Unit vector; null where the norm is under 1e-8."""
    return F.when(l2_norm(a) >= 1e-8, F.transform(a, lambda x: x / l2_norm(a)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (l2_norm(a) * l2_norm(b) + 1e-9)


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of boxes x1, y1, x2, y2; 0 without an area in common."""
    wide = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    high = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda c: (c[2] - c[0]) * (c[3] - c[1])
    both = wide * high
    return F.coalesce(F.try_divide(both, area(a) + area(b) - both), F.lit(0.0))
