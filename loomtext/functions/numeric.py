"""Scalar mathematics and geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
# Abramowitz and Stegun 7.1.26.
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429, 0.3275911)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(a))


def logistic(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def strength(z: Column) -> Column:
    return F.when(z >= 1.0, "strong").when(z >= 0.6, "medium").otherwise("weak")


def softmax(v: Column) -> Column:
    e = F.transform(v, lambda x: F.exp(x - F.array_max(v)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def log_sum_exp(v: Column) -> Column:
    m = F.array_max(v)
    return m + F.log(F.aggregate(F.transform(v, lambda x: F.exp(x - m)), F.lit(0.0), lambda a, b: a + b))


def erf(x: Column) -> Column:
    a1, a2, a3, a4, a5, p = ERF
    t = 1 / (1 + p * F.abs(x))
    y = 1 - ((((a5 * t + a4) * t + a3) * t + a2) * t + a1) * t * F.exp(-x * x)
    return F.when(x < 0, -y).otherwise(y)


def ring_area(xs: Column, ys: Column) -> Column:
    """Shoelace area of a ring; the last point is joined to the first."""
    n = F.size(xs)
    terms = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(xs, i) * F.get(ys, (i + 1) % n) - F.get(xs, (i + 1) % n) * F.get(ys, i))
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)) / 2


def snap(x: Column, grid: float = 0.6) -> Column:
    return F.round(F.bround(x / grid) * grid, 6)


def project(lon: Column, lat: Column, width: float, height: float) -> Column:
    return F.struct(((lon + 180) / 360 * width).alias("x"), ((90 - lat) / 180 * height).alias("y"))


def cohen_d(m1: Column, v1: Column, m2: Column, v2: Column) -> Column:
    return (m1 - m2) / F.sqrt((v1 + v2) / 2)


def cohen_d_pooled(m1: Column, v1: Column, n1: Column, m2: Column, v2: Column, n2: Column) -> Column:
    return (m1 - m2) / F.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2))


def version_key(v: Column) -> Column:
    return F.transform(F.split(v, r"\."), lambda x: x.cast("int"))


def min_max(x: Column, lo: Column, hi: Column) -> Column:
    return (x - lo) / F.when(hi == lo, F.lit(1.0)).otherwise(hi - lo)
