"""Windows over arrays: chunks, segments, interpolation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chunks(ws: Column, size: int = 300, overlap: int = 50) -> Column:
    """Chunks of ``size`` words, each starting ``size - overlap`` after the last; the last one may be short. Empty input: one empty chunk."""
    step = size - overlap
    n = F.size(ws)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)), lambda i: (i == 0) | (i + overlap < n))
    return F.transform(starts, lambda i: F.slice(ws, i + 1, F.lit(size)))


def windows(ws: Column, size: int = 150, tail: int = 75) -> Column:
    """Disjoint windows; a last one shorter than ``tail`` joins the one before."""
    n = F.size(ws)
    count = F.greatest(F.lit(1), F.floor(n / size) + F.when(n % size >= tail, 1).otherwise(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(ws, i * size + 1, F.when(i == count - 1, n).otherwise(size)))


def segments(ws: Column, parts: int = 12) -> Column:
    """``parts`` segments of max(1, n // parts) words, the last with the rest."""
    n = F.size(ws)
    size = F.greatest(F.lit(1), F.floor(n / parts)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.slice(ws, i * size + 1, F.when(i == parts - 1, F.greatest(n - size * (parts - 1), F.lit(0))).otherwise(size)))


def interpolate(v: Column, points: int = 8) -> Column:
    """Values of a sequence at ``points`` even places, linearly between neighbours."""
    n = F.size(v)

    def at(k):
        x = k * (n - 1) / F.lit(points - 1)
        lo = F.floor(x).cast("int")
        hi = F.least(lo + 1, n - 1)
        return F.get(v, lo) + (F.get(v, hi) - F.get(v, lo)) * (x - lo)

    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), at)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2(a: Column, floor: float = 1e-12) -> Column:
    return F.transform(a, lambda x: x.cast("double") / F.greatest(norm(a), F.lit(floor)))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def quantise(a: Column, scale: Column) -> Column:
    """Bytes of a vector under one scale, halves to even, clipped."""
    return F.transform(a, lambda x: F.least(F.lit(127), F.greatest(F.lit(-127), F.bround(x.cast("double") / scale * 127).cast("int"))))


def dequantise(a: Column, scale: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") * scale / 127)
