"""Distances and vector arithmetic as column expressions, in double precision and left to right."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _fold(a: Column, b: Column, step: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), step), F.lit(0.0), lambda s, x: s + x)


def l2sq(a: Column, b: Column) -> Column:
    """Squared Euclidean distance (no root)."""
    return _fold(a, b, lambda x, y: (x - y) * (x - y))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(l2sq(a, b))


def dot(a: Column, b: Column) -> Column:
    """Dot product; 0 for vectors of different length."""
    return F.when(F.size(a) == F.size(b), _fold(a, b, lambda x, y: x * y)).otherwise(0.0)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(doubles(v), lambda x: x * x), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for a zero vector or different lengths."""
    both = norm(a) * norm(b)
    return F.when(both > 0, dot(a, b) / both).otherwise(0.0)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 for a zero vector."""
    return 1.0 - cosine(a, b)


def normalize(v: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    n = norm(v)
    return F.transform(doubles(v), lambda x: F.when(n > 0, x / n).otherwise(x))


def is_normalized(v: Column, tolerance: float = 1e-6) -> Column:
    return F.abs(F.aggregate(F.transform(doubles(v), lambda x: x * x), F.lit(0.0), lambda s, x: s + x) - 1.0) < tolerance


def early_stop(a: Column, b: Column, threshold: float, dimension: int, block: int = 16) -> Column:
    """Euclidean distance summed in blocks; once the partial sum exceeds the squared threshold, its root is returned."""
    squares = F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))
    total, done = F.lit(0.0), F.lit(False)
    for start in range(0, dimension, block):
        part = F.aggregate(F.slice(squares, start + 1, block), total, lambda s, x: s + x)
        total = F.when(done, total).otherwise(part)
        done = total > threshold * threshold
    return F.sqrt(total)
