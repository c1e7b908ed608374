"""Column expressions over vectors (array<double>)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str, epsilon: float = 1e-8, sizes: tuple[str, str] | None = None) -> Column:
    """Null without a vector; with epsilon 0, null for a zero vector. ``sizes`` names columns that hold the norms already."""
    size = (F.col(sizes[0]) * F.col(sizes[1]) if sizes else norm(a) * norm(b)) + F.lit(epsilon)
    return dot(a, b) / (size if epsilon else F.nullif(size, F.lit(0.0)))
