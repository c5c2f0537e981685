"""Vector column builders over ``array<float|double>``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from prefspark.functions.numeric import clamp01


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_doubles(c: Column | str) -> Column:
    return _col(c).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(as_doubles(a), F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity, 0 when either norm is zero."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale).otherwise(0.0)


def cosine01(a: Column | str, b: Column | str, min_dims: int = 3) -> Column:
    """Cosine on the shared leading dimensions mapped to [0, 1]; null below ``min_dims`` or on a zero norm."""
    n = F.least(F.size(_col(a)), F.size(_col(b)))
    left, right = F.slice(_col(a), F.lit(1), n), F.slice(_col(b), F.lit(1), n)
    scale = norm(left) * norm(right)
    return F.when((n >= min_dims) & (scale > 0), clamp01((dot(left, right) / scale + 1.0) / 2.0))


def is_valid(c: Column | str, dim: int | None = None, min_dim: int = 1) -> Column:
    """Expected length and no null, NaN or infinite component."""
    v = as_doubles(c)
    length = (F.size(v) == dim) if dim is not None else (F.size(v) >= min_dim)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return _col(c).isNotNull() & length & ~bad


def from_columns(columns: Sequence[str]) -> Column:
    """Non-null components in column-name order."""
    return F.array_compact(F.array(*[F.col(n).cast("double") for n in sorted(columns)]))


def mean_of(columns: Sequence[str]) -> Column:
    """Mean of the non-null columns, null when all are missing."""
    values = from_columns(columns)
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(values) > 0, total / F.size(values))


def feature_similarity(pairs: Sequence[tuple[Column, Column, float]]) -> Column:
    """Weighted closeness 1 - min(1, |a-b|) over the measurements both sides have; null when none is shared."""
    score, total = F.lit(0.0), F.lit(0.0)
    for a, b, weight in pairs:
        shared = a.isNotNull() & b.isNotNull()
        score = score + F.when(shared, (1.0 - F.least(F.lit(1.0), F.abs(a - b))) * weight).otherwise(0.0)
        total = total + F.when(shared, weight).otherwise(0.0)
    return F.when(total > 0, score / total)


def blend_similarity(vector_score: Column, feature_score: Column) -> Column:
    """0.58 vector + 0.42 measurements; whichever exists alone, else 0."""
    both = vector_score * 0.58 + feature_score * 0.42
    return F.coalesce(both, vector_score, feature_score, F.lit(0.0))
