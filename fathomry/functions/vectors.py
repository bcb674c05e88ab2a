"""Vector arithmetic as Column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 where either vector is all zero, null where lengths differ or a vector is null."""
    size = norm(a) * norm(b)
    return F.when(F.size(a) == F.size(b), F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0)))


def similarity(distance: Column) -> Column:
    """Distance to similarity, clamped to [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - distance))


def mock_embedding(text: Column, dimension: int) -> Column:
    """Deterministic stand-in for a model: byte i mod 32 of the text's hash, divided by 255."""
    digest = F.sha2(text, 256)
    return F.transform(
        F.sequence(F.lit(0), F.lit(dimension - 1)),
        lambda i: F.conv(F.substring(digest, 2 * (i % 32) + 1, F.lit(2)), 16, 10).cast("double") / 255.0,
    )


def usable(vector: Column, dimension: int) -> Column:
    """True for vectors of the full length, all finite, and not all zero."""
    return F.coalesce(
        (F.size(vector) == dimension)
        & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists(vector, lambda x: x != 0),
        F.lit(False),
    )
