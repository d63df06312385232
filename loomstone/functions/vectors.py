"""Vector distances in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(a: Column, b: Column, term) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), term), F.lit(0.0), lambda s, x: s + x)


def _norm2(a: Column) -> Column:
    return F.aggregate(a.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x)


def dot(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: x * y)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 for different lengths or a zero vector, null if a side is null."""
    norms = F.sqrt(_norm2(a)) * F.sqrt(_norm2(b))
    return F.when(a.isNull() | b.isNull(), None).when((F.size(a) != F.size(b)) | (norms == 0), 1.0).otherwise(1.0 - F.try_divide(dot(a, b), norms))


def l2_distance(a: Column, b: Column) -> Column:
    """Null for a null side; the largest float for different lengths."""
    return F.when(a.isNull() | b.isNull(), None).when(F.size(a) != F.size(b), 3.4028234663852886e38).otherwise(F.sqrt(_fold(a, b, lambda x, y: (x - y) * (x - y))))


def dot_distance(a: Column, b: Column) -> Column:
    """The negative inner product; 1 for different lengths."""
    return F.when(a.isNull() | b.isNull(), None).when(F.size(a) != F.size(b), 1.0).otherwise(-dot(a, b))


METRICS = {"cosine": cosine_distance, "": cosine_distance, "l2": l2_distance, "euclidean": l2_distance, "dot": dot_distance, "dotproduct": dot_distance}


def metric(name: str | None):
    """The distance of a metric; unknown names mean cosine."""
    return METRICS.get((name or "").lower(), cosine_distance)


def parse_vector(text: Column) -> Column:
    """A literal such as '[0.1, 0.2]'; null if it is none."""
    return F.from_json(text, "array<float>")


def vector_literal(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])
