"""Array expressions for embeddings and padded id lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pad(ids: Column, size: int) -> Column:
    """The first `size` ids, then zeros."""
    head = F.slice(ids, 1, size)
    return F.concat(head, F.array_repeat(F.lit(0).cast("long"), F.lit(size) - F.size(head)))


def hadamard(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))


def absolute_difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))


def mean_pool(vectors: Column, width: int) -> Column:
    """Mean of an array of vectors; zeros without any."""
    zero = F.array_repeat(F.lit(0.0), width)
    total = F.aggregate(vectors, zero, lambda a, x: F.zip_with(a, x, lambda p, q: p + q.cast("double")))
    return F.transform(total, lambda x: x / F.greatest(F.size(vectors), F.lit(1)))


def interaction_input(candidate: Column, pooled: Column, features: Column) -> Column:
    """Candidate, pooled history, product, absolute difference and features, one after the other."""
    return F.concat(F.transform(candidate, lambda x: x.cast("double")), pooled, hadamard(candidate, pooled), absolute_difference(candidate, pooled), features)
