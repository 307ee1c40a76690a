"""Scalar expressions of weights, ranks and losses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MS_A_DAY = 86_400_000


def strength(weight: Column) -> Column:
    """How much a history item speaks: 1 + ln(1 + weight)."""
    return F.lit(1.0) + F.log1p(weight)


def recency(at: Column, then: Column, days: float = 30.0) -> Column:
    """Exponential decay over the age in days; the future counts as now."""
    return F.exp(-(F.greatest(at - then, F.lit(0)) / F.lit(float(MS_A_DAY))) / F.lit(days))


def discount(rank: Column) -> Column:
    """Discount of a hit at a rank from 1."""
    return F.lit(1.0) / F.log2(rank + F.lit(1.0))


def ideal_gain(relevant: Column, k: int) -> Column:
    """Discounted gain of min(relevant, k) hits on top, from a literal table of k sums."""
    import math

    sums, total = [], 0.0
    for rank in range(1, k + 1):
        total += 1 / math.log2(rank + 1)
        sums.append(total)
    return F.element_at(F.array(*(F.lit(x) for x in sums)), F.least(relevant, F.lit(k)).cast("int"))


def softplus(x: Column) -> Column:
    """ln(1 + e^x) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def relative_pct(new: Column, old: Column) -> Column:
    """Percent by which new exceeds old; null where old is 0."""
    return F.when(old != 0, (new / F.when(old != 0, old) - 1) * 100)


def knuth_bucket(value: Column, buckets: int = 10_000) -> Column:
    """value * 2654435761 modulo buckets, by residues so that no product overflows."""
    return F.pmod(F.pmod(value, F.lit(buckets)) * F.lit(2654435761 % buckets), F.lit(buckets))


def millis_date(ms: Column) -> Column:
    return F.to_date(F.timestamp_millis(ms))


def version_id(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyyMMdd'T'HHmmss'Z'")


def linear(features: Sequence[Column], weights: Sequence[float]) -> Column:
    out = F.lit(0.0)
    for feature, weight in zip(features, weights, strict=True):
        if weight:
            out = out + feature * F.lit(float(weight))
    return out
