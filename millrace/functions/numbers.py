"""Number functions of features and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def is_finite(x: Column) -> Column:
    """False for null, NaN and infinities."""
    v = x.cast("double")
    return F.coalesce(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), F.lit(False))


def sigmoid(z: Column) -> Column:
    """1 / (1 + exp(-z)) without overflow; null and NaN give null."""
    bound = F.greatest(F.least(z, F.lit(700.0)), F.lit(-700.0))
    return F.when(z.isNotNull() & ~F.isnan(z), 1 / (1 + F.exp(-bound)))


def softmax_first(a: Column, b: Column) -> Column:
    """exp(a) / (exp(a) + exp(b)) without overflow."""
    top = F.greatest(a, b)
    return F.exp(a - top) / (F.exp(a - top) + F.exp(b - top))


def entropy_bits(counts: Column) -> Column:
    """Shannon entropy of an array of counts; zeros don't count, nothing gives 0."""
    some = F.filter(counts, lambda x: x > 0)
    total = F.aggregate(some, F.lit(0.0), lambda a, x: a + x)
    bits = F.aggregate(some, F.lit(0.0), lambda a, x: a - (x / total) * F.log2(x / total))
    return F.when(F.size(some) > 0, bits).otherwise(0.0)


def evaluation_points(n: int, per_epoch: int) -> list[int]:
    """Steps, evenly spaced in an epoch of n, at which to evaluate."""
    return [-(-k * n // per_epoch) for k in range(1, per_epoch + 1)]
