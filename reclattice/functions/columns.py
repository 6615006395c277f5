"""Scalar expressions behind the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def binarized(rating: Column, min_value: float) -> Column:
    """1 when the rating is strictly above ``min_value``, else 0 (null counts as 0)."""
    return F.when(rating > F.lit(float(min_value)), F.lit(1.0)).otherwise(F.lit(0.0))


def prefix_size(n: Column, test_size: float) -> Column:
    """Rows of a history of length ``n`` that go to train: ``trunc((1 - test_size) * n)``
    in double arithmetic, so 0.7 * 90 gives 62."""
    return (F.lit(1.0 - test_size) * n).cast("long")


def log_discount(rank: Column) -> Column:
    return F.lit(1.0) / F.log2(rank + F.lit(1.0))


def cumulative_discount(n: Column, longest: int) -> Column:
    """``sum_{i<=n} 1/log2(i+1)`` for ``0 <= n <= longest``, looked up in a literal array."""
    totals, running = [0.0], 0.0
    for i in range(1, longest + 1):
        running += 1.0 / math.log2(i + 1)
        totals.append(running)
    return F.get(F.expr("array(" + ", ".join(f"{t!r}D" for t in totals) + ")"), n.cast("int"))


def plain_zero(value: Column) -> Column:
    """Turn -0.0 into 0.0 without touching other values."""
    return value + F.lit(0.0)


def rounded(value: Column, digits: int = 9) -> Column:
    return plain_zero(F.round(value, digits))
