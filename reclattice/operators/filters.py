"""Row filters on interaction tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reclattice.functions.columns import binarized


def positive_ratings(df: DataFrame, min_value: float, rating: str = "rating") -> DataFrame:
    """Keep ratings strictly above ``min_value``; null ratings drop out."""
    return df.filter(F.col(rating) > F.lit(float(min_value)))


def active_users(df: DataFrame, min_interactions: int = 2, user: str = "user") -> DataFrame:
    """Keep users with at least ``min_interactions`` rows.

    The counts are combined map-side, so a user holding a large share of the rows costs
    one partial count per task. The semi join has no per-user buffer and AQE may split a
    skewed left partition, which a ``count(*) over (partition by user)`` could not do.
    """
    counts = df.groupBy(user).agg(F.count(F.lit(1)).alias("_n"))
    keep = counts.filter(F.col("_n") >= min_interactions).select(user)
    return df.join(keep, user, "left_semi")


def binarize_rating(df: DataFrame, values: str = "rating", min_value: float = 3.5) -> DataFrame:
    """Replace ``values`` by 1 (strictly above ``min_value``) or 0."""
    return df.withColumn(values, binarized(F.col(values), min_value))


def without_seen(
    scores: DataFrame, seen: DataFrame, user: str = "user", item: str = "item", own: str | None = None
) -> DataFrame:
    """Drop scored pairs that occur in ``seen`` (the removing mask). Where the column ``own`` of the scores is the value of
    the pair in ``seen``, null without one, no pair travels to be looked up; the column is dropped."""
    if own is not None:
        return scores.filter(F.col(own).isNull()).drop(own)
    return scores.join(seen.select(user, item), [user, item], "left_anti")


def zero_seen(
    scores: DataFrame, seen: DataFrame, user: str = "user", item: str = "item", value: str = "rating",
    score: str = "scores", own: str | None = None,
) -> DataFrame:
    """Set the score of pairs seen with a non-zero value to 0; they stay candidates. ``own`` is as in ``without_seen``."""
    if own is not None:
        zero = F.when(F.col(own) != 0, F.lit(0.0)).otherwise(F.col(score))
        return scores.withColumn(score, zero).drop(own)
    marks = (
        seen.filter(F.col(value) != 0)
        .groupBy(user, item)
        .agg(F.lit(True).alias("_seen"))
    )
    return (
        scores.join(marks, [user, item], "left")
        .withColumn(score, F.when(F.col("_seen"), F.lit(0.0)).otherwise(F.col(score)))
        .drop("_seen")
    )
