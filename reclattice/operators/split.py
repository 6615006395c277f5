"""Per-user chronological holdout."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from reclattice.functions.columns import prefix_size
from reclattice.operators.ranking import HOT_ROWS, HotKeys, hot_keys, join_null_safe, repeat_rows, weighted_positions
from reclattice.session import checkpointed


# A triple with more copies than this is fanned out over many tasks, whoever the user.
MANY_COPIES = 1000


class Split(NamedTuple):
    """Both sides, and the persisted rows they are derived from."""

    train: DataFrame
    test: DataFrame
    rows: DataFrame

    def release(self) -> None:
        self.rows.unpersist()


def _window_counts(df, test_size, mode, user, item, rating, timestamp) -> DataFrame:
    """One shuffle on user: both window specs are satisfied by the same partitioning."""
    per_user = Window.partitionBy(user)
    position = F.row_number().over(per_user.orderBy(timestamp, item, rating))
    flagged = df.withColumn("_early", position <= prefix_size(F.count(F.lit(1)).over(per_user), test_size))
    early = F.col("_early").cast("long")
    if mode == "positional":
        train_times, test_times = early, F.lit(1) - early
    else:
        copies = F.sum(early).over(Window.partitionBy(user, item, rating))
        flagged = flagged.withColumn("_copies", copies)
        train_times = F.col("_copies")
        test_times = (F.col("_copies") == 0).cast("long")
    return flagged.select(*df.columns, train_times.alias("_train"), test_times.cast("long").alias("_test"))


def _range_counts(df, rows, hot_rows, test_size, mode, user, item, rating, timestamp) -> DataFrame:
    """The same counts for users whose history does not fit one task. Identical rows are
    folded into a weight first, so even a mass of copies is one row here."""
    columns = df.columns
    folded = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_m"))
    order = [timestamp, item, rating] + [c for c in columns if c not in (user, item, rating, timestamp)]
    placed = weighted_positions(folded, user, order, "_m", rows, hot_rows)
    room = prefix_size(F.col("_total"), test_size) - F.col("_start")
    placed = placed.withColumn("_early", F.greatest(F.lit(0), F.least(F.col("_m"), room)))
    if mode == "positional":
        train_times, test_times = F.col("_early"), F.col("_m") - F.col("_early")
    else:
        copies = placed.groupBy(user, item, rating).agg(F.sum("_early").alias("_copies"))
        placed = join_null_safe(placed, copies, [user, item, rating])
        train_times = F.col("_copies") * F.col("_m")
        test_times = F.when(F.col("_copies") == 0, F.col("_m")).otherwise(F.lit(0))
    return placed.select(*columns, train_times.alias("_train"), test_times.cast("long").alias("_test"))


def _dealt_users(df, hot_rows, mode, user, item, rating) -> HotKeys:
    """Users whose rows or whose copies of one triple are too many for one task. Copies are counted
    only for users who have that many rows."""
    if mode == "positional":
        return hot_keys(df, user, hot_rows)
    busy = hot_keys(df, user, min(hot_rows, MANY_COPIES))
    if not busy.count:
        return busy
    copies = busy.only(df, user).groupBy(user, item, rating).agg(F.count(F.lit(1)).alias("_n"))
    users = copies.groupBy(user).agg(F.sum("_n").alias("_rows"), F.max("_n").alias("_most"))
    found = checkpointed(users.filter((F.col("_rows") > hot_rows) | (F.col("_most") > MANY_COPIES)))
    sizes = found.agg(F.count(F.lit(1)).alias("k"), F.coalesce(F.sum("_rows"), F.lit(0)).alias("r")).first()
    return HotKeys(found.select(user), sizes["k"], sizes["r"])


def chronological_split(
    df: DataFrame,
    test_size: float = 0.2,
    mode: str = "triple",
    user: str = "user",
    item: str = "item",
    rating: str = "rating",
    timestamp: str = "timestamp",
    hot_rows: int = HOT_ROWS,
) -> Split:
    """First ``trunc((1 - test_size) * n)`` rows of each user by time go to train.

    With ``mode="triple"`` train is joined back to the source on (user, item, rating), where a
    null matches a null, so copies of a triple fan out and a triple with any copy in train
    is absent from test. ``mode="positional"`` puts every row on exactly one side. Ties in
    time are broken by item, then rating.

    Users with more than ``hot_rows`` rows, or with more than ``MANY_COPIES`` copies of a triple that
    would fan out, are ranked by ranges instead of in one window task. The rows are persisted, so the look for such users, the train side and the test
    side read the source once.
    """
    if mode not in ("triple", "positional"):
        raise ValueError(f"unknown split mode {mode!r}")
    names = (test_size, mode, user, item, rating, timestamp)
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    hot = _dealt_users(df, hot_rows, mode, user, item, rating)
    counts = _window_counts(hot.without(df, user), *names)
    train, test = (repeat_rows(counts.drop(drop), keep) for drop, keep in (("_test", "_train"), ("_train", "_test")))
    if hot.count:
        counts = _range_counts(hot.only(df, user), hot.rows, hot_rows, *names)
        train = train.unionByName(repeat_rows(counts.drop("_test"), "_train", spread=True))
        test = test.unionByName(repeat_rows(counts.drop("_train"), "_test", spread=True))
    return Split(train, test, df)
