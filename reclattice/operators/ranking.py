"""Ranking inside groups, including groups too large for one task."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reclattice.session import checkpointed, shuffle_partitions

# A group above this many rows is never put through a single window task.
HOT_ROWS = 2_000_000
# Rows for which a range of huge groups is worth a task of its own, however low the bound on a group.
RANGE_ROWS = 250_000
# Number of hot keys that may be broadcast (a key is a few bytes; 100k keys stay small).
HOT_KEYS_BROADCAST = 100_000
# Rows of a group in one array.
LIST_CHUNK = 10_000
# Copies of one row produced by one task when rows are repeated.
REPEAT_CHUNK = 100_000


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows of each group. The ``<= k`` filter on ``row_number`` becomes a
    partial group limit before the shuffle, so a task sends at most ``k`` rows per group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


@dataclass(frozen=True)
class HotKeys:
    keys: DataFrame
    count: int
    rows: int

    def _small(self) -> DataFrame:
        return F.broadcast(self.keys) if self.count <= HOT_KEYS_BROADCAST else self.keys

    def only(self, df: DataFrame, key: str) -> DataFrame:
        keys = self._small().select(F.col(key).alias("_hot"))
        return df.join(keys, F.col(key).eqNullSafe(F.col("_hot")), "left_semi")

    def without(self, df: DataFrame, key: str) -> DataFrame:
        if not self.count:
            return df
        keys = self._small().select(F.col(key).alias("_hot"))
        return df.join(keys, F.col(key).eqNullSafe(F.col("_hot")), "left_anti")


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which a null key meets a null key; the columns of ``keys`` come from the left."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(renamed, reduce(lambda a, b: a & b, same)).drop(*[f"_right_{k}" for k in keys])


def hot_keys(df: DataFrame, key: str, limit: int) -> HotKeys:
    """Keys with more than ``limit`` rows, found with a map-side combined count. At most
    ``rows / limit`` keys can qualify."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit)
    found = counts.agg(F.count(F.lit(1)).alias("k"), F.coalesce(F.sum("_n"), F.lit(0)).alias("r")).first()
    keys = counts.select(key)
    if found["k"]:
        keys = checkpointed(keys)
    return HotKeys(keys, found["k"], found["r"])


def weighted_positions(df: DataFrame, by: str, order: list[str], weight: str, rows: int, per_task: int) -> DataFrame:
    """Position of every row inside its (huge) group, without a task holding a whole group.

    Rows are range-partitioned on (group, order), so one group spreads over many tasks; the
    weight found in earlier partitions is added to the position inside the partition. Adds
    ``_start`` (weight before the row) and ``_total`` (weight of the group). Beyond a few ranges per shuffle
    partition, a range has at least ``RANGE_ROWS`` rows, so many small groups do not become as many tasks.
    """
    usual = shuffle_partitions(df.sparkSession)
    enough = max(4 * usual, -(-rows // max(per_task, RANGE_ROWS)))
    parts = max(usual, min(enough, -(-rows // max(per_task, 1))))
    ranged = checkpointed(
        df.repartitionByRange(parts, by, *order).withColumn("_part", F.spark_partition_id())
    )
    earlier = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (
        ranged.groupBy(by, "_part")
        .agg(F.sum(weight).alias("_piece"))
        .withColumn("_before", F.coalesce(F.sum("_piece").over(earlier), F.lit(0)))
        .withColumn("_total", F.sum("_piece").over(Window.partitionBy(by)))
        .drop("_piece")
    )
    inside = Window.partitionBy(by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        join_null_safe(ranged.withColumn("_inside", F.sum(weight).over(inside) - F.col(weight)), pieces, [by, "_part"])
        .withColumn("_start", F.col("_before") + F.col("_inside"))
        .drop("_part", "_before", "_inside")
    )


def row_numbers(df: DataFrame, by: str, order: list[str], name: str = "rank", hot_rows: int = HOT_ROWS) -> DataFrame:
    """``df`` with the position of each row in its group, from 1. Groups above ``hot_rows`` rows
    are ranked by ranges instead of in one window task."""
    hot = hot_keys(df, by, hot_rows)
    window = Window.partitionBy(by).orderBy(*order)
    ranked = hot.without(df, by).withColumn(name, F.row_number().over(window).cast("long"))
    if not hot.count:
        return ranked
    placed = weighted_positions(hot.only(df, by).withColumn("_m", F.lit(1)), by, order, "_m", hot.rows, hot_rows)
    return ranked.unionByName(placed.withColumn(name, (F.col("_start") + 1).cast("long")).select(ranked.columns))


def history_lists(
    df: DataFrame, by: str, order: list[str], columns: list[str], chunk: int = LIST_CHUNK, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """(by, chunk, rows): the ``columns`` of each group's rows in order, ``chunk`` rows to an array, chunks
    numbered from 0. A group of any size is a row of bounded length per chunk; groups above
    ``hot_rows`` are numbered by ranges."""
    numbered = row_numbers(df.select(by, *dict.fromkeys([*order, *columns])), by, order, "_at", hot_rows)
    entry = F.struct("_at", *columns)
    listed = numbered.groupBy(by, F.floor((F.col("_at") - 1) / chunk).alias("chunk")).agg(
        F.array_sort(F.collect_list(entry)).alias("rows")
    )
    return listed.withColumn("rows", F.transform("rows", lambda r: F.struct(*[r[c].alias(c) for c in columns])))


def from_lists(lists: DataFrame, by: str, chunk: int = LIST_CHUNK) -> DataFrame:
    """(by, pos, the listed columns): the rows behind ``history_lists``, numbered from 1."""
    out = lists.select(by, "chunk", F.posexplode("rows").alias("_at", "_row"))
    return out.select(by, (F.col("chunk") * chunk + F.col("_at") + 1).cast("long").alias("pos"), "_row.*")


def repeat_rows(df: DataFrame, times: str, spread: bool = False) -> DataFrame:
    """Emit every row ``times`` times (0 drops it). With ``spread`` a large count is first
    cut into chunks that are shuffled apart, so no single task writes all copies."""
    df = df.filter(F.col(times) > 0)
    if spread:
        chunks = F.sequence(F.lit(0), F.floor((F.col(times) - 1) / REPEAT_CHUNK))
        df = df.withColumn("_chunk", F.explode(chunks)).withColumn(
            times, F.least(F.lit(REPEAT_CHUNK), F.col(times) - F.col("_chunk") * REPEAT_CHUNK)
        )
        others = [c for c in df.columns if c != times]
        # A given number is not coalesced: the rows are small only until they are repeated.
        df = df.repartition(shuffle_partitions(df.sparkSession), *others).drop("_chunk")
    return df.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col(times).cast("int")))).drop(times, "_copy")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
