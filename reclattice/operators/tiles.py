"""Symmetric matrices as a table of square tiles, and their inverse as Spark jobs.

Only tiles with ``bi <= bj`` are stored, as float64 bytes. The inverse is a block sweep:
for each pivot tile K, with p = inverse(A[K,K]),

    A[K,K] <- -p      A[K,j] <- p A[K,j]      A[i,j] <- A[i,j] - A[K,i]' p A[K,j]

and after the last pivot the table holds minus the inverse. It needs no pivoting for a
positive definite matrix, and symmetry is kept, so half the tiles and half the work suffice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reclattice.session import delete_stored, stored

_TILE_SCHEMA = "bi long, bj long, tile binary"
# Width of a tile whatever the catalogue: 32 MB of doubles. A sweep has items / 2,048 steps.
TILE = 2048


def tile_count(n_items: int, width: int) -> int:
    return -(-n_items // width)


def tile_array(data: bytes, bi: int, bj: int, n_items: int, width: int) -> np.ndarray:
    rows = min(width, n_items - bi * width)
    cols = min(width, n_items - bj * width)
    return np.frombuffer(data, dtype=np.float64).reshape(rows, cols)


def tile_table(bi: int, bj: int, values: np.ndarray) -> pa.Table:
    return pa.table(
        {
            "bi": pa.array([bi], pa.int64()),
            "bj": pa.array([bj], pa.int64()),
            "tile": pa.array([np.ascontiguousarray(values).tobytes()], pa.binary()),
        }
    )


def first_valid(table: pa.Table, name: str) -> int:
    return table.column(name)[0].as_py()


def upper_positions(spark: SparkSession, blocks: int) -> DataFrame:
    return spark.range(blocks).select(
        F.col("id").alias("bi"), F.explode(F.sequence(F.col("id"), F.lit(blocks - 1).cast("long"))).alias("bj")
    )


def pack(upper: DataFrame, n_items: int, width: int, ridge: float, finish=None) -> DataFrame:
    """Tiles of ``G + ridge * I`` from the upper triangle ``(i, j, g)``. A group holds at
    most ``width * width`` entries; tiles without entries are made too, since the sweep fills
    them. ``finish`` is applied to each tile's array."""

    def build(table: pa.Table) -> pa.Table:
        bi, bj = first_valid(table, "bi"), first_valid(table, "bj")
        rows, cols = min(width, n_items - bi * width), min(width, n_items - bj * width)
        values = np.zeros((rows, cols))
        entries = table.drop_null()
        i = entries.column("i").to_numpy() - bi * width
        j = entries.column("j").to_numpy() - bj * width
        values[i, j] = entries.column("g").to_numpy()
        if bi == bj:
            values = values + np.triu(values, 1).T
            values[np.diag_indices(rows)] += ridge
        return tile_table(bi, bj, values if finish is None else finish(values))

    entries = upper.select(
        F.floor(F.col("i") / width).alias("bi"), F.floor(F.col("j") / width).alias("bj"), "i", "j", "g"
    )
    every = upper_positions(upper.sparkSession, tile_count(n_items, width))
    return (
        entries.unionByName(every, allowMissingColumns=True)
        .groupBy("bi", "bj")
        .applyInArrow(build, _TILE_SCHEMA)
    )


def _negative_pivot(tiles: DataFrame, k: int, n_items: int, width: int) -> np.ndarray:
    """Minus the inverse of A[K,K], solved once, in a task; one tile comes to the driver."""

    def invert(batches):
        for batch in batches:
            for data in batch.column(0):
                inverse = -np.linalg.inv(tile_array(data.as_buffer(), k, k, n_items, width))
                yield pa.RecordBatch.from_pydict({"tile": pa.array([inverse.tobytes()], pa.binary())})

    pivot = tiles.filter((F.col("bi") == k) & (F.col("bj") == k)).select("tile")
    return tile_array(pivot.mapInArrow(invert, "tile binary").first()["tile"], k, k, n_items, width)


def _pivot_panel(tiles: DataFrame, k: int, pivot: Broadcast, n_items: int, width: int) -> DataFrame:
    """Rows ``(b, raw, solved)``: raw = A[K,b], solved = inverse(A[K,K]) A[K,b]; for b = K
    solved is minus the inverse. Every tile of the panel is solved where it lies."""

    def solve(batches):
        for batch in batches:
            for bi, bj, data in zip(*(batch.column(c) for c in ("bi", "bj", "tile"))):
                bi, bj = bi.as_py(), bj.as_py()
                values = tile_array(data.as_buffer(), bi, bj, n_items, width)
                raw = values if bi == k else values.T
                solved = pivot.value if bi == bj else -pivot.value @ raw
                yield pa.RecordBatch.from_pydict({
                    "b": pa.array([bi + bj - k], pa.int64()),
                    "raw": pa.array([np.ascontiguousarray(raw).tobytes()], pa.binary()),
                    "solved": pa.array([np.ascontiguousarray(solved).tobytes()], pa.binary()),
                })

    panel = tiles.filter((F.col("bi") == k) | (F.col("bj") == k)).select("bi", "bj", "tile")
    return panel.mapInArrow(solve, "b long, raw binary, solved binary")


def _swept(tiles: DataFrame, panel: DataFrame, k: int, blocks: int, n_items: int, width: int) -> DataFrame:
    def update(table: pa.Table) -> pa.Table:
        bi, bj = first_valid(table, "bi"), first_valid(table, "bj")
        parts = dict(zip(table.column("role").to_pylist(), table.column("tile").to_pylist()))
        if bi == k or bj == k:
            b = bj if bi == k else bi
            solved = tile_array(parts["solved"], k, b, n_items, width)
            return tile_table(bi, bj, solved if bi == k else solved.T)
        own = tile_array(parts["own"], bi, bj, n_items, width)
        raw = tile_array(parts["raw"], k, bi, n_items, width)
        solved = tile_array(parts["solved"], k, bj, n_items, width)
        return tile_table(bi, bj, own - raw.T @ solved)

    b, last = F.col("b"), F.lit(blocks - 1)
    at_pivot = F.struct(F.least(b, F.lit(k)).alias("bi"), F.greatest(b, F.lit(k)).alias("bj"))
    own = tiles.filter((F.col("bi") != k) & (F.col("bj") != k)).select("bi", "bj", F.lit("own").alias("role"), "tile")
    others = panel.filter(b != k)
    raw = others.select(
        b.alias("bi"), F.explode(F.sequence(b, last.cast("long"))).alias("bj"), F.lit("raw").alias("role"), F.col("raw").alias("tile")
    ).filter(F.col("bj") != k)
    solved = others.select(
        F.explode(F.sequence(F.lit(0).cast("long"), b)).alias("bi"), b.alias("bj"), F.lit("solved").alias("role"), F.col("solved").alias("tile")
    ).filter(F.col("bi") != k)
    pivots = panel.select(at_pivot.alias("p"), "solved").select(
        "p.bi", "p.bj", F.lit("solved").alias("role"), F.col("solved").alias("tile")
    )
    return (
        own.unionByName(raw).unionByName(solved).unionByName(pivots)
        .groupBy("bi", "bj")
        .applyInArrow(update, _TILE_SCHEMA)
    )


def negative_inverse(tiles: DataFrame, n_items: int, width: int) -> DataFrame:
    """Tiles of ``-inverse(A)``. Every step ends in a table in the shared folder, since the next one
    reads its tiles several times; a table is deleted when the step after it is written."""
    spark = tiles.sparkSession
    tiles, old = stored(tiles, "tiles")
    for k in range(tile_count(n_items, width)):
        pivot = spark.sparkContext.broadcast(_negative_pivot(tiles, k, n_items, width))
        panel, panel_path = stored(_pivot_panel(tiles, k, pivot, n_items, width), "panel")
        tiles, new = stored(_swept(tiles, panel, k, tile_count(n_items, width), n_items, width), "tiles")
        pivot.unpersist()
        delete_stored(spark, panel_path)
        delete_stored(spark, old)
        old = new
    return tiles


def mirrored(tiles: DataFrame, n_items: int, width: int) -> DataFrame:
    """All tiles ``(bi, bj, tile)`` of a symmetric table, both triangles."""

    def turn(table: pa.Table) -> pa.Table:
        bi, bj, flip = (first_valid(table, c) for c in ("bi", "bj", "flip"))
        data = first_valid(table, "tile")
        if not flip:
            return table.select(["bi", "bj", "tile"])
        return tile_table(bi, bj, tile_array(data, bj, bi, n_items, width).T)

    sides = F.when(
        F.col("bi") == F.col("bj"), F.array(F.struct("bi", "bj", F.lit(False).alias("flip")))
    ).otherwise(
        F.array(
            F.struct("bi", "bj", F.lit(False).alias("flip")),
            F.struct(F.col("bj").alias("bi"), F.col("bi").alias("bj"), F.lit(True).alias("flip")),
        )
    )
    return (
        tiles.select("tile", F.inline(sides)).groupBy("bi", "bj").applyInArrow(turn, _TILE_SCHEMA)
    )


def entries(tiles: DataFrame, n_items: int, width: int) -> DataFrame:
    """Long form ``(i, j, b)`` of a tile table, one tile per task call."""

    def spread(table: pa.Table) -> pa.Table:
        bi, bj = first_valid(table, "bi"), first_valid(table, "bj")
        values = tile_array(first_valid(table, "tile"), bi, bj, n_items, width)
        i, j = np.indices(values.shape)
        return pa.table(
            {"i": i.ravel() + bi * width, "j": j.ravel() + bj * width, "b": values.ravel()}
        )

    return tiles.groupBy("bi", "bj").applyInArrow(spread, "i long, j long, b double")
