"""Exact cosine links between embeddings of one label, by cover trees over blocks.

The top of the tree is laid out by Spark: a bounded sample of vectors per large label serves as
centres, every vector goes to its nearest one, and cells beyond a block are cut further. Pairs of
blocks whose covering radii keep them apart are never made; for the others a task builds both
trees and walks them together. A task returns counts and one link per vector, not its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reclattice.llm import covertree
from reclattice.llm.common import add_columns, written
from reclattice.llm.components import connected_components

COSINE = 0.93
# Vectors per block in expectation, and centres in all (2 MB of 64 double components).
BLOCK = 1536
CENTRES = 4096
NO_CENTRE = -1


def _units(lists) -> np.ndarray:
    """Rows of unit length in double precision from an Arrow list column."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(lists), -1)
    # Scaled first, so that squares neither overflow nor vanish.
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _usable() -> Column:
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    some = F.exists("embedding", lambda x: F.coalesce(x != 0, F.lit(False)))
    return F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite & some, F.lit(False))


def cosine_links(df: DataFrame, cosine: float = COSINE, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(id, n_links, component), one row per row of ``df``.

    ``n_links`` counts the other rows of the same label with at least this cosine, ``component``
    is the least id that links lead to. Rows with a null id, label or vector, a zero vector, or
    a null or non-finite component link with nothing; so do vectors of different length. Rows
    that repeat an id share a component, and where their vectors differ, the sum of their links.
    Other columns are ignored.
    """
    spark = df.sparkSession
    rows = df.select(F.col(f"`{vec_id}`").alias("id"), F.col(f"`{embedding}`").alias("embedding"), F.col(f"`{label}`").alias("label"))
    good = rows.filter(_usable()).withColumn("dim", F.size("embedding"))
    # Equal vectors are one point with a weight; the count is combined before the shuffle.
    points = written(
        good.groupBy("label", "dim", "embedding").agg(F.min("id").alias("node"), F.count("*").alias("weight")), "points"
    )
    sizes = points.groupBy("label", "dim").agg(F.count("*").alias("size"))
    total = points.count()
    share = min(1.0, 1.0 / BLOCK, CENTRES / max(1, total))
    picked = F.pmod(F.xxhash64("node", F.lit(7)), F.lit(1_000_003)) < int(1_000_003 * share)
    sample = points.filter(picked).join(sizes.filter(F.col("size") > BLOCK), ["label", "dim"], "left_semi")
    centres: dict[tuple, list] = {}
    for row in sample.select("label", "dim", "node", "embedding").orderBy("node").collect():
        centres.setdefault((row["label"], row["dim"]), []).append(row["embedding"])
    kept = {k: _units(pa.array(v, pa.list_(pa.float64()))) for k, v in centres.items()}
    sent = spark.sparkContext.broadcast(kept)

    def assign():
        known = sent.value

        def step(labels, dims, vectors):
            cell, away = np.full(len(labels), NO_CENTRE, np.int32), np.full(len(labels), 2.0)
            at: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(labels.to_pylist(), dims.to_pylist(), strict=True)):
                if key in known:
                    at.setdefault(key, []).append(i)
            for key, index in at.items():
                unit = _units(vectors.take(pa.array(index)))
                near = np.argmax(unit @ known[key].T, axis=1)
                cell[index] = near
                away[index] = np.sqrt(((unit - known[key][near]) ** 2).sum(axis=1))
            return [pa.array(cell), pa.array(away)]

        return step

    placed = add_columns(points, ["label", "dim", "embedding"], "cell int, away double", assign)
    cells = placed.groupBy("label", "dim", "cell").agg(F.count("*").alias("members"))
    cut = F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / BLOCK)).cast("int")
    blocked = written(
        placed.join(cells, ["label", "dim", "cell"]).select("label", "dim", F.struct("cell", cut.alias("cut")).alias("block"), "node", "weight", "embedding", "away"),
        "blocks",
    )
    blocks = blocked.groupBy("label", "dim", "block").agg(F.max("away").alias("radius"))
    one, two = (blocks.select("label", "dim", F.col("block").alias(b), F.col("radius").alias(r)) for b, r in (("i", "ri"), ("j", "rj")))
    pairs = one.join(two, ["label", "dim"]).filter("i <= j").withColumn("c", F.col("i.cell")).withColumn("d", F.col("j.cell"))
    far = float(np.sqrt(2 - 2 * cosine))

    def apart():
        known = sent.value

        def step(labels, dims, c, d, ri, rj):
            near = []
            for key, x, y, r, s in zip(zip(labels.to_pylist(), dims.to_pylist(), strict=True), *(v.to_pylist() for v in (c, d, ri, rj)), strict=True):
                if x == NO_CENTRE or y == NO_CENTRE:
                    near.append(True)
                else:
                    near.append(bool(np.linalg.norm(known[key][x] - known[key][y]) - r - s <= far + covertree.MARGIN))
            return [pa.array(near, pa.bool_())]

        return step

    near = add_columns(pairs, ["label", "dim", "c", "d", "ri", "rj"], "near boolean", apart).filter("near")
    side = F.array(F.struct(F.lit(0).alias("side"), F.col("i").alias("block")), F.struct(F.lit(1).alias("side"), F.col("j").alias("block")))
    tasks = near.select(
        "label", "dim", F.struct("i", "j").alias("task"),
        F.explode(F.when(F.col("i") == F.col("j"), F.slice(side, 1, 1)).otherwise(side)).alias("e"),
    ).select("label", "dim", "task", "e.side", "e.block")
    dealt = tasks.join(blocked.drop("away"), ["label", "dim", "block"]).select("label", "dim", "task", "side", "node", "weight", "embedding")

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        unit = _units(group["embedding"].combine_chunks() if isinstance(group["embedding"], pa.ChunkedArray) else group["embedding"])
        which, ids, weight = (group[c].to_numpy() for c in ("side", "node", "weight"))
        left, right = which == 0, which == 1
        other = unit[right] if right.any() else None
        a, b, forest = covertree.links(unit[left], other, ids[left], ids[right], weight[left], weight[right], cosine)
        node = np.concatenate([ids[left], ids[right]])
        count = np.concatenate([a, b]) if other is not None else a
        root = np.array([forest.find(int(i)) for i in node], np.int64)
        some = (count > 0) | (root != node)
        return pa.table({"node": node[some], "n": count[some], "root": root[some]})

    found = written(dealt.groupBy("label", "dim", "task").applyInArrow(compare, "node bigint, n bigint, root bigint"), "links")
    counts = found.groupBy("node").agg(F.sum("n").alias("others"))
    # A point is named by its least id.
    member = good.join(points, ["label", "dim", "embedding"]).select("id", "node", "weight")
    ties = member.filter("id <> node").groupBy("id").agg(F.collect_set("node").alias("all")).filter(F.size("all") > 1)
    edges = found.select(F.col("node").alias("a"), F.col("root").alias("b")).union(
        ties.select(F.explode("all").alias("a"), F.col("id").alias("b"))
    )
    parts = connected_components(edges)
    linked = member.join(counts, "node", "left").join(parts, "node", "left").select(
        "id",
        (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"),
        F.coalesce("component", "node").alias("component"),
    )
    bad = rows.filter(~_usable()).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.union(bad)
