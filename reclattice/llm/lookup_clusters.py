"""Centroid clustering of integer vectors with scalar lookup tables.

Each dimension holds few different integers. They are listed once and vectors are kept as places
in those lists; in every round the squared difference of each listed integer to each centroid is
tabulated, and a distance is a sum of table entries picked by the places, without a
multiplication per vector.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reclattice.llm.common import add_columns, written
from reclattice.llm.vectors import integer_vectors, matrix
from reclattice.session import ship_package

SCALE = 64.0
DIMENSIONS = 64
CLUSTERS = 16
ROUNDS = 3
# Components as large as this are left out: squared distances need not fit a long.
LIMIT = 2**27
# Listed integers, of all dimensions, sent to every task; beyond it a task lists those of its batch.
LISTED = 1 << 17
# Vectors whose distances are summed at a time.
_ROWS = 4096


@dataclass(frozen=True)
class Places:
    """The integers that occur in each dimension, in order, or None if there are too many."""

    lists: list[np.ndarray] | None

    def of(self, x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """The lists that hold for ``x``, and the place of every component in its list."""
        lists, place = [], np.empty(x.shape, np.int32)
        for d in range(x.shape[1]):
            if self.lists is None:
                values, place[:, d] = np.unique(x[:, d], return_inverse=True)
            else:
                values = self.lists[d]
                place[:, d] = np.searchsorted(values, x[:, d])
            lists.append(values)
        return lists, place


def occurring(vectors: DataFrame, dims: int) -> Places:
    """Distinct integers per dimension, if there are no more than ``LISTED`` of all dimensions."""
    found = vectors.select(F.posexplode("x").alias("d", "v")).distinct()
    rows = found.limit(LISTED + 1).collect()
    if len(rows) > LISTED:
        return Places(None)
    lists: list[list[int]] = [[] for _ in range(dims)]
    for row in rows:
        lists[row["d"]].append(row["v"])
    return Places([np.array(sorted(v), np.int64) for v in lists])


def tabulate(lists: list[np.ndarray], centroids: np.ndarray) -> list[np.ndarray]:
    """Per dimension the squared difference of every listed integer (row) to every centroid."""
    return [(values[:, None] - centroids[None, :, d]) ** 2 for d, values in enumerate(lists)]


def distances(tables: list[np.ndarray], place: np.ndarray) -> np.ndarray:
    """Squared distance of every vector to every centroid, by gathers and sums."""
    out = np.zeros((place.shape[0], tables[0].shape[1]), np.int64)
    for d, table in enumerate(tables):
        out += table[place[:, d]]
    return out


class _Assigner:
    def __init__(self, places: Places, centroids: np.ndarray):
        self.places, self.centroids = places, centroids
        self.tables = None if places.lists is None else tabulate(places.lists, centroids)

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroid (ties: the smaller number) and squared distance to it."""
        cluster, nearest = np.empty(x.shape[0], np.int32), np.empty(x.shape[0], np.int64)
        for lo in range(0, x.shape[0], _ROWS):
            lists, place = self.places.of(x[lo : lo + _ROWS])
            far = distances(self.tables or tabulate(lists, self.centroids), place)
            cluster[lo : lo + _ROWS] = far.argmin(axis=1)
            nearest[lo : lo + _ROWS] = far.min(axis=1)
        return cluster, nearest


def first_centroids(vectors: DataFrame, clusters: int, seed: int = 1) -> np.ndarray:
    """The vectors with the smallest sha256 of ``<seed>:<id>``, in that order; null ids last."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    rows = vectors.select(mark.alias("mark"), "x").orderBy(F.col("mark").asc_nulls_last(), "x").limit(clusters).collect()
    return np.array([row["x"] for row in rows], np.int64)


def moved(vectors: DataFrame, places: Places, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: floors of exact means; an empty cluster's stays."""
    k, dims = centroids.shape

    def partial(batches):
        assign = _Assigner(places, centroids)
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            x = matrix(batch.column(0), dims)
            cluster, _ = assign(x)
            count += np.bincount(cluster, minlength=k)
            np.add.at(total, cluster, x)
        c = np.repeat(np.arange(k, dtype=np.int32), dims + 1)
        d = np.tile(np.arange(-1, dims, dtype=np.int32), k)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c), pa.array(d), pa.array(np.concatenate([count[:, None], total], axis=1).ravel())], names=["c", "d", "s"]
        )

    sums = vectors.select("x").mapInArrow(partial, "c int, d int, s long")
    found = {(r["c"], r["d"]): int(r["s"]) for r in sums.groupBy("c", "d").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
    out = centroids.copy()
    for c in range(k):
        n = found.get((c, -1), 0)
        if n:
            out[c] = [found[c, d] // n for d in range(dims)]
    return out


def assigned(vectors: DataFrame, places: Places, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of every vector."""
    dims = centroids.shape[1]

    def make():
        assign = _Assigner(places, centroids)

        def step(lists):
            cluster, nearest = assign(matrix(lists, dims))
            return [pa.array(cluster), pa.array(nearest)]

        return step

    return add_columns(vectors.select("id", "x"), ["x"], "cluster int, distance long", make).select("id", "cluster", "distance")


def cluster(
    df: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: float = SCALE, dims: int = DIMENSIONS,
    vec_id: str = "vec_id", embedding: str = "embedding",
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector.

    Kept are vectors of exactly ``dims`` components, all finite and below ``LIMIT`` in size once they
    are integers. Every row is a vector of its own, repeated ids and vectors too; of equal marks
    the smaller vector starts first, and a null id starts last. With fewer vectors than ``clusters``
    there are as many centroids as vectors. Equal distances go to the smaller number. An empty table gives no
    rows; sums beyond a long are null. Other columns are ignored.
    """
    spark = df.sparkSession
    ship_package(spark)
    small = F.forall("x", lambda c: (c > -LIMIT) & (c < LIMIT))
    whole = integer_vectors(df, scale, vec_id, embedding)
    vectors = written(whole.filter((F.size("x") == dims) & small), "kept-vectors")
    centroids = first_centroids(vectors, clusters)
    if not len(centroids):
        return spark.createDataFrame(
            [], f"id {dict(whole.dtypes)['id']}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        )
    places = occurring(vectors, dims)
    for _ in range(rounds):
        centroids = moved(vectors, places, centroids)
    found = written(assigned(vectors, places, centroids), "assigned")
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    by_cluster = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(exact.alias("s")).collect()}
    total = sum(by_cluster.values())
    fitting = lambda v: v if v < 2**63 else None
    rows = [
        (c, fitting(by_cluster.get(c, 0)), fitting(total), hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest())
        for c, x in enumerate(centroids)
    ]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # One row per centroid.
    return found.join(F.broadcast(facts), "cluster").select(
        "id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
