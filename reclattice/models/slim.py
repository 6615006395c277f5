"""SLIM: one non-negative elastic net per item, solved on the Gram table."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reclattice.models.base import Interactions, prepare
from reclattice.operators.matrix import both_triangles
from reclattice.operators.ranking import union_all
from reclattice.operators.scoring import recommend_sparse
from reclattice.session import broadcast_if_small, checkpointed

# Candidates, counted over its targets, of a group solved together. Groups of small targets have
# less than twice as many items, so their square of doubles stays under 128 MB; a target with more
# candidates of its own is solved alone on its Gram entries, without a square.
_CANDIDATES_PER_GROUP = 2048
# Largest step of the last sweep, relative to the largest weight.
_TOLERANCE = 1e-13
_MAX_SWEEPS = 100_000
_WEIGHT_SCHEMA = "i long, j long, b double"


def l1_ratio(l1: float, l2: float) -> float:
    """Share of the l1 part; the overall strength of the penalty is always 1."""
    if l1 + l2 == 0:
        raise ValueError("l1 and l2 are both 0: the ratio l1 / (l1 + l2) is undefined")
    return l1 / (l1 + l2)


@dataclass(frozen=True)
class SLIM:
    """Configuration; ``fit_predict`` never changes it. See ``EASE`` for the masks."""

    user: str = "user"
    item: str = "item"
    rating: str = "rating"
    l1_reg: float = 1.0
    l2_reg: float = 1.0
    top_k: int = 10
    filter_already_liked_items: bool = True
    binarize: bool = True
    positive_only: bool = True
    mask: str = "zero"
    score_digits: int | None = None

    name = "SLIM"

    def with_params(self, l1: float, l2: float) -> "SLIM":
        return replace(self, l1_reg=l1, l2_reg=l2)

    def prepare(self, df: DataFrame) -> Interactions:
        return prepare(df, self.user, self.item, self.rating, self.binarize)

    def fit(self, data: Interactions) -> DataFrame:
        """Sparse weights ``(i, j, b)``, ``b > 0``: item i's share in the score of item j."""
        return fit_weights(data, l1_ratio(self.l1_reg, self.l2_reg), self.positive_only, self._nearest(data))

    weights = fit

    def share(self, data: Interactions) -> None:
        """Keep every fit from now on as the start of the next one along the penalty path."""
        data.path = data.path or []

    def _nearest(self, data: Interactions) -> DataFrame | None:
        ratio = l1_ratio(self.l1_reg, self.l2_reg)
        near = min(data.path or [], key=lambda fit: abs(np.log(max(fit[0], 1e-12) / max(ratio, 1e-12))), default=None)
        return near and near[1]

    def recommend(self, data: Interactions) -> DataFrame:
        mask = self.mask if self.filter_already_liked_items else "none"
        weights = checkpointed(self.fit(data))
        if data.path is not None:
            data.path.append((l1_ratio(self.l1_reg, self.l2_reg), weights))
        top = recommend_sparse(data, weights, weights.count(), self.top_k, mask, self.score_digits)
        return data.decoded(top)

    def fit_predict(self, df: DataFrame) -> DataFrame:
        return self.recommend(self.prepare(df))


def fit_weights(
    data: Interactions, ratio: float, positive_only: bool = True, start: DataFrame | None = None
) -> DataFrame:
    """Elastic net of every item on all others. ``start`` is a fit to begin at, of a nearby ``ratio``:
    the optimum is the same, it is reached in fewer sweeps.

    Only pairs with ``|G_ij| > n * ratio`` start as candidates. With non-negative cells and
    ``positive_only`` every other weight is provably 0: its gradient at the solution is at
    most ``G_ij / n - ratio <= 0``. Otherwise the optimality condition is checked on the
    whole Gram table, violating pairs join the candidates, and the solve repeats until none
    is left, so no weight is lost to the screening.
    """
    n, bound = data.n_users, data.n_users * ratio
    off_diagonal = both_triangles(data.gram.filter(F.col("i") != F.col("j")))
    candidates = off_diagonal.filter(F.abs("g") > bound)

    def solved(pairs: DataFrame) -> DataFrame:
        return _solve(data.gram, pairs, data.n_items, n, ratio, positive_only, start)

    if positive_only and data.lowest >= 0:
        return solved(candidates).filter(F.col("b") > 0)
    full = both_triangles(data.gram)
    candidates = checkpointed(candidates)
    while True:
        weights = checkpointed(solved(candidates))
        missed = _violations(full, off_diagonal, candidates, weights, n, ratio, positive_only)
        missed = checkpointed(missed.join(off_diagonal, ["i", "j"], "left").select("i", "j", F.coalesce("g", F.lit(0.0)).alias("g")))
        if missed.isEmpty():
            return weights.filter(F.col("b") > 0)
        candidates = checkpointed(candidates.unionByName(missed))


def _violations(full, off_diagonal, candidates, weights, n, ratio, positive_only) -> DataFrame:
    """Pairs outside the candidates whose gradient exceeds the l1 bound."""
    explained = full.select(F.col("i"), F.col("j").alias("k"), "g").join(
        weights.select(F.col("i").alias("k"), F.col("j"), "b"), "k"
    ).select("i", "j", (-F.col("g") * F.col("b")).alias("g"))
    gradient = (
        union_all([off_diagonal.select("i", "j", "g"), explained])
        .filter(F.col("i") != F.col("j"))
        .groupBy("i", "j").agg((F.sum("g") / n).alias("grad"))
    )
    size = F.col("grad") if positive_only else F.abs("grad")
    return gradient.filter(size > ratio * (1 + 1e-9)).select("i", "j").join(candidates, ["i", "j"], "left_anti")


def _groups(candidates: DataFrame) -> DataFrame:
    """(j, pivot, cut): targets that are solved together.

    The pivot of a target is the one of its candidates with the least hash, so two targets share it
    with the chance of their candidate sets' Jaccard similarity. Targets of one pivot are cut where
    their counted candidates fill a group; a target too large for that is a group of its own.
    """
    least = F.min(F.struct(F.xxhash64("i").alias("hash"), "i"))["i"]
    targets = candidates.groupBy("j").agg(F.count("*").alias("size"), least.alias("pivot"))
    room = F.lit(_CANDIDATES_PER_GROUP)
    filled = F.sum("size").over(Window.partitionBy("pivot").orderBy("j"))
    small = targets.filter(F.col("size") <= room).select("j", "pivot", F.floor((filled - 1) / room).alias("cut"))
    large = targets.filter(F.col("size") > room).select("j", F.lit(-1).cast("long").alias("pivot"), F.col("j").alias("cut"))
    return small.unionByName(large)


def _solve(
    upper: DataFrame, candidates: DataFrame, n_items: int, n: int, ratio: float, positive_only: bool,
    start: DataFrame | None = None,
) -> DataFrame:
    """Weights of the candidate pairs (i, j, g), solved in groups of targets j.

    A group gets the Gram entries between its own candidates and no others, each once, from the
    upper triangle; what links a candidate to its target comes with the pair.
    """
    group = ["pivot", "cut"]
    if start is None:
        begun = candidates.select("i", "j", "g", F.lit(0.0).alias("b"))
    else:
        begun = candidates.join(start.select("i", "j", "b"), ["i", "j"], "left").fillna(0.0, "b")
    wanted = checkpointed(begun.join(_groups(candidates), "j"))
    members = wanted.select(*group, "i").distinct()
    used = broadcast_if_small(candidates.select("i").distinct(), n_items, 16)
    entries = (
        upper.join(used, "i", "left_semi").withColumnRenamed("j", "k")
        .join(used.withColumnRenamed("i", "k"), "k", "left_semi")
        .join(members, "i").join(members.withColumnRenamed("i", "k"), [*group, "k"])
    )

    def solve(square: pa.Table, pairs: pa.Table) -> pa.Table:
        return _solve_group(square, pairs, n, ratio, positive_only)

    pairs = wanted.select(*[F.col(c).alias(f"of_{c}") for c in group], "i", "j", "g", "b")
    return (
        entries.groupBy(*group).cogroup(pairs.groupBy(*[f"of_{c}" for c in group])).applyInArrow(solve, _WEIGHT_SCHEMA)
    )


def _solve_group(entries: pa.Table, pairs: pa.Table, n: int, ratio: float, positive_only: bool) -> pa.Table:
    pi, pj, g, b = (pairs.column(c).to_numpy() for c in ("i", "j", "g", "b"))
    items, at = np.unique(pi, return_inverse=True)
    targets, to = np.unique(pj, return_inverse=True)
    left, right = (np.searchsorted(items, entries.column(c).to_numpy()) for c in ("i", "k"))
    values = entries.column("g").to_numpy() / n
    if targets.size == 1 and items.size > _CANDIDATES_PER_GROUP:
        linear, start = np.empty(items.size), np.empty(items.size)
        linear[at], start[at] = g / n, b
        found = sparse_descent(left, right, values, linear, ratio, positive_only, start)[:, None]
    else:
        square = np.zeros((items.size, items.size))
        square[left, right] = values
        square[right, left] = values
        shape = (items.size, targets.size)
        linear, allowed, start = np.zeros(shape), np.zeros(shape, bool), np.zeros(shape)
        linear[at, to], allowed[at, to], start[at, to] = g / n, True, b
        found = coordinate_descent(square, linear, allowed, ratio, positive_only, start)
    at_i, at_j = np.nonzero(found)
    return pa.table({"i": items[at_i], "j": targets[at_j], "b": found[at_i, at_j]})


def _shrunk(pull, ratio: float, positive_only: bool):
    if positive_only:
        return np.maximum(pull - ratio, 0.0)
    return np.sign(pull) * np.maximum(np.abs(pull) - ratio, 0.0)


def sparse_descent(
    left: np.ndarray, right: np.ndarray, values: np.ndarray, linear: np.ndarray, ratio: float, positive_only: bool,
    start: np.ndarray | None = None,
) -> np.ndarray:
    """``coordinate_descent`` of one target on the non-zero entries of the upper triangle: the
    gradient is kept and changed along the row of each weight that moves."""
    size = linear.size
    off = left != right
    rows, cols = np.r_[left, right[off]], np.r_[right, left[off]]
    order = np.argsort(rows, kind="stable")
    cols, vals = cols[order], np.r_[values, values[off]][order]
    starts = np.searchsorted(rows[order], np.arange(size + 1))
    diagonal = np.zeros(size)
    diagonal[left[~off]] = values[~off]
    weights, gradient = np.zeros(size) if start is None else start.copy(), linear.copy()
    for i in np.flatnonzero(weights):
        row = slice(starts[i], starts[i + 1])
        gradient[cols[row]] -= weights[i] * vals[row]
    active = np.flatnonzero(diagonal + (1.0 - ratio) > 0)
    for _ in range(_MAX_SWEEPS):
        moved = 0.0
        for i in active:
            fresh = float(_shrunk(gradient[i] + diagonal[i] * weights[i], ratio, positive_only)) / (diagonal[i] + 1.0 - ratio)
            step = fresh - weights[i]
            if step:
                row = slice(starts[i], starts[i + 1])
                gradient[cols[row]] -= step * vals[row]
                weights[i] = fresh
                moved = max(moved, abs(step))
        if moved <= _TOLERANCE * np.abs(weights).max(initial=0.0):
            return weights
    raise RuntimeError(f"no convergence in {_MAX_SWEEPS} sweeps: the last one still moved a weight by {moved}")


def coordinate_descent(
    square: np.ndarray, linear: np.ndarray, allowed: np.ndarray, ratio: float, positive_only: bool,
    start: np.ndarray | None = None,
) -> np.ndarray:
    """Minimise ``w'Gw/2 - w'c + ratio |w|_1 + (1 - ratio) |w|^2 / 2`` for every column c of
    ``linear`` at once, over the allowed coordinates, from ``start`` (default: 0) until no step exceeds
    the tolerance. A solve that does not get there is an error."""
    weights = np.zeros(linear.shape) if start is None else np.where(allowed, start, 0.0)
    curvature = np.diag(square) + (1.0 - ratio)
    active = np.flatnonzero(allowed.any(axis=1) & (curvature > 0))
    for _ in range(_MAX_SWEEPS):
        moved = 0.0
        for i in active:
            pull = linear[i] - square[i] @ weights + square[i, i] * weights[i]
            fresh = np.where(allowed[i], _shrunk(pull, ratio, positive_only) / curvature[i], 0.0)
            moved = max(moved, float(np.abs(fresh - weights[i]).max()))
            weights[i] = fresh
        if moved <= _TOLERANCE * np.abs(weights).max(initial=0.0):
            return weights
    raise RuntimeError(f"no convergence in {_MAX_SWEEPS} sweeps: the last one still moved a weight by {moved}")
