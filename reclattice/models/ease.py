"""EASE: closed-form ridge item-item model, ``B = -P / diag(P)`` with ``P = (X'X + l2 I)^-1``."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reclattice.models.base import Interactions, prepare
from reclattice.operators import tiles as T
from reclattice.operators.scoring import recommend_dense
from reclattice.session import checkpointed


@dataclass(frozen=True)
class EASE:
    """Configuration of the model; ``fit_predict`` never changes it.

    ``mask="zero"`` scores seen items 0 and keeps them as candidates;
    ``mask="remove"`` drops them. ``filter_already_liked_items=False`` does neither.
    """

    user: str = "user"
    item: str = "item"
    rating: str = "rating"
    l2_reg: float = 1.0
    top_k: int = 10
    filter_already_liked_items: bool = True
    binarize: bool = True
    mask: str = "zero"
    tile: int | None = None
    score_digits: int | None = None

    name = "EASE"

    def with_params(self, l2: float) -> "EASE":
        return replace(self, l2_reg=l2)

    def prepare(self, df: DataFrame) -> Interactions:
        return prepare(df, self.user, self.item, self.rating, self.binarize)

    def fit(self, data: Interactions) -> DataFrame:
        """Tiles ``(bi, bj, tile)`` of B."""
        if not self.l2_reg > 0:
            raise ValueError("EASE needs l2_reg > 0: the Gram matrix alone may be singular")
        n, width = data.n_items, self.tile or T.TILE
        if T.tile_count(n, width) == 1:
            if data.spectrum is not None:
                return _from_spectrum(data.spectrum, n, self.l2_reg)
            return T.pack(data.gram, n, width, self.l2_reg, _solved_tile)
        negative = T.negative_inverse(T.pack(data.gram, n, width, self.l2_reg), n, width)
        return _normalised(negative, n, width)

    def share(self, data: Interactions) -> None:
        """Factorise the Gram matrix once for all l2, if it fits one tile: with ``G = Q L Q'``, the
        inverse of ``G + l2 I`` is ``Q (L + l2 I)^-1 Q'``."""
        n, width = data.n_items, self.tile or T.TILE
        if data.spectrum is None and n and T.tile_count(n, width) == 1:
            data.spectrum = checkpointed(T.pack(data.gram, n, width, 0.0, _spectrum))

    def weights(self, data: Interactions) -> DataFrame:
        """Long form ``(i, j, b)`` over encoded items."""
        return T.entries(self.fit(data), data.n_items, self.tile or T.TILE)

    def recommend(self, data: Interactions) -> DataFrame:
        mask = self.mask if self.filter_already_liked_items else "none"
        width = self.tile or T.TILE
        top = recommend_dense(data, self.fit(data), width, self.top_k, mask, self.score_digits)
        return data.decoded(top)

    def fit_predict(self, df: DataFrame) -> DataFrame:
        return self.recommend(self.prepare(df))


def _weights_of(inverse: np.ndarray) -> np.ndarray:
    weights = np.nan_to_num(inverse / -np.diag(inverse))
    np.fill_diagonal(weights, 0.0)
    return weights


def _solved_tile(values: np.ndarray) -> np.ndarray:
    """B of a catalogue that fits one tile."""
    return _weights_of(np.linalg.inv(values))


def _spectrum(values: np.ndarray) -> np.ndarray:
    """Eigenvectors as columns, and the eigenvalues as one more row."""
    lengths, axes = np.linalg.eigh(values)
    return np.vstack([axes, np.maximum(lengths, 0.0)])


def _from_spectrum(spectrum: DataFrame, n_items: int, l2: float) -> DataFrame:
    def solve(batches):
        for batch in batches:
            for data in batch.column(0):
                both = np.frombuffer(data.as_buffer()).reshape(n_items + 1, n_items)
                axes, lengths = both[:-1], both[-1]
                yield T.tile_table(0, 0, _weights_of((axes / (lengths + l2)) @ axes.T)).to_batches()[0]

    return spectrum.select("tile").mapInArrow(solve, "bi long, bj long, tile binary")


def _normalised(negative: DataFrame, n_items: int, width: int) -> DataFrame:
    """``B[i,j] = -P[i,j] / P[j,j]`` with a zero diagonal, from the upper tiles of ``-P``.
    Every tile of a column stripe gets the diagonal tile of that stripe."""
    last = F.lit(T.tile_count(n_items, width) - 1).cast("long")

    def scale(table: pa.Table) -> pa.Table:
        bi, bj = T.first_valid(table, "bi"), T.first_valid(table, "bj")
        parts = dict(zip(table.column("role").to_pylist(), table.column("tile").to_pylist()))
        diagonal = T.tile_array(parts["diagonal"], bj, bj, n_items, width)
        own = diagonal if bi == bj else T.tile_array(parts["own"], bi, bj, n_items, width)
        weights = np.nan_to_num(own / -np.diag(diagonal))
        if bi == bj:
            np.fill_diagonal(weights, 0.0)
        return T.tile_table(bi, bj, weights)

    off_diagonal = negative.filter(F.col("bi") != F.col("bj"))
    own = T.mirrored(off_diagonal, n_items, width).withColumn("role", F.lit("own"))
    diagonal = negative.filter(F.col("bi") == F.col("bj")).select(
        F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("bi"),
        "bj", "tile", F.lit("diagonal").alias("role"),
    )
    return own.unionByName(diagonal).groupBy("bi", "bj").applyInArrow(scale, "bi long, bj long, tile binary")
