"""Whitening of integer vectors by a covariance put together from variances alone.

With exact squared centred values summed for every dimension and for the sum of every pair of
dimensions, Cov(a, b) = (Var(a + b) - Var(a) - Var(b)) / 2. Vectors are centred on the whole number
below the mean before anything is squared, sums are whole numbers, and the remainder of the mean
is taken out at the end, so the covariance is exact until it is rounded to doubles once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reclattice.llm.common import add_columns, written
from reclattice.llm.vectors import integer_vectors, matrix
from reclattice.session import ship_package

SCALE = 256.0
COMPONENTS = 4
# Sums travel as four limbs of 40 bits.
_LIMB = 40
_LIMBS = 4
_LONG = 2**63
# Rows centred and squared at a time.
_ROWS = 4096


@dataclass(frozen=True)
class Whitening:
    """A fit: n distinct vectors with sums S, components as rows, their eigenvalues and shares."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    axes: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None

    @property
    def dims(self) -> int:
        return len(self.sums)

    @property
    def centre(self) -> np.ndarray:
        """The whole number at or below the mean of every dimension."""
        return np.array([s // self.n for s in self.sums], dtype=np.int64)

    @property
    def remainder(self) -> list[int]:
        return [s % self.n for s in self.sums]

    @property
    def projection(self) -> np.ndarray:
        """Columns that turn centred vectors into whitened ones; nan where the eigenvalue is 0."""
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(self.values > 0, 1.0 / np.sqrt(self.values), np.nan)
        return self.axes.T * scale


def _limbs(name: str) -> str:
    return ", ".join(f"{name}{i} long" for i in range(_LIMBS))


def _split(values: list[int]) -> list[pa.Array]:
    """Whole numbers as limbs; the last one keeps the sign."""
    mask = (1 << _LIMB) - 1
    return [
        pa.array([(v >> (_LIMB * i)) if i == _LIMBS - 1 else (v >> (_LIMB * i)) & mask for v in values], pa.int64())
        for i in range(_LIMBS)
    ]


def _joined(row, name: str = "s") -> int:
    return sum(int(row[f"{name}{i}"]) << (_LIMB * i) for i in range(_LIMBS))


def _summed(df: DataFrame, key: str) -> dict[int, int]:
    """Exact sums per key; there are as many keys as dimensions or pairs of them."""
    sums = df.groupBy(key).agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(_LIMBS)])
    return {row[key]: _joined(row) for row in sums.collect()}


def _whole(values: np.ndarray, reach: int) -> np.ndarray:
    """Values as 64-bit integers when sums of them stay under ``reach`` < 2^63, as Python's else."""
    return values if reach < _LONG else values.astype(object)


def _sums(fit: DataFrame, dims: int) -> list[int]:
    def partial(batches):
        total = [0] * dims
        for batch in batches:
            x = matrix(batch.column(0), dims)
            reach = max(abs(int(x.min(initial=0))), int(x.max(initial=0))) * max(1, x.shape[0])
            total = [a + int(b) for a, b in zip(total, _whole(x, reach).sum(axis=0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), *_split(total)], names=["d", *[f"s{i}" for i in range(_LIMBS)]])

    found = _summed(fit.select("x").mapInArrow(partial, f"d int, {_limbs('s')}"), "d")
    return [found.get(d, 0) for d in range(dims)]


def _squares(fit: DataFrame, dims: int, centre: np.ndarray) -> dict[int, int]:
    """Sums of squared centred values: key ``a * dims + b`` for the sum of dimensions a < b, and
    ``a * dims + a`` for dimension a alone."""

    def partial(batches):
        total = [0] * (dims * dims)
        for batch in batches:
            every = matrix(batch.column(0), dims)
            for lo in range(0, every.shape[0], _ROWS):
                x = every[lo : lo + _ROWS]
                # Distances of 64-bit integers may need one bit more.
                far = max(abs(int(x.min()) - int(centre.max())), abs(int(x.max()) - int(centre.min())))
                fits = 4 * far * far * x.shape[0] < _LONG
                y = (x - centre if fits else x.astype(object) - centre.astype(object)).T.copy()
                for a in range(dims):
                    both = y[a] + y[a + 1 :]
                    squared = (both * both).sum(axis=1) if both.size else []
                    for b, s in zip(range(a, dims), [int((y[a] * y[a]).sum()), *squared], strict=True):
                        total[a * dims + b] += int(s)
        keys = [a * dims + b for a in range(dims) for b in range(a, dims)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int32()), *_split([total[k] for k in keys])], names=["p", *[f"s{i}" for i in range(_LIMBS)]]
        )

    return _summed(fit.select("x").mapInArrow(partial, f"p int, {_limbs('s')}"), "p")


def covariance(n: int, sums: list[int], squares: dict[int, int]) -> np.ndarray:
    """V from the sums of squared centred values, every entry rounded once."""
    dims = len(sums)
    rest = [s % n for s in sums]
    # n^2 times the variance; a pair's centred values add up to both remainders.
    alone = [n * squares[a * dims + a] - rest[a] ** 2 for a in range(dims)]
    out = np.empty((dims, dims))
    for a in range(dims):
        out[a, a] = alone[a] / (n * n)
        for b in range(a + 1, dims):
            both = n * squares[a * dims + b] - (rest[a] + rest[b]) ** 2
            out[a, b] = out[b, a] = (both - alone[a] - alone[b]) / (2 * n * n)
    return out


def fit_whitening(fit: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit on distinct integer vectors (x) of one length. None without vectors or dimensions."""
    ship_package(fit.sparkSession)
    found = fit.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).first()
    if not found["n"] or not found["d"]:
        return None
    n, dims = found["n"], found["d"]
    sums = _sums(fit, dims)
    centre = np.array([s // n for s in sums], dtype=np.int64)
    cov = covariance(n, sums, _squares(fit, dims, centre))
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:components]
    # What rounding alone can make of an eigenvalue of 0.
    nothing = dims * np.finfo(np.float64).eps * max(float(np.abs(values).max()), 0.0)
    top = np.where(values[order] > nothing, values[order], 0.0)
    trace = float(np.trace(cov))
    share = top / trace if trace > 0 else np.full(top.size, np.nan)
    made = Whitening(n, sums, cov, axes[:, order].T, top, share)
    return Whitening(n, sums, cov, made.axes, top, share, identity_error(fit, made))


def _whitened(model: Whitening, x: np.ndarray) -> np.ndarray:
    shift = np.array([r / model.n for r in model.remainder])
    centred = (x - model.centre).astype(np.float64) if np.abs(x).max(initial=0) < 2**62 else (x.astype(object) - model.centre.astype(object)).astype(np.float64)
    return (centred - shift) @ model.projection


def identity_error(fit: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the whitened fit vectors' covariance less the identity, measured
    on them; components of eigenvalue 0 are left out, None if there are no others."""
    good = np.flatnonzero(model.values > 0)
    if not good.size:
        return None
    size = good.size

    def partial(batches):
        total, first = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            w = _whitened(model, matrix(batch.column(0), model.dims))[:, good]
            total += w.T @ w
            first += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(size * size + size, dtype=np.int32)), pa.array(np.r_[total.ravel(), first])], names=["p", "s"]
        )

    parts = fit.select("x").mapInArrow(partial, "p int, s double").groupBy("p").agg(F.sum("s").alias("s")).collect()
    flat = np.zeros(size * size + size)
    for row in parts:
        flat[row["p"]] = row["s"]
    mean = flat[size * size :] / model.n
    cov = flat[: size * size].reshape(size, size) / model.n - np.outer(mean, mean)
    return float(np.abs(cov - np.eye(size)).max())


def transform(df: DataFrame, model: Whitening) -> DataFrame:
    """(id, x) with component, whitened, and ``deviation``: the sum over dimensions of
    (n * x - S)^2, exact; null where it does not fit a long."""
    columns = "found array<double>, deviation long"
    n, rest = model.n, np.array(model.remainder, dtype=object)
    fixed = int((rest * rest).sum())
    most = int(rest.max())

    def make():
        def step(lists):
            x = matrix(lists, model.dims)
            white = _whitened(model, x) if len(lists) else np.empty((0, model.values.size))
            far = int(np.abs(x).max(initial=0)) + int(np.abs(model.centre).max()) + 1
            exact = far * far * model.dims * n * n + 2 * n * far * most * model.dims + fixed < _LONG
            y = x - model.centre if exact else x.astype(object) - model.centre.astype(object)
            remains = rest.astype(np.int64) if exact else rest
            d = n * n * (y * y).sum(axis=1) - 2 * n * (y * remains).sum(axis=1) + fixed
            listed = [None if np.isnan(v).all() else [None if np.isnan(c) else float(c) for c in v] for v in white] if np.isnan(white).any() else list(white)
            return [pa.array(listed, pa.list_(pa.float64())), pa.array([int(v) if v < _LONG else None for v in d] if not exact else d, pa.int64())]

        return step

    added = add_columns(df.select("id", "x"), ["x"], columns, make)
    shares = F.array(*[F.lit(None if np.isnan(v) else float(v)).cast("double") for v in model.explained])
    blank = F.array_repeat(F.lit(None).cast("double"), model.values.size)
    return added.select("id", "deviation", F.posexplode(F.coalesce("found", blank)).alias("at", "whitened")).select(
        "id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"),
    )


def whiten(
    df: DataFrame, components: int = COMPONENTS, scale: float = SCALE, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every usable row.

    Vectors that are null or hold null or non-finite components are dropped, and so are vectors of
    another length than the one most rows have (ties: the longer), and empty ones. Components become
    ``floor(scale * c)``, which stops at the bounds of a long. The fit counts every distinct vector
    once; rows are all kept, repeated and null ids too. A component of eigenvalue 0 has null
    ``whitened``; without any variance ``explained`` and ``identity_error`` are null. An empty table
    gives no rows. Other columns are ignored.
    """
    spark = df.sparkSession
    rows = integer_vectors(df, scale, vec_id, embedding).filter(F.size("x") > 0)
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return spark.createDataFrame(
            [], f"id {dict(rows.dtypes)['id']}, component int, n long, deviation long, whitened double, explained double, identity_error double"
        )
    rows = rows.filter(F.size("x") == common["d"])
    fit = written(rows.select("x").distinct(), "distinct-vectors")
    return transform(rows, fit_whitening(fit, components))
