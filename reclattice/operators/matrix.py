"""User-item cells and the item-item Gram table ``X'X``, both in long form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reclattice.operators.ranking import HOT_KEYS_BROADCAST

# Users with more distinct items than this have their row cut into item tiles.
WIDE_ROW = 4096
# Products formed at once inside a task, and distinct item pairs held before they are sent on.
_PRODUCTS_AT_ONCE = 2_000_000
_PAIRS_HELD = 4_000_000

_GRAM_SCHEMA = "i long, j long, g double"


def user_item(df: DataFrame, user: str = "user", item: str = "item", rating: str = "rating") -> DataFrame:
    """Cells ``(u, i, v)``; repeated pairs are added up, explicit zeros stay. The sum is
    combined map-side, so copies of a pair never travel."""
    return df.groupBy(F.col(user).alias("u"), F.col(item).alias("i")).agg(
        F.sum(F.col(rating).cast("double")).alias("v")
    )


class _PairSums:
    """Sums of products per item pair, held in bounded memory. Products wait until there are as many
    as held sums, so adding them costs the same however few come at a time."""

    def __init__(self, n_items: int):
        self.n = n_items
        self.dense = np.zeros(n_items * n_items) if n_items * n_items <= _PAIRS_HELD else None
        self.codes = np.empty(0, np.int64)
        self.sums = np.empty(0)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_waiting = 0

    def add(self, codes: np.ndarray, products: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.waiting.append((codes, products))
        self.n_waiting += codes.size
        if self.n_waiting >= max(_PRODUCTS_AT_ONCE, self.codes.size):
            self._merge()
            if self.codes.size > _PAIRS_HELD:
                yield from self.drain()

    def _merge(self) -> None:
        codes, products = (np.concatenate(part) for part in zip((self.codes, self.sums), *self.waiting))
        self.waiting, self.n_waiting = [], 0
        if self.dense is not None:
            self.dense += np.bincount(codes, weights=products, minlength=self.dense.size)
        elif codes.size:
            order = np.argsort(codes, kind="stable")
            codes, products = codes[order], products[order]
            starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            self.codes, self.sums = codes[starts], np.add.reduceat(products, starts)

    def drain(self) -> Iterator[pa.RecordBatch]:
        self._merge()
        if self.dense is not None:
            self.codes = np.flatnonzero(self.dense)
            self.sums = self.dense[self.codes]
            self.dense[:] = 0.0
        if self.codes.size:
            yield _pair_batch(self.codes // self.n, self.codes % self.n, self.sums)
        self.codes, self.sums = np.empty(0, np.int64), np.empty(0)


def _add_products(
    held: _PairSums, i: np.ndarray, v: np.ndarray, partner: np.ndarray, reach: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """Add the products of every cell with the ``reach`` cells from ``partner`` on."""
    upto = np.cumsum(reach)
    total = upto[-1] if upto.size else 0
    cuts = np.searchsorted(upto, np.arange(_PRODUCTS_AT_ONCE, total, _PRODUCTS_AT_ONCE))
    bounds = np.unique(np.r_[0, cuts + 1, i.size])
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        each = reach[lo:hi]
        first = np.repeat(np.arange(lo, hi), each)
        second = np.repeat(partner[lo:hi] - (np.cumsum(each) - each), each) + np.arange(first.size)
        x, y = i[first], i[second]
        yield from held.add(np.minimum(x, y) * held.n + np.maximum(x, y), v[first] * v[second])


def _pair_batch(i: np.ndarray, j: np.ndarray, g: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(g, pa.float64())], names=["i", "j", "g"]
    )


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _outer_sums(n_items: int):
    """Task body: cells arrive sorted by (u, i); the upper-triangle products of each user
    are added per item pair, so a task sends item pairs, not one row per user and pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _PairSums(n_items)
        u = i = v = None

        def products(i, v, starts):
            sizes = np.diff(np.r_[starts, i.size])
            at = np.arange(i.size)
            yield from _add_products(held, i, v, at, np.repeat(starts + sizes, sizes) - at)

        for batch in batches:
            nu, ni, nv = _column(batch, "u"), _column(batch, "i"), _column(batch, "v")
            if u is not None and u.size:
                nu, ni, nv = np.concatenate([u, nu]), np.concatenate([i, ni]), np.concatenate([v, nv])
            if not nu.size:
                continue
            starts = np.flatnonzero(np.r_[True, nu[1:] != nu[:-1]])
            last = starts[-1]
            if starts.size > 1:
                yield from products(ni[:last], nv[:last], starts[:-1])
            u, i, v = nu[last:], ni[last:], nv[last:]
        if u is not None and u.size:
            yield from products(i, v, np.zeros(1, np.int64))
        yield from held.drain()

    return run


def _chunk_sums(n_items: int):
    """Task body for wide rows: cells arrive sorted by (u, a, b), where a and b are two chunks of
    the user's own list; the products between them are added per item pair. A batch's groups are
    multiplied together, since most users have few cells in a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _PairSums(n_items)
        names = ("u", "a", "b", "own", "i", "v")
        rest: list[np.ndarray] | None = None

        def products(starts, a, b, own, i, v):
            sizes = np.diff(np.r_[starts, i.size])
            group, end = np.repeat(np.arange(starts.size), sizes), np.repeat(starts + sizes, sizes)
            # Chunk a before chunk b; within one chunk each pair is made once, the smaller item first.
            right = own != a
            order = np.lexsort((i, right, group))
            a, b, i, v, right = a[order], b[order], i[order], v[order], right[order]
            at = np.arange(i.size)
            lefts = np.add.reduceat((~right).astype(np.int64), starts)
            partner = np.where(a == b, at, np.repeat(starts + lefts, sizes))
            yield from _add_products(held, i, v, partner, np.where(right, 0, end - partner))

        for batch in batches:
            now = [_column(batch, name) for name in names]
            if rest is not None:
                now = [np.concatenate(pair) for pair in zip(rest, now)]
            u, a, b = now[:3]
            if not u.size:
                continue
            starts = np.flatnonzero(np.r_[True, (u[1:] != u[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            if starts.size > 1:
                yield from products(starts[:-1], *[c[: starts[-1]] for c in now[1:]])
            rest = [c[starts[-1] :] for c in now]
        if rest is not None and rest[0].size:
            yield from products(np.zeros(1, np.int64), *rest[1:])
        yield from held.drain()

    return run


def gram(x: DataFrame, n_items: int, wide_row: int = WIDE_ROW, by_user: bool = False) -> DataFrame:
    """Upper triangle (``i <= j``) of ``X'X`` as ``(i, j, g)`` with ``g = sum_u v_ui * v_uj``.

    ``x`` has one row per (u, i) with ``i`` a dense index. Work is the sum of squared row
    lengths, whatever the catalogue: a row wider than ``wide_row`` is cut into chunks of about
    that many cells by a hash of the item, and each pair of chunks is its own piece of work, so
    one very active user is spread over the cluster. With ``by_user`` the rows already lie by user
    and item and are not shuffled again.
    """
    narrow, wide_part = x, None
    if n_items > wide_row:
        wide = x.groupBy("u").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > wide_row)
        count = wide.count()
        if count:
            side = F.broadcast(wide) if count <= HOT_KEYS_BROADCAST else wide
            by_user = by_user and count <= HOT_KEYS_BROADCAST
            narrow = x.join(side, "u", "left_anti")
            chunks = F.ceil(F.col("_n") / wide_row)
            pieces = (
                x.join(side, "u")
                .withColumn("own", F.pmod(F.xxhash64("i"), chunks))
                .withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
                .select("u", "i", "v", "own", F.least("own", "_other").alias("a"), F.greatest("own", "_other").alias("b"))
                .repartition("u", "a", "b")
                .sortWithinPartitions("u", "a", "b")
            )
            wide_part = pieces.mapInArrow(_chunk_sums(n_items), _GRAM_SCHEMA)
    narrow = narrow.select("u", "i", "v")
    if not by_user:
        narrow = narrow.repartition("u").sortWithinPartitions("u", "i")
    sums = narrow.mapInArrow(_outer_sums(n_items), _GRAM_SCHEMA)
    if wide_part is not None:
        sums = sums.unionByName(wide_part)
    return sums.groupBy("i", "j").agg(F.sum("g").alias("g"))


def with_ridge(upper: DataFrame, n_items: int, l2: float) -> DataFrame:
    """Add ``l2`` to the diagonal, creating diagonal entries where none exist."""
    diagonal = upper.sparkSession.range(n_items).select(
        F.col("id").alias("i"), F.col("id").alias("j"), F.lit(float(l2)).alias("g")
    )
    return upper.unionByName(diagonal).groupBy("i", "j").agg(F.sum("g").alias("g"))


def both_triangles(upper: DataFrame) -> DataFrame:
    """Symmetric long form from the upper triangle."""
    mirrored = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j", "g"))).otherwise(
        F.array(F.struct("i", "j", "g"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), F.col("g")))
    )
    return upper.select(F.inline(mirrored))
