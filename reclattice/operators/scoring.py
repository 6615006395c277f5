"""Scores and top-k of users against an item-item or a factor model.

Cells stay where they are: partitioned and sorted by user (see ``models.base``). A sparse model within
a bound is broadcast whole; of a larger one each block of users is sent the rows of its items, packed, each once, and
it never passes the driver. A dense model is made once, kept in a checkpoint, and cut into column stripes
of counted size. One stripe at a time is broadcast and every task walks its users past it, so neither
the cells nor a users x items table is ever shuffled, and no plan holds a copy of the model per block of
users. Only the k best of a user leave a task; with several stripes they are merged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from reclattice.operators.ranking import top_k, union_all
from reclattice.operators.tiles import tile_array
from reclattice.session import BROADCAST_BYTES, checkpointed, parallelism, scratch_path, shuffle_partitions

# Scores are rounded before ranking, so the item order, not the summation order, breaks ties: to
# this many digits below the largest score that the user's cells could have under the model.
RELATIVE_DIGITS = 10
# Small enough that the passes over a batch of scores stay in the processor cache.
_SCORES_AT_ONCE = 500_000
# Cells a task gathers before it scores their users.
_CELLS_AT_ONCE = 200_000
# A dense array of scores is used while it has at most this many entries per product.
_DENSE_SHARE = 8
# Column stripes whose lists are merged together.
_STRIPES_PER_MERGE = 8
# Cells in a block of users, and users scored at once, against factors.
_CELLS_PER_BLOCK = 1_000_000
_USERS_AT_ONCE = 2048
# Items of a first step past the item factors; each step is twice the one before.
_FIRST_ITEMS = 256
# Items in a group of similar direction, passes that form the groups, vectors compared with the axes at
# once, and what rounding may take from the cosine of an angle.
_ITEMS_PER_GROUP = 256
_GROUP_ROUNDS = 3
_VECTORS_AT_ONCE = 8192
_ANGLE_ERROR = 1e-7
# Bytes of one sparse weight in a stripe.
_WEIGHT_BYTES = 16
# Weights packed into one message (at least one row of the model), cells that a task takes at once beside such rows,
# weights whose rows are put together in one task, and products that a task is meant for.
_PIECE = 500_000
_PACKED_AT_ONCE = 10_000
_WEIGHTS_PER_HOME = 2_000_000
_PRODUCTS_PER_TASK = 4_000_000


def best_per_row(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Column index and value of the ``k`` best of each row, best first, ties by column.
    Entries at -inf may be among them; the caller drops those."""
    k = min(k, scores.shape[1])
    low = -scores
    bound = np.partition(low, k - 1, axis=1)[:, k - 1 : k]
    surely = low < bound
    tied = low == bound
    room = k - surely.sum(axis=1, keepdims=True)
    chosen = surely | (tied & (np.cumsum(tied, axis=1) <= room))
    cols = np.nonzero(chosen)[1].reshape(-1, k)
    vals = np.take_along_axis(scores, cols, axis=1)
    order = np.argsort(-vals, axis=1, kind="stable")
    return np.take_along_axis(cols, order, axis=1), np.take_along_axis(vals, order, axis=1)


def score_unit(largest: np.ndarray) -> np.ndarray:
    """Power of ten at or above ``largest``; 1 where that is 0."""
    with np.errstate(divide="ignore"):
        return np.where(largest > 0, 10.0 ** np.ceil(np.log10(largest)), 1.0)


def rounded_scores(scores: np.ndarray, digits: int | None, largest: np.ndarray | None = None) -> np.ndarray:
    """Rounded to ``digits`` decimals, or relative to ``largest`` of each row (default: its own)."""
    if digits is not None:
        return np.round(scores, digits)
    unit = score_unit(np.abs(scores).max(axis=1) if largest is None else largest)[:, None]
    return np.round(scores / unit, RELATIVE_DIGITS) * unit


# ---------------------------------------------------------------- whole users from sorted cells


@dataclass
class UserRows:
    """Cells of some whole users: user r has ``i[starts[r]:starts[r + 1]]`` and the same of ``v``."""

    users: pa.Array
    starts: np.ndarray
    i: np.ndarray
    v: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.users)), np.diff(self.starts))

    def part(self, lo: int, hi: int) -> "UserRows":
        a, b = self.starts[lo], self.starts[hi]
        return UserRows(self.users.slice(lo, hi - lo), self.starts[lo : hi + 1] - a, self.i[a:b], self.v[a:b])


def _whole_users(batches: Iterator[pa.RecordBatch], at_once: int) -> Iterator[tuple[pa.Table, pa.Array, np.ndarray]]:
    """Rows sorted by ``u`` as (table, users, starts) of whole users, about ``at_once`` rows each."""

    def found(table: pa.Table) -> tuple[pa.Table, pa.Array, np.ndarray]:
        table = table.combine_chunks()
        coded = table["u"].combine_chunks().dictionary_encode(null_encoding="encode")
        code = coded.indices.to_numpy(zero_copy_only=False)
        return table, coded.dictionary, np.searchsorted(code, np.arange(len(coded.dictionary) + 1))

    held: list[pa.RecordBatch] = []
    count, wanted = 0, at_once
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= wanted:
            table, users, starts = found(pa.Table.from_batches(held))
            last = int(starts[-2])
            if last:
                yield table.slice(0, last), users.slice(0, len(users) - 1), starts[:-1]
            # The last user may go on in the next batch.
            rest = table.slice(last).combine_chunks()
            held, count = rest.to_batches(), rest.num_rows
            wanted = max(at_once, 2 * count)
    if count:
        yield found(pa.Table.from_batches(held))


def user_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[UserRows]:
    """Cells (u, i, v) sorted by user, as blocks of whole users."""
    for table, users, starts in _whole_users(batches, _CELLS_AT_ONCE):
        yield UserRows(users, starts, table["i"].to_numpy(), table["v"].to_numpy())


# ---------------------------------------------------------------- stripes of a model


@dataclass
class DenseStripe:
    """All rows of columns ``first`` to ``first + width`` of a dense model."""

    first: int
    values: np.ndarray

    @property
    def width(self) -> int:
        return self.values.shape[1]

    @property
    def largest(self) -> float:
        return float(np.abs(self.values).max(initial=0.0))

    def sizes(self, rows: UserRows) -> np.ndarray:
        return np.full(len(rows.users), self.width)

    def product(self, rows: UserRows) -> np.ndarray:
        """A matrix product when the rows are well filled, otherwise a sum of the few model rows
        each user touches."""
        m, n_items = len(rows.users), self.values.shape[0]
        if rows.i.size * 16 > m * n_items:
            dense = np.zeros((m, n_items))
            dense[rows.row, rows.i] = rows.v
            return dense @ self.values
        out = np.empty((m, self.width))
        for r in range(m):
            a, b = rows.starts[r], rows.starts[r + 1]
            out[r] = rows.v[a:b] @ self.values[rows.i[a:b]]
        return out


@dataclass
class SparseStripe:
    """Weights of columns ``first`` to ``first + width``, in rows: item i has
    ``cols[starts[i]:starts[i + 1]]``, counted from ``first``."""

    first: int
    width: int
    starts: np.ndarray
    cols: np.ndarray
    vals: np.ndarray

    @property
    def largest(self) -> float:
        return float(np.abs(self.vals).max(initial=0.0))

    def sizes(self, rows: UserRows) -> np.ndarray:
        """Products of every user."""
        upto = np.r_[0, np.cumsum(np.diff(self.starts)[rows.i])]
        return np.diff(upto[rows.starts])

    def products(self, rows: UserRows) -> tuple[np.ndarray, np.ndarray]:
        """Code ``row * width + column`` and value of every product of a cell and a weight."""
        each = np.diff(self.starts)[rows.i]
        at = np.repeat(self.starts[rows.i] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        code = np.repeat(rows.row, each) * self.width + self.cols[at]
        return code, np.repeat(rows.v, each) * self.vals[at]


def dense_stripes(tiles: DataFrame, n_items: int, tile: int, bytes_at_most: int) -> Iterator[DenseStripe]:
    """Columns of a tile table, as many at a time as ``bytes_at_most`` allows."""
    width = int(max(1, min(tile, bytes_at_most // (8 * max(n_items, 1)))))

    def cut(batches):
        for batch in batches:
            for bi, bj, data in zip(*(batch.column(n) for n in ("bi", "bj", "tile"))):
                bi, bj = bi.as_py(), bj.as_py()
                values = tile_array(data.as_buffer(), bi, bj, n_items, tile)
                for lo in range(0, values.shape[1], width):
                    part = np.ascontiguousarray(values[:, lo : lo + width])
                    yield pa.RecordBatch.from_pydict({"bi": [bi], "first": [bj * tile + lo], "part": [part.tobytes()]})

    edges = sorted({f for bj in range(0, n_items, tile) for f in range(bj, min(n_items, bj + tile), width)})
    whole = tiles.select("bi", (F.col("bj") * tile).alias("first"), F.col("tile").alias("part"))
    parts = whole if width >= min(tile, n_items) else tiles.mapInArrow(cut, "bi long, first long, part binary")
    if len(edges) > 1:
        parts = _by_stripe(parts, "first")
    for first, end in zip(edges, [*edges[1:], n_items], strict=True):
        values = np.empty((n_items, end - first))
        found = parts.filter(F.col("first") == first).select("bi", "part").toArrow()
        for bi, part in zip(found["bi"].to_pylist(), found["part"], strict=True):
            block = np.frombuffer(part.as_buffer()).reshape(-1, end - first)
            values[bi * tile : bi * tile + block.shape[0]] = block
        yield DenseStripe(first, values)


def _by_stripe(df: DataFrame, column: str) -> DataFrame:
    """``df`` as a table with one folder per stripe, so reading a stripe reads no other."""
    path = scratch_path(df.sparkSession, "stripes")
    df.write.partitionBy(column).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sparse_stripe(weights: DataFrame, n_items: int) -> SparseStripe:
    """All weights (i, j, b) as one stripe, on the driver."""
    found = weights.select("i", "j", "b").toArrow()
    i, j, b = (found[n].to_numpy() for n in ("i", "j", "b"))
    order = np.lexsort((j, i))
    return SparseStripe(0, n_items, np.searchsorted(i[order], np.arange(n_items + 1)), j[order], b[order])


# ---------------------------------------------------------------- large sparse models


def _narrow(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on, in as many bytes as the largest needs, first bytes first."""
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + planes.tobytes()


def _wide(data: memoryview, many: int) -> tuple[np.ndarray, memoryview]:
    """The numbers that ``_narrow`` packed, and the rest of the bytes."""
    width = data[0]
    wide = np.zeros((many, 8), np.uint8)
    wide[:, :width] = np.frombuffer(data[1 : 1 + width * many], np.uint8).reshape(width, many).T
    return wide.view("<i8").ravel(), data[1 + width * many :]


def pack_weights(i: np.ndarray, j: np.ndarray, b: np.ndarray) -> bytes:
    """Weights in order of (i, j), none twice, as bytes: gaps between the items, values by their place among the
    different ones where these are few. Nothing is rounded."""
    first = np.r_[True, i[1:] != i[:-1]] if i.size else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    known, code = np.unique(b.view(np.int64), return_inverse=True)
    if many := known.size <= 256:
        values = known.tobytes() + code.astype(np.uint8).tobytes()
    else:
        values = np.ascontiguousarray(b.view(np.uint8).reshape(-1, 8).T).tobytes()
    head = np.array([i.size, starts.size, known.size if many else 0], np.int64).tobytes()
    gaps = np.where(first, j, j - np.r_[0, j[:-1]])
    rows = _narrow(np.diff(i[starts], prepend=0)) + _narrow(np.diff(np.r_[starts, i.size]))
    data = head + rows + _narrow(gaps) + values
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def unpack_weights(packed: pa.Buffer) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(items, weights of each, j, b) of packed weights."""
    data = pa.decompress(packed.slice(8), int.from_bytes(packed.slice(0, 8).to_pybytes(), "little"), "zstd")
    size, rows, known = np.frombuffer(data, np.int64, 3).tolist()
    items, rest = _wide(memoryview(data)[24:], rows)
    each, rest = _wide(rest, rows)
    gaps, rest = _wide(rest, size)
    upto = np.cumsum(gaps)
    starts = np.cumsum(each) - each
    j = upto - np.repeat(upto[starts] - gaps[starts], each)
    if known:
        b = np.frombuffer(rest[: 8 * known], np.float64)[np.frombuffer(rest[8 * known :], np.uint8)]
    else:
        b = np.ascontiguousarray(np.frombuffer(rest, np.uint8).reshape(8, -1).T).view(np.float64).ravel()
    return np.cumsum(items), each, j, b


def _ranges(first: np.ndarray, each: np.ndarray) -> np.ndarray:
    """``first[0], first[0] + 1, ...``, ``each[0]`` of them, then the same of the next."""
    return np.repeat(first - (np.cumsum(each) - each), each) + np.arange(each.sum())


def _gathered(batches: Iterator[pa.RecordBatch], at_once: int) -> Iterator[pa.Table]:
    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= at_once:
            yield pa.Table.from_batches(held)
            held, count = [], 0
    if count:
        yield pa.Table.from_batches(held)


_SENT = "to int, routes boolean, packed binary"


def _sent(to: list[int], routes: bool, packed: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(to, pa.int32()), pa.array([routes] * len(to), pa.bool_()), pa.array(packed, pa.binary())],
        names=["to", "routes", "packed"],
    )


def _runs(of: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, start, end) of every run of equal values."""
    starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if of.size else np.empty(0, np.int64)
    return list(zip(of[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), of.size]))


def _cuts(each: np.ndarray) -> Iterator[tuple[int, int]]:
    """Rows in parts of about ``_PIECE`` weights; a part has at least one row."""
    upto, lo = np.r_[0, np.cumsum(each)], 0
    while lo < each.size:
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + _PIECE, side="right")) - 1)
        yield lo, hi
        lo = hi


def rows_of_blocks(cells: DataFrame, weights: DataFrame, n_weights: int, n_items: int, blocks: int) -> DataFrame:
    """(to, packed): the rows of weights (i, j, b), each once for every block ``to`` of users with a cell (block, i).

    Weights and the blocks that need an item meet at the item's home, packed by home, so that one shuffle moves either."""
    homes = max(shuffle_partitions(cells.sparkSession), -(-n_weights // _WEIGHTS_PER_HOME))
    per = -(-n_items // homes)

    def placed(i: np.ndarray) -> np.ndarray:
        return i % homes * per + i // homes

    def of_weights(batches):
        for table in _gathered(batches, _WEIGHTS_PER_HOME):
            i, j, b = (table[n].to_numpy() for n in ("i", "j", "b"))
            order = np.argsort(placed(i) * n_items + j, kind="stable")
            i, j, b = i[order], j[order], b[order]
            for home, lo, hi in _runs(i % homes):
                yield _sent([home], False, [pack_weights(i[lo:hi], j[lo:hi], b[lo:hi])])

    def of_cells(batches):
        for table in _gathered(batches, _WEIGHTS_PER_HOME):
            code = np.unique(placed(table["i"].to_numpy()) * blocks + table["block"].to_numpy())
            at, block = np.divmod(code, blocks)
            for home, lo, hi in _runs(at // per):
                # As weights of 1 from items to blocks.
                own = at[lo:hi] % per * homes + home
                yield _sent([home], True, [pack_weights(own, block[lo:hi], np.ones(hi - lo))])

    def met(batches):
        found, wanted = [], []
        for batch in batches:
            for routes, packed in zip(batch.column("routes").to_pylist(), batch.column("packed")):
                i, each, j, b = unpack_weights(packed.as_buffer())
                if routes:
                    wanted.append((np.repeat(i, each), j))
                else:
                    found.append((np.repeat(i, each), j, b))
        if not found or not wanted:
            return
        i, j, b = (np.concatenate(x) for x in zip(*found))
        found.clear()
        order = np.argsort(placed(i) * n_items + j, kind="stable")
        i, j, b = i[order], j[order], b[order]
        items, starts = np.unique(i, return_index=True)
        each = np.diff(np.r_[starts, i.size])
        need, block = (np.concatenate(x) for x in zip(*wanted))
        wanted.clear()
        code = np.unique(block * n_items + need)
        block, need = np.divmod(code, n_items)
        at = np.minimum(np.searchsorted(items, need), items.size - 1)
        known = items[at] == need
        block, at = block[known], at[known]
        for to, lo, hi in _runs(block):
            mine = at[lo:hi]
            for a, z in _cuts(each[mine]):
                rows = mine[a:z]
                which = _ranges(starts[rows], each[rows])
                yield _sent([to], False, [pack_weights(i[which], j[which], b[which])])

    typed = weights.select(*[F.col(c).cast(t).alias(c) for c, t in (("i", "long"), ("j", "long"), ("b", "double"))])
    sent = typed.mapInArrow(of_weights, _SENT).unionByName(cells.select("block", "i").mapInArrow(of_cells, _SENT))
    return sent.repartitionById(homes, "to").mapInArrow(met, _SENT).select("to", "packed")


def _beside_rows(data, weights: DataFrame, n_weights: int, each: Callable, schema: T.StructType) -> DataFrame:
    """``each(rows, code, s)`` on blocks of whole users: their cells, and code ``row * n_items + column``
    and sum of every scored pair. The model's rows travel, packed, once to each block of users that has a cell of
    their item; nothing passes the driver."""
    n_items, spark = data.n_items, data.cells.sparkSession
    products = n_weights * data.n_cells // max(n_items, 1)
    blocks = max(shuffle_partitions(spark), -(-products // _PRODUCTS_PER_TASK))
    block = F.pmod(F.xxhash64("u"), F.lit(blocks)).cast("int")
    cells = data.cells.select(block.alias("block"), "u", "i", "v")
    rows = rows_of_blocks(cells, weights, n_weights, n_items, blocks).withColumnRenamed("to", "block")
    met = rows.unionByName(cells, allowMissingColumns=True).repartitionById(blocks, "block")
    by_user = met.select("packed", "u", "i", "v").sortWithinPartitions(F.col("packed").isNull(), "u", "i")

    def task(batches):
        found, first, stripe = [], [], None

        def made() -> tuple[np.ndarray, SparseStripe]:
            """The items that have weights, in order, and their rows; one more row is empty."""
            parts = list(zip(*found)) or [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
            items, many, j, b = (np.concatenate(x) for x in parts)
            found.clear()
            order = np.argsort(items, kind="stable")
            which = _ranges((np.cumsum(many) - many)[order], many[order])
            own, starts = np.unique(items[order], return_index=True)
            upto = np.r_[0, np.cumsum(many[order])]
            return own, SparseStripe(0, n_items, np.r_[upto[starts], upto[-1], upto[-1]], j[which], b[which])

        def only_cells():
            # Rows come first; a batch may hold the last of them and the first cells.
            for batch in batches:
                packed = batch.column("packed")
                rows_here = len(batch) - packed.null_count
                for one in packed.slice(0, rows_here):
                    i, many, j, b = unpack_weights(one.as_buffer())
                    found.append((i, many, j.astype(place), b))
                if rows_here < len(batch):
                    yield batch.slice(rows_here)

        for table, users, starts in _whole_users(only_cells(), _PACKED_AT_ONCE):
            if stripe is None:
                first, stripe = made()
            i, v = table["i"].to_numpy(), table["v"].to_numpy()
            at = np.minimum(np.searchsorted(first, i), max(first.size - 1, 0))
            here = first[at] == i if first.size else np.zeros(i.size, bool)
            local = UserRows(users, starts, np.where(here, at, first.size), v)
            lo = 0
            for part in _in_parts(local, stripe):
                hi = lo + len(part.users)
                a, z = starts[lo], starts[hi]
                yield each(UserRows(part.users, part.starts, i[a:z], v[a:z]), *_added(*stripe.products(part)))
                lo = hi

    place = np.int32 if n_items < 1 << 31 else np.int64
    return by_user.mapInArrow(task, schema)


# ---------------------------------------------------------------- lists


def _table(users: pa.Array, row: np.ndarray, cols: np.ndarray, vals: np.ndarray, rank: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [users.take(pa.array(row)), pa.array(cols, pa.int64()), pa.array(vals + 0.0, pa.float64()), pa.array(rank, pa.int32())],
        names=["u", "i", "scores", "rank"],
    )


def _schema(cells: DataFrame) -> T.StructType:
    return T.StructType([
        T.StructField("u", cells.schema["u"].dataType), T.StructField("i", T.LongType()),
        T.StructField("scores", T.DoubleType()), T.StructField("rank", T.IntegerType()),
    ])


def _positions(row: np.ndarray) -> np.ndarray:
    """Position of every entry in its run of equal rows, from 0."""
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if row.size else np.empty(0, np.int64)
    return np.arange(row.size) - np.repeat(starts, np.diff(np.r_[starts, row.size]))


class Lists:
    """The k best of whole users against one stripe, under a mask on seen items."""

    def __init__(self, k: int, mask: str, digits: int | None, largest: float, scored_only: bool = False):
        self.k, self.mask, self.digits, self.largest, self.scored_only = k, mask, digits, largest, scored_only

    def _reach(self, rows: UserRows) -> np.ndarray:
        """Largest score that each user's cells could have."""
        return np.add.reduceat(np.abs(rows.v), rows.starts[:-1]) * self.largest

    def _seen(self, rows: UserRows, stripe) -> tuple[np.ndarray, np.ndarray]:
        here = (rows.i >= stripe.first) & (rows.i < stripe.first + stripe.width) & (rows.v != 0)
        return rows.row[here], rows.i[here] - stripe.first

    def dense(self, rows: UserRows, stripe, scores: np.ndarray) -> pa.RecordBatch:
        """Lists from an array of scores, -inf for items that are no candidate."""
        scores = rounded_scores(scores, self.digits, self._reach(rows))
        if self.mask != "none":
            scores[self._seen(rows, stripe)] = 0.0 if self.mask == "zero" else -np.inf
        cols, vals = best_per_row(scores, self.k)
        keep = np.isfinite(vals)
        rank = np.broadcast_to(np.arange(1, vals.shape[1] + 1), vals.shape)
        who = np.repeat(np.arange(vals.shape[0]), vals.shape[1])[keep.ravel()]
        return _table(rows.users, who, cols[keep] + stripe.first, vals[keep], rank[keep])

    def sparse(self, rows: UserRows, stripe: SparseStripe, code: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
        """The same from the scored pairs alone (codes in order, each once). Items without a score
        count as 0 and stand in item order between positive and negative ones."""
        row, col = np.divmod(code, stripe.width)
        if self.digits is None:
            unit = score_unit(self._reach(rows))[row]
            s = np.round(s / unit, RELATIVE_DIGITS) * unit
        else:
            s = np.round(s, self.digits)
        gone = np.empty(0, np.int64)
        if self.mask != "none":
            r, c = self._seen(rows, stripe)
            seen = np.unique(r * stripe.width + c)
            free = ~np.isin(code, seen, assume_unique=True)
            code, row, col, s = code[free], row[free], col[free], s[free]
            gone = seen if self.mask == "remove" else gone
        some = np.ones(s.size, bool) if self.scored_only else s > 0
        order = np.lexsort((col[some], -s[some], row[some]))
        best = np.flatnonzero(some)[order]
        best = best[_positions(row[best]) < self.k]
        who, cols, vals = row[best], col[best], s[best]
        if not self.scored_only:
            who, cols, vals = self._filled(rows, stripe, (code, row, col, s), gone, (who, cols, vals))
        return _table(rows.users, who, cols + stripe.first, vals, _positions(who) + 1)

    def _filled(self, rows, stripe, pairs, gone, best):
        """Lists shorter than k go on with free items at 0, then with negative scores."""
        code, row, col, s = pairs
        who, cols, vals = best
        width, wanted = stripe.width, min(self.k, stripe.width)
        have = np.bincount(who, minlength=len(rows.users))
        scored = code[s != 0]
        extra: list[tuple[int, np.ndarray, np.ndarray]] = []
        for r in np.flatnonzero(have < wanted):
            need = wanted - have[r]
            edges = np.array([r * width, (r + 1) * width])
            taken = [part[slice(*np.searchsorted(part, edges))] - r * width for part in (scored, gone)]
            taken = np.unique(np.concatenate(taken))
            first = np.arange(min(width, need + taken.size))
            free = first[~np.isin(first, taken, assume_unique=True)][:need]
            extra.append((r, free, np.zeros(free.size)))
            if free.size < need:
                mine = slice(*np.searchsorted(code, edges))
                under = np.flatnonzero(s[mine] < 0)
                under = under[np.lexsort((col[mine][under], -s[mine][under]))][: need - free.size]
                extra.append((r, col[mine][under], s[mine][under]))
        if not extra:
            return who, cols, vals
        who = np.concatenate([who, *[np.full(c.size, r) for r, c, _ in extra]])
        order = np.argsort(who, kind="stable")
        return (
            who[order], np.concatenate([cols, *[c for _, c, _ in extra]])[order],
            np.concatenate([vals, *[v for _, _, v in extra]])[order],
        )


def _in_parts(rows: UserRows, stripe) -> Iterator[UserRows]:
    """Users in parts of a bounded amount of work; a part has at least one user."""
    upto = np.r_[0, np.cumsum(np.maximum(stripe.sizes(rows), 1))]
    lo = 0
    while lo < len(rows.users):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + _SCORES_AT_ONCE, side="right")) - 1)
        yield rows.part(lo, hi)
        lo = hi


def _dense_lists(stripe: DenseStripe, lists: Lists) -> Callable:
    def task(batches):
        for rows in user_rows(batches):
            for part in _in_parts(rows, stripe):
                yield lists.dense(part, stripe, stripe.product(part))

    return task


def _added(code: np.ndarray, products: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes in order, each once, and the sums of their products."""
    order = np.argsort(code, kind="stable")
    code = code[order]
    starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if code.size else np.empty(0, np.int64)
    return code[starts], np.add.reduceat(products[order], starts) if code.size else products


def _sparse_lists(stripe: SparseStripe, lists: Lists) -> Callable:
    def task(batches):
        for rows in user_rows(batches):
            for part in _in_parts(rows, stripe):
                code, products = stripe.products(part)
                cells = len(part.users) * stripe.width
                if cells <= _DENSE_SHARE * code.size:
                    scores = np.bincount(code, weights=products, minlength=cells)
                    if lists.scored_only:
                        scores[np.bincount(code, minlength=cells) == 0] = -np.inf
                    yield lists.dense(part, stripe, scores.reshape(len(part.users), stripe.width))
                else:
                    yield lists.sparse(part, stripe, *_added(code, products))

    return task


def _past_stripes(cells: DataFrame, stripes: Iterator, make: Callable, n_items: int, k: int) -> DataFrame:
    """Lists of all users, one broadcast stripe at a time. A single stripe needs no merge, since its
    task sees every item of a user."""
    spark = cells.sparkSession
    kept: list[DataFrame] = []
    if not n_items:
        return spark.createDataFrame([], _schema(cells))

    def merged(parts: list[DataFrame]) -> DataFrame:
        return top_k(union_all(parts).drop("rank"), ["u"], [F.desc("scores"), F.col("i")], k)

    for stripe in stripes:
        sent = spark.sparkContext.broadcast(stripe)
        found = cells.select("u", "i", "v").mapInArrow(_with(sent, make), _schema(cells))
        if stripe.width == n_items:
            return found
        kept.append(checkpointed(found))
        sent.unpersist()
        if len(kept) > _STRIPES_PER_MERGE:
            kept = [checkpointed(merged(kept).select("u", "i", "scores", "rank"))]
    return merged(kept)


def _with(sent, make: Callable) -> Callable:
    def task(batches):
        yield from make(sent.value)(batches)

    return task


def recommend_dense(
    data, weights: DataFrame, width: int, k: int, mask: str, digits: int | None = None,
    bytes_at_most: int = BROADCAST_BYTES,
) -> DataFrame:
    """Top ``k`` of ``S = X B`` per user for a dense B given as tiles of ``width``, as (u, i, scores,
    rank). ``data.cells`` is partitioned and sorted by user."""
    # One stripe is read once; more are read from the checkpoint, the largest entry first.
    whole = data.n_items <= min(width, bytes_at_most // (8 * max(data.n_items, 1)))
    tiles = weights if whole else checkpointed(weights)
    largest = None if whole else _largest_entry(tiles)

    def make(stripe: DenseStripe):
        return _dense_lists(stripe, Lists(k, mask, digits, stripe.largest if largest is None else largest))

    stripes = dense_stripes(tiles, data.n_items, width, bytes_at_most)
    return _past_stripes(data.cells, stripes, make, data.n_items, k)


def _largest_entry(tiles: DataFrame) -> float:
    def largest(batches):
        for batch in batches:
            found = [float(np.abs(np.frombuffer(t.as_buffer())).max(initial=0.0)) for t in batch.column(0)]
            yield pa.RecordBatch.from_pydict({"m": pa.array(found, pa.float64())})

    return tiles.select("tile").mapInArrow(largest, "m double").agg(F.max("m")).first()[0] or 0.0


def recommend_sparse(
    data, weights: DataFrame, n_weights: int, k: int, mask: str, digits: int | None = None,
    scored_only: bool = False, bytes_at_most: int = BROADCAST_BYTES,
) -> DataFrame:
    """Top ``k`` of ``S = X W`` per user for a sparse W given as (i, j, b), as (u, i, scores, rank).

    Each user's row is multiplied with the model's rows in one task, to which of a model above
    ``bytes_at_most`` the rows of its users' items travel, and only its k best leave the task. Items without a score count as 0 and stand in item order between positive and
    negative ones, as in a dense ranking; with ``scored_only`` they are left out. ``data.cells`` is partitioned
    and sorted by user.
    """
    if not data.n_items:
        return data.cells.sparkSession.createDataFrame([], _schema(data.cells))
    if n_weights * _WEIGHT_BYTES <= bytes_at_most:
        def make(stripe: SparseStripe):
            return _sparse_lists(stripe, Lists(k, mask, digits, stripe.largest, scored_only))

        return _past_stripes(data.cells, iter([sparse_stripe(weights, data.n_items)]), make, data.n_items, k)
    lists = Lists(k, mask, digits, weights.agg(F.max(F.abs("b"))).first()[0] or 0.0, scored_only)
    every = SparseStripe(0, data.n_items, *[np.empty(0)] * 3)

    def best(rows: UserRows, code: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
        return lists.sparse(rows, every, code, s)

    return _beside_rows(data, weights, n_weights, best, _schema(data.cells))


def score_pairs(
    data, weights: DataFrame, n_weights: int, bytes_at_most: int = BROADCAST_BYTES, own: str | None = None,
) -> DataFrame:
    """``s_uj = sum_i v_ui * b_ij`` for every pair with a weight behind it, as (u, j, s). Made where the
    cells are, or, with a larger model, where a user's cells meet its rows; the pairs are not shuffled. ``own`` names one
    more column: the value of the user's own cell of item j, null where there is none."""
    cells, n_items = data.cells, data.n_items
    schema = T.StructType([cells.schema["u"], T.StructField("j", T.LongType()), T.StructField("s", T.DoubleType())])
    if own is not None:
        schema = schema.add(own, T.DoubleType())

    def pairs(rows: UserRows, code: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
        row, col = np.divmod(code, n_items)
        found = [rows.users.take(pa.array(row)), pa.array(col, pa.int64()), pa.array(s)]
        if own is not None:
            cell = rows.row * n_items + rows.i
            order = np.argsort(cell, kind="stable")
            at = order[np.minimum(np.searchsorted(cell, code, sorter=order), cell.size - 1)] if cell.size else code
            found.append(pa.array(rows.v[at].astype(float), pa.float64(), mask=cell[at] != code))
        return pa.RecordBatch.from_arrays(found, names=schema.names)

    if not n_items:
        return cells.sparkSession.createDataFrame([], schema)
    if n_weights * _WEIGHT_BYTES > bytes_at_most:
        return _beside_rows(data, weights, n_weights, pairs, schema)

    def make(stripe: SparseStripe):
        def task(batches):
            for rows in user_rows(batches):
                for part in _in_parts(rows, stripe):
                    yield pairs(part, *_added(*stripe.products(part)))

        return task

    sent = cells.sparkSession.sparkContext.broadcast(sparse_stripe(weights, n_items))
    return cells.select("u", "i", "v").mapInArrow(_with(sent, make), schema)


# ---------------------------------------------------------------- factors


@dataclass
class FactorStripe:
    """Item vectors in falling order of their length, and steps through them."""

    ids: np.ndarray
    vectors: np.ndarray
    lengths: np.ndarray
    # Every later stripe's vectors are shorter than this.
    ahead: float = 0.0
    names: pa.Array | None = None

    def steps(self, first: int) -> list["FactorStep"]:
        """Stretches of the stripe, each twice as long as the one before; made once."""
        made = self.__dict__.setdefault("_steps", {})
        if first not in made:
            edges = [0]
            while edges[-1] < self.ids.size:
                edges.append(min(self.ids.size, edges[-1] + first * 2 ** (len(edges) - 1)))
            made[first] = [factor_step(self, lo, hi) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
        return made[first]


@dataclass
class FactorStep:
    """Items ``lo`` to ``hi`` of a stripe in groups of similar direction. All vectors of a group lie within
    the angle of cosine ``near`` around its axis and are at most ``longest`` long."""

    lo: int
    hi: int
    at: np.ndarray
    starts: np.ndarray
    rows: np.ndarray
    axes: np.ndarray
    near: np.ndarray
    longest: np.ndarray


def factor_step(stripe: FactorStripe, lo: int, hi: int) -> FactorStep:
    vectors, lengths = stripe.vectors[lo:hi], stripe.lengths[lo:hi]
    unit = vectors / np.where(lengths > 0, lengths, 1.0)[:, None]
    groups = max(1, (hi - lo) // _ITEMS_PER_GROUP)
    axes, own = unit[np.arange(groups) * (hi - lo) // groups], np.zeros(hi - lo, np.int64)
    for _ in range(_GROUP_ROUNDS if groups > 1 else 0):
        low = axes.astype(np.float32).T
        for first in range(0, hi - lo, _VECTORS_AT_ONCE):
            part = unit[first : first + _VECTORS_AT_ONCE].astype(np.float32)
            own[first : first + _VECTORS_AT_ONCE] = (part @ low).argmax(axis=1)
        sums = np.stack([np.bincount(own, weights=c, minlength=groups) for c in unit.T], axis=1)
        size = np.sqrt((sums * sums).sum(axis=1))[:, None]
        axes = np.where(size > 0, sums / np.where(size > 0, size, 1.0), axes)
    at = np.argsort(own, kind="stable")
    used, starts = np.unique(own[at], return_index=True)
    axes = axes[used] if groups > 1 else np.zeros((1, vectors.shape[1]))
    cosine = np.where(lengths > 0, np.einsum("ij,ij->i", unit, axes[np.searchsorted(used, own)]), -1.0)
    near = np.clip(np.minimum.reduceat(cosine[at], starts), -1.0, 1.0) if groups > 1 else np.full(1, -1.0)
    top = stripe.lengths[0] or 1.0
    return FactorStep(
        lo, hi, lo + at, np.r_[starts, at.size], (vectors[at] / top).astype(np.float32), axes, near,
        np.maximum.reduceat(lengths[at], starts),
    )


def factor_stripes(items: DataFrame, n_items: int, n_factors: int, bytes_at_most: int) -> Iterator[FactorStripe]:
    """Items (id, vec) in stripes of falling length, each within the bound in expectation."""
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda total, c: total + c * c))
    with_length = items.select("id", "vec", length.alias("length"), *[c for c in items.columns if c == "name"])
    stripes = max(1, -(-n_items * 8 * (n_factors + 2) // bytes_at_most))
    edges = []
    if stripes > 1:
        with_length = checkpointed(with_length)
        edges = sorted(set(with_length.approxQuantile("length", [n / stripes for n in range(1, stripes)], 0.1 / stripes)), reverse=True)
    for high, low in zip([None, *edges], [*edges, None], strict=True):
        part = with_length
        part = part if high is None else part.filter(F.col("length") < high)
        part = part if low is None else part.filter(F.col("length") >= low)
        found = part.toArrow()
        vectors, lengths, ids = _vectors(found, n_factors), found["length"].to_numpy(), found["id"].to_numpy()
        order = np.lexsort((ids, -lengths))
        names = found["name"].combine_chunks().take(pa.array(order)) if "name" in found.column_names else None
        yield FactorStripe(ids[order], vectors[order], lengths[order], low or 0.0, names)


def _vectors(table: pa.Table, n_factors: int) -> np.ndarray:
    flat = table.column("vec").combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, n_factors)


class FactorLists:
    """The k best items of users by inner product, with as few products as bounds allow: once a user's
    k-th best is above |u| times the length of the next item, no later item can enter, and a group
    of items is passed over when the user's angle to it leaves all of them below the k-th best. What
    is left is compared in single precision, less its largest error, and scored in double."""

    def __init__(self, stripe: FactorStripe, k: int, digits: int | None, longest: float):
        self.stripe, self.k, self.digits, self.longest = stripe, k, digits, longest

    def __call__(self, u: np.ndarray, floor: np.ndarray, seen: Callable) -> tuple[np.ndarray, ...]:
        """(row, id, score) of the lists, and how many items each user was scored on. ``floor`` is
        a score that a list of other stripes already has at rank k. ``seen(rows, lo, hi)`` gives
        (index into rows, column) of what to leave out."""
        items, k = self.stripe, self.k
        m = u.shape[0]
        size = np.sqrt((u * u).sum(axis=1))
        unit = score_unit(size * self.longest)
        slack = (unit * 10.0**-RELATIVE_DIGITS if self.digits is None else np.full(m, 10.0**-self.digits)) + 1e-12 * unit
        direction = u / np.where(size > 0, size, 1.0)[:, None]
        kth, scored = floor.copy(), np.zeros(m, np.int64)
        row, ids, vals = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        active = np.arange(m)
        for step in items.steps(max(_FIRST_ITEMS, 2 * k)) if items.ids.size else []:
            active = active[size[active] * items.lengths[step.lo] + slack[active] >= kth[active]]
            if not active.size:
                break
            at, col = seen(active, step.lo, step.hi)
            r, c = self._candidates(step, u, direction, size, kth - slack, slack, active, at, col, scored)
            left_out = active[at] * np.int64(step.hi) + step.lo + col
            fresh = ~np.isin(r * np.int64(step.hi) + c, left_out)
            r, c = r[fresh], c[fresh]
            scores = np.einsum("ij,ij->i", u[r], items.vectors[c])
            scores = rounded_scores(scores[:, None], self.digits, size[r] * self.longest)[:, 0]
            # Equal scores are kept: the smaller id may come later.
            enough = scores >= kth[r]
            r, c, scores = r[enough], c[enough], scores[enough]
            row, ids, vals = np.concatenate([row, r]), np.concatenate([ids, items.ids[c]]), np.concatenate([vals, scores])
            row, ids, vals = self._cut(row, ids, vals, np.unique(r), kth)
        order = np.lexsort((ids, -vals, row))
        order = order[_positions(row[order]) < k]
        return row[order], ids[order], vals[order], scored

    def _cut(self, row, ids, vals, moved, kth) -> tuple[np.ndarray, ...]:
        """Raise ``kth`` of the users ``moved`` and drop what is below it, ties beyond 2 k entries too."""
        k = self.k
        place = np.full(kth.size, -1)
        place[moved] = np.arange(moved.size)
        of = np.flatnonzero(place[row] >= 0)
        of = of[np.argsort(place[row[of]].astype(np.min_scalar_type(kth.size)), kind="stable")]
        mine = place[row[of]]
        many = np.bincount(mine, minlength=moved.size)
        if many.size and many.max() >= k:
            side_by_side = np.full((moved.size, many.max()), np.inf)
            side_by_side[mine, np.arange(mine.size) - np.repeat(np.cumsum(many) - many, many)] = -vals[of]
            kth[moved] = np.maximum(kth[moved], -np.partition(side_by_side, k - 1, axis=1)[:, k - 1])
            keep = vals >= kth[row]
            row, ids, vals = row[keep], ids[keep], vals[keep]
            if np.bincount(row).max(initial=0) > 2 * k:
                order = np.lexsort((ids, -vals, row))
                order = order[_positions(row[order]) < k]
                row, ids, vals = row[order], ids[order], vals[order]
        return row, ids, vals

    def _candidates(self, step, u, direction, size, enough, slack, active, at, col, scored) -> tuple[np.ndarray, np.ndarray]:
        """(user, place in the stripe) of all pairs of a step that may reach ``enough``, and more."""
        f, top = u.shape[1], self.stripe.lengths[0] or 1.0
        cosine = np.clip(direction[active] @ step.axes.T, -1.0, 1.0)
        # Cosine of the least angle between the user and a vector of the group.
        least = cosine * step.near + np.sqrt((1 - cosine * cosine) * (1 - step.near * step.near))
        least = np.where(cosine >= step.near, 1.0, np.maximum(least, 0.0)) + _ANGLE_ERROR
        meets = size[active][:, None] * step.longest * least >= enough[active][:, None]
        # Products of directions with vectors of at most unit length; f + 4 rounding steps of single precision.
        scale = np.where(size > 0, size * top, 1.0)
        error = (f + 4) * 2.0**-22
        bar = np.where(size > 0, enough / scale, -np.inf) - error
        low = direction.astype(np.float32)
        if step.near.size == 1 and step.at.size > self.k:
            # One group of all items in order: its own k-th best is a floor already.
            products = low[active] @ step.rows.T
            products[at, col] = -np.inf
            own = np.partition(products, -self.k, axis=1)[:, -self.k] - slack[active] / scale[active] - 2 * error
            bar[active] = np.maximum(bar[active], np.where(size[active] > 0, own, -np.inf))
        bar = np.nextafter(bar.astype(np.float32), np.float32(-np.inf))
        rows, places = [], []
        for g in np.flatnonzero(meets.any(axis=0)):
            mine = active[meets[:, g]]
            first, end = step.starts[g], step.starts[g + 1]
            scored[mine] += end - first
            above = np.flatnonzero(low[mine] @ step.rows[first:end].T >= bar[mine][:, None])
            rows.append(mine[above // (end - first)])
            places.append(step.at[first + above % (end - first)])
        empty = np.empty(0, np.int64)
        return np.concatenate([empty, *rows]), np.concatenate([empty, *places])


def recommend_factors(
    data, user_factors: DataFrame, item_factors: DataFrame, n_factors: int, k: int, remove_seen: bool,
    digits: int | None = None, bytes_at_most: int = BROADCAST_BYTES, name_type: T.DataType | None = None,
) -> DataFrame:
    """Top ``k`` of ``U V'`` per user, as (u, i, scores, rank, scored); seen items are left out when
    ``remove_seen``. ``scored`` is with how many items of the row's stripe the user took products.

    ``user_factors`` is (id, vec) over user ids, ``item_factors`` (id, vec) over item indices. Items
    are broadcast in stripes of falling length; blocks of users meet their cells in one shuffle.
    Users whose list no later stripe can change leave after a stripe. Equal to a full scoring, ties by item.
    A column ``name`` of ``item_factors``, of type ``name_type``, is carried along to the lists.
    """
    spark = data.cells.sparkSession
    blocks = max(4 * parallelism(spark), -(-data.n_cells // _CELLS_PER_BLOCK))
    block = F.pmod(F.xxhash64("u"), F.lit(blocks)).alias("block")
    schema = T.StructType([*_schema(data.cells).fields, T.StructField("scored", T.LongType())])
    if name_type is not None:
        schema = schema.add("name", name_type)
    # What decides whether a list may still change.
    open_schema = T.StructType([*schema.fields, T.StructField("kth", T.DoubleType()), T.StructField("size", T.DoubleType())])
    users = user_factors.select(F.col("id").alias("u"), "vec").withColumn("floor", F.lit(float("-inf")))
    seen_cells = data.cells.select(block, "u", "i") if remove_seen else data.cells.select(block, "u", "i").limit(0)

    def lists_of(sent, longest: float):
        def score(people: pa.Table, cells: pa.Table) -> pa.Table:
            stripe = sent.value
            lists = FactorLists(stripe, k, digits, longest)
            if not people.num_rows:
                return pa.table([pa.array([], t) for t in types], names=open_schema.names)
            who = people["u"].combine_chunks()
            u, floor = _vectors(people, n_factors), people["floor"].to_numpy()
            size = np.sqrt((u * u).sum(axis=1))
            place = np.argsort(stripe.ids)
            sorted_ids = stripe.ids[place]
            # Seen items as (user, place in the stripe), by user.
            owner = pc.fill_null(pc.index_in(cells["u"], value_set=who), -1).to_numpy().astype(np.int64)
            item = cells["i"].to_numpy()
            at = np.minimum(np.searchsorted(sorted_ids, item), max(sorted_ids.size - 1, 0))
            here = sorted_ids[at] == item if sorted_ids.size else np.zeros(item.size, bool)
            owner, spot = owner[here], place[at[here]]
            order = np.argsort(owner, kind="stable")
            owner, spot = owner[order], spot[order]
            starts = np.searchsorted(owner, np.arange(len(who) + 1))
            out = []
            for lo in range(0, len(who), _USERS_AT_ONCE):
                hi = min(len(who), lo + _USERS_AT_ONCE)

                def seen(rows, first, end):
                    a, b = starts[lo + rows], starts[lo + rows + 1]
                    each = b - a
                    which = np.repeat(np.arange(rows.size), each)
                    cols = spot[np.repeat(a - (np.cumsum(each) - each), each) + np.arange(each.sum())]
                    inside = (cols >= first) & (cols < end)
                    return which[inside], cols[inside] - first

                row, ids, vals, scored = lists(u[lo:hi], floor[lo:hi], seen)
                rank = _positions(row) + 1
                kth, last = floor[lo:hi].copy(), rank == k
                kth[row[last]] = np.maximum(kth[row[last]], vals[last])
                more = [scored[row], kth[row], size[lo:hi][row]]
                if name_type is not None:
                    more.insert(1, stripe.names.take(pa.array(place[np.searchsorted(sorted_ids, ids)])))
                batch = _table(who.slice(lo, hi - lo), row, ids, vals, rank)
                out.append(pa.Table.from_arrays([*batch.columns, *map(pa.array, more)], names=open_schema.names))
            return pa.concat_tables(out)

        return score

    longest_squared = item_factors.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda t, c: t + c * c))).first()[0]
    longest = float(np.sqrt(longest_squared or 0.0))
    types = [f.type for f in to_arrow_schema(open_schema)]
    done, best, sent = [], None, None
    for stripe in factor_stripes(item_factors, data.n_items, n_factors, bytes_at_most):
        if not stripe.ids.size and data.n_items:
            continue
        stripe.steps(max(_FIRST_ITEMS, 2 * k))
        sent = spark.sparkContext.broadcast(stripe)
        left = users.withColumn("block", block).groupBy("block")
        found = left.cogroup(seen_cells.groupBy("block")).applyInArrow(lists_of(sent, longest), open_schema)
        if stripe.ids.size == data.n_items:
            return found.select(*schema.names)
        if best is not None:
            both = found.unionByName(best).drop("rank", "kth")
            kth = F.max(F.when(F.col("rank") == k, F.col("scores"))).over(Window.partitionBy("u"))
            found = top_k(both, ["u"], [F.desc("scores"), F.col("i")], k).withColumn("kth", F.coalesce(kth, F.lit(float("-inf"))))
        found = checkpointed(found.select(*open_schema.names))
        sent.unpersist()
        stays = _may_change(stripe.ahead, digits, longest)
        done.append(found.filter(~stays).select(*schema.names))
        best = found.filter(stays)
        known = found.filter(F.col("rank") == 1).select("u", F.col("kth").alias("floor"), stays.alias("stays"))
        users = users.select("u", "vec").join(known, "u", "left").filter("stays is null or stays")
        users = checkpointed(users.select("u", "vec", F.coalesce("floor", F.lit(float("-inf"))).alias("floor")))
        if users.isEmpty():
            return union_all(done)
        if remove_seen:
            seen_cells = data.cells.join(users.select("u"), "u", "left_semi").select(block, "u", "i")
    return union_all([*done, best.select(*schema.names)])


def _may_change(ahead: float, digits: int | None, longest: float) -> Column:
    """Whether an item shorter than ``ahead`` may enter the list; never false where ``FactorLists`` goes on."""
    size = F.col("size")
    slack = size * (20 * longest * 10.0**-RELATIVE_DIGITS) if digits is None else size * (longest * 1e-11) + 2 * 10.0**-digits
    return size * (ahead * (1 + 1e-9)) + slack >= F.col("kth")
