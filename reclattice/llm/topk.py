"""Exact top-k by inner product of integer vectors, by a three-phase uniform threshold.

The dimensions are cut into slices; a slice of all candidates is a node that can score a query on
its own dimensions only. The score of a candidate is the sum over the nodes.

1. Every node gathers its k best candidates of every query. Their scores are completed; the k-th
   best of these is a lower bound ``tau`` of the k-th best of all.
2. Every node gets a safe cutoff: its k-th best local score less the same ``give`` for every node,
   so that the cutoffs add up to at most ``tau``. A candidate under the cutoff of every node scores
   less than ``tau``. Each node sends the entries at or above its cutoff, packed by query. (The
   k-th best, because a few near copies of a query score far above what else is near it.)
3. Candidates that all nodes have sent are complete. Of the others, those that can still reach
   ``tau``, or the k-th best complete score, are scored exactly.

Nodes are cut into blocks of candidates and queries, so a task holds two blocks of one slice, or
in the third phase the entries of all slices between two blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reclattice.llm.common import written
from reclattice.llm.vectors import integer_vectors, matrix
from reclattice.session import ship_package

TOP = 20
SCALE = 64.0
SLICES = 2
# Candidates and queries in a block, and scores a task holds at once.
CANDIDATES = 8192
QUERIES = 1024
_SCORES_AT_ONCE = 4_000_000
# Squared length from which scores may not fit a long.
_SQUARED = float(2**62)
_LEAST = -(2**63)


def _squares(x) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda total, c: total + c.cast("double") * c.cast("double"))


def _best(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; tasks send no more than k rows a group."""
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a b'`` exactly, in the fastest type that can hold every partial sum."""
    reach = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    kind = np.float32 if reach < 2**24 else np.float64 if reach < 2**53 else np.int64
    return a.astype(kind) @ b.astype(kind).T


class _Blocks:
    """Candidates (key, x) and queries (q, own, x), cut into slices and blocks."""

    def __init__(self, candidates: DataFrame, queries: DataFrame, slices: int):
        self.candidates, self.queries = candidates, queries
        counted = candidates.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).first()
        asked = queries.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).first()
        self.dims = max(counted["d"] or 1, asked["d"] or 1, 1)
        self.slices = max(1, min(slices, self.dims))
        self.width = -(-self.dims // self.slices)
        self.cuts = {"key": max(1, -(-counted["n"] // CANDIDATES)), "q": max(1, -(-asked["n"] // QUERIES))}

    def block(self, name: str) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(self.cuts[name])).cast("int")

    def _every(self, name: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(self.cuts[name] - 1)))

    def placed(self, sliced: bool) -> tuple[DataFrame, DataFrame]:
        """Both sides with (slice if cut, cb, qb): every block meets every block of the other side."""
        def parts(df: DataFrame) -> DataFrame:
            if not sliced:
                return df
            pieces = F.array(*[
                F.struct(F.lit(g).alias("slice"), F.slice("x", g * self.width + 1, self.width).alias("x"))
                for g in range(self.slices)
            ])
            return df.withColumn("piece", F.explode(pieces)).withColumns(
                {"slice": F.col("piece.slice"), "x": F.col("piece.x")}
            ).drop("piece")

        left = parts(self.candidates).withColumn("cb", self.block("key")).withColumn("qb", self._every("q"))
        right = parts(self.queries).withColumn("qb", self.block("q")).withColumn("cb", self._every("key"))
        return left, right

    def on_nodes(self, right: DataFrame, left: DataFrame, task, schema: str) -> DataFrame:
        """``task`` on every pair of blocks of every slice."""
        keys = ["slice", "cb", "qb"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(task, schema)

    def resolve(self, pairs: DataFrame) -> DataFrame:
        """(q, key, score) of the given pairs, from whole vectors."""
        left, right = self.placed(sliced=False)
        pairs = pairs.select("q", "key", self.block("key").alias("cb"), self.block("q").alias("qb"))
        rows = (
            left.select("cb", "qb", "key", F.lit(None).cast("long").alias("q"), "x")
            .unionByName(right.select("cb", "qb", F.lit(None).cast("long").alias("key"), "q", "x"))
            .unionByName(pairs.withColumn("x", F.lit(None).cast("array<bigint>")))
        )
        dims = self.dims

        def score(table: pa.Table) -> pa.Table:
            table = table.combine_chunks()
            key, q = table["key"], table["q"]
            one, two = key.is_valid().to_numpy(), q.is_valid().to_numpy()
            known, asked, wanted = (table.filter(pa.array(m)) for m in (one & ~two, two & ~one, one & two))
            if not wanted.num_rows:
                return pa.table({"q": pa.array([], pa.int64()), "key": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
            c, v = known["key"].to_numpy(), matrix(known["x"], dims)
            u, w = asked["q"].to_numpy(), matrix(asked["x"], dims)
            order, other = np.argsort(c), np.argsort(u)
            at = order[np.searchsorted(c, wanted["key"].to_numpy(), sorter=order)]
            to = other[np.searchsorted(u, wanted["q"].to_numpy(), sorter=other)]
            out = np.empty(at.size, np.int64)
            step = max(1, _SCORES_AT_ONCE // dims)
            for lo in range(0, at.size, step):
                out[lo : lo + step] = np.einsum("ij,ij->i", v[at[lo : lo + step]], w[to[lo : lo + step]])
            return pa.table({"q": wanted["q"], "key": wanted["key"], "score": pa.array(out)})

        return rows.groupBy("cb", "qb").applyInArrow(score, "q long, key long, score long")


def _in_steps(known: pa.Table, asked: pa.Table):
    """(first query, local scores as an array, own column or -1 of each query) of two blocks."""
    key, own = known["key"].to_numpy(), asked["own"].to_numpy(zero_copy_only=False)
    width = max(matrix(known["x"]).shape[1], matrix(asked["x"]).shape[1])
    v, w = matrix(known["x"], width), matrix(asked["x"], width)
    order = np.argsort(key)
    at = order[np.minimum(np.searchsorted(key, own, sorter=order), key.size - 1)]
    column = np.where(key[at] == own, at, -1)
    step = max(1, _SCORES_AT_ONCE // key.size)
    for lo in range(0, w.shape[0], step):
        yield lo, _product(w[lo : lo + step], v), column[lo : lo + step]


_LISTS = "q long, slice int, key long, s long"
_SENT = "cb int, qb int, q long, cutoff long, cols binary, s binary"
_SCORED = "q long, key long, score long"


def _ints(values) -> pa.Array:
    return pa.array(np.concatenate(values) if len(values) else np.empty(0, np.int64), pa.int64())


def _local_lists(k: int):
    def task(known: pa.Table, asked: pa.Table) -> pa.Table:
        out = {"q": [], "key": [], "s": []}
        node = 0
        if known.num_rows and asked.num_rows:
            node = known["slice"][0].as_py()
            key, q = known["key"].to_numpy(), asked["q"].to_numpy()
            for lo, scores, own in _in_steps(known, asked):
                some = min(k + 1, key.size)
                best = np.argpartition(scores, key.size - some, axis=1)[:, key.size - some :]
                keep = best != own[:, None]
                rows = np.nonzero(keep)[0]
                out["q"].append(q[lo + rows])
                out["key"].append(key[best[keep]])
                out["s"].append(np.take_along_axis(scores, best, axis=1)[keep].astype(np.int64))
        made = {n: _ints(v) for n, v in out.items()}
        return pa.table({"q": made["q"], "slice": pa.array(np.full(len(made["q"]), node, np.int32)), "key": made["key"], "s": made["s"]})

    return task


def _entries(known: pa.Table, asked: pa.Table) -> pa.Table:
    """One row per query with entries at or above its cutoff: numbers of the candidates in the
    order of their keys, and local scores."""
    out = {name: [] for name in ("q", "cutoff", "cols", "s")}
    cb = qb = 0
    if known.num_rows and asked.num_rows:
        known = known.sort_by("key")
        cb, qb = known["cb"][0].as_py(), known["qb"][0].as_py()
        q, cutoff = asked["q"].to_numpy(), asked["cutoff"].to_numpy()
        for lo, scores, own in _in_steps(known, asked):
            bound = cutoff[lo : lo + scores.shape[0]]
            # No score is beyond what its type counts exactly, so a cutoff may stop there too.
            most = {np.dtype(np.float32): 2**24, np.dtype(np.float64): 2**53}.get(scores.dtype)
            near = bound if most is None else np.clip(bound, -most, most).astype(scores.dtype)
            row, col = np.nonzero(scores >= near[:, None])
            s = scores[row, col].astype(np.int64)
            keep = (col != own[row]) & (s >= bound[row])
            row, col, s = row[keep], col[keep].astype(np.int32), s[keep]
            ends = np.searchsorted(row, np.arange(scores.shape[0] + 1))
            for r in np.flatnonzero(np.diff(ends)):
                at = slice(ends[r], ends[r + 1])
                for name, value in (("q", q[lo + r]), ("cutoff", bound[r]), ("cols", col[at].tobytes()), ("s", s[at].tobytes())):
                    out[name].append(value)
    size = len(out["q"])
    return pa.table({
        "cb": pa.array(np.full(size, cb, np.int32)), "qb": pa.array(np.full(size, qb, np.int32)),
        "q": pa.array(out["q"], pa.int64()), "cutoff": pa.array(out["cutoff"], pa.int64()),
        "cols": pa.array(out["cols"], pa.binary()), "s": pa.array(out["s"], pa.binary()),
    })


def _unpacked(column: pa.ChunkedArray, kind) -> list[np.ndarray]:
    return [np.frombuffer(v.as_buffer(), kind) for v in column]


def _ranks(group: np.ndarray) -> np.ndarray:
    """Position inside each run of equal values."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    return np.arange(group.size) - np.repeat(starts, np.diff(np.r_[starts, group.size]))


def _completed(k: int, nodes: int, dims: int):
    """Task body of the third phase: the k best of every query between two blocks."""

    def task(table: pa.Table) -> pa.Table:
        sent = table.filter(table["cols"].is_valid())
        if not sent.num_rows:
            return pa.table({n: _ints([]) for n in ("q", "key", "score")})
        known = table.filter(table["key"].is_valid()).sort_by("key")
        asked = table.filter(table["own"].is_valid()).sort_by("q")
        key, q = known["key"].to_numpy(), asked["q"].to_numpy()
        v, w = matrix(known["x"], dims), matrix(asked["x"], dims)
        tau, total = asked["tau"].to_numpy(), asked["total"].to_numpy()
        cols = _unpacked(sent["cols"], np.int32)
        sizes = [c.size for c in cols]
        at = np.searchsorted(q, sent["q"].to_numpy())
        code = np.repeat(at * key.size, sizes) + np.concatenate(cols)
        order = np.argsort(code, kind="stable")
        code = code[order]
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        count = np.diff(np.r_[first, code.size])
        score = np.add.reduceat(np.concatenate(_unpacked(sent["s"], np.int64))[order], first)
        passed = np.add.reduceat(np.repeat(sent["cutoff"].to_numpy(), sizes)[order], first)
        row, col = np.divmod(code[first], key.size)

        def best(some: np.ndarray) -> np.ndarray:
            """Indices of the k best of each query among ``some``, in order."""
            some = some[np.lexsort((col[some], -score[some], row[some]))]
            return some[_ranks(row[some]) < k]

        whole = best(np.flatnonzero(count == nodes))
        bound = tau.copy()
        last = whole[_ranks(row[whole]) == k - 1]
        bound[row[last]] = np.maximum(bound[row[last]], score[last])
        # A node that did not send a candidate scores it below its cutoff.
        missing = nodes - count
        free = tau[row] == _LEAST
        reach = np.where(free, 0, score + np.where(free, 0, total[row] - passed) - missing)
        unsure = np.flatnonzero((missing > 0) & (free | (reach >= bound[row])))
        step = max(1, _SCORES_AT_ONCE // dims)
        for lo in range(0, unsure.size, step):
            these = unsure[lo : lo + step]
            score[these] = np.einsum("ij,ij->i", v[col[these]], w[row[these]])
        found = best(np.concatenate([whole, unsure]))
        return pa.table({"q": pa.array(q[row[found]]), "key": pa.array(key[col[found]]), "score": pa.array(score[found])})

    return task


def _kth(scored: DataFrame, k: int, name: str) -> DataFrame:
    """(q, name): the k-th best score; queries with fewer are left out."""
    best = _best(scored, ["q"], [F.desc("score")], k)
    return best.filter(F.col("rank") == k).select("q", F.col("score").alias(name))


def search(candidates: DataFrame, queries: DataFrame, k: int = TOP, slices: int = SLICES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates (id, x) of every query (id, x).

    A query's own row, that is one candidate with its id and its vector, takes no part; other
    rows that repeat its id do. Ties go to the smaller id, a null id last. Each row is a query of its own, so
    a repeated row gets its list as often. A shorter vector counts as one that ends in zeros. Vectors
    whose squared length reaches 2^62 are left out on both sides: their scores need not fit a
    long. No candidates or no queries give no rows.
    """
    spark = candidates.sparkSession
    ship_package(spark)
    small = _squares(F.col("x")) < _SQUARED
    # Of equal vectors only the k + 1 smallest ids can stand in a list. The key follows the id.
    last = F.col("id").asc_nulls_last()
    unlike = _best(candidates.filter(small).select("id", "x"), ["x"], [last], k + 1).drop("rank")
    spread = F.xxhash64("x")
    placed = unlike.repartitionByRange(last, spread).sortWithinPartitions(last, spread)
    known = written(placed.select(F.monotonically_increasing_id().alias("key"), "id", "x"), "candidates")
    own = known.groupBy(F.col("id").alias("own_id"), F.col("x").alias("own_x")).agg(F.min("key").alias("own"))
    asked = written(
        queries.filter(small).select("id", "x")
        .join(own, F.col("id").eqNullSafe(F.col("own_id")) & (F.col("x") == F.col("own_x")), "left")
        .select(F.monotonically_increasing_id().alias("q"), "id", F.coalesce("own", F.lit(-1)).alias("own"), "x"),
        "queries",
    )
    blocks = _Blocks(known.select("key", "x"), asked.select("q", "own", "x"), slices)
    nodes = blocks.slices
    # First phase.
    left, right = blocks.placed(sliced=True)
    gathered = blocks.on_nodes(right, left, _local_lists(k), _LISTS)
    lists = written(_best(gathered, ["q", "slice"], [F.desc("s"), F.col("key")], k).drop("rank"), "lists")
    complete = written(blocks.resolve(lists.select("q", "key").distinct()), "listed")
    tau = _kth(complete, k, "tau")
    listed = lists.groupBy("q", "slice").agg(F.min("s").alias("low"))
    give = F.ceil((F.sum(F.col("low").cast("decimal(38,0)")) - F.col("tau")) / nodes)
    given = listed.join(tau, "q").groupBy("q", "tau").agg(
        give.cast("long").alias("give"), F.sum("low").cast("long").alias("total")
    ).withColumn("total", F.col("total") - nodes * F.col("give"))
    cutoffs = written(
        listed.join(given, "q").select("q", "slice", "tau", "total", (F.col("low") - F.col("give")).alias("cutoff")), "cutoffs"
    )
    # Second phase; a query without k listed candidates has no cutoff and is sent them all.
    bounded = right.join(cutoffs.select("q", "slice", "cutoff"), ["q", "slice"], "left").withColumn(
        "cutoff", F.coalesce("cutoff", F.lit(_LEAST))
    )
    sent = blocks.on_nodes(bounded, left, _entries, _SENT)
    # Third phase.
    wide, asking = blocks.placed(sliced=False)
    per_query = cutoffs.select("q", "tau", "total").distinct()
    asking = asking.join(per_query, "q", "left").withColumns(
        {"tau": F.coalesce("tau", F.lit(_LEAST)), "total": F.coalesce("total", F.lit(0))}
    )
    met = wide.unionByName(asking, allowMissingColumns=True).unionByName(sent, allowMissingColumns=True)
    scored = met.groupBy("cb", "qb").applyInArrow(_completed(k, nodes, blocks.dims), _SCORED)
    top = _best(scored, ["q"], [F.desc("score"), F.col("key")], k)
    return (
        top.join(known.select("key", F.col("id").alias("vec_id")), "key")
        .join(asked.select("q", F.col("id").alias("query_id")), "q")
        .select("query_id", "rank", "vec_id", "score")
    )


def top_neighbours(
    df: DataFrame, k: int = TOP, every: int = 20, scale: float = SCALE, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """``search`` of the rows whose id is divisible by ``every`` among all rows of ``df``. Vectors that are null
    or hold null or non-finite components take no part; a null id is a candidate only."""
    rows = integer_vectors(df, scale, vec_id, embedding)
    return search(rows, rows.filter(F.col("id") % every == 0), k)
