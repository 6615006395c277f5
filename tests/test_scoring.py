"""Scoring past stripes of a model against full score tables."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reclattice.models.base import laid_out
from reclattice.operators import scoring
from reclattice.operators.filters import without_seen, zero_seen
from reclattice.operators.scoring import (
    FactorLists, FactorStripe, Lists, SparseStripe, UserRows, recommend_dense, recommend_factors, recommend_sparse,
    score_pairs, user_rows,
)
from reclattice.operators.tiles import tile_table

USERS, ITEMS = 30, 23


@pytest.fixture(scope="module")
def x():
    draw = np.random.default_rng(11)
    cells = np.where(draw.random((USERS, ITEMS)) < 0.2, draw.integers(-1, 4, (USERS, ITEMS)), 0).astype(float)
    cells[0] = draw.integers(1, 3, ITEMS)
    cells[:, 2] += 1
    return cells


@pytest.fixture(scope="module")
def data(spark, x):
    rows = [(int(u), int(i), float(x[u, i])) for u, i in zip(*np.nonzero(x))]
    cells = laid_out(spark.createDataFrame(rows, "u long, i long, v double")).persist()
    return SimpleNamespace(n_items=ITEMS, n_cells=len(rows), cells=cells)


def weight_table(spark, w):
    rows = [(int(i), int(j), float(w[i, j])) for i, j in zip(*np.nonzero(w))]
    return spark.createDataFrame(rows, "i long, j long, b double"), len(rows)


def lists(scores, k):
    """(user, item, rank) and scores: best first, ties by item, -inf left out."""
    scores = np.round(scores, 9)
    out = []
    for u in range(scores.shape[0]):
        order = [j for j in np.lexsort((np.arange(scores.shape[1]), -scores[u])) if np.isfinite(scores[u, j])][:k]
        out += [((u, int(j), r + 1), float(scores[u, j])) for r, j in enumerate(order)]
    return out


def same(found, expected):
    got = [((r["u"], r["i"], r["rank"]), r["scores"]) for r in found.orderBy("u", "rank").collect()]
    assert [g[0] for g in got] == [e[0] for e in expected]
    assert np.allclose([g[1] for g in got], [e[1] for e in expected], atol=1e-8)


def masked(scores, x, mask):
    return scores if mask == "none" else np.where(x != 0, 0.0 if mask == "zero" else -np.inf, scores)


@pytest.mark.parametrize("mask", ["none", "zero", "remove"])
@pytest.mark.parametrize("share,digits", [(8, 9), (0, 9), (0, None)])
def test_sparse_lists(spark, monkeypatch, data, x, mask, share, digits):
    """Signed weights, few scores per user: lists are filled with zeros in item order, by both ways
    of adding up and over one stripe or many."""
    monkeypatch.setattr(scoring, "_DENSE_SHARE", share)
    monkeypatch.setattr(scoring, "_STRIPES_PER_MERGE", 1)
    draw = np.random.default_rng(12)
    w = np.where(draw.random((ITEMS, ITEMS)) < 0.06, draw.integers(-3, 4, (ITEMS, ITEMS)) / 4, 0.0)
    table, n = weight_table(spark, w)
    expected = lists(masked(x @ w, x, mask), 9)
    for at_most in (1 << 20, 16 * 16):
        same(recommend_sparse(data, table, n, 9, mask, digits, bytes_at_most=at_most), expected)


@pytest.mark.parametrize("share", [8, 0])
def test_only_scored_items(spark, monkeypatch, data, x, share):
    monkeypatch.setattr(scoring, "_DENSE_SHARE", share)
    draw = np.random.default_rng(13)
    w = np.where(draw.random((ITEMS, ITEMS)) < 0.1, draw.integers(1, 4, (ITEMS, ITEMS)), 0).astype(float)
    table, n = weight_table(spark, w)
    touched = (x != 0).astype(int) @ (w != 0) > 0
    expected = lists(np.where(touched, masked(x @ w, x, "remove"), -np.inf), 5)
    for at_most in (1 << 20, 16 * 22):
        same(recommend_sparse(data, table, n, 5, "remove", 9, scored_only=True, bytes_at_most=at_most), expected)
    for at_most in (1 << 20, 16 * 22):
        pairs = {(r["u"], r["j"]): r["s"] for r in score_pairs(data, table, n, at_most).collect()}
        assert set(pairs) == set(zip(*map(lambda c: c.tolist(), np.nonzero(touched))))
        assert np.allclose(list(pairs.values()), [(x @ w)[k] for k in pairs])


@pytest.mark.parametrize("mask", ["zero", "remove"])
@pytest.mark.parametrize("tile,at_most", [(64, 1 << 20), (10, 1 << 20), (10, 8 * ITEMS * 9), (64, 8 * ITEMS * 12)])
def test_dense_lists(spark, data, x, mask, tile, at_most):
    b = np.random.default_rng(14).normal(size=(ITEMS, ITEMS))
    made = [
        tuple(tile_table(i // tile, j // tile, b[i : i + tile, j : j + tile]).to_pylist()[0].values())
        for i in range(0, ITEMS, tile) for j in range(0, ITEMS, tile)
    ]
    tiles = spark.createDataFrame(made, "bi long, bj long, tile binary")
    same(recommend_dense(data, tiles, tile, 6, mask, None, at_most), lists(masked(x @ b, x, mask), 6))


def test_no_shuffle_of_scores(spark, data):
    """Lists come out of the tasks that hold the cells; the plan has no exchange above them."""
    table, n = weight_table(spark, np.eye(ITEMS))
    for found in (recommend_sparse(data, table, n, 3, "none"), score_pairs(data, table, n)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan and "Window" not in plan and "Repartition" not in plan.split("InMemoryRelation")[0]


def test_users_stay_whole_over_batches():
    """A user whose cells span many batches, one below, and a null user."""
    who = [None] * 3 + [1] * 2 + [2] * 700 + [3] * 5
    cells = pa.table({"u": pa.array(who, pa.int64()), "i": list(range(len(who))), "v": [1.0] * len(who)})
    for at_once in (1, 7, 10_000):
        scoring_at_once, scoring._CELLS_AT_ONCE = scoring._CELLS_AT_ONCE, at_once
        try:
            blocks = list(user_rows(iter(cells.to_batches(max_chunksize=11))))
        finally:
            scoring._CELLS_AT_ONCE = scoring_at_once
        sizes = [(u, int(n)) for b in blocks for u, n in zip(b.users.to_pylist(), np.diff(b.starts))]
        assert sizes == [(None, 3), (1, 2), (2, 700), (3, 5)]
        assert [i for b in blocks for i in b.i] == list(range(len(who)))
    assert list(user_rows(iter([]))) == []


def test_ties_are_cut_by_one_rule():
    """Scores of very different size in one row: both ways of adding up round below the same bound."""
    rows = UserRows(pa.array([1]), np.array([0, 2]), np.array([0, 1]), np.array([1.0, 1.0]))
    weights = SparseStripe(0, 5, np.array([0, 3, 5, 5, 5, 5]), np.array([2, 3, 4, 2, 3]), np.array([0.1, 0.2 + 1e-13, 1e-6, 0.2, 0.1]))
    found = Lists(3, "none", None, 0.2)
    code, products = weights.products(rows)
    alone = found.sparse(rows, weights, *scoring._added(code, products))
    table = found.dense(rows, weights, np.bincount(code, weights=products, minlength=5).reshape(1, 5))
    assert alone.to_pydict() == table.to_pydict()
    assert alone["i"].to_pylist() == [2, 3, 4]


def full(u, v, ids, seen, k, digits):
    scores = np.round(u @ v.T, digits)
    out = []
    for r in range(u.shape[0]):
        order = [j for j in np.lexsort((ids, -scores[r])) if (r, ids[j]) not in seen][:k]
        out += [(r, int(ids[j]), float(scores[r, j])) for j in order]
    return out


@pytest.mark.parametrize("case", ["popular", "flat", "zero", "ties"])
def test_norm_bounds_lose_nothing(case):
    """Equal to full scoring; with lengths that fall off, most products are never taken."""
    draw = np.random.default_rng(15)
    n, m, f, k = 3000, 40, 6, 7
    u, v = draw.normal(size=(m, f)), draw.normal(size=(n, f))
    if case == "popular":
        v *= (1.0 / np.arange(1, n + 1) ** 0.7)[:, None]
    elif case == "zero":
        u[:] = 0.0
    elif case == "ties":
        u, v = np.round(u), np.round(v)
    ids = draw.permutation(n)
    length = np.sqrt((v * v).sum(axis=1))
    order = np.lexsort((ids, -length))
    stripe = FactorStripe(ids[order], v[order], length[order])
    seen = {(int(r), int(i)) for r, i in zip(draw.integers(0, m, 400), draw.integers(0, n, 400))}

    def left_out(rows, lo, hi):
        here = [(a, c) for a, r in enumerate(rows) for c in range(hi - lo) if (int(r), int(stripe.ids[lo + c])) in seen]
        return np.array([a for a, _ in here], int), np.array([c for _, c in here], int)

    row, got, vals, scored = FactorLists(stripe, k, 9, float(length.max()))(u, np.full(m, -np.inf), left_out)
    expected = full(u, v, ids, seen, k, 9)
    assert [(int(a), int(b)) for a, b in zip(row, got)] == [e[:2] for e in expected]
    assert np.allclose(vals, [e[2] for e in expected], atol=1e-9)
    if case == "popular":
        assert scored.mean() < 0.5 * n
    if case == "zero":
        assert (scored == n).all()


@pytest.mark.parametrize("remove", [True, False])
def test_factor_lists(spark, data, x, remove):
    draw = np.random.default_rng(16)
    u, v = draw.normal(size=(USERS, 4)), draw.normal(size=(ITEMS, 4)) * np.linspace(0.05, 2, ITEMS)[:, None]
    people = spark.createDataFrame([(n, r.tolist()) for n, r in enumerate(u)], "id long, vec array<double>")
    items = spark.createDataFrame([(n, r.tolist()) for n, r in enumerate(v)], "id long, vec array<double>")
    expected = lists(masked(u @ v.T, x, "remove" if remove else "none"), 5)
    for at_most in (1 << 20, 8 * 6 * 12):
        same(recommend_factors(data, people, items, 4, 5, remove, None, at_most), expected)


@pytest.mark.parametrize("mask", ["none", "zero", "remove"])
def test_a_large_sparse_model_does_not_pass_the_driver(spark, monkeypatch, data, x, mask):
    """Rows in several pieces, users over several batches; nothing is gathered or broadcast by hand."""
    monkeypatch.setattr(scoring, "_PIECE", 3)
    monkeypatch.setattr(scoring, "_PACKED_AT_ONCE", 5)
    draw = np.random.default_rng(15)
    w = np.where(draw.random((ITEMS, ITEMS)) < 0.4, draw.integers(-3, 4, (ITEMS, ITEMS)) / 4, 0.0)
    w[4] = 0.0
    table, n = weight_table(spark, w)
    gathered = []
    monkeypatch.setattr(type(table), "toArrow", lambda self: gathered.append(self))
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: gathered.append(value))
    same(recommend_sparse(data, table, n, 9, mask, 9, bytes_at_most=16), lists(masked(x @ w, x, mask), 9))
    touched = (x != 0).astype(int) @ (w != 0) > 0
    pairs = {(r["u"], r["j"]): r["s"] for r in score_pairs(data, table, n, 16).collect()}
    assert set(pairs) == set(zip(*map(lambda c: c.tolist(), np.nonzero(touched))))
    assert np.allclose(list(pairs.values()), [(x @ w)[k] for k in pairs])
    assert not gathered


def test_packed_weights_come_back():
    """Wide gaps, many or few values, signed zeros, values that are no numbers."""
    draw = np.random.default_rng(16)
    for many in (1, 3, 4000):
        i, j = np.sort(draw.integers(0, 40, many)), draw.integers(0, 1 << 40, many)
        order = np.lexsort((j, i))
        i, j = i[order], j[order]
        for b in (draw.integers(0, 3, many) - 0.0, draw.normal(size=many), np.full(many, np.nan), np.full(many, -0.0)):
            items, each, cols, vals = scoring.unpack_weights(pa.py_buffer(scoring.pack_weights(i, j, b)))
            assert np.repeat(items, each).tolist() == i.tolist() and cols.tolist() == j.tolist()
            assert (vals.view(np.int64) == b.view(np.int64)).all()


def test_a_row_travels_once_to_a_block(spark, monkeypatch, data, x):
    """The rows that blocks of users get are those of their items, each once, whatever the pieces."""
    monkeypatch.setattr(scoring, "_PIECE", 7)
    monkeypatch.setattr(scoring, "_WEIGHTS_PER_HOME", 20)
    w = np.where(np.random.default_rng(17).random((ITEMS, ITEMS)) < 0.5, 2.5, 0.0)
    w[4] = 0.0
    table, n = weight_table(spark, w)
    cells = data.cells.withColumn("block", (F.col("u") % 3).cast("int"))
    found = []
    for r in scoring.rows_of_blocks(cells, table, n, ITEMS, 3).collect():
        i, each, j, b = scoring.unpack_weights(pa.py_buffer(bytes(r["packed"])))
        found += zip([r["to"]] * j.size, np.repeat(i, each).tolist(), j.tolist(), b.tolist())
    wanted = {(u % 3, i) for u, i in zip(*map(lambda c: c.tolist(), np.nonzero(x)))}
    assert sorted(found) == sorted((to, i, int(j), 2.5) for to, i in wanted for j in np.flatnonzero(w[i]))


def _masks(spark, data, table, n, at_most):
    """Masked pairs by the column of own cells, next to those by a join; the plans of the former."""
    plain = score_pairs(data, table, n, at_most).select("u", F.col("j").alias("i"), F.col("s").alias("scores"))
    own = score_pairs(data, table, n, at_most, own="own").select("u", F.col("j").alias("i"), F.col("s").alias("scores"), "own")
    zero = zero_seen(own, data.cells, "u", "i", "v", own="own"), zero_seen(plain, data.cells, "u", "i", "v")
    gone = without_seen(own, data.cells, "u", "i", own="own"), without_seen(plain, data.cells, "u", "i")
    return zero, gone


def _pairs_of(df):
    assert df.columns == ["u", "i", "scores"]
    return sorted((r["u"], r["i"], round(r["scores"], 9)) for r in df.collect())


def _cells_of_zero(spark):
    """Cells of value 0 are seen, and still score."""
    rows = [(1, 0, 2.0), (1, 1, 0.0), (2, 1, 1.0), (2, 2, -1.0), (None, 0, 1.0), (3, 3, 1.0)]
    cells = laid_out(spark.createDataFrame(rows, "u long, i long, v double").filter("u is not null")).persist()
    table = spark.createDataFrame([(i, j, 1.0 + i + j) for i in range(3) for j in range(3)], "i long, j long, b double")
    return SimpleNamespace(n_items=4, n_cells=5, cells=cells), table


@pytest.mark.parametrize("at_most", [1 << 20, 16])
def test_zero_mask_joins_no_scores(spark, at_most):
    data, table = _cells_of_zero(spark)
    zero, _ = _masks(spark, data, table, 9, at_most)
    assert "Join" not in zero[0]._jdf.queryExecution().optimizedPlan().toString()
    found = _pairs_of(zero[0])
    assert found == _pairs_of(zero[1]) and (1, 0, 0.0) in found and (1, 1, 4.0) in found and len(found) == 6


@pytest.mark.parametrize("at_most", [1 << 20, 16])
def test_removing_mask_joins_no_scores(spark, at_most):
    data, table = _cells_of_zero(spark)
    _, gone = _masks(spark, data, table, 9, at_most)
    assert "Join" not in gone[0]._jdf.queryExecution().optimizedPlan().toString()
    found = _pairs_of(gone[0])
    assert found == _pairs_of(gone[1]) == [(1, 2, 6.0), (2, 0, -1.0)]


@pytest.mark.parametrize("query", ["mask_zero", "mask_remove"])
def test_masks_of_a_large_model_shuffle_no_scores(spark, monkeypatch, query):
    """With a model and a catalogue beyond what is joined in memory, the scored pairs meet no other table."""
    from reclattice.operators import encode
    from reclattice.plans import queries

    wanted = sorted(tuple(r) for r in queries.QUERIES[query](spark, "/root/testdata/sf0.001").collect())
    monkeypatch.setattr(queries, "score_pairs", lambda *a, **more: score_pairs(*a, 16, **more))
    monkeypatch.setattr(encode, "BROADCAST_BYTES", 8 * 200)
    df = queries.QUERIES[query](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan.split("InMemoryRelation")[0]
    assert wanted and sorted(tuple(r) for r in df.collect()) == wanted
