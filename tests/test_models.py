"""Gram table, solvers and scoring against plain numpy."""

import os
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import GOLDEN, SCHEMA, rows
from reclattice.models.als import ALS, initial_factors
from reclattice.models.ease import EASE
from reclattice.models import certificates, slim
from reclattice.models.base import laid_out
from reclattice.models.slim import SLIM, fit_weights, l1_ratio
from reclattice.operators.matrix import both_triangles, gram
from reclattice.operators.scoring import best_per_row, recommend_sparse, rounded_scores


@pytest.fixture(scope="module")
def ratings(spark):
    rng = np.random.default_rng(5)
    table = [
        (int(u), int(i), float(rng.integers(4, 6)), int(rng.integers(100)))
        for u in range(40) for i in rng.choice(30, size=29 if u == 0 else int(rng.integers(2, 9)), replace=False)
    ]
    table += table[:10]
    return spark.createDataFrame(table, SCHEMA), table


def matrix(table, value):
    x = np.zeros((40, 30))
    for u, i, r, _ in table:
        x[u, i] += value(r)
    return x


def dense(df, n, value="b"):
    out = np.zeros((n, n))
    for r in df.collect():
        out[r["i"], r["j"]] = r[value]
    return out


def ease_numpy(x, l2):
    p = np.linalg.inv(x.T @ x + l2 * np.eye(x.shape[1]))
    b = p / -np.diag(p)
    np.fill_diagonal(b, 0.0)
    return b


def listed(scores, k, users=40):
    """Expected (user, item, rank, score): best first, ties by item."""
    scores = np.round(scores, 9)
    out = []
    for u in range(users):
        order = [j for j in np.lexsort((np.arange(scores.shape[1]), -scores[u])) if np.isfinite(scores[u, j])][:k]
        out += [(u, int(j), r + 1, float(scores[u, j])) for r, j in enumerate(order)]
    return out


def same_lists(recs, expect):
    got = [(r["user"], r["item"], r["rank"], r["scores"]) for r in recs.orderBy("user", "rank").collect()]
    assert [g[:3] for g in got] == [e[:3] for e in expect]
    assert np.allclose([g[3] for g in got], [e[3] for e in expect], atol=1e-8)


def test_golden_gram_and_ease(golden):
    model = EASE(l2_reg=1.0, top_k=4)
    data = model.prepare(golden.train)
    assert dense(both_triangles(data.gram), 4, "g").tolist() == [[2, 2, 1, 0], [2, 3, 2, 0], [1, 2, 2, 0], [0, 0, 0, 1]]
    expect = [[0, 0.5, 0, 0], [0.5, 0, 0.5, 0], [0, 0.5, 0, 0], [0, 0, 0, 0]]
    assert np.allclose(dense(model.weights(data), 4), expect, atol=1e-12)
    top = rows(model.recommend(data).filter("rank = 1"), "user", "item", "scores")
    assert top == [(1, 10, 0.0), (2, 12, 0.5), (3, 10, 0.5), (4, 10, 0.0)]


def test_golden_slim(golden):
    model = SLIM(l1_reg=1.0, l2_reg=9.0, top_k=4, score_digits=9)
    data = model.prepare(golden.train)
    a, b, c = 0.242424242, 0.023058252, 0.235436893
    expect = [[0, a, b, 0], [c, 0, c, 0], [b, a, 0, 0], [0, 0, 0, 0]]
    assert np.allclose(dense(model.weights(data), 4), expect, atol=1e-8)
    top = rows(model.recommend(data).filter("rank = 1"), "user", "item", "scores")
    assert top == [(1, 10, 0.0), (2, 12, 0.258495146), (3, 10, 0.258495146), (4, 10, 0.0)]
    assert model.l1_reg == 1.0


@pytest.mark.parametrize("wide_row", [4096, 7])
def test_gram(spark, ratings, wide_row):
    data = EASE(binarize=False).prepare(ratings[0])
    x = matrix(ratings[1], lambda r: r)
    upper = gram(data.cells, 30, wide_row)
    assert np.allclose(dense(both_triangles(upper), 30, "g"), x.T @ x)


@pytest.mark.parametrize("tile", [None, 11])
@pytest.mark.parametrize("mask", ["zero", "remove"])
def test_ease_lists(ratings, tile, mask):
    x = matrix(ratings[1], lambda r: 1.0)
    b = ease_numpy(x, 3.0)
    model = EASE(l2_reg=3.0, top_k=12, tile=tile, mask=mask)
    data = model.prepare(ratings[0])
    assert np.allclose(dense(model.weights(data), 30), b, atol=1e-10)
    scores = np.where(x != 0, 0.0 if mask == "zero" else -np.inf, x @ b)
    same_lists(model.recommend(data), listed(scores, 12))


@pytest.mark.parametrize("l2", [0.5, 40.0])
def test_one_factorisation_serves_every_l2(ratings, l2):
    """Also for a Gram matrix without full rank (item 29 and a copy of its column)."""
    table = ratings[1] + [(u, 30, r, t) for u, i, r, t in ratings[1] if i == 29]
    df = ratings[0].sparkSession.createDataFrame(table, SCHEMA)
    x = np.zeros((40, 31))
    for u, i, _, _ in table:
        x[u, i] += 1.0
    model = EASE(l2_reg=l2, top_k=9)
    data = model.prepare(df)
    model.share(data)
    made = data.spectrum
    assert np.allclose(dense(model.weights(data), 31), ease_numpy(x, l2), atol=1e-9)
    model.share(data)
    assert data.spectrum is made
    same_lists(model.recommend(data), listed(np.where(x != 0, 0.0, x @ ease_numpy(x, l2)), 9))


def slim_numpy(x, ratio, positive):
    n, m = x.shape
    g = x.T @ x / n
    w = np.zeros((m, m))
    for j in range(m):
        for _ in range(3000):
            before = w[:, j].copy()
            for i in range(m):
                if i != j:
                    pull = g[i, j] - g[i] @ w[:, j] + g[i, i] * w[i, j]
                    step = max(pull - ratio, 0) if positive else np.sign(pull) * max(abs(pull) - ratio, 0)
                    w[i, j] = step / (g[i, i] + 1 - ratio)
            if np.abs(before - w[:, j]).max() < 1e-13:
                break
    return np.where(w > 0, w, 0)


@pytest.mark.parametrize("room", [2048, 40, 3])
@pytest.mark.parametrize("positive", [True, False])
def test_slim_weights(monkeypatch, ratings, positive, room):
    """In one group per pivot, in groups cut by their candidates, and target by target."""
    monkeypatch.setattr(slim, "_CANDIDATES_PER_GROUP", room)
    x = matrix(ratings[1], lambda r: 1.0)
    data = SLIM().prepare(ratings[0])
    got = dense(fit_weights(data, 0.02, positive), 30)
    assert np.allclose(got, slim_numpy(x, 0.02, positive), atol=1e-9)
    assert (got > 0).sum() > 10


@pytest.mark.parametrize("mask", ["zero", "remove"])
def test_slim_lists_are_filled_in_item_order(ratings, mask):
    x = matrix(ratings[1], lambda r: 1.0)
    b = slim_numpy(x, l1_ratio(1.0, 19.0), True)
    scores = np.where(x != 0, 0.0 if mask == "zero" else -np.inf, x @ b)
    same_lists(SLIM(l1_reg=1.0, l2_reg=19.0, top_k=25, mask=mask).fit_predict(ratings[0]), listed(scores, 25))


def test_negative_scores_rank_below_unscored_items(spark):
    cells = laid_out(spark.createDataFrame([(1, 0, 1.0), (1, 1, -2.0), (2, 2, 1.0)], "u long, i long, v double"))
    weights = spark.createDataFrame([(0, 3, 0.5), (1, 4, 0.25), (1, 5, 1.0)], "i long, j long, b double")
    data = SimpleNamespace(n_items=6, cells=cells)
    for mask in ("none", "zero"):
        found = recommend_sparse(data, weights, 3, 6, mask).filter("u = 1").orderBy("rank").collect()
        assert [(r["i"], r["scores"]) for r in found] == [(3, 0.5), (0, 0.0), (1, 0.0), (2, 0.0), (4, -0.5), (5, -2.0)]
    found = recommend_sparse(data, weights, 3, 3, "remove").filter("u = 1").orderBy("rank").collect()
    assert [r["i"] for r in found] == [3, 2, 4]


def test_scores_keep_their_order_at_any_size():
    scores = np.array([[3e-12, 1e-12, 2e-12], [0.0, 0.0, 0.0], [1.0, 1.0 + 1e-13, -1.0]])
    close = rounded_scores(scores, None)
    assert list(np.argsort(-close[0])) == [0, 2, 1] and close[2, 0] == close[2, 1] and not close[1].any()
    assert not rounded_scores(scores[:1], 9).any()


def test_a_solve_that_does_not_settle_is_an_error(monkeypatch):
    monkeypatch.setattr(slim, "_MAX_SWEEPS", 1)
    square = np.array([[1.0, 0.9], [0.9, 1.0]])
    with pytest.raises(RuntimeError):
        slim.coordinate_descent(square, np.array([[0.9], [0.8]]), np.ones((2, 1), bool), 0.1, True)


def test_groups_are_bounded_and_whole(spark):
    """Every target is in one group; groups of small targets stay under twice the bound."""
    rng = np.random.default_rng(17)
    pairs = [(int(i), j, 1.0) for j in range(60) for i in rng.choice(400, size=int(rng.integers(1, 90)), replace=False)]
    pairs += [(int(i), 100, 1.0) for i in range(3000)]
    placed = slim._groups(spark.createDataFrame(pairs, "i long, j long, g double")).collect()
    size = {}
    for _, j, _ in pairs:
        size[j] = size.get(j, 0) + 1
    assert sorted(r["j"] for r in placed) == sorted(size)
    groups = {}
    for r in placed:
        groups.setdefault((r["pivot"], r["cut"]), []).append(r["j"])
    assert groups[-1, 100] == [100]
    assert all(sum(size[j] for j in g) < 2 * slim._CANDIDATES_PER_GROUP for key, g in groups.items() if key[0] >= 0)


def test_both_descents_agree():
    rng = np.random.default_rng(18)
    x = (rng.random((300, 40)) < 0.2).astype(float)
    g, c = x.T @ x / 300, x.T @ (rng.random(300) < 0.3) / 300
    upper = np.triu_indices(40)
    for positive in (True, False):
        dense_way = slim.coordinate_descent(g, c[:, None], np.ones((40, 1), bool), 0.02, positive)[:, 0]
        assert np.allclose(slim.sparse_descent(*upper, g[upper], c, 0.02, positive), dense_way, atol=1e-10)
        assert (dense_way != 0).any()


def sweeps(monkeypatch, solve):
    """The least number of sweeps in which ``solve`` settles."""
    for n in range(1, 2000):
        monkeypatch.setattr(slim, "_MAX_SWEEPS", n)
        try:
            return n, solve()
        except RuntimeError:
            pass


def test_a_warm_start_saves_sweeps_and_changes_nothing(monkeypatch, ratings):
    rng = np.random.default_rng(20)
    x = (rng.random((200, 25)) < 0.35).astype(float)
    g = x.T @ x / 200
    allowed = ~np.eye(25, dtype=bool)
    near = slim.coordinate_descent(g, g.copy(), allowed, 0.021, True)
    cold, plain = sweeps(monkeypatch, lambda: slim.coordinate_descent(g, g.copy(), allowed, 0.02, True))
    warm, begun = sweeps(monkeypatch, lambda: slim.coordinate_descent(g, g.copy(), allowed, 0.02, True, near))
    assert warm < cold and np.allclose(plain, begun, atol=1e-11)
    upper = np.triu_indices(25)
    one = g[:, 0].copy()
    cold, plain = sweeps(monkeypatch, lambda: slim.sparse_descent(*upper, g[upper], one, 0.02, True))
    start = slim.sparse_descent(*upper, g[upper], one, 0.0201, True)
    warm, begun = sweeps(monkeypatch, lambda: slim.sparse_descent(*upper, g[upper], one, 0.02, True, start))
    assert warm < cold and np.allclose(plain, begun, atol=1e-11)


def test_fits_along_the_path_are_the_same(ratings):
    x = matrix(ratings[1], lambda r: 1.0)
    model = SLIM(l1_reg=1.0, l2_reg=19.0)
    data = model.prepare(ratings[0])
    model.share(data)
    model.recommend(data)
    follower = model.with_params(1.0, 29.0)
    assert len(data.path) == 1 and follower._nearest(data) is data.path[0][1]
    assert np.allclose(dense(follower.fit(data), 30), slim_numpy(x, l1_ratio(1.0, 29.0), True), atol=1e-9)


def test_slim_ratio():
    assert l1_ratio(1, 9) == 0.1 and l1_ratio(2, 0) == 1.0
    with pytest.raises(ValueError):
        l1_ratio(0, 0)


def als_numpy(spark, x, f, iterations, l2):
    start = initial_factors(spark.range(x.shape[1]), f, 42).orderBy("id").collect()
    y = np.array([r["vec"] for r in start])

    def half(c, y):
        base = y.T @ y + l2 * np.eye(f)
        return np.array([
            np.linalg.solve(base + (y[r != 0].T * (r[r != 0] - 1)) @ y[r != 0], r @ y) for r in c
        ])

    for _ in range(iterations):
        u = half(x, y)
        y = half(x.T, u)
    return u, y


@pytest.mark.parametrize("binarize,hot_cells", [(True, 1000), (False, 1000), (False, 8)])
def test_als(spark, ratings, binarize, hot_cells):
    x = matrix(ratings[1], lambda r: 1.0 if binarize else r)
    u, v = als_numpy(spark, x, 3, 2, 0.5)
    model = ALS(n_factors=3, n_iterations=2, reg=0.5, top_k=8, binarize=binarize, hot_cells=hot_cells)
    data = model.prepare(ratings[0])
    users, items = model.fit(data)
    got = np.array([r["vec"] for r in users.orderBy("id").collect()])
    assert np.allclose(got, u, atol=1e-8)
    assert np.allclose([r["vec"] for r in items.orderBy("id").collect()], v, atol=1e-8)
    if hot_cells == 1000:
        same_lists(model.recommend(data), listed(np.where(x != 0, -np.inf, u @ v.T), 8))


def test_als_spark_ml_engine(ratings):
    recs = ALS(n_factors=3, n_iterations=2, reg=0.1, top_k=5, engine="ml").fit_predict(ratings[0])
    seen = ratings[0].select("user", "item")
    assert recs.join(seen, ["user", "item"]).isEmpty()
    assert recs.groupBy("user").agg(F.max("rank").alias("r")).agg(F.max("r")).first()[0] == 5


def test_best_per_row_breaks_ties_by_column():
    scores = np.array([[0.0, 1.0, 0.0, 0.0], [2.0, 2.0, 3.0, 2.0], [-np.inf, -np.inf, 1.0, -np.inf]])
    cols, vals = best_per_row(scores, 2)
    assert cols[:2].tolist() == [[1, 0], [2, 0]] and vals[2].tolist() == [1.0, -np.inf]


def test_certificates_tell_an_optimum_from_a_near_one(spark, ratings):
    x = matrix(ratings[1], lambda r: 1.0)
    worst = lambda found: found.first()["worst"]
    model = EASE(l2_reg=3.0)
    data = model.prepare(ratings[0])
    weights = model.weights(data)
    found = certificates.ease_residual(data, weights, 3.0).first()
    assert found["checked"] == 30 and found["worst"] < 1e-10
    nudged = F.when((F.col("i") == 3) & (F.col("j") == 4), F.col("b") + 1e-4).otherwise(F.col("b"))
    assert worst(certificates.ease_residual(data, weights.withColumn("b", nudged), 3.0)) > 1e-6
    assert worst(certificates.ease_residual(data, weights, 3.1)) > 1e-6
    sparse = fit_weights(data, 0.02)
    found = certificates.slim_gap(data, sparse, 0.02).first()
    assert found["checked"] == 30 and found["worst"] < 1e-10
    one = sparse.orderBy(F.desc("b")).first()
    lost = sparse.filter((F.col("i") != one["i"]) | (F.col("j") != one["j"]))
    assert worst(certificates.slim_gap(data, lost, 0.02)) > 1e-4
    als = ALS(n_factors=3, n_iterations=2, reg=0.5, binarize=False)
    data = als.prepare(ratings[0])
    users, items = als.fit(data)
    found = certificates.als_residual(data, users, items, 3, 0.5).first()
    assert found["checked"] == 30 and found["worst"] < 1e-10
    assert worst(certificates.als_residual(data, users, items, 3, 0.6)) > 1e-6
    x = matrix(ratings[1], lambda r: r)
    u, v = als_numpy(spark, x, 3, 2, 0.5)
    confidence = np.where(x != 0, x, 1.0)
    loss = (confidence * ((x > 0) - u @ v.T) ** 2).sum() + 0.5 * ((u * u).sum() + (v * v).sum())
    assert np.isclose(certificates.als_training_loss(data, users, items, 3, 0.5), loss / confidence.sum())


def test_sweep_keeps_one_table(spark, tmp_path):
    """Blocked inverse over several tiles, the last one narrower; tables of earlier steps are gone."""
    from reclattice import session
    from reclattice.operators import tiles as T

    x = np.random.default_rng(19).normal(size=(50, 23))
    a = x.T @ x
    upper = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(23) for j in range(i, 23)], "i long, j long, g double")
    folder = session.checkpoint_dir(spark).removeprefix("file:")
    before = {p for p in os.listdir(folder) if p.startswith(("tiles-", "panel-"))}
    found = T.negative_inverse(T.pack(upper, 23, 6, 0.5), 23, 6)
    left = {p for p in os.listdir(folder) if p.startswith(("tiles-", "panel-"))} - before
    got = dense(T.entries(T.mirrored(found, 23, 6), 23, 6), 23)
    assert np.allclose(got, -np.linalg.inv(a + 0.5 * np.eye(23)), atol=1e-10) and len(left) == 1


def test_chunks_of_many_users_are_multiplied_together(monkeypatch):
    """Products of narrow chunks are added a batch at a time, not one group at a time."""
    import pyarrow as pa

    from reclattice.operators import matrix

    draw = np.random.default_rng(3)
    n_items, cells = 3000, []
    for u in range(400):
        items = np.sort(draw.choice(40, size=6, replace=False)) * 70
        own = draw.integers(0, 2, 6)
        for a, b in ((0, 0), (0, 1), (1, 1)):
            cells += [(u, a, b, o, i, 1.0 + i % 3) for o, i in zip(own, items) if o in (a, b)]
    names = ["u", "a", "b", "own", "i", "v"]
    whole = pa.table({n: [c[at] for c in cells] for at, n in enumerate(names)})
    calls = []
    plain = matrix._PairSums.add
    monkeypatch.setattr(matrix._PairSums, "add", lambda self, *a: calls.append(a[0].size) or plain(self, *a))
    for products in (2_000_000, 50):
        monkeypatch.setattr(matrix, "_PRODUCTS_AT_ONCE", products)
        monkeypatch.setattr(matrix, "_PAIRS_HELD", 300)
        calls.clear()
        found = {}
        for batch in matrix._chunk_sums(n_items)(iter(whole.to_batches(max_chunksize=1000))):
            for i, j, g in zip(*(batch.column(n).to_pylist() for n in "ijg")):
                found[i, j] = found.get((i, j), 0) + g
        expected = {}
        for u in range(400):
            mine = sorted({c[4:] for c in cells if c[0] == u})
            for at, (i, x) in enumerate(mine):
                for j, y in mine[at:]:
                    expected[i, j] = expected.get((i, j), 0) + x * y
        assert found == pytest.approx(expected)
        # 50 products, and those of the last cell of a part.
        assert len(calls) < 20 if products > 50 else max(calls) < 60
