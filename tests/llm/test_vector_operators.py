"""Top-k search, whitening and lookup-table clusters against brute force."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from reclattice.llm import lookup_clusters, topk, whitening
from reclattice.llm.vectors import integer_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, id long, x string, rank int"


def table(spark, rows, parts=3):
    """Rows of (vec_id, embedding), with extra columns whose names clash with inner ones."""
    data = [(i, e and [c if c is None else float(c) for c in e], 1, 5, "x", 9) for i, e in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(parts)


def floats(rows, dims, seed, spread=1.0):
    draw = np.random.default_rng(seed)
    return [(i, [float(np.float32(v)) for v in draw.normal(0, spread, dims)]) for i in range(rows)]


def whole(vector, scale):
    return [math.floor(scale * float(np.float32(c))) for c in vector]


def usable(vector):
    return vector is not None and all(c is not None and math.isfinite(c) for c in vector)


ODD = [
    (1000, None), (1020, [1.0, None, 2.0]), (1040, [float("nan")] * 4), (1060, [float("inf"), 0.0]),
]


# ------------------------------------------------------------------ top-k


def best(rows, k, every=20, scale=64):
    kept = [(i, whole(e, scale)) for i, e in rows if usable(e)]
    kept = [(i, x) for i, x in kept if sum(c * c for c in x) < 2**62]
    out = []
    for at, (i, x) in enumerate(kept):
        if i is None or i % every:
            continue
        scored = sorted(
            (-sum(a * b for a, b in zip(x, y)), j is None, j or 0) for other, (j, y) in enumerate(kept) if other != at
        )
        out += [(i, rank, None if none else j, -s) for rank, (s, none, j) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def searched(df, k, **more):
    return sorted((tuple(r) for r in topk.top_neighbours(df, k, **more).collect()), key=str)


@pytest.mark.parametrize("slices", [1, 2, 5])
def test_top_k_equals_brute_force(spark, monkeypatch, slices):
    monkeypatch.setattr(topk, "CANDIDATES", 40)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rows = floats(150, 7, 1) + ODD
    # Ties: equal vectors under many ids, a query among them; small integers tie often.
    rows += [(i, [1.0, 0.5, 0, 0, 0, 0, 0]) for i in range(200, 230)]
    rows += [(i, [float(i % 3), float(i % 2), 0, 0, 0, 0, 0]) for i in range(300, 340)]
    ints = integer_vectors(table(spark, rows), 64.0)
    found = topk.search(ints, ints.filter("id % 20 = 0"), 4, slices)
    assert sorted((tuple(r) for r in found.collect()), key=str) == best(rows, 4)


def test_top_k_odd_rows(spark):
    # Fewer candidates than k, repeated rows, ids with two vectors, null ids, vectors of other lengths, an empty
    # one, components too large for a long, and offsets that all vectors share.
    rows = [
        (20, [1.0, 2.0]), (20, [1.0, 2.0]), (40, [3.0]), (40, [-3.0, 1.0]), (None, [1.0, 2.0]), (None, [0.5, 0.5]),
        (60, []), (7, [1e30, 1.0]), (80, [-1e30, 1.0]), (9, [0.0, 0.0]), (11, [-1.0, -2.0]), *ODD,
    ]
    assert searched(table(spark, rows), 50) == best(rows, 50)
    assert searched(table(spark, rows), 3) == best(rows, 3)
    far = [(i, [500.0 + e[0], *e[1:], -300.0]) for i, e in floats(120, 5, 3)]
    assert searched(table(spark, far), 6) == best(far, 6)
    large = [(i, [c * 1e6 for c in e]) for i, e in floats(60, 6, 4)]
    assert searched(table(spark, large), 5) == best(large, 5)


def test_top_k_of_nothing(spark):
    assert searched(table(spark, [], 1), 3) == []
    assert searched(table(spark, [(1, [1.0]), (2, [2.0])]), 3) == []
    assert searched(table(spark, [(20, [1.0])]), 3) == []
    assert topk.top_neighbours(table(spark, [], 1)).columns == ["query_id", "rank", "vec_id", "score"]


# ------------------------------------------------------------------ whitening


def exact_fit(vectors):
    distinct = sorted({tuple(v) for v in vectors})
    n, dims = len(distinct), len(distinct[0])
    sums = [sum(v[d] for v in distinct) for d in range(dims)]
    mean = [Fraction(s, n) for s in sums]
    cov = [[sum((v[a] - mean[a]) * (v[b] - mean[b]) for v in distinct) / n for b in range(dims)] for a in range(dims)]
    return n, sums, distinct, np.array([[float(c) for c in row] for row in cov])


@pytest.mark.parametrize("spread", [0.2, 3e7, 1e12])
def test_covariance_is_exact(spark, spread):
    rows = floats(60, 6, 5, spread)
    rows = [(i, [e[0] + 50 * spread, *e[1:]]) for i, e in rows]
    ints = integer_vectors(table(spark, rows + rows[:7]), 256.0)
    model = whitening.fit_whitening(ints.select("x").distinct(), 4)
    n, sums, _, cov = exact_fit([whole(e, 256) for _, e in rows])
    assert (model.n, model.sums) == (n, sums)
    assert (model.covariance == cov).all()


def test_whitening_equals_brute_force(spark):
    draw = np.random.default_rng(6)
    mix = draw.normal(0, 0.4, (5, 5))
    rows = [(i, [float(np.float32(c)) for c in draw.normal(0, 1, 5) @ mix]) for i in range(200)]
    rows += [(None, rows[3][1]), (3, rows[3][1]), (7, rows[9][1]), (500, [1.0, 2.0]), (501, []), *ODD]
    found = whitening.whiten(table(spark, rows)).collect()
    kept = [(i, whole(e, 256)) for i, e in rows if usable(e) and len(e) == 5]
    n, sums, distinct, cov = exact_fit([x for _, x in kept])
    values, axes = np.linalg.eigh(cov)
    assert len(found) == 4 * len(kept)
    assert {r["component"] for r in found} == {1, 2, 3, 4} and {r["n"] for r in found} == {n}
    deviation = {(i, sum((n * c - s) ** 2 for c, s in zip(x, sums))) for i, x in kept}
    assert {(r["id"], r["deviation"]) for r in found} == deviation
    for component in range(4):
        mine = {r["id"]: r for r in found if r["component"] == component + 1}
        axis, value = axes[:, -1 - component], values[-1 - component]
        expected = {i: float((np.array(x) - np.array(sums) / n) @ axis / math.sqrt(value)) for i, x in kept if i not in (3, 7)}
        sign = 1 if expected[0] * mine[0]["whitened"] > 0 else -1
        for i, w in expected.items():
            assert mine[i]["whitened"] == pytest.approx(sign * w, rel=1e-9, abs=1e-9)
        assert mine[0]["explained"] == pytest.approx(value / np.trace(cov), rel=1e-9)
    assert {r["identity_error"] for r in found if r["identity_error"] > 1e-9} == set()


def test_whitening_without_variance(spark):
    assert whitening.whiten(table(spark, [], 1)).collect() == []
    assert whitening.whiten(table(spark, ODD)).collect() == []
    found = whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(found) == 4
    assert {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in found} == {(1, 0, None, None, None)}
    # Two dimensions that move together: the second component has no variance.
    found = whitening.whiten(table(spark, [(i, [float(i), float(i)]) for i in range(9)])).collect()
    assert {r["whitened"] is None for r in found if r["component"] == 2} == {True}
    assert all(r["identity_error"] < 1e-9 for r in found)
    # Components at the bounds of a long: the sums stay exact, deviations that do not fit are null.
    found = whitening.whiten(table(spark, [(1, [3e38, 0.0]), (2, [-3e38, 0.0]), (3, [0.0, 1.0])])).collect()
    assert {r["deviation"] for r in found if r["id"] == 1} == {None} and all(r["identity_error"] < 1e-4 for r in found)


# ------------------------------------------------------------------ clusters


def lloyd(rows, clusters, rounds, dims):
    kept = [(i, whole(e, 64)) for i, e in rows if usable(e) and len(e) == dims]
    kept = [(i, x) for i, x in kept if max(map(abs, x)) < 2**27]
    mark = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest()
    starts = sorted(kept, key=lambda r: (r[0] is None, mark(r[0]) if r[0] is not None else "", r[1]))
    centroids = [x for _, x in starts[:clusters]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        member = [nearest(x)[1] for _, x in kept]
        for n in range(len(centroids)):
            mine = [x for (_, x), m in zip(kept, member) if m == n]
            if mine:
                centroids[n] = [sum(c) // len(mine) for c in zip(*mine)]
    final = [(i, *nearest(x)) for i, x in kept]
    inertia = {n: sum(d for _, d, m in final if m == n) for n in range(len(centroids))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), digest[n]) for i, d, n in final), key=str)


@pytest.mark.parametrize("listed", [1 << 17, 10])
def test_clusters_equal_brute_force(spark, monkeypatch, listed):
    monkeypatch.setattr(lookup_clusters, "LISTED", listed)
    rows = floats(120, 4, 7) + ODD + [(5000, [1.0, 2.0]), (5001, [1e30] * 4), (None, [0.1, 0.2, 0.3, 0.4])]
    rows += [(i, [1.0, 1.0, 0.0, 0.0]) for i in range(200, 260)] + [(3, [0.5, 0.5, 0.5, 0.5])]
    found = lookup_clusters.cluster(table(spark, rows), clusters=5, dims=4)
    assert found.columns == ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == lloyd(rows, 5, 3, 4)


def test_clusters_of_few_vectors(spark):
    rows = [(1, [1.0, 2.0]), (2, [-1.0, 0.0]), (2, [-1.0, 0.0]), (None, [4.0, 4.0])]
    found = lookup_clusters.cluster(table(spark, rows), clusters=16, dims=2)
    assert sorted((tuple(r) for r in found.collect()), key=str) == lloyd(rows, 16, 3, 2)
    assert lookup_clusters.cluster(table(spark, ODD), dims=2).collect() == []
    assert lookup_clusters.cluster(table(spark, [], 1)).collect() == []


def test_tables_give_squared_distances():
    draw = np.random.default_rng(8)
    x, centroids = draw.integers(-70, 70, (200, 9)), draw.integers(-70, 70, (4, 9))
    lists, place = lookup_clusters.Places(None).of(x)
    far = lookup_clusters.distances(lookup_clusters.tabulate(lists, centroids), place)
    assert (far == ((x[:, None] - centroids[None]) ** 2).sum(axis=2)).all()


def test_new_queries_have_their_columns(spark):
    from reclattice.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    assert QUERIES["op11_top_neighbours"](spark, sf).columns[:4] == ["query_id", "rank", "vec_id", "score"]
    white = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert QUERIES["op12_whitening"](spark, sf).columns[:7] == white
    clusters = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert QUERIES["op13_lookup_clusters"](spark, sf).columns[:6] == clusters
