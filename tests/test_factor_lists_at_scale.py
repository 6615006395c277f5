"""Lists of factor models over many items: what is left out by bounds, and how often users are walked."""

from types import SimpleNamespace

import numpy as np
import pytest

from reclattice.models import als as als_module
from reclattice.models.als import ALS
from reclattice.models.base import laid_out
from reclattice.operators import scoring
from reclattice.operators.scoring import FactorLists, FactorStripe, recommend_factors


def _stripe(v):
    length = np.sqrt((v * v).sum(axis=1))
    order = np.lexsort((np.arange(len(v)), -length))
    return FactorStripe(order, v[order], length[order])


def _full(u, v, k, digits=None):
    scores = u @ v.T
    if digits is not None:
        scores = np.round(scores, digits)
    return [np.lexsort((np.arange(len(v)), -s))[:k].tolist() for s in scores]


def nothing(rows, lo, hi):
    return np.empty(0, np.int64), np.empty(0, np.int64)


def test_groups_of_other_directions_are_passed_over():
    """Vectors of one length, in clusters: lengths bound nothing, angles do."""
    draw = np.random.default_rng(3)
    v = np.repeat(draw.normal(size=(40, 6)), 500, axis=0) + 0.05 * draw.normal(size=(20_000, 6))
    v /= np.sqrt((v * v).sum(axis=1))[:, None]
    u = v[draw.choice(len(v), 50)] * draw.uniform(0.1, 9, (50, 1))
    row, ids, vals, scored = FactorLists(_stripe(v), 10, None, 1.0)(u, np.full(50, -np.inf), nothing)
    assert ids.reshape(50, 10).tolist() == _full(u, v, 10)
    assert scored.mean() < 0.5 * len(v)


@pytest.mark.parametrize("scale", [1e-30, 1.0, 1e30])
def test_single_precision_loses_nothing(scale):
    """Scores closer to each other than single precision tells apart, on vectors of any size."""
    draw = np.random.default_rng(4)
    v = (1.0 + 1e-8 * draw.integers(0, 50, (4000, 3))) * scale
    v[::7] = 0.0
    u = np.r_[draw.uniform(0.5, 1, (5, 3)), -draw.uniform(0.5, 1, (5, 3)), np.zeros((1, 3))]
    row, ids, vals, scored = FactorLists(_stripe(v), 6, None, float(np.sqrt((v * v).sum(axis=1)).max()))(
        u, np.full(11, -np.inf), nothing
    )
    size = np.sqrt((u * u).sum(axis=1)) * np.sqrt((v * v).sum(axis=1)).max()
    wanted = scoring.rounded_scores(u @ v.T, None, size)
    assert ids.reshape(11, 6).tolist() == [np.lexsort((np.arange(4000), -s))[:6].tolist() for s in wanted]


def test_users_leave_when_no_later_stripe_can_change_their_list(spark, monkeypatch):
    """Seven stripes of items; the lists of all users are full after the first ones."""
    draw = np.random.default_rng(5)
    v = draw.normal(size=(60, 3)) / np.arange(1, 61)[:, None] ** 1.5
    u = draw.normal(size=(25, 3))
    cells = laid_out(spark.createDataFrame([(n, n % 60, 1.0) for n in range(25)], "u long, i long, v double")).persist()
    data = SimpleNamespace(n_items=60, n_cells=25, cells=cells)
    people = spark.createDataFrame([(n, r.tolist()) for n, r in enumerate(u)], "id long, vec array<double>")
    items = spark.createDataFrame([(n, r.tolist(), f"i{n}") for n, r in enumerate(v)], "id long, vec array<double>, name string")
    sent = []
    plain = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: (sent.append(value), plain(self, value))[1])
    from pyspark.sql.types import StringType

    found = recommend_factors(data, people, items, 3, 4, True, None, 60 * 8 * 5 // 7, StringType())
    scores = u @ v.T
    scores[np.arange(25), np.arange(25) % 60] = -np.inf
    wanted = [[f"i{j}" for j in np.lexsort((np.arange(60), -s))[:4]] for s in scores]
    got = [[] for _ in range(25)]
    for r in found.orderBy("u", "rank").collect():
        got[r["u"]].append(r["name"])
    assert got == wanted
    assert len([s for s in sent if isinstance(s, FactorStripe)]) < 7


def test_ids_of_a_large_catalogue_are_looked_up_before_the_scoring(spark, golden, monkeypatch):
    model = ALS(n_iterations=2, n_factors=2, top_k=3)
    wanted = model.fit_predict(golden.train).collect()
    monkeypatch.setattr(als_module, "BROADCAST_BYTES", 0)
    found = model.fit_predict(golden.train)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
