"""What the evaluation of large runs relies on: how often predictions travel, and what points share."""

import math
import random

import pytest

from reclattice.models import als as als_module
from reclattice.models.als import ALS
from reclattice.operators.metrics import metric_panel
from reclattice.plans.grid import grid_search


def _random_sides(seed):
    rng = random.Random(seed)
    users = [None, *range(12)]
    item = lambda: rng.choice([None, *range(9)])
    pred = [(p, u, item(), rng.choice([None, 1.0, 2.0, rng.random()])) for p in (0, 1) for u in users for _ in range(rng.randint(0, 9))]
    true = [(u, item(), rng.randint(0, 3)) for u in users for _ in range(rng.randint(0, 6))]
    return pred, true


def _expected(pred, true, k, positional):
    """Means over users of recall@k and ndcg@k, by the definition, row by row."""
    low = lambda v: (v is not None, v if v is not None else 0)
    found = []
    for u in {p[0] for p in pred} & {t[0] for t in true} - {None}:
        mine = sorted((p for p in pred if p[0] == u), key=lambda p: ((0, -p[2]) if p[2] is not None else (1, 0), low(p[1])))
        mine = [p[1] for p in mine[:k]]
        ordered = [t[1] for t in sorted((t for t in true if t[0] == u), key=lambda t: (t[2], low(t[1])))]
        items = set(ordered)
        if positional:
            hit = [p is not None and r < len(ordered) and ordered[r] == p for r, p in enumerate(mine)]
        else:
            hit = [p is not None and p in items for p in mine]
        size = len(ordered) if positional else len(items)
        d = lambda n: sum(1 / math.log2(r + 2) for r in range(n))
        best = d(min(k, size)) - (d(min(k, size) - sum(hit)) if positional else 0)
        ndcg = sum(1 / math.log2(r + 2) for r, h in enumerate(hit) if h) / best if any(hit) else 0.0
        found.append((len({p for p in mine if p is not None} & items) / len(items), ndcg))
    return [sum(c) / len(found) for c in zip(*found)]


@pytest.mark.parametrize("variant", ["positional", "standard"])
def test_panel_equals_the_definition(spark, variant):
    for seed in (1, 2):
        pred, true = _random_sides(seed)
        frames = spark.createDataFrame(pred, "p int, user long, item long, scores double"), spark.createDataFrame(
            true, "user long, item long, timestamp long"
        )
        panel = {r["p"]: r for r in metric_panel(*frames, (1, 5), variant=variant, by=("p",)).collect()}
        for p in (0, 1):
            for k in (1, 5):
                wanted = _expected([row[1:] for row in pred if row[0] == p], true, k, variant == "positional")
                assert [panel[p][f"recall@{k}"], panel[p][f"ndcg@{k}"]] == pytest.approx(wanted)


def test_predictions_travel_as_rows_once(spark):
    """They are ranked after one shuffle; what follows moves one list a user."""
    pred = spark.createDataFrame([(0, 1, 2, 0.5)], "p int, user long, item long, scores double")
    true = spark.createDataFrame([(1, 2, 3)], "user long, item long, timestamp long")
    plan = metric_panel(pred, true, by=("p",))._jdf.queryExecution().optimizedPlan().toString()
    # Two rankings, and no further window for repeated predictions.
    assert plan.count("Window [row_number()") == 2


def test_points_share_the_blocks_of_cells(spark, golden, monkeypatch):
    made = []
    plain = als_module._Side.__init__

    def counted(self, *args):
        made.append(args[1])
        plain(self, *args)

    monkeypatch.setattr(als_module._Side, "__init__", counted)
    model = ALS(n_iterations=1, top_k=5, score_digits=9)
    shared = grid_search(model, {"l2": [1, 10], "n_factors": [1, 2]}, golden.train, ks=(1, 5)).history.collect()
    assert sorted(made) == ["i", "u"]
    alone = [grid_search(model, {"l2": [l2], "n_factors": [f]}, golden.train, ks=(1, 5)).history.first() for l2 in (1, 10) for f in (1, 2)]
    assert [tuple(r)[1:] for r in shared] == [tuple(r)[1:] for r in alone]
