"""Metrics, grid search, histories, reports, and a few registered queries next to their SQL."""

import math

import pytest

from conftest import rows
from oracle_check import difference, duck
from reclattice.models.ease import EASE
from reclattice.models.slim import SLIM
from reclattice.operators.metrics import metric_names, metric_panel, ndcg_k, recall_k
from reclattice.plans.grid import best_params, grid_search
from reclattice.plans.report import compare_models, report_tables
from reclattice.sources import history as H
from reclattice.sources import sinks

CASES = [
    ([13, 14], [13, 14], 5, 1.0, 1.0, 1.0),
    ([13, 14], [13, 10], 5, 0.5, 1.5849625007, 1.0),
    ([13, 14], [10, 14], 5, 0.5, 1.0, 0.6309297536),
    ([13, 14], [14, 13], 5, 1.0, 0.0, 0.0),
    ([1, 2, 3, 4, 5], [1, 9, 8, 7, 6], 5, 0.2, 2.5849625007, 1.0),
    ([1, 2, 3, 4, 5], [1, 9, 3, 7, 6], 5, 0.4, 1.8347964778, 0.9197207891),
    ([1, 2, 3, 4, 5], [1, 9, 3, 7, 6], 1, 0.2, 1.0, 1.0),
]


def frames(spark, cases):
    pred = [(u, i, float(-r)) for u, (_, p, *_rest) in enumerate(cases) for r, i in enumerate(p)]
    true = [(u, i, t) for u, (a, *_rest) in enumerate(cases) for t, i in enumerate(a)]
    return (
        spark.createDataFrame(pred, "user long, item long, scores double"),
        spark.createDataFrame(true, "user long, item long, timestamp long"),
    )


@pytest.mark.parametrize("k", [5, 1])
def test_metric_cases(spark, k):
    cases = [c for c in CASES if c[2] == k]
    pred, true = frames(spark, cases)
    mean = lambda at: sum(c[at] for c in cases) / len(cases)
    assert recall_k(pred, true, k).first()[0] == pytest.approx(mean(3))
    assert ndcg_k(pred, true, k).first()[0] == pytest.approx(mean(4))
    assert ndcg_k(pred, true, k, idcg="ideal").first()[0] == pytest.approx(mean(5))


def test_users_on_one_side_do_not_count(spark):
    pred, true = frames(spark, CASES[:1])
    pred = pred.union(spark.createDataFrame([(98, 1, 1.0)], pred.schema))
    true = true.union(spark.createDataFrame([(99, 1, 1)], true.schema))
    assert metric_panel(pred, true, (5,)).first().asDict() == {"recall@5": 1.0, "ndcg@5": 1.0}


def test_a_repeated_prediction_is_found_once(spark):
    pred = spark.createDataFrame([(1, 7, 3.0), (1, 7, 2.0), (1, 8, 1.0)], "user long, item long, scores double")
    true = spark.createDataFrame([(1, 7, 1)], "user long, item long, timestamp long")
    assert recall_k(pred, true, 2).first()[0] == 1.0


def test_standard_ndcg_counts_any_position(spark):
    pred, true = frames(spark, [([13, 14], [14, 13, 7], 5)])
    assert ndcg_k(pred, true, 5, variant="standard").first()[0] == pytest.approx(1.0)
    pred, true = frames(spark, [([13, 14], [7, 13], 5)])
    d2 = 1 / math.log2(3)
    assert ndcg_k(pred, true, 5, variant="standard").first()[0] == pytest.approx(d2 / (1 + d2))


def test_grid_and_report(spark, golden, tmp_path):
    ks = (1, 5)
    result = grid_search(SLIM(top_k=5), {"l1": [1, 2], "l2": [9, 18]}, golden.train, 0.5, ks)
    points = rows(result.history, "grid_id", "l1", "l2")
    assert points == [(0, 1.0, 9.0), (1, 1.0, 18.0), (2, 2.0, 9.0), (3, 2.0, 18.0)]
    by_id = {r["grid_id"]: r for r in result.history.collect()}
    assert all(by_id[0][m] == by_id[3][m] for m in metric_names(ks))
    path = str(tmp_path / "history")
    H.write_history(result.history, path, ("l1", "l2"), ks)
    assert rows(H.read_history(spark, path, ("l1", "l2"), ks)) == rows(result.history)
    winners = {m: {"l2": 1.0} for m in metric_names(ks)}
    winners["ndcg@1"] = None
    recall, ndcg = report_tables(compare_models(golden.train, golden.test, [(EASE(top_k=5), winners)], ks), ks)
    assert recall.columns == ["model", "recall@1", "recall@5"] and ndcg.first()["ndcg@1"] is None
    sinks.write_report(recall, str(tmp_path / "report"))
    assert rows(sinks.read_report(spark, str(tmp_path / "report"), ["recall@1", "recall@5"])) == rows(recall)


def test_winner_is_the_first_of_equal_points_and_null_at_zero(spark):
    long = spark.createDataFrame(
        [(0, 1.0, "a", 0.1), (1, 2.0, "a", 0.3), (2, 3.0, "a", 0.3), (0, 1.0, "b", 0.0), (1, 2.0, "b", 0.0)],
        "grid_id long, l2 double, metric string, value double",
    )
    assert sorted(H.best_points(long, ("l2",)).collect()) == [("a", 1, 2.0, 0.3), ("b", None, None, 0.0)]


def test_unknown_model(golden):
    class Other:
        name = "OTHER"

    with pytest.raises(ValueError):
        grid_search(Other(), {}, golden.train)


def test_inter_export_has_typed_header(spark, golden, tmp_path):
    sinks.write_inter(golden.train.coalesce(1), str(tmp_path / "inter"))
    part = next((tmp_path / "inter").glob("part-*")).read_text().splitlines()
    assert part[0] == "user:token\titem:token\trating:float\ttimestamp:float" and len(part) == 9


SAMPLE = ["load_movielens_1m", "split_train_repeated_triples", "gram", "ease_recs", "slim_weights", "als_recs", "metric_panel_part"]


@pytest.mark.parametrize("name", SAMPLE)
def test_queries_match_their_sql(spark, name):
    import __spark_entry__ as entry_point

    sf_dir = "/root/testdata/sf0.001"
    ours = entry_point.queries()[name](spark, sf_dir).toPandas()
    assert difference(ours, duck(sf_dir).execute(entry_point.oracle_sql()[name]).df()) is None


def test_every_query_is_known_to_the_entry():
    import __spark_entry__ as entry_point

    unknown = set(entry_point.oracle_sql()) - set(entry_point.queries())
    assert not unknown
