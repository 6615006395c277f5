"""Registered queries: every operator over the given tables.

``brand`` queries use the 25 brands as items, so that SQL can repeat the model fits;
``part`` and ``brand_size`` queries use larger catalogues. All of them read whole tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reclattice.functions.columns import log_discount, prefix_size, rounded
from reclattice.models.als import ALS
from reclattice.models.certificates import als_residual, als_training_loss, ease_residual, slim_gap
from reclattice.models.ease import EASE
from reclattice.models.slim import SLIM, l1_ratio
from reclattice.operators.encode import PLACE, OrdinalEncoder
from reclattice.operators.filters import (
    active_users, binarize_rating, positive_ratings, without_seen, zero_seen,
)
from reclattice.operators.matrix import both_triangles, with_ridge
from reclattice.operators.matrix import gram as item_pairs
from reclattice.operators.metrics import KS, metric_names, metric_panel, ndcg_k, recall_k
from reclattice.operators.ranking import from_lists, history_lists, row_numbers
from reclattice.operators.scoring import recommend_sparse, score_pairs
from reclattice.operators.split import Split, chronological_split
from reclattice.plans.grid import GridResult, best_params, grid_search, hold_out
from reclattice.plans.report import append_report, compare_models, report_tables, wide_report
from reclattice.session import checkpointed, scratch_path, ship_package
from reclattice.sources import history as H
from reclattice.sources import loaders as L
from reclattice.sources import tables as S
from reclattice.sources.netflix import positive_netflix, read_movie_blocks
from reclattice.sources.sinks import read_report, typed_columns, write_inter, write_report

Query = Callable[[SparkSession, str], DataFrame]

MIN_RATING = 3.5
# The SQL of the models ranks scores rounded to this many decimals.
SCORE_DIGITS = 9
TEST_SIZE = 0.3
TOP_K = 10
EASE_GRID = {"l2": [1, 51, 101]}
SLIM_GRID = {"l1": [1, 2], "l2": [15, 30]}
ALS_GRID = {"l2": [1, 10], "n_factors": [1, 2]}
EASE_L2 = 10.0
SLIM_L1, SLIM_L2 = 1.0, 15.0
ALS_L2, ALS_ITERATIONS = 1.0, 2

# Rows of a user in one list; few, so that most users have several lists.
LIST_ROWS = 8

QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return fn


# ---------------------------------------------------------------- shared inputs


def loaded_part(spark, sf) -> DataFrame:
    return L.clean_interactions(S.part_interactions(spark, sf), MIN_RATING)


def loaded_brand(spark, sf) -> DataFrame:
    return L.clean_interactions(S.brand_interactions(spark, sf), MIN_RATING)


def loaded_brand_size(spark, sf) -> DataFrame:
    return L.clean_interactions(S.brand_size_interactions(spark, sf), MIN_RATING)


def part_split(spark, sf) -> Split:
    return chronological_split(loaded_part(spark, sf), TEST_SIZE)


def brand_split(spark, sf) -> Split:
    return chronological_split(loaded_brand(spark, sf), TEST_SIZE)


def ease(**changes) -> EASE:
    return EASE(l2_reg=EASE_L2, top_k=TOP_K, score_digits=SCORE_DIGITS, **changes)


def slim(**changes) -> SLIM:
    return SLIM(l1_reg=SLIM_L1, l2_reg=SLIM_L2, top_k=TOP_K, score_digits=SCORE_DIGITS, **changes)


def als(**changes) -> ALS:
    return ALS(n_factors=2, n_iterations=ALS_ITERATIONS, reg=ALS_L2, top_k=TOP_K, score_digits=SCORE_DIGITS, **changes)


def ease_brand_size() -> EASE:
    return EASE(l2_reg=50.0, top_k=50)


def slim_brand_size() -> SLIM:
    return SLIM(l1_reg=1.0, l2_reg=999.0, top_k=50)


def als_part() -> ALS:
    return ALS(n_factors=20, n_iterations=5, reg=10.0, top_k=50)


def recs_out(recs: DataFrame) -> DataFrame:
    return recs.select("user", "item", "scores", F.col("rank").cast("long").alias("rank"))


def panel_out(panel: DataFrame) -> DataFrame:
    return panel.select(*[F.round(f"`{c}`", 6).alias(c) for c in panel.columns])


def brand_weights_out(model, weights: DataFrame, data) -> DataFrame:
    """Weights with item ids on both sides."""
    left = data.items.mapping.select(F.col("item").alias("item_from"), F.col(PLACE).alias("i"))
    right = data.items.mapping.select(F.col("item").alias("item_to"), F.col(PLACE).alias("j"))
    return (
        weights.join(left, "i").join(right, "j")
        .select("item_from", "item_to", rounded(F.col("b"), 6).alias("weight"))
    )


# ---------------------------------------------------------------- sources and sinks


def _written(df: DataFrame, name: str, **options) -> str:
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).csv(path)
    return path


@query
def load_movielens_1m(spark, sf):
    lines = S.part_interactions(spark, sf).select(
        F.concat_ws("::", "user", "item", "rating", "timestamp").alias("value")
    )
    path = scratch_path(spark, "ml1m")
    lines.write.text(path)
    return L.load_ml_1m(spark, path)


@query
def load_movielens_20m(spark, sf):
    named = S.part_interactions(spark, sf).withColumnsRenamed({"user": "userId", "item": "movieId"})
    return L.load_ml_20m(spark, _written(named, "ml20m", header="true"))


def _named_users(df: DataFrame) -> DataFrame:
    return df.withColumn("user", F.concat(F.lit("U"), F.col("user").cast("string")))


@query
def load_amazon_beauty(spark, sf):
    return L.load_beauty(spark, _written(_named_users(S.brand_interactions(spark, sf)), "beauty"))


@query
def load_amazon_sports(spark, sf):
    return L.load_sports(spark, _written(_named_users(S.brand_size_interactions(spark, sf)), "sports"))


@query
def load_okko(spark, sf):
    named = S.event_interactions(spark, sf).select(
        F.lit("movie").alias("element_type"), F.col("user").alias("user_uid"), F.col("item").alias("element_uid"),
        "rating", F.col("timestamp").alias("ts"),
    )
    return L.load_okko(spark, _written(named, "okko", header="true"))


def _netflix_file(spark, sf) -> str:
    """Movie headers and rating lines, one sorted range of movies per file."""
    rows = S.part_interactions(spark, sf).select(
        F.col("item"), F.lit(1).alias("kind"),
        F.concat_ws(",", "user", F.ceil("rating").cast("string"), "timestamp").alias("value"),
    )
    heads = rows.select("item").distinct().select(
        "item", F.lit(0).alias("kind"), F.concat(F.col("item").cast("string"), F.lit(":")).alias("value")
    )
    path = scratch_path(spark, "netflix")
    rows.unionByName(heads).repartitionByRange("item").sortWithinPartitions("item", "kind").select("value").write.text(path)
    return path


@query
def load_netflix_blocks(spark, sf):
    return read_movie_blocks(spark, _netflix_file(spark, sf))


@query
def load_netflix_positive(spark, sf):
    ratings = positive_netflix(read_movie_blocks(spark, _netflix_file(spark, sf)))
    return spark.read.schema("user long, rating double, timestamp string, item long").option("header", "true").csv(
        _written(ratings, "netflix-positive", header="true")
    )


@query
def inter_export(spark, sf):
    path = scratch_path(spark, "inter")
    write_inter(loaded_part(spark, sf), path)
    schema = "`user:token` long, `item:token` long, `rating:float` double, `timestamp:float` double"
    return spark.read.schema(schema).option("sep", "\t").option("header", "true").csv(path)


@query
def inter_projection(spark, sf):
    return typed_columns(loaded_brand(spark, sf))


# ---------------------------------------------------------------- filters and projections


@query
def positive_filter(spark, sf):
    return positive_ratings(S.part_interactions(spark, sf), MIN_RATING)


@query
def min_activity(spark, sf):
    return loaded_part(spark, sf)


@query
def cold_user_filter(spark, sf):
    return active_users(part_split(spark, sf).train)


@query
def binarize(spark, sf):
    return binarize_rating(S.part_interactions(spark, sf), "rating", MIN_RATING)


@query
def rename_drop_cast(spark, sf):
    """Rename, drop and truncating cast."""
    return (
        S.part_interactions(spark, sf)
        .withColumnsRenamed({"user": "user_uid", "item": "element_uid"})
        .withColumn("whole", F.col("rating").cast("int").cast("long"))
        .drop("rating", "timestamp")
    )


@query
def lists_and_explode(spark, sf):
    """Histories as lists in time order, in chunks of bounded length, and back to rows."""
    lists = history_lists(loaded_part(spark, sf), "user", ["timestamp", "item", "rating"], ["item", "rating"], LIST_ROWS)
    return from_lists(lists, "user", LIST_ROWS)


def _pair_weights(spark, sf):
    """Cells of the part-level train set, their co-occurrence counts as weights, and how many."""
    split = part_split(spark, sf)
    data = ease().prepare(split.train)
    split.release()
    upper = data.gram.filter(F.col("i") != F.col("j"))
    return data, both_triangles(upper).withColumnRenamed("g", "b"), 2 * upper.count()


def _pair_scores(spark, sf, **own):
    data, weights, n_weights = _pair_weights(spark, sf)
    scores = score_pairs(data, weights, n_weights, **own)
    return data, scores.select("u", F.col("j").alias("i"), rounded(F.col("s")).alias("scores"), *own.values())


def _scored_out(data, scores) -> DataFrame:
    named = scores.select(F.col("u").alias("user"), F.col("i").alias("item"), "scores")
    return data.items.inverse_transform(named).select("user", "item", "scores")


@query
def score_table(spark, sf):
    data, scores = _pair_scores(spark, sf)
    return _scored_out(data, scores)


@query
def mask_zero(spark, sf):
    data, scores = _pair_scores(spark, sf, own="own")
    return _scored_out(data, zero_seen(scores, data.cells, "u", "i", "v", own="own"))


@query
def mask_remove(spark, sf):
    data, scores = _pair_scores(spark, sf, own="own")
    return _scored_out(data, without_seen(scores, data.cells, "u", "i", own="own"))


def _part_topk(spark, sf, k=TOP_K) -> DataFrame:
    data, weights, n_weights = _pair_weights(spark, sf)
    return data.decoded(
        recommend_sparse(data, weights, n_weights, k, "remove", SCORE_DIGITS, scored_only=True)
    )


@query
def topk_scores(spark, sf):
    return recs_out(_part_topk(spark, sf))


# ---------------------------------------------------------------- split


@query
def split_train(spark, sf):
    return part_split(spark, sf).train


@query
def split_test(spark, sf):
    return part_split(spark, sf).test


@query
def split_train_repeated_triples(spark, sf):
    """Many copies of a (user, brand, rating) triple: they fan out in train."""
    return brand_split(spark, sf).train


@query
def split_test_repeated_triples(spark, sf):
    return brand_split(spark, sf).test


@query
def split_positional_train(spark, sf):
    return chronological_split(loaded_brand(spark, sf), TEST_SIZE, mode="positional").train


@query
def split_positional_test(spark, sf):
    return chronological_split(loaded_brand(spark, sf), TEST_SIZE, mode="positional").test


@query
def split_huge_histories(spark, sf):
    """The range-partitioned path, used for users too active for one task; here for every
    user above 20 rows, with the same result as the window path."""
    return chronological_split(loaded_brand(spark, sf), TEST_SIZE, hot_rows=20).train


@query
def history_lengths(spark, sf):
    """Rows per user and how many of them go to train."""
    counts = loaded_part(spark, sf).groupBy("user").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("train_size", prefix_size(F.col("n"), TEST_SIZE))


# ---------------------------------------------------------------- encoding and matrices


@query
def distinct_items(spark, sf):
    return loaded_part(spark, sf).select("item").distinct()


@query
def encoder_mapping(spark, sf):
    encoder = OrdinalEncoder("item").fit(loaded_brand_size(spark, sf))
    return encoder.mapping.select("item", F.col(PLACE).alias("idx"))


@query
def encode(spark, sf):
    """Encoder fitted on train, applied to everything: unseen items become null."""
    data = loaded_part(spark, sf)
    encoder = OrdinalEncoder("item").fit(chronological_split(data, TEST_SIZE).train)
    return encoder.transform(data).withColumn("item", F.col("item").cast("double"))


@query
def decode(spark, sf):
    encoder = OrdinalEncoder("item")
    return encoder.inverse_transform(encoder.fit_transform(loaded_brand(spark, sf)))


@query
def encode_users_and_items(spark, sf):
    data = loaded_brand(spark, sf)
    return OrdinalEncoder("item").fit_transform(OrdinalEncoder("user").fit_transform(data))


@query
def user_item_matrix(spark, sf):
    """Binarized cells with repeated pairs added up."""
    data = ease().prepare(brand_split(spark, sf).train)
    return data.cells.select(F.col("u").alias("user"), F.col("i").alias("item_idx"), F.col("v").alias("value"))


def _gram_out(upper: DataFrame) -> DataFrame:
    return both_triangles(upper).select("i", "j", rounded(F.col("g"), 6).alias("g"))


@query
def gram(spark, sf):
    return _gram_out(ease().prepare(part_split(spark, sf).train).gram)


@query
def gram_wide_rows(spark, sf):
    """The same table with every user of more than 4 items cut into chunks."""
    data = ease().prepare(part_split(spark, sf).train)
    return _gram_out(item_pairs(data.cells, data.n_items, wide_row=4))


@query
def gram_raw_ratings(spark, sf):
    return _gram_out(ease(binarize=False).prepare(brand_split(spark, sf).train).gram)


@query
def gram_ridge(spark, sf):
    data = ease().prepare(brand_split(spark, sf).train)
    return _gram_out(with_ridge(data.gram, data.n_items, EASE_L2))


# ---------------------------------------------------------------- models


@query
def ease_weights(spark, sf):
    model = ease()
    data = model.prepare(brand_split(spark, sf).train)
    return brand_weights_out(model, model.weights(data), data)


@query
def ease_weights_tiled(spark, sf):
    """The same weights through the block sweep over a table of tiles."""
    model = ease(tile=10)
    data = model.prepare(brand_split(spark, sf).train)
    return brand_weights_out(model, model.weights(data), data)


@query
def ease_recs(spark, sf):
    return recs_out(ease().fit_predict(brand_split(spark, sf).train))


@query
def ease_recs_remove(spark, sf):
    return recs_out(ease(mask="remove").fit_predict(brand_split(spark, sf).train))


@query
def ease_recs_unfiltered(spark, sf):
    return recs_out(ease(filter_already_liked_items=False).fit_predict(brand_split(spark, sf).train))


@query
def ease_recs_raw_ratings(spark, sf):
    return recs_out(ease(binarize=False).fit_predict(brand_split(spark, sf).train))


@query
def ease_recs_brand_size(spark, sf):
    model = ease_brand_size()
    return recs_out(model.recommend(_brand_size_data(spark, sf, model)))


@query
def slim_weights(spark, sf):
    model = slim()
    data = model.prepare(brand_split(spark, sf).train)
    return brand_weights_out(model, model.weights(data), data)


@query
def slim_weights_any_sign(spark, sf):
    """Fitted without the sign constraint; negative weights are dropped after the fit."""
    model = slim(positive_only=False)
    data = model.prepare(brand_split(spark, sf).train)
    return brand_weights_out(model, model.weights(data), data)


@query
def slim_recs(spark, sf):
    return recs_out(slim().fit_predict(brand_split(spark, sf).train))


@query
def slim_recs_remove(spark, sf):
    return recs_out(slim(mask="remove").fit_predict(brand_split(spark, sf).train))


@query
def slim_recs_unfiltered(spark, sf):
    return recs_out(slim(filter_already_liked_items=False).fit_predict(brand_split(spark, sf).train))


@query
def slim_recs_brand_size(spark, sf):
    model = slim_brand_size()
    return recs_out(model.recommend(_brand_size_data(spark, sf, model)))


@query
def als_item_factors(spark, sf):
    model = als()
    data = model.prepare(brand_split(spark, sf).train)
    _, items = model.fit(data)
    named = items.select(F.col("id").alias("item"), rounded(F.col("vec")[0], 6).alias("f1"), rounded(F.col("vec")[1], 6).alias("f2"))
    return data.items.inverse_transform(named)


@query
def als_recs(spark, sf):
    return recs_out(als().fit_predict(brand_split(spark, sf).train))


@query
def als_recs_raw_ratings(spark, sf):
    return recs_out(als(binarize=False).fit_predict(brand_split(spark, sf).train))


@query
def als_recs_unfiltered(spark, sf):
    return recs_out(als(filter_already_liked_items=False).fit_predict(brand_split(spark, sf).train))


@query
def als_recs_part(spark, sf):
    """Twenty factors over all parts."""
    return recs_out(als_part().fit_predict(part_split(spark, sf).train))


@query
def als_recs_spark_ml(spark, sf):
    model = ALS(n_factors=20, n_iterations=5, reg=0.1, top_k=50, engine="ml")
    return recs_out(model.fit_predict(part_split(spark, sf).train))


@query
def als_training_loss_brand(spark, sf):
    """The loss that is printed while ALS is trained."""
    model = als()
    data = model.prepare(brand_split(spark, sf).train)
    users, items = model.fit(data)
    loss = als_training_loss(data, users, items, model.n_factors, model.reg)
    return spark.createDataFrame([(round(loss, 6),)], "loss double")


# Relative residual under which a model counts as the optimum.
CERTIFIED = 1e-8


def certified(checked: DataFrame) -> DataFrame:
    return checked.select("checked", (F.col("worst") <= CERTIFIED).alias("optimal"))


@query
def als_certificate_part(spark, sf):
    """Twenty factors over all parts: every item's normal equations hold."""
    model = als_part()
    split = part_split(spark, sf)
    data = model.prepare(split.train)
    split.release()
    model.share(data)
    users, items = model.fit(data)
    found = als_residual(data, users, items, model.n_factors, model.reg)
    data.release()
    return certified(found)


def _brand_size_data(spark, sf, model):
    return model.prepare(chronological_split(loaded_brand_size(spark, sf), TEST_SIZE).train)


@query
def ease_certificate_brand_size(spark, sf):
    """The weights behind ``ease_recs_brand_size`` solve their equations."""
    model = ease_brand_size()
    data = _brand_size_data(spark, sf, model)
    return certified(ease_residual(data, model.weights(data), model.l2_reg))


@query
def slim_certificate_brand_size(spark, sf):
    """The weights behind ``slim_recs_brand_size`` meet the optimality conditions of every pair."""
    model = slim_brand_size()
    data = _brand_size_data(spark, sf, model)
    weights = checkpointed(model.fit(data))
    return certified(slim_gap(data, weights, l1_ratio(model.l1_reg, model.l2_reg)))


# ---------------------------------------------------------------- evaluation


@query
def rank_truth(spark, sf):
    """Test items of each user in time order."""
    test = part_split(spark, sf).test
    return row_numbers(test, "user", ["timestamp", "item"]).select("user", "item", "rank")


@query
def hits_per_user(spark, sf):
    """Size of the intersection of predicted and test items, and the discounted ranks."""
    split = part_split(spark, sf)
    truth = split.test.select("user", "item").distinct()
    pred = _part_topk(spark, sf)
    return (
        pred.join(truth, ["user", "item"]).groupBy("user")
        .agg(F.count(F.lit(1)).alias("hits"), F.round(F.sum(log_discount(F.col("rank"))), 6).alias("dcg"))
    )


@query
def recall_at_10(spark, sf):
    return panel_out(recall_k(_part_topk(spark, sf), part_split(spark, sf).test, 10))


@query
def ndcg_at_10(spark, sf):
    return panel_out(ndcg_k(_part_topk(spark, sf), part_split(spark, sf).test, 10))


def _brand_panel(spark, sf, **variant) -> DataFrame:
    split = brand_split(spark, sf)
    return panel_out(metric_panel(ease(mask="remove").fit_predict(split.train), split.test, **variant))


@query
def metric_panel_part(spark, sf):
    return panel_out(metric_panel(_part_topk(spark, sf, 50), part_split(spark, sf).test))


@query
def metric_panel_ease(spark, sf):
    return _brand_panel(spark, sf)


@query
def metric_panel_ease_ideal(spark, sf):
    return _brand_panel(spark, sf, idcg="ideal")


@query
def metric_panel_ease_standard(spark, sf):
    return _brand_panel(spark, sf, variant="standard")


# ---------------------------------------------------------------- grid search and reports


def _ease_grid(spark, sf) -> GridResult:
    return grid_search(ease(), EASE_GRID, brand_split(spark, sf).train)


def _slim_grid(spark, sf) -> GridResult:
    return grid_search(slim(), SLIM_GRID, brand_split(spark, sf).train)


def _als_grid(spark, sf) -> GridResult:
    return grid_search(als(), ALS_GRID, brand_split(spark, sf).train)


def _history_out(result: GridResult) -> DataFrame:
    return result.history.select(
        "grid_id", *result.params, *[F.round(f"`{m}`", 6).alias(m) for m in metric_names(KS)]
    )


def _best_out(result: GridResult) -> DataFrame:
    return result.best.withColumn("value", F.round("value", 6))


@query
def grid_history_ease(spark, sf):
    return _history_out(_ease_grid(spark, sf))


@query
def grid_history_slim(spark, sf):
    return _history_out(_slim_grid(spark, sf))


@query
def grid_history_als(spark, sf):
    return _history_out(_als_grid(spark, sf))


@query
def grid_best_ease(spark, sf):
    return _best_out(_ease_grid(spark, sf))


@query
def grid_best_slim(spark, sf):
    return _best_out(_slim_grid(spark, sf))


@query
def grid_best_als(spark, sf):
    return _best_out(_als_grid(spark, sf))


@query
def history_json(spark, sf):
    """The history written as one JSON object of parallel arrays and read back."""
    result = _slim_grid(spark, sf)
    path = scratch_path(spark, "history")
    H.write_history(result.history, path, result.params)
    return _history_out(GridResult(result.params, H.read_history(spark, path, result.params)))


@query
def history_long(spark, sf):
    return _slim_grid(spark, sf).long.withColumn("value", F.round("value", 6))


@query
def history_crosstab(spark, sf):
    """Mean value of each metric by l2 (rows) and l1 (columns)."""
    values = [float(v) for v in SLIM_GRID["l1"]]
    table = H.crosstab(_slim_grid(spark, sf).long, None, "l2", "l1", values)
    return table.select("metric", "l2", *[F.round(f"`{v}`", 6).alias(f"l1_{v:g}") for v in values])


@query
def history_crosstab_als(spark, sf):
    """Mean value of each metric by l2 (rows) and number of factors (columns)."""
    values = [float(v) for v in ALS_GRID["n_factors"]]
    table = H.crosstab(_als_grid(spark, sf).long, None, "l2", "n_factors", values)
    return table.select("metric", "l2", *[F.round(f"`{v}`", 6).alias(f"factors_{v:g}") for v in values])


@query
def history_curve(spark, sf):
    """recall@5 over l2."""
    curve = H.curve(_ease_grid(spark, sf).long, "recall@5", "l2")
    return curve.withColumn("value", F.round("value", 6))


def _tuned(spark, sf, train) -> list[tuple]:
    """Each model with its winning parameters; final fits use raw ratings."""
    held = hold_out(ease(), train)
    searches = [
        (grid_search(als(), ALS_GRID, train, held_out=held), als(binarize=False)),
        (grid_search(ease(), EASE_GRID, train, held_out=held), ease(binarize=False)),
        (grid_search(slim(), SLIM_GRID, train, held_out=held), slim(binarize=False)),
    ]
    held.release()
    tuned = []
    for result, model in searches:
        winners = best_params(result)
        if model.name == "ALS":
            winners = {m: p and {**p, "n_factors": int(p["n_factors"])} for m, p in winners.items()}
        tuned.append((model, winners))
    return tuned


@query
def model_report(spark, sf):
    """Tuned ALS, EASE and SLIM against the test set: one row per model, eight metrics."""
    split = brand_split(spark, sf)
    train = split.train.persist()
    long = compare_models(train, split.test, _tuned(spark, sf, train))
    return panel_columns(wide_report(long, metric_names(KS)))


def panel_columns(report: DataFrame) -> DataFrame:
    return report.select("model", *[F.round(f"`{c}`", 6).alias(c) for c in report.columns if c != "model"])


def _appended(spark, sf, table: int, metric: str) -> DataFrame:
    """One of the two report tables of two models, appended, written as CSV and read back."""
    split = brand_split(spark, sf)
    points = {m: {"l2": EASE_L2} for m in metric_names(KS)}
    first = compare_models(split.train, split.test, [(ease(), points)])
    points = {m: {"l1": SLIM_L1, "l2": SLIM_L2} for m in metric_names(KS)}
    second = compare_models(split.train, split.test, [(slim(), points)])
    report = append_report(report_tables(first)[table], report_tables(second)[table])
    path = scratch_path(spark, "report")
    write_report(report, path)
    return panel_columns(read_report(spark, path, [m for m in metric_names(KS) if m.startswith(metric)]))


@query
def report_append(spark, sf):
    """The recall tables."""
    return _appended(spark, sf, 0, "recall")


@query
def report_append_ndcg(spark, sf):
    """The ndcg tables."""
    return _appended(spark, sf, 1, "ndcg")
