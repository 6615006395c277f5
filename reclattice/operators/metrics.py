"""recall@k and positional ndcg@k for any set of k, in one pass and without Python rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reclattice.functions.columns import cumulative_discount, log_discount
from reclattice.operators.ranking import top_k

KS = (1, 5, 10, 50)


def metric_panel(
    pred: DataFrame,
    true: DataFrame,
    ks: tuple[int, ...] = KS,
    user: str = "user",
    item: str = "item",
    scores: str = "scores",
    timestamp: str = "timestamp",
    variant: str = "positional",
    idcg: str = "worst",
    by: tuple[str, ...] = (),
) -> DataFrame:
    """One row with ``recall@k`` and ``ndcg@k`` for every k, or one per group of ``by``
    columns of ``pred`` (several models judged in one pass).

    Means run over the users found on both sides. recall is the share of a user's distinct
    test items found in the first k predictions. ndcg compares position by position: the
    prediction at rank r counts when it equals the r-th test item in time. ``idcg="worst"``
    divides by the discounts of the hits at the *last* positions, so a value may exceed 1; ``idcg="ideal"`` puts them first, and ``variant="standard"`` counts
    a prediction when it is anywhere in the test set.
    """
    per_user = user_metrics(pred, true, ks, user, item, scores, timestamp, variant, idcg, by)
    return per_user.groupBy(*by).agg(*[F.avg(f"`{c}`").alias(c) for c in metric_names(ks)])


def metric_names(ks: tuple[int, ...] = KS) -> list[str]:
    return [f"{name}@{k}" for k in ks for name in ("recall", "ndcg")]


def user_metrics(pred, true, ks=KS, user="user", item="item", scores="scores", timestamp="timestamp",
                 variant="positional", idcg="worst", by=()) -> DataFrame:
    """Per-user values behind ``metric_panel``.

    No step gathers one user's test rows: their number comes from combined counts, set
    membership from a join of the test items with the user's list, and positions from the first
    ``max(ks)`` rows. Predictions are rows only until they are ranked; then a user has one list of at most
    ``max(ks)`` items, which travels once.
    """
    if variant not in ("positional", "standard") or idcg not in ("worst", "ideal"):
        raise ValueError(f"unknown ndcg variant {variant!r} / {idcg!r}")
    longest = max(ks)
    ranked = top_k(
        pred.select(*by, F.col(user).alias("u"), F.col(item).alias("i"), F.col(scores).alias("s")),
        [*by, "u"], [F.desc_nulls_last("s"), F.col("i")], longest, "r",
    )
    lists = ranked.groupBy(*by, "u").agg(_in_order("pred"))
    rows = true.select(F.col(user).alias("u"), F.col(item).alias("i"), F.col(timestamp).alias("t"))
    items = rows.groupBy("u", "i").agg(F.count(F.lit(1)).alias("n"))
    truth = items.groupBy("u").agg(F.count(F.lit(1)).alias("n_items"), F.sum("n").alias("n_rows"))
    if variant == "positional":
        order = top_k(rows, ["u"], [F.col("t"), F.col("i")], longest, "r").groupBy("u").agg(_in_order("first"))
        truth = truth.join(order, "u")
    told = items.select(F.col("u").alias("owner"), F.col("i").alias("told"))
    met = lists.join(told, (F.col("u") == F.col("owner")) & F.array_contains("pred", F.col("told")), "left")
    users = met.groupBy(*by, "u").agg(F.first("pred").alias("pred"), F.collect_set("told").alias("found")).join(truth, "u")
    in_set = F.transform("pred", lambda p: F.coalesce(F.array_contains("found", p), F.lit(False)))
    if variant == "positional":
        hit = F.transform("pred", lambda p, at: F.coalesce(p == F.get("first", at), F.lit(False)))
    else:
        hit = in_set
    # A prediction that repeats an item finds it once, at its first rank.
    once = F.transform("pred", lambda p, at: F.get("in_set", at) & (F.array_position("pred", p) == at + 1))
    gain = F.transform("hit", lambda h, at: F.when(h, log_discount(at + 1)).otherwise(F.lit(0.0)))
    flags = (
        users.withColumns({"in_set": in_set, "hit": hit})
        .select(*by, "u", "n_items", "n_rows", once.alias("once"), "hit", gain.alias("gain"))
    )
    sums = []
    for k in ks:
        sums += [
            F.size(F.filter(F.slice("once", 1, k), lambda x: x)).cast("long").alias(f"in{k}"),
            F.size(F.filter(F.slice("hit", 1, k), lambda x: x)).cast("long").alias(f"hits{k}"),
            F.aggregate(F.slice("gain", 1, k), F.lit(0.0), lambda total, x: total + x).alias(f"dcg{k}"),
        ]
    per_user = flags.select(*by, "u", "n_items", "n_rows", *sums)
    values = []
    for k in ks:
        hits, size = F.col(f"hits{k}"), F.col("n_rows" if variant == "positional" else "n_items")
        reach = F.least(F.lit(k).cast("long"), size)
        if variant == "standard":
            best = cumulative_discount(reach, longest)
        elif idcg == "ideal":
            best = cumulative_discount(hits, longest)
        else:
            best = cumulative_discount(reach, longest) - cumulative_discount(reach - hits, longest)
        values += [
            (F.col(f"in{k}") / F.col("n_items")).alias(f"recall@{k}"),
            F.when(hits == 0, F.lit(0.0)).otherwise(F.col(f"dcg{k}") / best).alias(f"ndcg@{k}"),
        ]
    return per_user.select(*by, F.col("u").alias(user), *values)


def _in_order(name: str) -> Column:
    """The items ``i`` of a group in order of their place ``r``, nulls included."""
    placed = F.array_sort(F.collect_list(F.struct("r", "i")))
    return F.transform(placed, lambda row: row["i"]).alias(name)


def recall_k(pred: DataFrame, true: DataFrame, k: int, user="user", item="item", rating="scores") -> DataFrame:
    """``recall@k`` as a one-row frame."""
    timed = true.withColumn("_t", F.lit(0))
    return metric_panel(pred, timed, (k,), user, item, rating, "_t").select(F.col(f"`recall@{k}`").alias(f"recall@{k}"))


def ndcg_k(pred: DataFrame, true: DataFrame, k: int, user="user", item="item", rating="scores",
           timestamp="timestamp", variant="positional", idcg="worst") -> DataFrame:
    """``ndcg@k`` as a one-row frame."""
    panel = metric_panel(pred, true, (k,), user, item, rating, timestamp, variant, idcg)
    return panel.select(F.col(f"`ndcg@{k}`").alias(f"ndcg@{k}"))
