"""Loading, splitting, encoding."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import GOLDEN, SCHEMA, rows
from reclattice.operators import encode
from reclattice.operators.encode import OrdinalEncoder
from reclattice.operators.filters import binarize_rating
from reclattice.operators.ranking import from_lists, history_lists, row_numbers
from reclattice.operators.split import chronological_split
from reclattice.sources import loaders
from reclattice.sources.netflix import positive_netflix, read_movie_blocks


def test_golden_split(golden):
    assert rows(golden.train, "user", "item") == [(1, 10), (1, 11), (1, 12), (2, 10), (2, 11), (3, 11), (3, 12), (4, 14)]
    assert rows(golden.test, "user", "item") == [(1, 13), (1, 14), (2, 14), (3, 10), (3, 13), (4, 10)]


def test_ids_and_ratings_missing(spark):
    data = spark.createDataFrame([(1, 1, 5.0, 1), (1, 2, None, 2), (1, 3, 5.0, 3), (None, 1, 5.0, 1), (2, None, 5.0, 1)], SCHEMA)
    assert rows(loaders.clean_interactions(data, 3.5), "user", "item") == [(1, 1), (1, 3)]


def test_binarize_null_is_zero(spark):
    data = spark.createDataFrame([(1, 1, 3.5, 1), (1, 2, None, 1), (1, 3, 3.6, 1)], SCHEMA)
    assert rows(binarize_rating(data), "item", "rating") == [(1, 0.0), (2, 0.0), (3, 1.0)]


@pytest.mark.parametrize("hot_rows", [1000, 10])
def test_prefix_is_truncated_in_double_arithmetic(spark, hot_rows):
    data = spark.range(90).select(F.lit(7).alias("user"), F.col("id").alias("item"), F.lit(5.0).alias("rating"), F.col("id").alias("timestamp"))
    split = chronological_split(data, 0.3, hot_rows=hot_rows)
    assert split.train.count() == 62
    assert split.test.agg(F.min("timestamp")).first()[0] == 62


@pytest.mark.parametrize("hot_rows", [1000, 1])
def test_repeated_triple_over_the_cut(spark, hot_rows):
    data = spark.createDataFrame([(1, 10, 5.0, 1), (1, 10, 5.0, 2)], SCHEMA)
    triple = chronological_split(data, 0.3, hot_rows=hot_rows)
    assert rows(triple.train, "timestamp") == [(1,), (2,)] and triple.test.isEmpty()
    placed = chronological_split(data, 0.3, mode="positional", hot_rows=hot_rows)
    assert rows(placed.train, "timestamp") == [(1,)] and rows(placed.test, "timestamp") == [(2,)]


@pytest.mark.parametrize("mode", ["triple", "positional"])
def test_range_ranking_equals_window_ranking(spark, mode):
    rng = random.Random(3)
    data = [(0 if rng.random() < 0.4 else rng.randrange(1, 8), rng.randrange(6), float(rng.randrange(4, 6)), rng.randrange(30)) for _ in range(300)]
    df = spark.createDataFrame(data + [(0, 1, 5.0, 9)] * 40, SCHEMA)
    window, ranged = (chronological_split(df, 0.3, mode, hot_rows=h) for h in (10_000, 25))
    assert rows(window.train) == rows(ranged.train)
    assert rows(window.test) == rows(ranged.test)


@pytest.mark.parametrize("mode", ["triple", "positional"])
def test_null_values_stay_on_both_paths(spark, mode):
    data = [(user, i if i % 5 else None, None if i % 3 == 0 else 5.0, i) for user in (1, None) for i in range(30)]
    df = spark.createDataFrame(data, "user long, item long, rating double, timestamp long")
    window, ranged = (chronological_split(df, 0.3, mode, hot_rows=h) for h in (10_000, 5))
    for side in ("train", "test"):
        left, right = (sorted(map(repr, getattr(s, side).collect())) for s in (window, ranged))
        assert left == right
    assert window.train.count() + window.test.count() >= len(data)


def test_encoder(spark):
    data = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "item string")
    encoder = OrdinalEncoder("item").fit(data)
    assert rows(encoder.mapping) == [("a", 0), ("b", 1), ("c", 2)] and encoder.size == 3
    assert rows(encoder.inverse_transform(encoder.transform(data))) == rows(data)
    assert encoder.transform(spark.createDataFrame([("z",)], "item string")).first()[0] is None


@pytest.mark.parametrize("kind,values", [("string", ["b", "a", "ccc"]), ("long", [70, -5, 900])])
def test_many_values_are_looked_up_in_a_list(spark, monkeypatch, kind, values):
    """Beyond a broadcast join, rows get their values without a shuffle; unknown indices stay without one."""
    encoder = OrdinalEncoder("item").fit(spark.createDataFrame([(v,) for v in values], f"item {kind}"))
    data = spark.createDataFrame([(1, 0), (2, 2), (3, None), (4, 3), (5, -1), (6, 1)], "at long, item long")
    joined = rows(encoder.inverse_transform(data))
    monkeypatch.setattr(encode, "BROADCAST_BYTES", 3 * 10)
    found = encoder.inverse_transform(data)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.columns == ["at", "item"] and rows(found) == joined
    assert [r[1] for r in rows(found)] == [sorted(values)[0], sorted(values)[2], None, None, None, sorted(values)[1]]
    monkeypatch.setattr(encode, "BROADCAST_BYTES", 3)
    assert rows(encoder.inverse_transform(data)) == joined


def test_rating_files(spark, tmp_path):
    expect = [(1, 10), (1, 11)]
    lines = [(1, 10, 5.0, 1), (1, 11, 4.0, 2), (1, 12, 1.0, 3), (2, 10, 5.0, 4)]

    def write(name, sep, header=None):
        path = tmp_path / name
        path.write_text("\n".join(([header] if header else []) + [sep.join(map(str, r)) for r in lines]), "latin1")
        return str(path)

    assert rows(loaders.load_ml_1m(spark, write("a.dat", "::")), "user", "item") == expect
    assert rows(loaders.load_ml_20m(spark, write("b.csv", ",", "userId,movieId,rating,timestamp")), "user", "item") == expect
    assert rows(loaders.load_beauty(spark, write("c.csv", ",")), "user", "item") == [("1", "10"), ("1", "11")]
    assert rows(loaders.load_sports(spark, write("d.csv", ",")), "user", "item") == [("1", "10"), ("1", "11")]
    okko = loaders.load_okko(spark, write("e.csv", ",", "user_uid,element_uid,rating,ts"), min_value=3.5)
    assert rows(okko, "user", "item", "timestamp") == [(1, 10, 1.0), (1, 11, 2.0)]


def test_row_numbers_of_huge_groups_are_dealt_out(spark):
    draw = random.Random(20)
    data = [(draw.choice([None, 1, 1, 1, 2]), draw.randint(0, 50), float(draw.randint(0, 20))) for _ in range(400)]
    df = spark.createDataFrame(sorted(set(data), key=str), "user long, item long, timestamp double")
    plain, dealt = (row_numbers(df, "user", ["timestamp", "item"], hot_rows=h).collect() for h in (10_000, 20))
    assert {tuple(r) for r in plain} == {tuple(r) for r in dealt} and len(plain) == len(dealt) == df.count()
    # Tiny partitions are not put together again, to see where the one user's rows are.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = row_numbers(df.filter("user = 1"), "user", ["timestamp", "item"], hot_rows=20)
        assert placed.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_movie_headers_carry_over_file_splits(spark, tmp_path):
    expect = []
    text = []
    for movie in range(1, 9):
        text.append(f"{movie}:")
        for customer in range(movie * 30):
            text.append(f"{customer},{customer % 5 + 1},2005-01-{customer % 28 + 1:02d}")
            expect.append((customer, float(customer % 5 + 1), movie))
    (tmp_path / "combined.txt").write_text("\n".join(text))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    try:
        ratings = read_movie_blocks(spark, str(tmp_path / "combined.txt")).persist()
        assert rows(ratings, "CustomerID", "Score", "MovieID") == sorted(expect)
        assert set(positive_netflix(ratings).columns) == {"user", "rating", "timestamp", "item"}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_copies_of_one_triple_are_dealt_out(spark, monkeypatch):
    """1,500 copies of a triple in a user who is not large: 1,500 x 1,050 rows of train, from many tasks,
    the same as when no triple is too many."""
    rows = spark.range(1500).select(
        F.lit(1).cast("long").alias("user"), F.lit(7).cast("long").alias("item"), F.lit(4.0).alias("rating"), F.col("id").alias("timestamp")
    ).unionByName(spark.range(40).select(
        (F.col("id") % 4 + 2).alias("user"), F.col("id").alias("item"), F.lit(5.0).alias("rating"), F.col("id").alias("timestamp")
    ))
    dealt = chronological_split(rows, 0.3)
    most = dealt.train.filter("user = 1").withColumn("task", F.spark_partition_id()).groupBy("task").count()
    assert most.agg(F.sum("count"), F.count("*")).first()[0] == 1500 * 1050 and most.count() > 1
    assert dealt.test.filter("user = 1").isEmpty()
    monkeypatch.setattr("reclattice.operators.split.MANY_COPIES", 10_000)
    plain = chronological_split(rows, 0.3)
    for one, two in ((dealt.train, plain.train), (dealt.test, plain.test)):
        assert one.count() == two.count() and one.exceptAll(two.filter("user > 1")).filter("user > 1").isEmpty()


@pytest.mark.parametrize("hot_rows", [10_000, 20])
def test_lists_have_bounded_length(spark, hot_rows):
    draw = random.Random(21)
    data = sorted({(draw.choice([None, 1, 1, 1, 2]), draw.randint(0, 50), float(draw.randint(0, 20))) for _ in range(300)}, key=str)
    df = spark.createDataFrame(data, "user long, item long, timestamp double")
    lists = history_lists(df, "user", ["timestamp", "item"], ["item", "timestamp"], 7, hot_rows)
    assert lists.agg(F.max(F.size("rows"))).first()[0] == 7
    for user in (None, 1, 2):
        mine = sorted((t, i) for u, i, t in data if u == user)
        found = from_lists(lists.filter(F.col("user").eqNullSafe(F.lit(user))), "user", 7).orderBy("pos").collect()
        assert [(r["pos"], r["timestamp"], r["item"]) for r in found] == [(n, *e) for n, e in enumerate(mine, 1)]


def test_ranges_do_not_follow_a_low_bound(spark):
    """Many users just above the bound share ranges: 400 users with 30 rows each are not 600 tasks."""
    from reclattice.operators.ranking import weighted_positions

    df = spark.range(12_000).selectExpr("id % 400 AS user", "id AS at", "1L AS w")
    placed = weighted_positions(df, "user", ["at"], "w", 12_000, 20)
    ranges = spark.range(12_000).selectExpr("id % 400 AS user", "id AS at", "id div 400 AS start")
    assert placed.join(ranges, ["user", "at"]).filter("_start = start AND _total = 30").count() == 12_000
    tracker, group = spark.sparkContext.statusTracker(), "ranges"
    spark.sparkContext.setJobGroup(group, group)
    try:
        weighted_positions(df, "user", ["at"], "w", 12_000, 20)
        stages = [s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert max(tracker.getStageInfo(s).numTasks for s in stages if tracker.getStageInfo(s)) < 50
