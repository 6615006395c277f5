"""Interaction views over the given parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a wall-clock timestamp, independent of the session time zone."""
    days = F.datediff(ts, F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def _order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def _canonical(df: DataFrame, item: Column) -> DataFrame:
    return df.select(
        F.col("o_custkey").alias("user"), item.alias("item"), (F.col("l_quantity") / 10).alias("rating"),
        epoch_seconds(F.col("o_orderdate")).alias("timestamp"),
    )


def part_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer bought part; quantity / 10 is the rating."""
    return _canonical(_order_lines(spark, sf_dir), F.col("l_partkey"))


def _with_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    return _order_lines(spark, sf_dir).join(parts, F.col("l_partkey") == F.col("p_partkey"))


def brand_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same purchases with the brand as item (25 items, string ids)."""
    return _canonical(_with_part(spark, sf_dir), F.col("p_brand"))


def brand_size_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same purchases with brand and size as item (at most 1,250 items)."""
    return _canonical(_with_part(spark, sf_dir), F.concat_ws("#", "p_brand", F.col("p_size").cast("string")))


def event_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User touched key ``props.k``; the event's value is the rating."""
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("user_id").alias("user"),
        F.get_json_object("props", "$.k").cast("long").alias("item"),
        F.col("value").alias("rating"),
        epoch_seconds(F.col("ts")).alias("timestamp"),
    )
