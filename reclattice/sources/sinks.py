"""Report and export files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_report(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One CSV file with header; a report has one row per model."""
    report.coalesce(1).write.mode(mode).option("header", "true").csv(path)


def read_report(spark: SparkSession, path: str, metrics: list[str]) -> DataFrame:
    schema = "model string, " + ", ".join(f"`{m}` double" for m in metrics)
    return spark.read.schema(schema).option("header", "true").csv(path)


def typed_columns(df: DataFrame, user="user", item="item", rating="rating", timestamp="timestamp") -> DataFrame:
    """Columns named ``name:type`` with float rating and timestamp in nanoseconds."""
    return df.select(
        F.col(user).alias(f"{user}:token"),
        F.col(item).alias(f"{item}:token"),
        F.col(rating).cast("double").alias(f"{rating}:float"),
        (F.col(timestamp).cast("double") * 1e9).alias(f"{timestamp}:float"),
    )


def write_inter(df: DataFrame, path: str, **names: str) -> None:
    """Tab-separated export with typed header, written in parallel."""
    typed_columns(df, **names).write.option("sep", "\t").option("header", "true").csv(path)
