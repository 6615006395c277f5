"""Rating files to the canonical table ``user, item, rating, timestamp``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reclattice.operators.filters import active_users, positive_ratings

CANONICAL = ("user", "item", "rating", "timestamp")


def clean_interactions(
    df: DataFrame, min_value: float, min_interactions: int = 2, extra_cols: tuple[str, ...] = ()
) -> DataFrame:
    """Rows rated strictly above ``min_value`` of users who keep at least
    ``min_interactions`` of them; rows without a user or item id drop out."""
    kept = df.select(*CANONICAL, *extra_cols).filter(F.col("user").isNotNull() & F.col("item").isNotNull())
    return active_users(positive_ratings(kept, min_value), min_interactions)


def load_interactions(
    spark: SparkSession,
    path: str | list[str],
    fmt: str = "csv",
    schema: str | None = None,
    rename: dict[str, str] | None = None,
    min_value: float = 3.5,
    min_interactions: int = 2,
    extra_cols: tuple[str, ...] = (),
    **options: str,
) -> DataFrame:
    """Read any Spark format, rename to the canonical columns and clean."""
    reader = spark.read.format(fmt).options(**options)
    if schema:
        reader = reader.schema(schema)
    return clean_interactions(reader.load(path).withColumnsRenamed(rename or {}), min_value, min_interactions, extra_cols)


def load_ml_1m(spark: SparkSession, path: str, min_value: float = 3.5) -> DataFrame:
    """MovieLens-1M: ``user::item::rating::timestamp`` lines in latin1."""
    return load_interactions(
        spark, path, schema="user long, item long, rating double, timestamp long", min_value=min_value,
        sep="::", encoding="ISO-8859-1",
    )


def load_ml_20m(spark: SparkSession, path: str, min_value: float = 3.5) -> DataFrame:
    """MovieLens-20M: CSV with header ``userId,movieId,rating,timestamp``."""
    return load_interactions(
        spark, path, schema="userId long, movieId long, rating double, timestamp long",
        rename={"userId": "user", "movieId": "item"}, min_value=min_value, header="true",
    )


def load_beauty(spark: SparkSession, path: str, min_value: float = 3.5) -> DataFrame:
    """Amazon Beauty: CSV without header, string ids."""
    return load_interactions(
        spark, path, schema="user string, item string, rating double, timestamp long", min_value=min_value
    )


def load_sports(spark: SparkSession, path: str, min_value: float = 3.5) -> DataFrame:
    """Amazon Sports and Outdoors: the same layout as Beauty."""
    return load_beauty(spark, path, min_value)


def load_okko(spark: SparkSession, path: str, min_value: float = 5.0) -> DataFrame:
    """Okko: CSV with header on a 0-10 scale; columns are picked by name from the header."""
    raw = spark.read.option("header", "true").csv(path)
    named = raw.select(
        F.col("user_uid").cast("long").alias("user"),
        F.col("element_uid").cast("long").alias("item"),
        F.col("rating").cast("double").alias("rating"),
        F.col("ts").cast("double").alias("timestamp"),
    )
    return clean_interactions(named, min_value)
