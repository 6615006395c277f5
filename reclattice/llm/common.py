"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reclattice.session import delete_stored, scratch_path, ship_package


# Whole texts that a function gets at a time where it makes Python strings of them.
TEXTS = 1024


def add_columns(
    df: DataFrame,
    inputs: list[str],
    added: str,
    make: Callable[[], Callable[..., list[pa.Array]]],
    rows: int | None = None,
) -> DataFrame:
    """``df`` with columns computed batch by batch in Arrow.

    ``make()`` runs once per task and returns a function from the Arrow columns ``inputs`` to
    one Arrow array per field of the DDL string ``added``. A column of ``df`` that has the name
    of an added one is replaced unless it is an input, which is read first and then replaced.
    ``rows`` bounds the rows that the function gets at a time, for long texts; its attribute
    ``close``, if any, is called when the task ends, so that a reused worker holds no memos.
    """
    ship_package(df.sparkSession)
    fields = T.StructType.fromDDL(added).fields
    taken = {f.name.lower() for f in fields}
    kept = [c for c in df.columns if c.lower() not in taken]
    sources = [F.col(f"`{c}`").alias(f"__in{i}") for i, c in enumerate(inputs)]
    base = df.select(*[F.col(f"`{c}`") for c in kept], *sources)
    width = len(kept)
    schema = T.StructType([*base.schema.fields[:width], *fields])
    names = [f.name for f in schema.fields]

    def run(batches):
        step = make()
        try:
            for batch in batches:
                many = rows or max(1, len(batch))
                for part in (batch.slice(at, many) for at in range(0, len(batch), many)):
                    new = step(*part.columns[width:])
                    yield pa.RecordBatch.from_arrays([*part.columns[:width], *new], names=names)
        finally:
            getattr(step, "close", lambda: None)()
            pa.default_memory_pool().release_unused()

    return base.mapInArrow(run, schema)


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def held_out(column: str, modulus: int, value: int) -> Column:
    """Whether the row is kept from learning. Rows without an id always are."""
    return F.coalesce(remainder(column, modulus) == value, F.lit(True))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that ``written`` makes inside when it is left, but for those that stay."""
    paths: list[str] = []
    token = _passing.set(paths)
    try:
        yield
    finally:
        _passing.reset(token)
        for path in paths:
            delete_stored(spark, path)


def written(df: DataFrame, name: str, stays: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors. Inside
    ``passing`` only a table that ``stays`` may be read afterwards."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if not stays and (paths := _passing.get()) is not None:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
