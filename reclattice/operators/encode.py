"""Dense 0-based index over the sorted distinct values of a column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reclattice.session import BROADCAST_BYTES, broadcast_if_small, checkpointed

# monotonically_increasing_id keeps the row number inside a partition in its low bits.
_ROW_BITS = 33
# Column of the index beside the value in a mapping.
PLACE = "place"
# Bytes of a mapping row besides its value, in the broadcast size check.
_ROW_BYTES = 40


def dense_index(df: DataFrame, column: str, name: str = PLACE) -> tuple[DataFrame, int, int]:
    """(mapping[column, name], number of values, bytes of its longest row).

    A range-partitioned sort gives every partition a contiguous slice; the index is the row number
    inside the slice plus the sizes of the slices before it, which are a table of one row per slice.
    """
    ordered = checkpointed(
        df.select(column).distinct()
        .repartitionByRange(column).sortWithinPartitions(column)
        .withColumn("_row", F.monotonically_increasing_id())
        .select(column, F.shiftright("_row", _ROW_BITS).alias("_part"),
                F.col("_row").bitwiseAND((1 << _ROW_BITS) - 1).alias("_row"))
    )
    longest = F.coalesce(F.max(F.octet_length(F.col(column).cast("string"))), F.lit(0))
    slices = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), longest.alias("_bytes"))
    known = slices.agg(
        F.count(F.lit(1)).alias("slices"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n"),
        F.coalesce(F.max("_bytes"), F.lit(0)).alias("bytes"),
    ).first()
    # One row per shuffle partition.
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    placed = ordered.join(broadcast_if_small(offsets, known["slices"], 16), "_part")
    mapping = placed.select(column, (F.col("_before") + F.col("_row")).cast("long").alias(name))
    return mapping, known["n"], _ROW_BYTES + known["bytes"]


class OrdinalEncoder:
    """Encode one column as its dense index and back. Values unseen by ``fit`` encode to null."""

    def __init__(self, column: str):
        self.column = column
        self.mapping: DataFrame | None = None
        self.size = 0
        self.row_bytes = 0

    def fit(self, df: DataFrame) -> "OrdinalEncoder":
        self.mapping, self.size, self.row_bytes = dense_index(df, self.column)
        return self

    def _side(self) -> DataFrame:
        return broadcast_if_small(self.mapping, self.size, self.row_bytes)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with the column's values replaced by their index, the other columns as they are."""
        found = df.join(self._side(), self.column, "left")
        return found.select(*[F.col(PLACE).alias(c) if c == self.column else F.col(c) for c in df.columns])

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def _listed(self, df: DataFrame) -> bool:
        """Whether the values are too many for a table in a join's memory, yet as a plain list by index small enough to
        be sent, so that rows need no shuffle."""
        kind = self.mapping.schema[self.column].dataType
        if isinstance(kind, (T.LongType, T.IntegerType, T.DoubleType)):
            each = 8
        elif isinstance(kind, T.StringType):
            each = 4 + self.row_bytes - _ROW_BYTES
        else:
            return False
        whole = isinstance(df.schema[self.column].dataType, (T.LongType, T.IntegerType))
        return whole and self.size * each <= BROADCAST_BYTES < self.size * self.row_bytes

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        """``df`` with the column's indices replaced by their values."""
        if self._listed(df):
            return self._looked_up(df)
        known = self._side().select(F.col(self.column).alias("_value"), F.col(PLACE).alias("_place"))
        found = df.join(known, F.col(self.column) == F.col("_place"), "left")
        return found.select(*[F.col("_value").alias(c) if c == self.column else F.col(c) for c in df.columns])

    def _looked_up(self, df: DataFrame) -> DataFrame:
        table = self.mapping.select(self.column, PLACE).toArrow()
        order = np.argsort(table[PLACE].to_numpy())
        sent = df.sparkSession.sparkContext.broadcast(table[self.column].combine_chunks().take(pa.array(order)))
        at, name = df.columns.index(self.column), self.column
        schema = T.StructType([self.mapping.schema[name] if c == name else df.schema[c] for c in df.columns])

        def task(batches):
            values = sent.value
            for batch in batches:
                place = batch.column(at)
                index = np.asarray(place.fill_null(-1))
                out = (index < 0) | (index >= len(values))
                found = values.take(pa.array(np.where(out, 0, index), mask=out))
                yield pa.RecordBatch.from_arrays([found if c == at else x for c, x in enumerate(batch.columns)], names=df_names)

        df_names = df.columns
        return df.mapInArrow(task, schema)
