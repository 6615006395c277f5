"""Embeddings as vectors of integers, and integer matrices from Arrow lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(embedding: str) -> Column:
    """Whether the list is there and all its components are finite numbers."""
    each = F.forall(F.col(f"`{embedding}`"), lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return F.coalesce(each, F.lit(False))


def integer_vectors(df: DataFrame, scale: float, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, x): every component c, as double, becomes ``floor(scale * c)``. Rows whose vector is
    null or holds a null or non-finite component are dropped; other columns are ignored."""
    whole = F.transform(F.col(f"`{embedding}`"), lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    return df.filter(finite(embedding)).select(F.col(f"`{vec_id}`").alias("id"), whole.alias("x"))


def matrix(lists: pa.Array | pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """Rows of 64-bit integers; lists shorter than the longest, or than ``width``, end in zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    sizes = np.diff(np.asarray(lists.offsets))
    width = int(max(sizes.max(initial=0), width or 0))
    if flat.size == len(lists) * width:
        return flat.reshape(len(lists), width)
    out = np.zeros((len(lists), width), np.int64)
    row = np.repeat(np.arange(len(lists)), sizes)
    out[row, np.arange(flat.size) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out
