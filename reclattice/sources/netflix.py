"""Netflix-prize text: a ``movie:`` line sets the movie of the ``customer,score,date`` lines after it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reclattice.session import broadcast_if_small, ship_package, stored

# Bytes of a row (file, split, movie) besides the path, in the broadcast size check.
_SPLIT_BYTES = 64


def _carry_headers(batches):
    """Lines of one partition in file order: rating lines with the movie set before them in their own
    split (null before the first header), and one row without a line per split with its last header."""
    place, movie = None, None

    def last() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "line": pa.array([None], pa.string()), "file": pa.array([place[0]]), "split": pa.array([place[1]], pa.int64()),
            "movie": pa.array([movie], pa.string()),
        })

    for batch in batches:
        lines, files, splits = batch.columns
        if not len(lines):
            continue
        header = pc.ends_with(lines, ":").to_numpy(zero_copy_only=False)
        codes = [c.dictionary_encode().indices.to_numpy() for c in (files, splits)]
        new = np.r_[True, (codes[0][1:] != codes[0][:-1]) | (codes[1][1:] != codes[1][:-1])]
        edges = np.flatnonzero(new)
        for lo, hi in zip(edges, [*edges[1:], len(lines)], strict=True):
            here = (files[lo].as_py(), splits[lo].as_py())
            if here != place:
                if place is not None:
                    yield last()
                place, movie = here, None
            names = pc.utf8_slice_codeunits(lines.slice(lo, hi - lo), 0, -1)
            at = np.maximum.accumulate(np.where(header[lo:hi], np.arange(hi - lo), -1))
            carried = names.take(pa.array(np.maximum(at, 0)))
            carried = pc.if_else(pa.array(at >= 0), carried, pa.scalar(movie, pa.string()))
            movie = carried[-1].as_py()
            rated = pa.array(~header[lo:hi])
            part = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, carried], names=["line", "file", "split", "movie"]
            ).filter(rated)
    if place is not None:
        yield last()


def read_movie_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(CustomerID, Score, Date, MovieID) from files of movie headers and rating lines.

    The text is read once, split by split, and the header is carried along in the task; no line is
    sorted or shuffled. Across splits only the last header of every split travels. Lines before a file's
    first header have a null movie.
    """
    ship_package(spark)
    lines = spark.read.text(path).select(
        F.trim("value").alias("line"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
    ).filter(F.length("line") > 0)
    carried, _ = stored(lines.mapInArrow(_carry_headers, "line string, file string, split long, movie string"), "movie-lines")
    splits = carried.filter(F.col("line").isNull())
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("file", "split", F.last("movie", ignorenulls=True).over(before).alias("earlier"))
    size = splits.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.octet_length("file")), F.lit(0)).alias("bytes")).first()
    side = broadcast_if_small(starts, size["n"], size["bytes"] + _SPLIT_BYTES)
    rated = carried.filter(F.col("line").isNotNull()).join(side, ["file", "split"], "left")
    fields = F.from_csv("line", F.lit("CustomerID long, Score double, Date string"))
    return rated.select(
        fields.alias("f"), F.coalesce("movie", "earlier").cast("long").alias("MovieID")
    ).select("f.CustomerID", "f.Score", "f.Date", "MovieID")


def positive_netflix(ratings: DataFrame, min_value: float = 3.5) -> DataFrame:
    """Ratings above ``min_value`` under the canonical names."""
    return ratings.filter(F.col("Score") > min_value).withColumnsRenamed(
        {"CustomerID": "user", "Score": "rating", "Date": "timestamp", "MovieID": "item"}
    )
