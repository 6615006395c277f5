"""Near-duplicate documents by fast similarity sketching, banding and exact verification."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reclattice.llm.common import passing, written
from reclattice.llm.similar import Settings, clusters
from reclattice.llm.sketches import FastSimilarity
from reclattice.session import broadcast_if_small

# 32 bands of 4 of 128 coordinates: a pair at 0.8 shares no band with a chance of 5e-8.
DOCUMENTS = Settings(sketch=FastSimilarity, bands=32, rows=4, width=5, similarity=Fraction(4, 5))
FOUR_WORDS = Settings(sketch=FastSimilarity, bands=32, rows=4, width=4, similarity=Fraction(4, 5))


def near_duplicates(documents: DataFrame, settings: Settings = DOCUMENTS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``documents``.

    ``component_id`` is the least id that links lead to; the document with that id is kept. Null
    or wordless texts have no shingles and stay alone. Rows without an id cannot be linked; their
    component is null and they are kept. Rows that repeat an id share a component.
    """
    units = documents.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    return clusters(units, settings).select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"),
    )


def one_of_each(documents: DataFrame, settings: Settings = DOCUMENTS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` with one row per cluster of near-duplicates; rows without an id all stay.

    Where the kept id stands for several texts, one of each stays that are not near-duplicates.
    """
    with passing(documents.sparkSession):
        found = near_duplicates(documents, settings, doc_id, text)
        kept = written(found.filter("kept and doc_id is not null").select("doc_id").distinct(), "kept", stays=True)
    named = documents.filter(F.col(f"`{doc_id}`").isNotNull())
    # Texts stay where they are while the kept ids are small.
    ids = broadcast_if_small(kept.select(F.col("doc_id").alias("__kept")), kept.count(), 32)
    chosen = named.join(ids, F.col(f"`{doc_id}`") == F.col("__kept"), "left_semi")
    unnamed = documents.filter(F.col(f"`{doc_id}`").isNull())
    once = chosen.withColumn("__unit", F.xxhash64(doc_id, text))
    repeated = written(
        once.groupBy(F.col(f"`{doc_id}`").alias("__again")).agg(F.count("*").alias("times"), F.count_distinct("__unit").alias("m"))
        .filter("times > 1").select("__again", "m"),
        "repeated",
    )
    # Only rows whose id repeats are shuffled with their texts.
    again = F.col(f"`{doc_id}`") == F.col("__again")
    single = chosen.join(repeated, again, "left_anti").union(unnamed)
    if repeated.isEmpty():
        return chosen.union(unnamed)
    single = single.union(chosen.join(repeated.filter("m = 1"), again, "left_semi").dropDuplicates([doc_id]))
    several = repeated.filter("m > 1").select(F.col("__again").alias("__several"))
    if several.isEmpty():
        return single
    mixed = once.join(several, F.col(f"`{doc_id}`") == F.col("__several"), "left_semi")
    with passing(documents.sparkSession):
        parts = clusters(mixed.select(F.col("__unit").alias("id"), F.col(f"`{text}`").alias("text")), settings)
        least = written(
            mixed.select(F.col(f"`{doc_id}`").alias("__id"), "__unit").distinct()
            .join(parts.select(F.col("id").alias("__unit"), "component").distinct(), "__unit")
            .groupBy("__id", "component").agg(F.min("__unit").alias("__least")).select("__least"),
            "least", stays=True,
        )
    own = mixed.join(least, F.col("__unit") == F.col("__least"), "left_semi").dropDuplicates(["__unit"]).drop("__unit")
    return single.union(own)
