"""Benchmark passages in documents, with DataFrame functions only.

Every window of consecutive benchmark words becomes one 64-bit hash with its text; the hashes are
broadcast when their counted size allows it. Documents are scanned once: each word position gives
one hash, computed inside generated code, a match is verified on the words themselves, and only
matches and one row per document are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reclattice.session import BROADCAST_BYTES

WINDOW = 10
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """A-Z lower-cased, nothing else. Pure ASCII takes the faster general function."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def words(text: Column) -> Column:
    """Words of a text (null: none): runs of a-z, 0-9 and everything beyond ASCII."""
    return F.array_remove(F.split(lowered(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _hash_at(at: Column, length: int) -> Column:
    return F.xxhash64(*[F.get("words", at + k) for k in range(length)])


def _text_at(at: Column, length: Column) -> Column:
    return F.array_join(F.slice("words", at + 1, length), " ")


def windows(benchmark: DataFrame, window: int = WINDOW, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(length, hash, passage, items): distinct windows with the ids of the items they come from.

    An item shorter than ``window`` is one window; one without words, or null, gives none. Items
    without an id count as matches but are not listed.
    """
    items = (
        benchmark.select(F.col(f"`{item_id}`").cast("string").alias("item"), words(F.col(f"`{text}`")).alias("words"))
        .withColumn("n", F.size("words"))
        .filter("n > 0")
        .withColumn("length", F.least("n", F.lit(window)))
        .withColumn("at", F.explode_outer(F.sequence(F.lit(0), F.col("n") - F.col("length"))))
    )
    return (
        items.select("item", "length", _text_at(F.col("at"), F.col("length")).alias("passage"))
        .groupBy("length", "passage")
        .agg(F.collect_set("item").alias("items"))
        .withColumn("words", F.split("passage", " "))
        .withColumn("hash", F.coalesce(*[F.when(F.col("length") == n, _hash_at(F.lit(0), n)) for n in range(1, window + 1)]))
        .select("length", "hash", "passage", "items")
    )


def _sized(found: DataFrame) -> tuple[DataFrame, list[int]]:
    """The windows, marked for broadcast if their counted bytes allow it, and their lengths."""
    facts = found.agg(
        F.collect_set("length").alias("lengths"),
        F.sum(F.octet_length("passage") + F.size("items") * 24 + 64).alias("bytes"),
    ).first()
    small = (facts["bytes"] or 0) <= BROADCAST_BYTES
    return (F.broadcast(found) if small else found), sorted(facts["lengths"]) or [1]


def contamination(
    documents: DataFrame, benchmark: DataFrame, window: int = WINDOW,
    doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(doc_id, text_key, n_words, hits, items), one row per row of ``documents``.

    ``hits`` lists (at, length) of every window of the benchmark in the document, ``items`` the
    ids it belongs to as sorted strings, ``text_key`` a hash of the text. Rows repeated with the
    same id and text come out as often as they went in; null ids are kept. Documents without
    words have no hits; so has everything when the benchmark is empty. Other columns are ignored.
    """
    found, lengths = _sized(windows(benchmark, window, item_id, item_text))
    rows = (
        documents.select(
            F.col(f"`{doc_id}`").alias("doc_id"),
            F.xxhash64(f"`{text}`").alias("text_key"),
            words(F.col(f"`{text}`")).alias("words"),
        )
        .withColumn("n_words", F.size("words"))
        .withColumn("at", F.explode_outer(F.sequence(F.lit(0), F.greatest(F.col("n_words") - lengths[0], F.lit(0)))))
    )

    def piece(n: int) -> Column:
        return F.when(F.col("at") + n <= F.col("n_words"), _hash_at(F.col("at"), n))

    if len(lengths) == 1:
        rows = rows.withColumn("length", F.lit(lengths[0])).withColumn("hash", piece(lengths[0]))
    else:
        each = F.array(*[F.struct(F.lit(n).alias("length"), piece(n).alias("hash")) for n in lengths])
        rows = rows.withColumn("w", F.explode_outer(each)).select("*", "w.length", "w.hash").drop("w")
    found = found.select(F.col("hash").alias("b_hash"), F.col("length").alias("b_length"), "passage", "items")
    first = (F.col("at") == 0) & (F.col("length") == lengths[0])
    matched = (
        F.col("b_hash").isNotNull()
        & (F.col("b_length") == F.col("length"))
        & (F.col("passage") == _text_at(F.col("at"), F.col("length")))
    )
    return (
        rows.join(found, F.col("hash") == F.col("b_hash"), "left")
        .withColumn("matched", matched)
        .filter(F.col("matched") | first)
        .groupBy("doc_id", "text_key", "n_words")
        .agg(
            F.count_if(first).alias("copies"),
            F.collect_set(F.when(F.col("matched"), F.struct("at", "length"))).alias("hits"),
            F.flatten(F.collect_set(F.when(F.col("matched"), F.col("items")))).alias("items"),
        )
        .withColumn("items", F.array_sort(F.array_distinct("items")))
        .withColumn("copy", F.explode_outer(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .drop("copies", "copy")
    )


def report(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Counts and digest of ``contamination``: a word inside any hit counts once."""
    covered = F.array_distinct(
        F.flatten(F.transform("hits", lambda h: F.sequence(h["at"], h["at"] + h["length"] - 1)))
    )
    return contamination(documents, benchmark, **options).select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.size(covered).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def remove_documents(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``documents`` without the rows that hold a benchmark window. Columns and clean rows stay."""
    bad = (
        contamination(documents, benchmark, doc_id=doc_id, text=text, **options)
        .filter(F.size("hits") > 0)
        .select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
    )
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col("__id")) & (F.xxhash64(f"`{text}`") == F.col("__key"))
    return documents.join(bad, same, "left_anti")
