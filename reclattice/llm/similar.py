"""Clusters of texts whose word-shingle sets have a Jaccard similarity of at least a bound.

1. Each text gives a sketch, cut into bands; texts with equal sets are one node from here on.
2. In each bucket (texts that share a band) every node is paired with one pivot, not with all
   others, and the pairs are verified on the full sets. That joins most true clusters.
3. What is left are buckets that still hold nodes of different components. Only there, nodes are
   compared with all others of another component, on their full sets, between blocks of bounded
   size. A task returns the links that join two components, not the pairs.
4. Components of all links.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reclattice.llm.common import TEXTS, add_columns, written
from reclattice.llm.components import connected_components
from reclattice.llm.covertree import Forest
from reclattice.llm.sketches import Shingler, Words, band_keys, set_key, text_groups
from reclattice.session import BROADCAST_BYTES, ship_package

# Nodes per block of step 3; a task there compares two blocks.
BLOCK = 512


@dataclass(frozen=True)
class Settings:
    """Sets of ``width``-word shingles are linked at Jaccard >= ``similarity``; ``sketch`` makes
    the sketcher, whose size is bands x rows.
    ``one_text`` says that rows of one id have the same words, so any of them will do."""

    sketch: Callable
    bands: int
    rows: int
    width: int = 5
    similarity: Fraction = Fraction(4, 5)
    one_text: bool = False

    @property
    def size(self) -> int:
        return self.bands * self.rows


def sketched(units: DataFrame, settings: Settings) -> DataFrame:
    """(id, n, k1, k2, bands) of units (id, text): set size, set key and band keys. Texts without
    words have n = 0 and no bands."""

    def make():
        shingle, sketch = Shingler(settings.width), settings.sketch(settings.size)

        def step(texts):
            n, k1, k2, bands = [], [], [], []
            for text in texts.to_pylist():
                found = shingle(text)
                n.append(len(found))
                if len(found):
                    one, two = set_key(found)
                    k1.append(one)
                    k2.append(two)
                    bands.append(band_keys(sketch(found), settings.rows))
                else:
                    k1.append(0)
                    k2.append(0)
                    bands.append(np.zeros(0, np.int64))
            return [
                pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
                pa.array(bands, pa.list_(pa.int64())),
            ]

        return step

    return add_columns(units, ["text"], "n bigint, k1 bigint, k2 bigint, bands array<bigint>", make, TEXTS).drop("text")


Texts = Callable[[DataFrame], DataFrame]


def _texts_of(texts: Texts, ids: DataFrame, count: int, settings: Settings) -> DataFrame:
    """(id, text) of some units. The ids are broadcast while ``count`` of them are small, and
    joined otherwise; only the texts asked for are shuffled afterwards."""
    found = texts(F.broadcast(ids) if count * 32 <= BROADCAST_BYTES else ids)
    return found.dropDuplicates(["id"]) if settings.one_text else found


def verified(pairs: DataFrame, texts: Texts, settings: Settings) -> DataFrame:
    """Those of ``pairs`` (a, b) whose texts reach the similarity on their full shingle sets.

    A pivot with very many partners is a skewed join key, which Spark splits; its text is copied
    to the splits, not to one task.
    """
    ship_package(pairs.sparkSession)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    found = _texts_of(texts, ids, 2 * pairs.count(), settings)
    left = found.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = found.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    top, bottom = settings.similarity.numerator, settings.similarity.denominator

    def run(batches):
        for batch in batches:
            keep = [np.zeros(0, bool)]
            for _, (one, two) in text_groups(batch.column(2), batch.column(3)):
                many = len(one)
                text, key = Words(one + two).sets(settings.width)
                size = np.bincount(text, minlength=2 * many)
                # A hash that comes twice in a pair is in both sets.
                pair = text % many
                order = np.lexsort((key, pair))
                pair, key = pair[order], key[order]
                twice = (pair[1:] == pair[:-1]) & (key[1:] == key[:-1])
                shared = np.bincount(pair[1:][twice], minlength=many)
                keep.append((bottom * shared >= top * (size[:many] + size[many:] - shared)) & (shared > 0))
            keep = pa.array(np.concatenate(keep))
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in batch.columns[:2]], names=["a", "b"])

    kind = dict(pairs.dtypes)["a"]
    return joined.mapInArrow(run, f"a {kind}, b {kind}")


def _blocks(rest: DataFrame) -> DataFrame:
    """(h, task, side, node, component): the members of buckets, dealt to pairs of blocks.

    A component with many members of a bucket has blocks of its own, which are never compared
    with each other; the other members share blocks.
    """
    parts = rest.groupBy("h", "component").agg(F.count("*").alias("m"))
    small = parts.filter(F.col("m") < BLOCK).groupBy("h").agg(F.sum("m").alias("mixed"))
    sized = rest.join(parts, ["h", "component"]).join(small, "h", "left")
    slot = F.pmod(F.xxhash64("node"), F.ceil(F.when(F.col("m") < BLOCK, F.col("mixed")).otherwise(F.col("m")) / BLOCK))
    dealt = sized.withColumn("own", F.when(F.col("m") >= BLOCK, F.col("component"))).withColumn(
        "block", F.struct(F.col("own"), slot.alias("slot"))
    )
    blocks = dealt.select("h", "block").distinct()
    pairs = (
        blocks.select("h", F.col("block").alias("i"))
        .join(blocks.select("h", F.col("block").alias("j")), "h")
        .filter((F.col("i") <= F.col("j")) & ~F.coalesce(F.col("i.own") == F.col("j.own"), F.lit(False)))
    )
    left, right = (F.struct(F.lit(k).alias("side"), F.col(c).alias("block")) for k, c in ((0, "i"), (1, "j")))
    ends = pairs.select(
        "h", F.xxhash64("i", "j").alias("task"),
        F.explode(F.when(F.col("i") == F.col("j"), F.array(left)).otherwise(F.array(left, right))).alias("e"),
    ).select("h", "task", "e.side", "e.block")
    return ends.join(dealt.select("h", "block", "node", "component"), ["h", "block"]).select("h", "task", "side", "node", "component")


def joining_links(rest: DataFrame, texts: Texts, settings: Settings) -> DataFrame:
    """(a, b): links that join different components inside the buckets of ``rest`` (h, node,
    component). Of the links of a task only those are returned that join what it has not joined
    yet, so there are fewer than nodes."""
    ship_package(rest.sparkSession)
    kind = dict(rest.dtypes)["node"]
    top, bottom = settings.similarity.numerator, settings.similarity.denominator
    ids = rest.select(F.col("node").alias("id")).distinct()
    found = _texts_of(texts, ids, rest.count(), settings).withColumnRenamed("id", "node")
    dealt = _blocks(rest).join(found, "node").select("h", "task", "side", "node", "component", "text")

    def compare(rows: list[tuple]) -> list[tuple]:
        """The links of one task; rows are (side, node, component, set)."""
        node, part = [r[1] for r in rows], [r[2] for r in rows]
        side, size = np.array([r[0] for r in rows]), np.array([len(r[3]) for r in rows], np.int64)
        same = not (side == 1).any()
        one = np.flatnonzero((side == 0) & (size > 0))
        two = one if same else np.flatnonzero((side == 1) & (size > 0))
        if not len(one) or not len(two):
            return []
        _, flat = np.unique(np.concatenate([r[3] for r in rows]), return_inverse=True)
        cuts = np.cumsum(size) - size
        marked = np.zeros(int(flat.max(initial=-1)) + 1, bool)
        # Rows of the second block one after the other, each with the places of its shingles.
        listed = np.concatenate([flat[cuts[j]:cuts[j] + size[j]] for j in two])
        starts = np.cumsum(size[two]) - size[two]
        parts = np.array(part)
        forest = Forest(parts)
        found = []
        for i in one:
            own = flat[cuts[i]:cuts[i] + size[i]]
            marked[own] = True
            shared = np.add.reduceat(marked[listed], starts, dtype=np.int64)
            marked[own] = False
            hit = (bottom * shared >= top * (size[i] + size[two] - shared)) & (parts[two] != parts[i])
            for j in two[hit]:
                if forest.find(part[i]) != forest.find(part[j]):
                    forest.union(part[i], part[j])
                    found.append((node[i], node[j]))
        return found

    def run(batches):
        # Rows of a task follow each other; the last one of a batch may go on in the next.
        task, rows = None, []
        for batch in batches:
            links = []
            for begin, (texts,) in text_groups(batch.column(5)):
                text, key = Words(texts).sets(settings.width)
                sets = np.split(key, np.searchsorted(text, np.arange(1, len(texts))))
                *tasks, side, node, part = (batch.column(i).slice(begin, len(texts)).to_pylist() for i in range(5))
                for now, row in zip(zip(*tasks, strict=True), zip(side, node, part, sets, strict=True), strict=True):
                    if now != task:
                        links += compare(rows) if rows else []
                        task, rows = now, []
                    rows.append(row)
            yield linked(links)
        if rows:
            yield linked(compare(rows))

    def linked(links: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()).cast(ends) for i in (0, 1)], names=["a", "b"])

    ends = {"int": pa.int32(), "bigint": pa.int64()}.get(kind, pa.int64())
    dealt = dealt.repartition("h", "task").sortWithinPartitions("h", "task")
    return dealt.mapInArrow(run, f"a {kind}, b {kind}")


def clusters(units: DataFrame, settings: Settings, texts: Texts | None = None, sketches: DataFrame | None = None) -> DataFrame:
    """(id, n, component) for each row of ``units`` (id integer, text): the size of its set and
    the least id that links lead to.

    Rows with a null id or without words are linked with nothing: their component is their id.
    Rows that repeat an id are one node with the links of all its texts. Other columns of
    ``units`` are ignored. ``texts`` gives the (id, text) of a table of ids where that is cheaper
    than looking through ``units``, and ``sketches`` the rows of ``sketched`` where they are at hand.
    """
    units = units.select("id", "text")
    texts = texts or (lambda ids: units.join(ids, "id", "left_semi"))
    every = sketched(units, settings) if sketches is None else sketches
    rows = written(every.distinct() if settings.one_text else every, "sketches")
    real = rows.filter("n > 0 and id is not null")
    equal = real.groupBy("k1", "k2", "n").agg(F.min("id").alias("node"))
    # The row of a node keeps its bands: those of all sets whose least id it is.
    own = F.when(F.col("id") == F.col("node"), F.col("bands")).alias("bands")
    member = written(real.join(equal, ["k1", "k2", "n"]).select("id", "n", "node", "k1", "k2", own), "members")
    nodes = member.filter("bands is not null").select("node", "n", "k1", "k2", "bands")
    if not settings.one_text:
        nodes = nodes.dropDuplicates(["node", "k1", "k2", "n"])

    # A set of n shingles and a different one have a Jaccard similarity of n / (n + 1) at most.
    top, bottom = settings.similarity.numerator, settings.similarity.denominator
    nodes = written(nodes.filter(F.col("n") * (bottom - top) >= top).select("node", "bands"), "nodes")
    entries = nodes.select("node", F.explode("bands").alias("h"))
    pivots = written(
        entries.groupBy("h").agg(F.count("*").alias("m"), F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi"),
        "pivots",
    )
    # Most bands have one node: the others are broadcast while their number is small.
    if pivots.count() * 64 <= BROADCAST_BYTES:
        pivots = F.broadcast(pivots)
    # Half of the buckets, by a bit of the band key, use their least node and half their greatest.
    pivot = F.when(F.col("h").bitwiseAND(1) == 0, F.col("lo")).otherwise(F.col("hi"))
    shared = written(entries.join(pivots, "h").select("h", "m", "node", pivot.alias("pivot")), "buckets")
    stars = written(
        shared.filter("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), "stars"
    )
    links = verified(stars, texts, settings)
    if not settings.one_text:
        # A repeated id ties its texts together, and equal sets are tied by their common node.
        repeated = member.groupBy("id").agg(F.min("node").alias("b"), F.collect_set("node").alias("all")).filter(F.size("all") > 1)
        links = links.union(repeated.select(F.explode("all").alias("a"), "b")).union(repeated.select(F.col("id").alias("a"), "b"))
    first = written(links, "links")
    found = written(connected_components(first), "components")

    def component(df: DataFrame) -> DataFrame:
        return df.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))

    labelled = component(shared.filter("m > 2").select("h", "node"))
    mixed = (
        labelled.groupBy("h")
        .agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m"),
             F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who"))
        .filter("lo < hi")
        # Bands often gather the very same nodes; one of those buckets is enough.
        .groupBy("m", "who").agg(F.min("h").alias("h")).select("h")
    )
    rest = written(labelled.join(mixed, "h").select("h", "node", "component").distinct(), "rest")
    second = written(joining_links(rest, texts, settings), "links")
    if second.isEmpty():
        final = found
    else:
        final = written(connected_components(first.union(second)), "components")
    own = member.join(final, "node", "left").select("id", "n", F.coalesce("component", "node").alias("component"))
    return own.union(rows.filter("n = 0 or id is null").select("id", "n", F.col("id").alias("component")))
