"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reclattice.llm.common import written


def _least(both: DataFrame) -> DataFrame:
    """(u, v, m): every neighbour v of u beside the least of u and its neighbours. The minimum is
    combined before the shuffle, and the join may split a node with very many neighbours."""
    least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("m"))
    return both.join(least, "u")


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): component is the least node that can
    be reached. Null ends and links to oneself are ignored; direction and repeats do not matter.

    Each round rewrites the links as stars around smaller nodes, in a written table; the number of
    rounds grows with the logarithm of the longest chain.
    """
    spark = links.sparkSession
    edges = written(
        links.filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "links",
    )
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0:
            return spark.createDataFrame([], f"node {dict(links.dtypes)['a']}, component {dict(links.dtypes)['a']}")
        if state == before:
            break
        before = state
        # Large star: neighbours above u move to the least neighbour of u.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Small star: u and its neighbours below it move to the least of them.
        small = _least(large)
        edges = written(
            small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").filter("u <> v").distinct(),
            "links",
        )
    # Every edge now joins a node to the least node of its component.
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
