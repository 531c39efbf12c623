"""Connected components of a graph given as rows of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.tables import stored


def components(links: DataFrame) -> DataFrame:
    """(``node``, ``root``) for every node of ``links`` (long columns ``a``, ``b``); the root is the smallest node.

    Every round links nodes to smaller ones only, until all links point at a root. The rounds
    grow with the logarithm of the longest chain. Every table is written, none is collected.
    """
    edges = stored(
        links.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(),
        "links",
    )
    before = None
    while True:
        # larger neighbours of a node go to the smallest neighbour (or the node)
        both = edges.select("v", "u").union(edges.select("u", "v"))
        least = stored(both.groupBy("v").agg(F.min("u").alias("m")), "least")
        large = stored(
            both.join(least, "v")
            .filter(F.col("u") > F.col("v"))
            .select(F.col("u").alias("v"), F.least("v", "m").alias("u"))
            .distinct(),
            "large-star",
        )
        # then the smaller neighbours of a node, and the node itself, go to the smallest of them
        least = stored(large.groupBy("v").agg(F.min("u").alias("m")), "least")
        pulled = large.join(least, "v").filter(F.col("u") > F.col("m")).select(F.col("u").alias("v"), F.col("m").alias("u"))
        edges = stored(pulled.union(least.select("v", F.col("m").alias("u"))).distinct(), "small-star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return roots.union(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
