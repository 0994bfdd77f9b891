"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codescope.sources.scratch import few_files, materialise


def components(links: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``links(a, b)``; the label is the component's smallest node.

    Each round points every larger neighbour of a node at the node's smallest
    neighbour, then every smaller one. Rounds grow with the logarithm of the
    component's size; each ends in a written table. Minima are partial
    aggregates and joins have one row per node on one side, so a node with very
    many links is no single task's work. An empty table gives an empty frame.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialise(edges, "edges")
    seen = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        # large star: neighbours above a node go to its smallest neighbour (or itself)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: neighbours below a node, and the node, go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = materialise(few_files(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), mark[0]), "edges")
    return edges.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label").unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
