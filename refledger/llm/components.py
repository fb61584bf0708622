"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refledger.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is the smallest node of its component.

    Each round points the neighbourhood of every node to its smallest neighbour (first the larger neighbours,
    then the smaller ones); rounds grow with the logarithm of a component's diameter.  Null ends are ignored.
    """
    edges = links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = cut_lineage(edges)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "w")
        large = both.filter("v > u").join(least, F.col("u") == F.col("w")).select(
            F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(smallest.withColumnRenamed("u", "w"), F.col("u") == F.col("w"))
        edges = cut_lineage(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(
            smallest.select("u", F.col("m").alias("v"))).distinct())
        # the same set twice: only stars are left, for contraction never brings an earlier set back
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return ends.unionByName(roots)
