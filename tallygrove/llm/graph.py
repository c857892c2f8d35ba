"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _to_smallest(pairs: DataFrame, above_only: bool) -> DataFrame:
    """Links every neighbour of a node to the smallest id around it: the neighbours above the node, or those below and the node itself."""
    near = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")).withColumnRenamed("u", "w")
    joined = pairs.join(near, pairs["u"] == near["w"])
    if above_only:
        return joined.where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    own = near.where("w > m").select(F.col("w").alias("u"), F.col("m").alias("v"))
    return joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(own).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``root`` (smallest node it can reach) of every node of an edge list, without self-loops; nothing is collected.

    The work of a round is two joins on node ids, with minima combined before they move; the rounds needed grow with
    the logarithm of the longest chain.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    links = cut_lineage(links)
    before = None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        links = cut_lineage(_to_smallest(_to_smallest(both, True), False))
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
