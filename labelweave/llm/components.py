"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.llm import common


def components(edges: DataFrame) -> DataFrame:
    """edges (u long, v long) to (node, component): the smallest node that each node of an edge reaches.

    A large star links every larger neighbour of a node to the node's smallest neighbour, a small star every smaller
    one; the two in turn end, after a number of rounds that grows with the logarithm of the nodes, in one star for each component.
    Minima are pre-aggregated before each shuffle, and the table is written once a round."""
    edges = common.written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.coalesce(F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))), F.lit(0))).first()
        if tuple(state) == seen or not state[0]:
            break
        seen = tuple(state)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large, before = common.written(large, "edges"), edges
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = common.written(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "edges")
        common.drop(before, large)
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
