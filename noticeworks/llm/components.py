"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is two shuffles of the edges; a round is written to the shared folder, so lineage stays short and a lost
executor costs one round.  Nothing but the number of changed edges comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeworks.llm import common

MAX_ROUNDS = 60


def _star(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Links the neighbours of each node to the smallest of them: the larger ones (large-star) or the smaller ones (small-star)."""
    if larger_only:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = both.join(least, "u")
    if larger_only:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of the edges (columns u, v; any order, repeats allowed)."""
    edges = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = common.written(edges, "edges")
    for _ in range(MAX_ROUNDS):
        large = _star(edges, True).where("u != v").distinct()
        small = _star(large, False).where("u != v").distinct()
        after = common.written(small, "edges")
        # Stars are reached when no node has two parents and no parent has a parent.
        settled = after.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("v"))
        open_nodes = settled.where("n > 1").count() or after.join(after.select(F.col("u").alias("v")).distinct(), "v", "left_semi").count()
        edges = after
        if not open_nodes:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
