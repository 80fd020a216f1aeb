"""Connected components of a graph given by its edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import table


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One step over edges (u, v). Large: each node hands its smallest neighbour to its larger ones; small: to its
    smaller ones and itself. The minimum is pre-aggregated and joined back, so that no node's neighbours ever meet."""
    hi, lo = F.greatest("u", "v"), F.least("u", "v")
    both = edges.select(hi.alias("u"), lo.alias("v")) if small else edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    if not small:
        least = least.withColumn("m", F.least("u", "m"))
    near = both.join(least, "u")
    out = near.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if not small else near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component) for every node that an edge (u, v) touches; component is its smallest reachable node."""
    edges = table(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(most):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
        if now == seen or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = now
        edges = table(_star(table(_star(edges, False), "large"), True), "small")
    raise RuntimeError("components did not settle")
