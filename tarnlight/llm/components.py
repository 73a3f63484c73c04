"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a map-side-combined minimum per node and an equi join, which Spark
splits where a node has very many neighbours. No edge or component reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tarnlight.llm.store import Workspace


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than a node is linked to the smallest of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.union(least.select("u", F.col("m").alias("v"))).distinct()


def _all_stars(edges: DataFrame) -> bool:
    """Whether each u has one v, and no v is a u: then no step changes anything."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("top")).union(edges.select("v", F.lit(0), F.lit(1)))
    per = ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("top").alias("top"))
    return per.where("down > 1 or (down > 0 and top > 0)").isEmpty()


def connected_components(edges: DataFrame, work: Workspace, label: str) -> DataFrame:
    """edges: u, v of any ordered type. Returns node, component (the smallest node) of every node but the smallest of each component."""
    edges = work.save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{label}-0")
    mark, step = None, 0
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == mark or _all_stars(edges):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark, step = now, step + 1
        edges = work.save(_small_star(_large_star(edges)), f"{label}-{step}")
        if step > 1:
            work.drop(f"{label}-{step - 2}")
