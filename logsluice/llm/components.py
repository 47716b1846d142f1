"""Connected components of a link table, by alternating large-star and small-star steps.

Each round is two grouped minima and two joins over (u, v) rows; no group is gathered in one place, and every round is
written to the shared folder, so lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.filter("v > u").join(least, "u").select(F.col("m").alias("u"), "v").filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    moved = edges.join(least, "v").filter("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v"))
    return moved.unionByName(least.select(F.col("m").alias("u"), "v")).distinct()


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """Rows (node, component) for every node that a link names: component is the smallest node that it reaches.

    Nulls and links of a node to itself count for nothing; repeated links do no harm; no links give no rows.
    """
    pairs = links.select(F.least(left, right).alias("u"), F.greatest(left, right).alias("v"))
    edges = written(pairs.filter(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col("u") != F.col("v"))).distinct(), "links")
    state = lambda e: e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    before = None
    while before != (now := state(edges)) and now.n:
        before = now
        edges = written(_small_star(_large_star(edges)), "links")
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("component"))).distinct()
