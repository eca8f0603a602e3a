"""Connected components over links between ids, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, tidied, written


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every linked node but the smallest of each component, which is what component names. links: a long, b long.

    Alternates large-star and small-star steps (Kiveris et al., 2014): each node tells its
    larger, then its smaller neighbours of the smallest id it knows, until every link leads to
    a component's smallest node, after about as many rounds as the logarithm of the nodes. A step
    is a minimum by key, summed before the shuffle, and an equi-join of checkpointed sides, which
    are plain exchanges, so Spark can split a node with very many links.

    Self links and repeated links do no harm; links with a null end are left out; no links
    give no rows.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    rounds = 0
    while not _settled(edges):
        rounds += 1
        both = edges.select("u", "v").union(edges.select("v", "u"))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small_least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        told = large.join(small_least, "u")
        small = told.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Of a table Spark knows the size; its estimate for a checkpoint grows with the joins of all rounds before.
        edges = cut(small) if rounds % 4 else written(small, "links")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _settled(edges: DataFrame) -> bool:
    """Whether every larger end has one link, and is no smaller end: each link then leads to its component's smallest node."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("larger"), F.lit(0).alias("smaller")).union(edges.select("v", F.lit(0), F.lit(1)))
    with tidied(edges.sparkSession):
        return ends.groupBy("node").agg(F.sum("larger").alias("larger"), F.max("smaller").alias("smaller")).where("larger > 1 or (larger = 1 and smaller = 1)").isEmpty()
