"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm._common import drop_stage, few, stage

MAX_ROUNDS = 60


def _settled(edges: DataFrame) -> bool:
    """Whether the links are stars already: no node has two smaller neighbours, and none with one is the smaller end of a link."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    per = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return per.where("up > 1 OR up = 1 AND down = 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """links (a, b: long) -> node, component (its smallest node) for every node of a link. Loops and repeated links do no harm.

    Each round replaces the links by links to smaller neighbours and ends in a written table; the number of rounds grows as the
    logarithm of the longest path. Minimum per node is a partial aggregate, so a node with very many links is no hot task.
    """
    edges = stage(few(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()), "links")
    for _ in range(MAX_ROUNDS):
        if _settled(edges):
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        new = stage(few(small), "links")
        drop_stage(edges)
        edges = new
    else:
        raise RuntimeError("components did not settle")
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.union(edges.select(F.col("v"), F.col("v"))).distinct()
