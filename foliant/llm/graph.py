"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours (large: the greater ones, else the smaller ones) are tied to its least neighbour."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("least")).withColumn("least", F.least("u", "least"))
    tied = both.join(least, "u")
    if large:
        out = tied.filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    else:
        out = tied.select(F.col("v").alias("u"), F.col("least").alias("v")).union(least.select("u", F.col("least").alias("v")))
    return out.filter("u != v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 20)))).first())


def components(edges: DataFrame) -> DataFrame:
    """(id, component: the least node that can be reached) of every node of edges (u, v); no edge, no rows."""
    edges = materialize(edges.select("u", "v").filter("u != v").distinct(), "edges")
    state = None
    while (now := _state(edges)) != state:
        state = now
        edges = materialize(_star(_star(edges, True), False), "stars")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
