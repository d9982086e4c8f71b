"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantpulse.session import staged


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (id, component): the smallest id that each id of an edge reaches; ids without an edge are absent.

    Every round links the larger neighbours of an id to the least one around it, then the smaller ones;
    edges never become more, and after some rounds (a logarithm of the longest path) each component
    is a star around its least id, where the rounds end. Each step is written to the shared folder. The least
    neighbour comes from a partial aggregation and is staged before its join, so that a hub's partition can
    be split there.
    """
    now = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(),
                 "edges")
    while not _stars(now):
        now = staged(_small(staged(_large(now), "edges")).distinct(), "edges")
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)


def _stars(edges: DataFrame) -> bool:
    """Has every larger end one edge only, and is none of them a smaller end too?"""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")),
        F.struct(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e")).select("e.*")
    worst = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not worst.filter("up > 1 or (up > 0 and down > 0)").limit(1).count()


def _large(edges: DataFrame) -> DataFrame:
    """Larger neighbours v of u are linked to the least of u and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = staged(least.select("u", F.least("u", "m").alias("m")), "least")
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked to the least of them."""
    least = staged(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    joined = edges.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return joined.unionByName(least.select("a", F.col("m").alias("b")))
