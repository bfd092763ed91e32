"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_counted, packed


def _least(edges: DataFrame) -> DataFrame:
    """The least v of each u and how many there are, so that a hub's edges can be joined where they lie."""
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("count"))


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).withColumn("m", F.least("u", "m"))
    return join_counted(both.where("v > u"), least, "u", "m", n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    moved = join_counted(down, least, "u", "m", n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, nodes: int) -> DataFrame:
    """(u, v): each node that has an edge and isn't the least of its component, with that least node.

    edges: (u, v), in any direction, u and v different; nodes: how many there are at most. Edges stay as many as nodes at most
    after the first round; each star goes to the shared checkpoint folder, since a plan over
    both reads its input sixty times before Spark finds what is equal, and the driver holds that plan.
    """
    stars, before = cut(packed(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), nodes)), None
    while True:
        large = cut(packed(_large_star(stars, nodes), nodes))
        stars = cut(packed(_small_star(large, nodes), nodes))
        row = stars.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        now = (row["n"], row["h"])
        if now == before or not row["n"]:
            return stars
        before = now
