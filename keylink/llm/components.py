"""Connected components of an edge table by alternating large and small stars.

Each round writes its edges to the shared scratch folder. A hub's edges never meet in one task: its
least neighbour comes from a partial aggregation, and the join back splits where it is skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keylink.sources.workspace import Workspace


def _least(both: DataFrame) -> DataFrame:
    return both.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("u2"), F.least("u", "m").alias("m")
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    up = both.filter("v > u").join(_least(both), F.col("u") == F.col("u2"))
    return up.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    moved = down.join(least, F.col("u") == F.col("u2"))
    links = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select(F.col("u2").alias("u"), F.col("m").alias("v"))
    return links.union(own).filter("u <> v").distinct()


def components(edges: DataFrame, space: Workspace) -> DataFrame:
    """(u, v): for each node of an edge (columns u and v) other than the least of its component,
    that least node."""
    edges = edges.filter("u <> v").select("u", "v")
    mark = before = None
    while True:
        edges = space.save(_small_star(_large_star(edges)), "stars")
        if before is not None:
            space.drop(before)
        before = edges
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(now) == mark:
            return edges
        mark = tuple(now)
