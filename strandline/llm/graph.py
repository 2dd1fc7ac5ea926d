"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import dropped, written


def _mark(edges: DataFrame) -> tuple[int, int, int]:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x"),
        F.coalesce(F.sum(F.xxhash64("b", "a") % 1_000_003), F.lit(0)).alias("s"),
    ).first()
    return row["n"], row["x"], row["s"]


def _large_star(edges: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Every neighbour above a node goes to the node's least neighbour. The least
    ones are a written table: both sides of the join are then plain exchanges,
    and the rows of a hub can be split over tasks."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = written(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("v", "u").alias("m")), name)
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")), least


def _small_star(edges: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Every neighbour below a node, and the node, go to the least of them."""
    least = written(edges.groupBy("a").agg(F.min("b").alias("m")), name)
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct(), least


def components(links: DataFrame, a: str, b: str, name: str = "components") -> DataFrame:
    """``node`` and ``component`` (the least node reachable) for every linked node.

    Nodes must be orderable and not null; links to itself are left out. The
    rounds run on Spark, each written to the shared folder, so neither links nor
    components pass through the driver; their number grows with the logarithm
    of the longest chain.
    """
    links = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    mark = _mark(edges)
    while mark[0]:
        large, one = _large_star(edges, name)
        large = written(large, name)
        small, two = _small_star(large, name)
        after = written(small, name)
        for old in (edges, one, large, two):
            dropped(old)
        edges, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
