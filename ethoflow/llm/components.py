"""Connected components of a distributed edge list.

Alternating large-star and small-star rounds (the published MapReduce
algorithm): each round only joins and aggregates the edge list, ends in a
written table, and the number of rounds grows with the logarithm of the
largest component's diameter.  Nodes with over a thousandth of all edges, of
which there are two thousand at most, meet their least neighbour by a broadcast
join, so that a large star is not one task's work.  No node, edge or component reaches the driver;
it only sees a row count and a checksum for each round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ethoflow.llm._common import Scratch


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return (row[0], row[1])


def _with_least(edges: DataFrame, least: Column, total: int) -> DataFrame:
    """Edges (u, v) with m, the smallest of ``least`` over the edges of u."""
    low = edges.groupBy("u").agg(F.min(least).alias("m"), F.count(F.lit(1)).alias("n"))
    hot = F.broadcast(low.where(F.col("n") > total // 1000).select("u", F.col("m").alias("hot")))
    rows = edges.join(hot, "u", "left")
    cold = rows.where("hot is null").select("u", "v").join(low.where(F.col("n") <= total // 1000).select("u", "m"), "u")
    return cold.unionAll(rows.where("hot is not null").select("u", "v", F.col("hot").alias("m")))


def connected_components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, root): root is the smallest node that can be reached.

    Nodes without an edge to another node are absent.  Nulls, self-loops and
    repeated edges are ignored; an empty edge list gives an empty result.
    """
    now = scratch.keep(
        edges.where(f"{a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges"
    )
    mark = _mark(now)
    while mark[0]:
        # Large star: every larger neighbour of a node points at the smallest one it knows.
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, F.least("u", "v"), mark[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: the smaller neighbours of a node, and it, point at the smallest of them.
        pairs = _with_least(large, F.col("v"), mark[0]).select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")
        )
        new = scratch.keep(pairs.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        new_mark = _mark(new)
        scratch.drop(now)
        now = new
        if new_mark == mark:
            break
        mark = new_mark
    tips = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return tips.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
