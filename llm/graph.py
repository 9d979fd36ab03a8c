"""Connected components by alternating stars, on DataFrames of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Joins neighbours of each node to the least of them: larger neighbours (large), or smaller ones and the node."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.where("v < u")
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    if large:
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node reachable, for every node of edges (u, v). Each round writes its edges, whose number
    never exceeds that of the first; rounds grow with the logarithm of the longest path."""
    now = saved(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(now)
    while before[0]:
        last, now = now, saved(_star(_star(now, True), False))
        discard(last)
        after = mark(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = saved(roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
    discard(now)
    return out
