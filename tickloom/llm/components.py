"""Connected components by alternating large-star and small-star, on tables of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import discard, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large-star: each node sends its larger neighbours to the smallest in sight. Small-star: its smaller ones and itself.

    The smallest neighbour is an aggregate per node, joined back to the edges: no list of neighbours is ever built, and a
    node with very many edges is cut up by the join.
    """
    if large:
        seen = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).union(edges.select(F.col("v"), F.col("u")))
    else:
        seen = edges.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b"))
    lowest = stored(seen.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "lowest")
    joined = seen.join(lowest, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("b").alias("u"), F.col("m").alias("v")).union(lowest.select(F.col("a"), F.col("m")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for every node of an edge (u, v of type long); no edges, no rows.

    Each round is written to the shared folder; the rounds end when a round changes nothing, which two sums over the edges
    show. Rounds grow with the logarithm of the longest path.
    """
    spark = edges.sparkSession
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = mark(now)
    while before[0]:
        new = stored(_star(stored(_star(now, True), "large"), False), "small")
        after = mark(new)
        discard(spark, now)
        now = new
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v")).distinct())
