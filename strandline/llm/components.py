"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import discard, staged


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the least of it and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    # Only the larger neighbours move, and they are the edges as they stand (u < v), so the join sends each edge once.
    return edges.join(least, "u").select(F.col("m").alias("u"), "v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of them."""
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    moved = edges.join(least, "v").select(F.col("m").alias("u"), F.col("u").alias("v"))
    own = least.select(F.col("m").alias("u"), "v")
    return moved.filter("u < v").unionByName(own)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component), staged: the least node reachable, for every node of `edges` (u, v; any order, repeats and loops allowed).

    Each round is staged in the shared folder and replaces the one before; it ends when a round changes nothing, told
    by the number of edges and two sums over them. Stars about a hot node are joins that adaptive execution can split.
    """
    spark = edges.sparkSession
    now = staged(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u < v").distinct(), name)
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.col("u").cast("decimal(38,0)"))).first()
        if mark == tuple(seen):
            break
        mark = tuple(seen)
        following = staged(_small_star(_large_star(now).distinct()).distinct(), name)
        discard(spark, now)
        now = following
    out = now.select(F.col("v").alias("node"), F.col("u").alias("component"))
    out = staged(out.unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()), f"{name}-nodes")
    discard(spark, now)
    return out
