"""Connected components of an edge table, without bringing edges to one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import meet, stored


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `edges` (u, v: long); component is the smallest node reachable.

    Large-star and small-star steps in turn (Kiveris et al., 2014) until nothing
    moves: a hub's edges only ever meet its minimum, found by partial sums, in
    joins that may be split.  Each step is a written table.  Self loops and repeated edges do no harm;
    edges with a null end are left out.
    """
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = stored(meet(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small = meet(large, large.groupBy("u").agg(F.min("v").alias("m")), "u").select("u", "v", "m")
        moved = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        now = stored(moved)
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
