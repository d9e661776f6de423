"""Connected components as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from meshline.llm.shared import materialize


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``id``, ``component`` (smallest id reachable) of every end of ``edges(a, b)``.

    Alternating large-star and small-star steps: every edge is replaced by one to the smallest neighbour, until
    only stars are left. Each step is a groupBy with partial aggregation and a join whose sides are stored
    tables, so that a hub's rows can be split; the number of edges never grows.
    """
    two = edges.filter(F.col("a") != F.col("b"))
    now = materialize(two.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    size = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    for _ in range(rounds):
        if not size[0]:
            break
        both = materialize(
            now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
                now.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
            )
        )
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = materialize(
            both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        )
        least = materialize(large.groupBy("hi").agg(F.min("lo").alias("m")))
        small = large.join(least, "hi").filter("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        now = materialize(small.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct())
        before, size = size, now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if size == before:
            break
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
    return stars.unionByName(now.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())
