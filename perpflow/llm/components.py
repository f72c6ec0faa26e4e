"""Connected components by alternating stars; every round is a few joins over the edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from perpflow.session import cut_lineage, drop_written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    near = _both_ways(edges)
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _print(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row.n, row.s


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id that has an edge (u, v) to another."""
    now = cut_lineage(edges.where("u <> v").distinct())
    seen = _print(now)
    while True:
        after = cut_lineage(_small_star(_large_star(now)))
        drop_written(now)
        mark = _print(after)
        now = after
        if mark == seen:
            break
        seen = mark
    stars = now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    return stars.union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
