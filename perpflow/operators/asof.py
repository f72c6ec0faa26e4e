"""As-of joins as one union, one shuffle by (series, chunk) and one window pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from perpflow.operators.chunks import CHUNK, Grid, window


def asof_join(left: DataFrame, rights: Sequence[tuple[DataFrame, dict[str, str]]], keys: Sequence[str], order: str,
              grid: Grid, *, forward: bool = False, tie: Column | None = None) -> DataFrame:
    """Attach to each left row the nearest row of every right table, within its series.

    Each right table comes with its wanted columns and their names in the result. Backward
    takes the last right row at or before the left row; ``forward=True`` the first one at or
    after it. ``tie`` (a boolean over left columns, default true) says whether an equal
    position counts. A right row in a distant chunk is found through a table that has one row
    per chunk.
    """
    sign = -1 if forward else 1
    pick = F.min_by if forward else F.max_by
    equal = F.lit(True) if tie is None else tie
    # Place of the left row among right rows (rank 0) of the same position.
    rank = F.when(equal, F.lit(sign)).otherwise(F.lit(-sign))
    lhs = left.withColumn(CHUNK, grid.chunk(left, order))
    both = lhs.withColumn("_rank", rank).withColumn("_is_left", F.lit(True))
    edges = lhs.select(*keys, CHUNK).distinct()
    for i, (right, columns) in enumerate(rights):
        rows = right.withColumn(CHUNK, grid.chunk(right, order))
        value = F.struct(*[F.col(c).alias(name) for c, name in columns.items()]).alias(f"_v{i}")
        both = both.unionByName(
            rows.select(*keys, order, CHUNK, value, F.lit(0).alias("_rank"), F.lit(False).alias("_is_left")),
            allowMissingColumns=True,
        )
        # One aggregate per column (not per struct) so that it stays a hash aggregate.
        edge = rows.groupBy(*keys, CHUNK).agg(*[pick(c, order).alias(name) for c, name in columns.items()])
        edges = edges.unionByName(
            edge.select(*keys, CHUNK, F.struct(*columns.values()).alias(f"_v{i}")), allowMissingColumns=True
        )
    values = [f"_v{i}" for i in range(len(rights))]
    # Both directions look back, forward over descending rows: such a frame grows by one row at a
    # time, while one that ends at the last row is computed anew for every row.
    way = F.desc if forward else F.asc
    outside = W.partitionBy(*keys).orderBy(way(CHUNK)).rangeBetween(W.unboundedPreceding, -1)
    inside = window(keys, way(order), way("_rank")).rowsBetween(W.unboundedPreceding, W.currentRow)
    far = edges.select(*keys, CHUNK, *[F.last(v, ignorenulls=True).over(outside).alias(f"_far{v}") for v in values])
    far = far.groupBy(*keys, CHUNK).agg(*[F.first(f"_far{v}", ignorenulls=True).alias(f"_far{v}") for v in values])
    near = both.select("*", *[F.last(v, ignorenulls=True).over(inside).alias(f"_near{v}") for v in values])
    found = near.filter("_is_left").join(far, [*keys, CHUNK], "left")
    picked = [
        F.coalesce(f"_near_v{i}", f"_far_v{i}")[name].alias(name)
        for i, (_, columns) in enumerate(rights) for name in columns.values()
    ]
    return found.select(*left.columns, *picked)


def previous_row(left: DataFrame, right: DataFrame, keys: Sequence[str], order: str, grid: Grid,
                 columns: dict[str, str]) -> DataFrame:
    """Backward as-of: the latest right row with order <= the left row's."""
    return asof_join(left, [(right, columns)], keys, order, grid)


def next_row(left: DataFrame, right: DataFrame, keys: Sequence[str], order: str, grid: Grid,
             columns: dict[str, str], *, tie: Column | None = None) -> DataFrame:
    """Forward as-of: the first right row after the left row (at it, where ``tie`` holds)."""
    return asof_join(left, [(right, columns)], keys, order, grid, forward=True,
                     tie=F.lit(False) if tie is None else tie)


def with_timeframe(base: DataFrame, higher: DataFrame, keys: Sequence[str], grid: Grid, columns: dict[str, str],
                   *, closed_only: bool = False, length: int = 0) -> DataFrame:
    """Latest bar of another timeframe as of each base row.

    By default a bar is visible from its own timestamp on, finished or not. With
    ``closed_only`` it becomes visible ``length`` microseconds later, when it has ended.
    """
    if closed_only:
        visible = F.timestamp_micros(F.unix_micros("timestamp") + F.lit(length))
        higher = higher.withColumn("timestamp", visible)
    return previous_row(base, higher, keys, "timestamp", grid, columns)
