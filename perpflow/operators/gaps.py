"""Missing grid points, as islands first and as single points on demand."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from perpflow.operators.chunks import Grid, lead_in, own, window
from perpflow.operators.interval_join import interval_join
from perpflow.schema import step_micros


def find_gaps(rows: DataFrame, ranges: DataFrame, keys: Sequence[str], grid: Grid) -> DataFrame:
    """Missing stretches of each range as (keys, gap_start, gap_end, missing).

    ``ranges`` holds one (keys, range_start, range_end) per expected series; a series without
    any row is one long gap. The grid starts at ``range_start``; rows off the grid fill
    nothing. The grid is never built: a gap is two neighbours more than one step apart.
    """
    step = step_micros(grid.step)
    bounds = ranges.select(
        *keys,
        F.unix_micros("range_start").alias("_from"),
        F.unix_micros("range_end").alias("_to"),
    ).filter(F.col("_from") <= F.col("_to"))
    covered = interval_join(
        rows.select(*keys, "timestamp"), ranges.select(*keys, "range_start", "range_end"), keys, "timestamp", "range_start", "range_end", grid.step)
    present = (
        covered.select(
            *keys, F.unix_micros("range_start").alias("_from"), F.unix_micros("range_end").alias("_to"), F.unix_micros("timestamp").alias("_at"))
        .filter(F.pmod(F.col("_at") - F.col("_from"), F.lit(step)) == 0)
        .select(*keys, "_from", "_to", "_at").distinct()
    )
    last_slot = F.col("_to") - F.pmod(F.col("_to") - F.col("_from"), F.lit(step))
    fence = bounds.withColumn("_at", F.explode(F.array(F.col("_from") - step, last_slot + step)))
    part = [*keys, "_from", "_to"]
    points = lead_in(present.unionByName(fence), part, "_at", Grid(step, grid.rows, grid.slots), 1)
    before = F.lag("_at").over(window(part, "_at"))
    return (
        own(points.withColumn("_before", before))
        .filter(F.col("_at") - F.col("_before") > step)
        .select(
            *keys,
            F.timestamp_micros(F.col("_before") + step).alias("gap_start"),
            F.timestamp_micros(F.col("_at") - step).alias("gap_end"),
            ((F.col("_at") - F.col("_before")) / step - 1).cast("bigint").alias("missing"),
        )
    )


def missing_points(gaps: DataFrame, keys: Sequence[str], grid: Grid) -> DataFrame:
    """Every missing grid timestamp. Long gaps are first split so no row holds a long array."""
    step, piece = step_micros(grid.step), step_micros(grid.step) * grid.rows
    start, end = F.unix_micros("gap_start"), F.unix_micros("gap_end")
    pieces = gaps.select(*keys, end.alias("_end"), F.explode(F.sequence(start, end, F.lit(piece))).alias("_a"))
    upto = F.least(F.col("_end"), F.col("_a") + piece - step)
    points = pieces.select(*keys, F.explode(F.sequence(F.col("_a"), upto, F.lit(step))).alias("_p"))
    return points.select(*keys, F.timestamp_micros("_p").alias("timestamp"))


def rows_for_gaps(stored: DataFrame, landed: DataFrame, ranges: DataFrame, keys: Sequence[str], grid: Grid) -> DataFrame:
    """Those landed rows that fall inside a gap of the stored series.

    A landed row belongs to a gap if the nearest stored grid point before it is not followed by the next
    one, which the as-of look-up of gap starts decides without a range join.
    """
    from perpflow.operators.asof import previous_row

    gaps = find_gaps(stored, ranges, keys, grid).withColumn("timestamp", F.col("gap_start"))
    located = previous_row(landed, gaps, keys, "timestamp", grid, {"gap_end": "_gap_end"})
    return located.filter(F.col("timestamp") <= F.col("_gap_end")).drop("_gap_end")


def fill_gaps(stored: DataFrame, landed: DataFrame, ranges: DataFrame, keys: Sequence[str], grid: Grid,
              seq: str | None = "ingest_seq") -> tuple[DataFrame, DataFrame]:
    """Add only those landed rows that fall inside a gap; report gaps still open.

    Returns (merged rows inside the ranges, remaining gaps).
    """
    from perpflow.operators.dedupe import merge_last_wins

    usable = rows_for_gaps(stored, landed, ranges, keys, grid)
    merged = merge_last_wins(stored, usable, [*keys, "timestamp"], seq or "ingest_seq")
    wanted = ranges.select(*keys, "range_start", "range_end")
    inside = interval_join(merged, wanted, keys, "timestamp", "range_start", "range_end", grid.step).select(*merged.columns)
    return inside, find_gaps(merged, ranges, keys, grid)
