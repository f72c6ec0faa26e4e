"""Positions of rows inside groups that may be far larger than a task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from perpflow.session import cut_lineage


def ranked(rows: DataFrame, group: list[str], order: list[str], name: str = "idx") -> DataFrame:
    """``rows`` with a position from 0 inside each group (nulls are a group, nulls sort first).

    The rows are sorted by range over all tasks and written, so a group of any size spreads over as many
    tasks as its share of the rows. A task numbers its own run of each group; one row of each group and
    task then says how many rows stood in the tasks before. Rows that agree in group and order
    are in one task.
    """
    sorted_rows = cut_lineage(rows.repartitionByRange(*group, *order).withColumn("_run", F.spark_partition_id()))
    counts = sorted_rows.groupBy(*group, "_run").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *(F.col(c).alias(f"_g_{c}") for c in group), F.col("_run").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy(*group, "_run").orderBy(*order)
    placed = sorted_rows.withColumn("_own", F.row_number().over(own).cast("long") - 1)
    same = F.col("_run") == F.col("_r")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    kept = [F.col(c) for c in rows.columns]
    return placed.join(offsets, same).select(*kept, (F.col("_own") + F.col("_before")).alias(name))
