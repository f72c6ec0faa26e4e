"""Exact percentiles of groups of any size, by counting between splitters.

Sorting or collecting a group takes one task; a group may be most of the table. Here the range of a group is cut
into ``CELLS`` equal stretches and each stretch is counted, with its smallest and largest value, in one aggregate that
folds before it is shuffled. The stretches that hold a wanted rank are cut again, between the extremes that were found in
them, until they hold one value or ``FEW`` rows at most; only those rows are put in order. A round divides
the range by ``CELLS``, so two or three are usual.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from perpflow.functions.numeric import finite
from perpflow.session import cut_lineage, drop_written

CELLS, FEW = 1024, 4096
_RANGE = ["_lo", "_hi"]


def _cell(x: Column, lo: Column, hi: Column) -> Column:
    """Stretch of x in lo..hi: never falls as x grows. Halves first, as the width may be out of range."""
    share = F.try_divide(x / 2 - lo / 2, hi / 2 - lo / 2)
    return F.least(F.floor(share * CELLS), F.lit(CELLS - 1))


def _inside(long: DataFrame, keys: Sequence[str], wanted: DataFrame) -> DataFrame:
    """The values that lie in a wanted range of their group, with it. Ranges of a group don't overlap."""
    ranges = wanted.select(*keys, *_RANGE).distinct().groupBy(*keys).agg(F.collect_list(F.struct(*_RANGE)).alias("_ranges"))
    met = long.join(ranges, [*keys]).withColumn("_r", F.filter("_ranges", lambda r: F.col("_x").between(r["_lo"], r["_hi"])))
    hit = F.get("_r", F.lit(0))
    return met.select(*keys, "_x", hit["_lo"].alias("_lo"), hit["_hi"].alias("_hi")).filter(F.col("_lo").isNotNull())


def _refined(long: DataFrame, keys: Sequence[str], wanted: DataFrame) -> DataFrame:
    """``wanted`` (keys, rank, _lo, _hi, _before, _n) with smaller ranges: one round of counting."""
    part = [*keys, *_RANGE]
    counted = _inside(long, keys, wanted).groupBy(*part, _cell(F.col("_x"), F.col("_lo"), F.col("_hi")).alias("_cell")).agg(
        F.count(F.lit(1)).alias("_in"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    earlier = W.partitionBy(*part).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    placed = counted.withColumn("_until", F.coalesce(F.sum("_in").over(earlier), F.lit(0)))
    hit = (F.col("rank") >= F.col("_before") + F.col("_until")) & (F.col("rank") < F.col("_before") + F.col("_until") + F.col("_in"))
    return wanted.drop("_n").join(placed, part).filter(hit).select(
        *keys, "rank", F.col("_low").alias("_lo"), F.col("_high").alias("_hi"), (F.col("_before") + F.col("_until")).alias("_before"), F.col("_in").alias("_n"))


def ranked_values(df: DataFrame, keys: Sequence[str], value: str, ranks: Column) -> DataFrame:
    """(keys, n, rank, value): the values at ``ranks``, an array of positions from 0 made of the group's count ``n``."""
    long = cut_lineage(df.select(*keys, finite(F.col(value).cast("double")).alias("_x")).filter(F.col("_x").isNotNull()))
    whole = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    wanted = cut_lineage(whole.withColumn("rank", F.explode(F.array_distinct(ranks))).select(
        *keys, "n", F.col("rank").cast("bigint").alias("rank"), *_RANGE, F.lit(0).cast("bigint").alias("_before"), F.col("n").alias("_n")))
    sizes = wanted.select(*keys, "n").distinct()
    open_, done = wanted.drop("n"), []
    wide = (F.col("_n") > FEW) & (F.col("_lo") < F.col("_hi"))
    while True:
        done.append(open_.filter(~wide))
        if open_.filter(wide).isEmpty():
            break
        open_ = cut_lineage(_refined(long, keys, open_.filter(wide)))
    settled = done[0]
    for table in done[1:]:
        settled = settled.unionByName(table)
    known = F.col("_lo") == F.col("_hi")
    small = settled.filter(~known)
    lists = _inside(long, keys, small).groupBy(*keys, *_RANGE).agg(F.array_sort(F.collect_list("_x")).alias("_xs"))
    picked = small.join(lists, [*keys, *_RANGE]).select(*keys, "rank", F.get("_xs", (F.col("rank") - F.col("_before")).cast("int")).alias("value"))
    found = cut_lineage(settled.filter(known).select(*keys, "rank", F.col("_lo").alias("value")).unionByName(picked).join(sizes, [*keys]))
    drop_written(long)
    return found.select(*keys, "n", "rank", "value")


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, percentiles: Sequence[float]) -> DataFrame:
    """(keys, percentile, value) with linear interpolation between neighbours, as ``percentile`` gives it.

    NULL, NaN and infinite values are left out; a group without others has no row.
    """
    if not percentiles or any(not 0 <= p <= 100 for p in percentiles):
        raise ValueError("percentiles must be a non-empty list of numbers in [0, 100]")
    asked = sorted(set(percentiles))
    at = lambda p: F.lit(p / 100) * (F.col("n") - 1)
    ranks = F.array(*[f(at(p)) for p in asked for f in (F.floor, F.ceil)])
    found = ranked_values(df, keys, value, ranks)
    by_rank = found.groupBy(*keys, "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_at"))
    entry = lambda p: F.struct(F.lit(p).alias("percentile"), at(p).alias("_position"))
    rows = by_rank.select(*keys, "_at", F.inline(F.array(*[entry(p) for p in asked])))
    low, high = (F.element_at("_at", f(F.col("_position")).cast("bigint")) for f in (F.floor, F.ceil))
    share = F.col("_position") - F.floor("_position")
    return rows.select(*keys, "percentile", F.when(share == 0, low).otherwise(low * (1 - share) + high * share).alias("value"))
