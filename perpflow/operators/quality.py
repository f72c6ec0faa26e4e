"""Data-quality findings on raw series: (keys, severity, problem, timestamp, detail)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from perpflow.functions.numeric import micros
from perpflow.operators.chunks import CHUNK, Grid, chunk_totals, placed_rows, window
from perpflow.session import cut_lineage


def _rows(df: DataFrame, keys: Sequence[str], severity: str, problem: str, detail: Column | None = None) -> DataFrame:
    note = F.lit(None).cast("double") if detail is None else detail.cast("double")
    return df.select(*keys, F.lit(severity).alias("severity"), F.lit(problem).alias("problem"),
                     "timestamp", note.alias("detail"))


def unknown_exchanges(selection: Sequence[str] | None, observed: Sequence[DataFrame]) -> DataFrame:
    """Selected exchanges that no supplied series contains."""
    first = observed[0]
    names = first.select("exchange").distinct()
    for df in observed[1:]:
        names = names.unionByName(df.select("exchange").distinct())
    wanted = first.sparkSession.createDataFrame([(e,) for e in selection or []], "exchange string")
    return wanted.join(names.distinct(), "exchange", "left_anti").select(
        "exchange", F.lit("WARNING").alias("severity"), F.lit("exchange not observed").alias("problem")
    )


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _stamps(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """One row for each timestamp of a series: copies, and count, mean and squared deviations of the values.

    All that findings between rows ask for merges from these; the raw rows are folded before they are shuffled.
    """
    v = F.col("_v")
    return cut_lineage(df.select(*keys, "timestamp", value.cast("double").alias("_v")).groupBy(*keys, "timestamp").agg(
        F.count(F.lit(1)).alias("_copies"), F.count(v).alias("_n"), F.avg(v).alias("_mean"), (F.var_pop(v) * F.count(v)).alias("_m2")))


def _spread(stamps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, _center, _sd) of series with at least two values that differ, merged from their timestamps."""
    some = stamps.filter("_n > 0")
    weight = F.col("_n").cast("double")
    center = some.groupBy(*keys).agg((F.sum(F.col("_mean") * weight) / F.sum(weight)).alias("_center"), F.sum("_n").alias("_all")).filter("_all >= 2")
    apart = F.col("_mean") - F.col("_center")
    return some.join(center, [*keys]).groupBy(*keys, "_center").agg(
        F.sqrt(F.sum(F.col("_m2") + weight * apart * apart) / F.sum(weight)).alias("_sd")).filter("_sd <> 0")


def _late(stamps: DataFrame, keys: Sequence[str], grid: Grid, interval: int) -> DataFrame:
    """Timestamps further than ``interval`` from the one before; a chunk's first is compared with the last of the chunks before."""
    placed = placed_rows(stamps.select(*keys, "timestamp"), keys, "timestamp", grid)
    ends = chunk_totals(placed, keys, {"end": ("max", F.col("timestamp"))})
    before = F.coalesce(F.lag("timestamp").over(window(keys, "timestamp")), F.col("_base_end"))
    elapsed = F.unix_micros("timestamp") - F.unix_micros(before)
    return placed.join(ends, [*keys, CHUNK]).withColumn("gap_micros", elapsed).filter(F.col("gap_micros") > interval)


def _report(df: DataFrame, keys: Sequence[str], value: Column, label: str, required: Sequence[str], grid: Grid, outlier_zscore: float | None,
            expected_interval, *, candles: bool = False, missing: str | None = None, pooled: Sequence[str] | None = None) -> DataFrame:
    """All findings of one raw series in two passes over it: one for what rows show together, one for what each shows.

    ``pooled`` are the keys over which values are judged, if not ``keys``; the keys left out are NULL in those findings.
    """
    stamps = _stamps(df, keys, value)
    note = lambda c: c.cast("double").alias("detail")
    absent = F.lit(False)
    for c in required:
        absent = absent | F.col(c).isNull()
    naive = dict(df.dtypes)["timestamp"] == "timestamp_ntz"
    mark = lambda when, severity, problem, detail=F.lit(None), pool=False: F.when(when, F.struct(
        F.lit(severity).alias("severity"), F.lit(problem).alias("problem"), note(detail), F.lit(pool).alias("_pool")))
    marks = [mark(absent, "WARNING", f"missing {missing or label}"), mark(F.lit(naive), "ERROR", "naive timestamp")]
    if candles:
        marks.append(mark(F.col("high") < F.col("low"), "ERROR", "high below low"))
    rows, shared = df, list(keys if pooled is None else pooled)
    if outlier_zscore is not None:
        rows = df.join(_spread(stamps, shared), shared, "left")
        z = F.abs(F.try_divide(value - F.col("_center"), F.col("_sd")))
        marks.append(mark(z > outlier_zscore, "WARNING", f"outlier {label}", z, True))
    found = rows.select(*keys, "timestamp", F.inline(F.array_compact(F.array(*marks))))
    owned = [F.col(k) if k in shared else F.when(~F.col("_pool"), F.col(k)).alias(k) for k in keys]
    columns = [*keys, "severity", "problem", "timestamp", "detail"]
    parts = [found.select(*owned, "severity", "problem", "timestamp", "detail"),
             _rows(stamps.filter("_copies > 1"), keys, "ERROR", "duplicate timestamp", F.col("_copies"))]
    if expected_interval is not None:
        parts.append(_rows(_late(stamps, keys, grid, micros(expected_interval)), keys, "WARNING", "gap", F.col("gap_micros")))
    return _union([p.select(*columns) for p in parts])


def series_report(df: DataFrame, keys: Sequence[str], value: str, grid: Grid, *,
                  outlier_zscore: float | None = None, expected_interval=None) -> DataFrame:
    """Report for a one-value series (funding rate, open interest)."""
    return _report(df, keys, F.col(value), value, [value], grid, outlier_zscore, expected_interval)


def candle_report(df: DataFrame, keys: Sequence[str], grid: Grid, *,
                  outlier_zscore: float | None = None, expected_interval=None) -> DataFrame:
    return _report(df, keys, F.col("close"), "close", ["high", "low", "close"], grid, outlier_zscore, expected_interval, candles=True, missing="candle")


# For each liquidity input, its required columns and the value tested for outliers.
LIQUIDITY_SOURCES = {
    "liquidations": (["long_liquidation_usd", "short_liquidation_usd"],
                     lambda: F.col("long_liquidation_usd") + F.col("short_liquidation_usd")),
    "global_ratio": (["long_account_ratio", "short_account_ratio"], lambda: F.col("long_account_ratio")),
    "top_trader_account_ratio": (["long_account_ratio", "short_account_ratio"], lambda: F.col("long_account_ratio")),
    "top_trader_position_ratio": (["long_account_ratio", "short_account_ratio"], lambda: F.col("long_account_ratio")),
    "open_interest": (["open_interest"], lambda: F.col("open_interest")),
    "price": (["close"], lambda: F.col("close")),
}


def liquidity_report(sources: dict[str, DataFrame], grid: Grid, *, outlier_zscore: float | None = None,
                     expected_interval=None) -> DataFrame:
    """Report over every supplied liquidity input, gaps and duplicates per exchange.

    The outlier test pools the exchanges of a symbol. Adds the ``source`` column.
    """
    parts = []
    for name, df in sources.items():
        columns, value = LIQUIDITY_SOURCES[name]
        found = _report(df, ["symbol", "exchange"], value(), name, columns, grid, outlier_zscore, expected_interval, pooled=["symbol"])
        parts.append(found.withColumn("source", F.lit(name)))
    return _union(parts)
