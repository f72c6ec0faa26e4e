"""Rolling features: wide columns per series, then the long feature table.

Every module adds its columns over one chunked window, so all of a module's frames share one
exchange and one sort. Frames are full-window gated: a value exists only where the whole
window has values.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from perpflow.functions.numeric import INF, finite, long_short_ratio
from perpflow.operators.chunks import CHUNK, OWN, Grid, frame_gate, lead_in, own, window
from perpflow.operators.wide_frames import IDX, NARROW, Roll, add_rolls, chunked_by_number, numbered
from perpflow.schema import FEATURE_VERSION
from perpflow.session import cut_lineage


# --- frame formulas ---------------------------------------------------------------------------

@dataclass(frozen=True)
class Wide:
    """A column out of statistics of frames too wide to slide; ``finish`` gets their columns."""

    rolls: Mapping[str, Roll]
    finish: Callable[[Mapping[str, Column]], Column]


def _rolling(kind: str, x: Column, over, n: int, narrow: Callable[[Column], Column]) -> Column | Wide:
    if n > NARROW:
        return Wide({kind: Roll(kind, x, n, full=True)}, lambda c: c[kind])
    return frame_gate(x, over, n, narrow(x).over(over.rowsBetween(-(n - 1), 0)))


def rolling_mean(x: Column, over, n: int) -> Column | Wide:
    return _rolling("mean", x, over, n, F.avg)


def rolling_sum(x: Column, over, n: int) -> Column | Wide:
    return _rolling("sum", x, over, n, F.sum)


def rolling_std(x: Column, over, n: int) -> Column | Wide:
    return _rolling("std", x, over, n, F.stddev_samp)


def rolling_zscore(x: Column, over, n: int) -> Column | Wide:
    """(x - mean) / std of the window that ends at, and includes, the current row."""
    if n > NARROW:
        return Wide({k: Roll(k, x, n, full=True) for k in ("mean", "std")}, lambda c: F.try_divide(x - c["mean"], c["std"]))
    frame = over.rowsBetween(-(n - 1), 0)
    return frame_gate(x, over, n, F.try_divide(x - F.avg(x).over(frame), F.stddev_samp(x).over(frame)))


def change(x: Column, over) -> Column:
    return x - F.lag(x).over(over)


def pct_change(x: Column, over, n: int = 1) -> Column:
    return F.try_divide(x, F.lag(x, n).over(over)) - 1


def true_range(over) -> Column:
    """Largest of high-low and the distances to the previous close; high-low on the first bar."""
    before = F.lag("close").over(over)
    high, low = F.col("high"), F.col("low")
    return F.greatest(high - low, F.abs(high - before), F.abs(low - before))


@dataclass(frozen=True)
class _Ema:
    """Exponential average with y0 = x0 and weight 2/(span+1), exact over any number of chunks.

    Inside a block the recurrence is a running sum of x * r^-j (r = 1 - weight, j = row in
    block); blocks are short enough for r^-j to stay finite. Chunks may hold few rows, so blocks
    are strung together by row number: a stretch is as many rows as the longest block, a block
    belongs to the stretch it begins in. Within a stretch the carried value is a running sum again;
    across stretches it is a sum over the few earlier ones whose weight has not underflowed to zero.
    """

    value: str
    span: int
    grid: Grid

    @property
    def weight(self) -> float:
        return 2.0 / (self.span + 1)

    @property
    def decay(self) -> float:
        return 1.0 - self.weight

    @property
    def block_rows(self) -> int:
        return max(int(120 / -math.log10(self.decay)), 1)

    def local(self, rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
        """Add the block of each own row and its average as if the block started from zero."""
        mine = F.col(OWN)
        so_far = window(keys, order).rowsBetween(W.unboundedPreceding, 0)
        rows = rows.withColumn("_i", F.count_if(mine).over(so_far) - 1)
        rows = rows.withColumn("_block", F.floor(F.col("_i") / self.block_rows)).withColumn(
            "_j", F.pmod("_i", F.lit(self.block_rows)))
        in_block = W.partitionBy(*keys, CHUNK, "_block").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
        scaled = F.when(mine, self.weight * F.col(self.value) * F.pow(F.lit(self.decay), -F.col("_j")))
        return rows.withColumn("_local", F.pow(F.lit(self.decay), F.col("_j")) * F.sum(scaled).over(in_block)).drop("_i")

    def starts(self, df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
        """For each block, the average just before its first row."""
        chunked = df.select(*keys, order, self.value).withColumn(CHUNK, self.grid.chunk(df, order))
        blocks = self.local(chunked.withColumn(OWN, F.lit(True)), keys, order).groupBy(*keys, CHUNK, "_block").agg(
            F.count(F.lit(1)).alias("_n"), F.max_by("_local", "_j").alias("_end"), F.min_by(self.value, "_j").alias("_x0")
        )
        along = W.partitionBy(*keys).orderBy(CHUNK, "_block")
        decay, size = F.lit(self.decay), self.block_rows
        placed = (
            blocks.withColumn("_before", F.coalesce(F.sum("_n").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
            .withColumn("_first", F.first("_x0").over(along.rowsBetween(W.unboundedPreceding, 0)))
            .withColumn("_stretch", F.floor(F.col("_before") / size)))
        # Ends of blocks as seen from the start of their stretch.
        seen = F.col("_end") * F.pow(decay, F.col("_stretch") * size - F.col("_before") - F.col("_n"))
        sums = placed.groupBy(*keys, "_stretch").agg(F.sum(seen).alias("_sum"))
        back = math.ceil(330 / -math.log10(self.decay) / size) + 2
        past = F.collect_list(F.struct("_stretch", "_sum")).over(W.partitionBy(*keys).orderBy("_stretch").rangeBetween(-back, -1))
        weighed = F.aggregate("_past", F.lit(0.0), lambda acc, p: acc + p["_sum"] * F.pow(decay, (F.col("_stretch") - p["_stretch"]) * size))
        bases = sums.withColumn("_past", past).select(*keys, "_stretch", weighed.alias("_base"))
        inside = W.partitionBy(*keys, "_stretch").orderBy(CHUNK, "_block").rowsBetween(W.unboundedPreceding, -1)
        carried = F.pow(decay, F.col("_before") - F.col("_stretch") * size) * (F.coalesce("_local_sum", F.lit(0.0)) + F.col("_base"))
        return (
            placed.withColumn("_local_sum", F.sum(seen).over(inside)).join(bases, [*keys, "_stretch"])
            .select(*keys, CHUNK, "_block", (carried + F.col("_first") * F.pow(decay, F.col("_before"))).alias("_start"))
        )

    def finish(self, rows: DataFrame, starts: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
        grown = F.col("_local") + F.pow(F.lit(self.decay), F.col("_j") + 1) * F.col("_start")
        return rows.join(starts, [*keys, CHUNK, "_block"]).withColumn(name, grown).drop("_block", "_j", "_local", "_start")


def ema(df: DataFrame, keys: Sequence[str], order: str, value: str, span: int, grid: Grid, name: str) -> DataFrame:
    """Add the exponential average of ``value`` (see ``_Ema``)."""
    if span <= 1:
        return df.withColumn(name, F.col(value))
    scan = _Ema(value, span, grid)
    rows = df.withColumn(CHUNK, grid.chunk(df, order)).withColumn(OWN, F.lit(True))
    return scan.finish(scan.local(rows, keys, order), scan.starts(df, keys, order), keys, name).drop(CHUNK, OWN)


# --- modules ----------------------------------------------------------------------------------

@dataclass(frozen=True)
class FeatureModule:
    """A named set of wide feature columns over one kind of series.

    ``wide(df, keys, grid)`` returns the input rows with ``columns`` added. Any callable of
    that shape is a valid module, so a user adds features without touching this file.
    """

    name: str
    columns: Sequence[str]
    wide: Callable[[DataFrame, Sequence[str], Grid], DataFrame]


Step = Callable[[object], dict[str, "Column | Wide"]]


def add_steps(df: DataFrame, keys: Sequence[str], grid: Grid, before: int, steps: Sequence[Step]) -> DataFrame:
    """The rows with the columns of ``steps``; a step may use those of the steps before it.

    ``before`` is what the sliding frames reach back. If a frame is wider than those, chunks are cut
    by row number and lead in what all steps reach back together.
    """
    over = window(keys, "timestamp")
    made = [step(over) for step in steps]
    wide = [{n: c for n, c in step.items() if isinstance(c, Wide)} for step in made]
    widths = [max((r.width for c in step.values() for r in c.rolls.values()), default=0) for step in wide]
    if not any(widths):
        led = lead_in(df, keys, "timestamp", grid, before)
        for step in made:
            led = led.withColumns(step)
        return own(led)
    before = sum(widths) + before
    led = chunked_by_number(numbered(df, keys, "timestamp"), keys, before, max(before, grid.rows))
    for step, wides in zip(made, wide, strict=True):
        led = led.withColumns({n: c for n, c in step.items() if n not in wides})
        rolls = {f"_{name}_{k}": r for name, c in wides.items() for k, r in c.rolls.items()}
        if rolls:
            led = add_rolls(led, keys, rolls)
            led = led.withColumns({name: c.finish({k: F.col(f"_{name}_{k}") for k in c.rolls}) for name, c in wides.items()}).drop(*rolls)
    return own(led).drop(IDX)


def _module(name: str, before: int, build: Step, stages: Sequence[Step] = ()) -> FeatureModule:
    steps = [build, *stages]
    columns = [c for step in steps for c in step(W.partitionBy(CHUNK).orderBy("timestamp"))]
    return FeatureModule(name, columns, lambda df, keys, grid: add_steps(df, keys, grid, before, steps))


def price_module(sma: int = 20, ema_span: int = 20, atr: int = 14, volatility: int = 14) -> FeatureModule:
    close, name = F.col("close"), f"ema_{ema_span}"

    def first(over) -> dict[str, Column]:
        return {
            "return_pct": pct_change(close, over),
            "log_return": F.ln(F.try_divide(close, F.lag(close).over(over))),
            "true_range": true_range(over),
            f"sma_{sma}": rolling_mean(close, over, sma),
            "high_low_range_pct": F.try_divide(F.col("high") - F.col("low"), close),
        }

    def second(over) -> dict[str, Column]:
        return {
            f"atr_{atr}": rolling_mean(F.col("true_range"), over, atr),
            f"volatility_{volatility}": rolling_std(F.col("return_pct"), over, volatility),
        }

    def wide(df: DataFrame, keys: Sequence[str], grid: Grid) -> DataFrame:
        if max(sma, atr, volatility) > NARROW:
            return ema(add_steps(df, keys, grid, NARROW, [first, second]), keys, "timestamp", "close", ema_span, grid, name)
        over = window(keys, "timestamp")
        led = lead_in(df, keys, "timestamp", grid, max(sma - 1, atr, volatility))
        led = led.withColumns(first(over)).withColumns(second(over))
        if ema_span <= 1:
            return own(led).withColumn(name, close)
        scan = _Ema("close", ema_span, grid)
        rows = scan.local(led, keys, "timestamp").filter(F.col(OWN))
        return scan.finish(rows, scan.starts(df, keys, "timestamp"), keys, name).drop(CHUNK, OWN)

    over = W.partitionBy(CHUNK).orderBy("timestamp")
    return FeatureModule("price", [*first(over), *second(over), name], wide)


def _level_module(name: str, x: Column, level: str, before: int, extra) -> FeatureModule:
    return _module(name, before, lambda over: {level: x, **extra(over)})


def funding_module(label: str = "standard", sma: int = 8, zscore: int = 30) -> FeatureModule:
    x = F.col("funding_rate")
    return _level_module(
        f"funding_{label}", x, "funding_rate", max(sma, zscore) - 1,
        lambda over: {
            "funding_rate_change": change(x, over),
            f"funding_rate_sma_{sma}": rolling_mean(x, over, sma),
            f"funding_rate_zscore_{zscore}": rolling_zscore(x, over, zscore),
        },
    )


def open_interest_module(sma: int = 20, roc: int = 14, zscore: int = 30) -> FeatureModule:
    x = F.col("open_interest")
    return _level_module(
        "open_interest", x, "open_interest", max(sma - 1, roc, zscore - 1),
        lambda over: {
            "oi_change_pct": pct_change(x, over),
            f"oi_sma_{sma}": rolling_mean(x, over, sma),
            f"oi_roc_{roc}": pct_change(x, over, roc),
            f"oi_zscore_{zscore}": rolling_zscore(x, over, zscore),
        },
    )


def liquidation_module(rolling: int = 24) -> FeatureModule:
    long, short = F.col("long_liquidation_usd"), F.col("short_liquidation_usd")
    return _module(
        "liquidation", rolling - 1,
        lambda over: {
            "long_liquidation_usd": long,
            "short_liquidation_usd": short,
            "total_liquidation_usd": long + short,
            "liquidation_imbalance": F.try_divide(long - short, long + short),
            f"long_liquidation_usd_sum_{rolling}": rolling_sum(long, over, rolling),
            f"short_liquidation_usd_sum_{rolling}": rolling_sum(short, over, rolling),
            f"total_liquidation_usd_sum_{rolling}": rolling_sum(long + short, over, rolling),
        },
    )


def long_short_module(label: str = "global", sma: int = 14, zscore: int = 30) -> FeatureModule:
    """An infinite ratio (no shorts) counts as missing, so windows that hold one are empty."""
    ratio = F.col("long_short_ratio")
    return _module(
        f"long_short_ratio_{label}", max(sma, zscore) - 1,
        lambda over: {
            "long_account_ratio": F.col("long_account_ratio"),
            "short_account_ratio": F.col("short_account_ratio"),
            "long_short_ratio": long_short_ratio(F.col("long_account_ratio"), F.col("short_account_ratio")),
        },
        [lambda over: {
            "long_short_ratio_change": change(ratio, over),
            f"long_short_ratio_sma_{sma}": rolling_mean(ratio, over, sma),
            f"long_short_ratio_zscore_{zscore}": rolling_zscore(ratio, over, zscore),
        }],
    )


# --- long table -------------------------------------------------------------------------------

def to_long(wide: DataFrame, module: str, columns: Sequence[str], version: str = FEATURE_VERSION) -> DataFrame:
    """Wide columns to (symbol, feature_name, timestamp, value, version).

    NULL, NaN and infinite cells are absent rows: a feature does not exist yet there.
    """
    cells = F.inline(F.array(*[
        F.struct(F.lit(f"{module}.{c}").alias("feature_name"), finite(F.col(c).cast("double")).alias("value"))
        for c in columns
    ]))
    return (
        wide.select(F.upper("symbol").alias("symbol"), "timestamp", cells)
        .filter(F.col("value").isNotNull())
        .select("symbol", "feature_name", "timestamp", "value", F.lit(version).alias("version"))
    )


def compute_features(modules: Sequence[FeatureModule], inputs: Mapping[str, DataFrame],
                     keys: Sequence[str], grid: Grid, version: str = FEATURE_VERSION) -> DataFrame | None:
    """All modules that have an input, every symbol at once, as one long table.

    A module without an input is skipped; None when no module has one.
    """
    result = None
    for module in modules:
        df = inputs.get(module.name)
        if df is None:
            continue
        part = [k for k in keys if k in df.columns]
        long = to_long(module.wide(df, part, grid), module.name, module.columns, version)
        result = long if result is None else result.unionByName(long)
    return result


@dataclass
class FeatureRun:
    """Features with the problems found in them; ``persist`` writes them to a store."""

    features: DataFrame | None
    issues: DataFrame | None = field(default=None)

    def is_valid(self) -> bool:
        return self.issues is None or self.issues.filter("severity = 'ERROR'").isEmpty()


def run_features(modules: Sequence[FeatureModule], inputs: Mapping[str, DataFrame], keys: Sequence[str],
                 grid: Grid, store=None, persist: bool = True) -> FeatureRun:
    """Compute the features of every symbol once; with a store, save them and go on with what it returns."""
    features = compute_features(modules, inputs, keys, grid)
    if features is None:
        return FeatureRun(None)
    if persist and store is not None:
        saved = cut_lineage(features)
        issues = check_features(saved)
        store.write(saved)
        return FeatureRun(store.read(), issues)
    return FeatureRun(features, check_features(features))


def check_features(features: DataFrame) -> DataFrame:
    """Problems in a long feature table as (severity, feature_name, symbol, timestamp, problem, count).

    A repeated (symbol, feature, timestamp, version) is reported twice, as a duplicate and as
    a series that does not strictly increase, once per extra copy for the latter.
    """
    key = ["symbol", "feature_name", "timestamp", "version"]
    naive = dict(features.dtypes)["timestamp"] == "timestamp_ntz"
    kinds = F.array_compact(F.array(
        F.when(F.isnan("value"), "nan"),
        F.when(F.abs(F.col("value")) == F.lit(INF), "infinite"),
        F.when(F.lit(naive), "naive_timestamp"),
    ))
    per_row = features.select(*key, F.explode(kinds).alias("problem"), F.lit(1).cast("bigint").alias("count"))
    copies = features.groupBy(*key).count().filter("count > 1")
    both = F.inline(F.array(
        F.struct(F.lit("duplicate").alias("problem"), F.col("count").alias("count")),
        F.struct(F.lit("not_increasing").alias("problem"), (F.col("count") - 1).alias("count")),
    ))
    return per_row.unionByName(copies.select(*key, both)).select(F.lit("ERROR").alias("severity"), *key, "problem", "count")


# --- look-back clips --------------------------------------------------------------------------

def lookback(bars: DataFrame, moments: DataFrame, keys: Sequence[str], step: int, periods: int) -> DataFrame:
    """For each moment, the bars with now - periods*step <= timestamp <= now (both ends count).

    Up to periods+1 bars match. Each bar is sent to the grid cells that can see it and the
    pair is decided by an equi-join on the cell, never by a range join.
    """
    width = max(step * max(periods, 1), 1)
    now, at = F.unix_micros("now"), F.unix_micros("timestamp")
    left = moments.withColumn("_cell", ((now - F.pmod(now, F.lit(width))) / width).cast("bigint"))
    home = ((at - F.pmod(at, F.lit(width))) / width).cast("bigint")
    right = bars.withColumn("_cell", F.explode(F.array(home, home + 1)))
    return (
        left.join(right, [*keys, "_cell"])
        .filter((at <= now) & (at >= now - F.lit(step * periods)))
        .drop("_cell")
    )
