"""Funding-rate and open-interest analysis: one numeric level per timestamp.

Both describe the newest reading against its own history. ``snapshot`` gives the row of the
newest reading of every series; ``series`` gives the same numbers as of every reading.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window as W, WindowSpec, functions as F

from perpflow.functions.numeric import direction, exceeds, half_split_delta, sufficiency
from perpflow.operators.chunks import CHUNK, OWN, Grid, add_running, chunk_totals, lead_in, newest, window
from perpflow.operators.dedupe import UNIQUE, last_wins
from perpflow.operators.wide_frames import IDX, NARROW, Roll, add_rolls, chunked_by_number, numbered, reach

NOISE = 1e-15


@dataclass(frozen=True)
class LevelConfig:
    """Windows in rows. None switches the rule that needs the value off."""

    trend_window: int = 8
    momentum_window: int = 8
    volatility_window: int = 30
    spike_window: int | None = None
    historical_window: int | None = None
    spike_zscore_threshold: float | None = None

    def __post_init__(self) -> None:
        sizes = [self.trend_window, self.momentum_window, self.volatility_window]
        if self.spike_window is not None:
            sizes.append(self.spike_window)
        if min(sizes) < 2:
            raise ValueError("analysis windows must hold at least 2 rows")
        if self.historical_window is not None and self.historical_window < 1:
            raise ValueError("historical_window must be at least 1")
        if self.spike_zscore_threshold is not None and self.spike_zscore_threshold <= 0:
            raise ValueError("spike_zscore_threshold must be positive")

    @property
    def widest(self) -> int:
        """Rows of history the widest rule asks for."""
        return max(self.trend_window, self.momentum_window, self.volatility_window,
                   self.spike_window or 0, self.historical_window or 0, 1)


FUNDING = LevelConfig()
OPEN_INTEREST = LevelConfig(spike_window=30)


def _slope(x: Column, over: WindowSpec, n: int) -> Column:
    """Least-squares slope of the last n (at least 2) rows against 0, 1, 2, ..."""
    frame = over.rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) >= 2, F.regr_slope(x, F.col("_at").cast("double")).over(frame))


def _spread(x: Column, over: WindowSpec, n: int) -> Column:
    frame = over.rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) >= 2, F.stddev_samp(x).over(frame))


def zscore_against(x: Column, over: WindowSpec, first: int, last: int = -1) -> Column:
    """z of the current value against rows first..last before it; NULL below 2 rows or at zero spread."""
    frame = over.rowsBetween(first, last)
    z = F.try_divide(x - F.avg(x).over(frame), F.stddev_samp(x).over(frame))
    return F.when(F.count(x).over(frame) >= 2, z)


def _wide_rolls(config: LevelConfig, relative: bool) -> dict[str, Roll]:
    """The statistics whose frames are too wide to slide (momentum keeps its window, which it splits in halves)."""
    x, change = F.col("x"), F.col("change")
    asked = {"trend_value": Roll("slope", x, config.trend_window), "volatility": Roll("std", x, config.volatility_window)}
    if relative:
        asked |= {"_trend_scale": Roll("max", F.abs(x), config.trend_window), "_momentum_scale": Roll("max", F.abs(x), config.momentum_window)}
    if config.spike_window is not None and config.spike_window > NARROW + 2:
        asked |= {f"_spike_{k}": Roll(k, change, config.spike_window - 2, shift=1) for k in ("count", "mean", "std")}
    if config.historical_window is not None:
        asked |= {
            "historical_average": Roll("mean", x, config.historical_window),
            "historical_maximum": Roll("max", x, config.historical_window),
            "historical_minimum": Roll("min", x, config.historical_window),
        }
    return {name: r for name, r in asked.items() if r.width > NARROW}


def _describe_wide(rows: DataFrame, keys: Sequence[str], grid: Grid, config: LevelConfig, relative: bool) -> DataFrame:
    """``_describe`` of whole series in time that does not depend on the windows; adds the row number as ``_idx``."""
    rolls = _wide_rolls(config, relative)
    # Two rows more, so that the change of the first row that counts is known.
    before = max(reach(rolls), NARROW) + 2
    placed = chunked_by_number(numbered(rows, keys, "timestamp"), keys, before, max(before, grid.rows))
    over = window(keys, IDX)
    placed = placed.withColumn("change", F.col("x") - F.lag("x").over(over))
    return _describe(add_rolls(placed, keys, rolls), over, config, relative, rolls).filter(F.col(OWN)).drop(CHUNK, OWN)


def _describe(df: DataFrame, over: WindowSpec, config: LevelConfig, relative: bool, known: Sequence[str] = ()) -> DataFrame:
    """Every bounded-window column but those ``known`` already. Expects ``x``; a row needs ``config.widest`` rows before it."""
    x = F.col("x")
    previous = F.lag(x).over(over)
    momentum_frame = over.rowsBetween(-(config.momentum_window - 1), 0)
    df = df.withColumn("_at", F.row_number().over(over)).withColumns({
        "previous": previous,
        "change": x - previous,
    })
    columns = {
        "change_pct": F.try_divide(F.col("change"), F.col("previous")),
        "trend_value": _slope(x, over, config.trend_window),
        "_halves": F.collect_list(x).over(momentum_frame),
        "volatility": _spread(x, over, config.volatility_window),
    }
    if relative:
        trend_frame = over.rowsBetween(-(config.trend_window - 1), 0)
        columns["_trend_scale"] = F.max(F.abs(x)).over(trend_frame)
        columns["_momentum_scale"] = F.max(F.abs(x)).over(momentum_frame)
    if "_spike_mean" in known:
        z = F.try_divide(F.col("change") - F.col("_spike_mean"), F.col("_spike_std"))
        columns["spike_magnitude"] = F.when(F.col("_spike_count") >= 2, z)
    elif config.spike_window is not None:
        columns["spike_magnitude"] = zscore_against(F.col("change"), over, -(config.spike_window - 2))
    if config.historical_window is not None:
        past = over.rowsBetween(-(config.historical_window - 1), 0)
        columns |= {
            "historical_average": F.avg(x).over(past),
            "historical_maximum": F.max(x).over(past),
            "historical_minimum": F.min(x).over(past),
        }
    columns = {name: c for name, c in columns.items() if name not in known}
    df = df.withColumns(columns).withColumn("momentum_value", half_split_delta(F.col("_halves")))

    def tolerance(scale: str) -> Column | float:
        if not relative:
            return NOISE
        return F.when(F.col(scale) > 0, F.col(scale)).otherwise(1.0) * NOISE

    df = df.withColumns({
        "trend": direction(F.col("trend_value"), tolerance("_trend_scale")),
        "momentum": direction(F.col("momentum_value"), tolerance("_momentum_scale")),
    })
    if config.spike_window is not None:
        df = df.withColumn("is_abnormal_spike", exceeds(F.col("spike_magnitude"), config.spike_zscore_threshold))
    return df.drop("_at", "_halves", "_trend_scale", "_momentum_scale", "_spike_count", "_spike_mean", "_spike_std")


def _clean(df: DataFrame, keys: Sequence[str], value: str, seq: str | None) -> DataFrame:
    columns = [*keys, "timestamp", F.col(value).alias("x"), *([] if seq in (None, UNIQUE) else [seq])]
    rows = last_wins(df.select(*columns), [*keys, "timestamp"], seq, F.col("x").isNotNull())
    return rows.select(*keys, "timestamp", "x")


_HISTORY = {
    "historical_average": ("sum", "x"), "historical_maximum": ("max", "x"),
    "historical_minimum": ("min", "x"), "sample_size": ("count", "x"),
}


def analyze_series(df: DataFrame, keys: Sequence[str], value: str, grid: Grid, config: LevelConfig,
                   *, seq: str | None = None, relative: bool = False) -> DataFrame:
    """The analysis as of every usable reading."""
    rows = _clean(df, keys, value, seq)
    if config.widest > NARROW and config.historical_window is not None:
        described = _describe_wide(rows, keys, grid, config, relative)
        out = described.withColumn("sample_size", F.col(IDX) + 1).drop(IDX)
        return out.withColumn("confidence_level", sufficiency(F.col("sample_size"), config.widest))
    led = lead_in(rows, keys, "timestamp", grid, config.widest)
    described = _describe(led, window(keys, "timestamp"), config, relative).filter(F.col(OWN)).drop(OWN)
    wanted = {n: (fn, F.col(c)) for n, (fn, c) in _HISTORY.items() if n == "sample_size" or config.historical_window is None}
    bases = chunk_totals(rows.withColumn(CHUNK, grid.chunk(rows, "timestamp")), keys, wanted)
    out = add_running(described, bases, keys, ["timestamp"], wanted).drop(CHUNK)
    if config.historical_window is None:
        out = out.withColumn("historical_average", F.col("historical_average") / F.col("sample_size"))
    return out.withColumn("confidence_level", sufficiency(F.col("sample_size"), config.widest))


def analyze_latest(df: DataFrame, keys: Sequence[str], value: str, config: LevelConfig,
                   *, seq: str | None = None, relative: bool = False) -> DataFrame:
    """The analysis as of the newest usable reading: only the last rows of a series are ordered."""
    rows = _clean(df, keys, value, seq)
    tail = newest(rows, keys, "timestamp", config.widest + 1)
    if config.widest > NARROW:
        # In pieces: the whole tail as one window would slide its widest frame over every row of it.
        last = _describe_wide(tail, keys, Grid(rows=4096), config, relative).filter("_age = 1").drop("_age", IDX)
    else:
        over = W.partitionBy(*keys).orderBy("timestamp")
        last = _describe(tail, over, config, relative).filter("_age = 1").drop("_age")
    totals = [F.count("x").alias("sample_size")]
    if config.historical_window is None:
        totals += [F.avg("x").alias("historical_average"), F.max("x").alias("historical_maximum"),
                   F.min("x").alias("historical_minimum")]
    whole = rows.groupBy(*keys).agg(*totals)
    return last.join(whole, [*keys]).withColumn("confidence_level", sufficiency(F.col("sample_size"), config.widest))


_COMMON = ["historical_average", "historical_maximum", "historical_minimum", "sample_size", "confidence_level"]


def _named(df: DataFrame, keys: Sequence[str], prefix: str, level: str, extra: Sequence[Column] = ()) -> DataFrame:
    renamed = [("x", f"current_{level}"), ("previous", f"previous_{level}"), ("change", f"{prefix}_change"),
               ("change_pct", f"{prefix}_change_pct"), ("trend", f"{prefix}_trend"),
               ("trend_value", f"{prefix}_trend_value"), ("momentum", f"{prefix}_momentum"),
               ("momentum_value", f"{prefix}_momentum_value"), ("volatility", f"{prefix}_volatility")]
    others = [k for k in keys if k != "symbol"]
    return df.select(F.upper("symbol").alias("symbol"), *others, F.col("timestamp").alias("as_of"),
                     *[F.col(a).alias(b) for a, b in renamed], *extra, *_COMMON)


def funding_latest(df: DataFrame, keys: Sequence[str] = ("symbol",), config: LevelConfig = FUNDING,
                   seq: str | None = None) -> DataFrame:
    return _named(analyze_latest(df, keys, "funding_rate", config, seq=seq), keys, "funding", "funding")


def funding_series(df: DataFrame, grid: Grid, keys: Sequence[str] = ("symbol",), config: LevelConfig = FUNDING,
                   seq: str | None = None) -> DataFrame:
    return _named(analyze_series(df, keys, "funding_rate", grid, config, seq=seq), keys, "funding", "funding")


def _oi_columns(source: str) -> list[Column]:
    return [F.lit(source).alias("source"), F.col("spike_magnitude"), F.col("is_abnormal_spike")]


def _with_spike(config: LevelConfig) -> LevelConfig:
    return config if config.spike_window is not None else replace(config, spike_window=30)


def open_interest_latest(df: DataFrame, keys: Sequence[str] = ("symbol",), config: LevelConfig = OPEN_INTEREST,
                         source: str = "aggregated", seq: str | None = None) -> DataFrame:
    out = analyze_latest(df, keys, "open_interest", _with_spike(config), seq=seq, relative=True)
    return _named(out, keys, "oi", "oi", _oi_columns(source))


def open_interest_series(df: DataFrame, grid: Grid, keys: Sequence[str] = ("symbol",),
                         config: LevelConfig = OPEN_INTEREST, source: str = "aggregated",
                         seq: str | None = None) -> DataFrame:
    out = analyze_series(df, keys, "open_interest", grid, _with_spike(config), seq=seq, relative=True)
    return _named(out, keys, "oi", "oi", _oi_columns(source))


def skipped(df: DataFrame, keys: Sequence[str], usable: Column) -> DataFrame:
    """Series that have rows but not one usable reading, so no analysis row."""
    return df.groupBy(*keys).agg(F.max(F.coalesce(usable, F.lit(False))).alias("_ok")).filter("NOT _ok").drop("_ok")
