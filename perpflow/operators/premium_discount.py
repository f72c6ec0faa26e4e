"""Active trading range from swings, and where the price sits in it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, WindowSpec, functions as F

from perpflow.functions.numeric import sufficiency
from perpflow.operators.chunks import CHUNK, OWN, Grid, add_running, chunk_totals, lead_in, newest, own, window
from perpflow.operators.dedupe import UNIQUE, last_wins
from perpflow.operators.wide_frames import IDX, NARROW, Roll, add_rolls, chunked_by_number, numbered, reach

# Zones a price can be in.
ZONES = ["DISCOUNT", "EQUILIBRIUM", "PREMIUM", "ABOVE_RANGE", "BELOW_RANGE"]


@dataclass(frozen=True)
class RangeConfig:
    method: str = "FRACTAL"
    lookback: int = 50
    strength: int = 2
    midpoint_ratio: float = 0.5
    equilibrium_band_pct: float | None = None

    def __post_init__(self) -> None:
        if self.method not in ("FRACTAL", "EXTREMUM"):
            raise ValueError(f"unknown swing method {self.method}")
        if self.lookback < 1 or self.strength < 1:
            raise ValueError("lookback and strength must be at least 1")
        if self.method == "FRACTAL" and self.lookback < self.neighbourhood:
            raise ValueError("lookback must hold a swing and its neighbours")
        if not 0.0 <= self.midpoint_ratio <= 1.0:
            raise ValueError("midpoint_ratio must lie in [0, 1]")
        if self.equilibrium_band_pct is not None and not 0.0 < self.equilibrium_band_pct <= 1.0:
            raise ValueError("equilibrium_band_pct must lie in (0, 1]")

    @property
    def neighbourhood(self) -> int:
        return 2 * self.strength + 1


def usable_candle():
    return F.col("high").isNotNull() & F.col("low").isNotNull() & F.col("close").isNotNull() & (F.col("high") >= F.col("low"))


def _clean(df: DataFrame, keys: Sequence[str], seq: str | None) -> DataFrame:
    rows = df.select(*keys, "timestamp", "high", "low", "close", *([] if seq in (None, UNIQUE) else [seq]))
    return last_wins(rows, [*keys, "timestamp"], seq, usable_candle()).select(*keys, "timestamp", "high", "low", "close")


def mark_swings(df: DataFrame, over: WindowSpec, strength: int) -> DataFrame:
    """``swing_high`` / ``swing_low``: the price where a bar beats all neighbours on both sides."""
    left, right = over.rowsBetween(-strength, -1), over.rowsBetween(1, strength)
    surrounded = (F.count("high").over(left) == strength) & (F.count("high").over(right) == strength)
    high, low = F.col("high"), F.col("low")
    is_high = surrounded & (high > F.max("high").over(left)) & (high > F.max("high").over(right))
    is_low = surrounded & (low < F.min("low").over(left)) & (low < F.min("low").over(right))
    return df.withColumns({"swing_high": F.when(is_high, high), "swing_low": F.when(is_low, low)})


def _locate(df: DataFrame, over: WindowSpec, config: RangeConfig) -> DataFrame:
    """Active range of the last ``lookback`` bars as of every bar, and the position in it."""
    if "active_high" in df.columns:
        top, bottom = F.col("active_high"), F.col("active_low")
    elif config.method == "FRACTAL":
        df = mark_swings(df, over, config.strength)
        frame = over.rowsBetween(-(config.lookback - 1 - config.strength), -config.strength)
        top, bottom = F.max("swing_high").over(frame), F.min("swing_low").over(frame)
    else:
        frame = over.rowsBetween(-(config.lookback - 1), 0)
        top, bottom = F.max("high").over(frame), F.min("low").over(frame)
    df = df.withColumns({"active_high": top, "active_low": bottom})
    price, high, low = F.col("close"), F.col("active_high"), F.col("active_low")
    size, mid = F.col("range_size"), F.col("midpoint")
    band = config.equilibrium_band_pct
    balanced = price == mid if band is None else F.abs(price - mid) <= size * band / 2
    zone = (
        F.when(price > high, "ABOVE_RANGE")
        .when(price < low, "BELOW_RANGE")
        .when(balanced, "EQUILIBRIUM")
        .when(price > mid, "PREMIUM")
        .otherwise("DISCOUNT")
    )
    upper, lower = high - mid, mid - low
    premium = F.when(price >= mid, F.when(upper > 0, (price - mid) / upper * 100)).otherwise(0.0)
    discount = F.when(price >= mid, 0.0).otherwise(F.when(lower > 0, (mid - price) / lower * 100))
    return (
        df.filter(high > low)
        .withColumn("range_size", high - low)
        .withColumn("midpoint", low + size * config.midpoint_ratio)
        .withColumns({
            "current_price": price,
            "current_price_position_pct": (price - low) / size * 100,
            "zone": zone,
            "premium_percentage": premium,
            "discount_percentage": discount,
        })
        .drop("swing_high", "swing_low")
    )


def _with_wide_range(rows: DataFrame, keys: Sequence[str], grid: Grid, config: RangeConfig) -> DataFrame:
    """The active range of wide look-backs, by blocks instead of a sliding frame; adds the bar's number as ``_idx``."""
    if config.method == "FRACTAL":
        width, shift, high, low = config.lookback - 2 * config.strength, config.strength, "swing_high", "swing_low"
    else:
        width, shift, high, low = config.lookback, 0, "high", "low"
    rolls = {"active_high": Roll("max", F.col(high), width, shift=shift), "active_low": Roll("min", F.col(low), width, shift=shift)}
    before = reach(rolls) + 2 * config.strength
    placed = chunked_by_number(numbered(rows, keys, "timestamp"), keys, before, max(before, grid.rows))
    if config.method == "FRACTAL":
        placed = mark_swings(placed, window(keys, IDX), config.strength)
    return add_rolls(placed, keys, rolls).filter(F.col(OWN)).drop(CHUNK, OWN)


_OUT = ["active_high", "active_low", "range_size", "midpoint", "current_price", "current_price_position_pct",
        "zone", "premium_percentage", "discount_percentage", "sample_size", "confidence_level"]


def _named(df: DataFrame, keys: Sequence[str], config: RangeConfig, label: str) -> DataFrame:
    required = max(config.lookback, config.neighbourhood, 1)
    df = df.withColumn("confidence_level", sufficiency(F.col("sample_size"), required))
    others = [k for k in keys if k not in ("symbol", "timeframe")]
    timeframe = F.col("timeframe") if "timeframe" in keys else F.lit(label).alias("timeframe")
    return df.select(F.upper("symbol").alias("symbol"), *others, timeframe, F.col("timestamp").alias("as_of"), *_OUT)


def range_latest(df: DataFrame, keys: Sequence[str] = ("symbol",), config: RangeConfig = RangeConfig(),
                 label: str = "unspecified", seq: str | None = None) -> DataFrame:
    """Newest bar of every series; no row where no range can be established."""
    rows = _clean(df, keys, seq)
    tail = newest(rows, keys, "timestamp", config.lookback)
    if config.lookback > NARROW:
        tail = _with_wide_range(tail, keys, Grid(rows=4096), config).drop(IDX)
    located = _locate(tail, W.partitionBy(*keys).orderBy("timestamp"), config).filter("_age = 1")
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("sample_size"))
    return _named(located.join(counts, [*keys]), keys, config, label)


def range_series(df: DataFrame, grid: Grid, keys: Sequence[str] = ("symbol",), config: RangeConfig = RangeConfig(),
                 label: str = "unspecified", seq: str | None = None) -> DataFrame:
    """The same as of every bar."""
    rows = _clean(df, keys, seq)
    if config.lookback > NARROW:
        wide = _with_wide_range(rows, keys, grid, config)
        located = _locate(wide, window(keys, "timestamp"), config)
        return _named(located.withColumn("sample_size", F.col(IDX) + 1), keys, config, label)
    led = lead_in(rows, keys, "timestamp", grid, config.lookback - 1)
    counts = {"sample_size": ("count", F.col("close"))}
    bases = chunk_totals(rows.withColumn(CHUNK, grid.chunk(rows, "timestamp")), keys, counts)
    # The range needs borrowed bars, the count must not see them.
    over = window(keys, "timestamp")
    counted = led.withColumn("_n", F.count_if(F.col(OWN)).over(over.rowsBetween(W.unboundedPreceding, 0)))
    located = _locate(counted, over, config).filter(F.col(OWN)).join(bases, [*keys, CHUNK], "left")
    total = F.col("_n") + F.coalesce(F.col("_base_sample_size"), F.lit(0))
    return _named(located.withColumn("sample_size", total), keys, config, label)


def swings(df: DataFrame, grid: Grid, keys: Sequence[str] = ("symbol",), strength: int = 2,
           seq: str | None = None) -> DataFrame:
    """All confirmed swing points of the whole history as (keys, timestamp, kind, price)."""
    rows = _clean(df, keys, seq)
    led = lead_in(rows, keys, "timestamp", grid, 2 * strength)
    # A swing is confirmed ``strength`` bars later; report it from the confirming bar's chunk.
    over = window(keys, "timestamp")
    marked = mark_swings(led, over, strength)
    confirmed = own(marked.select(
        *keys, CHUNK, OWN,
        F.lag("timestamp", strength).over(over).alias("timestamp"),
        F.lag("swing_high", strength).over(over).alias("swing_high"),
        F.lag("swing_low", strength).over(over).alias("swing_low"),
    ))
    points = F.inline(F.array(
        F.struct(F.lit("HIGH").alias("kind"), F.col("swing_high").alias("price")),
        F.struct(F.lit("LOW").alias("kind"), F.col("swing_low").alias("price")),
    ))
    return confirmed.select(*keys, "timestamp", points).filter("price IS NOT NULL")


def extremes_latest(df: DataFrame, keys: Sequence[str] = ("symbol",), lookback: int = 50,
                    seq: str | None = None) -> DataFrame:
    """Highest high and lowest low of the last bars, the earliest bar on ties."""
    tail = newest(_clean(df, keys, seq), keys, "timestamp", lookback)
    age = F.col("_age")
    best = tail.groupBy(*keys).agg(
        F.max_by(F.struct("timestamp", F.col("high").alias("price")), F.struct("high", age)).alias("HIGH"),
        F.min_by(F.struct("timestamp", F.col("low").alias("price")), F.struct("low", -age)).alias("LOW"),
    )
    points = F.inline(F.array(*[
        F.struct(F.lit(k).alias("kind"), F.col(k)["timestamp"].alias("timestamp"), F.col(k)["price"].alias("price"))
        for k in ("HIGH", "LOW")
    ]))
    return best.select(*keys, points)


def swings_latest(df: DataFrame, keys: Sequence[str] = ("symbol",), config: RangeConfig = RangeConfig(),
                  seq: str | None = None) -> DataFrame:
    """Swing points inside the last ``lookback`` bars as (keys, kind, timestamp, price)."""
    if config.method == "EXTREMUM":
        return extremes_latest(df, keys, config.lookback, seq)
    tail = newest(_clean(df, keys, seq), keys, "timestamp", config.lookback)
    marked = mark_swings(tail, W.partitionBy(*keys).orderBy("timestamp"), config.strength)
    points = F.inline(F.array(
        F.struct(F.lit("HIGH").alias("kind"), F.col("timestamp").alias("timestamp"), F.col("swing_high").alias("price")),
        F.struct(F.lit("LOW").alias("kind"), F.col("timestamp").alias("timestamp"), F.col("swing_low").alias("price")),
    ))
    return marked.select(*keys, points).filter("price IS NOT NULL")
