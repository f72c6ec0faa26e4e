"""Liquidity analysis over several exchanges and up to six inputs.

Each input is folded to one row per (symbol, timestamp) first; after that only the newest
rows of a symbol (``latest``) or bounded frames (``series``) are ordered.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, WindowSpec, functions as F

from perpflow.functions.numeric import bias, exceeds, half_split_delta, long_short_ratio, sufficiency
from perpflow.operators.asof import asof_join
from perpflow.operators.chunks import Grid, lead_in, newest, own, window
from perpflow.operators.dedupe import UNIQUE, last_wins
from perpflow.operators.level_analysis import zscore_against

KEY = ["symbol"]


@dataclass(frozen=True)
class LiquidityConfig:
    analysis_window: int = 30
    spike_window: int = 30
    exchanges: tuple[str, ...] | None = None
    aggregation: str = "SUM"
    spike_zscore_threshold: float | None = None

    def __post_init__(self) -> None:
        if self.analysis_window < 2 or self.spike_window < 2:
            raise ValueError("windows must hold at least 2 rows")
        if self.aggregation not in ("SUM", "MEAN"):
            raise ValueError(f"unknown aggregation {self.aggregation}")
        if self.exchanges is not None and (not self.exchanges or any(not e.strip() for e in self.exchanges)):
            raise ValueError("exchanges must name at least one exchange and no blank ones")
        if self.spike_zscore_threshold is not None and self.spike_zscore_threshold <= 0:
            raise ValueError("spike_zscore_threshold must be positive")


@dataclass(frozen=True)
class LiquidityInputs:
    """Only ``liquidations`` is required; fields of an absent input stay NULL."""

    liquidations: DataFrame
    global_ratio: DataFrame | None = None
    top_trader_account_ratio: DataFrame | None = None
    top_trader_position_ratio: DataFrame | None = None
    open_interest: DataFrame | None = None
    price: DataFrame | None = None


def clean_readings(df: DataFrame, columns: list[str], config: LiquidityConfig, seq: str | None = None) -> DataFrame:
    """Selected exchanges, complete readings, last copy per (symbol, timestamp, exchange)."""
    usable = F.lit(True)
    for c in columns:
        usable = usable & F.col(c).isNotNull()
    if config.exchanges is not None:
        usable = usable & F.col("exchange").isin(*config.exchanges)
    rows = df.select("symbol", "timestamp", "exchange", *columns, *([] if seq in (None, UNIQUE) else [seq]))
    return last_wins(rows, ["symbol", "timestamp", "exchange"], seq, usable)


def combine_exchanges(df: DataFrame, values: dict[str, Column], config: LiquidityConfig) -> DataFrame:
    """One row per (symbol, timestamp): SUM or MEAN over exchanges, the same for every value."""
    fn = F.sum if config.aggregation == "SUM" else F.avg
    return df.groupBy("symbol", "timestamp").agg(*[fn(v).alias(name) for name, v in values.items()])


def align(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Rows present in both series, joined on (symbol, timestamp)."""
    return primary.join(secondary, ["symbol", "timestamp"])


def _roll(df: DataFrame, rows: int, build: Callable[[WindowSpec], dict[str, Column]], grid: Grid | None) -> DataFrame:
    """Frame columns as of the newest row of each symbol, or (with a grid) as of every row."""
    if grid is None:
        tail = newest(df, KEY, "timestamp", rows)
        over = W.partitionBy(*KEY).orderBy("timestamp")
        return tail.withColumns(build(over)).filter("_age = 1").drop("_age")
    led = lead_in(df, KEY, "timestamp", grid, rows - 1)
    return own(led.withColumns(build(window(KEY, "timestamp"))))


def _pressure(config: LiquidityConfig) -> Callable[[WindowSpec], dict[str, Column]]:
    def build(over: WindowSpec) -> dict[str, Column]:
        frame = over.rowsBetween(-(config.analysis_window - 1), 0)
        total, mean_oi = F.sum("total").over(frame), F.avg("oi").over(frame)
        shares = F.collect_list(F.when(F.col("oi") > 0, F.col("total") / F.col("oi"))).over(frame)
        return {
            "liquidity_pressure": F.when(mean_oi > 0, total / mean_oi),
            "liquidity_shift": half_split_delta(shares),
        }

    return build


def _metrics(inputs: LiquidityInputs, config: LiquidityConfig, seq: str | None, grid: Grid | None):
    """(liquidation rows, cleaned liquidations, {input: metric table})."""
    n, spike = config.analysis_window, config.spike_window
    long, short = F.col("long_liquidation_usd"), F.col("short_liquidation_usd")
    cleaned = clean_readings(inputs.liquidations, ["long_liquidation_usd", "short_liquidation_usd"], config, seq)
    volumes = combine_exchanges(cleaned, {"long": long, "short": short, "total": long + short}, config)

    def liquidation(over: WindowSpec) -> dict[str, Column]:
        frame = over.rowsBetween(-(n - 1), 0)
        return {
            "long_liquidation_volume": F.sum("long").over(frame),
            "short_liquidation_volume": F.sum("short").over(frame),
            "liquidation_event_count": F.count("total").over(frame),
            "window_start": F.min("timestamp").over(frame),
            "liquidation_intensity": zscore_against(F.col("total"), over, -(spike - 1)),
        }

    base = _roll(volumes, max(n, spike), liquidation, grid).drop("long", "short", "total")
    metrics: dict[str, DataFrame] = {}

    def both_sides(df: DataFrame) -> DataFrame:
        columns = ["long_account_ratio", "short_account_ratio"]
        rows = clean_readings(df, columns, config, seq)
        return combine_exchanges(rows, {"l": F.col(columns[0]), "s": F.col(columns[1])}, config)

    if inputs.global_ratio is not None:
        sides = both_sides(inputs.global_ratio)
        ratio = {"long_short_ratio": long_short_ratio(F.col("l"), F.col("s"))}
        metrics["ratio"] = _roll(sides, 1, lambda over: ratio, grid).drop("l", "s")
        known = sides.withColumn("b", bias(F.col("l"), F.col("s"))).filter("b IS NOT NULL").drop("l", "s")
        crowd = lambda over: {"market_crowdedness": zscore_against(F.col("b"), over, -(n - 1))}
        metrics["crowd"] = _roll(known, n, crowd, grid).drop("b")
    for name in ("account", "position"):
        df = getattr(inputs, f"top_trader_{name}_ratio")
        if df is not None:
            latest_bias = {f"top_trader_{name}_bias": bias(F.col("l"), F.col("s")), f"_has_{name}": F.lit(True)}
            metrics[name] = _roll(both_sides(df), 1, lambda over, c=latest_bias: c, grid).drop("l", "s")
    if inputs.open_interest is not None:
        rows = clean_readings(inputs.open_interest, ["open_interest"], config, seq)
        oi = combine_exchanges(rows, {"oi": F.col("open_interest")}, config)

        def participation(over: WindowSpec) -> dict[str, Column]:
            first = F.first("oi").over(over.rowsBetween(-(n - 1), 0))
            grown = F.try_divide(F.col("oi") - first, first) * 100
            return {
                "market_participation": F.when(F.count("oi").over(over.rowsBetween(-(n - 1), 0)) >= 2, grown),
                "current_open_interest": F.col("oi"),
            }

        metrics["oi"] = _roll(oi, n, participation, grid).drop("oi")
        joined = align(volumes.select("symbol", "timestamp", "total"), oi)
        metrics["pressure"] = _roll(joined, n, _pressure(config), grid).drop("total", "oi")
    if inputs.price is not None:
        rows = clean_readings(inputs.price, ["close"], config, seq)
        price = combine_exchanges(rows, {"current_price": F.col("close")}, config)
        metrics["price"] = price if grid is not None else newest(price, KEY, "timestamp", 1).drop("_age")
    return base, cleaned, metrics


_DOUBLES = ["long_short_ratio", "top_trader_account_bias", "top_trader_position_bias", "top_trader_bias",
            "market_crowdedness", "market_participation", "current_open_interest", "current_price",
            "liquidity_pressure", "liquidity_shift"]


def _finish(df: DataFrame, config: LiquidityConfig, extra: list[str]) -> DataFrame:
    for name in ("account", "position"):
        if f"_has_{name}" not in df.columns:
            df = df.withColumns({f"top_trader_{name}_bias": F.lit(None).cast("double"), f"_has_{name}": F.lit(False)})
    long, short = F.col("long_liquidation_volume"), F.col("short_liquidation_volume")
    df = df.withColumns({
        "total_liquidation_volume": long + short,
        "liquidation_bias": bias(long, short),
        "is_abnormal_liquidation": exceeds(F.col("liquidation_intensity"), config.spike_zscore_threshold),
        # Position data decides as soon as there is any, even where its bias is undefined.
        "top_trader_bias": F.when(F.coalesce("_has_position", F.lit(False)), F.col("top_trader_position_bias"))
        .otherwise(F.col("top_trader_account_bias")),
        "sample_size": F.col("liquidation_event_count"),
        "confidence_level": sufficiency(F.col("liquidation_event_count"), max(config.analysis_window, config.spike_window, 1)),
    })
    missing = [c for c in _DOUBLES if c not in df.columns]
    df = df.withColumns({c: F.lit(None).cast("double") for c in missing}) if missing else df
    return df.select(
        F.upper("symbol").alias("symbol"), F.col("timestamp").alias("as_of"), "sample_size", "confidence_level",
        "long_liquidation_volume", "short_liquidation_volume", "total_liquidation_volume",
        "liquidation_event_count", "liquidation_bias", "liquidation_intensity", "is_abnormal_liquidation",
        *_DOUBLES, *extra,
    )


def exchange_totals(cleaned: DataFrame, starts: DataFrame) -> DataFrame:
    """Liquidated volume per (symbol, exchange) from ``window_start`` on.

    Every cleaned row lies on a window timestamp, so the start bound is the semi-join.
    """
    volume = F.col("long_liquidation_usd") + F.col("short_liquidation_usd")
    return (
        cleaned.join(starts.select("symbol", "window_start"), "symbol")
        .filter(F.col("timestamp") >= F.col("window_start"))
        .groupBy("symbol", "exchange").agg(F.sum(volume).alias("total"))
    )


def liquidity_latest(inputs: LiquidityInputs, config: LiquidityConfig = LiquidityConfig(),
                     seq: str | None = None) -> DataFrame:
    """One row per symbol as of its last liquidation; other inputs count up to their own end."""
    base, cleaned, metrics = _metrics(inputs, config, seq, None)
    for table in metrics.values():
        base = base.join(table.drop("timestamp"), "symbol", "left")
    totals = exchange_totals(cleaned, base).groupBy("symbol").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("exchange", "total")))).alias("exchange_liquidation_totals")
    )
    return _finish(base.join(totals, "symbol", "left"), config, ["exchange_liquidation_totals"])


def liquidity_series(inputs: LiquidityInputs, grid: Grid, config: LiquidityConfig = LiquidityConfig(),
                     seq: str | None = None) -> DataFrame:
    """As of every liquidation timestamp, using only readings up to it (no exchange map)."""
    base, _, metrics = _metrics(inputs, config, seq, grid)
    rights = [
        (table, {c: c for c in table.columns if c not in ("symbol", "timestamp")}) for table in metrics.values()
    ]
    return _finish(asof_join(base, rights, KEY, "timestamp", grid) if rights else base, config, [])
