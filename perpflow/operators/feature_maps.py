"""Analysis rows as long features: one row per known number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from perpflow.operators.premium_discount import ZONES

# The numeric fields each analysis exposes, in order.
FUNDING_FIELDS = ["current_funding", "previous_funding", "funding_change", "funding_change_pct", "funding_trend_value",
                  "funding_momentum_value", "funding_volatility", "historical_average", "historical_maximum",
                  "historical_minimum", "confidence_level"]
OPEN_INTEREST_FIELDS = ["current_oi", "previous_oi", "oi_change", "oi_change_pct", "oi_trend_value", "oi_momentum_value",
                        "oi_volatility", "spike_magnitude", "historical_average", "historical_maximum",
                        "historical_minimum", "confidence_level", "is_abnormal_spike"]
RANGE_FIELDS = ["active_high", "active_low", "range_size", "midpoint", "current_price", "current_price_position_pct",
                "premium_percentage", "discount_percentage", "confidence_level"]
LIQUIDITY_FIELDS = ["long_liquidation_volume", "short_liquidation_volume", "total_liquidation_volume",
                    "liquidation_event_count", "liquidation_bias", "liquidation_intensity", "long_short_ratio",
                    "top_trader_account_bias", "top_trader_position_bias", "top_trader_bias", "market_crowdedness",
                    "market_participation", "current_open_interest", "current_price", "liquidity_pressure",
                    "liquidity_shift", "confidence_level", "is_abnormal_liquidation"]


def _cells(df: DataFrame, prefix: Column, fields: list[str], extra: list[tuple[Column, Column]] = ()) -> DataFrame:
    pairs = [(F.concat(prefix, F.lit(f".{f}")), F.col(f).cast("double")) for f in fields] + list(extra)
    cells = F.inline(F.array(*[F.struct(n.alias("feature_name"), v.alias("value")) for n, v in pairs]))
    return df.select("symbol", F.col("as_of").alias("timestamp"), cells).filter("value IS NOT NULL")


def funding_features(df: DataFrame) -> DataFrame:
    return _cells(df, F.lit("funding_rate_analysis"), FUNDING_FIELDS)


def open_interest_features(df: DataFrame) -> DataFrame:
    return _cells(df, F.concat(F.lit("open_interest_analysis_"), F.col("source")), OPEN_INTEREST_FIELDS)


def range_features(df: DataFrame) -> DataFrame:
    prefix = F.concat(F.lit("premium_discount_analysis_"), F.col("timeframe"))
    flags = [(F.concat(prefix, F.lit(f".zone_is_{z.lower()}")), (F.col("zone") == z).cast("double")) for z in ZONES]
    return _cells(df, prefix, RANGE_FIELDS, flags)


def liquidity_features(df: DataFrame) -> DataFrame:
    cells = _cells(df, F.lit("liquidity_analysis"), LIQUIDITY_FIELDS)
    if "exchange_liquidation_totals" not in df.columns:
        return cells
    per_exchange = df.select("symbol", F.col("as_of").alias("timestamp"), F.explode("exchange_liquidation_totals")).select(
        "symbol", "timestamp",
        F.concat(F.lit("liquidity_analysis.exchange_liquidation_total."), F.col("key")).alias("feature_name"), "value",
    )
    return cells.unionByName(per_exchange)
