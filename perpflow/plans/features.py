"""Queries: rolling features, their checks, look-backs and as-of reads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from perpflow.operators import features as M
from perpflow.operators.asof import with_timeframe
from perpflow.plans.common import (
    CANDLES_DAILY, CANDLES_HOURLY, DAILY, FUNDING, HOURLY, LIQUIDATIONS, OPEN_INTEREST, ORDER_READINGS, RATIOS, READINGS, daily_bars, hourly_bars,
    query, rounded, stored, tidy, with_ctes,
)
from perpflow.schema import step_micros
from perpflow.session import shared_folder
from perpflow.sources import adapters as A
from perpflow.sources.store import FeatureStore

# Per-exchange series are told apart by name, since long features carry only a symbol.
NAMED = "concat(exchange, '/', symbol)"


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("symbol", F.expr(NAMED))


def _long_sql(source: str, module: str, columns: dict[str, str], symbol: str = "symbol") -> str:
    """Long rows of an inner SELECT; cells without a value are left out."""
    parts = [
        f"SELECT {symbol} AS symbol, '{module}.{name}' AS feature_name, timestamp, {sql} AS value, 'v1' AS version FROM {source}"
        for name, sql in columns.items()
    ]
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) AS long WHERE value IS NOT NULL"


def _gated(fn: str, x: str, n: int, key: str) -> str:
    w = f"OVER (PARTITION BY {key} ORDER BY timestamp ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {w} = {n} THEN {fn}({x}) {w} END"


def _zscore(x: str, n: int, key: str) -> str:
    w = f"OVER (PARTITION BY {key} ORDER BY timestamp ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {w} = {n} THEN ({x} - avg({x}) {w}) / nullif(stddev_samp({x}) {w}, 0) END"


def _lag(x: str, n: int, key: str) -> str:
    return f"lag({x}, {n}) OVER (PARTITION BY {key} ORDER BY timestamp)"


def _price_ctes(table: str) -> list[str]:
    prev = _lag("close", 1, "symbol")
    return [
        f"""p1 AS (SELECT *, close / nullif({prev}, 0) - 1 AS return_pct,
  CASE WHEN close / nullif({prev}, 0) > 0 THEN ln(close / nullif({prev}, 0)) END AS log_return,
  CASE WHEN {prev} IS NULL THEN high - low ELSE greatest(high - low, abs(high - {prev}), abs(low - {prev})) END AS true_range,
  row_number() OVER (PARTITION BY symbol ORDER BY timestamp) AS rn FROM {table})""",
        """e AS (SELECT symbol, timestamp, rn, close AS ema FROM p1 WHERE rn = 1
  UNION ALL SELECT p.symbol, p.timestamp, p.rn, p.close * 2.0e0 / 21 + e.ema * 19.0e0 / 21
  FROM e JOIN p1 p ON p.symbol = e.symbol AND p.rn = e.rn + 1)""",
        "p2 AS (SELECT p1.*, e.ema FROM p1 JOIN e ON e.symbol = p1.symbol AND e.rn = p1.rn)",
    ]


_PRICE = {
    "return_pct": "return_pct", "log_return": "log_return", "true_range": "true_range",
    "sma_20": _gated("avg", "close", 20, "symbol"), "high_low_range_pct": "(high - low) / nullif(close, 0)",
    "atr_14": _gated("avg", "true_range", 14, "symbol"), "volatility_14": _gated("stddev_samp", "return_pct", 14, "symbol"),
    "ema_20": "ema",
}


def _price_sql(cte: str, table: str) -> str:
    return rounded(with_ctes(cte, *_price_ctes(table), body=_long_sql("p2", "price", _PRICE), recursive=True), ["value"])


def _price(bars: DataFrame, grid) -> DataFrame:
    return tidy(M.compute_features([M.price_module()], {"price": bars}, ["exchange", "symbol", "timeframe"], grid))


@query("features_price_daily", _price_sql(CANDLES_DAILY, "daily"))
def features_price_daily(spark: SparkSession, sf: str) -> DataFrame:
    return _price(daily_bars(spark, sf), DAILY)


@query("features_price_hourly", _price_sql(CANDLES_HOURLY, "candles"))
def features_price_hourly(spark: SparkSession, sf: str) -> DataFrame:
    return _price(hourly_bars(spark, sf), HOURLY)


_WIDE_PRICE = {
    "return_pct": "return_pct", "log_return": "log_return", "true_range": "true_range",
    "sma_2000": _gated("avg", "close", 2000, "symbol"), "high_low_range_pct": "(high - low) / nullif(close, 0)",
    "atr_500": _gated("avg", "true_range", 500, "symbol"), "volatility_1000": _gated("stddev_samp", "return_pct", 1000, "symbol"),
    "ema_1": "close",
}


@query("features_price_wide", rounded(with_ctes(
    ORDER_READINGS, _price_ctes("readings")[0], body=_long_sql("p1", "price", _WIDE_PRICE)), ["value"]))
def features_price_wide(spark: SparkSession, sf: str) -> DataFrame:
    """Averages and spreads over hundreds to thousands of rows, at the cost of narrow ones."""
    module = M.price_module(sma=2000, ema_span=1, atr=500, volatility=1000)
    return tidy(M.compute_features([module], {"price": stored(A.order_readings, spark, sf)}, ["symbol"], READINGS))


_WIDE_FUNDING = {
    "funding_rate": "funding_rate", "funding_rate_change": f"funding_rate - {_lag('funding_rate', 1, 'symbol')}",
    "funding_rate_sma_500": _gated("avg", "funding_rate", 500, "symbol"), "funding_rate_zscore_3000": _zscore("funding_rate", 3000, "symbol"),
}


@query("features_zscore_wide", rounded(with_ctes(ORDER_READINGS, body=_long_sql("readings", "funding_standard", _WIDE_FUNDING)), ["value"], 8))
def features_zscore_wide(spark: SparkSession, sf: str) -> DataFrame:
    module = M.funding_module(sma=500, zscore=3000)
    return tidy(M.compute_features([module], {module.name: stored(A.order_readings, spark, sf)}, ["symbol"], READINGS), 8)


_KEY = "exchange, symbol"
_FUNDING = {
    "funding_rate": "funding_rate", "funding_rate_change": f"funding_rate - {_lag('funding_rate', 1, _KEY)}",
    "funding_rate_sma_8": _gated("avg", "funding_rate", 8, _KEY), "funding_rate_zscore_30": _zscore("funding_rate", 30, _KEY),
}


def _one(module: M.FeatureModule, df: DataFrame, digits: int) -> DataFrame:
    named = _named(df)
    return tidy(M.compute_features([module], {module.name: named}, ["exchange", "symbol"], HOURLY), digits)


@query("features_funding", rounded(with_ctes(FUNDING, body=_long_sql("funding", "funding_standard", _FUNDING, NAMED)), ["value"], 9))
def features_funding(spark: SparkSession, sf: str) -> DataFrame:
    return _one(M.funding_module(), stored(A.funding_events, spark, sf), 9)


@query("features_run_persisted", rounded(with_ctes(FUNDING, body=_long_sql("funding", "funding_standard", _FUNDING, NAMED)), ["value"], 9))
def features_run_persisted(spark: SparkSession, sf: str) -> DataFrame:
    """A run that checks its features, saves them and goes on with the saved ones."""
    store = FeatureStore(spark, f"{shared_folder(spark)}/perpflow-run-{uuid.uuid4().hex}")
    module = M.funding_module()
    run = M.run_features([module], {module.name: _named(stored(A.funding_events, spark, sf))}, ["exchange", "symbol"], HOURLY, store)
    if not run.is_valid():
        raise ValueError("the features have errors")
    return tidy(run.features, 9)


_OI = {
    "open_interest": "open_interest", "oi_change_pct": f"open_interest / nullif({_lag('open_interest', 1, _KEY)}, 0) - 1",
    "oi_sma_20": _gated("avg", "open_interest", 20, _KEY),
    "oi_roc_14": f"open_interest / nullif({_lag('open_interest', 14, _KEY)}, 0) - 1",
    "oi_zscore_30": _zscore("open_interest", 30, _KEY),
}


@query("features_open_interest", rounded(with_ctes(OPEN_INTEREST, body=_long_sql("oi", "open_interest", _OI, NAMED)), ["value"]))
def features_open_interest(spark: SparkSession, sf: str) -> DataFrame:
    return _one(M.open_interest_module(), stored(A.open_interest_events, spark, sf), 6)


_L, _S = "long_liquidation_usd", "short_liquidation_usd"
_LIQ = {
    _L: _L, _S: _S, "total_liquidation_usd": f"{_L} + {_S}", "liquidation_imbalance": f"({_L} - {_S}) / nullif({_L} + {_S}, 0)",
    f"{_L}_sum_24": _gated("sum", _L, 24, _KEY), f"{_S}_sum_24": _gated("sum", _S, 24, _KEY),
    "total_liquidation_usd_sum_24": _gated("sum", f"({_L} + {_S})", 24, _KEY),
}


@query("features_liquidation", rounded(with_ctes(LIQUIDATIONS, body=_long_sql("liq", "liquidation", _LIQ, NAMED)), ["value"], 5))
def features_liquidation(spark: SparkSession, sf: str) -> DataFrame:
    return _one(M.liquidation_module(), stored(A.liquidation_events, spark, sf), 5)


_RATIO = {
    "long_account_ratio": "long_account_ratio", "short_account_ratio": "short_account_ratio", "long_short_ratio": "ratio",
    "long_short_ratio_change": f"ratio - {_lag('ratio', 1, _KEY)}",
    "long_short_ratio_sma_14": _gated("avg", "ratio", 14, _KEY), "long_short_ratio_zscore_30": _zscore("ratio", 30, _KEY),
}


@query("features_long_short", rounded(with_ctes(
    RATIOS, "r2 AS (SELECT *, long_account_ratio / nullif(short_account_ratio, 0) AS ratio FROM ratios)",
    body=_long_sql("r2", "long_short_ratio_global", _RATIO, NAMED)), ["value"]))
def features_long_short(spark: SparkSession, sf: str) -> DataFrame:
    return _one(M.long_short_module(), stored(A.ratio_events, spark, sf), 6)


def _all_features(spark: SparkSession, sf: str) -> DataFrame:
    """Every module over every symbol in one job."""
    modules = [M.price_module(), M.funding_module("oi_weighted"), M.open_interest_module(), M.liquidation_module(),
               M.long_short_module("top_account"), M.long_short_module("top_position")]
    inputs = {
        "price": hourly_bars(spark, sf),
        "funding_oi_weighted": _named(stored(A.funding_events, spark, sf)),
        "open_interest": _named(stored(A.open_interest_events, spark, sf)),
        "liquidation": _named(stored(A.liquidation_events, spark, sf)),
        "long_short_ratio_top_account": _named(stored(A.ratio_events, spark, sf)),
    }
    return M.compute_features(modules, inputs, ["exchange", "symbol", "timeframe"], HOURLY)


_ALL_SQL = " UNION ALL ".join(f"SELECT * FROM ({s}) AS q" for s in [
    _long_sql("p2", "price", _PRICE),
    _long_sql("funding", "funding_oi_weighted", _FUNDING, NAMED),
    _long_sql("oi", "open_interest", _OI, NAMED),
    _long_sql("liq", "liquidation", _LIQ, NAMED),
    _long_sql("r2", "long_short_ratio_top_account", _RATIO, NAMED),
])


@query("features_all_modules", with_ctes(
    CANDLES_HOURLY, *_price_ctes("candles"), FUNDING, OPEN_INTEREST, LIQUIDATIONS, RATIOS,
    "r2 AS (SELECT *, long_account_ratio / nullif(short_account_ratio, 0) AS ratio FROM ratios)",
    body=f"SELECT symbol, feature_name, count(*) AS n, min(timestamp) AS first_at, max(timestamp) AS last_at FROM ({_ALL_SQL}) AS a "
         "GROUP BY symbol, feature_name", recursive=True))
def features_all_modules(spark: SparkSession, sf: str) -> DataFrame:
    """How far every feature of every symbol reaches; the module without input is skipped."""
    return tidy(_all_features(spark, sf).groupBy("symbol", "feature_name").agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at")))


@query("feature_checks", with_ctes("""f AS (
    SELECT upper(event_type) AS symbol, 'price.last' AS feature_name, date_trunc('hour', ts) AS timestamp, 'v1' AS version,
           CASE WHEN event_id % 97 = 0 THEN 'nan' WHEN event_id % 89 = 0 THEN 'infinite' END AS bad FROM events)""", body="""
  SELECT 'ERROR' AS severity, symbol, feature_name, timestamp, version, bad AS problem, 1 AS count FROM f WHERE bad IS NOT NULL
  UNION ALL SELECT 'ERROR', symbol, feature_name, timestamp, version, 'duplicate', count(*) FROM f GROUP BY symbol, feature_name, timestamp, version HAVING count(*) > 1
  UNION ALL SELECT 'ERROR', symbol, feature_name, timestamp, version, 'not_increasing', count(*) - 1 FROM f GROUP BY symbol, feature_name, timestamp, version HAVING count(*) > 1"""))
def feature_checks(spark: SparkSession, sf: str) -> DataFrame:
    value = (
        F.when(F.pmod("event_id", F.lit(97)) == 0, float("nan"))
        .when(F.pmod("event_id", F.lit(89)) == 0, float("inf")).otherwise(F.col("value"))
    )
    features = A.table(spark, sf, "events").select(
        F.upper("event_type").alias("symbol"), F.lit("price.last").alias("feature_name"),
        F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("timestamp"), value.alias("value"), F.lit("v1").alias("version"))
    return tidy(M.check_features(features))


@query("lookback_bars", rounded(with_ctes(CANDLES_HOURLY, body="""
  SELECT m.symbol, m.timestamp AS now, b.timestamp, b.close FROM candles m JOIN candles b ON b.symbol = m.symbol
    AND b.timestamp <= m.timestamp AND b.timestamp >= m.timestamp - INTERVAL 6 HOUR"""), ["close"]))
def lookback_bars(spark: SparkSession, sf: str) -> DataFrame:
    """What a look-back of 6 periods shows at every bar: up to 7 bars."""
    bars = hourly_bars(spark, sf).select("symbol", "timestamp", "close")
    moments = bars.select("symbol", F.col("timestamp").alias("now"))
    return tidy(M.lookback(bars, moments, ["symbol"], step_micros("1h"), 6).select("symbol", "now", "timestamp", "close"))


_HIGHER_SQL = """SELECT b.symbol, b.timestamp, b.close, h.timestamp AS higher_time, h.close AS higher_close FROM candles b
  ASOF LEFT JOIN (SELECT symbol, timestamp + INTERVAL {delay} HOUR AS visible, timestamp, close FROM h4) h ON b.symbol = h.symbol AND b.timestamp >= h.visible"""
_FOUR_HOURS = """h4 AS (SELECT symbol, time_bucket(INTERVAL 4 HOUR, timestamp) AS timestamp, max_by(close, timestamp) AS close
  FROM candles GROUP BY symbol, time_bucket(INTERVAL 4 HOUR, timestamp))"""


def _higher(spark: SparkSession, sf: str, closed_only: bool) -> DataFrame:
    bars = hourly_bars(spark, sf).select("symbol", "timestamp", "close")
    wide = step_micros("4h")
    start = F.timestamp_micros(F.unix_micros("timestamp") - F.pmod(F.unix_micros("timestamp"), F.lit(wide)))
    four = bars.groupBy("symbol", start.alias("bar")).agg(F.max_by("close", "timestamp").alias("close")).select(
        "symbol", F.col("bar").alias("timestamp"), F.col("bar"), "close")
    return tidy(with_timeframe(bars, four, ["symbol"], HOURLY, {"bar": "higher_time", "close": "higher_close"},
                               closed_only=closed_only, length=wide))


@query("timeframe_asof", rounded(with_ctes(CANDLES_HOURLY, _FOUR_HOURS, body=_HIGHER_SQL.format(delay=0)), ["close", "higher_close"]))
def timeframe_asof(spark: SparkSession, sf: str) -> DataFrame:
    return _higher(spark, sf, False)


@query("timeframe_asof_closed", rounded(with_ctes(CANDLES_HOURLY, _FOUR_HOURS, body=_HIGHER_SQL.format(delay=4)), ["close", "higher_close"]))
def timeframe_asof_closed(spark: SparkSession, sf: str) -> DataFrame:
    """Only four-hour bars that have ended are visible."""
    return _higher(spark, sf, True)
