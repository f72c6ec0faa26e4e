"""Queries: the four analyses, as of the newest and as of every reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from perpflow.operators import feature_maps, level_analysis as LA, liquidity as LQ, premium_discount as PD
from perpflow.operators.dedupe import UNIQUE
from perpflow.operators.score import Provider, ScoreConfig, join_analyses, score
from perpflow.plans.common import (
    CANDLES_DAILY, CANDLES_HOURLY, DAILY, FUNDING, HOURLY, LIQUIDATIONS, OPEN_INTEREST, ORACLES, ORDER_READINGS, RATIOS,
    READINGS, daily_bars, hourly_bars, query, rounded, stored, tidy, with_ctes,
)
from perpflow.sources import adapters as A

# --- funding and open interest ----------------------------------------------------------------


def _frame(n: int, last: str = "CURRENT ROW", key: str = "k") -> str:
    return f"OVER (PARTITION BY {key} ORDER BY timestamp ROWS BETWEEN {n - 1} PRECEDING AND {last})"


def _direction(x: str, tolerance: str) -> str:
    return (f"CASE WHEN {x} IS NULL THEN 'UNKNOWN' WHEN abs({x}) <= {tolerance} THEN 'FLAT' "
            f"WHEN {x} > 0 THEN 'RISING' ELSE 'FALLING' END")


def _scaled(n: int, relative: bool) -> str:
    if not relative:
        return "1e-15"
    top = f"max(abs(x)) {_frame(n)}"
    return f"(CASE WHEN {top} > 0 THEN {top} ELSE 1 END) * 1e-15"


def _level_ctes(source: str, key: str, value: str, relative: bool, config: LA.LevelConfig = LA.LevelConfig()) -> list[str]:
    """Spikes are judged on 30 rows unless ``config`` says otherwise; without a window history is everything so far."""
    trend, volatility = config.trend_window, config.volatility_window
    spike = _frame((config.spike_window or 30) - 1, "1 PRECEDING")
    past = "ROWS UNBOUNDED PRECEDING" if config.historical_window is None else f"ROWS {config.historical_window - 1} PRECEDING"
    halves = "list(x) " + _frame(8)
    return [
        f"obs AS (SELECT {key} AS k, {key}, timestamp, {value} AS x FROM {source} WHERE {value} IS NOT NULL)",
        """s1 AS (SELECT *, lag(x) OVER (PARTITION BY k ORDER BY timestamp) AS previous,
  x - lag(x) OVER (PARTITION BY k ORDER BY timestamp) AS change,
  row_number() OVER (PARTITION BY k ORDER BY timestamp) AS pos FROM obs)""",
        f"""s2 AS (SELECT *, change / nullif(previous, 0) AS change_pct,
  CASE WHEN count(x) {_frame(trend)} >= 2 THEN regr_slope(x, pos::DOUBLE) {_frame(trend)} END AS trend_value,
  {halves} AS h,
  CASE WHEN count(x) {_frame(volatility)} >= 2 THEN stddev_samp(x) {_frame(volatility)} END AS volatility,
  CASE WHEN count(change) {spike} >= 2 THEN (change - avg(change) {spike}) / nullif(stddev_samp(change) {spike}, 0) END AS spike_magnitude,
  {_scaled(trend, relative)} AS tolerance, {_scaled(8, relative)} AS halves_tolerance,
  avg(x) OVER w AS historical_average, max(x) OVER w AS historical_maximum, min(x) OVER w AS historical_minimum,
  row_number() OVER (PARTITION BY k ORDER BY timestamp) AS sample_size, max(timestamp) OVER (PARTITION BY k) AS newest
  FROM s1 WINDOW w AS (PARTITION BY k ORDER BY timestamp {past}))""",
        f"""s3 AS (SELECT *, CASE WHEN len(h) >= 2 THEN list_avg(h[len(h) // 2 + 1:]) - list_avg(h[:len(h) // 2]) END AS momentum_value,
  {_direction('trend_value', 'tolerance')} AS trend, least(sample_size / {float(config.widest)!r}, 1.0e0) AS confidence_level FROM s2)""",
    ]


_LEVEL = ["current_{l}", "previous_{l}", "{p}_change", "{p}_change_pct", "{p}_trend_value", "{p}_momentum_value",
          "{p}_volatility", "historical_average", "historical_maximum", "historical_minimum", "confidence_level"]


def _level_sql(cte: str, source: str, key: str, value: str, p: str, level: str, relative: bool, latest: bool, digits: int,
               extra: str = "", extra_doubles: tuple[str, ...] = (), config: LA.LevelConfig = LA.LevelConfig()) -> str:
    body = f"""SELECT {key} AS symbol, timestamp AS as_of, x AS current_{level}, previous AS previous_{level},
  change AS {p}_change, change_pct AS {p}_change_pct, trend AS {p}_trend, trend_value AS {p}_trend_value,
  {_direction('momentum_value', 'halves_tolerance')} AS {p}_momentum, momentum_value AS {p}_momentum_value, volatility AS {p}_volatility,
  {extra} historical_average, historical_maximum, historical_minimum, sample_size, confidence_level
  FROM s3{' WHERE timestamp = newest' if latest else ''}"""
    doubles = [d.format(p=p, l=level) for d in _LEVEL] + list(extra_doubles)
    small = {f"{p}_change_pct": 6, "confidence_level": 6, "spike_magnitude": 6}
    return rounded(with_ctes(cte, *_level_ctes(source, key, value, relative, config), body=body), doubles, digits, **small)


def _label(df: DataFrame) -> DataFrame:
    return df.withColumn("symbol", F.concat_ws("/", "exchange", "symbol")).drop("exchange")


_FUNDING_LABELLED = FUNDING + ",\nfl AS (SELECT concat(exchange, '/', symbol) AS name, timestamp, funding_rate FROM funding)"
_OI_LABELLED = OPEN_INTEREST + ",\nol AS (SELECT concat(exchange, '/', symbol) AS name, timestamp, open_interest FROM oi)"
_SPIKE = "'sim' AS source, spike_magnitude, (abs(spike_magnitude) > 2.5)::VARCHAR AS is_abnormal_spike,"
_OI_CONFIG = LA.LevelConfig(spike_window=30, spike_zscore_threshold=2.5)


def _funding_out(df: DataFrame) -> DataFrame:
    return tidy(df, 9, funding_change_pct=6, confidence_level=6)


def _oi_out(df: DataFrame) -> DataFrame:
    return tidy(df, 4, oi_change_pct=6, confidence_level=6, spike_magnitude=6)


@query("funding_series", _level_sql(_FUNDING_LABELLED, "fl", "name", "funding_rate", "funding", "funding", False, False, 9))
def funding_series(spark: SparkSession, sf: str) -> DataFrame:
    return _funding_out(LA.funding_series(_label(stored(A.funding_events, spark, sf)), HOURLY, seq=UNIQUE))


@query("funding_latest", _level_sql(_FUNDING_LABELLED, "fl", "name", "funding_rate", "funding", "funding", False, True, 9))
def funding_latest(spark: SparkSession, sf: str) -> DataFrame:
    return _funding_out(LA.funding_latest(_label(stored(A.funding_events, spark, sf)), seq=UNIQUE))


@query("open_interest_series", _level_sql(_OI_LABELLED, "ol", "name", "open_interest", "oi", "oi", True, False, 4, _SPIKE, ("spike_magnitude",)))
def open_interest_series(spark: SparkSession, sf: str) -> DataFrame:
    rows = _label(stored(A.open_interest_events, spark, sf))
    return _oi_out(LA.open_interest_series(rows, HOURLY, config=_OI_CONFIG, source="sim", seq=UNIQUE))


@query("open_interest_latest", _level_sql(_OI_LABELLED, "ol", "name", "open_interest", "oi", "oi", True, True, 4, _SPIKE, ("spike_magnitude",)))
def open_interest_latest(spark: SparkSession, sf: str) -> DataFrame:
    return _oi_out(LA.open_interest_latest(_label(stored(A.open_interest_events, spark, sf)), config=_OI_CONFIG, source="sim", seq=UNIQUE))


# Windows far wider than a sliding frame can take, over a reading for each order.
_HISTORY = LA.LevelConfig(historical_window=10_000)
_WIDE_OI = LA.LevelConfig(trend_window=500, volatility_window=2_000, spike_window=1_000, historical_window=5_000, spike_zscore_threshold=2.5)


@query("funding_history_window", _level_sql(ORDER_READINGS, "readings", "symbol", "funding_rate", "funding", "funding", False, False, 9, config=_HISTORY))
def funding_history_window(spark: SparkSession, sf: str) -> DataFrame:
    """As of every reading, against the last 10,000 readings."""
    return _funding_out(LA.funding_series(stored(A.order_readings, spark, sf), READINGS, config=_HISTORY, seq=UNIQUE))


@query("funding_history_window_latest", _level_sql(
    ORDER_READINGS, "readings", "symbol", "funding_rate", "funding", "funding", False, True, 9, config=_HISTORY))
def funding_history_window_latest(spark: SparkSession, sf: str) -> DataFrame:
    return _funding_out(LA.funding_latest(stored(A.order_readings, spark, sf), config=_HISTORY, seq=UNIQUE))


@query("open_interest_wide_windows", _level_sql(
    ORDER_READINGS, "readings", "symbol", "open_interest", "oi", "oi", True, False, 4, _SPIKE, ("spike_magnitude",), _WIDE_OI))
def open_interest_wide_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Slope of 500, spread of 2,000, spikes against 1,000 and history of 5,000 readings."""
    return _oi_out(LA.open_interest_series(stored(A.order_readings, spark, sf), READINGS, config=_WIDE_OI, source="sim", seq=UNIQUE))


_RAW_LEVEL_SQL = """raw AS (SELECT upper(event_type) AS name, date_trunc('hour', ts) AS timestamp, event_id,
    CASE WHEN user_id % 5 <> 0 THEN (value - 50) / 100000 END AS v FROM events),
fl AS (SELECT name, timestamp, max_by(v, event_id) AS funding_rate FROM raw WHERE v IS NOT NULL GROUP BY name, timestamp)"""


@query("funding_latest_from_raw", _level_sql(_RAW_LEVEL_SQL, "fl", "name", "funding_rate", "funding", "funding", False, True, 9))
def funding_latest_from_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Raw readings: missing ones dropped first, then the last given copy of an hour wins."""
    raw = A.table(spark, sf, "events").select(
        F.upper("event_type").alias("symbol"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("timestamp"),
        F.when(F.pmod("user_id", F.lit(5)) != 0, (F.col("value") - 50) / 100000).alias("funding_rate"), "event_id")
    return _funding_out(LA.funding_latest(raw, seq="event_id"))


# --- premium / discount -----------------------------------------------------------------------

def _range_ctes(source: str, fractal: bool, lookback: int = 50) -> list[str]:
    def w(a: str, b: str) -> str:
        return f"OVER (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN {a} AND {b})"

    left, right = w("2 PRECEDING", "1 PRECEDING"), w("1 FOLLOWING", "2 FOLLOWING")
    full = f"count(*) {left} = 2 AND count(*) {right} = 2"
    active = w(f"{lookback - 3} PRECEDING", "2 PRECEDING") if fractal else w(f"{lookback - 1} PRECEDING", "CURRENT ROW")
    high, low = ("sh", "sl") if fractal else ("high", "low")
    return [
        f"""c1 AS (SELECT symbol, timestamp, high, low, close,
  CASE WHEN {full} AND high > max(high) {left} AND high > max(high) {right} THEN high END AS sh,
  CASE WHEN {full} AND low < min(low) {left} AND low < min(low) {right} THEN low END AS sl FROM {source})""",
        f"""c2 AS (SELECT *, max({high}) {active} AS active_high, min({low}) {active} AS active_low,
  count(*) {w('UNBOUNDED PRECEDING', 'CURRENT ROW')} AS sample_size, max(timestamp) OVER (PARTITION BY symbol) AS newest FROM c1)""",
        """c3 AS (SELECT *, active_high - active_low AS range_size, active_low + (active_high - active_low) * 0.5 AS midpoint
  FROM c2 WHERE active_high > active_low)""",
    ]


_RANGE_DOUBLES = ["active_high", "active_low", "range_size", "midpoint", "current_price", "current_price_position_pct",
                  "premium_percentage", "discount_percentage", "confidence_level"]


def _range_sql(cte: str, source: str, label: str, *, fractal: bool = True, latest: bool = False, band: float | None = None,
               lookback: int = 50) -> str:
    balanced = "close = midpoint" if band is None else f"abs(close - midpoint) <= range_size * {band} / 2"
    body = f"""SELECT symbol, '{label}' AS timeframe, timestamp AS as_of, active_high, active_low, range_size, midpoint,
  close AS current_price, (close - active_low) / range_size * 100 AS current_price_position_pct,
  CASE WHEN close > active_high THEN 'ABOVE_RANGE' WHEN close < active_low THEN 'BELOW_RANGE' WHEN {balanced} THEN 'EQUILIBRIUM'
       WHEN close > midpoint THEN 'PREMIUM' ELSE 'DISCOUNT' END AS zone,
  CASE WHEN close >= midpoint THEN (close - midpoint) / nullif(active_high - midpoint, 0) * 100 ELSE 0 END AS premium_percentage,
  CASE WHEN close >= midpoint THEN 0 ELSE (midpoint - close) / nullif(midpoint - active_low, 0) * 100 END AS discount_percentage,
  sample_size, least(sample_size / {float(lookback)!r}, 1.0e0) AS confidence_level
  FROM c3{' WHERE timestamp = newest' if latest else ''}"""
    return rounded(with_ctes(cte, *_range_ctes(source, fractal, lookback), body=body), _RANGE_DOUBLES)


@query("range_series_daily", _range_sql(CANDLES_DAILY, "daily", "1d"))
def range_series_daily(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(PD.range_series(daily_bars(spark, sf), DAILY, label="1d", seq=UNIQUE))


@query("range_series_band", _range_sql(CANDLES_HOURLY, "candles", "1h", fractal=False, band=0.2))
def range_series_band(spark: SparkSession, sf: str) -> DataFrame:
    """Extremum swings with an equilibrium band of a fifth of the range."""
    config = PD.RangeConfig(method="EXTREMUM", equilibrium_band_pct=0.2)
    return tidy(PD.range_series(hourly_bars(spark, sf), HOURLY, config=config, label="1h", seq=UNIQUE))


@query("range_series_wide", _range_sql(ORDER_READINGS, "readings", "1h", lookback=3000))
def range_series_wide(spark: SparkSession, sf: str) -> DataFrame:
    """Swings of the last 3,000 readings, as of every reading."""
    return tidy(PD.range_series(stored(A.order_readings, spark, sf), READINGS, config=PD.RangeConfig(lookback=3000), label="1h", seq=UNIQUE))


@query("range_latest", _range_sql(CANDLES_HOURLY, "candles", "1h", latest=True))
def range_latest(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(PD.range_latest(hourly_bars(spark, sf), label="1h", seq=UNIQUE))


@query("range_latest_extremum", _range_sql(CANDLES_DAILY, "daily", "1d", fractal=False, latest=True))
def range_latest_extremum(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(PD.range_latest(daily_bars(spark, sf), config=PD.RangeConfig(method="EXTREMUM"), label="1d", seq=UNIQUE))


@query("swing_points", rounded(with_ctes(CANDLES_DAILY, *_range_ctes("daily", True)[:1], body="""
  SELECT symbol, timestamp, 'HIGH' AS kind, sh AS price FROM c1 WHERE sh IS NOT NULL
  UNION ALL SELECT symbol, timestamp, 'LOW', sl FROM c1 WHERE sl IS NOT NULL"""), ["price"]))
def swing_points(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(PD.swings(daily_bars(spark, sf), DAILY, seq=UNIQUE))


@query("swing_points_latest", rounded(with_ctes(CANDLES_HOURLY, """
last50 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) AS age FROM candles) AS n WHERE age <= 50)""",
    *_range_ctes("last50", True)[:1], body="""
  SELECT symbol, timestamp, 'HIGH' AS kind, sh AS price FROM c1 WHERE sh IS NOT NULL
  UNION ALL SELECT symbol, timestamp, 'LOW', sl FROM c1 WHERE sl IS NOT NULL"""), ["price"]))
def swing_points_latest(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(PD.swings_latest(A.candles_events(spark, sf), seq=UNIQUE))


@query("swing_extremes_latest", rounded(with_ctes(CANDLES_HOURLY, """
last50 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) AS age FROM candles) AS n WHERE age <= 50)""",
    body="""SELECT symbol, 'HIGH' AS kind, min(timestamp) AS timestamp, max(high) AS price FROM (
      SELECT *, max(high) OVER (PARTITION BY symbol) AS m FROM last50) AS a WHERE high = m GROUP BY symbol
    UNION ALL SELECT symbol, 'LOW', min(timestamp), min(low) FROM (
      SELECT *, min(low) OVER (PARTITION BY symbol) AS m FROM last50) AS b WHERE low = m GROUP BY symbol"""), ["price"]))
def swing_extremes_latest(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(PD.extremes_latest(A.candles_events(spark, sf), seq=UNIQUE))


# --- liquidity --------------------------------------------------------------------------------

_PRICES = """prices AS (SELECT concat('EX', user_id % 3) AS exchange, CASE WHEN user_id % 2 = 0 THEN 'AAAUSDT' ELSE 'BBBUSDT' END AS symbol,
  date_trunc('hour', ts) AS timestamp, max_by(value, event_id) AS close FROM events GROUP BY 1, 2, 3)"""


def _price_events(spark: SparkSession, sf: str) -> DataFrame:
    user = F.col("user_id")
    return A.table(spark, sf, "events").groupBy(
        F.concat(F.lit("EX"), F.pmod(user, F.lit(3)).cast("string")).alias("exchange"),
        F.when(F.pmod(user, F.lit(2)) == 0, "AAAUSDT").otherwise("BBBUSDT").alias("symbol"),
        F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("timestamp"),
    ).agg(F.max_by("value", "event_id").alias("close"))


def _w(n: int, last: str = "CURRENT ROW") -> str:
    return f"OVER (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN {n - 1} PRECEDING AND {last})"


def _z(x: str, n: int) -> str:
    w = _w(n, "1 PRECEDING")
    return f"CASE WHEN count({x}) {w} >= 2 THEN ({x} - avg({x}) {w}) / nullif(stddev_samp({x}) {w}, 0) END"


def _liquidity_ctes(fn: str, where: str) -> list[str]:
    """One table per metric, as of each of its own timestamps (windows 30 and 24)."""
    return [
        LIQUIDATIONS, RATIOS, OPEN_INTEREST, _PRICES,
        f"""lt AS (SELECT symbol, timestamp, {fn}(long_liquidation_usd) AS l, {fn}(short_liquidation_usd) AS s,
  {fn}(long_liquidation_usd + short_liquidation_usd) AS t FROM liq {where} GROUP BY symbol, timestamp)""",
        f"""m_liq AS (SELECT symbol, timestamp, sum(l) {_w(30)} AS long_liquidation_volume, sum(s) {_w(30)} AS short_liquidation_volume,
  count(t) {_w(30)} AS liquidation_event_count, min(timestamp) {_w(30)} AS window_start, {_z('t', 24)} AS liquidation_intensity FROM lt)""",
        f"""rt AS (SELECT symbol, timestamp, {fn}(long_account_ratio) AS l, {fn}(short_account_ratio) AS s FROM ratios {where} GROUP BY symbol, timestamp)""",
        "m_ratio AS (SELECT symbol, timestamp, l / nullif(s, 0) AS long_short_ratio, (l - s) / nullif(l + s, 0) AS b FROM rt)",
        f"m_crowd AS (SELECT symbol, timestamp, {_z('b', 30)} AS market_crowdedness FROM m_ratio WHERE b IS NOT NULL)",
        f"ot AS (SELECT symbol, timestamp, {fn}(open_interest) AS o FROM oi {where} GROUP BY symbol, timestamp)",
        f"""m_oi AS (SELECT symbol, timestamp, o AS current_open_interest, CASE WHEN count(o) {_w(30)} >= 2 THEN
  (o - first_value(o) {_w(30)}) / nullif(first_value(o) {_w(30)}, 0) * 100 END AS market_participation FROM ot)""",
        f"""jp AS (SELECT lt.symbol, lt.timestamp, t, o, CASE WHEN o > 0 THEN t / o END AS p FROM lt JOIN ot USING (symbol, timestamp))""",
        f"""jl AS (SELECT symbol, timestamp, CASE WHEN avg(o) {_w(30)} > 0 THEN sum(t) {_w(30)} / avg(o) {_w(30)} END AS liquidity_pressure,
  list(p) {_w(30)} AS ps FROM jp)""",
        """m_press AS (SELECT symbol, timestamp, liquidity_pressure,
  CASE WHEN len(q) >= 2 THEN list_avg(q[len(q) // 2 + 1:]) - list_avg(q[:len(q) // 2]) END AS liquidity_shift
  FROM (SELECT *, list_filter(ps, lambda x: x IS NOT NULL) AS q FROM jl) AS f)""",
        f"m_price AS (SELECT symbol, timestamp, {fn}(close) AS current_price FROM prices {where} GROUP BY symbol, timestamp)",
    ]


_LIQ_DOUBLES = ["confidence_level", "long_liquidation_volume", "short_liquidation_volume", "total_liquidation_volume",
                "liquidation_bias", "liquidation_intensity", "long_short_ratio", "top_trader_account_bias",
                "top_trader_position_bias", "top_trader_bias", "market_crowdedness", "market_participation",
                "current_open_interest", "current_price", "liquidity_pressure", "liquidity_shift"]
_LIQ_PLACES = {"long_liquidation_volume": 3, "short_liquidation_volume": 3, "total_liquidation_volume": 3, "current_open_interest": 4}
_METRICS = {"r": "m_ratio", "c": "m_crowd", "o": "m_oi", "p": "m_press", "x": "m_price"}


def _liquidity_sql(fn: str, where: str, latest: bool) -> str:
    def newest(t: str) -> str:
        return f"(SELECT * FROM {t} QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) = 1)"

    joins = " ".join(
        f"LEFT JOIN {newest(t)} {a} ON {a}.symbol = q.symbol" if latest
        else f"ASOF LEFT JOIN {t} {a} ON {a}.symbol = q.symbol AND q.timestamp >= {a}.timestamp"
        for a, t in _METRICS.items()
    )
    body = f"""SELECT q.symbol, q.timestamp AS as_of, liquidation_event_count AS sample_size,
  least(liquidation_event_count / 30.0e0, 1.0e0) AS confidence_level, long_liquidation_volume, short_liquidation_volume,
  long_liquidation_volume + short_liquidation_volume AS total_liquidation_volume, liquidation_event_count,
  (long_liquidation_volume - short_liquidation_volume) / nullif(long_liquidation_volume + short_liquidation_volume, 0) AS liquidation_bias,
  liquidation_intensity, (abs(liquidation_intensity) > 2.0)::VARCHAR AS is_abnormal_liquidation, long_short_ratio,
  r.b AS top_trader_account_bias, r.b AS top_trader_position_bias, r.b AS top_trader_bias, market_crowdedness,
  market_participation, current_open_interest, current_price, liquidity_pressure, liquidity_shift
  FROM {newest('m_liq') if latest else 'm_liq'} q {joins}"""
    return rounded(with_ctes(*_liquidity_ctes(fn, where), body=body), _LIQ_DOUBLES, 6, **_LIQ_PLACES)


def _inputs(spark: SparkSession, sf: str) -> LQ.LiquidityInputs:
    ratio = stored(A.ratio_events, spark, sf)
    return LQ.LiquidityInputs(
        liquidations=stored(A.liquidation_events, spark, sf), global_ratio=ratio, top_trader_account_ratio=ratio,
        top_trader_position_ratio=ratio, open_interest=stored(A.open_interest_events, spark, sf), price=_price_events(spark, sf))


_SUM = LQ.LiquidityConfig(analysis_window=30, spike_window=24, spike_zscore_threshold=2.0)
_MEAN_TWO = LQ.LiquidityConfig(analysis_window=30, spike_window=24, spike_zscore_threshold=2.0, aggregation="MEAN", exchanges=("EX0", "EX2"))
_TWO = "WHERE exchange IN ('EX0', 'EX2')"


@query("liquidity_latest", _liquidity_sql("sum", "", True))
def liquidity_latest(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(LQ.liquidity_latest(_inputs(spark, sf), _SUM, seq=UNIQUE).drop("exchange_liquidation_totals"), 6, **_LIQ_PLACES)


@query("liquidity_latest_mean_two_exchanges", _liquidity_sql("avg", _TWO, True))
def liquidity_latest_mean_two_exchanges(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(LQ.liquidity_latest(_inputs(spark, sf), _MEAN_TWO, seq=UNIQUE).drop("exchange_liquidation_totals"), 6, **_LIQ_PLACES)


@query("liquidity_series", _liquidity_sql("sum", "", False))
def liquidity_series(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(LQ.liquidity_series(_inputs(spark, sf), HOURLY, _SUM, seq=UNIQUE), 6, **_LIQ_PLACES)


@query("liquidity_exchange_totals", rounded(with_ctes(LIQUIDATIONS, """
stamps AS (SELECT symbol, timestamp, dense_rank() OVER (PARTITION BY symbol ORDER BY timestamp DESC) AS age FROM (SELECT DISTINCT symbol, timestamp FROM liq) AS d)""",
    body="""SELECT liq.symbol, exchange, sum(long_liquidation_usd + short_liquidation_usd) AS total FROM liq
  JOIN stamps ON stamps.symbol = liq.symbol AND stamps.timestamp = liq.timestamp AND age <= 30 GROUP BY liq.symbol, exchange"""), ["total"], 3))
def liquidity_exchange_totals(spark: SparkSession, sf: str) -> DataFrame:
    only = LQ.LiquidityInputs(A.liquidation_events(spark, sf))
    totals = LQ.liquidity_latest(only, _SUM, seq=UNIQUE).select("symbol", F.explode("exchange_liquidation_totals").alias("exchange", "total"))
    return tidy(totals, 3)


_BIAS_SOURCES = """acc AS (SELECT symbol, timestamp, sum(long_account_ratio) AS l, sum(short_account_ratio) AS s FROM ratios
  WHERE hour(timestamp) % 3 <> 0 GROUP BY symbol, timestamp),
pos AS (SELECT symbol, timestamp, sum(short_account_ratio) AS l, sum(long_account_ratio) AS s FROM ratios
  WHERE hour(timestamp) % 5 = 0 AND day(timestamp) > 2 GROUP BY symbol, timestamp),
lt AS (SELECT DISTINCT symbol, timestamp FROM liq),
m AS (SELECT lt.symbol, lt.timestamp AS as_of, (acc.l - acc.s) / nullif(acc.l + acc.s, 0) AS top_trader_account_bias,
    (pos.l - pos.s) / nullif(pos.l + pos.s, 0) AS top_trader_position_bias, pos.timestamp IS NOT NULL AS has
  FROM lt ASOF LEFT JOIN acc ON acc.symbol = lt.symbol AND lt.timestamp >= acc.timestamp ASOF LEFT JOIN pos ON pos.symbol = lt.symbol AND lt.timestamp >= pos.timestamp)"""


@query("liquidity_bias_sources", rounded(with_ctes(LIQUIDATIONS, RATIOS, _BIAS_SOURCES, body="""
  SELECT symbol, as_of, top_trader_account_bias, top_trader_position_bias, CASE WHEN has THEN top_trader_position_bias ELSE top_trader_account_bias END AS top_trader_bias FROM m"""),
  ["top_trader_account_bias", "top_trader_position_bias", "top_trader_bias"]))
def liquidity_bias_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Accounts and positions from different tables: positions decide from their first reading on."""
    ratio, hour = stored(A.ratio_events, spark, sf), F.hour("timestamp")
    position = ratio.filter((F.pmod(hour, F.lit(5)) == 0) & (F.dayofmonth("timestamp") > 2)).withColumns({
        "long_account_ratio": F.col("short_account_ratio"), "short_account_ratio": F.col("long_account_ratio")})
    inputs = LQ.LiquidityInputs(
        stored(A.liquidation_events, spark, sf), top_trader_account_ratio=ratio.filter(F.pmod(hour, F.lit(3)) != 0), top_trader_position_ratio=position)
    out = LQ.liquidity_series(inputs, HOURLY, _SUM, seq=UNIQUE)
    return tidy(out.select("symbol", "as_of", "top_trader_account_bias", "top_trader_position_bias", "top_trader_bias"))


# --- analysis rows as features ----------------------------------------------------------------

def _map_sql(inner: str, prefix: str, fields: list[str], extra: dict[str, str] | None = None, digits: int = 9) -> str:
    def number(f: str) -> str:
        return f"CASE {f} WHEN 'true' THEN 1.0e0 WHEN 'false' THEN 0.0e0 END" if f.startswith("is_") else f"{f}::DOUBLE"

    cells = [(f"'{prefix}.{f}'", number(f)) for f in fields] + [(f"'{prefix}.{k}'", v) for k, v in (extra or {}).items()]
    parts = " UNION ALL ".join(f"SELECT symbol, as_of AS timestamp, {n} AS feature_name, {v} AS value FROM a" for n, v in cells)
    return f"WITH a AS ({inner}) SELECT symbol, timestamp, feature_name, round(value, {digits}) + 0.0e0 AS value FROM ({parts}) AS m WHERE value IS NOT NULL"



def _flag(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.col(name) == "true")


def _places(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.withColumn("value", F.round("value", digits) + F.lit(0.0))


@query("analysis_features_open_interest", _map_sql(ORACLES["open_interest_latest"], "open_interest_analysis_sim", feature_maps.OPEN_INTEREST_FIELDS, digits=9))
def analysis_features_open_interest(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(_places(feature_maps.open_interest_features(_flag(open_interest_latest(spark, sf), "is_abnormal_spike")), 9), 9)


@query("analysis_features_funding", _map_sql(ORACLES["funding_latest"], "funding_rate_analysis", feature_maps.FUNDING_FIELDS, digits=9))
def analysis_features_funding(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(_places(feature_maps.funding_features(funding_latest(spark, sf)), 9), 9)


_ZONE_FLAGS = {f"zone_is_{z.lower()}": f"CASE WHEN zone = '{z}' THEN 1.0 ELSE 0.0 END" for z in PD.ZONES}


@query("analysis_features_range", _map_sql(ORACLES["range_latest"], "premium_discount_analysis_1h", feature_maps.RANGE_FIELDS, _ZONE_FLAGS, digits=9))
def analysis_features_range(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(_places(feature_maps.range_features(range_latest(spark, sf)), 9), 9)


@query("analysis_features_liquidity", _map_sql(ORACLES["liquidity_latest"], "liquidity_analysis", feature_maps.LIQUIDITY_FIELDS, digits=9))
def analysis_features_liquidity(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(_places(feature_maps.liquidity_features(_flag(liquidity_latest(spark, sf), "is_abnormal_liquidation")), 9), 9)


@query("analyses_joined", f"""
  SELECT coalesce(f.symbol, o.symbol) AS symbol, coalesce(f.as_of, o.as_of) AS as_of, f.confidence_level AS funding, o.confidence_level AS open_interest
  FROM (SELECT * FROM ({ORACLES['funding_series']}) WHERE hour(as_of) % 3 <> 0) f
  FULL JOIN (SELECT * FROM ({ORACLES['open_interest_series']}) WHERE hour(as_of) % 4 <> 0) o ON f.symbol = o.symbol AND f.as_of = o.as_of
""")
def analyses_joined(spark: SparkSession, sf: str) -> DataFrame:
    """Real analyses aligned for the score; a side that is not there is NULL."""
    hour = F.hour("as_of")
    funding = LA.funding_series(_label(stored(A.funding_events, spark, sf)), HOURLY, seq=UNIQUE).filter(F.pmod(hour, F.lit(3)) != 0)
    interest = LA.open_interest_series(
        _label(stored(A.open_interest_events, spark, sf)), HOURLY, config=_OI_CONFIG, source="sim", seq=UNIQUE).filter(F.pmod(hour, F.lit(4)) != 0)
    both = join_analyses({"funding": funding, "open_interest": interest})
    return tidy(both.select("symbol", "as_of", F.col("funding.confidence_level").alias("funding"), F.col("open_interest.confidence_level").alias("open_interest")))


_FOUR = f"""f AS (SELECT split_part(symbol, '/', 2) AS symbol, as_of, confidence_level AS c, funding_trend AS t FROM ({ORACLES['funding_series']}) AS q WHERE symbol LIKE 'EX0/%'),
o AS (SELECT split_part(symbol, '/', 2) AS symbol, as_of, confidence_level AS c, spike_magnitude AS z FROM ({ORACLES['open_interest_series']}) AS q WHERE symbol LIKE 'EX1/%'),
p AS (SELECT CASE symbol WHEN 'VIEW' THEN 'AAAUSDT' ELSE 'BBBUSDT' END AS symbol, as_of, confidence_level AS c, current_price_position_pct AS y
  FROM ({ORACLES['range_series_band']}) AS q WHERE symbol IN ('VIEW', 'CLICK')),
l AS (SELECT symbol, as_of, confidence_level AS c, liquidation_bias AS b FROM ({ORACLES['liquidity_series']}) AS q),
k AS (SELECT symbol, as_of FROM f UNION SELECT symbol, as_of FROM o UNION SELECT symbol, as_of FROM p UNION SELECT symbol, as_of FROM l),
j AS (SELECT k.*, f.c AS fc, o.c AS oc, p.c AS pc, l.c AS lc, CASE WHEN f.c IS NOT NULL THEN CASE WHEN t = 'RISING' THEN 0.75e0 ELSE 0.25e0 END END AS fv,
    1 - abs(z) / 10 AS ov, y / 100 AS pv, (b + 1) / 2 AS lv
  FROM k LEFT JOIN f USING (symbol, as_of) LEFT JOIN o USING (symbol, as_of) LEFT JOIN p USING (symbol, as_of) LEFT JOIN l USING (symbol, as_of))"""


@query("analyses_scored", rounded(with_ctes(_FOUR, body="""
  SELECT symbol, as_of, fc AS funding, oc AS open_interest, pc AS premium_discount, lc AS liquidity, least(fc, oc, pc, lc) AS confidence,
    CASE WHEN fc IS NULL OR (ov < 0 OR ov > 1) OR (pv < 0 OR pv > 1) THEN NULL ELSE greatest(fv, ov, pv, lv) END AS total_score FROM j""").replace(
        "(ov < 0 OR ov > 1)", "coalesce(ov < 0 OR ov > 1, FALSE)").replace("(pv < 0 OR pv > 1)", "coalesce(pv < 0 OR pv > 1, FALSE)"), ["funding", "open_interest", "premium_discount", "liquidity", "confidence", "total_score"]))
def analyses_scored(spark: SparkSession, sf: str) -> DataFrame:
    """All four analyses aligned and scored, with an aggregator of its own: the best usable component instead of the weighted mean."""
    of_exchange = lambda df, name: df.filter(F.col("symbol").startswith(f"{name}/")).withColumn("symbol", F.substring_index("symbol", "/", -1))
    band = range_series_band(spark, sf).filter(F.col("symbol").isin("VIEW", "CLICK"))
    joined = join_analyses({
        "funding": of_exchange(funding_series(spark, sf), "EX0"), "open_interest": of_exchange(open_interest_series(spark, sf), "EX1"),
        "premium_discount": band.withColumn("symbol", F.when(F.col("symbol") == "VIEW", "AAAUSDT").otherwise("BBBUSDT")),
        "liquidity": liquidity_series(spark, sf)})
    providers = {
        "funding": Provider("v1", lambda a: F.when(a["funding_trend"] == "RISING", 0.75).otherwise(0.25)),
        "open_interest": Provider("v1", lambda a: 1 - F.abs(a["spike_magnitude"]) / 10),
        "premium_discount": Provider("v1", lambda a: a["current_price_position_pct"] / 100),
        "liquidity": Provider("v1", lambda a: (a["liquidation_bias"] + 1) / 2)}

    def best(values, usable, weights):
        return F.greatest(*[F.when(usable[n], v) for n, v in values.items()])

    scored = score(joined, ScoreConfig("v1", required=("funding",)), providers, aggregate=best)
    levels = [F.col(n)["confidence_level"].alias(n) for n in providers]
    return tidy(scored.select("symbol", "as_of", *levels, "confidence", "total_score"))
