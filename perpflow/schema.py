"""Record types: column lists, Spark types, and the fixed vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

SERIES_KEY = ["exchange", "symbol", "timeframe"]

# Bar codes and their length in seconds.
TIMEFRAME_SECONDS = {
    "1m": 60,
    "5m": 300,
    "15m": 900,
    "30m": 1800,
    "1h": 3600,
    "2h": 7200,
    "4h": 14400,
    "6h": 21600,
    "8h": 28800,
    "12h": 43200,
    "1d": 86400,
    "1w": 604800,
}


def step_micros(step: str | int) -> int:
    """Length of a bar code (or a plain number of microseconds) in microseconds."""
    if isinstance(step, int):
        return step
    return TIMEFRAME_SECONDS[step] * 1_000_000


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


_ID = (("exchange", T.StringType()), ("symbol", T.StringType()))
_TS = (("timestamp", T.TimestampType()),)
_D = T.DoubleType()

CANDLE = _struct(
    *_ID, ("timeframe", T.StringType()), *_TS,
    ("open", _D), ("high", _D), ("low", _D), ("close", _D), ("volume", _D),
)
FUNDING_RATE = _struct(*_ID, *_TS, ("funding_rate", _D))
OPEN_INTEREST = _struct(*_ID, *_TS, ("open_interest", _D), ("open_interest_value_usd", _D))
LIQUIDATION = _struct(*_ID, *_TS, ("long_liquidation_usd", _D), ("short_liquidation_usd", _D))
LONG_SHORT_RATIO = _struct(*_ID, *_TS, ("long_account_ratio", _D), ("short_account_ratio", _D))
SUPPORTED_MARKET = _struct(
    ("exchange", T.StringType()), ("instrument_id", T.StringType()),
    ("base_asset", T.StringType()), ("quote_asset", T.StringType()),
)
FEATURE_VALUE = _struct(
    ("symbol", T.StringType()), ("feature_name", T.StringType()), *_TS,
    ("value", _D), ("version", T.StringType()),
)
SIGNAL = _struct(
    ("run_id", T.StringType()), ("symbol", T.StringType()), *_TS,
    ("emit_symbol", T.StringType()), ("seq", T.LongType()),
    ("action", T.StringType()), ("quantity", _D),
)
JOB = _struct(
    ("run_id", T.StringType()), ("exchange", T.StringType()),
    ("symbols", T.ArrayType(T.StringType())), ("timeframe", T.StringType()),
    ("start", T.TimestampType()), ("end", T.TimestampType()),
    ("initial_cash", _D), ("fee_rate", _D), ("slippage_bps", _D),
)
RULE = _struct(
    ("strategy", T.StringType()), ("section", T.StringType()), ("logic", T.StringType()),
    ("section_enabled", T.BooleanType()), ("name", T.StringType()), ("feature", T.StringType()),
    ("operator", T.StringType()), ("value", _D), ("value_high", _D), ("enabled", T.BooleanType()),
)

RECORD_TYPES = {
    "candle": CANDLE,
    "funding_rate": FUNDING_RATE,
    "open_interest": OPEN_INTEREST,
    "liquidation": LIQUIDATION,
    "long_short_ratio": LONG_SHORT_RATIO,
}

# Names of the four analyses, in reporting order.
ANALYSES = ["funding", "open_interest", "premium_discount", "liquidity"]
FEATURE_VERSION = "v1"
DEFAULT_FEE_RATE = 0.0004
DEFAULT_SLIPPAGE_BPS = 1.0
