"""Registry of the named queries, each with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from perpflow.operators.chunks import Grid
from perpflow.session import cut_lineage
from perpflow.sources import adapters as A

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

HOURLY = Grid("1h")
DAILY = Grid("1d")
READINGS = Grid("1h")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def stored(adapter: Query, spark: SparkSession, sf_dir: str) -> DataFrame:
    """A derived series as the table it would be in practice.

    Operators that pass over a series more than once read this small table; the raw events
    behind it are scanned once.
    """
    return cut_lineage(adapter(spark, sf_dir))


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(A.candles_events, spark, sf_dir)


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(A.candles_lineitem, spark, sf_dir)


def _nudge(digits: int) -> float:
    return float(f"1.37e-{digits + 2}")


def tidy(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Comparable output: doubles rounded (no negative zero), instants without zone, flags as text.

    A small offset keeps decimals that end in 5 off the rounding edge, where the last bit of
    a sum would decide.
    """
    columns = []
    for name, kind in df.dtypes:
        if kind == "double":
            d = special.get(name, digits)
            columns.append((F.round(F.col(name) + F.lit(_nudge(d)), d) + F.lit(0.0)).alias(name))
        elif kind == "timestamp":
            columns.append(F.col(name).cast("timestamp_ntz").alias(name))
        elif kind == "boolean":
            columns.append(F.col(name).cast("string").alias(name))
        elif kind == "int":
            columns.append(F.col(name).cast("bigint").alias(name))
        else:
            columns.append(F.col(name))
    return df.select(*columns)


def rounded(sql: str, doubles: Sequence[str], digits: int = 6, **special: int) -> str:
    """The same rounding around a SQL text."""
    places = {c: special.get(c, digits) for c in doubles}
    fixes = ", ".join(f"round({c} + {_nudge(d)!r}, {d}) + 0.0e0 AS {c}" for c, d in places.items())
    return f"SELECT * REPLACE ({fixes}) FROM ({sql}) AS t"


CANDLES_HOURLY = """candles AS (
  SELECT 'SIM' AS exchange, upper(event_type) AS symbol, '1h' AS timeframe, date_trunc('hour', ts) AS timestamp,
         min_by(value, event_id) AS open, max(value) AS high, min(value) AS low,
         max_by(value, event_id) AS close, sum(value) AS volume
  FROM events GROUP BY upper(event_type), date_trunc('hour', ts))"""

CANDLES_DAILY = """ticks AS (
  SELECT concat('P', l_partkey % 5) AS symbol, l_shipdate AS timestamp,
         l_extendedprice / l_quantity AS price, l_extendedprice AS vol,
         row_number() OVER (PARTITION BY l_partkey % 5, l_shipdate
           ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS rn
  FROM lineitem),
daily AS (
  SELECT 'SIM' AS exchange, symbol, '1d' AS timeframe, timestamp,
         min_by(price, rn) AS open, max(price) AS high, min(price) AS low,
         max_by(price, rn) AS close, sum(vol) AS volume
  FROM ticks GROUP BY symbol, timestamp)"""

ORDER_READINGS = """readings AS (
  SELECT *, (close - 1500) / 1000000 AS funding_rate, 1000 * close AS open_interest FROM (
    SELECT concat('P', l_partkey % 2) AS symbol, make_timestamp(epoch_us(min(l_shipdate)::TIMESTAMP) + l_orderkey) AS timestamp,
           max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low, sum(l_extendedprice) / sum(l_quantity) AS close
    FROM lineitem GROUP BY l_partkey % 2, l_orderkey))"""

_BY_EXCHANGE = """SELECT concat('EX', user_id % 3) AS exchange,
         CASE WHEN user_id % 2 = 0 THEN 'AAAUSDT' ELSE 'BBBUSDT' END AS symbol,
         date_trunc('hour', ts) AS timestamp, {columns}
  FROM events GROUP BY user_id % 3, user_id % 2, date_trunc('hour', ts)"""


def _cte(name: str, columns: str) -> str:
    return f"{name} AS (\n  {_BY_EXCHANGE.format(columns=columns)})"


LIQUIDATIONS = _cte("liq", """
         sum(CASE WHEN event_type IN ('purchase','signup') THEN value * 1000 ELSE 0 END) AS long_liquidation_usd,
         sum(CASE WHEN event_type IN ('error','view') THEN value * 1000 ELSE 0 END) AS short_liquidation_usd""")
RATIOS = _cte("ratios", """
         avg(CASE WHEN event_type IN ('purchase','click','signup') THEN 1.0E0 ELSE 0.0E0 END) AS long_account_ratio,
         avg(CASE WHEN event_type IN ('purchase','click','signup') THEN 0.0E0 ELSE 1.0E0 END) AS short_account_ratio""")
OPEN_INTEREST = _cte("oi", """
         1.0E6 + 100 * sum(CASE WHEN event_type = 'signup' THEN value ELSE -value / 4 END) AS open_interest""")
FUNDING = _cte("funding", "(avg(value) - 50) / 100000 AS funding_rate")


def with_ctes(*ctes: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n" + body
