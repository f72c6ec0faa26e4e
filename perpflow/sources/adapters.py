"""Market readings of the generic test tables.

Fixed adapters: hourly bars and per-exchange series from ``events``, daily bars from
``lineitem``. Each is one partial + final hash aggregate, so a hot symbol or hour is folded
map-side before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from perpflow.session import use_utc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def candles_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.upper("event_type").alias("symbol"), hour.alias("timestamp"))
        .agg(
            F.min_by("value", "event_id").alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", "event_id").alias("close"),
            F.sum("value").alias("volume"),
        )
        .select(F.lit("SIM").alias("exchange"), "symbol", F.lit("1h").alias("timeframe"), "timestamp",
                "open", "high", "low", "close", "volume")
    )


def candles_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars. The day has no clock, so open and close use a full tie-break order.

    The order is one number inside min_by/max_by, which keeps this a hash aggregate.
    """
    ticks = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("P"), F.pmod("l_partkey", F.lit(5)).cast("string")).alias("symbol"),
        F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_extendedprice").alias("traded"),
        F.expr(
            "cast(l_orderkey as decimal(38,0)) * 1000 * 1000000000000 * 10000000 + cast(l_linenumber as decimal(38,0)) * 1000000000000 * 10000000 "
            "+ cast(l_partkey as decimal(38,0)) * 10000000 + l_suppkey").cast("decimal(38,0)").alias("tick"),
    )
    return ticks.groupBy("symbol", "timestamp").agg(
        F.min_by("price", "tick").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "tick").alias("close"),
        F.sum("traded").alias("volume"),
    ).select(F.lit("SIM").alias("exchange"), "symbol", F.lit("1d").alias("timeframe"), "timestamp",
             "open", "high", "low", "close", "volume")


def order_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reading for each order and half of the parts: long series, one row an order."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    shipped = F.unix_micros(F.min("l_shipdate").cast("timestamp"))
    close = F.col("close")
    orders = table(spark, sf_dir, "lineitem").groupBy(
        F.concat(F.lit("P"), F.pmod("l_partkey", F.lit(2)).cast("string")).alias("symbol"), "l_orderkey",
    ).agg(
        shipped.alias("_shipped"), F.max(price).alias("high"), F.min(price).alias("low"),
        (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"))
    return orders.select(
        "symbol", F.timestamp_micros(F.col("_shipped") + F.col("l_orderkey")).alias("timestamp"), "high", "low", "close",
        ((close - 1500) / 1000000).alias("funding_rate"), (1000 * close).alias("open_interest"))


def _by_exchange(spark: SparkSession, sf_dir: str):
    user = F.col("user_id")
    return table(spark, sf_dir, "events").groupBy(
        F.concat(F.lit("EX"), F.pmod(user, F.lit(3)).cast("string")).alias("exchange"),
        F.when(F.pmod(user, F.lit(2)) == 0, "AAAUSDT").otherwise("BBBUSDT").alias("symbol"),
        F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("timestamp"),
    )


def _is(*kinds: str):
    return F.col("event_type").isin(*kinds)


def liquidation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    worth = F.col("value") * 1000
    return _by_exchange(spark, sf_dir).agg(
        F.sum(F.when(_is("purchase", "signup"), worth).otherwise(0.0)).alias("long_liquidation_usd"),
        F.sum(F.when(_is("error", "view"), worth).otherwise(0.0)).alias("short_liquidation_usd"),
    )


def ratio_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    bullish = _is("purchase", "click", "signup")
    return _by_exchange(spark, sf_dir).agg(
        F.avg(F.when(bullish, 1.0).otherwise(0.0)).alias("long_account_ratio"),
        F.avg(F.when(bullish, 0.0).otherwise(1.0)).alias("short_account_ratio"),
    )


def open_interest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    change = F.when(_is("signup"), F.col("value")).otherwise(-F.col("value") / 4)
    return _by_exchange(spark, sf_dir).agg((F.lit(1.0e6) + 100 * F.sum(change)).alias("open_interest"))


def funding_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_exchange(spark, sf_dir).agg(((F.avg("value") - 50) / 100000).alias("funding_rate"))


def sma_cross_signals(bars: DataFrame, grid, length: int = 5) -> DataFrame:
    """ENTER_LONG when the close rises above its moving average, EXIT when it falls below.

    One alternating stream per symbol: the first entry needs no earlier bar.
    """
    from perpflow.operators.chunks import lead_in, own, window

    keys = ["exchange", "symbol", "timeframe"]
    led = lead_in(bars.select(*keys, "timestamp", "close"), keys, "timestamp", grid, length)
    here = window(keys, "timestamp")
    frame = here.rowsBetween(-(length - 1), W.currentRow)
    full = F.count("close").over(frame) == length
    up = F.when(full, F.col("close") > F.avg("close").over(frame))
    crossed = own(led.withColumn("up", up).withColumn("was", F.lag("up").over(here)))
    return crossed.filter(
        (F.col("up") & ~F.coalesce("was", F.lit(False))) | (~F.col("up") & F.coalesce("was", F.lit(False)))
    ).select(
        "symbol", "timestamp", F.col("symbol").alias("emit_symbol"), F.lit(0).cast("bigint").alias("seq"),
        F.when(F.col("up"), "ENTER_LONG").otherwise("EXIT").alias("action"),
        F.when(F.col("up"), F.lit(1.0)).alias("quantity"),
    )
