"""Queries that run a stream over the whole ``events`` table to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from perpflow.operators.chunks import Grid
from perpflow.plans.common import query, rounded, tidy
from perpflow.session import shared_folder
from perpflow.sources import adapters as A
from perpflow.sources.store import SeriesStore
from perpflow.streaming import streams as ST


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events file as a file source (the pattern keeps the other tables out)."""
    schema = A.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/event[s].parquet")


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/perpflow-stream-{uuid.uuid4().hex}"


@query("stream_signal_flags", """
  WITH s AS (SELECT event_id, upper(event_type) AS symbol, date_trunc('hour', ts) - (user_id % 3) * INTERVAL 1 HOUR AS as_of FROM events),
  f AS (SELECT *, row_number() OVER (PARTITION BY symbol, as_of ORDER BY event_id) > 1 AS dup,
     coalesce(as_of <= max(as_of) OVER (PARTITION BY symbol ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS late FROM s)
  SELECT event_id AS arrival, symbol, as_of, dup::VARCHAR AS is_duplicate, late::VARCHAR AS is_out_of_order FROM f""")
def stream_signal_flags(spark: SparkSession, sf: str) -> DataFrame:
    at = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    late_by = F.pmod("user_id", F.lit(3)) * F.lit(3_600_000_000)
    signals = _event_stream(spark, sf).select(
        F.upper("event_type").alias("symbol"), F.timestamp_micros(F.unix_micros(at) - late_by).alias("as_of"),
        F.lit("v1").alias("score_version"), F.col("event_id").alias("arrival"))
    folder = _folder(spark)

    def keep(flagged: DataFrame, batch_id: int) -> None:
        flagged.write.mode("overwrite").parquet(f"{folder}/flagged/batch={batch_id}")

    ledger = ST.SignalLedger(spark, f"{folder}/ledger")
    ST.flag_signal_stream(signals, ledger, keep, f"{folder}/checkpoint", grid=Grid(1, 4096, 1)).awaitTermination()
    out = spark.read.parquet(f"{folder}/flagged")
    return tidy(out.select("arrival", "symbol", "as_of", "is_duplicate", "is_out_of_order"))


@query("stream_candles_to_store", rounded("""
  SELECT 'SIM' AS exchange, upper(event_type) AS symbol, '1h' AS timeframe, date_trunc('hour', ts) AS timestamp, max_by(value, event_id) AS close
  FROM events GROUP BY 2, 4""", ["close"]))
def stream_candles_to_store(spark: SparkSession, sf: str) -> DataFrame:
    """A stream of one-tick candles: the store keeps the last one given per symbol and hour."""
    value = F.col("value")
    candles = _event_stream(spark, sf).select(
        F.lit("sim").alias("exchange"), F.col("event_type").alias("symbol"), F.lit("1h").alias("timeframe"),
        F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("timestamp"), value.alias("open"), value.alias("high"),
        value.alias("low"), value.alias("close"), F.lit(1.0).alias("volume"), F.col("event_id").alias("ingest_seq"))
    folder = _folder(spark)
    store = SeriesStore(spark, f"{folder}/store")
    ST.stream_into_store(candles, store, f"{folder}/checkpoint").awaitTermination()
    return tidy(store.read("candle").select("exchange", "symbol", "timeframe", "timestamp", "close"))


@query("store_written_and_read", rounded("""
  SELECT 'SIM' AS exchange, upper(event_type) AS symbol, date_trunc('hour', ts) AS timestamp,
         max_by(value, CASE WHEN user_id % 2 = 1 THEN 1000000000000 ELSE 0 END + event_id) AS funding_rate
  FROM events WHERE date_trunc('hour', ts) >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY 2, 3""", ["funding_rate"]))
def store_written_and_read(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches into a partitioned store, then a pruned range read."""
    from datetime import datetime, timezone

    rows = A.table(spark, sf, "events").select(
        F.lit("sim").alias("exchange"), F.col("event_type").alias("symbol"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("timestamp"),
        F.col("value").alias("funding_rate"), F.col("event_id").alias("ingest_seq"), "user_id")
    store = SeriesStore(spark, f"{_folder(spark)}/store")
    for parity in (0, 1):
        store.write("funding_rate", rows.filter(F.pmod("user_id", F.lit(2)) == parity).drop("user_id"))
    return tidy(store.read("funding_rate", start=datetime(2024, 1, 10, tzinfo=timezone.utc)))
