"""Queries: adapters, landing, stores, gaps, quality."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from perpflow.operators import gaps as G, quality
from perpflow.operators.dedupe import last_wins, latest, merge_last_wins
from perpflow.operators.features import to_long
from perpflow.plans.common import (
    CANDLES_DAILY, CANDLES_HOURLY, DAILY, FUNDING, HOURLY, LIQUIDATIONS, OPEN_INTEREST, RATIOS, query, rounded, stored, tidy, with_ctes,
)
from perpflow.session import shared_folder
from perpflow.sources import adapters as A, landing as L
from perpflow.sources.store import (
    FeatureStore, SeriesStore, chronological, clip, covered_range, observations, observations_from_features, with_version,
)
from perpflow.sources.sync import SyncReport, series_keys, sync_store

BAR = ["open", "high", "low", "close", "volume"]


@query("candles_hourly", rounded(with_ctes(CANDLES_HOURLY, body="SELECT * FROM candles"), BAR))
def candles_hourly(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(A.candles_events(spark, sf))


@query("candles_daily", rounded(with_ctes(CANDLES_DAILY, body="SELECT * FROM daily"), BAR, 9, volume=4))
def candles_daily(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(A.candles_lineitem(spark, sf), 9, volume=4)


@query("chronological_scan", rounded(with_ctes(CANDLES_HOURLY, body="""
  SELECT timestamp, symbol, close, row_number() OVER (PARTITION BY timestamp ORDER BY symbol) AS visit FROM candles"""), ["close"]))
def chronological_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Every bar in (timestamp, symbol) order with its place inside the timestamp."""
    from pyspark.sql import Window as W

    bars = A.candles_events(spark, sf).select("timestamp", "symbol", "close")
    visit = F.row_number().over(W.partitionBy("timestamp").orderBy("symbol"))
    return tidy(chronological(bars.withColumn("visit", visit)))


# --- landing ----------------------------------------------------------------------------------

def _payloads(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """API-like payloads derived from a table: one JSON text per series and day."""
    time = F.unix_millis("timestamp").alias("time")
    item = F.struct(time, *[F.col(c).alias(name) for name, c in fields.items()])
    keys = [c for c in ("exchange", "symbol", "timeframe") if c in df.columns]
    grouped = df.groupBy(*keys, F.to_date("timestamp").alias("day")).agg(F.collect_list(item).alias("data"))
    return grouped.select(*keys, F.to_json(F.struct(F.lit("0").alias("code"), "data")).alias("payload"))


@query("land_candles", rounded(with_ctes(CANDLES_HOURLY, body="SELECT * FROM candles"), BAR))
def land_candles(spark: SparkSession, sf: str) -> DataFrame:
    fields = {"open": "open", "high": "high", "low": "low", "close": "close", "volume_usd": "volume"}
    return tidy(L.map_candles(_payloads(A.candles_events(spark, sf), fields))[0])


@query("land_funding", rounded(with_ctes(FUNDING, body="SELECT * FROM funding"), ["funding_rate"], 10))
def land_funding(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(L.map_funding_rates(_payloads(A.funding_events(spark, sf), {"close": "funding_rate"}))[0], 10)


@query("land_funding_oi_weighted", rounded(with_ctes(FUNDING, body="""
  SELECT 'AGGREGATED' AS exchange, symbol, timestamp, avg(funding_rate) AS funding_rate FROM funding GROUP BY symbol, timestamp"""),
  ["funding_rate"], 10))
def land_funding_oi_weighted(spark: SparkSession, sf: str) -> DataFrame:
    mean = A.funding_events(spark, sf).groupBy("symbol", "timestamp").agg(F.avg("funding_rate").alias("funding_rate"))
    return tidy(L.map_funding_rates(_payloads(mean, {"close": "funding_rate"}), L.AGGREGATED)[0], 10)


@query("land_open_interest", rounded(with_ctes(OPEN_INTEREST, body="""
  SELECT exchange, symbol, timestamp, open_interest, open_interest AS open_interest_value_usd FROM oi WHERE open_interest >= 0"""),
  ["open_interest", "open_interest_value_usd"], 4))
def land_open_interest(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(L.map_open_interest(_payloads(A.open_interest_events(spark, sf), {"close": "open_interest"}))[0], 4)


@query("land_open_interest_aggregated", rounded(with_ctes(OPEN_INTEREST, body="""
  SELECT 'AGGREGATED' AS exchange, symbol, timestamp, sum(open_interest) AS open_interest, sum(open_interest) AS open_interest_value_usd
  FROM oi GROUP BY symbol, timestamp HAVING sum(open_interest) >= 0"""), ["open_interest", "open_interest_value_usd"], 4))
def land_open_interest_aggregated(spark: SparkSession, sf: str) -> DataFrame:
    total = A.open_interest_events(spark, sf).groupBy("symbol", "timestamp").agg(F.sum("open_interest").alias("open_interest"))
    return tidy(L.map_open_interest(_payloads(total, {"close": "open_interest"}), L.AGGREGATED)[0], 4)


@query("land_liquidations", rounded(with_ctes(LIQUIDATIONS, body="SELECT * FROM liq"),
                                    ["long_liquidation_usd", "short_liquidation_usd"], 4))
def land_liquidations(spark: SparkSession, sf: str) -> DataFrame:
    fields = {c: c for c in L.FIELDS["liquidation"]}
    return tidy(L.map_liquidations(_payloads(A.liquidation_events(spark, sf), fields))[0], 4)


_RATIO = ["long_account_ratio", "short_account_ratio"]


def _ratios(spark: SparkSession, sf: str, source: str, scale: float) -> DataFrame:
    long, short = L.RATIO_FIELDS[source]
    df = A.ratio_events(spark, sf).withColumns({c: F.col(c) * scale for c in _RATIO})
    payloads = _payloads(df, {long: _RATIO[0], short: _RATIO[1]})
    return tidy(L.map_long_short_ratios(payloads, long, short)[0])


_RATIO_SQL = rounded(with_ctes(RATIOS, body="SELECT * FROM ratios"), _RATIO)
query("land_ratio_global_percent", _RATIO_SQL)(lambda spark, sf: _ratios(spark, sf, "global", 100.0))
query("land_ratio_top_account", _RATIO_SQL)(lambda spark, sf: _ratios(spark, sf, "top_account", 1.0))
query("land_ratio_top_position", _RATIO_SQL)(lambda spark, sf: _ratios(spark, sf, "top_position", 100.0))


@query("land_supported_markets", """
  SELECT DISTINCT concat('EX', user_id % 3) AS exchange, concat(upper(event_type), '-', user_id) AS instrument_id,
         upper(event_type) AS base_asset, 'USDT' AS quote_asset FROM events""")
def land_supported_markets(spark: SparkSession, sf: str) -> DataFrame:
    """Exchange dictionaries in pieces of 100 users, then flattened."""
    user = F.col("user_id")
    pairs = A.table(spark, sf, "events").select(
        F.concat(F.lit("ex"), F.pmod(user, F.lit(3)).cast("string")).alias("exchange"),
        F.floor(user / 100).alias("piece"),
        F.struct(F.concat_ws("-", "event_type", user.cast("string")).alias("instrument_id"),
                 F.col("event_type").alias("base_asset"), F.lit(" usdt ").alias("quote_asset")).alias("pair"),
    ).distinct()
    lists = pairs.groupBy("piece", "exchange").agg(F.collect_list("pair").alias("pairs"))
    payloads = lists.select(F.to_json(F.struct(F.create_map("exchange", "pairs").alias("data"))).alias("payload"))
    return L.map_supported_markets(payloads)[0]


EXCHANGE = "ex"
_DAMAGE = """CASE event_id % 7 WHEN 0 THEN 'missing field: close' WHEN 1 THEN 'not a number: close' WHEN 2 THEN 'not an epoch in milliseconds: time'
      WHEN 3 THEN 'item is not an object' WHEN 4 THEN 'payload has no list of data' END"""


def _damaged(spark: SparkSession, sf: str) -> DataFrame:
    """One funding payload per event, most of them damaged in one way each."""
    kind = F.pmod("event_id", F.lit(7))
    time, value = F.unix_millis(F.col("ts").cast("timestamp")).cast("string"), F.col("value").cast("string")
    item = (
        F.when(kind == 0, F.concat(F.lit('{"time":'), time, F.lit("}")))
        .when(kind == 1, F.concat(F.lit('{"time":'), time, F.lit(',"close":"n/a"}')))
        .when(kind == 2, F.concat(F.lit('{"time":"soon","close":'), value, F.lit("}")))
        .when(kind == 3, value)
        .otherwise(F.concat(F.lit('{"time":'), time, F.lit(',"close":'), value, F.lit("}")))
    )
    body = F.when(kind == 4, F.concat(F.lit('{"data":{"close":'), value, F.lit("}}"))).otherwise(
        F.concat(F.lit('{"data":['), item, F.lit("]}")))
    return A.table(spark, sf, "events").select(F.lit(EXCHANGE).alias("exchange"), F.col("event_type").alias("symbol"), "event_id", body.alias("payload"))


def _landed(spark: SparkSession, sf: str) -> DataFrame:
    """The damaged payloads as landed text files, one per symbol, read back with their places."""
    folder = f"{shared_folder(spark)}/perpflow-landed-{uuid.uuid4().hex}"
    # The writer keeps this order only if it already begins with its own, the partition columns; it sorts anew by those
    # alone for a column that is constant or may be NULL. The exchange is one, so it is a folder; an empty name is written as NULL.
    rows = _damaged(spark, sf).withColumn("symbol", F.coalesce("symbol", F.lit("")))
    rows = rows.repartition("symbol").sortWithinPartitions("symbol", "event_id")
    rows.select("symbol", "payload").write.partitionBy("symbol").text(f"{folder}/exchange={EXCHANGE}")
    return L.read_payloads(spark, folder)


@query("land_files_with_rejects", f"""
  SELECT exchange, symbol, line, raw, reason FROM (
    SELECT 'ex' AS exchange, event_type AS symbol, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS line, {_DAMAGE} AS reason,
      CASE event_id % 7 WHEN 1 THEN '{{"time":' || epoch_us(ts) // 1000 || ',"close":"n/a"}}' WHEN 0 THEN '{{"time":' || epoch_us(ts) // 1000 || '}}' END AS raw FROM events) AS t
  WHERE reason IS NOT NULL""")
def land_files_with_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Every refused item of landed files with the line it stands on; the text of items whose numbers print alike everywhere."""
    bad = L.map_funding_rates(_landed(spark, sf))[1]
    plain = F.col("reason").isin("missing field: close", "not a number: close")
    return tidy(bad.select("exchange", "symbol", F.col("line").cast("bigint").alias("line"), F.when(plain, F.col("raw")).alias("raw"), "reason"))


@query("land_files_records", rounded("""
  SELECT 'EX' AS exchange, upper(event_type) AS symbol, date_trunc('millisecond', ts) AS timestamp, value AS funding_rate, line FROM (
    SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS line FROM events) AS t WHERE event_id % 7 > 4""", ["funding_rate"]))
def land_files_records(spark: SparkSession, sf: str) -> DataFrame:
    """The records of the same files, each with its line."""
    return tidy(L.map_funding_rates(_landed(spark, sf))[0].drop("file"))


@query("land_rejects", """
  SELECT reason, count(*) AS n FROM (
    SELECT CASE WHEN event_id % 7 = 0 THEN 'missing field: close'
                WHEN event_id % 7 = 1 THEN 'not a number: close'
                WHEN event_id % 7 = 2 THEN 'not an epoch in milliseconds: time'
                WHEN event_id % 7 = 3 THEN 'item is not an object'
                WHEN event_id % 7 = 4 THEN 'payload has no list of data' END AS reason FROM events) AS t
  WHERE reason IS NOT NULL GROUP BY reason""")
def land_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Damaged payloads, one kind of damage per event, counted by reason."""
    rejects = L.map_funding_rates(_damaged(spark, sf).drop("event_id"))[1]
    return rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("canonical_checks", """
  WITH raw AS (
    SELECT event_id, value, event_id % 6 AS k, user_id FROM events),
  rec AS (
    SELECT event_id, CASE WHEN k = 0 THEN '  ' ELSE 'sim' END AS exchange,
           value AS open, CASE WHEN k = 1 THEN value - 1 ELSE value + 1 END AS high,
           CASE WHEN k = 2 THEN value + 0.5 ELSE value - 0.005 END AS low, value AS close,
           CASE WHEN k = 3 THEN -1.0 ELSE 1.0 END AS volume FROM raw)
  SELECT rule, count(*) AS n FROM (
    SELECT 'exchange empty' AS rule FROM rec WHERE trim(exchange) = ''
    UNION ALL SELECT 'high below zero' FROM rec WHERE NOT high >= 0
    UNION ALL SELECT 'low below zero' FROM rec WHERE NOT low >= 0
    UNION ALL SELECT 'volume below zero' FROM rec WHERE volume < 0
    UNION ALL SELECT 'high not the maximum' FROM rec WHERE high <> greatest(open, high, low, close)
    UNION ALL SELECT 'low not the minimum' FROM rec WHERE low <> least(open, high, low, close)) AS t GROUP BY rule""")
def canonical_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Candles with planted damage, quarantined and counted by broken rule."""
    k, v = F.pmod("event_id", F.lit(6)), F.col("value")
    candles = A.table(spark, sf, "events").select(
        F.when(k == 0, "  ").otherwise("sim").alias("exchange"), F.col("event_type").alias("symbol"),
        F.lit("1m").alias("timeframe"), F.col("ts").cast("timestamp").alias("timestamp"), v.alias("open"),
        F.when(k == 1, v - 1).otherwise(v + 1).alias("high"), F.when(k == 2, v + 0.5).otherwise(v - 0.005).alias("low"),
        v.alias("close"), F.when(k == 3, -1.0).otherwise(1.0).alias("volume"))
    bad = L.split_valid(candles, "candle")[1]
    return bad.select(F.explode("failed").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


_RECORD_RULES = """WITH e AS (SELECT event_id, event_id % 8 AS k, value / 100 AS v, ts FROM events WHERE value IS NOT NULL),
rec AS (SELECT *, CASE WHEN k = 0 THEN ' ' ELSE 'sim' END AS exchange, CASE WHEN k = 1 THEN NULL ELSE 'S' END AS symbol, CASE WHEN k = 2 THEN NULL ELSE ts END AS t,
    CASE WHEN k = 3 THEN -1 - v WHEN k = 4 THEN NULL ELSE v END AS a, CASE WHEN k = 5 THEN -1 ELSE 1 - v END AS b FROM e),
ids AS (SELECT event_id, rule FROM (SELECT event_id, 'exchange empty' AS rule FROM rec WHERE trim(exchange) = ''
    UNION ALL SELECT event_id, 'symbol empty' FROM rec WHERE symbol IS NULL UNION ALL SELECT event_id, 'timestamp missing' FROM rec WHERE t IS NULL) AS i),
kinds AS (SELECT unnest(['funding_rate', 'open_interest', 'liquidation', 'long_short_ratio']) AS kind)
SELECT kind, event_id, rule FROM ids CROSS JOIN kinds
UNION ALL SELECT 'funding_rate', event_id, 'funding_rate missing' FROM rec WHERE a IS NULL
UNION ALL SELECT 'open_interest', event_id, 'open_interest below zero' FROM rec WHERE a IS NULL OR a < 0
UNION ALL SELECT 'open_interest', event_id, 'open_interest_value_usd below zero' FROM rec WHERE b < 0
UNION ALL SELECT 'liquidation', event_id, 'long_liquidation_usd below zero' FROM rec WHERE a IS NULL OR a < 0
UNION ALL SELECT 'liquidation', event_id, 'short_liquidation_usd below zero' FROM rec WHERE b < 0
UNION ALL SELECT 'long_short_ratio', event_id, 'long_account_ratio outside 0..1' FROM rec WHERE a IS NULL OR a < 0 OR a > 1
UNION ALL SELECT 'long_short_ratio', event_id, 'short_account_ratio outside 0..1' FROM rec WHERE b < 0 OR b > 1
UNION ALL SELECT 'long_short_ratio', event_id, 'ratios do not sum to one' FROM rec WHERE a IS NULL OR a + b < 0.98 OR a + b > 1.02"""


@query("canonical_checks_by_record", _RECORD_RULES)
def canonical_checks_by_record(spark: SparkSession, sf: str) -> DataFrame:
    """Funding, open-interest, liquidation and ratio records with planted damage: every rule that a record breaks."""
    k, v = F.pmod("event_id", F.lit(8)), F.col("value") / 100
    a, b = F.when(k == 3, -1 - v).when(k != 4, v), F.when(k == 5, -1.0).otherwise(1 - v)
    rec = A.table(spark, sf, "events").filter("value IS NOT NULL").select(
        "event_id", F.when(k == 0, " ").otherwise("sim").alias("exchange"), F.when(k != 1, "S").alias("symbol"),
        F.when(k != 2, F.col("ts").cast("timestamp")).alias("timestamp"), a.alias("funding_rate"), a.alias("open_interest"), b.alias("open_interest_value_usd"),
        a.alias("long_liquidation_usd"), b.alias("short_liquidation_usd"), a.alias("long_account_ratio"), b.alias("short_account_ratio"))
    kinds = ("funding_rate", "open_interest", "liquidation", "long_short_ratio")
    judged = rec.select("event_id", F.explode(F.array(*[
        F.struct(F.lit(kind).alias("kind"), L.failed_rules(kind).alias("failed")) for kind in kinds])).alias("j"))
    return judged.select(F.col("j.kind").alias("kind"), "event_id", F.explode("j.failed").alias("rule"))


# --- stores -----------------------------------------------------------------------------------

def _raw_closes(spark: SparkSession, sf: str) -> DataFrame:
    """Unmerged readings: many copies per (symbol, hour), ordered by event_id."""
    return A.table(spark, sf, "events").select(
        F.upper("event_type").alias("symbol"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("timestamp"),
        F.col("value").alias("close"), F.col("event_id").alias("ingest_seq"), "user_id")


@query("upsert_last_wins", """
  WITH raw AS (SELECT upper(event_type) AS symbol, date_trunc('hour', ts) AS timestamp, value AS close, event_id,
                      CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END AS batch FROM events)
  SELECT symbol, timestamp, max_by(close, batch * 1000000000000 + event_id) AS close FROM raw GROUP BY symbol, timestamp""")
def upsert_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    """A third of the readings arrives as a second batch and replaces what is stored."""
    raw = _raw_closes(spark, sf)
    key, late = ["symbol", "timestamp"], F.pmod("user_id", F.lit(3)) == 0
    stored = last_wins(raw.filter(~late).drop("user_id"), key, "ingest_seq")
    return tidy(merge_last_wins(stored.drop("ingest_seq"), raw.filter(late).drop("user_id"), key))


@query("store_range_read", """
  SELECT upper(event_type) AS symbol, date_trunc('hour', ts) AS timestamp, max_by(value, event_id) AS close FROM events
  WHERE date_trunc('hour', ts) BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 06:00:00' GROUP BY 1, 2""")
def store_range_read(spark: SparkSession, sf: str) -> DataFrame:
    from datetime import datetime, timezone

    rows = last_wins(_raw_closes(spark, sf).drop("user_id"), ["symbol", "timestamp"], "ingest_seq").drop("ingest_seq")
    return tidy(clip(rows, datetime(2024, 1, 5, tzinfo=timezone.utc), datetime(2024, 1, 12, 6, tzinfo=timezone.utc)))


@query("store_covered_range", with_ctes(CANDLES_HOURLY, CANDLES_DAILY, body="""
  SELECT exchange, symbol, timeframe, min(timestamp) AS first_timestamp, max(timestamp) AS last_timestamp
  FROM (SELECT * FROM candles UNION ALL SELECT * FROM daily) AS t GROUP BY exchange, symbol, timeframe"""))
def store_covered_range(spark: SparkSession, sf: str) -> DataFrame:
    both = A.candles_events(spark, sf).unionByName(A.candles_lineitem(spark, sf))
    return tidy(covered_range(both, ["exchange", "symbol", "timeframe"]))


@query("feature_store_upsert", """
  WITH f AS (SELECT upper(event_type) AS symbol, 'price.last' AS feature_name, date_trunc('hour', ts) AS timestamp,
                    value, CASE WHEN user_id % 4 = 0 THEN 'v2' ELSE 'v1' END AS version, event_id FROM events)
  SELECT symbol, feature_name, timestamp, max_by(value, event_id) AS value, version FROM f
  GROUP BY symbol, feature_name, timestamp, version""")
def feature_store_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Versions side by side; rows written without a version count as the first one."""
    version = F.when(F.pmod("user_id", F.lit(4)) == 0, "v2").when(F.pmod("user_id", F.lit(4)) == 1, "v1")
    values = _raw_closes(spark, sf).select(
        "symbol", F.lit("price.last").alias("feature_name"), "timestamp", F.col("close").alias("value"),
        version.alias("version"), "ingest_seq")
    rows = with_version(values)
    empty = rows.drop("ingest_seq").limit(0)
    return tidy(merge_last_wins(empty, rows, ["symbol", "feature_name", "timestamp", "version"]))


@query("feature_store_range", """
  WITH f AS (SELECT upper(event_type) AS symbol, date_trunc('hour', ts) AS timestamp,
                    value, CASE WHEN user_id % 4 = 0 THEN 'v2' ELSE 'v1' END AS version, event_id FROM events)
  SELECT symbol, 'price.last' AS feature_name, timestamp, max_by(value, event_id) AS value, version FROM f
  WHERE symbol = 'CLICK' AND version = 'v2' AND timestamp BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 06:00:00' GROUP BY ALL""")
def feature_store_range(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches written to a feature store, later rows last; read by symbol, version and range."""
    from datetime import datetime, timezone

    version = F.when(F.pmod("user_id", F.lit(4)) == 0, "v2").when(F.pmod("user_id", F.lit(4)) == 1, "v1")
    values = _raw_closes(spark, sf).select(
        F.lower("symbol").alias("symbol"), F.lit("price.last").alias("feature_name"), "timestamp", F.col("close").alias("value"),
        version.alias("version"), "ingest_seq")
    middle = values.agg(F.percentile_approx("ingest_seq", 0.5)).first()[0] or 0
    store = FeatureStore(spark, f"{shared_folder(spark)}/perpflow-features-{uuid.uuid4().hex}")
    for part in (values.filter(F.col("ingest_seq") <= middle), values.filter(F.col("ingest_seq") > middle)):
        store.write(part)
    return tidy(store.read(
        symbol="click", feature_name="price.last", version="v2",
        start=datetime(2024, 1, 5, tzinfo=timezone.utc), end=datetime(2024, 1, 12, 6, tzinfo=timezone.utc)))


@query("features_to_observations", rounded(with_ctes(CANDLES_HOURLY, body="""
  SELECT symbol, timestamp, 'v1' AS version, high, low, CASE WHEN close > 20 THEN close END AS close FROM candles"""), ["high", "low", "close"]))
def features_to_observations(spark: SparkSession, sf: str) -> DataFrame:
    """Long features back to wide observations; a feature that is absent is NULL."""
    bars = A.candles_events(spark, sf).withColumn("close", F.when(F.col("close") > 20, F.col("close")))
    names = {f"bar.{c}": c for c in ("high", "low", "close")}
    return tidy(observations_from_features(to_long(bars, "bar", ["high", "low", "close"]), names))


@query("latest_per_series", rounded(with_ctes(CANDLES_HOURLY, body="""
  SELECT symbol, max(timestamp) AS timestamp, max_by(close, timestamp) AS close, max_by(volume, timestamp) AS volume
  FROM candles GROUP BY symbol"""), ["close", "volume"]))
def latest_per_series(spark: SparkSession, sf: str) -> DataFrame:
    bars = observations(A.candles_events(spark, sf).withColumn("price", F.col("close")), "candle")
    full = A.candles_events(spark, sf).select("symbol", "timestamp", "close", "volume")
    newest = latest(full, ["symbol"], "timestamp").select("symbol", "timestamp", "close", "volume")
    return tidy(newest.join(bars.select("symbol").distinct(), "symbol", "left_semi"))


# --- gaps -------------------------------------------------------------------------------------

_RANGE = ("TIMESTAMP '2024-01-01 00:00:00'", "TIMESTAMP '2024-01-31 12:00:00'")
_MISSING_SQL = """keys AS (SELECT DISTINCT exchange, symbol FROM funding),
grid AS (SELECT exchange, symbol, unnest(generate_series({a}, {b}, INTERVAL 1 HOUR)) AS timestamp FROM keys),
missing AS (SELECT g.* FROM grid g ANTI JOIN {table} f ON g.exchange = f.exchange AND g.symbol = f.symbol AND g.timestamp = f.timestamp),
islands AS (SELECT exchange, symbol, min(timestamp) AS gap_start, max(timestamp) AS gap_end, count(*) AS missing FROM (
  SELECT *, epoch(timestamp)::BIGINT // 3600 - row_number() OVER (PARTITION BY exchange, symbol ORDER BY timestamp) AS island
  FROM missing) AS m GROUP BY exchange, symbol, island)"""


def _missing_sql(table: str = "funding") -> str:
    return _MISSING_SQL.format(a=_RANGE[0], b=_RANGE[1], table=table)


def _ranges(df: DataFrame) -> DataFrame:
    return df.select("exchange", "symbol").distinct().select(
        "exchange", "symbol", F.expr(_RANGE[0]).alias("range_start"), F.expr(_RANGE[1]).alias("range_end"))


@query("gap_islands", with_ctes(FUNDING, _missing_sql(), body="SELECT * FROM islands"))
def gap_islands(spark: SparkSession, sf: str) -> DataFrame:
    rows = stored(A.funding_events, spark, sf)
    return tidy(G.find_gaps(rows, _ranges(rows), ["exchange", "symbol"], HOURLY))


@query("gap_points", with_ctes(FUNDING, _missing_sql(), body="SELECT * FROM missing"))
def gap_points(spark: SparkSession, sf: str) -> DataFrame:
    rows = stored(A.funding_events, spark, sf)
    gaps = G.find_gaps(rows, _ranges(rows), ["exchange", "symbol"], HOURLY)
    return tidy(G.missing_points(gaps, ["exchange", "symbol"], HOURLY))


_STORED_SQL = """stored AS (SELECT * FROM funding WHERE date_part('hour', timestamp) % 4 <> 0),
landed AS (SELECT exchange, symbol, timestamp, funding_rate + 1 AS funding_rate FROM funding WHERE date_part('hour', timestamp) % 8 <> 4),
merged AS (SELECT * FROM stored UNION ALL
  SELECT l.* FROM landed l ANTI JOIN stored s ON l.exchange = s.exchange AND l.symbol = s.symbol AND l.timestamp = s.timestamp)"""


def _filled(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows, hour = stored(A.funding_events, spark, sf), F.hour("timestamp")
    held = rows.filter(F.pmod(hour, F.lit(4)) != 0)
    landed = rows.filter(F.pmod(hour, F.lit(8)) != 4).withColumn("funding_rate", F.col("funding_rate") + 1)
    return G.fill_gaps(held, landed, _ranges(rows), ["exchange", "symbol"], HOURLY)


@query("gap_fill_rows", rounded(with_ctes(FUNDING, _STORED_SQL, body="SELECT * FROM merged"), ["funding_rate"], 10))
def gap_fill_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Landed rows enter only where the store has a gap; stored readings stay."""
    return tidy(_filled(spark, sf)[0], 10)


@query("gap_fill_remaining", with_ctes(FUNDING, _STORED_SQL, _missing_sql("merged"), body="SELECT * FROM islands"))
def gap_fill_remaining(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(_filled(spark, sf)[1])


# --- synchronising a store -------------------------------------------------------------------

# For each record kind: its source, its columns, and what a landed copy says instead (a stored row must not take that over).
_SYNC = {
    "candle": (A.candles_events, CANDLES_HOURLY, "candles", {c: f"{c} + 1" for c in BAR}),
    "funding_rate": (A.funding_events, FUNDING, "funding", {"funding_rate": "funding_rate + 1"}),
    "open_interest": (A.open_interest_events, OPEN_INTEREST, "oi", {"open_interest": "open_interest + 1", "open_interest_value_usd": "open_interest + 2"}),
    "liquidation": (A.liquidation_events, LIQUIDATIONS, "liq", {c: f"{c} + 1" for c in L.FIELDS["liquidation"]}),
    "long_short_ratio": (A.ratio_events, RATIOS, "ratios", {"long_account_ratio": "short_account_ratio", "short_account_ratio": "long_account_ratio"}),
}


def _sync_ctes(kind: str) -> list[str]:
    _, cte, name, changed = _SYNC[kind]
    keys = ", ".join(series_keys(kind))
    own = ", ".join("open_interest AS open_interest_value_usd" if c == "open_interest_value_usd" else c for c in changed)
    return [cte, f"""stored AS (SELECT {keys}, timestamp, {own} FROM {name} WHERE hour(timestamp) % 4 <> 0),
landed AS (SELECT {keys}, timestamp, {', '.join(f'{v} AS {c}' for c, v in changed.items())} FROM {name} WHERE hour(timestamp) % 8 <> 4),
merged AS (SELECT * FROM stored UNION ALL SELECT * FROM landed l WHERE NOT EXISTS (
  SELECT 1 FROM stored s WHERE {' AND '.join(f's.{k} = l.{k}' for k in [*series_keys(kind), 'timestamp'])}))"""]


def _synced(kind: str, spark: SparkSession, sf: str) -> tuple[SeriesStore, SyncReport]:
    """A store without every fourth hour, synchronised from records without every eighth."""
    adapter, _, _, changed = _SYNC[kind]
    rows, hour = stored(adapter, spark, sf), F.hour("timestamp")
    if kind == "open_interest":
        rows = rows.withColumn("open_interest_value_usd", F.col("open_interest"))
    rows = rows.withColumn("ingest_seq", F.lit(0).cast("bigint"))
    store = SeriesStore(spark, f"{shared_folder(spark)}/perpflow-sync-{uuid.uuid4().hex}")
    store.write(kind, rows.filter(F.pmod(hour, F.lit(4)) != 0))
    landed = rows.filter(F.pmod(hour, F.lit(8)) != 4).withColumns({c: F.expr(v) for c, v in changed.items()})
    ranges = rows.groupBy(*series_keys(kind)).agg(F.min("timestamp").alias("range_start"), F.max("timestamp").alias("range_end"))
    return store, sync_store(store, kind, landed, ranges, HOURLY)


def _register_sync(kind: str) -> None:
    columns = list(_SYNC[kind][3])
    keys = ", ".join(series_keys(kind))

    @query(f"sync_{kind}", rounded(with_ctes(*_sync_ctes(kind), body=f"SELECT {keys}, timestamp, {', '.join(columns)} FROM merged"), columns, 4))
    def rows_after(spark: SparkSession, sf: str) -> DataFrame:
        """What the store holds afterwards: its own readings, and landed ones where it had none."""
        return tidy(_synced(kind, spark, sf)[0].read(kind).select(*series_keys(kind), "timestamp", *columns), 4)


for _kind in _SYNC:
    _register_sync(_kind)


_OPEN = """span AS (SELECT exchange, symbol, min(timestamp) AS a, max(timestamp) AS b FROM {name} GROUP BY exchange, symbol),
grid AS (SELECT exchange, symbol, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS timestamp FROM span),
missing AS (SELECT g.* FROM grid g ANTI JOIN merged f ON g.exchange = f.exchange AND g.symbol = f.symbol AND g.timestamp = f.timestamp)
SELECT '{kind}' AS kind, exchange, symbol, min(timestamp) AS gap_start, max(timestamp) AS gap_end, count(*) AS missing FROM (
  SELECT *, epoch(timestamp)::BIGINT // 3600 - row_number() OVER (PARTITION BY exchange, symbol ORDER BY timestamp) AS island FROM missing) AS m
GROUP BY exchange, symbol, island"""


def _open_sql(kind: str) -> str:
    return "SELECT * FROM (" + with_ctes(*_sync_ctes(kind), body=", " + _OPEN.format(kind=kind, name=_SYNC[kind][2])).replace("\n, span", ",\nspan") + ") AS t"


@query("sync_remaining", " UNION ALL ".join(_open_sql(kind) for kind in _SYNC))
def sync_remaining(spark: SparkSession, sf: str) -> DataFrame:
    """Gaps that stay open after synchronising, of all record kinds."""
    parts = [_synced(kind, spark, sf)[1].remaining.select(F.lit(kind).alias("kind"), "exchange", "symbol", "gap_start", "gap_end", "missing") for kind in _SYNC]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return tidy(whole)


# --- quality ----------------------------------------------------------------------------------

_RAW_FUNDING_SQL = """raw AS (SELECT concat('EX', user_id % 3) AS exchange,
    CASE WHEN user_id % 2 = 0 THEN 'AAAUSDT' ELSE 'BBBUSDT' END AS symbol, date_trunc('hour', ts) AS timestamp,
    CASE WHEN event_type <> 'error' THEN value END AS v FROM events)"""
_QUALITY_PARTS = """
  SELECT exchange, symbol, 'WARNING' AS severity, 'missing {v}' AS problem, timestamp, NULL::DOUBLE AS detail FROM raw WHERE v IS NULL
  UNION ALL
  SELECT exchange, symbol, 'ERROR', 'duplicate timestamp', timestamp, count(*)::DOUBLE FROM raw GROUP BY exchange, symbol, timestamp HAVING count(*) > 1
  UNION ALL
  SELECT exchange, symbol, 'WARNING', 'outlier {v}', timestamp, abs(z) FROM (
    SELECT r.*, (v - m) / nullif(sd, 0) AS z FROM raw r JOIN (
      SELECT exchange AS e, symbol AS s, avg(v) AS m, stddev_pop(v) AS sd, count(v) AS n FROM raw GROUP BY exchange, symbol) AS st
    ON e = exchange AND s = symbol WHERE n >= 2) AS o WHERE abs(z) > 3
  UNION ALL
  SELECT exchange, symbol, 'WARNING', 'gap', timestamp, us FROM (
    SELECT *, date_diff('microsecond', lag(timestamp) OVER (PARTITION BY exchange, symbol ORDER BY timestamp), timestamp)::DOUBLE AS us
    FROM raw) AS g WHERE us > 3600000000"""


@query("quality_series", rounded(with_ctes(_RAW_FUNDING_SQL, body=_QUALITY_PARTS.format(v="funding_rate")), ["detail"]))
def quality_series(spark: SparkSession, sf: str) -> DataFrame:
    """Raw readings (copies and NULLs included): missing, duplicates, outliers, gaps."""
    raw = _raw_by_exchange(spark, sf).withColumnRenamed("v", "funding_rate")
    report = quality.series_report(raw, ["exchange", "symbol"], "funding_rate", HOURLY, outlier_zscore=3.0, expected_interval="1h")
    return tidy(report)


def _raw_by_exchange(spark: SparkSession, sf: str) -> DataFrame:
    user = F.col("user_id")
    return A.table(spark, sf, "events").select(
        F.concat(F.lit("EX"), F.pmod(user, F.lit(3)).cast("string")).alias("exchange"),
        F.when(F.pmod(user, F.lit(2)) == 0, "AAAUSDT").otherwise("BBBUSDT").alias("symbol"),
        F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("timestamp"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("v"))


@query("quality_candles", rounded("""
  WITH raw AS (SELECT concat('P', l_partkey % 5) AS symbol, l_shipdate AS timestamp,
      CASE WHEN l_linenumber <> 7 THEN l_extendedprice / l_quantity END AS high,
      l_extendedprice / l_quantity * CASE WHEN l_orderkey % 50 = 0 THEN 2 ELSE 0.5 END AS low,
      l_extendedprice / l_quantity AS close FROM lineitem)
  SELECT symbol, 'WARNING' AS severity, 'missing candle' AS problem, timestamp, NULL::DOUBLE AS detail FROM raw WHERE high IS NULL
  UNION ALL SELECT symbol, 'ERROR', 'high below low', timestamp, NULL FROM raw WHERE high < low
  UNION ALL SELECT symbol, 'ERROR', 'duplicate timestamp', timestamp, count(*)::DOUBLE FROM raw GROUP BY symbol, timestamp HAVING count(*) > 1
  UNION ALL SELECT symbol, 'WARNING', 'outlier close', timestamp, abs(z) FROM (
    SELECT r.*, (close - m) / nullif(sd, 0) AS z FROM raw r JOIN (
      SELECT symbol AS s, avg(close) AS m, stddev_pop(close) AS sd FROM raw GROUP BY symbol) AS st ON s = symbol) AS o WHERE abs(z) > 1.65
  UNION ALL SELECT symbol, 'WARNING', 'gap', timestamp, us FROM (
    SELECT *, date_diff('microsecond', lag(timestamp) OVER (PARTITION BY symbol ORDER BY timestamp), timestamp)::DOUBLE AS us
    FROM raw) AS g WHERE us > 86400000000""", ["detail"]))
def quality_candles(spark: SparkSession, sf: str) -> DataFrame:
    price = F.col("l_extendedprice") / F.col("l_quantity")
    raw = A.table(spark, sf, "lineitem").select(
        F.concat(F.lit("P"), F.pmod("l_partkey", F.lit(5)).cast("string")).alias("symbol"),
        F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        F.when(F.col("l_linenumber") != 7, price).alias("high"),
        (price * F.when(F.pmod("l_orderkey", F.lit(50)) == 0, 2.0).otherwise(0.5)).alias("low"), price.alias("close"))
    return tidy(quality.candle_report(raw, ["symbol"], DAILY, outlier_zscore=1.65, expected_interval="1d"))


@query("quality_liquidity", rounded(with_ctes(_RAW_FUNDING_SQL.replace("raw AS", "base AS"), LIQUIDATIONS, body="""
  , raw AS (SELECT exchange, symbol, timestamp, v AS open_interest FROM base),
  src AS (SELECT 'open_interest' AS source, exchange, symbol, timestamp, open_interest AS v FROM raw
          UNION ALL SELECT 'liquidations', exchange, symbol, timestamp, long_liquidation_usd + short_liquidation_usd FROM liq)
  SELECT source, exchange, symbol, 'WARNING' AS severity, 'missing ' || source AS problem, timestamp, NULL::DOUBLE AS detail FROM src WHERE v IS NULL
  UNION ALL SELECT source, exchange, symbol, 'ERROR', 'duplicate timestamp', timestamp, count(*)::DOUBLE FROM src
    GROUP BY source, exchange, symbol, timestamp HAVING count(*) > 1
  UNION ALL SELECT source, exchange, symbol, 'WARNING', 'gap', timestamp, us FROM (
    SELECT *, date_diff('microsecond', lag(timestamp) OVER (PARTITION BY source, exchange, symbol ORDER BY timestamp), timestamp)::DOUBLE AS us
    FROM src) AS g WHERE us > 7200000000
  UNION ALL SELECT source, NULL, symbol, 'WARNING', 'outlier ' || source, timestamp, abs(z) FROM (
    SELECT r.*, (v - m) / nullif(sd, 0) AS z FROM src r JOIN (
      SELECT source AS so, symbol AS s, avg(v) AS m, stddev_pop(v) AS sd FROM src GROUP BY source, symbol) AS st
    ON so = source AND s = symbol) AS o WHERE abs(z) > 3""".replace("\n  , raw", ", raw", 1)), ["detail"]))
def quality_liquidity(spark: SparkSession, sf: str) -> DataFrame:
    sources = {
        "open_interest": _raw_by_exchange(spark, sf).withColumnRenamed("v", "open_interest"),
        "liquidations": A.liquidation_events(spark, sf),
    }
    return tidy(quality.liquidity_report(sources, HOURLY, outlier_zscore=3.0, expected_interval=7_200_000_000))


_SELECTED = ["EX0", "EX2", "EX7", "NOWHERE"]


@query("quality_unknown_exchanges", with_ctes(LIQUIDATIONS, body=f"""
  SELECT e AS exchange, 'WARNING' AS severity, 'exchange not observed' AS problem FROM (SELECT unnest({_SELECTED}) AS e) AS s
  WHERE e NOT IN (SELECT exchange FROM liq WHERE exchange IS NOT NULL UNION SELECT concat('EX', user_id % 2) FROM events)"""))
def quality_unknown_exchanges(spark: SparkSession, sf: str) -> DataFrame:
    """Selected exchanges that neither of two inputs contains."""
    other = A.table(spark, sf, "events").select(F.concat(F.lit("EX"), F.pmod("user_id", F.lit(2)).cast("string")).alias("exchange"))
    return quality.unknown_exchanges(_SELECTED, [A.liquidation_events(spark, sf), other])
