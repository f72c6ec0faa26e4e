"""Payload mapping: values, units, and why a record is refused."""

import json

import pytest
from pyspark.errors import PySparkException

from perpflow.sources import landing as L

MS = 1_704_067_200_000


def payloads(spark, *data, exchange="binance"):
    rows = [(exchange, " btcusdt ", "1h", d if isinstance(d, str) else json.dumps({"code": "0", "data": d})) for d in data]
    return spark.createDataFrame(rows, "exchange string, symbol string, timeframe string, payload string")


def test_candles(spark):
    good, bad = L.map_candles(payloads(spark, [{"time": MS, "open": "100", "high": 110, "low": 90.5, "close": 105, "volume_usd": "7.5", "x": 1}]))
    (r,) = good.collect()
    assert (r.exchange, r.symbol, r.timeframe, r.open, r.low, r.volume) == ("BINANCE", "BTCUSDT", "1h", 100.0, 90.5, 7.5)
    assert r.timestamp.isoformat() == "2024-01-01T00:00:00" and bad.count() == 0


def test_candle_rules(spark):
    base = {"time": MS, "open": 100, "high": 110, "low": 90, "close": 105, "volume_usd": 1}
    _, bad = L.map_candles(payloads(spark, [base | {"high": 101}, base | {"low": 102}, base | {"volume_usd": -1}, base | {"close": "NaN"}]))
    reasons = sorted(r.reason for r in bad.collect())
    assert len(reasons) == 4 and sum("high not the maximum" in r for r in reasons) >= 1


@pytest.mark.parametrize("payload,reason", [
    ('{"code":"0"}', "payload has no list of data"),
    ('{"data":{"time":1}}', "payload has no list of data"),
    ("not json", "payload has no list of data"),
    ([5], "item is not an object"),
    ([{"time": MS}], "missing field: close"),
    ([{"time": MS, "close": "abc"}], "not a number: close"),
    ([{"time": MS, "close": None}], "not a number: close"),
    ([{"time": "soon", "close": 1}], "not an epoch in milliseconds: time"),
])
def test_reject_reasons(spark, payload, reason):
    good, bad = L.map_funding_rates(payloads(spark, payload))
    assert good.count() == 0 and [r.reason for r in bad.collect()] == [reason]


def test_one_bad_item_does_not_lose_the_others(spark):
    good, bad = L.map_funding_rates(payloads(spark, [{"time": MS, "close": 0.1}, {"time": MS + 1}], []))
    assert (good.count(), bad.count()) == (1, 1)


def test_failfast(spark):
    good, _ = L.map_funding_rates(payloads(spark, [{"time": MS}]), mode="failfast")
    with pytest.raises(PySparkException, match="missing field"):
        good.collect()


def test_open_interest_fills_both_columns(spark):
    r = L.map_open_interest(payloads(spark, [{"time": MS, "close": "5"}]), L.AGGREGATED)[0].first()
    assert (r.exchange, r.open_interest, r.open_interest_value_usd) == ("AGGREGATED", 5.0, 5.0)


@pytest.mark.parametrize("source", list(L.RATIO_FIELDS))
def test_percentages_become_shares(spark, source):
    long, short = L.RATIO_FIELDS[source]
    rows = [{"time": MS, long: 60, short: 40}, {"time": MS + 1, long: 0.6, short: 0.4}, {"time": MS + 2, long: 0.6, short: 0.6}]
    good, bad = L.map_long_short_ratios(payloads(spark, rows), long, short)
    assert {(r.long_account_ratio, r.short_account_ratio) for r in good.collect()} == {(0.6, 0.4)}
    assert "ratios do not sum to one" in bad.first().reason


def test_supported_markets(spark):
    pair = {"instrument_id": "btc_usdt", "base_asset": "btc", "quote_asset": "usdt"}
    df = spark.createDataFrame([(json.dumps({"data": {"binance": [pair, 3, {"base_asset": "x"}], "okx": {}}}),), ("[]",)], "payload string")
    good, bad = L.map_supported_markets(df)
    assert [tuple(r) for r in good.collect()] == [("BINANCE", "BTC_USDT", "BTC", "USDT")]
    assert sorted(r.reason for r in bad.collect()) == [
        "exchange has no list of pairs", "missing field: instrument_id", "pair is not an object", "payload has no map of data"]


def test_landed_files_keep_the_order_of_their_events(spark, tmp_path):
    from datetime import datetime, timedelta

    from perpflow.plans import market

    start, n = datetime(2024, 1, 1), 400
    rows = [(i, start + timedelta(seconds=i), i, ["a", "b", None][i % 3], float(i)) for i in reversed(range(n))]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    events.repartition(7).write.parquet(str(tmp_path / "events.parquet"))
    landed = {(r.symbol, r.line): r.timestamp for r in market.land_files_records(spark, str(tmp_path)).collect()}
    for k, name in enumerate("AB"):
        ids = range(k, n, 3)
        assert {line: at for (s, line), at in landed.items() if s == name} == {
            line: start + timedelta(seconds=i) for line, i in enumerate(ids, 1) if i % 7 > 4}
