"""Pinned semantics of features and analyses."""

import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from perpflow.operators.dedupe import UNIQUE
from perpflow.functions.numeric import bias, long_short_ratio
from perpflow.operators import features as M, level_analysis as LA, liquidity as LQ, premium_discount as PD, quality
from perpflow.operators.chunks import Grid

GRID = Grid("1h", 7, 3)


def funding(spark, hour, values, symbol="btcusdt"):
    rows = [(symbol, hour(i), v, i) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "symbol string, timestamp timestamp, funding_rate double, seq bigint")


def test_full_window_gate(spark, hour):
    rows = [("SIM", "A", "1h", hour(i), 1.0, 2.0, 0.5, 1.0, 1.0) for i in range(3)]
    df = spark.createDataFrame(rows, "exchange string, symbol string, timeframe string, timestamp timestamp, open double, high double, low double, close double, volume double")
    names = {r.feature_name for r in M.compute_features([M.price_module()], {"price": df}, ["symbol"], GRID).collect()}
    assert "price.atr_14" not in names and {"price.true_range", "price.ema_20"} <= names


def test_range_pct_and_first_true_range(spark, hour):
    df = spark.createDataFrame([("A", hour(0), 110.0, 90.0, 100.0)], "symbol string, timestamp timestamp, high double, low double, close double")
    got = {r.feature_name: r.value for r in M.compute_features([M.price_module()], {"price": df}, ["symbol"], GRID).collect()}
    assert got["price.high_low_range_pct"] == 0.2 and got["price.true_range"] == 20.0


def test_features_persist_and_validate(spark, hour, tmp_path):
    from perpflow.sources.store import FeatureStore

    store = FeatureStore(spark, str(tmp_path))
    run = M.run_features([M.funding_module()], {"funding_standard": funding(spark, hour, [0.1] * 40)}, ["symbol"], GRID, store)
    assert run.is_valid() and store.read().count() == run.features.count()
    assert M.run_features([M.price_module()], {}, ["symbol"], GRID, store).features is None


def test_infinite_ratio_empties_its_windows(spark, hour):
    rows = [("A", hour(i), 1.0 if i == 5 else 0.6, 0.0 if i == 5 else 0.4) for i in range(20)]
    df = spark.createDataFrame(rows, "symbol string, timestamp timestamp, long_account_ratio double, short_account_ratio double")
    module = M.long_short_module(sma=4, zscore=4)
    got = M.compute_features([module], {module.name: df}, ["symbol"], GRID)
    sma = [r.timestamp.hour for r in got.filter("feature_name LIKE '%sma_4'").orderBy("timestamp").collect()]
    assert sma == [3, 4, *range(9, 20)]


def test_scalar_formulas(spark):
    df = spark.createDataFrame([(150.0, 50.0), (0.0, 0.0), (1.0, 0.0)], "l double, s double")
    assert [r.b for r in df.select(bias(F.col("l"), F.col("s")).alias("b")).collect()] == [0.5, None, 1.0]
    row = df.filter("l = 1").select(long_short_ratio(F.col("l"), F.col("s")).alias("a"), long_short_ratio(F.col("l"), F.col("s"), infinite=True).alias("b")).first()
    assert row.a is None and row.b == float("inf")


@pytest.mark.parametrize("n", [1, 2, 3, 9, 50])
def test_funding_matches_direct_statistics(spark, hour, n):
    rng = np.random.default_rng(n)
    values = [float(v) for v in rng.normal(0, 1e-4, n)]
    row = LA.funding_latest(funding(spark, hour, values), seq=UNIQUE).first()
    last = LA.funding_series(funding(spark, hour, values), GRID, seq=UNIQUE).orderBy(F.desc("as_of")).first()
    assert row.as_of == last.as_of
    assert {k: v for k, v in row.asDict().items() if k != "as_of"} == pytest.approx({k: v for k, v in last.asDict().items() if k != "as_of"})
    w8, w30 = values[-8:], values[-30:]
    assert (row.symbol, row.sample_size, row.confidence_level) == ("BTCUSDT", n, min(n / 30, 1.0))
    if n < 2:
        assert row.funding_trend == row.funding_momentum == "UNKNOWN" and row.funding_volatility is None
        return
    assert row.funding_trend_value == pytest.approx(np.polyfit(range(len(w8)), w8, 1)[0])
    half = len(w8) // 2
    assert row.funding_momentum_value == pytest.approx(statistics.mean(w8[half:]) - statistics.mean(w8[:half]))
    assert row.funding_volatility == pytest.approx(statistics.stdev(w30))
    assert row.historical_average == pytest.approx(statistics.mean(values))


def test_cleaning_then_last_copy(spark, hour):
    rows = [("A", hour(0), 1.0, 1), ("A", hour(0), 2.0, 2), ("A", hour(0), None, 3), ("A", hour(1), None, 4)]
    df = spark.createDataFrame(rows, "symbol string, timestamp timestamp, funding_rate double, seq bigint")
    row = LA.funding_latest(df, seq="seq").first()
    assert (row.current_funding, row.sample_size) == (2.0, 1)
    empty = spark.createDataFrame([("B", hour(0), None, 1)], df.schema)
    assert LA.funding_latest(empty, seq="seq").count() == 0
    assert LA.skipped(df.unionByName(empty), ["symbol"], F.col("funding_rate").isNotNull()).first().symbol == "B"


def test_flat_series_and_spike(spark, hour):
    flat = LA.funding_latest(funding(spark, hour, [0.5] * 20), seq=UNIQUE).first()
    assert flat.funding_trend == flat.funding_momentum == "FLAT"
    values = [100.0, 101.0, 103.0, 104.0, 150.0]
    df = funding(spark, hour, values).withColumnRenamed("funding_rate", "open_interest")
    row = LA.open_interest_latest(df, config=LA.LevelConfig(spike_window=30, spike_zscore_threshold=2.0), source="binance", seq=UNIQUE).first()
    changes = [1.0, 2.0, 1.0]
    assert row.spike_magnitude == pytest.approx((46 - statistics.mean(changes)) / statistics.stdev(changes))
    assert row.is_abnormal_spike is True and row.source == "binance"
    assert LA.open_interest_latest(df, seq=UNIQUE).first().is_abnormal_spike is None


def candles(spark, hour, rows):
    return spark.createDataFrame([("a", hour(i), float(h), float(low), float(c)) for i, (h, low, c) in enumerate(rows)],
                                 "symbol string, timestamp timestamp, high double, low double, close double")


def test_range_uses_all_swings(spark, hour):
    highs = [10, 11, 15, 11, 10, 11, 13, 11, 10, 10]
    lows = [5, 4, 6, 5, 2, 5, 6, 3, 4, 5]
    df = candles(spark, hour, [(h, low, (h + low) / 2) for h, low in zip(highs, lows)])
    row = PD.range_latest(df, label="4h", seq=UNIQUE).first()
    assert (row.active_high, row.active_low, row.timeframe, row.sample_size) == (15.0, 2.0, "4h", 10)
    assert row.confidence_level == 0.2 and row.zone == "DISCOUNT"
    assert PD.range_latest(candles(spark, hour, [(10, 5, 7)] * 10), seq=UNIQUE).count() == 0


@pytest.mark.parametrize("close,zone,premium,discount", [
    (12.0, "ABOVE_RANGE", 140.0, 0.0), (-1.0, "BELOW_RANGE", 0.0, 120.0), (5.0, "EQUILIBRIUM", 0.0, 0.0), (7.5, "PREMIUM", 50.0, 0.0), (2.5, "DISCOUNT", 0.0, 50.0)])
def test_zones(spark, hour, close, zone, premium, discount):
    df = candles(spark, hour, [(10, 0, 5), (8, 2, close)])
    row = PD.range_latest(df, config=PD.RangeConfig(method="EXTREMUM"), seq=UNIQUE).first()
    assert (row.zone, row.premium_percentage, row.discount_percentage) == (zone, premium, discount)


def liq(spark, hour, rows):
    return spark.createDataFrame([("a", hour(h), e, l, s) for h, e, l, s in rows], "symbol string, timestamp timestamp, exchange string, long_liquidation_usd double, short_liquidation_usd double")


def test_liquidity_minimum(spark, hour):
    rows = [(0, "X", 10.0, 30.0), (0, "Y", 5.0, 5.0), (1, "X", 1.0, None), (2, "Y", 20.0, 0.0)]
    row = LQ.liquidity_latest(LQ.LiquidityInputs(liq(spark, hour, rows)), LQ.LiquidityConfig(analysis_window=5, spike_window=10), seq=UNIQUE).first()
    assert (row.long_liquidation_volume, row.short_liquidation_volume, row.liquidation_event_count) == (35.0, 35.0, 2)
    assert row.liquidation_bias == 0.0 and row.confidence_level == 0.2 and row.long_short_ratio is None
    assert row.exchange_liquidation_totals == {"X": 40.0, "Y": 30.0}
    only_y = LQ.liquidity_latest(LQ.LiquidityInputs(liq(spark, hour, rows)), LQ.LiquidityConfig(exchanges=("Y",)), seq=UNIQUE).first()
    assert only_y.exchange_liquidation_totals == {"Y": 30.0}


def test_position_bias_decides_even_when_undefined(spark, hour):
    ratio = "symbol string, timestamp timestamp, exchange string, long_account_ratio double, short_account_ratio double"
    account = spark.createDataFrame([("a", hour(0), "X", 0.6, 0.4)], ratio)
    position = spark.createDataFrame([("a", hour(0), "X", 0.0, 0.0)], ratio)
    base = liq(spark, hour, [(0, "X", 1.0, 1.0)])
    both = LQ.liquidity_latest(LQ.LiquidityInputs(base, top_trader_account_ratio=account, top_trader_position_ratio=position), seq=UNIQUE).first()
    assert both.top_trader_account_bias == pytest.approx(0.2) and both.top_trader_bias is None
    one = LQ.liquidity_latest(LQ.LiquidityInputs(base, top_trader_account_ratio=account), seq=UNIQUE).first()
    assert one.top_trader_bias == pytest.approx(0.2)


def test_quality_sees_raw_rows(spark, hour):
    rows = [("a", hour(0), 1.0), ("a", hour(0), None), ("a", hour(3), 1.0)]
    df = spark.createDataFrame(rows, "symbol string, timestamp timestamp, funding_rate double")
    report = quality.series_report(df, ["symbol"], "funding_rate", GRID, expected_interval="1h")
    assert sorted(r.problem for r in report.collect()) == ["duplicate timestamp", "gap", "missing funding_rate"]
    naive = df.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    assert quality.series_report(naive, ["symbol"], "funding_rate", Grid("1h")).where("problem = 'naive timestamp'").count() == 3
    other = spark.createDataFrame([("OKX",)], "exchange string")
    assert [r.exchange for r in quality.unknown_exchanges(("OKX", "BYBIT"), [other]).collect()] == ["BYBIT"]


@pytest.mark.parametrize("make", [
    lambda: LA.LevelConfig(trend_window=1), lambda: LA.LevelConfig(historical_window=0), lambda: PD.RangeConfig(lookback=4),
    lambda: PD.RangeConfig(midpoint_ratio=1.5), lambda: PD.RangeConfig(method="X"), lambda: LQ.LiquidityConfig(analysis_window=1),
    lambda: LQ.LiquidityConfig(exchanges=()), lambda: LQ.LiquidityConfig(aggregation="MAX")])
def test_bad_settings(make):
    with pytest.raises(ValueError):
        make()
