"""Frames by blocks against plain sliding windows."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import Window as W, functions as F

from conftest import T0
from perpflow.operators import features as FT, level_analysis as LA, premium_discount as PD, wide_frames as WF
from perpflow.operators.chunks import Grid
from perpflow.operators.dedupe import UNIQUE


@pytest.fixture(scope="module")
def series(spark):
    """One dense, one sparse and one flat series; some values missing."""
    rng, rows = random.Random(5), []
    for key, n, gap in (("a", 700, 1), ("b", 300, 97), ("c", 150, 3)):
        at = 0
        for i in range(n):
            at += rng.choice([gap, gap, gap * 3])
            value = 7.0 if key == "c" and i > 60 else 1e6 + rng.random()
            rows.append((key, T0 + timedelta(hours=at), None if rng.random() < 0.02 else value))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, timestamp timestamp, x double").repartition(5).cache()


def plain(df, name, kind, n, shift=0):
    over = W.partitionBy("k").orderBy("timestamp")
    frame = over.rowsBetween(-(n - 1) - shift, -shift)
    at = F.row_number().over(over).cast("double")
    x = F.col("x")
    enough = F.count(x).over(frame) >= 2
    column = {
        "count": F.count(x).over(frame), "sum": F.sum(x).over(frame), "mean": F.avg(x).over(frame), "max": F.max(x).over(frame),
        "min": F.min(x).over(frame), "std": F.when(enough, F.stddev_samp(x).over(frame)), "slope": None,
    }[kind]
    if kind == "slope":
        return df.withColumn("_at", at).withColumn(name, F.when(enough, F.regr_slope(x, F.col("_at")).over(frame))).drop("_at")
    return df.withColumn(name, column)


@pytest.mark.parametrize("width,shift", [(1, 0), (5, 1), (100, 3), (1000, 0)])
def test_every_statistic_matches_sliding_frames(spark, series, width, shift):
    kinds = ["count", "sum", "mean", "max", "min", "std", "slope"]
    rolls = {k: WF.Roll(k, F.col("x"), width, shift=shift) for k in kinds}
    got = {(r.k, r.timestamp): r for r in WF.roll(series, ["k"], "timestamp", Grid("1h", 128), rolls).collect()}
    want = series
    for k in kinds:
        want = plain(want, k, k, width, shift)
    rows = want.collect()
    assert len(got) == len(rows)
    for w in rows:
        g = got[(w.k, w.timestamp)]
        for k in kinds:
            near = pytest.approx(w[k], rel=1e-9, abs=1e-7) if w[k] is not None else None
            if k == "count":
                assert g[k] in (w[k], None if shift else w[k])
            else:
                assert g[k] == near, (w.k, w.timestamp, k)


def test_flat_stretch_has_no_spread(spark, series):
    rolls = {"s": WF.Roll("std", F.col("x"), 80, full=True)}
    flat = WF.roll(series.where("x IS NOT NULL"), ["k"], "timestamp", Grid("1h", 128), rolls).where("k = 'c'").orderBy("timestamp").collect()
    assert flat[-1].s == 0.0 and flat[5].s is None


@pytest.mark.parametrize("relative", [False, True])
def test_level_analysis_alike_with_wide_and_sliding_frames(spark, series, monkeypatch, relative):
    config = LA.LevelConfig(trend_window=90, volatility_window=120, spike_window=100, historical_window=200, spike_zscore_threshold=2.0)
    df = series.withColumn("n", F.lit(1))
    call = lambda f, *a: f(df, ["k"], "x", *a, config, seq=UNIQUE, relative=relative)
    wide, wide_last = call(LA.analyze_series, Grid("1h", 128)), call(LA.analyze_latest)
    wide, wide_last = wide.collect(), wide_last.collect()
    for module in (LA, PD):
        monkeypatch.setattr(module, "NARROW", 10**9)
    want = {(r.k, r.timestamp): r for r in call(LA.analyze_series, Grid("1h", 128)).collect()}
    assert len(want) == len(wide) and len(wide_last) == 3
    for r in wide + wide_last:
        w = want[(r.k, r.timestamp)]
        assert set(r.asDict()) == set(w.asDict())
        for name, value in w.asDict().items():
            if name == "spike_magnitude" and value is not None and abs(value) > 1e6:
                continue
            # The slope of a flat stretch may be a rounding error instead of zero; its direction allows for that.
            assert r[name] == (pytest.approx(value, rel=1e-6, abs=1e-7) if isinstance(value, float) else value) or name == "trend", name


@pytest.mark.parametrize("method", ["FRACTAL", "EXTREMUM"])
def test_range_alike_with_wide_and_sliding_frames(spark, series, monkeypatch, method):
    bars = series.where("x IS NOT NULL").select(
        F.col("k").alias("symbol"), "timestamp", (F.col("x") + F.rand(3)).alias("high"), (F.col("x") - F.rand(4)).alias("low"), F.col("x").alias("close")).cache()
    config = PD.RangeConfig(method=method, lookback=150)
    take = lambda: (sorted(PD.range_series(bars, Grid("1h", 128), config=config, seq=UNIQUE).collect()),
                    sorted(PD.range_latest(bars, config=config, seq=UNIQUE).collect()))
    wide = take()
    monkeypatch.setattr(PD, "NARROW", 10**9)
    assert wide == take() and len(wide[0]) > 500


def test_feature_modules_alike_with_wide_and_sliding_frames(spark, series, monkeypatch):
    bars = series.where("x IS NOT NULL").select(
        F.col("k").alias("symbol"), "timestamp", (F.col("x") + F.rand(3)).alias("high"), (F.col("x") - F.rand(4)).alias("low"),
        F.col("x").alias("close"), F.col("x").alias("funding_rate"))
    bars = bars.cache()
    take = lambda: [{(r.symbol, r.timestamp): r for r in m.wide(bars, ["symbol"], Grid("1h", 128)).collect()}
                    for m in (FT.price_module(sma=100, volatility=90), FT.price_module(atr=70, ema_span=30), FT.funding_module(sma=8, zscore=80))]
    wide = take()
    monkeypatch.setattr(FT, "NARROW", 10**9)
    for a, b in zip(wide, take(), strict=True):
        assert a.keys() == b.keys()
        for key, w in b.items():
            for name, value in w.asDict().items():
                assert a[key][name] == (pytest.approx(value, rel=1e-6, abs=1e-9) if isinstance(value, float) else value), name


def test_a_dense_stretch_is_dealt_over_tasks(spark, monkeypatch):
    """All rows in one second: numbered rightly, in ranges and chunks that no task takes whole."""
    monkeypatch.setattr(WF, "TASK_ROWS", 500)
    rows = spark.range(0, 6000, 1, 3).select(
        F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("k"), F.timestamp_micros(F.lit(10**15) + (F.col("id") * 7919) % 6000).alias("timestamp"), F.col("id").cast("double").alias("x"))
    got = WF.numbered(rows, ["k"], "timestamp")
    plain = F.row_number().over(W.partitionBy("k").orderBy("timestamp")) - 1
    assert got.withColumn("n", plain).filter(F.col("n") != F.col(WF.IDX)).count() == 0 and got.count() == 6000
    placed = WF.chunked_by_number(got, ["k"], 20, 100)
    most = placed.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert placed.rdd.getNumPartitions() >= 12 and most < 2000


def test_lent_rows_count_as_rows_of_a_task(spark, monkeypatch):
    """A lead-in as long as the chunk doubles the rows, and so the tasks."""
    assert WF.TASK_ROWS <= 1 << 15
    monkeypatch.setattr(WF, "TASK_ROWS", 500)
    rows = spark.range(6000).select(F.lit("a").alias("k"), F.col("id").alias(WF.IDX))
    placed = WF.chunked_by_number(rows, ["k"], 50, 50)
    assert placed.count() == 12000 and placed.rdd.getNumPartitions() >= 24
