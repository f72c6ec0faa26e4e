"""Stores on disk: last-wins upserts, ranges, versions, legacy files; streams into them."""

import re
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from perpflow.operators.chunks import Grid
from perpflow.operators.gaps import fill_gaps, find_gaps, missing_points
from perpflow.schema import CANDLE, FEATURE_VALUE
from perpflow.sources.store import FeatureStore, SeriesStore, history, observations_from_features
from perpflow.streaming.streams import SignalLedger, flag_signal_stream, stream_into_store


def candles(spark, hour, rows):
    """(hour, close, seq)"""
    full = [("binance", "btcusdt", "1h", hour(h), c, c + 1, c - 1, float(c), 1.0, s) for h, c, s in rows]
    return spark.createDataFrame(full, CANDLE.simpleString()[7:-1].replace(":", " ") + ", ingest_seq bigint")


def test_last_wins_within_and_across_batches(spark, hour, tmp_path):
    store = SeriesStore(spark, str(tmp_path))
    store.write("candle", candles(spark, hour, [(0, 100.0, 1), (0, 150.0, 2), (1, 101.0, 3)]))
    store.write("candle", candles(spark, hour, [(0, 200.0, 0), (800, 5.0, 1)]))
    rows = store.read("candle", exchange="Binance", symbol="BTCUSDT", timeframe="1h").orderBy("timestamp").collect()
    assert [(r.exchange, r.close) for r in rows] == [("BINANCE", 200.0), ("BINANCE", 101.0), ("BINANCE", 5.0)]


def test_upsert_leaves_other_months_alone(spark, hour, tmp_path):
    store = SeriesStore(spark, str(tmp_path))
    store.write("candle", candles(spark, hour, [(0, 1.0, 1), (800, 2.0, 1)]))
    january = list(tmp_path.glob("candle/*/*/*/period=2024-01/*.parquet"))
    store.write("candle", candles(spark, hour, [(801, 3.0, 1)]))
    assert list(tmp_path.glob("candle/*/*/*/period=2024-01/*.parquet")) == january
    assert store.read("candle").count() == 3


def test_range_is_inclusive_and_pruned(spark, hour, tmp_path):
    store = SeriesStore(spark, str(tmp_path))
    assert store.read("candle", symbol="none").count() == 0
    store.write("candle", candles(spark, hour, [(h, float(h), 1) for h in range(0, 2000, 100)]))
    df = store.read("candle", symbol="btcusdt", start=hour(100), end=hour(300))
    assert sorted(r.close for r in df.collect()) == [100.0, 200.0, 300.0]
    plan = df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    (partition,) = re.findall(r"PartitionFilters: \[(.*)\]", plan)
    (pushed,) = re.findall(r"PushedFilters: \[(.*)\]", plan)
    assert "symbol" in partition and "period" in partition and "GreaterThanOrEqual(timestamp" in pushed
    covered = store.covered("candle").first()
    assert (covered.first_timestamp, covered.last_timestamp) == (hour(0).replace(tzinfo=None), hour(1900).replace(tzinfo=None))


def test_history_never_looks_ahead(spark, hour):
    df, step = points(spark, hour, range(10)), timedelta(hours=1)
    assert history(df, hour(5), step, periods=2).count() == 3
    assert [r.v for r in history(df, hour(5), step, start=hour(8)).collect()] == [5.0]
    assert history(df, hour(5), step).count() == 6


def feature(spark, hour, rows):
    full = [("btcusdt", n, hour(h), v, ver, s) for n, h, v, ver, s in rows]
    return spark.createDataFrame(full, "symbol string, feature_name string, timestamp timestamp, value double, version string, ingest_seq bigint")


def test_versions_live_side_by_side(spark, hour, tmp_path):
    store = FeatureStore(spark, str(tmp_path / "f"))
    store.write(feature(spark, hour, [("atr_14", 0, 1.0, "v1", 1), ("atr_14", 0, 2.0, "v2", 2)]))
    store.write(feature(spark, hour, [("atr_14", 0, 99.0, None, 1)]))
    rows = {r.version: r.value for r in store.read(symbol="BTCUSDT", feature_name="atr_14").collect()}
    assert rows == {"v1": 99.0, "v2": 2.0}
    assert store.read(version="v2").count() == 1


def test_files_without_a_version_belong_to_v1(spark, hour, tmp_path):
    path = str(tmp_path / "f")
    old = feature(spark, hour, [("x", 0, 7.0, "v1", 1)]).drop("version", "ingest_seq").withColumn("symbol", F.upper("symbol"))
    old.withColumn("period", F.lit("2024-01")).write.partitionBy("feature_name", "symbol", "period").parquet(path)
    store = FeatureStore(spark, path)
    assert [r.version for r in store.read().collect()] == ["v1"]
    store.write(feature(spark, hour, [("x", 0, 8.0, "v1", 1)]))
    assert [(r.version, r.value) for r in store.read().collect()] == [("v1", 8.0)]


def test_features_back_to_observations(spark, hour):
    df = spark.createDataFrame([("A", "f.x", hour(0), 1.0, "v1"), ("A", "f.y", hour(0), 2.0, "v1"), ("A", "f.x", hour(1), 3.0, "v1")], FEATURE_VALUE)
    rows = observations_from_features(df, {"f.x": "x", "f.y": "y"}).orderBy("timestamp").collect()
    assert [(r.x, r.y) for r in rows] == [(1.0, 2.0), (3.0, None)]


# --- gaps -------------------------------------------------------------------------------------

def points(spark, hour, hours, keys=("a",)):
    return spark.createDataFrame([(k, hour(h), float(h)) for k in keys for h in hours], "k string, timestamp timestamp, v double")


def span(spark, hour, a, b, keys=("a",)):
    return spark.createDataFrame([(k, hour(a), hour(b)) for k in keys], "k string, range_start timestamp, range_end timestamp")


@pytest.mark.parametrize("chunk", [2, 7, 100])
def test_gap_edges_and_off_grid_rows(spark, hour, chunk):
    rows = points(spark, hour, [-3, 1, 2, 4.5, 6, 6, 30])
    grid = Grid("1h", chunk, 2)
    gaps = find_gaps(rows, span(spark, hour, 0, 10.5), ["k"], grid)
    got = [((r.gap_start - hour(0).replace(tzinfo=None)) / timedelta(hours=1), r.missing) for r in gaps.orderBy("gap_start").collect()]
    assert got == [(0, 1), (3, 3), (7, 4)]
    assert missing_points(gaps, ["k"], grid).count() == 8


def test_series_without_rows_is_one_gap(spark, hour):
    gaps = find_gaps(points(spark, hour, [1]), span(spark, hour, 0, 5, ("a", "b")), ["k"], Grid("1h", 3, 2))
    assert {(r.k, r.missing) for r in gaps.collect()} == {("a", 1), ("a", 4), ("b", 6)}


def test_only_missing_rows_are_filled(spark, hour):
    stored, landed = points(spark, hour, [0, 1, 5]), points(spark, hour, [1, 2, 4, 9]).withColumn("v", F.col("v") + 100)
    merged, left = fill_gaps(stored, landed, span(spark, hour, 0, 6), ["k"], Grid("1h", 2, 2))
    assert [r.v for r in merged.orderBy("timestamp").collect()] == [0.0, 1.0, 102.0, 104.0, 5.0]
    assert sum(r.missing for r in left.collect()) == 2


# --- streams ----------------------------------------------------------------------------------

def test_candle_stream_over_several_batches(spark, hour, tmp_path):
    source, schema = str(tmp_path / "in"), candles(spark, hour, [(0, 1.0, 1)]).schema
    store = SeriesStore(spark, str(tmp_path / "store"))

    def land(rows):
        candles(spark, hour, rows).coalesce(1).write.mode("append").parquet(source)
        stream_into_store(spark.readStream.schema(schema).parquet(source), store, str(tmp_path / "cp")).awaitTermination()

    land([(0, 1.0, 1), (0, 2.0, 2)])
    land([(1, 5.0, 1), (0, 3.0, 1)])
    assert [r.close for r in store.read("candle").orderBy("timestamp").collect()] == [3.0, 5.0]


def test_signal_stream_equals_batch(spark, hour, tmp_path):
    schema = "symbol string, as_of timestamp, score_version string, arrival bigint"
    rows = [("A", 1, 1), ("A", 3, 2), ("A", 2, 3), ("B", 1, 4), ("A", 3, 5), ("B", 2, 6), ("A", 4, 7), ("B", 2, 8)]
    source = str(tmp_path / "in")
    ledger = SignalLedger(spark, str(tmp_path / "ledger"))
    for part in (rows[:3], rows[3:5], rows[5:]):
        spark.createDataFrame([(s, hour(h), "v1", a) for s, h, a in part], schema).coalesce(1).write.mode("append").parquet(source)

        def keep(flagged, batch):
            flagged.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={batch}")

        flag_signal_stream(spark.readStream.schema(schema).parquet(source), ledger, keep, str(tmp_path / "cp"), grid=Grid(1, 2, 1)).awaitTermination()
    got = {r.arrival: (r.is_duplicate, r.is_out_of_order) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {1: (False, False), 2: (False, False), 3: (False, True), 4: (False, False), 5: (True, True),
                   6: (False, False), 7: (False, False), 8: (True, True)}
    # A replayed batch sees only earlier ones.
    again = ledger.flag(spark.createDataFrame([("A", hour(1), "v1", 1)], schema), 0, "arrival", Grid(1, 2, 1)).first()
    assert not again.is_duplicate and not again.is_out_of_order


def test_an_upsert_reads_the_touched_months_only(spark, hour, tmp_path):
    from perpflow.sources.store import SeriesStore

    store = SeriesStore(spark, str(tmp_path / "pruned"))
    make = lambda first, n: spark.createDataFrame(
        [("sim", "AAA", hour(first + 24 * d), 0.1 * d, d) for d in range(n)], "exchange string, symbol string, timestamp timestamp, funding_rate double, ingest_seq long")
    store.write("funding_rate", make(0, 150), "ingest_seq")
    kept = {p: p.stat().st_mtime_ns for p in (tmp_path / "pruned").rglob("*.parquet")}
    store.write("funding_rate", make(24 * 62, 3), "ingest_seq")
    now = {p: p.stat().st_mtime_ns for p in (tmp_path / "pruned").rglob("*.parquet")}
    assert {p.parent.name for p in kept.keys() - now.keys()} == {"period=2024-03"}
    table = store._table("funding_rate")
    part = table.load().filter("period BETWEEN '2024-03' AND '2024-03'")
    assert len(part.inputFiles()) == len(list((tmp_path / "pruned").rglob("period=*/*.parquet")))
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(period" in plan and "2024-03" in plan
