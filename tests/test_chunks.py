"""Chunked computation equals the same computation on the whole series."""

import random

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from perpflow.operators.asof import asof_join, next_row, previous_row
from perpflow.operators.chunks import Grid, lead_in, newest, own, running, running_path, window
from perpflow.operators.features import ema

ROWS = 300


def series(spark, seed, density=0.4, keys=("a", "b")):
    """Irregular series: dense stretches, long empty ones, single rows far apart."""
    rng = random.Random(seed)
    rows = []
    for key in keys:
        t = rng.randrange(50)
        for _ in range(ROWS):
            rows.append((key, t, float(rng.randrange(-50, 200))))
            t += 1 if rng.random() < density else rng.choice([2, 3, 7, 40, 400])
    return spark.createDataFrame(rows, "k string, t bigint, x double").repartition(5), pd.DataFrame(rows, columns=["k", "t", "x"])


@pytest.mark.parametrize("chunk", [3, 10, 64, 100_000])
@pytest.mark.parametrize("width", [2, 5, 30])
def test_bounded_frames(spark, chunk, width):
    df, pdf = series(spark, seed=chunk * 100 + width)
    led = lead_in(df, ["k"], "t", Grid(1, chunk, 4), width - 1)
    frame = window(["k"], "t").rowsBetween(-(width - 1), 0)
    got = own(led.withColumns({"s": F.sum("x").over(frame), "n": F.count("x").over(frame)})).toPandas()
    roll = pdf.groupby("k")["x"].rolling(width, min_periods=1)
    pdf["s"], pdf["n"] = roll.sum().reset_index(0, drop=True), roll.count().reset_index(0, drop=True)
    both = got.merge(pdf, on=["k", "t"], suffixes=("", "_want"))
    assert len(got) == len(pdf) == len(both)
    assert (both["s"] - both["s_want"]).abs().max() < 1e-9
    assert (both["n"] == both["n_want"]).all()


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(times=st.sets(st.integers(-500, 500), min_size=1, max_size=60), chunk=st.integers(1, 40), before=st.integers(1, 12))
def test_lag_over_any_gaps(spark, times, chunk, before):
    df = spark.createDataFrame([("a", t) for t in times], "k string, t bigint")
    led = lead_in(df, ["k"], "t", Grid(1, chunk, 3), before)
    got = own(led.withColumn("p", F.lag("t", before).over(window(["k"], "t")))).toPandas().sort_values("t")
    ordered = sorted(times)
    want = [None] * min(before, len(ordered)) + ordered[:-before]
    assert [None if pd.isna(p) else int(p) for p in got["p"]] == want[:len(ordered)]


def test_borrowed_rows_are_few(spark):
    df = spark.range(100_000).select(F.lit("a").alias("k"), F.col("id").alias("t"))
    led = lead_in(df, ["k"], "t", Grid(1, 4096, 32), 29)
    assert led.filter("NOT _own").count() <= 24 * 128


@pytest.mark.parametrize("chunk", [4, 50, 100_000])
def test_running_totals(spark, chunk):
    df, pdf = series(spark, seed=chunk)
    got = running(df, ["k"], ["t"], Grid(1, chunk, 2), {
        "s": ("sum", F.col("x")), "hi": ("max", F.col("x")), "lo": ("min", F.col("x")), "n": ("count", F.col("x"))}).toPandas()
    g = pdf.groupby("k")["x"]
    pdf["s_"], pdf["hi_"], pdf["lo_"], pdf["n_"] = g.cumsum(), g.cummax(), g.cummin(), g.cumcount() + 1
    both = got.merge(pdf, on=["k", "t"])
    assert len(both) == len(pdf)
    for c in ("s", "hi", "lo", "n"):
        assert (both[c] - both[c + "_"]).abs().max() < 1e-9


@pytest.mark.parametrize("chunk", [4, 60, 100_000])
def test_running_path(spark, chunk):
    df, pdf = series(spark, seed=chunk + 1)
    got = running_path(df, ["k"], ["t"], Grid(1, chunk, 2), "x").toPandas()
    pdf["g"] = pdf.groupby("k")["x"].cumsum()
    pdf["h"] = pdf.groupby("k")["g"].cummax()
    both = got.merge(pdf, on=["k", "t"])
    assert len(both) == len(pdf)
    assert (both["gain"] - both["g"]).abs().max() < 1e-9 and (both["high"] - both["h"]).abs().max() < 1e-9


@pytest.mark.parametrize("span,chunk", [(1, 10), (2, 7), (20, 16), (20, 100_000), (200, 50)])
def test_ema(spark, span, chunk):
    df, pdf = series(spark, seed=span + chunk)
    got = ema(df, ["k"], "t", "x", span, Grid(1, chunk, 2), "e").toPandas()
    pdf["want"] = pdf.groupby("k")["x"].transform(lambda s: s.ewm(span=span, adjust=False).mean())
    both = got.merge(pdf, on=["k", "t"])
    assert len(both) == len(pdf) and (both["e"] - both["want"]).abs().max() < 1e-8


def test_ema_of_a_long_series_stays_finite(spark):
    df = spark.range(5000).select(F.lit("a").alias("k"), F.col("id").alias("t"), (F.col("id") % 7).cast("double").alias("x"))
    got = ema(df, ["k"], "t", "x", 2, Grid(1, 100_000, 2), "e").toPandas().sort_values("t")
    want = got["x"].ewm(span=2, adjust=False).mean()
    assert (got["e"] - want).abs().max() < 1e-9


@pytest.mark.parametrize("chunk", [5, 100_000])
def test_asof_both_ways(spark, chunk):
    right, pr = series(spark, seed=3, density=0.1)
    left, pl = series(spark, seed=4, density=0.1, keys=("a", "b", "c"))
    grid = Grid(1, chunk, 2)
    back = previous_row(left, right.withColumn("rt", F.col("t")), ["k"], "t", grid, {"rt": "rt"}).toPandas()
    ahead = next_row(left, right.withColumn("rt", F.col("t")), ["k"], "t", grid, {"rt": "rt"}, tie=F.col("k") == "a").toPandas()
    by_key = {k: sorted(g["t"]) for k, g in pr.groupby("k")}
    assert len(back) == len(ahead) == len(pl)
    for r in back.itertuples():
        want = [t for t in by_key.get(r.k, []) if t <= r.t]
        assert (want[-1] if want else None) == (None if pd.isna(r.rt) else r.rt)
    for r in ahead.itertuples():
        want = [t for t in by_key.get(r.k, []) if (t >= r.t if r.k == "a" else t > r.t)]
        assert (want[0] if want else None) == (None if pd.isna(r.rt) else r.rt)


def test_asof_with_two_right_tables(spark):
    left = spark.createDataFrame([("a", 10), ("a", 95)], "k string, t bigint")
    one = spark.createDataFrame([("a", 1, 1.0), ("a", 90, 2.0)], "k string, t bigint, v double")
    two = spark.createDataFrame([("a", 50, 5.0)], "k string, t bigint, v double")
    got = asof_join(left, [(one, {"v": "p"}), (two, {"v": "q"})], ["k"], "t", Grid(1, 20, 2)).orderBy("t").collect()
    assert [(r.p, r.q) for r in got] == [(1.0, None), (2.0, 5.0)]


def test_newest_prunes_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("t"))
    tail = newest(df, ["k"], "t", 5)
    assert tail.count() == 15
    assert "WindowGroupLimit" in tail._jdf.queryExecution().executedPlan().toString()


def test_order_of_input_does_not_matter(spark):
    df, _ = series(spark, seed=9)
    frame = window(["k"], "t").rowsBetween(-6, 0)
    grid = Grid(1, 25, 4)

    def run(d):
        return own(lead_in(d, ["k"], "t", grid, 6).withColumn("s", F.sum("x").over(frame))).orderBy("k", "t").toPandas()

    assert run(df).equals(run(df.orderBy(F.col("t").desc())))
