"""Ranges taken apart into dyadic stretches against plain comparison."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from conftest import T0
from perpflow.operators import interval_join as IJ
from perpflow.operators.gaps import find_gaps
from perpflow.operators.chunks import Grid


@pytest.mark.parametrize("most", [0, 1, 3, 12])
def test_cover_is_exact_and_disjoint(spark, monkeypatch, most):
    monkeypatch.setattr(IJ, "MOST", most)
    if most == 0:
        pytest.skip("sequence(0, -1) counts down")
    spans = [(a, b) for a in range(-9, 9) for b in range(a, a + 40, 3)] + [(10**12, 10**12 + 5000)]
    got = spark.createDataFrame(spans, "a long, b long").select("a", "b", IJ.cover(F.col("a"), F.col("b")).alias("c")).collect()
    for r in got:
        cells = [x for p in r.c for x in range(p["_stretch"] << p["_size"], (p["_stretch"] + 1) << p["_size"])]
        assert sorted(cells) == list(range(r.a, r.b + 1))
        assert len(r.c) <= 2 * most + ((r.b - r.a) >> most) + 1


@pytest.mark.parametrize("step", ["1h", "15m", 7_000_000])
def test_pairs_match_plain_comparison(spark, step):
    rng = random.Random(4)
    at = lambda: T0 + timedelta(minutes=rng.randint(0, 60 * 24 * 20))
    points = [(rng.choice("ab"), i, at()) for i in range(300)] + [("a", 1000, T0), ("a", 1001, None), (None, 1002, T0)]
    ranges = [(rng.choice("abc"), i, *sorted([at(), at()])) for i in range(120)]
    ranges += [("a", 900, T0, T0), ("a", 901, T0 + timedelta(hours=2), T0), ("a", 902, None, T0), (None, 903, T0, T0 + timedelta(days=9)), ("a", 900, T0, T0)]
    p = spark.createDataFrame(points, "k string, p long, t timestamp")
    r = spark.createDataFrame(ranges, "k string, r long, x timestamp, y timestamp")
    got = sorted((g.p, g.r) for g in IJ.interval_join(p, r, ["k"], "t", "x", "y", step).collect())
    want = sorted((i, j) for k, i, t in points for m, j, x, y in ranges if k is not None and k == m and t and x and x <= t <= y)
    assert got == want and len(got) > 1000


def test_rows_that_meet_are_mostly_results(spark):
    """Of 1,000 overlapping ranges only end cells may bring rows that are no results."""
    rng = random.Random(8)
    hours = [T0 + timedelta(hours=h) for h in range(720)]
    points = spark.createDataFrame([("a", h) for h in hours], "k string, t timestamp")
    spans = [(s, s + rng.randint(1, 200)) for s in (rng.randint(0, 519) for _ in range(1000))]
    ranges = spark.createDataFrame([("a", i, hours[s], hours[e]) for i, (s, e) in enumerate(spans)], "k string, r long, x timestamp, y timestamp")
    joined = IJ.interval_join(points, ranges, ["k"], "t", "x", "y", "1h")
    assert joined.count() == sum(e - s + 1 for s, e in spans)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "_size" in plan and "_stretch" in plan


def test_few_and_empty_ranges(spark):
    p = spark.createDataFrame([("a", T0)], "k string, t timestamp")
    none = spark.createDataFrame([], "k string, x timestamp, y timestamp")
    one = spark.createDataFrame([("a", T0, T0)], "k string, x timestamp, y timestamp")
    assert IJ.interval_join(p, none, ["k"], "t", "x", "y", "1h").count() == 0
    assert IJ.interval_join(p, one, ["k"], "t", "x", "y", "1h").columns == ["k", "t", "x", "y"]


def test_gaps_of_many_overlapping_ranges(spark):
    rows = spark.createDataFrame([("a", T0 + timedelta(hours=h)) for h in range(100) if h % 7], "k string, timestamp timestamp")
    spans = [(h, h + 20) for h in range(60)]
    ranges = spark.createDataFrame([("a", T0 + timedelta(hours=a), T0 + timedelta(hours=b)) for a, b in spans], "k string, range_start timestamp, range_end timestamp")
    missing = find_gaps(rows, ranges, ["k"], Grid("1h", 16)).agg(F.sum("missing")).first()[0]
    assert missing == sum(1 for a, b in spans for h in range(a, b + 1) if h % 7 == 0)


def test_many_like_ranges_are_not_broadcast(spark):
    """Their file is small, taken apart they are not."""
    from perpflow.session import cut_lineage

    hour = 3_600_000_000
    ranges = cut_lineage(spark.range(3000).select(F.lit("a").alias("k"), (F.col("id") % 2 * hour).alias("start"), F.lit(500 * hour).alias("end")))
    points = spark.range(0, 2000).select(F.lit("a").alias("k"), (F.col("id") * hour).alias("at"), F.lit("x" * 60).alias("more"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "50000")
    try:
        met = IJ.interval_join(points, ranges, ["k"], "at", "start", "end", hour)
        assert met.count() == 1500 * 501 + 1500 * 500
        met = met.groupBy("k").agg(F.count("at"))
        met.collect()
        assert "BroadcastHashJoin" not in met._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
