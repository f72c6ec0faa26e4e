"""Long-memory operators on sparse series, and the cost of looking forward."""

import time
from datetime import timedelta

import pytest
from conftest import T0
from pyspark.sql import functions as F

from perpflow.operators.asof import next_row, previous_row
from perpflow.operators.chunks import Grid, lead_in, unplaced
from perpflow.operators.features import ema
from perpflow.schema import TIMEFRAME_SECONDS


@pytest.mark.parametrize("span", [2, 20, 200])
@pytest.mark.parametrize("hours", [8, 1, 24 * 9])
def test_ema_is_exact_over_gaps_of_many_chunks(spark, span, hours):
    rows = [("s", T0 + timedelta(hours=hours * i + 500 * (i // 7)), float((i * 37) % 101)) for i in range(600)]
    got = ema(spark.createDataFrame(rows, "symbol string, timestamp timestamp, x double"), ["symbol"], "timestamp", "x", span, Grid("1m", 240, 16), "e")
    want, weight = rows[0][2], 2 / (span + 1)
    for r, (_, _, x) in zip(sorted(got.collect(), key=lambda r: r.timestamp), rows, strict=True):
        want = weight * x + (1 - weight) * want
        assert abs(r.e - want) <= 1e-9 * max(1, abs(want))


def test_forward_costs_as_much_as_backward(spark):
    left = spark.range(150_000).select(F.lit("s").alias("k"), (F.col("id") * 3).alias("t"))
    right = spark.range(150_000).select(F.lit("s").alias("k"), (F.col("id") * 3 + 1).alias("t"), F.col("id").alias("v"))
    took = {}
    for name, join in (("back", previous_row), ("forward", next_row), ("back", previous_row), ("forward", next_row)):
        began = time.time()
        out = join(left, right, ["k"], "t", Grid(1, 1_000_000), {"v": "w"}).agg(F.sum("w"), F.count("w")).first()
        took[name] = time.time() - began
        assert out[1] == (150_000 if name == "forward" else 149_999)
    assert took["forward"] < 3 * took["back"] + 2


def test_rows_without_a_place_are_left_out_alike_and_reported(spark):
    rows = spark.createDataFrame([("s", 1, 1.0), (None, 2, 2.0), ("s", None, 3.0)], "k string, t long, x double")
    assert [lead_in(rows, ["k"], "t", Grid(1, 10, 2), n).count() for n in (0, 1)] == [1, 1]
    assert unplaced(rows, ["k"], "t").count() == 2


def test_bar_codes():
    assert "2h" in TIMEFRAME_SECONDS and "3m" not in TIMEFRAME_SECONDS
