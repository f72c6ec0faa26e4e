"""One strategy over many ranges: blocks of jobs against the replay by run."""

import random
from datetime import timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conftest import T0
from perpflow.operators import range_replay as RR
from perpflow.operators.backtest import run_backtests
from perpflow.operators.chunks import Grid
from perpflow.operators.signals import job_signals
from perpflow.schema import CANDLE, JOB, SIGNAL

KEY = ["run_id", "symbol", "exit_time", "step"]


def _tables(spark, seed):
    rng = random.Random(seed)
    hours = sorted(rng.sample(range(200), 150))
    bars = [("SIM", s, "1h", T0 + timedelta(hours=h), float(rng.randint(50, 150)), 0.0, 0.0, 1.0, 1.0) for s in "AB" for h in hours]
    bars += [("ELSE", "A", "1h", T0 + timedelta(hours=h), 10.0 + h, 0.0, 0.0, 1.0, 1.0) for h in hours[::2]]
    asked = [("ENTER_LONG", 1.0), ("ENTER_LONG", 0.3), ("ENTER_SHORT", 1.5), ("ENTER_SHORT", 0.25), ("EXIT", None), ("EXIT", None), ("HOLD", 1.0), ("ENTER_LONG", 0.0)]
    signals = [("x", rng.choice("ABC"), T0 + timedelta(hours=rng.choice(hours)), rng.choice([None, "A", "B"]), i, *rng.choice(asked)) for i in range(400)]
    jobs = []
    for i in range(150):
        a = rng.randint(-20, 190)
        jobs.append((f"r{i}", rng.choice(["sim", " SIM", "else", "none"]), rng.choice([["A"], ["B"], ["A", "B"], ["C", "A"]]), "1h", T0 + timedelta(hours=a),
                     T0 + timedelta(hours=a + rng.choice([0, 5, 12, 60, 150])), rng.choice([1e4, 1e4, 1e4, 0.0]), rng.choice([None, 0.001]), rng.choice([None, 0.0, 20.0])))
    return spark.createDataFrame(jobs, JOB), spark.createDataFrame(bars, CANDLE), spark.createDataFrame(signals, SIGNAL)


@pytest.mark.parametrize("seed,rows,block", [(1, 16, 5), (2, 1000, 40), (3, 100, 4096)])
def test_blocks_agree_with_the_replay_by_run(spark, monkeypatch, seed, rows, block):
    """Both over short and long jobs: long ones lie in three chunks or more and go by run."""
    monkeypatch.setattr(RR, "BLOCK", block)
    jobs, bars, signals = _tables(spark, seed)
    grid = Grid("1h", rows, 4)
    got = sorted(map(tuple, RR.range_trades(jobs, bars, signals.drop("run_id"), grid).select(*KEY, "side", "quantity", "entry_price", "exit_price", "realized_pnl", "fee").collect()))
    by_run = run_backtests(jobs, bars, job_signals(jobs, signals, grid.step), grid).trades
    want = sorted(map(tuple, by_run.select(*KEY, "side", "quantity", "entry_price", "exit_price", "realized_pnl", "fee").collect()))
    assert len(want) > 300 and [g[:6] for g in got] == [w[:6] for w in want]
    for g, w in zip(got, want):
        assert g[6:] == pytest.approx(w[6:], abs=1e-9)


def test_no_jobs_and_no_signals(spark):
    jobs, bars, signals = _tables(spark, 4)
    grid, none = Grid("1h", 1000, 4), signals.where("false").drop("run_id")
    assert RR.range_trades(jobs.where("false"), bars, signals.drop("run_id"), grid).count() == 0
    assert RR.range_trades(jobs, bars, none, grid).count() == 0
    assert RR.range_trades(jobs, bars.where("false"), signals.drop("run_id"), grid).count() == 0


def test_nothing_of_the_size_of_jobs_times_signals_is_written(spark):
    """The tables that the query keeps on disk are its bars and its jobs."""
    from perpflow.plans.backtests import backtest_many_ranges

    sf = "/root/testdata/sf0.001"
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    kept = set(shared.glob("perpflow-*"))
    assert backtest_many_ranges(spark, sf).count() > 100
    rows = sum(spark.read.parquet(str(f)).count() for f in set(shared.glob("perpflow-*")) - kept)
    bars = spark.read.parquet(f"{sf}/events.parquet").select("event_type", F.date_trunc("hour", "ts")).distinct().count()
    assert rows <= bars + spark.read.parquet(f"{sf}/customer.parquet").count()
