"""One strategy over very many ranges: blocks of jobs meet the signals of their market.

A replay by run has a row for each job and bar, and one for each job and signal, and shuffles them several times. Here the bar a
signal fills on is looked up once for each market, not for each job: a job sees the bars of its range, so the fill
is the same unless it lies beyond the end. Jobs travel in blocks of ``BLOCK``, signals as one row for each chunk where jobs
begin; a task visits the signals of a row in order, all jobs of its block side by side. Nothing of the size of jobs times
signals is written or shuffled, only trades become rows.

A row holds the signals of two chunks, so jobs of up to ``grid.rows`` steps are done this way, whatever their number. Longer ones,
which would be long work in one task, are replayed by run, where a series is cut into chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from perpflow.operators.asof import next_row
from perpflow.operators.backtest import run_backtests
from perpflow.operators.chunks import Grid
from perpflow.operators.positions import UNIT, asked_units
from perpflow.operators.signals import fault, fills_on_same_bar, job_signals, job_symbols, runnable
from perpflow.schema import SERIES_KEY

BLOCK, ROWS = 4096, 65_536
_PLACE = [*SERIES_KEY, "_first"]
_OUT = "run_id string, symbol string, side string, quantity double, entry_price double, exit_price double, exit_time bigint, step bigint, realized_pnl double, fee double"
_SIDES = pa.array(["SHORT", "LONG"])
_PER_ONE = round(1 / UNIT)


def range_trades(jobs: DataFrame, bars: DataFrame, signals: DataFrame, grid: Grid) -> DataFrame:
    """The trades of ``run_backtests`` where every job gets the signals of its symbols within its range (``signals.job_signals``).

    ``signals`` have no run. Jobs that can't run have no trade; what is rejected or unfilled is not listed.
    """
    good = runnable(jobs).withColumns({"_first": grid.chunk(jobs, "start"), "_last": grid.chunk(jobs, "end")})
    short, long = good.filter("_last <= _first + 1"), good.filter("_last > _first + 1").select(*jobs.columns)
    trades = _short_trades(short, bars, signals, grid)
    if long.isEmpty():
        return trades
    return trades.unionByName(run_backtests(long, bars, job_signals(long, signals, grid.step), grid).trades)


def _short_trades(jobs: DataFrame, bars: DataFrame, signals: DataFrame, grid: Grid) -> DataFrame:
    wanted = job_symbols(jobs).select(
        *_PLACE, "run_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "fee_rate", "slippage_bps")
    n_blocks = F.ceil(F.count(F.lit(1)) / BLOCK).alias("_n")
    # Jobs are many and their file is small: neither side is left to the planner's guess.
    dealt = wanted.join(wanted.groupBy(*_PLACE).agg(n_blocks).hint("merge"), _PLACE).withColumn("_block", F.pmod(F.xxhash64("run_id"), F.col("_n")))
    blocks = dealt.repartition(*_PLACE, "_block").groupBy(*_PLACE, "_block").agg(
        F.collect_list(F.struct("run_id", "start", "end", "fee_rate", "slippage_bps")).alias("jobs"))
    met = blocks.join(_signals_by_chunk(wanted.select(*SERIES_KEY).distinct(), bars, signals, grid).hint("merge"), _PLACE)
    # Rows are few and small for the work in them: as many tasks as the session shuffles into, whatever they weigh.
    n_tasks = int(jobs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = met.repartition(n_tasks, *_PLACE, "_block").select("symbol", "jobs", "signals").mapInArrow(_replayed, _OUT)
    return found.withColumn("exit_time", F.timestamp_micros("exit_time"))


def _signals_by_chunk(markets: DataFrame, bars: DataFrame, signals: DataFrame, grid: Grid) -> DataFrame:
    """(market, _first, signals): those that fill in a chunk or the one after it, in the order of their fills."""
    asked = signals.filter(fault().isNull() & F.col("action").isNotNull()).select(
        "symbol", "timestamp", F.coalesce("emit_symbol", "symbol").alias("emit_symbol"), "seq", asked_units().alias("units")).join(markets, "symbol")
    at = bars.select(*SERIES_KEY, "timestamp", F.col("timestamp").alias("_t"), "open")
    filled = next_row(asked, at, SERIES_KEY, "timestamp", grid, {"_t": "fill_time", "open": "fill_open"}, tie=fills_on_same_bar()).filter("fill_time IS NOT NULL")
    chunk = grid.chunk(filled, "fill_time")
    one = F.struct(F.unix_micros("fill_time").alias("fill"), F.unix_micros("timestamp").alias("at"), "emit_symbol", "seq", "units", F.col("fill_open").alias("open"), chunk.alias("chunk"))
    return filled.select(*SERIES_KEY, F.explode(F.array(chunk - 1, chunk)).alias("_first"), one.alias("_s")).groupBy(*_PLACE).agg(
        F.array_sort(F.collect_list("_s")).alias("signals"))


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            jobs, signals = (batch.column(c)[i].values for c in ("jobs", "signals"))
            yield from _replay(batch.column("symbol")[i], jobs, signals)


def _replay(symbol: pa.Scalar, jobs: pa.StructArray, signals: pa.StructArray) -> Iterator[pa.RecordBatch]:
    """Visits the signals in order: quantity (in units) and average price of every job, and the trades that arise."""
    start, end, fee_rate, bps = (jobs.field(c).to_numpy(zero_copy_only=False) for c in ("start", "end", "fee_rate", "slippage_bps"))
    fill, at, opens, chunk = (signals.field(c).to_numpy(zero_copy_only=False) for c in ("fill", "at", "open", "chunk"))
    units = signals.field("units").to_pylist()
    shift = bps / 10000.0
    held, before_bar, steps = (np.zeros(len(jobs), dtype=np.int64) for _ in range(3))
    average = np.zeros(len(jobs))
    found, n = [], 0
    for k in range(len(signals)):
        if k == 0 or fill[k] != fill[k - 1]:
            before_bar[:] = held
        if k and chunk[k] != chunk[k - 1]:
            steps[:] = 0
        on = np.flatnonzero((start <= at[k]) & (fill[k] <= end))
        # An exit closes what was held before the bar; of a flat bar it is idle.
        signed = -before_bar[on] if units[k] is None else np.full(len(on), units[k], dtype=np.int64)
        on, signed = on[signed != 0], signed[signed != 0]
        if not len(on):
            continue
        before, paid = held[on], average[on]
        after, was, now = before + signed, np.abs(before), np.abs(before + signed)
        price = opens[k] + np.where(signed > 0, 1, -1) * (opens[k] * shift[on])
        extends = (before != 0) & (np.sign(before) == np.sign(signed))
        keeps = (before != 0) & (np.sign(after) == np.sign(before))
        size = np.maximum(now, 1)
        mixed = was / size * paid + price * np.abs(signed) / size
        held[on], average[on] = after, np.where(extends, mixed, np.where(keeps, paid, np.where(after == 0, 0.0, price)))
        closed = np.where(before == 0, 0, np.where(np.sign(before) * np.sign(after) < 0, was, np.maximum(was - now, 0)))
        done = closed > 0
        if done.any():
            quantity, side = closed[done] * 1.0 / _PER_ONE, np.sign(before[done])
            found.append((on[done], side, quantity, paid[done], price[done], np.full(done.sum(), fill[k]), steps[on[done]],
                          (price[done] - paid[done]) * quantity * side, price[done] * (np.abs(signed[done]) / _PER_ONE) * fee_rate[on[done]]))
            n += len(found[-1][0])
        steps[on] += 1
        if n >= ROWS:
            yield _rows(symbol, jobs, found)
            found, n = [], 0
    if found:
        yield _rows(symbol, jobs, found)


def _rows(symbol: pa.Scalar, jobs: pa.StructArray, found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    who, side, *rest = (np.concatenate(x) for x in zip(*found))
    quantity, entry, price, at, step, pnl, fee = (pa.array(x, from_pandas=True) for x in rest)
    return pa.RecordBatch.from_arrays(
        [jobs.field("run_id").take(pa.array(who)), pa.repeat(symbol, len(who)), _SIDES.take(pa.array((side > 0).astype(np.int8))),
         quantity, entry, price, at, step, pnl, fee],
        ["run_id", "symbol", "side", "quantity", "entry_price", "exit_price", "exit_time", "step", "realized_pnl", "fee"])
