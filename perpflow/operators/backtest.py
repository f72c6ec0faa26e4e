"""Many backtest runs at once: jobs x bars x signals to trades, equity and summaries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from perpflow.operators.chunks import Grid
from perpflow.operators.equity import attribution, equity_curve, performance
from perpflow.operators.positions import fold_positions, held_at_end, idle_exits, settle, trades
from perpflow.operators.signals import (
    EXIT, NO_POSITION, RUN, check_jobs, job_bars, next_bar_orders, one_job_per_symbol, priced, runnable, screen_signals, unfilled,
)
from perpflow.session import cut_lineage


@dataclass(frozen=True)
class Backtest:
    """Result tables, all keyed by run_id, lazy beyond the checkpointed orders and fills."""

    jobs: DataFrame
    failed_jobs: DataFrame
    rejected_signals: DataFrame
    unfilled_signals: DataFrame
    fills: DataFrame
    bars: DataFrame
    grid: Grid

    @property
    def trades(self) -> DataFrame:
        return trades(self.fills)

    @property
    def equity(self) -> DataFrame:
        return equity_curve(self.jobs, self.bars, self.fills, self.grid)

    @property
    def summary(self) -> DataFrame:
        return performance(self.jobs, self.equity, self.trades)

    @property
    def per_symbol(self) -> DataFrame:
        return attribution(self.jobs, self.trades)


def run_backtests(jobs: DataFrame, bars: DataFrame, signals: DataFrame | Callable[[DataFrame], DataFrame],
                  grid: Grid, *, checkpoint: bool = True) -> Backtest:
    """Replay every job. ``signals`` is a table, or a function from the jobs' bars to one.

    Orders and folded fills are checkpointed once each: they are small next to the bars, and
    trades, marking, cash and summary all read them.
    """
    checked = check_jobs(jobs)
    good = runnable(jobs)
    run_bars = job_bars(good, bars, grid.step)
    table = signals(run_bars) if callable(signals) else signals
    accepted, rejected = screen_signals(good, table)
    orders = next_bar_orders(accepted, run_bars, grid)
    if checkpoint:
        orders = cut_lineage(orders)
    settled = settle(priced(orders, good), grid, checkpoint=checkpoint)
    # A signal of the last bar is judged by what is held after all fills.
    late = unfilled(orders).join(held_at_end(settled), RUN, "left").withColumn(
        "_idle", (F.col("action") == EXIT) & (F.coalesce("held", F.lit(0)) == 0)).drop("held")
    idle = idle_exits(settled).select(*rejected.drop("reason").columns).unionByName(
        late.filter("_idle").select(*rejected.drop("reason").columns)).withColumn("reason", F.lit(NO_POSITION))
    return Backtest(
        jobs=good,
        failed_jobs=checked.filter("error IS NOT NULL").select("run_id", "error"),
        rejected_signals=rejected.unionByName(idle),
        unfilled_signals=late.filter("NOT _idle").drop("_idle"),
        fills=fold_positions(settled, checkpoint=checkpoint),
        bars=run_bars,
        grid=grid,
    )


def run_per_symbol(jobs: DataFrame, bars: DataFrame, signals: DataFrame, grid: Grid, **options) -> Backtest:
    """One independent run per symbol of each job, each with the job's whole capital.

    ``signals`` carry the original run_id.
    """
    split = signals.withColumn("run_id", F.concat_ws("/", "run_id", "symbol"))
    return run_backtests(one_job_per_symbol(jobs), bars, split, grid, **options)
