"""Bars of a job, signal checks, and the bar each signal fills on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from perpflow.functions.numeric import fill_price
from perpflow.operators.asof import next_row
from perpflow.operators.chunks import Grid
from perpflow.operators.interval_join import interval_join
from perpflow.schema import DEFAULT_FEE_RATE, DEFAULT_SLIPPAGE_BPS
from perpflow.session import weighed

RUN = ["run_id", "symbol"]
# What a signal may ask for.
ENTRIES = ["ENTER_LONG", "ENTER_SHORT"]
EXIT = "EXIT"
NO_POSITION = "no open position"


def check_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs with normalised names and an ``error`` (NULL when the job can run).

    A bad job is a row with its error and never stops the other jobs.
    """
    symbols = F.transform("symbols", lambda s: F.upper(F.trim(s)))
    fee = F.coalesce("fee_rate", F.lit(DEFAULT_FEE_RATE))
    slip = F.coalesce("slippage_bps", F.lit(DEFAULT_SLIPPAGE_BPS))
    named = jobs.withColumns({
        "exchange": F.upper(F.trim("exchange")), "symbols": symbols, "fee_rate": fee, "slippage_bps": slip,
    })
    error = (
        F.when(F.coalesce("exchange", F.lit("")) == "", "exchange is empty")
        .when(F.coalesce(F.size("symbols"), F.lit(0)) <= 0, "no symbols")
        .when(F.exists("symbols", lambda s: s == ""), "empty symbol")
        .when(F.size(F.array_distinct("symbols")) != F.size("symbols"), "repeated symbol")
        .when(F.coalesce(F.col("end") <= F.col("start"), F.lit(True)), "end must be after start")
        .when(~F.coalesce(F.col("initial_cash") > 0, F.lit(False)), "initial_cash must be positive")
        .when((F.col("fee_rate") < 0) | (F.col("slippage_bps") < 0), "negative cost")
    )
    return named.withColumn("error", error)


def runnable(jobs: DataFrame) -> DataFrame:
    return check_jobs(jobs).filter("error IS NULL").drop("error")


def one_job_per_symbol(jobs: DataFrame) -> DataFrame:
    """Split every job into independent single-symbol jobs with their own capital."""
    per_symbol = jobs.withColumn("_s", F.explode("symbols"))
    return per_symbol.withColumns({
        "run_id": F.concat_ws("/", "run_id", "_s"), "symbols": F.array("_s"),
    }).drop("_s")


def job_symbols(jobs: DataFrame) -> DataFrame:
    """One row per (run, symbol) with the job settings."""
    return jobs.withColumn("symbol", F.explode("symbols")).drop("symbols")


def job_bars(jobs: DataFrame, bars: DataFrame, step: str | int = "1h") -> DataFrame:
    """Bars of every (run, symbol), start and end included; jobs may overlap in any number."""
    wanted = job_symbols(jobs).select("run_id", "exchange", "symbol", "timeframe", "start", "end")
    met = interval_join(bars, wanted, ["exchange", "symbol", "timeframe"], "timestamp", "start", "end", step)
    return met.select("run_id", "symbol", "timestamp", "open", "high", "low", "close")


def job_signals(jobs: DataFrame, signals: DataFrame, step: str | int = "1h") -> DataFrame:
    """Signals of a symbol for every job that trades it at their time: one strategy, many ranges."""
    wanted = job_symbols(jobs).select("run_id", "symbol", "start", "end")
    return interval_join(signals.drop("run_id"), wanted, ["symbol"], "timestamp", "start", "end", step).drop("start", "end")


def fault() -> Column:
    """Why no run can accept a signal; NULL if one can."""
    return (
        F.when(F.col("action").isin(ENTRIES) & ~F.coalesce(F.col("quantity") > 0, F.lit(False)), "entry needs a positive quantity")
        .when(~F.col("action").isin([*ENTRIES, EXIT]), "unknown action"))


def screen_signals(jobs: DataFrame, signals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(acceptable signals, rejects with a reason) by the rules that need no position.

    Whether an EXIT finds an open position is decided by the position fold.
    """
    known = job_symbols(jobs).select("run_id", "symbol", F.lit(True).alias("_known"))
    judged = signals.join(weighed(known, *RUN), RUN, "left").withColumn(
        "reason", F.when(F.col("_known").isNull(), "unknown symbol").otherwise(fault())).drop("_known")
    return judged.filter("reason IS NULL").drop("reason"), judged.filter("reason IS NOT NULL")


def fills_on_same_bar() -> Column:
    """Bars of one timestamp are visited in symbol order. A signal emitted by the bar of a
    symbol that sorts earlier therefore still fills on the target's bar of that timestamp.
    """
    return F.coalesce("emit_symbol", "symbol") < F.col("symbol")


def next_bar_orders(signals: DataFrame, bars: DataFrame, grid: Grid) -> DataFrame:
    """Signals with ``fill_time`` and ``fill_open`` of the next bar of their symbol; NULL if none."""
    at = bars.select(*RUN, "timestamp", F.col("timestamp").alias("_t"), "open")
    return next_row(signals, at, RUN, "timestamp", grid, {"_t": "fill_time", "open": "fill_open"}, tie=fills_on_same_bar())


def priced(orders: DataFrame, jobs: DataFrame) -> DataFrame:
    """Filled orders with buy and sell price after slippage and the fee rate of their run."""
    costs = jobs.select("run_id", "fee_rate", "slippage_bps")
    return orders.filter("fill_time IS NOT NULL").join(weighed(costs, "run_id"), "run_id").withColumns({
        "buy_price": fill_price(F.col("fill_open"), F.lit(True), F.col("slippage_bps")),
        "sell_price": fill_price(F.col("fill_open"), F.lit(False), F.col("slippage_bps")),
    })


def unfilled(orders: DataFrame) -> DataFrame:
    """Signals without a later bar: reported, never filled."""
    return orders.filter("fill_time IS NULL").drop("fill_time", "fill_open")
