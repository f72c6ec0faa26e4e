"""Account equity, drawdown and summaries from fills and bars."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, functions as F

from perpflow.functions.numeric import profit_factor
from perpflow.operators.asof import previous_row
from perpflow.operators.chunks import Grid, lead_in, own, running_path, window
from perpflow.operators.signals import RUN
from perpflow.session import weighed


def mark_to_market(bars: DataFrame, fills: DataFrame, grid: Grid) -> DataFrame:
    """Bars with the position held after the fills of the bar and its unrealised result at close."""
    held = fills.groupBy(*RUN, F.col("fill_time").alias("timestamp")).agg(
        F.max_by("quantity_after", "step").alias("position"),
        F.max_by("average_after", "step").alias("average_price"),
    )
    marked = previous_row(bars, held, RUN, "timestamp", grid, {"position": "position", "average_price": "average_price"})
    position = F.coalesce("position", F.lit(0.0))
    return marked.withColumn("position", position).withColumn(
        "unrealized_pnl",
        F.when(position == 0, 0.0).otherwise((F.col("close") - F.col("average_price")) * position),
    )


def equity_curve(jobs: DataFrame, bars: DataFrame, fills: DataFrame, grid: Grid) -> DataFrame:
    """One row per (run, bar, symbol) in (timestamp, symbol) order, after fills and marking.

    The peak starts with the first row. Cash moves by realised results and fees only; equity adds the unrealised result of every
    symbol. As a running sum over the whole run of: realised - fees + change of unrealised.
    """
    marked = mark_to_market(bars, fills, grid)
    led = lead_in(marked.select(*RUN, "timestamp", "unrealized_pnl"), RUN, "timestamp", grid, 1, count_on=bars)
    before = F.coalesce(F.lag("unrealized_pnl").over(window(RUN, "timestamp")), F.lit(0.0))
    moved = own(led.withColumn("moved", F.col("unrealized_pnl") - before))
    booked = fills.groupBy(*RUN, F.col("fill_time").alias("timestamp")).agg(
        F.sum(F.col("realized_pnl") - F.col("fee")).alias("booked"))
    steps = moved.join(booked, [*RUN, "timestamp"], "left").withColumn(
        "delta", F.col("moved") + F.coalesce("booked", F.lit(0.0)))
    # A chunk of the account holds every symbol, so it spans fewer bars.
    account = replace(grid, rows=max(grid.rows // 32, 1))
    path = running_path(steps, ["run_id"], ["timestamp", "symbol"], account, "delta")
    start = F.col("initial_cash")
    curve = path.join(weighed(jobs.select("run_id", "initial_cash"), "run_id"), "run_id").select(
        "run_id", "timestamp", "symbol", (start + F.col("gain")).alias("equity"), (start + F.col("high")).alias("peak"))
    return curve.withColumn("drawdown", drawdown(F.col("equity"), F.col("peak")))


def drawdown(equity: Column, peak: Column) -> Column:
    """Fall below the peak as a share of it; 0 while the peak is not positive."""
    return F.when(peak > 0, (peak - equity) / peak).otherwise(0.0)


def _trade_stats():
    pnl = F.col("realized_pnl")
    return [
        F.count(F.lit(1)).alias("num_trades"),
        F.count_if(pnl > 0).alias("wins"),
        F.coalesce(F.sum(F.when(pnl > 0, pnl)), F.lit(0.0)).alias("gain"),
        F.coalesce(F.sum(F.when(pnl < 0, -pnl)), F.lit(0.0)).alias("loss"),
        F.sum(pnl).alias("realized_pnl"),
    ]


def _rates():
    return [
        F.try_divide(F.col("wins"), F.col("num_trades")).cast("double").alias("win_rate"),
        profit_factor(F.col("gain"), F.col("loss"), F.col("wins")).alias("profit_factor"),
    ]


def performance(jobs: DataFrame, curve: DataFrame, trades: DataFrame) -> DataFrame:
    """Per run: final equity, total return, maximum drawdown, trades, win rate, profit factor."""
    ends = curve.groupBy("run_id").agg(
        F.max("drawdown").alias("max_drawdown"),
        F.max(F.struct("timestamp", "symbol", "equity"))["equity"].alias("final_equity"),
    )
    stats = trades.groupBy("run_id").agg(*_trade_stats())
    base = jobs.select("run_id", "initial_cash").join(ends, "run_id", "left").join(stats, "run_id", "left")
    final = F.coalesce("final_equity", "initial_cash")
    zero = {"num_trades": 0, "wins": 0, "gain": 0.0, "loss": 0.0}
    return base.fillna(zero).select(
        "run_id", "initial_cash", final.alias("final_equity"),
        F.try_divide(final - F.col("initial_cash"), F.col("initial_cash")).alias("total_return"),
        F.coalesce("max_drawdown", F.lit(0.0)).alias("max_drawdown"),
        "num_trades", *_rates(),
    )


def attribution(jobs: DataFrame, trades: DataFrame) -> DataFrame:
    """Per (run, symbol) trade statistics; symbols without a trade are listed too."""
    listed = jobs.select("run_id", F.explode("symbols").alias("symbol"))
    stats = trades.groupBy(*RUN).agg(*_trade_stats())
    zero = {"num_trades": 0, "wins": 0, "gain": 0.0, "loss": 0.0, "realized_pnl": 0.0}
    return listed.join(stats, RUN, "left").fillna(zero).select(
        *RUN, F.col("num_trades").alias("trade_count"), "realized_pnl", *_rates())


