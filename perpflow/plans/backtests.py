"""Queries: signals, fills, positions, equity, research."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from perpflow.operators import research as R, signals as S, strategies as ST
from perpflow.operators.backtest import Backtest, run_backtests, run_per_symbol
from perpflow.operators.equity import mark_to_market
from perpflow.operators.quantiles import exact_percentiles
from perpflow.operators.range_replay import range_trades
from perpflow.plans.common import CANDLES_DAILY, CANDLES_HOURLY, HOURLY, daily_bars, hourly_bars, query, rounded, tidy, with_ctes
from perpflow.schema import JOB
from perpflow.session import cut_lineage
from perpflow.sources import adapters as A

START, END = datetime(2024, 1, 1, tzinfo=timezone.utc), datetime(2024, 2, 1, tzinfo=timezone.utc)
SYMBOLS = ["VIEW", "CLICK", "PURCHASE", "SIGNUP", "ERROR"]


def _job(spark: SparkSession, *runs: tuple) -> DataFrame:
    """(run_id, symbols, start, end, fee_rate, slippage_bps) rows as a jobs table."""
    rows = [(r, "sim", list(s), "1h", a, b, 10_000.0, fee, slip) for r, s, a, b, fee, slip in runs]
    return spark.createDataFrame(rows, JOB)


def _jobs(bars: DataFrame, run: str, fee: float | None, slip: float | None) -> DataFrame:
    """One job over all symbols and the whole span of the bars."""
    hour = F.expr("INTERVAL 1 HOUR")
    return bars.groupBy("timeframe").agg(
        F.array_sort(F.collect_set("symbol")).alias("symbols"), F.min("timestamp").alias("start"), (F.max("timestamp") + hour).alias("end")
    ).select(F.lit(run).alias("run_id"), F.lit("sim").alias("exchange"), "symbols", "timeframe", "start", "end", F.lit(10_000.0).alias("initial_cash"),
             F.lit(fee).cast("double").alias("fee_rate"), F.lit(slip).cast("double").alias("slippage_bps"))


def _cross(bars: DataFrame, run: str = "sma") -> DataFrame:
    return A.sma_cross_signals(bars, HOURLY).withColumn("run_id", F.lit(run))


def _flagship(spark: SparkSession, sf: str) -> Backtest:
    bars = hourly_bars(spark, sf)
    jobs = _jobs(bars, "sma", None, None)
    return run_backtests(jobs, bars, _cross(bars), HOURLY)


_SIGNALS = """s AS (SELECT symbol, timestamp, open, close,
   avg(close) OVER w AS sma, count(close) OVER w AS n,
   lead(timestamp) OVER (PARTITION BY symbol ORDER BY timestamp) AS next_time, lead(open) OVER (PARTITION BY symbol ORDER BY timestamp) AS next_open
  FROM candles WINDOW w AS (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
f AS (SELECT *, close > sma AS up FROM s WHERE n = 5),
c AS (SELECT *, lag(up) OVER (PARTITION BY symbol ORDER BY timestamp) AS prev FROM f),
signals AS (SELECT symbol, timestamp, CASE WHEN up THEN 'ENTER_LONG' ELSE 'EXIT' END AS action, CASE WHEN up THEN 1.0e0 END AS quantity,
   next_time AS fill_time, next_open AS fill_open
  FROM c WHERE (up AND (prev IS NULL OR NOT prev)) OR (NOT up AND prev))"""
# The stream alternates, so each exit closes the unit bought by the entry before it.
_FILLS = """fills AS (SELECT symbol, fill_time, action, CASE WHEN action = 'ENTER_LONG' THEN fill_open * 1.0001e0 ELSE fill_open * 0.9999e0 END AS fill_price
  FROM signals WHERE fill_time IS NOT NULL),
paired AS (SELECT *, lag(fill_price) OVER (PARTITION BY symbol ORDER BY fill_time) AS entry_price FROM fills),
trades AS (SELECT symbol, entry_price, fill_price AS exit_price, fill_time AS exit_time, fill_price - entry_price AS realized_pnl,
   fill_price * 0.0004e0 AS fee FROM paired WHERE action = 'EXIT')"""
_EQUITY = """held AS (SELECT candles.symbol, candles.timestamp, close, f.action, f.fill_price FROM candles
  ASOF LEFT JOIN fills f ON f.symbol = candles.symbol AND candles.timestamp >= f.fill_time),
marks AS (SELECT symbol, timestamp, CASE WHEN action = 'ENTER_LONG' THEN close - fill_price ELSE 0.0e0 END AS unrealized_pnl,
   CASE WHEN action = 'ENTER_LONG' THEN 1.0e0 ELSE 0.0e0 END AS position FROM held),
moves AS (SELECT m.symbol, m.timestamp, unrealized_pnl - coalesce(lag(unrealized_pnl) OVER (PARTITION BY m.symbol ORDER BY m.timestamp), 0)
   + coalesce(CASE WHEN p.action = 'EXIT' THEN p.fill_price - p.entry_price ELSE 0 END - p.fill_price * 0.0004e0, 0) AS delta
  FROM marks m LEFT JOIN paired p ON p.symbol = m.symbol AND p.fill_time = m.timestamp),
curve AS (SELECT symbol, timestamp, 10000.0e0 + sum(delta) OVER (ORDER BY timestamp, symbol ROWS UNBOUNDED PRECEDING) AS equity FROM moves),
peaks AS (SELECT *, max(equity) OVER (ORDER BY timestamp, symbol ROWS UNBOUNDED PRECEDING) AS peak FROM curve)"""
_STATS = """count(*) AS {n}, sum(realized_pnl) AS pnl, count(*) FILTER (WHERE realized_pnl > 0) AS wins,
   coalesce(sum(realized_pnl) FILTER (WHERE realized_pnl > 0), 0) AS gain, coalesce(-sum(realized_pnl) FILTER (WHERE realized_pnl < 0), 0) AS loss"""
_RATES = """wins / nullif({n}, 0)::DOUBLE AS win_rate,
   CASE WHEN loss > 0 THEN gain / loss WHEN wins > 0 THEN 'inf'::DOUBLE END AS profit_factor"""


@query("signals_next_bar", rounded(with_ctes(CANDLES_HOURLY, _SIGNALS, body="""
  SELECT symbol, timestamp, action, quantity, fill_time, fill_open FROM signals WHERE fill_time IS NOT NULL"""), ["quantity", "fill_open"]))
def signals_next_bar(spark: SparkSession, sf: str) -> DataFrame:
    bars = hourly_bars(spark, sf)
    orders = S.next_bar_orders(_cross(bars), bars.withColumn("run_id", F.lit("sma")), HOURLY)
    return tidy(orders.filter("fill_time IS NOT NULL").select("symbol", "timestamp", "action", "quantity", "fill_time", "fill_open"))


_EVERY_BAR = """every AS (SELECT symbol, timestamp, (hour(timestamp) + 1) % 4 AS turn, lead(timestamp) OVER (PARTITION BY symbol ORDER BY timestamp) AS next_time FROM candles),
states AS (SELECT *, last_value(CASE WHEN next_time IS NOT NULL THEN turn END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY timestamp
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM every WHERE turn < 3),
exits AS (SELECT symbol, timestamp, next_time, turn, coalesce(before, 1) = 0 AS holding FROM states)"""


def _exit_run(spark: SparkSession, sf: str) -> Backtest:
    """Buys every fourth hour, exits in the two hours after: the second exit finds nothing."""
    turn = F.pmod(F.hour("timestamp") + 1, F.lit(4))
    bars = hourly_bars(spark, sf)
    table = bars.filter(turn < 3).select(
        F.lit("x").alias("run_id"), "symbol", "timestamp", F.col("symbol").alias("emit_symbol"), F.lit(0).cast("bigint").alias("seq"),
        F.when(turn == 0, "ENTER_LONG").otherwise("EXIT").alias("action"), F.when(turn == 0, 0.1).alias("quantity"))
    return run_backtests(_jobs(bars, "x", 0.0, 0.0), bars, table, HOURLY)


@query("signals_unfilled", with_ctes(CANDLES_HOURLY, _EVERY_BAR, body="""
  SELECT symbol, timestamp, CASE WHEN turn = 0 THEN 'ENTER_LONG' ELSE 'EXIT' END AS action FROM exits
  WHERE next_time IS NULL AND (turn = 0 OR holding)"""))
def signals_unfilled(spark: SparkSession, sf: str) -> DataFrame:
    """Signals of the last bar of a symbol, exits only where something is held."""
    return tidy(_exit_run(spark, sf).unfilled_signals.select("symbol", "timestamp", "action"))


@query("exit_rejects", with_ctes(CANDLES_HOURLY, _EVERY_BAR, body="""
  SELECT symbol, timestamp, 'no open position' AS reason FROM exits WHERE turn > 0 AND NOT holding"""))
def exit_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Exits that found no position, filled bar or not."""
    return tidy(_exit_run(spark, sf).rejected_signals.select("symbol", "timestamp", "reason"))


@query("signals_cross_symbol", with_ctes(CANDLES_HOURLY, body="""
  SELECT e.symbol AS emit_symbol, e.timestamp, t.symbol, min(b.timestamp) AS fill_time
  FROM candles e CROSS JOIN (SELECT DISTINCT symbol FROM candles) t
  LEFT JOIN candles b ON b.symbol = t.symbol AND (b.timestamp > e.timestamp OR (b.timestamp = e.timestamp AND b.symbol > e.symbol))
  GROUP BY 1, 2, 3"""))
def signals_cross_symbol(spark: SparkSession, sf: str) -> DataFrame:
    """Signals of one symbol's bar for every symbol: later-sorting targets fill on the same timestamp."""
    bars = hourly_bars(spark, sf).withColumn("run_id", F.lit("x"))
    targets = bars.withColumn("emit_symbol", F.col("symbol")).withColumn("symbol", F.explode(F.array(*[F.lit(s) for s in SYMBOLS])))
    signals = targets.select("run_id", "symbol", "timestamp", "emit_symbol")
    return tidy(S.next_bar_orders(signals, bars, HOURLY).select("emit_symbol", "timestamp", "symbol", "fill_time"))


@query("signals_screened", """
  SELECT reason, count(*) AS n FROM (
    SELECT CASE WHEN event_type = 'error' THEN 'unknown symbol' WHEN event_id % 4 IN (0, 1) AND NOT value - 40 > 0 THEN 'entry needs a positive quantity'
      WHEN event_id % 4 = 3 THEN 'unknown action' ELSE 'accepted' END AS reason FROM events) AS t GROUP BY reason""")
def signals_screened(spark: SparkSession, sf: str) -> DataFrame:
    jobs = _job(spark, ("x", [s for s in SYMBOLS if s != "ERROR"], START, END, None, None))
    action = F.element_at(F.array(*[F.lit(a) for a in ("ENTER_LONG", "ENTER_SHORT", "EXIT", "HOLD")]), F.pmod("event_id", F.lit(4)).cast("int") + 1)
    signals = A.table(spark, sf, "events").select(
        F.lit("x").alias("run_id"), F.upper("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("timestamp"),
        action.alias("action"), (F.col("value") - 40).alias("quantity"))
    good, bad = S.screen_signals(jobs, signals)
    both = bad.select("reason").unionByName(good.select(F.lit("accepted").alias("reason")))
    return both.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("backtest_generated", rounded(with_ctes(CANDLES_HOURLY, _SIGNALS, _FILLS, body="""
  SELECT 'sma' AS run_id, symbol, 'LONG' AS side, 1.0e0 AS quantity, entry_price, exit_price, exit_time, realized_pnl, fee FROM trades"""),
  ["quantity", "entry_price", "exit_price", "realized_pnl", "fee"]))
def backtest_generated(spark: SparkSession, sf: str) -> DataFrame:
    """The same run with signals made by a function of the job's bars."""
    bars = hourly_bars(spark, sf)

    def make(run_bars: DataFrame) -> DataFrame:
        named = run_bars.withColumns({"exchange": F.lit("SIM"), "timeframe": F.lit("1h")})
        return A.sma_cross_signals(named, HOURLY).withColumn("run_id", F.lit("sma"))

    return tidy(run_backtests(_jobs(bars, "sma", None, None), bars, make, HOURLY).trades.drop("step"))


@query("backtest_trades", rounded(with_ctes(CANDLES_HOURLY, _SIGNALS, _FILLS, body="""
  SELECT 'sma' AS run_id, symbol, 'LONG' AS side, 1.0e0 AS quantity, entry_price, exit_price, exit_time, realized_pnl, fee FROM trades"""),
  ["quantity", "entry_price", "exit_price", "realized_pnl", "fee"]))
def backtest_trades(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(_flagship(spark, sf).trades.drop("step"))


@query("backtest_marks", rounded(with_ctes(CANDLES_HOURLY, _SIGNALS, _FILLS, _EQUITY, body="SELECT symbol, timestamp, position, unrealized_pnl FROM marks"),
                                 ["position", "unrealized_pnl"]))
def backtest_marks(spark: SparkSession, sf: str) -> DataFrame:
    bt = _flagship(spark, sf)
    return tidy(mark_to_market(bt.bars, bt.fills, HOURLY).select("symbol", "timestamp", "position", "unrealized_pnl"))


@query("backtest_equity", rounded(with_ctes(CANDLES_HOURLY, _SIGNALS, _FILLS, _EQUITY, body="""
  SELECT 'sma' AS run_id, timestamp, symbol, equity, peak, (peak - equity) / peak AS drawdown FROM peaks"""), ["equity", "peak", "drawdown"]))
def backtest_equity(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(_flagship(spark, sf).equity)


@query("backtest_summary", rounded(with_ctes(CANDLES_HOURLY, _SIGNALS, _FILLS, _EQUITY, f"st AS (SELECT {_STATS.format(n='num_trades')} FROM trades)", body=f"""
  SELECT 'sma' AS run_id, 10000.0e0 AS initial_cash, final_equity, final_equity / 10000 - 1 AS total_return, max_drawdown, num_trades,
   {_RATES.format(n='num_trades')} FROM st CROSS JOIN (
    SELECT max((peak - equity) / peak) AS max_drawdown, last(equity ORDER BY timestamp, symbol) AS final_equity FROM peaks) AS e"""),
  ["initial_cash", "final_equity", "total_return", "max_drawdown", "win_rate", "profit_factor"]))
def backtest_summary(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(_flagship(spark, sf).summary)


@query("backtest_attribution", rounded(with_ctes(CANDLES_HOURLY, _SIGNALS, _FILLS, f"st AS (SELECT symbol, {_STATS.format(n='trade_count')} FROM trades GROUP BY symbol)",
  body=f"""SELECT 'sma' AS run_id, symbol, trade_count, pnl AS realized_pnl, {_RATES.format(n='trade_count')} FROM st
  UNION ALL SELECT 'sma', 'IDLE', 0, 0, NULL, NULL"""), ["realized_pnl", "win_rate", "profit_factor"]))
def backtest_attribution(spark: SparkSession, sf: str) -> DataFrame:
    """Shared capital, results per symbol; a symbol that never trades is listed."""
    jobs = _job(spark, ("sma", [*SYMBOLS, "idle"], START, END, None, None))
    bars = hourly_bars(spark, sf)
    return tidy(run_backtests(jobs, bars, _cross(bars), HOURLY).per_symbol)


@query("backtest_per_symbol", rounded(with_ctes(CANDLES_HOURLY, _SIGNALS, _FILLS, f"st AS (SELECT symbol, sum(fee) AS exit_fees, {_STATS.format(n='num_trades')} FROM trades GROUP BY symbol)", body=f"""
  SELECT concat('sma/', symbol) AS run_id, num_trades, {_RATES.format(n='num_trades')} FROM st"""), ["win_rate", "profit_factor"]))
def backtest_per_symbol(spark: SparkSession, sf: str) -> DataFrame:
    """One run per symbol, each with the whole capital."""
    jobs = _job(spark, ("sma", SYMBOLS, START, END, None, None))
    bars = hourly_bars(spark, sf)
    runs = run_per_symbol(jobs, bars, _cross(bars), HOURLY)
    return tidy(runs.summary.select("run_id", "num_trades", "win_rate", "profit_factor"))


_GRID_RUNS = [("free", SYMBOLS, START, END, 0.0, 0.0), ("costly", SYMBOLS, START, END, 0.002, 10.0), ("bad", SYMBOLS, END, START, None, None)]


@query("backtest_many_runs", rounded(with_ctes(CANDLES_HOURLY, _SIGNALS, """runs(run_id, fee, slip) AS (VALUES ('free', 0.0e0, 0.0e0), ('costly', 0.002e0, 0.001e0)),
  fills AS (SELECT run_id, symbol, fill_time, action, fee, CASE WHEN action = 'ENTER_LONG' THEN fill_open * (1 + slip) ELSE fill_open * (1 - slip) END AS fill_price
    FROM signals CROSS JOIN runs WHERE fill_time IS NOT NULL),
  paired AS (SELECT *, lag(fill_price) OVER (PARTITION BY run_id, symbol ORDER BY fill_time) AS entry_price FROM fills)""", body="""
  SELECT run_id, count(*) AS num_trades, sum(fill_price - entry_price) AS realized_pnl, sum(fill_price * fee) AS closing_fees, NULL::VARCHAR AS error
  FROM paired WHERE action = 'EXIT' GROUP BY run_id UNION ALL SELECT 'bad', 0, NULL, NULL, 'end must be after start'"""),
  ["realized_pnl", "closing_fees"]))
def backtest_many_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Several cost settings in one job; a bad job is a row with its error."""
    bars = hourly_bars(spark, sf)
    one = _cross(bars).drop("run_id")
    signals = one.withColumn("run_id", F.explode(F.array(*[F.lit(r[0]) for r in _GRID_RUNS])))
    bt = run_backtests(_job(spark, *_GRID_RUNS), bars, signals, HOURLY)
    done = bt.trades.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("num_trades"), F.sum("realized_pnl").alias("realized_pnl"), F.sum("fee").alias("closing_fees"))
    return tidy(done.unionByName(bt.failed_jobs, allowMissingColumns=True).fillna(0, ["num_trades"]))


# A job for every customer: one symbol, its own days and costs; most overlap.
_CUSTOMER_JOBS = """jobs AS (SELECT concat('c', c_custkey) AS run_id, (['VIEW', 'CLICK', 'PURCHASE', 'SIGNUP', 'ERROR'])[c_custkey % 5 + 1] AS symbol,
    t0 + c_custkey * 37 % 601 * INTERVAL 1 HOUR AS a, t0 + (c_custkey * 37 % 601 + 24 + c_custkey * 53 % 197) * INTERVAL 1 HOUR AS b,
    c_nationkey / 10000.0e0 AS fee FROM customer CROSS JOIN (SELECT min(timestamp) AS t0 FROM candles) AS o),
mine AS (SELECT run_id, fee, s.* FROM jobs JOIN signals s ON s.symbol = jobs.symbol AND s.timestamp BETWEEN a AND b AND s.fill_time <= b),
met AS (SELECT *, CASE WHEN action = 'ENTER_LONG' THEN fill_open * 1.0002e0 ELSE fill_open * 0.9998e0 END AS fill_price FROM mine),
paired AS (SELECT *, lag(fill_price) OVER (PARTITION BY run_id ORDER BY fill_time) AS entry_price FROM met)"""


def _customer_jobs(spark: SparkSession, sf: str, bars: DataFrame) -> DataFrame:
    c, hour = F.col("c_custkey"), 3_600_000_000
    first = F.unix_micros("t0") + F.pmod(c * 37, F.lit(601)) * hour
    symbol = F.element_at(F.array(*[F.lit(s) for s in SYMBOLS]), F.pmod(c, F.lit(5)).cast("int") + 1)
    return A.table(spark, sf, "customer").join(bars.agg(F.min("timestamp").alias("t0"))).select(
        F.concat(F.lit("c"), c).alias("run_id"), F.lit("sim").alias("exchange"), F.array(symbol).alias("symbols"), F.lit("1h").alias("timeframe"),
        F.timestamp_micros(first).alias("start"), F.timestamp_micros(first + (24 + F.pmod(c * 53, F.lit(197))) * hour).alias("end"),
        F.lit(10_000.0).alias("initial_cash"), (F.col("c_nationkey") / 10000).alias("fee_rate"), F.lit(2.0).alias("slippage_bps"))


@query("backtest_many_ranges", rounded(with_ctes(CANDLES_HOURLY, _SIGNALS, _CUSTOMER_JOBS, body="""
  SELECT run_id, count(*) AS num_trades, sum(fill_price - entry_price) AS realized_pnl, sum(fill_price * fee) AS closing_fees
  FROM paired WHERE action = 'EXIT' AND entry_price IS NOT NULL GROUP BY run_id"""), ["realized_pnl", "closing_fees"]))
def backtest_many_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """A job for every customer over a range of its own, all in one replay; runs without a trade have no row."""
    bars = hourly_bars(spark, sf)
    jobs = cut_lineage(_customer_jobs(spark, sf, bars))
    trades = range_trades(jobs, bars, _cross(bars).drop("run_id"), HOURLY)
    return tidy(trades.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("num_trades"), F.sum("realized_pnl").alias("realized_pnl"), F.sum("fee").alias("closing_fees")))


@query("job_bars_many_ranges", rounded(with_ctes(CANDLES_HOURLY, _SIGNALS, _CUSTOMER_JOBS, body="""
  SELECT run_id, count(*) AS bars, min(c.timestamp) AS first_bar, max(c.timestamp) AS last_bar, avg(c.close) AS mean_close
  FROM jobs JOIN candles c ON c.symbol = jobs.symbol AND c.timestamp BETWEEN a AND b GROUP BY run_id"""), ["mean_close"]))
def job_bars_many_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """The bars that each of very many overlapping jobs replays."""
    bars = hourly_bars(spark, sf)
    met = S.job_bars(S.runnable(cut_lineage(_customer_jobs(spark, sf, bars))), bars)
    return tidy(met.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("bars"), F.min("timestamp").alias("first_bar"), F.max("timestamp").alias("last_bar"), F.avg("close").alias("mean_close")))


_FLIP = """o AS (SELECT symbol, timestamp, CASE WHEN date_part('hour', timestamp) % 3 = 0 THEN 'ENTER_LONG' WHEN date_part('hour', timestamp) % 3 = 1 THEN 'ENTER_SHORT' ELSE 'EXIT' END AS action,
    (1 + date_part('day', timestamp) % 3)::DOUBLE AS n,
    lead(timestamp) OVER (PARTITION BY symbol ORDER BY timestamp) AS fill_time, lead(open) OVER (PARTITION BY symbol ORDER BY timestamp) AS price FROM candles),
q AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp) AS rn FROM o WHERE fill_time IS NOT NULL),
walk AS (
  SELECT symbol, 0::BIGINT AS rn, NULL::TIMESTAMP AS fill_time, 0.0e0 AS before, 0.0e0 AS after, 0.0e0 AS avg_before, 0.0e0 AS avg_after, 0.0e0 AS price FROM (SELECT DISTINCT symbol FROM q) AS k
  UNION ALL
  SELECT symbol, rn, fill_time, before, after, avg_before,
    CASE WHEN after = 0 THEN 0 WHEN before = after THEN avg_before WHEN before = 0 OR before * after < 0 THEN price
         WHEN abs(after) > abs(before) THEN (avg_before * abs(before) + price * abs(after - before)) / abs(after) ELSE avg_before END, price
  FROM (SELECT q.symbol, q.rn, q.fill_time, w.after AS before, w.avg_after AS avg_before, q.price,
          CASE q.action WHEN 'EXIT' THEN 0.0e0 WHEN 'ENTER_LONG' THEN w.after + q.n ELSE w.after - q.n END AS after
        FROM walk w JOIN q ON q.symbol = w.symbol AND q.rn = w.rn + 1) AS step)"""


@query("backtest_flips", rounded(with_ctes(CANDLES_HOURLY, _FLIP, body="""
  SELECT symbol, CASE WHEN before > 0 THEN 'LONG' ELSE 'SHORT' END AS side,
    CASE WHEN before * after < 0 THEN abs(before) ELSE abs(before) - abs(after) END AS quantity, avg_before AS entry_price, price AS exit_price,
    fill_time AS exit_time, (price - avg_before) * (CASE WHEN before * after < 0 THEN abs(before) ELSE abs(before) - abs(after) END) * sign(before) AS realized_pnl
  FROM walk WHERE before <> 0 AND (before * after < 0 OR abs(after) < abs(before))""", recursive=True),
  ["quantity", "entry_price", "exit_price", "realized_pnl"]))
def backtest_flips(spark: SparkSession, sf: str) -> DataFrame:
    """A signal on every bar (long, short, exit by hour): extends, reductions, closes and flips."""
    hour = F.pmod(F.hour("timestamp"), F.lit(3))
    bars = hourly_bars(spark, sf)
    signals = bars.select(
        F.lit("flip").alias("run_id"), "symbol", "timestamp", F.col("symbol").alias("emit_symbol"), F.lit(0).cast("bigint").alias("seq"),
        F.when(hour == 0, "ENTER_LONG").when(hour == 1, "ENTER_SHORT").otherwise("EXIT").alias("action"),
        (1 + F.pmod(F.dayofmonth("timestamp"), F.lit(3))).cast("double").alias("quantity"))
    bt = run_backtests(_jobs(bars, "flip", 0.0, 0.0), bars, signals, HOURLY)
    return tidy(bt.trades.drop("run_id", "step", "fee"))


# A stop leads to a pause, which only a fall ends: what a bar asks for depends on the position.
_REVERSE = ST.StateRules(
    states=["FLAT", "LONG", "SHORT", "PAUSED"],
    moves={"up": {"FLAT": "LONG", "SHORT": "LONG"}, "down": {"LONG": "SHORT", "PAUSED": "FLAT"}, "stop": {"LONG": "PAUSED", "SHORT": "FLAT"}},
    actions={("FLAT", "LONG"): "ENTER_LONG", ("SHORT", "LONG"): "ENTER_LONG", ("LONG", "SHORT"): "ENTER_SHORT", ("LONG", "PAUSED"): "EXIT", ("SHORT", "FLAT"): "EXIT"})
_WALK = """seen AS (SELECT symbol, timestamp, row_number() OVER (PARTITION BY symbol ORDER BY timestamp) AS rn,
    CASE WHEN high - low > 150 THEN 'stop' WHEN close > open * 1.5 THEN 'up' WHEN close < open / 1.5 THEN 'down' END AS k FROM candles),
walk AS (SELECT symbol, 0::BIGINT AS rn, NULL::TIMESTAMP AS timestamp, 'FLAT' AS before, 'FLAT' AS after FROM (SELECT DISTINCT symbol FROM seen) AS s
  UNION ALL SELECT n.symbol, n.rn, n.timestamp, w.after,
    CASE WHEN n.k = 'up' AND w.after IN ('FLAT', 'SHORT') THEN 'LONG' WHEN n.k = 'down' AND w.after = 'LONG' THEN 'SHORT' WHEN n.k = 'down' AND w.after = 'PAUSED' THEN 'FLAT'
      WHEN n.k = 'stop' AND w.after = 'LONG' THEN 'PAUSED' WHEN n.k = 'stop' AND w.after = 'SHORT' THEN 'FLAT' ELSE w.after END
  FROM walk w JOIN seen n ON n.symbol = w.symbol AND n.rn = w.rn + 1),
moves AS (SELECT symbol, timestamp, before, after, CASE WHEN after = 'LONG' AND before <> 'LONG' THEN 'ENTER_LONG' WHEN after = 'SHORT' AND before = 'LONG' THEN 'ENTER_SHORT'
    WHEN before = 'LONG' AND after = 'PAUSED' OR before = 'SHORT' AND after = 'FLAT' THEN 'EXIT' END AS action FROM walk WHERE rn > 0)"""


def _reversing(bars: DataFrame) -> DataFrame:
    close, opened = F.col("close"), F.col("open")
    seen = F.when(F.col("high") - F.col("low") > 150, "stop").when(close > opened * 1.5, "up").when(close < opened / 1.5, "down")
    return ST.states_along(bars, ["exchange", "symbol", "timeframe"], "timestamp", seen, _REVERSE, HOURLY)


@query("states_stop_and_reverse", with_ctes(CANDLES_HOURLY, _WALK, body="SELECT symbol, timestamp, before AS state_before, after AS state_after FROM moves", recursive=True))
def states_stop_and_reverse(spark: SparkSession, sf: str) -> DataFrame:
    """The position that a strategy of four states is in, as of every bar."""
    return tidy(_reversing(hourly_bars(spark, sf)).select("symbol", "timestamp", "state_before", "state_after"))


@query("signals_stop_and_reverse", with_ctes(CANDLES_HOURLY, _WALK, body="""
  SELECT symbol, timestamp, action, CASE WHEN action <> 'EXIT' THEN 2.0e0 END AS quantity FROM moves WHERE action IS NOT NULL""", recursive=True))
def signals_stop_and_reverse(spark: SparkSession, sf: str) -> DataFrame:
    """The signals of that strategy: it reverses when the trend turns and pauses after a stop."""
    return tidy(ST.state_signals(_reversing(hourly_bars(spark, sf)), _REVERSE, 2.0).select("symbol", "timestamp", "action", "quantity"))


# --- research ---------------------------------------------------------------------------------

_SPAN = """span AS (SELECT symbol, min(timestamp) AS range_start, max(timestamp) AS range_end FROM daily GROUP BY symbol),
windows AS (SELECT symbol, n AS window_no, range_start + n * INTERVAL 90 DAY AS train_start, range_start + n * INTERVAL 90 DAY + INTERVAL 360 DAY AS train_end,
   range_start + n * INTERVAL 90 DAY + INTERVAL 360 DAY AS test_start, range_start + n * INTERVAL 90 DAY + INTERVAL 450 DAY AS test_end, range_end
  FROM (SELECT *, unnest(range(0, date_diff('day', range_start, range_end) // 90 + 1)) AS n FROM span) AS k)"""


def _span(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.min("timestamp").alias("range_start"), F.max("timestamp").alias("range_end"))


def _days(n: int) -> int:
    return n * 86_400_000_000


@query("walk_forward_windows", with_ctes(CANDLES_DAILY, _SPAN, body="SELECT symbol, window_no, train_start, train_end, test_start, test_end FROM windows WHERE test_end <= range_end"))
def walk_forward_windows(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(R.walk_forward(_span(A.candles_lineitem(spark, sf)), ["symbol"], _days(360), _days(90)))


@query("walk_forward_stats", rounded(with_ctes(CANDLES_DAILY, _SPAN, body="""
  SELECT d.symbol, w.window_no, CASE WHEN d.timestamp < w.train_end THEN 'train' ELSE 'test' END AS part, count(*) AS bars, avg(close) AS mean_close
  FROM daily d JOIN windows w ON w.symbol = d.symbol AND d.timestamp >= w.train_start AND d.timestamp < w.test_end WHERE w.test_end <= w.range_end
  GROUP BY 1, 2, 3"""), ["mean_close"]))
def walk_forward_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Bars assigned to every train and test window that covers them."""
    bars = daily_bars(spark, sf)
    rows = R.assign_windows(bars.select("symbol", "timestamp", "close"), _span(bars), ["symbol"], _days(360), _days(90))
    return tidy(rows.groupBy("symbol", "window_no", "part").agg(F.count(F.lit(1)).alias("bars"), F.avg("close").alias("mean_close")))


_SIMS, _WIDE_SIMS, _SEED = 100, 2_000, 7


def _mixed(x: str) -> str:
    """The integer mixer as SQL; lists name the steps so that each is written once."""
    step = lambda shift, factor: f"lambda v: (xor(v, v >> {shift}) * {factor}) & 4294967295"
    inner = f"list_transform(list_transform([{x}], {step(16, 0x7FEB352D)}), {step(15, 0x46CA68B5)})"
    return f"list_transform({inner}, lambda v: xor(v, v >> 16))[1]"


_BOOT_TEXT = f"""t AS (SELECT row_number() OVER (ORDER BY exit_time, symbol) - 1 AS idx, count(*) OVER () AS n, realized_pnl FROM trades),
z AS (SELECT sim, {_mixed(f"(('0x' || substr(md5('{_SEED}|sma'), 1, 8))::BIGINT + sim) & 4294967295")} AS a,
  {_mixed(f"(('0x' || substr(md5('{_SEED}|sma'), 9, 8))::BIGINT + sim) & 4294967295")} AS b FROM (SELECT unnest(range(0, {{sims}})) AS sim) AS s),
d AS (SELECT sim, k, ({_mixed("(" + _mixed("xor(k, a)") + " + b) & 4294967295")} * (SELECT max(n) FROM t)) >> 32 AS idx
  FROM z CROSS JOIN (SELECT idx AS k FROM t) AS ks),
path AS (SELECT sim, k, 10000.0e0 + sum(realized_pnl) OVER (PARTITION BY sim ORDER BY k ROWS UNBOUNDED PRECEDING) AS equity FROM d JOIN t USING (idx)),
roof AS (SELECT *, greatest(10000.0e0, max(equity) OVER (PARTITION BY sim ORDER BY k ROWS UNBOUNDED PRECEDING)) AS peak FROM path),
paths AS (SELECT sim, max_by(equity, k) AS final_equity, max((peak - equity) / peak) AS max_drawdown FROM roof GROUP BY sim)"""


_BOOT, _WIDE_BOOT = (_BOOT_TEXT.replace("{sims}", str(n)) for n in (_SIMS, _WIDE_SIMS))


def _paths(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    bt = _flagship(spark, sf)
    return R.bootstrap_paths(bt.trades, bt.jobs, HOURLY, _SIMS, _SEED, piece=256), bt.jobs


@query("bootstrap_paths", rounded(with_ctes(CANDLES_HOURLY, _SIGNALS, _FILLS, _BOOT, body="SELECT sim, final_equity, max_drawdown FROM paths"),
                                  ["final_equity", "max_drawdown"]))
def bootstrap_paths(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(_paths(spark, sf)[0].select("sim", "final_equity", "max_drawdown"))


@query("bootstrap_summary", rounded(with_ctes(CANDLES_HOURLY, _SIGNALS, _FILLS, _BOOT, body="""
  SELECT 'sma' AS run_id, probability_of_loss, unnest([5, 25, 50, 75, 95]) AS percentile, unnest(e) AS final_equity, unnest(d) AS max_drawdown FROM (
    SELECT avg((final_equity < 10000)::INT) AS probability_of_loss, quantile_cont(final_equity, [0.05, 0.25, 0.5, 0.75, 0.95]) AS e,
      quantile_cont(max_drawdown, [0.05, 0.25, 0.5, 0.75, 0.95]) AS d FROM paths) AS z"""), ["probability_of_loss", "final_equity", "max_drawdown"]))
def bootstrap_summary(spark: SparkSession, sf: str) -> DataFrame:
    paths, jobs = _paths(spark, sf)
    return tidy(R.bootstrap_summary(paths, jobs, simulations=_SIMS))


_PERCENTS = [0, 1, 5, 25, 50, 75, 95, 99, 100]


@query("bootstrap_percentiles_wide", rounded(with_ctes(CANDLES_HOURLY, _SIGNALS, _FILLS, _WIDE_BOOT, body=f"""
  SELECT 'sma' AS run_id, unnest({_PERCENTS}) AS percentile, unnest(e) AS final_equity FROM (
    SELECT quantile_cont(final_equity, {[p / 100 for p in _PERCENTS]}) AS e FROM paths) AS z"""), ["final_equity"]))
def bootstrap_percentiles_wide(spark: SparkSession, sf: str) -> DataFrame:
    """Many paths of one run: percentiles by counting between splitters, so no task takes them all."""
    bt = _flagship(spark, sf)
    paths = R.bootstrap_paths(bt.trades, bt.jobs, HOURLY, _WIDE_SIMS, _SEED, piece=256)
    return tidy(exact_percentiles(paths, ["run_id"], "final_equity", _PERCENTS).withColumnRenamed("value", "final_equity"))


@query("price_percentiles", rounded(f"""
  SELECT symbol, unnest({_PERCENTS}) AS percentile, unnest(q) AS price FROM (
    SELECT concat('P', l_partkey % 2) AS symbol, quantile_cont(l_extendedprice / l_quantity, {[p / 100 for p in _PERCENTS]}) AS q
    FROM lineitem GROUP BY l_partkey % 2) AS z""", ["price"]))
def price_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles of two groups that are the whole table."""
    ticks = A.table(spark, sf, "lineitem").select(
        F.concat(F.lit("P"), F.pmod("l_partkey", F.lit(2)).cast("string")).alias("symbol"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    return tidy(exact_percentiles(ticks, ["symbol"], "price", _PERCENTS).withColumnRenamed("value", "price"))
