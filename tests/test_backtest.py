"""Backtest tables against a plain sequential replay."""

import math
import random

import pytest
from pyspark.sql import functions as F

from perpflow.operators.backtest import run_backtests
from perpflow.operators.chunks import Grid
from perpflow.operators.research import bootstrap_paths, bootstrap_summary, walk_forward
from perpflow.schema import CANDLE, JOB, SIGNAL

PRICES = [100, 101, 102, 101, 99, 105, 110, 108, 95, 90]


def bars(spark, hour, prices, symbol="BTCUSDT"):
    rows = [("SIM", symbol, "1h", hour(h), float(p), p + 2.0, p - 2.0, float(p), 1.0) for h, p in prices]
    return spark.createDataFrame(rows, CANDLE)


def job(spark, hour, symbols, fee=0.0, slip=0.0, hours=10_000, run="r", cash=10_000.0):
    return spark.createDataFrame([(run, "sim", symbols, "1h", hour(0), hour(hours), cash, fee, slip)], JOB)


def signals(spark, hour, rows, run="r"):
    """(hour, symbol, action, quantity[, emit_symbol])"""
    full = [(run, s, hour(h), e[0] if e else s, i, a, q) for i, (h, s, a, q, *e) in enumerate(rows)]
    return spark.createDataFrame(full, SIGNAL)


def simple(spark, hour, rows, prices=PRICES, **options):
    b = bars(spark, hour, list(enumerate(prices)))
    return run_backtests(job(spark, hour, ["BTCUSDT"], **options), b, signals(spark, hour, rows), Grid("1h", 4, 2))


def test_next_bar_fill(spark, hour):
    bt = simple(spark, hour, [(1, "BTCUSDT", "ENTER_LONG", 1.0), (6, "BTCUSDT", "EXIT", None)])
    (t,) = bt.trades.collect()
    assert (t.entry_price, t.exit_price, t.realized_pnl, t.side) == (102.0, 108.0, 6.0, "LONG")
    assert bt.summary.first().final_equity == 10_006.0


def test_last_bar_signal_is_unfilled(spark, hour):
    bt = simple(spark, hour, [(9, "BTCUSDT", "ENTER_LONG", 1.0)])
    assert bt.trades.count() == 0 and bt.unfilled_signals.count() == 1
    s = bt.summary.first()
    assert s.num_trades == 0 and s.win_rate is None and s.profit_factor is None and s.max_drawdown == 0.0


def test_exit_without_position_is_ignored(spark, hour):
    bt = simple(spark, hour, [(1, "BTCUSDT", "EXIT", None), (2, "BTCUSDT", "ENTER_SHORT", 2.0)])
    assert [r.quantity_after for r in bt.fills.collect()] == [-2.0]


def test_two_exits_on_one_bar_flip(spark, hour):
    bt = simple(spark, hour, [(0, "BTCUSDT", "ENTER_LONG", 1.0), (3, "BTCUSDT", "EXIT", None), (3, "BTCUSDT", "EXIT", None)])
    last = bt.fills.orderBy(F.desc("fill_time"), F.desc("step")).first()
    assert last.quantity_after == -1.0 and last.closed_quantity == 0.0


def test_extend_reduce_flip(spark, hour):
    rows = [(0, "BTCUSDT", "ENTER_LONG", 1.0), (1, "BTCUSDT", "ENTER_LONG", 3.0), (2, "BTCUSDT", "ENTER_SHORT", 1.0), (3, "BTCUSDT", "ENTER_SHORT", 5.0)]
    fills = simple(spark, hour, rows).fills.orderBy("fill_time").collect()
    assert [f.average_after for f in fills] == [101.0, 101.75, 101.75, 99.0]
    assert [f.closed_quantity for f in fills] == [0.0, 0.0, 1.0, 3.0]
    assert [f.realized_pnl for f in fills] == [0.0, 0.0, -0.75, (99 - 101.75) * 3]


def test_costs(spark, hour):
    bt = simple(spark, hour, [(1, "BTCUSDT", "ENTER_LONG", 2.0), (6, "BTCUSDT", "EXIT", None)], fee=0.001, slip=10.0)
    (t,) = bt.trades.collect()
    assert t.entry_price == pytest.approx(102 * 1.001) and t.exit_price == pytest.approx(108 * 0.999)
    assert t.fee == pytest.approx(t.exit_price * 2 * 0.001)
    assert t.realized_pnl == pytest.approx((t.exit_price - t.entry_price) * 2)  # gross of fees


def test_rejects_and_bad_jobs(spark, hour):
    bt = simple(spark, hour, [(1, "BTCUSDT", "ENTER_LONG", 0.0), (1, "XRP", "ENTER_LONG", 1.0), (1, "BTCUSDT", "HOLD", 1.0)])
    assert sorted(r.reason for r in bt.rejected_signals.collect()) == ["entry needs a positive quantity", "unknown action", "unknown symbol"]
    bad = simple(spark, hour, [(1, "BTCUSDT", "ENTER_LONG", 1.0)], cash=0.0)
    assert bad.failed_jobs.first().error == "initial_cash must be positive" and bad.fills.count() == 0


def test_profit_factor_without_loss_is_infinite(spark, hour):
    bt = simple(spark, hour, [(1, "BTCUSDT", "ENTER_LONG", 1.0), (6, "BTCUSDT", "EXIT", None)])
    s = bt.summary.first()
    assert math.isinf(s.profit_factor) and s.win_rate == 1.0


def test_signal_for_a_later_symbol_fills_on_the_same_timestamp(spark, hour):
    both = bars(spark, hour, list(enumerate(PRICES)), "AAA").unionByName(bars(spark, hour, list(enumerate(PRICES)), "BBB"))
    table = signals(spark, hour, [(2, "BBB", "ENTER_LONG", 1.0, "AAA"), (2, "AAA", "ENTER_LONG", 1.0, "BBB")])
    bt = run_backtests(job(spark, hour, ["AAA", "BBB"]), both, table, Grid("1h", 4, 2))
    filled = {r.symbol: r.fill_price for r in bt.fills.collect()}
    assert filled == {"BBB": 102.0, "AAA": 101.0}


# --- replay -----------------------------------------------------------------------------------

def replay(bar_rows, signal_rows, fee, slip, cash):
    """Visits bars in (time, symbol) order: fill, mark, snapshot, then queue the bar's signals."""
    position, pending, trades, curve, money = {}, {}, [], [], cash
    emitted = {}
    for i, (h, symbol, action, q, emit) in enumerate(signal_rows):
        emitted.setdefault((h, emit), []).append((i, symbol, action, q))
    for h, symbol, o, c in sorted(bar_rows):
        qty, avg, unreal = position.get(symbol, (0.0, 0.0, 0.0))
        for side, n in pending.pop(symbol, []):
            price = o * (1 + slip / 1e4) if side > 0 else o * (1 - slip / 1e4)
            money -= price * n * fee
            if qty == 0 or (qty > 0) == (side > 0):
                avg = (avg * abs(qty) + price * n) / (abs(qty) + n)
                qty += side * n
            else:
                closing = min(abs(qty), n)
                pnl = (price - avg) * closing * (1 if qty > 0 else -1)
                money += pnl
                trades.append((symbol, h, closing, pnl))
                left = qty + side * n
                avg = 0.0 if left == 0 else avg if (left > 0) == (qty > 0) else price
                qty = left
        unreal = (c - avg) * qty if qty else 0.0
        position[symbol] = (qty, avg, unreal)
        curve.append((h, symbol, money + sum(p[2] for p in position.values())))
        for _, target, action, q in emitted.get((h, symbol), []):
            have = position.get(target, (0.0,))[0]
            if action == "EXIT":
                if have:
                    pending.setdefault(target, []).append((-1 if have > 0 else 1, abs(have)))
            else:
                pending.setdefault(target, []).append((1 if action == "ENTER_LONG" else -1, q))
    return trades, curve


@pytest.mark.parametrize("seed,chunk", [(1, 5), (2, 24), (3, 100_000), (4, 9)])
def test_random_replay(spark, hour, seed, chunk):
    """Quarter quantities are exact in binary, so the replay and the fold agree to the last trade."""
    rng = random.Random(seed)
    symbols = ["AAA", "BBB", "CCC"]
    hours = sorted(rng.sample(range(400), 220))
    bar_rows = [(h, s, float(rng.randrange(50, 150)), float(rng.randrange(50, 150))) for h in hours for s in symbols if rng.random() < 0.8]
    seen = {(h, s) for h, s, _, _ in bar_rows}
    sig = []
    for h, emit in sorted(seen):
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            action = rng.choice(["ENTER_LONG", "ENTER_SHORT", "EXIT"])
            sig.append((h, rng.choice(symbols) if rng.random() < 0.3 else emit, action, None if action == "EXIT" else rng.choice([0.25, 0.5, 1.0, 1.75]), emit))
    want_trades, want_curve = replay(bar_rows, sig, 0.001, 5.0, 10_000.0)

    rows = [("SIM", s, "1h", hour(h), o, max(o, c), min(o, c), c, 1.0) for h, s, o, c in bar_rows]
    table = signals(spark, hour, [(h, s, a, q, e) for h, s, a, q, e in sig])
    bt = run_backtests(job(spark, hour, symbols, 0.001, 5.0), spark.createDataFrame(rows, CANDLE), table, Grid("1h", chunk, 3))
    got = bt.trades.orderBy("exit_time", "symbol", "step").collect()
    assert len(got) == len(want_trades)
    for g, (s, h, n, pnl) in zip(got, want_trades):
        assert (g.symbol, g.exit_time) == (s, hour(h).replace(tzinfo=None)) and g.quantity == n
        assert g.realized_pnl == pytest.approx(pnl, abs=1e-8)
    curve = bt.equity.orderBy("timestamp", "symbol").collect()
    assert [r.equity for r in curve] == pytest.approx([e for _, _, e in want_curve], abs=1e-6)
    peak, worst = -math.inf, 0.0
    for _, _, e in want_curve:
        peak = max(peak, e)
        worst = max(worst, (peak - e) / peak)
    assert bt.summary.first().max_drawdown == pytest.approx(worst, abs=1e-9)


# --- research ---------------------------------------------------------------------------------

def _trades(spark, hour, pnls):
    rows = [("r", "A", hour(i), 0, float(p)) for i, p in enumerate(pnls)]
    return spark.createDataFrame(rows, "run_id string, symbol string, exit_time timestamp, step bigint, realized_pnl double")


def test_bootstrap_is_seeded_and_ordered(spark, hour):
    jobs = job(spark, hour, ["A"])
    trades = _trades(spark, hour, [10, -5, 20, -15, 3, 8, -2, 12])
    grid = Grid("1h", 3, 2)
    a, b = (bootstrap_summary(bootstrap_paths(trades, jobs, grid, 50, 3, piece=3), jobs).orderBy("percentile").collect() for _ in range(2))
    assert a == b
    assert [r.final_equity for r in a] == sorted(r.final_equity for r in a)
    whole = bootstrap_paths(trades, jobs, grid, 50, 3, piece=1000).orderBy("sim").collect()
    cut = bootstrap_paths(trades, jobs, grid, 50, 3, piece=2).orderBy("sim").collect()
    assert [(r.sim, round(r.final_equity, 9), round(r.max_drawdown, 9)) for r in whole] == [
        (r.sim, round(r.final_equity, 9), round(r.max_drawdown, 9)) for r in cut]


def test_bootstrap_without_trades(spark, hour):
    jobs = job(spark, hour, ["A"])
    rows = bootstrap_summary(bootstrap_paths(_trades(spark, hour, [1]).limit(0), jobs, Grid("1h", 3, 2), 10, 0), jobs, (5, 95)).collect()
    assert {(r.final_equity, r.max_drawdown, r.probability_of_loss) for r in rows} == {(10_000.0, 0.0, 0.0)}


def test_all_losing_trades_always_lose(spark, hour):
    jobs = job(spark, hour, ["A"])
    rows = bootstrap_summary(bootstrap_paths(_trades(spark, hour, [-1, -2]), jobs, Grid("1h", 3, 2), 20, 0), jobs).collect()
    assert all(r.probability_of_loss == 1.0 and r.max_drawdown > 0 for r in rows)


def test_walk_forward_drops_partial_windows(spark, hour):
    span = spark.createDataFrame([("a", hour(0), hour(100))], "k string, range_start timestamp, range_end timestamp")
    h = 3_600_000_000
    rows = walk_forward(span, ["k"], 40 * h, 20 * h).orderBy("window_no").collect()
    assert [r.window_no for r in rows] == [0, 1, 2] and rows[-1].test_end == hour(100).replace(tzinfo=None)
    assert walk_forward(span, ["k"], 90 * h, 20 * h).count() == 0
    with pytest.raises(ValueError):
        walk_forward(span, ["k"], 0, 20 * h)


@pytest.mark.parametrize("rows", [1, 2, 3, 1000])
def test_fractions_close_alike_on_every_grid(spark, hour, rows):
    b = bars(spark, hour, list(enumerate(PRICES)))
    table = signals(spark, hour, [(0, "BTCUSDT", "ENTER_LONG", 0.1), (1, "BTCUSDT", "ENTER_LONG", 0.2), (2, "BTCUSDT", "ENTER_LONG", 0.3),
                                  (3, "BTCUSDT", "ENTER_SHORT", 0.6), (5, "BTCUSDT", "EXIT", None), (9, "BTCUSDT", "EXIT", None)])
    bt = run_backtests(job(spark, hour, ["BTCUSDT"]), b, table, Grid("1h", rows, 1))
    (t,) = bt.trades.collect()
    assert (t.quantity, t.exit_price) == (0.6, 99.0) and abs(t.entry_price - (10.1 + 20.4 + 30.3) / 0.6) < 1e-9
    assert [r.reason for r in bt.rejected_signals.collect()] == ["no open position"] * 2
    assert bt.unfilled_signals.count() == 0
