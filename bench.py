"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

Per query: one warm-up, then the median of three runs, forced with the noop sink. Building
the plan and writing intermediate tables count as part of the run.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from perpflow.plans.registry import QUERIES
from perpflow.session import build_session

HEADLINE = [
    "candles_hourly", "candles_daily", "land_candles", "upsert_last_wins", "gap_islands", "quality_series",
    "features_price_daily", "features_funding", "features_open_interest", "features_liquidation", "features_long_short",
    "funding_latest", "funding_series", "open_interest_series", "range_latest", "range_series_daily", "liquidity_latest",
    "liquidity_series", "timeframe_asof", "signals_next_bar", "backtest_trades", "backtest_equity", "backtest_summary",
    "walk_forward_stats", "bootstrap_summary", "rules_applied", "rule_audit", "score_rows", "signal_states", "no_trade_gate",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"),
    })
    spark.sparkContext.setLogLevel("ERROR")
    wanted = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    took = {}
    for name in wanted:
        times = []
        for _ in range(runs + 1):
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - started)
        took[name] = round(statistics.median(times[1:]), 3)
    print(json.dumps({"metric": "headline queries, warm median", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
