"""Compare registered queries with their DuckDB twins: python tests/check_oracles.py [sf] [names...]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return ""
        if isinstance(v, pd.Timestamp):
            return v.isoformat()
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.ndim == 0:
            f = float(v)
            return str(int(f)) if f == int(f) and abs(f) < 1e15 else repr(f) if not math.isinf(f) else str(f)
        return str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(cell(v) for v in row) for row in df.itertuples(index=False))


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    a, b = canonical(got), canonical(want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}: {[x for x in a if x not in set(b)][:3]} | {[x for x in b if x not in set(a)][:3]}"
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(diff)}/{len(a)} differ, e.g. {diff[0]}" if diff else None


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from perpflow.session import build_session

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("sf") else "sf0.01"
    folder = f"/root/testdata/{sf}"
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = duck(folder), oracle_sql(), []
    for name, fn in queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        started = time.time()
        try:
            got = fn(spark, folder).toPandas()
            took = time.time() - started
            if name not in sqls:
                print(f"rows {name}: {len(got)} ({took:.1f}s)", flush=True)
                continue
            t2 = time.time()
            problem = compare(got, con.execute(sqls[name]).df())
            print(f"{'ok  ' if problem is None else 'BAD '} {name}: {len(got)} ({took:.1f}s, duck {time.time() - t2:.1f}s) {problem or ''}", flush=True)
        except Exception as exc:  # noqa: BLE001
            problem = str(exc)[:1500]
            print(f"FAIL {name}: {problem}", flush=True)
        if problem:
            bad.append(name)
    print("bad:", bad)
