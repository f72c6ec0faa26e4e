"""Walk-forward windows and bootstrap validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from perpflow.functions.numeric import micros
from perpflow.operators.chunks import CHUNK, Grid, add_running, chunk_totals, path_in_parts
from perpflow.operators.equity import drawdown
from perpflow.operators.interval_join import interval_join
from perpflow.operators.quantiles import exact_percentiles
from perpflow.session import cut_lineage

DEFAULT_PERCENTILES = (5, 25, 50, 75, 95)
#: Draws that one task makes at most, about.
DRAWS = 1_000_000
#: Paths of one run that a single task may put in order.
GATHERED = 100_000


def _positive(**values) -> None:
    for name, value in values.items():
        if value <= 0:
            raise ValueError(f"{name} must be positive")


def walk_forward(ranges: DataFrame, keys: Sequence[str], train, test, step=None) -> DataFrame:
    """All complete (train, test) windows inside each (range_start, range_end), numbered from 0."""
    train_us, test_us = micros(train), micros(test)
    step_us = test_us if step is None else micros(step)
    _positive(train_period=train_us, test_period=test_us, step=step_us)
    first, last = F.unix_micros("range_start"), F.unix_micros("range_end") - train_us - test_us
    starts = F.when(first <= last, F.sequence(first, last, F.lit(step_us))).otherwise(F.array().cast("array<bigint>"))
    at = F.col("_s")
    return ranges.select(*keys, F.posexplode(starts).alias("window_no", "_s")).select(
        *keys, F.col("window_no").cast("bigint").alias("window_no"),
        F.timestamp_micros(at).alias("train_start"),
        F.timestamp_micros(at + train_us).alias("train_end"),
        F.timestamp_micros(at + train_us).alias("test_start"),
        F.timestamp_micros(at + train_us + test_us).alias("test_end"),
    )


def assign_windows(rows: DataFrame, ranges: DataFrame, keys: Sequence[str], train, test, step=None) -> DataFrame:
    """Each row with every (window_no, part) it belongs to; starts count, ends do not.

    A row meets only the ranges that cover it, however many there are; window numbers follow from arithmetic
    on the row's own timestamp, so it is copied once per window.
    """
    train_us, test_us = micros(train), micros(test)
    step_us = test_us if step is None else micros(step)
    _positive(train_period=train_us, test_period=test_us, step=step_us)
    wanted = ranges.select(*keys, "range_start", "range_end")
    joined = interval_join(rows, wanted, keys, "timestamp", "range_start", "range_end", step_us).withColumns({
        "_a": F.unix_micros("range_start"), "_b": F.unix_micros("range_end")})
    at = F.unix_micros("timestamp") - F.col("_a")
    count = F.floor((F.col("_b") - F.col("_a") - train_us - test_us) / step_us) + 1

    def covering(begin: int, length: int, part: str) -> Column:
        low = F.greatest(F.floor((at - begin - length) / step_us) + 1, F.lit(0))
        high = F.least(F.floor((at - begin) / step_us), count - 1)
        numbers = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(numbers, lambda n: F.struct(n.alias("window_no"), F.lit(part).alias("part")))

    hits = F.concat(covering(0, train_us, "train"), covering(train_us, test_us, "test"))
    return joined.select(*rows.columns, F.inline(hits))


_MASK = 0xFFFFFFFF


def mixed(x: Column) -> Column:
    """A bijection of 32 bits (in a bigint) after which each bit depends on every other; products stay below 2^63."""
    x = ((x.bitwiseXOR(F.shiftrightunsigned(x, 16))) * 0x7FEB352D).bitwiseAND(F.lit(_MASK))
    x = ((x.bitwiseXOR(F.shiftrightunsigned(x, 15))) * 0x46CA68B5).bitwiseAND(F.lit(_MASK))
    return x.bitwiseXOR(F.shiftrightunsigned(x, 16))


def stream_keys(seed: int, run: Column, sim: Column) -> tuple[Column, Column]:
    """Two words of 32 bits that name the stream of draws of one simulation."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), run))
    word = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint")
    return tuple(mixed((word(at) + sim).bitwiseAND(F.lit(_MASK))) for at in (1, 9))


def draw(first: Column, second: Column, k: Column, n: Column) -> Column:
    """Uniform index in [0, n), n below 2^31: draw k of a stream, from its number alone and in any order."""
    inner = mixed(k.cast("bigint").bitwiseAND(F.lit(_MASK)).bitwiseXOR(first))
    return F.shiftrightunsigned(mixed((inner + second).bitwiseAND(F.lit(_MASK))) * n, 32)


def number_trades(trades: DataFrame, grid: Grid) -> DataFrame:
    """Trades with their 0-based index per run in (exit_time, symbol, step) order."""
    rows = trades.withColumn(CHUNK, grid.chunk(trades, "exit_time"))
    one = {"_n": ("count", F.lit(1))}
    numbered = add_running(rows, chunk_totals(rows, ["run_id"], one), ["run_id"], ["exit_time", "symbol", "step"], one)
    return numbered.withColumn("idx", F.col("_n") - 1).drop("_n", CHUNK)


def bootstrap_paths(trades: DataFrame, jobs: DataFrame, grid: Grid, simulations: int = 1000, seed: int = 0,
                    piece: int = 4096) -> DataFrame:
    """Per (run, sim): final equity and maximum drawdown of one resample with replacement.

    Draw k of a simulation picks a trade by index, from an integer mixer over (seed, run, sim, k). Draws are made in
    pieces of ``piece``; one shuffle deals out the pieces, and their paths are summed where they are made. The numbered
    trades are a written table: while small they go to every task, else draws and trades meet in an equi-join on (run,
    index), where every trade is hit about ``simulations`` times and no key is hot. The peak starts at the initial cash.
    """
    _positive(simulations=simulations)
    indexed = cut_lineage(number_trades(trades, grid).select("run_id", "idx", "realized_pnl"))
    sizes = indexed.groupBy("run_id").agg((F.max("idx") + 1).alias("n"))
    pieces = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(piece).cast("bigint")))
    first, second = stream_keys(seed, F.col("run_id"), F.col("sim"))
    sims = sizes.withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(simulations - 1)))).withColumns({"_first": first, "_second": second})
    # The pieces are a few bytes each before they become draws: a number of partitions keeps them from being put together.
    tasks = max(int(trades.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-indexed.count() * simulations // DRAWS))
    starts = sims.withColumn("_from", pieces).repartition(tasks, "run_id", "sim", "_from")
    upto = F.least(F.col("n"), F.col("_from") + piece) - 1
    draws = starts.withColumn("k", F.explode(F.sequence(F.col("_from"), upto))).select(
        "run_id", "sim", "_from", "k", draw(F.col("_first"), F.col("_second"), F.col("k"), F.col("n")).alias("idx"))
    drawn = draws.join(indexed, ["run_id", "idx"]).drop("idx")
    path = path_in_parts(drawn, ["run_id", "sim"], ["k"], "realized_pnl", "_from")
    start = F.col("initial_cash")
    equity, peak = start + F.col("gain"), start + F.greatest("high", F.lit(0.0))
    return path.join(jobs.select("run_id", "initial_cash"), "run_id").groupBy("run_id", "sim").agg(
        F.max_by(equity, "k").alias("final_equity"),
        F.max(drawdown(equity, peak)).alias("max_drawdown"),
        F.max(start).alias("initial_cash"),
    )


def bootstrap_summary(paths: DataFrame, jobs: DataFrame, percentiles: Sequence[int] = DEFAULT_PERCENTILES,
                      simulations: int = 1000) -> DataFrame:
    """Per run and percentile: final equity and drawdown, plus the probability of loss.

    ``simulations`` says how many paths a run has: up to ``GATHERED`` of them are put in order in one task, more are
    counted between splitters (``quantiles``), with the same result. A run without trades keeps its initial cash at every percentile.
    """
    if not percentiles or any(not 0 <= p <= 100 for p in percentiles):
        raise ValueError("percentiles must be a non-empty list of numbers in [0, 100]")
    chosen = sorted(percentiles)
    if simulations > GATHERED:
        paths = cut_lineage(paths)
    lost = F.avg((F.col("final_equity") < F.col("initial_cash")).cast("double")).alias("probability_of_loss")
    listed = jobs.select("run_id", "initial_cash")
    if simulations > GATHERED:
        rows = F.explode(F.array(*[F.lit(p) for p in chosen])).alias("percentile")
        found = listed.join(paths.groupBy("run_id").agg(lost), "run_id", "left").select("run_id", "initial_cash", "probability_of_loss", rows)
        for name in ("final_equity", "max_drawdown"):
            stats = exact_percentiles(paths, ["run_id"], name, chosen).withColumnRenamed("value", name)
            found = found.join(stats, ["run_id", "percentile"], "left")
        return found.select(
            "run_id", F.coalesce("probability_of_loss", F.lit(0.0)).alias("probability_of_loss"), "percentile",
            F.coalesce("final_equity", "initial_cash").alias("final_equity"), F.coalesce("max_drawdown", F.lit(0.0)).alias("max_drawdown"))
    shares = F.array(*[F.lit(p / 100) for p in chosen])
    stats = paths.groupBy("run_id").agg(F.percentile("final_equity", shares).alias("e"), F.percentile("max_drawdown", shares).alias("d"), lost)
    rows = F.inline(F.arrays_zip(F.array(*[F.lit(p) for p in chosen]).alias("percentile"), F.col("e"), F.col("d")))
    filled = listed.join(stats, "run_id", "left").select(
        "run_id", F.coalesce("probability_of_loss", F.lit(0.0)).alias("probability_of_loss"),
        F.coalesce("e", F.array_repeat("initial_cash", len(chosen))).alias("e"),
        F.coalesce("d", F.array_repeat(F.lit(0.0), len(chosen))).alias("d"),
    )
    return filled.select("run_id", "probability_of_loss", rows.alias("percentile", "final_equity", "max_drawdown"))
