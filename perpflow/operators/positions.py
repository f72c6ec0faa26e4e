"""Net positions from orders: extend, reduce, close, flip, exit.

The state of one (run, symbol) is (quantity, average price). Both are affine in their value
before a bar or a fill: all exits of a bar size themselves from the quantity q before it, so the
bar maps q to (1 - exits) * q + entries; an extension mixes the average with the fill price; a
reduction keeps it; open, flip and close replace it. Affine maps compose, and ``carry_affine``
composes them chunk by chunk in parallel.

Quantities are counted in whole ``UNIT``s, so sums do not depend on how a series is cut: 0.1 +
0.2 + 0.3 - 0.6 is flat, where doubles added in turn keep a remainder. This is a deviation on purpose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from perpflow.operators.chunks import CHUNK, Grid
from perpflow.operators.scans import carry_affine
from perpflow.operators.signals import EXIT, RUN
from perpflow.session import cut_lineage

_ORDER = ["fill_time", "timestamp", "emit_symbol", "seq"]
#: Smallest quantity that is told apart.
UNIT = 1e-8


def asked_units() -> Column:
    """Signed units that an entry asks for; NULL for an exit."""
    units = F.round(F.col("quantity") / F.lit(UNIT)).cast("bigint")
    return F.when(F.col("action") == "ENTER_LONG", units).when(F.col("action") == "ENTER_SHORT", -units)


def settle(orders: DataFrame, grid: Grid, *, checkpoint: bool = True) -> DataFrame:
    """Orders with their signed quantity and the quantity held before, in units; NULL for an exit without a position.

    ``orders`` come from ``signals.priced``. The quantity before a bar is carried over bars; within a
    bar it is a running sum.
    """
    placed = orders.withColumn("emit_symbol", F.coalesce("emit_symbol", "symbol")).withColumn(CHUNK, grid.chunk(orders, "fill_time"))
    placed = placed.withColumn("_asked", asked_units())
    per_bar = placed.groupBy(*RUN, CHUNK, "fill_time").agg(
        (F.lit(1).cast("bigint") - F.count_if(F.col("action") == EXIT)).alias("_a"), F.coalesce(F.sum("_asked"), F.lit(0).cast("bigint")).alias("_b"))
    bars = carry_affine(per_bar, RUN, CHUNK, ["fill_time"], "_a", "_b", "_held", "bigint").drop("_a", "_b")
    # An exit of a flat bar has nothing to do; its size stays NULL and is passed over by the sum.
    signed = F.coalesce("_asked", F.when(F.col("_held") != 0, -F.col("_held")))
    in_bar = W.partitionBy(*RUN, CHUNK, "fill_time").orderBy("timestamp", "emit_symbol", "seq").rowsBetween(W.unboundedPreceding, -1)
    settled = placed.join(bars, [*RUN, CHUNK, "fill_time"]).withColumn("signed", signed)
    settled = settled.withColumn("before", F.col("_held") + F.coalesce(F.sum("signed").over(in_bar), F.lit(0))).drop("_asked", "_held")
    return cut_lineage(settled) if checkpoint else settled


def idle_exits(settled: DataFrame) -> DataFrame:
    """Exits that found no position."""
    return settled.filter("signed IS NULL").drop("signed", "before", CHUNK)


def held_at_end(settled: DataFrame) -> DataFrame:
    """(run_id, symbol, held): units left after the last fill."""
    return settled.groupBy(*RUN).agg(F.coalesce(F.sum("signed"), F.lit(0)).alias("held"))


def fold_positions(settled: DataFrame, *, checkpoint: bool = True) -> DataFrame:
    """Fills with the position before and after each, the average price and the realised result.

    Fills that close something are the trades. Every result reads the fills again, hence the checkpoint.
    """
    before, signed = F.col("before"), F.col("signed")
    after, price = before + signed, F.when(signed > 0, F.col("buy_price")).otherwise(F.col("sell_price"))
    extends = (before != 0) & (F.signum(before) == F.signum(signed))
    keeps = (before != 0) & (after != 0) & (F.signum(after) == F.signum(before))
    share = F.abs(before) / F.abs(after)
    steps = settled.filter("signed IS NOT NULL AND signed <> 0").select(
        *RUN, CHUNK, *_ORDER, "signed", "before", "fee_rate", price.alias("fill_price"),
        F.when(extends, share).when(keeps, 1.0).otherwise(0.0).alias("_a"),
        F.when(extends, price * F.abs(signed) / F.abs(after)).when(keeps | (after == 0), 0.0).otherwise(price).alias("_b"))
    averaged = carry_affine(steps, RUN, CHUNK, _ORDER, "_a", "_b", "average_before")
    unit = F.lit(UNIT)
    amount = lambda c: F.round(c * unit, 8)
    held, left = F.col("before"), F.col("before") + F.col("signed")
    closing = F.when(held * F.signum(left) < 0, F.abs(held)).otherwise(F.greatest(F.abs(held) - F.abs(left), F.lit(0)))
    closed = F.when(held == 0, F.lit(0)).otherwise(closing)
    fills = averaged.select(
        *RUN, "fill_time", (F.row_number().over(W.partitionBy(*RUN, CHUNK).orderBy(*_ORDER)) - 1).cast("bigint").alias("step"),
        F.when(F.col("signed") > 0, "BUY").otherwise("SELL").alias("side"), amount(F.abs("signed")).alias("quantity"), "fill_price",
        (F.col("fill_price") * amount(F.abs("signed")) * F.col("fee_rate")).alias("fee"), amount(held).alias("quantity_before"),
        amount(left).alias("quantity_after"), "average_before", (F.col("_a") * F.col("average_before") + F.col("_b")).alias("average_after"),
        amount(closed).alias("closed_quantity"))
    fills = fills.withColumn(
        "realized_pnl",
        F.when(F.col("closed_quantity") > 0,
               (F.col("fill_price") - F.col("average_before")) * F.col("closed_quantity") * F.signum("quantity_before")).otherwise(0.0))
    return cut_lineage(fills) if checkpoint else fills


def trades(fills: DataFrame) -> DataFrame:
    """One row per fill that closed all or part of a position; the fee is that fill's whole fee."""
    return fills.filter("closed_quantity > 0").select(
        "run_id", "symbol",
        F.when(F.col("quantity_before") > 0, "LONG").otherwise("SHORT").alias("side"),
        F.col("closed_quantity").alias("quantity"),
        F.col("average_before").alias("entry_price"),
        F.col("fill_price").alias("exit_price"),
        F.col("fill_time").alias("exit_time"),
        "step", "realized_pnl", "fee",
    )
