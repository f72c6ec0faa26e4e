"""Ordered computation over long series, cut into bounded pieces of time.

A window over ``partitionBy(series)`` puts a whole series into one task. A series may hold a
large part of the table, so every ordered operator here works on (series, chunk) instead: a
chunk is a fixed span of the series grid, hence has a bounded number of rows.

* Bounded frames ("the last n rows"): ``lead_in`` copies to each chunk the rows just before
  it, as many as the widest frame needs, across gaps and empty chunks.
* Running totals from the start of the series: ``running`` adds the totals of all earlier
  chunks, taken from a table with one row per chunk.
* Only the newest n rows matter: ``newest`` prunes before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, WindowSpec, functions as F, types as T

from perpflow.schema import step_micros

CHUNK, OWN = "_chunk", "_own"


@dataclass(frozen=True)
class Grid:
    """How to cut a series: ``rows`` grid steps form one chunk.

    ``step`` is a bar code or microseconds for timestamps, a plain number for other orders.
    ``slots`` is how finely the end of a chunk is resolved when its rows are lent to the next
    one: at most one slot more than needed is copied.
    """

    step: str | int = "1h"
    rows: int = 4096
    slots: int = 32

    @property
    def span(self) -> int:
        return max(step_micros(self.step) * self.rows, self.slots)

    def position(self, df: DataFrame, order: str) -> Column:
        kind = df.schema[order].dataType
        if isinstance(kind, T.TimestampNTZType):
            return F.unix_micros(F.col(order).cast("timestamp"))
        if isinstance(kind, T.TimestampType):
            return F.unix_micros(F.col(order))
        return F.col(order).cast("bigint")

    def chunk(self, df: DataFrame, order: str) -> Column:
        position, span = self.position(df, order), F.lit(self.span)
        return ((position - F.pmod(position, span)) / span).cast("bigint")

    def slot(self, df: DataFrame, order: str) -> Column:
        offset = F.pmod(self.position(df, order), F.lit(self.span))
        return F.floor(offset * F.lit(self.slots) / F.lit(self.span)).cast("int")


def window(keys: Sequence[str], *order: str | Column) -> WindowSpec:
    """The window of one chunk."""
    return W.partitionBy(*keys, CHUNK).orderBy(*order)


def own(df: DataFrame) -> DataFrame:
    """Drop the borrowed rows and the bookkeeping columns."""
    return df.filter(F.col(OWN)).drop(CHUNK, OWN)


def placed_rows(df: DataFrame, keys: Sequence[str], order: str, grid: Grid) -> DataFrame:
    """Rows with their ``_chunk``, shuffled by (series, chunk).

    Keys and positions are never NULL in canonical data; a row without one is in no series.
    Saying so here, and not leaving it to the joins further up, keeps all readers of this
    shuffle identical, so that Spark runs it once.
    """
    part = [*keys, CHUNK]
    return df.withColumn(CHUNK, grid.chunk(df, order)).filter(known(part)).repartition(*part)


def known(columns: Sequence[str]) -> Column:
    every = F.lit(True)
    for name in columns:
        every = every & F.col(name).isNotNull()
    return every


def unplaced(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The rows that belong to no series: without a key or a position. Every chunked operator leaves them out."""
    return df.filter(~known([*keys, order]))


def lead_in(df: DataFrame, keys: Sequence[str], order: str, grid: Grid, before: int,
            count_on: DataFrame | None = None) -> DataFrame:
    """Add ``_chunk`` and ``_own``; every chunk also gets the ``before`` rows that precede it.

    Rows per chunk and per trailing slot are counted first (a small aggregate over the key
    columns only). The full rows are shuffled once by (series, chunk); what travels in
    addition is the borrowed tail. ``count_on`` may name a cheaper table with the same keys
    and order values to count on.
    """
    part = [*keys, CHUNK]
    if before <= 0:
        return df.withColumn(CHUNK, grid.chunk(df, order)).filter(known(part)).withColumn(OWN, F.lit(True))

    basis = df if count_on is None else count_on
    placed_keys = basis.select(*keys, grid.chunk(basis, order).alias(CHUNK), grid.slot(basis, order).alias("_slot"))
    counted = placed_keys.groupBy(*part).agg(
        F.array(*[F.count_if(F.col("_slot") >= s) for s in range(grid.slots)]).alias("_tail")
    )
    # Rows before each chunk. A chunk lends to the later ones that begin less than ``before`` rows after its end,
    # that is after the beginning of the next chunk: a range of this count, and never an array of more chunks.
    along = W.partitionBy(*keys).orderBy(CHUNK)
    begun = counted.withColumn("_rows_before", F.coalesce(F.sum(F.col("_tail")[0]).over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    wanting = F.collect_list(F.struct(F.col(CHUNK).alias("to"), F.col("_rows_before").alias("rows"))).over(
        W.partitionBy(*keys).orderBy("_rows_before").rangeBetween(0, before - 1))
    end = F.col("_rows_before") + F.col("_tail")[0]
    loans = (
        begun.withColumn("_wanting", wanting).withColumn("_later", F.lead("_wanting").over(along))
        .withColumn("_loan", F.explode("_later"))
        .withColumn("_want", F.lit(before) - (F.col("_loan.rows") - end))
        .select(
            *part,
            F.col("_loan.to").alias("_loan_to"),
            F.greatest(F.size(F.filter("_tail", lambda t: t >= F.col("_want"))) - 1, F.lit(0)).alias("_loan_slot"),
        )
    )
    placed = placed_rows(df, keys, order, grid)
    borrowed = (
        # Few loans per partition: hashing them spares a second sort of the full rows.
        placed.join(loans.hint("shuffle_hash"), part)
        .filter(grid.slot(df, order) >= F.col("_loan_slot"))
        .withColumn(CHUNK, F.col("_loan_to"))
        .withColumn(OWN, F.lit(False))
        .select(*placed.columns, OWN)
        .repartition(*part)
    )
    return placed.withColumn(OWN, F.lit(True)).unionByName(borrowed)


_FINISH = {
    "sum": lambda inner, base: inner + F.coalesce(base, F.lit(0)),
    "count": lambda inner, base: inner + F.coalesce(base, F.lit(0)),
    "max": lambda inner, base: F.greatest(inner, base),
    "min": lambda inner, base: F.least(inner, base),
}
_FUNCTION = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}
_MERGE = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}


def chunk_totals(df: DataFrame, keys: Sequence[str], totals: dict[str, tuple[str, Column]]) -> DataFrame:
    """For each chunk, each total over all *earlier* chunks of its series (NULL if none)."""
    names = list(totals)
    per_chunk = df.groupBy(*keys, CHUNK).agg(
        *[_FUNCTION[fn](value).alias(name) for name, (fn, value) in totals.items()]
    )
    earlier = W.partitionBy(*keys).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    return per_chunk.select(
        *keys, CHUNK, *[_MERGE[totals[n][0]](n).over(earlier).alias(f"_base_{n}") for n in names]
    )


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], grid: Grid,
            totals: dict[str, tuple[str, Column]]) -> DataFrame:
    """Totals from the start of the series up to each row: ``{name: (sum|count|max|min, value)}``."""
    rows = df.withColumn(CHUNK, grid.chunk(df, order[0]))
    return add_running(rows, chunk_totals(rows, keys, totals), keys, order, totals).drop(CHUNK)


def add_running(rows: DataFrame, bases: DataFrame, keys: Sequence[str], order: Sequence[str],
                totals: dict[str, tuple[str, Column]]) -> DataFrame:
    """Second half of ``running`` for rows that already carry ``_chunk``."""
    so_far = window(keys, *order).rowsBetween(W.unboundedPreceding, W.currentRow)
    inner = rows.select("*", *[_FUNCTION[fn](v).over(so_far).alias(f"_in_{n}") for n, (fn, v) in totals.items()])
    joined = inner.join(bases, [*keys, CHUNK], "left")
    kept = [c for c in rows.columns if c not in totals]
    return joined.select(
        *kept,
        *[_FINISH[fn](F.col(f"_in_{n}"), F.col(f"_base_{n}")).alias(n) for n, (fn, _) in totals.items()],
    )


def running_path(steps: DataFrame, keys: Sequence[str], order: Sequence[str], grid: Grid, delta: str) -> DataFrame:
    """Running sum ``gain`` of ``delta`` and running maximum ``high`` of that sum, by chunks."""
    placed = placed_rows(steps.select(*keys, *order, delta), keys, order[0], grid)
    return path_in_parts(placed, keys, order, delta, CHUNK)


def path_in_parts(placed: DataFrame, keys: Sequence[str], order: Sequence[str], delta: str, part: str) -> DataFrame:
    """``running_path`` of rows that are dealt out by (keys, part) already; parts follow each other in order.

    Sum and maximum come from one ordered pass per part: a part's own sum and maximum are relative to
    its start, so one row per part is enough to shift them. Both branches below read the
    same columns, which lets Spark reuse the one shuffle of the full rows.
    """
    whole = [*keys, part]
    so_far = W.partitionBy(*whole).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = placed.withColumn("_g", F.sum(delta).over(so_far)).withColumn("_h", F.max("_g").over(so_far))
    per_part = local.groupBy(*whole).agg(F.sum(delta).alias("_sum"), F.max("_g").alias("_top"))
    earlier = W.partitionBy(*keys).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    shifts = (
        per_part.withColumn("_base", F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)))
        .withColumn("_roof", F.max(F.col("_base") + F.col("_top")).over(earlier))
        .select(*whole, "_base", "_roof")
    )
    gain = F.col("_base") + F.col("_g")
    high = F.greatest(F.col("_roof"), F.col("_base") + F.col("_h"))
    return local.join(shifts, whole).select(*keys, *order, gain.alias("gain"), high.alias("high"))


def newest(df: DataFrame, keys: Sequence[str], order: str, n: int) -> DataFrame:
    """The last ``n`` rows of every series; Spark keeps only n per task before it shuffles."""
    latest_first = W.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_age", F.row_number().over(latest_first)).filter(F.col("_age") <= n)


def frame_gate(value: Column, over: WindowSpec, n: int, result: Column) -> Column:
    """``result`` only where the last n rows all have a value."""
    return F.when(F.count(value).over(over.rowsBetween(-(n - 1), 0)) == n, result)
