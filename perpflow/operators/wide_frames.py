"""Rolling statistics whose cost does not depend on the width of the frame.

A sliding frame of Spark goes through its whole buffer again for every row, so n rows cost n times
the width. Here a series is numbered and cut into blocks as long as the frame. The last
``width`` rows before a row are then the rest of the block before and the start of its own block:

    frame(i) = rest of block b-1 after offset o  +  block b up to offset o,   i = b * width + o

Both parts are running aggregates, one forward and one backward, and the first of them stands exactly
``width`` rows back. Nothing is ever subtracted: sums, moments and covariances of the two parts
are merged, so a flat stretch after a steep one has no cancellation error.

Rows travel twice whatever the width: once by time to be numbered, once by number, where every
chunk also gets the ``width`` rows before it. Both times a task gets about ``TASK_ROWS`` rows, however many there are: ranges of
time are cut where the rows lie, chunks by row number. So sparse and dense series are equally well spread; a chunk holds
as many rows as the widest frame at least.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from perpflow.operators.chunks import CHUNK, OWN, Grid, known, window
from perpflow.session import cut_lineage

IDX = "_idx"
#: Up to this width a sliding frame costs less than numbering the series.
NARROW = 64
#: Rows that a task is given, about, lent ones included; the windows of a module hold some 2 KB for each.
TASK_ROWS = 1 << 15


@dataclass(frozen=True)
class Roll:
    """One statistic of ``value`` over the last ``width`` rows; ``shift`` rows back, if the newest don't count.

    NULL values are skipped. ``full`` asks for ``width`` values; otherwise one is enough (two for std and slope).
    ``slope`` is the least-squares slope against the row number.
    """

    kind: str
    value: Column
    width: int
    full: bool = False
    shift: int = 0

    def __post_init__(self) -> None:
        if self.kind not in _PARTS:
            raise ValueError(f"unknown statistic {self.kind}")
        if self.width < 1 or self.shift < 0:
            raise ValueError("width must be at least 1 and shift must not be negative")


#: What each statistic is merged from.
_PARTS = {
    "count": ("n",), "sum": ("n", "mean"), "mean": ("n", "mean"), "max": ("n", "max"), "min": ("n", "min"),
    "std": ("n", "mean", "m2"), "slope": ("n", "mean", "at", "cross", "spread"),
}


def _tasks(df: DataFrame, before: int = 0, size: int = 1) -> int:
    """Partitions for a shuffle of these rows, of which ``before`` in ``size`` go twice: no fewer than the session makes."""
    rows = df.count() * (size + before) // size
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def numbered(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows of each series numbered from 0 in ``order``; no task takes a series or a fixed span of time.

    Sorted ranges of rows are written with their place; one row per range and series tells how many rows of the
    series came before.
    """
    rows = df.filter(known([*keys, order]))
    ranges = rows.repartitionByRange(_tasks(rows), *keys, order).sortWithinPartitions(*keys, order)
    laid = cut_lineage(ranges.withColumn(IDX, F.monotonically_increasing_id()))
    laid = laid.withColumn("_range", F.shiftright(IDX, 33))
    earlier = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    begins = laid.groupBy(*keys, "_range").agg(F.min(IDX).alias("_first"), F.count(F.lit(1)).alias("_n")).select(
        *keys, "_range", (F.col("_first") - F.coalesce(F.sum("_n").over(earlier), F.lit(0))).alias("_off"))
    return laid.join(begins, [*keys, "_range"]).withColumn(IDX, F.col(IDX) - F.col("_off")).drop("_range", "_off")


def chunked_by_number(rows: DataFrame, keys: Sequence[str], before: int, size: int) -> DataFrame:
    """Numbered rows by chunks of ``size``, each led in by the ``before`` rows (``size`` at most) in front of it."""
    if before > size:
        raise ValueError("a chunk must hold as many rows as are lent to it")
    home = F.floor(F.col(IDX) / size)
    lent = F.pmod(F.col(IDX), F.lit(size)) >= size - before
    places = F.when(lent, F.array(home, home + 1)).otherwise(F.array(home))
    placed = rows.withColumn(CHUNK, F.explode(places))
    return placed.withColumn(OWN, F.col(CHUNK) == home).repartition(_tasks(rows, before, size), *keys, CHUNK)


def _parts(value: Column, over, wanted: set[str]) -> dict[str, Column]:
    """Mergeable aggregates of the rows of a running frame."""
    at = F.when(value.isNotNull(), F.col(IDX).cast("double"))
    n = F.count(value).over(over)
    made = {
        "n": n, "mean": F.avg(value).over(over), "max": F.max(value).over(over), "min": F.min(value).over(over),
        "m2": F.var_pop(value).over(over) * n, "at": F.avg(at).over(over),
        "cross": F.covar_pop(at, value).over(over) * n, "spread": F.var_pop(at).over(over) * n,
    }
    return {k: made[k] for k in wanted}


def _merged(kind: str, a: Mapping[str, Column], b: Mapping[str, Column]) -> tuple[Column, Column]:
    """(number of values, statistic) of two stretches of which either may be empty."""
    na, nb = (F.coalesce(x["n"], F.lit(0)) for x in (a, b))
    n = na + nb
    if kind == "count":
        return n, n
    if kind in ("max", "min"):
        return n, (F.greatest if kind == "max" else F.least)(a[kind], b[kind])
    either = lambda part: F.when(na == 0, b[part]).when(nb == 0, a[part])
    if kind in ("sum", "mean"):
        mean = either("mean").otherwise(a["mean"] + (b["mean"] - a["mean"]) * nb / n)
        return n, mean if kind == "mean" else mean * n
    step = b["mean"] - a["mean"]
    if kind == "std":
        m2 = either("m2").otherwise(a["m2"] + b["m2"] + step * step * na * nb / n)
        return n, F.when(n >= 2, F.sqrt(m2 / (n - 1)))
    apart = b["at"] - a["at"]
    cross = either("cross").otherwise(a["cross"] + b["cross"] + apart * step * na * nb / n)
    spread = either("spread").otherwise(a["spread"] + b["spread"] + apart * apart * na * nb / n)
    return n, F.when(n >= 2, F.try_divide(cross, spread))


def add_rolls(rows: DataFrame, keys: Sequence[str], rolls: Mapping[str, Roll]) -> DataFrame:
    """The statistics of rows that ``chunked_by_number`` placed; needs ``reach(rolls)`` rows before each chunk."""
    along = window(keys, IDX)
    values, shared = {}, {}
    for name, roll in rolls.items():
        slot = shared.setdefault(str(roll.value), f"_v{len(shared)}")
        values[slot] = roll.value
    rows = rows.withColumns(values)
    for width in sorted({r.width for r in rolls.values()}):
        block = f"_b{width}"
        own_block = W.partitionBy(*keys, CHUNK, block)
        so_far = own_block.orderBy(IDX).rowsBetween(W.unboundedPreceding, 0)
        # Later rows of the block, as a running frame over descending rows: a frame that ends at the last row is quadratic.
        later = own_block.orderBy(F.col(IDX).desc()).rowsBetween(W.unboundedPreceding, -1)
        wanted: dict[str, set[str]] = {}
        for roll in rolls.values():
            if roll.width == width:
                wanted.setdefault(shared[str(roll.value)], set()).update(_PARTS[roll.kind])
        rows = rows.withColumn(block, F.floor(F.col(IDX) / width))
        head = {f"_h{s}{k}": c for s, w in wanted.items() for k, c in _parts(F.col(s), so_far, w).items()}
        tail = {f"_t{s}{k}": c for s, w in wanted.items() for k, c in _parts(F.col(s), later, w).items()}
        rows = rows.withColumns(head).withColumns(tail)
        rows = rows.withColumns({c: F.lag(c, width).over(along) for c in tail})
        made = {}
        for name, roll in rolls.items():
            if roll.width == width:
                slot = shared[str(roll.value)]
                side = lambda p: {k: F.col(f"_{p}{slot}{k}") for k in _PARTS[roll.kind]}  # noqa: B023, E731
                n, result = _merged(roll.kind, side("t"), side("h"))
                need = width if roll.full else 1
                made[name] = F.when(n >= need, result) if roll.kind != "count" else result
        rows = rows.withColumns(made).drop(block, *head, *tail)
    shifted = {n: F.lag(n, r.shift).over(along) for n, r in rolls.items() if r.shift}
    return (rows.withColumns(shifted) if shifted else rows).drop(*values)


def reach(rolls: Mapping[str, Roll]) -> int:
    """Rows before a chunk that its frames look at."""
    return max((r.width + r.shift for r in rolls.values()), default=0)


def roll(df: DataFrame, keys: Sequence[str], order: str, grid: Grid, rolls: Mapping[str, Roll]) -> DataFrame:
    """``df`` with one column for each of ``rolls``, along every series of ``keys``."""
    before = reach(rolls)
    placed = chunked_by_number(numbered(df, keys, order), keys, before, max(before, grid.rows))
    return add_rolls(placed, keys, rolls).filter(F.col(OWN)).drop(CHUNK, OWN, IDX)
