"""Points and ranges that cover them, as an equi-join however many ranges overlap.

Joining on the key alone and filtering by time pairs every point of a key with every range of it. Here a range is
taken apart into dyadic stretches of grid cells, two of each size at most; a point lies in one stretch of
each size. Both meet on (key, size, stretch). Every pair that meets is a result, except for points in
the two end cells of a range that the range covers in part.

Stretches longer than ``2 ** MOST`` cells are cut to that size, so no stretch gathers more points than that
many cells hold, and a key with very many points is spread over its stretches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from perpflow.schema import step_micros
from perpflow.session import weighed

MOST = 12
#: With fewer ranges than this for each key, points meet them by key: nothing is taken apart.
FEW = 4
_SIZE, _STRETCH = "_size", "_stretch"


def _micros(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(F.col(name).cast("timestamp"))
    return F.unix_micros(F.col(name)) if isinstance(kind, T.TimestampType) else F.col(name).cast("bigint")


def _cell(at: Column, step: int) -> Column:
    return ((at - F.pmod(at, F.lit(step))) / step).cast("bigint")


def cover(first: Column, last: Column) -> Column:
    """Array of (size, stretch): disjoint stretches of 2 ** size cells that make up the cells first..last.

    From both ends inward: an end that is no multiple of the next size gives off one stretch of this size.
    """
    none = F.array().cast(f"array<struct<{_SIZE}: int, {_STRETCH}: bigint>>")
    piece = lambda size, at: F.struct(size.cast("int").alias(_SIZE), at.cast("bigint").alias(_STRETCH))
    odd = lambda x: F.pmod(x, F.lit(2)) == 1
    start = F.struct(first.alias("a"), (last + 1).alias("b"), none.alias("found"))

    def inward(state: Column, size: Column) -> Column:
        a, b = state["a"], state["b"]
        up = F.shiftright(a + 1, 1)
        left = F.when((a < b) & odd(a), F.array(piece(size, a))).otherwise(none)
        # Only if the left end has not just given off the last cell there was.
        right = F.when((up * 2 < b) & odd(b), F.array(piece(size, b - 1))).otherwise(none)
        return F.struct(up.alias("a"), F.shiftright(b, 1).alias("b"), F.concat(state["found"], left, right).alias("found"))

    done = F.aggregate(F.sequence(F.lit(0), F.lit(MOST - 1)), start, inward)
    rest = F.when(done["a"] < done["b"], F.transform(F.sequence(done["a"], done["b"] - 1), lambda at: piece(F.lit(MOST), at))).otherwise(none)
    return F.concat(done["found"], rest)


def interval_join(points: DataFrame, ranges: DataFrame, keys: Sequence[str], at: str, start: str, end: str, step: str | int) -> DataFrame:
    """Every point with every range of its key that covers it, both ends included.

    Points that lie in no range, ranges without a point, NULL keys or ends and empty ranges give no row. ``step`` is the width of
    a cell, best the usual distance of points; any other width gives the same rows. Columns other than
    the keys must not have one name on both sides.
    """
    inside = (_micros(points, at) >= F.col("_from")) & (_micros(points, at) <= F.col("_to"))
    bounded = ranges.withColumns({"_from": _micros(ranges, start), "_to": _micros(ranges, end)}).filter("_from <= _to")
    width = step_micros(step)
    pieces = bounded.withColumn("_pieces", cover(_cell(F.col("_from"), width), _cell(F.col("_to"), width)))
    # One pass over the ranges says how they overlap and which sizes occur at all (MOST + 1 at most).
    seen = pieces.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array_distinct(F.flatten(F.collect_set(F.transform("_pieces", lambda p: p[_SIZE])))).alias("sizes"))
    most, sizes = seen.agg(F.max("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("sizes"))))).first()
    if most is None or most < FEW:
        return weighed(points, *keys).join(weighed(bounded, *keys), [*keys]).filter(inside).drop("_from", "_to")
    laid = pieces.select(*[c for c in pieces.columns if c != "_pieces"], F.inline("_pieces"))
    cell = _cell(_micros(points, at), width)
    places = F.array(*[F.struct(F.lit(s).alias(_SIZE), F.shiftright(cell, s).alias(_STRETCH)) for s in sizes])
    placed = points.select(*points.columns, F.inline(places))
    # What is taken apart is much larger than the planner believes: never through the driver.
    return placed.join(laid.hint("merge"), [*keys, _SIZE, _STRETCH]).filter(inside).drop("_from", "_to", _SIZE, _STRETCH)
