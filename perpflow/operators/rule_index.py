"""An index over the conditions of many rule sections: cells between thresholds, one bit a section.

The thresholds of a feature in order cut its values into cells, a point or an open stretch each. Within a cell
every condition on that feature either holds or does not, so a cell is a row of bits: which sections have all their
conditions on this feature fulfilled, and which have one. A moment falls into one cell of each feature, and all
sections are judged at once: ALL by the *and* of its rows, ANY by the *or*.

Sections are dealt over shelves of about ``SHELF`` and moments over blocks of about ``BLOCK``; a task takes a shelf and
a block, and goes through the shelf in slabs of ``SLAB``. What each holds is bounded, and only sections that pass become rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SLAB, SHELF, BLOCK = 512, 8192, 4096
# How a section joins its conditions.
ALL, ANY = "ALL", "ANY"


def cell_ranges(op: str, low: np.ndarray, high: np.ndarray, thresholds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """First and last cell where each condition of one operator holds: cell 2k+1 is threshold k, 2k the stretch below it."""
    at, last = 2 * np.searchsorted(thresholds, low) + 1, np.full(len(low), 2 * len(thresholds))
    none = np.zeros(len(low), dtype=np.int64)
    if op == "BETWEEN":
        return [(at, 2 * np.searchsorted(thresholds, high) + 1)]
    return {
        "GT": [(at + 1, last)], "GTE": [(at, last)], "LT": [(none, at - 1)], "LTE": [(none, at)],
        "EQ": [(at, at)], "NEQ": [(none, at - 1), (at + 1, last)],
    }.get(op, [])


class Slab:
    """The bits of the sections of one slab; ``rows`` has arrays section, feature, operator, value, value_high."""

    def __init__(self, logic: list[str], rows: dict[str, np.ndarray]) -> None:
        self.n = len(logic)
        self.all_of = np.packbits(np.array([x == ALL for x in logic]))
        self.any_of = np.packbits(np.array([x == ANY for x in logic]))
        self.features: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for feature in sorted(set(rows["feature"]) - {None}):
            mine = rows["feature"] == feature
            self.features[feature] = self._bits(*(rows[c][mine] for c in ("section", "operator", "value", "value_high")))
        # A condition without a feature never holds: its ALL section can't either.
        lost = np.bincount(rows["section"][np.array([f is None for f in rows["feature"]], dtype=bool)], minlength=self.n) > 0
        self.possible = np.packbits(~lost)

    def _bits(self, section: np.ndarray, op: np.ndarray, value: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        missing = np.isnan(value) | ((op == "BETWEEN") & np.isnan(high))
        used = np.concatenate([value[~missing], high[~missing & (op == "BETWEEN")]])
        thresholds = np.unique(used)
        steps = np.zeros((2 * len(thresholds) + 2, self.n), dtype=np.int32)
        for name in set(op[~missing]):
            chosen = ~missing & (op == name)
            for first, last in cell_ranges(name, value[chosen], high[chosen], thresholds):
                some = first <= last
                np.add.at(steps, (first[some], section[chosen][some]), 1)
                np.add.at(steps, (last[some] + 1, section[chosen][some]), -1)
        held = np.cumsum(steps, axis=0)[:-1]
        asked = np.bincount(section, minlength=self.n)
        # One row more for moments that lack the feature.
        whole = np.vstack([held == asked, asked == 0])
        some = np.vstack([held > 0, np.zeros(self.n, dtype=bool)])
        return thresholds, np.packbits(whole, axis=1), np.packbits(some, axis=1)

    def passing(self, values: dict[str, np.ndarray], moments: int) -> tuple[np.ndarray, np.ndarray]:
        """(moment, section) of what passes; ``values`` has NaN where a moment lacks a feature."""
        every = np.broadcast_to(self.possible & self.all_of, (moments, len(self.all_of))).copy()
        some = np.zeros_like(every)
        for feature, (thresholds, whole, one) in self.features.items():
            x = values.get(feature)
            cell = np.full(moments, len(whole) - 1)
            if x is not None:
                k = np.searchsorted(thresholds, x)
                point = thresholds[np.minimum(k, len(thresholds) - 1)] == x if len(thresholds) else np.zeros(moments, dtype=bool)
                cell = np.where(np.isnan(x), cell, 2 * k + point)
            every &= whole[cell]
            some |= one[cell]
        return np.nonzero(np.unpackbits(every | (some & self.any_of), axis=1, count=self.n))


_OUT = "symbol string, timestamp timestamp, strategy string, section string"


def _slab(sections: pa.StructArray) -> Slab:
    lists = sections.field("conditions")
    conditions, starts = lists.flatten(), lists.offsets.to_numpy()
    number = lambda c: conditions.field(c).to_numpy(zero_copy_only=False).astype(float)
    text = lambda c: conditions.field(c).to_numpy(zero_copy_only=False)
    return Slab(sections.field("logic").to_pylist(), {
        "section": np.repeat(np.arange(len(sections)), np.diff(starts)), "feature": text("feature"), "operator": text("operator"),
        "value": number("value"), "value_high": number("value_high")})


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            shelf, moments = (batch.column(c)[i].values for c in ("sections", "moments"))
            given = moments.field("given")
            entries = given.flatten()
            who = np.repeat(np.arange(len(moments)), np.diff(given.offsets.to_numpy()))
            names, read = entries.field("feature_name").to_numpy(zero_copy_only=False), entries.field("value").to_numpy(zero_copy_only=False).astype(float)
            values = {}
            for feature in set(names) - {None}:
                mine = names == feature
                values[feature] = np.full(len(moments), np.nan)
                values[feature][who[mine]] = read[mine]
            for start in range(0, len(shelf), SLAB):
                sections = shelf.take(pa.array(np.arange(start, min(start + SLAB, len(shelf)))))
                at, which = (pa.array(x) for x in _slab(sections).passing(values, len(moments)))
                yield pa.RecordBatch.from_arrays(
                    [moments.field("symbol").take(at), moments.field("timestamp").take(at), sections.field("strategy").take(which),
                     sections.field("section").take(which)], ["symbol", "timestamp", "strategy", "section"])


def passing(moments: DataFrame, sections: DataFrame) -> DataFrame:
    """(symbol, timestamp, strategy, section) of the sections that pass.

    ``moments`` is (symbol, timestamp, given: array of feature_name and value), ``sections``
    (strategy, section, logic, conditions: array of feature, operator, value, value_high).
    """
    n_shelves, n_blocks = (max(1, -(-t.count() // size)) for t, size in ((sections, SHELF), (moments, BLOCK)))
    deal = lambda columns, n: F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")
    shelves = sections.groupBy(deal(["strategy", "section"], n_shelves).alias("shelf")).agg(
        F.collect_list(F.struct("strategy", "section", "logic", "conditions")).alias("sections"))
    blocks = moments.groupBy(deal(["symbol", "timestamp"], n_blocks).alias("block")).agg(
        F.collect_list(F.struct("symbol", "timestamp", "given")).alias("moments"))
    copies = blocks.withColumn("shelf", F.explode(F.sequence(F.lit(0), F.lit(n_shelves - 1))))
    # Neither side is ever broadcast: sections grow with their number, blocks are there once for each shelf.
    met = copies.hint("merge").join(shelves, "shelf")
    # A row is a whole task's work: as many tasks as rows, up to what the session shuffles into.
    return met.select("shelf", "block", "sections", "moments").repartition("shelf", "block").drop("shelf", "block").mapInArrow(_pairs, _OUT)
