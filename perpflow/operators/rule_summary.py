"""How often and when each of very many rule sections passes, without a row for each time it does.

Conditions are dealt by section over tasks and read in order of their sections, never gathered; every task gets all moments. A condition becomes
a bit for each moment of a symbol, a section the *and* (ALL) or *or* (ANY) of such rows of bits; they are counted
and their first and last bit looked up. A condition that many sections share is judged once for ``STEP`` conditions.

A task holds ``HELD`` feature values at most: of more, groups of moments go to tasks of their own, with the conditions once
for each group. The work grows with sections times moments, 64 moments to a machine word; what is shuffled, with
conditions times groups and moments times tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: Conditions of a task: at least, and at most (where the session shuffles into fewer tasks).
FEWEST, MOST = 1 << 16, 1 << 20
#: Feature values that a task holds, conditions taken at once, moments of a symbol and words of bits handled at once.
HELD, STEP, BLOCK, WORDS = 1 << 21, 1 << 16, 4096, 1 << 17
_SECTION = ["strategy", "section", "logic"]
_CONDITION = ["feature", "operator", "value", "value_high"]
_OUT = "strategy string, section string, logic string, symbol string, passed bigint, first bigint, last bigint"
_NEVER, _EVER = np.iinfo(np.int64).max, np.iinfo(np.int64).min


def summary(moments: DataFrame, conditions: DataFrame) -> DataFrame:
    """(strategy, section, logic, symbol, passed, first, last): moments at which a section passes, and the first and last of them.

    ``moments`` is (symbol, timestamp, given: array of feature_name and value), read twice; ``conditions`` has a row for each, with
    strategy, section, logic, feature, operator, value and value_high. Sections that never pass for a symbol have no row for it.
    """
    n_conditions, n_values = conditions.count(), moments.agg(F.sum(F.size("given"))).first()[0] or 0
    parts = int(moments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ceil = lambda n, size: max(1, -(-n // size))
    n_tasks, n_groups = min(ceil(n_conditions, FEWEST), max(parts, ceil(n_conditions, MOST))), ceil(n_values, HELD)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    group = F.pmod(F.xxhash64("symbol", "timestamp"), F.lit(n_groups)).cast("int")
    # A row for each value: to look at the size of rows with lists takes Arrow longer than all else here.
    there = moments.select("symbol", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("at"), group.alias("_group"), F.inline("given")).select(
        "symbol", "at", F.col("feature_name").alias("feature"), F.col("value").cast("double").alias("value"), "_group", every(n_tasks).alias("_task"))
    place = F.xxhash64(*_SECTION)
    asked = conditions.select(
        *_SECTION, "feature", "operator", F.col("value").cast("double").alias("value"), F.col("value_high").cast("double").alias("value_high"),
        place.alias("_place"), F.pmod(place, F.lit(n_tasks)).cast("int").alias("_task"), every(n_groups).alias("_group"))
    # Moments have no place, so they come first.
    both = there.unionByName(asked, allowMissingColumns=True)
    dealt = both.repartitionById(n_tasks * n_groups, F.col("_group") * n_tasks + F.col("_task")).sortWithinPartitions("_place", "symbol", "at", *_SECTION)
    found = dealt.select(F.col("_place").isNull().alias("moment"), "symbol", "at", *_SECTION, *_CONDITION).mapInArrow(_summed, _OUT)
    if n_groups > 1:
        found = found.groupBy(*_SECTION, "symbol").agg(F.sum("passed").alias("passed"), F.min("first").alias("first"), F.max("last").alias("last"))
    return found.withColumns({c: F.timestamp_micros(c) for c in ("first", "last")})


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    moments, symbols, waiting, n = [], None, [], 0
    for batch in batches:
        here = pc.sum(batch.column("moment")).as_py() or 0
        if here:
            moments.append(batch.slice(0, here).select(["symbol", "at", "feature", "value"]))
        if here == batch.num_rows:
            continue
        if symbols is None:
            symbols, moments = _by_symbol(moments), []
        waiting.append(batch.slice(here).select([*_SECTION, *_CONDITION]))
        n += waiting[-1].num_rows
        if n >= STEP:
            rows = pa.Table.from_batches(waiting).combine_chunks()
            # The last section may go on in the next batch.
            begun = _starts(rows)[-1]
            waiting, n = rows.slice(begun).to_batches(), rows.num_rows - begun
            if begun:
                yield from _judged(rows.slice(0, begun), symbols)
    if n:
        yield from _judged(pa.Table.from_batches(waiting).combine_chunks(), symbols)


def _new(rows: pa.Table, columns: list[str]) -> np.ndarray:
    """Whether a row differs from the one before it."""
    new = np.zeros(rows.num_rows, dtype=bool)
    new[0] = True
    for name in columns:
        column = rows.column(name)
        one, next_one = column.slice(0, rows.num_rows - 1), column.slice(1)
        differs = pc.or_(pc.fill_null(pc.not_equal(one, next_one), False), pc.xor(pc.is_null(one), pc.is_null(next_one)))
        new[1:] |= differs.to_numpy()
    return new


def _starts(rows: pa.Table) -> np.ndarray:
    """Where sections begin, in rows that are in their order."""
    return np.flatnonzero(_new(rows, _SECTION))


class _Block:
    """Up to ``BLOCK`` moments of a symbol in the order of time; the values of a feature by their place."""

    def __init__(self, rows: pa.Table, new: np.ndarray) -> None:
        """``rows`` has one for each value, ``new`` says where a moment begins."""
        begun = rows.column("at").take(pa.array(np.flatnonzero(new)))
        # A moment without a time comes last: it counts, and is neither first nor last.
        self.n, self.at = len(begun), begun.drop_null().to_numpy()
        names = rows.column("feature").combine_chunks().dictionary_encode()
        who, value = np.cumsum(new) - 1, _number(rows.column("value"))
        code = pc.fill_null(names.indices, -1).to_numpy()
        order = np.argsort(code, kind="stable")
        cuts = np.searchsorted(code[order], np.arange(len(names.dictionary) + 1))
        self.features = {name: (who[order[a:b]], value[order[a:b]]) for name, a, b in zip(names.dictionary.to_pylist(), cuts[:-1], cuts[1:])}

    def bits(self, conditions: list[tuple[str | None, str | None, np.ndarray, np.ndarray, np.ndarray]], n: int) -> np.ndarray:
        """A row of bits for each of n conditions, given as (feature, operator, their rows, value, value_high)."""
        words = -(-self.n // 64)
        out = np.zeros((n, words * 8), dtype=np.uint8)
        for feature, op, rows, low, high in conditions:
            if feature not in self.features:
                continue
            where, value = self.features[feature]
            x = np.full(self.n, np.nan)
            x[where] = value
            for start in range(0, len(rows), 512):
                part = slice(start, start + 512)
                held = np.packbits(_holds(op, x, low[part, None], high[part, None]), axis=1, bitorder="little")
                out[rows[part], :held.shape[1]] = held
        return out.view("<u8")

    def ends(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last time of each row of bits."""
        if not len(self.at):
            return np.full(len(bits), _NEVER), np.full(len(bits), _EVER)
        if len(self.at) < self.n:
            bits = bits & np.packbits(np.arange(bits.shape[1] * 64) < len(self.at), bitorder="little").view("<u8")
        rows, some = np.arange(len(bits)), bits != 0
        early, late = some.argmax(axis=1), bits.shape[1] - 1 - some[:, ::-1].argmax(axis=1)
        low, high = bits[rows, early], bits[rows, late]
        for by in (1, 2, 4, 8, 16, 32):
            high = high | high >> np.uint64(by)
        first = early * 64 + np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1))
        last = late * 64 + np.bitwise_count(high).astype(np.int64) - 1
        none = ~some.any(axis=1)
        first[none], last[none] = 0, 0
        return np.where(none, _NEVER, self.at[first]), np.where(none, _EVER, self.at[last])


def _holds(op: str | None, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """NaN, a value or a threshold that is missing, never holds."""
    match op:
        case "GT": return x > low
        case "GTE": return x >= low
        case "LT": return x < low
        case "LTE": return x <= low
        case "EQ": return x == low
        case "NEQ": return (x != low) & ~np.isnan(x) & ~np.isnan(low)
        case "BETWEEN": return (x >= low) & (x <= high)
    return np.zeros((len(low), len(x)), dtype=bool)


def _by_symbol(batches: list[pa.RecordBatch]) -> list[tuple[pa.Scalar, list[_Block]]]:
    if not batches:
        return []
    rows = pa.Table.from_batches(batches).combine_chunks().sort_by([("symbol", "ascending"), ("at", "ascending")])
    new = _new(rows, ["symbol", "at"])
    starts = np.flatnonzero(_new(rows, ["symbol"]))
    out = []
    for start, end in zip(starts, [*starts[1:], rows.num_rows]):
        moments = start + np.flatnonzero(new[start:end])
        cuts = [*moments[::BLOCK], end]
        out.append((rows.column("symbol")[int(start)], [_Block(rows.slice(a, b - a), new[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]))
    return out


def _number(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(float)


def _judged(rows: pa.Table, symbols: list[tuple[pa.Scalar, list[_Block]]]) -> Iterator[pa.RecordBatch]:
    """Whole sections against all moments of the task."""
    starts = _starts(rows)
    sections = rows.select(_SECTION).take(pa.array(starts)).combine_chunks()
    sizes = np.diff([*starts, rows.num_rows])
    which, different, n = _different(rows)
    kinds = np.array(sections.column("logic").to_pylist(), dtype=object)
    shares = []
    for kind, joined in (("ALL", np.bitwise_and), ("ANY", np.bitwise_or)):
        mine = np.flatnonzero(kinds == kind)
        if len(mine):
            shares.append((mine, joined, which[np.repeat(kinds == kind, sizes)], np.concatenate([[0], np.cumsum(sizes[mine])])))
    for symbol, blocks in symbols:
        passed = np.zeros(len(starts), dtype=np.int64)
        first, last = np.full(len(starts), _NEVER), np.full(len(starts), _EVER)
        for block in blocks:
            bits = block.bits(different, n)
            for mine, joined, conditions, cuts in shares:
                for a, b in _pieces(cuts, max(1, WORDS // bits.shape[1])):
                    here = joined.reduceat(bits[conditions[cuts[a]:cuts[b]]], cuts[a:b] - cuts[a], axis=0)
                    counts = np.bitwise_count(here).sum(axis=1, dtype=np.int64)
                    hit = np.flatnonzero(counts)
                    who = mine[a:b][hit]
                    begun, ended = block.ends(here[hit])
                    passed[who] += counts[hit]
                    first[who], last[who] = np.minimum(first[who], begun), np.maximum(last[who], ended)
        at = np.flatnonzero(passed)
        if len(at):
            yield pa.RecordBatch.from_arrays(
                [*(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in sections.take(pa.array(at)).columns), pa.repeat(symbol, len(at)),
                 pa.array(passed[at]), pa.array(first[at], mask=first[at] == _NEVER), pa.array(last[at], mask=last[at] == _EVER)],
                [*_SECTION, "symbol", "passed", "first", "last"])


def _pieces(cuts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of sections of about ``most`` conditions, of one section at least."""
    a = 0
    while a < len(cuts) - 1:
        b = max(a + 1, int(np.searchsorted(cuts, cuts[a] + most, side="right")) - 1)
        yield a, b
        a = b


def _different(rows: pa.Table) -> tuple[np.ndarray, list[tuple[str | None, str | None, np.ndarray, np.ndarray, np.ndarray]], int]:
    """The different conditions, those of one feature and operator together, and which of them each row is."""
    names = {c: rows.column(c).combine_chunks().dictionary_encode(null_encoding="encode") for c in ("feature", "operator")}
    feature, op = (names[c].indices.to_numpy() for c in ("feature", "operator"))
    ops = names["operator"].dictionary.to_pylist()
    low, high = _number(rows.column("value")), _number(rows.column("value_high"))
    if "BETWEEN" in ops:
        high = np.where(op == ops.index("BETWEEN"), high, 0.0)
    else:
        high = np.zeros(len(high))
    lows, low_at = np.unique(low, return_inverse=True)
    highs, high_at = np.unique(high, return_inverse=True)
    kind = feature.astype(np.int64) * len(ops) + op
    keys, which = np.unique((kind * len(lows) + low_at) * len(highs) + high_at, return_inverse=True)
    kinds, value, top = keys // (len(lows) * len(highs)), lows[keys // len(highs) % len(lows)], highs[keys % len(highs)]
    features = names["feature"].dictionary.to_pylist()
    out = []
    for k in np.unique(kinds):
        mine = np.flatnonzero(kinds == k)
        out.append((features[k // len(ops)], ops[k % len(ops)], mine, value[mine], top[mine]))
    return which, out, len(keys)
