"""Strategies that know their position, as transition tables composed in parallel.

A strategy of a few states (flat, long, short, cooling down after a stop, ...) maps its state before a bar to one after it, by
what the bar shows. Such a map is an array with one entry a state, and maps compose: the map of a stretch of bars is known
without knowing in which state it is entered. So every block of bars is folded to its map, the maps of blocks are folded
in turn, and each block then starts from the state that the blocks before it lead to. No series is walked
in one task, and no bar waits for the one before.

What a bar shows may depend on its whole past (averages, extremes), but not on the position; stop levels that hang on the
entry price are out of reach unless they fall into classes that a state can carry.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from perpflow.operators.chunks import CHUNK, Grid, placed_rows

#: Maps that one row gathers; three levels cover BLOCK * BLOCK * (as many as a row holds) bars of a series.
BLOCK = 256
_MAP = "array<int>"


@dataclass(frozen=True)
class StateRules:
    """``moves``: for each class of bar, state to state; a state that is not named stays. The first state is where a series starts.

    ``actions``: (before, after) to the signal that is given; no entry, no signal.
    """

    states: Sequence[str]
    moves: Mapping[str, Mapping[str, str]]
    actions: Mapping[tuple[str, str], str]

    def __post_init__(self) -> None:
        known = set(self.states)
        if not self.states or len(known) != len(self.states):
            raise ValueError("states must be named once each")
        named = [s for move in self.moves.values() for pair in move.items() for s in pair] + [s for pair in self.actions for s in pair]
        if set(named) - known:
            raise ValueError(f"unknown states: {sorted(set(named) - known)}")

    def table(self, seen: Column) -> Column:
        """The map of a bar of class ``seen``; a class without moves (NULL too) changes nothing."""
        place = {s: i for i, s in enumerate(self.states)}
        result = F.array(*[F.lit(i) for i in range(len(self.states))])
        for name, move in self.moves.items():
            result = F.when(seen == name, F.array(*[F.lit(place[move.get(s, s)]) for s in self.states])).otherwise(result)
        return result.cast(_MAP)

    def name(self, state: Column) -> Column:
        return F.element_at(F.array(*[F.lit(s) for s in self.states]), state + 1)


def _then(first: Column, second: Column) -> Column:
    """The map of two stretches in turn."""
    return F.transform(first, lambda s: F.get(second, s))


def _folded(rows: DataFrame, group: Sequence[str], index: str, step: str, width: int) -> DataFrame:
    """One row a group: ``_whole``, the map of all its steps in order, and ``_before``, (i, map of the steps before i)."""
    steps = F.array_sort(F.collect_list(F.struct(F.col(index).cast("bigint").alias("i"), F.col(step).alias("m"))))
    start = F.struct(
        F.array(*[F.lit(i) for i in range(width)]).cast(_MAP).alias("whole"), F.array().cast(f"array<struct<i: bigint, m: {_MAP}>>").alias("before"))

    def along(acc: Column, x: Column) -> Column:
        here = F.struct(x["i"].alias("i"), acc["whole"].alias("m"))
        return F.struct(_then(acc["whole"], x["m"]).alias("whole"), F.concat(acc["before"], F.array(here)).alias("before"))

    folded = rows.groupBy(*group).agg(steps.alias("_steps")).withColumn("_f", F.aggregate("_steps", start, along))
    return folded.select(*group, F.col("_f.whole").alias("_whole"), F.col("_f.before").alias("_before"))


def states_along(bars: DataFrame, keys: Sequence[str], order: str, seen: Column, rules: StateRules, grid: Grid) -> DataFrame:
    """``bars`` with ``state_before`` and ``state_after``. Rows of one series and time must be one row."""
    width, one = len(rules.states), [*keys, CHUNK]
    placed = placed_rows(bars, keys, order, grid).withColumn("_map", rules.table(seen))
    numbered = placed.withColumn("_i", F.row_number().over(W.partitionBy(*one).orderBy(order)) - 1).withColumn("_g", F.floor(F.col("_i") / BLOCK))
    low = _folded(numbered, [*one, "_g"], "_i", "_map", width)
    low = low.withColumn("_j", F.row_number().over(W.partitionBy(*keys).orderBy(CHUNK, "_g")) - 1).withColumn("_h", F.floor(F.col("_j") / BLOCK))
    mid = _folded(low, [*keys, "_h"], "_j", "_whole", width)
    top = _folded(mid, keys, "_h", "_whole", width)
    begun = top.select(*keys, F.inline("_before")).select(*keys, F.col("i").alias("_h"), F.get("m", F.lit(0)).alias("_state"))
    blocks = mid.select(*keys, "_h", F.inline("_before")).join(begun, [*keys, "_h"]).select(
        *keys, F.col("i").alias("_j"), F.get("m", F.col("_state")).alias("_state"))
    inside = low.join(blocks, [*keys, "_j"]).select(*one, "_state", F.inline("_before")).select(
        *one, F.col("i").alias("_i"), F.get("m", F.col("_state")).alias("_at"))
    walked = numbered.join(inside, [*one, "_i"])
    return walked.select(
        *bars.columns, rules.name(F.col("_at")).alias("state_before"), rules.name(F.get("_map", F.col("_at"))).alias("state_after"))


def state_signals(walked: DataFrame, rules: StateRules, quantity: float) -> DataFrame:
    """Signals of the bars whose change of state has an action; an EXIT has no quantity."""
    action = F.lit(None).cast("string")
    for (before, after), name in rules.actions.items():
        action = F.when((F.col("state_before") == before) & (F.col("state_after") == after), name).otherwise(action)
    given = walked.withColumn("action", action).filter("action IS NOT NULL")
    return given.select(
        "symbol", "timestamp", F.col("symbol").alias("emit_symbol"), F.lit(0).cast("bigint").alias("seq"), "action",
        F.when(F.col("action") != "EXIT", F.lit(float(quantity))).alias("quantity"))
