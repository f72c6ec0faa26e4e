"""Transition tables against a walk bar by bar."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from conftest import T0
from perpflow.operators import strategies as ST
from perpflow.operators.chunks import Grid

RULES = ST.StateRules(
    ["FLAT", "LONG", "SHORT", "OUT"],
    {"up": {"FLAT": "LONG", "SHORT": "FLAT"}, "down": {"LONG": "SHORT", "OUT": "FLAT"}, "stop": {"LONG": "OUT", "SHORT": "OUT"}},
    {("FLAT", "LONG"): "ENTER_LONG", ("LONG", "OUT"): "EXIT"})


@pytest.mark.parametrize("rows,block", [(8, 3), (4096, 256)])
def test_states_match_a_walk(spark, monkeypatch, rows, block):
    monkeypatch.setattr(ST, "BLOCK", block)
    rng, given, want = random.Random(rows), [], {}
    for key, n in (("a", 200), ("b", 40), ("c", 1)):
        at, state = 0, "FLAT"
        for _ in range(n):
            at += rng.choice([1, 1, 1, 40])
            seen = rng.choice(["up", "down", "stop", "odd", None])
            after = RULES.moves.get(seen, {}).get(state, state)
            given.append((key, T0 + timedelta(hours=at), seen))
            want[key, at] = (state, after)
            state = after
    rng.shuffle(given)
    frame = spark.createDataFrame(given, "symbol string, timestamp timestamp, seen string").repartition(3)
    walked = ST.states_along(frame, ["symbol"], "timestamp", F.col("seen"), RULES, Grid("1h", rows))
    got = {(r.symbol, round((r.timestamp.replace(tzinfo=None) - T0.replace(tzinfo=None)).total_seconds() / 3600)): (r.state_before, r.state_after) for r in walked.collect()}
    assert got == want
    signals = ST.state_signals(walked, RULES, 2.0).collect()
    assert len(signals) == sum(pair in RULES.actions for pair in want.values())
    assert all((s.quantity is None) == (s.action == "EXIT") for s in signals)


def test_rules_are_checked():
    with pytest.raises(ValueError):
        ST.StateRules(["A", "A"], {}, {})
    with pytest.raises(ValueError):
        ST.StateRules(["A"], {"x": {"A": "B"}}, {})
