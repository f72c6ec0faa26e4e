"""Sections counted by bits against sections judged row by row."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from perpflow.operators import rule_summary as RS, rules as RL
from perpflow.schema import RULE

OPS = ["GT", "GTE", "LT", "LTE", "EQ", "NEQ", "BETWEEN", "ODD"]
FEATURES = "symbol string, feature_name string, timestamp timestamp, value double, version string"


def _tables(spark, hour, seed, symbols="AB", hours=150):
    rng = random.Random(seed)
    read = lambda: rng.choice([float("nan"), None, *map(float, range(7))]) if rng.random() < 0.1 else float(rng.randint(0, 6))
    rows = [(s, f, hour(h), read(), "v1") for s in symbols for h in range(hours) for f in "xyz" if rng.random() < 0.8]
    rows += [("C", "unused", hour(0), 1.0, "v1"), (None, "x", hour(3), 2.0, "v1"), ("A", "x", None, 6.0, "v1"), ("D", "y", None, 3.0, "v1")]
    table = []
    for i in range(400):
        logic = rng.choice(["ALL", "ANY", "CUSTOM"])
        for j in range(rng.randint(1, 4)):
            value = rng.choice([None, float("nan")]) if rng.random() < 0.05 else float(rng.randint(0, 6))
            table.append((f"s{i % 40}" if i % 50 else None, f"n{i}", logic, rng.random() < 0.95, f"c{j}", rng.choice(["x", "y", "z", "w", None]), rng.choice(OPS), value,
                          rng.choice([None, float(rng.randint(0, 7))]), rng.random() < 0.9))
    # One name, two logics: each is a section.
    table += [("twice", "e", logic, True, c, f, "GTE", 4.0, None, True) for logic in ("ALL", "ANY") for c, f in (("a", "x"), ("b", "y"))]
    return spark.createDataFrame(rows, FEATURES), spark.createDataFrame(table, RULE)


@pytest.mark.parametrize("seed,held,fewest", [(1, 1 << 21, 1 << 16), (2, 200, 1 << 16), (3, 1 << 21, 50), (4, 300, 100)])
def test_counts_and_ends_agree_with_the_hits(spark, hour, monkeypatch, seed, held, fewest):
    monkeypatch.setattr(RS, "HELD", held)
    monkeypatch.setattr(RS, "FEWEST", fewest)
    features, rules = _tables(spark, hour, seed)
    columns = ["strategy", "section", "logic", "symbol", "passed", "first", "last"]
    got = RL.section_summary(features, rules).select(*columns).collect()
    # NaN is a missing value to the index, and greater than all others to a plain comparison.
    plain = RL.apply_rules(features.filter("NOT isnan(value)"), rules.withColumn("value", F.nanvl("value", F.lit(None))))
    want = plain.where("passed").groupBy("strategy", "section", "logic", "symbol").agg(
        F.count(F.lit(1)).alias("passed"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last")).select(*columns).collect()
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    assert order(got) == order(want) and len(want) > 150
    assert any(r.symbol is None for r in want) and any(r.first is None for r in want)


def test_no_rules_and_no_features(spark, hour):
    features, rules = _tables(spark, hour, 5, hours=3)
    for f, r in ((features.where("false"), rules), (features, rules.where("false")), (features.where("false"), rules.where("false")), (features.where("feature_name = 'unused'"), rules)):
        assert RL.section_summary(f, r).count() == 0


def _batches(seed, size):
    rng = random.Random(seed)
    moments = [(True, s, t, None, None, None, rng.choice("xy"), None, float(rng.randint(0, 5)), None) for s in "ABC" for t in sorted(rng.sample(range(500), 130))]
    conditions = [(False, None, None, f"s{i}", "e", rng.choice(["ALL", "ANY"]) if j == 0 else None, rng.choice("xy"), rng.choice(OPS[:7]), float(rng.randint(0, 5)), float(rng.randint(2, 6)))
                  for i in range(90) for j in range(rng.randint(1, 5))]
    logic, rows = None, []
    for r in conditions:
        logic = r[5] or logic
        rows.append((*r[:5], logic, *r[6:]))
    names = ["moment", "symbol", "at", "strategy", "section", "logic", "feature", "operator", "value", "value_high"]
    kinds = [pa.bool_(), pa.string(), pa.int64(), *[pa.string()] * 5, pa.float64(), pa.float64()]
    whole = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*moments, *rows), kinds)], names)
    return (whole.slice(a, size) for a in range(0, whole.num_rows, size))


def test_batches_steps_blocks_and_pieces_do_not_matter(monkeypatch):
    def found():
        return sorted(tuple(r.values()) for b in RS._summed(_batches(6, size)) for r in b.to_pylist())

    size = 100_000
    want = found()
    assert len(want) > 100
    for size, step, block, words in ((1, 1, 64, 1), (7, 20, 5, 3), (50, 64, 100, 1 << 17), (391, 5, 4096, 8)):
        for name, value in (("STEP", step), ("BLOCK", block), ("WORDS", words)):
            monkeypatch.setattr(RS, name, value)
        assert found() == want


def _nodes(plan):
    name = plan.nodeName()
    inner = plan.executedPlan() if name == "AdaptiveSparkPlan" else plan.plan() if "QueryStage" in name else None
    if inner is not None:
        yield from _nodes(inner)
        return
    yield plan
    for i in range(plan.children().size()):
        yield from _nodes(plan.children().apply(i))


def test_the_query_makes_no_row_for_what_passes(spark):
    """Tasks give back the rows of the result, and not one for each section and moment."""
    from perpflow.plans.gates import rules_many_sections

    result = rules_many_sections(spark, "/root/testdata/sf0.001")
    rows = result.collect()
    given = [n.metrics().apply("pythonNumRowsReceived").value() for n in _nodes(result._jdf.queryExecution().executedPlan()) if n.nodeName().startswith("MapInArrow")]
    assert given == [len(rows)] and sum(r.bars for r in rows) > 10 * len(rows)
