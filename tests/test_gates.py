"""Fail-closed behaviour of scores and gates."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from perpflow.functions.issues import issue
from perpflow.operators import gates as G, rules as RL, score as SC
from perpflow.schema import RULE


def rows(spark, hour, confidence=1.0, symbol="BTC", reference=1.0):
    schema = "symbol string, as_of timestamp, confidence_level double"
    df = spark.createDataFrame([(symbol, hour(0), confidence)], schema)
    joined = SC.join_analyses({"funding": df, "liquidity": df})
    portfolio = F.expr("struct(1.0D AS cash, 100.0D AS equity, array(struct(symbol, 1.0D AS quantity, 1.0D AS avg_entry_price, 0.0D AS unrealized_pnl, CAST(NULL AS DOUBLE) AS leverage)) AS positions)")
    market = F.expr("struct(symbol, 5.0D AS price)")
    return joined.withColumns({"reference_time": F.lit(hour(reference)), "portfolio": portfolio, "market_data": market})


def provider(value="confidence", version="v1"):
    return SC.Provider(version, lambda a: a["confidence_level"] if value == "confidence" else F.lit(value).cast("double"))


CONFIG = SC.ScoreConfig("v1", weights={"funding": 1.0, "liquidity": 3.0})


def chain(spark, hour, providers=None, **kw):
    scored = SC.score(rows(spark, hour, **kw), CONFIG, providers or {"funding": provider(), "liquidity": provider(0.5)})
    return G.validate_signals(scored, G.ValidationConfig())


def test_weighted_total(spark, hour):
    r = chain(spark, hour).first()
    assert r.total_score == pytest.approx((1.0 + 3 * 0.5) / 4)
    assert r.feature_status == {"funding": "AVAILABLE", "open_interest": "MISSING", "premium_discount": "MISSING", "liquidity": "AVAILABLE"}
    assert r.validation_passed and r.available_providers == ["funding", "liquidity"] and r.completeness_ratio == 0.5


@pytest.mark.parametrize("value,total,status", [(None, 1.0, "VALID"), (float("nan"), None, "INVALID"), (7.0, None, "INVALID")])
def test_null_is_quiet_but_nan_is_an_error(spark, hour, value, total, status):
    r = chain(spark, hour, {"funding": provider(), "liquidity": provider(value)}).first()
    assert (r.total_score, r.validation_status) == (total, status)


def test_missing_weight_blocks_the_total(spark, hour):
    scored = SC.score(rows(spark, hour), SC.ScoreConfig("v1", weights={"funding": 1.0}), {"funding": provider(), "liquidity": provider()})
    assert scored.first().total_score is None
    zero = SC.score(rows(spark, hour), SC.ScoreConfig("v1", weights={"funding": 0.0}), {"funding": provider()})
    assert zero.first().total_score is None


def test_custom_aggregator_and_not_implemented(spark, hour):
    r = SC.score(rows(spark, hour), CONFIG, {"funding": provider(), "liquidity": SC.Provider("v1")},
                 aggregate=lambda values, usable, weights: F.greatest(*values.values())).first()
    assert r.total_score == 1.0 and r.feature_status["liquidity"] == "NOT_IMPLEMENTED"


def test_future_timestamp_warns_without_a_limit(spark, hour):
    r = chain(spark, hour, reference=-1.0).first()
    assert r.validation_passed and r.data_integrity == "STALE"
    assert [i.message for i in r.validation_warnings if i.category == "freshness"] == ["timestamp in the future"] * 3


def test_staleness_marks_module_health(spark, hour):
    scored = SC.score(rows(spark, hour, reference=5.0), CONFIG, {"funding": provider(), "liquidity": provider()})
    r = G.validate_signals(scored, G.ValidationConfig(max_staleness=timedelta(hours=1))).first()
    assert r.module_health["funding"] == "STALE" and r.module_health["open_interest"] == "MISSING"


def test_invalid_confidence_is_an_error(spark, hour):
    r = chain(spark, hour, confidence=1.5).first()
    assert not r.validation_passed and r.confidence_status == "INVALID" and r.data_integrity == "INCONSISTENT"


def test_decision_states(spark, hour):
    v = chain(spark, hour)
    config = G.DecisionConfig()
    assert G.decide(v, config).first().decision_status == "PENDING"
    assert G.decide(v, config, [G.Plugin("a")]).first().decision_reason == "no substantive outcome yet"
    done = G.decide(v, config, [G.Plugin("a", result=F.lit("EVALUATED"))]).first()
    assert done.decision_status == "EVALUATED" and done.execution_ready
    assert G.decide(v, G.DecisionConfig(required=("b",)), [G.Plugin("a")]).first().decision_status == "NOT_READY"
    bad = chain(spark, hour, confidence=2.0)
    assert G.decide(bad, config).first().decision_status == "NOT_READY"


def test_risk_is_closed_by_default(spark, hour):
    d = G.decide(chain(spark, hour), G.DecisionConfig())
    config = G.RiskConfig()
    yes, no, cannot = (G.Plugin(n, result=F.lit(x)) for n, x in (("a", True), ("exposure_management", False), ("c", None)))
    assert not G.assess_risk(d, config).first().risk_approved
    assert G.assess_risk(d, config, [yes]).first().risk_approved
    assert not G.assess_risk(d, config, [yes, cannot]).first().risk_approved
    closed = G.assess_risk(d, config, [yes, no]).first()
    assert not closed.risk_approved and closed.exposure_status == "EXCEEDED"
    broke = d.withColumn("portfolio", F.col("portfolio").withField("equity", F.lit(float("nan"))))
    assert G.assess_risk(broke, config, [yes]).first().module_results == []


def test_no_trade_is_closed_by_default(spark, hour):
    r = G.assess_risk(G.decide(chain(spark, hour), G.DecisionConfig()), G.RiskConfig())
    allow = G.Plugin("a", result=F.lit("ALLOW"))
    assert G.gate_trading(r, G.NoTradeConfig()).first().blocked_reasons == ["no active filter"]
    assert G.gate_trading(r, G.NoTradeConfig(), [allow]).first().trading_allowed
    assert not G.gate_trading(r, G.NoTradeConfig(), [allow, G.Plugin("b")]).first().trading_allowed
    assert not G.gate_trading(r, G.NoTradeConfig(), [allow, allow]).first().trading_allowed
    assert not G.gate_trading(r, G.NoTradeConfig(enabled=("x",)), [allow]).first().trading_allowed
    assert not G.gate_trading(r, G.NoTradeConfig(enabled=()), [allow]).first().trading_allowed


def test_own_checks_replace_the_built_in_ones(spark, hour):
    scored = SC.score(rows(spark, hour), CONFIG, {"funding": provider()})
    mine = issue(F.col("symbol") == "BTC", "ERROR", "mine", "not today")
    r = G.validate_signals(scored, G.ValidationConfig(), checks=[mine]).first()
    assert [i.category for i in r.validation_errors] == ["mine"] and r.data_integrity == "INVALID"


def test_custom_rules_and_missing_feature(spark, hour):
    features = spark.createDataFrame([("A", "x", hour(0), 1.0, "v1")], "symbol string, feature_name string, timestamp timestamp, value double, version string")
    table = [("s", "all", "ALL", True, "one", "x", "GT", 0.0, None, True), ("s", "all", "ALL", True, "two", "y", "GT", 0.0, None, True),
             ("s", "own", "CUSTOM", True, "one", "x", "EQ", 1.0, None, True)]
    got = {r.section: r for r in RL.apply_rules(features, spark.createDataFrame(table, RULE)).collect()}
    assert got["all"].passed is False and got["own"].passed is None and got["own"].flags == {"one": True}


def test_audit_finds_each_problem(spark):
    table = [("s", "empty", "ALL", True, None, None, None, None, None, None), ("s", "off", "ALL", False, None, None, None, None, None, None),
             ("s", "e", "ALL", True, "a", "x", "GT", 5.0, None, True), ("s", "e", "ALL", True, "b", "x", "LT", 5.0, None, True),
             ("s", "e", "ALL", True, "b", "z", "BETWEEN", 1.0, None, True), ("s", "e", "ALL", True, "c", "y", "EQ", 1.0, None, True),
             ("s", "e", "ALL", True, "d", "y", "NEQ", 1.0, None, True), ("s", "any", "ANY", True, "a", "x", "GT", 5.0, None, True),
             ("s", "any", "ANY", True, "b", "x", "LT", 1.0, None, True)]
    found = sorted((r.section, r.problem) for r in RL.audit_rules(spark.createDataFrame(table, RULE)).collect())
    assert found == [("e", "BETWEEN without upper value"), ("e", "EQ and NEQ on one value"), ("e", "bounds never both hold"),
                     ("e", "duplicate condition name"), ("empty", "enabled section without conditions")]


def test_index_agrees_with_every_row_judged(spark, hour):
    """Thousands of sections: what passes by bits is what passes row by row."""
    rng = random.Random(9)
    features = spark.createDataFrame(
        [(s, f, hour(h), float(rng.randint(0, 6)), "v1") for s in "AB" for h in range(12) for f in "xyz" if rng.random() < 0.8] + [("C", "unused", hour(0), 1.0, "v1")],
        "symbol string, feature_name string, timestamp timestamp, value double, version string")
    ops = ["GT", "GTE", "LT", "LTE", "EQ", "NEQ", "BETWEEN", "ODD"]
    table = []
    for i in range(1500):
        logic = rng.choice(["ALL", "ANY", "CUSTOM"])
        for j in range(rng.randint(1, 4)):
            value = None if rng.random() < 0.03 else float(rng.randint(0, 6))
            table.append((f"s{i % 40}", f"n{i}", logic, rng.random() < 0.95, f"c{j}", rng.choice(["x", "y", "z", "w", None]), rng.choice(ops), value,
                          rng.choice([None, float(rng.randint(0, 7))]), rng.random() < 0.9))
    rules = spark.createDataFrame(table, RULE)
    got = {tuple(r) for r in RL.passing_sections(features, rules).select("symbol", "timestamp", "strategy", "section").collect()}
    rows = RL.apply_rules(features, rules)
    want = {tuple(r) for r in rows.where("passed").select("symbol", "timestamp", "strategy", "section").collect()}
    assert got == want and len(want) > 1000
    sections = RL.sections_of(rules).count()
    assert rows.count() == sections * features.select("symbol", "timestamp").distinct().count()


def test_newest_version_of_a_feature_counts(spark, hour):
    features = spark.createDataFrame([("A", "x", hour(0), 5.0, "v1"), ("A", "x", hour(0), 1.0, "v2")],
                                     "symbol string, feature_name string, timestamp timestamp, value double, version string")
    rules = spark.createDataFrame([("s", "a", "ALL", True, "one", "x", "GT", 2.0, None, True)], RULE)
    assert RL.apply_rules(features, rules).first().passed is False and RL.passing_sections(features, rules).count() == 0


def test_no_rules_and_no_features(spark, hour):
    empty = spark.createDataFrame([], "symbol string, feature_name string, timestamp timestamp, value double, version string")
    rules = spark.createDataFrame([("s", "a", "ANY", True, "one", "x", "GT", 2.0, None, True)], RULE)
    some = spark.createDataFrame([("A", "x", hour(0), 5.0, "v1")], empty.schema)
    none = rules.where("false")
    for f, r in ((empty, rules), (some, none), (empty, none)):
        assert RL.apply_rules(f, r).count() == 0 and RL.passing_sections(f, r).count() == 0


def test_many_sections_are_not_broadcast(spark, monkeypatch):
    """Moments are there once for each shelf of sections, which no estimate of their size knows."""
    from perpflow.operators import rule_index

    for name, size in (("SLAB", 8), ("SHELF", 30), ("BLOCK", 20)):
        monkeypatch.setattr(rule_index, name, size, raising=False)
    number = F.col("id").cast("double")
    moments = spark.range(50).select(F.lit("A").alias("symbol"), F.timestamp_seconds("id").alias("timestamp"),
                                     F.array(F.struct(F.lit("x").alias("feature_name"), number.alias("value"))).alias("given"))
    condition = F.struct(F.lit("c").alias("name"), F.lit("x").alias("feature"), F.lit("GTE").alias("operator"), number.alias("value"), F.lit(None).cast("double").alias("value_high"))
    sections = spark.range(100).select(F.col("id").cast("string").alias("strategy"), F.lit("e").alias("section"), F.lit("ALL").alias("logic"), F.array(condition).alias("conditions"))
    hits = rule_index.passing(moments, sections)
    assert "BroadcastHashJoin" not in hits._jdf.queryExecution().executedPlan().toString()
    assert {(r.timestamp.minute * 60 + r.timestamp.second, int(r.strategy)) for r in hits.collect()} == {(m, s) for m in range(50) for s in range(m + 1)}
