"""Signal validation, decision readiness, risk and no-trade gates as row expressions.

Each stage adds columns to one row per (symbol, as_of). A check is a Column yielding NULL or
an issue, so users append their own; stages fail closed: nothing configured means nothing is
allowed.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from perpflow.functions.issues import gather, has_error, issue, of_severity, status
from perpflow.functions.numeric import is_bad, micros
from perpflow.operators.chunks import CHUNK, Grid, chunk_totals, window
from perpflow.operators.dedupe import flag_repeats
from perpflow.schema import ANALYSES

# Limits a risk profile can set.
RISK_LIMITS = ["max_leverage", "max_risk_per_trade_pct", "max_daily_drawdown_pct", "max_total_drawdown_pct",
               "max_exposure_pct", "max_capital_allocation_pct", "max_margin_utilization_pct", "max_portfolio_risk_pct"]
# The assessment field filled by a module of that name.
RISK_FIELDS = {"position_sizing": "position_size", "leverage_validation": "leverage_allowed",
               "max_risk_validation": "max_risk_allowed", "portfolio_risk": "portfolio_risk"}
FRESHNESS = ["freshness"]
INCONSISTENCY = ["consistency", "structural", "sequencing"]


def _invalid_share(x: Column) -> Column:
    """A present number outside [0, 1] or not finite."""
    return F.coalesce(is_bad(x) | (x < 0) | (x > 1), F.lit(False))


def _present(name: str) -> Column:
    return F.col(name).isNotNull()


def _age(moment: Column, reference: Column) -> Column:
    return F.unix_micros(reference) - F.unix_micros(moment)


def _absent_analyses() -> list[Column]:
    return [issue(F.col(n).isNull(), "WARNING", "completeness", "analysis not provided", n) for n in ANALYSES]


def _broken_analyses(symbols: bool = True) -> list[Column]:
    checks = []
    for n in ANALYSES:
        if symbols:
            checks.append(issue(_present(n) & (F.coalesce(F.col(n)["symbol"], F.lit("")) == ""), "ERROR", "structural", "empty symbol", n))
        level = F.col(n)["confidence_level"]
        bad = _present(n) & (level.isNull() | _invalid_share(level))
        checks.append(issue(bad, "ERROR", "structural", "confidence outside 0..1", n))
    return checks


def _naive(df: DataFrame, columns: Mapping[str, str]) -> list[Column]:
    """A timestamp column without zone breaks every row that has it."""
    checks = []
    for subject, path in columns.items():
        if dict(df.select(F.col(path).alias("t")).dtypes)["t"] == "timestamp_ntz":
            checks.append(issue(F.col(path).isNotNull(), "ERROR", "structural", "timestamp has no zone", subject))
    return checks


# --- signal validation ------------------------------------------------------------------------

@dataclass(frozen=True)
class ValidationConfig:
    expected_version: str | None = None
    max_staleness: timedelta | None = None
    max_skew: timedelta | None = None
    min_confidence: float | None = None
    min_completeness: float | None = None
    required: Sequence[str] = ()

    def __post_init__(self) -> None:
        if self.max_staleness is not None and self.max_staleness <= timedelta(0):
            raise ValueError("max_staleness must be positive")
        if self.max_skew is not None and self.max_skew < timedelta(0):
            raise ValueError("max_skew must not be negative")
        for name in ("min_confidence", "min_completeness"):
            value = getattr(self, name)
            if value is not None and not 0.0 <= value <= 1.0:
                raise ValueError(f"{name} must lie in [0, 1]")
        if set(self.required) - set(ANALYSES):
            raise ValueError("unknown name in required")


def _completeness() -> Column:
    states = F.map_values("feature_status")
    return F.coalesce(F.try_divide(F.size(F.filter(states, lambda s: s == "AVAILABLE")), F.size(states)), F.lit(0.0))


def signal_checks(df: DataFrame, config: ValidationConfig) -> list[Column]:
    """The built-in checks, in order. Needs score columns, analyses and ``reference_time``."""
    reference = F.col("reference_time")
    checks = [*_absent_analyses(), *_broken_analyses(), *_naive(df, {n: f"{n}.as_of" for n in ANALYSES})]
    for n in ANALYSES:
        state = F.col("feature_status")[n]
        level = "ERROR" if n in config.required else "WARNING"
        checks.append(issue(state.isNotNull() & (state != "AVAILABLE"), level, "completeness", F.concat(F.lit("provider is "), state), n))
    for n in ANALYSES:
        checks.append(issue(F.col(n)["symbol"] != F.col("symbol"), "ERROR", "consistency", "symbol differs", n))
    if config.max_skew is not None:
        times = [F.unix_micros(F.col(n)["as_of"]) for n in ANALYSES]
        spread = F.greatest(*times) - F.least(*times)
        checks.append(issue(spread > micros(config.max_skew), "WARNING", "consistency", "timestamps too far apart"))
    confidence = F.col("confidence")
    checks.append(issue(_invalid_share(confidence), "ERROR", "confidence", "confidence is invalid"))
    if config.min_confidence is not None:
        low = ~_invalid_share(confidence) & (confidence < config.min_confidence)
        checks.append(issue(low, "WARNING", "confidence", "confidence is low"))
    if config.expected_version is not None:
        checks.append(issue(F.col("score_version") != config.expected_version, "WARNING", "version", "unexpected score version"))
    versions = F.array_compact(F.array(*[F.col(f"{n}_score")["provider_version"] for n in ANALYSES]))
    checks.append(issue(F.size(F.array_distinct(versions)) > 1, "WARNING", "version", "component versions differ"))
    for n in [*ANALYSES, None]:
        age = _age(F.col(n)["as_of"] if n else F.col("as_of"), reference)
        checks.append(issue(age < 0, "WARNING", "freshness", "timestamp in the future", n))
        if config.max_staleness is not None:
            checks.append(issue(age > micros(config.max_staleness), "WARNING", "freshness", "stale", n))
    if config.min_completeness is not None:
        short = (F.size("feature_status") > 0) & (_completeness() < config.min_completeness)
        checks.append(issue(short, "WARNING", "completeness", "too few providers available"))
    return checks


def flag_out_of_order(df: DataFrame, arrival: str, grid: Grid = Grid(1, 65536, 1)) -> DataFrame:
    """``is_out_of_order``: as_of is not after the latest as_of that arrived earlier for the symbol.

    ``arrival`` is a whole number that follows the order of arrival; chunks are ranges of it.
    """
    rows = df.withColumn(CHUNK, grid.chunk(df, arrival))
    bases = chunk_totals(rows, ["symbol"], {"latest": ("max", F.col("as_of"))})
    before = F.max("as_of").over(window(["symbol"], arrival).rowsBetween(W.unboundedPreceding, -1))
    joined = rows.withColumn("_before", before).join(bases, ["symbol", CHUNK])
    late = F.col("as_of") <= F.greatest("_before", "_base_latest")
    return joined.withColumn("is_out_of_order", F.coalesce(late, F.lit(False))).drop(CHUNK, "_before", "_base_latest")


def validate_signals(scored: DataFrame, config: ValidationConfig, *, arrival: str | None = None,
                     checks: Sequence[Column] | None = None, grid: Grid = Grid(1, 65536, 1)) -> DataFrame:
    """Add errors, warnings, confidence status, completeness, module health and data integrity."""
    rows = scored
    raised = list(signal_checks(scored, config) if checks is None else checks)
    if arrival:
        rows = flag_out_of_order(flag_repeats(rows, ["symbol", "as_of", "score_version"], arrival), arrival, grid)
        raised.append(issue(F.col("is_duplicate"), "WARNING", "duplicate", "signal seen before"))
        raised.append(issue(F.col("is_out_of_order"), "ERROR", "sequencing", "as_of not after the previous one"))
    found, confidence = F.col("signal_issues"), F.col("confidence")
    low = F.lit(False) if config.min_confidence is None else confidence < config.min_confidence
    ratio = _completeness()
    names = F.map_keys("feature_status")
    available = F.filter(names, lambda k: F.element_at("feature_status", k) == "AVAILABLE")

    def health(name: Column, state: Column) -> Column:
        stale = F.lit(False)
        if config.max_staleness is not None:
            ages = [F.when(name == n, _age(F.col(n)["as_of"], F.col("reference_time"))) for n in ANALYSES]
            stale = F.coalesce(F.coalesce(*ages) > micros(config.max_staleness), F.lit(False))
        return F.when(state != "AVAILABLE", state).when(stale, "STALE").otherwise("HEALTHY")

    def any_of(issues: Column, categories: list[str]) -> Column:
        return F.exists(issues, lambda i: i["category"].isin(categories))

    return rows.withColumn("signal_issues", gather(raised)).withColumns({
        "validation_errors": of_severity(found, "ERROR"),
        "validation_warnings": of_severity(found, "WARNING"),
        "validation_passed": ~has_error(found),
        "confidence_status": F.when(confidence.isNull(), "UNKNOWN").when(_invalid_share(confidence), "INVALID")
        .when(low, "LOW").otherwise("VALID"),
        "available_providers": F.array_sort(available),
        "missing_providers": F.array_sort(F.array_except(names, available)),
        "completeness_ratio": ratio,
        "is_sufficient": F.lit(None).cast("boolean") if config.min_completeness is None else ratio >= config.min_completeness,
        "module_health": F.transform_values("feature_status", health),
        "data_integrity": F.when(any_of(found, FRESHNESS), "STALE")
        .when(any_of(of_severity(found, "ERROR"), INCONSISTENCY), "INCONSISTENT")
        .when(has_error(found), "INVALID").otherwise("VALID"),
    })


# --- decision ---------------------------------------------------------------------------------

@dataclass(frozen=True)
class Plugin:
    """A named column rule (decision provider, risk module or no-trade filter).

    ``result`` gives the outcome column; None means not implemented. ``reason`` and ``value``
    are optional columns that go with it.
    """

    name: str
    version: str = "v1"
    result: Column | None = None
    reason: Column | str = ""
    value: Column | None = None


def _text(x: Column | str) -> Column:
    return F.lit(x) if isinstance(x, str) else x


@dataclass(frozen=True)
class DecisionConfig:
    expected_version: str | None = None
    require_validation_passed: bool = True
    required: Sequence[str] = ()
    priorities: Mapping[str, int] = field(default_factory=dict)


OUTCOMES_TYPE = "array<struct<provider:string,version:string,status:string,reason:string>>"


def decide(validated: DataFrame, config: DecisionConfig, providers: Sequence[Plugin] = (), *,
           arrival: str | None = None, checks: Sequence[Column] | None = None) -> DataFrame:
    """Add decision status NOT_READY / PENDING / EVALUATED with reason, issues and outcomes.

    A provider's ``result`` is an outcome status; PENDING is no substantive outcome. Repeats
    are judged against everything that arrived before.
    """
    state_version = F.col("strategy_version") if "strategy_version" in validated.columns else F.col("score_version")
    rows = validated.withColumn("strategy_version", state_version)
    raised = list(checks) if checks is not None else [
        *_absent_analyses(),
        issue(F.coalesce(F.col("symbol"), F.lit("")) == "", "ERROR", "structural", "score has no symbol", "score"),
        issue(F.trim(F.coalesce("score_version", F.lit(""))) == "", "ERROR", "structural", "score has no version", "score"),
        issue(_invalid_share(F.col("confidence")), "ERROR", "structural", "score confidence is invalid", "score"),
        *_naive(validated, {"score": "as_of"}),
        *_broken_analyses(),
        issue(F.col("strategy_version") != F.col("score_version"), "WARNING", "version", "state and score versions differ"),
    ]
    if checks is None and config.expected_version is not None:
        raised.append(issue(F.col("strategy_version") != config.expected_version, "WARNING", "version", "unexpected strategy version"))
    unregistered = sorted(set(config.required) - {p.name for p in providers})
    raised += [issue(F.lit(True), "ERROR", "unsupported", "required provider not registered", n) for n in unregistered]
    if arrival:
        rows = flag_repeats(rows, ["symbol", "as_of", "strategy_version"], arrival, "_again")
        raised.append(issue(F.col("_again"), "WARNING", "duplicate", "processed before"))
    ranked = sorted(providers, key=lambda p: (p.name not in config.priorities, config.priorities.get(p.name, 0)))
    outcomes = F.array(*[
        F.struct(F.lit(p.name).alias("provider"), F.lit(p.version).alias("version"),
                 F.coalesce(p.result if p.result is not None else F.lit(None).cast("string"), F.lit("PENDING")).alias("status"),
                 (_text(p.reason) if p.result is not None else F.lit("not implemented")).alias("reason"))
        for p in ranked
    ]).cast(OUTCOMES_TYPE)
    found = F.col("decision_issues")
    upstream = ~F.col("validation_passed") if config.require_validation_passed else F.lit(False)
    blocked = has_error(found) | upstream
    rows = rows.withColumn("decision_issues", gather(raised)).withColumn("_blocked", blocked)
    rows = rows.withColumn("provider_outcomes", F.when(F.col("_blocked"), F.array().cast(OUTCOMES_TYPE)).otherwise(outcomes))
    evaluated = F.exists("provider_outcomes", lambda o: o["status"] != "PENDING")
    errors = F.size(of_severity(found, "ERROR"))
    why = F.concat(F.lit("not ready: "), F.concat_ws(
        "; ",
        F.when(errors > 0, F.concat(errors.cast("string"), F.lit(" error(s)"))),
        F.when(upstream, "signal validation failed"),
    ))
    return rows.withColumns({
        "decision_status": F.when(F.col("_blocked"), "NOT_READY").when(evaluated, "EVALUATED").otherwise("PENDING"),
        "decision_reason": F.when(F.col("_blocked"), why).when(evaluated, "a provider gave an outcome")
        .when(F.size("provider_outcomes") > 0, "no substantive outcome yet").otherwise("no providers"),
        "decision_validation": status(found),
        "execution_ready": ~F.col("_blocked") & evaluated,
    }).drop("_blocked", "_again")


# --- risk -------------------------------------------------------------------------------------

@dataclass(frozen=True)
class RiskConfig:
    limits: Mapping[str, float | None] | None = None
    expected_version: str | None = None

    def __post_init__(self) -> None:
        unknown = set(self.limits or {}) - set(RISK_LIMITS)
        if unknown:
            raise ValueError(f"unknown limits: {sorted(unknown)}")
        if any(v is not None and v <= 0 for v in (self.limits or {}).values()):
            raise ValueError("limits must be positive")


MODULES_TYPE = "array<struct<module:string,version:string,approved:boolean,value:double,reason:string>>"


def _positions(bad: Callable[[Column], Column], message: str) -> Column:
    """One issue per offending position."""
    hits = F.filter(F.coalesce(F.col("portfolio")["positions"], F.array()), lambda p: F.coalesce(bad(p), F.lit(False)))
    return F.transform(hits, lambda p: F.struct(
        F.lit("ERROR").alias("severity"), F.lit("structural").alias("category"),
        F.lit(message).alias("message"), p["symbol"].alias("subject")))


def risk_issues(config: RiskConfig) -> Column:
    """Built-in checks on ``portfolio`` (cash, equity, positions), ``market_data`` and versions."""
    cash, equity, market = F.col("portfolio")["cash"], F.col("portfolio")["equity"], F.col("market_data")
    price = market["price"]
    unset = [n for n in RISK_LIMITS if (config.limits or {}).get(n) is None]
    single = [
        issue(is_bad(cash), "ERROR", "structural", "cash is not finite"),
        issue(is_bad(equity), "ERROR", "structural", "equity is not finite"),
        issue(~is_bad(equity) & (equity <= 0), "ERROR", "structural", "equity is not positive"),
        issue(market.isNotNull() & (is_bad(price) | (price <= 0)), "ERROR", "structural", "invalid price", "market_data"),
        issue(F.lit(bool(unset)), "WARNING", "configuration",
              "no risk profile" if config.limits is None else f"unset limits: {', '.join(unset)}"),
        issue(F.col("strategy_version") != F.col("score_version"), "WARNING", "version", "decision and score versions differ"),
    ]
    if config.expected_version is not None:
        single.append(issue(F.col("strategy_version") != config.expected_version, "WARNING", "version", "unexpected strategy version"))

    def bad_size(p: Column) -> Column:
        return is_bad(p["quantity"]) | is_bad(p["avg_entry_price"])

    return F.concat(
        _positions(lambda p: p["leverage"].isNotNull() & (is_bad(p["leverage"]) | (p["leverage"] <= 0)), "invalid leverage"),
        _positions(bad_size, "size or entry price is not finite"),
        _positions(lambda p: ~bad_size(p) & (p["avg_entry_price"] < 0), "negative entry price"),
        _positions(lambda p: is_bad(p["unrealized_pnl"]), "unrealised result is not finite"),
        gather(single),
    )


def assess_risk(decided: DataFrame, config: RiskConfig, modules: Sequence[Plugin] = ()) -> DataFrame:
    """Add the risk verdict: approved only without errors and with every (at least one) module at TRUE."""
    results = F.array(*[
        F.struct(F.lit(m.name).alias("module"), F.lit(m.version).alias("version"),
                 (m.result if m.result is not None else F.lit(None)).cast("boolean").alias("approved"),
                 (m.value if m.value is not None else F.lit(None)).cast("double").alias("value"),
                 (_text(m.reason) if m.result is not None else F.lit("not implemented")).alias("reason"))
        for m in modules
    ]).cast(MODULES_TYPE)
    rows = decided.withColumn("risk_issues", risk_issues(config))
    found = F.col("risk_issues")
    rows = rows.withColumn("module_results", F.when(has_error(found), F.array().cast(MODULES_TYPE)).otherwise(results))
    ran = F.col("module_results")

    def value_of(module: str) -> Column:
        mine = F.filter(ran, lambda r: (r["module"] == module) & r["value"].isNotNull())
        return F.try_element_at(mine, F.lit(-1))["value"]

    verdict = F.try_element_at(F.filter(ran, lambda r: (r["module"] == "exposure_management") & r["approved"].isNotNull()), F.lit(1))["approved"]
    all_true = F.forall(ran, lambda r: F.coalesce(r["approved"], F.lit(False)))
    return rows.withColumns({
        "risk_approved": ~has_error(found) & (F.size(ran) > 0) & all_true,
        "exposure_status": F.when(verdict.isNull(), "UNKNOWN").when(verdict, "WITHIN_LIMITS").otherwise("EXCEEDED"),
        "risk_validation": status(found),
        **{column: value_of(module) for module, column in RISK_FIELDS.items()},
    })


# --- no trade ---------------------------------------------------------------------------------

@dataclass(frozen=True)
class NoTradeConfig:
    enabled: Sequence[str] | None = None
    expected_version: str | None = None


FILTERS_TYPE = "array<struct<filter:string,version:string,verdict:string,reason:string>>"


def no_trade_checks(df: DataFrame, config: NoTradeConfig, filters: Sequence[Plugin]) -> list[Column]:
    market, portfolio = F.col("market_data"), F.col("portfolio")
    price, equity = market["price"], portfolio["equity"]
    has_risk = "risk_approved" in df.columns
    checks = [
        *_absent_analyses(),
        issue(F.lit(not has_risk), "WARNING", "completeness", "not provided", "risk_assessment"),
        issue(market.isNull(), "WARNING", "completeness", "not provided", "market_data"),
        issue(portfolio.isNull(), "WARNING", "completeness", "not provided", "portfolio"),
        issue(F.coalesce(F.col("symbol"), F.lit("")) == "", "ERROR", "structural", "score has no symbol"),
        *_naive(df, {"score": "as_of"}),
        *_broken_analyses(symbols=False),
        issue(market.isNotNull() & (is_bad(price) | (price <= 0)), "ERROR", "structural", "invalid price", "market_data"),
        issue(portfolio.isNotNull() & is_bad(equity), "ERROR", "structural", "equity is not finite", "portfolio"),
    ]
    names = [f.name for f in filters]
    for n in config.enabled or ():
        checks.append(issue(F.lit(n not in names), "ERROR", "registration", "enabled filter not registered", n))
    for n in sorted({n for n in names if names.count(n) > 1}):
        checks.append(issue(F.lit(True), "ERROR", "registration", "filter registered twice", n))
    if config.expected_version is not None:
        checks.append(issue(F.col("strategy_version") != config.expected_version, "WARNING", "version", "unexpected strategy version"))
    checks.append(issue(F.col("strategy_version") != F.col("score_version"), "WARNING", "version", "decision and score versions differ"))
    if "risk_version" in df.columns:
        checks.append(issue(F.col("risk_version") != F.col("strategy_version"), "WARNING", "version", "risk and decision versions differ"))
    return checks


def gate_trading(assessed: DataFrame, config: NoTradeConfig, filters: Sequence[Plugin] = (),
                 checks: Sequence[Column] | None = None) -> DataFrame:
    """Add ``trading_allowed`` with every reason that closes the gate.

    Closed by errors, by having no active filter, and by any filter that says BLOCK or cannot
    say. A filter's ``result`` is ALLOW, BLOCK or CANNOT_EVALUATE.
    """
    active = [f for f in filters if config.enabled is None or f.name in config.enabled]
    results = F.array(*[
        F.struct(F.lit(f.name).alias("filter"), F.lit(f.version).alias("version"),
                 F.coalesce(f.result if f.result is not None else F.lit(None).cast("string"), F.lit("CANNOT_EVALUATE")).alias("verdict"),
                 (_text(f.reason) if f.result is not None else F.lit("not implemented")).alias("reason"))
        for f in active
    ]).cast(FILTERS_TYPE)
    raised = no_trade_checks(assessed, config, filters) if checks is None else list(checks)
    rows = assessed.withColumn("no_trade_issues", gather(raised))
    found = F.col("no_trade_issues")
    rows = rows.withColumn("filter_results", F.when(has_error(found), F.array().cast(FILTERS_TYPE)).otherwise(results))
    errors = F.size(of_severity(found, "ERROR"))
    framework = F.when(errors > 0, F.concat(errors.cast("string"), F.lit(" validation error(s)")))
    if not active:
        framework = F.coalesce(framework, F.lit("no active filter"))
    closing = F.transform(
        F.filter("filter_results", lambda r: r["verdict"] != "ALLOW"),
        lambda r: F.concat_ws(": ", r["filter"], F.when(r["verdict"] == "CANNOT_EVALUATE", "cannot evaluate"), r["reason"]),
    )
    reasons = F.concat(F.array_compact(F.array(framework)), closing)
    return rows.withColumns({
        "blocked_reasons": reasons,
        "trading_allowed": F.size(reasons) == 0,
        "warning_messages": F.transform(of_severity(found, "WARNING"), lambda i: i["message"]),
        "active_filters": F.array(*[F.lit(f.name) for f in active]).cast("array<string>"),
        "skipped_filters": F.array(*[F.lit(f.name) for f in filters if config.enabled is not None and f.name not in config.enabled]).cast("array<string>"),
        "no_trade_validation": status(found),
    })
