"""Score rows from up to four analyses, with pluggable providers and aggregator.

Input: one row per (symbol, as_of) with a nullable struct column per analysis (at least
``symbol``, ``as_of``, ``confidence_level``). Everything is column expressions on that row;
only the repeat check needs another pass.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from perpflow.functions.issues import gather, has_error, issue, status
from perpflow.functions.numeric import is_bad
from perpflow.operators.dedupe import flag_repeats
from perpflow.schema import ANALYSES

COMPONENT_TYPE = "struct<provider_version:string,value:double,confidence:double,explanation:string>"


@dataclass(frozen=True)
class Provider:
    """Turns one analysis struct into a component value.

    ``value`` maps the analysis column to a score column; None means the formula is not
    implemented yet, which is a status of its own.
    """

    version: str
    value: Callable[[Column], Column] | None = None
    explanation: str = ""


@dataclass(frozen=True)
class ScoreConfig:
    version: str
    weights: Mapping[str, float] = field(default_factory=dict)
    required: Sequence[str] = ()
    score_min: float = 0.0
    score_max: float = 1.0
    confidence: str = "MIN"

    def __post_init__(self) -> None:
        if not self.version.strip():
            raise ValueError("version must not be empty")
        if self.score_min >= self.score_max:
            raise ValueError("score_min must be below score_max")
        unknown = (set(self.required) | set(self.weights)) - set(ANALYSES)
        if unknown:
            raise ValueError(f"unknown analyses: {sorted(unknown)}")
        if any(w < 0 for w in self.weights.values()):
            raise ValueError("weights must not be negative")
        if self.confidence not in ("MIN", "MEAN"):
            raise ValueError(f"unknown confidence rule {self.confidence}")


def join_analyses(analyses: Mapping[str, DataFrame]) -> DataFrame:
    """Analyses aligned by (symbol, as_of); an absent side is a NULL struct."""
    key = ["symbol", "as_of"]
    joined = None
    for name in ANALYSES:
        df = analyses.get(name)
        if df is None:
            continue
        packed = df.select(*key, F.struct(*df.columns).alias(name))
        joined = packed if joined is None else joined.join(packed, key, "full_outer")
    if joined is None:
        raise ValueError("at least one analysis is needed")
    empty = "struct<symbol:string,as_of:timestamp,confidence_level:double>"
    missing = {n: F.lit(None).cast(empty) for n in ANALYSES if n not in joined.columns}
    return joined.withColumns(missing) if missing else joined


def component(name: str, provider: Provider | None) -> Column:
    """The provider's struct, or NULL without input, provider or formula."""
    if provider is None or provider.value is None:
        return F.lit(None).cast(COMPONENT_TYPE)
    source = F.col(name)
    body = F.struct(
        F.lit(provider.version).alias("provider_version"),
        provider.value(source).cast("double").alias("value"),
        source["confidence_level"].alias("confidence"),
        F.lit(provider.explanation).alias("explanation"),
    )
    return F.when(source.isNotNull(), body).cast(COMPONENT_TYPE)


def component_status(name: str, provider: Provider | None) -> Column:
    source, value = F.col(name), F.col(f"{name}_score")["value"]
    if provider is None:
        return F.lit("MISSING")
    if provider.value is None:
        return F.when(source.isNull(), "MISSING").otherwise("NOT_IMPLEMENTED")
    return (
        F.when(source.isNull(), "MISSING")
        .when(value.isNull() | is_bad(value), "INVALID")
        .otherwise("AVAILABLE")
    )


def weighted_mean(values: Mapping[str, Column], usable: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """Sum(w*v)/Sum(w) over usable components; NULL if one lacks a weight or value, or none counts."""
    total, mass, blocked = F.lit(0.0), F.lit(0.0), F.lit(False)
    for name, value in values.items():
        weight = weights.get(name)
        if weight is None:
            blocked = blocked | usable[name]
            continue
        blocked = blocked | (usable[name] & value.isNull())
        total = total + F.when(usable[name], F.lit(float(weight)) * value).otherwise(0.0)
        mass = mass + F.when(usable[name], F.lit(float(weight))).otherwise(0.0)
    return F.when(~blocked, F.try_divide(total, mass))


def _score_checks(config: ScoreConfig, providers: Mapping[str, Provider]) -> list[Column]:
    checks = [
        issue(F.col(f"{n}_score").isNull(), "ERROR", "completeness", "required component is missing", n)
        for n in config.required
    ]
    for n in ANALYSES:
        c = F.col(f"{n}_score")
        checks.append(issue(c["confidence"] == 0.0, "WARNING", "completeness", "input has zero confidence", n))
    for n in ANALYSES:
        value = F.col(f"{n}_score")["value"]
        outside = ~is_bad(value) & ((value < config.score_min) | (value > config.score_max))
        checks.append(issue(is_bad(value), "ERROR", "structural", "score is not finite", n))
        checks.append(issue(outside, "ERROR", "structural", "score is out of range", n))
    for n in ANALYSES:
        if n in providers and providers[n].version != config.version:
            checks.append(issue(F.col(f"{n}_score").isNotNull(), "WARNING", "version", "provider version differs", n))
    return checks


def score(df: DataFrame, config: ScoreConfig, providers: Mapping[str, Provider], *, arrival: str | None = None,
          aggregate: Callable[..., Column] = weighted_mean) -> DataFrame:
    """Add components, statuses, issues, total and confidence to every (symbol, as_of) row.

    ``arrival`` orders the calculations; a repeated (symbol, as_of) then gets a warning.
    ``aggregate(values, usable, weights)`` can be replaced.
    """
    rows = flag_repeats(df, ["symbol", "as_of"], arrival, "_again") if arrival else df.withColumn("_again", F.lit(False))
    rows = rows.withColumns({f"{n}_score": component(n, providers.get(n)) for n in ANALYSES})
    pairs = [p for n in ANALYSES for p in (F.lit(n), component_status(n, providers.get(n)))]
    rows = rows.withColumn("feature_status", F.create_map(*pairs))
    again = issue(F.col("_again"), "WARNING", "duplicate", "score calculated before")
    rows = rows.withColumn("validation_issues", gather([*_score_checks(config, providers), again]))
    usable = {n: F.col("feature_status")[n] == "AVAILABLE" for n in ANALYSES}
    values = {n: F.col(f"{n}_score")["value"] for n in ANALYSES}
    levels = [F.col(n)["confidence_level"] for n in ANALYSES]
    if config.confidence == "MIN":
        confidence = F.least(*levels)
    else:
        present = sum((lvl.isNotNull().cast("int") for lvl in levels), F.lit(0))
        confidence = F.try_divide(sum((F.coalesce(lvl, F.lit(0.0)) for lvl in levels), F.lit(0.0)), present)
    return rows.withColumns({
        "symbol": F.upper("symbol"),
        "score_version": F.lit(config.version),
        "validation_status": status(F.col("validation_issues")),
        "total_score": F.when(~has_error(F.col("validation_issues")), aggregate(values, usable, config.weights)),
        "confidence": confidence,
    }).drop("_again")
