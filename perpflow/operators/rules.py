"""Rule tables: conditions on features, evaluated and audited as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from perpflow.operators import rule_index, rule_summary
from perpflow.session import cut_lineage

SECTION = ["strategy", "section"]


def holds(op: Column, x: Column, value: Column, high: Column) -> Column:
    """Truth of one comparison; NULL for an unknown operator or a missing threshold."""
    return (
        F.when(op == "GT", x > value)
        .when(op == "GTE", x >= value)
        .when(op == "LT", x < value)
        .when(op == "LTE", x <= value)
        .when(op == "EQ", x == value)
        .when(op == "NEQ", x != value)
        .when(op == "BETWEEN", (x >= value) & (x <= high))
    )


def condition_flags(features: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per (symbol, timestamp, enabled condition) whose feature exists there."""
    active = rules.filter("section_enabled AND enabled").select(
        *SECTION, "logic", "name", F.col("feature").alias("feature_name"), "operator",
        F.col("value").alias("_low"), "value_high")
    joined = features.select("symbol", "timestamp", "feature_name", "value").join(active, "feature_name")
    return joined.select(
        "symbol", "timestamp", *SECTION, "logic", "name",
        holds(F.col("operator"), F.col("value"), F.col("_low"), F.col("value_high")).alias("holds"),
    )


def moments_of(features: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """(symbol, timestamp, given): the features of each moment, the newest version of each; one shuffle.

    With ``rules`` only the features that they name travel; moments that have none of those stay, with an empty array.
    """
    kept = features.select("symbol", "timestamp", "feature_name", "value", *(["version"] if "version" in features.columns else []))
    if rules is not None:
        named = rules.select(F.col("feature").alias("feature_name")).distinct().withColumn("_named", F.lit(True))
        kept = kept.join(named, "feature_name", "left").withColumn("feature_name", F.when(F.col("_named"), F.col("feature_name"))).drop("_named")
    placed = kept.repartition("symbol", "timestamp")
    order = F.struct("version", "value") if "version" in features.columns else F.col("value")
    newest = placed.groupBy("symbol", "timestamp", "feature_name").agg(F.max_by("value", order).alias("value"))
    entry = F.when(F.col("feature_name").isNotNull(), F.struct("feature_name", "value"))
    return newest.groupBy("symbol", "timestamp").agg(F.collect_list(entry).alias("given"))


def sections_of(rules: DataFrame) -> DataFrame:
    """(strategy, section, logic, conditions): the enabled conditions of every enabled section."""
    active = rules.filter("section_enabled AND enabled")
    return active.groupBy(*SECTION, "logic").agg(
        F.array_sort(F.collect_list(F.struct("name", "feature", "operator", "value", "value_high"))).alias("conditions"))


def passing_sections(features: DataFrame, rules: DataFrame) -> DataFrame:
    """(symbol, timestamp, strategy, section) of every section that passes, for very many sections.

    The same judgement as ``apply_rules`` without a row for what does not pass: see ``rule_index``.
    """
    active = rules.filter("section_enabled AND enabled")
    return rule_index.passing(cut_lineage(moments_of(features, active)), cut_lineage(sections_of(rules)))


def section_summary(features: DataFrame, rules: DataFrame) -> DataFrame:
    """(strategy, section, logic, symbol, passed, first, last): how often each section passes, and the first and last time.

    ``passing_sections`` counted by section and symbol, but no row is made for what passes: see ``rule_summary``.
    """
    active = rules.filter("section_enabled AND enabled")
    return rule_summary.summary(cut_lineage(moments_of(features, active)), active)


def apply_rules(features: DataFrame, rules: DataFrame) -> DataFrame:
    """Per (symbol, timestamp, section): ``passed`` by ALL / ANY over the enabled conditions.

    A condition without its feature at that time does not hold; a section none of whose features is
    there still has its row. CUSTOM sections are combined elsewhere: their ``passed`` is NULL and
    ``flags`` carries the single results. Of several versions of a feature the newest counts.

    The result has a row for each moment and section; nothing else of that size is made or shuffled. Sections
    travel to the moments in slabs, each moment is judged as one row.
    """
    sections = cut_lineage(sections_of(rules))
    n_slabs = max(1, -(-sections.count() // rule_index.SLAB))
    slabs = sections.groupBy(F.pmod(F.xxhash64(*SECTION), F.lit(n_slabs)).cast("int").alias("slab")).agg(
        F.collect_list(F.struct(*SECTION, "logic", "conditions")).alias("sections"))
    moments = moments_of(features, sections.select(F.explode("conditions.feature").alias("feature")))
    given = F.map_from_entries("given").alias("given")
    judged = moments.select("symbol", "timestamp", given, F.explode(F.sequence(F.lit(0), F.lit(n_slabs - 1))).alias("slab")).join(
        slabs, "slab").select("symbol", "timestamp", "given", F.explode("sections").alias("s")).select(
        "symbol", "timestamp", "given", "s.*")

    def judge(c: Column) -> Column:
        return F.struct(c["name"].alias("name"), holds(c["operator"], F.try_element_at("given", c["feature"]), c["value"], c["value_high"]).alias("holds"))

    present = F.filter("conditions", lambda c: F.map_contains_key("given", F.coalesce(c["feature"], F.lit(""))))
    flags = F.transform(present, judge)
    judged = judged.withColumn("_flags", flags).withColumns({
        "met": F.size(F.filter("_flags", lambda e: e["holds"])).cast("bigint"), "conditions": F.size("conditions").cast("bigint")})
    passed = F.when(F.col("logic") == "ALL", F.col("met") == F.col("conditions")).when(F.col("logic") == "ANY", F.col("met") > 0)
    return judged.select(
        *SECTION, "symbol", "timestamp", "logic", "met", F.map_from_entries("_flags").alias("flags"), "conditions", passed.alias("passed"))


def _finding(df: DataFrame, severity: str, problem: Column, subject: Column) -> DataFrame:
    return df.select(*SECTION, F.lit(severity).alias("severity"), problem.alias("problem"),
                     subject.cast("string").alias("subject"))


def _problems(df: DataFrame, problems: list[Column], subject: Column) -> DataFrame:
    """One pass over the rows for several checks, each NULL or the name of its problem."""
    found = df.withColumn("_p", F.explode(F.array_compact(F.array(*problems))))
    return _finding(found, "ERROR", F.col("_p"), subject)


def audit_rules(rules: DataFrame) -> DataFrame:
    """Problems in any number of rule sets as (strategy, section, severity, problem, subject).

    Disabled sections are left alone. A section without a condition is one row with a NULL
    name. Contradictions are looked for under ALL only, among enabled complete conditions.
    """
    on = rules.filter("section_enabled")
    conditions = on.filter("name IS NOT NULL")
    empty = on.groupBy(*SECTION).agg(F.count("name").alias("n")).filter("n = 0")
    live = conditions.filter("enabled")
    name = F.col("name")
    incomplete = [
        F.when(F.coalesce(F.trim("feature"), F.lit("")) == "", "condition without feature"),
        F.when(F.col("value").isNull(), "condition without value"),
        F.when((F.col("operator") == "BETWEEN") & F.col("value_high").isNull(), "BETWEEN without upper value"),
    ]
    parts = [
        _finding(empty, "ERROR", F.lit("enabled section without conditions"), F.lit(None)),
        _problems(live, incomplete, name),
    ]
    repeated = conditions.groupBy(*SECTION, "name").count().filter("count > 1")
    parts.append(_finding(repeated, "ERROR", F.lit("duplicate condition name"), name))
    signature = ["feature", "operator", "value", "value_high"]
    same = conditions.groupBy(*SECTION, *signature).agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))
    parts.append(_finding(same.filter("n > 1"), "WARNING", F.lit("identical conditions"), F.col("names")))
    parts.append(_contradictions(live.filter("logic = 'ALL' AND value IS NOT NULL AND feature != ''")))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _contradictions(rules: DataFrame) -> DataFrame:
    """Bounds of each (section, feature) with at least two conditions that exclude each other.

    Of several bounds at the same value the first given one sets whether the value itself is
    allowed; ``position`` (optional) is the order in which conditions were given.
    """
    place = F.col("position") if "position" in rules.columns else F.lit(0)
    op, value, high = F.col("operator"), F.col("value"), F.col("value_high")
    closed_range = (op == "BETWEEN") & high.isNotNull()
    lower = F.when(op.isin("GT", "GTE") | closed_range, F.struct(value.alias("v"), (-place).alias("p"), (op != "GT").alias("closed")))
    top = F.when(closed_range, high).when(op.isin("LT", "LTE"), value)
    upper = F.when(top.isNotNull(), F.struct(top.alias("v"), place.alias("p"), (op != "LT").alias("closed")))
    bounds = (
        rules.groupBy(*SECTION, "feature")
        .agg(
            F.count(F.lit(1)).alias("n"), F.max(lower).alias("lower"), F.min(upper).alias("upper"),
            F.collect_set(F.when(op == "EQ", value)).alias("eq"),
            F.collect_set(F.when(op == "NEQ", value)).alias("neq"),
        )
        .filter("n > 1")
    )
    low, up = F.col("lower"), F.col("upper")
    never = (low["v"] > up["v"]) | ((low["v"] == up["v"]) & ~(low["closed"] & up["closed"]))
    def each(e: Column) -> Column:
        below = (e < low["v"]) | ((e == low["v"]) & ~low["closed"])
        above = (e > up["v"]) | ((e == up["v"]) & ~up["closed"])
        return F.array(
            F.when(below, "EQ below lower bound"),
            F.when(above, "EQ above upper bound"),
            F.when(F.array_contains("neq", e), "EQ and NEQ on one value"),
        )

    whole = F.array(F.when(F.size("eq") > 1, "contradictory EQ values"), F.when(never, "bounds never both hold"))
    problems = F.array_compact(F.concat(whole, F.flatten(F.transform("eq", each))))
    return _finding(bounds.withColumn("_p", F.explode(problems)), "ERROR", F.col("_p"), F.col("feature"))
