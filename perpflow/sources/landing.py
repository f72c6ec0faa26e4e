"""Landed API payloads (JSON text) to canonical records, good rows and rejects apart.

Input: one payload text per row plus the columns that say what it is (exchange, symbol,
timeframe). Output of every mapper: ``(records, rejects)``. A reject keeps the payload item
and the reason. ``mode="failfast"`` raises while the records are read instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from perpflow.functions.numeric import identifier
from perpflow.schema import RECORD_TYPES, SUPPORTED_MARKET
from perpflow.session import cut_lineage

# Payload field names of each record type.
FIELDS = {
    "candle": ["open", "high", "low", "close", "volume_usd"],
    "funding_rate": ["close"],
    "open_interest": ["close"],
    "liquidation": ["long_liquidation_usd", "short_liquidation_usd"],
}
# Percentage fields of the three long/short sources.
RATIO_FIELDS = {
    "global": ("global_account_long_percent", "global_account_short_percent"),
    "top_account": ("top_account_long_percent", "top_account_short_percent"),
    "top_position": ("top_position_long_percent", "top_position_short_percent"),
}
AGGREGATED = "AGGREGATED"


#: Where a landed payload comes from; mappers hand these on with records and rejects.
PROVENANCE = ["file", "line"]


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Landed files, one payload per line, with ``file`` and ``line`` (from 1); partition folders give exchange, symbol, timeframe.

    Large files are read in splits. Lines are counted inside each split, and one row per split tells how many
    lines of its file came before, so no task reads a whole file.
    """
    raw = spark.read.text(path)
    ids = [c for c in raw.columns if c != "value"]
    lines = cut_lineage(raw.select(
        *ids, F.col("value").alias("payload"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_row")))
    before = W.partitionBy("file").orderBy("_split").rowsBetween(W.unboundedPreceding, -1)
    counts = lines.groupBy("file", "_split").agg(F.count(F.lit(1)).alias("_n")).select(
        "file", "_split", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(W.partitionBy("file", "_split").orderBy("_row"))
    return lines.withColumn("_own", own).join(counts, ["file", "_split"]).select(*ids, "payload", "file", (F.col("_own") + F.col("_before")).alias("line"))


def _items(payloads: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per payload item with ``fields`` (NULL when not an object) and shape problems."""
    data = F.from_json("payload", "data ARRAY<STRING>")["data"]
    rows = payloads.select(*keep, "payload", data.alias("_data"))
    items = rows.select(
        *keep, F.col("_data").isNull().alias("_no_list"), F.col("payload"),
        F.posexplode_outer("_data").alias("_at", "_item"),
    ).filter(F.col("_no_list") | F.col("_at").isNotNull())
    parsed = F.from_json(F.col("_item"), "MAP<STRING,STRING>")
    is_object = F.ltrim(F.col("_item")).startswith("{")
    return items.select(
        *keep, F.coalesce("_item", "payload").alias("raw"), F.col("_no_list"),
        F.when(is_object, parsed).alias("fields"),
    )


def _number(name: str) -> Column:
    text = F.trim(F.col("fields")[name])
    flag = F.when(text == "true", 1.0).when(text == "false", 0.0)
    return F.coalesce(text.try_cast("double"), flag)


def _epoch_millis(text: Column) -> Column:
    whole = F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"))
    # Instants outside years 1..9999 are no timestamps.
    return F.when(whole.between(-62135596800000, 253402300799999), F.timestamp_millis(whole))


def _checked(items: DataFrame, required: Sequence[str]) -> DataFrame:
    """Add the parsed numbers, the timestamp and the first shape problem, if any."""
    numbers = [n for n in required if n != "time"]
    missing = F.filter(F.array(*[F.lit(n) for n in required]), lambda n: ~F.map_contains_key(F.col("fields"), n))
    textual = F.array_compact(F.array(*[F.when(F.col(f"_n_{n}").isNull(), n) for n in numbers]))
    rows = items.withColumns({f"_n_{n}": _number(n) for n in numbers}).withColumn(
        "timestamp", _epoch_millis(F.trim(F.col("fields")["time"]))
    )
    reason = (
        F.when(F.col("_no_list"), "payload has no list of data")
        .when(F.col("fields").isNull(), "item is not an object")
        .when(F.size(missing) > 0, F.concat(F.lit("missing field: "), F.array_join(missing, ",")))
        .when(F.size(textual) > 0, F.concat(F.lit("not a number: "), F.array_join(textual, ",")))
        .when(F.col("timestamp").isNull(), "not an epoch in milliseconds: time")
    )
    return rows.withColumn("_reason", reason)


def failed_rules(kind: str) -> Column:
    """Names of the canonical rules a record breaks (empty array = valid)."""
    def bad(name: str, holds: Column) -> Column:
        return F.when(~F.coalesce(holds, F.lit(False)), name)

    def at_least_zero(c: str) -> Column:
        return bad(f"{c} below zero", ~F.isnan(c) & (F.col(c) >= 0))

    checks = [
        bad("exchange empty", identifier("exchange").isNotNull()),
        bad("symbol empty", identifier("symbol").isNotNull()),
        bad("timestamp missing", F.col("timestamp").isNotNull()),
    ]
    if kind == "candle":
        prices = ["open", "high", "low", "close"]
        checks += [at_least_zero(c) for c in [*prices, "volume"]]
        checks += [
            bad("high not the maximum", F.col("high") == F.greatest(*prices)),
            bad("low not the minimum", F.col("low") == F.least(*prices)),
        ]
    elif kind == "funding_rate":
        checks.append(bad("funding_rate missing", F.col("funding_rate").isNotNull()))
    elif kind == "open_interest":
        usd = F.col("open_interest_value_usd")
        checks += [at_least_zero("open_interest"),
                   bad("open_interest_value_usd below zero", usd.isNull() | (~F.isnan(usd) & (usd >= 0)))]
    elif kind == "liquidation":
        checks += [at_least_zero("long_liquidation_usd"), at_least_zero("short_liquidation_usd")]
    elif kind == "long_short_ratio":
        long, short = F.col("long_account_ratio"), F.col("short_account_ratio")
        checks += [bad("long_account_ratio outside 0..1", long.between(0, 1)),
                   bad("short_account_ratio outside 0..1", short.between(0, 1)),
                   bad("ratios do not sum to one", (long + short).between(0.98, 1.02))]
    return F.array_compact(F.array(*checks))


def split_valid(df: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Canonical rows with normalised identifiers, and quarantined rows with the rules they break."""
    judged = df.withColumn("failed", failed_rules(kind))
    columns = [f.name for f in RECORD_TYPES[kind]]
    good = judged.filter(F.size("failed") == 0).withColumns(
        {"exchange": identifier("exchange"), "symbol": identifier("symbol")}
    )
    return good.select(*columns), judged.filter(F.size("failed") > 0)


def _map(payloads: DataFrame, kind: str, required: Sequence[str], columns: dict[str, Column],
         source_label: str | None, mode: str) -> tuple[DataFrame, DataFrame]:
    if source_label is not None:
        payloads = payloads.withColumn("exchange", F.lit(source_label))
    id_columns = [c for c in ("exchange", "symbol", "timeframe", *PROVENANCE) if c in payloads.columns]
    rows = _checked(_items(payloads, id_columns), required).withColumns(columns)
    rule = failed_rules(kind)
    reason = F.coalesce(F.col("_reason"), F.when(F.size(rule) > 0, F.concat(F.lit("rule: "), F.array_join(rule, ","))))
    judged = rows.withColumn("reason", reason)
    if mode == "failfast":
        stop = F.when(F.col("reason").isNotNull(), F.raise_error(F.concat(F.col("reason"), F.lit(" in "), F.col("raw"))).cast("string"))
        judged = judged.withColumn("reason", stop)
    good = judged.filter("reason IS NULL").withColumns(
        {"exchange": identifier("exchange"), "symbol": identifier("symbol")}
    )
    return (
        good.select(*[f.name for f in RECORD_TYPES[kind]], *[c for c in PROVENANCE if c in id_columns]),
        judged.filter("reason IS NOT NULL").select(*id_columns, "raw", "reason"),
    )


def map_candles(payloads: DataFrame, source_label: str | None = None, mode: str = "split"):
    prices = {c: F.col(f"_n_{c}") for c in ("open", "high", "low", "close")}
    return _map(payloads, "candle", ["time", *FIELDS["candle"]], {**prices, "volume": F.col("_n_volume_usd")},
                source_label, mode)


def map_funding_rates(payloads: DataFrame, source_label: str | None = None, mode: str = "split"):
    """The bar close is the rate; ``source_label="AGGREGATED"`` for the OI-weighted source."""
    return _map(payloads, "funding_rate", ["time", "close"], {"funding_rate": F.col("_n_close")}, source_label, mode)


def map_open_interest(payloads: DataFrame, source_label: str | None = None, mode: str = "split"):
    """The USD close fills both value columns."""
    value = F.col("_n_close")
    return _map(payloads, "open_interest", ["time", "close"],
                {"open_interest": value, "open_interest_value_usd": value}, source_label, mode)


def map_liquidations(payloads: DataFrame, source_label: str | None = None, mode: str = "split"):
    columns = {c: F.col(f"_n_{c}") for c in FIELDS["liquidation"]}
    return _map(payloads, "liquidation", ["time", *FIELDS["liquidation"]], columns, source_label, mode)


def map_long_short_ratios(payloads: DataFrame, long_field: str, short_field: str,
                          source_label: str | None = None, mode: str = "split"):
    """Percentages (sum above 1.5) are scaled to shares."""
    long, short = F.col(f"_n_{long_field}"), F.col(f"_n_{short_field}")
    percent = long + short > 1.5
    return _map(
        payloads, "long_short_ratio", ["time", long_field, short_field],
        {"long_account_ratio": F.when(percent, long / 100).otherwise(long),
         "short_account_ratio": F.when(percent, short / 100).otherwise(short)},
        source_label, mode,
    )


def map_supported_markets(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """{exchange: [pair, ...]} to one row per tradable instrument."""
    by_exchange = F.from_json("payload", "data MAP<STRING,STRING>")["data"]
    rows = payloads.select("payload", by_exchange.alias("_data"))
    no_map = rows.filter(F.col("_data").isNull()).select(
        F.lit(None).cast("string").alias("exchange"), F.col("payload").alias("raw"),
        F.lit("payload has no map of data").alias("reason"))
    listed = rows.select(F.explode("_data").alias("exchange", "_list")).withColumn(
        "_pairs", F.when(F.ltrim("_list").startswith("["), F.from_json("_list", "ARRAY<STRING>")))
    no_list = listed.filter("_pairs IS NULL").select(
        "exchange", F.col("_list").alias("raw"), F.lit("exchange has no list of pairs").alias("reason"))
    pairs = listed.select("exchange", F.explode("_pairs").alias("raw")).withColumn(
        "_f", F.when(F.ltrim("raw").startswith("{"), F.from_json("raw", "MAP<STRING,STRING>")))
    names = ["instrument_id", "base_asset", "quote_asset"]
    reason = F.when(F.col("_f").isNull(), "pair is not an object")
    for n in names:
        reason = reason.when(identifier(F.col("_f")[n]).isNull(), f"missing field: {n}")
    reason = reason.when(identifier("exchange").isNull(), "exchange empty")
    judged = pairs.withColumn("reason", reason)
    good = judged.filter("reason IS NULL").select(
        identifier("exchange").alias("exchange"), *[identifier(F.col("_f")[n]).alias(n) for n in names])
    bad = judged.filter("reason IS NOT NULL").select("exchange", "raw", "reason")
    return good.select(*[f.name for f in SUPPORTED_MARKET]), bad.unionByName(no_list).unionByName(no_map)
