"""Parquet stores: canonical series and long features, both with last-wins upserts.

A table is partitioned by its series columns and by ``period`` (calendar month), so an upsert
reads and rewrites only the months a batch touches and no series is ever one file or one
task. Writes use dynamic partition overwrite: output is staged and swapped in when the job
commits.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from perpflow.operators.dedupe import merge_last_wins
from perpflow.schema import FEATURE_VALUE, FEATURE_VERSION, RECORD_TYPES
from perpflow.session import cut_lineage, drop_written, use_utc


def _period(column: str = "timestamp") -> Column:
    return F.date_format(F.col(column), "yyyy-MM")


def _months(start: datetime | None, end: datetime | None) -> Column:
    """A partition filter on ``period``; months compare correctly as text."""
    keep = F.lit(True)
    if start is not None:
        keep = keep & (F.col("period") >= F.date_format(F.lit(start), "yyyy-MM"))
    if end is not None:
        keep = keep & (F.col("period") <= F.date_format(F.lit(end), "yyyy-MM"))
    return keep


class _Table:
    """One partitioned Parquet table."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, partitions: Sequence[str],
                 key: Sequence[str], upgrade: Callable[[DataFrame], DataFrame] | None = None) -> None:
        self.spark, self.path = use_utc(spark), path
        self.partitions = [*partitions, "period"]
        self.key = [*self.partitions, *[k for k in key if k not in self.partitions]]
        self.schema = T.StructType([*schema.fields, T.StructField("period", T.StringType())])
        self.upgrade = upgrade or (lambda df: df)

    def exists(self) -> bool:
        jvm = self.spark.sparkContext._jvm
        location = jvm.org.apache.hadoop.fs.Path(self.path)
        return location.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(location)

    def load(self) -> DataFrame:
        """All rows; files that lack a column (older layouts) read it as NULL."""
        if not self.exists():
            return self.spark.createDataFrame([], self.schema)
        return self.upgrade(self.spark.read.schema(self.schema).parquet(self.path))

    def upsert(self, batch: DataFrame, seq: str) -> None:
        # Written once: the edges, the partitions and the merge read it, whatever the batch costs to make.
        touched = cut_lineage(batch.withColumn("period", _period()))
        # First and last value of each partition column, one row, prune the read; the join does the rest.
        edges = touched.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in self.partitions for f in (F.min, F.max)]).first()
        stored = self.load()
        for c in self.partitions:
            low, high = edges[f"min_{c}"], edges[f"max_{c}"]
            stored = stored.filter(F.lit(False) if low is None else F.col(c).between(low, high))
        stored = stored.join(touched.select(*self.partitions).distinct(), self.partitions, "left_semi")
        merged = merge_last_wins(stored.select(*self.schema.names), touched, self.key, seq)
        # Rebalance groups a partition's rows for writing and splits partitions that are too big.
        (
            merged.hint("rebalance", *self.partitions)
            .sortWithinPartitions(*self.partitions, "timestamp")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*self.partitions)
            .parquet(self.path)
        )
        drop_written(touched)


class SeriesStore:
    """Canonical series by record type: ``root/<type>/exchange=/symbol=[/timeframe=]/period=``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def _table(self, kind: str) -> _Table:
        parts = ["exchange", "symbol", *(["timeframe"] if kind == "candle" else [])]
        return _Table(self.spark, f"{self.root}/{kind}", RECORD_TYPES[kind], parts, [*parts, "timestamp"])

    def write(self, kind: str, batch: DataFrame, seq: str = "ingest_seq") -> None:
        """Merge a batch: per series and timestamp the last given record stays."""
        normal = batch.withColumns({"exchange": F.upper("exchange"), "symbol": F.upper("symbol")})
        self._table(kind).upsert(normal, seq)

    def read(self, kind: str, *, exchange: str | None = None, symbol: str | None = None, timeframe: str | None = None,
             start: datetime | None = None, end: datetime | None = None) -> DataFrame:
        """Rows in [start, end], both ends included; a series that is not stored is empty."""
        df = self._table(kind).load().filter(_months(start, end))
        for column, value in (("exchange", exchange), ("symbol", symbol)):
            if value is not None:
                df = df.filter(F.col(column) == value.upper())
        if timeframe is not None and kind == "candle":
            df = df.filter(F.col("timeframe") == timeframe)
        return clip(df, start, end).drop("period")

    def covered(self, kind: str) -> DataFrame:
        """First and last timestamp of every stored series."""
        parts = ["exchange", "symbol", *(["timeframe"] if kind == "candle" else [])]
        return covered_range(self._table(kind).load(), parts)


def clip(df: DataFrame, start: datetime | None, end: datetime | None) -> DataFrame:
    if start is not None:
        df = df.filter(F.col("timestamp") >= F.lit(start))
    if end is not None:
        df = df.filter(F.col("timestamp") <= F.lit(end))
    return df


def history(df: DataFrame, now: datetime, step: timedelta, periods: int | None = None,
            start: datetime | None = None) -> DataFrame:
    """What was known at ``now``: from ``start`` (never after now), else ``periods`` steps back."""
    if start is None:
        start = now - step * periods if periods is not None else None
    return clip(df, None if start is None else min(start, now), now)


def covered_range(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.min("timestamp").alias("first_timestamp"), F.max("timestamp").alias("last_timestamp"))


def with_version(df: DataFrame) -> DataFrame:
    """Rows written before versions existed belong to the first version."""
    if "version" not in df.columns:
        return df.withColumn("version", F.lit(FEATURE_VERSION))
    return df.withColumn("version", F.coalesce("version", F.lit(FEATURE_VERSION)))


class FeatureStore:
    """Long features; versions of one feature live side by side."""

    KEY = ("symbol", "feature_name", "timestamp", "version")

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._table = _Table(spark, path, FEATURE_VALUE, ["feature_name", "symbol"], self.KEY, with_version)

    def write(self, values: DataFrame, seq: str = "ingest_seq") -> None:
        """Last value per (symbol, feature, timestamp, version) stays."""
        self._table.upsert(with_version(values).withColumn("symbol", F.upper("symbol")), seq)

    def read(self, *, symbol: str | None = None, feature_name: str | None = None, start: datetime | None = None,
             end: datetime | None = None, version: str | None = None) -> DataFrame:
        df = self._table.load().filter(_months(start, end))
        if symbol is not None:
            df = df.filter(F.col("symbol") == symbol.upper())
        if feature_name is not None:
            df = df.filter(F.col("feature_name") == feature_name)
        if version is not None:
            df = df.filter(F.col("version") == version)
        return clip(df, start, end).drop("period")


def chronological(df: DataFrame) -> DataFrame:
    """Scan order of several symbols: by time, ties by symbol name."""
    return df.orderBy("timestamp", "symbol")


# The value columns an analysis reads from each record type.
OBSERVED = {
    "funding_rate": ["funding_rate"],
    "open_interest": ["open_interest"],
    "candle": ["high", "low", "close"],
    "liquidation": ["long_liquidation_usd", "short_liquidation_usd"],
    "long_short_ratio": ["long_account_ratio", "short_account_ratio"],
    "price": ["close"],
}


def observations(records: DataFrame, kind: str) -> DataFrame:
    """Records as analysis input: keys, timestamp and the observed values."""
    keys = [c for c in ("exchange", "symbol", "timeframe") if c in records.columns]
    return records.select(*keys, "timestamp", *OBSERVED[kind])


def observations_from_features(features: DataFrame, names: dict[str, str]) -> DataFrame:
    """Long features back to wide observations: ``{feature_name: column}``, NULL where absent."""
    chosen = features.filter(F.col("feature_name").isin(*names))
    return chosen.groupBy("symbol", "timestamp", "version").agg(
        *[F.max(F.when(F.col("feature_name") == n, F.col("value"))).alias(c) for n, c in names.items()]
    )
