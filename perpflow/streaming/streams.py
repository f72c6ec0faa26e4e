"""Structured Streaming entry points: live candles into the store, checks on live signals.

Both run per micro-batch (``foreachBatch``) on the batch operators, so a hot symbol is
chunked, not gathered into one state group. Every step is idempotent per batch id: a batch
replayed after a failure replaces its own output and ledger files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from perpflow.operators.chunks import Grid
from perpflow.operators.dedupe import flag_repeats
from perpflow.operators.gates import flag_out_of_order
from perpflow.sources.store import SeriesStore


def stream_into_store(stream: DataFrame, store: SeriesStore, checkpoint: str, kind: str = "candle",
                      seq: str = "ingest_seq", trigger: dict | None = None) -> StreamingQuery:
    """Merge a record stream into the series store; within and across batches the last record wins.

    Late records need no watermark: an upsert accepts any timestamp.
    """
    def merge(batch: DataFrame, _: int) -> None:
        store.write(kind, batch, seq)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class SignalLedger:
    """What earlier batches have shown: signal keys seen, and the latest as_of per symbol.

    ``seen`` has one folder per batch, partitioned by month of as_of; the first and last month of a
    batch prune the read. ``latest`` is one row per symbol, carried on from batch to batch.
    """

    KEY = ("symbol", "as_of", "score_version")

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.seen_schema = T.StructType([
            T.StructField("symbol", T.StringType()), T.StructField("as_of", T.TimestampType()),
            T.StructField("score_version", T.StringType()), T.StructField("batch", T.LongType()),
            T.StructField("period", T.StringType())])

    def _read(self, part: str, schema, batch: int) -> DataFrame:
        location = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        if not location.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(location):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{part}").filter(F.col("batch") < batch)

    def _folder(self, path: str):
        location = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return location.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), location

    def _batches(self) -> list[int]:
        fs, location = self._folder(f"{self.path}/latest")
        if not fs.exists(location):
            return []
        return sorted(int(s.getPath().getName().partition("=")[2]) for s in fs.listStatus(location))

    def _tops(self, batch: int) -> DataFrame:
        """Latest as_of of every symbol before a batch: the one folder of the batch before it."""
        known = [b for b in self._batches() if b < batch]
        if not known:
            return self.spark.createDataFrame([], "symbol string, latest timestamp")
        return self.spark.read.schema("symbol string, latest timestamp").parquet(f"{self.path}/latest/batch={known[-1]}")

    def _forget(self, before: int) -> None:
        """A batch may be replayed, so what it started from stays; anything older goes."""
        for b in self._batches():
            if b < before:
                fs, location = self._folder(f"{self.path}/latest/batch={b}")
                fs.delete(location, True)

    def flag(self, rows: DataFrame, batch: int, arrival: str, grid: Grid) -> DataFrame:
        """Add ``is_duplicate`` and ``is_out_of_order`` against this batch and all earlier ones."""
        period = F.date_format("as_of", "yyyy-MM")
        here = flag_out_of_order(flag_repeats(rows, list(self.KEY), arrival), arrival, grid).withColumn("period", period)
        edge = here.agg(F.min("period").alias("first"), F.max("period").alias("last")).first()
        seen = self._read("seen", self.seen_schema, batch).filter(F.col("period").between(edge["first"] or "", edge["last"] or "")).select(
            *self.KEY, F.lit(True).alias("_seen")).distinct()
        latest = self._tops(batch).withColumnRenamed("latest", "_latest")
        joined = here.join(seen, list(self.KEY), "left").join(latest, "symbol", "left")
        return joined.withColumns({
            "is_duplicate": F.col("is_duplicate") | F.coalesce("_seen", F.lit(False)),
            "is_out_of_order": F.col("is_out_of_order") | F.coalesce(F.col("as_of") <= F.col("_latest"), F.lit(False)),
        }).drop("_seen", "_latest", "period")

    def record(self, rows: DataFrame, batch: int) -> None:
        """Remember a batch; recording it again replaces it."""
        keys = rows.select(*self.KEY).distinct().withColumns(
            {"batch": F.lit(batch).cast("bigint"), "period": F.date_format("as_of", "yyyy-MM")})
        keys.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "period").parquet(f"{self.path}/seen")
        tops = rows.groupBy("symbol").agg(F.max("as_of").alias("latest"))
        both = tops.unionByName(self._tops(batch)).groupBy("symbol").agg(F.max("latest").alias("latest"))
        both.write.mode("overwrite").parquet(f"{self.path}/latest/batch={batch}")
        self._forget(batch - 1)


def flag_signal_stream(stream: DataFrame, ledger: SignalLedger, sink: Callable[[DataFrame, int], None], checkpoint: str,
                       arrival: str = "arrival", grid: Grid = Grid(1, 65536, 1), trigger: dict | None = None) -> StreamingQuery:
    """Flag repeated and out-of-order signals of a stream; ``sink(flagged, batch_id)`` stores them."""
    def check(batch: DataFrame, batch_id: int) -> None:
        sink(ledger.flag(batch, batch_id, arrival, grid), batch_id)
        ledger.record(batch, batch_id)

    return stream.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
