"""Bringing a series store up to date: only what is missing is taken from landed records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from perpflow.operators.chunks import Grid
from perpflow.operators.gaps import find_gaps, rows_for_gaps
from perpflow.session import cut_lineage, drop_written
from perpflow.sources.store import SeriesStore


@dataclass(frozen=True)
class SyncReport:
    """``added``: rows written per series; ``remaining``: gaps that landed records did not close."""

    added: DataFrame
    remaining: DataFrame


def series_keys(kind: str) -> list[str]:
    return ["exchange", "symbol", *(["timeframe"] if kind == "candle" else [])]


def sync_store(store: SeriesStore, kind: str, landed: DataFrame, ranges: DataFrame, grid: Grid, seq: str = "ingest_seq") -> SyncReport:
    """Fill the gaps of one record kind in a store, over any number of series at once.

    ``ranges`` (keys, range_start, range_end) says what ought to be there, series that the store does not know included. The
    store is read between the first start and the last end only. Stored rows stay as they are; landed rows
    enter where a grid point is missing and are written in one upsert. A second run with the same records adds nothing.
    """
    keys = series_keys(kind)
    upper = {k: F.upper(k) for k in ("exchange", "symbol")}
    wanted, landed = cut_lineage(ranges.withColumns(upper)), landed.withColumns(upper)
    edge = wanted.agg(F.min("range_start").alias("first"), F.max("range_end").alias("last")).first()
    within = lambda: store.read(kind, start=edge["first"], end=edge["last"])
    usable = cut_lineage(rows_for_gaps(within(), landed, wanted, keys, grid))
    added = cut_lineage(usable.groupBy(*keys).agg(F.countDistinct("timestamp").alias("rows"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last")))
    store.write(kind, usable, seq)
    drop_written(usable)
    return SyncReport(added, find_gaps(within(), wanted, keys, grid))
