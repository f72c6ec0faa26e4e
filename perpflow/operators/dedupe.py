"""Last-wins upserts and latest rows, without a window over the key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


#: In place of a sequence column: every key has one row.
UNIQUE = "<unique>"


def last_wins(df: DataFrame, key: Sequence[str], seq: str | None, usable: Column | None = None) -> DataFrame:
    """One row per key: the usable one with the highest ``seq``.

    Copies are folded map-side first, so a key with very many copies costs one row per task.
    ``seq=UNIQUE`` declares the input unique already, and nothing is shuffled; without a ``seq`` the
    call is refused, since rows have no order of their own.
    """
    if seq is None:
        raise ValueError("name the column that orders copies of a key, or pass seq=UNIQUE")
    rows = df if usable is None else df.filter(usable)
    if seq == UNIQUE:
        return rows
    rest = [c for c in rows.columns if c not in key and c != seq]
    return rows.groupBy(*key).agg(*[F.max_by(c, seq).alias(c) for c in rest], F.max(seq).alias(seq)).select(*rows.columns)


def merge_last_wins(stored: DataFrame, batch: DataFrame, key: Sequence[str], seq: str = "ingest_seq") -> DataFrame:
    """Stored rows and a new batch as one series; the batch replaces stored rows of its keys.

    ``seq`` (not negative) orders copies inside the batch, since Spark rows have no order of
    their own. Readers sort; the merge does not.
    """
    columns = [c for c in stored.columns if c != seq]
    order = F.col(seq).cast("bigint") if seq in batch.columns else F.lit(0).cast("bigint")
    # One long as rank (stored rows below every batch row) keeps this a hash aggregate.
    old = stored.select(*columns, F.lit(-1).cast("bigint").alias("_rank"))
    new = batch.select(*columns, order.alias("_rank"))
    rest = [c for c in columns if c not in key]
    both = old.unionByName(new)
    return both.groupBy(*key).agg(*[F.max_by(c, "_rank").alias(c) for c in rest]).select(*columns)


def latest(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The newest row of every series as a plain aggregate."""
    rest = [c for c in df.columns if c not in keys and c != order]
    return df.groupBy(*keys).agg(F.max(order).alias(order), *[F.max_by(c, order).alias(c) for c in rest])


def flag_repeats(df: DataFrame, key: Sequence[str], arrival: str, flag: str = "is_duplicate") -> DataFrame:
    """Mark every row whose key has arrived before (null-safe on the key)."""
    first = df.groupBy(*key).agg(F.min(arrival).alias("_first"))
    names = {k: f"_k_{i}" for i, k in enumerate(key)}
    first = first.select("_first", *[F.col(k).alias(alias) for k, alias in names.items()])
    same = [F.col(k).eqNullSafe(F.col(alias)) for k, alias in names.items()]
    on = same[0]
    for condition in same[1:]:
        on = on & condition
    return df.join(first, on, "left").withColumn(flag, F.col(arrival) > F.col("_first")).drop("_first", *names.values())
