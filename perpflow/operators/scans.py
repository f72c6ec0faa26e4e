"""Prefix composition of affine maps over long ordered series, in three bounded levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Maps that one row gathers; three levels cover 256 * 256 * (as many as a row holds) maps of one key.
BLOCK = 256


def _composed(kind: str) -> Column:
    """Over sorted ``_maps`` of (i, a, b): the map before each, and the map of all."""
    item = f"struct<i: bigint, a: {kind}, b: {kind}>"
    zero = F.struct(F.lit(1).cast(kind).alias("a"), F.lit(0).cast(kind).alias("b"), F.array().cast(f"array<{item}>").alias("before"))

    def step(acc: Column, m: Column) -> Column:
        here = F.struct(m["i"].alias("i"), acc["a"].alias("a"), acc["b"].alias("b"))
        return F.struct(
            (acc["a"] * m["a"]).alias("a"), (acc["b"] * m["a"] + m["b"]).alias("b"), F.concat(acc["before"], F.array(here)).alias("before"))

    return F.aggregate("_maps", zero, step)


def _fold(rows: DataFrame, group: Sequence[str], index: str, a: str, b: str, kind: str) -> DataFrame:
    maps = F.array_sort(F.collect_list(F.struct(F.col(index).cast("bigint").alias("i"), F.col(a).alias("a"), F.col(b).alias("b"))))
    return rows.groupBy(*group).agg(maps.alias("_maps")).withColumn("_m", _composed(kind))


def carry_affine(rows: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str], a: str, b: str, name: str, kind: str = "double") -> DataFrame:
    """``rows`` with ``name``, the value before each under x -> a*x + b, starting from 0 for every key.

    Rows are numbered inside their chunk and folded in blocks; blocks are numbered along the key and
    folded in blocks again. Windows over a whole key only see one row for each block.
    """
    one = [*keys, chunk]
    numbered = rows.withColumn("_i", F.row_number().over(W.partitionBy(*one).orderBy(*order)) - 1)
    numbered = numbered.withColumn("_g", F.floor(F.col("_i") / BLOCK))
    low = _fold(numbered, [*one, "_g"], "_i", a, b, kind).withColumn(
        "_j", F.row_number().over(W.partitionBy(*keys).orderBy(chunk, "_g")) - 1)
    low = low.withColumns({"_h": F.floor(F.col("_j") / BLOCK), "_a": F.col("_m.a"), "_b": F.col("_m.b")})
    mid = _fold(low, [*keys, "_h"], "_j", "_a", "_b", kind)
    top = _fold(mid.withColumns({"_a": F.col("_m.a"), "_b": F.col("_m.b")}), keys, "_h", "_a", "_b", kind)
    starts = top.select(*keys, F.explode("_m.before").alias("s")).select(*keys, F.col("s.i").alias("_h"), F.col("s.b").alias("_start"))
    blocks = (
        mid.select(*keys, "_h", F.explode("_m.before").alias("s")).join(starts, [*keys, "_h"])
        .select(*keys, F.col("s.i").alias("_j"), (F.col("s.a") * F.col("_start") + F.col("s.b")).alias("_start")))
    values = (
        low.join(blocks, [*keys, "_j"]).select(*one, "_start", F.explode("_m.before").alias("s"))
        .select(*one, F.col("s.i").alias("_i"), (F.col("s.a") * F.col("_start") + F.col("s.b")).alias(name)))
    return numbered.join(values, [*one, "_i"]).drop("_i", "_g")
