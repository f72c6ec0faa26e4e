"""Benchmark passages in documents: SimHash of item-sized windows, Hamming blocks, exact similarity.

An item and a document match where a window of as many words as the item has is similar to it:
the Dice similarity of their shingles, weighted by how often each occurs, is ``SIMILARITY`` or
more. DataFrame operations only:

1. words of a document become hashes of ``SHINGLE`` words; those that no item has are gone after one
   join. A window without a shingle of an item has similarity 0, so nothing is lost;
2. windows of every item length around the hits get a 64-bit SimHash, each bit the majority of its weighted shingles;
3. the 64 bits are cut into ``RADIUS`` + 1 blocks. Fingerprints within ``RADIUS`` bits agree in a whole block,
   so an equi-join on (length, block, bits) meets every pair within the radius;
4. pairs within the radius are verified on the shingles themselves.

A pair at similarity 0.8 differs in 13 of 64 bits on average (3 standard); the radius of 22 lies three deviations out.

Only hits, windows around them and their fingerprints are shuffled, besides one shuffle of the texts to
those that have hits. The table of item shingles is small here, but nothing depends on it: Spark's size check decides.

Cases: null text is empty and has no words; an item without words matches nothing; an item under five words is
one shingle of all of them, and windows have that many words; a document shorter than an item is one
window; repeated rows give one result row for each distinct (doc_id, item_id); rows that repeat an
item_id are items of their own whose best match is kept; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from perpflow.llm.text import steady
from perpflow.session import cut_lineage

SHINGLE = 5
RADIUS = 22
SIMILARITY = 0.8
_EVERY_16TH = 0x0001000100010001


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingles(size: int) -> Column:
    """Hashes of all runs of ``size`` words in the column ``words``."""
    parts = ", ".join(["w", *(f"get(words, i + {k})" for k in range(1, size))])
    return F.expr(f"slice(transform(words, (w, i) -> xxhash64({parts})), 1, greatest(size(words) - {size - 1}, 0))")


def _weighted(hashes: str) -> Column:
    """The same hashes with later occurrences told apart, so that a set intersection counts weights."""
    return F.expr(
        f"CASE WHEN size(array_distinct({hashes})) = size({hashes}) THEN {hashes} ELSE "
        f"transform({hashes}, (h, i) -> CASE WHEN array_position({hashes}, h) = i + 1 THEN h "
        f"ELSE xxhash64(h, size(filter(slice({hashes}, 1, i + 1), x -> x = h))) END) END")


def _counts(hashes: str) -> Column:
    """How many hashes have each bit set; four counters of 16 bits share a long."""
    zero = ", ".join(f"'c{i}', 0L" for i in range(16))
    add = ", ".join(f"'c{i}', a.c{i} + (shiftrightunsigned(h, {i}) & {_EVERY_16TH}L)" for i in range(16))
    return F.expr(f"aggregate({hashes}, named_struct({zero}), (a, h) -> named_struct({add}))")


def _bits(count: str, size: str) -> Column:
    terms = [
        f"(CASE WHEN 2 * (shiftrightunsigned({count}.c{i}, {16 * j}) & 65535L) > {size} THEN shiftleft(1L, {i + 16 * j}) ELSE 0L END)"
        for i in range(16) for j in range(4)]
    return F.expr(" | ".join(terms))


def with_simhash(rows: DataFrame, hashes: str, name: str) -> DataFrame:
    """Adds the SimHash of an array column of at most 32,767 hashes."""
    return rows.withColumn("_counts", _counts(hashes)).withColumn(name, _bits("_counts", f"size({hashes})")).drop("_counts")


def blocks(fingerprint: str, radius: int) -> Column:
    """(number, bits) of radius + 1 blocks that cover the 64 bits."""
    n = radius + 1
    cuts = [64 * i // n for i in range(n + 1)]
    parts = [
        f"named_struct('block', {i}, 'bits', shiftrightunsigned({fingerprint}, {a}) & {(1 << (b - a)) - 1}L)" for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    return F.expr(f"array({', '.join(parts)})")


def _items(benchmark: DataFrame) -> DataFrame:
    split = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("words")).where("size(words) > 0")
    form = F.lit(None).cast("array<bigint>")
    for size in range(1, SHINGLE + 1):
        mine = F.size("words") == size if size < SHINGLE else F.size("words") >= SHINGLE
        form = F.when(mine, shingles(size)).otherwise(form)
    hashed = split.select("item_id", F.size("words").alias("length"), F.least(F.size("words"), F.lit(SHINGLE)).alias("k"), form.alias("hashes"))
    return with_simhash(hashed, "hashes", "fingerprint").withColumn("weighted", _weighted("hashes"))


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(doc_id, digest, item_id, similarity, distance, first_word): the best window of each document for each item it holds."""
    steady(docs.sparkSession)
    items = cut_lineage(_items(benchmark))
    sizes = [r.k for r in items.select("k").distinct().collect()]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    split = texts.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"), words(F.col("text")).alias("words"))
    known = items.select("k", F.col("length"), F.explode("hashes").alias("hash")).distinct()
    none = "array<struct<k: int, hashes: array<bigint>>>"
    each = F.array(*(F.struct(F.lit(k).alias("k"), shingles(k).alias("hashes")) for k in sizes)).cast(none) if sizes else F.array().cast(none)
    at = (
        split.select("doc_id", "digest", F.explode(each).alias("s")).select("doc_id", "digest", "s.k", F.posexplode("s.hashes").alias("at", "hash")))
    # Starts of all windows that hold the shingle, for every length of an item that has it.
    hits = (
        at.join(known, ["k", "hash"]).groupBy("doc_id", "digest", "k", "length").agg(F.collect_set("at").alias("at")))
    same = (F.col("d.digest") == F.col("h.digest")) & F.col("d.doc_id").eqNullSafe(F.col("h.doc_id"))
    found = split.alias("d").join(hits.alias("h"), same).select("d.doc_id", "d.digest", "d.words", "h.k", "h.length", "h.at")
    starts = F.expr(
        "array_distinct(flatten(transform(at, p -> sequence(greatest(p - (length - k), 0), greatest(least(p, size(words) - length), 0)))))")
    windows = found.withColumn("start", F.explode(starts)).select(
        "doc_id", "digest", "k", "length", "start", F.expr("slice(words, start + 1, length)").alias("words"))
    form = F.lit(None).cast("array<bigint>")
    for size in sizes:
        form = F.when(F.col("k") == size, shingles(size)).otherwise(form)
    hashed = windows.select("doc_id", "digest", "k", "length", "start", form.alias("hashes")).where("size(hashes) > 0")
    marked = with_simhash(hashed.dropDuplicates(["doc_id", "digest", "length", "start"]), "hashes", "fingerprint")
    marked = cut_lineage(marked)
    left = marked.select("*", F.explode(blocks("fingerprint", radius)).alias("b")).select("*", "b.block", "b.bits").drop("b")
    right = items.select(
        "item_id", "length", F.col("fingerprint").alias("item_fingerprint"), "weighted", F.explode(blocks("fingerprint", radius)).alias("b")
    ).select("item_id", "length", "item_fingerprint", "weighted", "b.block", "b.bits")
    distance = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_fingerprint")))
    near = left.join(right, ["length", "block", "bits"]).where(distance <= radius)
    # A pair meets in several blocks; only the first that agrees goes on.
    agreeing = F.array_min(F.transform(
        F.filter(F.arrays_zip(blocks("fingerprint", radius).alias("x"), blocks("item_fingerprint", radius).alias("y")), lambda p: p["x"] == p["y"]),
        lambda p: p["x"]["block"]))
    checked = near.where(F.col("block") == agreeing).select(
        "doc_id", "digest", "item_id", "start", distance.alias("distance"), _weighted("hashes").alias("mine"), "weighted")
    dice = 2 * F.size(F.array_intersect("mine", "weighted")) / (F.size("mine") + F.size("weighted"))
    best = F.max(F.struct(F.col("similarity"), -F.col("distance"), -F.col("start")))
    return (
        checked.select("doc_id", "digest", "item_id", "start", "distance", dice.alias("similarity")).where(F.col("similarity") >= similarity)
        .groupBy("doc_id", "digest", "item_id").agg(best.alias("best"))
        .select("doc_id", "digest", "item_id", "best.similarity", (-F.col("best.col2")).alias("distance"), (-F.col("best.col3")).alias("first_word")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without a benchmark passage, with all their columns."""
    found = contaminated(docs, benchmark, **options).select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(found["_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == found["_digest"])
    return docs.join(found, same, "left_anti")
