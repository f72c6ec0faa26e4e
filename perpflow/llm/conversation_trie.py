"""Prefix trie of conversations with subtree totals, rolled up in bands of depth.

A conversation of n turns passes n + 1 nodes, from the textless root down: a node is a distinct sequence
of first turns, its members are the conversations that start with it, and it is named by its
smallest member and its depth.

* **Prefix identities**: each turn has two 64-bit hashes of (position, role, text); a prefix is the xor of those of
  its turns. Xor is associative, so long conversations are cut into chunks of ``CHUNK`` turns whose
  totals are carried over; no task holds a whole conversation.
* **Rollup**: in bands of ``HEIGHT`` depths every node adds itself to its ancestors of the same band (``HEIGHT`` of them at
  most). The tops of bands form a trie that is ``HEIGHT`` times less deep and is rolled up the same way,
  until it has one band; then each band top's whole total goes to its ancestors in the band above. A trie of
  depth d takes log(d) / log(HEIGHT) rounds each way and never explodes a node more than ``HEIGHT`` times a round.
* **Digests of members** stream through one hash in the order of their ids, a few bytes at a time; nothing
  is gathered.

Cases: null role or text is empty; turns with one number are ordered by role, then text; a null turn comes first; repeated rows are
repeated turns; rows with a null conv_id belong to no conversation and are left out; a conversation without turns is a
member of the root; an empty table gives no nodes; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from perpflow.llm.ranks import ranked
from perpflow.session import cut_lineage

HEIGHT = 16
CHUNK = 256


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, role, text)."""
    known = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    placed = ranked(known, ["conv_id"], ["turn", "role", "text"], "pos")
    return placed.select("conv_id", (F.col("pos") + 1).alias("pos"), "role", "text")


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of conversations whose first h come from conversation c - c % 5; and (conv_id, n) of all, also turnless ones.

    h is crc32(c) % 9, so each conversation lends its first eight turns to five others (nine round zero) at most.
    """
    lengths = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    plan = lengths.select(
        "conv_id", "own", (F.crc32(F.col("conv_id").cast("string")) % 9).alias("h"), (F.col("conv_id") - F.col("conv_id") % 5).alias("base"))
    plan = plan.join(lengths.select(F.col("conv_id").alias("base"), F.col("own").alias("there")), "base", "left").select(
        "conv_id", "own", "h", "base", F.least("h", F.coalesce("there", F.lit(0))).alias("lent"))
    plan = cut_lineage(plan)
    early = turns.where("pos <= 8").withColumnRenamed("conv_id", "base")
    lent = plan.select("conv_id", "base", "lent").join(early, "base").where("pos <= lent").select("conv_id", "pos", "role", "text")
    own = turns.join(plan.select("conv_id", "h", "lent"), "conv_id").where("pos > h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("lent")).alias("pos"), "role", "text")
    sizes = plan.select("conv_id", (F.col("lent") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n"))
    return lent.union(own), sizes


def _prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, a, b, bytes): two hashes of the first ``depth`` turns, bytes of the last one's text."""
    hashed = turns.select(
        "conv_id", F.col("pos").alias("depth"), F.octet_length("text").cast("long").alias("bytes"),
        F.xxhash64(F.lit(1), "pos", "role", "text").alias("a"), F.xxhash64(F.lit("second"), "text", "role", "pos").alias("b"))
    hashed = hashed.withColumn("chunk", F.floor((F.col("depth") - 1) / CHUNK))
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = hashed.groupBy("conv_id", "chunk").agg(F.bit_xor("a").alias("ca"), F.bit_xor("b").alias("cb")).select(
        "conv_id", "chunk", *(F.coalesce(F.bit_xor(f"c{x}").over(earlier), F.lit(0)).alias(f"c{x}") for x in "ab"))
    inside = Window.partitionBy("conv_id", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    running = hashed.select("conv_id", "chunk", "depth", "bytes", *(F.bit_xor(x).over(inside).alias(x) for x in "ab"))
    return running.join(carried, ["conv_id", "chunk"]).select(
        "conv_id", "depth", F.col("a").bitwiseXOR(F.col("ca")).alias("a"), F.col("b").bitwiseXOR(F.col("cb")).alias("b"), "bytes")


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node and id: one digest a node, over its ids joined by commas."""
    node, digest = None, None
    for batch in batches:
        out = []
        for rep, depth, conv in zip(*(batch.column(c).to_pylist() for c in ("rep", "depth", "conv_id")), strict=True):
            if (rep, depth) == node:
                digest.update(f",{conv}".encode())
                continue
            if node is not None:
                out.append((*node, digest.hexdigest()))
            node, digest = (rep, depth), hashlib.sha256(str(conv).encode())
        yield _rows(out)
    if node is not None:
        yield _rows([(*node, digest.hexdigest())])


def _rows(out: list[tuple[int, int, str]]) -> pa.RecordBatch:
    reps, depths, digests = zip(*out, strict=True) if out else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(reps, pa.int64()), pa.array(depths, pa.int64()), pa.array(digests, pa.string())], ["rep", "depth", "ends_sha256"])


def _bands(lines: DataFrame) -> DataFrame:
    """(conv_id, band, steps): what a conversation passes in one band of depths, HEIGHT nodes at most, in order."""
    return lines.groupBy("conv_id", F.floor(F.col("depth") / HEIGHT).alias("band")).agg(
        F.array_sort(F.collect_list(F.struct("depth", "rep"))).alias("steps"))


def subtree_sums(lines: DataFrame, values: DataFrame, names: list[str], deepest: int) -> DataFrame:
    """(rep, depth, names): sums of ``values`` (rep, depth, names) over each node and all below it.

    ``lines`` (conv_id, depth, rep) has the nodes that each conversation passes; ``rep`` is a member of its node, so the
    ancestors of (rep, depth) are those that conversation ``rep`` passes.
    """
    sums = [F.sum(c).alias(c) for c in names]
    bands = cut_lineage(_bands(lines))
    placed = values.select(F.col("rep").alias("conv_id"), F.col("depth").alias("at"), F.floor(F.col("depth") / HEIGHT).alias("band"), *names)

    def lifted(rows: DataFrame) -> DataFrame:
        up = rows.join(bands, ["conv_id", "band"]).select(F.explode(F.expr("filter(steps, s -> s.depth <= at)")).alias("s"), *names)
        return up.groupBy(F.col("s.rep").alias("rep"), F.col("s.depth").alias("depth")).agg(*sums)

    inside = lifted(placed)
    if deepest < HEIGHT:
        return inside
    inside = cut_lineage(inside)
    top = F.col("depth") % HEIGHT == 0
    shrunk = (F.col("depth") / HEIGHT).cast("long").alias("depth")
    whole = subtree_sums(
        lines.where(top).select("conv_id", shrunk, "rep"), inside.where(top).select("rep", shrunk, *names), names, deepest // HEIGHT)
    whole = cut_lineage(whole)
    handed = whole.where("depth > 0").select(
        F.col("rep").alias("conv_id"), (F.col("depth") * HEIGHT).alias("at"), (F.col("depth") - 1).alias("band"), *names)
    below = lifted(handed)
    return inside.union(below.select("rep", "depth", *names)).groupBy("rep", "depth").agg(*sums)


def prefix_trie(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """The nodes of the trie over ``turns`` (conv_id, pos, role, text) of the conversations in ``sizes`` (conv_id, n)."""
    sizes = cut_lineage(sizes)
    first = sizes.agg(F.min("conv_id"), F.max("n")).first()
    if first[0] is None:
        deepest, root = 0, F.lit(None).cast("long")
    else:
        deepest, root = first[1], F.lit(first[0]).cast("long")
    prefixes = cut_lineage(_prefixes(turns))
    identity = ["depth", "a", "b"]
    named = prefixes.groupBy(*identity).agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("n_convs"), F.min("bytes").alias("bytes"))
    below = prefixes.drop("bytes").join(named, identity).select("conv_id", "depth", "rep", "n_convs", "bytes")
    roots = sizes.select("conv_id", F.lit(0).cast("long").alias("depth"), root.alias("rep"))
    lines = cut_lineage(below.select("conv_id", "depth", "rep").union(roots))
    every = sizes.agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(
        root.alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.col("n").alias("n_convs"), F.lit(0).cast("long").alias("bytes"))
    nodes = cut_lineage(below.where("conv_id = rep").select("conv_id", "depth", "n_convs", "bytes").union(every))

    parents = nodes.where("depth > 0").select("conv_id", "depth").join(
        lines.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("rep").alias("parent_conv_id")), ["conv_id", "depth"])
    parents = cut_lineage(parents)
    children = parents.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    grown = cut_lineage(
        nodes.join(parents, ["conv_id", "depth"], "left").join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    values = grown.select(
        F.col("conv_id").alias("rep"), "depth", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    totals = subtree_sums(lines, values, ["n_leaves", "saved_tokens"], deepest).select(F.col("rep").alias("conv_id"), "depth", "n_leaves", "saved_tokens")

    ends = lines.join(sizes.select("conv_id", F.col("n").alias("depth")), ["conv_id", "depth"])
    ends = ends.repartition("rep", "depth").sortWithinPartitions("rep", "depth", "conv_id").select("rep", "depth", "conv_id")
    ends = ends.mapInArrow(_streamed, "rep long, depth long, ends_sha256 string").withColumnRenamed("rep", "conv_id")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return grown.join(totals, ["conv_id", "depth"]).join(ends, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all rebuilt conversations."""
    turns, sizes = rebuilt_turns(ordered_turns(conversations))
    return prefix_trie(turns, sizes)
