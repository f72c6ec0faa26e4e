"""Merkle manifest of a document table, and versions of it for altered leaves.

Each row is a leaf, each source a tree over its leaves in the order of doc_id, and one tree over the
subroots of all sources gives the root. Runs of ``ARITY`` neighbours become a parent, level by
level, until one node is left; the last run may be shorter.

Trees are built in aligned blocks of ``ARITY ** HEIGHT`` nodes: a block is one small row group whatever
the size of its source, and becomes one node of the next round, so a tree of n leaves takes
log(n) / (HEIGHT log(ARITY)) rounds. Above the leaves, each block keeps for every level what stands to the
left and right of the path to the top: that is all a version needs of the nodes it shares.

A version of the tree is made for each altered leaf by copying its path: inside its block the ancestors are
hashed anew next to the untouched siblings, then the copy goes on through the levels above, as
independent rows. Untouched nodes are never hashed again or copied.

Cases: null fields are written as ``-``; a null source is a source of its own and comes first; leaves
with one doc_id follow their digests, and a repeated row is a leaf of its own (equal leaves may have different
siblings, so different proofs); a null doc_id comes first and is never altered; empty texts are ``0:``;
a single leaf is its own subroot, a single subroot is the root; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from perpflow.llm.ranks import ranked
from perpflow.session import cut_lineage

ARITY = 3
#: Levels of one block: 729 nodes.
HEIGHT = 6
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def written(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(**replaced: Column) -> Column:
    return F.sha2(F.concat(*(written(replaced.get(c, F.col(c))) for c in FIELDS)), 256)


def _digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode("ascii")).hexdigest()


def _levels(nodes: list[str], count: int) -> list[list[str]]:
    """The nodes and ``count`` levels above them."""
    levels = [nodes]
    for _ in range(count):
        below = levels[-1]
        levels.append([_digest(below[i : i + ARITY]) for i in range(0, len(below), ARITY)])
    return levels


def _path(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    """Left and right siblings of the path from node ``at`` upward, for every level but the top."""
    path = []
    for level in levels[:-1]:
        start = at - at % ARITY
        path.append(("".join(level[start:at]), "".join(level[at + 1 : start + ARITY])))
        at //= ARITY
    return path


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The top of each block after ``height`` levels."""
    for batch in batches:
        tops = []
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            tops.append(_levels([n["digest"] for n in sorted(row["nodes"], key=lambda n: n["idx"])], row["height"])[-1][0])
        yield pa.RecordBatch.from_arrays(
            [batch.column("tree"), batch.column("block"), batch.column("rest"), pa.array(tops, pa.string())], ["tree", "idx", "levels", "digest"])


_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
_PATH_SQL = "array<struct<left: string, right: string>>"


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each node of a block the siblings from it to the top of the whole tree."""
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            nodes = sorted(row["nodes"], key=lambda n: n["idx"])
            levels = _levels([n["digest"] for n in nodes], row["height"])
            paths = [[{"left": a, "right": b} for a, b in _path(levels, i)] + (row["above"] or []) for i in range(len(nodes))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["tree"]] * len(nodes), pa.int64()), pa.array([n["idx"] for n in nodes], pa.int64()), pa.array(paths, _PATH)],
                ["tree", "idx", "path"])


def _blocks(nodes: DataFrame) -> DataFrame:
    """Rows (tree, block, nodes, height, rest): at most ARITY ** HEIGHT nodes each; ``rest``: levels still to come."""
    keyed = nodes.withColumn("block", F.floor(F.col("idx") / ARITY**HEIGHT)).withColumn("height", F.least("levels", F.lit(HEIGHT)))
    return keyed.groupBy("tree", "block").agg(
        F.collect_list(F.struct("idx", "digest")).alias("nodes"), F.first("height").alias("height"),
        (F.first("levels") - F.first("height")).alias("rest"))


def _with_levels(nodes: DataFrame) -> DataFrame:
    """Levels that the whole tree of each node has: the smallest h with ARITY ** h >= its nodes."""
    h, size = F.lit(0), 1
    for _ in range(39):
        h = h + F.when(F.col("_count") > size, 1).otherwise(0)
        size *= ARITY
    counts = nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("_count")).select("tree", h.cast("int").alias("levels"))
    return nodes.join(counts, "tree")


def _rounds(nodes: DataFrame, most: int) -> list[DataFrame]:
    """The nodes (tree, idx, levels, digest) and, for every round of blocks, the nodes that stand for the blocks."""
    rounds = [nodes]
    while most > HEIGHT:
        rounds.append(cut_lineage(
            _blocks(rounds[-1].where("levels > 0")).mapInArrow(_tops, "tree long, idx long, levels int, digest string")))
        most -= HEIGHT
    return rounds


def _tree_paths(rounds: list[DataFrame]) -> DataFrame:
    """(tree, idx, path) of the nodes of the highest tables first, down to ``rounds[1]``; of blocks only, never of leaves."""
    above = None
    for nodes in reversed(rounds[1:]):
        blocks = _blocks(nodes)
        blocks = blocks.withColumn("above", F.lit(None).cast(_PATH_SQL)) if above is None else blocks.join(
            above.select("tree", F.col("idx").alias("block"), F.col("path").alias("above")), ["tree", "block"], "left")
        above = cut_lineage(blocks.mapInArrow(_paths, f"tree long, idx long, path {_PATH_SQL}"))
    return above


def _roots(rounds: list[DataFrame]) -> DataFrame:
    """(tree, top): blocks whose levels are used up are tops already."""
    last = rounds[-1]
    tops = _blocks(last).mapInArrow(_tops, "tree long, idx long, levels int, digest string")
    for nodes in rounds[:-1]:
        tops = tops.unionByName(nodes.where("levels = 0").select("tree", "idx", "levels", "digest"))
    return tops.select("tree", F.col("digest").alias("top"))


_OUT = "doc_id long, source string, leaf string, altered string, subroot string, proof_sha256 string, folded_root string"


def _versions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per leaf its proof, and the root of the version that holds its altered leaf.

    A version copies the ancestors of its leaf inside the block, then goes on through what stands
    beside the block's path above.
    """
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            leaves = sorted(row["leaves"], key=lambda n: n["idx"])
            levels = _levels([n["digest"] for n in leaves], row["height"])
            upper = [(step["left"], step["right"]) for step in [*(row["above"] or []), *row["top_path"]]]
            proofs, roots = [], []
            for i, leaf in enumerate(leaves):
                path = _path(levels, i) + upper
                copy = leaf["altered"] or leaf["digest"]
                for left, right in path:
                    copy = _digest([left, copy, right])
                proofs.append(_digest([a + b for a, b in path]))
                roots.append(copy)
            n, text = len(leaves), pa.string()
            yield pa.RecordBatch.from_arrays([
                pa.array([x["doc_id"] for x in leaves], pa.int64()), pa.array([row["source"]] * n, text), pa.array([x["digest"] for x in leaves], text),
                pa.array([x["altered"] for x in leaves], text), pa.array([row["subroot"]] * n, text), pa.array(proofs, text), pa.array(roots, text)],
                ["doc_id", "source", "leaf", "altered", "subroot", "proof_sha256", "folded_root"])


def manifest(docs: DataFrame, altered: Column | None = None, where: Column | None = None) -> DataFrame:
    """One row a leaf: (doc_id, source, leaf, altered, subroot, root, proof_sha256, folded_root, verified).

    ``altered`` is the text that a leaf is changed to where ``where`` holds; ``folded_root`` is the root of the version
    with that leaf. Without both, every leaf proves the root as it is.
    """
    changed = F.lit(None).cast("string")
    if altered is not None:
        changed = leaf_digest(text=altered) if where is None else F.when(where, leaf_digest(text=altered))
    leaves = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", leaf_digest().alias("digest"), changed.alias("altered"))
    placed = ranked(leaves, ["source"], ["doc_id", "digest", "altered"])
    # Sources in order are numbered like leaves, and their numbers stand for them from here on.
    names = ranked(placed.select("source").distinct().withColumn("_all", F.lit(0)), ["_all"], ["source"], "tree").drop("_all")
    names = cut_lineage(names)
    numbered = placed.join(names.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("source", "_s")
    nodes = cut_lineage(_with_levels(numbered))
    most = nodes.agg(F.max("levels")).first()[0] or 0
    rounds = _rounds(nodes.select("tree", "idx", "levels", "digest"), most)
    subroots = cut_lineage(_roots(rounds))

    top_nodes = cut_lineage(_with_levels(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.col("top").alias("digest"))))
    top_most = top_nodes.agg(F.max("levels")).first()[0] or 0
    top_rounds = _rounds(top_nodes.select("tree", "idx", "levels", "digest"), top_most)
    root = (_roots(top_rounds).first() or (None, None))[1]
    top_paths = cut_lineage(_tree_paths([top_nodes, *top_rounds]))

    blocks = nodes.withColumn("block", F.floor(F.col("idx") / ARITY**HEIGHT)).groupBy("tree", "block").agg(
        F.collect_list(F.struct("idx", "digest", "altered", "doc_id")).alias("leaves"), F.least(F.first("levels"), F.lit(HEIGHT)).alias("height"))
    above = _tree_paths(rounds)
    blocks = blocks.withColumn("above", F.lit(None).cast(_PATH_SQL)) if above is None else blocks.join(
        above.select("tree", F.col("idx").alias("block"), F.col("path").alias("above")), ["tree", "block"], "left")
    of_source = subroots.join(names, "tree").join(top_paths.select(F.col("idx").alias("tree"), F.col("path").alias("top_path")), "tree").select(
        "tree", "source", F.col("top").alias("subroot"), "top_path")
    done = blocks.join(of_source, "tree").mapInArrow(_versions, _OUT)
    return done.select(
        "doc_id", "source", "leaf", "altered", "subroot", F.lit(root).cast("string").alias("root"), "proof_sha256", "folded_root",
        (F.col("folded_root") == F.lit(root)).alias("verified"))


def tamper_check(docs: DataFrame) -> DataFrame:
    """The manifest with line breaks deleted from the texts whose doc_id has an even crc32."""
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return manifest(docs, F.replace("text", F.lit("\n"), F.lit("")), even)
