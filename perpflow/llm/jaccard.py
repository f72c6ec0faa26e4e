"""Exact Jaccard join of word-shingle sets and its components: a size-aware heavy-light join.

Two documents link when their sets of distinct ``SIZE``-word shingles reach 100 * intersection >= 80 *
union. Which of two ways finds a candidate depends on the size of the set:

* light sets enumerate all subsets of the overlap that a link of two such sets needs (a fixed size for
  each pair of sizes); sets with a common subset of that size meet in one equi-join;
* heavy sets are found in inverted lists: of the shingles in one order for all documents, a set looks
  only at the first n - ceil(0.8 n) + 1, since a linked pair shares one of those. The order puts rare shingles first.
  Most shingles of a text are nowhere else: a set whose prefix is full of them is in no list at all. Two rounds find how
  rare they are: the first counts those whose hash is below ``COUNTED``, about a quarter, which come before all others, and
  leaves only sets that may meet another one; the second counts all shingles of the sets that are left.

The boundary is the size at which subsets cost more than list entries, from the size counts and the list
lengths of all small sets of the corpus.

Two linked sets of n and m shingles share ceil(4 (n + m) / 9), so the first shingle they share has so many at least from its
rank to the end of either set. A list entry therefore knows what it can still reach, 5 n - 9 rank: it meets
entries of sets of m with 4 m at most that, and they it (``_meets``).

Groups of copies would make lists with all pairs of the group. Therefore equal sets are one node, then
each list links its members to its smallest document only, and then to the one that reaches farthest, and verified links
are joined into components first. After that, lists are looked at again for pairs of different components, and all of those are verified.
No link between components is lost, and no pair inside one is enumerated.

Candidates are verified on whole texts. Shingles are 64-bit hashes; sets are told apart by 128 bits.

Cases: null and blank texts have empty sets and link with nothing; texts under five words have one shingle
of all their words; a document that repeats a doc_id belongs to the same document (its texts share a component); a null
doc_id has its own shingle count, no component, and no links; repeated rows give repeated rows; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from perpflow.llm.components import components
from perpflow.llm.text import mixed, shingle_sets, slices, steady
from perpflow.session import cut_lineage, drop_written

SIZE = 5
#: Largest set for which subsets are considered at all.
LIGHT_MOST = 24
#: Shingles with a hash below this are counted.
COUNTED = 1 << 62
#: Shingles in more sets than this are equally frequent in the order.
CROWD = 1 << 16


def prefix_length(n):
    """How many shingles of a set of n a linked set must share one of."""
    return n - (4 * n + 4) // 5 + 1


def overlaps(n: int) -> list[int]:
    """Overlaps that a link with a set of any possible size needs."""
    return sorted({-(-4 * (n + m) // 9) for m in range((4 * n + 4) // 5, 5 * n // 4 + 1)})


def light_cost(n: int) -> int:
    return sum(comb(n, c) for c in overlaps(n))


def boundary(sizes: dict[int, int], list_length: float) -> int:
    """Largest size up to which subsets are cheaper than list entries, over all sets of the sizes so far."""
    best, saved, at = 0.0, 0.0, 0
    for n in range(1, LIGHT_MOST + 1):
        saved += sizes.get(n, 0) * (prefix_length(n) * (1 + list_length) - light_cost(n))
        if saved > best:
            best, at = saved, n
    return at


_SETS = "doc_id long, n long, first long, second long, counted int, keys array<long>"


def _sets(batches: Iterator[pa.RecordBatch], limit: int = COUNTED) -> Iterator[pa.RecordBatch]:
    """Size and 128-bit print of every set, and its counted shingles; more by hash where those are no prefix; all of small sets."""
    for batch in slices(batches):
        n = batch.num_rows
        o, v = shingle_sets(batch.column("text"), SIZE)
        sizes = np.bincount(o, minlength=n)
        cut = np.concatenate([[0], np.cumsum(sizes)])
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(v), dtype=np.uint64)])
        other = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(v ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
        rank = np.arange(len(o)) - cut[o]
        counted = v <= np.uint64(limit - 1)
        keep = counted | (rank < prefix_length(sizes)[o]) | (sizes[o] <= LIGHT_MOST)
        ends = np.concatenate([[0], np.cumsum(np.bincount(o[keep], minlength=n))]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), pa.array(sizes.astype(np.int64)),
            pa.array((total[cut[1:]] - total[cut[:-1]]).view(np.int64)), pa.array((other[cut[1:]] - other[cut[:-1]]).view(np.int64)),
            pa.array(np.bincount(o[counted], minlength=n).astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(v[keep].view(np.int64)))],
            ["doc_id", "n", "first", "second", "counted", "keys"])


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same with all shingles."""
    return _sets(batches, 1 << 64)


def _nodes(sets: DataFrame) -> DataFrame:
    """Equal sets as one node, named by their smallest document."""
    whole = sets.groupBy("first", "second", "n").agg(
        *(f(c).alias(c) for f, c in ((F.min, "doc_id"), (F.any_value, "counted"), (F.any_value, "keys"))))
    return cut_lineage(whole.withColumn("node", F.monotonically_increasing_id()))


def _subset_keys(values: np.ndarray) -> list[int]:
    keys = []
    parts = mixed(values).tolist()
    for c in overlaps(len(parts)):
        keys += [(sum(s) + c * 0x9E3779B97F4A7C15) & (2**64 - 1) for s in combinations(parts, c)]
    return keys


def _subsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The subset keys of light sets."""
    for batch in batches:
        made = [mixed(np.array(_subset_keys(np.array(k, dtype=np.int64).view(np.uint64)), dtype=np.uint64)) for k in batch.column("keys").to_pylist()]
        counts = np.array([len(m) for m in made], dtype=np.int64)
        row = pa.array(np.repeat(np.arange(len(made)), counts))
        keys = np.concatenate([np.zeros(0, np.uint64), *made])
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys.view(np.int64)), batch.column("doc_id").take(row), batch.column("n").take(row)], ["key", "doc_id", "n"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose texts reach the threshold."""
    for batch in slices(batches, "left"):
        n = batch.num_rows
        a, b = (shingle_sets(batch.column(c), SIZE) for c in ("left", "right"))
        o, v = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
        order = np.lexsort((v, o))
        o, v = o[order], v[order]
        same = (o[1:] == o[:-1]) & (v[1:] == v[:-1])
        both = np.bincount(o[1:][same], minlength=n)
        union = np.bincount(o, minlength=n) - both
        keep = pa.array((100 * both >= 80 * union) & (union > 0))
        yield pa.RecordBatch.from_arrays([batch.column("u").filter(keep), batch.column("v").filter(keep)], ["u", "v"])


#: SQL: two sets may share as much as a link needs, judged by where in their prefixes they meet.
_MEETS = "4 * n_b <= reach_a AND 4 * n_a <= reach_b"


def _listed(nodes: DataFrame, light: int, limit: int = COUNTED) -> DataFrame:
    """(key, doc_id, n, reach): prefixes, rare shingles first, of the sets that may link with one that is not light."""
    prefix = "n - floor((4 * n + 4) / 5) + 1"
    keys = nodes.where(5 * F.col("n") >= 4 * (light + 1)).select(
        "node", F.explode(F.expr(f"slice(keys, 1, cast(greatest(counted, {prefix}) AS int))")).alias("key"))
    # Written, so that the join sees two plain shuffles and can split a shingle that very many sets have.
    often = cut_lineage(keys.groupBy("key").agg(F.least(F.count(F.lit(1)), F.lit(CROWD)).alias("often")).where("often > 1"))
    shared = keys.join(often, "key").join(nodes.select("node", "doc_id", "n", "counted"), "node")
    late = F.lit(False) if limit > 1 << 63 else (F.col("key") < 0) | (F.col("key") >= limit)
    of_set = W.partitionBy("node")
    order = of_set.orderBy(late, F.when(~late, F.col("often")), F.col("key") < 0, "key")
    # Shingles of no other set come first. Late ones of no other set are not seen: such a rank is a lower bound.
    ranked = shared.withColumn("place", F.row_number().over(order) - 1).withColumn(
        "rank", F.col("place") + F.col("counted") - F.count_if(~late).over(of_set))
    return ranked.where(f"rank < {prefix}").select("key", "doc_id", "n", F.expr("5 * n - 9 * rank").alias("reach"))


def _meeting(entries: DataFrame) -> DataFrame:
    """Documents that may meet another one in a list."""
    lists = entries.groupBy("key").agg(
        F.min("n").alias("least"), F.max("reach").alias("most"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi")
    return entries.join(lists.drop("lo", "hi"), "key").where("4 * least <= reach AND 4 * n <= most").select("doc_id")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) that link, judged on their whole texts."""
    left = pairs.join(texts.select(F.col("doc_id").alias("u"), F.col("text").alias("left")), "u")
    both = left.join(texts.select(F.col("doc_id").alias("v"), F.col("text").alias("right")), "v")
    return both.select("u", "v", "left", "right").mapInArrow(_linked, "u long, v long").distinct()


def _pairs(met: DataFrame) -> DataFrame:
    return met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct()


def _to_hubs(placed: DataFrame, pick: Column) -> DataFrame:
    """Pairs of the members of each list with the one that ``pick`` takes, if it is in another component."""
    hubs = placed.groupBy("key").agg(pick.alias("hub"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select(
        "key", F.col("hub.doc_id").alias("v"), *(F.col(f"hub.{c}").alias(f"{c}_b") for c in ("n", "reach", "component")))
    members = placed.select("key", F.col("doc_id").alias("u"), *(F.col(c).alias(f"{c}_a") for c in ("n", "reach", "component")))
    return _pairs(members.join(hubs, "key").where(f"component_a <> component_b AND {_MEETS}"))


def linked_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row."""
    spark = steady(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = cut_lineage(texts.mapInArrow(_sets, _SETS))
    known = texts.where("doc_id IS NOT NULL")

    real = found.where("n > 0 AND doc_id IS NOT NULL")
    nodes = _nodes(real)
    same = cut_lineage(
        real.select("doc_id", "first", "second", "n").join(nodes.select("first", "second", "n", F.col("doc_id").alias("node")), ["first", "second", "n"])
        .where("doc_id <> node").select("doc_id", "node").distinct())

    small = nodes.where(F.col("n") <= LIGHT_MOST)
    sizes = {r.n: r.sets for r in small.groupBy("n").agg(F.count(F.lit(1)).alias("sets")).collect()}
    lists = small.select(F.explode(F.expr("slice(keys, 1, cast(n - floor((4 * n + 4) / 5) + 1 AS int))")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    length = lists.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] or 1.0
    light = boundary(sizes, float(length))

    subsets = nodes.where(F.col("n") <= light).select("doc_id", "n", "keys").mapInArrow(_subsets, "key long, doc_id long, n long")
    subsets = cut_lineage(subsets.select("key", "doc_id", "n", F.expr("5 * n").alias("reach")))
    rough = cut_lineage(_listed(nodes, light))
    drop_written(nodes)
    known = cut_lineage(known.join(_meeting(rough).union(_meeting(subsets)).distinct(), "doc_id", "left_semi"))
    drop_written(rough)
    left = _nodes(known.mapInArrow(_whole_sets, _SETS).where("n > 0"))
    keys = cut_lineage(_listed(left, light, 1 << 64).union(subsets))
    drop_written(left)

    edges = [same.select(F.col("node").alias("u"), F.col("doc_id").alias("v"))]
    placed = keys.withColumn("component", F.col("doc_id"))
    for pick in (F.min(F.struct("doc_id", "n", "reach", "component")), F.max_by(F.struct("doc_id", "n", "reach", "component"), F.struct("reach", "doc_id"))):
        edges.append(cut_lineage(verified(cut_lineage(_to_hubs(placed, pick)), known)))
        groups = cut_lineage(components(reduce(DataFrame.union, edges)))
        placed = cut_lineage(
            keys.join(groups.withColumnRenamed("id", "doc_id"), "doc_id", "left")
            .select("key", "doc_id", "n", "reach", F.coalesce("component", "doc_id").alias("component")))
    drop_written(keys)
    mixed_lists = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    open_lists = cut_lineage(placed.join(mixed_lists, "key"))
    drop_written(placed)
    blocks = open_lists.groupBy("key", "component").agg(F.min("n").alias("n"), F.max("reach").alias("reach"))
    a, b = (blocks.select("key", *(F.col(c).alias(f"{c}_{side}") for c in ("component", "n", "reach"))) for side in "ab")
    met = a.join(b, "key").where(f"component_a < component_b AND {_MEETS}").select("key", "component_a", "component_b")
    member = lambda side, id_: open_lists.select("key", F.col("doc_id").alias(id_), *(F.col(c).alias(f"{c}_{side}") for c in ("component", "n", "reach")))
    across = met.join(member("a", "u"), ["key", "component_a"]).join(member("b", "v"), ["key", "component_b"]).where(_MEETS)
    more = cut_lineage(verified(cut_lineage(_pairs(across)), known))
    label = groups.select("id", "component")
    # Links between components: their smallest documents stand for them.
    bridges = (
        more.join(label.select(F.col("id").alias("u"), F.col("component").alias("cu")), "u", "left")
        .join(label.select(F.col("id").alias("v"), F.col("component").alias("cv")), "v", "left")
        .select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v")))
    joined = components(bridges).select(F.col("id").alias("component"), F.col("component").alias("whole"))
    final = label.join(joined, "component", "full").select(
        F.coalesce("id", "component").alias("doc_id"), F.coalesce("whole", "component").alias("whole"))
    final = final.groupBy("doc_id").agg(F.min("whole").alias("whole"))
    for used in (open_lists, *edges[1:], subsets, known):
        drop_written(used)
    return found.select("doc_id", "n").join(final, "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("whole", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id, with all columns; rows without links stay.

    Rows that repeat the smallest doc_id are one document and all stay.
    """
    gone = linked_components(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
