"""Near duplicates by a chosen-path similarity join over minwise tokens.

Two documents link when their sets of distinct ``SIZE``-word shingles reach 100 * intersection >= ``PERCENT`` *
union. Every set has ``PATHS`` minwise tokens; two sets of similarity s agree on each with probability s. A node
of a tree holds the documents that agree on the tokens along its path:

* a node branches by minwise tokens which its path picks, two near the root and 1.3 on average below;
* a node of ``NODE`` documents or fewer is compared exhaustively;
* trees are repeated until a linked pair is missed by all of them with probability 1 - ``target`` at most. This is
  computed for paths of unlimited length and pairs exactly at the threshold; pairs that part in small nodes, as
  nearly all do, and more similar pairs are found with a far higher probability.

Exhaustive comparison works on sketches (the smallest shingle of each of ``BINS`` hash ranges, one byte each):
a pair goes on unless its sketches agree less than a linked pair's would by ``SIGMAS`` deviations. All that go on are
confirmed on the full sets of both texts.

Groups of copies never become all their pairs. Equal sets are one document of the join. Large nodes compare their
members with one hub, small nodes hand on the best spanning forest of their candidates; when those are
confirmed, nodes whose members are one component by then are left alone: large ones branch no further, and of small ones only
candidates between different components are confirmed after that. Nodes with the same members are compared once. Nodes
that are still large when their tokens are used up are compared block by block, so no pair of a node is left out.

Cases: null and blank texts have empty sets and link with nothing; texts under five words have one shingle of all
their words; a doc_id that repeats is one document (its texts share a component); a null doc_id links with nothing, has
no component and is kept; repeated rows give repeated rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from perpflow.llm.components import components
from perpflow.llm.text import mixed, shingle_sets, slices, steady
from perpflow.session import cut_lineage, drop_written

SIZE, PERCENT = 5, 85
PATHS, BINS, NODE = 32, 256, 4096
#: Chance that all trees miss a pair at the threshold: one in a hundred thousand.
TARGET = 0.99999
SIGMAS = 5.0
#: Share of the nodes below the second level that have two children instead of one.
TWINS = 0.3
DEEPEST = PATHS - 4
#: Levels between two comparisons of large nodes with hubs.
HUB_EVERY = 4
#: Members of nodes that are unpacked together.
UNPACKED = 20_000

_seeds = np.random.default_rng(20250311)
_A = _seeds.integers(1, 2**63, PATHS, dtype=np.uint64) | np.uint64(1)
_B = _seeds.integers(1, 2**63, PATHS, dtype=np.uint64) | np.uint64(1)


def tree_miss(s: float) -> float:
    """Chance that one tree of unlimited depth separates two sets of similarity s."""
    deep = 0.0
    for _ in range(10_000):
        x = 1 - s + s * deep
        deep = (1 - TWINS) * x + TWINS * x * x
    second = (1 - s + s * deep) ** 2
    return (1 - s + s * second) ** 2


def trees_for(target: float, s: float = PERCENT / 100) -> int:
    """Trees whose joint chance to miss a pair is 1 - target at most."""
    n = math.ceil(math.log(1 - target) / math.log(tree_miss(s)))
    if 2 * n > PATHS:
        raise ValueError("target needs more minwise tokens than PATHS")
    return max(1, n)


_FEATURES = "doc_id long, n long, first long, second long, paths array<int>, sketch binary"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Set size, 128-bit print, minwise tokens and sketch of every text."""
    for batch in slices(batches):
        rows = batch.num_rows
        o, v = shingle_sets(batch.column("text"), SIZE)
        sizes = np.bincount(o, minlength=rows)
        starts = np.cumsum(sizes) - sizes
        full = sizes > 0
        paths = np.zeros((rows, PATHS), dtype=np.uint32)
        sketch = np.zeros((rows, BINS), dtype=np.uint8)
        prints = []
        for salt in (0, 0x5851F42D4C957F2D):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(v ^ np.uint64(salt)), dtype=np.uint64)])
            prints.append(pa.array((total[starts + sizes] - total[starts]).view(np.int64)))
        if len(v):
            for j in range(PATHS):
                h = v * _A[j]
                h ^= h >> np.uint64(32)
                h *= _B[j]
                paths[full, j] = np.minimum.reduceat(h, starts[full]) >> np.uint64(32)
            # Shingles are sorted inside a text, so the first of each range is its smallest.
            bins = (v >> np.uint64(56)).astype(np.int64)
            lead = np.ones(len(v), dtype=bool)
            lead[1:] = (o[1:] != o[:-1]) | (bins[1:] != bins[:-1])
            sketch[o[lead], bins[lead]] = (v[lead] % np.uint64(255) + np.uint64(1)).astype(np.uint8)
        offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * PATHS)
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), pa.array(sizes.astype(np.int64)), *prints,
            pa.ListArray.from_arrays(offsets, pa.array(paths.view(np.int32).ravel())),
            pa.array([r.tobytes() for r in sketch], pa.binary())], ["doc_id", "n", "first", "second", "paths", "sketch"])


def _fits(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Sets whose sizes allow a link."""
    return 100 * np.minimum(na, nb) >= PERCENT * np.maximum(na, nb)


def _agreement(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarity of sketches row by row, and whether the pair may reach the threshold.

    The ranges that are filled in either sketch are a sample of the union without repetition, so a small union is
    nearly counted out and its estimate varies little.
    """
    s = PERCENT / 100
    same = np.count_nonzero((a == b) & (a > 0), axis=1)
    either = np.count_nonzero(a | b, axis=1)
    union = np.maximum((na + nb) / (1 + s), either + 1)
    spread = np.sqrt(either * s * (1 - s) * (union - either) / (union - 1))
    return same / np.maximum(either, 1), same >= either * s - SIGMAS * spread - 1


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same nodes in batches of about UNPACKED members."""
    for batch in batches:
        ends = np.cumsum(np.diff(batch.column("members").offsets.to_numpy()))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + UNPACKED, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def _compared(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(node, place, place, estimate) of the candidates of every node, by places in the flat list of members.

    ``group`` keeps pairs of one component apart.
    """
    lists = batch.column("members")
    members = lists.flatten()
    ids, sizes, groups = (members.field(c).to_numpy(zero_copy_only=False) for c in ("id", "n", "group"))
    sketch = np.frombuffer(b"".join(members.field("sketch").to_pylist()), dtype=np.uint8).reshape(-1, BINS)
    counts = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    starts = np.cumsum(counts) - counts
    for node in range(batch.num_rows):
        m, at = counts[node], starts[node]
        step = max(1, 40_000 // max(m, 1))
        for first in range(0, m - 1, step):
            rows = np.arange(first, min(first + step, m - 1))
            i = np.repeat(rows, m - 1 - rows)
            j = np.concatenate([np.arange(r + 1, m) for r in rows])
            i, j = i + at, j + at
            apart = (groups[i] != groups[j]) & (ids[i] != ids[j]) & _fits(sizes[i], sizes[j])
            i, j = i[apart], j[apart]
            if len(i):
                estimate, near = _agreement(sketch[i], sketch[j], sizes[i], sizes[j])
                yield node, i[near], j[near], estimate[near]


def _pairs(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each node the candidates of a spanning forest, the most similar ones first."""
    for batch in _few(batches):
        by_node: dict[int, list[tuple[float, int, int]]] = {}
        ids = _ids(batch)
        for node, i, j, estimate in _compared(batch):
            u, v = ids[i], ids[j]
            by_node.setdefault(node, []).extend(zip((-estimate).tolist(), u.tolist(), v.tolist(), strict=True))
        chosen = []
        for found in by_node.values():
            parent: dict[int, int] = {}

            def top(x: int, parent: dict[int, int] = parent) -> int:
                while parent.get(x, x) != x:
                    parent[x] = x = parent.get(parent[x], parent[x])
                return x

            for _, u, v in sorted(found):
                a, b = top(u), top(v)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    chosen.append((u, v))
        yield _pairs(*(np.array(x, dtype=np.int64) for x in (zip(*chosen, strict=True) if chosen else ((), ()))))


def _crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All candidates between different components, each from the first of the nodes that hold both."""
    for batch in _few(batches):
        ids, keys = _ids(batch), batch.column("key").to_numpy()
        homes = batch.column("members").flatten().field("homes")
        counts = np.diff(homes.offsets.to_numpy())
        width = int(counts.max(initial=1))
        table = np.full((len(counts), width), np.iinfo(np.int64).max)
        table[np.repeat(np.arange(len(counts)), counts), np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)] = homes.flatten().to_numpy()
        for node, i, j, _ in _compared(batch):
            for at in range(0, len(i), 4096):
                a, b = i[at : at + 4096], j[at : at + 4096]
                earlier = table[a][:, :, None] == table[b][:, None, :]
                earlier &= (table[a] < keys[node])[:, :, None]
                first = ~earlier.any(axis=(1, 2))
                if first.any():
                    yield _pairs(ids[a[first]], ids[b[first]])


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("members").flatten().field("id").to_numpy(zero_copy_only=False)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, BINS) for c in ("su", "sv"))
        na, nb = batch.column("nu").to_numpy(), batch.column("nv").to_numpy()
        _, near = _agreement(a, b, na, nb)
        keep = pa.array(near & _fits(na, nb))
        yield pa.RecordBatch.from_arrays([batch.column("u").filter(keep), batch.column("v").filter(keep)], ["u", "v"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets reach the threshold."""
    for batch in slices(batches, "left"):
        n = batch.num_rows
        a, b = (shingle_sets(batch.column(c), SIZE) for c in ("left", "right"))
        o, v = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
        order = np.lexsort((v, o))
        o, v = o[order], v[order]
        both = np.bincount(o[1:][(o[1:] == o[:-1]) & (v[1:] == v[:-1])], minlength=n)
        union = np.bincount(o, minlength=n) - both
        keep = pa.array((100 * both >= PERCENT * union) & (union > 0))
        yield pa.RecordBatch.from_arrays([batch.column("u").filter(keep), batch.column("v").filter(keep)], ["u", "v"])


def _confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) that link. Each side meets its texts on its own, so a short list of pairs is all that is sent to the texts."""
    left, right = (
        pairs.join(texts.select(F.col("doc_id").alias(side), F.col("text").alias(name)), side) for side, name in (("u", "left"), ("v", "right")))
    both = left.join(right, ["u", "v"])
    return both.select("u", "v", "left", "right").mapInArrow(_confirmed, "u long, v long").distinct()


def _roots(sets: DataFrame, trees: int) -> DataFrame:
    """(key, id, used) of the first level: two children of the root of every tree."""
    at = F.explode(F.sequence(F.lit(0), F.lit(2 * trees - 1))).alias("p")
    return sets.select("id", "paths", at).select(
        F.expr("xxhash64(p, element_at(paths, p + 1))").alias("key"), "id", F.expr("shiftleft(1L, p)").alias("used"))


def _children(nodes: DataFrame, sets: DataFrame, depth: int) -> DataFrame:
    """(key, id, used) one level down: tokens that the path has not used, picked by the node's key."""
    many = "2" if depth < 2 else f"IF(pmod(xxhash64(key, 'twins'), 1000) < {int(1000 * TWINS)}, 2, 1)"
    free = f"filter(sequence(0, {PATHS - 1}), p -> (shiftright(used, p) & 1L) = 0)"
    picked = f"slice(array_sort(transform({free}, p -> struct(xxhash64(key, p) AS h, p AS p))), 1, {many})"
    rows = nodes.join(sets.select("id", "paths"), "id").select("key", "id", "used", "paths", F.explode(F.expr(picked)).alias("c"))
    return rows.select(
        F.expr("xxhash64(key, c.p, element_at(paths, c.p + 1))").alias("key"), "id", F.expr("used | shiftleft(1L, c.p)").alias("used"))


def _blocks(nodes: DataFrame) -> DataFrame:
    """Large nodes as small ones: all pairs of blocks of about NODE / 4 members."""
    b = nodes.withColumn("blocks", F.ceil(F.col("size") / (NODE // 4)).cast("long")).withColumn("own", F.expr("pmod(xxhash64(key, id), blocks)"))
    return b.select("key", "id", "own", F.expr("explode(sequence(0L, blocks - 1))").alias("other")).select(
        F.expr("xxhash64(key, least(own, other), greatest(own, other))").alias("key"), "id")


def _shared(rows: DataFrame) -> DataFrame:
    """(key, id, used, size) of nodes with several members; of nodes with the same members one stays."""
    h = F.xxhash64("id")
    nodes = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("size"), F.sum(h.bitwiseAND(F.lit(2**32 - 1))).alias("low"), F.sum(F.shiftright(h, 32)).alias("high")).where("size > 1")
    return rows.join(nodes.groupBy("size", "low", "high").agg(F.min("key").alias("key")).select("key", "size"), "key")


def _several_components(rows: DataFrame, groups: DataFrame | None) -> DataFrame:
    """Rows of nodes whose members are in more than one component, with their component as ``group``."""
    if groups is None:
        return rows.withColumn("group", F.col("id"))
    placed = rows.join(groups.select("id", "component"), "id", "left").withColumn("group", F.coalesce("component", "id")).drop("component")
    mixed_nodes = placed.groupBy("key").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo < hi").select("key")
    return placed.join(mixed_nodes, "key")


def _gathered(rows: DataFrame, sets: DataFrame, compare: Callable) -> DataFrame:
    """Distinct pairs (u, v) that ``compare`` takes from small nodes; ``homes`` are all nodes of a member."""
    rows = rows.select("key", "id", "group").distinct()
    homes = rows.groupBy("id").agg(F.collect_list("key").alias("homes"))
    full = rows.join(homes, "id").join(sets.select("id", "n", "sketch"), "id")
    nodes = full.groupBy("key").agg(F.collect_list(F.struct("id", "n", "group", "sketch", "homes")).alias("members")).select("key", "members")
    return nodes.mapInArrow(compare, "u long, v long").distinct()


def _gathered_labels(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id within three links."""
    ends = F.array(*[F.struct(F.col(a).alias("id"), F.col(b).alias("near")) for a in "uv" for b in "uv"])
    near = links.select(F.inline(ends))
    labels = near.groupBy("id").agg(F.min("near").alias("component"))
    for _ in range(2):
        labels = near.join(labels.withColumnRenamed("id", "near"), "near").groupBy("id").agg(F.min("component").alias("component"))
    return labels


def _whole_components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that can be reached. Most links lie inside what three steps gather; stars join the rest."""
    labels = cut_lineage(_gathered_labels(links))
    of = lambda side: labels.select(F.col("id").alias(side), F.col("component").alias(f"c{side}"))
    open_ = cut_lineage(links.join(of("u"), "u").join(of("v"), "v").where("cu <> cv").select(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v")).distinct())
    if open_.isEmpty():
        return labels
    joined = components(open_).select(F.col("id").alias("component"), F.col("component").alias("whole"))
    return labels.join(joined, "component", "left").select("id", F.coalesce("whole", "component").alias("component"))


def _to_hubs(large: DataFrame, sets: DataFrame) -> DataFrame:
    """Candidates (u, v) between the members of each large node and one of them."""
    hubs = large.groupBy("key").agg(F.min_by("id", F.xxhash64("key", "id")).alias("hub"))
    pairs = large.join(hubs, "key").where("id <> hub").select(F.least("id", "hub").alias("u"), F.greatest("id", "hub").alias("v")).distinct()
    sized = pairs.join(sets.select(F.col("id").alias("u"), F.col("n").alias("nu"), F.col("sketch").alias("su")), "u").join(
        sets.select(F.col("id").alias("v"), F.col("n").alias("nv"), F.col("sketch").alias("sv")), "v")
    return sized.select("u", "v", "nu", "nv", "su", "sv").mapInArrow(_near, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, target: float = TARGET) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row."""
    steady(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = cut_lineage(texts.mapInArrow(_features, _FEATURES))
    known = found.where("n > 0 AND doc_id IS NOT NULL")
    sets = cut_lineage(known.groupBy("first", "second", "n").agg(
        F.min("doc_id").alias("id"), F.first("paths").alias("paths"), F.first("sketch").alias("sketch")))
    copies = cut_lineage(known.select("doc_id", "first", "second", "n").join(
        sets.select("first", "second", "n", "id"), ["first", "second", "n"]).where("doc_id <> id").select(F.col("id").alias("u"), F.col("doc_id").alias("v")))

    level = cut_lineage(_shared(_roots(sets, trees_for(target))))
    met = cut_lineage(texts.join(
        level.select(F.col("id").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi"))
    small, large = [level.where(F.col("size") <= NODE).select("key", "id")], level.where(F.col("size") > NODE)
    written, judged, links = [level], [], []

    def settle(candidates: DataFrame) -> DataFrame:
        """Confirm candidates; (id, component) by all links so far."""
        judged.append(cut_lineage(candidates))
        links.append(cut_lineage(_confirm(judged[-1], met)))
        written.append(cut_lineage(_whole_components(_all(links))))
        return written[-1]

    groups = settle(_gathered(_several_components(small[0], None), sets, _forest).unionByName(_to_hubs(large, sets)).distinct())
    deeper, depth = [], 1
    while True:
        opened = cut_lineage(_several_components(large, groups))
        written.append(opened)
        if opened.isEmpty():
            break
        if depth == DEEPEST:
            deeper.append(_blocks(opened))
            break
        level = cut_lineage(_shared(_children(opened.select("key", "id", "used"), sets, depth)))
        written.append(level)
        depth += 1
        deeper.append(level.where(F.col("size") <= NODE).select("key", "id"))
        large = level.where(F.col("size") > NODE)
        if depth % HUB_EVERY == 0:
            groups = settle(_to_hubs(large, sets))
    if deeper:
        groups = settle(_gathered(_several_components(_all(deeper), groups), sets, _forest))
    # Written first: a pair may come from several nodes, and a join before they are put together would carry all its copies.
    crossing = cut_lineage(_gathered(_several_components(_all([*small, *deeper]), groups), sets, _crossing))
    rest = cut_lineage(crossing.join(_all(judged), ["u", "v"], "left_anti"))
    links.append(cut_lineage(_confirm(rest, met)))
    written += [crossing, rest]
    final = cut_lineage(_whole_components(_all([*links, copies])))
    for table in (*written, *judged, *links, copies, sets, met):
        drop_written(table)
    placed = found.select("doc_id", F.col("n").alias("n_shingles")).join(final.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return placed.select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.coalesce("component", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)
