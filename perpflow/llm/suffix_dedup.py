"""Exact substring de-duplication by longest-previous-factor (LPF) arrays over bucketed suffixes.

A byte goes when a string of ``length`` bytes covers it that also starts earlier, that is in a
smaller doc_id or at an earlier start of the same document. In suffix order the earlier match
of a suffix is its previous or its next smaller position (PSV, NSV); the suffix is removable when
one of the two shares ``length`` bytes with it.

One suffix array over everything is not needed. Every string of ``length`` bytes contains an
anchor, the smallest hash of its ``GRAM``-byte substrings, and equal strings have equal anchors.
So the strings of one anchor are sorted apart from all others, and those of an anchor that
occurs once in the corpus are never sorted:

1. count anchors (fold before the shuffle), keep those that occur twice;
2. cut the texts into segments, the bytes around each repeated anchor;
3. equal segments: every copy but the first is covered whole (fold before the shuffle);
4. different segments of one anchor: suffix order to depth ``length``, PSV and NSV, in buckets;
   an anchor with more than ``HOT`` different segments is split by the strings themselves;
5. spans meet the texts again, one row for each document.

Cases: null text is empty; texts under ``length`` bytes keep everything; rows that repeat a
doc_id are told apart by their text, a repeated row (same id, same text) is the same document and
both get its result; a null doc_id sorts first; an empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from perpflow.llm.text import joined, minimizers, slices, steady, window_hashes, window_minimum
from perpflow.session import cut_lineage, drop_written

LENGTH = 100
GRAM = 32
HOT = 50_000


def _grams(data: np.ndarray, bounds: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, byte position and text of every gram that lies in one text."""
    value = window_hashes(data, gram)
    lengths = np.maximum(np.diff(bounds) - gram + 1, 0)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + bounds[owner]
    return value[at], at, owner


def _anchors(length: int, gram: int, keyed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, bounds = joined(batch.column("text"))
            value, _, owner = _grams(data, bounds, gram)
            at = minimizers(value, owner, length - gram + 1)
            if keyed:
                ids = np.stack([owner[at].astype(np.uint64), value[at]], axis=1)
                ids = np.unique(ids, axis=0) if len(ids) else ids
                doc = batch.column("doc_id").take(pa.array(ids[:, 0].astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[:, 1].view(np.int64) if len(ids) else [], pa.int64()), doc], ["anchor", "doc_id"])
            else:
                found, times = np.unique(value[at], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(times.astype(np.int64))], ["anchor", "times"])

    return run


def _segments(length: int, gram: int):
    """The bytes around each repeated anchor of a text: all strings that have it as leftmost smallest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, bounds = joined(batch.column("text"))
            value, at, owner = _grams(data, bounds, gram)
            width = length - gram + 1
            n = max(0, len(value) - width + 1)
            inside = np.flatnonzero(owner[:n] == owner[width - 1 :]) if n else np.zeros(0, np.int64)
            least = window_minimum(value, width)[inside] if n else np.zeros(0, np.uint64)
            anchors = minimizers(value, owner, width)
            pick = np.searchsorted(anchors, inside)
            while len(todo := np.flatnonzero(value[anchors[pick]] != least)) if len(inside) else False:
                pick[todo] += 1
            cut = np.flatnonzero(np.diff(pick, prepend=-1))
            first, anchor = inside[cut], anchors[pick[cut]] if len(cut) else np.zeros(0, np.int64)
            count = np.diff(cut, append=len(pick))
            doc = owner[first]
            flags = batch.column("anchors")
            sizes = np.asarray(pc.list_value_length(flags))
            flat = flags.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            ids = np.repeat(np.arange(len(sizes)), sizes)
            known = np.sort(np.rec.fromarrays([ids, flat], names="d,h"))
            mine = np.rec.fromarrays([doc, value[anchor]], names="d,h")
            spot = np.minimum(np.searchsorted(known, mine), max(0, len(known) - 1))
            keep = np.flatnonzero(known[spot] == mine) if len(known) and len(mine) else np.zeros(0, np.int64)
            start = at[first[keep]]
            whole = data.tobytes()
            pieces = [whole[s : s + c + length - 1] for s, c in zip(start.tolist(), count[keep].tolist(), strict=True)]
            rows = pa.array(doc[keep])
            yield pa.RecordBatch.from_arrays(
                [pa.array(value[anchor[keep]].view(np.int64)), pa.array(pieces, pa.binary()), batch.column("doc_id").take(rows),
                 batch.column("digest").take(rows), pa.array(start - bounds[doc[keep]])],
                ["anchor", "piece", "doc_id", "digest", "start"])

    return run


def suffix_ranks(data: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """Rank of each suffix when sorted by its first ``depth`` bytes; equal prefixes share a rank.

    Refined eight bytes at a time; only suffixes whose prefix is still shared are looked at again.
    """
    rank = np.zeros(len(starts), dtype=np.int64)
    live = np.arange(len(starts))
    for at in range(0, depth, 8):
        if len(live) < 2:
            break
        width = min(8, depth - at)
        key = np.zeros((len(live), 8), dtype=np.uint8)
        key[:, :width] = data[(starts[live] + at)[:, None] + np.arange(width)]
        key = key.view(">u8").ravel().astype(np.uint64)
        order = np.lexsort((key, rank[live]))
        live, key = live[order], key[order]
        group = rank[live]
        new = np.ones(len(live), dtype=bool)
        new[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        head = np.flatnonzero(new)
        base = np.ones(len(live), dtype=bool)
        base[1:] = group[1:] != group[:-1]
        origin = np.flatnonzero(base)
        within = head - origin[np.searchsorted(origin, head, side="right") - 1]
        size = np.diff(head, append=len(live))
        rank[live] = np.repeat(group[head] + within, size)
        live = live[np.repeat(size > 1, size)]
    return rank


def has_earlier(rank: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Whether LPF reaches the depth: a previous or next smaller position exists among equal ranks."""
    n = len(rank)
    order = np.argsort(rank, kind="stable")
    block = np.cumsum(np.diff(rank[order], prepend=rank[order[:1]]) != 0)
    p = position[order].astype(np.int64)
    ahead = p - block * n
    psv = np.minimum.accumulate(ahead) < ahead
    behind = (p + block * n)[::-1]
    nsv = (np.minimum.accumulate(behind) < behind)[::-1]
    out = np.zeros(n, dtype=bool)
    out[order] = psv | nsv
    return out


_SPAN = "doc_id long, digest long, start long, stop long"


def _repeats(length: int):
    """Spans that an earlier segment of the same anchor covers; all segments of an anchor are in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Table] = []
        for part in _by_anchor(batches):
            waiting.append(part)
            if sum(w.num_rows for w in waiting) >= HOT:
                yield from solve(pa.concat_tables(waiting))
                waiting = []
        if waiting:
            yield from solve(pa.concat_tables(waiting))

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        data, bounds = joined(table.column("piece"))
        count = np.diff(bounds) - length + 1
        piece = np.repeat(np.arange(len(count)), count)
        offset = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
        rank = suffix_ranks(data, bounds[piece] + offset, length)
        start = table.column("start").to_numpy()[piece] + offset
        doc = table.column("doc_id").fill_null(-(2**63)).to_numpy()
        digest = table.column("digest").to_numpy()
        order = np.lexsort((start, digest[piece], doc[piece]))
        position = np.empty(len(order), dtype=np.int64)
        position[order] = np.arange(len(order))
        hit = np.flatnonzero(has_earlier(rank, position)) if len(rank) else np.zeros(0, np.int64)
        if not len(hit):
            return
        new = np.ones(len(hit), dtype=bool)
        new[1:] = (piece[hit[1:]] != piece[hit[:-1]]) | (offset[hit[1:]] != offset[hit[:-1]] + 1)
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(hit)) - 1
        rows = pa.array(piece[hit[head]])
        yield from pa.table({
            "doc_id": table.column("doc_id").take(rows), "digest": table.column("digest").take(rows),
            "start": start[hit[head]], "stop": start[hit[tail]] + length,
        }).to_batches()

    return run


def _by_anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows, cut so that no anchor is in two tables; anchors with one segment have no match."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        anchor = rest.column("anchor").to_numpy()
        last = int(np.searchsorted(anchor, anchor[-1])) if len(anchor) else 0
        if last:
            yield _shared(rest.slice(0, last))
            rest = rest.slice(last)
    if rest is not None and rest.num_rows:
        yield _shared(rest)


def _shared(table: pa.Table) -> pa.Table:
    anchor = table.column("anchor").to_numpy()
    _, index, times = np.unique(anchor, return_inverse=True, return_counts=True)
    return table.filter(pa.array(times[index] > 1))


def _result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        out: dict[str, list] = {"doc_id": batch.column("doc_id"), "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "spans": []}
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            raw = (text or "").encode("utf-8")
            merged: list[list[int]] = []
            for s in sorted((s["start"], s["stop"]) for s in spans or []):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(list(s))
            kept, at = hashlib.sha256(), 0
            for s, e in merged:
                kept.update(raw[at:s])
                at = e
            kept.update(raw[at:])
            out["n_bytes"].append(len(raw))
            out["n_removed"].append(sum(e - s for s, e in merged))
            out["n_spans"].append(len(merged))
            out["kept_sha256"].append(kept.hexdigest())
            out["spans"].append([{"start": s, "stop": e} for s, e in merged])
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [out["doc_id"], *(pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")),
             pa.array(out["kept_sha256"], pa.string()), pa.array(out["spans"], spans_type)], list(out))


def _text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def _same_row(a: str, b: str, *keys: str):
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return on


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, digest, spans): the byte runs of each text that start earlier too; digest tells repeated ids apart."""
    spark = steady(docs.sparkSession)
    texts = _text(docs)
    counted = texts.mapInArrow(_anchors(length, gram, False), "anchor long, times long")
    twice = counted.groupBy("anchor").agg(F.sum("times").alias("times")).where("times > 1").select("anchor")
    flagged = cut_lineage(
        texts.mapInArrow(_anchors(length, gram, True), "anchor long, doc_id long").join(twice, "anchor")
        .groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors")))

    digested = texts.withColumn("digest", F.xxhash64("text")).alias("t")
    held = digested.join(flagged.alias("f"), _same_row("t", "f", "doc_id")).select("t.doc_id", "t.digest", "t.text", "f.anchors")
    segments = cut_lineage(
        held.mapInArrow(_segments(length, gram), "anchor long, piece binary, doc_id long, digest long, start long")
        .withColumn("print", F.xxhash64("piece")))
    firsts = cut_lineage(
        segments.groupBy("anchor", "piece").agg(
            F.min(F.struct("doc_id", "digest", "start")).alias("first"), F.count(F.lit(1)).alias("copies"))
        .select("anchor", "piece", F.xxhash64("piece").alias("print"), "first.*", "copies"))

    copied = firsts.where("copies > 1").select(
        "anchor", "print", F.struct("doc_id", "digest", "start").alias("first"), (F.length("piece")).alias("size"))
    copies = (
        segments.drop("piece").join(copied, ["anchor", "print"])
        .where(~F.struct("doc_id", "digest", "start").eqNullSafe(F.col("first")))
        .select("doc_id", "digest", "start", (F.col("start") + F.col("size")).alias("stop")))

    crowded = firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("pieces")).where(F.col("pieces") > HOT).select("anchor")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = ["anchor", "piece", "doc_id", "digest", "start"]
    sorted_apart = (
        firsts.join(crowded, "anchor", "left_anti").select(*columns).repartition(parts, "anchor")
        .sortWithinPartitions("anchor").mapInArrow(_repeats(length), _SPAN))
    strings = (
        firsts.join(crowded, "anchor", "left_semi")
        .select("doc_id", "digest", "start", "piece", F.explode(F.sequence(F.lit(0), F.length("piece") - length)).alias("offset"))
        .select("doc_id", "digest", (F.col("start") + F.col("offset")).alias("start"),
                F.expr(f"substring(piece, offset + 1, {length})").alias("string")))
    earliest = (
        strings.groupBy("string").agg(F.min(F.struct("doc_id", "digest", "start")).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").drop("n"))
    split_apart = (
        strings.join(earliest, "string").where(~F.struct("doc_id", "digest", "start").eqNullSafe(F.col("first")))
        .select("doc_id", "digest", "start", (F.col("start") + length).alias("stop")))
    found = cut_lineage(
        copies.unionByName(sorted_apart).unionByName(split_apart)
        .groupBy("doc_id", "digest").agg(F.collect_list(F.struct("start", "stop")).alias("spans")))
    for used in (flagged, segments, firsts):
        drop_written(used)
    return found


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row for each row of ``docs``: sizes, maximal removed runs and the digest of what is left."""
    found = repeated_spans(docs, length, gram).alias("s")
    texts = _text(docs).withColumn("digest", F.xxhash64("text")).alias("t")
    both = texts.join(found, _same_row("t", "s", "doc_id", "digest"), "left").select("t.doc_id", "t.text", "s.spans")
    return both.mapInArrow(
        _result, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, stop: long>>")
