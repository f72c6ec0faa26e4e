"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is the set of digests of its paragraphs, repeated ones told apart by their number. Lines are the paragraphs;
long ones are cut after a sentence end and after words picked by their hash, so a text of one line
has several too and an edit leaves the others alone. Every digest goes to three cells, each with a
count, an exclusive-or of digests and one of their checks. Cells of two versions subtract, and peeling
(a cell with one digest gives it away, which frees others) recovers the paragraphs that differ.
When cells are left over, the sketches are made again with twice as many, until they are not.

The published fingerprint has ``CELLS`` cells whatever the text; larger ones exist only while two texts
are compared. Likeness is the share of paragraphs that do not differ.

The next document in descending doc_id comes from a range partition of the ids, one shuffle of the
texts: the largest id of each range is also sent to the range above, which is all that a task needs
from outside. Only the cuts and these ids, one for each partition, pass the driver.

Cases: null text is empty; empty texts have an empty fingerprint and are alike (1.0); one document is its own next;
a null doc_id comes last; rows that repeat a doc_id are ordered by their text's hash, so ties
have one order; repeated rows give repeated rows; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from perpflow.llm.text import BATCH_BYTES, joined, mixed, power, steady, words

CELLS = 24
_WORD_BASE = 0x9E3779B97F4A7C15
_WORD_INVERSE = pow(_WORD_BASE, -1, 2**64)
_CHECK = np.uint64(0xD6E8FEB86659FD93)
_SALTS = np.array([0x2545F4914F6CDD1D, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


def paragraphs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, digest) of every paragraph; the digests of one text are all different."""
    data, bounds = joined(pa.array(texts, pa.string()))
    starts, ends, word, owner = words(data, bounds, lower=False)
    if not len(word):
        return owner, word
    closing = np.isin(data[ends - 1], np.frombuffer(b".!?", dtype=np.uint8)) | (word % np.uint64(8) == 0)
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    closing[:-1] |= (owner[1:] != owner[:-1]) | (lines[starts[1:]] != lines[ends[:-1]])
    closing[-1] = True
    last = np.flatnonzero(closing) + 1
    first = np.concatenate([[0], last[:-1]])
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(word * power(_WORD_BASE, len(word)), dtype=np.uint64)])
    digest = mixed((total[last] - total[first]) * power(_WORD_INVERSE, len(word))[first] + (last - first).astype(np.uint64))
    of = owner[first]
    order = np.lexsort((digest, of))
    o, d = of[order], digest[order]
    new = np.ones(len(o), dtype=bool)
    new[1:] = (o[1:] != o[:-1]) | (d[1:] != d[:-1])
    head = np.flatnonzero(new)
    again = np.arange(len(o)) - np.repeat(head, np.diff(head, append=len(o)))
    return o, np.where(again > 0, mixed(d + again.astype(np.uint64) * _CHECK), d)


def _places(digest: np.ndarray, cells: int) -> np.ndarray:
    part = cells // 3
    return np.stack([np.uint64(j * part) + mixed(digest ^ s) % np.uint64(part) for j, s in enumerate(_SALTS)]).astype(np.int64)


def sketch(owner: np.ndarray, digest: np.ndarray, n: int, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, digests and checks of n sketches, (n, cells) each."""
    count, key, check = np.zeros(n * cells, np.int64), np.zeros(n * cells, np.uint64), np.zeros(n * cells, np.uint64)
    tested = mixed(digest ^ _CHECK)
    for place in _places(digest, cells):
        at = owner * cells + place
        np.add.at(count, at, 1)
        np.bitwise_xor.at(key, at, digest)
        np.bitwise_xor.at(check, at, tested)
    return count.reshape(n, cells), key.reshape(n, cells), check.reshape(n, cells)


def peel(count: np.ndarray, key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of digests recovered from each difference of sketches, and whether that is all of them."""
    n, cells = count.shape
    count, key, check = count.ravel().copy(), key.ravel().copy(), check.ravel().copy()
    found = np.zeros(n, np.int64)
    for _ in range(4 * cells):
        at = np.flatnonzero(np.abs(count) == 1)
        at = at[check[at] == mixed(key[at] ^ _CHECK)]
        if not len(at):
            break
        owner, digest, sign = at // cells, key[at], count[at]
        order = np.lexsort((digest, owner))
        owner, digest, sign = owner[order], digest[order], sign[order]
        new = np.ones(len(owner), dtype=bool)
        new[1:] = (owner[1:] != owner[:-1]) | (digest[1:] != digest[:-1])
        owner, digest, sign = owner[new], digest[new], sign[new]
        found += np.bincount(owner, minlength=n)
        tested = mixed(digest ^ _CHECK)
        for place in _places(digest, cells):
            np.subtract.at(count, owner * cells + place, sign)
            np.bitwise_xor.at(key, owner * cells + place, digest)
            np.bitwise_xor.at(check, owner * cells + place, tested)
    left = (count != 0) | (key != 0) | (check != 0)
    return found, ~left.reshape(n, cells).any(axis=1)


def _some(owner: np.ndarray, digest: np.ndarray, which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The paragraphs of the texts listed, renumbered."""
    number = np.full(n, -1)
    number[which] = np.arange(len(which))
    keep = number[owner] >= 0
    return number[owner[keep]], digest[keep]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], n: int, cells: int = CELLS) -> np.ndarray:
    """Share of paragraphs that agree between the i-th text of a and of b."""
    total = np.bincount(a[0], minlength=n) + np.bincount(b[0], minlength=n)
    differ, todo = np.zeros(n, np.int64), np.arange(n)
    while len(todo):
        x, y = (sketch(*_some(*s, todo, n), len(todo), cells) for s in (a, b))
        found, whole = peel(x[0] - y[0], x[1] ^ y[1], x[2] ^ y[2])
        differ[todo[whole]] = found[whole]
        todo = todo[~whole]
        cells *= 2
    return np.where(total > 0, 1 - differ / np.maximum(total, 1), 1.0)


def _prints(owner: np.ndarray, digest: np.ndarray, n: int) -> list[str]:
    count, key, check = sketch(owner, digest, n, CELLS)
    many = np.bincount(owner, minlength=n)
    raw = np.concatenate(
        [count.astype("<u4").view(np.uint8).reshape(n, -1), key.astype("<u8").view(np.uint8).reshape(n, -1),
         (check >> np.uint64(32)).astype("<u4").view(np.uint8).reshape(n, -1)], axis=1)
    return [f"{m}:{base64.b64encode(r.tobytes()).decode()}" for m, r in zip(many.tolist(), raw, strict=True)]


def edited_text(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the next document as there is."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(rows: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
    texts, nexts = [r[1] for r in rows], [r[2] for r in rows]
    changed = [edited_text(t, n) for t, n in zip(texts, nexts, strict=True)]
    own, edit, following = paragraphs(texts), paragraphs(changed), paragraphs(nexts)
    n = len(rows)
    return pa.RecordBatch.from_arrays([
        pa.array([r[0] for r in rows], pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(c.encode("utf-8")).hexdigest() for c in changed], pa.string()),
        pa.array(_prints(*own, n), pa.string()), pa.array(_prints(*edit, n), pa.string()),
        pa.array(likeness(own, edit, n)), pa.array(likeness(own, following, n)),
    ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by range, own rows in order and then the one from outside; each is compared with the row after it."""
    waiting, size, last = [], 0, None
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("part", "outside", "doc_id", "text"))
        for part, outside, doc_id, text in zip(*columns, strict=True):
            if last is not None and last[0] == part:
                waiting.append((last[1], last[2], text))
                size += 2 * len(last[2]) + len(text)
                if size > BATCH_BYTES:
                    yield _compare(waiting)
                    waiting, size = [], 0
            last = None if outside else (part, doc_id, text)
    if waiting:
        yield _compare(waiting)


def _range_of(value: Column, cuts: list[int], low: int, high: int) -> Column:
    """Number of cuts below the value, by halving."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(value > F.lit(cuts[middle]), _range_of(value, cuts, middle + 1, high)).otherwise(_range_of(value, cuts, low, middle))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text and of its edited text, and their likeness to each other and to the next document."""
    spark = steady(docs.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lowest = F.lit(-(2**63))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = F.coalesce("doc_id", lowest)
    cuts = rows.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)] or [0.5], 10 * parts)).first()[0] or []
    cuts = sorted(set(cuts))
    part = _range_of(order, cuts, 0, len(cuts))
    tops = rows.groupBy(part.alias("part")).agg(F.max(order).alias("top")).orderBy("part").collect()
    above = [(t.top, tops[(i + 1) % len(tops)].part) for i, t in enumerate(tops)]
    sent = spark.createDataFrame(above, "top long, target int")
    own = F.struct(part.alias("part"), F.lit(False).alias("outside"))
    to = F.when(F.col("target").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("target").alias("part"), F.lit(True).alias("outside"))))
    # One row for each range, so broadcasting it is safe and keeps the texts to one shuffle.
    dealt = rows.join(F.broadcast(sent), order == F.col("top"), "left").select("doc_id", "text", F.explode(to).alias("to")).select("to.part", "to.outside", "doc_id", "text")
    return (
        dealt.repartition(parts, "part").sortWithinPartitions("part", "outside", F.desc(order), F.xxhash64("text"))
        .mapInArrow(_stream, _SCHEMA))
