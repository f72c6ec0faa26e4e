"""Fuzzy passages that repeat across documents, by collinear chaining of shared k-mer seeds.

1. Seeds: of the hashes of ``K`` words, those that are the smallest of ``K`` neighbours. Two exact runs of
   2 K - 1 words share one, and seeds in an exact run leave no word uncovered.
2. Every seed that occurs in several documents is matched to its first occurrence (smallest doc_id, then position):
   a fold before the shuffle and one join, so matches grow with the seeds and never with their pairs.
3. For each pair of a document and such a source, matches on one diagonal become segments, and
   ordered segments become chains: the best predecessor under a linear gap cost is a prefix maximum in a
   Fenwick tree over positions in the source.
4. Chains are aligned on the words themselves: segments are extended while words agree, and gaps between
   them get a longest common subsequence. A stretch below ``IDENTITY`` is split into its longest parts of that identity and what is between.
   For that a document's text meets its matches once, and chains go to their source in blocks: stretches of a document that overlap travel
   once, and a source's text once for ``BLOCK_WORDS`` words. A source of any number of chains is many rows, which the join may deal out.
5. Aligned pieces of one document that touch (``APART`` words between them at most) are a union, whichever sources they come from.
   Each word counts as much as the best piece over it, words between pieces nothing. A union of ``MIN_WORDS`` words and of ``IDENTITY``
   or more is a passage; of other unions the longest runs of pieces that are. The first occurrence stays.

Cases: null text is empty; texts under ``K`` words have no seeds; a repeat inside one document does not
count; rows that repeat a doc_id are one document, and each of its texts is aligned on its own; rows without a doc_id are
left alone; ties between sources go to the smallest doc_id; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from perpflow.llm.text import BATCH_BYTES, grams, joined, minimizers, slices, steady, words
from perpflow.session import cut_lineage, drop_written

K = 8
GAP_COST = 0.15
MIN_WORDS = 40
IDENTITY = 0.8
#: A chain with a gap of more words than this on either side is aligned as two stretches.
GAP_MOST = 24
#: Stretches of one document with this many words between them, or fewer, are one passage.
APART = 3
#: Bytes of texts and matches that a task takes chains of at once, pieces that it joins at once.
HELD_BYTES, HELD_ROWS = 4_000_000, 20_000
#: Words of documents that go with one copy of their source's text.
BLOCK_WORDS = 8192


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        data, bounds = joined(batch.column("text"))
        _, _, word, owner = words(data, bounds)
        value, at = grams(word, owner, K)
        picked = minimizers(value, owner[at], K)
        at, value = at[picked], value[picked]
        first = np.searchsorted(owner, np.arange(len(bounds) - 1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(value.view(np.int64)), batch.column("doc_id").take(pa.array(owner[at])), pa.array((at - first[owner[at]]).astype(np.int32))],
            ["seed", "doc_id", "at"])


class Fenwick:
    """Prefix maxima of (value, index) over positions 0 .. n-1."""

    def __init__(self, n: int):
        self.tree = [(-np.inf, -1)] * (n + 1)

    def put(self, i: int, value: float, index: int) -> None:
        i += 1
        while i < len(self.tree):
            if value > self.tree[i][0]:
                self.tree[i] = (value, index)
            i += i & -i

    def best(self, i: int) -> tuple[float, int]:
        """Of positions up to i."""
        out, i = (-np.inf, -1), i + 1
        while i > 0:
            if self.tree[i][0] > out[0]:
                out = self.tree[i]
            i -= i & -i
        return out


def chains(x: np.ndarray, y: np.ndarray, size: np.ndarray, gap_cost: float = GAP_COST) -> list[list[int]]:
    """Collinear chains of segments (x, y, size), each segment in one chain, best chains first.

    A predecessor must end before the segment starts on both sides; score = words - gap_cost * words skipped.
    """
    n = len(x)
    if n == 1:
        return [[0]]
    ends = np.unique(y + size)
    tree = Fenwick(len(ends))
    starts = np.argsort(x, kind="stable")
    closing = np.argsort(x + size, kind="stable")
    score, before, closed = np.zeros(n), np.full(n, -1), 0
    for i in starts.tolist():
        while closed < n and x[closing[closed]] + size[closing[closed]] <= x[i]:
            j = int(closing[closed])
            tree.put(int(np.searchsorted(ends, y[j] + size[j])), score[j] + gap_cost * (x[j] + y[j] + 2 * size[j]), j)
            closed += 1
        value, j = tree.best(int(np.searchsorted(ends, y[i], side="right")) - 1)
        gain = value - gap_cost * (x[i] + y[i])
        score[i] = size[i] + max(gain, 0.0)
        before[i] = j if gain > 0 else -1
    taken, out = np.zeros(n, dtype=bool), []
    for i in np.argsort(-score, kind="stable").tolist():
        chain = []
        while i >= 0 and not taken[i]:
            taken[i] = True
            chain.append(i)
            i = int(before[i])
        if chain:
            out.append(chain[::-1])
    return out


def _chain_pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """The chains of matches that come sorted by (doc_id, source)."""
    doc, source, x, y = (table.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "source", "at", "source_at"))
    pair = np.cumsum(np.concatenate([[False], (doc[1:] != doc[:-1]) | (source[1:] != source[:-1])]))
    order = np.lexsort((x, y - x, pair))
    p, a, d = pair[order], x[order], (y - x)[order]
    new = np.ones(len(p), dtype=bool)
    new[1:] = (p[1:] != p[:-1]) | (d[1:] != d[:-1]) | (a[1:] > a[:-1] + K)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(p)) - 1
    p, x, size, y = p[head], a[head], a[tail] - a[head] + K, a[head] + d[head]
    row = order[head]
    start = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
    # Where every segment ends behind the last start on either side, none has a predecessor. A run of one word is thousands of these.
    alone = np.minimum.reduceat(x + size, start) > np.maximum.reduceat(x, start)
    alone |= np.minimum.reduceat(y + size, start) > np.maximum.reduceat(y, start)
    stop = np.append(start[1:], len(p))
    lone = np.flatnonzero(np.repeat(alone, stop - start))
    made, lengths = [lone], [np.ones(len(lone), dtype=np.int64)]
    for i in np.flatnonzero(~alone).tolist():
        found = chains(x[start[i] : stop[i]], y[start[i] : stop[i]], size[start[i] : stop[i]])
        made.append(start[i] + np.array([k for chain in found for k in chain], dtype=np.int64))
        lengths.append(np.array([len(chain) for chain in found], dtype=np.int64))
    segment, offsets = np.concatenate(made), np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
    row = row[segment[offsets[:-1]]]
    at = pa.array(offsets.astype(np.int32))
    yield pa.RecordBatch.from_arrays(
        [pa.array(doc[row]), pa.array(source[row]), *(pa.ListArray.from_arrays(at, pa.array(v[segment].astype(np.int32))) for v in (x, y, size))],
        ["doc_id", "source", "x", "y", "size"])


def _common(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A longest common subsequence of two short runs of words, as positions in both."""
    if not len(a) or not len(b):
        return []
    table = np.zeros((len(a) + 1, len(b) + 1), dtype=np.int64)
    for i, w in enumerate(a):
        row = table[i + 1]
        row[1:] = np.maximum(table[i, 1:], table[i, :-1] + (b == w))
        np.maximum.accumulate(row, out=row)
    i, j, out = len(a), len(b), []
    while i and j:
        if table[i, j] == table[i - 1, j]:
            i -= 1
        elif table[i, j] == table[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


Piece = tuple[int, int, int, int, int]


def align(doc: np.ndarray, source: np.ndarray, x: list[int], y: list[int], size: list[int], identity: float = IDENTITY) -> list[Piece]:
    """(start, stop, source start, source stop, words that agree) of the pieces of each stretch of a chain, judged on word hashes."""
    x, y, size = (np.array(v, dtype=np.int64) for v in (x, y, size))
    if x[-1] + size[-1] > len(doc) or y[-1] + size[-1] > len(source):
        return []
    gaps = np.maximum(x[1:] - x[:-1] - size[:-1], y[1:] - y[:-1] - size[:-1])
    cuts = np.concatenate([[0], np.flatnonzero(gaps > GAP_MOST) + 1, [len(x)]])
    return [p for a, b in zip(cuts[:-1], cuts[1:], strict=True) for p in pieces(*_stretch(doc, source, x[a:b], y[a:b], size[a:b]), identity)]


def _stretch(doc: np.ndarray, source: np.ndarray, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[int, int, int, int]]:
    """The words that agree, as positions in both, and the bounds."""
    left, left_y, before = extend(doc[: x[0]][::-1], source[: y[0]][::-1])
    right, right_y, after = extend(doc[x[-1] + size[-1] :], source[y[-1] + size[-1] :])
    px, py = [x[0] - 1 - before[0][::-1]], [y[0] - 1 - before[1][::-1]]
    for i, (a, b, n) in enumerate(zip(x.tolist(), y.tolist(), size.tolist(), strict=True)):
        same = np.flatnonzero(doc[a : a + n] == source[b : b + n])
        px.append(a + same)
        py.append(b + same)
        if i + 1 < len(x):
            both = np.array(_common(doc[a + n : x[i + 1]], source[b + n : y[i + 1]]), dtype=np.int64).reshape(-1, 2)
            px.append(a + n + both[:, 0])
            py.append(b + n + both[:, 1])
    px.append(x[-1] + size[-1] + after[0])
    py.append(y[-1] + size[-1] + after[1])
    bounds = int(x[0]) - left, int(x[-1] + size[-1]) + right, int(y[0]) - left_y, int(y[-1] + size[-1]) + right_y
    return np.concatenate(px), np.concatenate(py), bounds


def pieces(px: np.ndarray, py: np.ndarray, bounds: tuple[int, int, int, int], identity: float = IDENTITY) -> list[Piece]:
    """The whole stretch if it has the identity, or else its longest part that has, and the same on both sides of it."""
    out, todo = [], [(px, py, *bounds)]
    while todo:
        px, py, x0, x1, y0, y1 = todo.pop()
        n = len(px)
        if x1 <= x0:
            continue
        if n >= identity * max(x1 - x0, y1 - y0) - 1e-9 or n < K:
            out.append((x0, x1, y0, y1, n))
            continue
        at = np.arange(n)
        u, v, spare = at - identity * px, at - identity * py, 1 - identity + 1e-9
        best, i, j = -1, 0, 0
        for k in range(n):
            if px[-1] - px[k] <= best:
                break
            last = k + int(np.flatnonzero((u[k:] + spare >= u[k]) & (v[k:] + spare >= v[k]))[-1])
            if px[last] - px[k] > best:
                best, i, j = int(px[last] - px[k]), k, last
        a, b, c, d = int(px[i]), int(px[j]) + 1, int(py[i]), int(py[j]) + 1
        if b - a < K:
            out.append((x0, x1, y0, y1, n))
            continue
        out.append((a, b, c, d, j - i + 1))
        todo += [(px[:i], py[:i], x0, a, y0, c), (px[j + 1 :], py[j + 1 :], b, x1, d, y1)]
    return sorted(out)


def extend(a: np.ndarray, b: np.ndarray, after: int = 3) -> tuple[int, int, tuple[np.ndarray, np.ndarray]]:
    """Words of a and b that go on agreeing, and which agree: one changed, added or missing word is passed over when ``after`` agree behind it."""
    i = j = 0
    runs = []
    while True:
        n = min(len(a) - i, len(b) - j)
        differ = np.flatnonzero(a[i : i + n] != b[j : j + n])
        run = int(differ[0]) if len(differ) else n
        runs.append((np.arange(i, i + run), np.arange(j, j + run)))
        i, j = i + run, j + run
        for di, dj in ((1, 1), (1, 0), (0, 1)):
            x, y = a[i + di : i + di + after], b[j + dj : j + dj + after]
            if len(x) == after == len(y) and (x == y).all():
                i, j = i + di, j + dj
                break
        else:
            return i, j, (np.concatenate([r[0] for r in runs]), np.concatenate([r[1] for r in runs]))


def _distinct_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of the different texts end to end, and where those of each row begin and end; joins repeat a text for each chain."""
    coded = texts.dictionary_encode()
    data, bounds = joined(coded.dictionary)
    _, _, word, owner = words(data, bounds)
    first = np.searchsorted(owner, np.arange(len(bounds)))
    row = coded.indices.to_numpy()
    return word, first[row], first[row + 1]


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column end to end, and where each row begins (one more at the end)."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy(), offsets - offsets[0]


def _bounds(x: np.ndarray, y: np.ndarray, size: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of the document that each chain may need and the one behind the last: as many around it as the source could still add."""
    head, tail = at[:-1], at[1:] - 1
    start = np.minimum(np.maximum(0, x[head] - np.minimum(y[head], 4 * K)).astype(np.int64), length)
    return start, np.maximum(start, np.minimum(x[tail].astype(np.int64) + size[tail] + 4 * K, length))


def _spans(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """All indices of the ranges, one range after the other."""
    ends = np.cumsum(stop - start)
    return np.repeat(stop - ends, stop - start) + np.arange(int(ends[-1]) if len(ends) else 0)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the document around each chain, as hashes: the plain way, a row a chain. ``_blocks`` ships the same words and is tested against it."""
    for batch in slices(batches):
        word, begin, end = _distinct_words(batch.column("text"))
        (x, at), (y, _), (size, _) = (_flat(batch.column(c)) for c in ("x", "y", "size"))
        start, stop = _bounds(x, y, size, at, end - begin)
        ends = np.concatenate([[0], np.cumsum(stop - start)])
        part = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(word[_spans(begin + start, begin + stop)].view(np.int64)))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "source", "x", "y", "size")), pa.array(start.astype(np.int32)), part],
            ["doc_id", "source", "x", "y", "size", "first", "words"])


_BLOCK = ("source long, doc_id array<long>, segments array<int>, x array<int>, y array<int>, size array<int>, "
          "first array<int>, place array<int>, length array<int>, words array<long>")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by doc_id, the texts of a document before its matches; a document is held until its last row is there."""
    held, size, most = [], 0, HELD_BYTES
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size < most:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        doc = table.column("doc_id").to_numpy()
        last = int(np.searchsorted(doc, doc[-1]))
        yield from _block(table.slice(0, last))
        held = table.slice(last).to_batches()
        size = sum(b.nbytes for b in held)
        most = max(HELD_BYTES, 2 * size)
    if held:
        yield from _block(pa.Table.from_batches(held).combine_chunks())


def _block(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """One row for each source of these documents, or more if the words its chains need are many."""
    is_text = table.column("source").is_null()
    matches, texts = table.filter(pc.invert(is_text)), table.filter(is_text)
    if not matches.num_rows:
        return
    texts = texts.filter(pa.array(np.isin(texts.column("doc_id").to_numpy(), matches.column("doc_id").to_numpy())))
    text_doc, word, length = texts.column("doc_id").to_numpy(), [], []
    for batch in slices(iter(texts.combine_chunks().to_batches())):
        data, bounds = joined(batch.column("text"))
        _, _, hashes, owner = words(data, bounds)
        word.append(hashes)
        length.append(np.bincount(owner, minlength=batch.num_rows))
    word, length = np.concatenate(word), np.concatenate(length)
    first = np.cumsum(length) - length
    for batch in _chain_pairs(matches):
        doc, source = batch.column("doc_id").to_numpy(), batch.column("source").to_numpy()
        (x, at), (y, _), (size, _) = (_flat(batch.column(c)) for c in ("x", "y", "size"))
        # A chain meets each text of its document, and takes the place of its words in all words here.
        low = np.searchsorted(text_doc, doc)
        times = np.searchsorted(text_doc, doc, side="right") - low
        chain, text = np.repeat(np.arange(len(doc)), times), _spans(low, low + times)
        segment = _spans(at[chain], at[chain + 1])
        x, y, size, at = x[segment], y[segment], size[segment], np.concatenate([[0], np.cumsum(at[chain + 1] - at[chain])])
        start, stop = _bounds(x, y, size, at, length[text])
        low, high = first[text] + start, first[text] + stop
        order = np.lexsort((low, source[chain]))
        chain, text, low, high, start = chain[order], text[order], low[order], high[order], start[order]
        segments = (at[1:] - at[:-1])[order]
        segment = _spans(at[:-1][order], at[1:][order])
        doc, source = doc[chain], source[chain]
        # Stretches that overlap are shipped once.
        shift = np.cumsum(np.concatenate([[0], source[1:] != source[:-1]])) * (len(word) + 1)
        reach = np.maximum.accumulate(shift + high)
        new = np.concatenate([[True], (shift + low)[1:] > reach[:-1]])
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(low)) - 1
        part = np.cumsum(new) - 1
        width = reach[tail] - shift[tail] - low[head]
        offset = np.cumsum(width) - width
        base = offset[np.searchsorted(shift[head], shift[head])]
        block = (offset - base) // BLOCK_WORDS
        row_head = np.flatnonzero(np.concatenate([[True], (shift[head][1:] != shift[head][:-1]) | (block[1:] != block[:-1])]))
        row_words, row_chains = np.append(offset[row_head], width.sum()), np.append(head[row_head], len(low))
        row_segments = np.concatenate([[0], np.cumsum(segments)])[row_chains]
        place = offset[part] + low - low[head][part]
        place -= np.repeat(row_words[:-1], np.diff(row_chains))
        needed = word[_spans(low[head], low[head] + width)].view(np.int64)

        def lists(offsets: np.ndarray, values: np.ndarray, kind=np.int32) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(kind)))

        made = pa.RecordBatch.from_arrays(
            [pa.array(source[row_chains[:-1]]), lists(row_chains, doc, np.int64), lists(row_chains, segments),
             *(lists(row_segments, v[segment]) for v in (x, y, size)), lists(row_chains, start), lists(row_chains, place),
             lists(row_chains, high - low), lists(row_words, needed, np.int64)],
            ["source", "doc_id", "segments", "x", "y", "size", "first", "place", "length", "words"])
        for i in range(0, made.num_rows, 512):
            yield made.slice(i, 512)


def extend_all(doc: np.ndarray, source: np.ndarray, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray, step: int,
               after: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``extend`` of many rows at once: words passed on both sides, and how many agree.

    Row r goes on from doc[a[r]] and source[b[r]] by ``step`` (1 or -1), up to a_end[r] and b_end[r], which do not count.
    """
    i, j, agree = (np.zeros(len(a), dtype=np.int64) for _ in range(3))
    la, lb = (a_end - a) * step, (b_end - b) * step

    def same(rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = (i < la[rows]) & (j < lb[rows])
        ok = rows[out]
        out[out] = doc[a[ok] + step * i[out]] == source[b[ok] + step * j[out]]
        return out

    rows = np.arange(len(a))
    while len(rows):
        goes = same(rows, i[rows], j[rows])
        on, stuck = rows[goes], rows[~goes]
        i[on] += 1
        j[on] += 1
        agree[on] += 1
        passed = []
        for di, dj in ((1, 1), (1, 0), (0, 1)):
            good = np.ones(len(stuck), dtype=bool)
            for k in range(after):
                good[good] = same(stuck[good], i[stuck[good]] + di + k, j[stuck[good]] + dj + k)
            i[stuck[good]] += di
            j[stuck[good]] += dj
            passed.append(stuck[good])
            stuck = stuck[~good]
        rows = np.concatenate([on, *passed])
    return i, j, agree


def _aligned(identity: float):
    names = ["doc_id", "source", "start", "stop", "source_start", "source_stop", "agree"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=4 * BATCH_BYTES):
            doc, chains_at = _flat(batch.column("doc_id"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(chains_at))
            source = batch.column("source").to_numpy()[row]
            (x, _), (y, _), (size, _) = (_flat(batch.column(c)) for c in ("x", "y", "size"))
            segments, begin, place, length = (_flat(batch.column(c))[0].astype(np.int64) for c in ("segments", "first", "place", "length"))
            at = np.concatenate([[0], np.cumsum(segments)])
            mine, words_at = _flat(batch.column("words"))
            mine = mine.view(np.uint64)
            place += words_at[row]
            limit = place + length
            other, low, high = _distinct_words(batch.column("text"))
            low, high = low[row], high[row]
            # One segment, and of the identity as a whole: nearly all of them.
            h, n = at[:-1], size[at[:-1]].astype(np.int64)
            a, b = place + x[h] - begin, low + y[h]
            lone = (segments == 1) & (a + n <= limit) & (b + n <= high)
            r = np.flatnonzero(lone)
            a, b, n = a[r], b[r], n[r]
            left, left_y, before = extend_all(mine, other, a - 1, place[r] - 1, b - 1, low[r] - 1, -1)
            right, right_y, behind = extend_all(mine, other, a + n, limit[r], b + n, high[r], 1)
            equal = mine[_spans(a, a + n)] == other[_spans(b, b + n)]
            agree = before + behind + np.bincount(np.repeat(np.arange(len(r)), n)[equal], minlength=len(r))
            start, stop, y0, y1 = a - left, a + n + right, b - left_y, b + n + right_y
            whole = (agree >= identity * np.maximum(stop - start, y1 - y0) - 1e-9) | (agree < K)
            q = r[whole]
            shift, base = begin[q] - place[q], low[q]
            made = [doc[q], source[q], start[whole] + shift, stop[whole] + shift, y0[whole] - base, y1[whole] - base, agree[whole]]
            lone[r[~whole]] = False
            rows = []
            for i in np.flatnonzero(~lone).tolist():
                s = slice(at[i], at[i + 1])
                found = align(mine[place[i] : limit[i]], other[low[i] : high[i]], x[s] - begin[i], y[s], size[s], identity)
                rows += [(doc[i], source[i], f[0] + begin[i], f[1] + begin[i], *f[2:]) for f in found]
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([m, np.array(c, dtype=np.int64)])) for m, c in zip(made, columns, strict=True)], names)

    return run


_PASSAGE = "doc_id long, start_word long, stop_word long, identity double, sources array<long>"


def passages(union: list[tuple[int, int, float, int]], least: int, identity: float) -> list[tuple[int, int, float, list[int]]]:
    """(start, stop, identity, sources) of the passages of touching pieces (start, stop, identity, source)."""
    first, end = min(p[0] for p in union), max(p[1] for p in union)
    if end - first < least:
        return []
    worth = np.zeros(end - first)
    for start, stop, share, _ in sorted(union, key=lambda p: p[2]):
        worth[start - first : stop - first] = share
    total = np.concatenate([[0.0], np.cumsum(worth)])
    edges = np.unique([e - first for p in union for e in p[:2]])
    out, todo = [], [(0, len(edges) - 1)]
    while todo:
        a, b = todo.pop()
        at = edges[a : b + 1]
        if at[-1] - at[0] < least:
            continue
        over = total[at] - identity * at
        low, high = np.minimum.accumulate(over), np.maximum.accumulate(over[::-1])[::-1]
        best, i, j, left, right = 0, 0, 0, 0, 0
        while right < len(at):
            if low[left] <= high[right] + 1e-9:
                if at[right] - at[left] > best:
                    best, i, j = at[right] - at[left], left, right
                right += 1
            else:
                left += 1
        if best < least:
            continue
        start, stop = int(at[i]), int(at[j])
        sources = {p[3] for p in union if p[2] >= identity - 1e-9 and p[0] - first < stop and p[1] - first > start}
        out.append((first + start, first + stop, min(1.0, float(total[stop] - total[start]) / (stop - start)), sorted(sources)))
        todo += [(a, a + i), (a + j, b)]
    return sorted(out)


def _merged(least: int, identity: float):
    """Passages of the touching pieces of each document; rows come sorted by (doc_id, start, source)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, most = [], 0, HELD_ROWS
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= most:
                made, rest = unions(pa.Table.from_batches(held), False)
                yield pack(made)
                held, count = rest.to_batches(), rest.num_rows
                most = max(HELD_ROWS, 2 * count)
        yield pack(unions(pa.Table.from_batches(held), True)[0] if count else [])

    def unions(table: pa.Table, over: bool) -> tuple[list, pa.Table]:
        """The passages of all unions (the last one may go on, unless ``over``), and the rows of the one that is left."""
        doc, source, start, stop, y0, y1, agree = (table.column(c).to_numpy() for c in ("doc_id", "source", "start", "stop", "source_start", "source_stop", "agree"))
        share = agree / np.maximum(np.maximum(stop - start, y1 - y0), 1)
        shift = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]])) * (int(stop.max()) + APART + 1)
        reach = np.maximum.accumulate(shift + stop)
        head = np.flatnonzero(np.concatenate([[True], (shift + start)[1:] > reach[:-1] + APART]))
        tail = np.append(head[1:], len(doc))
        last = len(head) if over else len(head) - 1
        long = reach[tail - 1] - shift[tail - 1] - start[head] >= least
        out = []
        for i in np.flatnonzero(long[:last]).tolist():
            s = slice(head[i], tail[i])
            union = list(zip(start[s].tolist(), stop[s].tolist(), share[s].tolist(), source[s].tolist(), strict=True))
            out += [(int(doc[head[i]]), *p) for p in passages(union, least, identity)]
        return out, table.slice(0, 0) if over else table.slice(int(head[-1]))

    def pack(rows: list) -> pa.RecordBatch:
        kinds = pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["doc_id", "start_word", "stop_word", "identity", "sources"])

    return run


def repeated_passages(docs: DataFrame, least: int = MIN_WORDS, identity: float = IDENTITY) -> DataFrame:
    """(doc_id, start_word, stop_word, identity, sources): passages that an earlier document has too, nearly word by word."""
    spark = steady(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where("doc_id IS NOT NULL")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    seeds = texts.mapInArrow(_seeds, "seed long, doc_id long, at int")
    first = (
        seeds.groupBy("seed").agg(F.min(F.struct("doc_id", "at")).alias("f"), F.max("doc_id").alias("last"))
        .where("f.doc_id < last").select("seed", F.col("f.doc_id").alias("source"), F.col("f.at").alias("source_at")))
    # Written, so that the join sees two plain shuffles and can split a seed that very many documents have.
    first = cut_lineage(first)
    matches = seeds.join(first, "seed").where("doc_id > source").select("doc_id", "source", "at", "source_at")
    # A text travels once to all the matches of its document, and once to each block of chains of its source.
    beside = texts.select("doc_id", F.lit(None).cast("long").alias("source"), F.lit(None).cast("int").alias("at"), F.lit(None).cast("int").alias("source_at"), "text")
    blocks = cut_lineage(
        matches.withColumn("text", F.lit(None).cast("string")).unionByName(beside)
        .repartition(parts, "doc_id").sortWithinPartitions("doc_id", "source").mapInArrow(_blocks, _BLOCK))
    lined = blocks.join(texts.withColumnRenamed("doc_id", "source"), "source").mapInArrow(
        _aligned(identity), "doc_id long, source long, start long, stop long, source_start long, source_stop long, agree long")
    lined = cut_lineage(lined)
    for used in (first, blocks):
        drop_written(used)
    return (
        lined.repartition(parts, "doc_id").sortWithinPartitions("doc_id", "start", "source", "stop").mapInArrow(_merged(least, identity), _PASSAGE)
        .withColumn("source_doc_id", F.get("sources", F.lit(0))))
