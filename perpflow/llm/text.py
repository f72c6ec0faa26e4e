"""Shared pieces: Arrow batches cut by bytes, word positions and rolling hashes in numpy.

All hashes are 64 bit and depend on the bytes alone, never on the batch, task or run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

BATCH_BYTES = 500_000

_rng = np.random.default_rng(20240101)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = int(_rng.integers(1, 2**62)) * 4 + 3
_INVERSE = pow(_BASE, -1, 2**64)
_MIX = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[int, np.ndarray] = {}


def steady(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, since a row may be a whole book; shuffle files go when their job ends."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text, and of one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum([0 if n is None else n for n in pc.binary_length(batch.column(column)).to_pylist()])
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, before + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and where each begins (one more at the end); null is empty."""
    data = [b"" if t is None else t if isinstance(t, bytes) else t.encode("utf-8") for t in texts.to_pylist()]
    ends = np.cumsum([0] + [len(d) for d in data], dtype=np.int64)
    return np.frombuffer(b"".join(data), dtype=np.uint8), ends


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits after which every bit depends on every other."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(4096, 1 << (n - 1).bit_length())
        have = np.ones(1, dtype=np.uint64)
        while len(have) < size:
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), 2**64))])
        if size <= 1 << 22:
            _powers[base] = have
    return have[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of data[start:end] for each span, by differences of one running polynomial."""
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * power(_BASE, len(data)), out=total[1:])
    value = (total[ends] - total[starts]) * power(_INVERSE, len(data) + 1)[starts]
    return mixed(value + mixed((ends - starts).astype(np.uint64)))


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """The hash of each window of ``width`` bytes."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * power(_BASE, len(data)), out=total[1:])
    return mixed((total[width:] - total[:-width]) * power(_INVERSE, n))


def words(data: np.ndarray, bounds: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of many texts end to end: byte starts, byte ends, hash, and the text each is in."""
    if lower:
        data = _LOWER[data]
    blank = np.ones(len(data) + 2, dtype=bool)
    blank[1:-1] = _SPACE[data]
    first = ~blank[1:-1] & blank[:-2]
    last = ~blank[1:-1] & blank[2:]
    edge = bounds[(bounds > 0) & (bounds < len(data))]
    first[edge] = ~blank[1:-1][edge]
    last[edge - 1] = ~blank[1:-1][edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    owner = np.searchsorted(bounds, starts, side="right") - 1
    return starts, ends, span_hashes(data, starts, ends), owner


def grams(word: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and index of the first word of every run of ``size`` words inside one text."""
    n = len(word) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    value = np.full(n, size, dtype=np.uint64)
    for i in range(size):
        value += mixed(word[i : i + n] * _MIX[i % len(_MIX)] + np.uint64(i))
    inside = np.flatnonzero(owner[:n] == owner[size - 1 :])
    return mixed(value[inside]), inside


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash), each pair once, sorted: the shingles of each text; short texts have one of all their words."""
    data, bounds = joined(texts)
    _, _, word, owner = words(data, bounds)
    value, at = grams(word, owner, size)
    owners, values = [owner[at]], [value]
    counts = np.bincount(owner, minlength=len(bounds) - 1)
    for n in range(1, size):
        short = np.isin(owner, np.flatnonzero(counts == n))
        v, i = grams(word[short], owner[short], n)
        owners.append(owner[short][i])
        values.append(v)
    o, v = np.concatenate(owners), np.concatenate(values)
    order = np.lexsort((v, o))
    o, v = o[order], v[order]
    new = np.ones(len(o), dtype=bool)
    new[1:] = (o[1:] != o[:-1]) | (v[1:] != v[:-1])
    return o[new], v[new]


def window_minimum(value: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        value = np.minimum(value[:-step] if step else value, value[step:])
        have += step
    return value


def minimizers(value: np.ndarray, owner: np.ndarray, width: int) -> np.ndarray:
    """Indices of values that are the smallest of some ``width`` neighbours of one text (ties all count)."""
    n = len(value) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    least = window_minimum(value, width)
    inside = owner[:n] == owner[width - 1 :]
    padded = np.zeros(len(value) + width - 1, dtype=np.uint64)
    padded[width - 1 : width - 1 + n] = np.where(inside, least, np.uint64(0))
    most = ~window_minimum(~padded, width)
    return np.flatnonzero(most == value)
