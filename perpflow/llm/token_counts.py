"""Token counts by a two-tier table of pre-token lengths, without any shuffle of pre-tokens.

A byte-level BPE never merges over pre-tokens, so a text has as many tokens as its pre-tokens
have. Tier one is a compact table of frequent pre-tokens with their lengths, learned from a sample of
about ``SAMPLE_ROWS`` rows, cut to ``TABLE_ROWS`` pre-tokens of up to ``LONG`` characters (so under 3 MB
whatever the corpus) and broadcast. Tier two is a cache in each worker that encodes misses with the
tokenizers library, each distinct pre-token once, and is emptied at ``CACHE_ROWS``. Both tiers
only save time: the count of a pre-token is the library's own.

Whether a code point is a letter may differ between the package that cuts and the library if a Unicode version has only just
assigned it. Texts with a code point that is unassigned in Python's own tables go to the library whole.

Special strings inside texts count as the library does by default: one token each, and the text
between them is split on its own.

Cases: null text is empty and has no tokens; texts of any length are counted whole; repeated rows
give repeated rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from perpflow.llm.text import slices, steady

SAMPLE_ROWS = 2_000
TABLE_ROWS = 50_000
CACHE_ROWS = 300_000
LONG = 32
#: Fixed value: the pattern by which byte-level BPE vocabularies of this kind cut texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_cut = regex.compile(PATTERN)


@lru_cache(maxsize=2)
def _library(path: str):
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
    added = spec.get("added_tokens", [])
    if not plain or any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in added):
        raise ValueError("the vocabulary cuts texts in another way")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    special = sorted((a["content"] for a in added), key=len, reverse=True)
    return tokenizer, regex.compile("|".join(map(regex.escape, special))) if special else None


_assigned: set[str] = set()


def _has_unassigned(text: str) -> bool:
    """Whether a code point is not assigned in Python's tables; those seen to be are remembered."""
    fresh = set(text) - _assigned
    missing = {c for c in fresh if unicodedata.category(c) == "Cn"}
    _assigned.update(fresh - missing)
    return bool(missing)


class _Lengths(dict):
    """Pre-token to number of tokens; a miss is encoded once."""

    def __init__(self, path: str, frequent: dict[str, int]):
        super().__init__(frequent)
        self.path, self.frequent = path, frequent

    def __missing__(self, chunk: str) -> int:
        tokenizer, _ = _library(self.path)
        n = len(tokenizer.encode(chunk, add_special_tokens=False).ids)
        if len(chunk) <= LONG:
            if len(self) >= CACHE_ROWS + len(self.frequent):
                self.clear()
                self.update(self.frequent)
            self[chunk] = n
        return n


_lengths: dict[tuple[str, str], _Lengths] = {}


def _count(lengths: _Lengths, special, text: str) -> int:
    if not text.isascii() and _has_unassigned(text):
        return len(_library(lengths.path)[0].encode(text, add_special_tokens=False).ids)
    parts = special.split(text) if special is not None else [text]
    return len(parts) - 1 + sum(sum(map(lengths.__getitem__, _cut.findall(p))) for p in parts if p)


def _counts(path: str, frequent, name: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (path, name)
        if key not in _lengths:
            _lengths.clear()
            _lengths[key] = _Lengths(path, frequent.value)
        lengths, (_, special) = _lengths[key], _library(path)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n = [_count(lengths, special, t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()), pa.array(n, pa.int64()),
                 pa.array([c > limit for c in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        seen = Counter(c for t in batch.column("text").to_pylist() if t for c in _cut.findall(t) if len(c) <= LONG)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["chunk", "n"])


def frequent_lengths(docs: DataFrame, path: str, sample_rows: int = SAMPLE_ROWS, table_rows: int = TABLE_ROWS) -> dict[str, int]:
    """Tier one: the commonest pre-tokens of a bounded sample and their token counts."""
    share = min(1.0, sample_rows / max(1, docs.count()))
    sample = docs.select("text").sample(share, seed=1) if share < 1 else docs.select("text")
    top = (
        sample.mapInArrow(_frequencies, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "chunk").limit(table_rows).select("chunk").collect())
    chunks = [r.chunk for r in top]
    tokenizer, _ = _library(path)
    return {c: len(e.ids) for c, e in zip(chunks, tokenizer.encode_batch(chunks, add_special_tokens=False), strict=True)}


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """Bytes, tokens and whether they exceed ``limit``, for every row."""
    spark = steady(docs.sparkSession)
    frequent = spark.sparkContext.broadcast(frequent_lengths(docs, path))
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    return docs.selectExpr("cast(doc_id as long) AS doc_id", "text").mapInArrow(_counts(path, frequent, uuid.uuid4().hex, limit), schema)
