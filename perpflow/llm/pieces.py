"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the model continues over a word marker (``check_model`` proves it from the
vocabulary), so the pieces of a text are the pieces of its chunks: a run of markers with the
letters after it. Each batch of texts is cut into chunks, every distinct chunk is segmented once
by the sentencepiece library, and ids go back to their texts by position. Chunks seen before are
kept in a table of the worker process, emptied when it holds ``TABLE_ROWS`` chunks: memory is
bounded and results do not depend on it. Rows are independent, so there is no shuffle.

Cases: null text is empty; empty texts have no ids and decode to empty text; texts of any length
are encoded whole; a chunk of over ``LONG`` characters is encoded but not kept. Repeated rows give repeated rows, ties do
not arise, extra columns are ignored by the query and kept by ``encode``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from perpflow.llm.text import slices, steady

MARK = "▁"
TABLE_ROWS = 200_000
LONG = 64
_CHUNK = re.compile(r"[ ▁]*[^ ▁]+|[ ▁]+")
_table: dict[tuple[str, str], tuple[str, int, str]] = {}


@lru_cache(maxsize=2)
def _model(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    check_model(model)
    return model


def check_model(model) -> None:
    """Refuse a model with a piece that has a marker after another character, or that rewrites characters."""
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(MARK in p.lstrip(MARK) for p in pieces):
        raise ValueError("pieces cross word markers: chunks cannot be segmented apart")
    for probe in (" a", "a  b", "ﬁ Ａ é\t\n"):
        if model.decode(model.encode(probe)) != probe:
            raise ValueError("the model normalizes texts: chunks cannot be decoded apart")


def _segment(model, path: str, chunks: list[str]) -> dict[str, tuple[str, int, str]]:
    """Ids joined by commas, their count and the decoded text, for each distinct chunk."""
    if len(_table) + len(chunks) > TABLE_ROWS:
        _table.clear()
    out = {}
    new = []
    for c in chunks:
        known = _table.get((path, c))
        if known is None:
            new.append(c)
        else:
            out[c] = known
    # The library puts a marker before every text, which stands for the chunk's own first one;
    # before an empty text it puts none.
    for c, ids in zip(new, model.encode([c[1:] for c in new], num_threads=1), strict=True):
        ids = ids or [model.piece_to_id(MARK)]
        row = (",".join(map(str, ids)), len(ids), " " + model.decode(ids) if c[1:] else " ")
        out[c] = row
        if len(c) <= LONG:
            _table[path, c] = row
    return out


def _chunks(text: str) -> list[str]:
    """The marked chunks of a text; each begins with the marker that the library would put there."""
    return _CHUNK.findall(" " + text) if text else []


def encoded(model, path: str, texts: list[str | None]) -> list[tuple[list[str], int, str]]:
    """For each text: id strings of its chunks, number of ids, decoded text."""
    parts = [_chunks(t or "") for t in texts]
    table = _segment(model, path, list(dict.fromkeys(c for p in parts for c in p)))
    out = []
    for p in parts:
        rows = [table[c] for c in p]
        out.append(([r[0] for r in rows], sum(r[1] for r in rows), "".join(r[2] for r in rows)[1:]))
    return out


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in slices(batches):
            rows = encoded(model, path, batch.column("text").to_pylist())
            sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([r[1] for r in rows], pa.int64()), pa.array([sha(",".join(r[0])) for r in rows], pa.string()),
                 pa.array([sha(r[2]) for r in rows], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Number of ids, and digests of the ids and of the decoded text, for every row."""
    steady(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.selectExpr("cast(doc_id as long) AS doc_id", "text").mapInArrow(_digests(path), schema)


def _ids(path: str, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in slices(batches, column):
            rows = encoded(model, path, batch.column(column).to_pylist())
            ids = [[int(i) for i in ",".join(r[0]).split(",")] if r[1] else [] for r in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], [*batch.schema.names, "ids"])

    return run


def encode(rows: DataFrame, path: str, column: str = "text") -> DataFrame:
    """The rows with ``ids``, the token ids of the column, in place of a column of that name."""
    steady(rows.sparkSession)
    kept = rows.drop("ids")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(_ids(path, column), f"{fields}, ids array<int>")


def _texts(path: str, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in batches:
            texts = [model.decode(i) if i else "" for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, column])

    return run


def decode(rows: DataFrame, path: str, column: str = "decoded") -> DataFrame:
    """The rows with ``column``, the text of their ``ids``, in place of a column of that name."""
    steady(rows.sparkSession)
    kept = rows.drop(column)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(_texts(path, column), f"{fields}, `{column}` string")
