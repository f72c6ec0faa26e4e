"""Piece ids and token counts against the libraries on whole texts."""

import hashlib
import random
import sys

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from perpflow.llm import pieces as P, token_counts as C

MODEL = public_tokenizers.path("piece_bpe_32k.model")
VOCAB = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", None, " ", "  ", "\n", "a", " a", "  a  b \n\n c  ", "▁a ▁▁b▁", "<s> x </s>", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>",
       "<|endoftext", "x" * 5000, "ab " * 3000, " " * 700, "▁" * 40, "café é ﬁ Ａ", "你好 \U0001f600\U0001f468‍\U0001f469", "a\tb\r\nc\x00d", "don't I'll we've 's 't",
       " x y​z", "123 4567 89!?", "...   \n  \t x", "﻿bom", "\u0085  "]


def texts():
    rng = random.Random(5)
    alphabet = "abcdefgh  \n\t▁é你\U0001f6001'."
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 200))) for _ in range(400)]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def check_pieces(rows, got):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for i, t in rows:
        ids = model.encode(t or "")
        assert got[i] == (len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids))), repr(t)


def test_pieces_on_odd_texts(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_tokens string")
    check_pieces(rows, {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in P.digests(docs, MODEL).collect()})
    back = P.decode(P.encode(docs, MODEL), MODEL).collect()
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert all(r.ids == model.encode(r.text or "") and r.decoded == model.decode(model.encode(r.text or "")) for r in back)


def test_pieces_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check_pieces(rows, {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in P.digests(docs, MODEL).collect()})


def test_a_model_with_pieces_over_markers_is_refused():
    class Crossing:
        def get_piece_size(self):
            return 1

        def id_to_piece(self, i):
            return "a▁b"

    with pytest.raises(ValueError):
        P.check_model(Crossing())


@pytest.mark.parametrize("small", [False, True])
def test_counts(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(C, "CACHE_ROWS", 2)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts())], "doc_id long, text string")
    rows = docs.union(more).collect()
    tokenizer = Tokenizer.from_file(VOCAB)
    for r in C.token_counts(docs.union(more), VOCAB).collect():
        text = next(x.text for x in rows if x.doc_id == r.doc_id) or ""
        n = len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 1024), repr(text)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert P.digests(none, MODEL).count() == 0
    assert C.token_counts(none, VOCAB).count() == 0


def test_every_code_point_counts_as_in_the_library():
    """All code points in one short text each, also those that a Unicode version has only just made letters."""
    library = Tokenizer.from_file(VOCAB)
    lengths, special = C._Lengths(VOCAB, {}), C._library(VOCAB)[1]
    texts = [f"a{chr(c)}b {chr(c)}" for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and not 0x40000 <= c < 0xE0000 and not c >= 0xF0000]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [C._count(lengths, special, t) for t in texts] == want
