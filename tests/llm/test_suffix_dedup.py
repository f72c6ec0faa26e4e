"""LPF de-duplication against brute force over all earlier strings."""

import hashlib
import random

import numpy as np
import pytest

from perpflow.llm import suffix_dedup as S


def brute(rows, length):
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out[doc_id] = (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def got(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8)))
    passages = [" ".join(word() for _ in range(rng.randint(5, 60))) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(rng.randint(0, 60)))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), " ".join(word() for _ in range(rng.randint(0, 20)))]
        rows.append((i, " ".join(parts)))
    rows += [(n, None), (n + 1, ""), (n + 2, "x" * 5000), (n + 3, "ab" * 700), (n + 4, "short"), (n + 5, rows[3][1]), (n + 6, rows[3][1])]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, digest string")
    assert got(S.remove_repeats(docs)) == brute(rows, 100)


def test_crowded_anchors_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT", 1)
    rows = corpus(3, 30)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(S.remove_repeats(docs)) == brute(rows, 100)


def test_empty_table_and_repeated_rows(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rng = random.Random(1)
    text = "".join(rng.choice("abcdef") for _ in range(300))
    rows = S.remove_repeats(spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_removed) for r in rows) == [(1, 0), (1, 0), (2, 300)]


def test_ranks_and_smaller_positions():
    raw = np.frombuffer(b"banana_banana_bandana", dtype=np.uint8)
    starts = np.arange(len(raw) - 4)
    rank = S.suffix_ranks(raw, starts, 5)
    strings = [raw[s : s + 5].tobytes() for s in starts]
    assert [strings[i] for i in np.argsort(rank, kind="stable")] == sorted(strings)
    earlier = [strings[i] in strings[:i] for i in range(len(strings))]
    assert S.has_earlier(rank, starts).tolist() == earlier
