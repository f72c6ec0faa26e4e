"""Windows of item size against brute force over all windows."""

import random
import re
from collections import Counter

import pytest

from perpflow.llm import decontaminate as D


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())


def bag(words, k):
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(docs, items, least=0.8):
    out = {}
    for item, text in items:
        words = split(text)
        if not words:
            continue
        k = min(5, len(words))
        mine = bag(words, k)
        for doc, body in docs:
            w = split(body)
            best = 0
            for s in range(max(1, len(w) - len(words) + 1)):
                other = bag(w[s : s + len(words)], k)
                best = max(best, 2 * sum((mine & other).values()) / max(1, sum(mine.values()) + sum(other.values())))
            if best >= least:
                out[doc, item] = max(best, out.get((doc, item), 0))
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop") + rng.choice("qrst")
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 4, 5, 20, 40])))) for i in range(12)] + [(50, None), (51, " "), (52, "rep " * 30)]
    docs = []
    for i in range(120):
        w = [word() for _ in range(rng.randint(0, 150))]
        if i % 3 == 0:
            part = split(rng.choice(items)[1])
            if part and i % 2:
                part[rng.randrange(len(part))] = "changed"
            at = rng.randint(0, len(w))
            w = w[:at] + part + w[at:]
        docs.append((i, " ".join(w)))
    return docs + [(500, None), (501, ""), (502, "REP\t" * 100), (503, items[5][1].upper())], items


def test_equals_brute_force(spark, corpus):
    docs, items = corpus
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in D.contaminated(d, b).collect()}
    want = brute(docs, items)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    kept = {r.doc_id for r in D.drop_contaminated(d, b).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in want}
    assert D.drop_contaminated(d, b).columns == d.columns


def test_simhash_by_hand(spark):
    values = [3, -1, 7, 2**62 + 5, 3]
    row = D.with_simhash(spark.createDataFrame([(values,)], "h array<long>"), "h", "f").first()
    bits = [sum((v >> i) & 1 for v in values) * 2 > len(values) for i in range(64)]
    assert row.f % 2**64 == sum(1 << i for i, b in enumerate(bits) if b)


def test_blocks_cover_all_bits(spark):
    row = spark.range(1).select(D.blocks("cast(-1 as bigint)", 22).alias("b")).first()
    assert len(row.b) == 23 and sum(b.bits.bit_count() for b in row.b) == 64


def test_empty_tables(spark, corpus):
    docs, items = corpus
    none = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert D.contaminated(none, b).count() == 0
    assert D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), b.limit(0)).count() == 0


def test_columns_with_the_names_of_helpers(spark):
    from perpflow.llm import decontaminate, jaccard

    said = " ".join(f"w{i}" for i in range(30))
    rows = [(1, said, 5, 6, 7), (2, said + " x", 5, 6, 7), (3, "another text of its own words here", 5, 6, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id int, _digest int, _gone int")
    bench = spark.createDataFrame([(9, said)], "item_id long, text string")
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and [r.doc_id for r in left.collect()] == [3]
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
