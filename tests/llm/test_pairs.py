"""Jaccard components, fingerprints, passages and the pipeline against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from perpflow.llm import components as G, jaccard as J, passages as P, sketches as S


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists = defaultdict(list)
    for i in sorted(sets):
        shared = defaultdict(int)
        for s in sets[i]:
            for o in lists[s]:
                shared[o] += 1
            lists[s].append(i)
        for o, n in shared.items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[o]) - n):
                a, b = find(i), find(o)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(seed, n=250):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklm") + rng.choice("nopqrstuvw")
    bases = [[word() for _ in range(rng.randint(1, 60))] for _ in range(20)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.randint(0, 3)):
            j = rng.randrange(len(w) + 1)
            w[j : j + rng.randint(0, 1)] = [word()] * rng.randint(0, 1)
        rows.append((i, " ".join(w)))
    return rows + [(9000, None), (9001, ""), (9002, " \n\t"), (9003, "One"), (9004, "one"), (9005, "very " * 20000)]


@pytest.mark.parametrize("seed,crowd", [(1, 64), (2, 2)])
def test_components_equal_brute_force(spark, monkeypatch, seed, crowd):
    monkeypatch.setattr(J, "CROWD", crowd)
    rows = near_copies(seed)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.linked_components(docs).collect()}
    want = brute_components(rows)
    assert got == want
    if seed == 1:
        kept = J.keep_one(docs)
        assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, (_, c) in want.items() if i == c}


def test_unlike_texts_of_one_origin_are_no_candidates(spark, monkeypatch):
    """Sixty texts that share three quarters of their words in runs: no two link, and hardly a pair is read."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):
        w = list(base)
        for j in rng.sample(range(200), 8):
            w[j] = f"only{i}x{j}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, t + " end") for i, t in rows[:5]]
    read, plain = [], J.verified
    monkeypatch.setattr(J, "verified", lambda pairs, texts: read.append(pairs.count()) or plain(pairs, texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in J.linked_components(docs).collect()} == brute_components(rows)
    assert 5 <= sum(read) < 100


def test_boundary_and_overlaps():
    for n in range(1, 60):
        for m in range(1, 60):
            need = min((o for o in range(min(n, m) + 1) if 100 * o >= 80 * (n + m - o)), default=None)
            if need is not None:
                assert need in J.overlaps(n) and need in J.overlaps(m)
                assert need > n - J.prefix_length(n)
    assert J.boundary({3: 10, 4: 10}, 5.0) == 4 and J.boundary({20: 10}, 1.0) == 0


def test_odd_ids(spark):
    docs = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "a b c")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in J.linked_components(docs).collect())
    assert got == [(0, 1, 0), (1, 1, 1), (1, 1, 1), (2, 1, 1)]
    assert J.linked_components(docs.limit(0)).count() == 0


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90)], "u long, v long")
    assert {(r.id, r.component) for r in G.components(edges).collect()} == {(i, 0) for i in range(41)} | {(100, 90), (90, 90)}


def test_fingerprints(spark):
    rows = [r for r in near_copies(3, 80)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, part string")
    got = {r.doc_id: r for r in S.fingerprints(docs).collect()}
    ordered = [(i, t or "") for i, t in sorted(rows, reverse=True)]
    prints = defaultdict(set)
    for k, (i, text) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        edited = S.edited_text(text, following)
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        sets = [set(S.paragraphs([t])[1].tolist()) for t in (text, edited, following)]
        for other, near in ((sets[1], r.near_edited), (sets[2], r.near_next)):
            total = len(sets[0]) + len(other)
            assert abs(near - (1 - len(sets[0] ^ other) / total if total else 1.0)) < 1e-9
        prints[text].add(r.fingerprint)
        prints[edited].add(r.edited_fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    assert S.fingerprints(docs.limit(1)).first().near_next == 1.0 and S.fingerprints(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "x y"), (1, "a"), (1, "a"), (1, "b")], "doc_id long, text string")
    assert S.fingerprints(odd).count() == 4


def test_peeling_recovers_or_says_no():
    rng = np.random.default_rng(5)
    keys = rng.integers(1, 2**63, 30, dtype=np.uint64)
    whole = S.sketch(np.zeros(8, np.int64), keys[:8], 1, 48)
    found, done = S.peel(*whole)
    assert done[0] and found[0] == 8
    _, done = S.peel(*S.sketch(np.zeros(30, np.int64), keys, 1, 24))
    assert not done[0]


def test_passages(spark):
    rng = random.Random(4)
    fresh = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    passages = [fresh(60) for _ in range(5)]
    rows, holders = [], defaultdict(list)
    for i in range(100):
        w = fresh(80)
        if i % 4 == 1:
            p = list(passages[i % 5])
            for _ in range(i % 3):
                p[rng.randrange(60)] = "changed"
            at = rng.randrange(80)
            w[at:at] = p
            holders[i % 5].append((i, at))
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, ""), (202, "one two"), (203, rows[7][1]), (204, "x " * 3000)]
    got = defaultdict(list)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, source string")
    for r in P.repeated_passages(docs).collect():
        got[r.doc_id].append(r)
        assert r.source_doc_id < r.doc_id and r.identity >= 0.8
    want = {i: at for h in holders.values() for i, at in h[1:]}
    assert set(got) == set(want) | {203}
    for i, at in want.items():
        assert any(r.start_word <= at + 8 and r.stop_word >= at + 52 for r in got[i])
    assert P.repeated_passages(docs.limit(0)).count() == 0


def test_poor_stretches_do_not_hide_passages(spark):
    rng = random.Random(7)
    fresh = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    first, second = fresh(60), fresh(60)
    changed = first[:23] + fresh(14) + first[37:]
    # 1, 2, 3: the same passage, a changed one, a copy of that; 11: an exact passage beside a stretch of which a half agrees.
    poor = [w for i in range(6) for w in second[i * 20 : i * 20 + 20]]
    half = [w for i in range(3) for w in poor[i * 20 : i * 20 + 16] + fresh(20)]
    exact = fresh(60)
    rows = [(1, fresh(30) + first + fresh(30)), (2, fresh(30) + changed + fresh(30)), (3, fresh(20) + changed + fresh(30)),
            (10, fresh(30) + exact + poor + fresh(30)), (11, fresh(25) + exact + half + fresh(30))]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = {r.doc_id: r for r in P.repeated_passages(docs).collect()}
    assert set(got) == {3, 11}
    assert got[3].start_word == 20 and got[3].stop_word == 80 and got[3].identity == 1.0 and got[3].sources == [1, 2]
    assert got[11].start_word == 25 and 85 <= got[11].stop_word <= 121 and got[11].identity >= 0.8
    assert P.passages([(0, 60, 1.0, 5), (60, 200, 0.3, 4)], 40, 0.8) == [(0, 60, 1.0, [5])]
    assert P.passages([(0, 60, 0.77, 1), (0, 60, 1.0, 2)], 40, 0.8) == [(0, 60, 1.0, [2])]


def test_a_lone_seed_is_aligned():
    table = pa.table({"doc_id": [5], "source": [1], "at": [10], "source_at": [20]})
    assert [r for b in P._chain_pairs(table) for r in b.to_pylist()] == [{"doc_id": 5, "source": 1, "x": [10], "y": [20], "size": [P.K]}]


def test_many_rows_extend_as_one_does():
    rng = np.random.default_rng(6)
    doc, source = rng.integers(0, 3, 400, dtype=np.uint64), rng.integers(0, 3, 400, dtype=np.uint64)
    source[100:160] = doc[200:260]
    a, b = rng.integers(0, 400, 300), rng.integers(0, 400, 300)
    a[:30], b[:30] = np.arange(200, 230), np.arange(100, 130)
    for step, end in ((1, 400), (-1, -1)):
        ends = np.full(300, end)
        i, j, agree = P.extend_all(doc, source, a, ends, b, ends, step)
        for r in range(300):
            one = (doc[a[r] :], source[b[r] :]) if step == 1 else (doc[a[r] :: -1], source[b[r] :: -1])
            x, y, runs = P.extend(*one)
            assert (i[r], j[r], agree[r]) == (x, y, len(runs[0]))


def test_a_text_is_cut_into_words_once_for_all_its_chains(monkeypatch):
    texts = ["one two three four five six seven eight nine ten"] * 50
    table = pa.table({"doc_id": [5] * 50, "source": list(range(50)), **{c: pa.array([[v]] * 50, pa.list_(pa.int32())) for c, v in (("x", 1), ("y", 0), ("size", 8))}, "text": texts})
    seen, plain = [], P.words
    monkeypatch.setattr(P, "words", lambda data, bounds: seen.append(len(data)) or plain(data, bounds))
    cut = [r for b in P._cut(iter(table.to_batches())) for r in b.to_pylist()]
    assert len(cut) == 50 and all(r["first"] == 1 and len(r["words"]) == 9 for r in cut)
    assert sum(seen) == len(texts[0])


def test_texts_do_not_travel_with_each_chain(spark, monkeypatch):
    # A run of one word has a seed at every word, each a chain of its own.
    rows = [(1, "x " * 600), (2, "y z " + "x " * 1500), (3, "x " * 900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kind, seen = type(docs), []
    plain = kind.mapInArrow

    def spy(self, *given, **named):
        if "text" in self.columns:
            seen.append(self.selectExpr("coalesce(sum(length(text)), 0)").first()[0])
        return plain(self, *given, **named)

    monkeypatch.setattr(kind, "mapInArrow", spy)
    got = {r.doc_id: (r.start_word, r.stop_word, r.source_doc_id) for r in P.repeated_passages(docs).collect()}
    assert got == {2: (2, 1502, 1), 3: (0, 900, 1)}
    assert sum(seen) <= 4 * sum(len(t) for _, t in rows)


@pytest.mark.parametrize("held, block", [(1, 1), (3000, 90), (4_000_000, 8192)])
def test_blocks_of_chains_are_aligned_as_single_chains(monkeypatch, held, block):
    monkeypatch.setattr(P, "HELD_BYTES", held)
    monkeypatch.setattr(P, "BLOCK_WORDS", block)
    rng = random.Random(9)
    base = [[rng.choice("abcdefghijklmnopqrstuvwxyz") * 3 for _ in range(150)] for _ in range(4)] + [["x"] * 150]
    texts, spots = [], {}
    for doc in range(12):
        for _ in range(1 + (doc in (4, 7))):  # 4 and 7 have two texts each
            w = []
            for _ in range(3):
                b, s = rng.choice(base), rng.randrange(100)
                w += [rng.choice("pqrst") for _ in range(rng.randrange(4))] + b[s : s + 50]
                if rng.random() < 0.5:
                    w[-rng.randrange(1, 40)] = "changed"
            texts.append((doc, " ".join(w)))
            for at in range(0, len(w) - P.K + 1, 3):
                spots.setdefault(tuple(w[at : at + P.K]), []).append((doc, at))
    matches = sorted({(d, *min(v), at) for v in spots.values() for d, at in v if d > min(v)[0]})
    assert len(matches) > 100
    matches = [(d, s, at, s_at) for d, s, s_at, at in matches]
    table = pa.table({c: [m[i] for m in matches] for i, c in enumerate(("doc_id", "source", "at", "source_at"))})
    whole = lambda rows, **more: [dict(r, text=t, **more) for r in rows for d, t in texts if d == r["doc_id"]]
    single = pa.Table.from_pylist(whole([r for b in P._chain_pairs(table) for r in b.to_pylist()]))
    single = single.cast(pa.schema([(f.name, pa.list_(pa.int32()) if f.name in ("x", "y", "size") else f.type) for f in single.schema]))
    want = []
    for r in (r for b in P._cut(iter(single.to_batches())) for r in b.to_pylist()):
        mine = np.array(r["words"], dtype=np.int64).view(np.uint64)
        for other in (P._distinct_words(pa.array([t]))[0] for d, t in texts if d == r["source"]):
            for a, b, c, d, n in P.align(mine, other, [x - r["first"] for x in r["x"]], r["y"], r["size"]):
                want.append((r["doc_id"], r["source"], a + r["first"], b + r["first"], c, d, n))
    rows = [(d, None, None, None, t) for d, t in texts] + [(*m, None) for m in matches]
    rows.sort(key=lambda r: (r[0], r[1] is not None, r[1] or 0))
    given = pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()))],
                     ["doc_id", "source", "at", "source_at", "text"])
    blocks = pa.Table.from_batches(P._blocks(iter(given.to_batches(max_chunksize=40))))
    to, text = zip(*((i, t) for i, s in enumerate(blocks.column("source").to_pylist()) for d, t in texts if d == s), strict=True)
    lined = blocks.take(pa.array(to)).append_column("text", pa.array(text)).combine_chunks()
    got = [tuple(r.values()) for b in P._aligned(P.IDENTITY)(iter(lined.to_batches(max_chunksize=7))) for r in b.to_pylist()]
    assert sorted(got) == sorted(want)


def test_unions_do_not_depend_on_how_rows_arrive(monkeypatch):
    rng = random.Random(3)
    rows = sorted((rng.randrange(6), s := rng.randrange(600), rng.randrange(4), s + rng.randrange(8, 40), rng.randrange(6, 36)) for _ in range(300))
    table = pa.table({"doc_id": [r[0] for r in rows], "source": [r[2] for r in rows], "start": [r[1] for r in rows], "stop": [r[3] for r in rows],
                      "source_start": [0] * 300, "source_stop": [r[3] - r[1] for r in rows], "agree": [min(r[4], r[3] - r[1]) for r in rows]})
    want, union = [], []
    for r in [*rows, (99, 0, 0, 0, 0)]:
        if union and (union[0][0] != r[0] or r[1] > max(u[3] for u in union) + P.APART):
            want += [(union[0][0], *p) for p in P.passages([(u[1], u[3], min(u[4], u[3] - u[1]) / (u[3] - u[1]), u[2]) for u in union], 40, 0.8)]
            union = []
        union.append(r)
    assert want
    for size, held in ((1, 1), (7, 30), (300, 20_000)):
        monkeypatch.setattr(P, "HELD_ROWS", held)
        got = [tuple(r.values()) for b in P._merged(40, 0.8)(iter(table.to_batches(max_chunksize=size))) for r in b.to_pylist()]
        assert got == want


def test_chains_equal_a_quadratic_search():
    rng = np.random.default_rng(2)
    for _ in range(40):
        n = int(rng.integers(2, 12))
        x, y, size = rng.integers(0, 60, n), rng.integers(0, 60, n), rng.integers(1, 9, n)
        best = np.zeros(n)
        for i in np.argsort(x, kind="stable"):
            gains = [best[j] - P.GAP_COST * (x[i] - x[j] - size[j] + y[i] - y[j] - size[j]) for j in range(n) if x[j] + size[j] <= x[i] and y[j] + size[j] <= y[i]]
            best[i] = size[i] + max([0.0, *gains])
        chain = P.chains(x, y, size)[0]
        score = float(size[chain[0]])
        for a, b in zip(chain, chain[1:], strict=False):
            score += size[b] - P.GAP_COST * (x[b] - x[a] - size[a] + y[b] - y[a] - size[a])
        assert abs(score - best.max()) < 1e-9


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "n-gram Jaccard join", "benchmark decontamination", "PII", "SentencePiece encoding and decoding"]
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    given = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = docs
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), before.schema)
        assert stage(spark, before, sf).columns == before.columns
        rows = [(r.doc_id, r.text) for r in before.collect()]
        if name == "n-gram Jaccard join":
            assert {r.doc_id for r in docs.collect()} == {i for i, (_, c) in brute_components(rows).items() if i == c}
        elif name == "quality classifier":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
            kept = {r.doc_id for r in docs.collect()}
            assert np.mean([(i in kept) == (q == 1) for i, q in labels.items()]) > 0.95
        elif name == "PII":
            assert docs.count() == before.count() and not any(re.search(r"@mail\d", r.text) for r in docs.collect())
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = corpus_pipeline.run(spark, sf).collect()
    clean = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in out} == set(clean) <= set(given)
    assert all(r.text == clean[r.doc_id] and list(r.ids) == model.encode(r.text) and r.decoded == model.decode(r.ids) for r in out)
