"""Conversation trie and Merkle manifest against straightforward versions in plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from perpflow.llm import conversation_trie as CT, merkle as MK
from perpflow.llm.ranks import ranked


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- ranks ------------------------------------------------------------------------------------

def test_ranks_of_hot_and_null_groups(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 6 + ["a", None]), rng.choice([None, *range(50)]), i) for i in range(500)]
    got = ranked(spark.createDataFrame(rows, "g string, x long, i long").repartition(7), ["g"], ["x", "i"]).collect()
    for g in {r[0] for r in rows}:
        mine = sorted((r.idx, r.x if r.x is not None else -1, r.i) for r in got if r.g == g)
        assert [m[0] for m in mine] == list(range(len(mine)))
        assert [m[1:] for m in mine] == sorted(m[1:] for m in mine)
    assert len(got) == 500


# --- trie -------------------------------------------------------------------------------------

def plain_trie(conversations):
    """{(conv_id, depth): (parent, n_convs, n_children, n_leaves, saved, ends)} of {conv: [(role, text)]}."""
    members = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)

    def total(p):
        own = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        leaves, saved = (1, own) if p not in children else (0, own)
        stack = list(children.get(p, []))
        while stack:
            q = stack.pop()
            leaves += q not in children
            saved += (len(members[q]) - 1) * len(q[-1][1].encode())
            stack += children.get(q, [])
        return leaves, saved

    out = {}
    for p, who in members.items():
        ends = sorted(c for c in who if len(conversations[c]) == len(p))
        out[min(who), len(p)] = (min(members[p[:-1]]) if p else None, len(who), len(children.get(p, [])), *total(p), sha(",".join(map(str, ends))))
    return out


def collected(frame):
    rows = frame.collect()
    found = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(found) == len(rows)
    return found


def turns_frame(spark, conversations):
    rows = [(c, i + 1, r, t) for c, turns in conversations.items() for i, (r, t) in enumerate(turns)]
    sizes = spark.createDataFrame([(c, len(t)) for c, t in conversations.items()], "conv_id long, n long")
    return spark.createDataFrame(rows, "conv_id long, pos long, role string, text string"), sizes


@pytest.mark.parametrize("height,chunk", [(2, 3), (16, 256)])
def test_trie_in_bands_of_any_height(spark, monkeypatch, height, chunk):
    monkeypatch.setattr(CT, "HEIGHT", height)
    monkeypatch.setattr(CT, "CHUNK", chunk)
    rng = random.Random(height)
    stem = [("u", "é" * rng.randint(0, 3)) for _ in range(40)]
    conversations = {}
    for c in range(40):
        cut = rng.choice([0, 0, 2, 5, 17, 40])
        conversations[c * 3 + 1] = stem[:cut] + [(rng.choice("ua"), rng.choice(["", "x", "yy"])) for _ in range(rng.randint(0, 3))]
    turns, sizes = turns_frame(spark, conversations)
    assert collected(CT.prefix_trie(turns, sizes)) == plain_trie(conversations)


def test_one_long_conversation(spark):
    conversations = {5: [("u", str(i)) for i in range(700)], 9: [("u", str(i)) for i in range(650)] + [("a", "end")], 2: []}
    turns, sizes = turns_frame(spark, conversations)
    assert collected(CT.prefix_trie(turns, sizes)) == plain_trie(conversations)


def test_rebuilt_conversations(spark):
    rng, rows = random.Random(3), []
    for c in [*range(0, 30, 2), 31, 102, -3, -10]:
        for t in range(rng.randint(1, 12)):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None])))
    rows += [rows[0], rows[0], (None, 0, "user", "lost")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit("extra")).withColumn("depth", F.lit(1))
    own = {}
    for c, t, r, x in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        own.setdefault(c, []).append((r or "", x or ""))
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        rebuilt[c] = own.get(base, [])[:h] + turns[h:]
    assert collected(CT.rebuilt_trie(frame)) == plain_trie(rebuilt)


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert CT.rebuilt_trie(empty).count() == 0
    lost = spark.createDataFrame([(None, 0, "user", "x")], empty.schema)
    assert CT.rebuilt_trie(lost).count() == 0


# --- manifest ---------------------------------------------------------------------------------

def H(*parts):
    return sha("".join("-" if p is None else f"{len(str(p).encode())}:{p}" for p in parts))


def grow(nodes):
    """The levels from the nodes to the single top."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i : i + 3])) for i in range(0, len(below), 3)])
    return levels


def walk(levels, at):
    for level in levels[:-1]:
        start = at - at % 3
        yield level[start:at], level[at + 1 : start + 3]
        at //= 3


def plain_manifest(rows):
    by = {}
    for doc_id, source, lang, n, text in rows:
        leaf = H(doc_id, source, lang, n, text)
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
        other = H(doc_id, source, lang, n, None if text is None else text.replace("\n", "")) if hit else None
        by.setdefault(source, []).append((doc_id, leaf, other))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2] or ""))
    trees = {s: grow([x[1] for x in by[s]]) for s in names}
    top = grow([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (doc_id, leaf, other) in enumerate(by[s]):
            path = [*walk(trees[s], i), *walk(top, k)]
            copy = other or leaf
            for left, right in path:
                copy = sha("".join([*left, copy, *right]))
            out.append((doc_id, leaf, trees[s][-1][0], top[-1][0], sha("".join("".join(a + b) for a, b in path)), copy, copy == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("height,sources", [(1, ["b", None, "é", "", "a"]), (2, list("abcdefghijkl")), (6, ["a"])])
def test_manifest_in_blocks_of_any_height(spark, monkeypatch, height, sources):
    monkeypatch.setattr(MK, "HEIGHT", height)
    rng, rows = random.Random(height), []
    for i in range(120):
        source = sources[0] if rng.random() < 0.5 else rng.choice(sources)
        rows.append((rng.choice([i, i, None, 7]), source, rng.choice(["en", None]), rng.choice([None, 3]), rng.choice([None, "", "a\nb", "\n", "é" * 50 + "\n"])))
    rows += [rows[3], (500, "single", None, None, "x\n")]
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    frame = frame.withColumn("idx", F.lit(1)).withColumn("digest", F.lit("x"))
    got = MK.tamper_check(frame).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_manifest(rows)
    assert not all(r.verified for r in got)


def test_manifest_of_one_row_and_of_none(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    one = [(1, None, None, None, "t")]
    got = MK.manifest(spark.createDataFrame(one, schema)).collect()
    assert len(got) == 1 and got[0].verified and got[0].root == got[0].leaf == got[0].subroot == H(*one[0])
    assert MK.tamper_check(spark.createDataFrame([], schema)).count() == 0
