"""The chosen-path join against all pairs of small corpora."""

import random

import pytest
from pyspark.sql import functions as F

from perpflow.llm import chosen_paths as CP
from test_pairs import shingles


def plain(rows):
    """{doc_id: component} by comparing everything; a doc_id that repeats is one document."""
    ids = sorted({d for d, _ in rows if d is not None})
    top = {d: d for d in ids}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    for i, (a, sa) in enumerate(sets):
        for b, sb in sets[:i]:
            if sa and sb and 100 * len(sa & sb) >= 85 * len(sa | sb):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def corpus(seed, n=150):
    """Groups of near copies with all degrees of change, shared passages, tiny texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    stems = [[rng.choice(words) for _ in range(rng.choice([3, 8, 40, 120]))] for _ in range(12)]
    rows = []
    for i in range(n):
        text = list(rng.choice(stems))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
            text[rng.randrange(len(text))] = rng.choice(words)
        if rng.random() < 0.2:
            text += rng.choice(stems)
        rows.append((i, " ".join(w.upper() if rng.random() < 0.1 else w for w in text)))
    return rows


@pytest.mark.parametrize("seed,node", [(1, 4096), (3, 3)])
def test_components_match_all_pairs(spark, monkeypatch, seed, node):
    """Nodes of 3 make the trees branch several levels deep and visit hubs."""
    monkeypatch.setattr(CP, "NODE", node)
    rows = corpus(seed)
    rows += [(500, None), (501, ""), (502, " \n"), (503, "one"), (504, "ONE"), (505, "one two three four"), (7, rows[7][1]), (None, rows[3][1]), (600, rows[3][1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit(1)).withColumn("component", F.lit(2)).repartition(5)
    got = CP.near_duplicates(frame).collect()
    want = plain(rows)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id)
    sizes = {d: len(shingles(t)) for d, t in rows}
    assert all(r.n_shingles == sizes[r.doc_id] for r in got if r.doc_id is not None)


def test_repeated_ids_with_different_texts(spark):
    a, b = "a b c d e f g h i j k", "l m n o p q r s t u v"
    rows = [(1, a), (5, a), (5, b), (9, b), (8, "x y z")]
    got = {(r.doc_id, r.component_id) for r in CP.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (5, 1), (9, 1), (8, 8)}


def test_blocks_leave_no_pair_out(spark, monkeypatch):
    monkeypatch.setattr(CP, "NODE", 16)
    rows = spark.range(100).select(F.lit(5).cast("long").alias("key"), "id", F.lit(1).cast("long").alias("used"), F.lit(100).cast("long").alias("size"))
    blocks = CP._blocks(rows)
    met = blocks.alias("a").join(blocks.alias("b"), "key").select(F.col("a.id").alias("x"), F.col("b.id").alias("y")).where("x < y").distinct()
    assert met.count() == 100 * 99 // 2


def test_trees_reach_the_target():
    miss = CP.tree_miss(0.85)
    assert miss ** CP.trees_for(CP.TARGET) <= 1 - CP.TARGET < miss ** (CP.trees_for(CP.TARGET) - 1)
    assert CP.tree_miss(0.95) < miss
    with pytest.raises(ValueError):
        CP.trees_for(1 - 1e-15)


def test_nothing_to_join(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert CP.near_duplicates(empty).count() == 0
    lone = spark.createDataFrame([(4, "a b c d e f"), (2, "g h i j k l")], empty.schema)
    assert {(r.doc_id, r.component_id, r.kept) for r in CP.near_duplicates(lone).collect()} == {(4, 4, True), (2, 2, True)}
