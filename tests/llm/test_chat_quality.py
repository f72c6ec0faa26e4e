"""Round trips of the chat template; held-out accuracy and edge cases of the classifier."""

import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from perpflow.llm import chat, quality


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_chat_round_trip(spark):
    rng = random.Random(3)
    tokens = ["###", "</turn>", "\\", " ", "\n", ": ", "### Assistant: ", "x", "é", " </turn>\n", "#", "<"]
    rows = []
    for conv in range(40):
        for turn in range(rng.randint(1, 6)):
            role = rng.choice(["user", "assistant", "system", "tool:x", "", "=a\\", "<|im|>", "</turn>\n"])
            rows.append((conv, turn, role, "".join(rng.choice(tokens) for _ in range(rng.randint(0, 8)))))
    rows += [(100, 0, "user", None), (101, None, None, "a"), (101, 1, "assistant", ""), (102, 0, "assistant", "tie"), (102, 0, "assistant", "tie"), (None, 0, "user", "u")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit("x"))
    examples = chat.format_examples(frame)
    got = {r.conv_id: r for r in chat.digests(examples).collect()}
    chars = {r.conv_id: r.n for r in examples.groupBy("conv_id").agg(F.sum(F.length("text")).alias("n")).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted(((t if t is not None else -1), r or "", x or "") for c, t, r, x in rows if c == conv)
        loss = "".join(x for _, r, x in mine if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(mine), sha("".join(f"{a}\n{b}\n" for _, a, b in mine)))
        assert (r.loss_chars, r.loss_sha256, r.formatted_chars) == (len(loss), sha(loss), chars[conv])
    n_replies = sum(r[2] == "assistant" for r in rows)
    assert examples.where("loss_end > loss_start").count() <= n_replies <= examples.count()


def test_chat_empty(spark):
    assert chat.format_examples(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good = [r.predicted == r.quality for r in rows]
    assert len(rows) > 50 and np.mean(good) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "x " * 30000, 0.5), (3, "x " * 30000, 0.5), (None, "a", 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.scores(docs, labels).collect()
    assert len(rows) == 5 and {r.score for r in rows} <= {0.5, 1.0}
    assert quality.scores(docs.limit(0), labels.limit(0)).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert np.isfinite(quality.statistics(pa.array([None, "", "a", "\n\n", "word " * 9]))).all()


def test_discriminant_equals_the_densities():
    rng = np.random.default_rng(1)
    mean, cov = rng.normal(size=(2, 3)), [np.eye(3) * 2, np.diag([1.0, 2.0, 3.0])]
    low = [np.linalg.cholesky(c) for c in cov]
    model = quality.Discriminant(mean, np.array([np.linalg.inv(x) for x in low]), np.array([2 * np.log(np.diag(x)).sum() for x in low]), np.log([0.3, 0.7]))
    x = rng.normal(size=(5, 3))
    log = [np.log(p) - 0.5 * (np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m) + np.log(np.linalg.det(c))) for m, c, p in zip(mean, cov, (0.3, 0.7), strict=True)]
    assert np.allclose(model.score(x), 1 / (1 + np.exp(log[0] - log[1])))
