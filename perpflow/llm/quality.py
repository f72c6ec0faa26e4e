"""Quality scores by a regularised quadratic discriminant over document statistics.

Statistics are taken from the whole text alone, transformed towards symmetry, and modelled as one Gaussian for each class.
Class covariances are shrunk towards the pooled one and that towards a multiple of the identity.
A score is the logistic of the difference of the two Mahalanobis log densities, with
Cholesky factors worked out once and reused for every batch. Means and covariances are Spark aggregates
over all labelled rows; the driver gets two rows of them, whatever the size of the corpus.

Cases: null text is empty and has the statistics of an empty text; labels that are null are left out; a document with
several labels counts once for each; a class without labelled rows gives every row the score of the
other class's share (0.5 where there are no labels at all); repeated rows give repeated rows;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from perpflow.llm.text import grams, joined, slices, steady, words
from perpflow.session import cut_lineage

STATISTICS = ("bytes", "word_bytes", "upper", "symbols", "marks", "digits", "distinct", "foreign", "stops", "repeats", "short")
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#$%&*|@^~<>{}[]_=+\\/")] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[list(b"!?")] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".,;:")] = True


def statistics(texts: pa.Array) -> np.ndarray:
    """One row for each text, one column for each of STATISTICS."""
    data, bounds = joined(texts)
    n = len(bounds) - 1
    size = np.diff(bounds)

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[bounds[1:]] - total[bounds[:-1]]

    starts, ends, word, owner = words(data, bounds)
    many = np.bincount(owner, minlength=n)
    length = np.bincount(owner, ends - starts, minlength=n)

    def distinct(values: np.ndarray, of: np.ndarray) -> np.ndarray:
        order = np.lexsort((values, of))
        v, o = values[order], of[order]
        new = np.ones(len(v), dtype=bool)
        new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
        return np.bincount(o[new], minlength=n)

    triple, at = grams(word, owner, 3)
    triples = np.bincount(owner[at], minlength=n)
    last = data[ends - 1] if len(ends) else data[:0]

    def share(found: np.ndarray, of: np.ndarray, usual: float, weight: int) -> np.ndarray:
        """A share, drawn to its usual value by ``weight`` made-up observations: short texts say little."""
        return (found + usual * weight) / (of + weight)

    by_byte = lambda mask, usual: np.sqrt(share(count(mask), size, usual, 60))
    by_word = lambda found, usual: share(found, many, usual, 12)
    return np.stack([
        np.log(size + 300.0), np.log(by_word(length, 6.0)),
        by_byte((data >= 65) & (data <= 90), 0.02), by_byte(_SYMBOL[data], 0.0), by_byte(_MARK[data], 0.0),
        by_byte((data >= 48) & (data <= 57), 0.0), by_word(distinct(word, owner), 0.8), by_byte(data >= 128, 0.05),
        np.sqrt(by_word(np.bincount(owner, _STOP[last], minlength=n), 0.15)),
        np.sqrt(np.maximum(0, 1 - share(distinct(triple, owner[at]), triples, 1.0, 12))),
        by_word(np.bincount(owner, ends - starts <= 3, minlength=n), 0.3),
    ], axis=1)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = statistics(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c) for c in rows.T)], ["doc_id", *STATISTICS])


def with_statistics(docs: DataFrame) -> DataFrame:
    steady(docs.sparkSession)
    schema = "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS)
    return docs.selectExpr("cast(doc_id as long) AS doc_id", "text").mapInArrow(_statistics, schema)


@dataclass(frozen=True)
class Discriminant:
    """Class means, inverse Cholesky factors of the shrunk covariances, log determinants and log priors."""

    mean: np.ndarray
    factor: np.ndarray
    logdet: np.ndarray
    prior: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.factor):
            return np.full(len(x), float(self.prior[0]))
        z = [(x - m) @ f.T for m, f in zip(self.mean, self.factor, strict=True)]
        density = [p - 0.5 * (np.einsum("ij,ij->i", d, d) + ld) for d, ld, p in zip(z, self.logdet, self.prior, strict=True)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -500, 500)))


def fit(labelled: DataFrame, shrink: float = 0.2, ridge: float = 0.02) -> Discriminant:
    """From (STATISTICS..., label 0 or 1), all rows."""
    pairs = [(i, j) for i in range(len(STATISTICS)) for j in range(i + 1)]
    rows = (
        labelled.where("label IN (0, 1)").groupBy("label").agg(
            F.count(F.lit(1)).alias("n"), F.array(*(F.avg(s) for s in STATISTICS)).alias("mean"),
            F.array(*(F.covar_pop(STATISTICS[i], STATISTICS[j]) for i, j in pairs)).alias("cov"))
        .orderBy("label").collect())
    count = {r.label: r.n for r in rows}
    if len(rows) < 2:
        share = float(count.get(1, 0)) / sum(count.values()) if count else 0.5
        none = np.zeros((0, 0))
        return Discriminant(none, none, none, np.array([share]))
    cov = []
    for r in rows:
        c = np.zeros((len(STATISTICS), len(STATISTICS)))
        for (i, j), v in zip(pairs, r.cov, strict=True):
            c[i, j] = c[j, i] = v
        cov.append(c)
    n = np.array([r.n for r in rows], dtype=float)
    pooled = sum(c * k for c, k in zip(cov, n, strict=True)) / n.sum()
    # Scale-free ridge: every statistic gets a share of its own pooled variance, and a floor.
    floor = np.diag(ridge * np.diag(pooled) + 1e-6)
    factors, logdets = [], []
    for c in cov:
        low = np.linalg.cholesky((1 - shrink) * c + shrink * pooled + floor)
        factors.append(np.linalg.inv(low))
        logdets.append(2 * np.log(np.diag(low)).sum())
    return Discriminant(np.array([r.mean for r in rows]), np.array(factors), np.array(logdets), np.log(n / n.sum()))


def held_out(doc_id: Column) -> Column:
    """A third of the ids, fixed by their checksum, that no model may learn from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(statistics: DataFrame, labels: DataFrame) -> Discriminant:
    known = labels.selectExpr("cast(doc_id as long) AS doc_id", "quality AS label").where(~held_out(F.col("doc_id")))
    return fit(statistics.join(known, "doc_id"))


def _scores(model: Discriminant):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(s).to_numpy(zero_copy_only=False) for s in STATISTICS], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    return run


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row."""
    found = cut_lineage(with_statistics(docs))
    model = train(found, labels)
    return found.mapInArrow(_scores(model), "doc_id long, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def score_column(model: Discriminant, text: Column) -> Column:
    """The score of a text column, for use beside other columns."""

    def score(part: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in part:
            out = [model.score(statistics(b.column("text"))) for b in slices(iter([pa.RecordBatch.from_arrays([pa.array(series, pa.string())], ["text"])]))]
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    score.__annotations__ = {"part": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(score, "double")(text)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with all their columns."""
    model = train(cut_lineage(with_statistics(docs)), labels)
    return docs.where(score_column(model, F.col("text")) >= 0.5)
