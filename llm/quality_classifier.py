"""Regularised quadratic discriminant analysis over transformed statistics of documents.

Class covariances are shrunk towards the pooled diagonal; a score is the logistic of the difference of the two
Mahalanobis log densities plus the log prior odds, with the Cholesky factor of each class computed once.

Fitting takes every labelled row of the training folds: only counts, sums and outer products of about a dozen
statistics are added up, so what reaches the driver does not depend on the number of rows.

Defined cases: null and empty texts get the statistics of an empty text and so a score. A document labelled more than
once counts once, with its highest label; null labels don't count. Of rows of one doc_id with different texts, that of
the least statistics is learnt from, and each is scored. With labels of one class only, that class is
certain (score 0 or 1); with none, every score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, map_text, pieces, saved, table, unsigned_crc, utf8
from .quality_rules import BARS, LETTERS, MARKS, SYMBOLS, UPPER, Lines

THRESHOLD = 0.3
#: Ids of labelled documents, 8 bytes each, that are broadcast; beyond, both sides are dealt out by id.
BROADCAST_IDS = 1 << 21
FEATURES = (
    "words", "word_length", "symbols", "exclamations", "bars", "capitals", "repeats", "echoes", "line_length", "stops", "commas", "digits", "wide", "repeated_lines", "marks",
)


def _is(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_BANG, _STOP, _COMMA, _DIGIT, _WIDE = _is(b"!"), _is(b"."), _is(b","), _is(b"0123456789"), np.arange(256) >= 0x80


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of transformed statistics for each document: logs of sizes and smoothed log rates."""
    x = Lines(data, off)
    n = x.n_words.astype(float)
    chars = x.by_doc((data & 0xC0 != 0x80) & ~SPACE[data])
    letters = x.by_doc(LETTERS[data])
    lines = np.bincount(x.doc, minlength=len(n))
    rate = lambda k, of: np.log((k + 0.5) / (of + 10.0))
    many = lambda chosen, of: rate(x.by_doc(chosen[data]), of)
    echo = x.total(x.echoes(), x.first[:-1], x.first[1:])
    return np.column_stack([
        np.log1p(n), np.log((chars + 50) / (n + 10)), many(SYMBOLS, n), many(_BANG, n), many(BARS, n), many(UPPER, letters), rate(x.repeated_words(), n), rate(echo, n),
        np.log((n + 10) / (lines + 1)), many(_STOP, n), many(_COMMA, n), many(_DIGIT, n), many(_WIDE, chars), rate(x.repeated_lines(), lines), many(MARKS, chars),
    ])


@dataclass
class Discriminant:
    """Means, Cholesky factors of the inverse covariances and log normalisers of the two classes."""

    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray

    @staticmethod
    def fit(counts: np.ndarray, sums: np.ndarray, products: np.ndarray, shrinkage: float = 0.1, ridge: float = 1e-3) -> Discriminant | float:
        """From counts (2), sums (2, p) and sums of outer products (2, p, p). A number: the score of every document."""
        if not counts.all():
            return 0.5 if not counts.any() else float(counts[1] > 0)
        means = sums / counts[:, None]
        scatter = [products[k] - counts[k] * np.outer(means[k], means[k]) for k in (0, 1)]
        pooled = np.diag(np.diag(scatter[0] + scatter[1])) / counts.sum()
        p = sums.shape[1]
        factors, offsets = [], []
        for k in (0, 1):
            # a class of few rows is shrunk further
            a = min(1.0, shrinkage + p / (p + counts[k]))
            cov = (1 - a) * scatter[k] / counts[k] + a * pooled + ridge * np.eye(p)
            low = np.linalg.cholesky(cov)
            factors.append(np.linalg.inv(low))
            offsets.append(np.log(counts[k] / counts.sum()) - np.log(np.diag(low)).sum())
        return Discriminant(means, np.array(factors), np.array(offsets))

    def scores(self, x: np.ndarray) -> np.ndarray:
        logs = [self.offsets[k] - 0.5 * (((x - self.means[k]) @ self.factors[k].T) ** 2).sum(1) for k in (0, 1)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    def run(piece: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> dict:
        x = statistics(data, off)
        return {"doc_id": piece.column("doc_id"), "x": pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))}

    return map_text(docs.selectExpr(f"`{key}` AS doc_id", f"`{text}` AS text"), run, "doc_id long, x array<double>")


def fit(labelled: DataFrame) -> Discriminant | float:
    """labelled: x array<double>, label int. Moments are summed on the executors; 2 (1 + p + p * p) numbers come back."""
    p = len(FEATURES)

    def moments(batches):
        total = np.zeros((2, 1 + p + p * p))
        for pdf in batches:
            for k in (0, 1):
                x = np.array(pdf["x"][pdf["label"] == k].tolist()).reshape(-1, p)
                total[k] += np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
        yield pd.DataFrame({"at": np.arange(total.size), "value": total.ravel()})

    got = labelled.mapInPandas(moments, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    total = np.zeros(2 * (1 + p + p * p))
    for row in got:
        total[row["at"]] = row["value"]
    total = total.reshape(2, -1)
    return Discriminant.fit(total[:, 0], total[:, 1 : 1 + p], total[:, 1 + p :].reshape(2, p, p))


def score(table_of_features: DataFrame, model: Discriminant | float) -> DataFrame:
    """Adds score; the model is a few kilobytes, whatever the corpus."""

    @F.pandas_udf("double")
    def scored(x: pd.Series) -> pd.Series:
        if isinstance(model, float):
            return pd.Series(np.full(len(x), model))
        return pd.Series(model.scores(np.array(x.tolist()).reshape(len(x), -1)))

    return table_of_features.withColumn("score", scored("x"))


def one_label(labels: DataFrame, column: str = "quality") -> DataFrame:
    return labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(column).alias("label"))


def train(x: DataFrame, labels: DataFrame) -> Discriminant | float:
    """Fits on features x (doc_id, x) of the folds that are not held out: every fifth document by crc32 of its id is."""
    rows = x.where(~held_out()).groupBy("doc_id").agg(F.min("x").alias("x")).join(one_label(labels), "doc_id")
    return fit(rows.select("x", "label"))


def held_out() -> F.Column:
    return F.coalesce(unsigned_crc("doc_id") % 5 == 0, F.lit(True))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    x = saved(features(docs))
    return score(x, train(x, labels)).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text scores at least the threshold."""
    # only labelled documents are learnt from, so that only theirs need statistics
    ids = labels.where("doc_id IS NOT NULL").select("doc_id").distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    model = train(features(docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")), labels)

    def good(batches):
        for piece in pieces(batches):
            x = statistics(*utf8(piece.column("text")))
            scores = np.full(len(x), model) if isinstance(model, float) else model.scores(x)
            yield piece.filter(pa.array(scores >= threshold))

    return docs.mapInArrow(good, docs.schema)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
