"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance that is shrunk towards its diagonal and towards the pooled one; the
score is the logistic of the difference of the Mahalanobis log densities plus the log prior odds, scaled so
that the fitted rows are calibrated. The Cholesky factors are computed once, on the driver, and sent as a
few hundred numbers; scoring is one pass without a shuffle.

The model learns from a bounded sample (FIT_ROWS) of labelled rows whose crc32 of the id, taken modulo
FOLDS, is not HELD_OUT. Labels, language, source and id are never inputs of a score.

Defined cases: a null text counts as empty and is scored as such; null labels and labels without a document
are left out; a document labelled several times counts by its largest label, and of rows that repeat an id one is
fitted on; with fewer than two rows of a
class every score is the prior's; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm import textstats
from glossa.llm.common import short_batches
from glossa.llm.quality_rules import labelled_sample, sample_statistics

FIT_ROWS = 16_000
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
#: Weights of the diagonal and of the pooled covariance in a class covariance, and a floor on variances.
TO_DIAGONAL, TO_POOLED, FLOOR = 0.1, 0.1, 1e-3


def fold_of(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string")) % FOLDS


def vector(raw: np.ndarray) -> np.ndarray:
    """Statistics as roots and logarithms, which are nearer to normal than counts are."""
    x = raw.astype(np.float64)
    words, chars, lines = np.maximum(x[:, 0], 1), np.maximum(x[:, 1], 1), np.maximum(x[:, 5], 1)
    return np.column_stack([
        np.log1p(x[:, 0]),
        np.log(chars / words + 0.5),
        np.sqrt(x[:, 2] / chars),
        np.sqrt(x[:, 3] / lines),
        np.sqrt(x[:, 4] / words),
        np.log(words / lines),
        np.log(x[:, 6] + 1) - 0.8 * np.log(words + 1),
        np.sqrt(x[:, 7] / chars),
        np.sqrt(x[:, 8] / chars),
        np.sqrt(x[:, 9] / words),
        np.sqrt(x[:, 11] / words),
    ])


class QuadraticDiscriminant:
    def __init__(self, x: np.ndarray, label: np.ndarray):
        self.center = x.mean(0) if len(x) else np.zeros(11)
        self.scale = np.maximum(x.std(0), 1e-6) if len(x) else np.ones(11)
        z = (x - self.center) / self.scale
        parts = [z[label == k] for k in (0, 1)]
        counts = np.array([len(p) for p in parts], dtype=np.float64)
        self.prior = float(np.log((counts[1] + 1) / (counts[0] + 1)))
        self.flat = counts.min() < 2
        self.slope, self.shift = 1.0, 0.0
        if self.flat:
            return
        covs = [np.cov(p.T) for p in parts]
        pooled = sum(n * c for n, c in zip(counts, covs)) / counts.sum()
        self.means = [p.mean(0) for p in parts]
        # Cholesky factors of the shrunk covariances, cached inverted: a Mahalanobis distance is one product
        self.inverse, self.logdet = [], []
        for c in covs:
            s = (1 - TO_DIAGONAL - TO_POOLED) * c + TO_DIAGONAL * np.diag(np.diag(c)) + TO_POOLED * pooled + FLOOR * np.eye(len(c))
            factor = np.linalg.cholesky(s)
            self.inverse.append(np.linalg.inv(factor).T)
            self.logdet.append(2 * float(np.log(np.diag(factor)).sum()))
        self._calibrate(self.difference(x), label)

    def difference(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.center) / self.scale
        dens = [-0.5 * ((((z - m) @ inv) ** 2).sum(1) + ld) for m, inv, ld in zip(self.means, self.inverse, self.logdet)]
        return dens[1] - dens[0] + self.prior

    def _calibrate(self, d: np.ndarray, label: np.ndarray) -> None:
        """Logistic slope and shift on the fitted rows, by Newton steps with a little weight decay."""
        c = np.clip(d, -30, 30) / 10
        a, b = 1.0, 0.0
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(a * c + b, -40, 40)))
            w, r = p * (1 - p), p - label
            g = np.array([(r * c).sum() + a, r.sum() + b])
            h = np.array([[(w * c * c).sum() + 1, (w * c).sum()], [(w * c).sum(), w.sum() + 1]])
            step = np.linalg.solve(h, g)
            step *= min(1.0, 0.5 / max(1e-12, float(np.abs(step).max())))
            a, b = a - float(step[0]), b - float(step[1])
        if a > 0:
            self.slope, self.shift = a / 10, b

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.flat:
            return np.full(len(x), 1 / (1 + np.exp(-self.prior)))
        return 1 / (1 + np.exp(-np.clip(self.slope * np.clip(self.difference(x), -30, 30) + self.shift, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> QuadraticDiscriminant:
    raw, label = sample_statistics(labelled_sample(docs, labels, "quality", rows, fold_of(F.col("doc_id")) != HELD_OUT))
    return QuadraticDiscriminant(vector(raw), label)


SCHEMA = "doc_id long, score double"


def scores(docs: DataFrame, model: QuadraticDiscriminant) -> DataFrame:
    """(doc_id, score) of every document."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                raw = np.array([textstats.stats(t) for t in b["text"].to_pylist()], dtype=np.int64)
                yield pa.record_batch([b["doc_id"], pa.array(model.score(vector(raw)))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every document; rows of the held-out fold are marked, as the model has not seen them."""
    out = scores(docs, fit(docs, labels))
    return out.select(
        "doc_id",
        F.coalesce(fold_of(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
