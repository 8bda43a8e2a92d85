"""Quality rules: an isolation forest over rule statistics, its threshold calibrated on labelled rows.

Every text gets the fixed base rules and a vector of rule statistics. The forest is grown on rows labelled
good, so that its path lengths say how unusual a document is among good ones. A tree takes TREE_ROWS of them,
as the method has it, and all trees together take as many different ones as they can hold. The margins and the
threshold, the lowest anomaly score that spares a stated share of the good rows, are those of all labelled
rows. Documents are scored in one pass, without a shuffle.

Defined cases: a null text counts as empty, which the base rules reject; labels that are null or that
have no document are left out; a document labelled several times counts by its largest label, and of rows
that repeat an id one is fitted on; without a good labelled row the verdict is that of the base rules. Ties
and repeated rows are scored alike, an empty table gives an empty result, and columns other than the text
and the id are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm import textstats
from glossa.llm.common import forget, short_batches, stored

#: Base rules: fewest words, and the share of words in repeated windows above which a text fails.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
TREES, TREE_ROWS = 96, 256
#: Spreads by which the range of a cut goes beyond the values that a node holds.
MARGIN = 1.0
#: Share of good labelled rows that the threshold may reject.
SPARE = 0.004
SEED = 11


def vector(raw: np.ndarray) -> np.ndarray:
    """Rule statistics: shares and logarithms, so that the length of a text alone says little."""
    x = raw.astype(np.float64)
    words, chars = np.maximum(x[:, 0], 1), np.maximum(x[:, 1], 1)
    return np.column_stack([
        x[:, 1] / words,
        x[:, 2] / chars,
        x[:, 3] / np.maximum(x[:, 5], 1),
        x[:, 4] / words,
        x[:, 7] / chars,
        x[:, 8] / chars,
        x[:, 9] / words,
        x[:, 11] / words,
        np.log1p(words) * (1 - x[:, 6] / words),
    ])


def base_failed(raw: np.ndarray) -> np.ndarray:
    return (raw[:, 0] < MIN_WORDS) | (100 * raw[:, 4] > MAX_REPEAT_PERCENT * raw[:, 0])


def mean_path(n) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points, the forest's yardstick."""
    n = np.asarray(n, dtype=np.float64)
    h = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    return np.where(n > 2, 2 * h - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Random axis splits; each tree is five flat arrays, walked for all rows of a batch at once."""

    def __init__(self, x: np.ndarray, margin: np.ndarray, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.size = min(TREE_ROWS, len(x))
        self.depth = max(1, math.ceil(math.log2(max(2, self.size))) + 2)
        # Good rows hold no value at all on some axes. Ranges are widened by a spread of each axis among all
        # labelled rows, so that a row beyond what the good ones show is cut off early.
        self.trees = [self._grow(margin, x[rng.choice(len(x), self.size, replace=False)], rng) for _ in range(TREES)]

    def _grow(self, margin: np.ndarray, x: np.ndarray, rng) -> tuple[np.ndarray, ...]:
        axis, cut, left, right, path = [], [], [], [], []

        def node(rows: np.ndarray, depth: int) -> int:
            at = len(axis)
            axis.append(0), cut.append(np.inf), left.append(at), right.append(at)
            path.append(depth + float(mean_path(len(rows))))
            if depth < self.depth and len(rows) > 1:
                low, high = rows.min(0), rows.max(0) + margin
                a = int(rng.choice(len(low)))
                c = float(rng.uniform(low[a], high[a]))
                axis[at], cut[at] = a, c
                left[at] = node(rows[rows[:, a] <= c], depth + 1)
                right[at] = node(rows[rows[:, a] > c], depth + 1)
            return at

        node(x, 0)
        return np.array(axis), np.array(cut), np.array(left), np.array(right), np.array(path)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1); larger is more unusual."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for axis, cut, left, right, path in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = np.where(x[rows, axis[at]] <= cut[at], left[at], right[at])
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / max(1e-9, float(mean_path(self.size))))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, where=None) -> DataFrame:
    """(doc_id, text, label) of at most `rows` labelled documents, those with the smallest hashes of the id.

    One row per id: of rows that repeat an id, the one with the smallest hash of the text.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).dropna()
    if where is not None:
        marks = marks.filter(where)
    marks = marks.groupBy("doc_id").agg(F.max("label").alias("label"))
    # a top-k that every task cuts first; `rows` bounds what is broadcast, too
    marks = stored(marks.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(rows), "labelled")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(marks), "doc_id")
    one = F.min(F.struct(F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text"))
    return found.groupBy("doc_id").agg(one.alias("t"), F.max("label").alias("label")).select("doc_id", "t.text", "label")


RAW_SCHEMA = "doc_id long, label int, raw array<long>"


def _raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw = [textstats.stats(t) for t in b["text"].to_pylist()]
        yield pa.record_batch([b["doc_id"], b["label"], pa.array(raw, pa.list_(pa.int64()))], names=["doc_id", "label", "raw"])


def sample_statistics(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The statistics and labels of a bounded sample, in the order of the ids."""
    short_batches(sample.sparkSession)
    got = sorted(((r.doc_id, r.label, tuple(r.raw)) for r in sample.select("doc_id", "text", "label").mapInArrow(_raw, RAW_SCHEMA).collect()))
    raw = np.array([r[2] for r in got], dtype=np.int64).reshape(len(got), len(textstats.NAMES))
    return raw, np.array([r[1] for r in got], dtype=np.int64)


AXES = [f"v{k}" for k in range(9)]


def labelled_vectors(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, label, v0...) of all labelled documents that the base rules pass; one row per id, as in labelled_sample().

    Statistics are taken inside the scan and joined with the labels: texts aren't moved.
    """
    short_batches(docs.sparkSession)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).dropna().groupBy("doc_id").agg(F.max("label").alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                raw = np.array([textstats.stats(t) for t in b["text"].to_pylist()], dtype=np.int64)
                yield pa.record_batch([b["doc_id"], b["h"], pa.array(base_failed(raw)), *map(pa.array, vector(raw).T.copy())], names=["doc_id", "h", "failed", *AXES])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"))
    rows = rows.mapInArrow(run, f"doc_id long, h long, failed boolean, {', '.join(f'{v} double' for v in AXES)}")
    one = rows.join(marks, "doc_id").groupBy("doc_id").agg(F.max("label").alias("label"), F.min(F.struct("h", "failed", *AXES)).alias("t"))
    return stored(one.filter("not t.failed and label in (0, 1)").select("doc_id", "label", *(f"t.{v}" for v in AXES)), "vectors")


def order_statistic(rows: DataFrame, value: str, k: int, few: int = 1000) -> float:
    """The k-th smallest value, from 0, of all rows: counts in bins, ever narrower; the driver gets fixed numbers of rows."""
    v = F.col(value)
    low, high = rows.agg(F.min(v), F.max(v)).first()
    while low < high:
        inside = rows.filter(v.between(low, high))
        bins = inside.groupBy(F.least(F.floor((v - low) / (high - low) * 1024), F.lit(1023)).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("low"), F.max(v).alias("high")).orderBy("b").collect()
        for b in bins:
            if k < b.n:
                break
            k -= b.n
        low, high = b.low, b.high
        if b.n <= few:
            return sorted(r[0] for r in rows.filter(v.between(low, high)).select(v).collect())[k]
    return low


def fit(docs: DataFrame, labels: DataFrame) -> tuple[IsolationForest | None, float]:
    """The forest and its threshold; a document is kept if its score does not exceed it."""
    rows = labelled_vectors(docs, labels)
    spread = rows.agg(F.count_if(F.col("label") == 1).alias("n"), *(F.stddev_pop(v).alias(v) for v in AXES)).first()
    if spread.n < 8:
        return None, 1.0
    # a sum's last digits depend on the order of its terms
    margin = np.array([float(f"{spread[v]:.9e}") for v in AXES])
    own = rows.filter("label = 1").withColumn("h", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 53)))
    if spread.n > TREES * TREE_ROWS:  # by the place of the last hash, not by a top-k of every task
        own = own.filter(F.col("h") <= order_statistic(own, "h", TREES * TREE_ROWS - 1))
    own = sorted(own.collect(), key=lambda r: r.doc_id)
    forest = IsolationForest(np.array([[r[v] for v in AXES] for r in own]), MARGIN * margin + 1e-12)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.record_batch([b["label"], pa.array(forest.score(np.column_stack([b[v].to_numpy() for v in AXES])))], names=["label", "score"])

    scores = stored(rows.mapInArrow(run, "label int, score double"), "scores")
    # the strictest threshold that spares enough good rows; halfway to the next bad row, if one lies beyond it
    least = order_statistic(scores.filter("label = 1"), "score", math.ceil((1 - SPARE) * (spread.n - 1))) + 1e-9
    caught = scores.filter((F.col("label") == 0) & (F.col("score") > least)).agg(F.min("score")).first()[0]
    forget(rows, scores)
    return forest, least if caught is None else (least + caught) / 2


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, anomaly double, kept boolean"


def scored(docs: DataFrame, forest: IsolationForest | None, threshold: float) -> DataFrame:
    """One row per document: statistics, the base verdict, the anomaly score and the final verdict."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            raw = np.array([textstats.stats(t) for t in b["text"].to_pylist()], dtype=np.int64)
            failed = base_failed(raw)
            odd = forest.score(vector(raw)) if forest else np.zeros(len(raw))
            columns = [b["doc_id"], *(pa.array(raw[:, i]) for i in range(5)), pa.array(failed), pa.array(odd), pa.array(~failed & (odd <= threshold))]
            yield pa.record_batch(columns, names=["doc_id", *textstats.NAMES[:5], "base_failed", "anomaly", "kept"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled rows, then score every document."""
    return scored(docs, *fit(docs, labels))


def passing(docs: DataFrame, forest: IsolationForest | None, threshold: float) -> DataFrame:
    """The rows of docs that are kept, with all their columns: a filter inside the scan, without a join."""
    short_batches(docs.sparkSession)
    names = docs.columns
    plain = docs.toDF(*(f"c{k}" for k in range(len(names))))  # a column may have a dot in its name
    text = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                raw = np.array([textstats.stats(t) for t in b[text].to_pylist()], dtype=np.int64)
                odd = forest.score(vector(raw)) if forest else np.zeros(len(raw))
                yield b.filter(pa.array(~base_failed(raw) & (odd <= threshold)))

    return plain.mapInArrow(run, plain.schema).toDF(*names)
