"""Scorers: the protocol of plug-in language models, and a native bigram model as the default.

The native model is counts; scoring a sentence is a join of its distinct bigrams with them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions.text import tokenize
from glossa.session import settled


class LanguageModel(Protocol):
    """What a backend offers (L1): ids of texts, and log probabilities of sequences at temperatures."""

    def encode(self, text: str) -> list[int]: ...

    def sequence_logprobs(self, sequences: list[list[int]], temperatures: list[float]) -> list[list[float]]: ...


REGISTRY: dict[str, Callable[[], LanguageModel]] = {}


def resolve(spec: str) -> Callable[[], LanguageModel]:
    """A registered name, or module:attribute (L2)."""
    if spec in REGISTRY:
        return REGISTRY[spec]
    module, _, name = spec.partition(":")
    if not name:
        raise ValueError(f"unknown backend {spec}; known are {', '.join(sorted(REGISTRY)) or 'none'}, or module:attribute")
    from importlib import import_module

    return getattr(import_module(module), name)


def scored(texts: DataFrame, key: str, key_type: str, backend: Callable[[], LanguageModel], temperatures: list[float], text: str = "text") -> DataFrame:
    """(key, scores): sequence log probabilities per temperature by a plug-in, loaded once per Python worker."""

    def run(batches) -> Iterator:
        import pandas as pd

        model = backend()
        for b in batches:
            out = model.sequence_logprobs([model.encode(t or "") for t in b[text]], temperatures)
            yield pd.DataFrame({key: b[key], "scores": [list(map(float, s)) for s in out]})

    return texts.select(key, text).mapInPandas(run, f"{key} {key_type}, scores array<double>")


def conforms(model: LanguageModel, texts: list[str], tolerance: float = 1e-4) -> None:
    """The contract of a backend: scores are finite, don't depend on the batch and repeat."""
    ids = [model.encode(t) for t in texts]
    together = model.sequence_logprobs(ids, [1.0, 2.0])
    alone = [model.sequence_logprobs([i], [1.0, 2.0])[0] for i in ids]
    for a, b in zip(together, alone):
        if len(a) != 2 or any(abs(x - y) > tolerance or x != x for x, y in zip(a, b)):
            raise ValueError("scores depend on the batch, or are not numbers")


def bigrams(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, place, a, b): neighbouring words; the first follows <s>."""
    rows = texts.select(key, tokenize(F.col(text)).alias("w")).filter(F.size("w") > 0)
    # two arrays, one a word behind, zipped: generated code all the way
    pairs = F.arrays_zip(F.concat(F.array(F.lit("<s>")), F.slice("w", 1, F.size("w") - 1)).alias("a"), F.col("w").alias("b"))
    return rows.select(key, F.posexplode(pairs).alias("place", "p")).select(key, "place", "p.a", "p.b")


def train_bigrams(docs: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """((a, b, n), (a, n_a)): counts of bigrams and of their first words; the corpus is counted once."""
    pairs = settled(bigrams(docs, key).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")))
    return pairs, pairs.groupBy("a").agg(F.sum("n").alias("n_a"))


def bigram_scores(texts: DataFrame, key: str, model: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(key, n, logprob): add-one log probabilities of texts."""
    pairs, firsts = model
    size = pairs.agg(F.countDistinct("b").alias("v"))
    rows = bigrams(texts, key)
    asked = rows.select("a", "b").distinct().join(pairs, ["a", "b"], "left").join(firsts, "a", "left").crossJoin(F.broadcast(size))  # one row
    known = asked.select("a", "b", F.ln((F.coalesce("n", F.lit(0)) + 1) / (F.coalesce("n_a", F.lit(0)) + F.col("v"))).alias("lp"))
    return rows.join(known, ["a", "b"]).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum("lp").alias("logprob"))


def ranked(scores: DataFrame, by: list[str], score: str, tie: str) -> DataFrame:
    """Places of candidates by descending score."""
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), tie)
    return scores.withColumn("place", F.row_number().over(order))
