"""A training-data pipeline over ``documents``: five stages, each a production operator.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read
again as the next stage's input. All stages but the last return the columns of documents. A stage deletes the
tables that the stage before it has left in the shared folder, so a result is to be written before the next
stage is called in the same thread; other threads, sessions and drivers have folders of their own.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm import bpe, exact_dedup, mixing, quality_rules, simhash
from glossa.llm.common import delete, drop_stored, shared_dir, stored, table, text_or_empty


def _ones_left(docs: DataFrame, verdict: DataFrame, key: Column) -> DataFrame:
    """The rows of docs that stay: one of each group. verdict: doc_id, key, group_size and kept of each row.

    Rows go by id and key, of which ids may be null or repeated. Where several rows of a group agree in the id and
    the key of the row that stays, one of them does: the one whose columns, as JSON, hash to the smallest number.
    The join is always a sort-merge join: the plan, and with it the disk that it needs, is the same at every size.
    """
    groups = verdict.filter(F.col("group_size") > 1).groupBy("doc_id", "key").agg(F.bool_or("kept").alias("one_stays"), F.count(F.lit(1)).alias("n"))
    gone = stored(groups.filter(~F.col("one_stays") | (F.col("n") > 1)).drop("n"), "dropped")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"), key.alias("own")).alias("d")
    same = F.col("d.id").eqNullSafe(F.col("x.doc_id")) & (F.col("d.own") == F.col("x.key"))
    left = rows.join(gone.hint("merge").alias("x"), same, "left_anti").select("row")
    if not (several := gone.filter("one_stays")).isEmpty():
        again = rows.join(several.hint("merge").alias("x"), same, "left_semi")
        one = F.min_by("row", F.struct(F.xxhash64(F.to_json("row")), F.to_json("row")))
        left = left.unionByName(again.groupBy("id", "own").agg(one.alias("row")).select("row"))
    return left.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the isolation forest."""
    drop_stored(spark)
    return quality_rules.passing(docs, *quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id."""
    drop_stored(spark)
    verdict = exact_dedup.exact_dedup(exact_dedup.in_two_batches(docs))
    verdict = verdict.select("doc_id", F.col("text_sha256").alias("key"), "group_size", "kept")
    return _ones_left(docs, verdict, exact_dedup.digest_of(exact_dedup.normalised(text_or_empty())))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of close fingerprints, the document with the smallest id."""
    drop_stored(spark)
    verdict = simhash.simhash_components(docs)
    verdict = verdict.select("doc_id", F.col("text_hash").alias("key"), F.col("component_size").alias("group_size"), "kept")
    return _ones_left(docs, verdict, simhash.text_hash(F.col("text")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents are repeated for complete epochs, or left out, by their source's target."""
    drop_stored(spark)
    return mixing.mixed_documents(docs)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and the decoded texts."""
    drop_stored(spark)
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", apply_quality_rules),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode_bytes),
]

#: The forest, the fingerprints and the merges have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written into the shared folder before the next begins, and deleted
    when the next one is written. The last one stays: the caller reads it."""
    docs, own = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{own}-{k}")
        docs = spark.read.parquet(f"{own}-{k}")
        if k:
            delete(spark, f"{own}-{k - 1}")
    drop_stored(spark)
    return docs
