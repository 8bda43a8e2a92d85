"""Exact deduplication with static binary fuse filters over immutable snapshots.

Documents come in batches. Each batch is grouped by its own (digest, normalised text): a hash aggregation
that combines copies before the shuffle, and whose text key compares bytes. The groups of a batch become an
immutable snapshot: Parquet rows (bucket, key, digest, text, first id, size) and, for each digest bucket, one
binary fuse filter. The digests of a later batch are screened by the filters of each earlier snapshot, bucket
by bucket; only positives are joined to the exact rows, where digest and text must agree byte for byte.

Buckets are by digest, hold about BUCKET_KEYS distinct digests, and so are even whatever the copies are like. A
batch that is larger than an earlier snapshot asks each of its filters in slices of about as many digests.

Defined cases: null counts as an empty text; texts are equal when identical after each run of
[\\x20\\x09-\\x0D] becomes one space; of equal texts the smallest id stays, a null id only if the group has no
other; rows that repeat an id with an equal text are counted in group_size and are kept or dropped alike.
Empty tables give empty results; other columns are not read, and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm import fuse
from glossa.llm.common import SPACES, stored, text_or_empty

#: Distinct digests that one filter holds, about; sets the number of buckets of a snapshot.
BUCKET_KEYS = 50_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACES, " ")


def digest_of(text: Column) -> Column:
    return F.sha2(text, 256)


def _key(digest: Column) -> Column:
    """64 bits of a hexadecimal digest."""
    return F.xxhash64(digest)


def groups_of(batch: DataFrame) -> DataFrame:
    """(digest, text_n, first_id, n) of the distinct normalised texts of a batch."""
    rows = batch.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(text_or_empty()).alias("text_n"))
    return rows.groupBy(digest_of(F.col("text_n")).alias("digest"), "text_n").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))


class Snapshot:
    """An immutable batch: its exact rows, their number, and one filter for each bucket of digests."""

    def __init__(self, exact: DataFrame, filters: DataFrame, buckets: int, groups: int):
        self.exact, self.filters, self.buckets, self.groups = exact, filters, buckets, groups


def snapshot(batch: DataFrame, name: str = "snapshot") -> Snapshot:
    """Write the groups of a batch and build the filters of their buckets."""
    exact = stored(batch.withColumn("key", _key(F.col("digest"))), name)
    groups = exact.count()
    buckets = max(1, -(-groups // BUCKET_KEYS))

    def build(keys: pa.Table) -> pa.Table:
        k = keys["key"].to_numpy()
        return pa.table({"bucket": pa.array([keys["bucket"][0].as_py()], pa.int64()), "filter": pa.array([fuse.build(k)], pa.binary())})

    keyed = exact.select(F.pmod("key", F.lit(buckets)).cast("long").alias("bucket"), "key")
    return Snapshot(exact, stored(keyed.groupBy("bucket").applyInArrow(build, "bucket long, filter binary"), f"{name}-filters"), buckets, groups)


def asked_of(batch: Snapshot, snap: Snapshot) -> tuple[DataFrame, int]:
    """The digests of a batch, dealt by the bucket of the snapshot that they fall into and by slice; the slices."""
    slices = max(1, -(-batch.groups // (snap.buckets * BUCKET_KEYS)))
    bucket, part = F.pmod("key", F.lit(snap.buckets)).cast("long"), F.pmod(F.xxhash64("key"), F.lit(slices)).cast("int")
    return batch.exact.select("digest", "key", bucket.alias("bucket"), part.alias("slice")), slices


def screen(batch: Snapshot, snap: Snapshot) -> DataFrame:
    """The digests (digest) of a batch that a filter of the snapshot may hold."""

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"digest": pa.array([], pa.string())})
        keep = fuse.contains(right["filter"][0].as_py(), left["key"].to_numpy())
        return left.select(["digest"]).filter(pa.array(keep))

    asked, slices = asked_of(batch, snap)
    filters = snap.filters.select("bucket", "filter", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    return asked.groupBy("bucket", "slice").cogroup(filters.groupBy("bucket", "slice")).applyInArrow(ask, "digest string")


def matches(batch: Snapshot, earlier: Snapshot) -> DataFrame:
    """The groups of both sides whose texts are the same bytes: rows (digest, check, side, first_id, n)."""
    positive = screen(batch, earlier)
    new = batch.exact.join(positive, "digest", "left_semi").alias("new")
    old = earlier.exact.join(positive, "digest", "left_semi").alias("old")
    # two inequalities: the comparison of bytes stays a condition on rows that already met by their digest
    same = (F.col("new.text_n") <= F.col("old.text_n")) & (F.col("new.text_n") >= F.col("old.text_n"))
    met = new.join(old, (F.col("new.digest") == F.col("old.digest")) & same)
    return met.select(F.col("new.digest").alias("digest"), F.xxhash64("new.text_n").alias("check"), *(F.struct(f"{side}.first_id", f"{side}.n").alias(side) for side in ("new", "old")))


def _slim(snap: Snapshot) -> DataFrame:
    return snap.exact.select("digest", F.xxhash64("text_n").alias("check"), "first_id", "n")


def classes(snaps: list[Snapshot]) -> DataFrame:
    """(digest, check, keep_id, group_size) of the equal texts of all snapshots, each screened against those before it."""
    own = reduce(DataFrame.unionByName, [_slim(s).withColumn("batch", F.lit(k)) for k, s in enumerate(snaps)])
    met = [
        matches(snaps[j], snaps[i]).select("digest", "check", F.explode(F.array(F.struct(F.lit(j).alias("batch"), "new.first_id", "new.n"), F.struct(F.lit(i).alias("batch"), "old.first_id", "old.n"))).alias("g"))
        for j in range(len(snaps))
        for i in range(j)
    ]
    if not met:
        return own.select("digest", "check", F.col("first_id").alias("keep_id"), F.col("n").alias("group_size"))
    shared = stored(reduce(DataFrame.unionByName, met).select("digest", "check", "g.*").distinct(), "shared")
    joined = shared.groupBy("digest", "check").agg(F.min("first_id").alias("keep_id"), F.sum("n").alias("group_size"))
    alone = own.join(shared.select("digest", "check"), ["digest", "check"], "left_anti")
    return alone.select("digest", "check", F.col("first_id").alias("keep_id"), F.col("n").alias("group_size")).unionByName(joined)


def exact_dedup(batches: list[DataFrame]) -> DataFrame:
    """One row per document of all batches: doc_id, keep_id, group_size, kept, text_sha256.

    Batches are added one after the other; each is screened against the snapshots of those before it.
    """
    whole = stored(classes([snapshot(groups_of(b), f"batch{k}") for k, b in enumerate(batches)]), "classes")
    rows = reduce(DataFrame.unionByName, [_row_keys(b) for b in batches])
    # both sides are plain scans, so that a group of many copies can be split among tasks
    joined = rows.join(whole, ["digest", "check"])
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return joined.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))


def _row_keys(batch: DataFrame) -> DataFrame:
    rows = batch.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(text_or_empty()).alias("text_n"))
    return rows.select("doc_id", digest_of(F.col("text_n")).alias("digest"), F.xxhash64("text_n").alias("check"))


def in_two_batches(docs: DataFrame) -> list[DataFrame]:
    """A table as it arrives: the lower half of its ids first, then the rest; null ids come last."""
    ends = docs.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).first()
    if ends["a"] is None:
        return [docs]
    first = F.coalesce(F.col("doc_id") <= (ends["a"] + ends["z"]) // 2, F.lit(False))
    return [docs.filter(first), docs.filter(~first)]
