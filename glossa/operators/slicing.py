"""Row numbering, slicing, splitting and sampling. Order is always by a key, never by arrival."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions.text import uniform
from glossa.session import settled


def numbered(df: DataFrame, *order: str, name: str = "record_index") -> DataFrame:
    """Gapless numbers from 0 in the order of the columns (A3, A6), without bringing all rows into one task.

    Rows are range-partitioned by the order, counted per partition, and numbered from their partition's start.
    """
    part = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    # range bounds are sampled, so the dealt rows are written once: a second sample could deal them otherwise
    part = settled(part.withColumn("_place", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("long"), 33)))
    counts = part.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    # one row per partition: the broadcast is as small as the number of tasks
    joined = part.join(F.broadcast(starts), "_part")
    return joined.withColumn(name, F.col("_start") + F.col("_place")).drop("_part", "_place", "_start")


def shard_bounds(rows: int, shard: int, shards: int) -> tuple[int, int]:
    """[start, end) of a contiguous shard; the last ones may be empty."""
    if not 0 <= shard < shards:
        raise ValueError(f"shard {shard} is not in 0..{shards - 1}")
    step = math.ceil(rows / shards) if rows else 0
    start = min(shard * step, rows)
    return start, min(start + step, rows)


def contiguous_shard(index: Column, rows: Column, shards: int) -> Column:
    """The contiguous shard of a row index."""
    return F.floor(index / F.ceil(rows / shards)).cast("int")


def strided_shard(df: DataFrame, index: str, rank: int, world: int) -> DataFrame:
    """Rows whose index is rank modulo world (C4)."""
    return df.filter(F.col(index) % world == rank)


def row_range(rows: int, start: int = 0, end: int = 0, shard: int | None = None, shards: int | None = None) -> tuple[int, int]:
    """One of a range and a shard; an end of 0 means all the rest."""
    if (shard is None) != (shards is None):
        raise ValueError("shard and shards go together")
    if shard is not None:
        if start or end:
            raise ValueError("a range and a shard exclude each other")
        return shard_bounds(rows, shard, shards)
    end = end or rows
    if start < 0 or end < start:
        raise ValueError(f"bad row range {start}..{end}")
    return start, end


def slice_rows(df: DataFrame, index: str, start: int, end: int) -> DataFrame:
    """Rows of [start, end)."""
    return df.filter((F.col(index) >= start) & (F.col(index) < end))


def prefix_split(index: Column, n: Column, train: float = 0.8) -> Column:
    """train, dev or test by position: the first share, half of what is left, the rest."""
    first = F.floor(n * train)
    dev = F.floor((n - first) / 2)
    return F.when(index < first, "train").when(index < first + dev, "dev").otherwise("test")


def recorded_split(df: DataFrame, index: str, splits: dict[str, list[int]]) -> DataFrame:
    """Rows at recorded places, in the recorded order, per split."""
    rows = [(name, k, i) for name, places in splits.items() for k, i in enumerate(places)]
    places = df.sparkSession.createDataFrame(rows, "split string, place int, _index long")
    return df.join(places, F.col(index) == F.col("_index")).drop("_index")


def running_total(df: DataFrame, amount: str, *order: str, by: tuple[str, ...] = (), name: str = "ahead", ranges: int | None = None, settle: Callable[[DataFrame], DataFrame] = settled) -> DataFrame:
    """The sum of `amount` over the rows before each one, in order, within `by`.

    Rows are dealt to ranges of (by, order), so that a large group spans many tasks; sums of the ranges are added
    up first, then the rows inside each one. Without `ranges` there are as many as the session has shuffle partitions,
    which adaptive execution joins where they are small; the result doesn't depend on it. All columns of df go through
    the shuffle: long ones should be left out.
    """
    dealt = df.repartitionByRange(ranges, *by, *order) if ranges else df.repartitionByRange(*by, *order)
    part = settle(dealt.withColumn("_part", F.spark_partition_id()))
    key = [*by, "_part"]
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = part.groupBy(*key).agg(F.sum(amount).alias("_sum"))
    starts = sums.select(*key, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = part.withColumn("_in", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    met = F.lit(True)
    for c in key:
        met = met & F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}"))
    out = summed.alias("r").join(starts.alias("s"), met).select("r.*", (F.col("s._start") + F.col("r._in")).alias(name))
    return out.drop("_part", "_in")


def take_budget(df: DataFrame, words: str, target: int, *order: str) -> DataFrame:
    """Rows in order until the budget is met; the row at the boundary only if that is nearer than without."""
    rows = running_total(df.filter(F.col(words) > 0), words, *order)
    after = F.col("ahead") + F.col(words)
    nearer = (F.col("ahead") < target) & (after - target < target - F.col("ahead"))
    return rows.filter((after <= target) | nearer).drop("ahead")


def sample_fraction(df: DataFrame, key: str, fraction: float, seed: int, n: int) -> DataFrame:
    """max(1, floor(n * fraction)) of n rows by the smallest hashes, all of them from a fraction of 1 (C11)."""
    if fraction >= 1:
        return df
    keep = max(1, int(n * fraction))
    ranked = df.withColumn("_u", uniform(seed, F.col(key)))
    # the k-th smallest hash is found by a top-k that every task cuts first
    return ranked.orderBy("_u", key).limit(keep).drop("_u")


def stratified_sample(df: DataFrame, stratum: str, key: str, rate: float, least: int, seed: int) -> DataFrame:
    """min(N, max(least, ceil(rate * N))) rows of every stratum, by hash."""
    rows = df.withColumn("_u", uniform(seed, F.col(key))).withColumn("_one", F.lit(1))
    ranked = running_total(rows, "_one", "_u", key, by=(stratum,), name="_r")
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    met = F.col(f"r.{stratum}").eqNullSafe(F.col(f"z.{stratum}")) & (F.col("r._r") < F.greatest(F.lit(least), F.ceil(F.col("z._n") * rate)))
    return ranked.alias("r").join(sizes.alias("z"), met, "left_semi").drop("_u", "_one", "_r")


def first_occurrences(df: DataFrame, value: str, *order: str) -> DataFrame:
    """The first row of each value (F10); nulls come last in the order."""
    place = F.struct(*(x for c in order for x in (F.col(c).isNull().alias(f"_{c}"), F.col(c))))
    first = df.groupBy(value).agg(F.min(place).alias("_first"))
    return first.select(value, *(f"_first.{c}" for c in order))


def interleaved(df: DataFrame, source: str, *order: str) -> DataFrame:
    """Round robin: document j of every source before document j + 1 of any (A12). Adds `turn`."""
    return running_total(df.withColumn("_one", F.lit(1)), "_one", *order, by=(source,), name="turn").drop("_one")


def replicated(df: DataFrame, times: int, suffix: str = ".") -> DataFrame:
    """Each text `times` times as it is, and as often with a suffix (C14)."""
    forms = F.explode(F.array(F.col("text"), F.concat("text", F.lit(suffix)))).alias("form")
    return df.select("*", forms).select("*", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("copy")).drop("text").withColumnRenamed("form", "text")


def epoch_order(df: DataFrame, key: str, epochs: int, seed: int) -> DataFrame:
    """A permutation of the rows for every epoch, by a hash of epoch and row (F9). Adds epoch and u."""
    rows = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    return rows.withColumn("u", uniform(seed, F.col("epoch"), F.col(key)))


def segments(ids: Column, length: int) -> Column:
    """Pieces of `length` ids; a last piece of one id or none is dropped."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(ids) - 1, F.lit(0)), F.lit(length))
    return F.filter(F.transform(starts, lambda o: F.slice(ids, o + 1, length)), lambda s: F.size(s) > 1)
