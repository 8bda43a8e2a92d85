"""Chat formatting with a collapse of cumulative snapshots.

Logs often hold a conversation again and again, a turn longer each time. Every turn gets a rolling hash of
its conversation's prefix (128 bits: two running exclusive ors of hashes of position, role and text).
Conversations with equal whole hashes are one, kept under the smallest id; one whose whole hash is the prefix
hash of a longer one at the same length goes by an anti-join. Only the maximal ones are rendered. Prefixes are
compared by their length and 128 bits, not by their texts.

DataFrame functions only. Defined cases: rows repeated whole count once; turns that tie are ordered by role,
then text, nulls first; a null role or text differs from an empty one as a prefix and is rendered as
"unknown" or as nothing; a turn without a conversation id is a conversation of its own; marks of the format inside a
text are broken up, so that a text cannot forge a turn; empty tables give empty results; other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.common import stored

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def turn_text(role: Column, text: Column) -> Column:
    """One rendered turn."""
    safe = F.regexp_replace(F.coalesce(text, F.lit("")), r"<\|", "< |")
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit("unknown")), F.lit("\n"), safe, F.lit(CLOSE + "\n"))


def prefixes(turns: DataFrame) -> DataFrame:
    """The turns with their place k, their conversation's length n and the prefix hashes h1, h2."""
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).distinct()
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    named = rows.filter("conv_id is not null").withColumn("k", F.row_number().over(order))
    alone = rows.filter("conv_id is null").withColumn("k", F.lit(1))
    running = Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    named = _hashed(named)
    named = named.withColumn("n", F.max("k").over(Window.partitionBy("conv_id")))
    named = named.select("conv_id", "k", "role", "text", F.bit_xor("h1").over(running).alias("h1"), F.bit_xor("h2").over(running).alias("h2"), "n")
    return named.unionByName(_hashed(alone).withColumn("n", F.lit(1)).drop("turn"))


def _hashed(rows: DataFrame) -> DataFrame:
    """Two hashes of each turn's place, role and text."""
    parts = ["k", F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    return rows.withColumns({h: F.xxhash64(F.lit(seed), *parts) for h, seed in (("h1", 1), ("h2", 2))})


def _who() -> Column:
    """A conversation: its id, or the hashes of a turn without one."""
    none = F.col("conv_id").isNull()
    return F.struct(none.alias("none"), F.coalesce("conv_id", "h1").alias("a"), F.when(none, F.col("h2")).otherwise(0).alias("b"))


def maximal(rows: DataFrame) -> DataFrame:
    """(who, n_copies) of the conversations that no other one extends."""
    whole = rows.filter("k = n").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    begun = rows.filter("k < n").select(F.col("k").alias("n"), "h1", "h2").distinct()
    return whole.join(begun, ["n", "h1", "h2"], "left_anti").select(_who().alias("who"), "n_copies")


def chat_format(turns: DataFrame) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, n_copies (equal ones logged), chat (the rendered text)."""
    rows = stored(prefixes(turns), "turns")
    keep = stored(maximal(rows), "maximal")
    own = rows.select(_who().alias("who"), "conv_id", "k", turn_text(F.col("role"), F.col("text")).alias("piece"))
    met = own.join(keep, "who").groupBy("who", "conv_id", "n_copies")
    # turns without a conversation that are alike are one
    chats = met.agg(F.max("k").cast("long").alias("n_turns"), F.array_sort(F.collect_set(F.struct("k", "piece"))).alias("pieces"))
    return chats.select("conv_id", "n_turns", "n_copies", F.array_join(F.col("pieces.piece"), "").alias("chat"))
