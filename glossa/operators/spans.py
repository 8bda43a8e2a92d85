"""Spans: merging, covering, overlap joins and assignment of positions to regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged_spans(spans: DataFrame, by: list[str]) -> DataFrame:
    """Overlapping and touching spans [start, end) as one, as gaps and islands."""
    order = Window.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("fresh", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
    islands = marked.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


#: Strengths of a cover; an unknown one counts as strong.
STRENGTHS = ("weak", "conservative", "guarded", "strong")


def covering_strength(spans: DataFrame, by: list[str]) -> DataFrame:
    """The strongest strength that covers each place of [start, end) (F8)."""
    rank = F.coalesce(F.element_at(F.create_map(*(x for k, s in enumerate(STRENGTHS) for x in (F.lit(s), F.lit(k)))), F.col("strength")), F.lit(len(STRENGTHS) - 1))
    places = spans.filter("start < end").select(*by, rank.alias("rank"), F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("place"))
    best = places.groupBy(*by, "place").agg(F.max("rank").alias("rank"))
    return best.select(*by, "place", F.element_at(F.array(*map(F.lit, STRENGTHS)), F.col("rank") + 1).alias("strength"))


def overlaps(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """Half-open spans that share a place (C17)."""
    return (start < other_end) & (other_start < end)


def marked_frozen(tokens: DataFrame, ranges: DataFrame, lemmas: DataFrame, by: list[str], width: int = 256) -> DataFrame:
    """tokens with `frozen`: whether they overlap a frozen range of their document or have a frozen lemma.

    tokens: by, i, char_start, char_end, lemma; ranges: by, start, end. Ranges and tokens meet on (document, cell of
    `width` characters), an equi-join instead of a range join. An empty range or token is in its first cell only.
    """
    cells = lambda s, e: F.sequence(F.floor(s / width), F.floor(F.greatest(s, e - 1) / width))
    frozen = ranges.select(*by, F.col("start").alias("_s"), F.col("end").alias("_e"), F.explode(cells(F.col("start"), F.col("end"))).alias("_cell"))
    keyed = tokens.select(*by, "i", "char_start", "char_end", F.explode(cells(F.col("char_start"), F.col("char_end"))).alias("_cell"))
    hit = keyed.join(frozen, [*by, "_cell"]).filter(overlaps(F.col("char_start"), F.col("char_end"), F.col("_s"), F.col("_e"))).select(*by, "i").distinct().withColumn("_hit", F.lit(True))
    held = lemmas.select("lemma").distinct().withColumn("_held", F.lit(True))
    marked = tokens.join(hit, [*by, "i"], "left").join(held, "lemma", "left")
    return marked.withColumn("frozen", F.coalesce("_hit", "_held", F.lit(False))).drop("_hit", "_held")


def without_frozen(tokens: DataFrame, ranges: DataFrame, lemmas: DataFrame, by: str, width: int = 256) -> DataFrame:
    """Tokens that overlap no frozen range of their document and whose lemma isn't frozen."""
    return marked_frozen(tokens, ranges, lemmas, [by], width).filter("not frozen").drop("frozen")


def word_groups(words: DataFrame, pieces: DataFrame, by: str) -> DataFrame:
    """Sub-tokens (piece) of each word by overlap; a word without one takes the first that follows.

    words: by, word, start, end; pieces: by, piece, p_start, p_end. They meet on cells of a text, and a running
    minimum from its end finds what follows: no pairs of a text are made.
    """
    width = 64
    cells = lambda s, e: F.sequence(F.floor(s / width), F.floor(F.greatest(s, e - 1) / width))
    left = words.select(by, "word", "start", "end", F.explode(cells(F.col("start"), F.col("end"))).alias("_cell"))
    right = pieces.select(by, "piece", "p_start", "p_end", F.explode(cells(F.col("p_start"), F.col("p_end"))).alias("_cell"))
    met = left.join(right, [by, "_cell"]).filter(overlaps(F.col("start"), F.col("end"), F.col("p_start"), F.col("p_end")))
    inside = met.groupBy(by, "word").agg(F.array_sort(F.collect_set("piece")).alias("pieces"))
    kinds = pieces.schema["piece"].dataType
    marks = words.select(by, F.col("start").alias("at"), F.lit(1).alias("is_word"), "word", F.lit(None).cast(kinds).alias("piece"))
    marks = marks.unionByName(pieces.select(by, F.col("p_start").alias("at"), F.lit(0).alias("is_word"), F.lit(None).cast(words.schema["word"].dataType).alias("word"), "piece"))
    back = Window.partitionBy(by).orderBy(F.col("at").desc(), "is_word").rowsBetween(Window.unboundedPreceding, 0)
    after = marks.withColumn("after", F.min("piece").over(back)).filter("is_word = 1").select(by, "word", "after")
    empty = F.slice(F.array("after"), 1, 0)
    out = after.join(inside, [by, "word"], "left")
    return out.select(by, "word", F.when(F.col("pieces").isNotNull(), F.col("pieces")).when(F.col("after").isNotNull(), F.array("after")).otherwise(empty).alias("pieces"))


def region_of(start: Column, end: Column, edges: Column, length: Column) -> Column:
    """The region (from 1) whose end lies beyond a token's last byte; 0 for empty spans at 0."""
    ends = F.concat(F.slice(edges, 2, F.greatest(F.size(edges) - 1, F.lit(0))), F.array(length))
    at = F.when(end > start, end - 1).otherwise(start)
    passed = F.size(F.filter(ends, lambda e: e <= at))
    return F.when((start == 0) & (end == 0), 0).otherwise(passed + 1)


def shifted_spans(spans: DataFrame, events: DataFrame, by: list[str]) -> DataFrame:
    """Spans after edits: every bound moves by the changes at or before it (H6). events: by, at, delta.

    Bounds and changes are put in one order and the changes summed up along it.
    """
    own = spans.select(*by, "start", "end").distinct()
    nothing = F.lit(0).cast(events.schema["delta"].dataType)
    bounds = own.select(*by, "start", "end", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(True).alias("first")), F.struct(F.col("end").alias("at"), F.lit(False).alias("first")))).alias("b"))
    bounds = bounds.select(*by, "b.at", nothing.alias("delta"), F.struct("start", "end", "b.first").alias("bound"))
    rows = bounds.unionByName(events.select(*by, "at", "delta"), allowMissingColumns=True)
    order = Window.partitionBy(*by).orderBy("at", F.col("bound").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    moved = rows.withColumn("by", F.sum("delta").over(order)).filter("bound is not null").select(*by, "bound.*", "by")
    side = lambda first: F.max(F.when(F.col("first") == first, F.col("by")))
    out = moved.groupBy(*by, "start", "end").agg(side(True).alias("ds"), side(False).alias("de"))
    return out.select(*by, "start", "end", (F.col("start") + F.col("ds")).alias("new_start"), (F.col("end") + F.col("de")).alias("new_end"))
