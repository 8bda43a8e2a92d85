"""Mixing sources to target weights by weighted sampling with exponential keys (Efraimidis and Spirakis).

Sources get targets: weights share a total, and a target stops at a multiple of its source's size, the rest
being shared anew by weight. Every document draws a key -ln(u) / w from a uniform u that a hash of its id
fixes and a quality weight w; within a source documents are taken in the order of (key, id, size) until the
budget is met. Complete epochs come first: a target of 1.7 times the source takes each document once and 0.7
of the source by keys. The document at the boundary gives as many words as are still missing.

The running sum is in two steps, so that no source is sorted in one task. Keys are mapped monotonically to
buckets of about BUCKET_ROWS rows: the map is the distribution function of the source's keys, a mixture of one
exponential for each class of quality weights, so that buckets are even whatever the weights are. Words are
summed by bucket before each shuffle; the sums, in order, name the one bucket of a source in which its budget
ends, and only that bucket is sorted. What precedes the boundary is taken whole, what follows it is not taken,
so every other document is decided where it is read. Rows that agree in all of source, key, id and size are
one row with a count, and are dealt out again by numbers.

DataFrame functions only. Defined cases: a null text has size 0; null is a source of its own, the last one;
a source without words has target 0; rows that repeat an id draw the same key and are ordered by size; a
null id draws the key of the empty string; an empty table gives an empty result; other columns are ignored.
The targets are computed in one task: a short row for each source, so sources may number some millions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.common import stored, words_of

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
SEED = 7
BUCKET_ROWS = 4096
#: Classes of quality weights to a halving; the classes below 2**-LEVELS count as the last one.
LEVEL_STEPS, LEVELS = 8, 24
#: Order of the rows of a source, and what tells rows apart.
ORDER = ("key", "doc_id", "size")


def uniform(doc_id: Column) -> Column:
    """In (0, 1), from 48 bits of SHA-256 of the seed and the id; the same on every run and in other engines."""
    bits = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 12), 16, 10)
    return (bits.cast("double") + 0.5) / float(2**48)


def quality_weight(chars: Column, words: Column) -> Column:
    """Near 1 for texts with words of usual length, less for junk; never 0."""
    mean = chars / F.greatest(words, F.lit(1))
    return 1.0 / (1.0 + F.abs(mean - 6.5) / 6.5)


def drawn(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, key and level, the class of the quality weight, of each row of docs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words_of(text).alias("size"), F.length(text).alias("chars"))
    rows = rows.withColumn("w", quality_weight(F.col("chars"), F.col("size")))
    level = F.least(F.lit(LEVELS * LEVEL_STEPS), F.round(-F.log2("w") * LEVEL_STEPS)).cast("int")
    return rows.select("doc_id", "source", "size", (-F.ln(uniform(F.col("doc_id"))) / F.col("w")).alias("key"), level.alias("level"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes (source, source_size, ...), one row per source, with the target of each.

    Sources stop at their limit in the order of limit / weight. The level, words per unit of weight, is what
    is left after the first k stopped, over the weights of the others; it holds for the smallest k at which
    the next source doesn't reach its limit.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("w", weight.cast("long")).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    rows = rows.withColumn("total", share * F.sum("source_size").over(whole)).withColumn("all_w", F.sum("w").over(whole))
    rows = rows.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("w_before", F.coalesce(F.sum("w").over(before), F.lit(0)))
    rows = rows.withColumn("level", (F.col("total") - F.col("cap_before")) / (F.col("all_w") - F.col("w_before")))
    rows = rows.withColumn("held", F.min(F.when(F.col("level") * F.col("w") < F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("cap_before"), "level"))).over(whole))
    target = F.when(F.col("held").isNull(), F.col("cap")).otherwise(F.least(F.col("held.level") * F.col("w"), F.col("cap")))
    return rows.select(*sizes.columns, F.round(target, 6).alias("target"))


def _placed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows with the plan of their source; plain scans on both sides, so that a source with a third of the rows can be split."""
    named = [c for c in plan.columns if c != "source"]
    return rows.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source"))).select("r.*", *(f"p.{c}" for c in named))


def _bucket() -> Column:
    """The place of a key among its source's keys, times the number of buckets."""
    below = lambda x: x["share"] * (1 - F.exp(-F.col("key") * F.pow(F.lit(2.0), -x["level"] / float(LEVEL_STEPS))))
    return F.floor(F.aggregate("levels", F.lit(0.0), lambda acc, x: acc + below(x)) * F.ceil(F.col("docs") / BUCKET_ROWS)).cast("long")


def source_plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, docs, levels, target, epochs, part): part words are taken by keys after whole epochs."""
    by_level = rows.groupBy("source", "level").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    spread = F.array_sort(F.collect_list(F.struct("level", "n")))
    sizes = by_level.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("n").alias("docs"), spread.alias("spread"))
    # one row per source, and at most LEVELS * LEVEL_STEPS + 1 classes in it
    levels = F.transform("spread", lambda x: F.struct(x["level"].alias("level"), (x["n"] / F.col("docs")).alias("share")))
    plan = targets(sizes.withColumn("levels", levels).drop("spread"), weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    part = F.floor(F.col("target") + 1e-6).cast("long") - F.col("epochs") * F.col("source_size")
    return plan.withColumn("epochs", epochs).withColumn("part", part)


def boundaries(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """plan with `edge`, the (key, doc_id, size) at which the part of a source ends, `edge_n`, the rows that
    agree with it, and `left`, the words that these give; edge is null where all documents are before it."""
    placed = _placed(rows, plan.select("source", "docs", "levels", "part")).withColumn("bucket", _bucket())
    sums = placed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = _placed(sums.withColumn("start", F.coalesce(F.sum("words").over(ahead), F.lit(0))), plan.select("source", "part"))
    # the first bucket that goes beyond the part: one row per source
    last = sums.filter(F.col("start") + F.col("words") > F.col("part")).groupBy("source").agg(F.min(F.struct("bucket", "start")).alias("at"))
    last = stored(last.select("source", "at.bucket", "at.start"), "last-buckets")
    met = F.col("r.source").eqNullSafe(F.col("l.source")) & (F.col("r.bucket") == F.col("l.bucket"))
    inner = placed.alias("r").join(last.alias("l"), met).select("r.source", *(f"r.{c}" for c in ORDER), "r.part", "l.start")
    alike = inner.groupBy("source", *ORDER, "part", "start").agg(F.count(F.lit(1)).alias("n"))
    inside = Window.partitionBy("source").orderBy(*(F.col(c).asc_nulls_first() for c in ORDER)).rowsBetween(Window.unboundedPreceding, -1)
    size = F.col("size") * F.col("n")
    alike = alike.withColumn("ahead", F.col("start") + F.coalesce(F.sum(size).over(inside), F.lit(0)))
    beyond = alike.filter(F.col("ahead") + size > F.col("part"))
    order = F.struct("key", F.col("doc_id").isNotNull(), "doc_id", "size")
    edge = beyond.groupBy("source").agg(F.min_by(F.struct(F.struct(*ORDER).alias("edge"), F.col("n").alias("edge_n"), (F.col("part") - F.col("ahead")).alias("left")), order).alias("e"))
    found = stored(edge.select("source", "e.*"), "edges")
    return plan.alias("p").join(found.alias("f"), F.col("p.source").eqNullSafe(F.col("f.source")), "left").select("p.*", "f.edge", "f.edge_n", "f.left")


def _against(edge: str) -> tuple[Column, Column]:
    """(before the edge, at the edge); without an edge every row is before it."""
    same_id = F.col("doc_id").eqNullSafe(F.col(f"{edge}.doc_id"))
    lower_id = (F.col("doc_id").isNull() & F.col(f"{edge}.doc_id").isNotNull()) | F.coalesce(F.col("doc_id") < F.col(f"{edge}.doc_id"), F.lit(False))
    same_key = F.col("key") == F.col(f"{edge}.key")
    before = (F.col("key") < F.col(f"{edge}.key")) | (same_key & (lower_id | (same_id & (F.col("size") < F.col(f"{edge}.size")))))
    at = same_key & same_id & (F.col("size") == F.col(f"{edge}.size"))
    none = F.col(edge).isNull()
    return none | before, ~none & at


def _planned(rows: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    return stored(boundaries(rows, stored(source_plan(rows, weights, share, most), "targets")), "plan")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    rows = stored(drawn(docs), "sizes")
    placed = _placed(rows, _planned(rows, weights, share, most).drop("docs", "levels", "part"))
    before, at = _against("edge")
    whole = F.col("epochs") * F.col("size") + F.when(before, F.col("size")).otherwise(0)
    others = placed.filter(~at).select("doc_id", "size", "source_size", "target", whole.cast("long").alias("taken"))
    # rows at an edge: alike in all that the result shows, so that they are one row with a count until the end
    edges = placed.filter(at).groupBy("source").agg(*(F.any_value(c).alias(c) for c in ("doc_id", "size", "source_size", "target", "epochs", "left", "edge_n")))
    nth = edges.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("edge_n") - 1)).alias("k"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("k") * F.col("size")))
    return others.unionByName(nth.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken")))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The mix as rows of documents, with all their columns: a document is there once for each complete epoch, and once
    more if it is before the edge of its source, or at the edge and at least half of it is taken; whole texts only.

    Texts are not shuffled: a row's decision needs its own id, source and text and the edge of its source. Rows that
    agree in source, key, id and size with the edge are taken or left together.
    """
    names = docs.columns
    plan = _planned(stored(drawn(docs), "sizes"), weights, share, most).drop("docs", "levels", "part", "source_size", "target")
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), "doc_id", "source", "text")
    own = held.select("row", F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    own = own.withColumn("size", words_of(F.col("t")))
    own = own.select("row", "doc_id", "source", "size", (-F.ln(uniform(F.col("doc_id"))) / quality_weight(F.length("t"), F.col("size"))).alias("key"))
    placed = _placed(own, plan)
    before, at = _against("edge")
    more = F.when(before, 1).when(at & (F.col("left") * 2 >= F.col("edge_n") * F.col("size")), 1).otherwise(0)
    times = F.when(F.col("size") > 0, F.col("epochs") + more).otherwise(0).cast("int")
    copies = placed.select("row", times.alias("times")).filter("times > 0")
    return copies.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*(F.col("row").getField(c).alias(c) for c in names))
