"""Sharding by a k-d tree: recursive splits at distributed weighted medians along the widest dimension.

Documents of equal text form a group that is never divided. A group's metadata are its language, source, size
and smallest id. A node that holds k shards is split into floor(k / 2) and the rest at the quantile of bytes
that their targets ask for, along the dimension that is widest in the node, relative to the whole; leaves are
shards of the target bytes. Quantiles come from histograms of fixed size that are refined until the cut is
exact enough: the driver sees a few thousand sums a level, whatever the number of documents.

A group that alone holds a sixteenth of a shard's bytes or more (there can be 16 times the number of shards,
at most) is placed first, heaviest first, on the lightest shard; the targets of the leaves are what then lacks
to a common level.

Slots number a shard's rows from 0 without gaps: rows are dealt to chunks by a hash, chunk counts are summed
up, and only a chunk's rows are sorted.

Defined cases: a null text counts as empty (its size is 16) and equals the empty one; null languages and
sources are values of their own; rows that repeat an id, or have none, get slots of their own; an empty table
gives an empty result; with fewer groups than shards some shards stay empty; other columns are not read.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.common import stored

SHARDS, EXTRA = 40, 16
HEAVY = 16
BINS, ZOOMS, EXACT = 512, 5, 0.002
CHUNK_ROWS = 4096
DIMENSIONS = ("by_lang", "by_source", "by_size", "by_id")


def rows_of(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, the text's hash g, and the metadata of each document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + EXTRA).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("g"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))


def groups_of(rows: DataFrame) -> DataFrame:
    """(g, size, bytes, coordinates) of each group of equal texts. A hash in [0, 1) breaks ties of a coordinate."""
    groups = rows.groupBy("g", "size").agg(F.sum("size").alias("bytes"), F.min("lang").alias("lang"), F.min("source").alias("source"), F.min("doc_id").alias("first"))
    spread = F.shiftrightunsigned(F.xxhash64(F.lit(1), "g", "size"), 24) / float(2**40)
    name = lambda c: F.crc32(F.coalesce(c, F.lit("\u0000"))).cast("double")
    return groups.select("g", "size", "bytes", (name(F.col("lang")) + spread).alias("by_lang"), (name(F.col("source")) + spread).alias("by_source"), F.log2(F.col("size") + spread).alias("by_size"), (F.coalesce("first", F.lit(-1)).cast("double") + spread).alias("by_id"))


def _lookup(entries: dict[int, tuple], names: tuple[str, ...]) -> Column:
    """The values that belong to a row's node, as a struct; null for other nodes."""
    pairs = [x for n, v in entries.items() for x in (F.lit(n), F.struct(*(F.lit(y).alias(k) for k, y in zip(names, v))))]
    return F.element_at(F.create_map(*pairs), F.col("node"))


def _coordinate(dim: Column) -> Column:
    return F.element_at(F.array(*map(F.col, DIMENSIONS)), dim + 1)


def _ranges(groups: DataFrame) -> dict[int, dict]:
    """Bytes and the range of each dimension, by node."""
    ends = [f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))]
    return {r["node"]: r.asDict() for r in groups.groupBy("node").agg(F.sum("bytes").alias("bytes"), *ends).collect()}


def _cuts(groups: DataFrame, wanted: dict[int, tuple], step: float) -> dict[int, tuple[int, float]]:
    """Where each node is to be cut: (dimension, value). wanted: node -> (dimension, low, high, bytes that go left)."""
    state = {n: {"dim": d, "lo": lo, "hi": math.nextafter(hi, math.inf), "want": w, "below": 0.0, "best": (abs(w), lo)} for n, (d, lo, hi, w) in wanted.items()}
    open_ = set(state)
    for _ in range(ZOOMS):
        if not open_:
            break
        asked = _lookup({n: (state[n]["dim"], state[n]["lo"], state[n]["hi"] - state[n]["lo"]) for n in open_}, ("dim", "lo", "wide"))
        rows = groups.filter(F.col("node").isin(*open_)).select("node", "bytes", asked.alias("q"), *DIMENSIONS)
        rows = rows.select("node", "bytes", F.floor((_coordinate(F.col("q.dim")) - F.col("q.lo")) / F.col("q.wide") * BINS).alias("bin"))
        sums = rows.filter(F.col("bin").between(0, BINS - 1)).groupBy("node", "bin").agg(F.sum("bytes").alias("bytes")).collect()
        for n in list(open_):
            s = state[n]
            bins = sorted((r["bin"], r["bytes"]) for r in sums if r["node"] == n)
            unit, total, zoom = (s["hi"] - s["lo"]) / BINS, s["below"], None
            for b, w in bins:
                if zoom is None and total + w >= s["want"]:
                    zoom = (b, total)
                for edge, left in ((b, total), (b + 1, total + w)):
                    s["best"] = min(s["best"], (abs(left - s["want"]), s["lo"] + edge * unit))
                total += w
            if s["best"][0] <= step or zoom is None or unit <= abs(s["lo"]) * 1e-15:
                open_.discard(n)
            else:
                s["lo"], s["hi"], s["below"] = s["lo"] + zoom[0] * unit, s["lo"] + (zoom[0] + 1) * unit, zoom[1]
    return {n: (s["dim"], s["best"][1]) for n, s in state.items()}


def _levels(loads: list[float], rest: float) -> list[float]:
    """What each shard lacks to the common level at which the rest is used up."""
    order = sorted(loads)
    for k in range(len(order), 0, -1):
        level = (rest + sum(order[:k])) / k
        if level >= order[k - 1]:
            return [max(0.0, level - x) for x in loads]
    return [0.0] * len(loads)


def leaves_of(groups: DataFrame, targets: list[float]) -> DataFrame:
    """The groups with the leaf of the k-d tree (a shard) that each falls into, in the column node.

    A level is written before the next is cut: it holds a short row per group and no text.
    """
    shards_left = [i for i, t in enumerate(targets) if t > 0] or [0]
    mean, number = max(1.0, sum(targets) / len(targets)), len(targets)
    together = {number: shards_left} if len(shards_left) > 1 else {}
    now = groups.withColumn("node", F.lit(number if together else shards_left[0]))
    whole: dict | None = None
    while together:
        found = _ranges(now)
        whole = whole or found.get(len(targets))
        wanted = {}
        for n, leaves in together.items():
            if r := found.get(n):
                width = [(r[f"hi_{d}"] - r[f"lo_{d}"]) / max(1e-12, whole[f"hi_{d}"] - whole[f"lo_{d}"]) for d in DIMENSIONS]
                d = width.index(max(width))
                share = sum(targets[i] for i in leaves[: len(leaves) // 2]) / sum(targets[i] for i in leaves)
                wanted[n] = (d, r[f"lo_{DIMENSIONS[d]}"], r[f"hi_{DIMENSIONS[d]}"], r["bytes"] * share)
        cuts, moves, following = _cuts(now, wanted, EXACT * mean), {}, {}
        for n, leaves in together.items():
            half, ends = len(leaves) // 2, []
            for part in (leaves[:half], leaves[half:]):
                number += 1
                ends.append(part[0] if len(part) == 1 else number)
                if len(part) > 1:
                    following[number] = part
            if n in cuts:
                moves[n] = (*cuts[n], *ends)
        if moves:
            q = F.col("q")
            side = F.when(_coordinate(q["dim"]) < q["cut"], q["left"]).otherwise(q["right"])
            moved = now.withColumn("q", _lookup(moves, ("dim", "cut", "left", "right")))
            now = stored(moved.withColumn("node", F.when(q.isNull(), F.col("node")).otherwise(side)).drop("q"), "level")
        together = following
    return now


def shards(docs: DataFrame, count: int = SHARDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    rows = stored(rows_of(docs), "rows")
    groups = stored(groups_of(rows), "groups")
    total, n = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0], rows.count()
    limit = total / count / HEAVY
    # the heavy groups sum up to the total at most, so that there are no more than count * HEAVY of them
    heavy = sorted(groups.filter((F.col("bytes") >= limit) & (F.col("bytes") > 0)).select("bytes", "g", "size").collect(), reverse=True)
    loads, placed, queue = [0.0] * count, [], [(0, i) for i in range(count)]
    for h in heavy:
        load, i = heapq.heappop(queue)
        placed.append((h["g"], h["size"], i))
        loads[i] = load + h["bytes"]
        heapq.heappush(queue, (loads[i], i))
    light = groups.filter(F.col("bytes") < limit)
    fixed = spark.createDataFrame(placed, "g long, size long, fixed int")
    where = leaves_of(light, _levels(loads, total - sum(loads))).select("g", "size", F.col("node").cast("int").alias("shard")).unionByName(fixed.withColumnRenamed("fixed", "shard"))
    where = stored(where, "where")
    dealt = rows.select("doc_id", "size", "text_crc32", "g").join(where, ["g", "size"])
    dealt = stored(dealt.withColumn("chunk", F.pmod(F.xxhash64(F.lit(2), "doc_id", "g"), F.lit(max(1, n // count // CHUNK_ROWS))).cast("int")), "dealt")
    ahead = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("c")).select("shard", "chunk", F.coalesce(F.sum("c").over(ahead), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "chunk").orderBy("doc_id", "g", "size")
    numbered = dealt.withColumn("slot", F.row_number().over(inside) - 1).join(stored(starts, "starts"), ["shard", "chunk"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("slot") + F.col("start")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
