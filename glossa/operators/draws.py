"""Candidate sets that many requests share, and draws from them without joining a request with its whole set.

A set is known by a string. Its members lie one after the other on a line, each as long as its weight, in the order of
the candidates. A request draws a point of the line, beside the part that its excluded candidate takes, and meets the
member there by an equi-join on cells: the line has as many cells as members, so a cell holds one of them on average.
Weights and points are whole numbers: sums don't depend on the order of addition.

Sets of several keys are many, and together have far more members than there are requests. Their members are kept once
for the same keys, in blocks; the line of a set is the lengths of its blocks.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions.text import uniform
from glossa.operators.slicing import numbered, running_total
from glossa.session import stored

if TYPE_CHECKING:
    import pyarrow as pa

#: Weights of means are kept in thousandths.
UNIT = 1000


def held_keys(members: DataFrame) -> DataFrame:
    """(cand, held): the keys of each candidate with their weights. members: key, cand, n (a weight, or null for none)."""
    return members.groupBy("cand").agg(F.map_from_entries(F.collect_list(F.struct("key", "n"))).alias("held"))


def has_all(keys: Column, held: Column) -> Column:
    return F.forall(keys, lambda k: F.map_contains_key(held, k))


def shared_members(sets: DataFrame, members: DataFrame, pieces: int = 8) -> DataFrame:
    """(set, cand, ns): the candidates that all keys of a set have, with their weights in the order of the keys.

    sets: set, keys (an array); members: key, cand, n. The candidates of a set's smallest key are met, each with all that
    it holds, and kept if that is all keys: large keys aren't gone through for every set, and nothing is grouped. The
    candidates of a key are in several pieces, so that a key that many sets have isn't one task's.
    """
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    keys = sets.select("set", "keys", F.explode("keys").alias("key")).join(sizes, "key", "left")
    least = keys.groupBy("set").agg(F.any_value("keys").alias("keys"), F.min_by("key", F.struct(F.coalesce("size", F.lit(0)), "key")).alias("key"))
    asked = stored(least.select("set", "keys", "key", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("piece")))
    used = members.join(asked.select(F.explode("keys").alias("key")).distinct(), "key", "left_semi")
    known = used.join(asked.select("key").distinct(), "key", "left_semi").select("key", "cand").join(held_keys(used), "cand")
    met = asked.join(known.withColumn("piece", F.pmod(F.xxhash64("cand"), F.lit(pieces)).cast("int")), ["key", "piece"]).filter(has_all(F.col("keys"), F.col("held")))
    return met.select("set", "cand", F.transform("keys", lambda k: F.element_at("held", k)).alias("ns"))


def mean_weight(ns: Column, times: Column) -> Column:
    """The mean of weights that count `times` times each, in thousandths, 1000 at least."""
    total = F.aggregate(F.zip_with(ns, times, lambda n, t: n * t), F.lit(0).cast("long"), lambda s, x: s + x)
    count = F.aggregate(times, F.lit(0).cast("long"), lambda s, x: s + x)
    return F.greatest(F.floor(total * UNIT / count).cast("long"), F.lit(UNIT).cast("long"))


#: Candidates that stand side by side in one row, at most.
BLOCK = 4096


def blocks_of(members: DataFrame) -> DataFrame:
    """(cand, block): the candidates in order, BLOCK of them in each block."""
    ranked = numbered(members.select("cand").distinct(), "cand", name="rank")
    return ranked.select("cand", F.floor(F.col("rank") / BLOCK).cast("int").alias("block"))


def blocked_members(shared: DataFrame, blocks: DataFrame) -> DataFrame:
    """(set, block, cands): shared members (set, cand, ns), those of a block in one row, in order."""
    rows = shared.join(blocks, "cand").groupBy("set", "block")
    return rows.agg(F.array_sort(F.collect_list(F.struct("cand", "ns"))).alias("cands"))


def lines_of(variants: DataFrame, blocked: DataFrame) -> DataFrame:
    """(line, total, n, blocks): how long the line of each variant (line, set, times) of a set is, and its blocks.

    Sets whose keys count differently often have the same members with other weights: these are summed up, not kept.
    """
    weights = lambda cands: F.aggregate(cands, F.lit(0).cast("long"), lambda s, c: s + mean_weight(c["ns"], F.col("times")))
    parts = variants.join(blocked, "set").select("line", F.size("cands").cast("long").alias("n"), F.struct("block", weights(F.col("cands")).alias("w")).alias("b"))
    return parts.groupBy("line").agg(F.sum("b.w").alias("total"), F.sum("n").alias("n"), F.array_sort(F.collect_list("b")).alias("blocks"))


#: Counts of candidates and sets that a tile takes, about, and cells of variants and counts that are weighed at once.
COUNTS, SETS, CELLS = 1 << 21, 1 << 18, 1 << 22


def line_sums(variants: DataFrame, members: DataFrame) -> DataFrame:
    """(line, total, n): how long the line of each variant (line, keys, times) is, as lines_of() has it; empty ones left out.

    members: key, cand, n. Sets meet candidates in tiles, all sets of one part and all candidates of another, and a tile
    returns sums: the members that a set shares are neither moved nor kept.
    """

    def sums(sets: pa.Table, counts: pa.Table) -> pa.Table:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if not len(sets) or not len(counts):
            return pa.table({"line": pa.array([], pa.string()), "total": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        column = lambda t, c: pa.concat_arrays(t[c].chunks)
        key = column(counts, "key").dictionary_encode()
        at, cand, n = key.indices.to_numpy(), column(counts, "cand").dictionary_encode().indices.to_numpy(), column(counts, "n").to_numpy()
        order = np.lexsort((cand, at))
        cand, n, bounds = cand[order], n[order], np.searchsorted(at[order], np.arange(len(key.dictionary) + 1))

        keys, variants = column(sets, "keys"), column(sets, "variants")
        places = pc.fill_null(pc.index_in(pc.list_flatten(keys), value_set=key.dictionary), -1).to_numpy()
        ends = lambda lists: np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
        key_ends, line_ends, lines = ends(keys), ends(variants), pc.list_flatten(variants)
        times, used = pc.list_flatten(pc.struct_field(lines, "times")).to_numpy(), 0
        total, size = np.zeros(len(lines), np.int64), np.zeros(len(lines), np.int64)

        for k in range(len(keys)):
            own, rows = places[key_ends[k] : key_ends[k + 1]], slice(line_ends[k], line_ends[k + 1])
            many = (rows.stop - rows.start) * len(own)
            t = times[used : used + many].reshape(-1, len(own))
            used += many
            if own.min() < 0:
                continue
            by_size = np.argsort(bounds[own + 1] - bounds[own])
            met, found = None, {}
            for j in by_size:
                part = slice(bounds[own[j]], bounds[own[j] + 1])
                if met is None:
                    met, found[j] = cand[part], n[part]
                    continue
                place = np.minimum(np.searchsorted(cand[part], met), part.stop - part.start - 1)
                same = cand[part][place] == met
                met, found = met[same], {i: c[same] for i, c in found.items()} | {j: n[part][place[same]]}
            if not len(met):
                continue
            held, often = np.stack([found[j] for j in range(len(own))]), np.ones(len(met), np.int64)
            if len(t) > 4:  # candidates of the same counts are weighed once
                code = np.zeros(len(met), np.int64)
                for c in held:
                    code = np.unique(code * (c.max() + 1) + c, return_inverse=True)[1]
                _, first, often = np.unique(code, return_index=True, return_counts=True)
                held = held[:, first]
            step = max(1, CELLS // held.shape[1])
            for a in range(0, len(t), step):
                some = t[a : a + step]
                weights = np.maximum(some @ held * UNIT // some.sum(axis=1)[:, None], UNIT)
                total[rows.start + a : rows.start + a + len(some)] = weights @ often
            size[rows] = len(met)
        return pa.table({"line": pc.struct_field(lines, "line"), "total": total, "n": size}).filter(pa.array(size > 0))

    pieces, chunks = (max(4, -(-d.count() // most)) for d, most in ((members, COUNTS), (variants, SETS)))
    dealt = lambda d, c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int") * F.lit(d)
    sets = variants.groupBy("keys").agg(F.collect_list(F.struct("line", "times")).alias("variants"))
    sets = sets.select("keys", "variants", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("at")).withColumn("tile", F.col("at") + dealt(pieces, "keys", chunks))
    counts = members.select("key", "cand", F.col("n").cast("long").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("at")).withColumn("tile", F.col("at") * pieces + dealt(1, "cand", pieces))
    left, right = (d.drop("at").repartition(pieces * chunks, "tile").groupBy("tile") for d in (sets, counts))
    parts = left.cogroup(right).applyInArrow(sums, "line string, total long, n long")
    return parts.groupBy("line").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def measured_lines(requests: DataFrame, lines: DataFrame, held: DataFrame, exclude: str) -> DataFrame:
    """requests (line, set, keys, times, ...) with n_cands and weight of their line beside the excluded candidate.

    held: cand, held, block. The columns are null where a line has no members.
    """
    own = held.select(F.col("cand").alias(exclude), "held", F.col("block").alias("own_block"))
    rows = requests.join(lines, "line", "left").join(own, exclude, "left")
    inside = F.coalesce(has_all(F.col("keys"), F.col("held")), F.lit(False))
    rows = rows.withColumn("own_w", F.when(inside, mean_weight(F.transform("keys", lambda k: F.element_at("held", k)), F.col("times"))))
    rows = rows.withColumn("n_cands", F.col("n") - F.when(inside, 1).otherwise(0)).withColumn("weight", F.col("total") - F.coalesce("own_w", F.lit(0)))
    return rows.withColumn("own_block", F.when(inside, F.col("own_block"))).drop("held", "total", "n")


def drawn_from_blocks(asked: DataFrame, blocked: DataFrame, keys: list[str], exclude: str, seed: int) -> DataFrame:
    """(keys, cand): a candidate of each of measured_lines(), by weight: first its block, then its place there."""

    def walk(items: Column, left: Column, kind: str, name: str, weight) -> Column:
        """The item in which a point of a line is, and what is left of the point there."""
        start = F.struct(left.alias("left"), F.lit(None).cast(kind).alias("at"))
        step = lambda s, x: F.when(s["at"].isNotNull(), s).when(s["left"] < weight(x), F.struct(s["left"].alias("left"), x[name].alias("at"))).otherwise(F.struct((s["left"] - weight(x)).alias("left"), F.lit(None).cast(kind).alias("at")))
        return F.aggregate(items, start, step)

    point = F.floor(uniform(seed, *(F.col(k) for k in keys)) * F.col("weight")).cast("long")
    beside = lambda b: b["w"] - F.when(b["block"] == F.col("own_block"), F.col("own_w")).otherwise(0)
    names = list(dict.fromkeys([*keys, exclude]))
    rows = asked.select(*names, "set", "times", "own_block", "own_w", "blocks", point.alias("x"))
    rows = rows.withColumn("b", walk(F.col("blocks"), F.col("x"), "int", "block", beside)).select(*names, "set", "times", F.col("b.at").alias("block"), F.col("b.left").alias("x"))
    one = lambda c: F.when(c["cand"] == F.col(exclude), F.lit(0).cast("long")).otherwise(mean_weight(c["ns"], F.col("times")))
    met = rows.join(blocked, ["set", "block"])
    return met.select(*keys, walk(F.col("cands"), F.col("x"), "string", "cand", one)["at"].alias("cand"))


def placed_members(members: DataFrame) -> DataFrame:
    """members (set, cand, w) with the place `start` of each on its set's line, the line's length `total` and `n`."""
    sizes = members.groupBy("set").agg(F.sum("w").alias("total"), F.count(F.lit(1)).alias("n"))
    return stored(running_total(members, "w", "cand", by=("set",), name="start", settle=stored).join(sizes, "set"))


def measured_requests(requests: DataFrame, placed: DataFrame, exclude: str) -> DataFrame:
    """requests (with a column set) with n_cands, weight and the place of the excluded candidate; null for an empty set.

    Placed sets are as many as there are contexts: their sizes go to every task, so that no set's requests are one task's.
    """
    sizes = placed.groupBy("set").agg(F.any_value("total").alias("total"), F.any_value("n").alias("n"))
    return beside_own(requests, sizes, placed.select("set", F.col("cand").alias(exclude), F.col("start").alias("own_start"), F.col("w").alias("own_w")), exclude)


def beside_own(requests: DataFrame, sizes: DataFrame, own: DataFrame, exclude: str) -> DataFrame:
    """measured_requests() of the sizes (set, total, n) and the weights of members (set, exclude, own_w, ...)."""
    rows = requests.join(F.broadcast(sizes), "set", "left").join(own, ["set", exclude], "left")
    has = F.when(F.col("own_w").isNull(), 0).otherwise(1)
    return rows.withColumn("n_cands", F.col("n") - has).withColumn("weight", F.col("total") - F.coalesce("own_w", F.lit(0)))


def open_requests(requests: DataFrame, placed: DataFrame, exclude: str) -> DataFrame:
    """measured_requests() that have a candidate beside the excluded one."""
    return measured_requests(requests, placed, exclude).filter("n_cands > 0")


def drawn(asked: DataFrame, placed: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """(keys, cand): a candidate of each open request, by weight; fixed by the seed and the keys."""
    point = F.floor(uniform(seed, *(F.col(k) for k in keys)) * F.col("weight")).cast("long")
    rows = asked.withColumn("x", point)
    rows = rows.withColumn("x", F.col("x") + F.when(F.col("x") >= F.col("own_start"), F.col("own_w")).otherwise(0))
    cell = lambda x: F.floor(x / F.col("total") * F.col("n"))  # noqa: E731  grows with x, rounding included
    rows = rows.select(*keys, "set", "x", cell(F.col("x")).alias("cell"))
    last = F.col("start") + F.col("w") - 1
    cells = placed.select("set", "cand", "start", "w", F.explode(F.sequence(cell(F.col("start")), cell(last))).alias("cell"))
    met = rows.join(cells, ["set", "cell"]).filter((F.col("start") <= F.col("x")) & (F.col("x") < F.col("start") + F.col("w")))
    return met.select(*keys, "cand")
