"""Evaluation: accuracies over temperatures and groups, margins, comparisons, losses, contrastive scores."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions.vectors import l2_normalised


def accuracy_by(scores: DataFrame, keys: list[str], keep_empty: bool = True) -> DataFrame:
    """Accuracy per temperature and value of each key, all keys in one pass.

    scores: temp_idx, correct (0 or 1) and the keys. Without keep_empty, groups with no correct item vanish.
    """
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys))).alias("g")
    out = scores.select("temp_idx", "correct", pairs).groupBy("temp_idx", "g.key", "g.value").agg(F.sum("correct").alias("right"), F.count(F.lit(1)).alias("n"))
    out = out if keep_empty else out.filter("right > 0")
    return out.select("temp_idx", "key", "value", "right", "n", (F.col("right") / F.col("n")).alias("accuracy"))


def macro_by_temperature(accuracies: DataFrame, key: str) -> DataFrame:
    """The mean over the groups of one key, per temperature."""
    return accuracies.filter(F.col("key") == key).groupBy("temp_idx").agg(F.avg("accuracy").alias("accuracy"))


def best_temperature(by_temperature: DataFrame, score: str = "accuracy") -> DataFrame:
    """The temperature of the largest score, the first one on ties: one row."""
    best = F.max(F.struct(F.col(score), (-F.col("temp_idx")).alias("back")))
    return by_temperature.agg(best.alias("b")).select((-F.col("b.back")).alias("temp_idx"), F.col(f"b.{score}").alias(score))


def confusion(rows: DataFrame, predicted: str, gold: str, labels: list) -> DataFrame:
    """tp, fp, fn and F1 of each label; F1 is 0 without true positives."""
    counts = rows.groupBy(F.col(predicted).alias("p"), F.col(gold).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    own = F.explode(F.array(*map(F.lit, labels))).alias("label")
    each = counts.select("p", "g", "n", own)
    hit = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    is_p, is_g = F.col("p") == F.col("label"), F.col("g") == F.col("label")
    out = each.groupBy("label").agg(hit(is_p & is_g).alias("tp"), hit(is_p & ~is_g).alias("fp"), hit(~is_p & is_g).alias("fn"))
    return out.withColumn("f1", F.when(F.col("tp") == 0, 0.0).otherwise(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))))


def binary_metrics(rows: DataFrame, predicted: str, gold: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """accuracy, F1 and Matthews correlation of 0/1 columns."""
    p, g = F.col(predicted) == 1, F.col(gold) == 1
    c = rows.groupBy(*by).agg(F.count_if(p & g).alias("tp"), F.count_if(p & ~g).alias("fp"), F.count_if(~p & g).alias("fn"), F.count_if(~p & ~g).alias("tn"))
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return c.select(*by, ((tp + tn) / (tp + fp + fn + tn)).alias("accuracy"), F.when(tp == 0, 0.0).otherwise(2 * tp / (2 * tp + fp + fn)).alias("f1"), F.when(root == 0, 0.0).otherwise((tp * tn - fp * fn) / root).alias("mcc"))


def margins(rows: DataFrame, margin: str, kind: str) -> DataFrame:
    """n, accuracy (margin above 0) and mean margin, overall (kind null) and by kind; null margins are skipped."""
    known = rows.filter(F.col(margin).isNotNull())
    return known.rollup(kind).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(margin) > 0).cast("double")).alias("accuracy"), F.avg(margin).alias("mean_margin"))


def split_accuracy(rows: DataFrame, ids: DataFrame, key: str, correct: str = "correct") -> DataFrame:
    """Accuracy over all rows and over those on a list, in one pass (D4). The list is joined by its distinct ids."""
    marked = rows.join(ids.select(F.col("id").alias(key)).distinct().withColumn("hard", F.lit(1)), key, "left")
    return marked.agg(F.avg(correct).alias("accuracy"), F.avg(F.when(F.col("hard") == 1, F.col(correct))).alias("hard_accuracy"), F.count_if(F.col("hard") == 1).alias("n_hard"))


def compare_sets(derived: DataFrame, reference: DataFrame, key: str, value: str) -> DataFrame:
    """missing, extra, changed or same for every key of two sets (D10). Null is a key like any other."""
    d, r = derived.select(key, F.col(value).alias("d"), F.lit(1).alias("in_d")), reference.select(key, F.col(value).alias("r"), F.lit(1).alias("in_r"))
    state = F.when(F.col("in_d").isNull(), "missing").when(F.col("in_r").isNull(), "extra").when(~F.col("d").eqNullSafe(F.col("r")), "changed").otherwise("same")
    both = d.alias("x").join(r.alias("y"), F.col(f"x.{key}").eqNullSafe(F.col(f"y.{key}")), "full_outer")
    return both.select(F.coalesce(f"x.{key}", f"y.{key}").alias(key), state.alias("state"))


def weighted_mean(value: Column, weight: Column) -> Column:
    """sum(v * w) / sum(w)."""
    return F.sum(value * weight) / F.sum(weight)


def perplexity(loss: Column, tokens: Column) -> Column:
    """exp of the token-weighted mean loss."""
    return F.exp(F.sum(loss * tokens) / F.greatest(F.lit(1), F.sum(tokens)))


def rank_value(df: DataFrame, value: str, by: list[str], percent: int) -> DataFrame:
    """The value at index n * percent / 100 of the descending order, an exact rank and no interpolation.

    Equal values are counted first, so that only distinct values are sorted.
    """
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy(*by).orderBy(F.col(value).desc())
    placed = counts.withColumn("upto", F.sum("c").over(order)).withColumn("n", F.sum("c").over(Window.partitionBy(*by)))
    at = F.floor(F.col("n") * percent / 100)
    return placed.filter((F.col("upto") > at) & (F.col("upto") - F.col("c") <= at)).select(*by, value)


def log_softmax_at(logits: Column, label: Column, temperature: Column) -> Column:
    """log softmax of logits / T at a label."""
    scaled = F.transform(logits, lambda x: x / temperature)
    top = F.array_max(scaled)
    total = F.aggregate(scaled, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.get(scaled, label) - top - F.ln(total)


#: Rows of a block and of a tile of the contrastive loss: a task holds two blocks of vectors and TILE * BLOCK_ROWS products.
BLOCK_ROWS, TILE = 8192, 512


def infonce(features: DataFrame, key: str, vector: str, group: str, tau: float = 0.1, blocks: int = 0) -> DataFrame:
    """Multi-positive InfoNCE: (n, loss), rows without a positive left out.

    Every row must meet every other one: that is the definition of its denominator. Rows are dealt to blocks and
    pairs of blocks meet as matrix products, a tile at a time; only the sums per row leave a pair of blocks. Without
    `blocks` there is one for each BLOCK_ROWS rows, so that a task's matrices don't grow with the table. Vectors are
    normalised once.
    """
    import numpy as np
    import pandas as pd

    blocks = blocks or max(4, -(-features.count() // BLOCK_ROWS))
    unit = features.select(F.col(key).alias("k"), F.col(group).alias("g"), l2_normalised(F.col(vector)).alias("v")).withColumn("b", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = unit.select("k", "g", "v", F.col("b").alias("i"), others.alias("j")).groupBy("i", "j")
    right = unit.select("k", "g", "v", F.col("b").alias("j"), others.alias("i")).groupBy("i", "j")

    def sums(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"k": [], "whole": [], "near": [], "n_near": []})
        right, keys, groups, parts = np.stack(y.v.to_list()).T, y.k.to_numpy(), y.g.to_numpy(), []
        for at in range(0, len(x), TILE):
            part = x.iloc[at : at + TILE]
            e = np.exp(np.stack(part.v.to_list()) @ right / tau)
            e[part.k.to_numpy()[:, None] == keys] = 0
            same = (part.g.to_numpy()[:, None] == groups) & (e > 0)
            parts.append(pd.DataFrame({"k": part.k, "whole": e.sum(1), "near": (e * same).sum(1), "n_near": same.sum(1)}))
        return pd.concat(parts)

    schema = f"k {features.schema[key].dataType.simpleString()}, whole double, near double, n_near long"
    met = left.cogroup(right).applyInPandas(sums, schema)
    rows = met.groupBy("k").agg(F.sum("whole").alias("whole"), F.sum("near").alias("near"), F.sum("n_near").alias("n_near")).filter("n_near > 0")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(-F.ln(F.col("near") / F.col("whole"))).alias("loss"))


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New cells replace old ones, others stay (B16). Null is a value of a key like any other."""
    gone = reduce(and_, (F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in key))
    return old.alias("o").join(new.select(*key).alias("n"), gone, "left_anti").unionByName(new)


def mean_pooled(words: DataFrame, key: list[str], vector: str) -> DataFrame:
    """The element-wise mean of vectors that belong together."""
    parts = words.select(*key, F.posexplode(vector).alias("dim", "x"))
    means = parts.groupBy(*key, "dim").agg(F.avg("x").alias("x"))
    return means.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias(vector))


def greedy_selection(pool: DataFrame, target: int, per_frame: int, per_pair: int, ctrl_margin: float = 1.0, conf_margin: float = 0.5) -> DataFrame:
    """Items in pool order under caps that depend on what was kept before.

    pool: family, pool_order, frame, pair, item, delta_conf, delta_ctrl. An item that one cap rejects does not
    count for the other, so ranks per frame and per pair would be wrong; each family is folded in order. Caps only
    fill up, so that of one frame and pair none is kept after one is rejected: no more than the smaller cap of each
    such cell, and each item once, is sent to the fold, which is thereby bounded by the cells of a family.
    """
    import pandas as pd

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        frames, pairs, seen, kept = {}, {}, set(), []
        for r in rows.sort_values("pool_order").itertuples(index=False):
            if len(kept) >= target:
                break
            if frames.get(r.frame, 0) >= per_frame or pairs.get(r.pair, 0) >= per_pair or (r.frame, r.pair, r.item) in seen:
                continue
            frames[r.frame], pairs[r.pair] = frames.get(r.frame, 0) + 1, pairs.get(r.pair, 0) + 1
            seen.add((r.frame, r.pair, r.item))
            kept.append(r)
        out = pd.DataFrame(kept, columns=rows.columns).sort_values(["delta_conf", "pool_order"], kind="stable")
        out["place"] = range(len(out))
        return out

    strong = pool.filter((F.col("delta_ctrl") >= ctrl_margin) & (F.col("delta_conf") <= -conf_margin))
    again = Window.partitionBy("family", "frame", "pair", "item").orderBy("pool_order")
    first = strong.withColumn("_r", F.row_number().over(again)).filter("_r = 1").drop("_r")
    cell = Window.partitionBy("family", "frame", "pair").orderBy("pool_order")
    strong = first.withColumn("_r", F.row_number().over(cell)).filter(F.col("_r") <= min(per_frame, per_pair)).drop("_r")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in strong.schema) + ", place long"
    return strong.groupBy("family").applyInPandas(fold, schema)


def joined_metrics(first: DataFrame, second: DataFrame, groups: DataFrame, key: str = "uid") -> DataFrame:
    """(group, key, a, b): two maps of metrics (a column m each) side by side, with the group of each name."""
    a, b = (d.select(F.explode("m").alias(key, n)) for d, n in ((first, "a"), (second, "b")))
    return a.join(b, key).join(groups, key).select("group", key, "a", "b")


#: Orders of two pairs (x1, y1), (x2, y2) by mode.
ARRANGEMENTS = {
    "primary": ("x1 y1 x2 y2",),
    "sem2": ("x1 y1 x2 y2", "x2 y2 x1 y1"),
    "all4": ("x1 y1 x2 y2", "x1 y2 x2 y1", "x2 y2 x1 y1", "x2 y1 x1 y2"),
}


def arranged(items: DataFrame, key: list[str], modes: tuple[str, ...] = tuple(ARRANGEMENTS)) -> DataFrame:
    """(key, mode, arrangement): two pairs x1, y1 and x2, y2 in all orders of each mode."""
    one = lambda order: F.concat_ws(" ", *order.split())
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("mode"), one(o).alias("arrangement")) for m in modes for o in ARRANGEMENTS[m]))).alias("a")
    return items.select(*key, each).select(*key, "a.mode", "a.arrangement")
