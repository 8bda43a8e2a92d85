"""Context buckets: lemma counts per syntactic context, back-off to looser contexts, and their use as a gate.

A bucket is one string of named fields; a field that back-off has dropped is written as ~, which no tag is.
That keeps keys comparable without null-safe joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions.text import neighbour_tag
from glossa.session import settled

DROPPED = "~"
ADVERB_BIT = 8


def key_of(kind: str, *fields: Column | str) -> Column:
    """A bucket key; a field may be DROPPED."""
    return F.concat_ws("|", F.lit(kind), *(F.lit(f) if isinstance(f, str) else F.coalesce(f.cast("string"), F.lit(DROPPED)) for f in fields))


def backoff_chain() -> Column:
    """Keys from the strict one to the loosest, repeats left out.

    Needs pos, tag, dep, relpos, prev_tag, next_tag, head_tag, frame, comp, mask, bare of a token.
    """
    prev, nxt = neighbour_tag(F.col("prev_tag")), neighbour_tag(F.col("next_tag"))
    c = F.col
    loose_mask = F.when(c("mask").bitwiseAND(16) == 0, c("mask").bitwiseAND(~ADVERB_BIT)).otherwise(c("mask"))
    verb = [key_of("VERB", c("tag"), c("frame"), c("comp"), c("mask"), c("head_tag")), key_of("VERB", c("tag"), c("frame"), c("comp"), loose_mask, c("head_tag")), key_of("VERB", c("tag"), c("frame"), c("comp"), loose_mask, DROPPED)]
    noun = [key_of("NOUN", c("tag"), c("bare"), c("dep"))]
    adj = [
        key_of("ADJ", c("relpos"), c("prev_tag"), c("next_tag"), c("head_tag")),
        key_of("ADJ", c("relpos"), prev, nxt, c("head_tag")),
        key_of("ADJ", c("relpos"), prev, DROPPED, c("head_tag")),
        key_of("ADJ", c("relpos"), DROPPED, DROPPED, c("head_tag")),
        key_of("ADJ", c("relpos"), DROPPED, DROPPED, DROPPED),
        key_of("ADJ", DROPPED, DROPPED, DROPPED, DROPPED),
    ]
    adv = [
        key_of("ADV", c("prev_tag"), c("next_tag"), c("head_tag")),
        key_of("ADV", prev, nxt, c("head_tag")),
        key_of("ADV", DROPPED, DROPPED, c("head_tag")),
        key_of("ADV", DROPPED, DROPPED, DROPPED),
    ]
    chains = [(kind, F.array(*keys)) for kind, keys in (("VERB", verb), ("NOUN", noun), ("ADJ", adj), ("ADV", adv))]
    out = F.lit(None).cast("array<string>")
    for kind, keys in chains:
        out = F.when(c("pos") == kind, F.array_distinct(keys)).otherwise(out)
    return out


def key_fields(keys: DataFrame) -> DataFrame:
    """Strict keys (bucket) with the columns that backoff_chain() needs: a key's fields are all that its chain is made of."""
    part = F.split("bucket", r"\|")
    places = {"tag": {"VERB": 1, "NOUN": 1}, "frame": {"VERB": 2}, "comp": {"VERB": 3}, "mask": {"VERB": 4}, "head_tag": {"VERB": 5, "ADJ": 4, "ADV": 3}}
    places |= {"bare": {"NOUN": 2}, "dep": {"NOUN": 3}, "relpos": {"ADJ": 1}, "prev_tag": {"ADJ": 2, "ADV": 1}, "next_tag": {"ADJ": 3, "ADV": 2}}
    field = lambda at: F.nullif(F.coalesce(*(F.when(F.get(part, F.lit(0)) == pos, F.get(part, F.lit(k))) for pos, k in at.items())), F.lit(DROPPED))
    return keys.withColumns({"pos": F.get(part, F.lit(0))} | {name: field(at).cast("int" if name == "mask" else "string") for name, at in places.items()})


def lemma_statistics(tokens: DataFrame) -> DataFrame:
    """(bucket, lemma, n) over tokens with a chain; the strict key only. Counts combine before the shuffle."""
    strict = tokens.filter(F.col("chain").isNotNull()).select(F.get("chain", F.lit(0)).alias("bucket"), F.lower("lemma").alias("lemma"))
    return strict.groupBy("bucket", "lemma").agg(F.count(F.lit(1)).alias("n"))


def merged_statistics(*parts: DataFrame) -> DataFrame:
    """Sums of the counts of several shards."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("bucket", "lemma").agg(F.sum("n").alias("n"))


def pruned(stats: DataFrame, least: int) -> DataFrame:
    """Counts of at least `least`, lemmas in lower case (M1)."""
    low = stats.filter(F.col("bucket").isNotNull() & (F.col("n") > 0)).groupBy("bucket", F.lower("lemma").alias("lemma")).agg(F.sum("n").alias("n"))
    return low.filter(F.col("n") >= least)


def with_backoff(strict: DataFrame, chains: DataFrame, least: int) -> DataFrame:
    """Strict buckets plus the coarser ones that they project to.

    chains: bucket (strict), coarse: the distinct looser keys of each strict key. Strict counts are pruned first,
    projected only where they have no dropped field, summed, pruned again and added; counting the raw rows once
    per level would give other numbers.
    """
    base = pruned(strict, least)
    whole = base.filter(~F.col("bucket").contains("|" + DROPPED))
    coarse = whole.join(chains, "bucket").filter(F.col("coarse") != F.col("bucket")).groupBy(F.col("coarse").alias("bucket"), "lemma").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return base.unionByName(coarse).groupBy("bucket", "lemma").agg(F.sum("n").alias("n"))


def chains_of(tokens: DataFrame) -> DataFrame:
    """(bucket, coarse): the looser keys of every strict key that occurs."""
    rows = tokens.filter(F.size("chain") > 1).select(F.get("chain", F.lit(0)).alias("bucket"), "chain").distinct()
    return rows.select("bucket", F.explode(F.slice("chain", 2, 100)).alias("coarse")).distinct()


def level_statistics(stats: DataFrame, least: int) -> DataFrame:
    """(bucket, s, l): the sum and the number of the lemmas with `least` counts."""
    return stats.filter(F.col("n") >= least).groupBy("bucket").agg(F.sum("n").alias("s"), F.count(F.lit(1)).alias("l"))


def gated(requests: DataFrame, candidates: DataFrame, stats: DataFrame, least: int = 2, min_k: int = 2, share: float = 0.05, mode: str = "b", min_total: int = 0, pool: str = "request") -> DataFrame:
    """Candidates inside the first bucket of a request's chain that passes.

    requests: request, chain and the column that names their pool; candidates: that column and cand. Per level the
    bucket needs lemmas, and the candidates must meet it. Mode "b" asks for max(min_k, share * candidates) lemmas in
    the bucket, "a" for a total count. The strictest passing level wins; without one, the level with most lemmas, the
    strictest on ties. A request of one candidate is returned as it is, without weights.

    Many requests may share a pool: pools meet buckets on the lemma, once for each pair of pool and bucket, so that no
    request is joined with its whole pool. Distinct requests should be sent, not occurrences.
    """
    sizes = candidates.groupBy(pool).agg(F.count(F.lit(1)).alias("n_orig"))
    asked = requests.join(sizes, pool)
    single = asked.filter("n_orig <= 1").join(candidates, pool).select("request", "cand", F.lit(None).cast("long").alias("n"), F.lit(-1).alias("level"))
    usable = stats.filter(F.col("n") >= least)
    levels = asked.filter("n_orig > 1").select("request", F.col(pool).alias("p"), "n_orig", F.posexplode("chain").alias("level", "bucket"))
    levels = levels.join(level_statistics(stats, least), "bucket")
    pairs = levels.select("p", "bucket").distinct().join(usable.select("bucket", F.col("lemma").alias("cand"), "n"), "bucket")
    inside = settled(pairs.join(candidates.select(F.col(pool).alias("p"), "cand"), ["p", "cand"]))
    met = levels.join(inside.select("p", "bucket").distinct(), ["p", "bucket"])
    enough = F.lit(True)
    if mode == "b":
        enough = F.col("l") >= F.greatest(F.lit(min_k), F.floor(F.col("n_orig") * share))
    elif mode == "a":
        enough = F.col("s") >= min_total
    at = lambda c: F.struct(F.col(c).alias("by"), (-F.col("level")).alias("back"), "level", "p", "bucket")
    chosen = met.groupBy("request").agg(F.min(F.when(enough, F.struct("level", "p", "bucket"))).alias("first"), F.max(at("l")).alias("most"))
    chosen = chosen.select("request", *(F.coalesce(f"first.{c}", f"most.{c}").alias(c) for c in ("level", "p", "bucket")))
    return chosen.join(inside, ["p", "bucket"]).select("request", "cand", "n", "level").unionByName(single)


def top_p(rows: DataFrame, by: list[str], weight: str, p: float, least: int, tie: str) -> DataFrame:
    """The heaviest rows until they hold a share p of the weight, at least `least` of them (F1)."""
    if not 0 < p < 1:
        return rows
    order = Window.partitionBy(*by).orderBy(F.col(weight).desc(), tie)
    ranked = rows.withColumn("_ahead", F.coalesce(F.sum(weight).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_total", F.sum(weight).over(Window.partitionBy(*by))).withColumn("_rank", F.row_number().over(order))
    return ranked.filter((F.col("_ahead") < p * F.col("_total")) | (F.col("_rank") <= least) | (F.col("_total") <= 0)).drop("_ahead", "_total", "_rank")
