"""Rewriting with one consistent mapping of lemmas per example: candidate sets, draws, rendering."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions.text import capitalise_first_letter, inflect, match_case, uniform
from glossa.operators.slicing import numbered
from glossa.operators.trees import same_profile, sentence_profiles
from glossa.session import forget, settled, stored


def race_key(weight: Column, u: Column) -> Column:
    """ln(u) / max(w, 1): the largest wins with a probability in proportion to max(w, 1)."""
    return F.ln(u) / F.greatest(weight.cast("double"), F.lit(1.0))


def weighted_draw(cands: DataFrame, by: list[str], cand: str, weight: str, seed: int, take: int = 1) -> DataFrame:
    """The first `take` candidates of each group in the order of an exponential race; fixed by seed, group and candidate."""
    u = uniform(seed, *(F.col(c) for c in by), F.col(cand))
    order = Window.partitionBy(*by).orderBy(race_key(F.coalesce(weight, F.lit(1)), u).desc(), cand)
    return cands.withColumn("draw", F.row_number().over(order)).filter(F.col("draw") <= take)


def lockstep(levels: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(example, lemma, level, cand, weight): candidates that all occurrences of a lemma share.

    levels: example, lemma, occ, level, cand, w; occurrences: example, lemma, occ, depth. At level k an occurrence
    takes part with its own level min(k, depth - 1); the first k with a common candidate counts. Weights are means,
    if every occurrence has one.
    """
    deepest = occurrences.groupBy("example", "lemma").agg(F.max("depth").alias("deepest"), F.count(F.lit(1)).alias("n_occ"))
    steps = occurrences.join(deepest, ["example", "lemma"]).select("example", "lemma", "occ", "n_occ", F.explode(F.sequence(F.lit(0), F.col("deepest") - 1)).alias("k"), "depth")
    steps = steps.withColumn("level", F.least("k", F.col("depth") - 1))
    met = steps.join(levels, ["example", "lemma", "occ", "level"])
    common = met.groupBy("example", "lemma", "k", "cand", "n_occ").agg(F.countDistinct("occ").alias("have"), F.avg("w").alias("mean"), F.count("w").alias("weighted")).filter("have = n_occ")
    first = common.groupBy("example", "lemma").agg(F.min("k").alias("k"))
    return common.join(first, ["example", "lemma", "k"]).select("example", "lemma", F.col("k").alias("level"), "cand", F.when(F.col("weighted") == F.col("n_occ"), F.col("mean")).alias("weight"))


def sample_mapping(cands: DataFrame, lemmas: DataFrame, seed: int, fallback: str = "passthrough") -> DataFrame:
    """(example, lemma, target): one target per lemma of each example.

    fallback for lemmas without a candidate: "passthrough" (or "coarsen") keeps the lemma, "drop" leaves out its
    whole example.
    """
    drawn = weighted_draw(cands, ["example", "lemma"], "cand", "weight", seed).select("example", "lemma", F.col("cand").alias("target"))
    whole = lemmas.join(drawn, ["example", "lemma"], "left")
    if fallback == "drop":
        bad = whole.filter(F.col("target").isNull()).select("example").distinct()
        return whole.join(bad, "example", "left_anti")
    if fallback not in ("passthrough", "coarsen"):
        raise ValueError(f"unknown fallback {fallback}")
    return whole.withColumn("target", F.coalesce("target", "lemma"))


def render(tokens: DataFrame, mapping: DataFrame, key: list[str], example: str) -> DataFrame:
    """Texts of the tokens under a mapping: inflected, cased like the source, capitals at sentence starts.

    Adds spans: the character span of every token in the new text. tokens: key, i, text, lemma, tag, is_start, fixed
    (true for tokens that stay). Fixed tokens don't meet the mapping, and the forms are written before they meet in texts.
    """
    own = F.coalesce("fixed", F.lit(False))
    joined = tokens.filter(~own).join(mapping.withColumnRenamed("example", example), [example, "lemma"], "left")
    form = match_case(F.col("text"), inflect(F.col("target"), F.col("tag")))
    form = F.when(F.col("is_start"), capitalise_first_letter(form)).otherwise(form)
    words = joined.withColumn("form", F.when(F.col("target").isNull() | (F.col("target") == F.col("lemma")), F.col("text")).otherwise(form))
    parts = [*key, "i", "text", "form"]
    words = words.select(*parts).unionByName(tokens.filter(own).withColumn("form", F.col("text")).select(*parts))
    words = stored(words.withColumn("gap", F.when(F.col("i") == 0, "").when(F.col("text").rlike(r"^[.,!?;:)\]]$"), "").otherwise(" ")).drop("text"))
    order = Window.partitionBy(*key).orderBy("i")
    words = words.withColumn("end", F.sum(F.length("gap") + F.length("form")).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("start", F.col("end") - F.length("form"))
    row = F.array_sort(F.collect_list(F.struct("i", "gap", "form", "start", "end")))
    whole = words.groupBy(*key).agg(row.alias("w"))
    return whole.select(*key, F.array_join(F.transform("w", lambda x: F.concat(x["gap"], x["form"])), "").alias("text"), F.transform("w", lambda x: F.struct(x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"))).alias("spans"))


def accepted_attempt(attempts: DataFrame, key: list[str]) -> DataFrame:
    """Of numbered attempts the first that validates, else the last one (J2). attempts: key, attempt, valid, text."""
    first = F.min(F.when(F.col("valid"), F.col("attempt")))
    chosen = attempts.groupBy(*key).agg(F.coalesce(first, F.max("attempt")).alias("attempt"))
    return attempts.join(chosen, [*key, "attempt"])


def validated(tokens: DataFrame, mapping: Callable[[int], DataFrame], parse: Callable[[DataFrame], DataFrame], key: list[str], example: str, attempts: int) -> DataFrame:
    """(key, attempt, valid, text): texts rewritten until a parse of the new text keeps the profile of every sentence.

    tokens: as for render(); mapping(k): the mapping of attempt k; parse: texts (key, text) to tokens. An attempt
    renders only texts that none before it has settled; of those that none settles the last one counts.
    """
    own = stored(sentence_profiles(tokens, key))
    rest, out = tokens, None
    for k in range(attempts):
        texts = stored(render(rest, mapping(k), key, example).select(*key, "text"))
        parsed = stored(parse(texts))
        same = same_profile(own.join(texts.select(*key), key, "left_semi"), sentence_profiles(parsed, key), key)
        tried = stored(texts.join(same, key).select(*key, F.lit(k).alias("attempt"), F.col("same").alias("valid"), "text"))
        done = tried if k == attempts - 1 else tried.filter("valid")
        out = done if out is None else out.unionByName(done)
        left = stored(rest.join(tried.filter("not valid").select(*key), key, "left_semi")) if k < attempts - 1 else rest
        forget(texts, parsed, *([rest] if rest is not tokens and left is not rest else []))
        rest = left
    forget(own, *([rest] if rest is not tokens else []))
    return out


def draw_name(requests: DataFrame, names: DataFrame, seed: int) -> DataFrame:
    """(request, name): a name of the wanted gender, any gender if none is wanted, never the excluded one.

    requests: request, gender, exclude; names: name, gender. Each gender's names are ranked once by hash and a
    request takes a place by its own hash: no request meets the whole list.
    """
    pools = names.select("name", "gender").unionByName(names.select("name", F.lit("any").alias("gender"))).distinct()
    order = Window.partitionBy("gender").orderBy(uniform(seed, F.col("gender"), F.col("name")), "name")
    ranked = pools.withColumn("place", F.row_number().over(order) - 1)
    sizes = pools.groupBy("gender").agg(F.count(F.lit(1)).alias("size"))
    asked = requests.withColumn("gender", F.coalesce("gender", F.lit("any"))).join(sizes, "gender")
    first = F.floor(uniform(seed + 1, F.col("request")) * F.col("size"))
    tries = asked.select("request", "gender", "exclude", F.explode(F.array(F.struct(F.lit(0).alias("t"), first.alias("place")), F.struct(F.lit(1).alias("t"), ((first + 1) % F.col("size")).alias("place")))).alias("p"))
    met = tries.select("request", "gender", "exclude", "p.t", "p.place").join(ranked, ["gender", "place"]).filter(~F.lower("name").eqNullSafe(F.lower("exclude")))
    return met.groupBy("request").agg(F.min(F.struct("t", "name"))["name"].alias("name"))


def template_items(frames: DataFrame, left: DataFrame, right: DataFrame, n: int, seed: int) -> DataFrame:
    """n items of frames and two different nouns, sampled by hash without replacement.

    frames: frame, pattern with {a}, {b}; left: a; right: b; each distinct. No product is made: every frame draws the
    places of pairs, in the order of a hash of the draw, from lists that are numbered once; draws that repeat a pair, or
    hit a word with itself, are left out, and three times as many are made as are asked for, and more if pairs are few.
    """
    spark = frames.sparkSession
    sides = [settled(numbered(d.select(c).distinct(), c, name="place")) for d, c in ((left, "a"), (right, "b"))]
    n_a, n_b, shapes = sides[0].count(), sides[1].count(), numbered(frames, "frame", "pattern", name="shape")
    n_frames = shapes.count()
    tries = min(3 * n + 64, 8 * n_a * n_b * max(1, n_frames) + 64)
    pick = lambda k, size: F.floor(uniform(seed + k, F.col("id")) * F.lit(size)).cast("long")
    draws = spark.range(tries).select("id", pick(0, n_frames).alias("shape"), pick(1, n_a).alias("pa"), pick(2, n_b).alias("pb"))
    met = draws.join(shapes, "shape").join(sides[0].withColumnRenamed("place", "pa"), "pa").join(sides[1].withColumnRenamed("place", "pb"), "pb").filter("a <> b")
    first = met.groupBy("frame", "pattern", "a", "b").agg(F.min("id").alias("id"))
    fill = lambda x, y: F.replace(F.replace("pattern", F.lit("{a}"), F.col(x)), F.lit("{b}"), F.col(y))
    items = first.select("id", "frame", "a", "b", capitalise_first_letter(fill("a", "b")).alias("good"), capitalise_first_letter(fill("b", "a")).alias("bad"))
    return items.orderBy("id").limit(n).drop("id")
