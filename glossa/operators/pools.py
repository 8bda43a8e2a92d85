"""Candidate pools: countability slots, verb frames, licenses, names and gates by vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Order of priority of the countability classes, and of tags by license.
BUCKETS = ("PLURAL_ONLY", "BOTH", "MASS", "COUNT")
GENDERS = ("m", "f", "n")
LICENSE_TAGS = {"there": ("raising_there", "raising"), "ecm_it": ("ecm_it", "ecm"), "obj": ("object_control", "ecm"), "subj": ("subject_control", "raising"), "subjpass": ("raising", "subject_control")}
ADJECTIVE_TAGS = ("tough", "raising", "control")

#: Which classes replace a noun of a class, by tag and bareness (G1).
SLOTS = {
    ("NNS", None): {"BOTH": ("BOTH",), "COUNT": ("COUNT", "BOTH", "PLURAL_ONLY"), "MASS": ("COUNT", "BOTH", "PLURAL_ONLY"), "UNKNOWN": ("COUNT", "BOTH", "PLURAL_ONLY"), "PLURAL_ONLY": ("PLURAL_ONLY",)},
    ("NN", True): {"BOTH": ("BOTH",), "COUNT": ("MASS", "BOTH"), "MASS": ("MASS", "BOTH"), "UNKNOWN": ("MASS", "BOTH"), "PLURAL_ONLY": ("MASS", "BOTH")},
    ("NN", False): {"BOTH": ("BOTH",), "COUNT": ("COUNT",), "MASS": ("MASS",), "UNKNOWN": ("COUNT", "BOTH"), "PLURAL_ONLY": ()},
}


def bucket_of(pools: DataFrame) -> DataFrame:
    """(lemma, bucket): the class of highest priority that lists a lemma (G2). pools: lemma, bucket."""
    rank = F.array_position(F.array(*map(F.lit, BUCKETS)), F.col("bucket"))
    return pools.groupBy("lemma").agg(F.min(F.struct(rank.alias("r"), "bucket"))["bucket"].alias("bucket"))


def slot_rules(spark: SparkSession) -> DataFrame:
    """The slot table as rows (tag, bare, source, target); some tens of rows."""
    rows = [(tag, bare, source, t) for (tag, b), m in SLOTS.items() for bare in ((b,) if b is not None else (True, False)) for source, ts in m.items() for t in ts]
    return spark.createDataFrame(rows, "tag string, bare boolean, source string, target string")


def noun_pool(slots: DataFrame, pools: DataFrame) -> DataFrame:
    """(request, cand) for slots (request, lemma, tag, bare); the source lemma is never a candidate."""
    own = slots.join(bucket_of(pools), "lemma", "left").withColumn("source", F.coalesce("bucket", F.lit("UNKNOWN"))).drop("bucket")
    rules = own.join(F.broadcast(slot_rules(slots.sparkSession)), ["tag", "bare", "source"])  # a fixed table
    met = rules.join(pools.select(F.col("bucket").alias("target"), F.col("lemma").alias("cand")), "target")
    return met.filter(F.col("cand") != F.col("lemma")).select("request", "cand").distinct()


def noun_sets(slots: DataFrame, pools: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((request, lemma, set), (set, cand, w)): noun_pool() as the sets of classes that slots share, a dozen at most.

    A slot isn't joined with its candidates; the source lemma is left out when one is drawn.
    """
    own = slots.join(bucket_of(pools), "lemma", "left").withColumn("source", F.coalesce("bucket", F.lit("UNKNOWN"))).drop("bucket")
    rules = slot_rules(slots.sparkSession).groupBy("tag", "bare", "source").agg(F.array_sort(F.collect_set("target")).alias("targets"))
    asked = own.join(F.broadcast(rules), ["tag", "bare", "source"])  # a fixed table
    requests = asked.select("request", "lemma", F.array_join("targets", " ").alias("set"))
    sets = rules.select(F.array_join("targets", " ").alias("set"), F.explode("targets").alias("bucket")).distinct()
    members = pools.join(F.broadcast(sets), "bucket").select("set", F.col("lemma").alias("cand"), F.lit(1).cast("long").alias("w")).distinct()
    return requests, members


def broad_pools(pools: DataFrame) -> DataFrame:
    """(number, lemma): singular is MASS, COUNT and BOTH, plural COUNT, BOTH and PLURAL_ONLY."""
    number = F.explode(F.when(F.col("bucket") == "MASS", F.array(F.lit("NN"))).when(F.col("bucket") == "PLURAL_ONLY", F.array(F.lit("NNS"))).otherwise(F.array(F.lit("NN"), F.lit("NNS"))))
    return pools.select(number.alias("number"), "lemma").distinct()


def verbs_for_shape(requests: DataFrame, frames: DataFrame) -> DataFrame:
    """(request, verb, step): verbs of a frame in three steps, the first that finds any.

    requests: request, key, comp, preps, flags; frames: verb, key, comp, preps, flags, protected (arrays sorted).
    1: equal preps and flags within the request's; 2: more preps, protected flags agree; 3: equal preps,
    protected flags agree. A frame's protected flags must be among the request's.
    """
    none = lambda a, b: F.size(F.array_except(a, b)) == 0
    safe, fits = none(F.col("f.protected"), F.col("q.flags")), none(F.col("f.flags"), F.col("q.flags"))
    shape = (F.col("q.key") == F.col("f.key")) & (F.col("q.comp") == F.col("f.comp"))
    f = frames.alias("f")
    equal = requests.alias("q").join(f, shape & (F.col("q.preps") == F.col("f.preps")))
    found = equal.select("q.request", "f.verb", F.when(fits, 1).when(safe, 3).alias("step")).filter("step is not null")
    # only requests without a verb of the first step meet frames of other prepositions, and by one that they hold
    rest = requests.join(found.filter("step = 1").select("request").distinct(), "request", "left_anti")
    some = rest.filter(F.size("preps") > 0).withColumn("prep", F.get("preps", F.lit(0))).alias("q")
    by_prep = frames.withColumn("prep", F.explode("preps")).alias("f")
    more = some.join(by_prep, shape & (F.col("q.prep") == F.col("f.prep")) & none(F.col("q.preps"), F.col("f.preps")) & safe)
    any_prep = rest.filter(F.size("preps") == 0).alias("q").join(f, shape & safe)
    for wider in (more, any_prep):
        found = found.unionByName(wider.select("q.request", "f.verb", F.lit(2).alias("step")))
    first = found.groupBy("request").agg(F.min("step").alias("step"))
    return found.join(first, ["request", "step"]).select("request", "verb", "step").distinct()


def holding(lexicon: DataFrame, required: Column | list[str]) -> DataFrame:
    """Entries whose licenses contain all required ones."""
    need = F.array(*map(F.lit, required)).cast("array<string>") if isinstance(required, list) else required
    return lexicon.filter(F.size(F.array_except(need, F.col("licenses"))) == 0)


def same_tag_pool(requests: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(request, cand): lemmas of a request's own tag that hold its license, without itself.

    requests: request, lemma, license. The tag is the first of the license's priority list that the lemma has.
    """
    order = F.create_map(*(x for k, v in LICENSE_TAGS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    own = requests.join(lexicon.select("lemma", "tags", "licenses"), "lemma").filter(F.array_contains("licenses", F.col("license")))
    tag = F.get(F.filter(F.element_at(order, F.col("license")), lambda t: F.array_contains("tags", t)), F.lit(0))
    picked = own.select("request", "lemma", "license", tag.alias("tag")).filter(F.col("tag").isNotNull())
    pool = lexicon.select(F.explode("tags").alias("tag"), F.col("lemma").alias("cand"), F.col("licenses").alias("held"))
    met = picked.join(pool, "tag").filter(F.array_contains("held", F.col("license")) & (F.col("cand") != F.col("lemma")))
    return met.select("request", "cand").distinct()


def adjective_tag(tags: Column) -> Column:
    """tough, else raising, else control."""
    out = F.lit(None).cast("string")
    for t in reversed(ADJECTIVE_TAGS):
        out = F.when(F.array_contains(tags, t), t).otherwise(out)
    return out


def gender_of(names: DataFrame, lists: DataFrame) -> DataFrame:
    """(name, gender): the first of m, f and n whose list holds the case-folded name."""
    rank = F.array_position(F.array(*map(F.lit, GENDERS)), F.col("gender"))
    best = lists.groupBy(F.lower("name").alias("low")).agg(F.min(F.struct(rank.alias("r"), "gender"))["gender"].alias("gender"))
    return names.withColumn("low", F.lower("name")).join(best, "low", "left").drop("low")


def allowed(pool: DataFrame, vocabulary: DataFrame, banned: DataFrame) -> DataFrame:
    """Candidates of the vocabulary that no list bans (J10, J12, J13, G5, G6). All have a column lemma."""
    return pool.join(vocabulary.select("lemma").distinct(), "lemma", "left_semi").join(banned.select("lemma").distinct(), "lemma", "left_anti")


def narrowed(pool: DataFrame, gate: DataFrame, request: str = "request", cand: str = "cand") -> DataFrame:
    """Candidates that pass a gate, but all of a request's where none does."""
    marked = pool.join(gate.select(cand).distinct().withColumn("_in", F.lit(1)), cand, "left")
    survivors = marked.groupBy(request).agg(F.max("_in").alias("_some"))
    kept = marked.join(survivors, request).filter((F.col("_in") == 1) | F.col("_some").isNull())
    return kept.select(request, cand)


def base_of_participle(forms: DataFrame, verbs: DataFrame, irregular: DataFrame) -> DataFrame:
    """(form, verb): an irregular base, else the first known verb among -ied, -ed, -d and -e guesses."""
    f = F.col("form")
    cut = lambda n: F.substring(f, F.lit(1), F.length(f) - n)
    guesses = F.array(F.when(f.endswith("ied"), F.concat(cut(3), F.lit("y"))), F.when(f.endswith("ed"), cut(2)), F.when(f.endswith("ed"), cut(1)), F.when(f.endswith("ed"), F.concat(cut(2), F.lit("e"))))
    rows = forms.select("form", F.posexplode(guesses).alias("rank", "verb")).filter(F.col("verb").isNotNull()).join(verbs.select("verb").distinct(), "verb")
    first = irregular.select("form", F.lit(-1).alias("rank"), "verb").join(forms.select("form"), "form")
    return rows.select("form", "rank", "verb").unionByName(first).groupBy("form").agg(F.min(F.struct("rank", "verb"))["verb"].alias("verb"))


def merged_countability(rows: DataFrame) -> DataFrame:
    """(lemma, bucket, tags): BOTH before COUNT or PLURAL_ONLY (the first seen) before MASS; tags united.

    rows: lemma, bucket, tags, place (the order seen).
    """
    rank = F.when(F.col("bucket") == "BOTH", 0).when(F.col("bucket").isin("COUNT", "PLURAL_ONLY"), 1).otherwise(2)
    return rows.groupBy("lemma").agg(F.min(F.struct(rank.alias("r"), "place", "bucket"))["bucket"].alias("bucket"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"))


def with_derived_tag(lexicon: DataFrame, source: str, license: str, derived: str) -> DataFrame:
    """Entries with a tag and a license also get the derived tag."""
    has = F.array_contains("tags", source) & F.array_contains("licenses", license)
    return lexicon.withColumn("tags", F.when(has, F.array_sort(F.array_union("tags", F.array(F.lit(derived))))).otherwise(F.col("tags")))


def object_counts(frames: DataFrame) -> DataFrame:
    """(verb, objects): the fewest objects of a verb's frame strings, -1 if none says (I26). frames: verb, frame."""
    said = F.size(F.regexp_extract_all(F.regexp_replace("frame", r"^\S+", ""), F.lit(r"something|somebody"), F.lit(0)))
    return frames.groupBy("verb").agg(F.coalesce(F.min(F.when(F.col("frame").isNotNull(), F.least(said, F.lit(2)))), F.lit(-1)).alias("objects"))


def complement_profile(frames: DataFrame) -> DataFrame:
    """(verb, that, wh, to): which complements the frame strings allow; all if there are none."""
    says = lambda p: F.coalesce(F.max(F.col("frame").rlike(p)), F.lit(True))
    return frames.groupBy("verb").agg(says(r"\bthat\b").alias("that"), says(r"\bwhether\b").alias("wh"), says(r"\bto\b").alias("to"))


def preps_after(frames: DataFrame) -> DataFrame:
    """(verb, preps): prepositions named in the frame strings."""
    named = F.explode(F.regexp_extract_all("frame", F.lit(r"\b(of|in|to|by|with|for|on|from)\b"), F.lit(1)))
    return frames.select("verb", named.alias("p")).groupBy("verb").agg(F.array_sort(F.collect_set("p")).alias("preps"))


def first_per_form(entries: DataFrame) -> DataFrame:
    """The first entry of each (pos, form) of good shape (M39, M38). entries: pos, form, place, lemma."""
    order = Window.partitionBy("pos", "form").orderBy("place", "lemma")
    good = entries.filter(F.col("form").rlike(r"^[a-z]+(?:[-'][a-z]+)*$"))
    return good.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def frame_index(frames: DataFrame) -> DataFrame:
    """(key, comp, preps, flags, verbs): the verbs of each frame."""
    return frames.groupBy("key", "comp", "preps", "flags").agg(F.array_sort(F.collect_set("verb")).alias("verbs"))


def broad_verbs(index: DataFrame) -> DataFrame:
    """All verbs of a frame index."""
    return index.select(F.explode("verbs").alias("verb")).distinct()


def gated_names(names: DataFrame, gender: str | None, vocabulary: DataFrame, banned: DataFrame) -> DataFrame:
    """Names of a gender, or of any, that the vocabulary holds and no list bans."""
    pool = names if gender is None else names.filter(F.col("gender") == gender)
    return allowed(pool.withColumn("lemma", F.lower("name")), vocabulary, banned).drop("lemma").distinct()
