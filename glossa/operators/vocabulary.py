"""Vocabularies: counts, filters by vocabulary, name and proper-noun pools."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions.text import bare_words, inflect, let, sentences
from glossa.session import settled


def surface_counts(docs: DataFrame, pattern: str = r"^[A-Za-z]", least: int = 1) -> DataFrame:
    """Case-preserving counts of white-space words whose first character passes, with `least` or more."""
    words = docs.select(F.explode(F.split("text", r"\s+")).alias("token")).filter((F.col("token") != "") & F.col("token").rlike(pattern))
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def pair_counts(pairs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Counts of the words of several text columns together."""
    words = pairs.select(F.explode(F.concat(*(F.split(F.coalesce(c, F.lit("")), r"\s+") for c in columns))).alias("token")).filter("token <> ''")
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def top_words(counts: DataFrame, n: int) -> DataFrame:
    """The n most frequent words, ties by word; each task cuts its own first."""
    return counts.orderBy(F.col("n").desc(), "token").limit(n)


#: Words of a vocabulary that are sent with the plan, as a hashed set; a larger one is joined.
IN_PLACE = 50_000


def within_vocabulary(docs: DataFrame, vocabulary: DataFrame, key: str = "doc_id", in_place: int = IN_PLACE) -> DataFrame:
    """(key, text, kept_sentences): the sentences whose words are all in the vocabulary; documents without one go.

    Rows that share a key are one document, its sentences in their order, ties by text. A vocabulary of at most
    `in_place` words is a set inside the filter, so that nothing but what is left of a document is moved. A larger one
    meets the distinct words of each sentence in a join.
    """
    rows = docs.select(key, F.posexplode(sentences(F.col("text"))).alias("place", "sentence"))
    words = vocabulary.select("token").filter("token is not null").distinct()
    few = [r.token for r in words.limit(in_place + 1).collect()]  # a bounded number
    if len(few) <= in_place:
        bare = bare_words(F.col("sentence"))
        kept = rows.filter(let(bare, lambda w: (F.size(w) > 0) & F.forall(w, lambda x: x.isin(few) if few else F.lit(False))))
    else:
        rows = settled(rows.withColumn("row", F.monotonically_increasing_id()))
        asked = rows.select("row", F.array_distinct(bare_words(F.col("sentence"))).alias("w")).filter(F.size("w") > 0)
        missing = asked.select("row", F.explode("w").alias("token")).join(words, "token", "left_anti").select("row").distinct()
        whole = asked.select("row").join(missing, "row", "left_anti")
        kept = rows.join(whole, "row", "left_semi")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "sentence"))), lambda s: s["sentence"]), " ")
    return kept.groupBy(key).agg(text.alias("text"), F.count(F.lit(1)).alias("kept_sentences"))


def name_classes(names: DataFrame, share: float = 0.9, least: int = 1000) -> DataFrame:
    """Names by sex: one with a share of at least 0.9 and enough counts, else neutral if frequent (E5)."""
    sums = names.groupBy("name").agg(F.sum(F.when(F.col("sex") == "M", F.col("n")).otherwise(0)).alias("m"), F.sum(F.when(F.col("sex") == "F", F.col("n")).otherwise(0)).alias("f"))
    total = F.col("m") + F.col("f")
    label = F.when((F.col("m") >= share * total) & (F.col("m") >= least), "male").when((F.col("f") >= share * total) & (F.col("f") >= least), "female").when(total >= least, "neutral")
    return sums.select("name", "m", "f", label.alias("class")).filter("class is not null")


def top_per_class(classed: DataFrame, n: int) -> DataFrame:
    """The n most frequent names of each class."""
    order = Window.partitionBy("class").orderBy((F.col("m") + F.col("f")).desc(), "name")
    return classed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def proper_profile(tokens: DataFrame) -> DataFrame:
    """Counts by tag of the lemmas that are a proper noun at least once."""
    counted = tokens.groupBy("lemma").agg(
        F.count_if(F.col("tag") == "NNP").alias("nnp"),
        F.count_if(F.col("tag") == "NNPS").alias("nnps"),
        F.count_if(~F.col("tag").isin("NNP", "NNPS")).alias("other"),
    )
    return counted.filter(F.col("nnp") + F.col("nnps") > 0)


def proper_pool(counts: DataFrame, excluded: DataFrame, least: int = 80, shortest: int = 4, longest: int = 10) -> DataFrame:
    """Capitalised words without a lower-case twin, frequent, of usual length, on no excluded list."""
    word = F.col("token")
    shape = word.rlike("^[A-Z][A-Za-z]*$") & (F.upper(word) != word) & F.length(word).between(shortest, longest)
    twins = counts.filter(F.lower(word) == word).select(F.col("token").alias("low"))
    chosen = counts.filter(shape & (F.col("n") >= least)).withColumn("low", F.lower("token")).join(twins, "low", "left_anti")
    return chosen.join(excluded.select(F.lower("token").alias("low")), "low", "left_anti").select("token", "n")


def with_some_form(records: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Records that aren't nouns, have no word, or have a word, plural or singular in the vocabulary."""
    forms = records.filter((F.col("pos") == "noun") & F.col("word").isNotNull())
    known = vocabulary.select(F.lower("token").alias("form")).distinct()
    hit = forms.select("record", F.explode(F.array("word", "plural", "singular")).alias("form")).select("record", F.lower("form").alias("form")).join(known, "form", "left_semi").select("record").distinct()
    rest = records.filter((F.col("pos") != "noun") | F.col("word").isNull())
    return rest.unionByName(forms.join(hit, "record", "left_semi"))


def phrase_list(*lists: DataFrame) -> DataFrame:
    """Several lists as one without repeats."""
    out = lists[0]
    for other in lists[1:]:
        out = out.union(other)
    return out.distinct()


def realized(rows: DataFrame, forms: DataFrame) -> DataFrame:
    """rows (lemma, tag) with their form: the first that a table of forms lists, else by suffix rules (H7).

    forms: lemma, tag, rank, form. Of several words the last one is looked up and inflected.
    """
    head = F.regexp_extract("lemma", r"[^ ]*$", 0)
    first = forms.groupBy(F.col("lemma").alias("_head"), "tag").agg(F.min_by("form", F.struct("rank", "form")).alias("_form"))
    met = rows.withColumn("_head", head).join(first, ["_head", "tag"], "left")
    before = F.substring("lemma", F.lit(1), F.length("lemma") - F.length("_head"))
    form = F.when(F.col("_form").isNotNull(), F.concat(before, "_form")).otherwise(inflect(F.col("lemma"), F.col("tag")))
    return met.withColumn("form", form).drop("_head", "_form")
