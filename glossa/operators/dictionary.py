"""Nested dictionary entries: senses, their tags and what they say about countability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTRY = "word string, pos string, lang_code string, tags array<string>, head_templates array<struct<name:string, args:map<string,string>>>, senses array<struct<tags:array<string>, glosses:array<string>>>"

# Tags of senses that are forms of other words, and tags by class.
FORM_TAGS = ("form-of", "alt-of", "misspelling", "obsolete")
REGIONS = ("UK", "US", "Scotland", "Ireland", "Australia", "Canada", "dialectal", "regional")
UNCOUNTABLE, PLURAL_ONLY, COUNTABLE = "uncountable", "plural-only", "countable"


def own_senses(senses: Column) -> Column:
    """Senses that aren't forms, misspellings or regional."""
    drop = F.array(*map(F.lit, FORM_TAGS + REGIONS))
    return F.filter(senses, lambda s: ~F.arrays_overlap(F.coalesce(s["tags"], F.array().cast("array<string>")), drop))


def plural_only(tags: Column, senses: Column) -> Column:
    """All remaining senses are plural only; without senses the entry's own tags decide."""
    has = lambda t: F.array_contains(F.coalesce(t, F.array().cast("array<string>")), PLURAL_ONLY)
    return F.when(F.size(senses) > 0, F.forall(senses, lambda s: has(s["tags"]))).otherwise(has(tags))


def is_lemma(templates: Column) -> Column:
    """Whether the head templates mark a lemma and not a form."""
    forms = F.exists(templates, lambda t: t["name"].contains("plural of") | (t["name"] == "head") & (F.element_at(t["args"], "2") == "noun form"))
    return ~F.coalesce(forms, F.lit(False))


def classified(entries: DataFrame) -> DataFrame:
    """(lemma, bucket, tags) of English nouns of one token; COUNT where nothing else is said."""
    nouns = entries.filter((F.col("lang_code") == "en") & (F.col("pos") == "noun") & F.col("word").rlike(r"^\p{Ll}+(?:['-]\p{Ll}+)*$"))
    rows = nouns.filter(is_lemma(F.col("head_templates"))).withColumn("s", own_senses(F.coalesce("senses", F.from_json(F.lit("[]"), "array<struct<tags:array<string>, glosses:array<string>>>"))))
    seen = F.array_sort(F.array_distinct(F.flatten(F.transform("s", lambda x: F.coalesce(x["tags"], F.array().cast("array<string>"))))))
    rows = rows.withColumn("seen", seen)
    un, co = F.array_contains("seen", UNCOUNTABLE), F.array_contains("seen", COUNTABLE)
    bucket = F.when(plural_only(F.col("tags"), F.col("s")), "PLURAL_ONLY").when(un & co, "BOTH").when(un, "MASS").otherwise("COUNT")
    return rows.select(F.col("word").alias("lemma"), bucket.alias("bucket"), F.col("seen").alias("tags"))
