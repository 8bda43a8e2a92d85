"""Token tables: the schema that parsers fill, the native rule-based parser, and the plug-in point for others.

tokens(key..., i, text, is_start, sent, pos, tag, lemma, dep, head). i counts from 0 within a text, head is the i
of the governing token (its own for a root). The native parser is made of Column expressions and windows over a
text; it is a mechanical stand-in that any other engine can repeat, not a linguistic one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.sources.readers import spread

#: Tokens: words with inner apostrophes, runs of digits, single other characters.
TOKEN_PATTERN = r"\p{L}+(?:['’]\p{L}+)*|\p{Nd}+|[^\s\p{L}\p{Nd}]"

# Fixed values of the native parser: closed classes and suffixes.
DETERMINERS = ("the", "a", "an", "la", "le", "el", "der", "die", "das", "un", "une", "des", "les")
ADPOSITIONS = ("of", "in", "to", "by", "with", "for", "on", "de", "du", "en", "zu", "von", "con", "para")
PRONOUNS = ("it", "there", "he", "she", "they", "you", "who", "which", "himself", "herself", "themselves", "elle", "que", "ich")
AUXILIARIES = ("is", "be", "was", "are", "has", "had", "est", "es", "ist", "und")
TO_WORDS = ("to", "zu", "de", "para")
SUBJECTS, OBJECTS = ("nsubj", "nsubjpass", "expl"), ("dobj", "iobj")
ENDS = (".", "!", "?")


def words_of(text: str = "text") -> Column:
    """The tokens of a text in an array."""
    return F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN_PATTERN), F.lit(0))


def parse(texts: DataFrame, key: list[str], text: str = "text", by: list[str] | None = None, piece: int | None = None) -> DataFrame:
    """The native parse of every text; key names the columns that tell texts apart.

    Rows are parsed one by one, also those that repeat a key or have none. Texts are dealt by the rows' numbers, or by
    the columns `by` of the key, which leaves the tokens dealt by them; words aren't moved. piece: as for spread().
    """
    # numbered before the words are taken out: a generator in the same projection would number these
    rows = texts.select(*key, F.col(text).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    rows = spread(rows, *(by or ["_row"]), piece=piece)
    words = rows.select(*key, "_row", F.posexplode(words_of("_text")).alias("i", "text"))
    doc = Window.partitionBy(*(by or []), "_row").orderBy("i")
    ends = F.col("text").isin(*ENDS)
    words = words.withColumn("before", F.lag(ends).over(doc)).withColumn("is_start", F.coalesce("before", F.lit(True)))
    words = words.withColumn("sent", F.sum(F.when(F.coalesce("before", F.lit(False)), 1).otherwise(0)).over(doc.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("before")
    low = F.lower("text")
    pos = (
        F.when(F.col("text").rlike(r"^[^\p{L}\p{Nd}]$"), "PUNCT")
        .when(F.col("text").rlike(r"^\p{Nd}"), "NUM")
        .when(low.isin(*DETERMINERS), "DET")
        .when(low.isin(*ADPOSITIONS), "ADP")
        .when(low.isin(*PRONOUNS), "PRON")
        .when(low.isin(*AUXILIARIES), "AUX")
        .when(~F.col("is_start") & F.col("text").rlike(r"^\p{Lu}"), "PROPN")
        .when(low.rlike("..ly$"), "ADV")
        .when(low.rlike("..(ed|ing|er|en|ar)$"), "VERB")
        .when(low.rlike("..(ble|ous|al|ich)$"), "ADJ")
        .otherwise("NOUN")
    )
    words = words.withColumn("pos", pos)
    p, s = F.col("pos"), low.rlike("..s$")
    tag = F.when(p == "VERB", F.when(low.endswith("ed"), "VBD").when(low.endswith("ing"), "VBG").otherwise("VB")).when(p == "NOUN", F.when(s, "NNS").otherwise("NN")).when(p == "PROPN", F.when(s, "NNPS").otherwise("NNP"))
    for name, t in (("ADJ", "JJ"), ("ADV", "RB"), ("DET", "DT"), ("ADP", "IN"), ("NUM", "CD"), ("PRON", "PRP"), ("AUX", "VBZ")):
        tag = tag.when(p == name, t)
    words = words.withColumn("tag", tag.otherwise("."))
    t = F.col("tag")
    words = words.withColumn("lemma", F.when(t.isin("NNS", "NNPS"), F.regexp_replace(low, "s$", "")).when(t == "VBD", F.regexp_replace(low, "ed$", "")).when(t == "VBG", F.regexp_replace(low, "ing$", "")).otherwise(low))
    sent = Window.partitionBy(*(by or []), "_row", "sent")
    order = sent.orderBy("i")
    noun = p.isin("NOUN", "PROPN")
    first = lambda c: F.min(F.when(c, F.col("i"))).over(sent)
    words = words.withColumn("root", F.coalesce(first(p == "VERB"), first(p != "PUNCT"), first(F.lit(True))))
    words = words.withColumn("next_noun", F.min(F.when(noun, F.col("i"))).over(order.rowsBetween(1, Window.unboundedFollowing)))
    words = words.withColumn("subject", F.max(F.when(noun & (F.col("i") < F.col("root")), F.col("i"))).over(sent)).withColumn("object", F.min(F.when(noun & (F.col("i") > F.col("root")), F.col("i"))).over(sent))
    words = words.withColumn("prev_pos", F.lag("pos").over(order)).withColumn("prev_low", F.lag(low).over(order))
    i, root = F.col("i"), F.col("root")
    governed = F.coalesce("next_noun", "root")
    arc = (
        F.when(i == root, F.struct(i.alias("head"), F.lit("ROOT").alias("dep")))
        .when(p == "DET", F.struct(governed.alias("head"), F.lit("det").alias("dep")))
        .when(p == "ADJ", F.struct(governed.alias("head"), F.lit("amod").alias("dep")))
        .when(p == "NUM", F.struct(governed.alias("head"), F.lit("nummod").alias("dep")))
        .when(p == "AUX", F.struct(root.alias("head"), F.lit("aux").alias("dep")))
        .when(p == "ADV", F.struct(root.alias("head"), F.lit("advmod").alias("dep")))
        .when(p == "PRON", F.struct(root.alias("head"), F.when(i > root, "dobj").when(low.isin("there", "it"), "expl").otherwise("nsubj").alias("dep")))
        .when(p == "ADP", F.struct(F.when(i > root, root).otherwise(governed).alias("head"), F.when(i > root, "prep").otherwise("case").alias("dep")))
        .when(noun & (F.col("prev_pos") == "ADP"), F.struct((i - 1).alias("head"), F.lit("pobj").alias("dep")))
        .when(i == F.col("subject"), F.struct(root.alias("head"), F.lit("nsubj").alias("dep")))
        .when(i == F.col("object"), F.struct(root.alias("head"), F.lit("dobj").alias("dep")))
        .when(noun, F.struct(root.alias("head"), F.lit("nmod").alias("dep")))
        .when(p == "VERB", F.struct(root.alias("head"), F.when(F.col("prev_low").isin(*TO_WORDS), "xcomp").otherwise("conj").alias("dep")))
        .otherwise(F.struct(root.alias("head"), F.lit("punct").alias("dep")))
    )
    return words.withColumn("arc", arc).select(*key, "i", "text", "is_start", "sent", "pos", "tag", "lemma", F.col("arc.dep").alias("dep"), F.col("arc.head").alias("head"))


def token_places(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key, i, char_start, char_end) of every token of parse(): only white space lies between tokens (C17)."""
    pieces = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(rf"\s*(?:{TOKEN_PATTERN})"), F.lit(0))
    rows = texts.select(*key, F.posexplode(pieces).alias("i", "piece"))
    order = Window.partitionBy(*key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("char_end", F.sum(F.length("piece")).over(order).cast("int"))
    return rows.select(*key, "i", (F.col("char_end") - F.length(F.regexp_replace("piece", r"^\s+", ""))).alias("char_start"), "char_end")


TOKEN_FIELDS = "i int, text string, is_start boolean, sent int, pos string, tag string, lemma string, dep string, head int"


def parse_with(texts: DataFrame, key: str, key_type: str, parser: Callable[[], Callable[[str], list[tuple]]], text: str = "text") -> DataFrame:
    """Tokens from a plug-in (A13, K2, L1): parser() is called once per Python worker and gives a function from a
    text to tuples of TOKEN_FIELDS. Texts travel in Arrow batches."""

    def run(batches) -> Iterator:
        import pandas as pd

        names, own = [f.split()[0] for f in TOKEN_FIELDS.split(", ")], parser()
        for b in batches:
            rows = [(k, *t) for k, x in zip(b[key], b[text]) for t in own(x or "")]
            yield pd.DataFrame(rows, columns=[key, *names])

    return texts.select(key, text).mapInPandas(run, f"{key} {key_type}, {TOKEN_FIELDS}")
