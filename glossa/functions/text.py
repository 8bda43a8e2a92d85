"""Text functions as Column expressions: tokens, counts, casing, slices, hashes. No Python on the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words with inner apostrophes, or runs of digits.
WORD_PATTERN = r"\p{L}+(?:['’]\p{L}+)*|\p{Nd}+"
#: Unicode white space, as str.split() and str.strip() know it.
UNICODE_SPACE = r"(?U)\s+"
EDGES = r"(?U)^\s+|\s+$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once a row, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tokenize(text: Column, lowercase: bool = True) -> Column:
    """Word tokens of a text (H1)."""
    return F.regexp_extract_all(F.lower(text) if lowercase else text, F.lit(WORD_PATTERN), F.lit(0))


def strip(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, EDGES, "")


def pieces(text: Column) -> Column:
    """Parts between runs of white space, none empty."""
    return F.filter(F.split(text, UNICODE_SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of white-space words (H2)."""
    return F.size(pieces(text))


def truncate_words(text: Column, n: Column | int) -> Column:
    """The first n white-space words."""
    return F.array_join(F.slice(pieces(text), 1, n), " ")


def bare_words(sentence: Column) -> Column:
    """Lower-case words without leading or trailing characters that aren't letters or digits."""
    cut = F.transform(pieces(sentence), lambda w: F.lower(F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")))
    return F.filter(cut, lambda w: w != "")


def title_and_body(text: Column) -> Column:
    """What follows the first line feed, null if there is none or nothing but spaces."""
    at = F.instr(text, "\n")
    body = F.trim(F.substring(text, at + 1, F.length(text)))
    return F.when((at > 0) & (body != ""), body)


def match_case(source: Column, candidate: Column) -> Column:
    """The candidate in the casing of the source: upper, lower, title, or first letter only (H3)."""
    cased = F.upper(source) != F.lower(source)
    rest = F.substring(candidate, 2, F.length(candidate))
    first = F.upper(F.substring(candidate, 1, 1))
    titled = source == F.concat(F.upper(F.substring(source, 1, 1)), F.lower(F.substring(source, 2, F.length(source))))
    initial = F.substring(source, 1, 1)
    return (
        F.when(cased & (source == F.upper(source)), F.upper(candidate))
        .when(cased & (source == F.lower(source)), F.lower(candidate))
        .when(cased & titled, F.concat(first, F.lower(rest)))
        .when((initial == F.upper(initial)) & (initial != F.lower(initial)), F.concat(first, rest))
        .otherwise(candidate)
    )


def capitalise_first_letter(text: Column) -> Column:
    """The first letter in upper case, wherever it is (H4)."""
    before = F.regexp_extract(text, r"^[^\p{L}]*", 0)
    at = F.length(before) + 1
    return F.concat(before, F.upper(F.substring(text, at, F.lit(1))), F.substring(text, at + 1, F.length(text)))


def neighbour_tag(tag: Column) -> Column:
    """Brackets and tags of punctuation only become PUNCT; the markers of edges stay."""
    return F.when(tag.isin("START", "END", "OTHER", "NONE"), tag).when(tag.isin("-LRB-", "-RRB-") | tag.rlike(r"^[^\p{L}\p{N}]+$"), F.lit("PUNCT")).otherwise(tag)


def swapped_tokens(a: Column, b: Column) -> Column:
    """Places (from 0) of the two tokens by whose exchange b becomes a; null if b isn't a with two swapped (H8)."""
    x, y = (F.regexp_extract_all(t, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), F.lit(0)) for t in (a, b))
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(x) - 1, F.lit(0))), lambda i: F.get(x, i) != F.get(y, i))
    i, j = F.get(places, F.lit(0)), F.get(places, F.lit(1))
    crossed = (F.get(x, i) == F.get(y, j)) & (F.get(x, j) == F.get(y, i))
    return F.when((F.size(x) == F.size(y)) & (F.size(places) == 2) & crossed, places)


def seed_of(seed: int, record: Column) -> Column:
    """A record's seed: 48 bits of SHA-256 of "seed:record", within a long."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), record.cast("string")), 256), 1, 12), 16, 10).cast("long")


def uniform(seed: int, *parts: Column) -> Column:
    """In (0, 1), fixed by the seed and the parts, whatever the partitioning."""
    text = F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts))
    return (F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)


def set_digest(values: Column) -> Column:
    """A digest of a set of strings that doesn't depend on their order."""
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(values)), "\n"), 256)


def subsequence_starts(haystack: Column, needle: Column) -> Column:
    """All start places (from 0) of an array inside another."""
    last = F.size(haystack) - F.size(needle)
    found = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.slice(haystack, i + 1, F.size(needle)) == needle)
    return F.when((last >= 0) & (F.size(needle) > 0), found).otherwise(F.array().cast("array<int>"))


def first_surface_match(tokens: Column, surfaces: list[Column]) -> Column:
    """Starts of the first surface variant, in the given order, that occurs at all."""
    found = [subsequence_starts(tokens, s) for s in surfaces]
    return F.coalesce(*(F.when(F.size(f) > 0, f) for f in found))


def round_half_up(value: Column, places: int = 1) -> Column:
    """Decimal rounding, halves away from zero."""
    return F.round(value.cast("decimal(18,6)"), places).cast("double")


def size_name(text: Column) -> Column:
    """"05m" as "5M" (M67)."""
    return F.upper(F.regexp_replace(text, "^0+(?=[0-9])", ""))


def run_name(name: Column) -> Column:
    """Method, size, fraction and seed out of the name of a run's log."""
    pattern = r"^([A-Za-z]+)_0*([0-9]+m)_([0-9.]+)_seed0*([0-9]+)"
    part = lambda k: F.regexp_extract(name, pattern, k)
    return F.when(name.rlike(pattern), F.struct(part(1).alias("method"), part(2).alias("size"), part(3).cast("double").alias("fraction"), part(4).cast("int").alias("seed")))


def region_sentence(contents: Column) -> Column:
    """Regions in order as a sentence with single spaces."""
    return F.trim(F.regexp_replace(F.array_join(F.filter(contents, lambda c: F.trim(c) != ""), " "), r"\s+", " "))


#: Beginnings that take no space before them.
NO_SPACE_BEFORE = (",", ".", "!", "?", ":", ";", "'")


def joined_regions(contents: Column) -> Column:
    """A sentence from regions, and the byte at which each region starts."""

    def step(acc: Column, raw: Column) -> Column:
        c = F.regexp_replace(F.coalesce(raw, F.lit("")), r"^\s+", "")
        tight = (F.size(acc["edges"]) == 0) | (F.trim(c) == "") | F.substring(c, 1, 1).isin(*NO_SPACE_BEFORE)
        text = F.concat(acc["text"], F.when(tight, F.lit("")).otherwise(F.lit(" ")))
        return F.struct(F.concat(text, c).alias("text"), F.concat(acc["edges"], F.array(F.octet_length(text))).alias("edges"))

    return F.aggregate(contents, F.struct(F.lit("").alias("text"), F.array().cast("array<int>").alias("edges")), step)


def packed_sentences(sentences: Column, limit: int) -> Column:
    """Greedy chunks of whole sentences of at most `limit` words; a longer sentence is a chunk alone.

    The fold keeps the finished chunks, the open one and its length; no shuffle and no Python.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("now"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["n"] + x["n"] <= limit
        empty = F.size(acc["now"]) == 0
        one = F.array(x["s"])
        done = F.when(fits | empty, acc["done"]).otherwise(F.concat(acc["done"], F.array(F.array_join(acc["now"], " "))))
        return F.struct(done.alias("done"), F.when(fits | empty, F.concat(acc["now"], one)).otherwise(one).alias("now"), F.when(fits, acc["n"] + x["n"]).otherwise(x["n"]).alias("n"))

    # words are counted once a sentence, before the fold
    counted = F.transform(sentences, lambda s: F.struct(s.alias("s"), word_count(s).alias("n")))
    return F.aggregate(counted, start, step, lambda a: F.when(F.size(a["now"]) == 0, a["done"]).otherwise(F.concat(a["done"], F.array(F.array_join(a["now"], " ")))))


def sentences(text: Column) -> Column:
    """Sentences of a text without line feeds and double spaces: cut after . ! ? and white space."""
    flat = F.regexp_replace(F.regexp_replace(text, "\n", " "), " +", " ")
    return F.filter(F.transform(F.split(flat, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def temperature_grid() -> Column:
    """61 temperatures from 0 to 3, the first raised to 1e-6."""
    return F.transform(F.sequence(F.lit(0), F.lit(60)), lambda i: F.greatest(F.round(i * F.lit(0.05), 2), F.lit(1e-6)))


#: Suffix rules of regular inflection, and tags that leave a lemma as it is.
SIBILANTS = r"(s|x|z|ch|sh)$"


def inflect(lemma: Column, tag: Column) -> Column:
    """A surface form for a lemma and a tag by suffix rules; of several words the last is inflected (H7)."""
    head = F.regexp_extract(lemma, r"[^ ]*$", 0)
    before = F.substring(lemma, F.lit(1), F.length(lemma) - F.length(head))
    chopped = lambda n: F.substring(head, F.lit(1), F.length(head) - n)
    s_form = F.when(head.rlike(SIBILANTS), F.concat(head, F.lit("es"))).when(head.rlike("[^aeiou]y$"), F.concat(chopped(1), F.lit("ies"))).otherwise(F.concat(head, F.lit("s")))
    past = F.when(head.endswith("e"), F.concat(head, F.lit("d"))).otherwise(F.concat(head, F.lit("ed")))
    gerund = F.when(head.endswith("ie"), F.concat(chopped(2), F.lit("ying"))).when(head.endswith("e") & (F.length(head) > 1), F.concat(chopped(1), F.lit("ing"))).otherwise(F.concat(head, F.lit("ing")))
    form = F.when(tag.isin("NNS", "NNPS", "VBZ"), s_form).when(tag.isin("VBD", "VBN"), past).when(tag == "VBG", gerund).otherwise(head)
    return F.when(F.length(head) > 0, F.concat(before, form)).otherwise(lemma)


#: Beginnings that are spoken with a consonant though written with a vowel, and the other way round.
CONSONANT_STARTS, VOWEL_STARTS = r"(?i:eu|one\b|once\b|uni|use|usi|uti)", r"(?i:hour|honest|hono|heir)"


def fix_articles(text: Column) -> Column:
    """a or an by the first sound of the next word, by rule: written vowels but for a few beginnings (H5)."""
    an = rf"(?:(?!{CONSONANT_STARTS})[aeiouAEIOU8]|{VOWEL_STARTS}|[FHLMNRSX](?=[A-Z]))"
    opening = r"([\"“‘(\[{]*)"
    text = F.regexp_replace(text, rf"\b([Aa])n?(\s+){opening}(?={an})", "$1n$2$3")
    return F.regexp_replace(text, rf"\b([Aa])n?(\s+){opening}(?!{an})(?=[A-Za-z0-9])", "$1$2$3")


def batch_size(words: Column) -> Column:
    """How many texts of a length a parser takes at once."""
    out = F.lit(4)
    for most, size in ((2048, 8), (1024, 32), (512, 64), (256, 128), (128, 256)):
        out = F.when(words <= most, size).otherwise(out)
    return out
