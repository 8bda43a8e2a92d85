"""Block entropies of word sequences: n-gram counts inside documents, estimators, budgets and curves."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions.text import WORD_PATTERN, tokenize
from glossa.operators.slicing import running_total
from glossa.session import settled

#: The smallest budget of the ladder, and the words from which halves are compared.
LEAST_BUDGET, LEAST_HALF = 250_000, 1000


def ngrams(docs: DataFrame, orders: list[int], by: list[str]) -> DataFrame:
    """(by, n, a, b): all n-grams inside documents; tokens must be an array column `tokens`.

    A gram is known by 96 bits of two hashes of its words (a: 64, b: 32): short keys of fixed width are shuffled and
    counted, not joined texts. Among 10^12 distinct grams two share a key with a chance of about 10^-5.
    """
    n_max = max(orders)
    # a row per position with the words that follow, by zipping shifted arrays: all of it is generated code
    shifted = [F.slice("tokens", k + 1, F.size("tokens")).alias(f"w{k}") for k in range(n_max)]
    rows = docs.filter(F.size("tokens") > 0).select(*by, F.explode(F.arrays_zip(*shifted)).alias("z"))
    words = [F.col(f"z.w{k}") for k in range(n_max)]
    each = [F.struct(F.lit(n).alias("n"), F.when(words[n - 1].isNotNull(), F.xxhash64(*words[:n])).alias("a"), F.hash(*words[:n]).alias("b")) for n in orders]
    return rows.select(*by, F.explode(F.array(*each)).alias("g")).filter("g.a is not null").select(*by, "g.n", "g.a", "g.b")


def estimates(counts: DataFrame, by: list[str], count: str = "c") -> DataFrame:
    """Entropies in bits of count distributions: plug-in, Miller-Madow and Chao-Shen, with their diagnostics.

    Sums of c log c are one aggregation; the Chao-Shen sum needs the coverage first, so it is a second one over
    the distinct counts, which are few. Null is a value of a key like any other.
    """
    spectrum = counts.groupBy(*by, F.col(count).alias("c")).agg(F.count(F.lit(1)).alias("m"))
    whole = Window.partitionBy(*by)
    singles = F.sum(F.when(F.col("c") == 1, F.col("m")).otherwise(0)).over(whole)
    joined = spectrum.select("*", F.sum(F.col("c") * F.col("m")).over(whole).alias("total"), F.sum("m").over(whole).alias("types"), singles.alias("singletons"))
    total, f1 = F.col("total").cast("double"), F.col("singletons")
    coverage = 1 - F.when(f1 < F.col("total"), f1).otherwise(F.col("total") - 1) / total
    joined = joined.withColumn("p", F.col("c") / total).withColumn("coverage", coverage)
    scaled = F.col("coverage") * F.col("p")
    plug = F.sum(-F.col("m") * F.col("p") * F.log2("p"))
    chao = F.sum(F.when(F.col("coverage") > 0, -F.col("m") * scaled * F.log2(scaled) / (1 - F.pow(1 - scaled, total))))
    out = joined.groupBy(*by, "total", "types", "singletons", "coverage").agg(plug.alias("plugin"), chao.alias("cs"))
    return out.select(
        *by,
        "total",
        "types",
        "singletons",
        "plugin",
        (F.col("plugin") + (F.col("types") - 1) / (2 * F.col("total") * math.log(2))).alias("miller_madow"),
        F.when(F.col("coverage") > 0, F.col("cs")).otherwise(F.lit(float("nan"))).alias("chao_shen"),
        "coverage",
        (F.col("types") / F.col("total")).alias("saturation"),
        F.log2("types").alias("max_entropy"),
    )


def block_entropies(docs: DataFrame, max_n: int, by: list[str]) -> DataFrame:
    """Entropy estimates of the n-grams of each order."""
    counts = ngrams(docs, list(range(1, max_n + 1)), by).groupBy(*by, "n", "a", "b").agg(F.count(F.lit(1)).alias("c"))
    return estimates(counts, [*by, "n"])


def curve(blocks: DataFrame, by: list[str], columns: tuple[str, ...] = ("plugin",)) -> DataFrame:
    """h(n) = H(n) - H(n - 1), with H(0) = 0."""
    order = Window.partitionBy(*by).orderBy("n")
    return blocks.select("*", *((F.col(c) - F.coalesce(F.lag(c).over(order), F.lit(0.0))).alias(f"h_{c}") for c in columns))


def token_stream(docs: DataFrame, by: list[str], *order: str) -> DataFrame:
    """Documents with tokens and `ahead`, the number of tokens before them in their stream.

    Rows are carried through the running total, so that rows that repeat a key stay as many as they are.
    """
    rows = docs.withColumn("n_tokens", n_tokens(F.col("text"))).filter("n_tokens > 0")
    return running_total(rows, "n_tokens", *order, by=tuple(by)).withColumn("tokens", tokenize(F.col("text")))


def clipped(stream: DataFrame, budget: Column | int) -> DataFrame:
    """The first `budget` tokens of each stream: the document at the cut keeps its first words."""
    left = F.lit(budget) - F.col("ahead") if isinstance(budget, int) else budget - F.col("ahead")
    return stream.filter(left > 0).withColumn("tokens", F.slice("tokens", 1, F.greatest(F.lit(0), F.least(left, F.col("n_tokens"))).cast("int")))


def n_tokens(text: Column) -> Column:
    """How many tokens tokenize() finds, without the array of them."""
    return F.coalesce(F.regexp_count(F.lower(text), F.lit(WORD_PATTERN)), F.lit(0))


def stream_lengths(docs: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """(by, place, words, copies): what of each document its place in a stream takes; documents alike in all of it are one row.

    place holds the order, the length and a hash of the text, so that only equal documents share it.
    """
    place = F.struct(*order, n_tokens(F.col("text")).alias("n_tokens"), F.xxhash64("text").alias("h"))
    rows = docs.select(*by, place.alias("place")).filter("place.n_tokens > 0")
    return rows.groupBy(*by, "place").agg(F.count(F.lit(1)).alias("copies")).withColumn("words", F.col("copies") * F.col("place.n_tokens"))


def budgeted(docs: DataFrame, lengths: DataFrame, budgets: DataFrame, by: list[str], order: list[str], part: str = "part") -> DataFrame:
    """(by, part, tokens): the first words of each stream, by as many budgets as there are parts.

    lengths: stream_lengths(); budgets: by, part, budget, a row for each stream and part. Lengths only are sorted and
    summed; they name the place at which a budget ends. A document before it is taken whole, where it is read; no text
    is shuffled. The document at the cut keeps its first words.
    """
    ahead = running_total(lengths, "words", "place", by=tuple(by))
    same = lambda a, b: reduce(and_, (F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by), F.lit(True))
    met = ahead.alias("r").join(budgets.alias("q"), same("r", "q")).select("r.*", f"q.{part}", "q.budget")
    cut = met.filter((F.col("ahead") < F.col("budget")) & (F.col("budget") <= F.col("ahead") + F.col("words")))
    edges = settled(cut.select(*by, part, F.col("place").alias("edge"), "copies", (F.col("budget") - F.col("ahead")).alias("left")))
    plan = budgets.alias("q").join(edges.alias("e"), same("q", "e") & (F.col(f"q.{part}") == F.col(f"e.{part}")), "left").select("q.*", "e.edge", "e.copies", "e.left")
    place = F.struct(*order, n_tokens(F.col("text")).alias("n_tokens"), F.xxhash64("text").alias("h"))
    rows = docs.select(*by, "text", place.alias("place")).filter("place.n_tokens > 0").alias("r").join(plan.alias("p"), same("r", "p")).select("r.*", *(f"p.{c}" for c in (part, "edge", "copies", "left")))
    keys = [*by, part]
    tokens = tokenize(F.col("text")).alias("tokens")
    whole = rows.filter(F.col("edge").isNull() | (F.col("place") < F.col("edge"))).select(*keys, tokens)
    # equal documents at a cut are one row, then as many as fit
    at = rows.filter(F.col("place") == F.col("edge")).groupBy(*keys).agg(*(F.any_value(c).alias(c) for c in ("text", "copies", "left")))
    at = at.select(*keys, tokens, "left", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("k"))
    rest = F.col("left") - F.col("k") * F.size("tokens")
    return whole.unionByName(at.filter(rest > 0).select(*keys, F.slice("tokens", 1, F.least(rest, F.size("tokens")).cast("int")).alias("tokens")))


def budgets(total: int, least: int = LEAST_BUDGET) -> list[int]:
    """The ladder: the whole, then halves while they are large enough; at least the whole."""
    out, b = [total], total // 2
    while b >= least:
        out.append(b)
        b //= 2
    return out


def halves(stream: DataFrame, total: int) -> DataFrame:
    """Documents dealt to the two halves of a stream by where they start (E10). Adds `half`."""
    return stream.withColumn("half", F.when(F.col("ahead") < total // 2, 0).otherwise(1))
