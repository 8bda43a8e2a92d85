"""Personal data: base patterns, and more identifiers found by bootstrapped contextual extraction.

The base spans are matches of four fixed patterns. They are the seeds: tokens inside them are known entities.
Every token that looks like an identifier is an instance: a number of 5 to 19 digits, whose groups may be joined
by one or two separators or spaces, or a word with five digits or an at sign. The word to its left and the word to
its right make lexical patterns, each once with the token's exact shape and once with a coarse one, in which only
digits, letters and the at sign count and all layouts are alike. Patterns and instances form a bipartite graph on
which scores travel for a few rounds: a pattern belongs to the kind that most of its instances' confidence speaks
for and scores that share, less where it rests on few; an instance that isn't a seed takes the best score of its
supported patterns, where left patterns hear what right ones say and the reverse, so that no pattern confirms
itself. Confident instances support patterns as seeds do, so patterns without a seed can be learned in later
rounds. Patterns of high confidence then discover instances that the base patterns did not match; these become
spans of the pattern's kind. The graph holds distinct (entity, pattern) pairs, counted before each shuffle; an
entity is a token, or the last ten digits of a number, so that a number written in another way is the same one.

DataFrame functions only. Positions come from the texts between matches: a text is split at a pattern and the
lengths of pieces and matches are summed, in blocks, so that a text of a million numbers costs linear time. The
Java patterns match what the stated ones match, but are written so that a run of 100,000 digits or letters costs
linear time and no deep recursion.

Defined cases: a null text counts as empty; rows that repeat an id are searched each on its own; spans are in
code points with the end exclusive; ties in score fall to the kind listed first; empty tables give empty
results; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import let, stored

KINDS = ("email", "ip", "card", "phone")

# The base patterns, each followed by the form that Java runs in linear time.
#   email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#   ip     [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card   [0-9]([\x20-]?[0-9])+
#   phone  \+[0-9][\x20().0-9-]+[0-9]
JAVA = {
    # a match begins where a run of its characters begins, or where the last match ended (\G); its end is the
    # first place that the greedy form could not pass
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-][A-Za-z0-9.-]*?(?=\.(?![A-Za-z0-9-])|[^A-Za-z0-9.-]|\z)",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?=[\x20-]?[0-9])[0-9\x20-]*?[0-9](?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that a text must pass before its matches are sought.
HINT = {"email": r"@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}

#: Instances: digit groups with one or two separators between digits, or a word with a digit or an at sign in it.
NUMBER = r"[+(]{0,2}[0-9](?:[\x20()./-]{0,2}[0-9]){4,18}(?![\x20()./-]{0,2}[0-9])(?![A-Za-z@_%+])"
TOKEN = rf"(?<![A-Za-z0-9@._%+()/-])(?:{NUMBER}|[A-Za-z._%+()/-]*+[0-9@][A-Za-z0-9@._%+()/-]*+)"
CONTEXT = 48
ROUNDS = 4
#: Confidence that a pattern needs from distinct instances, least share of it that counts, and the scores that discover.
MIN_SUPPORT, MIN_HEARD, MIN_PATTERN = 5, 0.6, 0.9
#: Matches whose positions are summed in one piece.
BLOCK = 256


def _at(text: Column, pattern: str) -> Column:
    """All matches as an array of structs (start, end, found, before, after), by position."""
    empty = F.from_json(F.lit("[]"), "array<struct<start:int,end:int,found:string,before:string,after:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["before"])
        end = start + F.length(x["found"])
        near = F.substring(x["before"], -CONTEXT, CONTEXT)
        row = F.struct(start.alias("start"), end.alias("end"), x["found"].alias("found"), near.alias("before"), F.substring(x["after"], 1, CONTEXT).alias("after"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(row)).alias("out"))

    def placed(rows: Column) -> Column:
        # an array that grows by one copies itself each time, so only arrays of a block, and one of blocks, grow
        blocks = F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / BLOCK).cast("int"))
        block = lambda b: F.slice(rows, b * BLOCK + 1, F.lit(BLOCK))
        wide = F.transform(blocks, lambda b: F.aggregate(block(b), F.lit(0), lambda acc, x: acc + F.length(x["before"]) + F.length(x["found"])))
        begins = F.aggregate(wide, F.array(F.lit(0)), lambda acc, w: F.concat(acc, F.array(F.element_at(acc, -1) + w)))
        one = lambda b, at: F.aggregate(block(b), F.struct(F.element_at(at, b + 1).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
        return F.when(F.size(rows) > 0, let(begins, lambda at: F.flatten(F.transform(blocks, lambda b: one(b, at))))).otherwise(empty)

    def rows(found: Column, pieces: Column) -> Column:
        return F.arrays_zip(F.slice(pieces, 1, F.size(found)).alias("before"), F.slice(pieces, 2, F.size(found)).alias("after"), found.alias("found"))

    matches = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("pieces"))
    return let(let(matches, lambda m: rows(m["found"], m["pieces"])), placed)


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def step(acc: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 0, d * 2).otherwise(d)
        return acc + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _valid(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


NO_SPANS = "array<struct<start:int,end:int>>"


def base_spans(text: Column, kind: str) -> Column:
    """The valid matches of one kind as an array of (start, end)."""
    spans = F.transform(F.filter(_at(text, JAVA[kind]), lambda m: _valid(kind, m["found"])), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))
    return F.when(text.rlike(HINT[kind]), spans).otherwise(F.from_json(F.lit("[]"), NO_SPANS))


def _shape(token: Column) -> Column:
    """Digits as 9, letters as a, each run of letters once."""
    return F.regexp_replace(F.regexp_replace(token, "[0-9]", "9"), r"[A-Za-z]+", "a")


def _coarse(token: Column) -> Column:
    """What is left of a token without its layout: an at sign, or else whether it has letters."""
    return F.when(token.contains("@"), "@").when(token.rlike("[A-Za-z]"), "a9").otherwise("9")


def _entity(token: Column) -> Column:
    """What tokens of one entity share: the last ten digits of a number that has as many, else the token as it is."""
    digits = F.regexp_replace(token, "[^0-9]", "")
    return F.when(~token.rlike("[A-Za-z@]") & (F.length(digits) >= 10), F.substring(digits, -10, 10)).otherwise(token)


def _word_shape(word: Column) -> Column:
    """A context word: lower case, digits as 9."""
    return F.regexp_replace(F.lower(word), "[0-9]", "9")


NO_TOKENS = "array<struct<start:int,end:int,found:string,before:string,after:string>>"


def instances(text: Column) -> Column:
    """Tokens that look like identifiers: (start, end, found, before, after)."""
    found = F.filter(_at(text, TOKEN), lambda m: (F.length(F.regexp_replace(m["found"], "[^0-9]", "")) >= 5) | m["found"].contains("@"))
    return F.when(text.rlike(r"[0-9@]"), found).otherwise(F.from_json(F.lit("[]"), NO_TOKENS))


def searched(docs: DataFrame) -> DataFrame:
    """(row, doc_id, one array of spans per kind, tokens): one pass over the texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"))
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", *(base_spans(F.col("t"), k).alias(k) for k in KINDS), instances(F.col("t")).alias("tokens"))


def occurrences(found: DataFrame) -> DataFrame:
    """(row, start, end, token, seed, patterns): each instance, its entity, the kind (a number) that it is a seed of, its patterns."""
    tokens = found.select("row", *KINDS, F.explode("tokens").alias("m"))
    tail = F.length(F.regexp_extract("m.found", r"[.,)/_%+-]*$", 0))
    head = F.length(F.regexp_extract("m.found", r"^[._%/-]*", 0))
    start, end = F.col("m.start") + head, F.col("m.end") - tail
    inside = [F.when(F.exists(k, lambda s: (s["start"] < F.col("m.end")) & (s["end"] > F.col("m.start"))), F.lit(i)) for i, k in enumerate(KINDS)]
    # a word that touches the token is none: brackets and quotes are left out
    before = F.regexp_extract(F.col("m.before"), r"(\S+)\s*$", 1)
    after = F.regexp_extract(F.col("m.after"), r"^\S*\s*(\S+)", 1)
    rows = tokens.filter(F.length("m.found") > tail + head).select("row", start.alias("start"), end.alias("end"), _entity(F.col("m.found")).alias("token"), F.coalesce(*inside).alias("seed"), _shape(F.col("m.found")).alias("shape"), _coarse(F.col("m.found")).alias("coarse"), _word_shape(before).alias("left"), _word_shape(after).alias("right"))

    def context(side: str, word: str, shape: str) -> Column:
        return F.when(F.col(word) != "", F.concat_ws("\u0001", F.lit(side), word, shape))

    # contexts with the exact shape, and with a coarse one for layouts that no seed has; an empty word is no context
    contexts = [context("L", "left", "shape"), context("R", "right", "shape"), context("l", "left", "coarse"), context("r", "right", "coarse")]
    return rows.select("row", "start", "end", "token", "seed", F.array_compact(F.array(*contexts)).alias("patterns"))


def pattern_scores(rows: DataFrame) -> DataFrame:
    """(pattern, p, kind) of the patterns whose score after the last round discovers."""
    marks = rows.select("token", "seed", F.explode("patterns").alias("pattern"))
    # the graph: each (token, pattern) once
    graph = stored(marks.groupBy("token", "pattern").agg(F.min("seed").alias("seed")).select("token", "pattern"), "graph")
    own = stored(rows.groupBy("token").agg(F.min("seed").alias("seed")), "tokens")
    nothing = F.struct(F.lit(0.0).alias("p"), F.lit(0).alias("other"))
    score = own.select("token", "seed", nothing.alias("by_left"), nothing.alias("by_right"))
    on_left = F.lower(F.substring("pattern", 1, 1)) == "l"
    for k in range(ROUNDS):
        # what a pattern hears of a token comes from the token's other side
        heard = F.when(on_left, F.col("by_right")).otherwise(F.col("by_left"))
        edges = graph.join(score, "token").select("pattern", "seed", heard.alias("heard"))
        kind = F.coalesce("seed", -F.col("heard.other"))
        conf = F.when(F.col("seed").isNotNull(), 1.0).when(F.col("heard.p") >= MIN_HEARD, F.col("heard.p")).otherwise(0.0)
        edges = edges.select("pattern", kind.alias("kind"), conf.alias("conf"))
        sums = [F.sum(F.when(F.col("kind") == i, F.col("conf")).otherwise(0.0)) for i in range(len(KINDS))]
        patterns = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("sums"))
        top = F.array_max("sums")
        few = 1 - F.pow(F.lit(2.0), -top)  # little confidence weighs less
        patterns = patterns.select("pattern", (top / F.col("n") * few).alias("p"), top.alias("support"), (F.array_position("sums", top) - 1).cast("int").alias("kind"))
        patterns = stored(patterns.filter(F.col("support") >= MIN_SUPPORT - 1e-9).select("pattern", "p", "kind"), "patterns")
        if k == ROUNDS - 1:
            return patterns.filter(F.col("p") >= MIN_PATTERN)
        # of equal scores the kind listed first
        best = F.struct("p", (-F.col("kind")).alias("other"))
        told = graph.join(patterns, "pattern").groupBy("token").agg(F.max(F.when(on_left, best)).alias("by_left"), F.max(F.when(~on_left, best)).alias("by_right"))
        score = stored(own.join(told, "token", "left").select("token", "seed", *(F.coalesce(c, nothing).alias(c) for c in ("by_left", "by_right"))), "scores")


def discovered(found: DataFrame) -> DataFrame:
    """(row, start, end, kind) of identifiers that patterns of high confidence add to the base spans."""
    rows = stored(occurrences(found), "instances")
    sure = pattern_scores(rows)
    new = rows.filter(F.col("seed").isNull()).select("row", "start", "end", F.explode("patterns").alias("pattern"))
    best = F.max(F.struct("p", (-F.col("kind")).alias("other")))["other"]
    return new.join(sure, "pattern").groupBy("row", "start", "end").agg((-best).alias("kind"))


def _joined(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_discovered."""
    found = stored(searched(docs), "searched")
    extra = discovered(found).groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("extra"))
    extra = stored(extra, "extra")
    rows = found.drop("tokens").join(extra, "row", "left")
    more = F.coalesce(F.col("extra"), F.from_json(F.lit("[]"), "array<struct<kind:int,start:int,end:int>>"))
    base = F.concat(*(_joined(k, F.col(k)) for k in KINDS))

    def both(kind: str) -> Column:
        added = F.transform(F.filter(more, lambda s: s["kind"] == KINDS.index(kind)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
        return F.array_sort(F.concat(F.col(kind), added))

    every = F.concat(*(_joined(k, both(k)) for k in KINDS))
    return rows.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(every, ",").alias("spans"),
        F.size(more).cast("long").alias("n_discovered"),
    )
