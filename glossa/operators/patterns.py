"""Patterns over tokens and over dependency arcs, compiled to plans.

A token pattern is a list of conditions on neighbouring tokens. Each sentence becomes a string with one character per
token, whose code says which conditions the token meets; the pattern becomes a regular expression over these codes, so
that one pass of the string engine finds all matches. A dependency pattern becomes joins of the tokens with themselves
along their heads, one for each edge.
"""

from __future__ import annotations

import json
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Codes begin here: letters of one plane, none of which means anything in a pattern.
FIRST_CODE = 0x4E00
#: Attributes of a condition and the columns that they ask.
ATTRIBUTES = {"LOWER": lambda: F.lower("text"), "TEXT": lambda: F.col("text"), "LEMMA": lambda: F.col("lemma"), "POS": lambda: F.col("pos"), "TAG": lambda: F.col("tag"), "DEP": lambda: F.col("dep")}
REPEATS = {"1": "", "?": "?", "*": "*", "+": "+"}


def condition(spec: dict) -> Column:
    """Whether a token meets all attributes of a condition; a value is a string or {"IN": [...]}, or {"NOT_IN": [...]}."""
    parts = []
    for name, value in spec.items():
        if name == "OP":
            continue
        if name not in ATTRIBUTES:
            raise ValueError(f"unknown attribute {name}; known are {', '.join(ATTRIBUTES)}")
        column = ATTRIBUTES[name]()
        if isinstance(value, dict):
            parts.append(~column.isin(*value["NOT_IN"]) if "NOT_IN" in value else column.isin(*value["IN"]))
        else:
            parts.append(column == value)
    return F.coalesce(reduce(and_, parts, F.lit(True)), F.lit(False))


def token_matches(tokens: DataFrame, patterns: dict[str, list[dict]], key: list[str]) -> DataFrame:
    """(key, start, end, pattern): at each place of a sentence the longest match of each pattern that begins there.

    OP of a condition is 1 (the default), ?, * or +. At most 12 different conditions.
    """
    specs = list(dict.fromkeys(json.dumps({k: v for k, v in c.items() if k != "OP"}, sort_keys=True) for p in patterns.values() for c in p))
    if len(specs) > 12:
        raise ValueError("more than 12 different conditions")
    mask = reduce(lambda a, b: a + b, (F.when(condition(json.loads(s)), 1 << k).otherwise(0) for k, s in enumerate(specs)), F.lit(0))
    codes = [chr(FIRST_CODE + m) for m in range(1 << len(specs))]
    letters = F.substring(F.lit("".join(codes)), mask + 1, F.lit(1))
    sentences = tokens.select(*key, "sent", "i", letters.alias("c")).groupBy(*key, "sent").agg(F.array_sort(F.collect_list(F.struct("i", "c"))).alias("w"))
    rows = sentences.select(*key, F.array_join("w.c", "").alias("s"), "w.i")
    found = []
    for name, pattern in patterns.items():
        expression = "^"
        for c in pattern:
            k = specs.index(json.dumps({a: v for a, v in c.items() if a != "OP"}, sort_keys=True))
            expression += "[" + "".join(x for m, x in enumerate(codes) if m >> k & 1) + "]" + REPEATS[c.get("OP", "1")]
        found.append((name, expression))
    places = rows.select(*key, "s", "i", F.explode(F.sequence(F.lit(1), F.length("s"))).alias("at"))
    tried = places.select(*key, "i", "at", F.substring("s", F.col("at"), F.length("s")).alias("rest"))
    out = None
    for name, expression in found:
        n = F.length(F.regexp_extract("rest", expression, 0))
        hit = tried.select(*key, F.get("i", F.col("at") - 1).alias("start"), n.alias("n"), "i", "at").filter("n > 0")
        hit = hit.select(*key, "start", (F.get("i", F.col("at") + F.col("n") - 2) + 1).alias("end"), F.lit(name).alias("pattern"))
        out = hit if out is None else out.unionByName(hit)
    return out


def dependency_matches(tokens: DataFrame, anchor: dict, edges: list[tuple[str, str, str, dict]], key: list[str]) -> DataFrame:
    """(key, anchor, one column per edge): tokens that match a pattern of arcs.

    edges: (left, name, relation, condition): a child of the node `left` (or "anchor") by a relation. An edge whose
    condition has OP ? is optional: with the child where there is one, and null where there is none.
    """
    out = tokens.filter(condition(anchor)).select(*key, F.col("i").alias("anchor"))
    for left, name, relation, spec in edges:
        child = tokens.filter((F.col("dep") == relation) & (F.col("head") != F.col("i")) & condition(spec)).select(*key, F.col("head").alias(left), F.col("i").alias(name))
        out = out.join(child, [*key, left], "left" if spec.get("OP") == "?" else "inner")
    return out.select(*key, "anchor", *(name for _, name, _, _ in edges))
