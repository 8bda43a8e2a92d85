"""Sources: strict and lenient readers of JSON lines, Parquet, text, CoNLL-U, suites, word lists and logs.

All are lazy but for a look at the file's columns. Types of JSON values are tested on the raw value, as a
declared string column would accept numbers too.
"""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossa.functions.text import strip

FORMATS = ("jsonl", "parquet", "text")


def parquet_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Bytes a core below which a table is dealt anew: its files may have fewer pieces than there are cores.
SMALL = 16 << 20


def size_of(df: DataFrame) -> int:
    """The bytes of a table as Spark estimates them, from the sizes of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame, *by: str, piece: int | None = None) -> DataFrame:
    """df over all cores if it is small: one file, or one row group, is one task however many cores wait.

    Larger tables come in pieces enough and are left as they are: no row is moved. by: columns to deal rows by, in any
    case; piece: the bytes of a table that a task gets then, about.
    """
    cores, size = df.sparkSession.sparkContext.defaultParallelism, size_of(df)
    if piece:
        return df.repartition(max(cores, -(-size // piece)), *by)
    if size < SMALL * cores:
        return df.repartition(cores, *by)
    return df.repartition(*by) if by else df


def detect_format(path: str) -> str:
    """The format of a path by its suffix, compression left aside."""
    plain = path.lower().removesuffix(".gz")
    if plain.endswith(".parquet"):
        return "parquet"
    return "jsonl" if plain.endswith((".jsonl", ".json", ".ndjson")) else "text"


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value, file, at): lines with the place of each; a file's order is that of its bytes."""
    rows = spark.read.option("recursiveFileLookup", "true").text(path)
    return rows.select("value", F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m")).alias("at"))


def numbered_lines(spark: SparkSession, path: str | list[str], name: str = "line_no") -> DataFrame:
    """(file, value, line_no): lines with their number in the file, from 0; a file is split like any other."""
    from glossa.operators.slicing import running_total

    rows = _lines(spark, path).select("file", "value", F.col("at.b").alias("_b"), F.col("at.m").alias("_m"), F.lit(1).alias("_one"))
    return running_total(rows, "_one", "_b", "_m", by=("file",), name=name).select("file", "value", F.col(name).cast("int").alias(name))


def _typed(rows: DataFrame, field: str) -> DataFrame:
    """Adds v (the parsed line) and kind (the type of the field in it)."""
    parsed = rows.withColumn("v", F.try_parse_json("value"))
    return parsed.withColumn("kind", F.schema_of_variant(F.variant_get("v", f"$.{field}", "variant")))


def read_jsonl_strict(spark: SparkSession, path: str | list[str], field: str = "text") -> DataFrame:
    """Rows (text, value) of JSON lines; a line that is no object or whose field is no string fails the query (A1)."""
    rows = _typed(_lines(spark, path).filter(F.trim("value") != ""), field)
    checked = F.when(F.col("kind") == "STRING", F.variant_get("v", f"$.{field}", "string")).otherwise(F.raise_error(F.concat(F.lit(f"no string field {field}: "), F.substring("value", 1, 80))))
    return rows.select(checked.alias(field), "value", "at")


def read_jsonl_lenient(spark: SparkSession, path: str | list[str], field: str = "text") -> DataFrame:
    """Stripped texts of JSON lines; what doesn't parse, isn't a string or is blank is left out (A4)."""
    rows = _typed(_lines(spark, path), field).filter(F.col("kind") == "STRING")
    return rows.select(strip(F.variant_get("v", f"$.{field}", "string")).alias(field), "at").filter(F.col(field) != "")


def read_jsonl_loose(spark: SparkSession, path: str | list[str], field: str = "text") -> DataFrame:
    """Documents of JSON lines: objects give the field, a bare string itself, a line that doesn't parse its text."""
    rows = _typed(_lines(spark, path).filter(F.trim("value") != ""), field)
    whole = F.schema_of_variant("v")
    text = F.when(F.col("v").isNull(), F.col("value")).when(whole == "STRING", F.variant_get("v", "$", "string")).when(F.col("kind") == "STRING", F.variant_get("v", f"$.{field}", "string"))
    return rows.select(text.alias(field), "at").filter(F.length(field) > 0)


def read_parquet_strict(spark: SparkSession, path: str | list[str], field: str = "text") -> DataFrame:
    """All columns; a missing text column raises and lists those there are (A2)."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    if field not in df.columns:
        raise ValueError(f"no column {field}; there are {', '.join(df.columns)}")
    return df


def read_parquet_lenient(spark: SparkSession, path: str | list[str], field: str = "text") -> DataFrame:
    """The stripped texts that aren't blank; only their column is read."""
    df = read_parquet_strict(spark, path, field)
    return df.select(strip(F.col(field).cast("string")).alias(field)).filter(F.col(field) != "")


def read_text_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One document per line that isn't empty (A10)."""
    return _lines(spark, path).filter(F.col("value") != "").select(F.col("value").alias("text"), "at")


def read_documents(spark: SparkSession, path: str, fmt: str = "auto", field: str = "text") -> DataFrame:
    """The reader of a path's format."""
    fmt = detect_format(path) if fmt == "auto" else fmt
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}; known are {', '.join(FORMATS)}")
    if fmt == "parquet":
        return read_parquet_lenient(spark, path, field)
    return read_jsonl_loose(spark, path, field) if fmt == "jsonl" else read_text_lines(spark, path)


def read_many(spark: SparkSession, paths: list[str], fmt: str = "auto", field: str = "text") -> DataFrame:
    """Documents of several files with the number of their file, for round robin."""
    parts = [read_documents(spark, p, fmt, field).select(field, F.lit(k).alias("file_no")) for k, p in enumerate(paths)]
    return reduce(DataFrame.unionByName, parts)


def count_records(spark: SparkSession, path: str) -> int:
    """Number of rows; Parquet answers from its footers."""
    return spark.read.parquet(path).count() if detect_format(path) == "parquet" else spark.read.text(path).filter(F.trim("value") != "").count()


def empty_like(df: DataFrame) -> DataFrame:
    """No rows, same columns."""
    return df.limit(0)


def conllu_words(lines: DataFrame) -> DataFrame:
    """(sent, i, form, lemma, upos, xpos, head, deprel) from lines (file, line_no, value) of CoNLL-U.

    Comments, multiword ranges and empty nodes are skipped; a blank line ends a sentence.
    """
    order = Window.partitionBy("file").orderBy("line_no")
    rows = lines.withColumn("sent", F.sum(F.when(F.trim("value") == "", 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("c", F.split("value", "\t")).filter(F.size("c") >= 8).filter(F.get("c", F.lit(0)).rlike("^[0-9]+$"))
    at = lambda k: F.get("c", F.lit(k))
    return rows.select("file", F.coalesce("sent", F.lit(0)).cast("int").alias("sent"), at(0).cast("int").alias("i"), at(1).alias("form"), at(2).alias("lemma"), at(3).alias("upos"), at(4).alias("xpos"), at(6).cast("int").alias("head"), at(7).alias("deprel"))


def read_conllu(spark: SparkSession, path: str) -> DataFrame:
    """Words of CoNLL-U files."""
    return conllu_words(numbered_lines(spark, path))


PAIR_SCHEMA = "sentence_good string, sentence_bad string, field string, linguistics_term string, UID string"


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Minimal pairs of a folder of JSON lines; the index is the physical line number in the file."""
    rows = numbered_lines(spark, path, "idx").filter(F.trim("value") != "")
    name = F.regexp_extract("file", r"([^/]*?)(\.jsonl?)?$", 1)
    rows = rows.select(name.alias("file"), "idx", F.from_json("value", PAIR_SCHEMA).alias("p"))
    field = F.when(F.col("p.field") == "syntax_semantics", "syntax/semantics").otherwise(F.coalesce("p.field", F.lit("supplemental")))
    return rows.select("file", "idx", F.col("p.sentence_good").alias("good"), F.col("p.sentence_bad").alias("bad"), field.alias("field"), F.coalesce("p.linguistics_term", F.lit("supplemental")).alias("linguistics_term"), F.coalesce("p.UID", "file").alias("uid"))


CONTEXT_SCHEMA = "Domain string, ConceptA string, ConceptB string, ContextType string, ContextDiff string, TargetDiff string, Context1 string, Context2 string, Target1 string, Target2 string"


def read_context_items(spark: SparkSession, path: str) -> DataFrame:
    """Context and target items; the index counts lines that aren't blank, the id is domain and index."""
    from glossa.operators.slicing import running_total

    rows = numbered_lines(spark, path).filter(F.trim("value") != "").withColumn("_one", F.lit(1))
    rows = running_total(rows, "_one", "line_no", by=("file",), name="idx").withColumn("idx", F.col("idx").cast("int"))
    rows = rows.select(F.regexp_extract("file", r"([^/]*)$", 1).alias("file"), "idx", F.from_json("value", CONTEXT_SCHEMA).alias("p")).select("file", "idx", "p.*")
    return rows.withColumn("id", F.concat_ws("_", "Domain", "idx"))


SUITE_SCHEMA = (
    "meta struct<name:string,metric:string>, predictions array<struct<type:string,formula:string>>, "
    "items array<struct<item_number:int,conditions:array<struct<condition_name:string,regions:array<struct<region_number:int,content:string>>>>>>"
)


def read_suites(spark: SparkSession, path: str) -> DataFrame:
    """One nested row per suite."""
    return spark.read.option("multiLine", "true").schema(SUITE_SCHEMA).json(path)


def suite_regions(suites: DataFrame) -> DataFrame:
    """(suite, item, condition, region, content) from nested suites."""
    rows = suites.select(F.col("meta.name").alias("suite"), F.explode("items").alias("i")).select("suite", F.col("i.item_number").alias("item"), F.explode("i.conditions").alias("c"))
    return rows.select("suite", "item", F.col("c.condition_name").alias("condition"), F.explode("c.regions").alias("r")).select("suite", "item", "condition", F.col("r.region_number").alias("region"), F.col("r.content").alias("content"))


#: The labels of inference pairs.
INFERENCE_LABELS = ("entailment", "neutral", "contradiction")


def read_inference_pairs(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """Labelled pairs with a known gold label; the limit applies after the filter."""
    schema = "pairID string, gold_label string, sentence1 string, sentence2 string"
    df = spark.read.schema(schema).json(path).filter(F.col("gold_label").isin(*INFERENCE_LABELS))
    return df.orderBy("pairID").limit(limit) if limit else df


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One id per line."""
    return spark.read.text(path).select(F.trim("value").alias("id")).filter(F.col("id") != "")


def read_raw_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(raw line, parsed row), so that kept rows can be written as they were."""
    return spark.read.text(path).filter(F.trim("value") != "").select(F.col("value").alias("raw"), F.from_json("value", schema).alias("row"))


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """Stripped lines that aren't empty."""
    return spark.read.text(path).select(strip(F.col("value")).alias("word")).filter(F.col("word") != "")


def read_first_column(spark: SparkSession, path: str) -> DataFrame:
    """The first CSV column, the delimiter sniffed from the first five lines; a header is a row like others."""
    head = [r.value for r in spark.read.text(path).filter(F.trim("value") != "").limit(5).collect()]
    try:
        sep = csv.Sniffer().sniff("\n".join(head), delimiters=",;\t").delimiter
    except csv.Error:
        sep = ","
    return spark.read.option("sep", sep).csv(path).select(F.trim("_c0").alias("word")).filter(F.col("word") != "")


def clean_word_list(lines: DataFrame, single: bool = True, drop_capitalised: bool = True) -> DataFrame:
    """Lemmas of a list's lines (value): marks and comments cut, split at commas and spaces, lower case."""
    text = F.regexp_replace(F.regexp_replace("value", "^﻿", ""), "#.*$", "")
    words = lines.select(F.explode(F.split(text, r"[,\s]+")).alias("word")).filter("word <> ''")
    if drop_capitalised:
        words = words.filter(~F.col("word").rlike(r"^\p{Lu}"))
    if single:
        words = words.filter(F.col("word").rlike(r"^\p{L}+(?:['-]\p{L}+)*$"))
    return words.select(F.lower("word").alias("word")).distinct()


def merged_lexicon(entries: DataFrame) -> DataFrame:
    """One row per lemma with the unions of its tags and licenses."""
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return entries.groupBy("lemma").agg(union("tags"), union("licenses"))


def tag_index(lexicon: DataFrame) -> DataFrame:
    """(tag, lemmas): the inverted index of a lexicon."""
    return lexicon.select(F.explode("tags").alias("tag"), "lemma").groupBy("tag").agg(F.array_sort(F.collect_set("lemma")).alias("lemmas"))


def single_gender(entries: DataFrame) -> DataFrame:
    """Words with exactly one gender among m, f and n."""
    known = entries.filter(F.col("gender").isin("m", "f", "n"))
    return known.groupBy(F.lower("word").alias("word")).agg(F.collect_set("gender").alias("g")).filter(F.size("g") == 1).select("word", F.get("g", F.lit(0)).alias("gender"))


def read_counts(spark: SparkSession, path: str, least: int = 1) -> DataFrame:
    """token and count of a tab-separated file; malformed rows are left out."""
    rows = spark.read.option("sep", "\t").option("quote", "").csv(path, schema="token string, n string")
    return rows.select("token", F.expr("try_cast(n as bigint)").alias("n")).filter(F.col("n") >= least)


def last_match(text, pattern: str):
    """The last match of a pattern's first group in a text."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def only_match(text, pattern: str):
    """The match of a pattern, which must occur exactly once."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.when(F.size(found) == 1, F.element_at(found, 1)).otherwise(F.raise_error(F.concat(F.lit("matches: "), F.size(found).cast("string"))))


def metric_blocks(lines: DataFrame, pattern: str, by: list[str]) -> DataFrame:
    """Maximal runs of consecutive metric lines, numbered from 0 within `by`; lines need a column line_no."""
    order = Window.partitionBy(*by).orderBy("line_no")
    hits = lines.withColumn("hit", F.regexp_extract("value", pattern, 1)).withColumn("rn", F.row_number().over(order)).filter("hit <> ''")
    runs = hits.withColumn("island", F.col("rn") - F.row_number().over(order))
    return runs.withColumn("block", F.dense_rank().over(Window.partitionBy(*by).orderBy("island")) - 1).drop("rn", "island")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, md5) of files, to check what was fetched."""
    return spark.read.format("binaryFile").load(path).select("path", F.md5("content").alias("md5"))


#: Words that open an embedded question, and descriptions of clauses.
QUESTION_WORDS = ("whether", "if", "who", "whom", "whose", "what", "which", "where", "when", "why", "how")
QUESTION_TO, QUESTION = ("WH-TO-INF", "WHAT-TO-INF", "HOW-TO-INF"), ("WH-S", "WHAT-S", "HOW-S")


def read_verb_classes(spark: SparkSession, path: str) -> DataFrame:
    """(verb, key, preps, flags): the frames of verb class files, one row per member and frame.

    A class is one record; its frames are read in the order of their elements. Objects are noun phrases after the verb
    that no preposition opens. A frame with a clause counts as intransitive.
    """
    classes = spark.read.option("lineSep", "</VNCLASS>").text(path)
    found = lambda x, p, k=1: F.regexp_extract_all(x, F.lit(p), F.lit(k))
    rows = classes.select(found(F.col("value"), r'<MEMBER\b[^>]*\bname="([^"]*)"').alias("members"), F.explode(found(F.col("value"), r"(?s)<FRAME\b(.*?)</FRAME>")).alias("f"))
    rows = rows.withColumn("syntax", F.regexp_extract("f", r"(?s)<SYNTAX>(.*?)</SYNTAX>", 1))
    start = F.struct(F.lit(False).alias("after"), F.lit(False).alias("open"), F.lit(0).alias("n"))

    def step(acc, tag):
        core = (tag == "NP") & acc["after"] & ~acc["open"]
        return F.struct((acc["after"] | (tag == "VERB")).alias("after"), F.when(tag == "PREP", True).when(tag == "NP", False).otherwise(acc["open"]).alias("open"), (acc["n"] + core.cast("int")).alias("n"))

    objects = F.aggregate(found(F.col("syntax"), r"<(NP|VERB|PREP)\b"), start, step, lambda a: a["n"])
    words = F.transform(found(F.col("syntax"), r'<LEX\b[^>]*\bvalue="([^"]*)"'), lambda w: F.lower(F.trim(w)))
    said = F.filter(F.array(F.when(F.arrays_overlap(words, F.array(*map(F.lit, QUESTION_WORDS))), "q"), F.when(F.array_contains(words, "that"), "that"), F.when(F.array_contains(words, "to"), "to")), lambda x: x.isNotNull())
    about = F.replace(F.upper(F.regexp_extract("f", r'<DESCRIPTION\b[^>]*\bprimary="([^"]*)"', 1)), F.lit("_"), F.lit("-"))
    holds = lambda names: F.exists(F.array(*map(F.lit, names)), lambda t: F.contains(about, t))
    some = lambda *names: F.array(*map(F.lit, names)).cast("array<string>")
    described = F.when(holds(QUESTION_TO), some("q", "to")).when(F.contains(about, F.lit("TO-INF")), some("to")).when(holds(QUESTION), some("q")).when(about == "S", some("that")).otherwise(some())
    rows = rows.withColumn("flags", F.when(F.size(said) > 0, said).otherwise(described)).withColumn("objects", objects)
    values = F.flatten(F.transform(found(F.col("syntax"), r'<PREP\b[^>]*\bvalue="([^"]*)"'), lambda v: F.split(F.lower(F.trim(v)), r"[/\s|]+")))
    preps = F.array_sort(F.array_distinct(F.filter(values, lambda v: ~v.isin("", "none"))))
    key = F.when(F.size("flags") > 0, "intrans").when(F.col("objects") >= 2, "ditrans").when(F.col("objects") == 1, "trans").otherwise("intrans")
    return rows.select(F.explode("members").alias("verb"), key.alias("key"), preps.alias("preps"), F.array_sort("flags").alias("flags")).distinct()
