"""Queries through files: tables written by a sink, read again by a reader, and compared with the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.functions import vectors as V
from glossa.operators import dictionary, language_model, patterns, pools, rewriting, trees, vocabulary
from glossa.plans.registry import query
from glossa.plans.rewriting import _INF, _KIDS, _U, BENCH, CONV, KEY, _in, bench_tokens, conv_tokens
from glossa.session import shared_folder
from glossa.sources import readers, sinks
from glossa.sources.readers import parquet_table


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files/{uuid.uuid4().hex}"


@query(r"""WITH d AS (SELECT text FROM documents WHERE text IS NOT NULL), l AS (SELECT unnest(string_split(text, chr(10))) AS x FROM d)
SELECT 'parquet' AS format, count(*) AS n, CAST(sum(length(trim(text, ' ' || chr(9) || chr(10) || chr(13)))) AS BIGINT) AS chars FROM d WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''
UNION ALL SELECT 'jsonl', count(*), CAST(sum(length(text)) AS BIGINT) FROM d WHERE text <> '' UNION ALL SELECT 'txt', count(*), CAST(sum(length(x)) AS BIGINT) FROM l WHERE x <> ''
UNION ALL SELECT 'records', count(*), 0 FROM d""")
def file_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through files of each format, by the reader that the suffix names."""
    at = _folder(spark)
    docs = parquet_table(spark, sf_dir, "documents").filter("text is not null").select("text")
    sinks.write_table(docs, f"{at}/d.parquet")
    sinks.write_table(docs, f"{at}/d.jsonl", "json")
    docs.write.text(f"{at}/d.txt")
    out = readers.empty_like(docs).select(F.lit("records").alias("format"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("chars"))
    for fmt in ("parquet", "jsonl", "txt"):
        rows = readers.read_documents(spark, f"{at}/d.{fmt}")
        out = out.unionByName(rows.agg(F.lit(fmt).alias("format"), F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).select("format", "n", "chars"))
    counted = readers.count_records(spark, f"{at}/d.parquet")
    return out.unionByName(spark.range(1).select(F.lit("records").alias("format"), F.lit(counted).cast("long").alias("n"), F.lit(0).cast("long").alias("chars")))


_BW = r"bw AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS w FROM benchmark)"


@query(rf"""WITH {_BW}, c AS (SELECT w, count(*) AS n FROM bw GROUP BY w)
SELECT 'list' AS source, w AS word, CAST(0 AS BIGINT) AS n FROM c UNION ALL SELECT 'first column', w, 0 FROM c
UNION ALL SELECT DISTINCT 'clean', lower(u), 0 FROM (SELECT unnest(string_split(regexp_replace(w, '#.*$', ''), ',')) AS u FROM c) WHERE NOT regexp_matches(u, '^\p{{Lu}}') AND regexp_full_match(u, '\p{{L}}+(?:[''-]\p{{L}}+)*')
UNION ALL SELECT 'counts', w, n FROM c WHERE n >= 2 UNION ALL SELECT 'merged', w, 0 FROM c""")
def word_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word lists and counts written as lines, columns and tables, and read again."""
    at = _folder(spark)
    words = parquet_table(spark, sf_dir, "benchmark").select(F.explode(T.pieces(F.col("text"))).alias("token"))
    counts = words.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    counts.select(F.concat(F.lit("  "), "token", F.lit(" ")).alias("value")).write.text(f"{at}/list")
    counts.select(F.concat("token", F.lit(" # a note")).alias("value")).write.text(f"{at}/notes")
    sinks.write_tsv(counts, f"{at}/counts", ["token", "n"])
    lists = readers.read_word_list(spark, f"{at}/list")
    column = readers.read_ids(spark, f"{at}/list").select(F.col("id").alias("word"))
    parts = {
        "list": lists,
        "first column": column,
        "clean": readers.clean_word_list(spark.read.text(f"{at}/notes")),
        "merged": vocabulary.phrase_list(lists, column),
    }
    out = readers.read_counts(spark, f"{at}/counts", 2).select(F.lit("counts").alias("source"), F.col("token").alias("word"), "n")
    for name, df in parts.items():
        out = out.unionByName(df.select(F.lit(name).alias("source"), "word", F.lit(0).cast("long").alias("n")))
    return out


@query(r"""SELECT CAST(row_number() OVER (ORDER BY item_id) - 1 AS INTEGER) AS idx, text AS good, lower(text) AS bad, CASE WHEN item_id % 2 = 0 THEN 'syntax/semantics' ELSE 'supplemental' END AS field, 'rr_' || lpad(item_id::VARCHAR, 6, '0') AS uid FROM benchmark""")
def pair_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minimal pairs written as JSON lines with numbered ids, read by line numbers."""
    at = _folder(spark)
    bench = parquet_table(spark, sf_dir, "benchmark")
    rows = bench.select("item_id", F.col("text").alias("sentence_good"), F.lower("text").alias("sentence_bad"), F.when(F.col("item_id") % 2 == 0, "syntax_semantics").alias("field"), sinks.numbered_uid("rr", F.col("item_id")).alias("UID"))
    sinks.write_table(rows.orderBy("item_id").drop("item_id"), f"{at}/pairs", "json", 1)
    raw = readers.read_raw_rows(spark, f"{at}/pairs", readers.PAIR_SCHEMA).select(F.col("row.UID").alias("uid")).distinct()
    return readers.read_pairs(spark, f"{at}/pairs").join(raw, "uid", "left_semi").select("idx", "good", "bad", "field", "uid")


@query(r"""SELECT CAST(row_number() OVER (ORDER BY item_id) - 1 AS INTEGER) AS idx, 'd' || (item_id % 3) || '_' || (row_number() OVER (ORDER BY item_id) - 1) AS id, text AS "Context1" FROM benchmark""")
def context_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context items with ids of domain and index."""
    at = _folder(spark)
    rows = parquet_table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("d"), (F.col("item_id") % 3).cast("string")).alias("Domain"), F.col("text").alias("Context1"))
    sinks.write_table(rows.orderBy("item_id").drop("item_id"), f"{at}/items", "json", 1)
    return readers.read_context_items(spark, f"{at}/items").select("idx", "id", "Context1")


@query(r"""WITH p AS (SELECT item_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS w FROM benchmark)
SELECT 's' || (item_id % 3) AS suite, CAST(item_id AS INTEGER) AS item, c AS condition, CASE c WHEN 'whole' THEN array_to_string(w, ' ') ELSE array_to_string(list_reverse(w), ' ') END AS sentence FROM p, unnest(['whole', 'reversed']) AS t(c)""")
def suite_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suites as nested JSON, their regions, and the sentence of each condition."""
    at = _folder(spark)
    words = parquet_table(spark, sf_dir, "benchmark").select("item_id", T.pieces(F.col("text")).alias("w"))
    regions = lambda w: F.transform(w, lambda x, k: F.struct((k + 1).alias("region_number"), F.concat(F.lit(" "), x, F.lit(" ")).alias("content")))
    conditions = F.array(F.struct(F.lit("whole").alias("condition_name"), regions(F.col("w")).alias("regions")), F.struct(F.lit("reversed").alias("condition_name"), regions(F.reverse("w")).alias("regions")))
    items = words.select((F.col("item_id") % 3).alias("s"), F.struct(F.col("item_id").cast("int").alias("item_number"), conditions.alias("conditions")).alias("i"))
    suites = items.groupBy("s").agg(F.collect_list("i").alias("items"))
    suites.select(F.struct(F.concat(F.lit("s"), F.col("s").cast("string")).alias("name"), F.lit("sum").alias("metric")).alias("meta"), "items").write.partitionBy().json(f"{at}/suites")
    rows = readers.suite_regions(spark.read.schema(readers.SUITE_SCHEMA).json(f"{at}/suites"))
    parts = rows.groupBy("suite", "item", "condition").agg(F.array_sort(F.collect_list(F.struct("region", "content"))).alias("r"))
    return parts.select("suite", "item", "condition", T.region_sentence(F.col("r.content")).alias("sentence"))


@query(r"""SELECT item_id AS "pairID", text AS sentence1, ['entailment', 'neutral', 'contradiction'][1 + item_id % 4] AS gold_label FROM benchmark WHERE item_id % 4 < 3""")
def inference_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled pairs; rows without a known label go."""
    at = _folder(spark)
    label = F.get(F.array(*map(F.lit, (*readers.INFERENCE_LABELS[:1], "neutral", "contradiction", "-"))), (F.col("item_id") % 4).cast("int"))
    rows = parquet_table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("pairID"), label.alias("gold_label"), F.col("text").alias("sentence1"))
    sinks.write_table(rows, f"{at}/pairs", "json")
    return readers.read_inference_pairs(spark, f"{at}/pairs").select(F.col("pairID").cast("long").alias("pairID"), "sentence1", "gold_label")


@query(r"""SELECT count(*) AS files, count(DISTINCT md5(text)) AS digests, min(md5(text)) AS least FROM benchmark""")
def file_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of files, each of one text."""
    at = _folder(spark)
    rows = parquet_table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("value"))
    rows.repartition("item_id").write.partitionBy("item_id").option("lineSep", chr(3)).text(f"{at}/texts")
    found = readers.file_digests(spark, f"{at}/texts/*/*.txt")
    own = rows.select(F.md5(F.concat("value", F.lit(chr(3)))).alias("md5"), F.md5("value").alias("plain"))
    return found.join(own, "md5").agg(F.count(F.lit(1)).alias("files"), F.countDistinct("plain").alias("digests"), F.min("plain").alias("least"))


@query(rf"""WITH t AS (SELECT item_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS w, text FROM benchmark)
SELECT item_id, array_to_string(regexp_extract_all(lower(text), '\p{{L}}+(?:[''’]\p{{L}}+)*|\p{{Nd}}+'), ' ') AS tokens, sha256(array_to_string(list_sort(list_distinct(w)), chr(10))) AS digest FROM t""")
def token_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of texts, and a digest of their set of words."""
    t = F.col("text")
    return parquet_table(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.tokenize(t), " ").alias("tokens"), T.set_digest(T.pieces(t)).alias("digest"))


@query(r"""WITH t AS (SELECT item_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS w FROM benchmark),
s AS (SELECT item_id, w, CASE WHEN len(w) >= 3 AND w[2] <> w[3] THEN [w[1], w[3], w[2]] || w[4:] ELSE w END AS v FROM t)
SELECT item_id, CASE WHEN len(w) >= 3 AND w[2] <> w[3] THEN '1 2' END AS places FROM s""")
def swapped_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H8: where two words of a sentence are exchanged."""
    w = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), F.lit(0))
    rows = parquet_table(spark, sf_dir, "benchmark").select("item_id", "text", w.alias("w"))
    at = lambda k: F.get("w", F.lit(k))
    swapped = F.concat(F.array(at(0), at(2), at(1)), F.slice("w", 4, F.greatest(F.size("w"), F.lit(1))))
    other = F.array_join(F.when(F.size("w") >= 3, swapped).otherwise(F.col("w")), " ")
    return rows.select("item_id", F.array_join(F.transform(T.swapped_tokens(F.col("text"), other), lambda p: p.cast("string")), " ").alias("places"))


@query(rf"""WITH {CONV} SELECT conv_id, turn, i, CASE lower(text) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in trees.PRONOUN_GENDER.items())} END AS gender,
  CASE WHEN lemma IN {_in(trees.REFLEXIVES)} THEN 'REFL' WHEN dep = 'poss' THEN 'POSSDET' WHEN dep IN ('dobj', 'iobj', 'pobj') THEN 'OBJ' ELSE 'SUBJ' END AS class FROM tok WHERE pos = 'PRON'""")
def pronouns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gender and class of pronouns."""
    tok = conv_tokens(spark, sf_dir).filter("pos = 'PRON'")
    return tok.select(*KEY, "i", trees.pronoun_gender(F.col("text")).alias("gender"), trees.pronoun_class().alias("class"))


@query(rf"""WITH {CONV}, r AS (SELECT conv_id, turn, i, head FROM tok WHERE lemma IN {_in(trees.REFLEXIVES)}),
s AS (SELECT conv_id, turn, head AS h, min(i) AS subject FROM tok WHERE dep IN ('nsubj', 'nsubjpass') GROUP BY ALL)
SELECT r.conv_id, r.turn, r.i, coalesce(a.subject, b.subject) AS subject FROM r JOIN tok t ON t.conv_id = r.conv_id AND t.turn = r.turn AND t.i = r.head
LEFT JOIN s a ON a.conv_id = r.conv_id AND a.turn = r.turn AND a.h = r.head LEFT JOIN s b ON b.conv_id = r.conv_id AND b.turn = r.turn AND b.h = t.head""")
def reflexives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I16: subjects of reflexive pronouns."""
    return trees.reflexive_subjects(conv_tokens(spark, sf_dir), KEY)


@query(rf"""WITH {CONV}, k AS (SELECT conv_id, turn, head AS top, i, lower(text) AS w FROM tok WHERE dep = 'det' AND head <> i),
a AS (SELECT * FROM k UNION ALL SELECT t.conv_id, t.turn, t.i, t.i, lower(t.text) FROM tok t WHERE EXISTS (SELECT 1 FROM k WHERE k.conv_id = t.conv_id AND k.turn = t.turn AND k.top = t.i)),
p AS (SELECT string_agg(w, ' ' ORDER BY i, w) AS phrase FROM a GROUP BY conv_id, turn, top) SELECT phrase, count(*) AS n FROM p GROUP BY phrase""")
def fixed_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads with their children of one relation as phrases."""
    return trees.fixed_expressions(conv_tokens(spark, sf_dir), KEY, "det")


@query(rf"""WITH {BENCH}, v AS (SELECT DISTINCT lemma AS token FROM tok WHERE i < 8), r AS (SELECT item_id * 1000 + i AS record, CASE WHEN pos = 'NOUN' THEN 'noun' ELSE lower(pos) END AS pos, text AS word, text || 's' AS plural, lemma AS singular FROM tok)
SELECT * FROM r WHERE pos <> 'noun' OR EXISTS (SELECT 1 FROM v WHERE lower(v.token) IN (lower(word), lower(plural), lower(singular)))""")
def vocabulary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a form in a vocabulary, and all that aren't nouns."""
    tok = bench_tokens(spark, sf_dir)
    kind = F.when(F.col("pos") == "NOUN", "noun").otherwise(F.lower("pos"))
    rows = tok.select((F.col("item_id") * 1000 + F.col("i")).alias("record"), kind.alias("pos"), F.col("text").alias("word"), F.concat("text", F.lit("s")).alias("plural"), F.col("lemma").alias("singular"))
    return vocabulary.with_some_form(rows, tok.filter("i < 8").select(F.col("lemma").alias("token")))


_ENTRIES = """e AS (SELECT DISTINCT low AS word, CASE WHEN length(low) % 2 = 0 THEN ['uncountable'] ELSE ['countable'] END AS a, CASE WHEN length(low) % 3 = 0 THEN ['plural-only'] WHEN length(low) % 3 = 1 THEN ['countable', 'form-of'] ELSE ['countable'] END AS b, length(low) % 5 = 0 AS form
  FROM (SELECT lower(w) AS low FROM bw) WHERE regexp_full_match(low, '\\p{Ll}+'))"""


@query(rf"""WITH {_BW}, {_ENTRIES}, s AS (SELECT word, list_filter([a, b], lambda t: NOT list_contains(t, 'form-of')) AS own FROM e WHERE NOT form),
t AS (SELECT word, own, list_sort(list_distinct(flatten(own))) AS seen FROM s)
SELECT word AS lemma, CASE WHEN len(list_filter(own, lambda x: NOT list_contains(x, 'plural-only'))) = 0 THEN 'PLURAL_ONLY' WHEN list_contains(seen, 'uncountable') AND list_contains(seen, 'countable') THEN 'BOTH' WHEN list_contains(seen, 'uncountable') THEN 'MASS' ELSE 'COUNT' END AS bucket, array_to_string(seen, ' ') AS tags FROM t""")
def dictionary_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Countability from nested dictionary entries in JSON lines."""
    at = _folder(spark)
    low = parquet_table(spark, sf_dir, "benchmark").select(F.explode(T.pieces(F.lower("text"))).alias("word")).distinct().filter(F.col("word").rlike(r"^\p{Ll}+$"))
    n = F.length("word")
    sense = lambda *tags: F.struct(F.array(*map(F.lit, tags)).alias("tags"))
    second = F.when(n % 3 == 0, sense("plural-only")).when(n % 3 == 1, sense("countable", "form-of")).otherwise(sense("countable"))
    senses = F.array(F.when(n % 2 == 0, sense("uncountable")).otherwise(sense("countable")), second)
    template = F.struct(F.lit("head").alias("name"), F.create_map(F.lit("2"), F.when(n % 5 == 0, "noun form").otherwise("noun")).alias("args"))
    low.select("word", F.lit("noun").alias("pos"), F.lit("en").alias("lang_code"), F.array(template).alias("head_templates"), senses.alias("senses")).write.json(f"{at}/entries")
    out = dictionary.classified(spark.read.schema(dictionary.ENTRY).json(f"{at}/entries"))
    return out.select("lemma", "bucket", F.array_join("tags", " ").alias("tags"))


@query(rf"""WITH {BENCH}, nm AS (SELECT DISTINCT text AS name, ['m', 'f', 'n'][1 + length(text) % 3] AS gender FROM tok WHERE is_start AND pos <> 'PUNCT'), vo AS (SELECT DISTINCT lower(text) AS lemma FROM tok WHERE NOT is_start), ba AS (SELECT DISTINCT lemma FROM tok WHERE pos IN ('DET', 'ADP')),
g AS (SELECT DISTINCT name, gender FROM nm WHERE lower(name) IN (SELECT lemma FROM vo) AND NOT EXISTS (SELECT 1 FROM ba WHERE ba.lemma = lower(name))),
po AS (SELECT name, gender FROM g UNION SELECT name, 'any' FROM g), rk AS (SELECT *, row_number() OVER (PARTITION BY gender ORDER BY {_U.format("'41:' || gender || ':' || name")}, name) - 1 AS place, count(*) OVER (PARTITION BY gender) AS size FROM po),
rq AS (SELECT item_id || ':' || i AS request, ['m', 'f', 'n', 'any'][1 + length(text) % 4] AS gender, text AS exclude FROM tok WHERE is_start AND pos <> 'PUNCT'),
fi AS (SELECT rq.*, z.size, CAST(floor({_U.format("'42:' || request")} * z.size) AS BIGINT) AS first FROM rq JOIN (SELECT DISTINCT gender, size FROM rk) z USING (gender)),
tr AS (SELECT request, gender, exclude, 0 AS t, first AS place FROM fi UNION ALL SELECT request, gender, exclude, 1, (first + 1) % size FROM fi)
SELECT request, arg_min(rk.name, t) AS name FROM tr JOIN rk USING (gender, place) WHERE lower(rk.name) <> lower(exclude) GROUP BY request""")
def drawn_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name of the wanted gender out of gated pools, never the excluded one."""
    tok = bench_tokens(spark, sf_dir)
    own = tok.filter("is_start and pos <> 'PUNCT'")
    kinds = F.array(*map(F.lit, ("m", "f", "n", "any")))
    names = own.select(F.col("text").alias("name"), F.get(kinds, F.length("text") % 3).alias("gender")).distinct()
    pool = pools.gated_names(names, None, tok.filter("not is_start").select(F.lower("text").alias("lemma")), tok.filter("pos in ('DET', 'ADP')").select("lemma"))
    wanted = F.get(kinds, F.length("text") % 4)
    asked = own.select(F.concat_ws(":", "item_id", "i").alias("request"), F.when(wanted != "any", wanted).alias("gender"), F.col("text").alias("exclude"))
    return rewriting.draw_name(asked, pool, 41)


@query(rf"""WITH {BENCH}, l AS (SELECT lemma, list_sort(list_distinct(list(CASE dep WHEN 'amod' THEN 'tough' WHEN 'ROOT' THEN 'raising' ELSE 'control' END))) AS tags, list_sort(list_distinct(list(CASE length(text) % 2 WHEN 0 THEN 'subj' ELSE 'subjpass' END))) AS licenses FROM tok WHERE pos IN ('ADJ', 'NOUN') GROUP BY lemma)
SELECT lemma, CASE WHEN list_contains(tags, 'tough') THEN 'tough' WHEN list_contains(tags, 'raising') THEN 'raising' ELSE 'control' END AS tag, array_to_string(CASE WHEN list_contains(tags, 'control') AND list_contains(licenses, 'subjpass') THEN list_sort(list_distinct(tags || ['raising'])) ELSE tags END, ' ') AS tags FROM l""")
def adjective_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tag that counts, and tags that follow from a tag with a license."""
    tok = bench_tokens(spark, sf_dir).filter("pos in ('ADJ', 'NOUN')")
    tag = F.when(F.col("dep") == "amod", "tough").when(F.col("dep") == "ROOT", "raising").otherwise("control")
    held = F.when(F.length("text") % 2 == 0, "subj").otherwise("subjpass")
    lexicon = readers.merged_lexicon(tok.select("lemma", F.array(tag).alias("tags"), F.array(held).alias("licenses")))
    derived = pools.with_derived_tag(lexicon.withColumn("tag", pools.adjective_tag(F.col("tags"))), "control", "subjpass", "raising")
    return derived.select("lemma", "tag", F.array_join("tags", " ").alias("tags"))


@query("""SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC NULLS LAST, doc_id NULLS FIRST) AS place FROM documents""")
def ranked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of candidates by score."""
    return language_model.ranked(parquet_table(spark, sf_dir, "documents"), ["lang"], "n_chars", "doc_id").select("lang", "doc_id", "place")


@query(rf"""WITH {CONV}, x AS (SELECT conv_id, turn, sent, i, pos, lead(pos) OVER w AS p1, lead(pos, 2) OVER w AS p2, lower(text) AS l0, lead(lower(text)) OVER w AS l1 FROM tok WINDOW w AS (PARTITION BY conv_id, turn, sent ORDER BY i))
SELECT conv_id, turn, i AS start, i + CASE WHEN p1 = 'ADJ' THEN 3 ELSE 2 END AS "end", 'noun phrase' AS pattern FROM x WHERE pos = 'DET' AND (p1 = 'NOUN' OR (p1 = 'ADJ' AND p2 = 'NOUN'))
UNION ALL SELECT conv_id, turn, i, i + 2, 'of or in with the' FROM x WHERE l0 IN ('of', 'in') AND l1 = 'the'""")
def token_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of token patterns with sets of values and optional tokens."""
    wanted = {"noun phrase": [{"POS": "DET"}, {"POS": "ADJ", "OP": "?"}, {"POS": "NOUN"}], "of or in with the": [{"LOWER": {"IN": ["of", "in"]}}, {"LOWER": "the"}]}
    return patterns.token_matches(conv_tokens(spark, sf_dir), wanted, KEY)


@query(rf"""WITH {CONV}, k AS (SELECT * FROM tok WHERE head <> i)
SELECT v.conv_id, v.turn, v.i AS anchor, s.i AS subject, d.i AS determiner, o.i AS object FROM tok v JOIN k s ON s.conv_id = v.conv_id AND s.turn = v.turn AND s.head = v.i AND s.dep = 'nsubj'
LEFT JOIN k d ON d.conv_id = v.conv_id AND d.turn = v.turn AND d.head = s.i AND d.dep = 'det' LEFT JOIN k o ON o.conv_id = v.conv_id AND o.turn = v.turn AND o.head = v.i AND o.dep = 'dobj' AND o.pos = 'NOUN' WHERE v.pos = 'VERB'""")
def dependency_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verbs with a subject, its determiner and an object where there are any."""
    edges = [("anchor", "subject", "nsubj", {}), ("subject", "determiner", "det", {"OP": "?"}), ("anchor", "object", "dobj", {"POS": "NOUN", "OP": "?"})]
    return patterns.dependency_matches(conv_tokens(spark, sf_dir), {"POS": "VERB"}, edges, KEY)


@query(rf"""WITH {CONV}, a AS (SELECT * FROM tok WHERE pos = 'ADP' AND dep IN ('prep', 'case')),
n AS (SELECT * FROM tok WHERE dep IN ('obl', 'nmod', 'obj', 'dobj', 'iobj', 'pobj', 'attr')),
f AS (SELECT conv_id, turn, head AS i, lemma FROM a UNION SELECT n.conv_id, n.turn, n.head, a.lemma FROM a JOIN n ON n.conv_id = a.conv_id AND n.turn = a.turn AND n.i = a.head UNION SELECT conv_id, turn, i - 1, lemma FROM a)
SELECT v.conv_id, v.turn, v.i, coalesce(string_agg(DISTINCT f.lemma, ' ' ORDER BY f.lemma), '') AS preps, CAST(count(DISTINCT g.i) AS BIGINT) AS governed FROM tok v LEFT JOIN f USING (conv_id, turn, i)
LEFT JOIN (SELECT p.conv_id, p.turn, p.head AS i, p.i AS g FROM tok p WHERE p.pos = 'ADP' AND p.dep = 'prep' AND p.head <> p.i) h ON h.conv_id = v.conv_id AND h.turn = v.turn AND h.i = v.i
LEFT JOIN tok g ON g.conv_id = h.conv_id AND g.turn = h.turn AND g.i = h.g AND NOT (g.lemma = 'to' AND v.dep = 'xcomp') WHERE v.pos = 'VERB' GROUP BY v.conv_id, v.turn, v.i""")
def verb_prepositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepositions that pair with verbs, and how many a verb governs."""
    tok = conv_tokens(spark, sf_dir)
    governed = trees.governed_prepositions(tok, KEY).join(tok.select(*KEY, "i", "head"), [*KEY, "i"]).groupBy(*KEY, F.col("head").alias("i")).agg(F.count(F.lit(1)).alias("governed"))
    out = trees.verb_prepositions(tok, KEY).join(governed, [*KEY, "i"], "left")
    return out.select(*KEY, "i", F.array_join("preps", " ").alias("preps"), F.coalesce("governed", F.lit(0)).alias("governed"))


@query(rf"""WITH {CONV}, {_KIDS}, ss AS (SELECT conv_id, turn, sent, bool_or(tag LIKE 'W%' OR lower(text) IN {_in(trees.WH_WORDS)}) AS wh, bool_or(dep = 'aux' AND lemma IN ('do', 'is', 'und')) AS has_do FROM tok GROUP BY ALL),
su AS (SELECT conv_id, turn, head AS i, arg_min(NOT (tag LIKE 'W%' OR lower(text) IN {_in(trees.WH_WORDS)}), i) AS plain FROM tok WHERE dep = 'nsubj' AND head <> i GROUP BY ALL)
SELECT f.conv_id, f.turn, f.i, CASE WHEN has_obj AND has_prep THEN 'ditrans' WHEN has_obj THEN 'trans' WHEN len(preps) = 0 AND NOT has_xcomp AND coalesce(plain, false) AND wh AND has_do THEN 'trans' ELSE 'intrans' END AS frame
FROM ful f JOIN ss USING (conv_id, turn, sent) LEFT JOIN su USING (conv_id, turn, i) WHERE pos = 'VERB'""")
def gap_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of verbs with the gaps of moved objects."""
    return trees.gap_frames(conv_tokens(spark, sf_dir), KEY, ("do", "is", "und"))


@query(rf"""WITH RECURSIVE {BENCH}, dn AS (SELECT item_id, i AS top, i, 0 AS d FROM tok UNION SELECT x.item_id, x.top, t.i, x.d + 1 FROM dn x JOIN tok t ON t.item_id = x.item_id AND t.head = x.i AND t.head <> t.i WHERE x.d < 4),
mk AS (SELECT dn.item_id, top, bool_or(t.lemma IN ('is', 'be', 'en') AND t.pos IN ('AUX', 'VERB', 'ADP')) FILTER (WHERE t.pos IN ('AUX', 'VERB')) AS has_be, bool_or(t.lemma IN ('to', 'de', 'in')) AS has_to, bool_or(t.lemma = 'there' AND t.dep IN ('expl', 'nsubj')) AS there FROM dn JOIN tok t ON t.item_id = dn.item_id AND t.i = dn.i GROUP BY ALL),
xc AS (SELECT x.item_id, x.head AS i FROM tok x JOIN mk ON mk.item_id = x.item_id AND mk.top = x.i AND has_be AND has_to WHERE x.dep = 'xcomp')
SELECT v.item_id, v.i FROM tok v WHERE v.pos IN ('VERB', 'AUX') AND EXISTS (SELECT 1 FROM xc WHERE xc.item_id = v.item_id AND xc.i = v.i)
  AND (EXISTS (SELECT 1 FROM mk WHERE mk.item_id = v.item_id AND mk.top = v.i AND there) OR EXISTS (SELECT 1 FROM tok o WHERE o.item_id = v.item_id AND o.head = v.i AND o.dep IN ('obj', 'dobj') AND o.pos = 'PRON' AND o.lemma = 'it'))""")
def expletive_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verbs over a to-be clause with an expletive."""
    return trees.expletive_contexts(bench_tokens(spark, sf_dir), ["item_id"], ("is", "be", "en"), ("to", "de", "in"))


@query(rf"""WITH {BENCH}, e AS (SELECT item_id, head AS host, arg_min(CASE WHEN dep = 'expl' THEN lemma WHEN pos = 'PRON' AND lemma = 'it' THEN 'it' ELSE 'np' END, CASE WHEN dep = 'expl' THEN 0 ELSE 100000 END + i) AS v FROM tok WHERE head <> i AND ((dep = 'expl' AND lemma IN ('there', 'it')) OR dep IN ('nsubj', 'nsubjpass')) GROUP BY ALL)
SELECT t.item_id, t.i, coalesce(e.v, 'np') AS license FROM tok t LEFT JOIN e ON e.item_id = t.item_id AND e.host = CASE WHEN t.dep IN ('acomp', 'attr') THEN t.head ELSE t.i END WHERE t.pos = 'ADJ'""")
def adjective_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject licenses of adjectives."""
    return trees.adjective_licenses(bench_tokens(spark, sf_dir), ["item_id"])


@query(rf"""WITH {BENCH} SELECT item_id, i, lower(text) IN ('who', 'which') AND (SELECT count(*) FROM tok q WHERE q.item_id = tok.item_id AND q.text = '?') > 0 AS asks, 'Number=' || (CASE WHEN tag LIKE '%S' THEN 'Plur' ELSE 'Sing' END) || '|Tag=' || tag AS morph FROM tok WHERE pos IN ('PRON', 'NOUN')""")
def token_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wh tokens that ask, and sorted morphological features."""
    tok = bench_tokens(spark, sf_dir)
    marks = tok.groupBy("item_id").agg(F.bool_or(F.col("text") == "?").alias("marked"))
    rows = tok.filter("pos in ('PRON', 'NOUN')").join(marks, "item_id").withColumn("was", F.col("tag")).withColumn("tag", F.when(F.lower("text").isin("who", "which"), "WP").otherwise(F.col("tag")))
    morph = F.create_map(F.lit("Tag"), F.col("was"), F.lit("Number"), F.when(F.col("was").endswith("S"), "Plur").otherwise("Sing"))
    signature = F.array_join(F.transform(trees.morph_signature(morph), lambda e: F.concat_ws("=", e["key"], e["value"])), "|")
    return rows.select("item_id", "i", trees.interrogative(F.array().cast("array<string>"), F.col("marked")).alias("asks"), signature.alias("morph"))


_FRAMES = ("<NP/><VERB/><NP/>", "<NP/><VERB/><NP/><NP/>", '<NP/><VERB/><PREP value="with / to"/><NP/>', '<NP/><VERB/><LEX value="that"/><S/>', '<NP/><VERB/><NP/><PREP value="to"/><NP/>')
_SAID = ("('trans', '', '')", "('ditrans', '', '')", "('intrans', 'to with', '')", "('intrans', '', 'that')", "('trans', 'to', '')")


@query(rf"""WITH {BENCH}, f(k, key, preps, flags) AS (VALUES {', '.join(f"({k}, {x[1:]}" for k, x in enumerate(_SAID))})
SELECT DISTINCT lemma AS verb, key, preps, flags FROM tok JOIN f ON k IN (item_id % 5, length(lemma) % 5) WHERE pos = 'VERB'""")
def verb_class_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members and frames of verb classes in XML."""
    at = _folder(spark)
    verbs = bench_tokens(spark, sf_dir).filter("pos = 'VERB'").select("item_id", "lemma").distinct()
    frame = lambda k: F.concat(F.lit("<FRAME><SYNTAX>"), F.get(F.array(*map(F.lit, _FRAMES)), k.cast("int")), F.lit("</SYNTAX></FRAME>"))
    text = F.concat(F.lit('<VNCLASS ID="c"><MEMBERS><MEMBER name="'), "lemma", F.lit('"/></MEMBERS><FRAMES>'), frame(F.col("item_id") % 5), frame(F.length("lemma") % 5), F.lit("</FRAMES></VNCLASS>"))
    verbs.select(text.alias("value")).write.text(f"{at}/classes")
    out = readers.read_verb_classes(spark, f"{at}/classes")
    return out.select("verb", "key", F.array_join("preps", " ").alias("preps"), F.array_join("flags", " ").alias("flags"))


@query(f"""WITH {BENCH}, r AS (SELECT DISTINCT lemma AS target, unnest(['NNS', 'VBD']) AS tag FROM tok WHERE pos IN ('NOUN', 'VERB')), fo AS (SELECT lemma, 'VBD' AS tag, min(text) AS form FROM tok WHERE pos = 'VERB' AND length(text) % 3 = 0 GROUP BY lemma)
SELECT target AS lemma, r.tag, coalesce(fo.form, {_INF.replace('tag IN', 'r.tag IN').replace('tag =', 'r.tag =')}) AS form FROM r LEFT JOIN fo ON fo.lemma = target AND fo.tag = r.tag""")
def realized_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H7: forms from a table of irregular ones, else by rule."""
    tok = bench_tokens(spark, sf_dir)
    rows = tok.filter("pos in ('NOUN', 'VERB')").select("lemma", F.explode(F.array(F.lit("NNS"), F.lit("VBD"))).alias("tag")).distinct()
    forms = tok.filter("pos = 'VERB' and length(text) % 3 = 0").select("lemma", F.lit("VBD").alias("tag"), F.lit(0).alias("rank"), F.col("text").alias("form"))
    return vocabulary.realized(rows, forms)


@query(r"""SELECT item_id, CAST(octet_length(encode(trim(text))) AS INTEGER) AS n_ids, list_sum(list_transform(range(octet_length(encode(trim(text)))), lambda i: CAST('0x' || substr(hex(encode(trim(text))), 2 * i + 1, 2) AS INTEGER)))::BIGINT AS total FROM benchmark""")
def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of a plug-in tokenizer written as a table and read again."""
    at = _folder(spark)
    ids = sinks.token_ids(parquet_table(spark, sf_dir, "benchmark").select("item_id", "text"), "item_id", "long", sinks.utf8_tokenizer)
    sinks.write_table(ids, f"{at}/ids")
    rows = spark.read.parquet(f"{at}/ids")
    return rows.select("item_id", F.size("ids").alias("n_ids"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS z FROM embeddings),
k AS (SELECT vec_id, label, z, list_sort(z)[len(z) - 4] AS least FROM e), p AS (SELECT *, list_transform(z, lambda x, i: CASE WHEN i - 1 = label % len(z) THEN CASE WHEN x > 0 THEN x / 1.5::DOUBLE ELSE x * 1.5::DOUBLE END ELSE x END) AS pen FROM k)
SELECT vec_id, CAST(len(list_filter(z, lambda x: x >= least)) AS INTEGER) AS kept, round(list_sum(pen), 6) AS penalised, CASE WHEN label % 2 = 0 THEN '3' ELSE '' END AS blocked FROM p""")
def decoding_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-k, the penalty of seen ids, and ids that would repeat an n-gram."""
    z = F.col("embedding").cast("array<double>")
    rows = parquet_table(spark, sf_dir, "embeddings").select("vec_id", z.alias("z"), (F.col("label") % F.size("embedding")).cast("int").alias("y"), (F.col("label") % 2).cast("int").alias("odd"))
    kept = F.size(F.filter(V.top_k(F.col("z"), 5), lambda x: x > float("-inf")))
    penalised = F.aggregate(V.repetition_penalty(F.col("z"), F.array("y"), 1.5), F.lit(0.0), lambda a, x: a + x)
    ids = F.when(F.col("odd") == 0, F.array(*map(F.lit, (1, 2, 3, 4, 1, 2)))).otherwise(F.array(*map(F.lit, (1, 2, 3, 4, 5, 6))))
    blocked = F.array_join(F.transform(V.blocked_ids(ids, 3), lambda x: x.cast("string")), " ")
    return rows.select("vec_id", kept.alias("kept"), F.round(penalised, 6).alias("penalised"), blocked.alias("blocked"))
