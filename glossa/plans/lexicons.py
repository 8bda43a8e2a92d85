"""Queries on lexicons, slots and scalar functions that the other plans don't touch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.operators import metrics, pools, trees
from glossa.plans.registry import query
from glossa.plans.rewriting import _COMP, _FRAME, _INF, _KIDS, BENCH, CONV, KEY, _in, bench_tokens, conv_tokens
from glossa.sources import readers
from glossa.sources.readers import parquet_table


@query(f"""WITH {BENCH} SELECT item_id, i, CASE WHEN pos = 'PRON' THEN 'pron' WHEN NOT regexp_matches(text, '\\p{{L}}') OR pos IN {_in(trees.CLOSED)} OR dep IN ('det', 'nummod', 'predet') OR lemma IN {_in(trees.QUANTIFIERS + trees.MODALS)} THEN 'frozen'
  WHEN pos = 'PROPN' THEN 'propn' WHEN pos = 'VERB' THEN 'verb' WHEN pos = 'NOUN' THEN 'noun' WHEN pos = 'ADJ' THEN 'adj' WHEN pos = 'ADV' THEN 'adv' ELSE 'pass' END AS kind FROM tok""")
def slot_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a rewrite does with each token."""
    return bench_tokens(spark, sf_dir).select("item_id", "i", trees.slot_kind().alias("kind"))


@query(f"""WITH {CONV}, a AS (SELECT conv_id, turn, head AS i, count(*) AS n, bool_or(lemma NOT IN {_in(trees.MODALS)}) AS f FROM tok WHERE dep IN ('aux', 'auxpass') GROUP BY ALL)
SELECT t.conv_id, t.turn, t.i, coalesce(n > 1 OR (f AND t.tag IN ('VBN', 'VBD')), false) AS heavy FROM tok t LEFT JOIN a USING (conv_id, turn, i) WHERE t.pos = 'VERB'""")
def heavy_auxiliaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: verbs with a periphrasis."""
    return trees.heavy_auxiliaries(conv_tokens(spark, sf_dir), KEY)


@query(f"""WITH {CONV}, {_KIDS} SELECT key, comp, array_to_string(preps, '+') AS preps, string_agg(DISTINCT lemma, ' ' ORDER BY lemma) AS verbs FROM (SELECT {_FRAME} AS key, {_COMP} AS comp, preps, lemma FROM ful WHERE pos = 'VERB') GROUP BY ALL""")
def verb_frame_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verbs by frame."""
    full = trees.with_children(conv_tokens(spark, sf_dir), KEY).filter("pos = 'VERB'")
    frames = full.select(F.col("lemma").alias("verb"), trees.frame().alias("key"), trees.complement_kind().alias("comp"), "preps", F.array().cast("array<string>").alias("flags"))
    return pools.frame_index(frames).select("key", "comp", F.array_join("preps", "+").alias("preps"), F.array_join("verbs", " ").alias("verbs"))


@query(f"WITH {BENCH} SELECT DISTINCT target, tag, {_INF} AS form FROM (SELECT lemma AS target, unnest(['NN', 'NNS', 'VBZ', 'VBD', 'VBG']) AS tag FROM tok WHERE pos IN ('NOUN', 'VERB'))")
def inflected_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H7: regular forms of lemmas."""
    tags = F.explode(F.array(*map(F.lit, ("NN", "NNS", "VBZ", "VBD", "VBG")))).alias("tag")
    rows = bench_tokens(spark, sf_dir).filter("pos in ('NOUN', 'VERB')").select(F.col("lemma").alias("target"), tags).distinct()
    return rows.select("target", "tag", T.inflect(F.col("target"), F.col("tag")).alias("form"))


@query(r"""WITH w AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n FROM documents)
SELECT doc_id, CAST(CASE WHEN n <= 128 THEN 256 WHEN n <= 256 THEN 128 WHEN n <= 512 THEN 64 WHEN n <= 1024 THEN 32 WHEN n <= 2048 THEN 8 ELSE 4 END AS INTEGER) AS batch FROM w""")
def batch_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """batch sizes by length."""
    return parquet_table(spark, sf_dir, "documents").select("doc_id", T.batch_size(T.word_count(F.col("text"))).alias("batch"))


@query("""WITH a AS (SELECT source AS uid, avg(n_chars) AS a FROM documents WHERE lang = 'en' GROUP BY 1), b AS (SELECT source AS uid, avg(n_chars) AS b FROM documents WHERE lang = 'de' GROUP BY 1)
SELECT substr(uid, 1, 4) AS "group", uid, round(a, 6) AS a, round(b, 6) AS b FROM a JOIN b USING (uid)""")
def metrics_side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two metric maps joined with their groups."""
    docs = parquet_table(spark, sf_dir, "documents")
    side = lambda lang: docs.filter(F.col("lang") == lang).groupBy("source").agg(F.round(F.avg("n_chars"), 6).alias("v")).agg(F.map_from_entries(F.collect_list(F.struct("source", "v"))).alias("m"))
    groups = docs.select(F.col("source").alias("uid"), F.substring("source", 1, 4).alias("group")).distinct()
    return metrics.joined_metrics(side("en"), side("de"), groups)


@query(r"""WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '\s+')) AS word, ['m', 'f', 'n', 'x'][1 + item_id % 4] AS gender FROM benchmark), g AS (SELECT DISTINCT lower(word) AS word, gender FROM w WHERE gender <> 'x')
SELECT word, min(gender) AS gender FROM g GROUP BY word HAVING count(*) = 1""")
def single_gender_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with exactly one gender."""
    kinds = F.array(*map(F.lit, ("m", "f", "n", "x")))
    rows = parquet_table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", r"\s+")).alias("word"), F.get(kinds, (F.col("item_id") % 4).cast("int")).alias("gender"))
    return readers.single_gender(rows)


@query(r"""WITH v AS (SELECT list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w, text, item_id FROM benchmark),
s AS (SELECT item_id, w[1] AS verb, CASE WHEN item_id % 3 = 0 THEN 'Somebody ----s something to somebody' WHEN item_id % 3 = 1 THEN 'Somebody ----s that CLAUSE' ELSE 'Something ----s with something' END AS frame FROM v)
SELECT verb, CAST(coalesce(min(least(len(regexp_extract_all(regexp_replace(frame, '^\S+', ''), 'something|somebody')), 2)), -1) AS INTEGER) AS objects, max(regexp_matches(frame, '\bthat\b')) AS that, max(regexp_matches(frame, '\bto\b')) AS "to",
  coalesce(string_agg(DISTINCT nullif(regexp_extract(frame, '\b(to|with)\b', 1), ''), ' ' ORDER BY nullif(regexp_extract(frame, '\b(to|with)\b', 1), '')), '') AS preps FROM s GROUP BY verb""")
def verb_frame_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What frame strings say about objects, complements and prepositions."""
    k = F.col("item_id") % 3
    frame = F.when(k == 0, "Somebody ----s something to somebody").when(k == 1, "Somebody ----s that CLAUSE").otherwise("Something ----s with something")
    rows = parquet_table(spark, sf_dir, "benchmark").select(F.get(T.pieces(F.lower("text")), F.lit(0)).alias("verb"), frame.alias("frame"))
    out = pools.object_counts(rows).join(pools.complement_profile(rows), "verb").join(pools.preps_after(rows), "verb", "left")
    return out.select("verb", F.col("objects").cast("int").alias("objects"), "that", "to", F.coalesce(F.array_join("preps", " "), F.lit("")).alias("preps"))


@query(r"""WITH r AS (SELECT lower(split_part(text, ' ', 1)) AS lemma, ['BOTH', 'COUNT', 'MASS', 'PLURAL_ONLY'][1 + item_id % 4] AS bucket, 't' || (item_id % 6) AS tag, item_id AS place FROM benchmark)
SELECT lemma, arg_min(bucket, CASE bucket WHEN 'BOTH' THEN 0 WHEN 'MASS' THEN 2 ELSE 1 END * 1000000 + place) AS bucket, string_agg(DISTINCT tag, ' ' ORDER BY tag) AS tags FROM r GROUP BY lemma""")
def merged_countability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates of a lemma merged by class."""
    kinds = F.array(*map(F.lit, ("BOTH", "COUNT", "MASS", "PLURAL_ONLY")))
    rows = parquet_table(spark, sf_dir, "benchmark").select(F.lower(F.split_part("text", F.lit(" "), F.lit(1))).alias("lemma"), F.get(kinds, (F.col("item_id") % 4).cast("int")).alias("bucket"), F.array(F.concat(F.lit("t"), (F.col("item_id") % 6).cast("string"))).alias("tags"), F.col("item_id").alias("place"))
    return pools.merged_countability(rows).select("lemma", "bucket", F.array_join("tags", " ").alias("tags"))


@query(r"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY pos, form ORDER BY place, lemma) AS r FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN 'n' ELSE 'v' END AS pos, lower(split_part(text, ' ', 1)) AS form, doc_id AS place, source AS lemma FROM documents))
SELECT pos, form, place, lemma FROM e WHERE r = 1 AND regexp_full_match(form, '[a-z]+(?:[-''][a-z]+)*')""")
def first_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first entry of each form of good shape."""
    rows = parquet_table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 2 == 0, "n").otherwise("v").alias("pos"), F.lower(F.split_part("text", F.lit(" "), F.lit(1))).alias("form"), F.col("doc_id").alias("place"), F.col("source").alias("lemma"))
    return pools.first_per_form(rows)
