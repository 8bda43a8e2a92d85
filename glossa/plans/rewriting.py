"""Queries on token tables: trees, contexts, pools, mappings and rendering."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.operators import context, draws, parsing, pools, rewriting, spans, trees
from glossa.plans.registry import query
from glossa.session import forget, settled, stored
from glossa.sources.readers import parquet_table, size_of, spread


def _in(words: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def tokens_sql(table: str, keys: str, p: str = "") -> str:
    """The native parse as CTEs that end in `tok`; p comes before their names."""
    end = "text IN ('.', '!', '?')"
    return rf"""
{p}w0 AS (SELECT {keys}, rid, unnest(regexp_extract_all(coalesce(text, ''), '\p{{L}}+(?:[''’]\p{{L}}+)*|\p{{Nd}}+|[^\s\p{{L}}\p{{Nd}}]')) AS text,
  unnest(generate_series(0, len(regexp_extract_all(coalesce(text, ''), '\p{{L}}+(?:[''’]\p{{L}}+)*|\p{{Nd}}+|[^\s\p{{L}}\p{{Nd}}]')) - 1)) AS i FROM (SELECT *, row_number() OVER () AS rid FROM {table}) numbered),
{p}w1 AS (SELECT *, lag({end}) OVER (PARTITION BY rid ORDER BY i) AS before FROM {p}w0),
{p}w2 AS (SELECT *, coalesce(before, true) AS is_start, lower(text) AS low,
  CAST(sum(CASE WHEN coalesce(before, false) THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i) AS INTEGER) AS sent FROM {p}w1),
{p}w3 AS (SELECT *, CASE WHEN regexp_full_match(text, '[^\p{{L}}\p{{Nd}}]') THEN 'PUNCT' WHEN regexp_matches(text, '^\p{{Nd}}') THEN 'NUM'
  WHEN low IN {_in(parsing.DETERMINERS)} THEN 'DET' WHEN low IN {_in(parsing.ADPOSITIONS)} THEN 'ADP' WHEN low IN {_in(parsing.PRONOUNS)} THEN 'PRON' WHEN low IN {_in(parsing.AUXILIARIES)} THEN 'AUX'
  WHEN NOT is_start AND regexp_matches(text, '^\p{{Lu}}') THEN 'PROPN' WHEN regexp_matches(low, '..ly$') THEN 'ADV' WHEN regexp_matches(low, '..(ed|ing|er|en|ar)$') THEN 'VERB'
  WHEN regexp_matches(low, '..(ble|ous|al|ich)$') THEN 'ADJ' ELSE 'NOUN' END AS pos FROM {p}w2),
{p}w4 AS (SELECT *, CASE pos WHEN 'VERB' THEN CASE WHEN suffix(low, 'ed') THEN 'VBD' WHEN suffix(low, 'ing') THEN 'VBG' ELSE 'VB' END
  WHEN 'NOUN' THEN CASE WHEN regexp_matches(low, '..s$') THEN 'NNS' ELSE 'NN' END WHEN 'PROPN' THEN CASE WHEN regexp_matches(low, '..s$') THEN 'NNPS' ELSE 'NNP' END
  WHEN 'ADJ' THEN 'JJ' WHEN 'ADV' THEN 'RB' WHEN 'DET' THEN 'DT' WHEN 'ADP' THEN 'IN' WHEN 'NUM' THEN 'CD' WHEN 'PRON' THEN 'PRP' WHEN 'AUX' THEN 'VBZ' ELSE '.' END AS tag FROM {p}w3),
{p}w5 AS (SELECT *, CASE WHEN tag IN ('NNS', 'NNPS') THEN regexp_replace(low, 's$', '') WHEN tag = 'VBD' THEN regexp_replace(low, 'ed$', '') WHEN tag = 'VBG' THEN regexp_replace(low, 'ing$', '') ELSE low END AS lemma,
  coalesce(min(CASE WHEN pos = 'VERB' THEN i END) OVER s, min(CASE WHEN pos <> 'PUNCT' THEN i END) OVER s, min(i) OVER s) AS root,
  min(CASE WHEN pos IN ('NOUN', 'PROPN') THEN i END) OVER (PARTITION BY rid, sent ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_noun,
  lag(pos) OVER (PARTITION BY rid, sent ORDER BY i) AS prev_pos, lag(low) OVER (PARTITION BY rid, sent ORDER BY i) AS prev_low
  FROM {p}w4 WINDOW s AS (PARTITION BY rid, sent)),
{p}w6 AS (SELECT *, max(CASE WHEN pos IN ('NOUN', 'PROPN') AND i < root THEN i END) OVER (PARTITION BY rid, sent) AS subj, min(CASE WHEN pos IN ('NOUN', 'PROPN') AND i > root THEN i END) OVER (PARTITION BY rid, sent) AS obj FROM {p}w5),
{p}tok AS (SELECT {keys}, CAST(i AS INTEGER) AS i, text, is_start, sent, pos, tag, lemma,
  CASE WHEN i = root THEN 'ROOT' WHEN pos = 'DET' THEN 'det' WHEN pos = 'ADJ' THEN 'amod' WHEN pos = 'NUM' THEN 'nummod' WHEN pos = 'AUX' THEN 'aux' WHEN pos = 'ADV' THEN 'advmod'
    WHEN pos = 'PRON' THEN CASE WHEN i > root THEN 'dobj' WHEN low IN ('there', 'it') THEN 'expl' ELSE 'nsubj' END WHEN pos = 'ADP' THEN CASE WHEN i > root THEN 'prep' ELSE 'case' END
    WHEN pos IN ('NOUN', 'PROPN') AND prev_pos = 'ADP' THEN 'pobj' WHEN i = subj THEN 'nsubj' WHEN i = obj THEN 'dobj' WHEN pos IN ('NOUN', 'PROPN') THEN 'nmod'
    WHEN pos = 'VERB' THEN CASE WHEN prev_low IN {_in(parsing.TO_WORDS)} THEN 'xcomp' ELSE 'conj' END ELSE 'punct' END AS dep,
  CAST(CASE WHEN i = root THEN i WHEN pos IN ('DET', 'ADJ', 'NUM') THEN coalesce(next_noun, root) WHEN pos IN ('AUX', 'ADV', 'PRON') THEN root WHEN pos = 'ADP' THEN CASE WHEN i > root THEN root ELSE coalesce(next_noun, root) END
    WHEN pos IN ('NOUN', 'PROPN') AND prev_pos = 'ADP' THEN i - 1 ELSE root END AS INTEGER) AS head FROM {p}w6)"""


CONV = tokens_sql("conversations", "conv_id, turn")
BENCH = tokens_sql("benchmark", "item_id")
DOCS = tokens_sql("documents", "doc_id")
KEY = ["conv_id", "turn"]

def kids_sql(keys: str, p: str = "") -> str:
    """What the children of each token say, and the tokens with it, as CTEs `kid` and `ful`."""
    return f"""
{p}kid AS (SELECT {keys}, head AS i, bit_or(CASE dep WHEN 'dobj' THEN 1 WHEN 'iobj' THEN 2 WHEN 'prep' THEN 4 WHEN 'advmod' THEN 8 WHEN 'xcomp' THEN 16 ELSE 0 END) AS mask,
  bool_or(dep = 'dobj') AS has_obj, bool_or(dep = 'prep') AS has_prep, bool_or(dep = 'xcomp') AS has_xcomp, bool_or(dep = 'aux') AS has_aux, bool_or(dep IN ('det', 'nummod', 'poss')) AS has_det, bool_or(dep = 'expl') AS has_expl,
  coalesce(list_sort(list_distinct(list(lemma) FILTER (WHERE dep = 'prep' AND lemma <> 'by'))), []) AS preps, count(*) AS n_children,
  arg_min(dep, i) FILTER (WHERE dep IN ('nsubj', 'expl')) AS s_dep, arg_min(lemma, i) FILTER (WHERE dep IN ('nsubj', 'expl')) AS s_lemma
  FROM {p}tok WHERE head <> i GROUP BY {keys}, head),
{p}ful AS (SELECT {p}tok.*, coalesce(mask, 0) AS mask, coalesce(has_obj, false) AS has_obj, coalesce(has_prep, false) AS has_prep, coalesce(has_xcomp, false) AS has_xcomp, coalesce(has_aux, false) AS has_aux, coalesce(has_det, false) AS has_det,
  coalesce(has_expl, false) AS has_expl, coalesce(preps, []) AS preps, coalesce(n_children, 0) AS n_children, s_dep, s_lemma FROM {p}tok LEFT JOIN {p}kid USING ({keys}, i))"""


_KIDS = kids_sql("conv_id, turn")
_FRAME = "CASE WHEN has_obj AND has_prep THEN 'ditrans' WHEN has_obj THEN 'trans' ELSE 'intrans' END"
_COMP = "CASE WHEN has_xcomp THEN 'CP_TO' WHEN has_obj THEN 'NP_OBJ' ELSE 'NONE' END"


def conv_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(parsed_conversations(spark, sf_dir))


def parsed_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_tokens() of a query that reads them once."""
    return parsing.parse(parquet_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), KEY)


def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.parse(parquet_table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])


def bench_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.parse(parquet_table(spark, sf_dir, "benchmark").select("item_id", "text"), ["item_id"])


@query(f"WITH {tokens_sql('documents', 'doc_id')} SELECT pos, tag, dep, count(*) AS n, count(DISTINCT lemma) AS lemmas, CAST(sum(abs(head - i)) AS BIGINT) AS distance FROM tok GROUP BY pos, tag, dep")
def parsed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The native parse of all documents, summed up by part of speech, tag and relation."""
    tok = doc_tokens(spark, sf_dir)
    return tok.groupBy("pos", "tag", "dep").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("lemma").alias("lemmas"), F.sum(F.abs(F.col("head") - F.col("i"))).alias("distance"))


@query(f"WITH {BENCH} SELECT * FROM tok")
def benchmark_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens table of the benchmark sentences."""
    return bench_tokens(spark, sf_dir)


@query(f"""WITH {CONV}, {_KIDS}
SELECT conv_id, turn, i, lemma, {_FRAME} AS frame, {_COMP} AS comp, CAST(mask AS INTEGER) AS mask, array_to_string(preps, ' ') AS preps, n_children,
  CASE WHEN NOT has_xcomp THEN NULL WHEN has_expl AND s_lemma = 'there' THEN 'there' WHEN has_expl THEN 'ecm_it' WHEN has_obj THEN 'obj' WHEN s_dep IS NOT NULL THEN 'subj' END AS license FROM ful WHERE pos = 'VERB'""")
def verb_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames, complements, child masks, prepositions and licenses of verbs."""
    full = trees.with_children(conv_tokens(spark, sf_dir), KEY).filter(F.col("pos") == "VERB")
    return full.select(*KEY, "i", "lemma", trees.frame().alias("frame"), trees.complement_kind().alias("comp"), F.col("mask").cast("int").alias("mask"), F.array_join("preps", " ").alias("preps"), "n_children", trees.verb_license().alias("license"))


@query(f"""WITH {CONV}, {_KIDS}
SELECT conv_id, turn, count(*) AS tokens, count(*) FILTER (WHERE NOT regexp_matches(text, '\\p{{L}}') OR pos IN {_in(trees.CLOSED)} OR dep IN ('det', 'nummod', 'predet') OR lemma IN {_in(trees.QUANTIFIERS + trees.MODALS)}) AS functionish,
  count(*) FILTER (WHERE tag = 'NN' AND NOT has_det AND dep <> 'nmod') AS bare FROM ful GROUP BY conv_id, turn""")
def frozen_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that a rewrite leaves alone, and bare singulars."""
    full = trees.with_children(conv_tokens(spark, sf_dir), KEY)
    return full.groupBy(*KEY).agg(F.count(F.lit(1)).alias("tokens"), F.count_if(trees.functionish()).alias("functionish"), F.count_if(trees.bare_singular()).alias("bare"))


@query(f"""WITH {CONV}, ev AS (SELECT conv_id, turn, head AS i, bool_or(lemma IN {_in(trees.EVIDENCE_SINGULAR)}) AS one, bool_or(lemma IN {_in(trees.EVIDENCE_PLURAL)}) AS many FROM tok WHERE dep = 'det' GROUP BY conv_id, turn, head)
SELECT conv_id, turn, i, tag, CASE WHEN one AND NOT many AND tag = 'NNS' THEN 'NN' WHEN many AND NOT one AND tag = 'NN' THEN 'NNS' ELSE tag END AS forced FROM tok LEFT JOIN ev USING (conv_id, turn, i) WHERE tag IN ('NN', 'NNS')""")
def noun_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noun tags corrected by their determiners."""
    return trees.forced_number(conv_tokens(spark, sf_dir), KEY)


@query(f"""WITH {CONV}, v AS (SELECT s.conv_id, s.turn, s.sent, s.i AS subject, s.head AS verb FROM tok s JOIN tok h ON h.conv_id = s.conv_id AND h.turn = s.turn AND h.i = s.head AND h.pos = 'VERB' WHERE s.dep LIKE 'nsubj%')
SELECT v.*, count(n.i) AS n_attractors FROM v LEFT JOIN tok n ON n.conv_id = v.conv_id AND n.turn = v.turn AND n.sent = v.sent AND n.pos IN ('NOUN', 'PROPN') AND n.i > least(subject, verb) AND n.i < greatest(subject, verb) GROUP BY ALL""")
def subject_verb_attractors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects, their verbs and the nouns between."""
    tok = conv_tokens(spark, sf_dir)
    return trees.attractors(tok, trees.subject_verb(tok, KEY), KEY)


def profiles_sql(keys: str, p: str = "") -> str:
    """The structural profiles of sentences, as CTEs that end in `prof`."""
    return f"""
{p}frm AS (SELECT {keys}, sent, string_agg({_FRAME}, ' ' ORDER BY {_FRAME}) AS frames FROM {p}ful WHERE pos = 'VERB' GROUP BY ALL),
{p}cnt AS (SELECT {keys}, sent, count(*) FILTER (WHERE dep = 'expl' AND lemma = 'there') AS there, count(*) FILTER (WHERE dep = 'expl' AND lemma = 'it') AS it,
  count(*) FILTER (WHERE has_aux AND has_xcomp AND has_obj) AS tough, count(*) FILTER (WHERE has_aux AND has_xcomp AND NOT has_obj) AS raising FROM {p}ful GROUP BY ALL),
{p}prof AS (SELECT {p}cnt.*, coalesce(frames, '') AS frames FROM {p}cnt LEFT JOIN {p}frm USING ({keys}, sent))"""


@query(f"WITH {CONV}, {_KIDS}, {profiles_sql('conv_id, turn')} SELECT * FROM prof")
def sentence_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural profiles of sentences."""
    return trees.sentence_profiles(conv_tokens(spark, sf_dir), KEY)


@query(f"""WITH RECURSIVE {BENCH}, up AS (SELECT item_id, i AS top, i FROM tok UNION SELECT u.item_id, t.head AS top, u.i FROM up u JOIN tok t ON t.item_id = u.item_id AND t.i = u.top AND t.head <> t.i)
SELECT item_id, top AS i, min(i) AS first, max(i) AS last FROM up GROUP BY item_id, top""")
def subtree_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reach of every token's subtree."""
    return trees.subtree_spans(bench_tokens(spark, sf_dir), ["item_id"])


@query(f"""WITH {CONV}, g AS (SELECT conv_id, turn, i AS "start", n, array_to_string(list_slice(list(low) OVER (PARTITION BY conv_id, turn, sent ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING), 1, n), ' ') AS phrase,
  count(*) OVER (PARTITION BY conv_id, turn, sent ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS have FROM (SELECT *, lower(text) AS low FROM tok) x, unnest([1, 2, 3]) AS k(n))
SELECT conv_id, turn, "start", 0 AS "end", '' AS phrase FROM g WHERE false
UNION ALL SELECT conv_id, turn, i, i + 2, p FROM (SELECT conv_id, turn, i, lower(text) || ' ' || lead(lower(text)) OVER (PARTITION BY conv_id, turn, sent ORDER BY i) AS p FROM tok) WHERE p IN ('of the', 'in the', 'de la')
UNION ALL SELECT conv_id, turn, i, i + 3, p FROM (SELECT conv_id, turn, i, lower(text) || ' ' || lead(lower(text)) OVER w || ' ' || lead(lower(text), 2) OVER w AS p FROM tok WINDOW w AS (PARTITION BY conv_id, turn, sent ORDER BY i)) WHERE p IN ('and of the')""")
def phrase_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiword expressions of a list.

    Tokens stay in the row of their text, but for those of rows that repeat a key, whose sentences are one.
    """
    phrases = spark.sql("VALUES ('of the'), ('In the'), ('de la'), ('and of the') AS p(phrase)")
    texts = parquet_table(spark, sf_dir, "conversations").select(*KEY, "text")
    twice = stored(texts.groupBy(*KEY).count().filter("count > 1").select(*KEY))
    some, twice = not twice.isEmpty(), twice.hint("merge")  # packed files of keys look small enough to broadcast when they aren't
    same = reduce(and_, (texts[k].eqNullSafe(twice[k]) for k in KEY))
    once = spread(texts.join(twice, same, "left_anti") if some else texts)
    found = trees.phrases_of_words(once.select(*KEY, parsing.words_of().alias("words")), phrases, KEY, parsing.ENDS, 3)
    if some:
        tok = parsing.parse(texts.join(twice, same, "left_semi"), KEY)
        found = found.unionByName(trees.phrase_matches(tok, phrases, KEY, 3))
    return found


@query(f"""WITH {CONV}, n AS (SELECT conv_id, turn, head AS i, dep, count(*) AS n FROM tok WHERE head <> i GROUP BY ALL)
SELECT conv_id, turn, i, string_agg(dep || ':' || n, ' ' ORDER BY dep || ':' || n) AS deps FROM n GROUP BY conv_id, turn, i""")
def child_dependency_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children of each token by relation."""
    return trees.child_dep_counts(conv_tokens(spark, sf_dir), KEY)


@query(f"""WITH {CONV}, r AS (SELECT DISTINCT lower(text) AS word, 'function' AS kind FROM tok WHERE pos IN ('DET', 'ADP', 'PRON', 'AUX') AND regexp_full_match(text, '\\p{{L}}+')
UNION ALL SELECT DISTINCT v.lemma || ' ' || p.lemma, 'particle' FROM tok v JOIN tok p ON p.conv_id = v.conv_id AND p.turn = v.turn AND p.head = v.i AND p.dep = 'prep' WHERE v.pos = 'VERB') SELECT * FROM r""")
def extracted_lexicons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Function words, and verbs with their particles."""
    tok = conv_tokens(spark, sf_dir)
    particles = trees.particle_verbs(tok, KEY).select(F.concat_ws(" ", "verb", "particle").alias("word"), F.lit("particle").alias("kind"))
    return trees.function_words(tok).withColumn("kind", F.lit("function")).unionByName(particles)


@query(f"""WITH {CONV} SELECT conv_id, turn, sent, bool_or(lower(text) IN ('the', 'que') OR lemma IN ('the', 'que')) AS licensed FROM tok GROUP BY ALL""")
def licensed_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that hold one of the listed items."""
    return trees.licensed_sentences(conv_tokens(spark, sf_dir), KEY, ["the", "que"])


@query(f"""WITH {DOCS} SELECT lemma, count(*) FILTER (WHERE tag = 'NNP') AS nnp, count(*) FILTER (WHERE tag = 'NNPS') AS nnps, count(*) FILTER (WHERE tag NOT IN ('NNP', 'NNPS')) AS other FROM tok GROUP BY lemma HAVING count(*) FILTER (WHERE tag IN ('NNP', 'NNPS')) > 0""")
def proper_noun_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag counts of lemmas that are proper nouns somewhere."""
    from glossa.operators.vocabulary import proper_profile

    return proper_profile(doc_tokens(spark, sf_dir))


# contexts

_NORM = "CASE WHEN {0} IN ('START', 'END', 'OTHER', 'NONE') THEN {0} WHEN {0} IN ('-LRB-', '-RRB-') OR regexp_full_match({0}, '[^\\p{{L}}\\p{{N}}]+') THEN 'PUNCT' ELSE {0} END"
_P, _N = _NORM.format("prev_tag"), _NORM.format("next_tag")
_CHAIN = f"""{_KIDS},
cx AS (SELECT f.*, coalesce(lag(f.tag) OVER (PARTITION BY f.conv_id, f.turn, f.sent ORDER BY f.i), 'START') AS prev_tag, coalesce(lead(f.tag) OVER (PARTITION BY f.conv_id, f.turn, f.sent ORDER BY f.i), 'END') AS next_tag,
  CASE WHEN f.i = f.head THEN 'ROOT' WHEN f.i < f.head THEN 'LEFT' ELSE 'RIGHT' END AS relpos, {_FRAME} AS frame, {_COMP} AS comp, tag = 'NN' AND NOT has_det AND dep <> 'nmod' AS bare FROM ful f),
cy AS (SELECT cx.*, h.tag AS head_tag, CASE WHEN mask & 16 = 0 THEN mask & ~8 ELSE mask END AS lm FROM cx JOIN tok h ON h.conv_id = cx.conv_id AND h.turn = cx.turn AND h.i = cx.head),
ch AS (SELECT conv_id, turn, i, lemma, pos, tag, CASE pos
  WHEN 'VERB' THEN ['VERB|' || tag || '|' || frame || '|' || comp || '|' || mask || '|' || head_tag, 'VERB|' || tag || '|' || frame || '|' || comp || '|' || lm || '|' || head_tag, 'VERB|' || tag || '|' || frame || '|' || comp || '|' || lm || '|~']
  WHEN 'NOUN' THEN ['NOUN|' || tag || '|' || bare || '|' || dep]
  WHEN 'ADJ' THEN ['ADJ|' || relpos || '|' || prev_tag || '|' || next_tag || '|' || head_tag, 'ADJ|' || relpos || '|' || {_P} || '|' || {_N} || '|' || head_tag, 'ADJ|' || relpos || '|' || {_P} || '|~|' || head_tag, 'ADJ|' || relpos || '|~|~|' || head_tag, 'ADJ|' || relpos || '|~|~|~', 'ADJ|~|~|~|~']
  WHEN 'ADV' THEN ['ADV|' || prev_tag || '|' || next_tag || '|' || head_tag, 'ADV|' || {_P} || '|' || {_N} || '|' || head_tag, 'ADV|~|~|' || head_tag, 'ADV|~|~|~'] END AS raw FROM cy),
chain0 AS (SELECT * EXCLUDE (raw), list_filter(raw, lambda x, k: list_position(raw, x) = k) AS chain FROM ch),
chain AS (SELECT * FROM chain0 WHERE chain IS NOT NULL)"""


def chained_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of conversations that have a back-off chain.

    Texts are dealt by their keys and their tokens stay there. Rows that repeat a key meet each other's tokens, by joins.
    """
    return chained_texts(keyed_texts(spark, sf_dir))


def keyed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet_table(spark, sf_dir, "conversations").select(*KEY, "text").dropna(subset=KEY)


#: Bytes of a table of texts whose tokens a task sorts at once, in memory.
PIECE = 1 << 20


def chained_once(texts: DataFrame, by: list[str]) -> DataFrame:
    """chained_tokens() of texts that repeat no key, left dealt by the columns `by` of it."""
    return chained(trees.placed_with_children(parsing.parse(texts, KEY, by=by, piece=PIECE), KEY))


def chained_texts(texts: DataFrame) -> DataFrame:
    """chained_tokens() of texts whose keys aren't null."""
    twice = stored(texts.groupBy(*KEY).count().filter("count > 1").select(*KEY))
    some = not twice.isEmpty()
    rows = chained_once(texts.join(twice, KEY, "left_anti") if some else texts, KEY)
    if some:
        tok = stored(parsing.parse(texts.join(twice, KEY, "left_semi"), KEY))
        rows = rows.unionByName(chained(trees.with_children(trees.context(tok, KEY), KEY)))
    return stored(rows)


def chained(full: DataFrame) -> DataFrame:
    rows = full.withColumns({"frame": trees.frame(), "comp": trees.complement_kind(), "bare": trees.bare_singular()})
    return rows.withColumn("chain", context.backoff_chain()).select(*KEY, "i", "lemma", "pos", "tag", "chain").filter("chain is not null")


@query(f"WITH {CONV}, {_CHAIN} SELECT conv_id, turn, i, array_to_string(chain, ' ') AS chain FROM chain")
def backoff_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets of tokens from strict to loose."""
    return chained_tokens(spark, sf_dir).filter("chain is not null").select(*KEY, "i", F.array_join("chain", " ").alias("chain"))


@query(f"WITH {CONV}, {_CHAIN} SELECT chain[1] AS bucket, lower(lemma) AS lemma, count(*) AS n FROM chain GROUP BY ALL")
def context_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lemma counts per strict bucket, counted in two shards and merged."""
    rows = chained_tokens(spark, sf_dir)
    return context.merged_statistics(*(context.lemma_statistics(rows.filter(F.col("conv_id") % 2 == k)) for k in (0, 1)))


_STATS = """
st0 AS (SELECT chain[1] AS bucket, lower(lemma) AS lemma, count(*) AS n FROM chain GROUP BY ALL HAVING count(*) >= 2),
links AS (SELECT DISTINCT chain[1] AS bucket, unnest(chain[2:]) AS coarse FROM chain WHERE len(chain) > 1),
co AS (SELECT coarse AS bucket, lemma, sum(n) AS n FROM st0 JOIN links USING (bucket) WHERE NOT contains(bucket, '|~') AND coarse <> bucket GROUP BY ALL HAVING sum(n) >= 2),
stats AS (SELECT bucket, lemma, CAST(sum(n) AS BIGINT) AS n FROM (SELECT * FROM st0 UNION ALL SELECT * FROM co) GROUP BY ALL)"""


def backoff_statistics(rows: DataFrame) -> DataFrame:
    return stored(context.with_backoff(context.lemma_statistics(rows), context.chains_of(rows), 2))


@query(f"WITH {CONV}, {_CHAIN}, {_STATS} SELECT bucket, lemma, n FROM stats")
def backoff_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict buckets and the coarser ones that they add up to."""
    return backoff_statistics(chained_tokens(spark, sf_dir))


@query(f"WITH {CONV}, {_CHAIN}, {_STATS} SELECT bucket, CAST(sum(n) AS BIGINT) AS s, count(*) AS l FROM stats WHERE n >= 2 GROUP BY bucket")
def bucket_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and lemmas of buckets."""
    return context.level_statistics(backoff_statistics(chained_tokens(spark, sf_dir)), 2)


_POOL = "pool AS (SELECT DISTINCT tag, lemma AS cand FROM chain)"
_REQ = "req AS (SELECT DISTINCT tag || ' ' || chain[1] AS request, tag, chain FROM chain)"
_GATE = f"""{_POOL}, {_REQ},
cand AS (SELECT request, cand FROM req JOIN pool USING (tag)), cn AS (SELECT request, count(*) AS n_orig FROM cand GROUP BY request),
lv AS (SELECT bucket, sum(n) AS s, count(*) AS l FROM stats WHERE n >= 2 GROUP BY bucket),
rl AS (SELECT request, unnest(generate_series(0, len(chain) - 1)) AS level, unnest(chain) AS bucket FROM req),
met AS (SELECT rl.request, rl.level, lv.l, cand.cand, stats.n, cn.n_orig FROM rl JOIN lv USING (bucket) JOIN cand USING (request) JOIN stats ON stats.bucket = rl.bucket AND stats.lemma = cand.cand AND stats.n >= 2 JOIN cn USING (request) WHERE n_orig > 1),
pick AS (SELECT request, coalesce(min(CASE WHEN l >= greatest(2, floor(n_orig * 0.05)) THEN level END), arg_max(level, l * 1000 - level)) AS level FROM met GROUP BY request),
gate AS (SELECT request, cand, n, CAST(level AS INTEGER) AS level FROM met JOIN pick USING (request, level) UNION ALL SELECT request, cand, NULL, -1 FROM cand JOIN cn USING (request) WHERE n_orig <= 1)"""


def tag_pool(rows: DataFrame) -> DataFrame:
    """(tag, cand): all lemmas of each tag."""
    return rows.filter("chain is not null").select("tag", F.col("lemma").alias("cand")).distinct()


def gated_requests(rows: DataFrame) -> DataFrame:
    requests = rows.filter("chain is not null").select(F.concat_ws(" ", "tag", F.get("chain", F.lit(0))).alias("request"), "tag", "chain").distinct()
    return context.gated(requests, settled(tag_pool(rows)), settled(backoff_statistics(rows)), pool="tag")


@query(f"WITH {CONV}, {_CHAIN}, {_STATS}, {_GATE} SELECT request, cand, n, level FROM gate")
def context_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of each context at the first bucket that passes, or the largest."""
    return gated_requests(chained_tokens(spark, sf_dir))


@query(f"""WITH {CONV}, {_CHAIN}, {_STATS}, {_GATE},
r AS (SELECT *, sum(n) OVER (PARTITION BY request ORDER BY n DESC, cand ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS ahead, sum(n) OVER (PARTITION BY request) AS total, row_number() OVER (PARTITION BY request ORDER BY n DESC, cand) AS k FROM gate WHERE n IS NOT NULL)
SELECT request, cand, n FROM r WHERE ahead < 0.8 * total OR k <= 3 OR total <= 0""")
def nucleus_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1: the heaviest candidates that hold 0.8 of the counts, three at least."""
    rows = gated_requests(chained_tokens(spark, sf_dir)).filter("n is not null")
    return context.top_p(rows, ["request"], "n", 0.8, 3, "cand").select("request", "cand", "n")


_U = "((CAST(('0x' || substr(sha256({0}), 1, 12)) AS BIGINT) + 0.5) / 281474976710656.0::DOUBLE)"


@query(f"""WITH {CONV}, {_CHAIN}, {_STATS}, {_GATE},
r AS (SELECT request, cand, row_number() OVER (PARTITION BY request ORDER BY ln({_U.format("'13:' || request || ':' || cand")}) / greatest(coalesce(n, 1)::DOUBLE, 1.0::DOUBLE) DESC, cand) AS k FROM gate)
SELECT request, cand FROM r WHERE k = 1""")
def weighted_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one candidate per context, drawn by weight."""
    rows = gated_requests(chained_tokens(spark, sf_dir))
    return rewriting.weighted_draw(rows, ["request"], "cand", "n", 13).select("request", "cand")


# one mapping per conversation

# candidates that all occurrences of a lemma in a conversation share: those of its strict buckets, else of its tags

_SETS = """
k0 AS (SELECT example, lemma, list({'b': b, 'm': m} ORDER BY b) AS keys FROM (SELECT conv_id AS example, lemma, chain[1] AS b, count(*) AS m FROM chain GROUP BY ALL) GROUP BY example, lemma),
k1 AS (SELECT conv_id AS example, lemma, list(DISTINCT tag ORDER BY tag) AS keys FROM chain GROUP BY ALL),
m0 AS (SELECT keys, s.lemma AS cand, (1000 * sum(e.m * s.n)) // sum(e.m) AS w FROM (SELECT keys, unnest(keys) AS e FROM (SELECT DISTINCT keys FROM k0)) x JOIN stats s ON s.bucket = e.b GROUP BY keys, s.lemma HAVING count(*) = len(keys)),
m1 AS (SELECT keys, p.cand, 1 AS w FROM (SELECT keys, unnest(keys) AS tag FROM (SELECT DISTINCT keys FROM k1)) x JOIN pool p USING (tag) GROUP BY keys, p.cand HAVING count(*) = len(keys)),
mem AS (SELECT 0 AS level, CAST(keys AS VARCHAR) AS st, cand, CAST(greatest(w, 1000) AS BIGINT) AS w FROM m0 UNION ALL SELECT 1, CAST(keys AS VARCHAR), cand, w FROM m1),
plc AS (SELECT *, CAST(sum(w) OVER (PARTITION BY level, st ORDER BY cand ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - w AS start FROM mem),
siz AS (SELECT level, st, CAST(sum(w) AS BIGINT) AS total, count(*) AS n FROM mem GROUP BY ALL),
ask AS (SELECT example, lemma, 0 AS level, CAST(keys AS VARCHAR) AS st FROM k0 UNION ALL SELECT example, lemma, 1, CAST(keys AS VARCHAR) FROM k1),
opn AS (SELECT a.*, o.start AS own_start, o.w AS own_w, total - coalesce(o.w, 0) AS weight, n - (o.w IS NOT NULL)::INTEGER AS n_cands
  FROM ask a JOIN siz USING (level, st) LEFT JOIN plc o ON o.level = a.level AND o.st = a.st AND o.cand = a.lemma),
cset AS (SELECT * FROM opn WHERE n_cands > 0 QUALIFY row_number() OVER (PARTITION BY example, lemma ORDER BY level) = 1)"""


def map_sql(seed: int, attempts: int = 1) -> str:
    """One target per lemma of each conversation and attempt, as CTEs that end in `mp`."""
    draw = _U.format(f"'{seed}:' || example || ':' || lemma" + (" || ':' || attempt" if attempts > 1 else ""))
    return f"""
pt0 AS (SELECT *, CAST(floor({draw} * weight) AS BIGINT) AS x0 FROM cset, (SELECT unnest(generate_series(0, {attempts - 1})) AS attempt) a),
pt AS (SELECT *, x0 + CASE WHEN x0 >= own_start THEN own_w ELSE 0 END AS x FROM pt0),
hit AS (SELECT pt.example, pt.lemma, pt.attempt, plc.cand FROM pt ASOF JOIN plc ON plc.level = pt.level AND plc.st = pt.st AND pt.x >= plc.start),
mp AS (SELECT k.example, k.lemma, k.attempt, coalesce(hit.cand, k.lemma) AS target FROM (SELECT example, lemma, unnest(generate_series(0, {attempts - 1})) AS attempt FROM k1) k LEFT JOIN hit USING (example, lemma, attempt))"""


EACH = ["example", "lemma"]


def in_buckets(rows: DataFrame) -> DataFrame:
    """(example, lemma, tag, bucket): chained tokens in their conversations and strict buckets."""
    return rows.filter("chain is not null").select(F.col("conv_id").alias("example"), "lemma", "tag", F.get("chain", F.lit(0)).alias("bucket"))


def asked_sets(dealt: DataFrame) -> DataFrame:
    """(example, lemma, keys, times, tags): the strict buckets of each lemma of a conversation, how often, and its tags."""
    counted = dealt.groupBy(*EACH, "bucket").agg(F.count(F.lit(1)).alias("m"), F.collect_set("tag").alias("tags"))
    keys = counted.groupBy(*EACH).agg(F.array_sort(F.collect_list(F.struct("bucket", "m"))).alias("k"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"))
    return keys.select(*EACH, F.col("k.bucket").alias("keys"), F.col("k.m").alias("times"), "tags")


def named(c: Column) -> Column:
    """128 bits of a hash of the value."""
    return F.substring(F.sha2(F.to_json(c), 256), 1, 32)


class Choices:
    """For each lemma of a conversation the first level with a candidate beside itself: its strict buckets, else its tags.

    Lemmas that meet the same contexts share a set. Sets of one bucket and of tags are few and placed whole; of sets of
    several buckets, the members that they share are kept in blocks.
    """

    by = EACH

    def __init__(self, rows: DataFrame):
        asked = stored(asked_sets(in_buckets(rows).repartition(*self.by)))
        stats = stored(backoff_statistics(rows).select(F.col("bucket").alias("key"), F.col("lemma").alias("cand"), "n"))

        single = stats.select(F.col("key").alias("set"), "cand", F.greatest(F.col("n") * draws.UNIT, F.lit(draws.UNIT)).cast("long").alias("w"))
        self.single = draws.placed_members(single)
        self.first = stored(draws.measured_requests(asked.filter("size(keys) = 1").select(*self.by, "tags", F.get("keys", F.lit(0)).alias("set")), self.single, "lemma"))

        several = asked.filter("size(keys) > 1").withColumns({"set": named(F.col("keys")), "line": named(F.struct("keys", "times"))})
        shared = draws.shared_members(several.select("set", "keys").dropDuplicates(["set"]), stats)
        blocks = draws.blocks_of(stats)
        self.blocked = stored(draws.blocked_members(shared, blocks))
        lines = draws.lines_of(several.select("line", "set", "times").dropDuplicates(["line"]), self.blocked)
        self.mixed = stored(draws.measured_lines(several, lines, draws.held_keys(stats).join(blocks, "cand"), "lemma"))

        rest = self.first.select(*self.by, "tags", "n_cands").unionByName(self.mixed.select(*self.by, "tags", "n_cands")).filter("n_cands is null or n_cands = 0")
        rest = rest.select(*self.by, "tags", F.array_join("tags", " ").alias("set"))
        pool = stored(rows.filter("chain is not null").select(F.col("tag").alias("key"), F.col("lemma").alias("cand"), F.lit(None).cast("long").alias("n")).distinct())
        loose = draws.shared_members(rest.groupBy("set").agg(F.any_value("tags").alias("keys")), pool)
        self.loose = draws.placed_members(loose.select("set", "cand", F.lit(1).cast("long").alias("w")))
        self.second = stored(draws.measured_requests(rest.drop("tags"), self.loose, "lemma"))
        forget(asked, stats, pool)

    def mapping(self, seed: int, attempt: int | None = None) -> DataFrame:
        """(example, lemma, target): one target per lemma of each conversation; a lemma without a candidate stays."""
        keys = self.by if attempt is None else [*self.by, "attempt"]
        some = lambda d: d.filter("n_cands > 0").withColumn("attempt", F.lit(attempt))
        parts = [draws.drawn(some(self.first), self.single, keys, seed), draws.drawn_from_blocks(some(self.mixed), self.blocked, keys, "lemma", seed), draws.drawn(some(self.second), self.loose, keys, seed)]
        out = self.second.filter("n_cands is null or n_cands = 0").select(*self.by, F.col("lemma").alias("target"))
        for hit in parts:
            out = out.unionByName(hit.select(*self.by, F.col("cand").alias("target")))
        return out

    def forget(self) -> None:
        forget(self.first, self.mixed, self.second, self.single, self.loose, self.blocked)


def drawn_mapping(rows: DataFrame, seed: int) -> DataFrame:
    """(example, lemma, target): one target per lemma of each conversation; a lemma without a candidate stays.

    rows: of stored(); they and all that the mapping is made from are deleted.
    """
    choices = Choices(rows)
    forget(rows)
    out = stored(choices.mapping(seed))
    choices.forget()
    return out


#: Characters of a conversation up to which its tokens are one task's.
WHOLE = 4 << 20

#: Parts in which lemmas meet their counts, one after the other, at most, and bytes of texts for each.
PARTS, PART = 8, 4 << 20


def asked_in_parts(texts: DataFrame) -> tuple[DataFrame, int]:
    """asked_sets() of all conversations with a column `part`, stored, and the number of parts.

    Texts are dealt by their conversation and nothing else is moved. Tokens of long conversations, and of such as repeat
    a turn, are dealt by lemma.
    """
    turns = texts.groupBy(*KEY).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("text")).alias("chars"))
    odd = stored(turns.groupBy("conv_id").agg(F.max("rows").alias("rows"), F.sum("chars").alias("chars")).filter((F.col("rows") > 1) | (F.col("chars") > WHOLE)).select("conv_id"))
    some = not odd.isEmpty()
    asked = asked_sets(in_buckets(chained_once(texts.join(odd, "conv_id", "left_anti") if some else texts, ["conv_id"])))
    if some:
        rest = chained_texts(texts.join(odd, "conv_id", "left_semi"))
        asked = asked.unionByName(asked_sets(in_buckets(rest)))
    parts = min(PARTS, max(1, -(-size_of(texts) // PART)))
    asked = stored(asked.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(parts))), by="part")
    forget(odd, *([rest] if some else []))
    return asked, parts


def tag_sets(asked: DataFrame) -> DataFrame:
    """(tags, n): how many lemmas have all tags of each set that is asked for."""
    held = asked.select("lemma", F.explode("tags").alias("tag")).distinct().groupBy("lemma").agg(F.array_sort(F.collect_list("tag")).alias("held"))
    kinds = held.groupBy("held").agg(F.count(F.lit(1)).alias("n"))
    # as few rows on both sides as there are sets of tags
    met = asked.select("tags").distinct().join(F.broadcast(kinds), F.size(F.array_except("tags", "held")) == 0)
    return met.groupBy("tags").agg(F.sum("n").alias("n"))


def first_levels(asked: DataFrame, single: DataFrame, sizes: DataFrame, held: DataFrame, lines: DataFrame, loose: DataFrame) -> DataFrame:
    """(example, lemma, level, n_cands, weight): the first level of each lemma that has a candidate beside itself.

    single: set, lemma, own_w, for lemmas of one bucket, and its sizes; held: of held_keys(), and lines: of line_sums(),
    for those of several; loose: of tag_sets(). A lemma has all its tags itself, and its line of tags counts each member
    once.
    """
    one = draws.beside_own(asked.filter("size(keys) = 1").select(*EACH, "tags", F.get("keys", F.lit(0)).alias("set")), sizes, single, "lemma")
    several = asked.filter("size(keys) > 1").withColumn("line", named(F.struct("keys", "times")))
    rows = one.select(*EACH, "tags", "n_cands", "weight").unionByName(draws.measured_lines(several, lines, held.withColumn("block", F.lit(0)), "lemma").select(*EACH, "tags", "n_cands", "weight"))
    rows = rows.join(F.broadcast(loose.withColumn("beside", F.col("n") - 1).drop("n")), "tags", "left")
    strict = F.coalesce(F.col("n_cands") > 0, F.lit(False))
    level = lambda a, b: F.when(strict, a).otherwise(b)
    rows = rows.select(*EACH, level(F.lit(0), F.lit(1)).alias("level"), level(F.col("n_cands"), F.col("beside")).alias("n_cands"), level(F.col("weight"), F.col("beside")).alias("weight"))
    return rows.filter("n_cands > 0")


@query(f"WITH {CONV}, {_CHAIN}, {_STATS}, {_POOL}, {_SETS} SELECT example, lemma, level, n_cands, weight FROM cset")
def lockstep_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates that all occurrences of a lemma in a conversation share: their level, number and weight."""
    asked, parts = asked_in_parts(keyed_texts(spark, sf_dir))
    strict = stored(asked.select(F.lower("lemma").alias("lemma"), F.inline(F.arrays_zip(F.col("keys").alias("bucket"), F.col("times").alias("m")))).groupBy("bucket", "lemma").agg(F.sum("m").alias("n")).filter("n > 1"))
    fields = stored(context.key_fields(strict.select("bucket").distinct()))
    links = context.chains_of(fields.withColumn("chain", context.backoff_chain()))
    stats = stored(context.with_backoff(strict, links, 2).select(F.col("bucket").alias("key"), F.col("lemma").alias("cand"), "n"))
    variants = stored(asked.filter("size(keys) > 1").select("keys", "times").distinct().withColumn("line", named(F.struct("keys", "times"))))
    lines, loose = stored(draws.line_sums(variants, stats)), stored(tag_sets(asked))
    single = stats.select(F.col("key").alias("set"), F.col("cand").alias("lemma"), F.greatest(F.col("n") * draws.UNIT, F.lit(draws.UNIT)).cast("long").alias("own_w"))
    sizes = stored(single.groupBy("set").agg(F.sum("own_w").alias("total"), F.count(F.lit(1)).alias("n")))
    held = stored(draws.held_keys(stats))
    found = [stored(first_levels(asked.filter(F.col("part") == k), single, sizes, held, lines, loose)) for k in range(parts)]
    forget(asked, strict, fields, variants, stats, sizes, held, lines, loose)
    return reduce(DataFrame.unionByName, found)


@query(f"WITH {CONV}, {_CHAIN}, {_STATS}, {_POOL}, {_SETS}, {map_sql(17)} SELECT example, lemma, target FROM mp")
def lemma_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One target per lemma of each conversation."""
    return drawn_mapping(chained_tokens(spark, sf_dir), 17)


_INF = r"""CASE WHEN tag IN ('NNS', 'NNPS', 'VBZ') THEN CASE WHEN regexp_matches(target, '(s|x|z|ch|sh)$') THEN target || 'es' WHEN regexp_matches(target, '[^aeiou]y$') THEN substr(target, 1, length(target) - 1) || 'ies' ELSE target || 's' END
  WHEN tag IN ('VBD', 'VBN') THEN CASE WHEN suffix(target, 'e') THEN target || 'd' ELSE target || 'ed' END
  WHEN tag = 'VBG' THEN CASE WHEN suffix(target, 'ie') THEN substr(target, 1, length(target) - 2) || 'ying' WHEN suffix(target, 'e') AND length(target) > 1 THEN substr(target, 1, length(target) - 1) || 'ing' ELSE target || 'ing' END ELSE target END"""


def render_sql(tokens: str, fixed: str) -> str:
    """The texts of tokens (with an attempt) under the mapping `mp`, as CTEs that end in `ren`; fixed tokens stay.

    A sharp s in upper case is SS, as in Unicode's full mapping.
    """
    up = lambda x: f"upper(replace({x}, 'ß', 'SS'))"
    title = lambda x: f"{up(f'substr({x}, 1, 1)')} || lower(substr({x}, 2))"
    return rf"""
rj AS (SELECT t.*, m.target, {_INF} AS inf FROM {tokens} t LEFT JOIN mp m ON m.example = t.conv_id AND m.lemma = t.lemma AND m.attempt = t.attempt),
rk AS (SELECT *, CASE WHEN text = {up('text')} AND {up('text')} <> lower(text) THEN {up('inf')} WHEN text = lower(text) AND {up('text')} <> lower(text) THEN lower(inf)
  WHEN {up('text')} <> lower(text) AND text = {title('text')} THEN {title('inf')} WHEN {up('substr(text, 1, 1)')} = substr(text, 1, 1) AND lower(substr(text, 1, 1)) <> substr(text, 1, 1) THEN {up('substr(inf, 1, 1)')} || substr(inf, 2) ELSE inf END AS cased FROM rj),
rf AS (SELECT conv_id, turn, attempt, i, CASE WHEN target IS NULL OR target = lemma OR {fixed} THEN text WHEN is_start THEN {up('substr(cased, 1, 1)')} || substr(cased, 2) ELSE cased END AS form,
  CASE WHEN i = 0 OR regexp_full_match(text, '[.,!?;:)\]]') THEN '' ELSE ' ' END AS gap FROM rk),
ren AS (SELECT conv_id, turn, attempt, string_agg(gap || form, '' ORDER BY i) AS text FROM rf GROUP BY conv_id, turn, attempt)"""


_OPEN = ("NOUN", "VERB", "ADJ", "ADV")
_DRAWN = f"{CONV}, {_CHAIN}, {_STATS}, {_POOL}, {_SETS}"


@query(f"WITH {_DRAWN}, {map_sql(17)}, {render_sql('(SELECT *, 0 AS attempt FROM tok)', f'pos NOT IN {_in(_OPEN)}')} SELECT conv_id, turn, text FROM ren")
def rewritten_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations rendered under one mapping each."""
    mapping = drawn_mapping(chained_tokens(spark, sf_dir), 17)
    tok = conv_tokens(spark, sf_dir)
    fixed = tok.withColumn("fixed", ~F.col("pos").isin(*_OPEN))
    out = rewriting.render(fixed, mapping, KEY, "conv_id").select("conv_id", "turn", "text")
    forget(tok, mapping)
    return out


#: How often a text is rewritten anew where the structure of a sentence isn't kept.
ATTEMPTS = 3


@query(f"""WITH {_DRAWN}, {profiles_sql('conv_id, turn')}, {map_sql(19, ATTEMPTS)}, att AS (SELECT unnest(generate_series(0, {ATTEMPTS - 1})) AS attempt), toks AS (SELECT * FROM tok, att),
{render_sql('toks', f'pos NOT IN {_in(_OPEN)}')}, {tokens_sql('ren', 'conv_id, turn, attempt', 'n')}, {kids_sql('conv_id, turn, attempt', 'n')}, {profiles_sql('conv_id, turn, attempt', 'n')},
own AS (SELECT conv_id, turn, attempt, sent, [frames, there::VARCHAR, it::VARCHAR, tough::VARCHAR, raising::VARCHAR] AS v FROM prof, att), new AS (SELECT conv_id, turn, attempt, sent, [frames, there::VARCHAR, it::VARCHAR, tough::VARCHAR, raising::VARCHAR] AS v FROM nprof),
ok AS (SELECT conv_id, turn, attempt, bool_and(own.v IS NOT DISTINCT FROM new.v) AS valid FROM own FULL JOIN new USING (conv_id, turn, attempt, sent) GROUP BY conv_id, turn, attempt),
best AS (SELECT conv_id, turn, coalesce(min(attempt) FILTER (WHERE valid), {ATTEMPTS - 1}) AS attempt FROM ok GROUP BY conv_id, turn)
SELECT conv_id, turn, CAST(attempt AS INTEGER) AS attempt, valid, text FROM best JOIN ok USING (conv_id, turn, attempt) JOIN ren USING (conv_id, turn, attempt)""")
def validated_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts rewritten until a new parse keeps the structure of every sentence, else the last attempt."""
    rows = chained_tokens(spark, sf_dir)
    choices = Choices(rows)
    forget(rows)
    tok = conv_tokens(spark, sf_dir)
    fixed = tok.withColumn("fixed", ~F.col("pos").isin(*_OPEN))
    out = rewriting.validated(fixed, lambda attempt: choices.mapping(19, attempt), lambda texts: parsing.parse(texts, KEY), KEY, "conv_id", ATTEMPTS)
    choices.forget()
    forget(tok)
    return out


_PLACES = r"""
ws AS (SELECT conv_id, turn, unnest(regexp_extract_all(coalesce(text, ''), '\s*(?:\p{L}+(?:[''’]\p{L}+)*|\p{Nd}+|[^\s\p{L}\p{Nd}])')) AS piece, unnest(generate_series(0, len(regexp_extract_all(coalesce(text, ''), '\s*(?:\p{L}+(?:[''’]\p{L}+)*|\p{Nd}+|[^\s\p{L}\p{Nd}])')) - 1)) AS i FROM conversations),
wp AS (SELECT conv_id, turn, CAST(i AS INTEGER) AS i, CAST(sum(length(piece)) OVER (PARTITION BY conv_id, turn ORDER BY i) AS INTEGER) AS char_end, length(regexp_replace(piece, '^\s+', '')) AS n FROM ws)"""
#: What the query freezes: the first characters of every turn, and these lemmas.
FROZEN_CHARS, FROZEN_LEMMAS = 24, ("the", "ea", "en", "que")


@query(f"""WITH {_DRAWN}, {map_sql(17)}, {_PLACES}, toks AS (SELECT t.*, 0 AS attempt, (wp.char_end - n < {FROZEN_CHARS} OR t.lemma IN {_in(FROZEN_LEMMAS)}) AS frozen FROM tok t JOIN wp USING (conv_id, turn, i)),
{render_sql('toks', f'frozen OR pos NOT IN {_in(_OPEN)}')} SELECT r.conv_id, r.turn, r.text, CAST(z.n AS BIGINT) AS n_frozen FROM ren r JOIN (SELECT conv_id, turn, count(*) FILTER (WHERE frozen) AS n FROM toks GROUP BY ALL) z USING (conv_id, turn)""")
def frozen_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations rendered with frozen character ranges and lemmas as they stand."""
    texts = parquet_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    mapping = drawn_mapping(chained_tokens(spark, sf_dir), 17)
    tok = stored(parsed_conversations(spark, sf_dir).join(parsing.token_places(texts, KEY), [*KEY, "i"]))
    ranges = texts.select(*KEY, F.lit(0).alias("start"), F.lit(FROZEN_CHARS).alias("end"))
    lemmas = spark.createDataFrame([(x,) for x in FROZEN_LEMMAS], "lemma string")
    marked = stored(spans.marked_frozen(tok, ranges, lemmas, KEY).drop("char_start", "char_end"))
    fixed = marked.withColumn("fixed", F.col("frozen") | ~F.col("pos").isin(*_OPEN))
    out = rewriting.render(fixed, mapping, KEY, "conv_id").select(*KEY, "text")
    counts = stored(marked.groupBy(*KEY).agg(F.count_if("frozen").alias("n_frozen")))
    forget(tok, mapping, marked)
    return out.join(counts, KEY)


# pools, from lists that are made of the corpus

_LISTS = "pl AS (SELECT lemma, ['MASS', 'COUNT', 'BOTH', 'PLURAL_ONLY'][1 + length(lemma) % 4] AS bucket FROM tok WHERE pos = 'NOUN' GROUP BY lemma)"
_SLOT = "slot AS (SELECT DISTINCT lemma || '/' || tag || '/' || (dep = 'nsubj') AS request, lemma, tag, dep = 'nsubj' AS bare FROM tok WHERE tag IN ('NN', 'NNS'))"
_RULES = "rules(tag, bare, source, target) AS (VALUES " + ", ".join(f"('{tag}', {str(bare).lower()}, '{s}', '{t}')" for (tag, b), m in pools.SLOTS.items() for bare in ((b,) if b is not None else (True, False)) for s, ts in m.items() for t in ts) + ")"


def noun_lists(tok: DataFrame) -> DataFrame:
    kinds = F.array(*map(F.lit, ("MASS", "COUNT", "BOTH", "PLURAL_ONLY")))
    return tok.filter("pos = 'NOUN'").select("lemma").distinct().select("lemma", F.get(kinds, F.length("lemma") % 4).alias("bucket"))


@query(f"""WITH {BENCH}, {_LISTS}, {_SLOT}, {_RULES},
c AS (SELECT DISTINCT s.request, c.lemma AS cand FROM slot s LEFT JOIN pl o USING (lemma) JOIN rules r ON r.tag = s.tag AND r.bare = s.bare AND r.source = coalesce(o.bucket, 'UNKNOWN') JOIN pl c ON c.bucket = r.target WHERE c.lemma <> s.lemma),
k AS (SELECT request, cand, row_number() OVER (PARTITION BY request ORDER BY cand) - 1 AS place, count(*) OVER (PARTITION BY request) AS n_cands FROM c)
SELECT request, n_cands, cand FROM k WHERE place = CAST(floor({_U.format("'29:' || request")} * n_cands) AS BIGINT)""")
def noun_slot_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many candidates countability, tag and bareness leave to a slot, and one of them."""
    tok = bench_tokens(spark, sf_dir)
    bare = F.col("dep") == "nsubj"
    slots = tok.filter("tag in ('NN', 'NNS')").select(F.concat_ws("/", "lemma", "tag", bare.cast("string")).alias("request"), "lemma", "tag", bare.alias("bare")).distinct()
    requests, members = pools.noun_sets(slots, noun_lists(tok))
    placed = draws.placed_members(members)
    asked = settled(draws.open_requests(requests, placed, "lemma"))
    return asked.select("request", "n_cands").join(draws.drawn(asked, placed, ["request"], 29), "request")


@query(f"""WITH {BENCH}, {_LISTS} SELECT DISTINCT number, lemma FROM (SELECT lemma, unnest(CASE bucket WHEN 'MASS' THEN ['NN'] WHEN 'PLURAL_ONLY' THEN ['NNS'] ELSE ['NN', 'NNS'] END) AS number FROM pl)""")
def broad_noun_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broad pools by number."""
    return pools.broad_pools(noun_lists(bench_tokens(spark, sf_dir)))


@query(f"""WITH {CONV}, {_KIDS}, fr AS (SELECT DISTINCT lemma AS verb, {_FRAME} AS key, {_COMP} AS comp, preps, CASE WHEN has_aux THEN ['aux'] ELSE [] END AS flags FROM ful WHERE pos = 'VERB'),
q AS (SELECT DISTINCT key || ' ' || comp || ' ' || array_to_string(preps, '+') AS request, key, comp, preps FROM fr),
m AS (SELECT q.request, f.verb, CASE WHEN q.preps = f.preps AND len(f.flags) = 0 THEN 1 WHEN list_has_all(f.preps, q.preps) AND len(f.flags) = 0 THEN 2 WHEN q.preps = f.preps AND len(f.flags) = 0 THEN 3 END AS step FROM q JOIN fr f USING (key, comp)),
b AS (SELECT request, min(step) AS step FROM m GROUP BY request)
SELECT DISTINCT request, verb, step FROM m JOIN b USING (request, step)""")
def verb_frame_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verbs of a frame by prepositions and flags, in three steps."""
    full = trees.with_children(conv_tokens(spark, sf_dir), KEY).filter("pos = 'VERB'")
    none = F.array().cast("array<string>")
    flags = F.when(F.col("has_aux"), F.array(F.lit("aux"))).otherwise(none)
    frames = full.select(F.col("lemma").alias("verb"), trees.frame().alias("key"), trees.complement_kind().alias("comp"), "preps", flags.alias("flags"), flags.alias("protected")).distinct()
    requests = frames.select(F.concat_ws(" ", "key", "comp", F.array_join("preps", "+")).alias("request"), "key", "comp", "preps", none.alias("flags")).distinct()
    return pools.verbs_for_shape(requests, frames)


_LEX = """lex AS (SELECT lemma, list_sort(list_distinct(list(CASE dep WHEN 'conj' THEN 'raising' WHEN 'xcomp' THEN 'subject_control' ELSE 'ecm' END))) AS tags, list_sort(list_distinct(list(CASE length(text) % 2 WHEN 0 THEN 'subj' ELSE 'obj' END))) AS licenses FROM tok WHERE pos = 'VERB' GROUP BY lemma)"""


def verb_lexicon(tok: DataFrame) -> DataFrame:
    from glossa.sources.readers import merged_lexicon

    tag = F.when(F.col("dep") == "conj", "raising").when(F.col("dep") == "xcomp", "subject_control").otherwise("ecm")
    held = F.when(F.length("text") % 2 == 0, "subj").otherwise("obj")
    return merged_lexicon(tok.filter("pos = 'VERB'").select("lemma", F.array(tag).alias("tags"), F.array(held).alias("licenses")))


@query(f"WITH {BENCH}, {_LEX} SELECT lemma, array_to_string(tags, ' ') AS tags, array_to_string(licenses, ' ') AS licenses FROM lex WHERE list_has_all(licenses, ['subj'])")
def licensed_verbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A merged lexicon and its entries that hold a license."""
    lex = pools.holding(verb_lexicon(bench_tokens(spark, sf_dir)), ["subj"])
    return lex.select("lemma", F.array_join("tags", " ").alias("tags"), F.array_join("licenses", " ").alias("licenses"))


@query(f"""WITH {BENCH}, {_LEX}, r AS (SELECT lemma, unnest(licenses) AS license, tags FROM lex),
t AS (SELECT lemma, license, CASE license WHEN 'subj' THEN CASE WHEN list_contains(tags, 'subject_control') THEN 'subject_control' WHEN list_contains(tags, 'raising') THEN 'raising' END
  ELSE CASE WHEN list_contains(tags, 'object_control') THEN 'object_control' WHEN list_contains(tags, 'ecm') THEN 'ecm' END END AS tag FROM r)
SELECT DISTINCT t.lemma || '/' || t.license AS request, x.lemma AS cand FROM t JOIN lex x ON list_contains(x.tags, t.tag) AND list_contains(x.licenses, t.license) AND x.lemma <> t.lemma""")
def infinitive_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replacements with the same tag and license."""
    lex = verb_lexicon(bench_tokens(spark, sf_dir))
    requests = lex.select("lemma", F.explode("licenses").alias("license")).withColumn("request", F.concat_ws("/", "lemma", "license"))
    return pools.same_tag_pool(requests, lex)


@query(f"""WITH {CONV}, v AS (SELECT DISTINCT lemma AS verb FROM tok WHERE tag = 'VB'), f AS (SELECT DISTINCT lower(text) AS form FROM tok WHERE tag = 'VBD'),
g AS (SELECT form, 1 AS r, CASE WHEN suffix(form, 'ied') THEN substr(form, 1, length(form) - 3) || 'y' END AS verb FROM f UNION ALL SELECT form, 2, substr(form, 1, length(form) - 2) FROM f UNION ALL SELECT form, 3, substr(form, 1, length(form) - 1) FROM f UNION ALL SELECT form, 4, substr(form, 1, length(form) - 2) || 'e' FROM f)
SELECT form, arg_min(verb, r) AS verb FROM g WHERE verb IN (SELECT verb FROM v) GROUP BY form""")
def participle_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known verbs that participles come from."""
    tok = conv_tokens(spark, sf_dir)
    verbs = tok.filter("tag = 'VB'").select(F.col("lemma").alias("verb")).distinct()
    forms = tok.filter("tag = 'VBD'").select(F.lower("text").alias("form")).distinct()
    return pools.base_of_participle(forms, verbs, spark.createDataFrame([], "form string, verb string"))


@query(f"""WITH {DOCS}, l AS (SELECT lower(text) AS low, min(CASE length(text) % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END) AS r FROM tok WHERE is_start AND pos <> 'PUNCT' GROUP BY 1)
SELECT DISTINCT t.text AS name, ['m', 'f', 'n'][l.r] AS gender FROM tok t LEFT JOIN l ON l.low = lower(t.text) WHERE t.pos = 'PROPN'""")
def name_genders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of three lists that holds a name."""
    tok = doc_tokens(spark, sf_dir)
    kinds = F.array(F.lit("m"), F.lit("f"), F.lit("n"))
    lists = tok.filter("is_start and pos <> 'PUNCT'").select(F.col("text").alias("name"), F.get(kinds, F.length("text") % 3).alias("gender"))
    return pools.gender_of(tok.filter("pos = 'PROPN'").select(F.col("text").alias("name")).distinct(), lists).select("name", "gender")


@query(f"""WITH {CONV}, v AS (SELECT DISTINCT lower(unnest(regexp_split_to_array(text, '\\s+'))) AS lemma FROM benchmark)
SELECT DISTINCT tag, lemma FROM tok WHERE pos IN ('NOUN', 'VERB', 'ADJ', 'ADV') AND lemma IN (SELECT lemma FROM v) AND lemma NOT IN (SELECT lemma FROM tok WHERE pos IN ('DET', 'ADP', 'PRON', 'AUX'))""")
def allowed_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lemmas by tag inside a vocabulary and outside the closed classes."""
    tok = conv_tokens(spark, sf_dir)
    vocab = parquet_table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", r"\s+")).alias("w")).select(F.lower("w").alias("lemma"))
    pool = tok.filter("pos in ('NOUN', 'VERB', 'ADJ', 'ADV')").select("tag", "lemma").distinct()
    return pools.allowed(pool, vocab, tok.filter("pos in ('DET', 'ADP', 'PRON', 'AUX')").select("lemma")).select("tag", "lemma")


# spans

_SPANS = "sp AS (SELECT doc_id % 50 AS doc, CAST(n_chars % 400 AS INTEGER) AS s, CAST(n_chars % 400 + 1 + doc_id % 23 AS INTEGER) AS e, ['weak', 'strong', 'guarded', 'odd'][1 + doc_id % 4] AS strength FROM documents)"


def some_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = parquet_table(spark, sf_dir, "documents")
    start = (F.col("n_chars") % 400).cast("int")
    return d.select((F.col("doc_id") % 50).alias("doc"), start.alias("start"), (start + 1 + F.col("doc_id") % 23).cast("int").alias("end"), F.get(F.array(*map(F.lit, ("weak", "strong", "guarded", "odd"))), (F.col("doc_id") % 4).cast("int")).alias("strength"))


@query(f"""WITH {_SPANS}, a AS (SELECT doc, s, e, max(e) OVER (PARTITION BY doc ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sp),
b AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM a)
SELECT doc, min(s) AS "start", max(e) AS "end" FROM b GROUP BY doc, g""")
def merged_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """overlapping and touching spans as one."""
    return spans.merged_spans(some_spans(spark, sf_dir).select("doc", "start", "end"), ["doc"])


@query(f"""WITH {_SPANS} SELECT doc, place, ['weak', 'conservative', 'guarded', 'strong'][1 + max(CASE strength WHEN 'weak' THEN 0 WHEN 'conservative' THEN 1 WHEN 'guarded' THEN 2 ELSE 3 END)] AS strength
FROM (SELECT doc, strength, unnest(generate_series(s, e - 1)) AS place FROM sp) GROUP BY doc, place""")
def covering_strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: the strongest cover of every place."""
    return spans.covering_strength(some_spans(spark, sf_dir), ["doc"]).select("doc", F.col("place").cast("long").alias("place"), "strength")


_PLACED = "pt AS (SELECT item_id % 50 AS doc, i, lemma, 7 * i AS cs, CAST(7 * i + length(text) AS BIGINT) AS ce FROM tok)"


@query(f"""WITH {BENCH}, {_SPANS}, {_PLACED} SELECT doc, i, lemma, cs AS char_start, ce AS char_end FROM pt WHERE lemma NOT IN ('the', 'la') AND NOT EXISTS (SELECT 1 FROM sp WHERE sp.doc = pt.doc AND sp.s < pt.ce AND pt.cs < sp.e)""")
def unfrozen_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens outside frozen ranges and lemmas, by an equi-join on cells."""
    tok = bench_tokens(spark, sf_dir).select((F.col("item_id") % 50).alias("doc"), "i", "lemma", (7 * F.col("i")).alias("char_start"), (7 * F.col("i") + F.length("text")).cast("long").alias("char_end"))
    lemmas = spark.createDataFrame([("the",), ("la",)], "lemma string")
    return spans.without_frozen(tok, some_spans(spark, sf_dir), lemmas, "doc", 32).select("doc", "i", "lemma", "char_start", "char_end")


@query(f"""WITH {BENCH}, t AS (SELECT item_id, i, 7 * i AS s, 7 * i + length(text) AS e FROM tok)
SELECT item_id, i, CAST(CASE WHEN s = 0 AND e = 0 THEN 0 ELSE 1 + (CASE WHEN e - 1 >= 30 THEN 1 ELSE 0 END) + (CASE WHEN e - 1 >= 75 THEN 1 ELSE 0 END) + (CASE WHEN e - 1 >= 100000 THEN 1 ELSE 0 END) END AS INTEGER) AS region FROM t""")
def token_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region of each token by its last byte."""
    start = 7 * F.col("i")
    return bench_tokens(spark, sf_dir).select("item_id", "i", spans.region_of(start, start + F.length("text"), F.array(F.lit(0), F.lit(30), F.lit(75)), F.lit(100000)).alias("region"))


@query(f"""WITH {BENCH}, w AS (SELECT item_id, i AS word, 7 * i AS s, 7 * i + length(text) AS e FROM tok), p AS (SELECT item_id, 5 * i AS ps, 5 * i + 4 AS pe, i AS piece FROM tok),
g AS (SELECT w.item_id, word, list_sort(coalesce(list(piece) FILTER (WHERE s < pe AND ps < e), [])) AS pieces, min(CASE WHEN ps >= s THEN piece END) AS after FROM w JOIN p USING (item_id) GROUP BY ALL)
SELECT item_id, word, array_to_string(CASE WHEN len(pieces) > 0 THEN pieces WHEN after IS NOT NULL THEN [after] ELSE pieces END, ' ') AS pieces FROM g""")
def word_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-tokens of each word by overlap."""
    tok = bench_tokens(spark, sf_dir)
    words = tok.select("item_id", F.col("i").alias("word"), (7 * F.col("i")).alias("start"), (7 * F.col("i") + F.length("text")).alias("end"))
    parts = tok.select("item_id", F.col("i").alias("piece"), (5 * F.col("i")).alias("p_start"), (5 * F.col("i") + 4).alias("p_end"))
    return spans.word_groups(words, parts, "item_id").select("item_id", "word", F.array_join(F.transform("pieces", lambda x: x.cast("string")), " ").alias("pieces"))
