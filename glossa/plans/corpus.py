"""Queries on the corpus: slicing, sampling, vocabulary, packing and entropy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.operators import entropy, slicing, vocabulary
from glossa.plans.registry import query
from glossa.session import settled
from glossa.sources.readers import parquet_table, spread

#: The words of the oracle: lower case, as T.tokenize.
TOKENS = r"regexp_extract_all(lower(text), '\p{L}+(?:[''’]\p{L}+)*|\p{Nd}+')"
PIECES = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"
U = "((CAST(('0x' || substr(sha256({0}), 1, 12)) AS BIGINT) + 0.5) / 281474976710656.0::DOUBLE)"
MAX_N = 3


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet_table(spark, sf_dir, "documents")


def texts_of(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of documents for queries that work on every character."""
    return spread(docs_of(spark, sf_dir).select(*columns))


_GRAMS = f"""
d AS (SELECT doc_id, lang, {TOKENS} AS t FROM documents),
g AS (
  SELECT lang, k.n AS n, array_to_string(list_slice(t, i, i + k.n - 1), ' ') AS gram
  FROM d, (SELECT unnest([1, 2, 3]) AS n) k, unnest(generate_series(1, len(t) - k.n + 1)) AS s(i)),
c AS (SELECT lang, n, gram, count(*) AS c FROM g GROUP BY lang, n, gram),
z AS (SELECT lang, n, sum(c) AS total, count(*) AS types, count(*) FILTER (WHERE c = 1) AS f1 FROM c GROUP BY lang, n),
y AS (SELECT *, 1 - (CASE WHEN f1 < total THEN f1 ELSE total - 1 END) / total::DOUBLE AS cov FROM z),
e AS (
  SELECT c.lang, c.n, any_value(total) AS total, any_value(types) AS types, any_value(f1) AS f1, any_value(cov) AS cov,
    sum(-(c / total::DOUBLE) * log2(c / total::DOUBLE)) AS plugin,
    sum(CASE WHEN cov > 0 THEN -(cov * c / total) * log2(cov * c / total) / (1 - pow(1 - cov * c / total, total::DOUBLE)) END) AS cs
  FROM c JOIN y ON c.lang IS NOT DISTINCT FROM y.lang AND c.n = y.n GROUP BY c.lang, c.n)"""


@query(f"""WITH {_GRAMS}
SELECT lang, n, round(plugin, 6) AS block_entropy, round(plugin - coalesce(lag(plugin) OVER (PARTITION BY lang ORDER BY n), 0), 6) AS h FROM e""")
def entropy_curve_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entropy curve of each language up to trigrams."""
    docs = texts_of(spark, sf_dir, "lang", "text").select("lang", T.tokenize(F.col("text")).alias("tokens"))
    out = entropy.curve(entropy.block_entropies(docs, MAX_N, ["lang"]), ["lang"])
    return out.select("lang", "n", F.round("plugin", 6).alias("block_entropy"), F.round("h_plugin", 6).alias("h"))


@query(f"""WITH {_GRAMS}
SELECT lang, n, CAST(total AS BIGINT) AS total, types, f1 AS singletons, round(plugin, 6) AS plugin,
  round(plugin + (types - 1) / (2 * total * ln(2)), 6) AS miller_madow, round(CASE WHEN cov > 0 THEN cs ELSE 'nan'::DOUBLE END, 6) AS chao_shen,
  round(cov, 9) AS coverage, round(types / total::DOUBLE, 9) AS saturation, round(log2(types), 6) AS max_entropy FROM e""")
def entropy_estimators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All estimators and diagnostics by language and order."""
    docs = texts_of(spark, sf_dir, "lang", "text").select("lang", T.tokenize(F.col("text")).alias("tokens"))
    out = entropy.block_entropies(docs, MAX_N, ["lang"])
    six = [F.round(c, 6).alias(c) for c in ("plugin", "miller_madow", "chao_shen", "max_entropy")]
    return out.select("lang", "n", "total", "types", "singletons", *six, F.round("coverage", 9).alias("coverage"), F.round("saturation", 9).alias("saturation"))


@query(f"""WITH d AS (SELECT lang, doc_id, {TOKENS} AS t FROM documents),
a AS (SELECT *, len(t) AS n_tokens, sum(len(t)) OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, len(t) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - len(t) AS ahead FROM d WHERE len(t) > 0),
b AS (SELECT min(s) AS budget FROM (SELECT sum(n_tokens) AS s FROM a GROUP BY lang)),
w AS (SELECT lang, unnest(list_slice(t, 1, CAST(least(budget - ahead, n_tokens) AS BIGINT))) AS w FROM a, b WHERE ahead < budget),
c AS (SELECT lang, w, count(*) AS c FROM w GROUP BY lang, w), z AS (SELECT lang, sum(c) AS total FROM c GROUP BY lang)
SELECT c.lang AS lang, CAST(any_value(total) AS BIGINT) AS words, count(*) AS word_types, round(sum(-(c / total::DOUBLE) * log2(c / total::DOUBLE)), 6) AS h1 FROM c JOIN z ON c.lang IS NOT DISTINCT FROM z.lang GROUP BY c.lang""")
def entropy_matched_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram entropy of each language at the size of the smallest one."""
    docs = texts_of(spark, sf_dir, "lang", "doc_id", "text")
    lengths = settled(entropy.stream_lengths(docs, ["lang"], ["doc_id"]))
    sums = lengths.groupBy("lang").agg(F.sum("words").alias("s"))
    least = sums.agg(F.min("s").alias("budget"))
    budgets = settled(sums.crossJoin(F.broadcast(least)).select("lang", F.lit(1).alias("part"), "budget"))  # one row
    cut = entropy.budgeted(docs, lengths, budgets, ["lang"], ["doc_id"])
    counts = cut.select("lang", F.explode("tokens").alias("w")).groupBy("lang", "w").agg(F.count(F.lit(1)).alias("c"))
    return entropy.estimates(counts, ["lang"]).select("lang", F.col("total").alias("words"), F.col("types").alias("word_types"), F.round("plugin", 6).alias("h1"))


@query(f"""WITH d AS (SELECT lang, doc_id, {TOKENS} AS t FROM documents),
a AS (SELECT *, len(t) AS n_tokens, sum(len(t)) OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, len(t) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - len(t) AS ahead, sum(len(t)) OVER (PARTITION BY lang) AS all_t FROM d WHERE len(t) > 0),
l AS (SELECT *, unnest([1, 2, 4, 8]) AS part FROM a),
w AS (SELECT lang, part, unnest(list_slice(t, 1, CAST(least(all_t // part - ahead, n_tokens) AS BIGINT))) AS w FROM l WHERE ahead < all_t // part),
c AS (SELECT lang, part, w, count(*) AS c FROM w GROUP BY lang, part, w), z AS (SELECT lang, part, sum(c) AS total FROM c GROUP BY lang, part)
SELECT c.lang AS lang, c.part AS part, CAST(any_value(total) AS BIGINT) AS words, round(sum(-(c / total::DOUBLE) * log2(c / total::DOUBLE)), 6) AS h1 FROM c JOIN z ON c.lang IS NOT DISTINCT FROM z.lang AND c.part = z.part GROUP BY c.lang, c.part""")
def entropy_budget_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram entropy at halving budgets, all budgets in one pass."""
    docs = texts_of(spark, sf_dir, "lang", "doc_id", "text")
    lengths = settled(entropy.stream_lengths(docs, ["lang"], ["doc_id"]))
    sums = lengths.groupBy("lang").agg(F.sum("words").alias("s"))
    rungs = sums.select("lang", "s", F.explode(F.array(*map(F.lit, (1, 2, 4, 8)))).alias("part"))
    budgets = settled(rungs.select("lang", "part", F.floor(F.col("s") / F.col("part")).alias("budget")))
    cut = entropy.budgeted(docs, lengths, budgets, ["lang"], ["doc_id"])
    counts = cut.select("lang", "part", F.explode("tokens").alias("w")).groupBy("lang", "part", "w").agg(F.count(F.lit(1)).alias("c"))
    return entropy.estimates(counts, ["lang", "part"]).select("lang", "part", F.col("total").alias("words"), F.round("plugin", 6).alias("h1"))


@query("SELECT lang, doc_id, row_number() OVER (ORDER BY lang NULLS FIRST, doc_id NULLS FIRST) - 1 AS record_index FROM documents")
def row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gapless numbers in a stated order."""
    return slicing.numbered(docs_of(spark, sf_dir).select("lang", "doc_id"), "lang", "doc_id")


@query("""WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM documents)
SELECT doc_id, CAST(floor(i / ceil(n / 7.0)) AS INTEGER) AS shard, CAST(i % 7 AS BIGINT) AS stride,
  CASE WHEN i < floor(n * 0.8) THEN 'train' WHEN i < floor(n * 0.8) + floor((n - floor(n * 0.8)) / 2) THEN 'dev' ELSE 'test' END AS split FROM n""")
def shards_and_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contiguous and strided shards and a prefix split."""
    docs = slicing.numbered(docs_of(spark, sf_dir).select("doc_id"), "doc_id")
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    i = F.col("record_index")
    rows = docs.crossJoin(F.broadcast(n))  # one row
    return rows.select("doc_id", slicing.contiguous_shard(i, F.col("n"), 7).alias("shard"), (i % 7).alias("stride"), slicing.prefix_split(i, F.col("n")).alias("split"))


@query("""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id NULLS FIRST) - 1 AS i FROM documents) WHERE i >= 25 AND i < 125""")
def row_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an absolute range."""
    docs = slicing.numbered(docs_of(spark, sf_dir).select("doc_id"), "doc_id")
    return slicing.slice_rows(docs, "record_index", *slicing.row_range(10**9, 25, 125)).select("doc_id")


@query(f"""WITH d AS (SELECT doc_id, len({PIECES}) AS n FROM documents),
a AS (SELECT *, sum(n) OVER (ORDER BY {U.format("'3' || coalesce(':' || doc_id, '')")}, doc_id NULLS FIRST, n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS ahead FROM d WHERE n > 0)
SELECT doc_id, CAST(n AS INTEGER) AS n FROM a WHERE ahead + n <= 50000 OR (ahead < 50000 AND ahead + n - 50000 < 50000 - ahead)""")
def budgeted_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in a shuffled order until a budget of words is met."""
    docs = texts_of(spark, sf_dir, "doc_id", "text").select("doc_id", T.word_count(F.col("text")).alias("n"), T.uniform(3, F.col("doc_id")).alias("u"))
    return slicing.take_budget(docs, "n", 50_000, "u", "doc_id", "n").select("doc_id", "n")


@query(f"""WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY {U.format("'5' || coalesce(':' || doc_id, '')")}, doc_id) AS r, count(*) OVER () AS n FROM documents)
SELECT doc_id FROM n WHERE r <= greatest(1, floor(n * 0.1))""")
def fraction_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11: a seeded tenth of the documents, without replacement."""
    docs = docs_of(spark, sf_dir).select("doc_id")
    return slicing.sample_fraction(docs, "doc_id", 0.1, 5, docs.count())


@query(f"""WITH n AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY {U.format("'42' || coalesce(':' || doc_id, '')")}, doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT source, doc_id FROM n WHERE r <= greatest(2, ceil(n * 0.2))""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of every source, two documents at least."""
    return slicing.stratified_sample(docs_of(spark, sf_dir).select("source", "doc_id"), "source", "doc_id", 0.2, 2, 42)


@query("""WITH p AS (SELECT * FROM (VALUES ('a', 0, 5), ('a', 1, 2), ('b', 0, 11), ('b', 1, 7), ('b', 2, 30)) t(split, place, i)),
n AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS i FROM documents)
SELECT lang, split, CAST(place AS INTEGER) AS place, doc_id FROM n JOIN p USING (i)""")
def recorded_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows at recorded places of every language."""
    rows = slicing.interleaved(docs_of(spark, sf_dir).select("lang", "doc_id"), "lang", "doc_id")
    return slicing.recorded_split(rows, "turn", {"a": [5, 2], "b": [11, 7, 30]}).select("lang", "split", "place", "doc_id")


@query("SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS turn FROM documents")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turn at which round robin over sources reaches a document."""
    return slicing.interleaved(docs_of(spark, sf_dir).select("source", "doc_id"), "source", "doc_id").select("source", "doc_id", F.col("turn").cast("long").alias("turn"))


@query("SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def first_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the first document of each text."""
    return slicing.first_occurrences(docs_of(spark, sf_dir), "text", "doc_id")


@query("""SELECT item_id, unnest([text, text || '.']) AS text, copy FROM benchmark, unnest([1, 2, 3]) AS c(copy)""")
def replicated_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C14: every benchmark sentence three times, and three times with a period."""
    return slicing.replicated(parquet_table(spark, sf_dir, "benchmark").select("item_id", "text"), 3).select("item_id", "text", "copy")


@query(f"""SELECT doc_id, CAST(e AS INTEGER) AS epoch, row_number() OVER (PARTITION BY e ORDER BY {U.format("'9:' || e || coalesce(':' || doc_id, '')")}, doc_id) AS place
FROM documents, unnest([0, 1]) AS t(e)""")
def epoch_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a permutation of the documents for each of two epochs."""
    rows = slicing.epoch_order(docs_of(spark, sf_dir).select("doc_id"), "doc_id", 2, 9)
    placed = slicing.running_total(rows.withColumn("one", F.lit(1)), "one", "u", "doc_id", by=("epoch",))
    return placed.select("doc_id", "epoch", (F.col("ahead") + 1).alias("place"))


@query(r"""WITH w AS (SELECT unnest(regexp_split_to_array(text, '\s+')) AS token FROM documents)
SELECT token, count(*) AS n FROM w WHERE token <> '' AND regexp_matches(token, '^[A-Za-z]') GROUP BY token HAVING count(*) >= 20""")
def surface_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case-preserving counts of words of 20 occurrences or more."""
    return vocabulary.surface_counts(texts_of(spark, sf_dir, "text"), least=20)


@query(r"""WITH w AS (SELECT unnest(regexp_split_to_array(text, '\s+')) AS token FROM benchmark UNION ALL SELECT unnest(regexp_split_to_array(lower(text), '\s+')) FROM benchmark)
SELECT token, count(*) AS n FROM w WHERE token <> '' GROUP BY token""")
def pair_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over both sentences of pairs."""
    pairs = parquet_table(spark, sf_dir, "benchmark").select("text", F.lower("text").alias("other"))
    return vocabulary.pair_counts(pairs, ("text", "other"))


_SENTENCES = r"""list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(text, '\n', ' ', 'g'), ' +', ' ', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"""
_BARE = r"""list_filter(list_transform(list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> ''), lambda w: lower(regexp_replace(w, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g'))), lambda w: w <> '')"""


@query(rf"""WITH d AS (SELECT doc_id, {_SENTENCES} AS ss FROM documents),
s AS (SELECT doc_id, unnest(generate_series(1, len(ss))) AS place, unnest(ss) AS sentence FROM d),
b AS (SELECT *, {_BARE.format('sentence')} AS w FROM s),
v AS (SELECT token FROM (SELECT unnest(w) AS token FROM b) GROUP BY token ORDER BY count(*) DESC, token LIMIT 400),
k AS (SELECT doc_id, place, sentence FROM b WHERE len(w) > 0 AND NOT EXISTS (SELECT 1 FROM unnest(w) AS x(t) WHERE t NOT IN (SELECT token FROM v)))
SELECT doc_id, string_agg(sentence, ' ' ORDER BY place) AS text, count(*) AS kept_sentences FROM k GROUP BY doc_id""")
def vocabulary_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences made of the 400 most frequent words only."""
    docs = texts_of(spark, sf_dir, "doc_id", "text")
    # a sentence's end is white space, too: the words of a text are those of its sentences
    words = docs.select(F.explode(T.bare_words(F.col("text"))).alias("token"))
    top = vocabulary.top_words(words.groupBy("token").agg(F.count(F.lit(1)).alias("n")), 400)
    return vocabulary.within_vocabulary(docs, top)


@query(rf"""WITH RECURSIVE d AS (SELECT doc_id, {_SENTENCES} AS ss FROM documents),
s AS (SELECT doc_id, unnest(generate_series(1, len(ss))) AS i, unnest(ss) AS s, len(ss) AS m FROM d),
w AS (SELECT doc_id, i, s, m, CAST(len(list_filter(regexp_split_to_array(s, '\s+'), lambda x: x <> '')) AS BIGINT) AS n FROM s),
f AS (
  SELECT doc_id, i, m, n AS acc, 0 AS chunk, n FROM w WHERE i = 1
  UNION ALL
  SELECT w.doc_id, w.i, w.m, CASE WHEN f.acc + w.n <= 60 THEN f.acc + w.n ELSE w.n END, CASE WHEN f.acc + w.n <= 60 THEN f.chunk ELSE f.chunk + 1 END, w.n
  FROM f JOIN w ON w.doc_id = f.doc_id AND w.i = f.i + 1)
SELECT f.doc_id, CAST(f.chunk AS INTEGER) AS chunk, string_agg(w.s, ' ' ORDER BY w.i) AS text FROM f JOIN w USING (doc_id, i) GROUP BY f.doc_id, f.chunk""")
def packed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole sentences packed greedily into chunks of 60 words."""
    docs = texts_of(spark, sf_dir, "doc_id", "text").select("doc_id", T.packed_sentences(T.sentences(F.col("text")), 60).alias("c"))
    return docs.select("doc_id", F.posexplode("c").alias("chunk", "text"))


@query(r"""WITH t AS (SELECT source AS name, CASE WHEN doc_id % 3 = 0 THEN 'M' ELSE 'F' END AS sex, CAST(sum(n_chars) AS BIGINT) AS n FROM documents GROUP BY 1, 2),
p AS (SELECT name, CAST(coalesce(sum(n) FILTER (WHERE sex = 'M'), 0) AS BIGINT) AS m, CAST(coalesce(sum(n) FILTER (WHERE sex = 'F'), 0) AS BIGINT) AS f FROM t GROUP BY name)
SELECT * FROM (SELECT name, m, f, CASE WHEN m >= 0.7 * (m + f) AND m >= 1000 THEN 'male' WHEN f >= 0.7 * (m + f) AND f >= 1000 THEN 'female' WHEN m + f >= 1000 THEN 'neutral' END AS class FROM p) WHERE class IS NOT NULL""")
def name_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5: classes by the share of one of two kinds, here of sources by the parity of ids."""
    docs = docs_of(spark, sf_dir).select(F.col("source").alias("name"), F.when(F.col("doc_id") % 3 == 0, "M").otherwise("F").alias("sex"), F.col("n_chars").alias("n"))
    return vocabulary.name_classes(docs, share=0.7)


@query(r"""WITH w AS (SELECT unnest(regexp_split_to_array(text, '\s+')) AS token FROM documents),
c AS (SELECT token, count(*) AS n FROM w WHERE token <> '' AND regexp_matches(token, '^[A-Za-z]') GROUP BY token),
x AS (SELECT DISTINCT lower(unnest(regexp_split_to_array(text, '\s+'))) AS low FROM benchmark)
SELECT token, n FROM c WHERE regexp_matches(token, '^[A-Z][A-Za-z]*$') AND upper(token) <> token AND length(token) BETWEEN 3 AND 12 AND n >= 2
  AND NOT EXISTS (SELECT 1 FROM c AS o WHERE o.token = lower(c.token)) AND NOT EXISTS (SELECT 1 FROM x WHERE x.low = lower(c.token))""")
def proper_noun_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised words without a lower-case twin that the benchmark doesn't use."""
    counts = vocabulary.surface_counts(texts_of(spark, sf_dir, "text"))
    used = parquet_table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", r"\s+")).alias("token")).distinct()
    return vocabulary.proper_pool(counts, used, least=2, shortest=3, longest=12)


@query(rf"""WITH t AS (SELECT item_id, text, {PIECES} AS p FROM benchmark)
SELECT item_id, CAST(len(p) AS INTEGER) AS words, array_to_string(list_slice(p, 1, 5), ' ') AS head, CAST(('0x' || substr(sha256('11:' || item_id), 1, 12)) AS BIGINT) AS seed,
  regexp_extract(text, '^[^\p{{L}}]*') || upper(substr(text, length(regexp_extract(text, '^[^\p{{L}}]*')) + 1, 1)) || substr(text, length(regexp_extract(text, '^[^\p{{L}}]*')) + 2) AS capitalised FROM t""")
def scalar_text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, truncation, seeds and casing."""
    t = F.col("text")
    return parquet_table(spark, sf_dir, "benchmark").select("item_id", T.word_count(t).alias("words"), T.truncate_words(t, 5).alias("head"), T.seed_of(11, F.col("item_id")).alias("seed"), T.capitalise_first_letter(t).alias("capitalised"))


@query("""SELECT doc_id, CASE WHEN instr(text, chr(10)) > 0 AND trim(substr(text, instr(text, chr(10)) + 1)) <> '' THEN trim(substr(text, instr(text, chr(10)) + 1)) END AS body FROM documents""")
def title_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows the title line."""
    return docs_of(spark, sf_dir).select("doc_id", T.title_and_body(F.col("text")).alias("body"))


@query(f"""WITH d AS (SELECT doc_id, {TOKENS} AS t FROM documents)
SELECT doc_id, CAST(o // 32 AS INTEGER) AS segment, array_to_string(list_slice(t, o + 1, o + 32), ' ') AS words FROM d, unnest(generate_series(0, greatest(len(t) - 1, 0), 32)) AS s(o) WHERE len(list_slice(t, o + 1, o + 32)) > 1""")
def fixed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of 32 tokens, trailing single tokens dropped."""
    docs = texts_of(spark, sf_dir, "doc_id", "text").select("doc_id", T.tokenize(F.col("text")).alias("t"))
    return docs.select("doc_id", F.posexplode(slicing.segments(F.col("t"), 32)).alias("segment", "s")).select("doc_id", "segment", F.array_join("s", " ").alias("words"))
