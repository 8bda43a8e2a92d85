"""Queries on scores: accuracies, temperatures, margins, formulas, vectors, language models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.functions import vectors as V
from glossa.functions.formula import compile_formula, region_totals
from glossa.operators import language_model, metrics, rewriting, slicing
from glossa.plans.registry import query
from glossa.sources.readers import parquet_table, spread

U = "((CAST(('0x' || substr(sha256({0}), 1, 12)) AS BIGINT) + 0.5) / 281474976710656.0::DOUBLE)"
TEMPS = 13

# Scores of pairs come from hashes, so that any engine has the same ones: a good and a bad score per temperature.
_SCORES = f"""sc AS (SELECT item_id, CAST(t AS INTEGER) AS temp_idx, 'f' || (item_id % 3) AS field, 't' || (item_id % 5) AS term, 'u' || (item_id % 7) AS uid,
  {U.format("'21:' || item_id || ':' || t")} + 0.02::DOUBLE * (t % 5) AS good, {U.format("'22:' || item_id || ':' || t")} AS bad FROM benchmark, unnest(generate_series(0, {TEMPS - 1})) AS g(t)),
co AS (SELECT *, CASE WHEN good > bad THEN 1 ELSE 0 END AS correct FROM sc)"""


def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parquet_table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.sequence(F.lit(0), F.lit(TEMPS - 1))).alias("temp_idx"))
    part = lambda p, m: F.concat(F.lit(p), (F.col("item_id") % m).cast("string"))
    good = T.uniform(21, F.col("item_id"), F.col("temp_idx")) + F.lit(0.02) * (F.col("temp_idx") % 5)
    rows = rows.select("item_id", "temp_idx", part("f", 3).alias("field"), part("t", 5).alias("term"), part("u", 7).alias("uid"), good.alias("good"), T.uniform(22, F.col("item_id"), F.col("temp_idx")).alias("bad"))
    return rows.withColumn("correct", (F.col("good") > F.col("bad")).cast("int"))


_ACC = """ac AS (SELECT temp_idx, key, value, CAST(sum(correct) AS BIGINT) AS "right", count(*) AS n, sum(correct) / count(*)::DOUBLE AS accuracy FROM (
  SELECT temp_idx, correct, unnest(['field', 'term', 'uid']) AS key, unnest([field, term, uid]) AS value FROM co) GROUP BY temp_idx, key, value)"""


@query(f'WITH {_SCORES}, {_ACC} SELECT temp_idx, key, value, "right", n, round(accuracy, 9) AS accuracy FROM ac')
def pair_accuracies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy by temperature and each of three keys, in one pass."""
    out = metrics.accuracy_by(pair_scores(spark, sf_dir), ["field", "term", "uid"])
    return out.withColumn("accuracy", F.round("accuracy", 9))


@query(f'WITH {_SCORES}, {_ACC} SELECT temp_idx, round(avg(accuracy), 9) AS accuracy FROM ac WHERE key = \'uid\' AND "right" > 0 GROUP BY temp_idx')
def nonzero_macro_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The macro mean over groups with a correct item only."""
    out = metrics.accuracy_by(pair_scores(spark, sf_dir), ["uid"], keep_empty=False)
    return metrics.macro_by_temperature(out, "uid").withColumn("accuracy", F.round("accuracy", 9))


_BEST = "bt AS (SELECT temp_idx, correct FROM (SELECT temp_idx, sum(correct) AS correct FROM co GROUP BY temp_idx) ORDER BY correct DESC, temp_idx LIMIT 1)"


@query(f"WITH {_SCORES}, {_BEST} SELECT co.item_id, co.temp_idx, round(good - bad, 9) AS delta FROM co JOIN bt USING (temp_idx) WHERE co.correct = 0")
def conflict_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items answered wrong at the best temperature, the first one on ties."""
    scores = pair_scores(spark, sf_dir)
    best = metrics.best_temperature(scores.groupBy("temp_idx").agg(F.sum("correct").alias("right")), "right")
    wrong = scores.join(F.broadcast(best.select("temp_idx")), "temp_idx").filter("correct = 0")  # one row
    return wrong.select("item_id", "temp_idx", F.round(F.col("good") - F.col("bad"), 9).alias("delta"))


@query(f"""WITH {_SCORES}, m AS (SELECT field AS kind, CASE WHEN item_id % 11 <> 0 THEN good - bad END AS m FROM co WHERE temp_idx = 3)
SELECT kind, count(*) AS n, round(avg((m > 0)::INTEGER), 9) AS accuracy, round(avg(m), 9) AS mean_margin FROM m WHERE m IS NOT NULL GROUP BY ROLLUP (kind)""")
def margin_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and mean margin overall and by kind, null margins skipped."""
    rows = pair_scores(spark, sf_dir).filter("temp_idx = 3").select(F.col("field").alias("kind"), F.when(F.col("item_id") % 11 != 0, F.col("good") - F.col("bad")).alias("m"))
    return metrics.margins(rows, "m", "kind").select("kind", "n", F.round("accuracy", 9).alias("accuracy"), F.round("mean_margin", 9).alias("mean_margin"))


_PRED = "pr AS (SELECT l.doc_id, l.quality AS gold, CASE WHEN d.n_chars > 900 THEN 1 ELSE 0 END AS pred, l.toxic FROM labels l JOIN documents d USING (doc_id))"


def label_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = parquet_table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") > 900, 1).otherwise(0).alias("pred"))
    return parquet_table(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", F.col("quality").alias("gold"), "pred", "toxic")


@query(f"""WITH {_PRED}, c AS (SELECT label, count(*) FILTER (WHERE pred = label AND gold = label) AS tp, count(*) FILTER (WHERE pred = label AND gold <> label) AS fp, count(*) FILTER (WHERE pred <> label AND gold = label) AS fn
  FROM pr, unnest([0, 1, 2]) AS t(label) GROUP BY label) SELECT label, tp, fp, fn, round(CASE WHEN tp = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn)::DOUBLE END, 9) AS f1 FROM c""")
def per_label_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 per label, 0 without true positives."""
    out = metrics.confusion(label_predictions(spark, sf_dir), "pred", "gold", [0, 1, 2])
    return out.withColumn("f1", F.round("f1", 9))


@query(f"""WITH {_PRED}, c AS (SELECT toxic, count(*) FILTER (WHERE pred = 1 AND gold = 1)::DOUBLE AS tp, count(*) FILTER (WHERE pred = 1 AND gold = 0)::DOUBLE AS fp, count(*) FILTER (WHERE pred = 0 AND gold = 1)::DOUBLE AS fn, count(*) FILTER (WHERE pred = 0 AND gold = 0)::DOUBLE AS tn FROM pr GROUP BY toxic)
SELECT toxic, round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy, round(CASE WHEN tp = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END, 9) AS f1,
  round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0.0 ELSE (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) END, 9) AS mcc FROM c""")
def binary_label_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, F1 and Matthews correlation by group."""
    out = metrics.binary_metrics(label_predictions(spark, sf_dir), "pred", "gold", ["toxic"])
    return out.select("toxic", *(F.round(c, 9).alias(c) for c in ("accuracy", "f1", "mcc")))


@query(f"WITH {_PRED}, e AS (SELECT doc_id, (pred = gold)::INTEGER AS correct FROM pr) SELECT round(avg(correct), 9) AS accuracy, round(avg(correct) FILTER (WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'de')), 9) AS hard_accuracy, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'de')) AS n_hard FROM e")
def hard_subset_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy over all rows and over a listed subset."""
    rows = label_predictions(spark, sf_dir).withColumn("correct", (F.col("pred") == F.col("gold")).cast("int"))
    hard = parquet_table(spark, sf_dir, "documents").filter("lang = 'de'").select(F.col("doc_id").alias("id"))
    out = metrics.split_accuracy(rows, hard, "doc_id")
    return out.select(F.round("accuracy", 9).alias("accuracy"), F.round("hard_accuracy", 9).alias("hard_accuracy"), "n_hard")


@query("""WITH d AS (SELECT doc_id, CAST(n_chars > 500 AS INTEGER) AS v, 1 AS here FROM documents), r AS (SELECT doc_id, CAST(max(quality) AS INTEGER) AS v, 1 AS here FROM labels GROUP BY doc_id)
SELECT coalesce(d.doc_id, r.doc_id) AS doc_id, CASE WHEN d.here IS NULL THEN 'missing' WHEN r.here IS NULL THEN 'extra' WHEN d.v IS DISTINCT FROM r.v THEN 'changed' ELSE 'same' END AS state FROM d FULL JOIN r ON d.doc_id IS NOT DISTINCT FROM r.doc_id""")
def compared_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing, extra, changed and equal keys of two sets: a rule's verdict and the labels."""
    derived = parquet_table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 500).cast("int").alias("v"))
    recorded = parquet_table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").cast("int").alias("v"))
    return metrics.compare_sets(derived, recorded, "doc_id", "v")


@query("""SELECT lang, round(sum(n_chars * (doc_id % 7)) / sum(n_chars)::DOUBLE, 9) AS weighted, round(exp(sum((doc_id % 9) / 10.0::DOUBLE * n_chars) / greatest(1, sum(n_chars))), 9) AS perplexity FROM documents WHERE source NOT LIKE 'src1%' GROUP BY lang""")
def weighted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted means with a predicate, and perplexity."""
    docs = parquet_table(spark, sf_dir, "documents").filter(~F.col("source").like("src1%"))
    loss = (F.col("doc_id") % 9) / F.lit(10.0)
    return docs.groupBy("lang").agg(F.round(metrics.weighted_mean(F.col("doc_id") % 7, F.col("n_chars")), 9).alias("weighted"), F.round(metrics.perplexity(loss, F.col("n_chars")), 9).alias("perplexity"))


@query("""WITH r AS (SELECT lang, n_chars, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC) - 1 AS k FROM documents) SELECT lang, n_chars FROM r WHERE k = n * 95 // 100""")
def rank_of_95_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value at the exact rank of 95 %."""
    return metrics.rank_value(parquet_table(spark, sf_dir, "documents"), "n_chars", ["lang"], 95)


@query("""WITH s AS (SELECT lang AS method, source AS budget, doc_id % 3 AS seed, round(avg(n_chars), 1) AS v FROM documents GROUP BY ALL),
c AS (SELECT method, budget, round(avg(v), 1) AS mean, round(stddev_samp(v), 6) AS sd, round(stddev_pop(v), 6) AS sd_pop, count(*) AS seeds FROM s GROUP BY method, budget)
SELECT *, max(mean) OVER (PARTITION BY budget) AS ceiling FROM c""")
def seed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and both deviations over seeds, and the ceiling of each budget."""
    seeds = parquet_table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("method"), F.col("source").alias("budget"), (F.col("doc_id") % 3).alias("seed")).agg(F.round(F.avg("n_chars"), 1).alias("v"))
    cells = seeds.groupBy("method", "budget").agg(F.round(F.avg("v"), 1).alias("mean"), F.round(F.stddev_samp("v"), 6).alias("sd"), F.round(F.stddev_pop("v"), 6).alias("sd_pop"), F.count(F.lit(1)).alias("seeds"))
    return cells.withColumn("ceiling", F.max("mean").over(Window.partitionBy("budget")))


@query("SELECT lang, round(regr_slope(n_chars, doc_id), 9) AS slope, round(corr(n_chars, doc_id), 9) AS r FROM documents GROUP BY lang")
def efficiency_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope and correlation of a linear fit."""
    docs = parquet_table(spark, sf_dir, "documents")
    return docs.groupBy("lang").agg(F.round(F.regr_slope("n_chars", "doc_id"), 9).alias("slope"), F.round(F.corr("n_chars", "doc_id"), 9).alias("r"))


@query("""WITH u AS (SELECT vec_id AS k, label AS g, list_transform(embedding, lambda x: x::DOUBLE / nullif(sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 0)) AS v FROM embeddings),
p AS (SELECT a.k, a.g = b.g AS same, exp(list_dot_product(a.v, b.v) / 0.1::DOUBLE) AS e FROM u a JOIN u b ON a.k <> b.k),
s AS (SELECT k, sum(e) AS whole, sum(e) FILTER (WHERE same) AS near FROM p GROUP BY k)
SELECT count(*) AS n, round(avg(-ln(near / whole)), 6) AS loss FROM s WHERE near IS NOT NULL""")
def contrastive_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-positive InfoNCE of the embeddings by label."""
    out = metrics.infonce(parquet_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    return out.select("n", F.round("loss", 6).alias("loss"))


_UNIT = "list_transform({0}, lambda x: x::DOUBLE / sqrt(list_sum(list_transform({0}, lambda y: y::DOUBLE * y::DOUBLE))))"


@query(f"""WITH p AS (SELECT a.vec_id AS premise, b.vec_id AS hypothesis, {_UNIT.format('a.embedding')} AS u, {_UNIT.format('b.embedding')} AS v FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
f AS (SELECT premise, hypothesis, u, v, list_transform(list_zip(u, v), lambda z: abs(z[1] - z[2])) AS d, list_transform(list_zip(u, v), lambda z: z[1] * z[2]) AS m FROM p)
SELECT premise, hypothesis, CAST(4 * len(u) + 1 AS INTEGER) AS width, round(list_sum(d), 6) AS distance, round(list_sum(m), 6) AS cosine FROM f""")
def pair_representations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of pairs of neighbouring vectors, joined back twice."""
    e = parquet_table(spark, sf_dir, "embeddings")
    left, right = e.select(F.col("vec_id").alias("premise"), F.col("embedding").alias("u")), e.select((F.col("vec_id") - 1).alias("premise"), F.col("vec_id").alias("hypothesis"), F.col("embedding").alias("v"))
    rows = left.join(right, "premise").select("premise", "hypothesis", V.pair_features(F.col("u"), F.col("v")).alias("f"), F.size("u").alias("k"), V.cosine(F.col("u"), F.col("v")).alias("cosine"))
    distance = F.aggregate(F.slice("f", 2 * F.col("k") + 1, F.col("k")), F.lit(0.0), lambda a, x: a + x)
    return rows.select("premise", "hypothesis", F.size("f").alias("width"), F.round(distance, 6).alias("distance"), F.round("cosine", 6).alias("cosine"))


@query("""WITH x AS (SELECT label, unnest(embedding) AS x, unnest(generate_series(0, len(embedding) - 1)) AS dim FROM embeddings) SELECT label, CAST(dim AS INTEGER) AS dim, round(avg(x::DOUBLE), 6) AS mean FROM x GROUP BY ALL""")
def pooled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Element-wise means of the vectors of a group."""
    rows = parquet_table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"))
    return metrics.mean_pooled(rows, ["label"], "v").select("label", F.posexplode("v").alias("dim", "mean")).withColumn("mean", F.round("mean", 6))


@query("""WITH z AS (SELECT vec_id, label % len(embedding) AS y, t, list_transform(embedding, lambda x: x::DOUBLE / t) AS z FROM embeddings, unnest([0.5::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE]) AS g(t))
SELECT vec_id, t AS temperature, round(z[y + 1] - list_max(z) - ln(list_sum(list_transform(z, lambda x: exp(x - list_max(z))))), 6) AS logprob FROM z""")
def tempered_logprobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log softmax at a label for several temperatures."""
    rows = parquet_table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % F.size("embedding")).cast("int").alias("y"), F.col("embedding").cast("array<double>").alias("z"), F.explode(F.array(F.lit(0.5), F.lit(1.0), F.lit(2.0))).alias("temperature"))
    return rows.select("vec_id", "temperature", F.round(metrics.log_softmax_at(F.col("z"), F.col("y"), F.col("temperature")), 6).alias("logprob"))


@query("SELECT CAST(i AS INTEGER) AS i, greatest(round(i * 0.05::DOUBLE, 2), 1e-6::DOUBLE) AS temperature FROM unnest(generate_series(0, 60)) AS t(i)")
def temperature_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid of temperatures."""
    return spark.range(1).select(F.posexplode(T.temperature_grid()).alias("i", "temperature"))


#: Formulas of the query, each with its SQL over columns a1 a2 a3 b1 b2 b3 (condition and region).
FORMULAS = {
    "(1;%a%) < (1;%b%)": "a1 < b1",
    "((2;%a%) + (3;%a%)) - (2;%b%) > (3;%b%) - 0.25": "(a2 + a3) - b2 > b3 - 0.25",
    "[(1;%a%) > (2;%a%)] & [(*;%a%) > (*;%b%)]": "a1 > a2 AND a1 + a2 + a3 > b1 + b2 + b3",
    "((1;%a%) > 0.9) | ((2;%b%) = (2;%b%))": "a1 > 0.9 OR abs(b2 - b2) <= 1e-6",
    "(4;%a%) > (1;%b%)": None,
}


@query(f"""WITH r AS (SELECT item_id, {', '.join(f"{U.format(repr(f'23:{c}{k}:') + ' || item_id')} AS {c}{k}" for c in 'ab' for k in (1, 2, 3))} FROM benchmark)
SELECT f AS formula, CAST(count(ok) AS BIGINT) AS predictions, CAST(coalesce(sum(ok::INTEGER), 0) AS BIGINT) AS correct FROM ({' UNION ALL '.join(f"SELECT {k} AS f, ({s or 'NULL::BOOLEAN'}) AS ok FROM r" for k, s in enumerate(FORMULAS.values()))}) GROUP BY f""")
def formula_accuracies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction formulas compiled to columns; items without a region leave the denominator."""
    pairs = [x for c in "ab" for k in (1, 2, 3) for x in (F.lit(f"{c}|{k}"), _region(c, k))]
    rows = parquet_table(spark, sf_dir, "benchmark").select("item_id", F.create_map(*pairs).alias("m"))
    refer = region_totals(F.col("m"))
    checks = [F.struct(F.lit(k).alias("formula"), compile_formula(f.replace("[", "(").replace("]", ")"), refer).alias("ok")) for k, f in enumerate(FORMULAS)]
    flat = rows.select(F.explode(F.array(*checks)).alias("c")).select("c.formula", "c.ok")
    return flat.groupBy("formula").agg(F.count("ok").alias("predictions"), F.sum(F.coalesce(F.col("ok").cast("int"), F.lit(0))).alias("correct"))


def _region(condition: str, region: int):
    text = F.concat(F.lit(f"23:{condition}{region}:"), F.col("item_id").cast("string"))
    return (F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)


_WORDS = r"list_prepend('<s>', regexp_extract_all(lower(text), '\p{L}+(?:[''’]\p{L}+)*|\p{Nd}+'))"


@query(f"""WITH d AS (SELECT {_WORDS} AS w FROM documents), p AS (SELECT w[i] AS a, w[i + 1] AS b FROM d, unnest(generate_series(1, len(w) - 1)) AS g(i)),
c AS (SELECT a, b, count(*) AS n FROM p GROUP BY a, b), f AS (SELECT a, sum(n) AS n_a FROM c GROUP BY a), v AS (SELECT count(DISTINCT b) AS v FROM c),
q AS (SELECT item_id, w[i] AS a, w[i + 1] AS b FROM (SELECT item_id, {_WORDS} AS w FROM benchmark), unnest(generate_series(1, len(w) - 1)) AS g(i))
SELECT item_id, count(*) AS n, round(sum(ln((coalesce(c.n, 0) + 1) / (coalesce(f.n_a, 0) + v)::DOUBLE)), 6) AS logprob FROM q LEFT JOIN c USING (a, b) LEFT JOIN f ON f.a = q.a, v GROUP BY item_id""")
def bigram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1, L4: benchmark sentences under the native bigram model of the documents."""
    model = language_model.train_bigrams(spread(parquet_table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id")
    out = language_model.bigram_scores(parquet_table(spark, sf_dir, "benchmark"), "item_id", model)
    return out.select("item_id", "n", F.round("logprob", 6).alias("logprob"))


@query(f"""WITH f(frame, pattern, shape) AS (VALUES ('by', 'the {{a}} were seen by the {{b}}', 0), ('see', 'the {{a}} see the {{b}}', 1)), w AS (SELECT DISTINCT split_part(text, ' ', 2) AS w FROM benchmark WHERE split_part(text, ' ', 2) <> ''),
k AS (SELECT w, row_number() OVER (ORDER BY w) - 1 AS place, count(*) OVER () AS m FROM w), m AS (SELECT max(m) AS m FROM k),
d AS (SELECT id, CAST(floor({U.format("'31:' || id")} * 2) AS BIGINT) AS shape, CAST(floor({U.format("'32:' || id")} * m) AS BIGINT) AS pa, CAST(floor({U.format("'33:' || id")} * m) AS BIGINT) AS pb FROM unnest(generate_series(0, 663)) AS g(id), m),
p AS (SELECT frame, pattern, x.w AS a, y.w AS b, min(id) AS id FROM d JOIN f USING (shape) JOIN k x ON x.place = pa JOIN k y ON y.place = pb WHERE x.w <> y.w GROUP BY ALL),
s AS (SELECT frame, a, b, replace(replace(pattern, '{{a}}', a), '{{b}}', b) AS g, replace(replace(pattern, '{{a}}', b), '{{b}}', a) AS r FROM p ORDER BY id LIMIT 200)
SELECT frame, a, b, upper(g[1]) || g[2:] AS good, upper(r[1]) || r[2:] AS bad FROM s""")
def template_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs from templates, sampled by hash."""
    frames = spark.createDataFrame([("see", "the {a} see the {b}"), ("by", "the {a} were seen by the {b}")], "frame string, pattern string")
    words = parquet_table(spark, sf_dir, "benchmark").select(F.split_part("text", F.lit(" "), F.lit(2)).alias("w")).filter("w <> ''").distinct()
    return rewriting.template_items(frames, words.select(F.col("w").alias("a")), words.select(F.col("w").alias("b")), 200, 31)


@query(f"""WITH RECURSIVE {_SCORES}, po AS (SELECT field AS family, item_id * 100 + temp_idx AS pool_order, term AS frame, uid AS pair, CAST(temp_idx AS VARCHAR) AS item, 4 * (good - bad) - 1 AS delta_conf, 4 * good AS delta_ctrl FROM sc),
st AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY pool_order) AS k FROM po WHERE delta_ctrl >= 1 AND delta_conf <= -0.5),
f AS (
  SELECT family, CAST(0 AS BIGINT) AS k, false AS took, CAST([] AS VARCHAR[]) AS frames, CAST([] AS VARCHAR[]) AS pairs, CAST([] AS VARCHAR[]) AS seen FROM (SELECT DISTINCT family FROM st)
  UNION ALL
  SELECT family, k, ok, CASE WHEN ok THEN list_append(frames, frame) ELSE frames END, CASE WHEN ok THEN list_append(pairs, pair) ELSE pairs END, CASE WHEN ok THEN list_append(seen, id) ELSE seen END
  FROM (SELECT st.family, st.k, st.frame, st.pair, st.frame || '/' || st.pair || '/' || st.item AS id, f.frames, f.pairs, f.seen,
    len(f.seen) < 40 AND len(list_filter(f.frames, lambda x: x = st.frame)) < 6 AND len(list_filter(f.pairs, lambda x: x = st.pair)) < 5 AND NOT list_contains(f.seen, st.frame || '/' || st.pair || '/' || st.item) AS ok
    FROM f JOIN st ON st.family = f.family AND st.k = f.k + 1))
SELECT st.* EXCLUDE (k), row_number() OVER (PARTITION BY family ORDER BY delta_conf, pool_order) - 1 AS place FROM st JOIN f USING (family, k) WHERE f.took""")
def greedy_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items under caps that depend on what was kept."""
    pool = pair_scores(spark, sf_dir).select(F.col("field").alias("family"), (F.col("item_id") * 100 + F.col("temp_idx")).alias("pool_order"), F.col("term").alias("frame"), F.col("uid").alias("pair"), F.col("temp_idx").cast("string").alias("item"), (4 * (F.col("good") - F.col("bad")) - 1).alias("delta_conf"), (4 * F.col("good")).alias("delta_ctrl"))
    return metrics.greedy_selection(pool, 40, 6, 5)


@query(r"""WITH t AS (SELECT item_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS w FROM benchmark)
SELECT item_id, CAST(list_position(w, 'the') - 1 AS INTEGER) AS first_the, CAST(len(list_filter(w, lambda x: x = 'the')) AS INTEGER) AS n_the FROM t WHERE list_contains(w, 'the')""")
def surface_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of a sub-array, the first surface variant that occurs."""
    rows = parquet_table(spark, sf_dir, "benchmark").select("item_id", T.pieces(F.col("text")).alias("w"))
    found = T.first_surface_match(F.col("w"), [F.array(F.lit("zzz")), F.array(F.lit("the")), F.array(F.lit("of"))])
    starts = T.subsequence_starts(F.col("w"), F.array(F.lit("the")))
    return rows.filter(F.size(starts) > 0).select("item_id", F.get(found, F.lit(0)).alias("first_the"), F.size(starts).alias("n_the"))


@query(f"""WITH {_SCORES}, a AS (SELECT field, temp_idx, avg(correct) AS acc FROM sc JOIN co USING (item_id, temp_idx, field, term, uid, good, bad) GROUP BY ALL), b AS (SELECT temp_idx AS best FROM (SELECT temp_idx, avg(acc) AS m FROM a GROUP BY 1 ORDER BY m DESC, temp_idx LIMIT 1)),
p AS (SELECT uid, string_agg(uid || '_' || item_id || CASE WHEN correct = 1 THEN '+' ELSE '-' END, ' ' ORDER BY item_id) AS chosen FROM co WHERE temp_idx = 5 GROUP BY uid),
m AS (SELECT field, round(max(CASE WHEN temp_idx = best THEN acc END), 9) AS at_best, round(max(CASE WHEN temp_idx = 5 THEN acc END), 9) AS at_five FROM a, b GROUP BY field)
SELECT 'predictions' AS kind, uid AS name, chosen AS text, CAST(NULL AS DOUBLE) AS at_best, CAST(NULL AS DOUBLE) AS at_five FROM p UNION ALL SELECT 'suite', field, NULL, at_best, at_five FROM m WHERE field IN ('f0', 'f2')""")
def temperature_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is chosen at one temperature, and chosen suites at the best and at a fixed one."""
    scores = pair_scores(spark, sf_dir)
    sign = F.when(F.col("correct") == 1, "+").otherwise("-")
    item = F.concat("uid", F.lit("_"), F.col("item_id").cast("string"), sign)
    chosen = scores.filter("temp_idx = 5").groupBy("uid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", item.alias("t")))), lambda s: s["t"]), " ").alias("text"))
    by_field = metrics.accuracy_by(scores, ["field"])
    best = metrics.best_temperature(metrics.macro_by_temperature(by_field, "field")).select(F.col("temp_idx").alias("best"))
    rows = by_field.crossJoin(F.broadcast(best))  # one row
    at = lambda c: F.round(F.max(F.when(c, F.col("accuracy"))), 9)
    suites = rows.groupBy(F.col("value").alias("name")).agg(at(F.col("temp_idx") == F.col("best")).alias("at_best"), at(F.col("temp_idx") == 5).alias("at_five"))
    wanted = spark.createDataFrame([("f0",), ("f2",)], "name string")
    suites = suites.join(wanted, "name", "left_semi").select(F.lit("suite").alias("kind"), "name", F.lit(None).cast("string").alias("text"), "at_best", "at_five")
    none = F.lit(None).cast("double")
    return suites.unionByName(chosen.select(F.lit("predictions").alias("kind"), F.col("uid").alias("name"), "text", none.alias("at_best"), none.alias("at_five")))


@query(f"""WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM benchmark), s AS (SELECT item_id, {U.format("'51:' || item_id")} AS good, {U.format("'52:' || item_id")} AS bad, CASE WHEN item_id % 3 > 0 THEN {U.format("'53:' || item_id")} END AS good_at, CASE WHEN item_id % 4 > 0 THEN {U.format("'54:' || item_id")} END AS bad_at FROM benchmark),
b AS (SELECT item_id, w, coalesce(sum(len(w)) OVER (ORDER BY item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w WHERE len(w) >= 2)
SELECT b.item_id, array_to_string(w[1:3], ' ') || ' ' || array_to_string(w[4:], ' ') AS sequence, CAST(len(w[1:3]) AS INTEGER) AS prefix, round(CASE WHEN good_at IS NULL OR bad_at IS NULL THEN good - bad ELSE good_at - bad_at END, 9) AS margin FROM b JOIN s USING (item_id) WHERE before < 500""")
def scored_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences with their prefix until a budget of words is met, scored at critical words or else whole."""
    u = lambda k: T.uniform(k, F.col("item_id"))
    rows = parquet_table(spark, sf_dir, "benchmark").select("item_id", T.pieces(F.col("text")).alias("w")).filter(F.size("w") >= 2)
    taken = slicing.running_total(rows.withColumn("n", F.size("w")), "n", "item_id", name="before").filter("before < 500")
    part = lambda a, b: F.array_join(F.slice("w", a, b), " ")
    at = F.when(F.col("item_id") % 3 > 0, u(53)) - F.when(F.col("item_id") % 4 > 0, u(54))
    sequence = F.concat(part(1, 3), F.lit(" "), part(4, F.size("w")))
    return taken.select("item_id", sequence.alias("sequence"), F.size(F.slice("w", 1, 3)).alias("prefix"), F.round(F.coalesce(at, u(51) - u(52)), 9).alias("margin"))


@query("""WITH i AS (SELECT item_id, split_part(text, ' ', 1) AS x1, split_part(text, ' ', 2) AS y1, split_part(text, ' ', 3) AS x2, split_part(text, ' ', 4) AS y2 FROM benchmark)
SELECT item_id, mode, unnest(CASE mode WHEN 'primary' THEN [x1 || ' ' || y1 || ' ' || x2 || ' ' || y2] WHEN 'sem2' THEN [x1 || ' ' || y1 || ' ' || x2 || ' ' || y2, x2 || ' ' || y2 || ' ' || x1 || ' ' || y1]
  ELSE [x1 || ' ' || y1 || ' ' || x2 || ' ' || y2, x1 || ' ' || y2 || ' ' || x2 || ' ' || y1, x2 || ' ' || y2 || ' ' || x1 || ' ' || y1, x2 || ' ' || y1 || ' ' || x1 || ' ' || y2] END) AS arrangement FROM i, unnest(['primary', 'sem2', 'all4']) AS m(mode)""")
def arrangements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrangements of two associated pairs by mode."""
    word = lambda k: F.split_part("text", F.lit(" "), F.lit(k))
    rows = parquet_table(spark, sf_dir, "benchmark").select("item_id", *(word(k).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"), 1)))
    return metrics.arranged(rows, ["item_id"])
