"""Queries on assembled results, readers, streams and the relational tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.operators import metrics
from glossa.plans.registry import query
from glossa.session import shared_folder
from glossa.sources import readers, sinks
from glossa.sources.readers import parquet_table
from glossa.streaming import ingest


@query("""WITH n AS (SELECT doc_id, 'label ' || quality AS cell FROM labels)
SELECT doc_id, source AS cell FROM documents d WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.doc_id IS NOT DISTINCT FROM d.doc_id) UNION ALL SELECT doc_id, cell FROM n""")
def upserted_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New cells replace old ones, others stay: documents by their labels."""
    old = parquet_table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("cell"))
    new = parquet_table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("label "), F.col("quality").cast("string")).alias("cell"))
    return metrics.upsert(old, new, ["doc_id"])


_REPORT = "m AS (SELECT lang, source, avg(n_chars) AS v FROM documents GROUP BY ALL)"


@query(f"""WITH {_REPORT} SELECT lang AS section, source AS name, round(v, 2) AS value FROM m""")
def report_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics written as report texts and parsed again."""
    values = parquet_table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.avg("n_chars").alias("v")).withColumn("v", F.round("v", 2))
    reports = sinks.report_lines(values, "lang", "source", "v").select(F.col("lang").alias("report"), F.posexplode(F.split("report", "\n")).alias("line_no", "value"))
    return sinks.parsed_report(reports)


@query("""SELECT '{' || string_agg('"' || k || '":' || n, ',' ORDER BY k) || '}' AS record FROM (SELECT replace(lang || '/' || source, '/', '_') AS k, count(*) AS n FROM documents GROUP BY 1)""")
def metric_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON record of all metrics."""
    counts = parquet_table(spark, sf_dir, "documents").groupBy(F.concat_ws("/", "lang", "source").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return sinks.flat_record(counts, "k", "n")


_LOG = "lg AS (SELECT doc_id, n_chars, 'baby_0' || (doc_id % 9 + 1) || 'm_0.' || (1 + doc_id % 3) || '_seed0' || (doc_id % 4) AS name, 'step' || chr(10) || 'blimp: ' || (n_chars % 100) || chr(10) || 'other' || chr(10) || 'blimp: ' || (doc_id % 100) || chr(10) || 'sg: 5' AS log FROM documents)"


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lambda c: c.cast("string")
    d, n = F.col("doc_id"), F.col("n_chars")
    name = F.concat(F.lit("baby_0"), s(d % 9 + 1), F.lit("m_0."), s(d % 3 + 1), F.lit("_seed0"), s(d % 4))
    return parquet_table(spark, sf_dir, "documents").select("doc_id", name.alias("name"), F.concat(F.lit("step\nblimp: "), s(n % 100), F.lit("\nother\nblimp: "), s(d % 100), F.lit("\nsg: 5")).alias("log"))


@query(f"""WITH {_LOG} SELECT doc_id, 'baby' AS method, upper((doc_id % 9 + 1) || 'm') AS size, CAST('0.' || (1 + doc_id % 3) AS DOUBLE) AS fraction, CAST(doc_id % 4 AS INTEGER) AS seed, CAST(doc_id % 100 AS DOUBLE) AS last FROM lg""")
def parsed_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and the last metric of logs."""
    rows = _logs(spark, sf_dir).select("doc_id", T.run_name(F.col("name")).alias("r"), readers.last_match(F.col("log"), r"blimp: ([0-9.]+)").cast("double").alias("last"))
    return rows.select("doc_id", "r.method", T.size_name(F.col("r.size")).alias("size"), "r.fraction", "r.seed", "last")


@query(f"""WITH {_LOG} SELECT doc_id, block, hit FROM (SELECT doc_id, 0 AS block, CAST(n_chars % 100 AS VARCHAR) AS hit FROM lg UNION ALL SELECT doc_id, 1, CAST(doc_id % 100 AS VARCHAR) FROM lg)""")
def log_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of consecutive metric lines."""
    lines = _logs(spark, sf_dir).select("doc_id", F.posexplode(F.split("log", "\n")).alias("line_no", "value"))
    return readers.metric_blocks(lines, r"^blimp: ([0-9.]+)$", ["doc_id"]).select("doc_id", "block", "hit")


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN trim(text) WHEN 4 THEN '{"broken' WHEN 5 THEN trim(text) END AS loose, CASE WHEN doc_id % 6 = 0 THEN trim(text) END AS lenient FROM documents WHERE doc_id % 6 IN (0, 4, 5)""")
def json_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What strict, lenient and loose readers make of JSON lines of all kinds."""
    docs = parquet_table(spark, sf_dir, "documents").select("doc_id", F.trim("text").alias("t"))
    k = F.col("doc_id") % 6
    whole = F.to_json(F.struct(F.col("t").alias("text")))
    string = F.regexp_replace(F.regexp_replace(whole, r'^\{"text":', ""), r"\}$", "")
    lines = docs.select("doc_id", F.when(k == 0, whole).when(k == 1, '{"text": 5}').when(k == 2, '{"other": "x"}').when(k == 3, '{"text": {"a": 1}}').when(k == 4, '{"broken').otherwise(string).alias("value"))
    typed = readers._typed(lines, "text")
    lenient = F.when(F.col("kind") == "STRING", T.strip(F.variant_get("v", "$.text", "string")))
    loose = F.when(F.col("v").isNull(), F.col("value")).when(F.schema_of_variant("v") == "STRING", F.variant_get("v", "$", "string")).otherwise(lenient)
    return typed.select("doc_id", loose.alias("loose"), lenient.alias("lenient")).filter(F.col("loose").isNotNull())


@query(r"""SELECT item_id, CAST(i AS INTEGER) AS i, w AS form, CAST(i - 1 AS INTEGER) AS head FROM (SELECT item_id, unnest(regexp_split_to_array(trim(text), '\s+')) AS w, unnest(generate_series(1, len(regexp_split_to_array(trim(text), '\s+')))) AS i FROM benchmark)""")
def conllu_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of CoNLL-U lines with comments, ranges, empty nodes and blank lines."""
    rows = parquet_table(spark, sf_dir, "benchmark").select("item_id", F.split(F.trim("text"), r"\s+").alias("w"))
    word = lambda w, i: F.concat_ws("\t", (i + 1).cast("string"), w, w, F.lit("X"), F.lit("X"), F.lit("_"), i.cast("string"), F.lit("dep"), F.lit("_"), F.lit("_"))
    lines = F.concat(F.array(F.lit("# text"), F.lit("1-2\tx\tx\tX\tX\t_\t0\td\t_\t_")), F.transform("w", word), F.array(F.lit("3.1\tx\tx\tX\tX\t_\t0\td\t_\t_"), F.lit("")))
    table = rows.select(F.col("item_id").cast("string").alias("file"), F.posexplode(lines).alias("line_no", "value"))
    return readers.conllu_words(table).select(F.col("file").cast("long").alias("item_id"), "i", "form", "head")


@query("SELECT conv_id, count(*) AS turns, string_agg(turn || ':' || role, ' ' ORDER BY turn) AS roles, md5(string_agg(role, '|' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def conversation_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and sizes of grouped rows in order."""
    rows = parquet_table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"))
    return rows.select("conv_id", "turns", F.array_join(F.transform("r", lambda x: F.concat_ws(":", x["turn"].cast("string"), x["role"])), " ").alias("roles"), F.md5(F.array_join("r.role", "|")).alias("digest"))


@query("SELECT page_id, url, regexp_extract(url, '^https?://([^/]+)', 1) AS host, length(html) AS n FROM pages")
def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw scans with scalar extraction."""
    return parquet_table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"), F.length("html").cast("long").alias("n"))


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows over events."""
    out = ingest.windowed_counts(parquet_table(spark, sf_dir, "events"), "ts", "event_type", "1 hour", "10 minutes")
    return out.select(F.col("w.start").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


def _scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"


@query("SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL")
def resumable_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream that may stop and go on, its partial sums added up."""
    at = _scratch(spark)
    return ingest.partial_counts(spark, f"{sf_dir}/events.parquet", f"{at}/sums", f"{at}/state", ["event_type", "user_id"], lambda df: df)


@query("SELECT doc_id, upper(lang) AS lang, n_chars FROM documents WHERE n_chars > 500")
def resumable_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1, K3, B1: rows of new files transformed and appended, each file once; a second run finds nothing new."""
    at = _scratch(spark)
    for _ in range(2):
        ingest.resume(spark, f"{sf_dir}/documents.parquet", f"{at}/out", f"{at}/state", lambda df: df.filter("n_chars > 500").select("doc_id", F.upper("lang").alias("lang"), "n_chars"))
    return spark.read.parquet(f"{at}/out")


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem GROUP BY ALL""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grouped aggregate over the fact table."""
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return parquet_table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("""SELECT n_name, count(DISTINCT c_custkey) AS customers, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def nation_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A star join; Spark picks broadcasts by size."""
    t = lambda n: parquet_table(spark, sf_dir, n)
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.countDistinct("c_custkey").alias("customers"), F.round(F.sum("o_totalprice"), 2).alias("total"))
