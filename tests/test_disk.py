"""What the queries on conversations keep on disk, and their results on odd keys."""

import os
import re
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from glossa.operators import context, draws, parsing, trees
from glossa.plans import rewriting

from .oracle import assert_same, connection

QUERIES, SQL = entry.queries(), entry.oracle_sql()
KEY = ["conv_id", "turn"]


def kept(spark):
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs)


@pytest.mark.parametrize("name", ["phrase_matches", "lockstep_candidates", "lemma_mapping", "rewritten_conversations", "frozen_rewrites", "validated_rewrites"])
def test_little_is_kept_on_disk(spark, name):
    folder = "/root/testdata/sf0.01"
    before = kept(spark)
    QUERIES[name](spark, folder).count()
    assert kept(spark) - before < 4 * os.path.getsize(f"{folder}/conversations.parquet")


@pytest.mark.parametrize("name", ["backoff_chains", "phrase_matches", "lockstep_candidates", "lemma_mapping"])
def test_null_and_repeated_keys_of_conversations(spark, sf_dir, tmp_path, name):
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    # each word of a repeated key is in a sentence of its own: the SQL's order of equal places is open otherwise
    odd = spark.createDataFrame([(None, 1, "u", "Ten dark cats."), (3, None, "u", "Ten dark cats."), (90001, 1, "u", "walked"), (90001, 1, "u", "walked"), (90002, 1, "u", None), (90003, 1, "u", "")], talks.schema)
    talks.unionByName(odd).coalesce(2).write.parquet(f"{tmp_path}/conversations.parquet")
    assert_same(connection(str(tmp_path)), QUERIES[name](spark, str(tmp_path)), SQL[name])


def test_heads_and_children_without_a_join(spark, sf_dir):
    texts = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(*KEY, "text")
    got = trees.placed_with_children(parsing.parse(texts, KEY, by=KEY), KEY)
    tok = parsing.parse(texts, KEY).cache()
    placed = trees.context(tok, KEY).select(*KEY, "i", "prev_tag", "next_tag", "relpos", "head_tag")
    want = trees.with_children(tok, KEY).join(placed, [*KEY, "i"]).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_blocks_draw_as_whole_sets_do(spark, monkeypatch):
    monkeypatch.setattr(draws, "BLOCK", 3)
    members = spark.createDataFrame([(k, c, n + j) for k, n in (("p", 2), ("q", 7)) for j, c in enumerate("abcdefghij")] + [("p", "only", 4)], "key string, cand string, n long")
    sets = spark.createDataFrame([("s", ["p", "q"])], "set string, keys array<string>")
    shared, blocks = draws.shared_members(sets, members), draws.blocks_of(members)
    blocked = draws.blocked_members(shared, blocks).cache()
    assert blocked.count() == 4 and shared.count() == 10
    variants = spark.createDataFrame([("s1", "s", [1, 1]), ("s2", "s", [3, 1])], "line string, set string, times array<long>")
    lines = draws.lines_of(variants, blocked)
    asked = spark.range(300).selectExpr("id", "if(id % 2 = 0, 's1', 's2') AS line", "'s' AS set", "array('p', 'q') AS keys", "if(id % 2 = 0, array(1L, 1L), array(3L, 1L)) AS times", "if(id % 3 = 0, 'e', 'only') AS lemma")
    opened = draws.measured_lines(asked, lines, draws.held_keys(members).join(blocks, "cand"), "lemma").cache()
    got = {r.id: r.cand for r in draws.drawn_from_blocks(opened, blocked, ["id"], "lemma", 5).collect()}
    weigh = lambda t: [("abcdefghij"[j], 1000 * (t * (2 + j) + 7 + j) // (t + 1)) for j in range(10)]
    whole = draws.placed_members(spark.createDataFrame([(f"s{k}", c, w) for k, t in ((1, 1), (2, 3)) for c, w in weigh(t)], "set string, cand string, w long"))
    plain = draws.open_requests(asked.select("id", "lemma", asked["line"].alias("set")), whole, "lemma")
    assert got == {r.id: r.cand for r in draws.drawn(plain, whole, ["id"], 5).collect()} and len(got) == 300
    assert {(r.id, r.n_cands, r.weight) for r in opened.collect()} == {(r.id, r.n_cands, r.weight) for r in plain.collect()}


def test_lockstep_keeps_its_rows_only(spark):
    folder = "/root/testdata/sf0.1"
    before = kept(spark)
    QUERIES["lockstep_candidates"](spark, folder).count()
    assert kept(spark) - before < 1.5 * os.path.getsize(f"{folder}/conversations.parquet")


def test_lockstep_of_long_conversations_and_several_parts(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(rewriting, "WHOLE", 1000)
    monkeypatch.setattr(rewriting, "PART", 5000)
    assert_same(connection(sf_dir), rewriting.lockstep_candidates(spark, sf_dir), SQL["lockstep_candidates"])


def test_chains_from_the_fields_of_keys(spark, sf_dir):
    rows = rewriting.chained_tokens(spark, sf_dir).selectExpr("chain[0] AS bucket", "chain").distinct()
    fields = context.key_fields(rows.select("bucket").distinct()).localCheckpoint()
    got = fields.withColumn("chain", context.backoff_chain()).select("bucket", "chain")
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.collect()))


@pytest.mark.parametrize("tile", [None, 3])
def test_sums_of_lines_without_their_members(spark, monkeypatch, tile):
    if tile:
        monkeypatch.setattr(draws, "COUNTS", tile)
        monkeypatch.setattr(draws, "SETS", tile)
        monkeypatch.setattr(draws, "CELLS", tile)
    members = spark.createDataFrame([(k, f"c{j}", 2 + (j * p) % 7) for k, p in (("p", 2), ("q", 3), ("r", 5), ("none shared", 1)) for j in range(40 * (k == "none shared"), 40 + 40 * (k == "none shared"), p)], "key string, cand string, n long")
    keys = [["p", "q"], ["p", "q", "r"], ["q", "r"], ["p", "absent"], ["none shared", "p"]]
    rows = [(f"{k} {t}", "".join(k), k, [t + j for j in range(len(k))]) for k in keys for t in range(1, 7)]
    variants = spark.createDataFrame(rows, "line string, set string, keys array<string>, times array<long>")
    shared = draws.shared_members(variants.select("set", "keys").dropDuplicates(["set"]), members)
    want = draws.lines_of(variants.select("line", "set", "times"), draws.blocked_members(shared, draws.blocks_of(members)))
    got = {tuple(r) for r in draws.line_sums(variants.select("line", "keys", "times"), members).collect()}
    assert got == {tuple(r) for r in want.select("line", "total", "n").collect()} and len(got) == 18


SMALL_HEAP = """
import sys
from pyspark.sql import SparkSession
import __spark_entry__ as entry
folder, scratch = sys.argv[1:]
spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.local.dir", scratch).config("spark.memory.fraction", "0.2").config("spark.checkpoint.dir", f"file://{scratch}/shared").getOrCreate()
print("ROWS", entry.queries()["phrase_matches"](spark, folder).count())
"""


def test_phrases_where_driver_and_tasks_share_little_memory(spark, tmp_path):
    talks = spark.read.parquet("/root/testdata/sf0.1/conversations.parquet")
    talks.crossJoin(spark.range(4).withColumnRenamed("id", "copy")).selectExpr("conv_id + copy * 1000000 AS conv_id", "turn", "role", "text").write.parquet(f"{tmp_path}/conversations.parquet")
    env = os.environ | {"PYTHONPATH": str(Path(entry.__file__).parent), "PYSPARK_SUBMIT_ARGS": "--driver-memory 600m pyspark-shell"}
    run = subprocess.run([sys.executable, "-c", SMALL_HEAP, str(tmp_path), str(tmp_path)], env=env, capture_output=True, text=True, timeout=180)
    want = QUERIES["phrase_matches"](spark, "/root/testdata/sf0.1").count()
    assert f"ROWS {4 * want}" in run.stdout, run.stderr[-2000:]


def test_phrases_without_sorts_or_python(spark, sf_dir):
    plan = QUERIES["phrase_matches"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and not re.search("Sort|Window|ExistingRDD|Python|Arrow", plan)


def test_phrases_never_broadcast_the_words(spark, sf_dir):
    # a list from Python has no known size, and texts in small files seem the lesser side
    texts = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(*KEY, "text")
    phrases = spark.createDataFrame([("of the",)], "phrase string")
    for found in (trees.phrase_matches(parsing.parse(texts, KEY), phrases, KEY), trees.phrases_of_words(texts.select(*KEY, parsing.words_of().alias("words")), phrases, KEY, parsing.ENDS)):
        assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_phrases_of_words_as_of_tokens(spark, sf_dir):
    texts = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(*KEY, "text")
    odd = ["of the. Of The", "of. the", "! ! of the", "OF", "", None, "...", "a of the b of the", "ÉTÉ İstanbul’s été İSTANBUL’S"]
    texts = texts.unionByName(spark.createDataFrame([(-1, j, t) for j, t in enumerate(odd)], texts.schema)).cache()
    tok = parsing.parse(texts, KEY).cache()
    phrases = spark.createDataFrame([(p,) for p in ("of the", "Of the", "the", ". .", "!", "! of", "of the .", "a of the b", "été İstanbul’s", "absent", "")], "phrase string")
    for longest in (1, 3, 4):
        want = trees.phrase_matches(tok, phrases, KEY, longest)
        got = trees.phrases_of_words(texts.select(*KEY, parsing.words_of().alias("words")), phrases, KEY, parsing.ENDS, longest)
        assert got.dtypes == want.dtypes and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 5


def test_phrases_of_repeated_and_null_keys(spark, sf_dir, tmp_path):
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    # equal texts: the order of equal places doesn't matter
    odd = [(k, t, "u", text) for k, t, n, text in ((None, 1, 3, "One of the cats. In the house"), (None, None, 2, "and of the"), (7, None, 1, "In the house of the cats"), (90001, 1, 2, "de la of the"), (90002, 1, 1, "and of the")) for _ in range(n)]
    talks.unionByName(spark.createDataFrame(odd, talks.schema)).write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["phrase_matches"](spark, str(tmp_path))
    joins = re.findall("(?:BroadcastHash|SortMerge)Join .*", got._jdf.queryExecution().executedPlan().toString())
    assert len(joins) == 4 and all("phrase" in x and "BuildRight" in x for x in joins if "Broadcast" in x)
    assert_same(connection(str(tmp_path)), got, SQL["phrase_matches"])
