"""Each stage of the pipeline against brute force on its own input."""

import hashlib
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import pytest
from glossa.llm import bpe, common, quality_rules, queries

from .test_tables import norm, roots_by_hand, targets_by_hand
from .test_texts import PATH, WORD, base_by_hand, fingerprint_by_hand

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def bag(rows):
    return Counter(tuple(r[c] for c in COLUMNS) for r in rows)


def one_of_each(rows, group, text):
    """(id, text) of the row that stays in each group: the smallest id, null last, then by text."""
    members = defaultdict(list)
    for i, r in enumerate(rows):
        members[group(i, r)].append((r.doc_id is None, r.doc_id or 0, text(r)))
    return Counter((None if none else i, t) for none, i, t in map(min, members.values()))


def exact_by_hand(rows):
    return one_of_each(rows, lambda i, r: norm(r.text), lambda r: norm(r.text))


def near_groups(rows):
    fps = [fingerprint_by_hand(r.text) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4]
    return roots_by_hand(range(len(rows)), links)


def mix_by_hand(rows):
    """Copies of each row: the SQL's words of each document, rounded to whole texts."""
    con = duckdb.connect()
    con.execute("create table documents as select unnest($1) as doc_id, unnest($2) as text, unnest($3) as source", [[r.doc_id for r in rows], [r.text for r in rows], [r.source for r in rows]])
    sql = queries.ORACLE["op3_mix_sources"].replace("SELECT k.doc_id,", "SELECT k.source, k.doc_id,")
    taken = con.sql(sql.replace("SELECT doc_id, size, source_size, target,", "SELECT source, doc_id, size, source_size, target,")).fetchall()
    whole = defaultdict(lambda: [0, 0, 0])
    for s, i, size, source_size, target, words in taken:
        at = whole[(s, i, size)]
        at[0], at[1], at[2] = at[0] + words, at[1] + 1, size
    return {k: int(words / n / size + 0.5) if size else 0 for k, (words, n, size) in whole.items()}


@pytest.mark.parametrize("name", ["documents", "edge_docs"])
def test_stages(spark, sf_dir, name, request, tmp_path):
    docs = request.getfixturevalue(name)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    verdict = quality_rules.quality_rules(docs, labels).filter("kept").collect()
    results = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        results.append((before, after.collect()))
        if k < 4:
            assert after.columns == COLUMNS
        if not (k == 0 and name == "edge_docs"):  # the rules leave little of the short rows: later stages get them all
            docs = after
    (b0, a0), (b1, a1), (b2, a2), (b3, a3), (b4, a4) = results

    passed = [r for r in b0 if not (base_by_hand(r.text)[0] < 50 or 100 * base_by_hand(r.text)[4] > 50 * base_by_hand(r.text)[0])]
    assert not bag(a0) - bag(passed)
    assert Counter(r.doc_id for r in a0) == Counter(r.doc_id for r in verdict)
    if name == "documents":
        assert len(a0) > 0.9 * len(passed)

    assert Counter((r.doc_id, norm(r.text)) for r in a1) == exact_by_hand(b1) and not bag(a1) - bag(b1)
    group = near_groups(b2)
    assert len(a2) == len(set(group.values())) and not bag(a2) - bag(b2)
    top = {r.doc_id: group[i] for i, r in enumerate(b2)}
    least = defaultdict(list)
    for i, r in enumerate(b2):
        least[group[i]].append((r.doc_id is None, r.doc_id or 0))
    assert sorted(map(str, (r.doc_id for r in a2))) == sorted(str(None if none else i) for none, i in map(min, least.values())) and top

    copies = mix_by_hand(b3)
    times = Counter()
    for r in b3:
        times[tuple(r[c] for c in COLUMNS)] += copies[(r.source, r.doc_id, len(WORD.findall(r.text or "")))]
    assert bag(a3) == +times
    if name == "documents":
        sizes, got, longest = defaultdict(int), Counter(), Counter()
        for r in b3:
            sizes[r.source] += len(WORD.findall(r.text or ""))
            longest[r.source] = max(longest[r.source], len(WORD.findall(r.text or "")))
        for r in a3:
            got[r.source] += len(WORD.findall(r.text or ""))
        assert all(abs(got[s] - t) <= longest[s] for s, t in targets_by_hand(sizes).items())

    want = Counter()
    enc = bpe.encoder(PATH, corpus_pipeline.public_tokenizers.PATTERN)
    for r in b4:
        ids = enc.encode_batch([r.text or ""])[0]
        want[(r.doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())] += 1
    assert Counter(map(tuple, a4)) == want


def test_empty_input(spark, sf_dir, empty_docs, tmp_path):
    docs = empty_docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.count() == 0


def test_two_runs_in_one_folder(spark, sf_dir):
    """Two threads run the whole pipeline at a time: neither deletes what the other reads."""
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(2) as pool:
        first, second = pool.map(lambda _: corpus_pipeline.run(spark, sf_dir), range(2))
    assert first.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and first.count() > 50
    assert Counter(first.collect()) == Counter(second.collect())


def test_stages_keep_columns_of_any_name(spark, sf_dir, documents, tmp_path):
    """Input columns that are called what the operators call their own."""
    from pyspark.sql import functions as F

    names = ("copies", "_key", "root", "row", "token", "id", "own", "key", "kept", "times", "_copy", "fp", "size", "words", "w", "a.b")
    docs = documents.limit(60)
    for c in names:
        docs = docs.withColumn(c, F.lit(c))
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns == [*COLUMNS, *names] and docs.count() > 0
        assert docs.select(*(F.col(f"`{c}`") for c in names)).distinct().collect() == [names]


def test_one_row_of_rows_that_repeat_id_and_text(spark, sf_dir):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (1, text, "de", "s", 2), (2, text, "en", "s", 1), (None, "no id", "en", "s", 1), (None, "no id", "en", "s", 1), (3, "one", "en", "s", 1), (3, "two", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for stage in (corpus_pipeline.drop_exact_copies, corpus_pipeline.drop_near_copies):
        out = Counter((r.doc_id, r.text) for r in stage(spark, docs, sf_dir).collect())
        assert out == {(1, text): 1, (None, "no id"): 1, (3, "one"): 1, (3, "two"): 1}


def test_runs_have_folders_of_their_own(spark):
    """Two threads in one shared folder: neither deletes what the other has written."""
    from concurrent.futures import ThreadPoolExecutor

    def work(n):
        rows = common.stored(spark.range(n), "rows")
        common.drop_stored(spark)
        kept = common.stored(spark.range(n), "rows")
        return rows, kept

    with ThreadPoolExecutor(2) as pool:
        (_, a), (_, b) = pool.map(work, (5, 7))
    mine = common.stored(spark.range(3), "rows")
    common.drop_stored(spark)
    assert (a.count(), b.count()) == (5, 7) and mine.columns == ["id"]
