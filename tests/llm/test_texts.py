"""Operators on single texts against brute force: quality rules, BPE, fingerprints, chunks, classifier."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from glossa.llm import bpe, quality_classifier, quality_rules, simhash, substring_dedup, textstats
from hypothesis import given, settings
from hypothesis import strategies as st

from .conftest import edge_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATH = P.path("byte_bpe_multi_50k.tiktoken")


def base_by_hand(text):
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)


@given(st.text(alphabet="ab \n\t#é|日\x0b", max_size=80))
@settings(max_examples=300, deadline=None)
def test_statistics_match_their_definition(text):
    assert textstats.stats(text)[:5] == base_by_hand(text)


def test_statistics_on_documents_and_edge_cases(documents):
    for t in [r.text for r in documents.collect()] + edge_texts():
        assert textstats.stats(t)[:5] == base_by_hand(t)


def test_quality_rules_query(spark, documents, sf_dir, clash):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = {r.doc_id: r for r in quality_rules.quality_rules(clash(documents), labels).collect()}
    rows = documents.collect()
    assert len(out) == len(rows)
    for d in rows:
        n, chars, symbols, dup, rep = base_by_hand(d.text)
        r = out[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n)
        assert not (r.base_failed and r.kept)
    good = [out[x.doc_id] for x in labels.filter("quality = 1").collect() if not out[x.doc_id].base_failed]
    assert np.mean([r.kept for r in good]) > 0.9


def test_quality_rules_edges(spark, edge_docs, empty_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality_rules.quality_rules(edge_docs, labels).collect()
    assert len(out) == edge_docs.count() and all(r.kept == (not r.base_failed) for r in out)
    assert quality_rules.quality_rules(empty_docs, labels).count() == 0
    odd = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (2, None, 0), (10**9, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality_rules.quality_rules(edge_docs, odd).count() == edge_docs.count()


def test_forest_isolates_what_is_far():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    forest = quality_rules.IsolationForest(x, np.ones(4))
    assert forest.score(np.full((1, 4), 6.0))[0] > np.quantile(forest.score(x), 0.99)


def test_verdicts_by_walking_the_trees(spark):
    """Path lengths, scores, the threshold and the verdict, a row and a tree at a time."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    forest, threshold = quality_rules.fit(docs, labels)

    def walk(x):
        total = 0.0
        for axis, cut, left, right, path in forest.trees:
            at = 0
            while left[at] != at or right[at] != at:
                at = left[at] if x[axis[at]] <= cut[at] else right[at]
            total += path[at]
        h = np.log(forest.size - 1) + np.euler_gamma
        return 2.0 ** (-total / len(forest.trees) / (2 * h - 2 * (forest.size - 1) / forest.size))

    out = {r.doc_id: r for r in quality_rules.scored(docs, forest, threshold).collect()}
    label = {r.doc_id: r.quality for r in labels.collect()}
    good, bad = [], []
    for r in docs.collect():
        raw = np.array([textstats.stats(r.text)])
        odd = walk(quality_rules.vector(raw)[0])
        assert abs(out[r.doc_id].anomaly - odd) < 1e-12
        assert out[r.doc_id].kept == (not out[r.doc_id].base_failed and odd <= threshold)
        if r.doc_id in label and not out[r.doc_id].base_failed:
            (good if label[r.doc_id] else bad).append(odd)
    # the threshold is the lowest that spares the stated share of good rows, at most moved up to the next bad one
    least = sorted(good)[int(np.ceil((1 - quality_rules.SPARE) * (len(good) - 1)))]
    beyond = [x for x in bad if x > least + 1e-9]
    assert least <= threshold <= (min(beyond) if beyond else least + 1e-8)


def test_fitting_sample_is_bounded(spark):
    docs = spark.range(2000).selectExpr("id % 500 AS doc_id", "concat('text ', id) AS text")
    labels = spark.range(500).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality")
    sample = quality_rules.labelled_sample(docs, labels, "quality", 100).collect()
    assert len(sample) == len({r.doc_id for r in sample}) == 100
    assert sorted(map(tuple, sample)) == sorted(map(tuple, quality_rules.labelled_sample(docs.repartition(7), labels, "quality", 100).collect()))


def test_log_densities_by_inverse_and_determinant():
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(size=(300, 11)), rng.normal(size=(500, 11)) * 1.5 + 1])
    label = np.repeat([0, 1], [300, 500])
    model = quality_classifier.QuadraticDiscriminant(x, label)
    z = (x - x.mean(0)) / x.std(0)
    parts = [z[label == k] for k in (0, 1)]
    covs = [np.cov(p.T) for p in parts]
    pooled = (300 * covs[0] + 500 * covs[1]) / 800
    dens = []
    for p, c in zip(parts, covs):
        s = 0.8 * c + 0.1 * np.diag(np.diag(c)) + 0.1 * pooled + 1e-3 * np.eye(11)
        far = np.einsum("ij,jk,ik->i", z - p.mean(0), np.linalg.inv(s), z - p.mean(0))
        dens.append(-0.5 * (far + np.linalg.slogdet(s)[1]))
    assert np.allclose(model.difference(x), dens[1] - dens[0] + np.log(501 / 301))
    order = np.argsort(model.difference(x))
    assert (np.diff(model.score(x)[order]) >= 0).all() and abs(model.score(x).mean() - label.mean()) < 0.01


def test_classifier_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = {r.doc_id: r for r in quality_classifier.quality_classifier(docs, labels).collect()}
    assert len(out) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in out.items())
    held = [(out[x.doc_id].predicted, x.quality) for x in labels.collect() if out[x.doc_id].held_out]
    assert np.mean([p == q for p, q in held]) > 0.93


def test_classifier_edges(spark, edge_docs, empty_docs):
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality_classifier.quality_classifier(edge_docs, labels).collect()
    assert len(out) == edge_docs.count() and all(0 <= r.score <= 1 for r in out)
    assert quality_classifier.quality_classifier(empty_docs, labels).count() == 0


@pytest.fixture(scope="module")
def reference():
    ranks = bpe.encoder(PATH, P.PATTERN).ranks
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks.ids, special_tokens={})


def ids_of(reference, text):
    return np.array(reference.encode_ordinary(text or ""), dtype="<u4").tobytes()


@given(st.lists(st.text(alphabet="aeé ñß\n\t 　日本12'stdlve!#🙂\r", max_size=60), max_size=6))
@settings(max_examples=200, deadline=None)
def test_bpe_matches_the_library(reference, texts):
    enc = bpe.encoder(PATH, P.PATTERN)
    got = enc.encode_batch(texts)
    assert got == [ids_of(reference, t) for t in texts]
    assert [enc.decode(g) for g in got] == [t.encode() for t in texts]


@given(st.binary(min_size=1, max_size=70))
@settings(max_examples=200, deadline=None)
def test_both_trees_agree(piece):
    ranks = bpe.encoder(PATH, P.PATTERN).ranks
    alone = np.array(bpe.encode_piece(piece, ranks), dtype="<u4").tobytes()
    if piece not in ranks.ids:
        assert bpe.encode_pieces([piece, b"ab", piece], ranks)[::2] == [alone, alone]
    assert b"".join(ranks.bytes[i] for i in np.frombuffer(alone, "<u4")) == piece


def test_every_character_splits_as_in_the_library(reference):
    texts = [f"{chr(c)}a {chr(c)}{chr(c)} b{chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 7 == 0 or 0x10D00 <= c < 0x1FA00)]
    enc = bpe.encoder(PATH, P.PATTERN)
    for a in range(0, len(texts), 5000):
        assert enc.encode_batch(texts[a : a + 5000]) == [ids_of(reference, t) for t in texts[a : a + 5000]]


def test_bpe_query(reference, documents, edge_docs, empty_docs):
    for docs in (documents, edge_docs):
        want = Counter((r.doc_id, len(i) // 4, hashlib.sha256(i).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.collect() for i in [ids_of(reference, r.text)])
        assert Counter(map(tuple, bpe.round_trip(docs, PATH, P.PATTERN).collect())) == want
    assert bpe.round_trip(empty_docs, PATH, P.PATTERN).count() == 0
    back = bpe.decode(bpe.encode(edge_docs, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert Counter((r.doc_id, bytes(r.text).decode()) for r in back) == Counter((r.doc_id, r.text or "") for r in edge_docs.collect())


def fingerprint_by_hand(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(documents):
    for t in edge_texts()[:27] + [r.text for r in documents.limit(60).collect()]:
        assert simhash.fingerprint(t) == fingerprint_by_hand(t)


@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=4, unique=True))
def test_close_pairs_share_a_key(fp, flips):
    other = fp
    for f in flips:
        other ^= 1 << f
    assert any((fp & m % 2**64) == (other & m % 2**64) for m in simhash.masks())


@given(st.binary(max_size=3000))
@settings(max_examples=100, deadline=None)
def test_chunks_partition_a_text(data):
    ends = substring_dedup.chunk_ends(np.frombuffer(data, dtype=np.uint8))
    sizes = np.diff(ends, prepend=0)
    assert (sizes > 0).all() and sizes.sum() == len(data)
    assert not len(sizes) or sizes.max() <= substring_dedup.HASH + 2 * substring_dedup.WINDOW


@given(st.integers(0, 2**32), st.binary(max_size=40))
@settings(max_examples=60, deadline=None)
def test_chunks_come_back_after_an_insertion(seed, inserted):
    data = np.random.default_rng(seed).integers(0, 256, 2000).astype(np.uint8).tobytes()
    ends = substring_dedup.chunk_ends(np.frombuffer(data, dtype=np.uint8))
    moved = substring_dedup.chunk_ends(np.frombuffer(inserted + data, dtype=np.uint8)) - len(inserted)
    far = substring_dedup.HASH + substring_dedup.WINDOW
    assert {e for e in ends.tolist() if e > far} == {e for e in moved.tolist() if e > far}


def test_quality_threshold_is_that_of_all_labelled_rows(spark, monkeypatch):
    texts = [(i, f"w{i % 7} " * 3 + " ".join(f"word{j * (i % 97)} x{j}" for j in range(40 + i % 50)) + " #" * (i % 11 == 0)) for i in range(1200)]
    docs, labels = spark.createDataFrame(texts, "doc_id long, text string"), spark.range(1200).selectExpr("id AS doc_id", "int(id % 11 <> 0) AS quality")
    monkeypatch.setattr(quality_rules, "TREES", 4)
    monkeypatch.setattr(quality_rules, "TREE_ROWS", 16)  # the trees take 64 rows
    monkeypatch.setattr(quality_rules, "FIT_ROWS", 64, raising=False)
    forest, threshold = quality_rules.fit(docs, labels)
    raw = np.array([textstats.stats(t) for _, t in texts])
    use, good = ~quality_rules.base_failed(raw), np.arange(1200) % 11 != 0
    score = forest.score(quality_rules.vector(raw))
    least = np.quantile(score[use & good], 1 - quality_rules.SPARE, method="higher") + 1e-9
    beyond = score[use & ~good & (score > least)]
    assert threshold == pytest.approx((least + beyond.min()) / 2 if len(beyond) else least, abs=1e-12)
    vectors = quality_rules.labelled_vectors(docs, labels)
    assert vectors.count() == use.sum()
    values = vectors.select("v0").toPandas()["v0"].sort_values().tolist()
    assert [quality_rules.order_statistic(vectors, "v0", k, few=3) for k in (0, 5, 700, len(values) - 1)] == [values[k] for k in (0, 5, 700, len(values) - 1)]
