"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, then Hamming distances.

A 64-bit fingerprint is cut into 7 blocks. Two fingerprints that differ in at most 4 bits agree on at least
3 whole blocks, so each fingerprint gets one key for each of the 35 choices of 3 blocks (27 or 28 bits), and
rows that share a key are compared. Only distinct fingerprints take part; copies follow theirs afterwards.

Within a key nothing like all pairs is emitted: a search from row to row emits one link for each row that it
reaches, a spanning forest of the close pairs. A key with more than SPLIT rows is split on its other bits, by the
same principle: they are cut into 8 parts, of which a close pair shares at least 4, so that 70 keys of about 45
bits take its place. What is left free in such a key are 19 bits or less, 2^19 fingerprints at most. A key with
more than CHUNK rows is cut into chunks by a hash, and every pair of chunks is a group of its own of at most about
two chunks, so no close pair is lost and no group is gathered in one task. The distributed components of these
links give the classes.

Defined cases: a null text counts as empty; a text without a word has fingerprint zero and is linked like any
other; a text of fewer than 4 words is one shingle; the component id is the smallest id reachable, null only
if no row of the component has one; the row of a component that is marked as kept has that id and, of several,
the smallest text hash; repeated rows count as copies, and are marked alike; empty tables give empty results;
other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import short_batches, stored
from glossa.llm.components import connected_components

SHINGLE, DISTANCE, SEED = 4, 4, 42
#: First bits of the blocks, and the number of blocks that a close pair shares.
EDGES = (0, 9, 18, 27, 36, 45, 54, 64)
SHARED = len(EDGES) - 1 - DISTANCE
CHUNK = 2048
#: Rows of a key beyond which pairs of chunks would be more rows than the keys of the second level are.
SPLIT = 70 * CHUNK
PARTS, SHARED_PARTS = 8, 4

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_OFFSETS = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: str | None) -> int:
    """The fingerprint as an unsigned integer."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and exactly the contract's white space
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - SHINGLE + 1)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends][:n]
    view = [xxhash.xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[min(SHINGLE, len(words)) - 1 :])]
    h = np.array(view, dtype="<u8").view(np.uint8).reshape(-1, 8)
    seen = np.bincount((h + _OFFSETS).ravel(), minlength=2048).reshape(8, 256)
    ones = (seen @ _BITS).ravel()
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def text_hash(text: Column) -> Column:
    """Tells rows of one id apart by their text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp) with the fingerprint as a signed long."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in b["text"].to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.record_batch([b["doc_id"], b["text_hash"], pa.array(fp)], names=["doc_id", "text_hash", "fp"])

    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), text_hash(text).alias("text_hash"))
    return texts.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def masks() -> list[int]:
    """One mask for each choice of SHARED blocks, as signed longs."""
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(EDGES, EDGES[1:])]
    return [_signed(sum(c)) for c in combinations(blocks, SHARED)]


def finer_masks() -> list[list[int]]:
    """For each of masks(), the masks that take its place in a key with many rows."""
    out = []
    for m in masks():
        free = [b for b in range(64) if not m >> b & 1]
        ends = [round(k * len(free) / PARTS) for k in range(PARTS + 1)]
        parts = [sum(1 << b for b in free[x:y]) for x, y in zip(ends, ends[1:])]
        out.append([_signed((m % 2**64) | sum(c)) for c in combinations(parts, SHARED_PARTS)])
    return out


def finer_keys(rows: DataFrame) -> DataFrame:
    """(part, block, fp) of the second level, from rows of keys with many rows."""
    finer = finer_masks()
    mine = F.element_at(F.from_json(F.lit(json.dumps(finer)), "array<array<bigint>>"), F.col("part") + 1)
    number = F.lit(len(finer)) + F.col("part") * len(finer[0])
    keys = F.transform(mine, lambda m, j: F.struct((number + j).alias("part"), F.col("fp").bitwiseAND(m).alias("block")))
    return rows.select("fp", F.explode(keys).alias("k")).select("k.part", "k.block", "fp")


def block_keys(fps: DataFrame) -> DataFrame:
    """(part, block, fp): the keys of each distinct fingerprint."""
    keys = F.array(*(F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("block")) for k, m in enumerate(masks())))
    return fps.select("fp", F.explode(keys).alias("k")).select("k.part", "k.block", "fp")


def _close(a: np.ndarray, b: np.ndarray | np.int64) -> np.ndarray:
    """Which fingerprints differ in at most DISTANCE bits; bitwise_count of a signed number counts its absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64)) <= DISTANCE


def _forest(fp: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links of a spanning forest of the close pairs among fp."""
    left, right, rest = [], [], fp
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            u = queue.pop()
            near = _close(rest, u)
            if near.any():
                new = rest[near]
                left.append(np.full(len(new), u)), right.append(new)
                queue.extend(new)
                rest = rest[~near]
    return left, right


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among rows of equal (part, block, i, j); the partition is sorted by these."""

    def links(cols: list[np.ndarray], fp: np.ndarray) -> tuple[list, list]:
        new = np.ones(len(fp), dtype=bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(fp)))
        left, right = [], []
        pair = start[size == 2]
        near = _close(fp[pair], fp[pair + 1])
        left.append(fp[pair][near]), right.append(fp[pair + 1][near])
        for s, n in zip(start[size > 2], size[size > 2]):
            a, b = _forest(np.unique(fp[s : s + n]))
            left += a
            right += b
        return left, right

    carry: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if carry is None else pa.concat_tables([carry, t])
        cols = [t[c].to_numpy() for c in ("part", "block", "i", "j")]
        n = len(t)
        if not n:
            continue
        last = np.flatnonzero(np.any([c != c[-1] for c in cols], axis=0))
        cut = int(last[-1]) + 1 if len(last) else 0
        carry = t.slice(cut)
        if cut:
            yield _batch(*links([c[:cut] for c in cols], t["fp"].to_numpy()[:cut]))
    if carry is not None and len(carry):
        yield _batch(*links([carry[c].to_numpy() for c in ("part", "block", "i", "j")], carry["fp"].to_numpy()))


def _batch(left: list[np.ndarray], right: list[np.ndarray]) -> pa.RecordBatch:
    a = np.concatenate(left) if left else np.zeros(0, dtype=np.int64)
    b = np.concatenate(right) if right else np.zeros(0, dtype=np.int64)
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _shared(keys: DataFrame, name: str) -> DataFrame:
    """Keys that more than one fingerprint has, with the number of these in the column g."""
    # a count is a long: a key's rows are combined before the shuffle
    sizes = keys.groupBy("part", "block").agg(F.count(F.lit(1)).alias("g")).filter("g > 1")
    return keys.join(stored(sizes, name), ["part", "block"])


def dealt_keys(fps: DataFrame) -> DataFrame:
    """(part, block, i, j, fp): the groups that are searched, each a key's pair of chunks, of at most about two chunks."""
    rows = _shared(block_keys(fps), "keys")
    if not rows.filter(F.col("g") > SPLIT).isEmpty():
        finer = _shared(finer_keys(rows.filter(F.col("g") > SPLIT)), "finer-keys")
        rows = rows.filter(F.col("g") <= SPLIT).unionByName(finer)
    chunks = F.ceil(F.col("g") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("fp"), chunks.cast("long")).cast("int")
    rows = rows.select("part", "block", "fp", own.alias("c"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("d"))
    return rows.select("part", "block", F.least("c", "d").alias("i"), F.greatest("c", "d").alias("j"), "fp")


def close_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints of `fps` within DISTANCE of each other."""
    dealt = dealt_keys(fps).repartition("part", "block", "i", "j").sortWithinPartitions("part", "block", "i", "j")
    return dealt.mapInArrow(_search, "a long, b long").distinct()


def simhash_components(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, text_hash, component_size, kept."""
    rows = stored(fingerprints(docs), "fingerprints")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    fps = stored(rows.groupBy("fp").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")), "distinct")
    roots = stored(connected_components(close_links(fps.select("fp"))), "roots")
    named = fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    named = stored(named, "named")
    # combined before the shuffle, and written: both sides of the joins are plain scans, so that the members of a large
    # component, and the copies of one fingerprint, can be split among tasks
    tops = stored(named.groupBy("root").agg(F.min("first").alias("top"), F.sum("n").alias("component_size")), "tops")
    whole = stored(named.select("fp", "root").join(tops, "root").select("fp", "top", "component_size"), "components")
    kept = F.col("doc_id").eqNullSafe(F.col("top.doc_id")) & (F.col("text_hash") == F.col("top.text_hash"))
    return rows.join(whole, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("top.doc_id").alias("component_id"), "text_hash", "component_size", kept.alias("kept"))
