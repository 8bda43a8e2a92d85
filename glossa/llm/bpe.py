"""Byte-level BPE with the ranks of a public vocabulary.

Each match of the split pattern is encoded separately. A segment tree over the byte positions of a piece
holds, at its root, the leftmost minimum rank among the pairs of live neighbours; a merge changes two leaves
and removes one, each in logarithmic time. Pieces of up to LANES bytes are encoded many at a time, one tree
per row of a matrix; longer ones (a run of one letter may be 100 kB long) by the same tree alone.

The ranks are read on the executors from a path that is a parameter, once per Python worker. Encoded pieces
are remembered in a table of bounded size.

Defined cases: a null text counts as empty and has no tokens; special tokens are ordinary text; equal texts
get equal ids; letters are those of the library's Unicode tables; every byte sequence decodes to itself; empty tables give empty results; other columns are not
read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import short_batches

LANES = 32
#: Entries of each of two tables of encoded units, and the longest unit (in characters) that they hold.
KEPT, KEPT_CHARS = 400_000, 40
NONE = np.int64(2**62)

#: A space before a character that isn't white space: every match of the pattern lies on one side of it.
_CUT = re.compile(r" (?=\S)")


class Ranks:
    """The vocabulary: token bytes by id, and the id that two neighbouring ids merge to."""

    def __init__(self, tokens: dict[bytes, int]):
        self.ids = tokens
        self.bytes = [b""] * (max(tokens.values()) + 1)
        for t, i in tokens.items():
            self.bytes[i] = t
        self.single = np.array([tokens[bytes([b])] for b in range(256)], dtype=np.int64)
        self.pairs: dict[int, int] = {}
        for t, i in tokens.items():
            for cut in range(1, len(t)):
                a, b = tokens.get(t[:cut]), tokens.get(t[cut:])
                if a is not None and b is not None:
                    self.pairs[a << 32 | b] = i
        self._hash()

    def _hash(self) -> None:
        """An open-addressed table of the pairs for whole arrays of keys."""
        keys = np.fromiter(self.pairs, dtype=np.int64, count=len(self.pairs))
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.key = np.full(1 << self.bits, -1, dtype=np.int64)
        self.value = np.full(1 << self.bits, NONE, dtype=np.int64)
        values = np.fromiter(self.pairs.values(), dtype=np.int64, count=len(self.pairs))
        at = self._slot(keys)
        while len(keys):
            free = self.key[at] == -1
            self.key[at[free]] = keys[free]
            self.value[at[free]] = values[free]
            lost = self.key[at] != keys
            # a slot that two keys took in one step holds the last; its value was written in the same order
            keys, values, at = keys[lost], values[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id of each pair of ids, NONE where it is no token; negative ids are no tokens."""
        keys = np.where((a < 0) | (b < 0), np.int64(-2), (a << 32) | np.maximum(b, 0))
        out = np.full(keys.shape, NONE, dtype=np.int64)
        at = self._slot(keys)
        rows = np.flatnonzero(keys >= 0)
        while len(rows):
            found = self.key[at[rows]]
            hit = found == keys[rows]
            out[rows[hit]] = self.value[at[rows[hit]]]
            rows = rows[~hit & (found != -1)]
            at[rows] = (at[rows] + 1) & ((1 << self.bits) - 1)
        return out


def encode_piece(piece: bytes, ranks: Ranks) -> list[int]:
    """Ids of one piece, by a segment tree over its byte positions."""
    n = len(piece)
    if (whole := ranks.ids.get(piece)) is not None:
        return [whole]
    size = 1 << max(0, n - 1).bit_length()
    ids, ahead, back = [int(ranks.single[b]) for b in piece], list(range(1, n + 1)), list(range(-1, n - 1))
    pairs, none = ranks.pairs, (1 << 62, 0)
    tree = [none] * (2 * size)
    for i in range(n - 1):
        rank = pairs.get(ids[i] << 32 | ids[i + 1])
        if rank is not None:
            tree[size + i] = (rank, i)  # compared by rank, then by place: the leftmost minimum
    for i in range(size - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])

    def put(i: int, value) -> None:
        i += size
        tree[i] = value
        while i > 1:
            i >>= 1
            best = min(tree[2 * i], tree[2 * i + 1])
            if tree[i] == best:
                break
            tree[i] = best

    def pair(i: int, j: int):
        rank = pairs.get(ids[i] << 32 | ids[j])
        return none if rank is None else (rank, i)

    while tree[1] != none:
        rank, i = tree[1]
        j = ahead[i]
        ids[i], ahead[i] = rank, ahead[j]
        put(j, none)
        if ahead[i] < n:
            back[ahead[i]] = i
            put(i, pair(i, ahead[i]))
        else:
            put(i, none)
        if back[i] >= 0:
            put(back[i], pair(back[i], i))
    out, i = [], 0
    while i < n:
        out.append(ids[i])
        i = ahead[i]
    return out


def encode_pieces(pieces: list[bytes], ranks: Ranks) -> list[bytes]:
    """Ids of many pieces of 1 to LANES bytes as little-endian 32-bit integers; one segment tree a row."""
    if not pieces:
        return []
    m, width = len(pieces), 1 << max(1, max(map(len, pieces)) - 1).bit_length()
    size = np.fromiter(map(len, pieces), dtype=np.int64, count=m)
    data = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(m, width)
    place = np.arange(width)
    ids = np.where(place < size[:, None], ranks.single[data], -1)
    ahead = np.minimum(place + 1, size[:, None])  # the next live position, or the length
    back = np.broadcast_to(place - 1, (m, width)).copy()
    nearest = np.concatenate([ids[:, 1:], np.full((m, 1), -1)], axis=1)
    leaf = ranks.merged(ids.ravel(), nearest.ravel()).reshape(m, width)
    # a node's value is rank * width + place, so that its minimum is the leftmost one
    tree = np.full((m, 2 * width), NONE, dtype=np.int64)
    tree[:, width:] = np.where(leaf < NONE, leaf * width + place, NONE)
    for at in range(width - 1, 0, -1):
        tree[:, at] = np.minimum(tree[:, 2 * at], tree[:, 2 * at + 1])

    def put(r: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
        at = at + width
        tree[r, at] = value
        span = width
        while span > 1:
            at, span = at >> 1, span >> 1
            tree[r, at] = np.minimum(tree[r, 2 * at], tree[r, 2 * at + 1])

    def pair(r: np.ndarray, i: np.ndarray, j: np.ndarray, ok: np.ndarray) -> np.ndarray:
        rank = ranks.merged(np.where(ok, ids[r, i], -1), np.where(ok, ids[r, np.minimum(j, width - 1)], -1))
        return np.where(rank < NONE, rank * width + i, NONE)

    rows = np.flatnonzero(tree[:, 1] < NONE)
    while len(rows):
        best = tree[rows, 1]
        i, rank = best % width, best // width
        j = ahead[rows, i]
        after = ahead[rows, j]
        ids[rows, i], ids[rows, j] = rank, -1
        ahead[rows, i] = after
        more = after < size[rows]
        back[rows[more], after[more]] = i[more]
        put(rows, j, np.full(len(rows), NONE))
        put(rows, i, pair(rows, i, after, more))
        b = back[rows, i]
        has = b >= 0
        put(rows[has], b[has], pair(rows[has], b[has], i[has], np.ones(int(has.sum()), dtype=bool)))
        rows = rows[tree[rows, 1] < NONE]
    live = ids >= 0
    flat = ids[live].astype("<u4").tobytes()
    ends = np.cumsum(live.sum(1)) * 4
    return [flat[a:z] for a, z in zip([0, *ends[:-1].tolist()], ends.tolist())]


@lru_cache(maxsize=1)
def _library_letters():
    """Whether the tokenizer library's own Unicode tables call a character a letter or a number."""
    import tiktoken

    ask = tiktoken.Encoding("letters", pat_str=r"\p{L}|\p{N}", mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    return lambda c: bool(ask.encode_ordinary(c))


@lru_cache(maxsize=1 << 16)
def _too_new(c: str) -> bool:
    """A letter or number of a Unicode version that the library doesn't know yet; only unassigned ones can be."""
    return unicodedata.category(c) == "Cn" and bool(regex.match(r"[\p{L}\p{N}]", c)) and not _library_letters()(c)


class Encoder:
    """Whole texts to ids and back, with a bounded memory of encoded units."""

    def __init__(self, ranks: Ranks, pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        # two generations: what the young one has not met again when it is full is forgotten
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _pieces(self, unit: str) -> list[str]:
        """The matches of the pattern; characters too new for the library count as unassigned ones."""
        if unit.isascii() or not any(map(_too_new, unit)):
            return self.pattern.findall(unit)
        plain = "".join("\U000f0000" if _too_new(c) else c for c in unit)
        return [unit[m.start() : m.end()] for m in self.pattern.finditer(plain)]

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of units not met before: their pieces are encoded together."""
        found = [[p.encode() for p in self._pieces(u)] for u in new]
        known: dict[bytes, bytes] = {}
        for p in {p for ps in found for p in ps}:
            if (i := self.ranks.ids.get(p)) is not None:
                known[p] = i.to_bytes(4, "little")
            elif len(p) > LANES:
                known[p] = np.array(encode_piece(p, self.ranks), dtype="<u4").tobytes()
        rest = sorted({p for ps in found for p in ps if p not in known}, key=len)
        for a in range(0, len(rest), 4096):  # like lengths together, so that little of the matrix is padding
            known.update(zip(rest[a : a + 4096], encode_pieces(rest[a : a + 4096], self.ranks)))
        return {u: b"".join([known[p] for p in ps]) for u, ps in zip(new, found)}

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """For each text, its ids as little-endian unsigned 32-bit integers."""
        split = []
        for t in texts:
            head, *tail = _CUT.split(t)
            split.append([head, *[" " + u for u in tail]])
        wanted = {u for s in split for u in s}
        found = {u: self.old[u] for u in wanted if u not in self.young and u in self.old}
        found |= self._learn([u for u in wanted if u not in self.young and u not in found])
        long = {u: v for u, v in found.items() if len(u) > KEPT_CHARS}
        self.young.update(found.items() - long.items() if long else found)
        young = self.young
        out = [b"".join([young[u] if u in young else long[u] for u in s]) for s in split]
        if len(young) > KEPT:
            self.old, self.young = young, {}
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.ranks.bytes.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=2)
def _encoder(ranks: bytes, pattern: str) -> Encoder:
    """The encoder of a rank file's contents (a base64 token and its rank on each line); one per Python worker."""
    return Encoder(Ranks({base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}), pattern)


def encoder(path: str, pattern: str) -> Encoder:
    with open(path, "rb") as f:
        return _encoder(f.read(), pattern)


def _sent(df: DataFrame, path: str) -> Broadcast[bytes]:
    """The rank file, read by the driver, for all executors: its size is that of a vocabulary, about 1 MB."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): the ids of every whole text, as the bytes of little-endian unsigned 32-bit integers."""
    short_batches(docs.sparkSession)
    ranks = _sent(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(ranks.value, pattern)
        for b in batches:
            ids = enc.encode_batch([t or "" for t in b["text"].to_pylist()])
            yield pa.record_batch([b["doc_id"], pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return _texts(docs).mapInArrow(run, "doc_id long, ids binary")


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text): ids back to bytes."""
    short_batches(tokens.sparkSession)
    ranks = _sent(tokens, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(ranks.value, pattern)
        for b in batches:
            yield pa.record_batch([b["doc_id"], pa.array([enc.decode(i or b"") for i in b["ids"].to_pylist()], pa.binary())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text binary")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document: encoded, then decoded, in one pass."""
    short_batches(docs.sparkSession)
    ranks = _sent(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(ranks.value, pattern)
        for b in batches:
            ids = enc.encode_batch([t or "" for t in b["text"].to_pylist()])
            hashes = [hashlib.sha256(i).hexdigest() for i in ids]
            texts = [hashlib.sha256(enc.decode(i)).hexdigest() for i in ids]
            columns = [b["doc_id"], pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(hashes, pa.string()), pa.array(texts, pa.string())]
            yield pa.record_batch(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
