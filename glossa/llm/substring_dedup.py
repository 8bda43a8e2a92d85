"""Substring deduplication by content-defined chunks.

A gear rolling hash over 16 bytes is winnowed: of every WINDOW neighbouring hashes the smallest cuts the text,
so boundaries depend on nearby content only, come back after an insertion, and are never further apart than
WINDOW. A chunk is known by a 64-bit digest. The smallest id that holds a digest keeps it; chunks of all other
documents that are held elsewhere are seeds.

A seed lies on a line: the keeping row and the distance from a place to the place there. A span is a stretch of
one line, so that its text is in the keeping document as it stands. Neighbouring seeds of one line that hold
MIN_WORDS words or more are a span by their digests alone, two of 64 bits at least; its ends are then compared
byte by byte, to where the texts stop to agree. Around fewer seeds of a line the whole stretch is compared, and
is a span if MIN_WORDS words or more agree. Stretches of one line that overlap are one. Of spans of several lines
that overlap, as few as cover the same bytes are reported: spans may overlap, but none is needless.

Digests are combined before each shuffle (the smallest holder and the largest id of a digest), so a passage
that many documents share is one row a task; the joins that bring it back to its documents have plain tables
on both sides, which Spark splits where one key has very many rows.

Defined cases: a null text counts as empty and has no chunk; rows that repeat an id are one document, as are
rows without an id (or with the largest one, 2^63 - 1), which come after all others; each row has its own spans; repeats inside one document are
not reported; of tied documents the smallest id keeps the passage; a digest that its keeping row holds several
times, as in periodic text, is followed to its first and its last place there; empty tables give empty results;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import forget, short_batches, stored, words_of

#: Mean bytes of a chunk, the most between two cuts, and the fewest words of a reported span. Ends are followed byte by
#: byte from one chunk on, and a stretch of 2 * WINDOW + HASH bytes holds one, wherever it begins.
MEAN, WINDOW, MIN_WORDS = 32, 64, 20
SEED = 5
#: Bytes of a hash. A stretch that agrees ends less than 2 * WINDOW + HASH bytes beyond its last seed.
HASH = 16
REACH = 2 * WINDOW + HASH
#: Stands for no id, after all others.
NO_ID = 2**63 - 1

#: Random 16-bit values of the bytes, from a fixed seed.
GEAR = np.random.default_rng(SEED).integers(0, 1 << 16, 256).astype(np.uint16)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def chunk_ends(data: np.ndarray) -> np.ndarray:
    """Ends (exclusive) of the chunks of a text's bytes."""
    n = len(data)
    if n < HASH + WINDOW:
        return np.array([n] if n else [], dtype=np.int64)
    h = GEAR[data]
    step = 1
    while step < HASH:  # a window of 2 * step bytes from two windows of step bytes
        h[step:] = h[step:] + (h[:-step] << np.uint16(step))
        step *= 2
    least = (h[HASH - 1 :].astype(np.uint64) << np.uint64(40)) | np.arange(HASH, n + 1, dtype=np.uint64)
    step = 1
    while step < WINDOW:  # of equal hashes the first; the last step overlaps
        more = min(step, WINDOW - step)
        least = np.minimum(least[:-more], least[more:])
        step += more
    least = least[np.flatnonzero(np.diff(least, prepend=np.uint64(0)))]
    ends = (least & np.uint64((1 << 40) - 1)).astype(np.int64)
    # equal hashes at equal distances, as in periodic text: as few of them as leave no gap above WINDOW
    gap = np.diff(ends, prepend=-n)
    same = np.diff(least >> np.uint64(40), prepend=np.uint64(1 << 20)) == 0
    same[1:] &= (gap[1:] == gap[:-1]) | ~same[:-1]
    place = np.arange(len(ends))
    nth = place - np.maximum.accumulate(np.where(same, 0, place))
    ends = ends[nth % np.where(same, WINDOW // np.maximum(gap, 1), 1).clip(1) == 0]
    return ends if ends[-1] == n else np.append(ends, n)


def word_starts(data: np.ndarray) -> np.ndarray:
    """Whether a word begins at each byte."""
    begins = ~_SPACE[data]
    begins[1:] &= _SPACE[data[:-1]]
    return begins


def around(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The four bytes before and the four bytes after each chunk as a signed long; zeros beyond the text."""
    p = np.concatenate([np.zeros(4, np.uint8), data, np.zeros(4, np.uint8)]).astype(np.uint64)
    four = p[:-3] | p[1:-2] << np.uint64(8) | p[2:-1] << np.uint64(16) | p[3:] << np.uint64(24)
    return (four[starts] << np.uint64(32) | four[ends + 4]).view(np.int64)


def text_table(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(row, doc_id, text): the texts as bytes, by a number of their row; doc_id is NO_ID for none.

    Texts that are too short for a span are left out: no span is in them, nor in any other text by them.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), text.alias("text"))
    return texts.filter(words_of(F.col("text")) >= min_words).withColumn("text", F.col("text").cast("binary"))


CHUNKS = "row long, doc_id long, digests array<long>, places array<long>, sizes array<tinyint>, beside array<long>"


def chunk_table(texts: DataFrame) -> DataFrame:
    """(row, doc_id, digests, places, sizes, beside): the chunks of each text of text_table() as arrays.

    places: the start of a chunk, 32 bits up, and the bytes from it to the last of its digest in the row, in periodic
    text above zero.
    """
    short_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, places, sizes, beside = [], [], [], []
            for raw in b["text"].to_pylist():
                data = np.frombuffer(raw, dtype=np.uint8)
                cut = chunk_ends(data)
                size = np.diff(cut, prepend=0)
                start = cut - size
                digest = [xxhash.xxh3_64_intdigest(raw[x:y]) for x, y in zip(start.tolist(), cut.tolist())]
                last = dict(zip(digest, start.tolist()))
                digests.append(np.array(digest, dtype=np.uint64).view(np.int64))
                places.append((start << 32) | (np.array([last[d] for d in digest], dtype=np.int64) - start))
                sizes.append(size.astype(np.uint8).view(np.int8))
                beside.append(around(data, start, cut))
            longs, bytes_ = pa.list_(pa.int64()), pa.list_(pa.int8())
            columns = [b["row"], b["doc_id"], pa.array(digests, longs), pa.array(places, longs), pa.array(sizes, bytes_), pa.array(beside, longs)]
            yield pa.record_batch(columns, names=["row", "doc_id", "digests", "places", "sizes", "beside"])

    return texts.mapInArrow(run, CHUNKS)


#: A part of a row's text to be compared with the text of `first_row`, `shift` bytes on, or (own is null) a span.
#: w_lo and w_hi words begin before lo and hi. `at` is a place that the sought stretch holds, -1 for any long one.
SPAN = "row long, doc_id long, lo int, hi int, w_lo int, w_hi int, n_chunks int, first long, first_row long, shift int"
#: k_row: the row whose text is needed, none (below 0) for a span.
PART = SPAN + ", k_row long, at int, begins boolean, own binary"
#: Bytes of parts in one Arrow batch.
BATCH_BYTES = 8 << 20


def _record(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    names, types = zip(*(x.split(" ") for x in schema.split(", ")))
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.record_batch([pa.array(c, kinds[t]) for c, t in zip(columns, types)], names=list(names))


class _Seeds:
    """The seeds of one row in the order of their places, and the words of its text."""

    def __init__(self, row: int, doc_id: int, raw: bytes, hits: dict[str, np.ndarray], min_words: int):
        self.row, self.doc_id, self.raw, self.n, self.min_words = row, doc_id, raw, len(raw), min_words
        data = np.frombuffer(raw, dtype=np.uint8)
        self.begins = word_starts(data)
        self.words = np.append(0, np.cumsum(self.begins))
        order = np.argsort(hits["start"])
        self.hits = hits = {k: v[order] for k, v in hits.items()}
        self.start = hits["start"].astype(np.int64)
        self.end = self.start + hits["size"].view(np.uint8)
        hits["first_start"] = hits["place"] >> 32
        hits["last_start"] = hits["first_start"] + (hits["place"] & 0xFFFFFFFF)
        self.again = hits["last_start"] != hits["first_start"]
        differ = (around(data, self.start, self.end) ^ hits["beside"]).view(np.uint64)
        # a stretch that goes on beyond a seed has the seed's neighbouring bytes
        self.left = ((differ >> np.uint64(56) == 0) | self.again) & (self.start > 0)
        self.right = ((differ & np.uint64(255) == 0) | self.again) & (self.end < self.n)
        wide_left = (differ >> np.uint64(32) == 0) & (self.start >= 4)
        wide_right = (differ & np.uint64(0xFFFFFFFF) == 0) & (self.end <= self.n - 4)
        # half of the other words are on one side; three words that begin there are four bytes at least
        self.through = (self.words[self.end] - self.words[self.start] > min_words - 6) | wide_left | wide_right | self.again

    def part(self, k: int, shift: int, lo: int, hi: int, chunks: int, at: int | None) -> tuple:
        """Bytes lo to hi on the line of seed k; a span if at is None, else to be compared."""
        w, h = self.words, self.hits
        own = (-1 - self.row, None, None, None) if at is None else (int(h["first_row"][k]), at, bool(self.begins[lo]), self.raw[lo:hi])
        return (self.row, self.doc_id, lo, hi, int(w[lo]), int(w[hi]), chunks, int(h["first"][k]), int(h["first_row"][k]), shift, *own)

    def _wide(self, k: int, shift: int, lo: int, hi: int, chunks: int) -> Iterator[tuple]:
        lo, hi = max(0, lo - REACH), min(self.n, hi + REACH)
        if self.words[hi] - self.words[lo] >= self.min_words:
            yield self.part(k, shift, lo, hi, chunks, -1)

    def lines(self) -> Iterator[tuple]:
        """Spans and parts of the seeds whose digest has one place in the keeping row."""
        once = np.flatnonzero(~self.again)
        shift = (self.hits["first_start"] - self.hits["start"]).astype(np.int64)
        once = once[np.lexsort((self.start[once], shift[once], self.hits["first_row"][once]))]
        row, line = self.hits["first_row"][once], shift[once]
        other = (row[1:] != row[:-1]) | (line[1:] != line[:-1])
        cuts = np.flatnonzero(other | (self.start[once][1:] != self.end[once][:-1])) + 1
        new_line = set((np.flatnonzero(other) + 1).tolist())
        few: list[np.ndarray] = []
        for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), len(once)]):
            if y == x:
                continue
            run = once[x:y]
            a, z = int(run[0]), int(run[-1])
            s, e, by = int(self.start[a]), int(self.end[z]), int(line[x])
            if few and (x in new_line or s - self.end[few[-1][-1]] >= 2 * REACH):
                yield from self._few(few, shift)
                few = []
            if y - x > 1 and self.words[e] - self.words[s] >= self.min_words:
                yield self.part(a, by, s, e, y - x, None)
                if self.left[a]:
                    yield self.part(a, by, max(0, s - REACH), int(self.end[a]), 0, s)
                if self.right[z]:
                    yield self.part(z, by, int(self.start[z]), min(self.n, e + REACH), 0, int(self.start[z]))
            else:
                few.append(run)
        if few:
            yield from self._few(few, shift)

    def _few(self, runs: list[np.ndarray], shift: np.ndarray) -> Iterator[tuple]:
        """Short runs of one line, near each other: one part."""
        seeds = np.concatenate(runs)
        if self.through[seeds].any():
            k = int(seeds[0])
            yield from self._wide(k, int(shift[k]), int(self.start[k]), int(self.end[seeds[-1]]), len(seeds))

    def periodic(self) -> Iterator[tuple]:
        """Parts of the seeds whose digest has several places in the keeping row.

        Neighbouring ones are compared whole on the lines of the first places of seeds near the beginning and of the
        last places of seeds near the end, and, as periods may be more there or fewer, in pieces around a seed every
        REACH bytes.
        """
        seeds = np.flatnonzero(self.again)
        cuts = np.flatnonzero(self.start[seeds][1:] != self.end[seeds][:-1]) + 1
        shifts = {c: (self.hits[c] - self.hits["start"]).astype(np.int64) for c in ("first_start", "last_start")}
        for run in np.split(seeds, cuts):
            if not len(run):
                continue
            s, e = int(self.start[run[0]]), int(self.end[run[-1]])
            near = {"first_start": run[self.start[run] < s + REACH], "last_start": run[self.end[run] > e - REACH]}
            whole = {(int(self.hits["first_row"][k]), int(shifts[c][k])): int(k) for c, ks in near.items() for k in ks}
            for (_, shift), k in whole.items():
                yield from self._wide(k, shift, s, e, len(run))
            last = s - REACH
            for k in run.tolist():
                if self.start[k] >= last + REACH:
                    last = int(self.start[k])
                    for c in shifts:
                        if (int(self.hits["first_row"][k]), int(shifts[c][k])) not in whole:
                            yield from self._wide(k, int(shifts[c][k]), last, int(self.end[k]), 1)


def _agreeing(p: dict, keep: bytes, min_words: int) -> Iterator[tuple]:
    """The stretches of a part that agree with the keeping text; keep begins at the part's place, or at the text's."""
    own = np.frombuffer(p["own"], dtype=np.uint8)
    begins = word_starts(own)
    begins[0] = p["begins"]
    words = np.append(0, np.cumsum(begins))
    skip = max(0, -(p["lo"] + p["shift"]))
    other = np.frombuffer(keep, dtype=np.uint8)[: len(own) - skip]
    same = np.zeros(len(own) + 2, dtype=np.int8)
    same[1 + skip : 1 + skip + len(other)] = own[skip : skip + len(other)] == other
    turns = np.diff(same)
    for s, e in zip(np.flatnonzero(turns == 1).tolist(), np.flatnonzero(turns == -1).tolist()):
        if words[e] - words[s] >= min_words if p["at"] < 0 else s <= p["at"] - p["lo"] < e:
            yield (p["row"], p["doc_id"], p["lo"] + s, p["lo"] + e, p["w_lo"] + int(words[s]), p["w_lo"] + int(words[e]), p["n_chunks"], p["first"], p["first_row"], p["shift"])


def _joined(spans: list[dict]) -> list[dict]:
    """Stretches of one line that overlap as one."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: (s["first_row"], s["shift"], s["lo"], -s["hi"])):
        last = out[-1] if out else None
        if last and (last["first_row"], last["shift"]) == (s["first_row"], s["shift"]) and s["lo"] <= last["hi"]:
            last["n_chunks"] = max(last["n_chunks"], s["n_chunks"]) if s["hi"] <= last["hi"] else last["n_chunks"] + s["n_chunks"]
            if s["hi"] > last["hi"]:
                last["hi"], last["w_hi"] = s["hi"], s["w_hi"]
        else:
            out.append(dict(s))
    return out


def _cover(spans: list[dict]) -> Iterator[tuple]:
    """As few spans of one row as cover the bytes of all; of equal ones the smallest keeping id."""
    rest = sorted(_joined(spans), key=lambda s: (s["lo"], -s["hi"], s["first"]))
    k, reach = 0, -1
    while k < len(rest):
        if rest[k]["hi"] <= reach:
            k += 1
            continue
        best, limit = rest[k], max(reach, rest[k]["lo"])
        while k < len(rest) and rest[k]["lo"] <= limit:
            if rest[k]["hi"] > best["hi"]:
                best = rest[k]
            k += 1
        reach = best["hi"]
        yield best["lo"], best["hi"], best["w_hi"] - best["w_lo"], best["n_chunks"], best["first"]


SPANS = "doc_id long, span_start long, span_end long, n_words long, n_chunks long, first_doc_id long"


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per repeated span: doc_id, span_start, span_end (bytes), n_words, n_chunks, first_doc_id.

    The bytes of a span are in the document first_doc_id; documents without a row are clean.
    """
    texts = stored(text_table(docs, min_words), "texts")
    chunks = stored(chunk_table(texts), "chunks")

    def pieces(*names: str) -> DataFrame:
        rows = chunks.select("row", "doc_id", F.explode(F.arrays_zip("digests", *names)).alias("c"))
        return rows.select("row", "doc_id", F.col("c.digests").alias("digest"), *(F.col(f"c.{n}").alias(n.rstrip("s")) for n in names))

    held = pieces("places", "beside").groupBy("digest").agg(F.min(F.struct("doc_id", "row", "place", "beside")).alias("f"), F.max("doc_id").alias("last"))
    held = held.filter("f.doc_id < last").select("digest", F.col("f.doc_id").alias("first"), F.col("f.row").alias("first_row"), "f.place", "f.beside")
    held = stored(held, "held")
    asked = pieces("places", "sizes").select("row", "doc_id", "digest", F.shiftright("place", 32).cast("int").alias("start"), "size")
    found = asked.join(held, "digest").filter((F.col("doc_id") > F.col("first")) | (F.col("doc_id") == NO_ID))
    found = stored(found.select("row", "start", "size", "first", "first_row", "place", "beside"), "found")
    forget(chunks, held)
    hits = found.groupBy("row").agg(F.collect_list(F.struct("start", "size", "first", "first_row", "place", "beside")).alias("hits"))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[tuple] = []
        held = 0
        for b in batches:
            ids, doc_ids, own_texts = (b[c].to_pylist() for c in ("row", "doc_id", "text"))
            seeds, bounds = b["hits"].flatten(), np.cumsum([0, *(len(x) for x in b["hits"])])
            fields = {f.name: seeds.field(f.name).to_numpy(zero_copy_only=False) for f in seeds.type}
            for k, (x, y) in enumerate(zip(bounds, bounds[1:])):
                own = _Seeds(ids[k], doc_ids[k], own_texts[k], {c: v[x:y] for c, v in fields.items()}, min_words)
                for part in chain(own.lines(), own.periodic()):
                    got.append(part)
                    held += 200 + len(part[-1] or b"")
                    if held > BATCH_BYTES:
                        yield _record(got, PART)
                        got, held = [], 0
        yield _record(got, PART)

    names = [x.split(" ")[0] for x in SPAN.split(", ")]

    def agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            whole = [tuple(p[c] for c in names) for p in rows if p["own"] is None]
            yield _record(whole + [x for p in rows if p["own"] is not None for x in _agreeing(p, p["keep"], min_words)], SPAN)

    def covering(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [(r["doc_id"], *x) for r in b.to_pylist() for x in _cover(r["spans"])]
            yield _record([tuple(None if k in (0, 5) and v == NO_ID else v for k, v in enumerate(x)) for x in spans], SPANS)

    # texts are dealt by row once: both joins read one exchange, as they ask the same columns of the table
    parted = texts.join(hits, "row").select("row", "doc_id", "text", "hits").mapInArrow(parts, PART)
    place = F.greatest(F.lit(0), F.col("p.lo") + F.col("p.shift"))
    keep = F.substring(F.col("t.text"), place + 1, F.octet_length("p.own")).alias("keep")
    met = parted.alias("p").join(texts.alias("t"), F.col("p.k_row") == F.col("t.row"), "left")
    spans = met.select("p.*", keep, F.col("t.doc_id").alias("keep_id")).mapInArrow(agreeing, SPAN)
    by_row = spans.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.collect_list(F.struct("lo", "hi", "w_lo", "w_hi", "n_chunks", "first", "first_row", "shift")).alias("spans"))
    return by_row.mapInArrow(covering, SPANS)
