"""Substring dedup by content-defined chunking with a gear rolling hash.

A 16-bit gear hash over UTF-8 bytes depends on the last 16 bytes only; where
it falls below a threshold a chunk ends, about every ``AVERAGE`` bytes.  An
insertion therefore moves the boundaries next to it and no others, and the
same passage is cut the same way wherever it stands.  A boundary inside a
character moves to its end, so chunks are whole characters.

The unit of comparison is a chunk with its successor, under a 64-bit digest of
both (XXH3), so a common phrase of one chunk tells nothing.  Units that occur
more than once, in one text or in several, have a first place, by doc_id, row
and position.  Units of a text that follow each other and whose first places
follow each other too make a run: the text there repeats the other one chunk
by chunk.  Runs of ``MIN_WORDS`` words or more are repeated passages; the text
with the first places keeps the passage whole and the run is cut from this one.  What
repeats at different places, a few words each, is left alone on both sides.
A text loses part of a passage that it is the first to hold only where a run of
its own, that another text keeps, reaches into it.

Shuffles of narrow rows: a combined count per digest, the join of the units with
the repeated digests, one row each, so AQE can split a digest that many texts
hold, and the chunks of passages by row, copies of one passage combined before.

Defined results: null and empty texts have no chunks, and a text of one chunk is
one unit; a null doc_id ranks after all others; rows that repeat a doc_id, or
have none, are texts of their own, in input order; where a text repeats itself
without a gap the first period stays; a run of more than ``LONGEST`` bytes
without a boundary is cut at local minima of the hash, so a repeating one is cut
alike each time, and where it has none every ``LONGEST`` bytes; of boundaries
less than ``SHORTEST`` bytes apart the first counts; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copyledger.llm.common import python_ready, stage
from copyledger.llm.words import GRAM_BASE, mix

WINDOW = 16
AVERAGE = 32
SHORTEST = 8
LONGEST = 64
MIN_WORDS = 16
WORD_BITS = 6      # words begun in a chunk of at most LONGEST + 3 bytes
WORD_MASK = (1 << WORD_BITS) - 1
GEAR = np.random.default_rng(16).integers(0, 1 << 16, 256, dtype=np.uint16)
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
LAST_ID = (1 << 63) - 1


def minima(h: np.ndarray) -> np.ndarray:
    """Ends after the hashes that are the least of their ``WINDOW`` neighbours on either side."""
    most = np.uint16(65535)
    m, step = np.append(h, np.full(WINDOW, most)), 1
    while step < WINDOW:
        m = np.minimum(m, np.concatenate([np.full(step, most), m[:-step]]))
        step *= 2
    return np.flatnonzero((h < np.append(most, m[:len(h) - 1])) & (h <= m[WINDOW:])) + 1


def boundaries(buf: np.ndarray, average: int = AVERAGE) -> np.ndarray:
    """Ends (exclusive) of the chunks of a text's bytes."""
    h = GEAR[buf]
    step = 1
    while step < WINDOW:
        h = h + np.concatenate([np.zeros(step, np.uint16), h[:-step] << np.uint16(step)])[:len(h)]
        step *= 2
    cut = np.flatnonzero(h < (1 << 16) // average) + 1
    if len(cut):
        cut = cut[np.diff(cut, prepend=-SHORTEST) >= SHORTEST]
    cut = np.unique(np.append(cut, len(buf)))
    size = np.diff(cut, prepend=0)
    if size.max() > LONGEST:
        low = minima(h)
        run = np.searchsorted(cut, low)
        far = (low - cut[run] + size[run] >= SHORTEST) & (cut[run] - low >= SHORTEST)
        cut = np.union1d(cut, low[far & (size[run] > LONGEST)])
        size = np.diff(cut, prepend=0)
    if size.max() > LONGEST:
        start = cut - size
        cut = np.unique(np.concatenate([cut, *(np.arange(a, b, LONGEST)[1:] for a, b in
                                               zip(start[size > LONGEST], cut[size > LONGEST]))]))
    inside = np.append((buf & 0xC0) == 0x80, False)
    for _ in range(3):
        cut = cut + inside[cut]
    return np.unique(cut)


def chunk(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digest, end in bytes, words begun) of each chunk."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    buf = np.frombuffer(raw, np.uint8)
    end = boundaries(buf)
    start = np.append(0, end[:-1])
    view = memoryview(raw)
    digest = np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(start.tolist(), end.tolist())),
                         np.uint64, len(end)).view(np.int64)
    blank = BLANK[buf]
    begin = ~blank
    begin[1:] &= blank[:-1]
    return digest, end.astype(np.int32), np.add.reduceat(begin, start, dtype=np.int32)


def lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(arrays), kind))


def units(digest: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(digest, place) of each chunk with its successor; a place holds the
    position and the words begun in either chunk."""
    if len(digest) < 2:
        return digest, words.astype(np.int64) << WORD_BITS
    both = mix(digest[:-1].view(np.uint64) * GRAM_BASE + digest[1:].view(np.uint64)).view(np.int64)
    pos, words = np.arange(len(both), dtype=np.int64), words.astype(np.int64)
    return both, (pos << WORD_BITS | words[:-1]) << WORD_BITS | words[1:]


def _chunks(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        found = [chunk(t) for t in batch["text"].to_pylist()]
        digest, place = zip(*(units(d, w) for d, _, w in found))
        yield pa.RecordBatch.from_arrays(
            [batch["rid"], batch["doc_id"], lists(digest, pa.int64()), lists(place, pa.int64()),
             lists([e for _, e, _ in found], pa.int32()), lists([w for _, _, w in found], pa.int32())],
            ["rid", "doc_id", "units", "places", "ends", "words"])


def numbered(docs: DataFrame) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def chunks(rows: DataFrame) -> DataFrame:
    """One row per document row: rid, doc_id, its units and their places, its chunks' ends and words."""
    python_ready(rows.sparkSession)
    return rows.mapInArrow(_chunks, "rid long, doc_id long, units array<long>, places array<long>, "
                                    "ends array<int>, words array<int>")


def runs(place: np.ndarray, row: np.ndarray, first: np.ndarray, least: int) -> list[tuple[int, int, int, int]]:
    """(first chunk, last chunk, other row, its first chunk) of the runs of
    ``least`` words or more: ``place`` in this text, ``first`` place in ``row``."""
    order = np.argsort(place)
    place, row, first = place[order], row[order], first[order]
    pos, other = place >> 2 * WORD_BITS, first >> 2 * WORD_BITS
    cut = np.flatnonzero((np.diff(pos) != 1) | (np.diff(other) != 1) | (np.diff(row) != 0)) + 1
    begin, end = np.append(0, cut), np.append(cut, len(pos)) - 1
    ahead = np.cumsum(place >> WORD_BITS & WORD_MASK)
    words = ahead[end] - np.append(0, ahead)[begin] + (place[end] & WORD_MASK)
    return [(int(pos[a]), int(pos[b]) + 1, int(row[a]), int(other[a]))
            for a, b in zip(begin[words >= least], end[words >= least])]


def _runs(least: int):
    def run(batches):
        for batch in batches:
            out = []
            for rid, hits in zip(batch["rid"].to_pylist(), batch["hits"]):
                found = runs(*(hits.values.field(c).to_numpy(zero_copy_only=False) for c in range(3)), least)
                out += [(rid, *r) for r in found]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] if out else
                                             [pa.array([], pa.int64())] * 5, ["rid", "a", "b", "other", "c"])
    return run


def split(at: np.ndarray) -> list[np.ndarray]:
    """Runs of neighbouring positions."""
    return np.split(at, np.flatnonzero(np.diff(at) != 1) + 1) if len(at) else []


def spans(at: np.ndarray, gone: np.ndarray, words: np.ndarray, ends: np.ndarray) -> tuple[list[dict], list[dict]]:
    """Neighbouring chunks ``at`` of passages, and those of them that are cut."""
    def piece(run):
        a, b = int(run[0]), min(int(run[-1]), len(ends) - 1)  # a text of one chunk has no successor
        return {"start": int(ends[a - 1]) if a else 0, "end": int(ends[b]), "words": int(words[a:b + 1].sum())}

    cuts = [piece(r) for r in split(at[gone])]
    return [piece(r) | {"removed": int(words[r[np.isin(r, at[gone]) & (r < len(words))]].sum())} for r in split(at)], cuts


def _spans(batches):
    kinds = [pa.list_(pa.struct([(c, pa.int32()) for c in names]))
             for names in (("start", "end", "words", "removed"), ("start", "end", "words"))]
    for batch in batches:
        out = []
        for row in zip(*(batch[c] for c in ("marks", "words", "ends"))):
            marks, words, ends = (c.values.to_numpy(zero_copy_only=False) for c in row)
            marks = np.sort(marks)
            out.append(spans(marks >> 1, marks & 1 > 0, words, ends))
        yield pa.RecordBatch.from_arrays(
            [batch["rid"], batch["doc_id"], batch["n_chunks"], pa.array([len(m) for m in batch["marks"]], pa.int64()),
             *(pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds))],
            ["rid", "doc_id", "n_chunks", "n_repeated", "spans", "cuts"])


def _repeated(rows: DataFrame, least: int) -> DataFrame:
    staged = stage(chunks(rows), "chunks")
    at = staged.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"), "rid",
                       F.explode(F.arrays_zip("units", "places")).alias("u"))
    at = at.select("rid", F.col("u.units").alias("digest"), F.col("u.places").alias("place"), "id")
    first = (at.groupBy("digest").agg(F.min(F.struct("id", "rid", "place")).alias("first"), F.count("*").alias("n"))
             .where("n > 1").select("digest", F.col("first.rid").alias("row"), F.col("first.place").alias("first")))
    hits = (at.drop("id").join(stage(first, "chunks-repeated"), "digest")
            .where("rid != row OR place != first")
            .groupBy("rid").agg(F.collect_list(F.struct("place", "row", "first")).alias("hits")))
    found = stage(hits.mapInArrow(_runs(least), "rid long, a long, b long, other long, c long"), "chunk-runs")
    # the passage's chunks in the text that keeps it, and those to cut, each once
    there = found.select(F.col("other").alias("rid"), F.explode(F.sequence(F.col("c"), F.expr("c + b - a"))).alias("at"),
                         F.lit(0).alias("gone"))
    here = found.select("rid", F.explode(F.sequence("a", "b")).alias("at"), F.lit(1).alias("gone"))
    marks = (there.unionByName(here).groupBy("rid", "at").agg(F.max("gone").alias("gone"))
             .groupBy("rid").agg(F.collect_list(F.col("at") * 2 + F.col("gone")).alias("marks")))
    kind = ("rid long, doc_id long, n_chunks long, n_repeated long, "
            "spans array<struct<start: int, end: int, words: int, removed: int>>, "
            "cuts array<struct<start: int, end: int, words: int>>")
    return (staged.select("rid", "doc_id", F.size("ends").cast("long").alias("n_chunks"), "ends", "words")
            .join(marks, "rid").mapInArrow(_spans, kind))


def repeated_spans(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """Document rows that hold repeated passages: rid, doc_id, n_chunks,
    n_repeated (chunks in them), spans (byte start and end, words, words removed
    since another place keeps them) and cuts (byte start and end, words), the ranges to remove."""
    return _repeated(numbered(docs), least)


def without_repeated_spans(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the text that is left after the cuts (and its length in
    ``n_chars``, if there); every row stays, if need be with an empty text."""
    # Written once, so that a row has the same number in both uses.
    rows = stage(docs.select(F.monotonically_increasing_id().alias("rid"),
                             F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), "chunk-rows")
    found = _repeated(rows.select("rid", F.col("row.doc_id").cast("long").alias("doc_id"),
                                  F.col("row.text").alias("text")), least)
    cuts = stage(found.where(F.size("cuts") > 0).select("rid", "cuts"), "chunk-cuts")
    raw = F.col("row.text").cast("binary")
    pieces = F.zip_with(F.concat(F.array(F.lit(0)), F.col("cuts.end")),
                        F.concat(F.col("cuts.start"), F.array(F.octet_length("row.text"))),
                        lambda a, b: F.substring(raw, a + 1, b - a).cast("string"))
    out = rows.join(cuts, "rid", "left").select(
        "row", F.col("cuts").isNotNull().alias("cut"),
        F.when(F.col("cuts").isNull(), F.col("row.text")).otherwise(F.array_join(pieces, "")).alias("kept"))
    new = {"text": F.col("kept"),
           "n_chars": F.when(F.col("cut"), F.length("kept").cast("long")).otherwise(F.col("row.n_chars"))
           if "n_chars" in docs.columns else None}
    return out.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
