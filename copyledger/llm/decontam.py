"""Benchmark decontamination by greedy string tiling.

Seeds are word k-grams that a document shares with a benchmark item; an item of
fewer than ``k`` words has one seed, itself whole.  The items' k-gram hashes
make a fixed-size bitmap; a document's k-grams that pass it are joined in Spark
with the items' k-grams, on the Karp-Rabin hash and on the words themselves.

Pairs that cannot reach the wanted coverage are not made.  Of an item's k-grams
the ones that most items hold are left out of the search as long as the words
they cover together are too few: whoever covers enough of the item then shares
at least one of the others, its probes.  Documents meet items by probes; a
template that all items open with is no probe of any of them unless it makes up
the wanted share by itself.  Only for pairs that share a probe are all shared
k-grams joined.

Each pair has its list of shared seed positions: runs on a diagonal are the
maximal matches, the longest unmarked one is marked again and again until none
of ``k`` words is left, and the words of the item that tiles cover decide.
Tiles may lie in any order, so a reordered passage counts like a straight one.

Defined results: null and empty texts and items share nothing; of equal matches the one
earliest in the item, then in the document, is marked first; rows equal in
id and text have one result; empty tables give no rows.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copyledger.llm.common import keep_rows, python_ready, row_key, stage
from copyledger.llm.words import Membership, Words, chunks

K = 5
COVERAGE = 0.5
BITMAP_BITS = 24
GRAMS = "id long, key long, n_words long, size int, pos int, hash long, gram string"


def _grams(sizes: list[int], member=None):
    """k-grams of each text, k in ``sizes``: all of them, or those that may be a member."""
    def run(batches):
        known = None if member is None else Membership(BITMAP_BITS, member.value)
        for batch in batches:
            texts = [(t or "").lower().encode("utf-8", "replace") for t in batch["text"].to_pylist()]
            ids, keys = (batch[c].to_pylist() for c in ("id", "key"))
            for lo, hi in chunks(texts):
                words = Words(texts[lo:hi])
                for k in sizes:
                    hashes, at = words.grams(k)
                    if known is not None:
                        hit = known.has(hashes)
                        hashes, at = hashes[hit], at[hit]
                    doc = words.doc[at]
                    where = (doc + lo).tolist()
                    yield pa.RecordBatch.from_arrays([
                        pa.array([ids[d] for d in where], pa.int64()),
                        pa.array([keys[d] for d in where], pa.int64()),
                        pa.array(words.n[doc], pa.int64()),
                        pa.array(np.full(len(at), k, np.int32)),
                        pa.array(at - words.first[doc], pa.int32()),
                        pa.array(hashes.view(np.int64)),
                        pa.array([words.gram(i, k) for i in at.tolist()], pa.string()),
                    ], ["id", "key", "n_words", "size", "pos", "hash", "gram"])
    return run


def probes(n_words: int, size: int, grams: list[tuple[int, int]], coverage: float) -> set[int]:
    """Positions to search an item by: its ``grams`` (items that hold it, position)
    without the most common ones that together cover too few words."""
    least = max(1, math.ceil(coverage * n_words - 1e-9))
    out, covered = {p for _, p in grams}, set()
    for _, p in sorted(grams, reverse=True):
        covered.update(range(p, p + size))
        if len(covered) >= least:
            break
        out.discard(p)
    return out


def _probes(coverage: float):
    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                some = probes(r["n_words"], r["size"], [(g["items"], g["pos"]) for g in r["grams"]], coverage)
                out += [(r["id"], r["key"], r["n_words"], r["size"], g["pos"], g["hash"], g["gram"], g["pos"] in some)
                        for g in r["grams"]]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.bool_()]
            columns = zip(*out) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)],
                                             ["id", "key", "n_words", "size", "pos", "hash", "gram", "probe"])
    return run


def searched(items: DataFrame, coverage: float) -> DataFrame:
    """Items' k-grams with ``probe``; an item's k-grams are one bounded list."""
    common = items.groupBy("hash", "gram").agg(F.count_distinct("key").alias("items"))
    listed = (items.join(common, ["hash", "gram"]).groupBy("id", "key", "n_words", "size")
              .agg(F.collect_set(F.struct("items", "pos", "hash", "gram")).alias("grams")))
    return listed.mapInArrow(_probes(coverage), GRAMS + ", probe boolean")


def _bitmap(grams: DataFrame) -> bytes:
    """``Membership`` bytes: 64-bit words of the bitmap, combined in Spark; at
    most ``2**(BITMAP_BITS - 6)`` of them (2 MB) reach the driver."""
    slot = F.shiftrightunsigned("hash", 64 - BITMAP_BITS)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))
    cells = (grams.select(F.floor(slot / 64).cast("int").alias("cell"), bit.alias("bit"))
             .groupBy("cell").agg(F.bit_or("bit").alias("bits")).collect())
    words = np.zeros(1 << BITMAP_BITS - 6, np.int64)
    for r in cells:
        words[r["cell"]] = r["bits"]
    return words.tobytes()


def tiles(i: np.ndarray, j: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling over shared k-gram starts, ``i`` in the text and
    ``j`` in the item: the marked (start in the item, start in the text,
    length), longest first."""
    if not len(i):
        return []
    diagonal, width = i.astype(np.int64) - j, int(j.max()) + 1
    low = int(diagonal.min())
    place = np.unique((diagonal - low) * width + j)
    pairs = np.stack([place // width + low, place % width], axis=1)
    cut = np.flatnonzero((np.diff(pairs[:, 0]) != 0) | (np.diff(pairs[:, 1]) != 1)) + 1
    heap = []
    for run in np.split(pairs, cut):
        d, j = int(run[0, 0]), int(run[0, 1])
        heap.append((-(len(run) + k - 1), j, j + d))
    heapq.heapify(heap)
    in_item, in_text, out = set(), set(), []
    while heap:
        size, j, i = heapq.heappop(heap)
        free, part = [], None
        for x in range(-size):
            if j + x in in_item or i + x in in_text:
                part = None
            elif part is None:
                part = [x, 1]
                free.append(part)
            else:
                part[1] += 1
        if free and free[0][1] == -size:
            out.append((j, i, -size))
            in_item.update(range(j, j - size))
            in_text.update(range(i, i - size))
        else:
            for x, n in free:
                if n >= k:
                    heapq.heappush(heap, (-n, j + x, i + x))
    return out


def _tile(k: int):
    def run(batches):
        for batch in batches:
            seeds = batch["seeds"]
            i, j = (seeds.flatten().field(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            ends = np.cumsum(np.diff(seeds.offsets.to_numpy()))
            sizes = np.minimum(batch["item_words"].to_numpy(), k).tolist()
            found = [tiles(i[a:b], j[a:b], n) for a, b, n in zip([0, *ends[:-1]], ends, sizes)]
            keep = [c for c in batch.schema.names if c != "seeds"]
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in keep), pa.array([len(f) for f in found], pa.int64()),
                 pa.array([sum(t[2] for t in f) for f in found], pa.int64())], [*keep, "n_tiles", "covered"])
    return run


def candidates(seeds: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct (id, key, item_id, item_key) of documents and items that share a probe."""
    probe = items.where("probe").select(F.col("id").alias("item_id"), F.col("key").alias("item_key"),
                                        F.col("hash").alias("h"), F.col("gram").alias("g"))
    return (seeds.join(probe, (F.col("hash") == F.col("h")) & (F.col("gram") == F.col("g")))
            .select("id", "key", "item_id", "item_key").distinct())


def overlaps(docs: DataFrame, benchmark: DataFrame, k: int = K, coverage: float = 0.0) -> DataFrame:
    """One row per document (equal rows are one) and item that share a k-gram
    and may reach the coverage: doc_id, key, item_id, n_tiles, covered, item_words, coverage."""
    spark = python_ready(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long").alias("id"),
                             F.xxhash64("item_id", "text").alias("key"), "text")
    items = items.mapInArrow(_grams(list(range(1, k + 1))), GRAMS).where(F.col("size") == F.least("n_words", F.lit(k)))
    items = stage(searched(stage(items, "items"), coverage), "items-searched")
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # at most k numbers
    member = spark.sparkContext.broadcast(_bitmap(items))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), row_key().alias("key"), "text")
    seeds = stage(rows.mapInArrow(_grams(sizes, member), GRAMS), "seeds")
    met = stage(candidates(seeds, items), "decontam-pairs")
    met = met.select(F.col("id").alias("d"), F.col("key").alias("dk"), "item_id", "item_key")
    other = items.select(F.col("id").alias("i"), F.col("key").alias("ik"), F.col("n_words").alias("item_words"),
                         F.col("pos").alias("j"), F.col("hash").alias("h"), F.col("gram").alias("g"))
    shared = (seeds.join(met, (F.col("key") == F.col("dk")) & F.col("id").eqNullSafe(F.col("d")))
              .join(other, (F.col("hash") == F.col("h")) & (F.col("gram") == F.col("g"))
                    & (F.col("item_key") == F.col("ik")) & F.col("item_id").eqNullSafe(F.col("i"))))
    pairs = (shared.groupBy(F.col("id").alias("doc_id"), "key", "item_id", "item_key", "item_words")
             .agg(F.collect_list(F.struct(F.col("pos").alias("i"), "j")).alias("seeds")))
    schema = ("doc_id long, key long, item_id long, item_key long, item_words long, "
              "n_tiles long, covered long")
    return (pairs.mapInArrow(_tile(k), schema)
            .select("doc_id", "key", "item_id", "n_tiles", "covered", "item_words",
                    (F.col("covered") / F.col("item_words")).alias("coverage")))


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = K, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``overlaps`` whose tiles cover enough of the item."""
    return overlaps(docs, benchmark, k, coverage).where(F.col("coverage") >= coverage)


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = K, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item."""
    found = contaminated(docs, benchmark, k, coverage).select("key", F.col("doc_id").alias("id")).distinct()
    return keep_rows(docs, stage(found, "contaminated"), "left_anti")
