"""SimHash near-dedup by anchor-point covering.

Fingerprint: 64 bits over XXH64 hashes of word shingles.  Links: fingerprints
that differ in at most ``max_bits`` bits.

Anchors are the words of the Hamming code on bits 1..63, bit 0 free: the
syndrome of x is the XOR of the indexes of its set bits, and a word is an
anchor when it is 0.  The code is perfect, so its covering radius is 1.  Two
fingerprints at distance t have a midpoint within ceil(t / 2) of both, and the
midpoint's anchor lies within 1 of it: replicating every fingerprint to all
anchors within covering radius plus ceil(t / 2) from both sides brings every
linked pair together.  (One-sided, radius plus t for t = 2 takes 660 anchors a
fingerprint where this takes 33; the pairs found are the same.)  For t <= 2 an
anchor sees at most the 2,081 words within 3 of it, whatever the data, so no
anchor group grows; equal fingerprints are one before they are replicated.

Each anchor's fingerprints are compared bit by bit and give a star of links
per linked set, never all pairs.

Defined results: a null text counts as empty; no words give fingerprint zero,
which links like any other; a null ``doc_id`` takes part in links but is never
the smallest id (a component of null ids only has a null component_id).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copyledger.llm.common import keep_rows, python_ready, row_key, stage
from copyledger.llm.graph import components

CHUNK = 1 << 16
ONE = np.uint64(1)


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned SimHash of the text's word shingles; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    count = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = words[at:min(n, at + CHUNK) + shingle - 1]
        grams = zip(*(part[i:] for i in range(shingle))) if len(words) >= shingle else [part]
        hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(g), seed) for g in grams), np.uint64)
        count += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1,
                               bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int):
    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t, shingle) for t in batch["text"].to_pylist()),
                              np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["key"], pa.array(fps.view(np.int64))], ["doc_id", "key", "fp"])
    return run


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, key (row key), fp (the fingerprint as a signed long)."""
    python_ready(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), "text")
    return rows.mapInArrow(_fingerprints(shingle), "doc_id long, key long, fp long")


def syndrome(x: np.ndarray) -> np.ndarray:
    """XOR of the indexes of the set bits."""
    out = np.zeros(x.shape, np.uint64)
    for bit in range(6):
        mask = np.uint64(sum(1 << i for i in range(64) if i >> bit & 1))
        out |= (np.bitwise_count(x & mask).astype(np.uint64) & ONE) << np.uint64(bit)
    return out


def anchors(x: np.ndarray, max_bits: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, index into x): all anchors within 1 + ceil(max_bits / 2) that
    are nearest to some word within ceil(max_bits / 2) of the fingerprint."""
    reach = (max_bits + 1) // 2
    flips = np.array([sum(1 << i for i in c) for r in range(reach + 1) for c in combinations(range(64), r)],
                     np.uint64)
    near = x[:, None] ^ flips[None, :]
    wrong = syndrome(x)[:, None] ^ syndrome(flips)[None, :]
    near = np.sort(np.where(wrong > 0, near ^ (ONE << wrong), near), axis=1)
    fresh = np.ones(near.shape, bool)
    fresh[:, 1:] = near[:, 1:] != near[:, :-1]
    return near[fresh], np.nonzero(fresh)[0]


def _replicate(max_bits: int):
    def run(batches):
        for batch in batches:
            x = batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(x), 8192):
                part = x[at:at + 8192]
                anchor, i = anchors(part, max_bits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(part[i].view(np.int64))], ["anchor", "fp"])
    return run


def linked(fps: np.ndarray, max_bits: int) -> tuple[list[int], list[int]]:
    """Star edges (smallest, other) of the linked sets among distinct ``fps``."""
    left, a, b = np.sort(fps), [], []
    while len(left) > 1:
        hub, seen, left = left[0], left[:1], left[1:]
        while len(seen) and len(left):
            d = np.zeros(len(left), bool)
            for x in seen:
                d |= np.bitwise_count((left ^ x).view(np.uint64)) <= max_bits
            seen, left = left[d], left[~d]
            a += [int(hub)] * len(seen)
            b += seen.tolist()
    return a, b


def _compare(max_bits: int):
    """Over batches sorted by anchor; the last anchor's rows wait for the next batch."""
    def edges(anchor, fp):
        start = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        size = np.diff(np.r_[start, len(anchor)])
        two = start[size == 2]
        near = two[np.bitwise_count((fp[two] ^ fp[two + 1]).view(np.uint64)) <= max_bits]
        a, b = [np.minimum(fp[near], fp[near + 1])], [np.maximum(fp[near], fp[near + 1])]
        for s, n in zip(start[size > 2], size[size > 2]):
            x, y = linked(fp[s:s + n], max_bits)
            a.append(np.array(x, np.int64))
            b.append(np.array(y, np.int64))
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def run(batches):
        kept = [np.zeros(0, np.int64)] * 2
        for batch in batches:
            cols = [np.concatenate([k, batch[c].to_numpy(zero_copy_only=False)])
                    for k, c in zip(kept, ("anchor", "fp"))]
            if not len(cols[0]):
                continue
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            kept = [c[cut:] for c in cols]
            if cut:
                yield edges(*[c[:cut] for c in cols])
        if len(kept[0]):
            yield edges(*kept)
    return run


def links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """``fps(fp)`` distinct -> edges ``a, b`` that connect exactly what links connect."""
    copies = fps.select("fp").mapInArrow(_replicate(max_bits), "anchor long, fp long")
    return (copies.repartition("anchor").sortWithinPartitions("anchor")
            .mapInArrow(_compare(max_bits), "a long, b long"))


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row per document: doc_id, key, fp, root (smallest fingerprint of
    its component) and component_id (smallest doc_id of its component)."""
    rows = stage(fingerprints(docs, shingle), "simhash-rows")
    distinct = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-fps")
    edges = stage(links(distinct, max_bits), "simhash-links")
    roots = components(edges, "simhash")
    member = stage(distinct.join(roots, F.col("fp") == F.col("v"), "left")
                   .select("fp", "least", F.coalesce("label", "fp").alias("root")), "simhash-members")
    named = stage(member.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-named")
    of_fp = stage(member.join(named, "root").select("fp", "root", "component_id"), "simhash-of-fp")
    return rows.join(of_fp, "fp").select("doc_id", "key", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``docs`` with one row of every component: the smallest doc_id (null ids
    after all others, then the row key); rows equal in id and text are one."""
    found = near_duplicates(docs, shingle, max_bits)
    first = found.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id"), "key")).alias("f"))
    kept = keep_rows(docs, stage(first.select("f.key", "f.id"), "simhash-kept"), "left_semi")
    names = kept.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    # rows with a map have no order; their text form has one
    least = F.min("row") if "map<" not in kept.select(row).schema.simpleString() else F.min_by("row", F.to_json("row"))
    repeated = (kept.select(row.alias("row"), F.col("doc_id").alias("i"), row_key().alias("k"))
                .groupBy("i", "k").agg(least.alias("row")))
    return repeated.select("row.*")
