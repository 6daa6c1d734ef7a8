"""Target-distribution importance resampling over hashed word n-grams.

Features are all runs of 1 to 3 consecutive words, repeats counted; a feature's
bucket is the CRC-32 of its UTF-8 bytes modulo ``buckets``.  CRCs are taken of
distinct features only, in length-bucketed matrices: features of equal length
are the rows of a two-dimensional byte array, all of whose CRCs are updated
column by column, and the buckets are scattered back to the occurrences.  Words
are told apart by their bytes, runs by the numbers of their words, so no two
features are ever taken for one.

A bucket's gain is the smoothed log ratio of its share among the target's
features to its share among the documents'; a document's weight is the sum over
its features, and adding Gumbel noise from a digest of its id turns the highest
scores into a draw without replacement in proportion to exp(weight).

A document's buckets are written once (two bytes a feature) and read twice, for
the counts and for the weights; texts never meet a shuffle.  Counts per task are
one row per bucket, so the driver sees 2 x ``buckets`` numbers.  Ranks come from
range partitions, so no task sorts the whole table.

Defined results: null and empty texts have no features and weight 0; a null
doc_id is drawn like the id ``null`` and comes after all others in ties;
repeated rows are documents each; an empty ``target`` leaves all shares
smoothed alike; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copyledger.llm.common import keep_rows, python_ready, row_key, stage
from copyledger.llm.words import IS_WORD, chunks
from copyledger.operators.ids import assign_ids

ORDERS = 3
BUCKETS = 10_000
LEAST_WORDS = 20
PIECE = 1 << 20
FEW = 8            # rows of one length that are not worth a matrix
BLOCK = 1 << 24    # bytes of one matrix
LAST_ID = (1 << 63) - 1
BETWEEN = re.compile(rb"[\x00-/:-`{-\x7f]")


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC = _crc_table()


def crc_matrix(rows: np.ndarray) -> np.ndarray:
    """CRC-32 of each row of a two-dimensional byte array, column by column."""
    crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(rows.T):
        crc = CRC[(crc ^ column) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
    return ~crc


def crcs(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of ``buf[start:start + size]`` for each pair, by length."""
    out = np.zeros(len(start), np.uint32)
    order = np.argsort(size, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
        length = int(size[rows[0]]) if len(rows) else 0
        if len(rows) < FEW:
            out[rows] = [zlib.crc32(buf[a:a + length]) for a in start[rows].tolist()]
            continue
        step = max(FEW, BLOCK // max(1, length))
        for part in (rows[i:i + step] for i in range(0, len(rows), step)):
            out[part] = crc_matrix(buf[start[part][:, None] + np.arange(length)])
    return out


def word_numbers(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Numbers that are equal exactly for words of equal bytes."""
    out = np.zeros(len(start), np.int64)
    order, seen = np.argsort(size, kind="stable"), 0
    for rows in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
        if not len(rows):
            continue
        length = int(size[rows[0]])
        if len(rows) < FEW or length > 64:
            known = {}
            out[rows] = [seen + known.setdefault(buf[a:a + length].tobytes(), len(known))
                         for a in start[rows].tolist()]
            seen += len(known)
            continue
        wide = np.zeros((len(rows), -(-length // 8) * 8), np.uint8)
        wide[:, :length] = buf[start[rows][:, None] + np.arange(length)]
        number = np.zeros(len(rows), np.int64)
        for column in wide.view(np.uint64).T:  # eight bytes at a time
            part = np.unique(column, return_inverse=True)[1]
            number = np.unique(number * (int(part.max()) + 1) + part, return_inverse=True)[1]
        out[rows] = seen + number
        seen += int(number.max()) + 1
    return out


def buckets_of(raw: bytes, fresh: int = 0, owner_starts: np.ndarray | None = None,
               buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text of each word, text of each feature, its bucket) for texts laid end
    to end in ``raw`` with a separator between them; runs that end before word
    ``fresh`` are left out.  Features come by length of run, then place."""
    buf = np.frombuffer(raw, np.uint8)
    edge = np.flatnonzero(np.diff(IS_WORD[buf].view(np.int8), prepend=0, append=0))
    start, end = edge[0::2], edge[1::2]
    owner = (np.zeros(len(start), np.int64) if owner_starts is None
             else np.searchsorted(owner_starts, start, "right") - 1)
    if not len(start):
        return owner, owner, np.zeros(0, np.uint16)
    word = word_numbers(buf, start, end - start)
    many, run = int(word.max()) + 1, word
    # a feature's words stand one space apart: its bytes are laid out once, so
    # texts with other separators give the same feature
    size = end - start
    line = np.full(int(size.sum()) + len(size), 32, np.uint8)
    at = np.cumsum(size + 1) - size - 1
    line[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = buf[IS_WORD[buf]]
    who, out = [], []
    for n in range(1, min(ORDERS, len(start)) + 1):
        m = len(start) - n + 1
        if n > 1:
            run = np.unique(run[:m] * many + word[n - 1:], return_inverse=True)[1]
        inside = np.flatnonzero((owner[:m] == owner[n - 1:]) & (np.arange(m) + n > fresh))
        _, first, back = np.unique(run[inside], return_index=True, return_inverse=True)
        first = inside[first]
        crc = crcs(line, at[first], at[first + n - 1] + size[first + n - 1] - at[first])
        out.append((crc % np.uint32(buckets)).astype(np.uint16)[back])
        who.append(owner[inside])
    return owner, np.concatenate(who), np.concatenate(out)


def long_buckets(raw: bytes, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """(words, buckets) of a long text, in pieces that end between words; each
    begins with the last words of the piece before."""
    n_words, out, at, back, carried = 0, [], 0, 0, 0
    while at < len(raw):
        gap = BETWEEN.search(raw, min(len(raw), at + PIECE))
        end = gap.start() if gap else len(raw)
        piece = raw[back:end]
        words, _, found = buckets_of(piece, carried, buckets=buckets)
        n_words += len(words) - carried
        out.append(found)
        edge = np.flatnonzero(np.diff(IS_WORD[np.frombuffer(piece, np.uint8)].view(np.int8), prepend=0, append=0))
        carried = min(ORDERS - 1, len(words))
        back, at = (back + int(edge[0::2][-carried]) if carried else end), end
        if not gap:
            break
    return n_words, np.concatenate(out) if out else np.zeros(0, np.uint16)


def features(texts: list[bytes], buckets: int = BUCKETS) -> list[tuple[int, np.ndarray]]:
    """(words, bucket of each feature) of each lower-cased text."""
    found: list = [None] * len(texts)
    short = [i for i, t in enumerate(texts) if len(t) <= PIECE]
    if short:
        starts = np.cumsum([0] + [len(texts[i]) + 1 for i in short])[:-1]
        words, who, got = buckets_of(b"\n".join(texts[i] for i in short), 0, starts, buckets)
        order = np.argsort(who, kind="stable")
        ends = np.cumsum(np.bincount(who, minlength=len(short)))
        counts = np.bincount(words, minlength=len(short))
        for i, n, part in zip(short, counts.tolist(), np.split(got[order], ends[:-1])):
            found[i] = (n, part)
    for i, t in enumerate(texts):
        if found[i] is None:
            found[i] = long_buckets(t, buckets)
    return found


def _features(buckets: int):
    def run(batches):
        for batch in batches:
            texts = [(t or "").encode("utf-8", "replace").lower() for t in batch["text"].to_pylist()]
            found = [f for lo, hi in chunks(texts) for f in features(texts[lo:hi], buckets)]
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in batch.schema.names if c != "text"),
                 pa.array([n for n, _ in found], pa.int64()), pa.array([len(b) for _, b in found], pa.int64()),
                 pa.array([b.tobytes() for _, b in found], pa.binary())],
                [*(c for c in batch.schema.names if c != "text"), "n_words", "n_features", "buckets"])
    return run


def _counts(buckets: int):
    def run(batches):
        count = np.zeros(buckets, np.int64)
        for batch in batches:
            for b in batch["buckets"]:
                count += np.bincount(np.frombuffer(b.as_buffer(), np.uint16), minlength=buckets)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(count[at])], ["bucket", "n"])
    return run


def counts(staged: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences per bucket: at most ``buckets`` numbers reach the driver."""
    found = staged.select("buckets").mapInArrow(_counts(buckets), "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of each bucket's smoothed share in the target over that in the source."""
    k, s, t = float(len(source)), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + k) / ((a + 1.0) * (t + k))))
                     for a, b in zip(source.tolist(), target.tolist())], np.int64)


def _weigh(gain):
    def run(batches):
        for batch in batches:
            weight = [int(gain.value[np.frombuffer(b.as_buffer(), np.uint16)].sum()) for b in batch["buckets"]]
            keep = [c for c in batch.schema.names if c != "buckets"]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(weight, pa.int64())],
                                             [*keep, "weight"])
    return run


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = LEAST_WORDS,
             seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """One row per document: doc_id, key, n_words, n_features, weight, score and
    rank (1, 2, ... for the drawn ones, else null); ``target`` has a column text."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must fit in two bytes")
    spark = python_ready(docs.sparkSession)
    kind = "n_words long, n_features long, buckets binary"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), "text")
    staged = stage(rows.mapInArrow(_features(buckets), f"doc_id long, key long, {kind}"), "importance-buckets")
    wanted = stage(target.select("text").mapInArrow(_features(buckets), kind), "importance-target")
    gain = spark.sparkContext.broadcast(gains(counts(staged, buckets), counts(wanted, buckets)))
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long")
    scored = stage(staged.mapInArrow(_weigh(gain), "doc_id long, key long, n_words long, n_features long, weight long")
                   .withColumn("score", F.col("weight") + noise), "importance-scores")
    fit = F.col("n_words") >= least_words
    n = percent * scored.where(fit).count() // 100
    names = ["doc_id", "key", "n_words", "n_features", "weight", "score"]
    ranked = assign_ids(scored.where(fit).select(*names, (-F.col("score")).alias("low"),
                                                 F.coalesce("doc_id", F.lit(LAST_ID)).alias("tie")),
                        ["low", "tie", "key"], id_col="rank")
    rank = F.when(F.col("rank") <= n, F.col("rank")).alias("rank")
    return ranked.select(*names, rank).unionByName(
        scored.where(~fit).select(*names, F.lit(None).cast("long").alias("rank")))


def drawn_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of ``docs``; of rows equal in id and text all come where one is drawn."""
    drawn = resample(docs, target, **options).where("rank IS NOT NULL")
    return keep_rows(docs, drawn.select("key", F.col("doc_id").alias("id")).distinct(), "left_semi")
