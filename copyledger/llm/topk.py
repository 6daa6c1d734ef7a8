"""Exact top-k inner products by MaxScore over sharded postings.

A vector's components are the weights of its terms.  Vectors are dealt into
shards of about ``SHARD`` rows; every block of queries meets every shard, sent
once to each group of at most ``GROUP`` shards.  In a shard a term's
contribution to a query lies between the products of its weight with the
shard's smallest and largest component.  Measured from the smallest one all
contributions are non-negative, and the classic split holds: terms in falling
order of their bounds, non-essential ones are the longest tail whose bounds
together cannot lift a vector over the score of the current k-th.  The
essential terms' postings are traversed for all vectors of the shard; the
others are probed, some at a time, only for vectors whose bound still reaches
that score.  Bounds and partial sums are floats and are compared with a margin
above their rounding; survivors are scored in integers, so the result is exact
for components of any size.  The shards' best are merged in two steps.

Defined results: a vector that is null or holds a null or non-finite component
takes no part, neither does one with a null id; a query never meets rows of
its own id; ties go to the smaller id; rows that repeat an id are candidates
each, and queries each, with ``k`` results of their own; scores outside the
range of a long are held at its ends;
vectors of unequal length are compared as if padded with zeros; fewer
candidates than ``k`` give all; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from copyledger.llm.common import python_ready, stage
from copyledger.llm.exact import LARGEST, best, products

SHARD = 4096
BLOCK = 256
GROUP = 16
STEP = 8
SAMPLE = 512
MARGIN = 1e-12    # of the sum of absolute products


def quantised(vectors: DataFrame, scale: int = 1024, *more: str) -> DataFrame:
    """vec_id, ``more`` columns, v: floor(scale * x) of every component, usable rows only."""
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return (vectors.where(x.isNotNull() & F.col("vec_id").isNotNull()).where(~bad)
            .select(F.col("vec_id").cast("long").alias("vec_id"), *more,
                    F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v")))


def matrix(column) -> np.ndarray:
    """Rows of a list column as one integer matrix, padded with zeros."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(size) and (size == size[0]).all():
        return flat.reshape(len(size), -1)
    out = np.zeros((len(size), int(size.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None, :] < size[:, None]] = flat
    return out


def search(query: np.ndarray, q_id: int, ids: np.ndarray, postings: np.ndarray,
           low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
    """Places in the shard that may be among the best ``k`` for one query.

    ``postings``: terms by vectors; ``low`` and ``high``: smallest and largest
    component of each term."""
    ends = np.stack([query * low, query * high])
    base = ends.min(axis=0)
    bound = ends.max(axis=0) - base
    # what rounding can add up to, and how far above a long's end is no matter
    margin = MARGIN * (np.abs(query) @ np.maximum(np.abs(low), np.abs(high)))
    most = float(LARGEST) - base.sum()
    order = np.argsort(-bound, kind="stable")
    tail = np.append(np.cumsum(bound[order][::-1])[::-1], 0)
    own = ids == q_id
    some = np.flatnonzero(~own[:SAMPLE])
    first = query @ postings[:, some] - base.sum()
    floor = np.partition(first, len(first) - k)[len(first) - k] if len(first) >= k else -np.inf
    floor = min(floor, most) - 2 * margin
    essential = max(1, int(np.count_nonzero(tail[:-1] >= floor)))
    head = order[:essential]
    score = query[head] @ postings[head] - base[head].sum()
    live = np.flatnonzero((score + tail[essential] >= floor) & ~own)
    score = score[live]
    for at in range(essential, len(order), STEP):
        if len(live) > k:
            now = np.partition(score, len(score) - k)[len(score) - k]
            floor = max(floor, min(now, most) - 2 * margin)
        near = score + tail[at] >= floor
        live, score = live[near], score[near]
        part = order[at:at + STEP]
        score = score + query[part] @ postings[np.ix_(part, live)] - base[part].sum()
    if len(live) > k:
        now = np.partition(score, len(score) - k)[len(score) - k]
        live = live[score >= max(floor, min(now, most) - 2 * margin)]
    return live


def _shard(k: int):
    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                ids, q, q_ids = (np.frombuffer(batch[c][r].as_py(), np.int64) for c in ("ids", "q", "q_ids"))
                rows = np.frombuffer(batch["rows"][r].as_py(), np.int64).reshape(len(ids), -1)
                queries = np.frombuffer(batch["q_rows"][r].as_py(), np.int64).reshape(len(q_ids), -1)
                width = max(rows.shape[1], queries.shape[1])
                rows, queries = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (rows, queries))
                postings = np.ascontiguousarray(rows.T.astype(float))
                low, high = postings.min(axis=1), postings.max(axis=1)
                live = [search(x, int(i), ids, postings, low, high, k) for x, i in zip(queries.astype(float), q_ids)]
                i, j = np.repeat(np.arange(len(live)), [len(x) for x in live]), np.concatenate(live)
                score = products(queries, rows, i, j)
                top = best(i, ids[j], score, k)
                i, j = i[top], j[top]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q[i]), pa.array(q_ids[i]), pa.array(ids[j]), pa.array(score[top])],
                    ["q", "query_id", "vec_id", "score"])
    return run


def _pack(keep: str, size: int, numbers: tuple[str, ...] = ("ids",)):
    """Rows sorted by ``keep`` -> one row of bytes per run of at most ``size``
    rows; the last run waits for the next batch."""
    def packed(key, *columns):
        *columns, spans = columns
        return pa.RecordBatch.from_arrays(
            [pa.array([int(key[a]) for a, _ in spans], pa.int32()),
             *(pa.array([np.ascontiguousarray(c[a:b], np.int64).tobytes() for a, b in spans], pa.binary())
               for c in columns)], [keep, *numbers, "rows"])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [*(batch[c].to_numpy(zero_copy_only=False) for c in (keep, *numbers)), matrix(batch["v"])]
            if held is not None:
                width = max(held[-1].shape[1], now[-1].shape[1])
                held[-1], now[-1] = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (held[-1], now[-1]))
                now = [np.concatenate(x) for x in zip(held, now)]
            cuts = [0, *(np.flatnonzero(now[0][1:] != now[0][:-1]) + 1).tolist(), len(now[0])]
            spans = [(x, min(x + size, hi)) for lo, hi in zip(cuts, cuts[1:]) for x in range(lo, hi, size)]
            if len(spans) > 1:
                yield packed(*now, spans[:-1])
            held = [x[spans[-1][0]:] for x in now]
        if held is not None:
            yield packed(*held, [(0, len(held[0]))])
    return run


def merged(scored: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each (query, part): a bounded window per part."""
    by = Window.partitionBy("q", "part").orderBy(F.col("score").desc(), "vec_id")
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``vectors`` and ``queries`` (vec_id, v) -> query_id, rank, vec_id, score."""
    spark = python_ready(vectors.sparkSession)
    n = vectors.count()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-queries.count() // BLOCK))
    # a repeated id must not fill one shard: rows are dealt by id and content
    deal = vectors.select(F.col("vec_id").alias("ids"), "v",
                          F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int").alias("shard"))
    packed = (deal.repartition("shard").sortWithinPartitions("shard")
              .mapInArrow(_pack("shard", SHARD), "shard int, ids binary, rows binary"))
    asked = queries.select(F.monotonically_increasing_id().alias("q"), F.col("vec_id").alias("ids"), "v",
                           F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int").alias("block"))
    asked = (asked.repartition("block").sortWithinPartitions("block")
             .mapInArrow(_pack("block", BLOCK, ("q", "ids")), "block int, q binary, ids binary, rows binary"))
    # a group of shards receives each query block once: as many groups as the
    # cluster's cores can use, so blocks travel no more often than they must
    cores = 4 * spark.sparkContext.defaultParallelism
    groups = max(-(-shards // GROUP), min(shards, cores))
    asked = stage(asked, "query-blocks").select(
        "q", F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"),
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    packed = stage(packed, "shards").withColumn("group", F.col("shard") % groups)
    met = asked.join(packed, "group")
    scored = met.select("ids", "rows", "q", "q_ids", "q_rows").mapInArrow(
        _shard(k), "q long, query_id long, vec_id long, score long")
    parts = max(1, round(shards ** 0.5))
    spread = scored.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)))
    out = merged(merged(spread, k).withColumn("part", F.lit(0)), k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
