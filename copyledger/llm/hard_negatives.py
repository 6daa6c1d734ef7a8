"""Hard-negative mining with rotated one-bit codes.

Vectors are turned by one fixed random rotation and written as a short sum of
sign vectors: the signs of the turned vector are a one-bit code, its alignment
with that code is stored, and what is left is coded again, ``LEVELS`` times.
The products of two coded vectors' codes are popcounts, and together with the
alignments they estimate the inner product.  The rest of either vector enters
through Cauchy-Schwarz only: <x, q> differs from the estimate by at most
|coded x| * |rest of q| + |rest of x| * |q|.  That interval is certain, so a candidate
is dropped only where it cannot matter, and the intervals that survive are
scored in integers: results are exact.

Two passes of the anchors, in blocks, over all vectors, in shards.  The first
finds each anchor's positives: candidates of its label whose upper end reaches
the k-th lower end.  The second finds the negatives of each (anchor,
positive): candidates of other labels whose interval meets the positive's
window and reaches the k-th lower end among those certainly inside it.  Every
shard yields a bounded number of rows an anchor, merged in two steps.  Rows are
dealt to shards by a hash of id and content, so neither a label nor a vector
that a third of all rows share fills a shard.

Defined results: a row with a null id, label or vector or with a null or
non-finite component takes no part; rows that repeat an id are candidates each, never
of an anchor of their own id, and anchors each, with results of their own;
vectors of unequal length are compared as if padded with zeros; scores outside
the range of a long are held at its ends; an anchor without another row of its
label, or a positive without a negative in its window, gives no rows; empty
tables give no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from copyledger.llm.common import python_ready, stage
from copyledger.llm.exact import LARGEST, best, products
from copyledger.llm.topk import matrix

SHARD = 4096
BLOCK = 256
GROUP = 16
STRIP = 8        # anchors whose estimates are made at once, in the processor's cache
LEVELS = 6
SLACK = 1e-5     # of the product of the lengths: above the rounding of the estimates


@lru_cache(maxsize=4)
def rotation(width: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(64).normal(size=(width, width)))[0]


def encode(rows: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (n, levels, words), alignments (n, levels), and lengths (n, 3) of
    the vector, its coded part and the rest."""
    n, d = rows.shape
    left = whole = rows.astype(float) @ rotation(d)
    codes = np.zeros((n, levels, -(-d // 64)), np.uint64)
    align = np.zeros((n, levels))
    for i in range(levels):
        sign = left >= 0
        align[:, i] = np.abs(left).sum(axis=1) / d ** 0.5
        codes[:, i].view(np.uint8)[:, :-(-d // 8)] = np.packbits(sign, axis=1, bitorder="little")
        left = left - np.where(sign, 1.0, -1.0) * (align[:, i] / d ** 0.5)[:, None]
    ends = np.stack([np.linalg.norm(x, axis=1) for x in (whole, whole - left, left)], axis=1)
    return codes, align, ends


def intervals(a: dict, b: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Certain (lower, upper) ends of all inner products of ``a`` with ``b``,
    and the unit of each row of them: the length of its ``a`` times the largest
    length in ``b``, so that small floats hold vectors of any size."""
    d, kind = a["v"].shape[1], np.float32
    (q, q_coded, q_rest), (x, x_coded, x_rest) = a["ends"].T, b["ends"].T
    own, longest = np.where(q > 0, q, 1), max(x.max(initial=0), 1e-300)
    mine, theirs = (a["align"] / own[:, None]).astype(kind), (b["align"] / longest).astype(kind)
    # 1 - 2 * apart / d for each pair of codes: the ones come first, at once
    estimate = mine.sum(axis=1)[:, None] * theirs.sum(axis=1)[None, :]
    weights = np.asfortranarray(theirs * kind(2 / d))
    columns = np.ascontiguousarray(b["codes"].transpose(1, 2, 0))
    for lo in range(0, len(own), STRIP):
        strip = slice(lo, lo + STRIP)
        for i in range(mine.shape[1]):
            apart = np.zeros(estimate[strip].shape, kind)
            for j in range(theirs.shape[1]):
                for w in range(len(columns[j])):
                    apart += np.bitwise_count(a["codes"][strip, i, w, None] ^ columns[j, w]) * weights[:, j]
            estimate[strip] -= apart * mine[strip, i, None]
    size, coded, rest = ((c / longest).astype(kind)[None, :] for c in (x, x_coded, x_rest))
    reach = (q_rest / own).astype(kind)[:, None] * coded + (rest + kind(SLACK) * size)
    unit = own * longest
    # a score beyond a long is held at its end, and so are these
    most = np.minimum(float(LARGEST) / unit, 2).astype(kind)[:, None]
    return np.clip(estimate - reach, -most, most), np.clip(estimate + reach, -most, most), unit


def kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, minus infinity where there are fewer."""
    n = values.shape[1]
    return np.partition(values, n - k, axis=1)[:, n - k] if n >= k else np.full(len(values), -np.inf)


def positives_in(a: dict, b: dict, k: int) -> list[np.ndarray]:
    """(anchor number, vec_id, score): the shard's first ``k`` rows of each anchor's label."""
    found = []
    for label in np.intersect1d(a["labels"], b["labels"]):
        mine, theirs = np.flatnonzero(a["labels"] == label), np.flatnonzero(b["labels"] == label)
        one, other = ({c: v[i] for c, v in x.items()} for x, i in ((a, mine), (b, theirs)))
        low, high, _ = intervals(one, other)
        usable = one["ids"][:, None] != other["ids"][None, :]
        i, j = np.nonzero(usable & (high >= kth(np.where(usable, low, -np.inf), k)[:, None]))
        score = products(one["v"], other["v"], i, j)
        top = best(i, other["ids"][j], score, k)
        found.append((one["q"][i[top]], other["ids"][j[top]], score[top]))
    return [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 3


def negatives_in(a: dict, b: dict, k: int, share: tuple[int, int]) -> list[np.ndarray]:
    """(anchor number, positive's place, vec_id, score): the shard's first ``k``
    rows of other labels in the window of each positive."""
    low, high, unit = intervals(a, b)
    usable = a["labels"][:, None] != b["labels"][None, :]
    windows = np.array([[(-(-share[0] * s // 100), share[1] * s // 100) for s in row] for row in a["scores"].tolist()],
                       dtype=object).reshape(len(a["ids"]), -1, 2)
    ends = (windows.astype(float) / unit[:, None, None]).astype(np.float32)
    slack = np.abs(ends) * np.float32(SLACK)
    needed = np.zeros(low.shape, bool)
    for r, n in enumerate(a["n_scores"].tolist()):
        if not n:
            continue
        least, most = ends[r, :n] - slack[r, :n], ends[r, :n] + slack[r, :n]
        near = np.flatnonzero(usable[r] & (high[r] >= least[:, 0].min()) & (low[r] <= most[:, 1].max()))
        lower, upper, need = low[r, near], high[r, near], np.zeros(len(near), bool)
        for p in range(n):
            sure = lower[(lower >= most[p, 0]) & (upper <= least[p, 1])]
            floor = max(least[p, 0], kth(sure[None, :], k)[0])
            need |= (upper >= floor) & (lower <= most[p, 1])
        needed[r, near[need]] = True
    i, j = np.nonzero(needed)
    score = products(a["v"], b["v"], i, j)
    found = []
    for place in range(windows.shape[1]):
        begin, end = (np.array([max(-LARGEST, min(LARGEST, w)) for w in windows[:, place, e].tolist()], np.int64)
                      for e in (0, 1))
        at = np.flatnonzero((a["n_scores"][i] > place) & (begin[i] <= score) & (score <= end[i]))
        at = at[best(i[at], b["ids"][j[at]], score[at], k)]
        found.append((a["q"][i[at]], np.full(len(at), place, np.int64), b["ids"][j[at]], score[at]))
    return [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 4


def _pack(key: str, size: int, numbers: tuple[str, ...], lists: dict[str, int]):
    """Rows sorted by ``key``, with columns of numbers and of lists of a fixed
    width -> one row of bytes, codes included, per run of at most ``size`` rows."""
    def packed(k, rows):
        coded = dict(zip(("codes", "align", "ends"), encode(rows["v"])))
        return pa.RecordBatch.from_arrays(
            [pa.array([k], pa.int32()), *(pa.array([np.ascontiguousarray(v).tobytes()], pa.binary())
                                          for v in (rows | coded).values())], [key, *rows, *coded])

    def run(batches):
        held, now = None, None
        for batch in batches:
            keys = batch[key].to_numpy()
            for part in np.split(np.arange(len(keys)), np.flatnonzero(np.diff(keys)) + 1):
                if not len(part):
                    continue
                some = batch.slice(int(part[0]), len(part))
                rows = {c: some[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in numbers}
                for c, width in lists.items():
                    m = matrix(some[c])
                    rows[c] = np.pad(m, ((0, 0), (0, width - m.shape[1]))).astype(np.int64)
                if held is not None and now != keys[part[0]]:
                    yield packed(now, held)
                    held = None
                now = int(keys[part[0]])
                held = rows if held is None else {c: np.concatenate([held[c], rows[c]]) for c in rows}
                while len(held["v"]) > size:
                    yield packed(now, {c: v[:size] for c, v in held.items()})
                    held = {c: v[size:] for c, v in held.items()}
        if held is not None:
            yield packed(now, held)
    return run


def _read(batch, r: int, prefix: str, numbers: tuple[str, ...], lists: dict[str, int]) -> dict:
    def column(name, kind=np.int64):
        return np.frombuffer(batch[prefix + name][r].as_buffer(), kind)

    out = {c: column(c) for c in numbers} | {c: column(c).reshape(-1, w) for c, w in lists.items()}
    return out | {"codes": column("codes", np.uint64).reshape(len(out["v"]), LEVELS, -1),
                  "align": column("align", float).reshape(-1, LEVELS), "ends": column("ends", float).reshape(-1, 3)}


def _meet(search, numbers: tuple[str, ...], lists: dict[str, int], names: list[str]):
    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                a = _read(batch, r, "a_", numbers, lists)
                b = _read(batch, r, "", ("ids", "labels"), {"v": lists["v"]})
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in search(a, b)], names)
    return run


def _packed(rows: DataFrame, parts: int, size: int, numbers: tuple[str, ...], lists: dict[str, int]) -> DataFrame:
    names = (*numbers, *lists, "codes", "align", "ends")
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("ids", "labels", "v"), F.lit(parts)).cast("int"))
    return (dealt.repartition("part").sortWithinPartitions("part")
            .mapInArrow(_pack("part", size, numbers, lists), "part int, " + ", ".join(f"{c} binary" for c in names)))


def _merged(found: DataFrame, by: list[str], k: int, parts: int) -> DataFrame:
    """The ``k`` best rows of each key, over parts of it first: bounded windows."""
    found = found.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)))
    for keys in ([*by, "part"], by):
        order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "vec_id")
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.drop("part")


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5,
                   share: tuple[int, int] = (80, 100)) -> DataFrame:
    """``vectors`` and ``anchors`` (vec_id, label, v: integers) -> anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score, and
    positive_rank.  A negative's score is at least ``share[0]`` and at most
    ``share[1]`` hundredths of its positive's."""
    spark = python_ready(vectors.sparkSession)
    columns = [F.col("vec_id").cast("long").alias("ids"), F.col("label").cast("long").alias("labels"), "v"]

    def usable(rows):
        return rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").select(*columns)
    rows = usable(vectors)
    asked = stage(usable(anchors).withColumn("q", F.monotonically_increasing_id()), "anchors")
    n, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    asked_n, asked_width = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    width = max(width or 1, asked_width or 1, 1)
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-asked_n // BLOCK))
    # a group of shards receives each block once: as many groups as the cores can use
    groups = max(-(-shards // GROUP), min(shards, 4 * spark.sparkContext.defaultParallelism))
    shelf = stage(_packed(rows, shards, SHARD, ("ids", "labels"), {"v": width}), "shards") \
        .withColumn("group", F.col("part") % groups).drop("part")

    def met(asked, search, numbers, lists, names):
        packed = stage(_packed(asked, blocks, BLOCK, numbers, lists), "anchor-blocks").drop("part")
        sent = packed.select(*[F.col(c).alias("a_" + c) for c in packed.columns],
                             F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
        return sent.join(shelf, "group").drop("group").mapInArrow(
            _meet(search, numbers, lists, names), ", ".join(f"{c} long" for c in names))

    parts = max(1, round(shards ** 0.5))
    found = met(asked, lambda a, b: positives_in(a, b, positives), ("ids", "labels", "q"), {"v": width},
                ["q", "vec_id", "score"])
    good = stage(_merged(found, ["q"], positives, parts), "positives")
    # at most ``positives`` rows an anchor, so the lists are short
    listed = good.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("p"))
    listed = listed.select("q", F.size("p").cast("long").alias("n_scores"), F.slice(F.concat(
        F.col("p.score"), F.array_repeat(F.lit(0).cast("long"), positives)), 1, positives).alias("scores"))
    found = met(asked.join(listed, "q"), lambda a, b: negatives_in(a, b, negatives, share),
                ("ids", "labels", "q", "n_scores"), {"v": width, "scores": positives},
                ["q", "place", "vec_id", "score"])
    found = _merged(found, ["q", "place"], negatives, parts).select(
        "q", (F.col("place") + 1).alias("positive_rank"), F.col("vec_id").alias("negative_id"),
        F.col("score").alias("negative_score"), F.col("rank").cast("int").alias("rank"))
    good = good.select("q", F.col("rank").cast("long").alias("positive_rank"), F.col("vec_id").alias("positive_id"),
                       F.col("score").alias("positive_score"))
    return (found.join(good, ["q", "positive_rank"]).join(asked.select("q", F.col("ids").alias("anchor_id")), "q")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score",
                    F.col("positive_rank").cast("int").alias("positive_rank")))
