"""Quality classifier: hashed word n-gram logistic regression trained with
follow-the-regularised-leader (FTRL-proximal) updates.

Tokens are runs of word characters (letters, digits, all non-ASCII) and runs
of one punctuation mark; a token equal to the one before it in its text
becomes a repeat mark, so that stuttering text shares features whatever it
repeats.  A text's features are its 1- to 3-grams of tokens, hashed to
``2**BITS`` buckets, with the value log(1 + count), scaled to length one.

Fitting takes a bounded sample: of each class the ``PER_CLASS`` training rows
with the smallest id hash among labelled rows that have a text of at most
``SAMPLE_CHARS`` characters in ``documents``; only their features reach the
driver.  Updates run over the sample in hash order, ``EPOCHS`` times, weighed
to the class shares of all labelled training rows.  The margin is calibrated on
folds it was not fitted on.  Scoring covers every row and whole texts: a sparse
dot product with the weights, most of which the l1 term keeps at zero.

Defined results: null and empty texts have no features and get the calibrated
bias's score; without labels of both classes nothing is learned and every score is
the share of good training labels (0.5 where there is none); label rows with a
null id or class are left out; a labelled id that several rows repeat is
learned from its smallest text, and a repeated label counts again; repeated
rows get equal scores; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copyledger.llm.common import keep_rows, python_ready, row_key, stage
from copyledger.llm.words import BASE, BYTES, GRAM_BASE, chunks, mix, powers

BITS = 18
ORDERS = 3
PER_CLASS = 2000
SAMPLE_CHARS = 20_000
THRESHOLD = 0.3
EPOCHS = 4
FOLDS = 4
PIECE = 1 << 20
SAME = np.uint64(0x5851F42D4C957F2D)
WORD, BLANK = 256, 257
KIND = np.arange(256)
KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = WORD
KIND[[9, 10, 11, 12, 13, 32]] = BLANK


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def tokens(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of the tokens of a text's bytes, repeat marks not yet put in."""
    buf = np.frombuffer(raw, np.uint8)
    kind = KIND[buf]
    start = np.flatnonzero(np.diff(kind, prepend=-1))
    size = np.diff(start, append=len(buf))
    solid = kind[start] != BLANK
    start, size = start[solid], size[solid]
    if not len(start):
        return np.zeros(0, np.uint64), start
    inside = kind != BLANK
    at = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(at, size)
    return mix(np.add.reduceat(BYTES[buf[inside]] * powers(BASE, int(size.max()))[place], at)), start


def grams(hashes: np.ndarray, owner: np.ndarray, fresh: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(owner, bucket) of every n-gram inside one owner that ends at token ``fresh`` or later."""
    h = hashes.copy()
    again = np.flatnonzero((hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])) + 1
    h[again] = SAME
    who, out, g = [], [], np.zeros(len(h), np.uint64)
    for n in range(1, min(ORDERS, len(h)) + 1):
        m = len(h) - n + 1
        g = g[:m] * GRAM_BASE + h[n - 1:] + np.uint64(n)
        at = np.flatnonzero(owner[:m] == owner[n - 1:])
        at = at[at + n > fresh]
        who.append(owner[at])
        out.append((mix(g[at]) >> np.uint64(64 - BITS)).astype(np.int64))
    return (np.concatenate(who), np.concatenate(out)) if out else (owner[:0], np.zeros(0, np.int64))


def long_counts(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, count) of a long text, read piece by piece; pieces end at a blank
    or a mark where there is one and carry ``ORDERS`` tokens into the next."""
    count = np.zeros(1 << BITS, np.int64)
    carry, at = np.zeros(0, np.uint64), 0
    while at < len(raw):
        end = min(len(raw), at + PIECE)
        while end < len(raw) and KIND[raw[end]] == KIND[raw[end - 1]] != BLANK:
            end += 1
        h = np.concatenate([carry, tokens(raw[at:end])[0]])
        count += np.bincount(grams(h, np.zeros(len(h), np.int64), len(carry))[1], minlength=1 << BITS)
        carry, at = h[-ORDERS:], end
    bucket = np.flatnonzero(count)
    return bucket, count[bucket]


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, value) of the texts' features, by text and bucket."""
    pairs, count = [], []
    short = [i for i, t in enumerate(texts) if len(t) <= PIECE]
    if short:
        h, start = tokens(b" ".join(texts[i] for i in short))
        begins = np.cumsum([0] + [len(texts[i]) + 1 for i in short])[:-1]
        own = np.searchsorted(begins, start, "right") - 1
        who, bucket = grams(h, own)
        pair, n = np.unique(np.array(short)[who] << BITS | bucket, return_counts=True)
        pairs.append(pair)
        count.append(n)
    for i, t in enumerate(texts):
        if len(t) > PIECE:
            bucket, n = long_counts(t)
            pairs.append(i << BITS | bucket)
            count.append(n)
    if not pairs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    pair, value = np.concatenate(pairs), np.log1p(np.concatenate(count))
    order = np.argsort(pair, kind="stable")
    doc, bucket, value = pair[order] >> BITS, pair[order] & (1 << BITS) - 1, value[order]
    norm = np.sqrt(np.bincount(doc, value * value, len(texts)))
    return doc, bucket, value / norm[doc]


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS,
         alpha: float = 1.0, beta: float = 1.0, l1: float = 0.1, l2: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias after FTRL-proximal updates, row after row; the bias is
    one more coordinate, without l1."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    least = np.full(len(z), l1)
    least[-1] = 0

    def at(i):
        return -np.sign(z[i]) * np.maximum(np.abs(z[i]) - least[i], 0) / ((beta + np.sqrt(n[i])) / alpha + l2)

    rows = [(np.append(i, len(z) - 1), np.append(x, 1.0)) for i, x in rows]
    for _ in range(epochs):
        for (i, x), label, c in zip(rows, y, weight):
            w = at(i)
            g = (sigmoid(w @ x) - label) * c * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    w = at(np.arange(len(z)))
    return w[:-1], float(w[-1])


def fit(rows: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, share: float) -> Model:
    """Fit on the sample's (buckets, values); ``share``: the share of good
    texts the score is calibrated for."""
    y = np.asarray(good, float)
    if not 0 < y.sum() < len(y):
        edge = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(1 << BITS), float(np.log(edge / (1 - edge))))
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    margin, fold = np.zeros(len(y)), np.zeros(len(y), int)
    for c in (0, 1):  # every fold has its share of both classes
        fold[y == c] = np.arange(int((y == c).sum())) % FOLDS
    for f in range(FOLDS):
        use = np.flatnonzero(fold != f)
        w, b = ftrl([rows[i] for i in use], y[use], weight[use])
        for i in np.flatnonzero(fold == f):
            margin[i] = w[rows[i][0]] @ rows[i][1] + b
    slope, shift = platt(margin, y, weight)
    w, b = ftrl(rows, y, weight)
    return Model(w, b, slope, shift)


def platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the calibrated margin, by Newton steps on smoothed labels."""
    pos, neg = y.sum(), (1 - y).sum()
    goal = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([z, np.ones_like(z)])
    t = np.array([1.0, 0.0])
    for _ in range(50):
        p = sigmoid(t @ x)
        grad = x @ (weight * (p - goal)) / len(y)
        hess = (x * (weight * p * (1 - p))) @ x.T / len(y) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        t = t - step * min(1, 2 / max(1e-12, np.abs(step).max()))
    return max(float(t[0]), 1e-3), float(t[1])


def scores(model: Model, texts: list[bytes]) -> np.ndarray:
    out = np.full(len(texts), model.bias)
    for lo, hi in chunks(texts):
        doc, bucket, value = features(texts[lo:hi])
        out[lo:hi] += np.bincount(doc, model.weights[bucket] * value, hi - lo)
    return sigmoid(model.slope * out + model.shift)


def encoded(column) -> list[bytes]:
    return [(t or "").encode("utf-8", "replace") for t in column.to_pylist()]


def _features(batches):
    for batch in batches:
        texts = encoded(batch["text"])
        cut = []
        for lo, hi in chunks(texts):
            doc, bucket, value = features(texts[lo:hi])
            ends = np.searchsorted(doc, np.arange(hi - lo + 1))
            cut += [(bucket[a:b].astype(np.int32).tobytes(), value[a:b].astype(np.float32).tobytes())
                    for a, b in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array([c[0] for c in cut], pa.binary()), pa.array([c[1] for c in cut], pa.binary())],
            ["doc_id", "buckets", "vals"])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the bounded sample of labelled rows that are not held out and have a usable text."""
    known = (labels.select(F.col("doc_id").cast("long").alias("i"), F.col("quality").cast("int").alias("good"))
             .where(F.col("i").isNotNull() & F.col("good").isin(0, 1) & ~held_out(F.col("i"))))
    usable = docs.where(F.length("text").between(1, SAMPLE_CHARS)).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = stage(known.join(usable.select(F.col("doc_id").alias("i")).distinct(), "i", "left_semi")
                  .withColumn("h", F.xxhash64("i")), "quality-labels")
    sizes = {r["good"]: r["count"] for r in known.groupBy("good").count().collect()}
    part = [known.where(F.col("good") == c).orderBy("h", "i").limit(PER_CLASS) for c in (0, 1)]
    picked = stage(part[0].unionByName(part[1]), "quality-sample")
    wanted = F.broadcast(picked.select(F.col("i").alias("doc_id")).distinct())  # at most 2 * PER_CLASS rows
    texts = usable.join(wanted, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    found = texts.mapInArrow(_features, "doc_id long, buckets binary, vals binary")
    rows = found.join(picked, F.col("doc_id") == F.col("i")).select("h", "i", "good", "buckets", "vals").collect()
    rows.sort(key=lambda r: (r["h"], r["i"], r["good"]))
    total = sum(sizes.values())
    return fit([(np.frombuffer(r["buckets"], np.int32).astype(np.int64), np.frombuffer(r["vals"], np.float32).astype(float))
                for r in rows], np.array([r["good"] for r in rows], float), sizes.get(1, 0) / total if total else 0.5)


def _score(model):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["key"], pa.array(scores(model.value, encoded(batch["text"])))],
                ["doc_id", "key", "score"])
    return run


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, key, held_out, score, predicted."""
    spark = python_ready(docs.sparkSession)
    model = spark.sparkContext.broadcast(train(docs, labels))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), "text")
    return (rows.mapInArrow(_score(model), "doc_id long, key long, score double")
            .select("doc_id", "key", held_out(F.col("doc_id")).alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted")))


def of_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows scored under the threshold."""
    low = score_quality(docs, labels, threshold).where("predicted = 0")
    return keep_rows(docs, low.select("key", F.col("doc_id").alias("id")).distinct(), "left_anti")
