"""Toxicity: a linear classifier over character n-grams whose features are
scaled by naive Bayes log-count ratios.

A text's features are the distinct n-grams of 4 to 6 code points, lower-cased,
hashed to 2**22 buckets.  Fitting takes a bounded sample: of each class the
``PER_CLASS`` training rows with the smallest id hash among labelled rows that
have a text of up to ``SAMPLE_CHARS`` characters in ``documents``; the class
shares come from all of these labelled rows.  Buckets are kept by chi-square, scaled by the log ratio of their
smoothed shares in the two classes, weighed by ridge logistic regression, and
the margin is calibrated on folds it was not fitted on, for the true shares.
Scoring covers every row and whole texts; its model is a few thousand numbers.

Defined results: null and empty texts have no features and get the score of
the calibrated bias; without labels of both classes nothing is learned and
every score is the share of toxic training labels, 0.5 at most, so that
nothing is rejected; repeated labels count again; label rows with a null id or
class are left out, and a labelled id that several rows repeat is learned from
its smallest text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copyledger.llm.common import keep_rows, python_ready, row_key, stage
from copyledger.llm.words import mix

SIZES = (4, 5, 6)
BITS = 22
PER_CLASS = 1500
SAMPLE_CHARS = 20_000
FEATURES = 1 << 13
LEAST_DOCS = 5
THRESHOLD = 0.7
FOLDS = 5
CHUNK_CHARS = 1 << 17
BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    buckets: np.ndarray
    weights: np.ndarray
    bias: float


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def features(texts: list[str | None], keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, bucket) pairs; ``keep``: flags of wanted buckets."""
    codes, owner = [], []
    for i, t in enumerate(texts):
        own = np.frombuffer(f" {(t or '').lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        codes.append(own)
        owner.append(np.full(len(own), i, np.int32))
    code, owner = np.concatenate(codes).astype(np.uint64), np.concatenate(owner)
    found = []
    h = np.zeros(len(code), np.uint64)
    for n in range(1, max(SIZES) + 1):
        m = len(code) - n + 1
        if m <= 0:
            break
        h = h[:m] * BASE + code[n - 1:] + np.uint64(1)
        if n in SIZES:
            bucket = (mix(h) >> np.uint64(64 - BITS)).astype(np.int64)
            inside = owner[:m] == owner[n - 1:]
            at = np.flatnonzero(inside if keep is None else inside & keep[bucket])
            found.append(owner[at].astype(np.int64) << BITS | bucket[at])
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs >> BITS, pairs & (1 << BITS) - 1


def groups(texts: list[str | None], limit: int = CHUNK_CHARS):
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t or "") > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t or "")
    if lo < len(texts):
        yield lo, len(texts)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def logistic(doc, feat, value, y, weight, n_feat, ridge=3e-3, rounds=150, rate=0.05):
    """Ridge logistic regression on sparse rows by Adam; (weights, bias)."""
    w, b = np.zeros(n_feat), 0.0
    m, v = np.zeros(n_feat + 1), np.zeros(n_feat + 1)
    weight = weight / weight.sum()
    for t in range(1, rounds + 1):
        z = np.bincount(doc, value * w[feat], len(y)) + b
        err = (sigmoid(z) - y) * weight
        g = np.append(np.bincount(feat, value * err[doc], n_feat) + ridge * w, err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def fit(texts: list[str], toxic: np.ndarray, share: float) -> Model:
    """Fit on the sample; ``share``: the toxic share the score is calibrated for."""
    toxic = np.asarray(toxic, float)
    if not 0 < toxic.sum() < len(toxic):
        edge = min(max(share, 1e-6), 0.5)
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(edge / (1 - edge))))
    n = len(toxic)
    count = np.zeros((2, 1 << BITS), np.int32)
    for lo, hi in groups(texts):
        doc, bucket = features(texts[lo:hi])
        for c in (0, 1):
            count[c] += np.bincount(bucket[toxic[doc + lo] == c], minlength=1 << BITS).astype(np.int32)
    pos, neg = toxic.sum(), n - toxic.sum()
    seen = np.flatnonzero(count.sum(axis=0) >= min(LEAST_DOCS, max(1, n // 4)))
    a, b = count[1, seen].astype(float), count[0, seen].astype(float)
    both = a + b
    chi = n * (a * (neg - b) - b * (pos - a)) ** 2 / np.maximum(both * (n - both) * pos * neg, 1)
    best = np.sort(np.lexsort((seen, -chi))[:FEATURES])
    chosen, a, b = seen[best], a[best] + 1, b[best] + 1
    ratio = np.log(a / a.sum() / (b / b.sum()))
    place = np.full(1 << BITS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    docs, feats = [], []
    for lo, hi in groups(texts):
        doc, bucket = features(texts[lo:hi], place >= 0)
        docs.append(doc + lo)
        feats.append(place[bucket])
    doc, feat = np.concatenate(docs), np.concatenate(feats)
    weight = np.where(toxic == 1, share / pos, (1 - share) / neg)
    even = np.where(toxic == 1, 0.5 / pos, 0.5 / neg)
    margin, fold = np.zeros(n), np.zeros(n, int)
    for c in (0, 1):  # every fold has its share of both classes
        fold[toxic == c] = np.arange(int((toxic == c).sum())) % FOLDS
    for f in range(FOLDS):
        use = fold[doc] != f
        w, c = logistic(doc[use], feat[use], ratio[feat[use]], toxic, np.where(fold != f, even, 0), len(chosen))
        out = ~use
        margin += np.where(fold == f, np.bincount(doc[out], (ratio * w)[feat[out]], n) + c, 0)
    goal = np.where(toxic == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))  # Platt's smoothed labels
    scale, shift = logistic(np.arange(n), np.zeros(n, np.int64), margin, goal, weight, 1,
                            ridge=1e-4, rounds=1500)
    w, c = logistic(doc, feat, ratio[feat], toxic, even, len(chosen))
    slope = max(float(scale[0]), 1e-3)
    return Model(chosen, ratio * w * slope, float(c * slope + shift))


def scores(model: Model, texts: list[str | None]) -> np.ndarray:
    table = np.zeros(1 << BITS)
    table[model.buckets] = model.weights
    keep = np.zeros(1 << BITS, bool)
    keep[model.buckets] = True
    out = np.full(len(texts), model.bias)
    for lo, hi in groups(texts):
        doc, bucket = features(texts[lo:hi], keep)
        out[lo:hi] += np.bincount(doc, table[bucket], hi - lo)
    return sigmoid(out)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the bounded sample of labelled rows that are not held out."""
    known = (labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
             .where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))))
    usable = docs.where(F.length("text") <= SAMPLE_CHARS).select("doc_id", "text")
    # only labels that have such a text: labels of other corpora do not push them out of the sample
    known = stage(known.join(usable.select("doc_id").distinct(), "doc_id", "left_semi")
                  .withColumn("h", F.xxhash64("doc_id")), "toxic-labels")
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    sample = [known.where(F.col("toxic") == c).orderBy("h", "doc_id").limit(PER_CLASS) for c in (0, 1)]
    picked = stage(sample[0].unionByName(sample[1]).select(F.col("doc_id").alias("i"), "toxic", "h"), "toxic-sample")
    wanted = F.broadcast(picked.select("i").distinct())  # at most 2 * PER_CLASS rows
    texts = (usable.join(wanted, F.col("doc_id") == F.col("i"), "left_semi")
             .groupBy("doc_id").agg(F.min("text").alias("text")))
    rows = (texts.join(picked, F.col("doc_id") == F.col("i"))
            .select("h", "doc_id", "toxic", "text").collect())
    rows.sort(key=lambda r: (r["h"], r["doc_id"], r["toxic"], r["text"]))
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    return fit([r["text"] for r in rows], np.array([r["toxic"] for r in rows], float), share)


def _score(model):
    def run(batches):
        for batch in batches:
            s = scores(model.value, batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["key"], pa.array(s)],
                                             ["doc_id", "key", "score"])
    return run


def score_texts(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, key, held_out, score, predicted."""
    spark = python_ready(docs.sparkSession)
    model = spark.sparkContext.broadcast(train(docs, labels))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), "text")
    return (rows.mapInArrow(_score(model), "doc_id long, key long, score double")
            .select("doc_id", "key", held_out(F.col("doc_id")).alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted")))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows scored at the threshold or above."""
    rejected = score_texts(docs, labels, threshold).where("predicted = 1")
    return keep_rows(docs, rejected.select("key", F.col("doc_id").alias("id")).distinct(), "left_anti")
