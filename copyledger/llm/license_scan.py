"""License scans by diagonal voting.

All rolling word k-grams of a text are held against the k-grams of license
templates (a bitmap of their hashes lets through those that can match) and
joined in Spark with the template positions, on hash and words.  Matches vote
for their diagonal, text position minus template position; a diagonal with all
votes is a literal occurrence.  Neighbouring diagonals are merged, so a few
inserted or missing words do not split a notice, and a merged band is verified
by the share of template words that its matches cover.

Base labels come from literal occurrences of the three base phrases; the
method adds the labels of templates covered by ``COVERED`` or more.  Templates
are whole notices and the short forms of file headers.  Where versions or
variants differ in a few words, these must stand literally, on one diagonal:
their share says nothing in a long notice.

Defined results: null and empty texts have 0 words and no labels; overlapping
places count each; repeated rows get a result each; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from copyledger.llm.common import python_ready, row_key, stage
from copyledger.llm.license_texts import NOTICES
from copyledger.llm.words import Membership, Words, chunks

# The base phrases of the contract.
BASE_PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
K = 3
NEAR = 2
COVERED = 0.8
BITS = 20


def _place(text: str, phrase: str, k: int) -> list[int]:
    """Positions of the k-grams of a phrase that stands once in a text."""
    words = Words([text.lower().encode(), phrase.lower().encode()])
    if not (n := int(words.n[1])):
        return []
    want = words.gram(int(words.first[1]), n)
    at = [i for i in range(int(words.n[0]) - n + 1) if words.gram(int(words.first[0]) + i, n) == want]
    if len(at) != 1:
        raise ValueError(f"{phrase!r} stands {len(at)} times in its notice")
    return list(range(at[0], at[0] + n - k + 1))


def template_grams(k: int = K) -> list[tuple[int, str, bool, int, list[int], int, int, str]]:
    """(template, label, base, words, needed grams, position, hash, gram) of all templates."""
    named = [(a, "", b, True) for a, b in BASE_PHRASES] + [(*notice, False) for notice in NOTICES]
    words = Words([text.lower().encode() for _, _, text, _ in named])
    needed = [_place(text, phrase, k) for _, phrase, text, _ in named]
    hashes, at = words.grams(k)
    doc = words.doc[at]
    return [(int(d), named[d][0], named[d][3], int(words.n[d]), needed[d], int(i - words.first[d]),
             int(h), words.gram(int(i), k)) for d, i, h in zip(doc, at, hashes.view(np.int64))]


def _hits(k: int, packed: bytes):
    def run(batches):
        known = Membership(BITS, packed)
        kind = pa.list_(pa.struct([("pos", pa.int32()), ("hash", pa.int64()), ("gram", pa.string())]))
        for batch in batches:
            texts = [(t or "").encode("utf-8", "replace").lower() for t in batch["text"].to_pylist()]
            n_words, hits = [], []
            for lo, hi in chunks(texts):
                words = Words(texts[lo:hi])
                hashes, at = words.grams(k)
                got = known.has(hashes)
                own = [[] for _ in range(lo, hi)]
                for h, i in zip(hashes[got].view(np.int64).tolist(), at[got].tolist()):
                    d = words.doc[i]
                    own[d].append({"pos": i - int(words.first[d]), "hash": h, "gram": words.gram(i, k)})
                hits += own
                n_words += words.n.tolist()
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["key"], pa.array(n_words, pa.int64()), pa.array(hits, kind)],
                ["doc_id", "key", "n_words", "hits"])
    return run


def votes(spark: SparkSession, texts: DataFrame, k: int = K) -> DataFrame:
    """``texts(id, key, hits)`` -> one row per (row, template, diagonal) with its template positions."""
    grams = spark.createDataFrame(template_grams(k), "template int, label string, base boolean, words int, "
                                                     "needed array<int>, tpos int, h long, g string")
    hits = texts.where(F.size("hits") > 0).select("doc_id", "key", F.explode("hits").alias("hit"))
    met = hits.join(grams, (F.col("hit.hash") == F.col("h")) & (F.col("hit.gram") == F.col("g")))
    return (met.groupBy("doc_id", "key", "template", "label", "base", "words", "needed",
                        (F.col("hit.pos") - F.col("tpos")).alias("diagonal"))
            .agg(F.collect_set("tpos").alias("tpos")))


def scan_licenses(docs: DataFrame, k: int = K, near: int = NEAR, covered: float = COVERED) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score (largest covered share of a template)."""
    spark = python_ready(docs.sparkSession)
    member = np.zeros(1 << BITS, bool)
    member[np.array([g[6] for g in template_grams(k)], np.int64).view(np.uint64) >> np.uint64(64 - BITS)] = True
    packed = np.packbits(member, bitorder="little").tobytes()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), "text")
    texts = stage(rows.mapInArrow(_hits(k, packed),
                                  "doc_id long, key long, n_words long, "
                                  "hits array<struct<pos: int, hash: long, gram: string>>"), "license-hits")
    found = votes(spark, texts, k)
    order = Window.partitionBy("doc_id", "key", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(order) > near
    bands = (found.withColumn("band", F.sum(F.coalesce(apart.cast("int"), F.lit(0))).over(order))
             .groupBy("doc_id", "key", "template", "label", "base", "words", "band")
             .agg(F.max(F.size(F.array_except("needed", "tpos")) == 0).alias("settled"),
                  F.array_distinct(F.flatten(F.collect_list("tpos"))).alias("tpos"),
                  F.collect_list(F.when(F.size("tpos") == F.col("words") - k + 1, F.col("diagonal"))).alias("whole")))
    spans = F.array_distinct(F.flatten(F.transform("tpos", lambda t: F.sequence(t, t + k - 1))))
    share = F.size(spans) / F.col("words")
    literal = F.col("base") & (F.size("whole") > 0)
    judged = bands.select("doc_id", "key", "label", "whole", share.alias("share"), literal.alias("literal"),
                          (literal | (F.col("settled") & (share >= covered))).alias("labelled"))
    of_doc = judged.groupBy("doc_id", "key").agg(
        F.sum(F.when(F.col("literal"), F.size("whole")).otherwise(0)).cast("long").alias("n_base"),
        F.min(F.when(F.col("literal"), F.array_min("whole"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("literal"), F.array_max("whole"))).cast("long").alias("last_word"),
        F.collect_set(F.when(F.col("literal"), F.col("label"))).alias("base_labels"),
        F.collect_set(F.when(F.col("labelled"), F.col("label"))).alias("labels"),
        F.max("share").alias("score"))
    of_doc = of_doc.select(F.col("doc_id").alias("i"), F.col("key").alias("k"), "n_base", "first_word", "last_word",
                           *[F.array_join(F.array_sort(c), ",").alias(c) for c in ("base_labels", "labels")], "score")
    out = texts.select("doc_id", "key", "n_words").join(
        of_doc, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("i")), "left")
    zero = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    return out.select("doc_id", "n_words", *[
        F.coalesce(F.col(c), zero[c]).alias(c) if c in zero else F.col(c)
        for c in ("n_base", "first_word", "last_word", "base_labels", "labels", "score")])
