"""Held-out labels, FTRL against a plain statement, features, edge cases."""

import math
import random
import zlib

import duckdb
import numpy as np

import __spark_entry__ as E
from copyledger.llm import quality

MIDDLE = "/root/testdata/sf0.01"
KIND = "doc_id long, text string, score string, good string, i string"


def test_held_out_labels(spark):
    got = {r["doc_id"]: r for r in E.queries()["op12_quality"](spark, MIDDLE).collect()}
    con = duckdb.connect()
    labels = con.execute(f"SELECT doc_id, quality FROM read_parquet('{MIDDLE}/labels.parquet')").fetchall()
    assert len(got) == con.execute(f"SELECT count(*) FROM read_parquet('{MIDDLE}/documents.parquet')").fetchone()[0]
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    held = [(got[d], q) for d, q in labels if got[d]["held_out"]]
    good, bad = ([r for r, q in held if q == c] for c in (1, 0))
    assert len(good) > 40 and len(bad) > 5
    assert np.mean([r["predicted"] for r in good]) > 0.97 and np.mean([r["predicted"] for r in bad]) < 0.2
    assert np.mean([a["score"] > b["score"] for a in good for b in bad]) > 0.98
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in got.values())


def test_updates_equal_the_plain_statement():
    rng = random.Random(5)
    rows = [(np.array(sorted(rng.sample(range(40), 6))), np.array([rng.random() for _ in range(6)])) for _ in range(60)]
    y, c = np.array([float(r[0][0] % 2) for r in rows]), np.array([rng.choice([0.5, 2.0]) for _ in rows])
    alpha, beta, l1, l2 = 0.7, 1.0, 0.05, 0.2
    z, n = [0.0] * 41, [0.0] * 41

    def weight(i):
        least = 0 if i == 40 else l1
        return 0.0 if abs(z[i]) <= least else -(z[i] - math.copysign(least, z[i])) / ((beta + n[i] ** 0.5) / alpha + l2)
    for _ in range(2):
        for (at, x), label, k in zip(rows, y, c):
            pairs = [*zip(at.tolist(), x.tolist()), (40, 1.0)]
            w = {i: weight(i) for i, _ in pairs}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in pairs)))
            for i, v in pairs:
                g = (p - label) * k * v
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha * w[i]
                n[i] += g * g
    moved = [(np.where(at == 40, 0, at), x) for at, x in rows]
    w, b = quality.ftrl(moved, y, c, 2, alpha, beta, l1, l2)
    assert np.allclose(w[:40], [weight(i) for i in range(40)]) and abs(b - weight(40)) < 1e-9
    assert not w[40:].any()


def plain(text):
    """{bucket: value} by definition, from the hashes of single tokens."""
    h = quality.tokens(text.encode())[0].tolist()
    h = [int(quality.SAME) if i and h[i] == h[i - 1] else x for i, x in enumerate(h)]
    count = {}
    for n in range(1, quality.ORDERS + 1):
        for i in range(len(h) - n + 1):
            g = 0
            for j in range(n):
                g = (g * int(quality.GRAM_BASE) + h[i + j] + j + 1) % (1 << 64)
            b = int(quality.mix(np.array([g], np.uint64))[0]) >> 64 - quality.BITS
            count[b] = count.get(b, 0) + 1
    norm = math.sqrt(sum(math.log1p(v) ** 2 for v in count.values())) or 1
    return {b: math.log1p(v) / norm for b, v in count.items()}


def test_features_by_definition(monkeypatch):
    texts = ["", "one", "one one  one two!!! Two", "größe 日本 | | x", " ", "a\tb\nc d", "one one"]
    rng = random.Random(2)
    texts.append(" ".join(rng.choice(["ab", "cd!!", "x", "##", "yz yz"]) for _ in range(900)))
    for piece in (quality.PIECE, 64):  # the second reads the long text in pieces
        monkeypatch.setattr(quality, "PIECE", piece)
        doc, bucket, value = quality.features([t.encode() for t in texts])
        for i, t in enumerate(texts):
            want, got = plain(t), dict(zip(bucket[doc == i].tolist(), value[doc == i].tolist()))
            assert got.keys() == want.keys() and all(abs(got[b] - want[b]) < 1e-9 for b in want)


def test_edges(spark, docs, empty):
    labels = spark.createDataFrame([(8, 1), (5, 0), (6, 0), (None, 1), (7, None), (8, 1)], "doc_id long, quality int")
    out = quality.score_quality(docs, labels)
    assert out.count() == docs.count() and out.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    blank = {r["score"] for r in out.where("doc_id IN (1, 2, 3)").collect()}
    assert len(blank) == 1
    assert quality.score_quality(empty, labels).count() == 0
    none = quality.score_quality(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    one = quality.score_quality(docs, labels.where("quality = 1")).collect()
    assert min(r["score"] for r in one) > 0.9
    assert quality.of_quality(docs, labels).columns == docs.columns


def test_labels_far_beyond_the_documents(spark):
    """Labels without a text do not push usable ones out of the sample."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdefg") for _ in range(30)) + (" !!!" * 5 if i % 2 else "")) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    few = spark.createDataFrame([(i, 1 - i % 2) for i in range(200)], "doc_id long, quality int")
    many = few.unionByName(spark.range(1000, 100_000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality"))
    a, b = (quality.train(docs, labels) for labels in (few, many))
    assert np.array_equal(a.weights, b.weights) and np.count_nonzero(a.weights) > 3
