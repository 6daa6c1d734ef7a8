"""CRC matrices, features by definition, the query's SQL, brute force, edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np

import __spark_entry__ as E
from copyledger.llm import importance

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_matrices_equal_the_library():
    rng = np.random.default_rng(1)
    buf = rng.integers(0, 256, 5000).astype(np.uint8)
    start = rng.integers(0, 4000, 700)
    size = np.where(np.arange(700) < 5, 900, rng.integers(0, 40, 700))
    want = [zlib.crc32(buf[a:a + n].tobytes()) for a, n in zip(start, size)]
    assert importance.crcs(buf, start, size).tolist() == want
    assert importance.crcs(buf, start[:0], size[:0]).tolist() == []


def plain(text):
    w = WORDS.findall((text or "").translate(ASCII))
    runs = [" ".join(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]
    return len(w), Counter(zlib.crc32(r.encode()) % importance.BUCKETS for r in runs)


def test_features_by_definition(monkeypatch):
    rng = random.Random(4)
    long = " ".join(rng.choice(["a", "Bc", "döf", "日本", "x" * 90, "12"]) + rng.choice(["", ",", " .", "\n"])
                    for _ in range(700))
    texts = ["", " .,", "One", "one  two", "a-b c_d\x00e", "Ä Ö ä", long, "z" * 300, "one one one one"]
    for piece in (importance.PIECE, 50):  # the second reads the long text in pieces
        monkeypatch.setattr(importance, "PIECE", piece)
        got = importance.features([t.encode().lower() for t in texts])
        assert [(n, Counter(b.tolist())) for n, b in got] == [plain(t) for t in texts]


def test_numbers_are_equal_for_equal_words_only():
    rng = random.Random(9)
    words = ["".join(rng.choice("ab") for _ in range(rng.choice([1, 3, 8, 9, 17, 70]))).encode() for _ in range(900)]
    buf = np.frombuffer(b"".join(words), np.uint8)
    size = np.array([len(w) for w in words])
    number = importance.word_numbers(buf, np.cumsum(size) - size, size).tolist()
    assert len(set(zip(words, number))) == len(set(words)) == len(set(number))


def brute(docs, target, percent=5, least=20):
    s, t = Counter(), Counter()
    found = {d: plain(text) for d, text in docs}
    for _, c in found.values():
        s.update(c)
    for _, text in target:
        t.update(plain(text)[1])
    k, ss, tt = importance.BUCKETS, sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (ss + k) / ((s[b] + 1.0) * (tt + k)))) for b in range(k)]
    out = {}
    for d, (n, c) in found.items():
        h = int(hashlib.sha256(f"42:{d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * m for b, m in c.items())
        out[d] = [sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32))), None]
    some = sorted((-out[d][2], d) for d in found if found[d][0] >= least)
    for place, (_, d) in enumerate(some[:percent * len(some) // 100], 1):
        out[d][3] = place
    return out


def table(name, sf):
    return duckdb.connect().execute(f"SELECT #1, text FROM read_parquet('{sf}/{name}.parquet')").fetchall()


def test_query_equals_brute_force(spark):
    got = E.queries()["op13_importance"](spark, MIDDLE).collect()
    want = brute(table("documents", MIDDLE), table("benchmark", MIDDLE))
    assert {r["doc_id"]: [r["n_features"], r["weight"], r["score"], r["rank"]] for r in got} == want
    assert len(got) == len(want) and any(r["rank"] for r in got)


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SMALL}/{name}.parquet')")
    want = con.execute(E.oracle_sql()["op13_importance"])
    cols = [d[0] for d in want.description]
    got = E.queries()["op13_importance"](spark, SMALL).select(*cols).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))


def test_edges(spark, docs, empty):
    target = spark.createDataFrame([("alpha beta w1x1 w2x2",), (None,), ("",)], "text string")
    rows = importance.resample(docs, target, percent=50, least_words=2)
    got = rows.collect()
    assert len(got) == docs.count()
    assert all(r["weight"] == r["n_features"] == 0 and r["rank"] is None for r in got if r["doc_id"] in (1, 2, 3))
    fit = [r for r in got if r["n_words"] >= 2]
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(fit) // 2 + 1))
    again = importance.resample(docs.repartition(5), target, percent=50, least_words=2).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert importance.resample(empty, target).count() == 0
    assert importance.resample(docs, target.limit(0), percent=50, least_words=2).count() == len(got)
    kept = importance.drawn_documents(docs, target, percent=50, least_words=2)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if r["rank"]}
