"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from copyledger.llm import (
    chunk_dedup,
    decontam,
    graph,
    license_scan,
    line_dedup,
    mixing,
    secret_scan,
    simhash,
    token_counts,
    topk,
    toxicity,
)
from llm.conftest import LINE, LONG, ROWS


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(8, 1, 1), (5, 1, 0), (6, 1, 0), (None, 1, 1), (7, None, None), (8, 1, 1)],
                                 "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "five six seven eight nine"), (2, None), (3, ""), (4, "too short"),
                                  (None, "a text without an id")], "item_id long, text string")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_mixing(docs, empty):
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == len(ROWS)
    got = {(r["doc_id"], r["source"]): r for r in rows}
    assert got[1, "a"]["size"] == got[1, "a"]["taken"] == 0 and got[3, "a"]["size"] == 0
    assert all(r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in rows)
    total = sum(r["size"] for r in rows)
    targets = {r["source"]: (r["target"], r["source_size"]) for r in rows}
    assert sum(t for t, _ in targets.values()) == pytest.approx(1.5 * total)
    assert all(t <= 2 * s for t, s in targets.values())
    assert got[9, None]["source_size"] == 5 + 5 + 8 + 4
    assert mixing.mix_sources(empty).count() == 0
    again = sorted(map(str, mixing.mix_sources(docs.repartition(7)).collect()))
    assert again == sorted(map(str, rows))
    plan = mixing.mix_sources(docs.where("doc_id < 9"))
    mix = mixing.mixed_documents(docs.where("doc_id < 9"), plan)
    assert mix.columns == docs.columns
    assert mix.count() == plan.agg(F.sum("copies")).first()[0]


def test_line_dedup(docs, empty):
    out = line_dedup.dedup_lines(docs).select("row.doc_id", "kept", "n_lines", "n_dropped")
    got = by_id(out.where("doc_id IS NOT NULL"))
    assert out.count() == len(ROWS)
    assert (got[1]["kept"], got[1]["n_lines"], got[1]["n_dropped"]) == ("", 1, 0)
    assert (got[3]["kept"], got[3]["n_lines"]) == (" \n\t ", 2)
    assert got[4]["kept"] == LONG
    assert got[5]["kept"] == "alpha beta gamma delta"
    assert got[6]["kept"] == "one two three four"
    assert got[7]["kept"] == f"{LINE}\nfive six seven eight nine" and got[7]["n_dropped"] == 0
    kept = line_dedup.without_frequent_lines(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 5").first()["n_chars"] == 22
    assert line_dedup.without_frequent_lines(empty).count() == 0


def test_simhash(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    zero = {r["component_id"] for r in got if r["fp"] == 0}
    assert zero == {1} and sum(r["fp"] == 0 for r in got) == 4
    assert [r["component_id"] for r in got if r["doc_id"] == 9] == [9, 9]
    assert [r["component_id"] for r in got if r["doc_id"] is None and r["fp"] != 0] == [None]
    kept = simhash.one_of_each(docs)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs.columns
    assert sorted(x or 0 for x in ids) == [0, 1, 4, 5, 6, 7, 8, 9]
    assert simhash.one_of_each(empty).count() == 0


def test_decontamination(docs, empty, benchmark):
    found = {(r["doc_id"], r["item_id"]): r for r in decontam.overlaps(docs, benchmark).collect()}
    assert set(found) == {(7, 1), (None, None)}
    assert found[7, 1]["coverage"] == 1.0
    kept = decontam.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 2
    assert decontam.decontaminate(empty, benchmark).count() == 0
    assert decontam.decontaminate(docs, benchmark.limit(0)).count() == len(ROWS)


def test_toxicity(docs, empty, labels):
    got = toxicity.score_texts(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    blank = {r["score"] for r in got if r["doc_id"] in (1, 2)}
    assert len(blank) == 1
    assert toxicity.score_texts(empty, labels).count() == 0
    none = toxicity.score_texts(docs, labels.limit(0)).collect()
    assert len(none) == len(ROWS) and not any(r["predicted"] for r in none)
    assert toxicity.without_toxic(docs, labels.limit(0)).columns == docs.columns


def test_toxicity_learns_a_repeated_id_once(spark, labels):
    ids = [r["doc_id"] for r in labels.collect()]
    rows = spark.createDataFrame([(i, f"text of {i} and more words {i % 3}") for i in ids if i is not None],
                                 "doc_id long, text string")
    again = rows.crossJoin(spark.range(5).select("id")).drop("id")
    one, many = toxicity.train(rows, labels), toxicity.train(again, labels)
    assert (one.buckets == many.buckets).all() and (one.weights == many.weights).all() and one.bias == many.bias


def test_token_counts(docs, empty, vocabulary):
    got = by_id(token_counts.count_tokens(docs, vocabulary).where("doc_id IS NOT NULL"))
    assert (got[1]["n_bytes"], got[1]["n_tokens"], got[2]["n_tokens"], got[3]["n_tokens"]) == (0, 0, 0, 0)
    assert got[4]["n_bytes"] == len(LONG) and got[4]["over_limit"]
    assert token_counts.count_tokens(docs, vocabulary).count() == len(ROWS)
    assert token_counts.count_tokens(empty, vocabulary).count() == 0


def test_licenses(docs, empty):
    got = by_id(license_scan.scan_licenses(docs).where("doc_id IS NOT NULL"))
    assert (got[1]["n_words"], got[1]["n_base"], got[1]["first_word"], got[1]["labels"]) == (0, 0, None, "")
    assert got[4]["n_words"] == 60_000
    assert license_scan.scan_licenses(docs).count() == len(ROWS)
    assert license_scan.scan_licenses(empty).count() == 0


def test_secrets(docs, empty):
    out = secret_scan.scan_secrets(docs)
    assert out.count() == len(ROWS)
    assert all(not r["spans"] for r in out.where("doc_id IN (1, 2, 3)").collect())
    assert secret_scan.scan_secrets(empty).count() == 0


def test_chunk_dedup(spark, docs, empty):
    assert chunk_dedup.repeated_spans(empty).count() == 0
    rows = [(1, LONG), (2, LONG), (None, LONG), (3, None), (4, ""), (5, "short"), (6, LONG[:400])]
    got = chunk_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] or 0 for r in got) == [0, 1, 2, 6]
    removed = {r["doc_id"]: sum(s["removed"] for s in r["spans"]) for r in got}
    seen = {}  # LONG holds each of its 40-word runs once in 977 * 31 words
    for i, run in enumerate(zip(*(LONG.split()[k:] for k in range(40)))):
        seen.setdefault(run, []).append(i)
    again = sum(len(at) > 1 for at in seen.values())
    assert max(map(len, seen.values())) == 2 and again > 29_000
    assert removed[2] == 60_000 == removed[None] and abs(removed[1] - again) < 60
    # LONG repeats itself in a table of its own too; what else repeats there is shorter than a passage
    got = chunk_dedup.repeated_spans(docs).collect()
    assert [r["doc_id"] for r in got] == [4] and abs(sum(s["removed"] for s in got[0]["spans"]) - again) < 60


def test_topk(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, None, 1), (4, [None, 1.0], 1),
            (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, [-1.0, 0.5], 1), (7, [-1.0, 0.5], 1), (None, [1.0, 1.0], 1),
            (8, [2.0], 1), (100, [0.0, 1.0], 1), (100, [0.0, 1.0], 1)]
    vectors = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int"))
    got = topk.top_k(vectors, vectors.where("vec_id = 0"), 10).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [
        (1, 8), (2, 1), (3, 2), (4, 100), (5, 100), (6, 7), (7, 7)]
    assert topk.top_k(vectors.limit(0), vectors, 10).count() == 0
    assert topk.top_k(vectors, vectors.limit(0), 10).count() == 0


def test_topk_over_groups_of_shards(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 4)
    monkeypatch.setattr(topk, "BLOCK", 3)
    rows = [(i, [(i * 7 % 23) / 4.0, (i * 11 % 19) / 8.0 - 1, (i % 5) / 2.0]) for i in range(600)]
    vectors = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert -(-600 // 4) > 4 * spark.sparkContext.defaultParallelism  # a group holds several shards
    got = topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 4).collect()
    v = {i: [int(1024 * x // 1) for x in e] for i, e in rows}
    for q in range(0, 600, 50):
        want = sorted((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in v if c != q)[:4]
        assert [(-r["score"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == want


@pytest.mark.parametrize("most", [400, 10 ** 5, 10 ** 7, 1 << 40, (1 << 62) - 1])
def test_topk_is_exact_at_any_size(spark, most):
    """Integer inner products, far beyond what a float tells apart; held at the ends of a long."""
    rng = random.Random(most)
    rows = [(i, [rng.randint(-most, most) for _ in range(64)]) for i in range(150)]
    rows += [(150 + i, [x + (j == i) for j, x in enumerate(rows[3][1])]) for i in range(30)]  # nearly equal scores
    vectors = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = {}
    for r in topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), 10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    end = (1 << 63) - 1
    for q in range(0, 180, 20):
        scores = {i: max(-end, min(end, sum(x * y for x, y in zip(rows[q][1], v)))) for i, v in rows if i != q}
        want = sorted(scores, key=lambda i: (-scores[i], i))[:10]
        assert sorted(got[q]) == [(n, i, scores[i]) for n, i in enumerate(want, 1)]


def test_topk_repeated_queries(spark):
    """Every row of a repeated query id has ten results of its own."""
    rows = [(i, [i, 1]) for i in range(30)] + [(100, [1, 0]), (100, [0, 1])]
    vectors = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = topk.top_k(vectors, vectors.where("vec_id = 100"), 3).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [
        (1, 0, 1), (1, 29, 29), (2, 1, 1), (2, 28, 28), (3, 2, 1), (3, 27, 27)]


def test_columns_without_an_order(spark):
    rows = [(1, "a b c d", {"k": 2}), (1, "a b c d", {"k": 1}), (2, "a b c d", {}), (3, "other words are here", None)]
    texts = spark.createDataFrame(rows, "doc_id long, text string, more map<string,int>")
    assert sorted((r["doc_id"], r["more"]) for r in simhash.one_of_each(texts).collect()) == [(1, {"k": 1}), (3, None)]


def test_short_items_are_found(spark):
    """Items of one to four words are matched whole."""
    bench = spark.createDataFrame([(n, " ".join(f"q{n}w{i}" for i in range(n))) for n in range(1, 7)] + [(9, " ")],
                                  "item_id long, text string")
    rows = [(n, "before it " + " ".join(f"q{n}w{i}" for i in range(n)) + " and after") for n in range(1, 7)]
    rows += [(10, "q4w0 q4w1 q4w2 apart q4w3"), (11, "q2w1 q2w0"), (12, "nothing here"), (13, None)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontam.contaminated(texts, bench).collect()
    assert sorted((r["doc_id"], r["item_id"], r["covered"]) for r in got) == [(n, n, n) for n in range(1, 7)]
    assert {r["doc_id"] for r in decontam.decontaminate(texts, bench).collect()} == {10, 11, 12, 13}


def test_a_shared_template_makes_no_pairs(spark):
    """All items and a third of the documents share an opening: they meet by what is their own."""
    opening = "answer the following question with one short sentence please"
    items = [(i, f"{opening} " + " ".join(f"i{i}w{j}" for j in range(16))) for i in range(120)]
    rows = [(i, f"{opening} " + " ".join(f"d{i}w{j}" for j in range(40))) for i in range(100)]
    rows += [(200 + i, "text " + items[i][1] + " text") for i in range(10)]
    rows += [(300 + i, " ".join(f"i{i}w{j}" for j in range(16))) for i in range(10)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(texts, bench).collect()}
    assert got == {(200 + i, i) for i in range(10)} | {(300 + i, i) for i in range(10)}
    assert decontam.overlaps(texts, bench, coverage=0.5).count() == 20  # pairs that are joined at all
    # with a wish that the opening alone fulfils every pair of opening holders is a result
    assert decontam.contaminated(texts, bench, coverage=0.3).count() == 110 * 120 + 10


def test_probes_miss_nothing():
    """Whoever covers enough of an item with k-grams shares one of its probes."""
    rng = random.Random(8)
    for _ in range(300):
        n, k = rng.randint(5, 30), rng.randint(1, 5)
        grams = [(rng.choice([1, 2, 50]), p) for p in range(n - k + 1)]
        coverage = rng.choice([0.0, 0.3, 0.5, 0.9, 1.0])
        chosen = decontam.probes(n, k, grams, coverage)
        shared = {p for _, p in grams if rng.random() < rng.choice([0.1, 0.5, 0.9])}
        covered = {w for p in shared for w in range(p, p + k)}
        if shared and len(covered) >= coverage * n:
            assert shared & chosen


def test_toxicity_labels_far_beyond_the_documents(spark):
    """Labels without a text do not push usable ones out of the sample."""
    rows = [(i, f"row {i} " + ("vile foul words" if i % 2 else "kind mild phrases") + f" number {i * 7}") for i in range(300)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    few = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    many = few.unionByName(spark.range(1000, 400_000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS toxic"))
    a, b = (toxicity.train(texts, labels) for labels in (few, many))
    assert len(a.buckets) > 20 and np.array_equal(a.buckets, b.buckets) and np.array_equal(a.weights, b.weights)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150), (7, 7), (100, 200)]
    got = dict(graph.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(61)) and got[200] == got[150] == got[100] == 100
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_stages(spark, docs, empty, labels, benchmark, tmp_path):
    sf = str(tmp_path)
    labels.write.parquet(f"{sf}/labels.parquet")
    benchmark.write.parquet(f"{sf}/benchmark.parquet")
    for start in (docs, empty):
        now = start
        for i, (_name, step) in enumerate(corpus_pipeline.STAGES):
            now = step(spark, now, sf)
            if i < len(corpus_pipeline.STAGES) - 1:
                assert now.columns == docs.columns
        n = now.count()
        assert n == 0 if start is empty else 0 < n < len(ROWS)


def test_kept_text_digest_of_nothing(spark):
    rows = [(i, LINE) for i in range(4)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    got = out.select("row.doc_id", F.sha2("kept", 256).alias("d")).collect()
    assert {r["d"] for r in got if r["doc_id"] < 3} == {hashlib.sha256(b"").hexdigest()}


def test_periodic_text_is_cut():
    cut = chunk_dedup.boundaries(np.frombuffer(b"la " * 5000, np.uint8))
    assert np.diff(cut, prepend=0).max() <= chunk_dedup.LONGEST and cut[-1] == 15000
