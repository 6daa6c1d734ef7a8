"""Repeats inside one text, among repeated and null ids, and the text that is left."""

import collections
import random
import re

import duckdb
import numpy as np

from copyledger.llm import chunk_dedup

MIDDLE = "/root/testdata/sf0.01"
KIND = "doc_id long, text string, n_chars long, row string"


def words(seed, n=120, pool="abcdefghijklmnopqrstuvwxyz"):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(pool) for _ in range(rng.randint(3, 9))) for _ in range(n))


def left_of(spark, rows):
    docs = spark.createDataFrame([(d, t, None if t is None else len(t), str(i)) for i, (d, t) in enumerate(rows)],
                                 KIND).coalesce(1)
    out = chunk_dedup.without_repeated_spans(docs)
    assert out.columns == docs.columns
    got = sorted(out.collect(), key=lambda r: int(r["row"]))
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)
    return [r["text"] for r in got], chunk_dedup.repeated_spans(docs).collect()


def test_what_is_left(spark):
    """Passages repeated in one text, between rows of one id, without an id, and whole copies."""
    a, b, c, e = words(1), words(2), words(3, pool="äöü日本éabc"), words(4)
    rows = [(1, f"{words(11)} {a} {words(12)} {a} {words(13)}"), (2, f"{words(14)} {b}"), (2, f"{b} {words(15)}"),
            (None, f"{words(16)} {c}"), (None, f"{c} {words(17)}"), (4, e), (4, e), (5, None), (6, ""),
            (7, f"{words(18)} {a}"), (8, words(19))]
    left, found = left_of(spark, rows)
    assert {r["doc_id"] for r in found} == {1, 2, None, 4, 7} and len(found) == 8
    assert left[7] is None and left[8] == "" and left[10] == rows[10][1]
    assert [left[i] for i in (1, 3, 5)] == [rows[i][1] for i in (1, 3, 5)] and len(left[6]) < 70
    for text, copies in ((a, (0, 9)), (b, (1, 2)), (c, (3, 4))):
        assert sum(left[i].count(text) for i in copies) == 1
        assert sum(left[i].count(text[80:-80]) for i in copies) == 1
    assert all(words(n) in " ".join(filter(None, left)) for n in range(11, 20))


def test_every_passage_stays_whole_at_its_first_place(spark):
    """Passages made of phrases that earlier texts hold one by one: phrases alone
    are no passage, and the first copy of a passage does not lose them."""
    rng = random.Random(5)
    phrases = [words(100 + i, 7) for i in range(60)]
    rows = [(i, " ".join(words(1000 + 40 * i + k, 9) + " " + rng.choice(phrases) for k in range(30))) for i in range(20)]
    passages = [" ".join(rng.sample(phrases, 3) + [words(200 + i, rng.randint(40, 90))] + rng.sample(phrases, 3))
                for i in range(25)]
    for i in range(20, 90):
        held = rng.sample(passages, 3)
        rows.append((i, " ".join(x for k, p in enumerate(held) for x in (words(5000 + 3 * i + k, 25), p)) + " " + words(9000 + i, 9)))
    left, found = left_of(spark, rows)
    for p in passages:
        first = next(i for i, (_, t) in enumerate(rows) if p in t)
        assert p in left[first]
        assert sum(t.count(p[130:-130]) for t in left) == 1
    assert left[:20] == [t for _, t in rows[:20]]
    cuts = [c for r in found for c in r["cuts"]]
    assert len(cuts) > 100 and all(c["words"] >= chunk_dedup.MIN_WORDS for c in cuts)
    for r in found:  # what is cut stands whole somewhere, but for a chunk at either end
        raw = rows[r["doc_id"]][1].encode()
        for c in r["cuts"]:
            inner = raw[c["start"] + 70:c["end"] - 70].decode()
            assert any(inner in t for t in left)
    kept = [t for i, (_, t) in enumerate(rows) if i not in {r["doc_id"] for r in found if r["cuts"]}]
    assert all(t in left for t in kept)


def test_chunks_are_whole_characters():
    text = words(5, 400, "äöü日本é😀")
    raw = text.encode()
    end = chunk_dedup.boundaries(np.frombuffer(raw, np.uint8))
    assert "".join(raw[a:b].decode() for a, b in zip([0, *end], end)) == text


def test_repeats_inside_documents_of_the_tables(spark):
    table = duckdb.connect().execute(
        f"SELECT doc_id, text FROM read_parquet('{MIDDLE}/documents.parquet')").fetchall()
    want = set()
    for d, t in table:
        w, seen = t.split(), {}
        if any(i - seen.setdefault(tuple(w[i:i + 51]), i) >= 51 for i in range(len(w) - 50)):
            want.add(d)
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    got = {r["doc_id"] for r in chunk_dedup.repeated_spans(docs).collect()}
    assert len(want) > 20 and want <= got
    assert all(c["words"] >= chunk_dedup.MIN_WORDS
               for r in chunk_dedup.repeated_spans(docs).collect() for c in r["cuts"])


def test_passages_of_the_tables_stay(spark):
    """Few 51-word runs that stand at two places apart are whole nowhere afterwards: those that
    straddle two copies side by side or an edit of a near copy; hardly any stands twice."""
    table = duckdb.connect().execute(
        f"SELECT doc_id, text FROM read_parquet('{MIDDLE}/documents.parquet') ORDER BY doc_id").fetchall()
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    left = {r["doc_id"]: r["text"] for r in chunk_dedup.without_repeated_spans(docs).collect()}
    cut = {r["doc_id"]: r["cuts"] for r in chunk_dedup.repeated_spans(docs).collect()}

    def runs(text):
        w = text.split()
        return (tuple(w[i:i + 51]) for i in range(len(w) - 50))
    places = collections.defaultdict(list)
    for d, t in table:
        for i, r in enumerate(runs(t)):
            if not places[r] or places[r][-1][0] != d or i - places[r][-1][1] >= 51:
                places[r].append((d, i))
    want = {r: at for r, at in places.items() if len(at) > 1}
    count = collections.Counter(r for t in left.values() for r in runs(t) if r in want)
    lost = [r for r in want if not count[r]]
    assert len(lost) < 0.2 * len(want) and sum(n > 1 for n in count.values()) < 0.002 * len(want)
    text = dict(table)
    for r in lost:  # a cut of 16 words or more touches its first place
        d, i = want[r][0]
        at = [m.span() for m in re.finditer(r"\S+", text[d])][i:i + 51]
        a, b = (len(text[d][:x].encode()) for x in (at[0][0], at[-1][1]))
        assert any(a <= c["end"] and c["start"] <= b for c in cut[d])


def test_runs_by_definition():
    """Runs against a plain walk over the hits."""
    rng = random.Random(12)
    for _ in range(200):
        n = rng.randint(1, 40)
        at = sorted(rng.sample(range(60), n))
        row, first = [rng.randint(0, 2) for _ in at], [p - rng.choice([0, 5, 5, 5]) + 50 for p in at]
        begun = {p: rng.randint(0, 9) for p in range(62)}
        want, k = [], 0
        while k < n:
            e = k
            while e + 1 < n and (at[e + 1] - at[e], first[e + 1] - first[e], row[e + 1] - row[e]) == (1, 1, 0):
                e += 1
            if sum(begun[p] for p in range(at[k], at[e] + 2)) >= 16:
                want.append((at[k], at[e] + 1, row[k], first[k]))
            k = e + 1
        place = np.array([(p << 6 | begun[p]) << 6 | begun[p + 1] for p in at])
        mixed = np.array(rng.sample(range(n), n))
        got = chunk_dedup.runs(place[mixed], np.array(row)[mixed], np.array(first)[mixed] << 12, 16)
        assert got == want
