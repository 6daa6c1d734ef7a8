"""Collision counters against a sequential first-fit statement, and dense
ordered ids / ranks without a one-partition window."""

import os
import random

from pyspark.sql import functions as F

from copyledger.operators.collisions import resolve_counters
from copyledger.operators.ids import assign_ids
from copyledger.operators.ranking import rank_within


def sequential(cands, taken):
    used = set(taken)
    out = {}
    for cid, d, base in sorted(cands, key=lambda c: c[0]):
        stem, ext = os.path.splitext(base)
        k, name = 0, base
        while (d, name) in used:
            k += 1
            name = f"{stem}_{k}{ext}"
        used.add((d, name))
        out[cid] = name
    return out


def _check(spark, cands, taken, **options):
    cdf = spark.createDataFrame([(i, d, b, 0, i) for i, d, b in cands],
                                "id long, dir string, base string, ord0 int, ord1 long")
    tdf = spark.createDataFrame(taken or [("/none", "none")], "dir string, name string")
    want = sequential(cands, taken)
    assert {r.id: r.name for r in resolve_counters(cdf, tdf, **options).collect()} == want


def test_counters_simple_and_taken_gaps(spark):
    cands = [(i, "/d", "x.mp4") for i in range(1, 8)] + [(20, "/d", "y.mkv"), (21, "/e", "x.mp4")]
    taken = [("/d", "x.mp4"), ("/d", "x_2.mp4"), ("/d", "x_5.mp4"), ("/e", "z.mp4")]
    _check(spark, cands, taken)


def test_counters_natural_generated_names(spark):
    cands = [(1, "/d", "x.mp4"), (2, "/d", "x_1.mp4"), (3, "/d", "x.mp4"), (4, "/d", "x.mp4"),
             (5, "/d", "x_1.mp4"), (6, "/d", "a_1_2.ts"), (7, "/d", "a_1.ts"), (8, "/d", "a_1.ts")]
    taken = [("/d", "x_3.mp4"), ("/d", "a_1_1.ts")]
    _check(spark, cands, taken)


def test_counters_random(spark):
    rng = random.Random(11)
    bases = ["x.mp4", "x_1.mp4", "x_2.mp4", "y.ts", "x_1_1.mp4", ".mp4", "z."]
    cands = [(i, "/d" if rng.random() < 0.8 else "/e", rng.choice(bases)) for i in range(1, 120)]
    taken = [("/d", rng.choice(bases).replace(".", f"_{rng.randint(1, 6)}.", 1)) for _ in range(8)]
    taken += [("/d", "y.ts"), ("/e", "x.mp4")]
    _check(spark, cands, sorted(set(taken)))


def test_counters_of_nested_names(spark):
    rng = random.Random(23)
    names = ["x", "x_1", "x_2", "x_3", "x_5", "x_1_1", "x_1_2", "x_2_1", "x_1_1_1", "x_0", "x_01"]
    cands, taken = [], set()
    for d in range(40):
        some = rng.sample(names, rng.randint(2, 7))
        cands += [(d * 100 + i, f"/d{d}", rng.choice(some) + ".mp4") for i in range(rng.randint(1, 40))]
        taken |= {(f"/d{d}", f"{rng.choice(names)}_{rng.randint(1, 4)}.mp4") for _ in range(rng.randint(0, 6))}
        taken |= {(f"/d{d}", rng.choice(names) + ".mp4") for _ in range(rng.randint(0, 2))}
    rng.shuffle(cands)
    _check(spark, cands, sorted(taken))


def test_family_over_many_blocks(spark):
    """One base's shared names over many blocks, with gaps, taken names, late children and a second level."""
    rng = random.Random(31)
    for many in (1, 300):
        cands = [(rng.randint(1, 10 ** 9), "/d", "c.mp4") for _ in range(many)]
        cands += [(rng.randint(1, 10 ** 9), "/d", f"c_{k}.mp4") for k in rng.sample(range(1, 400), 250)]
        cands += [(rng.randint(1, 10 ** 9), "/d", f"c_7_{k}.mp4") for k in rng.sample(range(1, 90), 40)]
        cands += [(rng.randint(1, 10 ** 9), "/d", "c_7.mp4") for _ in range(30)]
        taken = {("/d", f"c_{k}.mp4") for k in rng.sample(range(1, 400), 40)} | {("/d", "c_7_3.mp4")}
        _check(spark, cands, sorted(taken), block=16)


def test_family_of_100000_names(spark):
    """``clip.mp4`` many times beside ``clip_1.mp4 ... clip_N.mp4`` in one folder: no task holds the family."""
    n = 100_000
    late = [(3 * n + i, "/d", "clip.mp4") for i in range(50)]
    early = [(i, "/d", "clip.mp4") for i in range(1, 2_000, 20)]
    rest = [(n + (k * 7919 % n), "/d", f"clip_{k}.mp4") for k in range(1, n) if k % 1_000]
    _check(spark, late + early + rest, [("/d", f"clip_{k}.mp4") for k in range(500, n, 1_700)], block=4_096)


def test_no_task_takes_a_family():
    import inspect

    from copyledger.operators import collisions
    assert "applyInPandas" not in inspect.getsource(collisions)


def test_assign_ids_dense_and_ordered(spark):
    df = spark.range(5000).select(F.concat(F.lit("/p/"), F.lpad((F.col("id") * 7919 % 5000).cast("string"),
                                                                   6, "0")).alias("original_path"))
    out = assign_ids(df, ["original_path"], base_id=100).collect()
    got = sorted((r.original_path, r.id) for r in out)
    assert [i for _, i in got] == list(range(101, 5101))


def test_rank_within_hot_key(spark):
    df = spark.range(6000).select(F.when(F.col("id") % 4 == 0, F.lit("b")).otherwise(F.lit("hot")).alias("k"),
                                  (F.col("id") * 37 % 6000).alias("o"))
    rows = rank_within(df, ["k"], ["o"], "r").collect()
    for key in ("hot", "b"):
        sub = sorted((r.o, r.r) for r in rows if r.k == key)
        assert [r for _, r in sub] == list(range(len(sub)))


def test_counter_too_long_for_a_number(spark):
    _check(spark, [(1, "/d", "x.mp4"), (2, "/d", "x.mp4")],
           [("/d", "x.mp4"), ("/d", "x_20250101123045999999999999.mp4"), ("/d", "x_1.mp4")])
