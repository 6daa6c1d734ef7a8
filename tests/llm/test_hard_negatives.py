"""Intervals that are certain, exact scores of any size, brute force, edge cases."""

import random

import numpy as np
import pytest

from copyledger.llm import exact, hard_negatives
from copyledger.llm.topk import quantised

KIND = "vec_id long, label int, v array<long>"


def side(rows):
    codes, align, ends = hard_negatives.encode(rows)
    n = len(rows)
    return {"ids": np.arange(n), "labels": np.zeros(n, int), "v": rows, "codes": codes, "align": align, "ends": ends}


@pytest.mark.parametrize("width, most", [(1, 9), (7, 300), (64, 300), (130, 1 << 20), (64, 1 << 52)])
def test_every_product_lies_in_its_interval(width, most):
    rng = np.random.default_rng(width)
    a = rng.integers(-most, most, (60, width))
    b = np.concatenate([rng.integers(-most, most, (200, width)), a, -a, np.zeros((1, width), np.int64)])
    low, high, unit = hard_negatives.intervals(side(a), side(b))
    low, high = low.astype(float) * unit[:, None], high.astype(float) * unit[:, None]
    want = np.clip(a.astype(object) @ b.T.astype(object), -exact.LARGEST, exact.LARGEST).astype(float)
    hair = 1e-6 * np.abs(want)  # where both ends are the end of a long
    assert ((low - hair <= want) & (want <= high + hair)).all()
    length = np.linalg.norm(a.astype(float), axis=1)[:, None] * np.linalg.norm(b.astype(float), axis=1)
    assert np.mean((high - low)[length > 0] / length[length > 0]) < 0.7


def test_coded_part_and_rest_make_the_vector():
    rows = np.random.default_rng(1).integers(-500, 500, (50, 64))
    ends = hard_negatives.encode(rows)[2]
    assert np.allclose(ends[:, 0], np.linalg.norm(rows, axis=1)) and (ends[:, 2] < 0.5 * ends[:, 0]).all()


def test_products_of_any_size():
    rng = random.Random(3)
    for most in (10, 10 ** 7, 1 << 31, 1 << 62):
        a, b = ([[rng.randint(-most, most) for _ in range(16)] for _ in range(40)] for _ in range(2))
        want = [max(-exact.LARGEST, min(exact.LARGEST, sum(x * y for x, y in zip(p, q)))) for p, q in zip(a, b)]
        assert exact.products(np.array(a), np.array(b), np.arange(40), np.arange(40)).tolist() == want


def brute(rows, anchors, k=5, n=5, share=(80, 100)):
    """[(anchor, positive, rank, negative, score, score)] with plain integers."""
    out = []
    width = max((len(v) for _, _, v in rows), default=0)

    def dot(p, q):
        s = sum(x * y for x, y in zip(p, q))
        return max(-exact.LARGEST, min(exact.LARGEST, s))
    assert width or not rows
    for a, label, v in anchors:
        near = sorted((-dot(v, w), i, m) for i, m, w in rows if i != a)
        for s, p, _ in [x for x in near if x[2] == label][:k]:
            window = [x for x in near if x[2] != label and share[0] * -s <= 100 * -x[0] <= share[1] * -s]
            out += [(a, p, r, i, -s, -t) for r, (t, i, _) in enumerate(window[:n], 1)]
    return sorted(out)


def mined(spark, rows, anchors, **options):
    out = hard_negatives.hard_negatives(spark.createDataFrame(rows, KIND), spark.createDataFrame(anchors, KIND), **options)
    return sorted(tuple(r)[:6] for r in out.collect())


@pytest.mark.parametrize("most", [40, 10 ** 7, 1 << 40])
def test_equals_brute_force(spark, monkeypatch, most):
    """Small shards and blocks; a third of the rows share one label, a third of those one vector."""
    monkeypatch.setattr(hard_negatives, "SHARD", 32)
    monkeypatch.setattr(hard_negatives, "BLOCK", 7)
    rng = random.Random(most)
    centres = [[rng.randint(-most, most) for _ in range(12)] for _ in range(6)]
    rows = []
    for i in range(400):
        c = centres[0 if i % 9 == 0 else rng.randrange(6)]
        v = c if i % 9 == 0 else [x + rng.randint(-most // 2, most // 2) for x in c]
        rows.append((i, 0 if i % 3 == 0 else rng.randint(1, 5), v))
    anchors = [r for r in rows if r[0] % 10 == 0]
    want = brute(rows, anchors)
    assert mined(spark, rows, anchors) == want and len(want) > 100
    assert mined(spark, rows, anchors[:5], positives=2, negatives=1, share=(50, 90)) == brute(rows, anchors[:5], 2, 1, (50, 90))


def test_edges(spark):
    rows = [(0, 1, [4, 0]), (1, 1, [4, 0]), (1, 1, [4, 0]), (2, 1, [4]), (3, 2, [4, 1]), (3, 2, [4, 1]), (4, 2, [3, 0]),
            (5, 2, [4, 0]), (6, 3, [0, 0]), (7, 9, [4, 0])]
    useless = [(None, 1, [4, 0]), (8, None, [4, 0]), (9, 2, None)]
    anchors = [rows[0], rows[8], useless[0], useless[1]]
    assert mined(spark, rows + useless, anchors) == brute(rows, anchors[:2])
    # a repeated anchor gives its results once for each of its rows
    assert mined(spark, rows, [rows[0], rows[0]]) == sorted(2 * brute(rows, [rows[0]]))
    assert mined(spark, [], anchors) == mined(spark, rows, []) == []


def test_unusable_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [nan], 1, "x"), (2, [inf], 1, "x"), (3, [None], 1, "x"), (4, None, 1, "x"), (5, [-0.001], 1, "x")]
    got = quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, v string"), 256, "label")
    assert [tuple(r) for r in got.collect()] == [(5, 1, [-1])]
