"""Packed products against plain ones, and mined negatives against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobloom.llm.kronecker import Packed, Packing, mine


@pytest.mark.parametrize("least, greatest, width", [(-160, 154, 64), (0, 1, 3), (-1, 0, 1), (-(1 << 20), 1 << 20, 40), (-(1 << 28), 1 << 28, 5), (0, 0, 4), (0, 0, 0)])
def test_products_are_exact(least, greatest, width):
    rng = np.random.default_rng(abs(least) + width)
    vectors = rng.integers(least, greatest + 1, (101, width))
    anchors = rng.integers(least, greatest + 1, (7, width))
    packing = Packing(least, greatest, width)
    assert packing.fields >= 1 and (packing.double or packing.bits > 53)
    packed = Packed(np.arange(101), np.zeros(101), vectors, packing)
    assert (packed.scores(anchors) == anchors @ vectors.T).all()


def test_extremes_stay_in_their_fields():
    packing = Packing(-160, 154, 64)
    assert packing.fields == 2
    vectors = np.array([[-160] * 64, [154] * 64, [154] * 64, [-160] * 64, [0] * 64])
    packed = Packed(np.arange(5), np.zeros(5), vectors, packing)
    assert (packed.scores(vectors) == vectors @ vectors.T).all()


def brute(rows, asks, positives=5, negatives=10, low=30, high=90):
    width = max((len(v) for _, v, _ in rows), default=0)
    whole = {i: (np.pad(np.floor(256 * np.array(v, float)).astype(np.int64), (0, width - len(v))), l) for i, v, l in rows}
    out = []
    for a, (x, label) in whole.items():
        if not asks(a):
            continue
        score = {i: int(x @ y) for i, (y, _) in whole.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if whole[i][1] == label][:positives]:
            fits = [i for i in order if whole[i][1] != label and low * score[p] <= 100 * score[i] <= high * score[p]]
            out += [(a, p, n + 1, i, score[p], score[i]) for n, i in enumerate(fits[:negatives])]
    return sorted(out)


def test_mine_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(0.3, 1, size=6).round(1).tolist(), int(rng.integers(0, 3)) if i % 3 else 0) for i in range(600)]
    rows += [(1000 + i, rows[10][1], i % 2) for i in range(150)]  # one very common vector
    rows += [(2000 + i, [0.5] * (1 + i % 6), 2) for i in range(20)] + [(3000, [1.0] * 6, 77)]
    frame = spark.createDataFrame([(*r, 1.0, 5) for r in rows], "vec_id long, embedding array<float>, label int, score double, rank int").repartition(3)
    exact = [(r.vec_id, r.embedding, r.label) for r in frame.collect()]
    want = brute(exact, lambda i: i % 10 == 0)
    assert sorted(tuple(r) for r in mine(frame, F.col("vec_id") % 10 == 0, chunk_rows=90).collect()) == want
    assert sorted(tuple(r) for r in mine(frame, F.col("vec_id") % 10 == 0).collect()) == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (10, None, 1), (20, [nan, 1.0], 1), (30, [inf, 1.0], 1), (40, [None, 1.0], 1), (None, [1.0, 1.0], 1), (50, [1.0, 0.0], None)]
    rows += [(1, [1.0], 1), (1, [1.0], 1), (2, [0.5, 9.0], 0), (3, [0.9], 5), (4, [0.95], 5), (5, [], 5), (7, [-1.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(tuple(r) for r in mine(frame, F.col("vec_id") % 10 == 0).collect())
    assert got == [(0, 1, 1, 3, 65536, 230 * 256), (0, 1, 2, 2, 65536, 128 * 256)]
    sound = [r for r in rows if r[0] is not None and r[2] is not None and r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    assert got == brute(sound, lambda i: i % 10 == 0)
    assert mine(frame.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert mine(frame, F.lit(False)).count() == 0
