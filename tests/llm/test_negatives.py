"""Hard negatives against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from petridish.llm import negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int, rid string, rank int, q string"


def brute(rows):
    """Rows as (vec_id, embedding, label); row places stand for rows that repeat."""
    kept = []
    for i, (vec_id, vector, label) in enumerate(rows):
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        kept.append((vec_id, label, [math.floor(256 * float(np.float32(x))) for x in vector], i))
    order = lambda s, r: (-s, r[0] is None, r[0] or 0)
    out = []
    for a in kept:
        if a[0] is None or a[0] % 50:
            continue
        scored = [(sum(x * y for x, y in zip(a[2], r[2])), r) for r in kept if r[3] != a[3]]
        scored.sort(key=lambda x: order(*x))
        for p, positive in [x for x in scored if x[1][1] == a[1]][:5]:
            fit = [x for x in scored if x[1][1] != a[1] and 50 * p <= 100 * x[0] <= 95 * p][:3]
            out += [(a[0], positive[0], k + 1, r[0], p, s) for k, (s, r) in enumerate(fit)]
    return out


def mined(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = negatives.mine(frame, F.col("vec_id") % 50 == 0, label)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return [tuple(r) for r in got.collect()]


@pytest.mark.parametrize("shape", [(1, 1, 1), (33, 64, 70), (65, 33, 129), (100, 7, 100), (40, 200, 37)])
def test_strassen(shape):
    random = np.random.default_rng(0)
    n, k, m = shape
    a, b = random.integers(-(2**28), 2**28, (n, k)), random.integers(-(2**28), 2**28, (k, m))
    np.testing.assert_array_equal(negatives.strassen(a, b), a @ b)


def test_strassen_wraps_to_the_true_value():
    """Sums inside pass 64 bits, the products don't."""
    a = np.full((64, 64), 2**61) * np.eye(64, dtype=np.int64)
    b = np.eye(64, dtype=np.int64) * 3
    np.testing.assert_array_equal(negatives.strassen(a, b), a * 3)


@pytest.mark.parametrize("tile", [(2048, 1024), (3, 40)])
def test_mine_as_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(negatives, "ANCHORS", tile[0])
    monkeypatch.setattr(negatives, "CANDIDATES", tile[1])
    monkeypatch.setattr(negatives, "LEAF", 4)
    random = np.random.default_rng(3)
    vectors = random.normal(size=(330, 12)).round(1) / 4
    rows = [(i, v.tolist(), int(random.integers(0, 4))) for i, v in enumerate(vectors)]
    rows += [
        (400, [1.0] * 12, None), (450, None, 1), (500, [0.1, None], 1), (550, [float("nan")], 2), (600, [float("inf")] * 3, 2),
        (650, [], 3), (700, [0.25] * 5, 3), (750, [0.25] * 20, 2), (None, [0.5] * 12, 1), (-50, [0.3] * 12, 2), (-7, [0.2] * 12, 9),
    ]
    rows += [(1000 + i, [0.5, 0.25] * 6, i % 3) for i in range(40)]  # ties
    want = brute(rows)
    assert len(want) > 60
    order = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(mined(spark, rows), key=order) == sorted(want, key=order)


def test_repeated_rows_and_nothing(spark):
    rows = [(50, [1.0, 0.0], 1), (50, [1.0, 0.0], 1), (1, [0.7, 0.7], 2), (1, [0.7, 0.7], 2), (3, [0.9, 0.0], 1)]
    assert sorted(mined(spark, rows)) == sorted(brute(rows))
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 1)]) == []
    assert mined(spark, [(50, [1e30, 0.0], 1), (2, [1.0, 0.0], 1)]) == []


def test_ids_above_2_to_53(spark):
    base = 50 * (2**55)
    rows = [(base + i, [1.0 - i / 100, i / 50], i % 2) for i in range(30)]
    assert sorted(mined(spark, rows)) == sorted(brute(rows))
