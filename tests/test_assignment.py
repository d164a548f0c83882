"""Best assignment against brute force, and a permuted folder found by its tiles."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from petridish.operators import assignment, pairing

SCHEMA = "dataset string, row_image int, col_image int, score double"


def best_total(score):
    """Largest total over all ways to pair rows with columns, single ones allowed."""
    n, m = score.shape
    if n > m:
        return best_total(score.T)
    return max(sum(max(score[i, j], 0) for i, j in enumerate(p)) for p in itertools.permutations(range(m), n))


def random_scores(seed):
    rng = np.random.default_rng(seed)
    out = {}
    for d in range(6):
        score = np.round(rng.uniform(0, 100, (rng.integers(2, 6), rng.integers(2, 6))) * (rng.random((1, 1)) < 2), 2)
        score[rng.random(score.shape) < 0.3] = 0
        if d == 0:
            score[:] = 7.0  # ties
        out[f"d{d}"] = score
    return out


@pytest.mark.parametrize("matrix", [1 << 22, 0])
def test_total_is_the_best(spark, monkeypatch, matrix):
    monkeypatch.setattr(assignment, "MATRIX", matrix)
    scores = random_scores(3)
    if not matrix:  # the auction takes many rounds
        monkeypatch.setattr(assignment, "STEP", 0.5)
        scores = {"d": np.array([[9.0, 8.0], [8.0, 2.0]])}  # the greedy pairs are not the best
    rows = [(d, i, j, float(s[i, j])) for d, s in scores.items() for i in range(s.shape[0]) for j in range(s.shape[1])]
    got = assignment.best_assignment(spark.createDataFrame(rows, SCHEMA), ["dataset"]).collect()
    assert len({(r.dataset, r.row_image) for r in got}) == len({(r.dataset, r.col_image) for r in got}) == len(got)
    for d, s in scores.items():
        total = sum(r.score for r in got if r.dataset == d)
        assert abs(total - best_total(s)) <= (1e-9 if matrix else 2 * assignment.STEP * sum(s.shape)), d


def test_hungarian_on_larger_matrices():
    rng = np.random.default_rng(0)
    for n, m in ((6, 6), (5, 7), (1, 4)):
        score = rng.integers(0, 9, (n, m)).astype(float)
        own = assignment._hungarian(score)
        assert len(set(own)) == n and score[np.arange(n), own].sum() == best_total(score)


def test_permuted_folder_is_found(spark):
    """Nuclei under wrong names are paired with their cells; an image without nuclei keeps its own."""
    rng = np.random.default_rng(9)
    n = 14
    source = rng.permutation(n).tolist()
    cells = {i: rng.integers(4, 60, (7, 2)) for i in range(n)}
    cyto = [("a", i, "cyto", k + 1, int(x + dx), int(y + dy)) for i, own in cells.items() for k, (x, y) in enumerate(own) for dx in range(-3, 4) for dy in range(-3, 4)]
    nuc = [("a", source[i], "nuc", k + 1, int(x + dx), int(y + dy)) for i, own in cells.items() if i for k, (x, y) in enumerate(own) for dx in (0, 1) for dy in (0, 1)]
    pixels = spark.createDataFrame(cyto + nuc, "dataset string, image_id int, region string, label int, x int, y int")
    candidates = pairing.nucleus_candidates(pixels, 8.0)
    assert candidates.count() < n * n
    scores = pairing.score_nucleus_pairs(candidates, pixels)
    got = {r.row_image: r for r in pairing.remap_batch(scores).collect()}
    assert all(r.accepted for r in got.values()) and got[1].assigned > got[1].identity
    assert {i: got[i].source for i in range(1, n)} == {i: source[i] for i in range(1, n)}
    plain = {(r.row_image, r.col_image): r.score for r in scores.collect()}
    assert abs(got[1].assigned - sum(plain[i, source[i]] for i in range(1, n))) < 1e-3 + plain.get((0, got[0].source), 0.0)


def test_copies_do_not_pair_all_with_all(spark):
    """Equal images meet a bounded number of candidates."""
    rows = [("a", i, float(x), 5.0) for i in range(300) for x in (3, 20, 40)]
    left = spark.createDataFrame(rows, "dataset string, row_image int, x double, y double")
    found = assignment.tile_candidates(left, left.withColumnRenamed("row_image", "col_image"), ["dataset"], 8.0, bands=4, bucket=10)
    assert 300 <= found.count() <= 300 * 10 * 4 * 2.5
    assert found.filter("row_image = col_image").count() == 300
    none = left.filter("x > 100")
    assert assignment.tile_candidates(none, none.withColumnRenamed("row_image", "col_image"), ["dataset"], 8.0).count() == 0
    assert assignment.best_assignment(spark.createDataFrame([], SCHEMA), ["dataset"]).count() == 0
    zero = spark.createDataFrame([("a", 1, 1, 0.0)], SCHEMA)
    assert assignment.best_assignment(zero, ["dataset"]).count() == 0
    assert zero.filter(F.col("score") > 0).count() == 0
