"""Recall of the quantised search on vectors that do not spread in all their components."""

import numpy as np
import pytest

from petridish.llm import quantised


def pairs(random, number, dims):
    """Vectors and for each one at cosine 0.951 in a random direction."""
    x = random.normal(size=(number, dims))
    x /= np.linalg.norm(x, axis=1)[:, None]
    turn = random.normal(size=x.shape)
    turn -= (turn * x).sum(axis=1)[:, None] * x
    turn /= np.linalg.norm(turn, axis=1)[:, None]
    return x, 0.951 * x + np.sqrt(1 - 0.951**2) * turn


def made(kind, number=3000):
    random = np.random.default_rng(8)
    if kind == "low rank":
        turned = np.linalg.qr(random.normal(size=(64, 6)))[0].T
        return [list(v @ turned) for part in pairs(random, number, 6) for v in part]
    if kind == "padded":
        return [list(v) + [0.0] * 56 for part in pairs(random, number, 8) for v in part]
    if kind == "two subspaces":
        parts = [pairs(random, number // 2, 6) for _ in range(2)]
        turned = [np.linalg.qr(random.normal(size=(64, 6)))[0].T for _ in range(2)]
        return [list(v @ t) for i in (0, 1) for part, t in zip(parts, turned) for v in part[i]]
    mixed = [list(v) for part in pairs(random, number, 8) for v in part]
    return [*mixed, list(random.normal(size=1024))]


@pytest.mark.parametrize("kind", ["low rank", "padded", "two subspaces", "mixed lengths"])
def test_recall_on_uneven_spreads(spark, monkeypatch, kind):
    monkeypatch.setattr(quantised, "LIST", 16)  # many lists
    own = made(kind)
    frame = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(own)], "vec_id bigint, embedding array<double>")
    want = 0
    for length in {len(v) for v in own}:
        x = np.array([v for v in own if len(v) == length])
        x /= np.linalg.norm(x, axis=1)[:, None]
        want += int((x @ x.T >= 0.95).sum()) - len(x)
    found = sum(r["n_links"] for r in quantised.near_duplicates(frame).collect())
    assert 0.97 * want <= found <= want
