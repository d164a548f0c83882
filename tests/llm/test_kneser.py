"""The Kneser-Ney scores against a plain version with dictionaries."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from petridish.llm import kneser
from tests.llm import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def split(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*WORD.findall(lower), None]


class Plain:
    def __init__(self, texts):
        self.pairs = Counter((u, w) for t in texts for u, w in zip(["<", *split(t)], split(t)))
        self.tokens = Counter(w for t in texts for w in split(t))
        self.after, self.before, self.kinds = Counter(), Counter(), defaultdict(Counter)
        for (u, w), n in self.pairs.items():
            self.after[u] += n
            self.before[w] += 1
            self.kinds[u][min(n, 3)] += 1
        numbers = lambda counter: [sum(v == k for v in counter.values()) for k in (1, 2, 3, 4)]
        self.off, self.off_before = kneser.discounts(numbers(self.pairs)), kneser.discounts(numbers(self.before))

    def single(self, w):
        share = 1 / (len(self.tokens) + 1)
        if not self.pairs:
            return share
        left = sum(self.off_before[min(n, 3)] for n in self.before.values())
        n = self.before[w]
        return (n - self.off_before[min(n, 3)] + left * share) / len(self.pairs)

    def chance(self, u, w):
        if not self.after[u]:
            return self.single(w)
        n = self.pairs[u, w]
        left = sum(self.off[k] * m for k, m in self.kinds[u].items())
        return (n - self.off[min(n, 3)] + left * self.single(w)) / self.after[u]

    def row(self, text):
        words = split(text)
        n, v = sum(self.tokens.values()), len(self.tokens)
        base = sum(math.log10((self.tokens[w] + 1) / (n + v + 1)) for w in words)
        own = sum(math.log10(self.chance(u, w)) for u, w in zip(["<", *words], words))
        return len(words), sum(w in self.tokens for w in words), n, base, own


def compare(rows, got):
    model = Plain([t for _, t, held in rows if not held])
    want = sorted((str(i), held, *model.row(t)) for i, t, held in rows)
    have = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got)
    assert [x[:5] for x in have] == [x[:5] for x in want]
    np.testing.assert_allclose([x[5:] for x in have], [x[5:] for x in want], rtol=1e-10)


@pytest.mark.parametrize("limits", [(1 << 20, 16 << 20, 4_000_000), (2000, 9000, 900)])
def test_score_as_plain(spark, monkeypatch, limits):
    monkeypatch.setattr(kneser, "PIECE", limits[0])
    monkeypatch.setattr(kneser, "BLOCK", limits[1])
    monkeypatch.setattr(kneser.cells, "PER_SHARD", limits[2])
    rows = [(r[0], r[1], (r[0] or 0) % 4 == 1) for r in cases.rows()]
    docs = cases.documents(spark)
    got = kneser.score(docs, F.col("doc_id") % 4 == 1).collect()
    compare(rows, got)
    assert all(math.isclose(r["perplexity"], 10 ** (-r["score"] / r["n_tokens"])) for r in got)


def test_chances_add_up_to_one(spark):
    model = Plain([t for t in cases.texts() if t and len(t) < 2000])
    for u in ["<", "no", "never seen"]:
        total = sum(model.chance(u, w) for w in [*model.tokens, "another word"])
        assert math.isclose(total, 1, rel_tol=1e-9)


def test_discounts():
    np.testing.assert_allclose(kneser.discounts([10, 4, 2, 1]), [0, 1 - 2 * (10 / 18) * 0.4, 2 - 3 * (10 / 18) * 0.5, 3 - 4 * (10 / 18) * 0.5])
    assert kneser.discounts([1, 0, 2, 1]).tolist() == [0, *kneser.USUAL]


def test_score_nothing_and_no_training(spark):
    assert kneser.score(cases.nothing(spark), F.lit(True)).count() == 0
    rows = [("a", "x y", True), ("b", None, True), ("b", "", True)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, held_out boolean")
    compare(rows, kneser.score(docs, F.col("held_out")).collect())


def test_better_than_single_words(spark):
    """Held-out texts whose word order the training texts have are likelier than by single words."""
    words = [f"w{i}" for i in range(50)]
    rows = [(i, " ".join(words[(i + j) % 50] for j in range(40))) for i in range(60)]
    got = kneser.score(spark.createDataFrame(rows, "doc_id bigint, text string"), F.col("doc_id") % 3 == 0).collect()
    assert all(r["score"] > r["base_score"] / 5 for r in got if r["held_out"])


def test_mapped_table():
    have = np.arange(10, 1000, 7).astype(np.uint64)
    table = kneser._mapped(have, np.arange(have.size))
    assert isinstance(table[0], np.memmap)
    assert kneser.look_up(table, np.array([3, 10, 11, 24, 5000], np.uint64)).tolist() == [0, 0, 0, 2, 0]
