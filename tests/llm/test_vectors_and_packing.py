"""Product quantisation and packing against plain versions, and the pipeline."""

import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from petridish.llm import packing, quantised, shared
from tests.llm import cases
from tests.llm.test_repeats import groups

SF = "/root/testdata/sf0.001"


def vectors():
    random = np.random.default_rng(3)
    x = random.normal(size=(400, 20)).astype(np.float32)
    near = x[:120] + random.normal(size=(120, 20)).astype(np.float32) * 0.2
    chain = np.cumsum(random.normal(size=(60, 20)) * 0.25, axis=0) + x[0] * 3
    out = [v.tolist() for v in np.concatenate([x, near, chain.astype(np.float32), x[:30], x[:10] * 2])]
    out += [None, [], [0.0] * 20, [None] * 20, [float("nan")] + [1.0] * 19, [float("inf")] + [1.0] * 19]
    out += [x[5].tolist()[:7], x[5].tolist()[:7], [1.0], [2.0], [-1.0]]
    return out


@pytest.mark.parametrize("block", [1024, 16])
def test_near_vectors_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(quantised, "BLOCK", block)
    monkeypatch.setattr(quantised, "LIST", 32)
    monkeypatch.setattr(quantised, "MARGIN", 20.0)  # every list that can hold a link
    rows = [(i, v, 0) for i, v in enumerate(vectors())]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")

    def usable(v):
        return v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    good = [(i, np.array(v, np.float64)) for i, v, _ in rows if usable(v)]
    links = [
        (i, j)
        for i, a in good
        for j, b in good
        if i != j and a.size == b.size and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.95 - 1e-12
    ]
    number, of = Counter(i for i, _ in links), groups([i for i, _, _ in rows], links)
    got = {tuple(r) for r in quantised.near_duplicates(frame).collect()}
    assert got == {(i, number[i], of[i], of[i] == i) for i, _, _ in rows}
    assert quantised.near_duplicates(frame.limit(0)).collect() == []


def test_recall_of_the_margin_in_use(spark):
    """Pairs at the threshold itself, the hardest: nearly all are found."""
    random = np.random.default_rng(8)
    x = random.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    turn = random.normal(size=x.shape)
    turn -= (turn * x).sum(axis=1)[:, None] * x
    turn /= np.linalg.norm(turn, axis=1)[:, None]
    near = 0.951 * x + np.sqrt(1 - 0.951**2) * turn
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, near]))]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = quantised.near_duplicates(frame).filter("n_links > 0").count()
    assert found / len(rows) >= 0.98


def test_null_and_repeated_vector_ids(spark):
    frame = spark.createDataFrame(
        [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (None, [1.0, 0.01]), (None, None), (4, [0.0, 1.0])],
        "vec_id bigint, embedding array<double>",
    )
    got = sorted(map(tuple, quantised.near_duplicates(frame).collect()), key=str)
    assert got == sorted(
        [(1, 1, 1, True), (1, 1, 1, True), (None, 1, 1, False), (None, 0, None, True), (4, 1, 1, False)], key=str
    )


def check_packed(rows, totals):
    assert {d: sum(r["size"] for r in rows if r["doc_id"] == d) for d in totals} == totals
    bins = {}
    for r in rows:
        if r["seq_id"] is not None:
            bins.setdefault(r["seq_id"], []).append(r)
    for own in bins.values():
        own.sort(key=lambda r: r["seq_offset"])
        at = 0
        for r in own:
            assert r["seq_offset"] == at
            at += r["size"]
        length = own[0]["seq_length"]
        assert length in packing.LENGTHS and at <= length
        assert all(x < at for x in packing.LENGTHS if x < length)  # no smaller length holds it
    return bins


def test_packing(spark):
    random = np.random.default_rng(4)
    totals = {i: int(n) for i, n in enumerate(random.lognormal(6, 1.5, 3000))} | {9001: 0, 9002: 4096, 9003: 50_000}
    docs = spark.createDataFrame(list(totals.items()), "doc_id bigint, n bigint")
    rows = packing.best_fit(docs, F.col("n"), shard=500).collect()
    bins = check_packed(rows, totals)
    used = sum(totals.values()) / sum(own[0]["seq_length"] for own in bins.values())
    assert used > 0.97
    assert len(rows) == sum(max(1, -(-n // 4096)) for n in totals.values())


def test_packing_bears_all_cases(spark):
    docs = cases.documents(spark)
    rows = packing.best_fit(docs, packing.word_count()).collect()
    words = [(r["doc_id"], len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", r["text"] or "")])) for r in docs.collect()]
    want = Counter()
    for doc, n in words:
        want.update((doc, i, min(4096, n - 4096 * i)) for i in range(max(1, -(-n // 4096))))
    assert Counter((r["doc_id"], r["piece"], r["size"]) for r in rows) == want
    assert all((r["size"] == 0) == (r["seq_id"] is None) for r in rows)
    assert packing.best_fit(cases.nothing(spark), packing.word_count()).collect() == []


def test_pack_takes_the_tightest_room():
    bins, offsets, held = packing.pack(np.array([400, 300, 200, 100, 100]), (512,))
    assert bins.tolist() == [0, 1, 1, 0, 2]
    assert offsets.tolist() == [0, 0, 300, 400, 0]
    assert held.tolist() == [512] * 5


def test_pipeline_stages_on_the_given_tables(spark):
    docs = shared.read(spark, SF, "documents")
    ids = {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = shared.written(stage(spark, docs, SF))
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
            left = {r["doc_id"] for r in docs.collect()}
            assert left <= ids and len(left) > 0.6 * len(ids)
            ids = left
            if name == "quality_classifier":
                labels = {r["doc_id"]: r["quality"] for r in shared.read(spark, SF, "labels").collect()}
                assert sum(labels.get(i) == 0 for i in left) <= 2
    words = docs.groupBy("doc_id").agg(F.sum("size")).count()
    assert words == len(ids)


def test_pipeline_stages_bear_all_cases(spark):
    for docs in (cases.documents(spark), cases.nothing(spark)):
        for _, stage in corpus_pipeline.STAGES:
            out = shared.written(stage(spark, docs, SF))
            out.count()
            if out.columns == corpus_pipeline.COLUMNS:
                docs = out


def test_one_document_of_each_group_stays(spark):
    texts = ["one two three four five six", "one two three four five six", "seven eight nine ten", None, None]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = corpus_pipeline.drop_near_copies(spark, docs.union(docs), SF)
    assert sorted(r["doc_id"] for r in out.collect()) == [0, 2, 3]


def test_passages_are_taken_out_and_the_rest_stays(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    texts = [passage, passage, "before " + passage + "\nafter", "clean\ttext  here"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = corpus_pipeline.drop_repeated_passages(spark, docs, SF)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert got == {0: (passage, len(passage)), 2: ("before after", 12), 3: ("clean\ttext  here", 16)}


def test_llm_is_imported_by_nothing_else():
    import pathlib

    root = pathlib.Path(__file__).parents[2]
    for path in [*root.glob("petridish/**/*.py"), *root.glob("registry/*.py"), root / "bench.py"]:
        if "llm" not in path.parts:
            assert "petridish.llm" not in path.read_text(), path
    assert "petridish.llm" in sys.modules
