"""Fingerprints, language, licences, pieces and quality against plain versions."""

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from petridish.llm import fingerprints, language, licences, pieces, quality
from tests.llm import cases

SF = "/root/testdata/sf0.001"


def key(row):
    return (row["doc_id"] is not None, row["doc_id"] or 0)


def test_fingerprints_match_their_sql(spark):
    docs = spark.createDataFrame(
        [(2 * i, t) for i, t in enumerate(cases.texts())], "doc_id bigint, text string"
    )
    got = sorted(tuple(r) for r in fingerprints.edited_likeness(docs).collect())
    documents = pd.DataFrame([tuple(r) for r in docs.collect()], columns=["doc_id", "text"])  # noqa: F841
    want = sorted(duckdb.connect().execute(fingerprints.SQL).fetchall()) if duckdb else None
    texts = {2 * i: t or "" for i, t in enumerate(cases.texts())}
    ids = sorted(texts)
    for row in got:
        own, n = texts[row[0]], len(texts[row[0]])
        after = texts[ids[(ids.index(row[0]) + 1) % len(ids)]]
        edited = own[: n - n // 4] + after[: n // 4]
        assert row[1] == n and row[2] == hashlib.sha256(edited.encode()).hexdigest()
    assert got == want
    same = {}
    for row in got:
        assert same.setdefault(texts[row[0]], row[3]) == row[3]
        assert 0 <= row[5] <= 1 and 0 <= row[6] <= 1


def test_fingerprints_bear_all_cases(spark):
    docs = cases.documents(spark)
    out = fingerprints.edited_likeness(docs).collect()
    assert len(out) == docs.count()
    assert all(r["near_edited"] is not None and r["near_next"] is not None for r in out)
    assert fingerprints.edited_likeness(cases.nothing(spark)).collect() == []
    assert fingerprints.fingerprints(cases.nothing(spark)).collect() == []


def test_language_is_learnt_and_bears_all_cases(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = language.identify(docs, ["lang"]).withColumn("out", language.held_out())
    right = out.filter("out").agg(F.avg((F.col("lang_pred") == F.col("row.lang")).cast("double"))).first()[0]
    assert right >= 0.95
    docs = cases.documents(spark)
    found = language.identify(docs).collect()
    assert len(found) == docs.count()
    assert {r["lang_pred"] for r in found} <= {"a", "b", "c", "und"}
    assert all(0 <= r["score"] <= 1 for r in found)
    without = {i for i, t in enumerate(cases.texts()) if not t or not re.search(r"[^\W\d_]", t)}
    assert {r["doc_id"] for r in found if r["lang_pred"] == "und"} == without | {None}
    assert language.identify(cases.nothing(spark)).collect() == []


def test_language_never_reads_labels_of_held_out_rows(spark):
    docs = cases.documents(spark)
    other = docs.withColumn("lang", F.when(language.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    plain = lambda d: sorted(map(str, language.identify(d).collect()))
    assert plain(docs) == plain(other)


def test_word_scores_back_off():
    one, two = np.array([0.0, -1.0]), np.array([-2.0, 0.0])
    tables = [language.Table(list(t), np.array(list(t.values()))) for t in ({"known": one}, {"k": two}, {"<x": one, "xk": two})]
    model = language.Model(["a", "b"], tables[0], tables[1:])
    assert (language.word_score(model, "known") == one).all()
    assert (language.word_score(model, "xk") == (one + two) / 2).all()
    assert (language.word_score(model, "k") == two).all()
    assert (language.word_score(model, "zz") == 0).all()


def test_licences_match_brute_force(spark):
    docs = cases.documents(spark, 1)
    mixed = [" ".join(np.random.default_rng(i).choice(["cc", "BY", "general", "public", "license", "all", "rights", "reserved", "x"], 40)) for i in range(60)]
    docs = docs.select("doc_id", "text").union(
        spark.createDataFrame([(1000 + i, t) for i, t in enumerate(mixed)], "doc_id bigint, text string")
    )
    got = licences.scan(docs).collect()
    plain = Counter()
    for row in docs.collect():
        text = re.sub("[A-Z]", lambda m: m[0].lower(), row["text"] or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        places, labels = [], set()
        for phrase, label in licences.BASE.items():
            own = phrase.split()
            at = [i for i in range(len(words)) if words[i : i + len(own)] == own]
            places += at
            labels |= {label} if at else set()
        plain[(row["doc_id"], len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))] += 1
    assert Counter((r[0], r[1], r[2], r[3], r[4], r[5]) for r in got) == plain
    for r in got:
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1
    assert licences.scan(cases.nothing(spark)).collect() == []


def test_licence_templates_need_their_key_phrases(spark):
    texts = [
        "Released under the MIT License.",
        "released under the mit licence",
        "Licensed under the Apache License, Version 2.0.",
        "the apache license, version 3.0",
        "This work is licensed under the GNU General Public License, version 3.",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licences.scan(docs).collect()}
    assert got == {0: ("mit", 1.0), 1: ("", 0.0), 2: ("apache-2.0", 1.0), 3: ("", 0.0), 4: ("gpl,gpl-3.0", 1.0)}


@pytest.fixture(scope="module")
def model():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


def test_pieces_are_the_library_s(spark, model):
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    docs = cases.documents(spark)
    encoded = pieces.encode(docs, model, decoded=True).collect()
    texts = [r["text"] or "" for r in docs.collect()]
    own = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["ids"])
    want = sorted((r["doc_id"] is not None, r["doc_id"] or 0, library.encode(t)) for r, t in zip(docs.collect(), texts))
    assert sorted(map(own, encoded)) == want
    assert all(r["decoded"] == library.decode(r["ids"]) for r in encoded)
    again = pieces.decode(pieces.encode(docs, model), model).collect()
    assert Counter(map(tuple, again)) == Counter((r["doc_id"], r["decoded"]) for r in encoded)
    assert pieces.digests(cases.nothing(spark), model).collect() == []


def test_pieces_of_random_texts(model):
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    with open(model, "rb") as file:
        vocabulary = pieces.read_model(file.read())
    codec = pieces.Codec(vocabulary)
    random = np.random.default_rng(3)
    parts = [p.replace("▁", " ") for p, _, kind in vocabulary if kind == pieces.NORMAL]
    parts += ["  ", "\n", "▁", "😀", "\0", "ab", "aaa", " the", "ing"] * 300
    for _ in range(3000):
        text = "".join(random.choice(parts, random.integers(0, 9)))
        ids = [i for part in codec.encode(text) for i in part]
        assert ids == library.encode(text), text
        assert codec.decode(ids) == library.decode(ids)


def test_pairs_are_judged_as_by_merging(model):
    with open(model, "rb") as file:
        codec = pieces.Codec(pieces.read_model(file.read()))
    random = np.random.default_rng(4)
    for a, b in random.choice(codec.known, (20000, 2)).tolist():
        assert codec.compatible(a, b) == (codec.merged(a + b) == [a, b]), (a, b)


def test_quality_is_learnt_and_bears_all_cases(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = quality.assess(docs, labels).filter(language.held_out("doc_id", 5, 0))
    right = found.join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")))
    assert right.first()[0] >= 0.9
    docs = cases.documents(spark)
    labels = spark.createDataFrame(
        [(i, i % 2, None) for i in range(40)] + [(None, 1, 0), (5, None, 1), (6, 7, 0), (7, 0, 0), (7, 1, 0)],
        "doc_id bigint, quality int, text string",
    )
    found = quality.assess(docs, labels).collect()
    assert len(found) == docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)
    assert {r["score"] for r in quality.assess(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.assess(cases.nothing(spark), labels).collect() == []


def test_quality_gradients_are_those_of_the_loss():
    random = np.random.default_rng(0)
    base = np.array([0, 3, 4, 9])
    x, y = random.normal(size=(9, quality.FEATURES)), np.array([1.0, 0.0, 1.0])
    model = quality.train(x, base, np.zeros(0))
    grads = quality._gradients(model, quality.forward(model, x, base), base, y)

    def loss():
        p = quality.forward(model, x, base)["score"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for k, spot in (("W", (5, 3)), ("b", (2,)), ("V", (4, 1)), ("U", (3, 2)), ("w", (6,)), ("c", (8,))):
        old = model[k][spot]
        model[k][spot] = old + 1e-5
        up = loss()
        model[k][spot] = old - 1e-5
        assert abs((up - loss()) / 2e-5 - grads[k][spot]) < 1e-6
        model[k][spot] = old


def test_passages_cover_whole_texts():
    text = " ".join(["word"] * 200)
    x, base = quality.passages(pa.array([None, "", text, "one"]))
    assert base.tolist() == [0, 1, 2, 6, 7]
    assert not x[:2].any() and x[2:].any(axis=1).all()
