"""Quality scores by attention-based multiple-instance learning.

A text is a bag of passages of PASSAGE words. Each passage is encoded from its characters and words
by a small layer; gated attention weighs the passages, and the weighted representation is scored.
Encoder, attention and score are learned together from document labels alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petridish.llm import shared
from petridish.llm.language import held_out
from petridish.llm.textblocks import (
    LOWER_ASCII,
    NOT_SPACE,
    blocks,
    prefix_sums,
    span_hash,
    text_buffer,
    word_spans,
)

#: Labelled documents that the model is fitted on (expected number, picked by a hash of the id).
SAMPLE = 6000
PASSAGE, HASHED, ENCODED, GATED = 64, 32, 32, 16
EPOCHS, GROUP, RATE, SHRINK = 30, 128, 0.01, 1e-4
#: From this score on a document counts as good.
GOOD = 0.3

#: Classes of bytes: lower, upper, digit, beyond ASCII, line end, other space, then each sign.
_CLASS = np.zeros(256, np.int64)
_CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3
_CLASS[[9, 11, 12, 13, 32]], _CLASS[10] = 5, 4
_SIGNS = [c for c in range(33, 127) if not chr(c).isalnum()]
_CLASS[_SIGNS] = 6 + np.arange(len(_SIGNS))
_CLASS[:9] = _CLASS[14:32] = _CLASS[127] = 6 + len(_SIGNS)
CLASSES = 7 + len(_SIGNS)
FEATURES = CLASSES + HASHED + 8


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of some texts, and where each text's passages start (one more).

    A text without words has one passage of zeros.
    """
    data, offsets = text_buffer(texts)
    starts, ends, first = word_spans(data, offsets, NOT_SPACE)
    words = np.diff(first)
    number = np.maximum(1, -(-words // PASSAGE))
    base = np.concatenate([[0], np.cumsum(number)])
    total = int(base[-1])
    out = np.zeros((total, FEATURES), np.float32)
    if starts.size == 0:
        return out, base
    text_of = np.repeat(np.arange(words.size), words)
    own = base[text_of] + (np.arange(starts.size) - first[text_of]) // PASSAGE
    heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    spots = own[heads]  # passages with words
    till = np.append(heads[1:], starts.size) - 1
    from_byte, to_byte = starts[heads], ends[till]

    def shares(kinds: np.ndarray, bins: int, at: np.ndarray) -> np.ndarray:
        return np.bincount(at * bins + kinds, minlength=heads.size * bins).reshape(-1, bins)

    # bytes from a passage's first word to its last; what lies between passages is white space
    inside = np.zeros(data.size + 1, np.int64)
    np.add.at(inside, from_byte, 1)
    place = np.cumsum(inside)[:-1] - 1
    used = place >= 0
    used[used] = np.flatnonzero(used) < to_byte[place[used]]
    counts = shares(_CLASS[data[used]], CLASSES, place[used])
    out[spots, :CLASSES] = counts / counts.sum(axis=1, keepdims=True)

    rank = np.repeat(np.arange(heads.size), till - heads + 1)
    size = (till - heads + 1).astype(np.float64)
    codes = span_hash(prefix_sums(LOWER_ASCII[data]), starts, ends)
    bag = shares((codes >> np.uint64(59)).astype(np.int64), HASHED, rank)
    out[spots, CLASSES : CLASSES + HASHED] = bag / size[:, None]

    length = (ends - starts).astype(np.float64)
    mean = np.add.reduceat(length, heads) / size
    spread = np.sqrt(np.maximum(0, np.add.reduceat(length**2, heads) / size - mean**2))
    order = np.lexsort((codes, rank))
    fresh = np.ones(codes.size, bool)
    fresh[1:] = (codes[order][1:] != codes[order][:-1]) | (rank[order][1:] != rank[order][:-1])
    again = np.zeros(codes.size)
    again[1:] = (codes[1:] == codes[:-1]) & (rank[1:] == rank[:-1])
    head, tail = _CLASS[data[starts]], _CLASS[data[ends - 1]]
    more = [
        mean / 10,
        spread / 10,
        np.add.reduceat(fresh.astype(np.float64), heads) / size,
        np.add.reduceat(again, heads) / size,
        np.add.reduceat((tail >= 6).astype(np.float64), heads) / size,
        np.add.reduceat((head == 1).astype(np.float64), heads) / size,
        np.log1p(size) / 4,
        np.minimum(length.max(), np.maximum.reduceat(length, heads)) / 50,
    ]
    out[spots, CLASSES + HASHED :] = np.stack(more, axis=1)
    return out, base


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def forward(model: dict, x: np.ndarray, base: np.ndarray) -> dict:
    """Scores of bags of passages; each bag has one passage at least."""
    x = (x - model["mean"]) / model["scale"]
    h = np.tanh(x @ model["W"] + model["b"])
    t, g = np.tanh(h @ model["V"]), _sigmoid(h @ model["U"])
    e = (t * g) @ model["w"]
    bag = np.repeat(np.arange(base.size - 1), np.diff(base))
    e = np.exp(e - np.maximum.reduceat(e, base[:-1])[bag])
    a = e / np.add.reduceat(e, base[:-1])[bag]
    z = np.add.reduceat(a[:, None] * h, base[:-1], axis=0)
    return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "bag": bag,
            "score": _sigmoid(z @ model["c"] + model["d"])}


def _gradients(model: dict, f: dict, base: np.ndarray, y: np.ndarray) -> dict:
    error = (f["score"] - y) / y.size
    from_bag = error[:, None] * model["c"]
    dz = from_bag[f["bag"]]
    da = (dz * f["h"]).sum(axis=1)
    de = f["a"] * (da - np.add.reduceat(f["a"] * da, base[:-1])[f["bag"]])
    dt = de[:, None] * model["w"] * f["g"] * (1 - f["t"] ** 2)
    dg = de[:, None] * model["w"] * f["t"] * f["g"] * (1 - f["g"])
    dh = f["a"][:, None] * dz + dt @ model["V"].T + dg @ model["U"].T
    dh *= 1 - f["h"] ** 2
    return {
        "W": f["x"].T @ dh, "b": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg,
        "w": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ error, "d": error.sum(),
    }


def train(x: np.ndarray, base: np.ndarray, y: np.ndarray, seed: int = 0) -> dict:
    """Model for bags of passages x (bag i: rows base[i] to base[i + 1]) and labels y, by Adam."""
    random = np.random.default_rng(seed)
    start = lambda *shape: random.normal(0, shape[0] ** -0.5, shape)
    model = {
        "W": start(FEATURES, ENCODED), "b": np.zeros(ENCODED), "V": start(ENCODED, GATED),
        "U": start(ENCODED, GATED), "w": start(GATED), "c": start(ENCODED), "d": np.zeros(()),
    }
    model["mean"] = x.mean(axis=0) if len(x) else np.zeros(FEATURES)
    model["scale"] = (x.std(axis=0) if len(x) else np.zeros(FEATURES)) + 0.01
    learned = ["W", "b", "V", "U", "w", "c", "d"]
    first = {k: np.zeros_like(model[k]) for k in learned}
    second = {k: np.zeros_like(model[k]) for k in learned}
    turn = 0
    for epoch in range(EPOCHS if y.size else 0):
        order = random.permutation(y.size)
        rate = RATE * (1 - epoch / EPOCHS)
        for at in range(0, y.size, GROUP):
            own = order[at : at + GROUP]
            sizes = base[own + 1] - base[own]
            part = np.concatenate([[0], np.cumsum(sizes)])
            rows = np.repeat(base[own] - part[:-1], sizes) + np.arange(part[-1])
            f = forward(model, x[rows], part)
            turn += 1
            for k, grad in _gradients(model, f, part, y[own]).items():
                grad = grad + SHRINK * model[k]
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad**2
                step = first[k] / (1 - 0.9**turn) / (np.sqrt(second[k] / (1 - 0.999**turn)) + 1e-8)
                model[k] = model[k] - rate * step
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Model from the labels 0 and 1 in column quality; about `sample` labelled documents are used.

    A document with several labels counts with the least. Without any label every text gets 0.5.
    """
    known = labels.filter("doc_id is not null and quality in (0, 1)")
    rate = max(1, known.count() // sample)
    picked = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(rate)) == 0)
    picked = picked.groupBy("doc_id").agg(F.min("quality").alias("label")).limit(2 * sample)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            x, base = passages(batch.column("text"))
            bags = [x[a:b].tobytes() for a, b in zip(base[:-1], base[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.string()), batch.column("label"), pa.array(bags, pa.binary())],
                names=["id", "label", "bag"],
            )

    # at most 2 * sample rows of two numbers are sent to every task
    found = (
        docs.select("doc_id", "text")
        .join(F.broadcast(picked.select("doc_id", F.col("label").cast("double"))), "doc_id")
        .mapInArrow(encode, "id string, label double, bag binary")
    )
    rows = sorted((r["id"], r["label"], bytes(r["bag"])) for r in found.collect())
    bags = [np.frombuffer(r[2], np.float32).reshape(-1, FEATURES) for r in rows]
    base = np.concatenate([[0], np.cumsum([len(b) for b in bags])]).astype(np.int64)
    x = np.concatenate(bags) if bags else np.zeros((0, FEATURES), np.float32)
    model = train(x, base, np.array([r[1] for r in rows]))
    if not rows:
        model["c"], model["d"] = np.zeros(ENCODED), np.zeros(())
    return {k: np.asarray(v, np.float32) for k, v in model.items()}


def score(docs: DataFrame, model: dict, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, score[, text, row]) of each whole text: higher if label 1 is likelier.

    Only the text is read; with `carry` it comes back, and the columns named there in `row`. Null and empty texts are scored as one empty passage. Rows that repeat
    an id stay, and an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            x, base = passages(batch.column("text"))
            found = forward(sent.value, x, base)["score"].astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found), *([batch.column("text"), batch.column("row")] if carry else [])],
                names=["doc_id", "score", *(["text", "row"] if carry else [])],
            )

    given, schema = shared.carrying(docs, carry)
    return given.mapInArrow(run, schema.format("score double"))


def assess(docs: DataFrame, labels: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Scores of all rows by a model that has not seen the labels of the held-out ones."""
    model = fit(docs, labels.filter(~held_out("doc_id", 5, 0)))
    found = score(docs, model, carry)
    return found.withColumn("predicted", F.when(F.col("score") >= GOOD, 1).otherwise(0))


def op6_quality(spark, sf_dir: str) -> DataFrame:
    found = assess(shared.read(spark, sf_dir, "documents"), shared.read(spark, sf_dir, "labels"))
    out = held_out("doc_id", 5, 0).alias("held_out")
    return found.select("doc_id", out, "score", "predicted")
