"""Removal of byte strings that occur more than once, by suffix arrays.

Suffixes are sorted in two stages: those smaller than their successors are sorted directly, the
others are induced by scanning the buckets of first bytes in order, each suffix placing its
predecessor. Two windows are equal if neighbours in the suffix array have a common prefix of the
window's length. Each suffix array is over a shard of the contexts that can hold repeats (see
`anchors`), of bounded expected size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petridish.llm import anchors, shared
from petridish.llm.textblocks import blocks, text_buffer

LENGTH, GRAMS = 400, (64, 368, 400)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes of a byte array in the order of their first `depth` bytes."""
    n = text.size
    if n == 0:
        return np.zeros(0, np.int64)
    turns = np.flatnonzero(text[:-1] != text[1:])
    turn = np.searchsorted(turns, np.arange(n))
    smaller = np.zeros(n, bool)  # a run up to the end is greater than its successor
    inside = turn < turns.size
    at = turns[turn[inside]]
    smaller[inside] = text[at] < text[at + 1]

    padded = np.concatenate([text, np.zeros(depth, np.uint8)])
    view = np.ndarray((n,), f"S{depth}", padded, strides=(1,))
    direct: dict[int, np.ndarray] = {}
    firsts = text[smaller]
    own = np.flatnonzero(smaller)
    for byte in np.unique(firsts).tolist():
        bucket = own[firsts == byte]
        direct[byte] = bucket[np.argsort(view[bucket], kind="stable")]

    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[int(text[-1])].append(np.array([n - 1]))  # the empty suffix comes first of all
    out = []
    for byte in range(256):
        parts = waiting[byte]
        front = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        parts = [front]
        while front.size:  # predecessors with the same first byte follow in this bucket
            front = front[front > 0] - 1
            front = front[(text[front] == byte) & ~smaller[front]]
            parts.append(front)
        if byte in direct:
            parts.append(direct[byte])
        bucket = np.concatenate(parts)
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[~smaller[before] & (text[before] > byte)]
        if before.size:
            first = text[before]
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            cuts = np.flatnonzero(first[1:] != first[:-1]) + 1
            for part in np.split(before, cuts):
                waiting[int(text[part[0]])].append(part)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, one: np.ndarray, two: np.ndarray, depth: int) -> np.ndarray:
    """Bytes that the suffixes at `one` and `two` have in common, in steps of 8 up to `depth`."""
    padded = np.concatenate([text, np.zeros(depth + 8, np.uint8)])
    words = np.ndarray((text.size + depth,), "<u8", padded, strides=(1,))
    found = np.zeros(one.size, np.int64)
    alive = np.arange(one.size)
    for at in range(0, depth, 8):
        alive = alive[words[one[alive] + at] == words[two[alive] + at]]
        if not alive.size:
            break
        found[alive] = at + 8
    return found


def repeated_starts(bodies: list[np.ndarray], totals: list[int], length: int = LENGTH):
    """Spans of window starts of each body whose window starts in these bodies twice."""
    assert length % 8 == 0
    text = np.concatenate(bodies)
    base = np.concatenate([[0], np.cumsum([b.size for b in bodies])])
    full = np.zeros(text.size, bool)
    for a, b in zip(base[:-1].tolist(), base[1:].tolist()):
        full[a : max(a, b - length + 1)] = True
    order = suffix_array(text, length)
    order = order[full[order]]
    same = common_prefixes(text, order[:-1], order[1:], length) >= length
    again = np.zeros(text.size, bool)
    again[order[:-1][same]] = True
    again[order[1:][same]] = True
    starts, ends, first = anchors.runs_of(again, base)
    return [
        [(0, len(bodies[i]) - length + 1)]  # the whole body occurs again
        if totals[i] > 1
        else list(zip((starts[p:q] - base[i]).tolist(), (ends[p:q] - base[i]).tolist()))
        for i, (p, q) in enumerate(zip(first[:-1].tolist(), first[1:].tolist()))
    ]


RULE = anchors.Rule(LENGTH, GRAMS, text_buffer, "u1", "count", repeated_starts)


def remove_repeats(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, n_bytes, spans, kept[, row]): each whole text without its repeated bytes.

    A byte goes if a string of LENGTH bytes that covers it also starts elsewhere, in the same or
    another document; strings overlap freely and never cross documents. `spans` are the maximal
    removed runs, `kept` the bytes left (binary, as a run may begin inside a character). Null and
    empty texts have no bytes. Repeated rows are each other's repeats. Different texts with one
    doc_id, or with a null one, are documents of their own. An empty table gives an empty result.
    Only doc_id and text are read, and the columns named in `carry`, which come back in `row`.
    """
    spans = anchors.repeated(docs, RULE, F.lit(1))
    joined = anchors.with_spans(docs, spans, carry or [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            data, bounds = text_buffer(batch.column("text"))
            gone = anchors.covered(batch, bounds, LENGTH, data.size)
            starts, ends, first = anchors.runs_of(gone, bounds)
            left = data[~gone]
            kept = np.concatenate([[0], np.cumsum(~gone)])[bounds]
            columns = [
                batch.column("doc_id"),
                pa.array(np.diff(bounds)),
                anchors.span_lists(starts, ends, first, bounds),
                pa.array([left[a:b].tobytes() for a, b in zip(kept[:-1], kept[1:])], pa.binary()),
            ]
            names = ["doc_id", "n_bytes", "spans", "kept"]
            if carry:
                columns.append(batch.column("row"))
                names.append("row")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes bigint, spans array<{anchors.SPAN}>, kept binary"
    if carry:
        schema += f", row {joined.schema['row'].dataType.simpleString()}"
    return joined.mapInArrow(run, schema)


def op7_suffixes(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(shared.read(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
