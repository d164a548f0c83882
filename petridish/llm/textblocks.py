"""Numpy views of text columns inside tasks: byte blocks, word spans and rolling hashes.

Everything here works on one bounded block of an Arrow batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {
    "up": np.ones(1, np.uint64),
    "down": np.ones(1, np.uint64),
}

#: Words are runs of bytes that are not white space (0x09 to 0x0D and 0x20).
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Lower-cases A to Z and nothing else.
LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[65:91] += 32


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, where, data = column.buffers()
    if len(column) == 0 or where is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES
) -> Iterator[pa.RecordBatch]:
    """Slices of batches with about `limit` bytes of text each, one row at least."""
    for batch in batches:
        _, offsets = text_buffer(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def word_spans(
    data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each row the index of its first word (one more entry)."""
    if data.size == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    inside = is_word[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < data.size]] = False
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if have.size < n:
        step = np.full(max(n, 2 * have.size), _ODD if kind == "up" else _ODD_INVERSE, np.uint64)
        step[0] = 1
        have = _powers[kind] = np.cumprod(step)
    return have[:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums from which `span_hash` gets the hash of any span; one entry more than `values`."""
    sums = np.zeros(values.size + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _power("up", values.size), out=sums[1:])
    return sums


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes, one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span [start, end); equal spans have equal hashes wherever they stand."""
    at = _power("down", sums.size)
    with np.errstate(over="ignore"):
        return mix((sums[ends] - sums[starts]) * at[starts] + (ends - starts).astype(np.uint64))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of `width` neighbours, by doubling."""
    have, out = 1, values
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        more = width - have
        out = np.minimum(out[:-more], out[more:])
    return out
