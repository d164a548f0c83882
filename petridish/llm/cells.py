"""Packed arrays, and cells: the keys that a block of documents sends to the shards of a table.

A block is the documents that a task takes together. It sends its distinct keys to shards by a hash
of the key, one row of packed arrays for each (block, shard), and gets the answers back in the order
of the cell. One key stands once in a cell however often the block has it, so no shard is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petridish.llm import shared
from petridish.llm.textblocks import mix

#: Keys that are sent to a shard, as expected.
PER_SHARD = 4_000_000


def pack(values: np.ndarray, ascending: bool = False) -> bytes:
    """Compressed 64-bit numbers, as differences if ascending; bytes of one place stand together."""
    x = np.asarray(values).astype(np.uint64)
    if ascending and x.size:
        x = np.concatenate([x[:1], np.diff(x)])
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T)
    return x.size.to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(blob: bytes, ascending: bool = False) -> np.ndarray:
    size = int.from_bytes(blob[:8], "little")
    raw = pa.decompress(blob[8:], decompressed_size=8 * size, codec="zstd", asbytes=True)
    planes = np.frombuffer(raw, np.uint8).reshape(8, size)
    x = np.ascontiguousarray(planes.T).view(np.uint64).ravel()
    return np.cumsum(x, dtype=np.uint64) if ascending else x


def numbers() -> Iterator[int]:
    """Numbers of the blocks of a task, unlike those of other tasks."""
    at = TaskContext.get().partitionId() << 32
    while True:
        yield at
        at += 1


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mix(keys.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)


def split(keys: np.ndarray, shards: int) -> list[tuple[int, np.ndarray]]:
    """(shard, places of its keys in order) of each shard that has one."""
    shard = shard_of(keys, shards)
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    return [(int(shard[p[0]]), p) for p in np.split(order, cuts) if p.size]


def shards_for(blocks: DataFrame, sizes: str, share: int = 1) -> int:
    """Number of shards, `share` times as many as usual, for blocks whose `sizes` counts the keys they send."""
    return shared.shard_count(share * blocks.agg(F.coalesce(F.sum(sizes), F.lit(0))).first()[0], PER_SHARD)


def sums(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Exact integer sums of `values` by place."""
    out = np.zeros(size, np.int64)
    np.add.at(out, at, values.astype(np.int64))
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of the runs [start, start + length), one run after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))
