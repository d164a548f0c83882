"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted, each with a cost. Texts longer than the greatest length are
cut into pieces of that length and a rest. Pieces are placed from the longest to the shortest: into
the open bin that they leave least room in, or else into a new bin of the length with the least
cost per token of those that hold the piece. At the end each bin goes down to the cheapest length
that holds its contents.

Pieces are dealt to shards of an expected size by a hash, so every task packs a bounded number of
pieces and no source, length or group of copies lands in one task. Only ids and lengths are
shuffled, never texts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from petridish.llm import shared

#: Permitted sequence lengths in tokens.
LENGTHS = (512, 1024, 2048, 4096)
#: Expected pieces in a shard.
SHARD = 2048
#: Parts of a sequence's cost besides one per token: a fixed part, and attention, which costs as
#: much as everything else at this length.
START, EVEN = 64.0, 8192.0


def sequence_cost(length: int) -> float:
    return START + length + length * length / EVEN


def pack(
    sizes: np.ndarray,
    lengths: Sequence[int] = LENGTHS,
    cost: Callable[[int], float] = sequence_cost,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset in the bin and the bin's length for each size (in the order given).

    Sizes must be at most the greatest length and are taken as they come, so sort them first.
    Rooms are found in a bit mask of the rooms that open bins have: the lowest set bit from the
    size on is the best fit. Pieces of size 0 go to no bin (-1).
    """
    lengths = sorted(set(lengths))
    opened = [0] * (lengths[-1] + 1)  # length of a new bin for a piece of each size
    for size in range(1, lengths[-1] + 1):
        opened[size] = min((x for x in lengths if x >= size), key=lambda x: (cost(x) / x, x))
    rooms: list[list[int]] = [[] for _ in range(lengths[-1] + 1)]
    mask, full = 0, []
    bins, offsets = np.full(len(sizes), -1, np.int64), np.zeros(len(sizes), np.int64)
    for i, size in enumerate(sizes.tolist()):
        if size == 0:
            continue
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            own = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            room, own = opened[size], len(full)
            full.append(0)
        bins[i], offsets[i] = own, full[own]
        full[own] += size
        left = room - size
        if left:
            rooms[left].append(own)
            mask |= 1 << left
    least = np.array(
        [0] + [min((x for x in lengths if x >= n), key=cost) for n in range(1, lengths[-1] + 1)]
    )
    held = least[np.array(full, np.int64)] if full else np.zeros(1, np.int64)
    return bins, offsets, np.where(bins >= 0, held[bins], 0)


def pieces(docs: DataFrame, size: Column, longest: int) -> DataFrame:
    """(doc_id, copy, piece, start, size): each text cut into pieces of at most `longest` tokens."""
    sized = docs.select("doc_id", F.coalesce(size.cast("long"), F.lit(0)).alias("total"))
    last = F.greatest(F.lit(0), F.ceil(F.col("total") / longest) - 1)
    return sized.select(
        "doc_id", "total", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece")
    ).select(
        "doc_id",
        "piece",
        (F.col("piece") * longest).alias("start"),
        F.least(F.lit(longest), F.col("total") - F.col("piece") * longest).alias("size"),
    )


def best_fit(
    docs: DataFrame, size: Column, lengths: Sequence[int] = LENGTHS, shard: int = SHARD
) -> DataFrame:
    """One row per piece: doc_id, piece, start and size in the text, and its place in a sequence.

    `size` gives the tokens of each row. seq_id names the sequence (shard and bin), seq_length its
    length, seq_offset the piece's start in it. Rows of no tokens (null or empty texts) keep one
    piece of size 0 and have a null seq_id. Repeated rows are packed one by one. Ties are placed by
    doc_id (null first) and piece. An empty table gives an empty result; columns other than doc_id
    and those in `size` are not read.
    """
    lengths = sorted(set(lengths))
    cut = pieces(docs, size, lengths[-1])
    shards = shared.shard_count(docs.count(), shard)

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(
            ["size", "doc_id", "piece"], ascending=[False, True, True], na_position="first"
        )
        bins, offsets, held = pack(group["size"].to_numpy(), lengths)
        name = group["shard"].astype(str) + "-" + pd.Series(bins, group.index).astype(str)
        return group.assign(
            seq_id=name.where(bins >= 0, None), seq_offset=offsets, seq_length=held
        )

    kind = docs.schema["doc_id"].dataType
    out = T.StructType(
        [
            T.StructField("doc_id", kind),
            T.StructField("piece", T.LongType()),
            T.StructField("start", T.LongType()),
            T.StructField("size", T.LongType()),
            T.StructField("shard", T.LongType()),
            T.StructField("seq_id", T.StringType()),
            T.StructField("seq_offset", T.LongType()),
            T.StructField("seq_length", T.LongType()),
        ]
    )
    # full texts of the greatest length make a sequence of their own and are dealt like the others
    spot = F.pmod(F.xxhash64("doc_id", "piece", F.lit(3)), F.lit(shards)).cast("long")
    return (
        cut.withColumn("shard", spot)
        .groupBy("shard")
        .applyInPandas(fill, out)
        .drop("shard")
    )


def word_count(text: str = "text") -> Column:
    """Words of a text (runs of bytes that are not white space); null counts as empty."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return F.length(F.regexp_replace(spaced, r"[\x20\x09-\x0D]+", ""))


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return best_fit(shared.read(spark, sf_dir, "documents"), word_count())
