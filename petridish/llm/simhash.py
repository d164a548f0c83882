"""SimHash near-duplicates: fingerprints of word shingles, linked through a vantage-point tree.

Method. Distinct fingerprints are partitioned by a tree of vantage points: a node sends the
fingerprints within a Hamming distance `cut` of its vantage point inside, the others outside.
The tree is fitted on a bounded sample and only decides where work is done. A fingerprint has one
home leaf. By the triangle inequality a link of at most `radius` bits between an inside and an
outside home needs the inside one within `radius` of the cut, so only those are sent on as
visitors, and a visitor enters every branch that its distance does not rule out. Each leaf then
compares its homes with each other and with its visitors, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petridish.llm import shared
from petridish.llm.textblocks import LOWER_ASCII, NOT_SPACE, blocks, text_buffer, word_spans

#: Distinct fingerprints that the tree is fitted on (expected number).
SAMPLE = 16384
#: Wanted fingerprints in a leaf and largest side of one comparison; the number of leaves is
#: bounded by MAX_LEAVES, so the tree that is sent to the tasks stays under a megabyte.
LEAF, BLOCK, MAX_LEAVES = 512, 768, 4096
SHINGLE, SEED, RADIUS = 3, 42, 2


def normalised(data, offsets):
    """Lower-cased words joined by one space: bytes, word starts and ends in them, first words."""
    data = LOWER_ASCII[data]
    starts, ends, first = word_spans(data, offsets, NOT_SPACE)
    keep = NOT_SPACE[data]
    inner = np.ones(starts.size, bool)
    inner[first[1:][first[1:] > first[:-1]] - 1] = False
    keep[ends[inner]] = True
    data[ends[inner]] = 32
    place = np.cumsum(keep) - keep
    return data[keep], place[starts], place[ends - 1] + 1, first


def simhashes(texts: pa.Array, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """64-bit fingerprints: a bit is set if it is set in over half of the shingles' hashes.

    Texts of fewer words are one shingle; texts without words get 0.
    """
    data, offsets = text_buffer(texts)
    norm, starts, ends, first = normalised(data, offsets)
    words = np.diff(first)
    number = np.where(words >= shingle, words - shingle + 1, np.minimum(words, 1))
    base = np.concatenate([[0], np.cumsum(number)])
    of = np.repeat(np.arange(words.size), number)
    at = first[of] + np.arange(base[-1]) - base[of]
    till = np.minimum(at + shingle, first[of + 1]) - 1
    raw, digest = norm.tobytes(), xxhash.xxh64_intdigest
    found = np.fromiter(
        (digest(raw[a:b], seed) for a, b in zip(starts[at].tolist(), ends[till].tolist())),
        np.uint64,
        at.size,
    )
    out = np.zeros(words.size, np.uint64)
    full = np.flatnonzero(number)
    if full.size:
        bits = np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, base[full], axis=0, dtype=np.int32)
        wins = ones * 2 > number[full, None]
        out[full] = np.packbits(wins, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text as a signed long."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            found = simhashes(batch.column("text"), shingle, seed).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found)], names=["doc_id", "fp"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(compute, f"doc_id {kind}, fp bigint")


def distance(a, b) -> np.ndarray:
    return np.bitwise_count(np.bitwise_xor(a, b)).astype(np.int16)


def fit_tree(sample: np.ndarray, leaves: int, least: int = 8) -> dict:
    """Vantage points, cuts and children of a tree; leaves have child numbers below zero.

    Of some vantage candidates the one with the widest spread of distances is taken; the cut is
    the median distance. Nodes with few sampled fingerprints or no spread become leaves.
    """
    points, cuts, children, done = [], [], [], [0]
    random = np.random.default_rng(7)

    def grow(own: np.ndarray, share: int) -> int:
        if share > 1 and own.size >= least:
            tried = own[random.integers(0, own.size, min(16, own.size))]
            spread = [np.std(distance(own, t)) for t in tried]
            best = tried[int(np.argmax(spread))]
            away = distance(own, best)
            cut = int(np.median(away))
            inside = away <= cut
            if inside.all():
                cut, inside = cut - 1, away < cut
            if inside.any() and not inside.all():
                here = len(points)
                points.append(best)
                cuts.append(cut)
                children.append([0, 0])
                children[here] = [grow(own[inside], share // 2), grow(own[~inside], share // 2)]
                return here
        done[0] += 1
        return -done[0]

    root = grow(sample, leaves)
    return {
        "points": np.array(points, np.uint64),
        "cuts": np.array(cuts, np.int16),
        "children": np.array(children, np.int32).reshape(-1, 2),
        "root": root,
        "leaves": done[0],
    }


def route(tree: dict, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, at home): the home leaf of each fingerprint and the leaves that it visits."""
    rows, leaves, homes = [], [], []
    todo = [(tree["root"], np.arange(fps.size), np.ones(fps.size, bool))]
    while todo:
        node, own, home = todo.pop()
        if own.size == 0:
            continue
        if node < 0:
            rows.append(own)
            leaves.append(np.full(own.size, -node - 1))
            homes.append(home)
            continue
        away = distance(fps[own], tree["points"][node])
        cut = tree["cuts"][node]
        inside = away <= cut
        # homes go to their side, inside homes near the cut visit the outside as well
        go_in = np.where(home, inside, away <= cut + radius)
        go_out = np.where(home, away > cut - radius, away + radius > cut)
        todo.append((tree["children"][node][0], own[go_in], home[go_in]))
        todo.append((tree["children"][node][1], own[go_out], (home & ~inside)[go_out]))
    if not rows:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, bool)
    return np.concatenate(rows), np.concatenate(leaves), np.concatenate(homes)


def near_edges(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest over all pairs of one from `left` and one from `right` within `radius` bits."""
    every = np.unique(np.concatenate([left, right]))
    top = np.arange(every.size)
    one, two = np.searchsorted(every, left), np.searchsorted(every, right)
    for at in range(0, left.size, 256):
        near = np.bitwise_count(left[at : at + 256, None] ^ right[None, :]) <= radius
        a, b = np.nonzero(near)
        a, b = one[at + a], two[b]
        while a.size:  # link the roots of each pair, flatten, and drop pairs that are joined
            a, b = top[a], top[b]
            open_ = a != b
            a, b = a[open_], b[open_]
            np.minimum.at(top, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(top, top[top]):
                top = top[top]
    linked = np.flatnonzero(top != np.arange(every.size))
    return every[linked], every[top[linked]]


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): a forest of links between distinct fingerprints (column fp) within `radius` bits.

    Links inside a leaf are reduced to a forest there, so a dense group costs as many rows as it
    has fingerprints. A large leaf is cut into blocks of bounded size, and each pair of blocks is
    a task's group of its own.
    """
    spark = fps.sparkSession
    total = fps.count()
    rate = max(1, total // SAMPLE)
    picked = fps.filter(F.pmod(F.xxhash64("fp", F.lit(5)), F.lit(rate)) == 0) if rate > 1 else fps
    sample = np.array([r["fp"] for r in picked.select("fp").limit(2 * SAMPLE).collect()], np.int64)
    sample = np.sort(sample).view(np.uint64)
    tree = fit_tree(sample, min(MAX_LEAVES, shared.shard_count(total, LEAF)))
    sent = spark.sparkContext.broadcast(tree)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                own = batch.column("fp").slice(at, 4096).to_numpy(zero_copy_only=False)
                row, leaf, home = route(sent.value, own.view(np.uint64), radius)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[row]), pa.array(leaf.astype(np.int32)), pa.array(home)],
                    names=["fp", "leaf", "home"],
                )

    routed = shared.materialise(
        fps.select("fp").mapInArrow(spread, "fp bigint, leaf int, home boolean")
    )
    sizes = routed.groupBy("leaf").agg(
        F.greatest(F.lit(1), F.ceil(F.sum(F.col("home").cast("int")) / BLOCK)).alias("home_blocks"),
        F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK)).alias("all_blocks"),
    )
    # one row per leaf and at most MAX_LEAVES leaves
    routed = routed.join(F.broadcast(sizes), "leaf")
    spot = F.xxhash64("fp", F.lit(11))
    homes = routed.filter("home").select(
        "leaf",
        F.pmod(spot, F.col("home_blocks")).alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1)).alias("j"),
        "fp",
        F.lit(True).alias("home"),
    )
    asking = routed.select(
        "leaf",
        F.explode(F.sequence(F.lit(0), F.col("home_blocks") - 1)).alias("i"),
        F.pmod(spot, F.col("all_blocks")).alias("j"),
        "fp",
        F.lit(False).alias("home"),
    )

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        own = group["fp"].to_numpy().view(np.uint64)
        home = group["home"].to_numpy()
        a, b = near_edges(own[home], own[~home], radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return (
        homes.union(asking)
        .groupBy("leaf", "i", "j")
        .applyInPandas(compare, "a bigint, b bigint")
        .distinct()
    )


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of `docs`.

    Copies are combined to one fingerprint first. Null and empty texts, and texts of white space
    only, have fingerprint 0 and are linked like any other. Rows that repeat a doc_id stay; a null
    doc_id gets its fingerprint's component, and is that component's id only if no other id is in
    it. An empty table gives an empty result. Columns other than doc_id and text are not read.
    """
    found = shared.materialise(fingerprints(docs))
    classes = shared.materialise(found.groupBy("fp").agg(F.min("doc_id").alias("first")))
    linked = shared.components(links(classes, radius), "a", "b")
    of = classes.join(linked, classes.fp == linked.node, "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("group")
    )
    least = of.groupBy("group").agg(F.min("first").alias("component_id"))
    # a component's size is not bounded: both joins have a unique side and can split the other
    of = of.join(least, "group").select("fp", "component_id")
    return found.join(of, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(shared.read(spark, sf_dir, "documents"))
