"""Embedding near-duplicates by product quantisation.

A coarse quantiser puts each distinct vector (scaled to length 1) into an inverted list, with a code
of its residual: the nearest codeword in each subspace. A query visits its own list and those whose
cell begins within a margin of it, measured to the plane between the two centres. In a list,
distances to the codes come from a table of the query's distances to all codewords. What passes
the threshold plus the code's own error, which loses nothing, is compared by exact cosine.

The margin between two lists is MARGIN standard deviations of a step of threshold length towards the
other centre, if steps spread as the sampled vectors of that length do; it is widened by what the
links of some probes, compared with all vectors, need. It is never above the full step, which finds
every pair for certain, but visits most lists where vectors spread in many dimensions. Lengths with
few sampled vectors get the full step. Tests measure the recall against brute force.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petridish.llm import shared

LEAST = 0.95
#: Vectors that the quantisers are fitted on (expected number), vectors in a list, most lists.
SAMPLE, LIST, MAX_LISTS = 16384, 256, 4096
SUBSPACES, CODEWORDS, ROUNDS = 8, 64, 8
MARGIN = 3.3
#: Vector lengths with a spread of their own; sampled vectors that this takes for each component.
SPREADS, ENOUGH = 8, 2
#: Vectors compared with all others to widen the margin, and the share of them whose links it covers.
PROBES, COVERED = 256, 0.99
#: Largest side of one comparison; longer lists are cut into blocks.
BLOCK = 1024


def k_means(x: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    random = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    centres = x[random.choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        near = nearest(x, centres)
        order = np.argsort(near, kind="stable")
        heads = np.flatnonzero(np.diff(near[order], prepend=-1))
        sums = np.add.reduceat(x[order], heads, axis=0)
        sizes = np.diff(np.append(heads, len(x)))
        centres[near[order][heads]] = sums / sizes[:, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(axis=1) / 2
    parts = [(half - x[i : i + 2048] @ centres.T).argmin(axis=1) for i in range(0, len(x), 2048)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def fit(x: np.ndarray, lists: int) -> dict:
    """Coarse centres, their distances, and the codewords of each subspace, from unit vectors."""
    centres = k_means(x, lists)
    rest = x - centres[nearest(x, centres)]
    parts = np.split(rest, SUBSPACES, axis=1)
    apart = np.stack([((centres - c) ** 2).sum(axis=1) for c in centres])
    return {
        "centres": centres,
        "apart": np.sqrt(apart),
        "words": np.stack([_padded(k_means(p, CODEWORDS, m)) for m, p in enumerate(parts)]),
    }


def _padded(words: np.ndarray) -> np.ndarray:
    return words[np.arange(CODEWORDS) % len(words)]


def encode(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """List, codes and length of the coding error of unit vectors."""
    own = nearest(x, model["centres"])
    rest = x - model["centres"][own]
    codes, error = [], np.zeros(len(x))
    for words, part in zip(model["words"], np.split(rest, SUBSPACES, axis=1)):
        code = nearest(part, words)
        codes.append(code.astype(np.uint8))
        error += ((part - words[code]) ** 2).sum(axis=1)
    return own, np.stack(codes, axis=1), np.sqrt(error)


def fit_spreads(model: dict, x: np.ndarray, dims: np.ndarray) -> dict:
    """Per vector length, centres scaled so that their distances are spreads of a random step."""
    out = {}
    lengths, number = np.unique(dims, return_counts=True)
    for i in np.argsort(-number, kind="stable")[:SPREADS]:
        if number[i] >= ENOUGH * lengths[i]:
            values, axes = np.linalg.eigh(np.cov(x[dims == lengths[i]].T))
            values = np.maximum(values, 0)
            if values.sum() > 1e-12:
                scaled = axes * np.sqrt(values / values.sum())
                out[int(lengths[i])] = model["centres"] @ scaled
    return out


def margins(model: dict, own: np.ndarray, dims: np.ndarray, reach: float) -> np.ndarray:
    """(row, list): the margin of vectors of a list and a length towards each other list."""
    out = np.full((len(own), len(model["centres"])), reach)
    for length in np.unique(dims):
        scaled = model["spreads"].get(int(length))
        if scaled is not None:
            rows = np.flatnonzero(dims == length)
            square = (scaled**2).sum(axis=1)
            apart = square[own[rows], None] + square - 2 * (scaled[own[rows]] @ scaled.T)
            share = np.sqrt(np.maximum(apart, 0)) / np.maximum(model["apart"][own[rows]], 1e-9)
            out[rows] = reach * np.minimum(1, MARGIN * model["wider"] * share)
    return out


def ahead(model: dict, x: np.ndarray, own: np.ndarray) -> np.ndarray:
    """(row, list): how far before the cell of each list a vector is, measured to the plane."""
    centres = model["centres"]
    square = (centres**2).sum(axis=1) - 2 * (x @ centres.T)
    gap = square - square[np.arange(len(x)), own][:, None]
    return gap / (2 * np.maximum(model["apart"][own], 1e-9))


def visits(model: dict, x: np.ndarray, own: np.ndarray, dims: np.ndarray, reach: float):
    """(row, list): lists above the own one whose cell begins within the margin of the vector."""
    near = ahead(model, x, own) <= margins(model, own, dims, reach) + 1e-9
    near &= np.arange(len(model["centres"])) > own[:, None]
    return np.nonzero(near)


def widening(classes: DataFrame, model: dict, raw: list[bytes], width: int, least: float) -> float:
    """By how much margins must grow for the links of the probes `raw`, compared with all vectors."""
    reach = float(np.sqrt(2 - 2 * least))
    probes = unit(raw, width)
    lengths = np.array([len(r) // 8 for r in raw])
    sent = classes.sparkSession.sparkContext.broadcast((model, probes, lengths))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, probes, lengths = sent.value
        lists = nearest(probes, model["centres"])
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                x = unit([np.array(v, np.float64).tobytes() for v in batch.column("vec").to_pylist()], width)
                dims = batch.column("dims").to_numpy(zero_copy_only=False)
                row, probe = np.nonzero((x @ probes.T >= least) & (dims[:, None] == lengths))
                own = nearest(x[row], model["centres"])
                # the vector of the lower list visits the other's
                up = (own < lists[probe])[:, None]
                low = np.where(up, x[row], probes[probe])
                of, to = np.minimum(own, lists[probe]), np.maximum(own, lists[probe])
                each, worst = np.arange(row.size), np.zeros(len(probes))
                for a in range(0, row.size, 1024):
                    p = slice(a, a + 1024)
                    gap = ahead(model, low[p], of[p])[each[p] - a, to[p]]
                    have = margins(model, of[p], lengths[probe[p]], reach)[each[p] - a, to[p]]
                    need = np.where((of[p] == to[p]) | (have >= reach), 0, gap / np.maximum(have, 1e-9))
                    np.maximum.at(worst, probe[p], need)
                linked = np.unique(probe)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(linked.astype(np.int32)), pa.array(worst[linked])], names=["probe", "need"]
                )

    found = classes.select("dims", "vec").mapInArrow(compare, "probe int, need double")
    need = [r["need"] for r in found.groupBy("probe").agg(F.max("need").alias("need")).collect()]
    return max(1.0, float(np.quantile(need, COVERED, method="higher"))) if need else 1.0


def table_distances(model: dict, own: int, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Distances of unit vectors to the coded vectors of a list, by table look-up."""
    rest = x - model["centres"][own]
    total = np.zeros((len(x), len(codes)))
    for m, (words, part) in enumerate(zip(model["words"], np.split(rest, SUBSPACES, axis=1))):
        table = (part**2).sum(axis=1)[:, None] + (words**2).sum(axis=1) - 2 * part @ words.T
        total += table[:, codes[:, m]]
    return np.sqrt(np.maximum(total, 0))


def unit(raw: list[bytes], width: int) -> np.ndarray:
    """Vectors in double precision, scaled to length 1 and filled up with zeros to `width`."""
    out = np.zeros((len(raw), width))
    for i, x in enumerate(raw):
        own = np.frombuffer(x, np.float64)
        own = own / np.abs(own).max()  # no overflow in the squares
        out[i, : own.size] = own / np.sqrt((own**2).sum())
    return out


def forest(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Root of each of `size` nodes under links (a, b)."""
    top = np.arange(size)
    while a.size:
        a, b = top[a], top[b]
        open_ = a != b
        a, b = a[open_], b[open_]
        np.minimum.at(top, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(top, top[top]):
            top = top[top]
    return top


def near_links(classes: DataFrame, least: float = LEAST) -> DataFrame:
    """(cid, links, root): linked copies that each list's comparisons found, and a forest of links.

    classes: cid, n (copies), dims and vec (array of double, valid) of distinct vectors.
    """
    spark = classes.sparkSession
    total, dims = classes.agg(F.count("*"), F.coalesce(F.max("dims"), F.lit(1))).first()
    width = -(-dims // SUBSPACES) * SUBSPACES
    rate = max(1, total // SAMPLE)
    picked = classes.filter(F.pmod(F.xxhash64("cid", F.lit(5)), F.lit(rate)) == 0)
    sample = picked.select("cid", "vec").limit(2 * SAMPLE).collect()
    if not sample:
        return classes.select("cid", F.lit(0).cast("long").alias("links"), F.col("cid").alias("root"))
    raw = [np.array(r["vec"], np.float64).tobytes() for r in sorted(sample, key=lambda r: r["cid"])]
    lists = min(MAX_LISTS, shared.shard_count(total, LIST))
    x = unit(raw, width)
    model = fit(x, lists)
    model["spreads"] = fit_spreads(model, x, np.array([len(r) // 8 for r in raw]))
    model["wider"] = 1.0
    if lists > 1 and model["spreads"]:
        step = max(1, len(raw) // PROBES)
        model["wider"] = widening(classes, model, raw[::step][:PROBES], width, least)
    sent = spark.sparkContext.broadcast(model)
    reach = float(np.sqrt(2 - 2 * least))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                raw = [np.array(v, np.float64).tobytes() for v in batch.column("vec").to_pylist()]
                x = unit(raw, width)
                own, codes, error = encode(model, x)
                row, to = visits(model, x, own, batch.column("dims").to_numpy(zero_copy_only=False), reach)
                rows = np.concatenate([np.arange(len(x)), row])
                home = np.arange(rows.size) < len(x)
                named = [batch.column(c).take(pa.array(rows)) for c in ("cid", "n", "dims")]
                yield pa.RecordBatch.from_arrays(
                    named
                    + [
                        pa.array(np.concatenate([own, to]).astype(np.int32)),
                        pa.array(home),
                        pa.array([codes[i].tobytes() if h else b"" for i, h in zip(rows, home)]),
                        pa.array(error[rows]),
                        pa.array([raw[i] for i in rows]),
                    ],
                    names=["cid", "n", "dims", "list", "home", "codes", "error", "vec"],
                )

    placed = shared.written(
        classes.select("cid", "n", "dims", "vec").mapInArrow(
            place,
            "cid bigint, n bigint, dims int, list int, home boolean, codes binary, error double, vec binary",
        )
    )
    blocks = lambda number: F.greatest(F.lit(1), F.ceil(number / BLOCK))
    sizes = placed.groupBy("list").agg(
        blocks(F.sum(F.col("home").cast("int"))).alias("home_blocks"),
        blocks(F.count("*")).alias("all_blocks"),
    )
    # one row per list and at most MAX_LISTS lists
    placed = placed.join(F.broadcast(sizes), "list")
    spot = F.xxhash64("cid", F.lit(11))
    homes = placed.filter("home").select(
        "list",
        F.pmod(spot, F.col("home_blocks")).alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1)).alias("j"),
        F.lit(True).alias("target"),
        "home", "cid", "n", "dims", "codes", "error", "vec",
    )
    asking = placed.select(
        "list",
        F.explode(F.sequence(F.lit(0), F.col("home_blocks") - 1)).alias("i"),
        F.pmod(spot, F.col("all_blocks")).alias("j"),
        F.lit(False).alias("target"),
        "home", "cid", "n", "dims", "codes", "error", "vec",
    )

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        model, own = sent.value, int(group["list"].iloc[0])
        have, ask = group[group["target"]], group[~group["target"]]
        none = pd.DataFrame({"cid": [], "links": [], "root": []}).astype("int64")
        if not len(have) or not len(ask):
            return none
        codes = np.stack([np.frombuffer(c, np.uint8) for c in have["codes"]])
        x, y = unit(ask["vec"].tolist(), width), unit(have["vec"].tolist(), width)
        limit = reach + have["error"].to_numpy() + 1e-9
        a, b = [], []
        for at in range(0, len(x), 256):
            part = slice(at, at + 256)
            near = table_distances(model, own, x[part], codes) <= limit
            near &= ask["dims"].to_numpy()[part, None] == have["dims"].to_numpy()
            near &= ask["cid"].to_numpy()[part, None] != have["cid"].to_numpy()
            rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
            cosine = x[at + rows] @ y[columns].T
            one, two = np.nonzero(near[np.ix_(rows, columns)] & (cosine >= least))
            a.append(at + rows[one])
            b.append(columns[two])
        a, b = np.concatenate(a), np.concatenate(b)
        if not a.size:
            return none
        # pairs of one list come up from both sides, pairs with a visitor only here
        visitor = ~ask["home"].to_numpy()[a]
        ids, flat = np.unique(np.concatenate([ask["cid"], have["cid"]]), return_inverse=True)
        of_ask, of_have = flat[: len(ask)], flat[len(ask) :]
        links = np.zeros(ids.size, np.int64)
        np.add.at(links, of_ask[a], have["n"].to_numpy()[b])
        np.add.at(links, of_have[b[visitor]], ask["n"].to_numpy()[a[visitor]])
        top = forest(of_ask[a], of_have[b], ids.size)
        some = np.unique(np.concatenate([of_ask[a], of_have[b]]))
        return pd.DataFrame({"cid": ids[some], "links": links[some], "root": ids[top[some]]})

    return (
        homes.union(asking)
        .groupBy("list", "i", "j")
        .applyInPandas(compare, "cid bigint, links bigint, root bigint")
    )


def near_duplicates(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of `vectors` (vec_id, embedding).

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing:
    no links, their own id as component, kept. Vectors of different length don't link. Copies of a
    vector are combined first and link with each other. Rows that repeat a vec_id are vectors of
    their own. An empty table gives an empty result; other columns, labels among them, are not
    read.
    """
    vec = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = ~bad & F.exists("vec", lambda x: x != 0)
    rows = vectors.select("vec_id", vec.alias("vec"))
    rows = rows.withColumn("good", F.coalesce(F.col("vec").isNotNull() & good, F.lit(False)))
    classes = rows.filter("good").groupBy("vec").agg(
        F.min("vec_id").alias("first"), F.count("*").alias("n")
    )
    classes = shared.written(
        classes.select(
            F.monotonically_increasing_id().alias("cid"), "first", "n", F.size("vec").alias("dims"), "vec"
        )
    )
    found = shared.materialise(near_links(classes, least))
    sums = found.groupBy("cid").agg(F.sum("links").alias("links"))
    linked = shared.components(found, "cid", "root")
    of = (
        classes.select("cid", "first", "n", "vec")
        .join(sums, "cid", "left")
        .join(linked.withColumnRenamed("node", "cid"), "cid", "left")
        .withColumn("group", F.coalesce("component", "cid"))
    )
    least_id = of.groupBy("group").agg(F.min("first").alias("component_id"))
    of = of.join(least_id, "group").select(
        "vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"
    )
    # copies of one vector may be many: its side of the join can be split, the other is unique
    out = rows.filter("good").join(of, "vec").select("vec_id", "n_links", "component_id")
    alone = rows.filter("not good").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return out.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op8_quantised(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(shared.read(spark, sf_dir, "embeddings"))


#: The same rule in DuckDB SQL, by brute force.
SQL = """
with recursive valid as (
  select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and len(embedding) > 0
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0
    and len([x for x in embedding if x <> 0]) > 0
), links as (
  select a.vec_id as x, b.vec_id as y from valid a join valid b on a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= 0.95
), reach as (
  select vec_id as x, vec_id as y from valid
  union select r.x, l.y from reach r join links l on r.y = l.x
), least as (select x, min(y) as component_id from reach group by x),
number as (select x, count(*) as n_links from links group by x)
select vec_id, coalesce(n_links, 0) as n_links, coalesce(component_id, vec_id) as component_id,
  vec_id = coalesce(component_id, vec_id) as kept
from embeddings left join least on vec_id = least.x left join number on vec_id = number.x
"""
