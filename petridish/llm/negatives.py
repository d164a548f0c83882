"""Hard negatives: for each anchor and positive, near rows of other labels in a window of scores.

Anchors and candidates are dealt to a grid of tiles. The integer inner products of a tile come from
Strassen's recursive multiplication, filled up with zeros; its additions are exact in whole numbers.
A first pass keeps a heap of the best positives of each anchor, a second one, which knows the
positives' scores, a heap of the best candidates in each window. The heaps of the tiles are merged by
Spark, which keeps the first few of each key before and after the shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from petridish.llm import shared

#: Rows of a tile, as expected; tiles grow in number with the data, not in size.
ANCHORS, CANDIDATES = 2048, 1024
#: Multiplications with a side of this length or less are done directly.
LEAF = 32
NONE = np.iinfo(np.int64).min
#: Squared lengths of quantised vectors stay below this, so every score and sum fits a long.
LONGEST = float(1 << 62)


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of two int64 matrices; sums wrap, so it is exact wherever the true value fits."""
    (n, k), m = a.shape, b.shape[1]
    if min(n, k, m) <= LEAF:
        return a @ b
    half = [-(-x // 2) for x in (n, k, m)]
    a = np.pad(a, ((0, 2 * half[0] - n), (0, 2 * half[1] - k)))
    b = np.pad(b, ((0, 2 * half[1] - k), (0, 2 * half[2] - m)))
    (a11, a12), (a21, a22) = ((x[:, : half[1]], x[:, half[1] :]) for x in (a[: half[0]], a[half[0] :]))
    (b11, b12), (b21, b22) = ((x[:, : half[2]], x[:, half[2] :]) for x in (b[: half[1]], b[half[1] :]))
    p1 = strassen(a11 + a22, b11 + b22)
    p2 = strassen(a21 + a22, b11)
    p3 = strassen(a11, b12 - b22)
    p4 = strassen(a22, b21 - b11)
    p5 = strassen(a11 + a12, b22)
    p6 = strassen(a21 - a11, b11 + b12)
    p7 = strassen(a12 - a22, b21 + b22)
    out = np.empty((2 * half[0], 2 * half[2]), np.int64)
    out[: half[0], : half[2]] = p1 + p4 - p5 + p7
    out[: half[0], half[2] :] = p3 + p5
    out[half[0] :, : half[2]] = p2 + p4
    out[half[0] :, half[2] :] = p1 - p2 + p3 + p6
    return out[:n, :m]


def heap(scores: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the `size` best entries of each row, ties to the first; NONE is no entry."""
    rows, found = np.arange(len(scores)), []
    for _ in range(min(size, scores.shape[1])):
        best = scores.argmax(axis=1)
        some = np.flatnonzero(scores[rows, best] > NONE)
        if not some.size:
            break
        found.append((some, best[some]))
        scores[rows, best] = NONE
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


class _Side:
    """The rows of a tile, candidates in the order in which ties are broken."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        self.table = table.take(
            pa.compute.sort_indices(table, sort_keys=[("vec_id", "ascending"), ("rid", "ascending")], null_placement="at_end")
        )
        self.rid = self.table.column("rid").to_numpy()
        self.ids = self.table.column("vec_id")
        lists = self.table.column("q").combine_chunks()
        self.sizes = np.diff(lists.offsets.to_numpy())
        self.flat = lists.flatten().to_numpy()

    def matrix(self, width: int) -> np.ndarray:
        out = np.zeros((len(self.rid), width), np.int64)
        out[np.arange(width) < self.sizes[:, None]] = self.flat
        return out


def _tile(anchors: pa.Table, candidates: pa.Table) -> tuple[_Side, _Side, list[np.ndarray], list[np.ndarray]]:
    """Both sides, their matrices, and their labels as common codes."""
    sides = [_Side(anchors), _Side(candidates)]
    width = max(1, *(int(s.sizes.max(initial=0)) for s in sides))
    codes, _ = pd.factorize(np.concatenate([s.table.column("label").to_numpy() for s in sides]))
    return *sides, [s.matrix(width) for s in sides], np.split(codes, [len(sides[0].rid)])


def best_positives(size: int):
    def run(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        out = []
        if anchors.num_rows and candidates.num_rows:
            a, c, (x, y), (of_a, of_c) = _tile(anchors, candidates)
            for code in np.unique(of_a):
                rows, columns = np.flatnonzero(of_a == code), np.flatnonzero(of_c == code)
                if not columns.size:
                    continue
                scores = strassen(x[rows], np.ascontiguousarray(y[columns].T))
                kept = scores.copy()
                kept[a.rid[rows, None] == c.rid[columns]] = NONE
                row, column = heap(kept, size)
                out.append((rows[row], columns[column], scores[row, column]))
        if not out:
            return pa.table({n: [] for n in ("anchor", "positive", "positive_id", "positive_score")}, schema=None).cast(
                pa.schema([("anchor", pa.int64()), ("positive", pa.int64()), ("positive_id", candidates.schema.field("vec_id").type), ("positive_score", pa.int64())])
            )
        row, column, score = (np.concatenate(x) for x in zip(*out))
        return pa.table({
            "anchor": a.rid[row], "positive": c.rid[column],
            "positive_id": c.ids.take(pa.array(column)), "positive_score": score,
        })

    return run


def windows(size: int, low: int, high: int):
    """The best of each window: low / 100 to high / 100 of the positive's score."""
    names = ["anchor", "place", "anchor_id", "positive_id", "positive_score", "negative", "negative_id", "negative_score"]

    def run(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        kind = candidates.schema.field("vec_id").type
        kinds = [pa.int64(), pa.int32(), kind, kind, pa.int64(), pa.int64(), kind, pa.int64()]
        out = []
        if anchors.num_rows and candidates.num_rows:
            a, c, (x, y), (of_a, of_c) = _tile(anchors, candidates)
            scores = strassen(x, np.ascontiguousarray(y.T))
            other = of_a[:, None] != of_c
            given = a.table.column("positives").combine_chunks()
            many = np.diff(given.offsets.to_numpy())
            first = np.cumsum(many) - many
            flat = given.flatten()
            ids, of_positive = flat.field("positive_id"), flat.field("positive_score").to_numpy()
            for place in range(int(many.max(initial=0))):
                rows = np.flatnonzero(many > place)
                at = first[rows] + place
                p = of_positive[at]
                # low * p <= 100 * n <= high * p in whole numbers that fit
                least = np.array([-((-low * int(v)) // 100) for v in p], np.int64)[:, None]
                most = np.array([(high * int(v)) // 100 for v in p], np.int64)[:, None]
                own = scores[rows]
                row, column = heap(np.where(other[rows] & (own >= least) & (own <= most), own, NONE), size)
                take = lambda values, i: values.take(pa.array(i))
                out.append([
                    pa.array(a.rid[rows[row]]), pa.array(np.full(row.size, place), pa.int32()),
                    take(a.ids.combine_chunks(), rows[row]), take(ids, at[row]), pa.array(p[row]),
                    pa.array(c.rid[column]), take(c.ids.combine_chunks(), column), pa.array(own[row, column]),
                ])
        schema = pa.schema(list(zip(names, kinds)))
        return pa.concat_tables([schema.empty_table(), *(pa.table(x, schema=schema) for x in out)])

    return run


def first_few(heaps: DataFrame, keys: list[str], other: str, size: int) -> DataFrame:
    """Merged heaps: the first `size` of each key, with their rank."""
    order = Window.partitionBy(*keys).orderBy(F.desc(f"{other}_score"), F.col(f"{other}_id").asc_nulls_last(), other)
    return heaps.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)


def mine(
    vectors: DataFrame,
    anchors: Column,
    label: Column,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    vectors: vec_id, embedding and the columns that `anchors` and `label` read. A row whose label or
    vector is null, or that has a null or non-finite component, takes no part, nor does one whose
    quantised vector is so long (2**31) that scores might not fit a long. Vectors of different length
    are filled up with zeros; empty ones have score 0 with all. Equal scores come by vec_id, null ids
    last. Repeated rows are rows of their own, and a copy of an anchor can be its positive. An anchor
    without positives or without rows in a window gives no rows there; an empty table gives none.
    """
    x = F.col("embedding")
    good = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    given = vectors.filter(x.isNotNull() & good).select(
        "vec_id",
        label.alias("label"),
        F.coalesce(anchors, F.lit(False)).alias("is_anchor"),
        F.transform("embedding", lambda v: F.floor(256 * v.cast("double"))).alias("q"),
    )
    square = F.aggregate("q", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    given = given.filter(F.col("label").isNotNull() & (square < LONGEST))
    rows = shared.written(given.select(F.monotonically_increasing_id().alias("rid"), "*"))
    total, asking = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("is_anchor").cast("int")), F.lit(0))).first()
    down, across = shared.shard_count(asking, ANCHORS), shared.shard_count(total, CANDIDATES)
    spot = lambda n: F.pmod(F.xxhash64("rid"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    names = ["rid", "vec_id", "label", "q"]
    right = rows.select(every(down).alias("i"), spot(across).alias("j"), *names)
    # columns of their own, as the other side comes from the same rows
    right = right.toDF(*right.columns).groupBy("i", "j")
    kind = rows.schema["vec_id"].dataType.simpleString()

    def tiles(frame: DataFrame, more: list[str], run, schema: str) -> DataFrame:
        left = frame.select(spot(down).alias("i"), every(across).alias("j"), *names, *more)
        left = left.toDF(*left.columns)
        return left.groupBy("i", "j").cogroup(right).applyInArrow(run, schema)

    asked = rows.filter("is_anchor")
    near = tiles(
        asked, [], best_positives(positives), f"anchor bigint, positive bigint, positive_id {kind}, positive_score bigint"
    )
    near = first_few(near, ["anchor"], "positive", positives)
    best = F.sort_array(F.collect_list(F.struct("rank", "positive_id", "positive_score")))
    near = near.groupBy("anchor").agg(best.alias("positives")).withColumnRenamed("anchor", "rid")
    found = tiles(
        asked.join(near, "rid"),
        ["positives"],
        windows(negatives, low, high),
        f"anchor bigint, place int, anchor_id {kind}, positive_id {kind}, positive_score bigint, negative bigint, negative_id {kind}, negative_score bigint",
    )
    return first_few(found, ["anchor", "place"], "negative", negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def op13_negatives(spark, sf_dir: str) -> DataFrame:
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(shared.read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, changed)


#: The same rule in DuckDB SQL, by brute force.
SQL = """
with valid as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    [floor(256 * x::double) for x in embedding] as q
  from embeddings
  where label is not null and embedding is not null
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), scores as (
  select a.vec_id as anchor_id, c.vec_id as other, a.label = c.label as same,
    list_inner_product(a.q, c.q)::bigint as score
  from valid a join valid c on a.vec_id <> c.vec_id where a.vec_id % 50 = 0
), positives as (
  select anchor_id, other as positive_id, score as positive_score from scores where same
  qualify row_number() over (partition by anchor_id order by score desc, other) <= 5
)
select anchor_id, positive_id,
  row_number() over (partition by anchor_id, positive_id order by score desc, other)::int as rank,
  other as negative_id, positive_score, score as negative_score
from positives join scores using (anchor_id)
where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify rank <= 3
"""
