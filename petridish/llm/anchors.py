"""Narrowing the search for repeated windows to the places that can hold one, without losing any.

A window is a run of `window` units (bytes or words) of one text. Each window is owned by the least
hash of the `gram`-unit runs in it; neighbours with the same owner form one context. Equal windows
have equal owners wherever they stand, so windows need only be compared within an owner, and an
owner that occurs once has no repeated window. Equal contexts are combined, and what is left of an
owner, its different contexts, goes to one shard with other owners, where the operator's own method
decides each window. An owner with very many different contexts is split: its contexts are owned
anew by longer grams, at last by whole windows, of which equal ones are one context.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from petridish.llm import shared
from petridish.llm.textblocks import blocks, prefix_sums, sliding_min, span_hash

#: Bytes of an owner's different contexts beyond which it is split, and expected bytes in a shard.
OWNER_BYTES, SHARD_BYTES = 384 * 1024, 192 * 1024
SPAN = "struct<a: bigint, b: bigint>"
#: Common grams are looked for in about so many texts; a gram is common if it stands in one of
#: OFTEN of them, and at most MOST grams are sent to the tasks.
SAMPLE, OFTEN, MOST = 4000, 250, 1 << 16

Units = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]
Local = Callable[[list[np.ndarray], list[int]], list[list[tuple[int, int]]]]


@dataclass(frozen=True)
class Rule:
    """What is compared and how.

    units gives the units of a block of texts and where each text's begin. weigh is "count" (a
    window is repeated if it starts twice) or "first" (if it starts at a lower weight). local
    decides the windows of a shard's contexts: spans of repeated window starts for each. With
    demote, grams that a sample of texts shows to be common only own windows without any other, so
    that no common phrase owns a large share of all windows. This moves work and changes no result.
    """

    window: int
    grams: tuple[int, ...]
    units: Units
    kind: str
    weigh: str
    local: Local
    demote: bool = False

    def total(self, w: Column, times: Column) -> Column:
        return F.sum(w * times) if self.weigh == "count" else F.min(w)

    def whole(self, total: Column, own: Column) -> Column:
        """Whether all windows of an occurrence are repeated as its context occurs elsewhere."""
        found = total >= 2 if self.weigh == "count" else total < own
        return F.coalesce(found, F.lit(False))


def contexts(units: np.ndarray, bounds: np.ndarray, window: int, gram: int, common=None):
    """(text, lo, n, owner, digest, many) of the contexts of a block: n window starts from lo on.

    many: the owner's gram stands at several places of the context, so it may repeat itself.
    """
    none = np.zeros(0, np.int64)
    if units.size < window:
        return none, none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)
    sums, width = prefix_sums(units), window - gram + 1
    at = np.arange(units.size - gram + 1)
    hashes = span_hash(sums, at, at + gram)
    if common is not None:  # sorted hashes of grams that rank behind all others
        near = np.minimum(np.searchsorted(common, hashes), max(common.size - 1, 0))
        behind = common[near] == hashes if common.size else np.zeros(hashes.size, bool)
        hashes = (hashes >> np.uint64(1)) | (behind.astype(np.uint64) << np.uint64(63))
    owner = sliding_min(hashes, width)
    text = np.repeat(np.arange(bounds.size - 1), np.diff(bounds))[: owner.size]
    valid = np.arange(owner.size) + window <= bounds[1:][text]
    new = np.ones(owner.size, bool)
    new[1:] = (owner[1:] != owner[:-1]) | (text[1:] != text[:-1]) | (valid[1:] != valid[:-1])
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], owner.size)
    good = valid[lo]
    lo, hi = lo[good], hi[good]
    if gram == window:  # a run of equal windows is one window several times
        return text[lo], lo, hi - lo, owner[lo], owner[lo], hi - lo > 1
    # places of the gram before the last window's start begin a window; the rest are in that window
    begins = np.concatenate([[0], np.cumsum(hashes[: owner.size] == owner)])
    places = begins[hi - 1] - begins[lo]
    for i in range(0, lo.size, 1024):
        inside = hashes[hi[i : i + 1024, None] - 1 + np.arange(width)]
        places[i : i + 1024] += (inside == owner[lo[i : i + 1024], None]).sum(axis=1)
    digest = span_hash(sums, lo, hi - 1 + window)
    return text[lo], lo, hi - lo, owner[lo], digest, places > 1


def _numbers(*arrays) -> list[pa.Array]:
    return [pa.array(a.view(np.int64) if a.dtype == np.uint64 else a) for a in arrays]


def occurrences(docs: DataFrame, rule: Rule) -> DataFrame:
    """Contexts of all texts: doc_id, tag (of repeated ids), lo, n, owner f, digest c[, many]."""
    counted = rule.weigh == "count"
    common = _common_grams(docs, rule) if rule.demote else None
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            units, bounds = rule.units(batch.column("text"))
            text, lo, n, f, c, many = contexts(
                units, bounds, rule.window, rule.grams[0], common.value if common else None
            )
            own = [batch.column(x).take(pa.array(text)) for x in ("doc_id", "tag")]
            place = [(lo - bounds[text]).astype(np.int32), n.astype(np.int32)]
            yield pa.RecordBatch.from_arrays(
                own + _numbers(*place, f, c, *([many] if counted else [])),
                names=["doc_id", "tag", "lo", "n", "f", "c", *(["many"] if counted else [])],
            )

    given = docs.select("doc_id", tag().alias("tag"), "text")
    schema = f"doc_id {kind}, tag int, lo int, n int, f bigint, c bigint"
    return given.mapInArrow(run, schema + ", many boolean" * counted)


def _common_grams(docs: DataFrame, rule: Rule):
    """Broadcast sorted hashes of the most common grams in a sample of texts, MOST at most."""
    rate = max(1, docs.count() // SAMPLE)
    picked = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(rate)) == 0).select("text")
    gram = rule.grams[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            units, bounds = rule.units(batch.column("text"))
            at = np.arange(max(0, units.size - gram + 1))
            text = np.repeat(np.arange(bounds.size - 1), np.diff(bounds))[: at.size]
            found = span_hash(prefix_sums(units), at, at + gram)
            each = np.unique(np.stack([text.astype(np.uint64), found]), axis=1)[1]
            hashes, number = np.unique(each, return_counts=True)
            some = number > 1  # what is common stands in several texts of a block
            yield pa.RecordBatch.from_arrays(
                _numbers(hashes[some], number[some]), names=["gram", "n"]
            )

    counts = picked.mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    most = counts.filter(F.col("n") * OFTEN >= SAMPLE).orderBy(F.col("n").desc(), "gram").limit(MOST)
    found = np.array([r["gram"] for r in most.collect()], np.int64).view(np.uint64)
    return docs.sparkSession.sparkContext.broadcast(np.sort(found))


def tag() -> Column:
    """Tells apart different texts with one doc_id."""
    return F.hash("text")


def _bodies_of_texts(docs: DataFrame, wanted: DataFrame, rule: Rule) -> DataFrame:
    """Bodies of contexts, read from the texts; wanted: f, c, total, n, bytes, rep (doc_id, tag, lo)."""
    spots = wanted.select("rep.doc_id", "rep.tag", F.struct("f", "c", "total", "bytes", "n", "rep.lo").alias("x"))
    spots = spots.groupBy("doc_id", "tag").agg(F.collect_list("x").alias("spots"))
    texts = docs.select("doc_id", tag().alias("tag"), "text")
    joined = _same_row(texts, spots).select("text", "spots")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            units, bounds = rule.units(batch.column("text"))
            raw = units.astype(rule.kind, copy=False)
            rows = []
            for i, spots in enumerate(batch.column("spots").to_pylist()):
                for x in spots:
                    at = bounds[i] + x["lo"]
                    body = raw[at : at + x["n"] - 1 + rule.window].tobytes()
                    rows.append((x["f"], x["c"], x["total"], x["bytes"], body))
            columns = list(zip(*rows)) if rows else [[], [], [], [], []]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(columns, kinds)], names=["f", "c", "total", "bytes", "body"]
            )

    found = joined.mapInArrow(run, "f bigint, c bigint, total bigint, bytes bigint, body binary")
    return found.dropDuplicates(["f", "c"])  # a repeated row gives its bodies again


def _same_row(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join rows of a document; a null id is an id here."""
    right = right.withColumnRenamed("doc_id", "_id").withColumnRenamed("tag", "_tag")
    same = left.doc_id.eqNullSafe(right["_id"]) & (left.tag == right["_tag"])
    return left.join(right, same, how).drop("_id", "_tag")


def _inner_occurrences(bodies: DataFrame, rule: Rule, gram: int) -> DataFrame:
    """Contexts of contexts under a longer gram: pf, pc (the parent), w, lo, n, f, c, body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                own = [np.frombuffer(x.as_py(), rule.kind) for x in part.column("body")]
                bounds = np.concatenate([[0], np.cumsum([x.size for x in own])])
                units = np.concatenate(own)
                text, lo, n, f, c, many = contexts(units, bounds, rule.window, gram)
                inner = gram < rule.window  # bodies of single windows are not needed
                bodies = [
                    units[a : a + m - 1 + rule.window].tobytes() if inner else b""
                    for a, m in zip(lo.tolist(), n.tolist())
                ]
                named = [part.column(x).take(pa.array(text)) for x in ("f", "c", "total")]
                yield pa.RecordBatch.from_arrays(
                    named
                    + _numbers(lo - bounds[text], n, f, c, many)
                    + [pa.array(bodies, pa.binary())],
                    names=["pf", "pc", "w", "lo", "n", "f", "c", "many", "body"],
                )

    return bodies.select("f", "c", "total", "body").mapInArrow(
        run,
        "pf bigint, pc bigint, w bigint, lo bigint, n bigint, f bigint, c bigint, many boolean, "
        "body binary",
    )


def _shards(bodies: DataFrame, rule: Rule, size: int) -> DataFrame:
    """(f, c, spans): repeated window starts of each context, decided shard by shard."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["f", "c"])
        own = [np.frombuffer(x, rule.kind) for x in group["body"]]
        found = rule.local(own, group["total"].tolist())
        spans = [[{"a": int(a), "b": int(b)} for a, b in x] for x in found]
        return pd.DataFrame({"f": group["f"], "c": group["c"], "spans": spans})

    shards = shared.shard_count(size, SHARD_BYTES)
    return (
        bodies.withColumn("shard", F.pmod(F.xxhash64("f", F.lit(13)), F.lit(shards)))
        .groupBy("shard")
        .applyInPandas(run, f"f bigint, c bigint, spans array<{SPAN}>")
    )


def repeated(docs: DataFrame, rule: Rule, weight: Column) -> DataFrame:
    """(doc_id, tag, a, b): spans of window starts whose windows are repeated, by the rule."""
    refs = ["doc_id", "tag"]
    found = _decide(
        occurrences(docs, rule), refs, rule, 0, lambda wanted: _bodies_of_texts(docs, wanted, rule), weight
    )
    return found.select(*refs, "a", "b")


def _decide(
    occ: DataFrame, refs: list[str], rule: Rule, level: int, fetch, weight: Column
) -> DataFrame:
    """Spans of repeated window starts (refs, a, b) of occurrences (refs, lo, n, f, c[, many])."""
    if rule.weigh == "count":
        owners = occ.groupBy("f").agg(F.count("*").alias("k"), F.max("many").alias("many"))
        again = (F.col("k") >= 2) | F.col("many")
    else:
        owners = occ.groupBy("f").agg(F.min(weight).alias("least"), F.max(weight).alias("most"))
        again = F.col("least") < F.col("most")
    kept = shared.written(occ.join(owners.filter(again).select("f"), "f"))
    many = F.col("many") if rule.weigh == "count" else F.lit(False)
    kept = kept.withColumn("w", weight.cast("long")).withColumn("many", many)
    last = rule.grams[level] == rule.window
    rep = F.min(F.struct(*refs, "lo")).alias("rep")
    body = [F.first("body").alias("body")] if level else []
    groups = kept.groupBy("f", "c").agg(
        rule.total(F.col("w"), F.col("n") if last else F.lit(1)).alias("total"),
        F.max("n").alias("n"),
        F.max("many").alias("many"),
        rep,
        *body,
    )
    if last:  # equal windows are one context
        decided = groups.select("f", "c", "total", F.lit(None).cast(f"array<{SPAN}>").alias("spans"))
    else:
        groups = shared.written(groups)
        width = np.dtype(rule.kind).itemsize
        kinds = groups.groupBy("f").agg(
            F.count("*").alias("kinds"),
            F.max("many").alias("many"),
            (F.sum(F.col("n") + (rule.window - 1)) * width).alias("bytes"),
        )
        # contexts of one kind can only repeat themselves, which matters if starts are counted
        kinds = kinds.filter(f"kinds > 1 or many and '{rule.weigh}' = 'count'").select("f", "bytes")
        wanted = groups.join(kinds, "f")
        bodies = shared.written(
            fetch(wanted) if not level else wanted.select("f", "c", "total", "bytes", "body")
        )
        calm, hot = bodies.filter(F.col("bytes") <= OWNER_BYTES), bodies.filter(F.col("bytes") > OWNER_BYTES)
        size = calm.agg(F.sum(F.length("body"))).first()[0] or 0
        spans = _shards(calm.drop("bytes"), rule, size)
        if not hot.isEmpty():
            spans = spans.union(_split_owners(hot, rule, level + 1, fetch))
        decided = groups.select("f", "c", "total").join(shared.written(spans), ["f", "c"], "left")
    lo, n = F.col("lo").cast("long"), F.col("n").cast("long")
    all_of = F.array(F.struct(lo.alias("a"), (lo + n).alias("b")))
    moved = F.transform("spans", lambda x: F.struct((x["a"] + lo).alias("a"), (x["b"] + lo).alias("b")))
    return (
        kept.join(decided, ["f", "c"])
        .select(*refs, F.explode(F.when(rule.whole(F.col("total"), F.col("w")), all_of).otherwise(moved)).alias("x"))
        .select(*refs, "x.a", "x.b")
    )


def _split_owners(hot: DataFrame, rule: Rule, level: int, fetch) -> DataFrame:
    """(f, c, spans): repeated window starts of the contexts of owners that are split."""
    if rule.weigh == "count":
        return _rest_of(hot, _lone_starts(hot, rule, level), rule)
    inner = _inner_occurrences(hot, rule, rule.grams[level])
    more = _decide(inner, ["pf", "pc"], rule, level, fetch, F.col("w"))
    more = more.groupBy("pf", "pc").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    return more.select("pf", "pc", _merged(F.array_sort("spans")))


def _lone_starts(bodies: DataFrame, rule: Rule, level: int) -> DataFrame:
    """(pf, pc, a, b): the window starts of contexts whose windows start nowhere else.

    A window that starts once has one place, which is known when equal windows are counted. So no
    window is joined back to all its places, however many have it.
    """
    inner = _inner_occurrences(bodies, rule, rule.grams[level])
    last = rule.grams[level] == rule.window
    # of what occurs once, the least place is the place
    place = [F.min(x).alias(x) for x in ("pf", "pc", "lo")]
    sums = [
        F.sum(F.col("w") * (F.col("n") if last else F.lit(1))).alias("total"),
        F.max("n").cast("long").alias("n"),
        *place,
    ]
    once = ("pf", "pc", F.col("lo").alias("a"), (F.col("lo") + F.col("n")).alias("b"))
    if last:
        return inner.groupBy("c").agg(*sums).filter("total = 1").select(*once)
    groups = inner.groupBy("f", "c").agg(
        *sums, F.count("*").alias("k"), F.max("many").alias("many"), F.first("body").alias("body")
    )
    groups = shared.written(groups)
    width = np.dtype(rule.kind).itemsize
    owners = groups.groupBy("f").agg(
        ((F.sum("k") > 1) | F.max("many")).alias("again"),
        ((F.count("*") > 1) | F.max("many")).alias("several"),
        (F.sum(F.col("n") + (rule.window - 1)) * width).alias("bytes"),
    )
    owners = shared.written(owners.filter("again"))
    alone = groups.filter("total = 1").join(owners.select("f"), "f", "left_anti").select(*once)
    wanted = shared.written(
        groups.select("f", "c", "total", "body").join(owners.filter("several").select("f", "bytes"), "f")
    )
    calm, hot = wanted.filter(F.col("bytes") <= OWNER_BYTES), wanted.filter(F.col("bytes") > OWNER_BYTES)
    size = calm.agg(F.sum(F.length("body"))).first()[0] or 0
    spans = _shards(calm.drop("bytes"), rule, size)
    if not hot.isEmpty():
        spans = spans.union(_split_owners(hot, rule, level + 1, None))
    places = groups.filter("total = 1").select("f", "c", "n", "pf", "pc", "lo")
    left = places.join(spans, ["f", "c"]).select(
        "pf", "pc", "lo", F.explode(_rest(F.col("spans"), F.col("n"))).alias("x")
    )
    return alone.union(left.select("pf", "pc", F.col("lo") + F.col("x.a"), F.col("lo") + F.col("x.b")))


def _rest_of(bodies: DataFrame, lone: DataFrame, rule: Rule) -> DataFrame:
    """(f, c, spans): the window starts of contexts that aren't among the lone ones."""
    lists = lone.groupBy("pf", "pc").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("lone"))
    lists = lists.toDF("f", "c", "lone")
    n = F.expr(f"length(body) div {np.dtype(rule.kind).itemsize}") - (rule.window - 1)
    own = bodies.select("f", "c", n.cast("long").alias("n"))
    return own.join(lists, ["f", "c"], "left").select("f", "c", _rest(F.col("lone"), F.col("n")).alias("spans"))


def _rest(spans: Column, n: Column) -> Column:
    """The spans between these, which are sorted and apart, and up to n."""
    none = F.array().cast(f"array<{SPAN}>")
    spans = F.coalesce(spans, none)
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda x: x["b"].cast("long")))
    ends = F.concat(F.transform(spans, lambda x: x["a"].cast("long")), F.array(n.cast("long")))
    between = F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.filter(between, lambda x: x["a"] < x["b"]).cast(f"array<{SPAN}>")


def _merged(spans: Column) -> Column:
    """Spans that touch or overlap made one; they must be sorted."""

    def add(have: Column, x: Column) -> Column:
        last = F.try_element_at(have, F.lit(-1))
        longer = F.struct(last["a"].alias("a"), F.greatest(last["b"], x["b"]).alias("b"))
        return F.when(
            (F.size(have) > 0) & (last["b"] >= x["a"]),
            F.concat(F.slice(have, F.lit(1), F.size(have) - 1), F.array(longer)),
        ).otherwise(F.concat(have, F.array(x)))

    return F.aggregate(spans, F.array().cast(f"array<{SPAN}>"), add)


def with_spans(docs: DataFrame, spans: DataFrame, carry: list[str]) -> DataFrame:
    """(row, doc_id, text, spans): each document with its spans of repeated window starts."""
    lists = spans.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    left = docs.select(
        "doc_id", tag().alias("tag"), "text", *([F.struct(*carry).alias("row")] if carry else [])
    )
    return _same_row(left, lists, "left").drop("tag")


def covered(batch: pa.RecordBatch, bounds: np.ndarray, window: int, size: int) -> np.ndarray:
    """Whether each unit of a block is in a repeated window."""
    steps = np.zeros(size + 1, np.int64)
    spans = batch.column("spans")
    number = pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(spans)  # leaves out null lists
    base = np.repeat(bounds[:-1], number)
    np.add.at(steps, base + pc.struct_field(flat, "a").to_numpy(zero_copy_only=False), 1)
    ends = base + pc.struct_field(flat, "b").to_numpy(zero_copy_only=False) - 1 + window
    np.add.at(steps, ends, -1)
    return np.cumsum(steps)[:-1] > 0


def runs_of(mask: np.ndarray, bounds: np.ndarray):
    """Maximal runs (start, end) of true units that don't cross texts, and each text's first run."""
    before, after = np.empty_like(mask), np.empty_like(mask)
    before[1:], after[:-1] = mask[:-1], mask[1:]
    if mask.size:
        before[0] = after[-1] = False
    before[bounds[:-1][bounds[:-1] < mask.size]] = False
    after[bounds[1:][bounds[1:] > 0] - 1] = False
    starts = np.flatnonzero(mask & ~before)
    return starts, np.flatnonzero(mask & ~after) + 1, np.searchsorted(starts, bounds)


def span_lists(starts, ends, first, bounds) -> pa.Array:
    """Each text's runs as a list of (a, b), counted from the text's start."""
    base = np.repeat(bounds[:-1], np.diff(first))
    pairs = pa.StructArray.from_arrays(
        [pa.array(starts - base), pa.array(ends - base)], names=["a", "b"]
    )
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pairs)
