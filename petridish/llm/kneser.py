"""Scores of texts under an interpolated modified Kneser-Ney model of word pairs.

Each block of documents sends its distinct word pairs, with how often the training documents among
its own have them, to shards by pair hash, as cells (see `cells`). A shard adds them up to a table of
sorted hashes and counts, keeps it in a scratch file that its worker maps into memory, and looks up
the pairs of each block there. What the smoothing needs of each word (followers by count, different
predecessors) is added up per word in the same way, and each block puts the scores of its documents
together from the answers. Pairs and words are told apart by 64-bit hashes.

The model: p(w | u) = (max(c(uw) - D(c(uw)), 0) + g(u) p(w)) / c(u.), where c(u.) is the number of
tokens after u, g(u) = D1 n1(u) + D2 n2(u) + D3 n3+(u), and p(w) does the same with the numbers of
different predecessors over a uniform share of 1 / (V + 1). u is the word before or the text's begin.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from petridish.llm import cells, shared
from petridish.llm.language import held_out
from petridish.llm.textblocks import (
    LOWER_ASCII,
    NOT_SPACE,
    blocks,
    mix,
    prefix_sums,
    span_hash,
    text_buffer,
    word_spans,
)

#: Bytes of text that are hashed at once, and bytes whose documents look up their pairs together.
PIECE, BLOCK = 1 << 20, 8 << 20
#: Hashes that stand for the end of a text, a token, and for its begin, which is only a context.
END, BEGIN = np.uint64(0x452821E638D01377), np.uint64(0xBE5466CF34E90C6C)
#: Discounts where a corpus is too small to estimate them.
USUAL = (0.5, 1.0, 1.5)
#: What is known of a word: training tokens, tokens after it, followers seen once, twice, more often,
#: different predecessors.
VALUES = ("tokens", "after", "once", "twice", "more", "before")


def pair_hash(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(mix(u) * np.uint64(0x9E3779B97F4A7C15) + w)


def discounts(counts: list[int]) -> np.ndarray:
    """What is taken off counts of 0, 1, 2 and 3 or more, from the numbers of counts 1 to 4."""
    n1, n2, n3, n4 = counts
    if not (n1 and n2 and n3):
        return np.array([0.0, *USUAL])
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0.0, *(min(max(d, 0.0), k) for d, k in zip(found, (1, 2, 3)))])


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, one after the other, and the number of tokens of each."""
    data, offsets = text_buffer(column)
    lower = LOWER_ASCII[data]
    starts, ends, first = word_spans(lower, offsets, NOT_SPACE)
    rows = len(column)
    out = np.full(starts.size + rows, END, np.uint64)
    sizes = np.diff(first)
    out[np.arange(starts.size) + np.repeat(np.arange(rows), sizes)] = span_hash(prefix_sums(lower), starts, ends)
    return out, sizes + 1


class Pairs:
    """Distinct (word before, word) pairs of a block; `words` are its distinct hashes, begin included."""

    def __init__(self, words: np.ndarray, sequence: np.ndarray, sizes: np.ndarray):
        before = np.empty_like(sequence)
        before[1:] = sequence[:-1]
        before[np.cumsum(sizes) - sizes] = np.searchsorted(words, BEGIN)
        keys, self.at = np.unique(before * words.size + sequence, return_inverse=True)
        self.u, self.w = np.divmod(keys, words.size)
        self.hashes = pair_hash(words[self.u], words[self.w])


def _listed(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _block(number: int, rows: list[pa.RecordBatch], flat: list[np.ndarray], sizes: list[np.ndarray]) -> pa.RecordBatch:
    """A block: its documents, its distinct words, and its tokens as places among them."""
    words, sequence = np.unique(np.concatenate([*flat, [BEGIN]]), return_inverse=True)
    sequence, sizes = sequence[:-1], np.concatenate(sizes)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([number]), *(_listed(pa.concat_arrays([r.column(c) for r in rows])) for c in ("doc_id", "held_out")),
            _listed(pa.array(sizes)), pa.array([cells.pack(words, True)], pa.binary()), *_packed([sequence]),
            pa.array([sequence.size]), pa.array([words.size]),
        ],
        names=["block", "doc_id", "held_out", "n_tokens", "words", "sequence", "tokens", "different"],
    )


def _packed(*columns: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array([cells.pack(x) for x in column], pa.binary()) for column in columns]


def _mapped(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two arrays from a scratch file without a name, mapped into memory."""
    if not hashes.size:
        return hashes, counts
    with tempfile.TemporaryFile() as scratch:
        hashes.tofile(scratch)
        counts.astype(np.uint64).tofile(scratch)
        scratch.flush()
        both = np.memmap(scratch, np.uint64, "r", shape=(2, hashes.size))
    return both[0], both[1]


def look_up(table: tuple[np.ndarray, np.ndarray], hashes: np.ndarray) -> np.ndarray:
    """Count of each hash, 0 if the table hasn't got it."""
    have, counts = table
    if not have.size:
        return np.zeros(hashes.size, np.uint64)
    at = np.minimum(np.searchsorted(have, hashes), have.size - 1)
    return np.where(have[at] == hashes, counts[at], 0)


_LONGS = ", ".join(f"{n} binary" for n in VALUES)


def _deal_pairs(shards: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                words, sequence = cells.unpack(row["words"], True), cells.unpack(row["sequence"]).astype(np.int64)
                sizes = np.array(row["n_tokens"], np.int64)
                pairs = Pairs(words, sequence, sizes)
                train = np.repeat(~np.array(row["held_out"], bool), sizes)
                times = np.bincount(pairs.at[train], minlength=pairs.hashes.size)
                parts = cells.split(pairs.hashes, shards)
                own = [np.unique(np.concatenate([pairs.u[p], pairs.w[p]])) for _, p in parts]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([s for s, _ in parts], pa.int32()),
                        pa.array([row["block"]] * len(parts), pa.int64()),
                        pa.array([cells.pack(words[x], True) for x in own], pa.binary()),
                        # pairs are sorted by the word before
                        pa.array([cells.pack(np.searchsorted(x, pairs.u[p]), True) for x, (_, p) in zip(own, parts)], pa.binary()),
                        *_packed([np.searchsorted(x, pairs.w[p]) for x, (_, p) in zip(own, parts)], [times[p] for _, p in parts]),
                    ],
                    names=["shard", "block", "words", "u", "w", "times"],
                )

    return deal


def _count_pairs(word_shards: int):
    """Counts for each block, and per word shard what the shard's pairs tell of words."""

    def count(table: pa.Table) -> pa.Table:
        blocks_of, shard = table.column("block").to_pylist(), table.column("shard")[0].as_py()
        blob = lambda name, i: table.column(name)[i].as_py()
        words = np.unique(np.concatenate([cells.unpack(blob("words", i), True) for i in range(table.num_rows)]))
        # the pairs of all cells, their words as places among `words`
        own, each = [], []
        for i in range(table.num_rows):
            at = np.searchsorted(words, cells.unpack(blob("words", i), True)).astype(np.int32)
            u, w = at[cells.unpack(blob("u", i), True)], at[cells.unpack(blob("w", i))]
            own.append((pair_hash(words[u], words[w]), u, w, cells.unpack(blob("times", i)).astype(np.int32)))
            each.append(own[-1][0])
        hashes, u, w, times = (np.concatenate(x) for x in zip(*own))
        del own
        order = np.argsort(hashes)
        opens = np.flatnonzero(np.diff(hashes[order], prepend=~hashes[order[:1]]))
        counts = np.add.reduceat(times[order].astype(np.int64), opens)
        first = order[opens]
        del order, times
        seen = counts > 0
        first, counts = first[seen], counts[seen]
        model = _mapped(hashes[first], counts)
        u, w = u[first], w[first]
        del hashes, first, seen
        answers = [cells.pack(look_up(model, x)) for x in each]
        by = lambda at, values: np.bincount(at, values, words.size).astype(np.int64)
        told = {
            "after": by(u, counts), "once": by(u, counts == 1), "twice": by(u, counts == 2),
            "more": by(u, counts > 2), "before": np.bincount(w, minlength=words.size),
        }
        known = np.flatnonzero((told["after"] > 0) | (told["before"] > 0))
        words, told = words[known], {k: v[known] for k, v in told.items()}
        parts = cells.split(words, word_shards)
        none, n = [None] * len(answers), len(parts)
        return pa.table({
            "shard": pa.array([shard] * len(answers) + [s for s, _ in parts], pa.int32()),
            "block": pa.array(blocks_of + [None] * n, pa.int64()),
            "words": pa.array(none + [cells.pack(words[p], True) for _, p in parts], pa.binary()),
            "tokens": pa.array(answers + [None] * n, pa.binary()),
            **{k: pa.array(none + [cells.pack(v[p]) for _, p in parts], pa.binary()) for k, v in told.items()},
            # numbers of pairs by count, once per shard
            "of_counts": pa.array([[int((counts == k).sum()) for k in (1, 2, 3, 4)]] + [None] * (len(answers) + n - 1), pa.list_(pa.int64())),
        })

    return count


def _deal_words(shards: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                words, sequence = cells.unpack(row["words"], True), cells.unpack(row["sequence"]).astype(np.int64)
                train = np.repeat(~np.array(row["held_out"], bool), np.array(row["n_tokens"], np.int64))
                times = np.bincount(sequence[train], minlength=words.size)
                parts = cells.split(words, shards)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([s for s, _ in parts], pa.int32()),
                        pa.array([row["block"]] * len(parts), pa.int64()),
                        pa.array([cells.pack(words[p], True) for _, p in parts], pa.binary()),
                        *_packed([times[p] for _, p in parts]),
                        *[pa.nulls(len(parts), pa.binary())] * (len(VALUES) - 1),
                    ],
                    names=["shard", "block", "words", *VALUES],
                )

    return deal


def _count_words(table: pa.Table) -> pa.Table:
    """Values of the words of each block, and the sums over the words of this shard."""
    blob = lambda name, i: table.column(name)[i].as_py()
    block, rows = table.column("block").to_pylist(), range(table.num_rows)
    words = np.unique(np.concatenate([cells.unpack(blob("words", i), True) for i in rows]))
    places = [np.searchsorted(words, cells.unpack(blob("words", i), True)).astype(np.int32) for i in rows]
    to = [i for i in rows if block[i] is not None]
    out, total = {}, {}
    for n in VALUES:
        value = np.zeros(words.size, np.int64)
        for i in rows:
            packed = blob(n, i)
            if packed is not None:
                value[places[i]] += cells.unpack(packed).astype(np.int64)  # a row has a word once
        out[n] = pa.array([cells.pack(value[places[i]]) for i in to] + [None], pa.binary())
        if n in ("tokens", "before"):
            total[n] = value
    before = total["before"]
    whole = [total["tokens"].sum(), (total["tokens"] > 0).sum(), before.sum(), *((before == k).sum() for k in (1, 2, 3, 4)), (before > 2).sum()]
    return pa.table({
        "shard": pa.array([table.column("shard")[0].as_py()] * (len(to) + 1), pa.int32()),
        "block": pa.array([block[i] for i in to] + [None], pa.int64()),
        **out,
        "whole": pa.array([None] * len(to) + [[int(x) for x in whole]], pa.list_(pa.int64())),
    })


def _finish(pair_shards: int, word_shards: int, of_counts: list[int], whole: list[int]):
    train_tokens, known, pairs_total, *of_before, more_before = whole
    off, off_before = discounts(of_counts), discounts(of_before)
    spread = float(off_before[1:] @ [of_before[0], of_before[1], more_before])

    def finish(block: pa.Table, answers: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        words, sequence = cells.unpack(row["words"], True), cells.unpack(row["sequence"]).astype(np.int64)
        sizes = np.array(row["n_tokens"], np.int64)
        pairs = Pairs(words, sequence, sizes)
        got = {(r["pairs"], r["shard"]): r for r in answers.to_pylist()}
        of = {n: np.zeros(words.size) for n in VALUES}
        for shard, places in cells.split(words, word_shards):
            for n in VALUES:
                of[n][places] = cells.unpack(got[False, shard][n])
        count = np.zeros(pairs.hashes.size, np.int64)
        for shard, places in cells.split(pairs.hashes, pair_shards):
            count[places] = cells.unpack(got[True, shard]["tokens"])
        before = of["before"]
        single = np.full(words.size, 1 / (known + 1))
        if pairs_total:
            single = (before - off_before[np.minimum(before, 3).astype(int)] + spread * single) / pairs_total
        left = off[1] * of["once"] + off[2] * of["twice"] + off[3] * of["more"]
        after = of["after"][pairs.u]
        both = count - off[np.minimum(count, 3)] + left[pairs.u] * single[pairs.w]
        chance = np.where(after > 0, both / np.maximum(after, 1), single[pairs.w])
        starts = np.cumsum(sizes) - sizes
        add = lambda values: np.add.reduceat(values, starts)
        score = add(np.log10(chance)[pairs.at])
        return pa.table({
            "doc_id": block.column("doc_id").combine_chunks().flatten(),
            "held_out": pa.array(row["held_out"]),
            "n_tokens": sizes,
            "n_known": add((of["tokens"] > 0).astype(np.int64)[sequence]),
            "train_tokens": np.full(sizes.size, train_tokens),
            "base_score": add(np.log10((of["tokens"] + 1) / (train_tokens + known + 1))[sequence]),
            "score": score,
            "perplexity": 10 ** (-score / sizes),
        })

    return finish


def score(docs: DataFrame, held: Column) -> DataFrame:
    """One row per document: its log10 probability under a model of the documents not `held`.

    Also n_tokens (words and one end), n_known (tokens that the training documents have),
    train_tokens, base_score (add-one estimate of single tokens) and the perplexity of a token. Null
    and empty texts are an end alone. A null `held` counts as false. Repeated rows are documents of
    their own. Without training documents every token has the same chance of 1; an empty table gives
    an empty result. Other columns are not read. Where counts of 1, 2 or 3 are missing, USUAL stands
    for the estimated discounts.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    given = docs.select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows, flat, sizes, size = cells.numbers(), [], [], [], 0
        for batch in blocks(batches, limit=PIECE):
            own, each = tokens(batch.column("text"))
            rows.append(batch.select(["doc_id", "held_out"]))
            flat.append(own)
            sizes.append(each)
            size += int(text_buffer(batch.column("text"))[1][-1])
            if size >= BLOCK:
                yield _block(next(number), rows, flat, sizes)
                rows, flat, sizes, size = [], [], [], 0
        if rows:
            yield _block(next(number), rows, flat, sizes)

    schema = f"block bigint, doc_id array<{kind}>, held_out array<boolean>, n_tokens array<bigint>, words binary, sequence binary, tokens bigint, different bigint"
    state = shared.written(given.mapInArrow(run, schema))
    # words come from the blocks and again from the shards of pairs
    pair_shards, word_shards = cells.shards_for(state, "tokens"), cells.shards_for(state, "different", 4)
    kept = state.select("block", "doc_id", "held_out", "n_tokens", "words", "sequence")
    sent = kept.drop("doc_id")
    pairs = sent.mapInArrow(_deal_pairs(pair_shards), "shard int, block bigint, words binary, u binary, w binary, times binary")
    counted = shared.written(
        pairs.groupBy("shard").applyInArrow(
            _count_pairs(word_shards), f"shard int, block bigint, words binary, {_LONGS}, of_counts array<bigint>"
        )
    )
    word_cells = sent.mapInArrow(_deal_words(word_shards), f"shard int, block bigint, words binary, {_LONGS}")
    told = counted.filter("block is null").select("shard", "block", "words", *VALUES)
    known = shared.written(
        word_cells.union(told)
        .groupBy("shard")
        .applyInArrow(_count_words, f"shard int, block bigint, {_LONGS}, whole array<bigint>")
    )
    total = lambda df, c, n: [x or 0 for x in df.agg(*(F.sum(F.col(c)[i]) for i in range(n))).first()]
    finish = _finish(pair_shards, word_shards, total(counted, "of_counts", 4), total(known, "whole", 8))
    some = F.col("block").isNotNull()
    answers = counted.filter(some).select(F.lit(True).alias("pairs"), "shard", "block", *VALUES)
    answers = answers.union(known.filter(some).select(F.lit(False), "shard", "block", *VALUES))
    out = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double"
    return kept.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, out)


def op11_kneser(spark, sf_dir: str) -> DataFrame:
    return score(shared.read(spark, sf_dir, "documents"), held_out("doc_id", 7, 2))
