"""Alignment of the tokens of two tokenizers over the bytes of each text, by interval coalescing.

All tokens of both sides are sorted by start; the running maximum of their ends closes a group where
a start reaches it, and inside the groups tokens whose byte ranges overlap are linked. How often an
id pair is linked in the corpus is counted by cells (see `cells`): a block of documents sends its
distinct pairs to shards by pair, which add them up and answer each block.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petridish.llm import cells, shared
from petridish.llm.textblocks import blocks, text_buffer

#: Bytes of text that are aligned at once, and documents' bytes that look up their pairs together.
PIECE, BLOCK = 1 << 20, 16 << 20
#: Segments beyond which a worker forgets those it has seen in one block only (and all, if these are
#: fewer than half), and those it encodes at once.
MEMORY, CHUNK = 400_000, 1024
_codecs: dict[int, Codec] = {}


def byte_level() -> dict[str, int]:
    """The byte of each character in which byte-level vocabularies write bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Both tokenizers, with the bytes of each id.

    A text is cut at single spaces between two printable ASCII characters. No pre-token of the byte-level
    side and no piece of the other runs over such a place (`__init__` checks the pieces), so each
    different segment of a block is encoded once, by the libraries, and the ids are those of the
    whole text.
    """

    def __init__(self, tokenizer: str, pieces: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(tokenizer)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        of = byte_level()
        words = self.a.get_vocab()
        self.a_bytes = [b""] * (max(words.values()) + 1)
        for word, i in words.items():
            self.a_bytes[i] = bytes(of[c] for c in word) if all(c in of for c in word) else word.encode()
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            own = bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()
            self.b_bytes.append(own)
            # a space after another character inside a piece would run over a cut
            if not self.b.is_byte(i) and b" " in own.lstrip(b" "):
                raise ValueError(f"piece {i} holds an inner space")
        self.tables = [pa.array(x, pa.large_binary()) for x in (self.a_bytes, self.b_bytes)]
        self.lengths = [np.array([len(w) for w in x], np.int64) for x in (self.a_bytes, self.b_bytes)]
        # decimal ids with what follows them in the text of groups
        written = [f"{i}{end}" for ids, ends in ((self.a_bytes, ",|"), (self.b_bytes, ",;")) for end in ends for i in range(len(ids))]
        self.decimal = pa.array(written, pa.large_string())

        self.places: dict[str, int] = {}
        self.good = self.again = np.zeros(0, bool)
        self.ids = [np.zeros(0, np.int32)] * 2
        self.ends = [np.zeros(1, np.int64)] * 2
        self.waiting: list[tuple[list, np.ndarray]] = []

    def _forget(self) -> None:
        keep = np.flatnonzero(self.again)
        if 2 * keep.size > len(self.places):
            keep = keep[:0]
        names = list(self.places)
        self.places = {names[at]: i for i, at in enumerate(keep.tolist())}
        for side, upto in enumerate(self.ends):
            sizes = np.diff(upto)[keep]
            self.ids[side] = self.ids[side][cells.ragged(upto[keep], sizes)]
            self.ends[side] = np.concatenate([[0], np.cumsum(sizes)])
        self.good, self.again = self.good[keep], np.zeros(keep.size, bool)

    def look_up(self, segments: pa.Array) -> np.ndarray:
        """Place of each of the different segments among those whose ids are known from here on."""
        if len(self.places) > MEMORY:
            self._forget()
        names = segments.to_pylist()
        places = self.places
        found = np.array([places.get(n, -1) for n in names], np.int64)
        new = np.flatnonzero(found < 0)
        self.again[found[found >= 0]] = True
        # segments that follow each other in a text as cuts leave them are encoded as one text
        missing = (names[i] for i in new.tolist())
        plain = np.fromiter((len(n) > 1 and "!" <= n[1] <= "~" and "!" <= n[-1] <= "~" for n in missing), bool, new.size)
        for rows, encode in ((new[plain], self._joined), (new[~plain], self._each)):
            for at in range(0, rows.size, CHUNK):
                own = segments.take(pa.array(rows[at : at + CHUNK]))
                encode(own.to_pylist(), own)
        self._settle()
        found[new] = [places[names[i]] for i in new.tolist()]
        return found

    def _joined(self, names: list[str], segments: pa.Array) -> None:
        """Encode the segments as one text; one by one if the tokens don't give that text back."""
        text = "".join(names)
        byte = np.frombuffer(text.encode(), np.uint8)
        stops = np.cumsum(np.diff(np.frombuffer(segments.buffers()[1], np.int64)[: len(segments) + 1]))
        found = []
        for side, ids in enumerate((self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.b.encode(text[1:]))):
            ids = np.array(ids, np.int32)
            ends = np.cumsum(self.lengths[side][ids])
            at = np.searchsorted(ends, stops)
            if ends[-1] != byte.size or (ends[at] != stops).any() or (self.spelled(side, ids) != byte).any():
                return self._each(names, segments)
            found.append((ids, np.diff(at + 1, prepend=0)))
        self._remember(names, found, np.ones(len(names), bool))

    def _each(self, names: list[str], segments: pa.Array) -> None:
        a = [x.ids for x in self.a.encode_batch_fast(names, add_special_tokens=False)]
        b = self.b.encode([n[1:] for n in names], num_threads=1)
        good, found = np.ones(len(names), bool), []
        for side, lists in enumerate((a, b)):
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            ids = np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum()))
            good &= self.faithful(side, ids, sizes, segments)
            found.append((ids, sizes))
        self._remember(names, found, good)

    def _remember(self, names: list[str], found: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray) -> None:
        self.waiting.append((found, good))
        self.places.update(zip(names, range(len(self.places), len(self.places) + len(names))))

    def _settle(self) -> None:
        """Put the ids that wait behind the others, all at once."""
        if not self.waiting:
            return
        for side in (0, 1):
            ids, sizes = zip(*(found[side] for found, _ in self.waiting))
            self.ids[side] = np.concatenate([self.ids[side], *ids])
            self.ends[side] = np.concatenate([self.ends[side], self.ends[side][-1] + np.cumsum(np.concatenate(sizes))])
        self.good = np.concatenate([self.good, *(good for _, good in self.waiting)])
        self.again = np.concatenate([self.again, np.zeros(self.good.size - self.again.size, bool)])
        self.waiting = []

    def spelled(self, side: int, ids: np.ndarray) -> np.ndarray:
        """Bytes of ids, one after the other."""
        joined = self.tables[side].take(pa.array(ids))
        return np.frombuffer(joined.buffers()[2] or b"", np.uint8)[: int(self.lengths[side][ids].sum())]

    def faithful(self, side: int, ids: np.ndarray, sizes: np.ndarray, segments: pa.Array) -> np.ndarray:
        """Which segments are the joined bytes of their ids."""
        _, where, data = segments.buffers()
        ends = np.frombuffer(where, np.int64)[: len(segments) + 1]
        total = np.concatenate([[0], np.cumsum(self.lengths[side][ids])])
        upto = np.concatenate([[0], np.cumsum(sizes)])
        good = np.diff(total[upto]) == np.diff(ends)
        keep = np.repeat(good, sizes)
        have = self.spelled(side, ids[keep])
        lengths = np.diff(ends)
        own = np.frombuffer(data, np.uint8)[cells.ragged(ends[:-1][good], lengths[good])]
        starts = np.concatenate([[0], np.cumsum(lengths[good])])
        wrong = np.unique(np.searchsorted(starts, np.flatnonzero(have != own), side="right") - 1)
        good[np.flatnonzero(good)[wrong]] = False
        return good


class Aligned:
    """Tokens, groups and links of the texts of one block."""

    def __init__(self, codec: Codec, column: pa.Array):
        raw, offsets = text_buffer(column)
        self.rows = len(column)
        some = np.flatnonzero(np.diff(offsets))
        joined = b"".join(b" " + raw[offsets[i] : offsets[i + 1]].tobytes() for i in some)
        byte = np.frombuffer(joined, np.uint8)
        lengths = offsets[some + 1] - offsets[some] + 1
        begin = np.cumsum(lengths) - lengths
        cut = np.zeros(byte.size, bool)
        printable = (byte > 0x20) & (byte < 0x7F)
        cut[1:-1] = (byte[1:-1] == 0x20) & printable[:-2] & printable[2:]
        cut[begin] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts, byte.size).astype(np.int64)
        coded = pa.LargeStringArray.from_buffers(starts.size, pa.py_buffer(ends), pa.py_buffer(joined)).dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        known = codec.look_up(coded.dictionary)
        good, which = codec.good, known[which]
        of = np.searchsorted(begin, starts, side="right") - 1
        # texts with an unfaithful segment take no part
        keep = np.ones(some.size, bool)
        keep[of[~good[which]]] = False
        taken = keep[of]
        self.rows_with = some[keep]
        number = np.cumsum(keep) - 1
        doc, which = number[of[taken]], which[taken]
        self.ids, self.ends, self.sizes = [], [], []
        for side, (ids, upto) in enumerate(zip(codec.ids, codec.ends)):
            sizes = np.diff(upto)[which]
            all_ids = ids[cells.ragged(upto[which], sizes)].astype(np.int64)
            self.ids.append(all_ids)
            self.ends.append(np.cumsum(codec.lengths[side][all_ids]))
            self.sizes.append(cells.sums(doc, sizes, len(self.rows_with)))
        self.codec = codec
        self._coalesce()
        self._link()

    def _coalesce(self) -> None:
        """Number of the group of each token; a text's end closes a group, so none runs over it."""
        starts = [np.concatenate([[0], e[:-1]]) if e.size else e for e in self.ends]
        side = np.repeat([0, 1], [s.size for s in starts])
        start, end = np.concatenate(starts), np.concatenate(self.ends)
        order = np.lexsort((side, start))
        reach = np.maximum.accumulate(end[order]) if order.size else end
        opens = np.ones(order.size, bool)
        opens[1:] = start[order][1:] >= reach[:-1]
        group = np.empty(order.size, np.int64)
        group[order] = np.cumsum(opens) - 1
        self.starts = starts
        self.groups = [group[: starts[0].size], group[starts[0].size :]]
        self.group_count = int(opens.sum())

    def _link(self) -> None:
        """Places of the linked tokens: for each A token the B tokens of its group that overlap it."""
        (a_start, b_start), (a_end, b_end) = self.starts, self.ends
        first = np.searchsorted(b_end, a_start, side="right")
        past = np.searchsorted(b_start, a_end, side="left")
        self.a_at = np.repeat(np.arange(a_start.size), past - first)
        self.b_at = cells.ragged(first, past - first)

    def pairs(self) -> np.ndarray:
        """Linked ids as one number: A's in the upper half, B's in the lower."""
        return (self.ids[0][self.a_at] << 32) | self.ids[1][self.b_at]

    def per_row(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(self.rows, np.int64)
        out[self.rows_with] = values
        return out

    def token_docs(self, side: int) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows_with)), self.sizes[side])

    def group_docs(self) -> np.ndarray:
        """Text of each group."""
        out = np.zeros(self.group_count, np.int64)
        out[self.groups[0]] = self.token_docs(0)
        return out

    def link_counts(self) -> np.ndarray:
        return np.bincount(self.token_docs(0)[self.a_at], minlength=len(self.rows_with))

    def texts(self) -> list[str]:
        """Digest of each text's groups, written as a1,a2|b1;a3|b2,b3."""
        a, b = self.groups
        last = [np.append(g[1:] != g[:-1], True) if g.size else np.zeros(0, bool) for g in (a, b)]
        n_a, n_b = (len(x) for x in (self.codec.a_bytes, self.codec.b_bytes))
        out = np.empty(a.size + b.size, np.int64)
        out[np.arange(a.size) + np.searchsorted(b, a, side="left")] = self.ids[0] + n_a * last[0]
        out[np.arange(b.size) + np.searchsorted(a, b, side="right")] = 2 * n_a + self.ids[1] + n_b * last[1]
        written = self.codec.decimal.take(pa.array(out))
        _, where, data = written.buffers()
        places = np.frombuffer(where, np.int64)[np.concatenate([[0], np.cumsum(self.sizes[0] + self.sizes[1])])]
        view, digests = memoryview(data) if data else b"", [""] * self.rows
        for row, start, end in zip(self.rows_with, places[:-1], places[1:]):
            digests[row] = hashlib.sha256(view[start : end - 1]).hexdigest()
        return digests


class _Sent:
    """The two model files, read by the driver and sent to the tasks."""

    def __init__(self, spark, tokenizer: str, pieces: str):
        with open(tokenizer, encoding="utf-8") as a, open(pieces, "rb") as b:
            self.files = spark.sparkContext.broadcast((a.read(), b.read()))
        self.id = self.files._jbroadcast.id()

    def __getstate__(self):
        return {"files": self.files, "id": self.id}

    def codec(self) -> Codec:
        if self.id not in _codecs:
            _codecs.clear()
            _codecs[self.id] = Codec(*self.files.value)
        return _codecs[self.id]


def groups(docs: DataFrame, tokenizer: str, pieces: str) -> DataFrame:
    """(doc_id, a_ids, b_ids, a_ends, b_ends): ids of both sides, and where each group ends in them.

    tokenizer: file of a byte-level tokenizer, which encodes a space and the text; pieces: file of a
    piece model, which adds the space itself. Null and empty texts, and texts that the joined tokens
    of a side do not give back, have empty arrays. Repeated rows stay; an empty table gives none.
    """
    sent = _Sent(docs.sparkSession, tokenizer, pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = sent.codec()
        for batch in blocks(batches, limit=PIECE):
            found = Aligned(codec, batch.column("text"))
            columns = [batch.column("doc_id")]
            ends = []
            for side in (0, 1):
                places = np.concatenate([[0], np.cumsum(found.per_row(found.sizes[side]))])
                columns.append(pa.LargeListArray.from_arrays(places, pa.array(found.ids[side])).cast(pa.list_(pa.int32())))
                upto = np.append(np.flatnonzero(np.diff(found.groups[side])) + 1, found.ids[side].size)[: found.group_count]
                doc = found.group_docs()
                upto = upto - (np.cumsum(found.sizes[side]) - found.sizes[side])[doc]
                counts = found.per_row(np.bincount(doc, minlength=len(found.rows_with)))
                ends.append(pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]), pa.array(upto)).cast(pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns + ends, names=["doc_id", "a_ids", "b_ids", "a_ends", "b_ends"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


NAMES = ["n_a", "n_b", "n_groups", "n_links"]


class _Gathered:
    """What is kept of the documents of a block; links of one document with one pair are one entry."""

    def __init__(self):
        self.rows = self.bytes = 0
        self.ids, self.digests = [], []
        self.counts = [[] for _ in NAMES]
        self.docs, self.pairs, self.often = [], [], []

    def add(self, batch: pa.RecordBatch, found: Aligned) -> None:
        pairs = found.pairs()
        distinct, at = np.unique(pairs, return_inverse=True)
        doc = found.rows_with[found.token_docs(0)[found.a_at]]
        entry, often = np.unique(doc * max(distinct.size, 1) + at, return_counts=True)
        doc, at = np.divmod(entry, max(distinct.size, 1))
        self.docs.append(self.rows + doc)
        self.pairs.append(distinct[at])
        self.often.append(often)
        per_group = np.bincount(found.group_docs(), minlength=len(found.rows_with))
        for own, values in zip(self.counts, (found.sizes[0], found.sizes[1], per_group, found.link_counts())):
            own.append(found.per_row(values))
        self.ids.append(batch.column("doc_id"))
        self.digests.append(pa.array(found.texts(), pa.string()))
        self.rows += batch.num_rows
        self.bytes += int(text_buffer(batch.column("text"))[1][-1])

    def row(self, block: int) -> pa.RecordBatch:
        doc, often = np.concatenate(self.docs), np.concatenate(self.often)
        distinct, at = np.unique(np.concatenate(self.pairs), return_inverse=True)
        # documents come in order, and so do the pairs of each
        entry = doc * max(distinct.size, 1) + at
        listed = lambda x: pa.ListArray.from_arrays(pa.array([0, self.rows], pa.int32()), x)
        packed = cells.pack(distinct, True), cells.pack(cells.sums(at, often, distinct.size)), cells.pack(entry, True), cells.pack(often)
        return pa.RecordBatch.from_arrays(
            [pa.array([block]), listed(pa.concat_arrays(self.ids))]
            + [listed(pa.array(np.concatenate(x))) for x in self.counts]
            + [listed(pa.concat_arrays(self.digests))]
            + [pa.array([x], pa.binary()) for x in packed]
            + [pa.array([distinct.size])],
            names=["block", "doc_id", *NAMES, "digest", "pairs", "times", "entries", "often", "size"],
        )


def align(docs: DataFrame, tokenizer: str, pieces: str) -> DataFrame:
    """Counts of tokens, groups and links of each document, and how usual its links are.

    n_best: links whose id pair is linked in the corpus as often as any pair of its B id; count_sum:
    the corpus counts of the pairs, added over the links; groups_sha256: digest of the groups, or ''.
    Null and empty texts, and texts that the joined tokens of a side do not give back, have zeros.
    Repeated rows stay, an empty table gives none, and other columns are not read.
    """
    sent = _Sent(docs.sparkSession, tokenizer, pieces)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = NAMES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, number = sent.codec(), cells.numbers()
        gathered = _Gathered()
        for batch in blocks(batches, limit=PIECE):
            gathered.add(batch, Aligned(codec, batch.column("text")))
            if gathered.bytes >= BLOCK:
                yield gathered.row(next(number))
                gathered = _Gathered()
        if gathered.rows:
            yield gathered.row(next(number))

    schema = f"block bigint, doc_id array<{kind}>, " + ", ".join(f"{n} array<bigint>" for n in names)
    schema += ", digest array<string>, pairs binary, times binary, entries binary, often binary, size bigint"
    found = shared.written(docs.select("doc_id", "text").mapInArrow(run, schema))
    shards = cells.shards_for(found, "size")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, pairs, times in zip(*(batch.column(c).to_pylist() for c in ("block", "pairs", "times"))):
                pairs, times = cells.unpack(pairs, True), cells.unpack(times)
                parts = cells.split(pairs, shards)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([s for s, _ in parts], pa.int32()),
                        pa.array([block] * len(parts), pa.int64()),
                        pa.array([cells.pack(pairs[p], True) for _, p in parts], pa.binary()),
                        pa.array([cells.pack(times[p]) for _, p in parts], pa.binary()),
                    ],
                    names=["shard", "block", "pairs", "times"],
                )

    def count(table: pa.Table) -> pa.Table:
        block = table.column("block").to_pylist()
        shard = table.column("shard")[0].as_py()
        keys = [cells.unpack(x.as_py(), True) for x in table.column("pairs")]
        times = np.concatenate([cells.unpack(x.as_py()) for x in table.column("times")])
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = cells.sums(at, times, distinct.size)
        cuts = np.cumsum([k.size for k in keys])[:-1]
        # of each B id the most that one of its pairs has in this shard
        b = (distinct & np.uint64(0xFFFFFFFF)).astype(np.int64)
        ids, of = np.unique(b, return_inverse=True)
        most = np.zeros(ids.size, np.int64)
        np.maximum.at(most, of, total)
        return pa.table({
            "shard": pa.array([shard] * (len(block) + 1), pa.int32()),
            "block": pa.array([*block, None], pa.int64()),
            "totals": pa.array([*(cells.pack(x) for x in np.split(total[at], cuts)), None], pa.binary()),
            "ids": pa.array([*[None] * len(block), ids], pa.list_(pa.int64())),
            "most": pa.array([*[None] * len(block), most], pa.list_(pa.int64())),
        })

    dealt = found.select("block", "pairs", "times").mapInArrow(deal, "shard int, block bigint, pairs binary, times binary")
    counted = shared.written(
        dealt.groupBy("shard").applyInArrow(
            count, "shard int, block bigint, totals binary, ids array<bigint>, most array<bigint>"
        )
    )
    each = counted.filter("block is null").select(F.explode(F.arrays_zip("ids", "most")).alias("x"))
    # one row per id of the piece vocabulary at most
    best = dict(each.groupBy("x.ids").agg(F.max("x.most")).collect())
    usual = np.zeros(max(best, default=0) + 1, np.int64)
    usual[list(best)] = list(best.values())
    usual = docs.sparkSession.sparkContext.broadcast(usual)

    def finish(block: pa.Table, answers: pa.Table) -> pa.Table:
        columns = {n: block.column(n).combine_chunks().flatten() for n in ("doc_id", *names, "digest")}
        rows = len(columns["doc_id"])
        pairs, entries, often = (
            cells.unpack(block.column(n)[0].as_py(), up) for n, up in (("pairs", True), ("entries", True), ("often", False))
        )
        total = np.zeros(pairs.size, np.int64)
        by_shard = dict(zip(answers.column("shard").to_pylist(), answers.column("totals").to_pylist()))
        for shard, places in cells.split(pairs, shards):
            total[places] = cells.unpack(by_shard[shard])
        top = total == usual.value[(pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        doc, at = np.divmod(entries.astype(np.int64), max(pairs.size, 1))
        often = often.astype(np.int64)
        return pa.table({
            "doc_id": columns["doc_id"],
            **{n: columns[n] for n in names},
            "n_best": cells.sums(doc, often * top[at], rows),
            "count_sum": cells.sums(doc, often * total[at], rows),
            "groups_sha256": columns["digest"],
        })

    out = f"doc_id {kind}, " + ", ".join(f"{n} bigint" for n in [*names, "n_best", "count_sum"]) + ", groups_sha256 string"
    kept = found.select("block", "doc_id", *names, "digest", "pairs", "entries", "often")
    answers = counted.filter("block is not null").select("block", "shard", "totals")
    return kept.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, out)


def op12_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tokenizer, pieces = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return align(shared.read(spark, sf_dir, "documents"), tokenizer, pieces)
