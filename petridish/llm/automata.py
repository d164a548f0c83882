"""Removal of word passages that an earlier document has, by suffix automata.

Reference passages are the contexts that can hold a repeat (see `anchors`), dealt to shards of
bounded expected size. For each shard a suffix automaton over the words of its passages is built,
with the least doc_id of each state's places. The shard's documents are streamed through it for
their matching statistics: the longest suffix of the words so far that the shard has. Where it
reaches the length threshold, the state that holds the last words of that length tells the earliest
document, and spans with an earlier one than the document's own go, in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petridish.llm import anchors, shared
from petridish.llm.textblocks import (
    NOT_SPACE,
    blocks,
    prefix_sums,
    span_hash,
    text_buffer,
    word_spans,
)

LENGTH, GRAMS = 13, (4, 13)


class Automaton:
    """Suffix automaton of several word sequences."""

    def __init__(self):
        self.after: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.first = [None]  # least weight of the sequences that hold the state's strings

    def _state(self, length: int, after: dict[int, int], link: int) -> int:
        self.after.append(after)
        self.link.append(link)
        self.length.append(length)
        self.first.append(None)
        return len(self.link) - 1

    def _split(self, at: int, word: int, to: int) -> int:
        """A copy of state `to` for the strings that come from `at` by `word`."""
        copy = self._state(self.length[at] + 1, dict(self.after[to]), self.link[to])
        while at >= 0 and self.after[at].get(word) == to:
            self.after[at][word] = copy
            at = self.link[at]
        self.link[to] = copy
        return copy

    def add(self, words: list[int], weight: int | None) -> None:
        last = 0
        for word in words:
            to = self.after[last].get(word)
            if to is not None:  # an earlier sequence has it
                if self.length[to] != self.length[last] + 1:
                    to = self._split(last, word, to)
                new = to
            else:
                new = self._state(self.length[last] + 1, {}, 0)
                at = last
                while at >= 0 and word not in self.after[at]:
                    self.after[at][word] = new
                    at = self.link[at]
                if at >= 0:
                    to = self.after[at][word]
                    if self.length[to] != self.length[at] + 1:
                        to = self._split(at, word, to)
                    self.link[new] = to
            last = new
            if weight is not None and (self.first[new] is None or weight < self.first[new]):
                self.first[new] = weight

    def settle(self) -> None:
        """Hand the least weights on to the suffixes."""
        for at in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            up, own = self.link[at], self.first[at]
            if up > 0 and own is not None and (self.first[up] is None or own < self.first[up]):
                self.first[up] = own

    def statistics(self, words: list[int], least: int) -> Iterator[int | None]:
        """For each word: the least weight with the `least` words up to it, None if none has them."""
        at = size = 0
        for word in words:
            while at and word not in self.after[at]:
                at = self.link[at]
                size = self.length[at]
            if word in self.after[at]:
                at = self.after[at][word]
                size += 1
            if size < least:
                yield None
                continue
            top = at
            while self.length[self.link[top]] >= least:
                top = self.link[top]
            yield self.first[top]


def earlier_starts(bodies: list[np.ndarray], firsts: list[int | None], length: int = LENGTH):
    """Spans of window starts of each body that a body with a lower weight has as well."""
    machine = Automaton()
    own = [b.tolist() for b in bodies]
    for words, first in zip(own, firsts):
        machine.add(words, first)
    machine.settle()
    out = []
    for words, first in zip(own, firsts):
        spans: list[tuple[int, int]] = []
        for end, least in enumerate(machine.statistics(words, length)):
            if least is not None and first is not None and least < first:
                start = end - length + 1
                if spans and spans[-1][1] == start:
                    spans[-1] = (spans[-1][0], start + 1)
                else:
                    spans.append((start, start + 1))
        out.append(spans)
    return out


def word_units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_buffer(texts)
    starts, ends, first = word_spans(data, offsets, NOT_SPACE)
    return span_hash(prefix_sums(data), starts, ends), first


RULE = anchors.Rule(LENGTH, GRAMS, word_units, "u8", "first", earlier_starts, demote=True)


def remove_repeats(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, n_words, spans, kept[, text, row]): each whole text without words that come again.

    A word goes if a window of LENGTH words that covers it also starts in a document with a smaller
    doc_id; windows are judged on the input and never cross documents. `spans` are the maximal
    removed runs of words, `kept` the words left, joined by one space. Null texts have no words.
    Rows with one doc_id are never earlier than each other; a row without a doc_id keeps all its
    words, and no document is later than it. An empty table gives an empty result. Only doc_id and
    text are read, and the columns named in `carry`, which come back in `row`, with the text.
    """
    spans = anchors.repeated(docs, RULE, F.col("doc_id"))
    joined = anchors.with_spans(docs, spans, carry or [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            data, offsets = text_buffer(batch.column("text"))
            starts, ends, bounds = word_spans(data, offsets, NOT_SPACE)
            gone = anchors.covered(batch, bounds, LENGTH, starts.size)
            left, till = starts[~gone], ends[~gone]
            kept = np.concatenate([[0], np.cumsum(~gone)])[bounds]
            # bytes of kept words, each with a space behind it
            sizes = till - left + 1
            place = np.concatenate([[0], np.cumsum(sizes)])
            spot = np.repeat(left - place[:-1], sizes) + np.arange(place[-1])
            raw = np.append(data, np.uint8(32))[np.minimum(spot, data.size)]
            raw[place[1:] - 1] = 32
            texts = [
                raw[place[a] : max(place[a], place[b] - 1)].tobytes().decode()
                for a, b in zip(kept[:-1], kept[1:])
            ]
            columns = [
                batch.column("doc_id"),
                pa.array(np.diff(bounds)),
                anchors.span_lists(*anchors.runs_of(gone, bounds), bounds),
                pa.array(texts, pa.string()),
            ]
            names = ["doc_id", "n_words", "spans", "kept"]
            if carry:
                columns += [batch.column("text"), batch.column("row")]
                names += ["text", "row"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words bigint, spans array<{anchors.SPAN}>, kept string"
    if carry:
        schema += f", text string, row {joined.schema['row'].dataType.simpleString()}"
    return joined.mapInArrow(run, schema)


def op9_automata(spark, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"])
    return remove_repeats(shared.read(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        removed.alias("n_removed"),
        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"),
    )


#: The same rule in DuckDB SQL.
SQL = r"""
with words as (
  select doc_id, [x for x in regexp_split_to_array(coalesce(text, ''), '[ \t\n\v\f\r]+')
                  if x <> ''] as w
  from documents
), starts as (
  select doc_id, unnest(range(1, len(w) - 11)) as pos from words where len(w) >= 13
), windows as (
  select s.doc_id, s.pos, array_to_string(w.w[s.pos : s.pos + 12], ' ') as key
  from starts s join words w using (doc_id)
), firsts as (
  select key, min(doc_id) as first from windows group by key
), again as (
  select distinct w.doc_id, unnest(range(w.pos, w.pos + 13)) as pos
  from windows w join firsts f using (key) where f.first < w.doc_id
), lists as (
  select doc_id, list(pos) as gone from again group by doc_id
)
select doc_id, len(w) as n_words, coalesce(len(gone), 0) as n_removed,
  sha256(array_to_string(case when gone is null then w else
    [w[i] for i in range(1, len(w) + 1) if not list_contains(gone, i)] end, ' '))
    as kept_sha256
from words left join lists using (doc_id)
"""
