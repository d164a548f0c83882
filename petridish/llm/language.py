"""Language identification, words first, backing off to shorter and shorter character n-grams.

A word that the model knows adds its log frequency in each language. An unseen word adds the mean
log frequency of its known character n-grams of the longest length of which any is known.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from petridish.llm import shared
from petridish.llm.textblocks import blocks

#: The model is fitted on a bounded sample: expected labelled documents of each language, the most
#: frequent words of each, and its most frequent n-grams of each length, up to the longest.
SAMPLE, WORDS, GRAMS, LONGEST = 4000, 10_000, 10_000, 5
#: Numbers in a table of the model; with many languages each of them has fewer words and n-grams.
CELLS = 4_000_000
#: Words whose scores a worker remembers; it starts anew beyond that.
MEMORY = 300_000
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")


class Table(dict):
    """Place of each key in `shares`, which has its log frequency in each language."""

    def __init__(self, keys: list[str], shares: np.ndarray):
        super().__init__(zip(keys, range(len(keys))))
        self.shares = shares

    def __reduce__(self):
        return Table, (list(self), self.shares)


@dataclass(frozen=True)
class Model:
    """Languages in order, and log frequencies by language of words and of n-grams."""

    languages: list[str]
    words: Table
    grams: list[Table]


class _Scores(dict):
    """Row of `table` for each word, filled on first use."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.table = np.zeros((1024, len(model.languages)))

    def __missing__(self, word: str) -> int:
        row = self[word] = len(self)
        if row >= len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[row] = word_score(self.model, word)
        return row


def word_score(model: Model, word: str) -> np.ndarray:
    known = model.words.get(word)
    if known is not None:
        return model.words.shares[known]
    padded = f"<{word}>"
    for n in range(len(model.grams), 0, -1):
        have = model.grams[n - 1]
        found = [have[g] for i in range(len(padded) - n + 1) if (g := padded[i : i + n]) in have]
        if found:
            return have.shares[found].mean(axis=0)
    return np.zeros(len(model.languages))


def _log_frequencies(rows, languages: list[str]) -> Table:
    at = {x: i for i, x in enumerate(languages)}
    counts = np.zeros((len(rows), len(languages)))
    for i, row in enumerate(rows):
        for lang, n in row["by"].items():
            counts[i, at[lang]] = n
    share = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * (len(rows) + 1)))
    return Table([row["key"] for row in rows], share)


def _frequent(counts: DataFrame, limit: int) -> list:
    """Counts by language of the most frequent keys of each language, `limit` of each at most."""
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "key")
    own = counts.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= limit)
    by = F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by")
    return counts.join(own.select("key").distinct(), "key").groupBy("key").agg(by).orderBy("key").collect()


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Word and n-gram frequencies by language of a sample of rows with a text and a `lang`.

    Each language gives about `sample` documents (all if it has fewer), picked by a hash of doc_id, and
    every language is learned, each with as many words and n-grams.
    """
    labelled = docs.filter("lang is not null and text is not null and doc_id is not null")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], Table([], np.zeros((0, 0))), [])
    share = max(1, CELLS // len(languages) ** 2)
    rate = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, sample / n))])
    spot = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    taken = labelled.filter(spot < rate[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            own: Counter = Counter()
            rows = zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist())
            for lang, text in rows:
                own.update((lang, w) for w in WORD.findall(text.lower()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in own], pa.string()),
                    pa.array([k[1] for k in own], pa.string()),
                    pa.array(list(own.values()), pa.int64()),
                ],
                names=["lang", "key", "n"],
            )

    words = taken.select("lang", "text").mapInArrow(count, "lang string, key string, n bigint")
    words = shared.materialise(words.groupBy("lang", "key").agg(F.sum("n").alias("n")))
    padded = F.concat(F.lit("<"), F.col("key"), F.lit(">"))
    grams = []
    for n in range(1, LONGEST + 1):
        places = F.sequence(F.lit(1), F.length(padded) - (n - 1))
        pieces = F.when(
            F.length(padded) >= n, F.transform(places, lambda at: F.substring(padded, at, F.lit(n)))
        )
        cut = words.select("lang", "n", F.explode(pieces).alias("key"))
        cut = cut.groupBy("lang", "key").agg(F.sum("n").alias("n"))
        grams.append(_log_frequencies(_frequent(cut, min(GRAMS, share)), languages))
    return Model(languages, _log_frequencies(_frequent(words, min(WORDS, share)), languages), grams)


def predict(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, lang_pred, score[, text, row]): the likeliest language of each whole text and its probability.

    Only the text is read; with `carry` it comes back, and the columns named there in `row`. Null
    texts, texts without letters and all texts under an empty model get `und` with score 0. Ties go to the language that comes first in order. Rows that repeat an id
    stay; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        memory = _Scores(own)
        for batch in blocks(batches):
            if len(memory) > MEMORY:
                memory = _Scores(own)
            langs, scores = [], []
            for text in batch.column("text").to_pylist():
                words = WORD.findall(text.lower()) if text else []
                if not words or not own.languages:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                rows = np.fromiter(map(memory.__getitem__, words), np.int64, len(words))
                total = memory.table[rows].sum(axis=0)
                best = int(total.argmax())
                langs.append(own.languages[best])
                scores.append(float(1.0 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(langs, pa.string()),
                    pa.array(scores, pa.float64()),
                    *([batch.column("text"), batch.column("row")] if carry else []),
                ],
                names=["doc_id", "lang_pred", "score", *(["text", "row"] if carry else [])],
            )

    given, schema = shared.carrying(docs, carry)
    return given.mapInArrow(run, schema.format("lang_pred string, score double"))


def held_out(column: str = "doc_id", of: int = 4, rest: int = 2) -> Column:
    """Whether crc32 of an id written in decimal leaves this remainder; false for a null id."""
    digest = F.crc32(F.col(column).cast("string").cast("binary"))
    return F.coalesce(digest % of == rest, F.lit(False))


def identify(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Predictions for all rows by a model that has not seen the held-out ones."""
    return predict(docs, fit(docs.filter(~held_out())), carry)


def op2_language(spark, sf_dir: str) -> DataFrame:
    found = identify(shared.read(spark, sf_dir, "documents"))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
