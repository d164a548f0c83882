"""Licence scans with a positional index of rare licence words.

Templates are short licence passages as words. The index holds, for each template's words with the
highest inverse document frequency among the templates, where they stand in it. Each file's
occurrences of indexed words are looked up; postings of one template that agree on where the
template would begin in the file are intersected, and a placed template counts if its mandatory key
phrases stand there word for word. Base phrases are templates that are key phrases as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from petridish.llm import shared
from petridish.llm.textblocks import (
    LOWER_ASCII,
    blocks,
    prefix_sums,
    span_hash,
    text_buffer,
    word_spans,
)

#: Words are runs of digits, letters a to z and bytes beyond ASCII, after lower-casing A to Z.
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True
#: Indexed words of each template, and how many of them must agree on a place.
RARE, AGREE = 4, 2

#: Phrases whose places are counted, with their labels.
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
#: Label, words of the template, and its key phrases.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this "
        "software and associated documentation files the software to deal in the software "
        "without restriction",
        ("permission is hereby granted free of charge", "without restriction"),
    ),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    (
        "gpl-3.0",
        "this work is licensed under the gnu general public license version 3",
        ("gnu general public license version 3",),
    ),
    (
        "gpl-2.0",
        "under the terms of the gnu general public license version 2",
        ("gnu general public license version 2",),
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms "
        "of the gnu general public license as published by the free software foundation",
        ("redistribute it and or modify it", "gnu general public license"),
    ),
    ("lgpl", "gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl", "gnu affero general public license", ("gnu affero general public license",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    (
        "cc-by-4.0",
        "licensed under a creative commons attribution 4 0 international license",
        ("creative commons attribution 4 0",),
    ),
    ("cc0", "released under cc0 1 0 universal public domain dedication", ("cc0 1 0",)),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are "
        "permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms", "following conditions are met"),
    ),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("reserved", "copyright all rights reserved", ("all rights reserved",)),
)


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(prefix_sums(data), starts, ends)


def codes_of(phrase: str) -> np.ndarray:
    data = np.frombuffer(phrase.encode(), np.uint8)
    return word_codes(data, *word_spans(data, np.array([0, data.size]), IS_WORD)[:2])


@dataclass
class Template:
    label: str
    words: list[str]
    keys: list[tuple[int, int]]  # words from and to of each key phrase
    base: bool
    codes: np.ndarray = field(default=None)
    rare: list[int] = field(default=None)  # places of the indexed words
    agree: int = 1


def build_index(base: dict[str, str], templates) -> list[Template]:
    """Templates with hashed words, key places and their rarest words' places."""
    out = [Template(label, phrase.split(), [(0, len(phrase.split()))], True) for phrase, label in base.items()]
    for label, text, keys in templates:
        words, places = text.split(), []
        for key in keys:
            own = key.split()
            at = next((i for i in range(len(words)) if words[i : i + len(own)] == own), None)
            if at is None:
                raise ValueError(f"{key!r} is not in the template of {label}")
            places.append((at, at + len(own)))
        out.append(Template(label, words, places, False))
    number: dict[str, int] = {}
    for t in out:
        for word in set(t.words):
            number[word] = number.get(word, 0) + 1
    for t in out:
        idf = lambda i: -np.log((1 + number[t.words[i]]) / (1 + len(out)))  # noqa: B023, E731
        inside = [i for a, b in t.keys for i in range(a, b)]
        # indexed words are taken from the key phrases, where they must stand for a match
        t.rare = sorted(inside, key=lambda i: (-idf(i), i))[: 1 if t.base else RARE]
        t.agree = min(1 if t.base else AGREE, len(t.rare))
        t.codes = codes_of(" ".join(t.words))
    return out


def scan_block(index: list[Template], texts: pa.Array) -> dict[str, list]:
    """n_words, and for each hit: text, template, first word, covered share."""
    data, offsets = text_buffer(texts)
    data = LOWER_ASCII[data]
    starts, ends, first = word_spans(data, offsets, IS_WORD)
    codes = word_codes(data, starts, ends)
    wanted = np.unique(np.concatenate([t.codes[t.rare] for t in index]))
    near = np.searchsorted(wanted, codes)
    near[near == wanted.size] = 0
    known = np.flatnonzero(wanted[near] == codes) if codes.size else np.zeros(0, np.int64)
    which = codes[known]
    text_of = np.searchsorted(first, known, side="right") - 1
    hits = []
    for number, t in enumerate(index):
        begins = [known[which == t.codes[i]] - i for i in t.rare]
        texts_of = [text_of[which == t.codes[i]] for i in t.rare]
        placed = np.stack([np.concatenate(texts_of), np.concatenate(begins)])
        placed, votes = np.unique(placed, axis=1, return_counts=True)
        placed = placed[:, votes >= t.agree]
        for text, begin in placed.T.tolist():
            low, high = first[text], first[text + 1]
            words = begin + np.arange(len(t.words))
            good = (words >= low) & (words < high)
            good[good] = codes[words[good]] == t.codes[good]
            if all(good[a:b].all() for a, b in t.keys) and _same(
                data, starts, ends, begin, t
            ):
                hits.append((text, number, int(begin - low), float(good.mean())))
    return {"n_words": np.diff(first), "hits": hits}


def _same(data, starts, ends, begin: int, t: Template) -> bool:
    """Whether the key phrases' words are there letter for letter."""
    return all(
        data[starts[begin + i] : ends[begin + i]].tobytes() == t.words[i].encode()
        for a, b in t.keys
        for i in range(a, b)
    )


def scan(docs: DataFrame, base: dict[str, str] | None = None, templates=None) -> DataFrame:
    """One row per document: words, places of base phrases, labels and the best covered share.

    n_base counts all places of base phrases; first_word and last_word are the least and greatest
    word (from 0) at which one begins, else null. base_labels are the base phrases' labels, labels
    those of the templates as well; distinct, sorted, joined by commas ('' if none). score is the
    greatest share of a found template's words that stand in their places (0 if none). Null and
    empty texts have no words. Repeated rows stay; an empty table gives an empty result; only doc_id
    and text are read.
    """
    index = build_index(BASE if base is None else base, TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            found = scan_block(index, batch.column("text"))
            rows = [
                {"n_base": 0, "first": None, "last": None, "base": set(), "all": set(), "score": 0.0}
                for _ in range(batch.num_rows)
            ]
            for text, number, at, share in found["hits"]:
                row, t = rows[text], index[number]
                if t.base:
                    row["n_base"] += 1
                    row["first"] = at if row["first"] is None else min(row["first"], at)
                    row["last"] = at if row["last"] is None else max(row["last"], at)
                    row["base"].add(t.label)
                row["all"].add(t.label)
                row["score"] = max(row["score"], share)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(found["n_words"]),
                    pa.array([r["n_base"] for r in rows], pa.int64()),
                    pa.array([r["first"] for r in rows], pa.int64()),
                    pa.array([r["last"] for r in rows], pa.int64()),
                    pa.array([",".join(sorted(r["base"])) for r in rows], pa.string()),
                    pa.array([",".join(sorted(r["all"])) for r in rows], pa.string()),
                    pa.array([r["score"] for r in rows], pa.float64()),
                ],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run,
        f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
        "base_labels string, labels string, score double",
    )


def op3_licences(spark, sf_dir: str) -> DataFrame:
    return scan(shared.read(spark, sf_dir, "documents"))
