"""SentencePiece encoding and decoding of merge-type models, by backtracking.

A text's encoding is the only sequence of pieces in which every adjacent pair is what merging the
pair's own characters gives. The encoder walks a text from left to right with the longest piece
that starts at each place (found by an Aho-Corasick automaton), takes the next shorter prefix piece
while the pair with the piece before is not compatible, and steps back when none is left. A bit for
each place remembers that no encoding ends a piece there, so no place is tried twice.

No piece has a space mark after another character, so texts are cut before each run of space marks
and equal parts are encoded once for each worker.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petridish.llm import shared
from petridish.llm.textblocks import blocks

MARK = "▁"
#: Parts and pairs that a worker remembers at most; both memories start anew beyond it.
MEMORY = 400_000
NORMAL, UNKNOWN, BYTE = 1, 2, 6

_codecs: dict[int, "Codec"] = {}


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(raw):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        elif kind == 5:
            yield number, struct.unpack_from("<f", raw, at)[0]
            at += 4
        elif kind == 1:
            yield number, struct.unpack_from("<d", raw, at)[0]
            at += 8
        else:
            size = varint()
            yield number, raw[at : at + size]
            at += size


def read_model(raw: bytes) -> list[tuple[str, float, int]]:
    """(piece, score, type) of each id; refuses models whose rules this encoder does not have."""
    pieces, trainer, normal = [], {}, {}
    for number, value in _fields(raw):
        if number == 1:
            own = dict(_fields(value))
            pieces.append((own.get(1, b"").decode(), own.get(2, 0.0), own.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normal = dict(_fields(value))
    plain = not normal.get(2) and normal.get(3, 1) and not normal.get(4, 1) and normal.get(5, 1)
    if trainer.get(3) != 2 or not trainer.get(35) or trainer.get(24) or not plain:
        raise ValueError("the model is not a merge model with byte fallback and identity rules")
    if any(kind not in (NORMAL, UNKNOWN, 3, BYTE) for _, _, kind in pieces):
        raise ValueError("the model has user-defined or unused pieces")
    if any(MARK in p.lstrip(MARK) for p, _, kind in pieces if kind == NORMAL):
        raise ValueError("a piece has a space mark after another character")
    return pieces


class Codec:
    """Encoder and decoder of one model; small, built once in each worker."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.score = {p: pieces[i][1] for p, i in self.ids.items()}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.raw = [
            bytes([int(p[3:5], 16)])
            if kind == BYTE
            else p.replace(MARK, " ").encode()
            if kind == NORMAL
            else b" \xe2\x81\x87 "
            if kind == UNKNOWN
            else b""
            for p, _, kind in pieces
        ]
        # characters that are in pieces but are none themselves take part in merges all the same
        self.known = sorted(set(self.ids) | {c for p in self.ids for c in p})
        number = {p: n for n, p in enumerate(self.known)}
        self.size = [len(p) for p in self.known]
        self.out = [
            (self.ids[p],) if p in self.ids else tuple(map(self.bytes.get, p.encode()))
            for p in self.known
        ]
        self.shorter = [
            next((number[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in number), -1)
            for p in self.known
        ]
        #: What has been found for each piece and the piece before it; the last row is for none.
        self.pairs: list[dict[int, bool]] = [{} for _ in range(len(self.known) + 1)]
        self.n_pairs = 0
        self.machine = ahocorasick.Automaton()
        for piece, n in number.items():
            self.machine.add_word(piece, (len(piece) - 1, n))
        self.machine.make_automaton()
        letters = re.escape("".join(sorted(c for c in self.known if len(c) == 1 and c != MARK)))
        self.cut = re.compile(f"{MARK}+[{letters}]*|[{letters}]+|[^{letters}{MARK}]+")
        self.gap = re.compile(f"[^{letters}{MARK}]")
        self.halves: dict[str, tuple | None] = {}
        self.parts: dict[str, tuple[int, ...]] = {}

    def merged(self, text: str, parts: int = 1) -> list[str]:
        """Pieces of a short text by merging the best neighbours, the leftmost first.

        Ends when nothing can be merged or `parts` parts are left.
        """
        own = list(text)
        while len(own) > parts:
            best, at = None, -1
            for i in range(len(own) - 1):
                score = self.score.get(own[i] + own[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            own[at : at + 2] = [own[at] + own[at + 1]]
        return own

    def half(self, piece: str) -> tuple | None:
        """(left, right, score) of the last merge that makes a piece; () for a single character.

        None if merging its characters doesn't give the piece, or if a part is made by a merge
        that doesn't come strictly before the merge that uses it.
        """
        if piece not in self.halves:
            found = ()
            if len(piece) > 1:
                own = self.merged(piece, 2)
                score = self.score.get(piece)
                inner = [self.half(x) for x in own] if len(own) == 2 and score is not None else [None]
                good = all(x is not None and (not x or x[2] > score) for x in inner)
                found = (own[0], own[1], score) if good else None
            self.halves[piece] = found
        return self.halves[piece]

    def compatible(self, last: str, piece: str) -> bool:
        """Whether merging the characters of both together gives just these two.

        Merges are undone from the latest on. Between two parts that touch at the border, a merge
        across it must not come before the merge that takes either of them away; of equal merges
        the left one comes first. Pieces without an ordered history are merged in full instead.
        """
        one, two = self.half(last) if last else None, self.half(piece)
        if one is None or two is None:
            found = self.merged(last + piece) == ([last, piece] if last else [piece])
        else:
            score, a, b = self.score, last, piece
            found = a + b not in score
            while found and (one or two):
                if not one or (two and two[2] <= one[2]):
                    b, limit = two[0], two[2]
                    two = self.half(b)
                    found = score.get(a + b, -float("inf")) < limit
                else:
                    a, limit = one[1], one[2]
                    one = self.half(a)
                    found = score.get(a + b, -float("inf")) <= limit
        return found

    def judge(self, last: int, piece: int) -> bool:
        """compatible() of numbered pieces, remembered."""
        if self.n_pairs >= MEMORY:
            self.n_pairs = 0
            for own in self.pairs:
                own.clear()
        good = self.compatible(self.known[last] if last >= 0 else "", self.known[piece])
        self.n_pairs += 1
        self.pairs[last][piece] = good
        return good

    def walk(self, text: str) -> list[int]:
        """Numbers of the pieces of a text whose characters are all known."""
        till = len(text)
        longest = [-1] * till
        for end, (more, piece) in self.machine.iter(text):
            longest[end - more] = piece  # ends rise, so the last match of a start is its longest
        size, shorter, pairs = self.size, self.shorter, self.pairs
        dead, failed = bytearray((till >> 3) + 1), False
        found: list[int] = []
        at, piece, last = 0, longest[0], -1
        while at < till:
            after = pairs[last]
            while piece >= 0:
                end = at + size[piece]
                if not failed or not dead[end >> 3] >> (end & 7) & 1:
                    good = after.get(piece)
                    if good or good is None and self.judge(last, piece):
                        break
                piece = shorter[piece]
            if piece >= 0:
                found.append(piece)
                at, last = end, piece
                if at < till:
                    piece = longest[at]
            elif found:
                dead[at >> 3] |= 1 << (at & 7)
                failed = True
                piece = found.pop()
                last = found[-1] if found else -1
                at -= size[piece]
            else:
                raise AssertionError(f"no encoding of {text[:40]!r}")
        return found

    def part(self, text: str) -> tuple[int, ...]:
        """Ids of one part; characters without a piece become their bytes."""
        if self.gap.match(text):
            return tuple(map(self.bytes.get, text.encode()))
        return tuple(chain.from_iterable(map(self.out.__getitem__, self.walk(text))))

    def encode(self, text: str) -> list[tuple[int, ...]]:
        """Ids of a text, part by part: cut before space marks and around unknown characters."""
        if not text:
            return []
        if len(self.parts) >= MEMORY:
            self.parts.clear()
        have, out = self.parts, []
        for part in self.cut.findall(MARK + text.replace(" ", MARK)):
            ids = have.get(part)
            if ids is None:
                ids = have[part] = self.part(part)
            out.append(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def _codec(sent) -> Codec:
    if sent.id not in _codecs:
        _codecs.clear()
        _codecs[sent.id] = Codec(sent.value)
    return _codecs[sent.id]


class _Sent:
    """A broadcast vocabulary (a few hundred kilobytes) with a key for the workers' codecs."""

    def __init__(self, spark, path: str):
        with open(path, "rb") as file:
            self.variable = spark.sparkContext.broadcast(read_model(file.read()))
        self.id = self.variable._jbroadcast.id()

    def __getstate__(self):
        return {"variable": self.variable, "id": self.id}

    @property
    def value(self):
        return self.variable.value


def encode(docs: DataFrame, model: str, decoded: bool = False) -> DataFrame:
    """(doc_id, ids[, decoded]) of each whole text, exactly as the library's encode() gives them.

    No begin or end ids, no sampling. Null and empty texts have no ids. With `decoded`, the ids are
    decoded again. Rows that repeat an id stay, an empty table gives an empty result, and other
    columns are not read. The model file is read by the driver and sent to the tasks.
    """
    sent = _Sent(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent)
        for batch in blocks(batches):
            flat, sizes, back = [], [], []
            for text in batch.column("text").to_pylist():
                ids = list(chain.from_iterable(codec.encode(text or "")))
                sizes.append(len(ids))
                flat.append(np.array(ids, np.int32))
                if decoded:
                    back.append(codec.decode(ids))
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            values = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32))
            columns = [batch.column("doc_id"), pa.ListArray.from_arrays(offsets, values)]
            names = ["doc_id", "ids"]
            if decoded:
                columns.append(pa.array(back, pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, ids array<int>" + ", decoded string" * decoded
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give an empty text."""
    sent = _Sent(encoded.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent)
        for batch in batches:
            back = [codec.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(back, pa.string())], names=["doc_id", "text"]
            )

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """One row per document: number of ids, digest of the ids, digest of the decoded text."""
    return encode(docs, model, decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias(
            "ids_sha256"
        ),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op4_pieces(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    return digests(shared.read(spark, sf_dir, "documents"), model)
