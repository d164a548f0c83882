"""Alignment of two tokenizers' tokens against a plain version that encodes whole texts."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from petridish.llm import alignment
from tests.llm import cases

PATHS = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
MORE = [
    "<|endoftext|> <s> </s> <unk>", "  two  leading", "trailing  ", "a\n\nb \t c", "it's  we'll  I'M x y  z",
    " ", "\n", "x " * 4000, "näive ​ zero", "9 99 999 9999 ١٢", "ａ① full", "word" * 900, "a b" + "é" * 50,
]


def plain(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    of, words = alignment.byte_level(), {i: w for w, i in a.get_vocab().items()}
    spell_a = lambda i: bytes(of[c] for c in words[i])
    spell_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    found = []
    for text in texts:
        x = a.encode(" " + (text or ""), add_special_tokens=False).ids
        y = b.encode(text or "")
        whole = (" " + (text or "")).encode()
        if not text or b"".join(map(spell_a, x)) != whole or b"".join(map(spell_b, y)) != whole:
            found.append(None)
            continue
        spans = []
        for ids, spell in ((x, spell_a), (y, spell_b)):
            at, out = 0, []
            for i in ids:
                out.append((at, at + len(spell(i)), i))
                at = out[-1][1]
            spans.append(out)
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, i, j = [], 0, 0
        for cut in cuts:
            ga, gb = [], []
            while i < len(spans[0]) and spans[0][i][1] <= cut:
                ga.append(spans[0][i])
                i += 1
            while j < len(spans[1]) and spans[1][j][1] <= cut:
                gb.append(spans[1][j])
                j += 1
            groups.append((ga, gb))
        links = [(p[2], q[2]) for ga, gb in groups for p in ga for q in gb if p[0] < q[1] and q[0] < p[1]]
        found.append((x, y, groups, links))
    return found


def expected(texts):
    found = plain(texts)
    count = Counter(x for f in found if f for x in f[3])
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        x, y, groups, links = f
        joined = ";".join("|".join(",".join(str(t[2]) for t in g) for g in pair) for pair in groups)
        out.append((
            len(x), len(y), len(groups), len(links), sum(count[k] == best[k[1]] for k in links),
            sum(count[k] for k in links), hashlib.sha256(joined.encode()).hexdigest(),
        ))
    return out


@pytest.mark.parametrize("limits", [(1 << 20, 16 << 20, 4_000_000), (2000, 9000, 500)])
def test_align_as_plain(spark, monkeypatch, limits):
    """Large and small blocks and shards give the plain version's rows."""
    monkeypatch.setattr(alignment, "PIECE", limits[0])
    monkeypatch.setattr(alignment, "BLOCK", limits[1])
    monkeypatch.setattr(alignment.cells, "PER_SHARD", limits[2])
    monkeypatch.setattr(alignment, "MEMORY", 50)
    rows = cases.rows() + [(1000 + i, t, *[None] * 9) for i, t in enumerate(MORE)]
    docs = spark.createDataFrame(rows, cases.SCHEMA).repartition(3)
    got = alignment.align(docs, *PATHS).collect()
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert got[0].asDict().keys() == set(names)
    want = [(r[0], *x) for r, x in zip(rows, expected([r[1] for r in rows]))]
    order = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
    assert any(x[1] == 0 and r[1] for r, x in zip(rows, want)), "no text that the tokens don't give back"


def test_groups_are_the_plain_ones(spark):
    texts = cases.texts() + MORE
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string")
    got = {r["doc_id"]: r for r in alignment.groups(docs.repartition(2), *PATHS).collect()}
    for i, f in enumerate(plain(texts)):
        r = got[str(i)]
        if f is None:
            assert [r[c] for c in ("a_ids", "b_ids", "a_ends", "b_ends")] == [[], [], [], []]
            continue
        assert (r["a_ids"], r["b_ids"]) == (f[0], f[1])
        for side, column in ((0, "a_ends"), (1, "b_ends")):
            upto, total = [], 0
            for g in f[2]:
                total += len(g[side])
                upto.append(total)
            assert r[column] == upto


def test_align_nothing(spark):
    assert alignment.align(cases.nothing(spark), *PATHS).count() == 0
    assert alignment.groups(cases.nothing(spark), *PATHS).count() == 0
    only = spark.createDataFrame([(1, None), (1, ""), (None, "▁")], "doc_id bigint, text string")
    assert {tuple(r)[1:] for r in alignment.align(only, *PATHS).collect()} == {(0, 0, 0, 0, 0, 0, "")}


def test_segments_of_several_blocks_are_not_forgotten(monkeypatch):
    import pyarrow as pa

    with open(PATHS[0], encoding="utf-8") as a, open(PATHS[1], "rb") as b:
        codec = alignment.Codec(a.read(), b.read())
    monkeypatch.setattr(alignment, "MEMORY", 6)
    encoded, joined = [], codec._joined
    monkeypatch.setattr(codec, "_joined", lambda names, own: (encoded.extend(names), joined(names, own)))

    def ids(*names):
        at = codec.look_up(pa.array(names, pa.large_string()))
        return [tuple(i[e[p] : e[p + 1]].tolist() for i, e in zip(codec.ids, codec.ends)) for p in at.tolist()]

    first = ids(" one", " two", " three", " four")
    assert ids(" five", " one", " six", " seven")[1] == first[0]
    assert ids(" eight", " one")[1] == first[0] and ids(" two")[0] == first[1]
    assert encoded.count(" one") == 1 and encoded.count(" two") == 2 and codec.good.all()
