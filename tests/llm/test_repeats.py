"""SimHash, substring and suffix-array deduplication, and components, against brute force."""

import hashlib
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from petridish.llm import anchors, automata, shared, simhash, suffixes
from tests.llm import cases

SPACE = r"[^\x20\x09-\x0D]+"


def groups(nodes, links):
    top = {n: n for n in nodes}

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            top[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "pair", "none"])
def test_components(spark, shape):
    random = np.random.default_rng(1)
    links = {
        "chain": [(i, i + 1) for i in range(300)],
        "star": [(500, i) for i in range(200)],
        "random": random.integers(0, 400, (300, 2)).tolist(),
        "pair": [(7, 7), (8, 9), (9, 8)],
        "none": [],
    }[shape]
    frame = spark.createDataFrame([tuple(map(int, x)) for x in links], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in shared.components(frame, "a", "b").collect()}
    nodes = {n for x in links for n in x if x[0] != x[1]}
    assert got == groups(nodes, [x for x in links if x[0] != x[1]])


def test_vantage_point_routes_meet_every_near_pair():
    random = np.random.default_rng(2)
    fps = np.unique(random.integers(0, 2**63, 3000).astype(np.uint64))
    near = fps[:1500] ^ (np.uint64(1) << random.integers(0, 64, 1500).astype(np.uint64))
    near ^= np.uint64(1) << random.integers(0, 64, 1500).astype(np.uint64)
    fps = np.unique(np.concatenate([fps, near]))
    tree = simhash.fit_tree(fps[::3], 64)
    row, leaf, home = simhash.route(tree, fps, 2)
    assert sorted(row[home]) == list(range(fps.size))
    homes, seen = dict(zip(row[home], leaf[home])), defaultdict(set)
    for r, x in zip(row, leaf):
        seen[r].add(x)
    for i in range(fps.size):
        for j in np.flatnonzero(simhash.distance(fps, fps[i]) <= 2):
            assert homes[j] in seen[i] or homes[i] in seen[j]
    assert row.size < 20 * fps.size


@pytest.mark.parametrize("block", [768, 7])
def test_simhash_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "LEAF", 16)
    docs = cases.documents(spark)

    def plain(text):
        words = re.findall(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        if not words:
            return 0
        own = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in own]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    found = docs.select("doc_id", "text").collect()
    prints = [plain(r["text"]) for r in found]
    every = sorted(set(prints))
    links = [(a, b) for a in every for b in every if a < b and (a ^ b).bit_count() <= 2]
    of = groups(every, links)
    least = {}
    for r, p in zip(found, prints):
        if r["doc_id"] is not None:
            least[of[p]] = min(least.get(of[p], r["doc_id"]), r["doc_id"])
    want = Counter((r["doc_id"], f"{p:016x}", least.get(of[p])) for r, p in zip(found, prints))
    assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == want
    assert simhash.near_duplicates(cases.nothing(spark)).collect() == []


def test_suffix_arrays():
    random = np.random.default_rng(0)
    for n in (1, 2, 7, 60, 900):
        for letters in (1, 2, 4, 256):
            text = random.integers(0, letters, n).astype(np.uint8)
            raw = text.tobytes()
            order = suffixes.suffix_array(text, 1000)
            assert order.tolist() == sorted(range(n), key=lambda i: raw[i:])


@pytest.mark.parametrize("split", [384 * 1024, 900])
def test_repeated_bytes_match_brute_force(spark, monkeypatch, split):
    monkeypatch.setattr(anchors, "OWNER_BYTES", split)
    docs, length = cases.documents(spark), suffixes.LENGTH
    found = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    starts = Counter(b[i : i + length] for _, b in found for i in range(len(b) - length + 1))
    want = Counter()
    for doc, raw in found:
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - length + 1):
            if starts[raw[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(raw) else 0
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        want[(doc, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())] += 1
    out = suffixes.remove_repeats(docs).collect()
    got = Counter(
        (r["doc_id"], r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest())
        for r in out
    )
    assert got == want
    assert suffixes.remove_repeats(cases.nothing(spark)).collect() == []


def test_common_passage_is_found_without_a_row_per_window_and_place(spark, monkeypatch):
    """A passage of 430 bytes in 300 texts, each with other words around it, owned by few grams."""
    random = np.random.default_rng(8)
    letters = np.frombuffer(b"abcdefghijklmnop ", np.uint8)
    speak = lambda n: letters[random.integers(0, letters.size, n)].tobytes().decode()
    passage, length = speak(430), suffixes.LENGTH
    given = [(i, speak(300) + (passage if i % 4 else speak(430)) + speak(300)) for i in range(400)]
    written, rows = shared.written, []

    def counted(df):
        out = written(df)
        if "pf" in out.columns:  # contexts of contexts
            rows.append((out.count(), out.select("f", "c").distinct().count()))
        return out

    monkeypatch.setattr(anchors, "OWNER_BYTES", 2000)
    monkeypatch.setattr(shared, "written", counted)
    found = suffixes.remove_repeats(spark.createDataFrame(given, "doc_id bigint, text string")).collect()
    starts = Counter(t[i : i + length] for _, t in given for i in range(len(t) - length + 1))
    for r in found:
        text = given[r["doc_id"]][1]
        gone = np.zeros(len(text), bool)
        for i in range(len(text) - length + 1):
            if starts[text[i : i + length]] > 1:
                gone[i : i + length] = True
        own = np.zeros(len(text), bool)
        for x in r["spans"]:
            own[x["a"] : x["b"]] = True
        assert (own == gone).all()
        assert gone.sum() >= len(passage) if r["doc_id"] % 4 else not gone.any()
    assert rows and all(n == kinds for n, kinds in rows)


def test_written_tables_leave_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: set(re.findall(r"shuffle_\w+\.data", disk.getAllFiles().mkString(" ")))
    before, setting = shuffles(), spark.conf.get(shared.CLEANUP)
    out = shared.written(spark.range(1000).repartition(3, "id"))
    for _ in range(100):  # the files go in the background
        if shuffles() <= before:
            break
        time.sleep(0.1)
    assert shuffles() <= before and out.count() == 1000
    assert spark.conf.get(shared.CLEANUP) == setting


@pytest.mark.parametrize("split", [384 * 1024, 300])
def test_repeated_passages_match_brute_force(spark, monkeypatch, split):
    monkeypatch.setattr(anchors, "OWNER_BYTES", split)
    docs, length = cases.documents(spark), automata.LENGTH
    found = [(r["doc_id"], re.findall(SPACE, r["text"] or "")) for r in docs.collect()]
    first = {}
    for doc, words in found:
        for i in range(len(words) - length + 1) if doc is not None else ():
            key = tuple(words[i : i + length])
            first[key] = min(first.get(key, doc), doc)
    want = Counter()
    for doc, words in found:
        gone = [False] * len(words)
        for i in range(len(words) - length + 1) if doc is not None else ():
            if first[tuple(words[i : i + length])] < doc:
                gone[i : i + length] = [True] * length
        want[(doc, len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g))] += 1
    out = automata.remove_repeats(docs, ["lang", "spans"]).withColumn(
        "n", F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"])
    )
    assert Counter((r["doc_id"], r["n_words"], r["n"], r["kept"]) for r in out.collect()) == want
    assert automata.remove_repeats(cases.nothing(spark)).collect() == []


def test_automaton_statistics():
    random = np.random.default_rng(5)
    for _ in range(60):
        bodies = [random.integers(0, 3, random.integers(1, 25)) for _ in range(5)]
        firsts = [3, 1, None, 2, 5]
        least = {}
        for body, first in zip(bodies, firsts):
            for i in range(len(body) - 3):
                key = tuple(body[i : i + 4])
                if first is not None:
                    least[key] = min(least.get(key, first), first)
        for body, first, spans in zip(bodies, firsts, automata.earlier_starts(bodies, firsts, 4)):
            starts = {i for a, b in spans for i in range(a, b)}
            assert starts == {
                i
                for i in range(len(body) - 3)
                if first is not None and least[tuple(body[i : i + 4])] < first
            }


@pytest.mark.parametrize("gram", [4, 13])
def test_equal_windows_have_equal_owners(gram):
    random = np.random.default_rng(6)
    units = random.integers(0, 4, 4000).astype(np.uint64)
    units[2000:2300] = units[100:400]
    bounds = np.array([0, 700, 700, 1500, 4000])
    plain = anchors.contexts(units, bounds, 13, gram)
    common = np.unique(plain[3])[::7]
    for found in (plain, anchors.contexts(units, bounds, 13, gram, common)):
        owners, windows = {}, 0
        for text, lo, n, owner, _, _ in zip(*found):
            assert bounds[text] <= lo and lo + n - 1 + 13 <= bounds[text + 1]
            for at in range(lo, lo + n):
                assert owners.setdefault(units[at : at + 13].tobytes(), owner) == owner
                windows += 1
        assert windows == 688 + 788 + 2488
