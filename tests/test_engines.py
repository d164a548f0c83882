"""Balanced grouping helpers and iterative engines against brute force."""

import itertools
import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from petridish.operators import engines, scale


def test_rank_within_matches_sorting(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else "cold", rng.randint(0, 20), i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, v int, i int")
    got = {(r.g, r.i): r.r for r in scale.rank_within(df, ["g"], ["v", "i"], "r").collect()}
    for g in ("hot", "cold"):
        ordered = sorted((v, i) for k, v, i in rows if k == g)
        assert [got[(g, i)] for _, i in ordered] == list(range(1, len(ordered) + 1))


def test_running_total(spark):
    df = spark.createDataFrame([("a", i, i * 2) for i in range(50)], "g string, o int, n int")
    got = {r.o: r.t for r in scale.running_total(df, ["g"], ["o"], "n", "t").collect()}
    assert got[49] == sum(i * 2 for i in range(50)) and got[3] == 12


def test_percentiles_of_hot_groups_are_exact(spark):
    rng = np.random.default_rng(3)
    values = {"hot": rng.normal(size=401), "cold": rng.normal(size=7)}
    rows = [(g, float(v), float(v) * 2) for g, vs in values.items() for v in vs]
    rows.append(("hot", None, 1.0))
    df = spark.createDataFrame(rows, "g string, a double, b double")
    specs = {"a10": ("a", 0.1), "a50": ("a", 0.5), "b90": ("b", 0.9)}
    aggs = {"n": F.count("a")}
    found = {r.g: r for r in scale.summarise(df, ["g"], aggs, specs).collect()}
    assert found.keys() == {"hot", "cold"} and found["hot"].n == 401
    for g, vs in values.items():
        assert math.isclose(found[g].a10, np.percentile(vs, 10), abs_tol=1e-12)
        assert math.isclose(found[g].a50, np.median(vs), abs_tol=1e-12)
    nulls = spark.createDataFrame([(None, 1.0), (None, 3.0), ("x", None)], "g string, a double")
    rows = scale.summarise(nulls, ["g"], {}, {"a50": ("a", 0.5)}).collect()
    assert {(r.g, r.a50) for r in rows} == {(None, 2.0), ("x", None)}
    whole = scale.summarise(df, [], aggs, {"a50": ("a", 0.5)}).first()
    every = np.concatenate(list(values.values()))
    assert math.isclose(whole.a50, np.median(every), abs_tol=1e-12) and whole.n == len(every)


def test_percentiles_of_large_groups_are_selected_exactly(spark, monkeypatch):
    """Groups beyond a bracket's size: sketch and count, and the sort where brackets hold too many."""
    rng = np.random.default_rng(8)
    values = {"hot": np.round(rng.normal(size=23_001), 3), "even": np.arange(12_000.0), "cold": rng.normal(size=5)}
    frame = pd.DataFrame([(g, v, -v) for g, vs in values.items() for v in vs], columns=["g", "a", "b"])
    df = spark.createDataFrame(frame).repartition(5)
    shares = (0.0, 1e-4, 0.25, 0.5, 0.9, 1.0)
    specs = {f"{c}{i}": (c, p) for c in "ab" for i, p in enumerate(shares)}

    def check():
        for r in scale.summarise(df, ["g"], {}, specs).collect():
            for i, p in enumerate(shares):
                assert math.isclose(r[f"a{i}"], np.quantile(values[r.g], p), abs_tol=1e-12), (r.g, p)
                assert math.isclose(r[f"b{i}"], np.quantile(-values[r.g], p), abs_tol=1e-12), (r.g, p)
        whole = scale.summarise(df, [], {}, {"a2": ("a", 0.25)}).first()
        assert math.isclose(whole.a2, np.quantile(np.concatenate(list(values.values())), 0.25), abs_tol=1e-12)

    check()
    monkeypatch.setattr(scale, "GATHERED", 10)
    check()


def test_components_of_long_chains_end(spark):
    """Rounds stay flat in time: a chain of 20,000 links, its ids in no order along it."""
    order = np.random.default_rng(2).permutation(20_001).tolist()
    links = spark.createDataFrame([("g", a, b) for a, b in zip(order, order[1:])], "g string, a long, b long")
    nodes = spark.createDataFrame([("g", i) for i in range(20_003)], "g string, id long")
    got = engines.connected_components(nodes, links, ["g"])
    assert {(r.component, r["count"]) for r in got.groupBy("component").count().collect()} == {(0, 20_001), (20_001, 1), (20_002, 1)}


def test_greedy_matching_is_the_same_in_rounds(spark):
    rng = random.Random(5)
    edges = [("g", l, r, rng.random()) for l in range(25) for r in range(25) if rng.random() < 0.2]
    df = spark.createDataFrame(edges, "g string, l int, r int, p double")
    used_l, used_r, want = set(), set(), set()
    for _, l, r, _ in sorted(edges, key=lambda e: e[3]):
        if l not in used_l and r not in used_r:
            want.add((l, r))
            used_l.add(l)
            used_r.add(r)
    got = engines.greedy_matching(df, ["g"], "l", "r", ["p"])
    assert {(x.l, x.r) for x in got.collect()} == want


def test_components_are_the_same_in_rounds(spark):
    rng = random.Random(7)
    n = 60
    edges = [("g", rng.randrange(n), rng.randrange(n)) for _ in range(45)]
    edges += [("g", i, i + 1) for i in range(0, 14)]
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for _, a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    want = {i: min(j for j in range(n) if find(j) == find(i)) for i in range(n)}
    nodes = spark.createDataFrame([("g", i) for i in range(n)], "g string, id long")
    links = spark.createDataFrame(edges, "g string, a long, b long")
    got = engines.connected_components(nodes, links, ["g"])
    assert {r.id: r.component for r in got.collect()} == want


def test_nearest_matches_brute_force(spark):
    rng = random.Random(11)
    points = [("a", i, rng.uniform(0, 50), rng.uniform(0, 50)) for i in range(40)]
    points += [("a", 40 + i, 500.0 + i, 500.0) for i in range(3)]  # a far group
    points += [("a", 43 + i, 7.0, 7.0) for i in range(6)]  # a pile on one position
    points += [("b", 100, 1.0, 1.0), ("b", 101, 4.0, 5.0)]
    left = spark.createDataFrame(points, "g string, lid int, x double, y double")
    right = left.withColumnRenamed("lid", "rid")
    got = engines.nearest(left, right, ["g"], k=3, same=True).collect()
    found = {}
    for r in got:
        found.setdefault((r.g, r.lid), {})[r.pos] = (r.rid, r.d)
    for g, i, x, y in points:
        others = sorted(
            (math.dist((x, y), (px, py)), j) for h, j, px, py in points if h == g and j != i
        )[:3]
        mine = found[(g, i)]
        assert [mine[p + 1][0] for p in range(len(others))] == [j for _, j in others]


def test_group_stats_keep_every_row(spark):
    df = spark.createDataFrame([(k, float(v)) for k, v in itertools.product("ab", range(5))], "k string, v double")
    rows = scale.with_group_stats(df, ["k"], m=F.avg("v")).collect()
    assert len(rows) == 10 and {r.m for r in rows} == {2.0}
