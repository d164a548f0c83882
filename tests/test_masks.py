"""Labelling by tiles, basins and traced outlines against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from petridish.operators import roi, stencil, structure


def frame(spark, masks):
    rows = [(g, int(x), int(y)) for g, m in masks.items() for y, x in zip(*np.nonzero(m))]
    return spark.createDataFrame(rows, "g string, x int, y int").repartition(3)


def plain_components(mask, connectivity):
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if connectivity == 8 else [])
    found = {}
    for y, x in zip(*np.nonzero(mask)):
        if (x, y) in found:
            continue
        todo, first = [(x, y)], y * stencil.ROW_ID + x
        found[x, y] = first
        while todo:
            a, b = todo.pop()
            for dx, dy in steps:
                p = (a + dx, b + dy)
                if 0 <= p[0] < mask.shape[1] and 0 <= p[1] < mask.shape[0] and mask[p[1], p[0]] and p not in found:
                    found[p] = first
                    todo.append(p)
    return {(int(x), int(y)): int(c) for (x, y), c in found.items()}


@pytest.mark.parametrize("connectivity", [4, 8])
def test_tiles_label_as_a_flood(spark, monkeypatch, connectivity):
    monkeypatch.setattr(stencil, "TILE", 7)
    rng = np.random.default_rng(connectivity)
    spiral = np.zeros((30, 30), bool)
    for k in range(0, 14, 2):
        spiral[k, k : 30 - k] = spiral[k : 30 - k, 29 - k] = spiral[29 - k, k : 30 - k] = spiral[k + 2 : 30 - k, k] = True
        spiral[k + 2, k : k + 2] = True
    masks = {"noise": rng.random((25, 40)) < 0.55, "spiral": spiral, "full": np.ones((21, 14), bool), "dot": np.eye(1, dtype=bool)}
    got = {}
    for r in stencil.label_components(frame(spark, masks), ["g"], connectivity).collect():
        got.setdefault(r.g, {})[r.x, r.y] = r.component
    assert got == {g: plain_components(m, connectivity) for g, m in masks.items()}


def discs(*centres, shape=(40, 60), radius=9):
    y, x = np.mgrid[: shape[0], : shape[1]]
    return np.any([(x - a) ** 2 + (y - b) ** 2 <= radius**2 for a, b in centres], axis=0)


def plain_watershed(height, markers):
    """Kruskal over the edges in order, trees of two markers never joined."""
    top = {p: p for p in height}
    mark = {p: markers.get(p) for p in height}

    def find(p):
        while top[p] != p:
            p = top[p]
        return p

    joined = {}
    for p, m in markers.items():
        if m in joined:
            top[find(p)] = find(joined[m])
        joined.setdefault(m, p)
    for m, p in joined.items():
        mark[find(p)] = m
    ident = lambda p: p[1] * stencil.ROW_ID + p[0]
    edges = [(max(height[p], height[q]), ident(p), ident(q), p, q) for p in height for q in ((p[0] + 1, p[1]), (p[0], p[1] + 1)) if q in height]
    for _, _, _, p, q in sorted(edges):
        a, b = find(p), find(q)
        if a != b and not (mark[a] and mark[b]):
            top[a] = b
            mark[b] = mark[a] or mark[b]
    return {p: mark[find(p)] for p in height if mark[find(p)]}


def test_watershed_is_the_spanning_forest(spark):
    rng = np.random.default_rng(1)
    mask = rng.random((14, 16)) < 0.85
    height = {(int(x), int(y)): float(rng.integers(0, 6)) for y, x in zip(*np.nonzero(mask))}
    spots = sorted(height)[:: len(height) // 7]
    markers = {p: i // 2 + 1 for i, p in enumerate(spots)}  # two pixels of a marker may be apart
    heights = spark.createDataFrame([("a", *p, v) for p, v in height.items()], "g string, x int, y int, v double")
    seeds = spark.createDataFrame([("a", *p, m) for p, m in markers.items()], "g string, x int, y int, marker int")
    got = {(r.x, r.y): r.component for r in stencil.watershed(heights, seeds, ["g"]).collect()}
    assert got == plain_watershed(height, markers)


def test_touching_discs_are_cut(spark):
    mask = discs((15, 20), (29, 20), (48, 12))
    got = stencil.split_touching(frame(spark, {"a": mask}), ["g"])
    sizes = sorted(r["count"] for r in got.groupBy("component").count().collect())
    assert len(sizes) == 3 and sum(sizes) == mask.sum() and sizes[0] > 200
    cut = {(r.x, r.y): r.component for r in got.collect()}
    assert cut[10, 20] != cut[34, 20] and cut[10, 20] == cut[15, 27] and cut[34, 20] == cut[29, 13]


def test_debris_options(spark):
    """Touching particles count twice with the watershed; a slope of the background goes with the ball."""
    mask = discs((15, 20), (29, 20))
    y, x = np.mgrid[:40, :60]
    signal = np.where(mask, 230.0, 25.0) + x / 4.0
    pixels = spark.createDataFrame([("a", int(i), int(j), float(signal[j, i])) for j in range(40) for i in range(60)], "g string, x int, y int, v double")
    cells = spark.createDataFrame([("a", 57, 37)], "g string, x int, y int")
    area = spark.createDataFrame([("a", 1000.0)], "g string, median_nucleus_area double")
    config = {"threshold_method": "otsu", "min_size_px": 60, "max_size_fraction_of_median_nucleus_area": 1.0, "cell_dilate_px": 1}
    for more, count in (({}, 1), ({"watershed": True}, 2), ({"subtract_background": True, "rolling_ball_radius": 12.0}, 1)):
        particles, _ = structure.debris_particles(pixels, cells, ["g"], F.lit(60), F.lit(40), area, config | more)
        assert particles.count() == count, more
        assert abs(particles.agg(F.sum("area")).first()[0] - mask.sum()) <= 40


def polygon_area(points):
    x, y = np.array([p.x for p in points]), np.array([p.y for p in points])
    return abs((x * np.roll(y, -1) - y * np.roll(x, -1)).sum()) / 2


def test_concave_and_ring_outlines_are_simple(spark):
    c_shape = np.zeros((30, 30), bool)
    c_shape[3:27, 4:26] = True
    c_shape[9:21, 10:26] = False
    ring = discs((15, 15), shape=(30, 30), radius=12) & ~discs((15, 15), shape=(30, 30), radius=6)
    masks = {"c": c_shape, "ring": ring, "dot": np.eye(1, dtype=bool), "pair": np.eye(2, dtype=bool)}
    loops = roi.mask_to_loops(frame(spark, masks), ["g"]).collect()
    kinds = sorted((r.g, r.hole) for r in loops)
    assert kinds == [("c", False), ("dot", False), ("pair", False), ("ring", False), ("ring", True)]
    for r in loops:
        steps = zip(r.points, [*r.points[1:], r.points[0]])
        assert all(max(abs(a.x - b.x), abs(a.y - b.y)) <= 1 for a, b in steps)
        if r.g in ("c", "ring"):
            assert len({(p.x, p.y) for p in r.points}) == len(r.points)  # passes no pixel twice
    outline = {r.g: r.points for r in roi.mask_to_outline(frame(spark, masks), ["g"]).collect()}
    # pixel centres enclose the pixels but for half of those on the border (Pick)
    for g, area in (("c", c_shape.sum()), ("ring", discs((15, 15), shape=(30, 30), radius=12).sum())):
        assert polygon_area(outline[g]) + len(outline[g]) / 2 + 1 == area
    assert [(p.x, p.y) for p in outline["dot"]] == [(0, 0)] and len(outline["pair"]) == 2
