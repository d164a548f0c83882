"""Polygon arithmetic on one row's vertex array ``ARRAY<STRUCT<x, y>>``; no shuffle."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from petridish.functions.numeric import col, compute_once


def closed_edges(points: Column | str) -> Column:
    """Edges ``(x1, y1, x2, y2)`` including the closing one, as doubles."""
    p = col(points)
    rotated = F.concat(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 1, 1))
    return F.zip_with(
        p,
        rotated,
        lambda a, b: F.struct(
            a.x.cast("double").alias("x1"),
            a.y.cast("double").alias("y1"),
            b.x.cast("double").alias("x2"),
            b.y.cast("double").alias("y2"),
        ),
    )


def _total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, v: acc + v)


def perimeter(edges: Column | str) -> Column:
    return _total(
        F.transform(
            col(edges),
            lambda e: F.sqrt((e.x2 - e.x1) * (e.x2 - e.x1) + (e.y2 - e.y1) * (e.y2 - e.y1)),
        )
    )


def area(edges: Column | str) -> Column:
    """Shoelace area."""
    return F.abs(_total(F.transform(col(edges), lambda e: e.x1 * e.y2 - e.x2 * e.y1))) / 2.0


def vertex_mean(points: Column | str, axis: str) -> Column:
    p = col(points)
    return _total(F.transform(p, lambda q: q[axis].cast("double"))) / F.size(p)


def on_edge(edges: Column, x: Column, y: Column) -> Column:
    return F.exists(
        edges,
        lambda e: ((e.x2 - e.x1) * (y - e.y1) == (e.y2 - e.y1) * (x - e.x1))
        & (x >= F.least(e.x1, e.x2))
        & (x <= F.greatest(e.x1, e.x2))
        & (y >= F.least(e.y1, e.y2))
        & (y <= F.greatest(e.y1, e.y2)),
    )


def crossings_odd(edges: Column, x: Column, y: Column) -> Column:
    """Even-odd rule with half-open edges."""
    hits = F.filter(
        edges,
        lambda e: ((e.y1 > y) != (e.y2 > y))
        & (x < (e.x2 - e.x1) * (y - e.y1) / (e.y2 - e.y1) + e.x1),
    )
    return F.size(hits) % 2 == 1


def strictly_inside(edges: Column | str, x: Column | str, y: Column | str) -> Column:
    e, x, y = col(edges), col(x).cast("double"), col(y).cast("double")
    return crossings_odd(e, x, y) & ~on_edge(e, x, y)


def rasterize(
    polygons: DataFrame, points: str, width: int | Column, height: int | Column
) -> DataFrame:
    """Pixel rows ``x, y`` inside or on each polygon, clipped to the image.

    Only the edges that reach a line are tested on it, and rows are expanded in place. Joins with them
    are merged: Spark's size estimate leaves out the rows that an expansion makes, so that it would
    broadcast them.
    """
    others = [c for c in polygons.columns if c != points]
    w = F.lit(width) if isinstance(width, int) else width
    h = F.lit(height) if isinstance(height, int) else height
    base = compute_once(
        polygons.filter(F.size(points) >= 3),
        _edges=closed_edges(points),
        _xs=F.transform(points, lambda p: p.x),
        _ys=F.transform(points, lambda p: p.y),
    )
    # array_min/max bound the expansion; sequences run only where they are not empty
    base = compute_once(
        base,
        _x0=F.greatest(F.array_min("_xs"), F.lit(0)).cast("int"),
        _x1=F.least(F.array_max("_xs"), w - 1).cast("int"),
        _y0=F.greatest(F.array_min("_ys"), F.lit(0)).cast("int"),
        _y1=F.least(F.array_max("_ys"), h - 1).cast("int"),
    ).filter("_x0 <= _x1 and _y0 <= _y1")
    lines = base.select(
        *others, "_edges", "_x0", "_x1", F.explode(F.sequence("_y0", "_y1")).alias("y")
    )
    lines = compute_once(
        lines,
        _near=F.filter(
            "_edges",
            lambda e: (F.least(e.y1, e.y2) <= F.col("y")) & (F.greatest(e.y1, e.y2) >= F.col("y")),
        ),
    )
    px = lines.select(*others, "_near", "y", F.explode(F.sequence("_x0", "_x1")).alias("x"))
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    return px.filter(crossings_odd(F.col("_near"), x, y) | on_edge(F.col("_near"), x, y)).select(
        *others, "x", "y"
    ).hint("merge")


def shape_masks(xs: np.ndarray, ys: np.ndarray, x0: int, x1: int, y0: int, y1: int) -> np.ndarray:
    """Pixels ``[y0..y1, x0..x1]`` inside or on each of several polygons with as many vertices (one a row).

    The rule of `crossings_odd` and `on_edge`: an edge that crosses a line flips all pixels on its left.
    Edges with a missing coordinate do not count.
    """
    count, high, wide = len(xs), y1 - y0 + 1, x1 - x0 + 1
    ax, ay = xs[:, :, None], ys[:, :, None]
    bx, by = np.roll(xs, -1, 1)[:, :, None], np.roll(ys, -1, 1)[:, :, None]
    known = np.isfinite(ax) & np.isfinite(ay) & np.isfinite(bx) & np.isfinite(by)
    y = np.arange(y0, y1 + 1, dtype="float64")
    place = (np.arange(count)[:, None, None] * high + np.arange(high)) * (wide + 1)

    def counted(hit, column):
        column = np.clip(column, 0, wide).astype("int64")
        at = np.broadcast_to(place, hit.shape)[hit] + column
        return np.bincount(at, minlength=count * high * (wide + 1)).reshape(count, high, wide + 1)

    with np.errstate(all="ignore"):
        at = (bx - ax) * (y - ay) / (by - ay) + ax
        cross = known & ((ay > y) != (by > y))
        flips = counted(cross, np.ceil(at[cross]) - x0)
        near = np.rint(at)
        on = known & (ay != by) & (np.minimum(ay, by) <= y) & (y <= np.maximum(ay, by))
        on &= ((bx - ax) * (y - ay) == (by - ay) * (near - ax)) & (near >= x0) & (near <= x1)
        on &= (near >= np.minimum(ax, bx)) & (near <= np.maximum(ax, bx))
        flat = known & (ay == by) & (ay == y)
        shape = flat.shape
        left = np.ceil(np.broadcast_to(np.minimum(ax, bx), shape)[flat])
        right = np.floor(np.broadcast_to(np.maximum(ax, bx), shape)[flat])
    inside = flips[:, :, ::-1].cumsum(2)[:, :, ::-1][:, :, 1:] % 2 == 1
    inside |= counted(on, near[on] - x0)[:, :, :wide] > 0
    # an edge without whole pixels begins after its end
    spans = counted(flat, left - x0) - counted(flat, np.maximum(right + 1, left) - x0)
    inside |= spans.cumsum(2)[:, :, :wide] > 0
    return inside


def box_in(xs: np.ndarray, ys: np.ndarray, width: int, height: int) -> tuple[int, int, int, int] | None:
    """``x0, x1, y0, y1`` of the part of a polygon's box that lies in the image; None if there is none."""
    if not (np.isfinite(xs).any() and np.isfinite(ys).any()):
        return None
    x0, x1 = max(int(np.nanmin(xs)), 0), min(int(np.nanmax(xs)), width - 1)
    y0, y1 = max(int(np.nanmin(ys)), 0), min(int(np.nanmax(ys)), height - 1)
    return (x0, x1, y0, y1) if x0 <= x1 and y0 <= y1 else None


def _hull(points: np.ndarray) -> list[int]:
    """Indices of the convex hull's corners in counter-clockwise order (monotone chain)."""
    order = sorted(range(len(points)), key=lambda i: (points[i][0], points[i][1]))

    def half(indices):
        chain: list[int] = []
        for i in indices:
            while len(chain) >= 2:
                o, a, b = points[chain[-2]], points[chain[-1]], points[i]
                if (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0]) > 0:
                    break
                chain.pop()
            chain.append(i)
        return chain

    lower, upper = half(order), half(order[::-1])
    return lower[:-1] + upper[:-1]


HULL_TYPE = T.StructType(
    [T.StructField(n, T.DoubleType()) for n in ("perimeter", "area", "feret")]
)


@F.pandas_udf(HULL_TYPE)
def hull_measures(polygons: pd.Series) -> pd.DataFrame:
    """Perimeter, area and largest corner distance of each polygon's convex hull."""
    rows = []
    for vertices in polygons:
        if vertices is None or len(vertices) < 3:
            rows.append((None, None, None))
            continue
        pts = np.array([(v["x"], v["y"]) for v in vertices], dtype="float64")
        h = pts[_hull(pts)]
        nxt = np.roll(h, -1, axis=0)
        length = float(np.hypot(*(nxt - h).T).sum())
        surface = float(abs((h[:, 0] * nxt[:, 1] - nxt[:, 0] * h[:, 1]).sum()) / 2.0)
        reach = max(float(np.hypot(*(h - p).T).max()) for p in h)
        rows.append((length, surface, reach))
    return pd.DataFrame(rows, columns=["perimeter", "area", "feret"])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def defect_depths(polygons: pd.Series) -> pd.Series:
    """Per polygon, the depth of every hull gap: largest vertex distance to its hull edge.

    Depths are kept in steps of 1/256.
    """
    out = []
    for vertices in polygons:
        if vertices is None or len(vertices) < 4:
            out.append(None)
            continue
        pts = np.array([(v["x"], v["y"]) for v in vertices], dtype="float64")
        corners = sorted(_hull(pts))
        depths = []
        for a, b in zip(corners, corners[1:] + [corners[0] + len(pts)]):
            if b - a < 2:
                continue
            gap = pts[[i % len(pts) for i in range(a + 1, b)]]
            p, q = pts[a], pts[b % len(pts)]
            d = np.abs((q[0] - p[0]) * (gap[:, 1] - p[1]) - (q[1] - p[1]) * (gap[:, 0] - p[0]))
            depths.append(float(np.rint(d.max() / np.hypot(*(q - p)) * 256.0) / 256.0))
        out.append(depths)
    return pd.Series(out)
