"""Measurements of one region (cell or nucleus) from its pixels or its polygon.

Pixel rows are ``keys, x, y, v`` where ``keys`` names one region (image, region, label).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from petridish.functions import polygons as poly
from petridish.functions.numeric import col, compute_once, safe_divide
from petridish.operators.scale import summarise, with_group_stats


def join_signal(label_pixels: DataFrame, pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Region pixels with their intensity ``v``; the key ends in the pixel position, so one
    large image spreads over all tasks."""
    signal = pixels.select(*keys, "x", "y", "v")
    return label_pixels.join(signal, [*keys, "x", "y"])


def intensity_aggregates() -> dict[str, Column]:
    """Fifteen statistics in one aggregate; entropy is :func:`entropy`.

    ``percentile`` keeps one count per distinct gray level of a region, at most 65,536 for
    16-bit images.
    """
    n, mean, std = F.count("v"), F.avg("v"), F.stddev_pop("v")
    shape = (n >= 3) & (std > 0)
    levels = F.percentile("v", F.array(*[F.lit(p) for p in (0.10, 0.25, 0.75, 0.90)]))
    return {
        "Mean": mean,
        "StdDev": std,
        "Min": F.min("v"),
        "Max": F.max("v"),
        "IntDen": n * mean,
        "RawIntDen": F.sum("v"),
        "CV": safe_divide(std, mean),
        "Range": F.max("v") - F.min("v"),
        "P10": levels[0],
        "P25": levels[1],
        "P75": levels[2],
        "P90": levels[3],
        "IQR80": levels[3] - levels[0],
        "Skewness": F.when(shape, F.skewness("v")),
        "Kurtosis": F.when(shape, F.kurtosis("v")),
    }


def roi_intensity(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[c.alias(n) for n, c in intensity_aggregates().items()])


def roi_entropy(rows: DataFrame, keys: Sequence[str], bins: int = 256) -> DataFrame:
    """Shannon entropy (bits) of the histogram over the region's own range."""
    levels = rows.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("_c"))
    levels = with_group_stats(
        levels, keys, _lo=F.min("v"), _hi=F.max("v"), _n=F.sum("_c")
    )
    bin_ = F.when(
        F.col("_hi") > F.col("_lo"),
        F.least(
            F.floor((F.col("v") - F.col("_lo")) * bins / (F.col("_hi") - F.col("_lo"))),
            F.lit(bins - 1),
        ),
    ).otherwise(0)
    shares = levels.groupBy(*keys, "_n", bin_.alias("_b")).agg(F.sum("_c").alias("_c"))
    p = F.col("_c") / F.col("_n")
    return shares.groupBy(*keys).agg((F.abs(F.sum(p * F.log2(p)))).alias("Entropy"))


def centroid_area(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("area"), F.avg("x").alias("x_centroid"), F.avg("y").alias("y_centroid")
    )


def roi_moments(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Axes of the ellipse with the same second moments, extent and compactness."""
    m = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("area"),
        F.var_pop("x").alias("_xx"),
        F.var_pop("y").alias("_yy"),
        F.covar_pop(F.col("x").cast("double"), F.col("y").cast("double")).alias("_xy"),
        ((F.max("x") - F.min("x") + 1) * (F.max("y") - F.min("y") + 1)).alias("_box"),
    )
    half = (F.col("_xx") + F.col("_yy")) / 2.0
    root = F.sqrt(
        (F.col("_xx") - F.col("_yy")) * (F.col("_xx") - F.col("_yy")) / 4.0 + F.col("_xy") * F.col("_xy")
    )
    major, minor = half + root, F.greatest(half - root, F.lit(0.0))
    return m.select(
        *keys,
        "area",
        (4.0 * F.sqrt(major)).alias("major_axis_length"),
        (4.0 * F.sqrt(minor)).alias("minor_axis_length"),
        F.when(major > 0, F.sqrt(F.greatest(1.0 - minor / major, F.lit(0.0)))).alias("eccentricity"),
        (F.col("area") / F.col("_box")).alias("extent"),
        (2.0 * math.pi * (F.col("_xx") + F.col("_yy")) / F.col("area")).alias("compactness"),
    )


def distance_to_outside(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exact Euclidean distance of every region pixel to the nearest pixel outside.

    Separable: vertical runs give the distance within each column; along each row the
    lower envelope ``min((x - x')² + g(x')²)`` is taken over the row's own pixels and the
    run ends. Windows and arrays hold one region line.
    """
    keys = list(keys)
    column = Window.partitionBy(*keys, "x").orderBy("y")
    px = rows.select(*keys, "x", "y").withColumn("_i", F.col("y") - F.row_number().over(column))
    run = Window.partitionBy(*keys, "x", "_i")
    px = px.withColumn(
        "_g",
        F.least(
            F.col("y") - F.min("y").over(run) + 1, F.max("y").over(run) - F.col("y") + 1
        ),
    ).drop("_i")
    line = Window.partitionBy(*keys, "y").orderBy("x")
    px = px.withColumn("_j", F.col("x") - F.row_number().over(line))
    runs = px.groupBy(*keys, "y", "_j").agg(
        F.sort_array(F.collect_list(F.struct("x", "_g"))).alias("_l")
    )
    ends = F.array(
        F.struct((F.col("_l")[0].x - 1).alias("x"), F.lit(0).alias("_g")),
        F.struct((F.element_at("_l", -1).x + 1).alias("x"), F.lit(0).alias("_g")),
    )
    runs = compute_once(runs, _all=F.concat("_l", ends))
    best = F.transform(
        "_l",
        lambda p: F.struct(
            p.x.alias("x"),
            F.array_min(
                F.transform("_all", lambda q: (p.x - q.x) * (p.x - q.x) + q["_g"] * q["_g"])
            ).alias("d2"),
        ),
    )
    return runs.select(*keys, "y", F.explode(best).alias("_b")).select(
        *keys, F.col("_b.x").alias("x"), "y", F.sqrt(F.col("_b.d2").cast("double")).alias("distance")
    )


def roi_radii(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Largest, mean and median distance to the outside."""
    return distance_to_outside(rows, keys).groupBy(*keys).agg(
        F.max("distance").alias("maximum_radius"),
        F.avg("distance").alias("mean_radius"),
        F.median("distance").alias("median_radius"),
    )


def outline_geometry(polygons: DataFrame, points: str) -> DataFrame:
    """Add perimeter, hull perimeter, Feret length and solidity of a polygon."""
    p = compute_once(polygons, _e=poly.closed_edges(points))
    p = compute_once(p, perimeter=poly.perimeter("_e"), polygon_area=poly.area("_e"), _h=poly.hull_measures(F.col(points)))
    return p.select(
        *[c for c in p.columns if c not in ("_e", "_h")],
        F.col("_h.perimeter").alias("convex_perimeter"),
        F.col("_h.feret").alias("feret_length"),
        safe_divide("polygon_area", "_h.area").alias("solidity"),
    )


def geometry_derived(
    df: DataFrame,
    area: str = "area",
    perimeter: str = "perimeter",
    convex: str = "convex_perimeter",
    major: str = "major_axis_length",
    minor: str = "minor_axis_length",
) -> DataFrame:
    """Diameter, shape ratios and roughness from the basic measurements."""
    a, p = col(area), col(perimeter)
    return df.withColumns(
        {
            "circular_diameter": F.when(a > 0, 2.0 * F.sqrt(a / math.pi)),
            "aspect_ratio": safe_divide(major, minor),
            "roundness": F.when(col(major) > 0, 4.0 * a / (math.pi * col(major) * col(major))),
            "circularity": F.when(p > 0, 2.0 * F.sqrt(math.pi * a) / (p * p)),
            "sphericity": F.when(p > 0, 4.0 * math.pi * a / (p * p)),
            "roughness": F.when(p > 0, 1.0 - col(convex) / p),
            "perimeter_area_ratio": safe_divide(perimeter, area),
        }
    )


def cross_region(df: DataFrame) -> DataFrame:
    """Nucleus against cell: ratios, differences and centre offset over the cell radius.

    Expects suffixed ``_nuc``/``_cyto`` columns; the cell mask includes the nucleus.
    """
    def c(name):
        return F.col(name)

    offset = F.sqrt(
        (c("x_centroid_nuc") - c("x_centroid_cyto")) * (c("x_centroid_nuc") - c("x_centroid_cyto"))
        + (c("y_centroid_nuc") - c("y_centroid_cyto")) * (c("y_centroid_nuc") - c("y_centroid_cyto"))
    )
    return df.withColumns(
        {
            "Nuc Cyto Mean Ratio": safe_divide("Mean_nuc", "Mean_cyto"),
            "Nuc Cyto IntDen Ratio": safe_divide("IntDen_nuc", "IntDen_cyto"),
            "Nuc Cyto RawIntDen Ratio": safe_divide("RawIntDen_nuc", "RawIntDen_cyto"),
            "Nuc Cell IntDen Ratio": safe_divide("IntDen_nuc", "IntDen_cyto"),
            "Nuc Cyto Entropy Difference": c("Entropy_nuc") - c("Entropy_cyto"),
            "Nuc Cyto CV Difference": c("CV_nuc") - c("CV_cyto"),
            "Nucleus Centroid Offset": safe_divide(
                offset, F.when(c("area_cyto") > 0, F.sqrt(c("area_cyto") / math.pi))
            ),
        }
    )


def karyoplasmic_ratio(nuc: Column | str, cell: Column | str) -> Column:
    rest = col(cell) - col(nuc)
    return F.when(rest > 0, col(nuc) / rest)


def label_stats(label_pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Objects per image: count, median area, below 30 px, below 15 % of the median."""
    keys = list(keys)
    areas = label_pixels.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("area"))
    medians = summarise(areas, keys, {"n": F.count(F.lit(1))}, {"median": ("area", 0.5)})
    return areas.join(medians, keys).groupBy(*keys, "n", "median").agg(
        F.count_if(F.col("area") < 30).alias("lt30"),
        F.count_if(F.col("area") < 0.15 * F.col("median")).alias("lt15pct"),
    )


def boundary_pixels(label_pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pixels with a 4-neighbour outside their object.

    Every pixel marks itself and its four neighbours; one aggregate decides.
    """
    steps = F.array(
        *[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))]
    )
    marks = label_pixels.select(*keys, "x", "y", F.explode(steps).alias("_s")).groupBy(
        *keys, (F.col("x") + F.col("_s.dx")).alias("x"), (F.col("y") + F.col("_s.dy")).alias("y")
    ).agg(
        F.max((F.col("_s.dx") == 0) & (F.col("_s.dy") == 0)).alias("_self"),
        F.count(F.lit(1)).alias("_n"),
    )
    return marks.filter(F.col("_self") & (F.col("_n") < 5)).select(*keys, "x", "y")


def mask_to_loops(label_pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Closed boundaries of each object: ``loop, hole, points``, in the order along the boundary.

    The sides of the boundary pixels that face outwards are linked end to start, which closes each
    piece's outer boundary and each hole to a loop of its own (pieces that touch by a corner are
    one). Points are the pixels along the loop, the first one being the first in row order; parts
    one pixel wide are passed twice. The loops of an object, each a row, are traced in one task.
    """
    keys = list(keys)
    edge = boundary_pixels(label_pixels, keys)
    sides = ((0, -1), (1, 0), (0, 1), (-1, 0))
    inside = label_pixels.select(*keys, "x", "y").distinct()
    # of every boundary pixel the sides whose neighbour is not of the object
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for i, (dx, dy) in enumerate(sides)])
    asked = edge.select(*keys, F.col("x").alias("px"), F.col("y").alias("py"), F.explode(steps).alias("_s")).select(
        *keys, "px", "py", F.col("_s.i").alias("side"), (F.col("px") + F.col("_s.dx")).alias("x"), (F.col("py") + F.col("_s.dy")).alias("y")
    )
    open_sides = asked.join(inside, [*keys, "x", "y"], "left_anti").select(*keys, "px", "py", "side")
    first = ", ".join(f"`{k}` {open_sides.schema[k].dataType.simpleString()}" for k in keys)

    def trace(part: pd.DataFrame) -> pd.DataFrame:
        loops = boundary_loops(part["px"].to_numpy(np.int64), part["py"].to_numpy(np.int64), part["side"].to_numpy())
        same = {k: [part[k].iloc[0]] * len(loops) for k in keys}
        return pd.DataFrame({
            **same,
            "loop": range(len(loops)),
            "hole": [hole for hole, _ in loops],
            "points": [[{"x": int(a), "y": int(b)} for a, b in line] for _, line in loops],
        })

    return open_sides.groupBy(*keys).applyInPandas(
        trace, f"{first}, loop int, hole boolean, points array<struct<x: int, y: int>>"
    )


def boundary_loops(x: np.ndarray, y: np.ndarray, side: np.ndarray) -> list[tuple[bool, list[tuple[int, int]]]]:
    """(is a hole, pixels in order) of each loop of open pixel sides; 0 to 3: up, right, down, left."""
    # clockwise on screen: the corner where a side starts, and where it ends
    corner = [((0, 0), (1, 0)), ((1, 0), (1, 1)), ((1, 1), (0, 1)), ((0, 1), (0, 0))]
    order = np.lexsort((side, x, y))
    x, y, side = x[order].tolist(), y[order].tolist(), side[order].tolist()
    starts: dict[tuple[int, int], list[int]] = {}
    for i, (a, b, s) in enumerate(zip(x, y, side)):
        starts.setdefault((a + corner[s][0][0], b + corner[s][0][1]), []).append(i)
    used, loops = [False] * len(x), []
    for first in range(len(x)):
        if used[first]:
            continue
        at, line, turn = first, [], 0
        while not used[at]:
            used[at] = True
            pixel = (x[at], y[at])
            if not line or line[-1] != pixel:
                line.append(pixel)
            (a0, b0), (a1, b1) = corner[side[at]]
            turn += (pixel[0] + a0) * (pixel[1] + b1) - (pixel[0] + a1) * (pixel[1] + b0)
            onward = starts[pixel[0] + a1, pixel[1] + b1]
            # where two pixels touch by a corner the loop crosses over to the other one
            at = onward[0] if len(onward) == 1 else next(i for i in onward if (x[i], y[i]) != pixel)
        if len(line) > 1 and line[-1] == line[0]:
            line.pop()
        loops.append((turn < 0, line))
    return loops


def mask_to_outline(label_pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Outline of each object: its longest outer boundary, points in order along it."""
    loops = mask_to_loops(label_pixels, keys).filter("not hole")
    longest = F.max(F.struct(F.size("points").alias("n"), (-F.col("loop")).alias("l"), "points")).alias("_m")
    return loops.groupBy(*keys).agg(longest).select(*keys, F.col("_m.points").alias("points"))


def region_algebra(pixels: DataFrame, label_pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every image pixel with ``in_cell``, ``in_nucleus``, ``in_cytoplasm``, ``background``.

    One aggregate over the tagged union replaces several anti-joins. ``background`` is
    outside of every cell; a nucleus without a cell counts as one.
    """
    with_cell = label_pixels.select(
        *keys, "x", "y", "region", "label"
    )
    tagged = pixels.select(
        *keys, "x", "y", "v", F.lit(0).alias("_c"), F.lit(0).alias("_n")
    ).unionByName(
        with_cell.select(
            *keys,
            "x",
            "y",
            F.lit(None).cast("double").alias("v"),
            (F.col("region") == "cyto").cast("int").alias("_c"),
            (F.col("region") == "nuc").cast("int").alias("_n"),
        )
    )
    merged = tagged.groupBy(*keys, "x", "y").agg(
        F.max("v").alias("v"), F.max("_c").alias("_c"), F.max("_n").alias("_n")
    )
    return merged.select(
        *keys,
        "x",
        "y",
        "v",
        (F.col("_c") == 1).alias("in_cell"),
        (F.col("_n") == 1).alias("in_nucleus"),
        ((F.col("_c") == 1) & (F.col("_n") == 0)).alias("in_cytoplasm"),
        (F.col("_c") == 0).alias("background"),
    ).filter("v is not null")
