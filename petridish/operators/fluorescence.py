"""Fluorescence rings, IDO response and Ki67 labelling."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from petridish.functions.numeric import sides
from petridish.functions.polygons import box_in, shape_masks
from petridish.functions.text import ring_cell_id, ring_number
from petridish.operators import stencil as st
from petridish.operators.scale import summarise, with_group_stats
from petridish.session import materialize


#: pixels of grown shapes that are made at a time
GROWN_PIXELS = 1 << 20


def scaled(xs: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """One axis of a polygon scaled about the centre of its box, a row for each factor; cut to whole pixels."""
    centre = (np.nanmin(xs) + np.nanmax(xs)) / 2.0
    return np.trunc(centre + (xs - centre) * factors[:, None])


def _ring_pixels(outlines: list, width: int, height: int, steps: int, growth: float) -> np.ndarray:
    """Pixels ``(ring * height + y) * width + x`` of the rings of the outlines of one cell."""

    def polygon(outline, side):
        return np.array([list(outline[f"{side}_{axis}"]) for axis in ("x", "y")], dtype="float64")

    cells = [polygon(o, "cyto") for o in outlines]
    cells = [(p, box) for p in cells if p.shape[1] >= 3 and (box := box_in(*p, width, height))]
    if not cells:
        return np.zeros(0, "int64")
    x0, y0 = (min(box[i] for _, box in cells) for i in (0, 2))
    x1, y1 = (max(box[i] for _, box in cells) for i in (1, 3))
    # outlines that come twice count twice
    cell = sum(shape_masks(*p[:, None], x0, x1, y0, y1)[0].astype("int64") for p, _ in cells)
    factors = 1.0 + growth * np.arange(steps + 1)
    member = np.zeros((steps + 1, *cell.shape), bool)
    spills = np.zeros(steps + 1, bool)
    for p in (polygon(o, "nuc") for o in outlines):
        if p.shape[1] < 3 or not (np.isfinite(p[0]).any() and np.isfinite(p[1]).any()):
            continue
        xs, ys = (scaled(axis, factors) for axis in p)
        first = 0
        while first <= steps:
            # as many steps at a time as the box of the last one allows
            last = steps + 1
            while True:
                box = box_in(xs[first:last], ys[first:last], width, height)
                if last == first + 1 or box is None:
                    break
                if (box[1] - box[0] + 2) * (box[3] - box[2] + 1) * (last - first) <= GROWN_PIXELS:
                    break
                last = first + max((last - first) // 2, 1)
            if box is not None:
                shape = shape_masks(xs[first:last], ys[first:last], *box)
                a, b, c, d = max(x0, box[0]), min(x1, box[1]), max(y0, box[2]), min(y1, box[3])
                held = np.zeros(last - first, "int64")
                if a <= b and c <= d:
                    part = shape[:, c - box[2] : d - box[2] + 1, a - box[0] : b - box[0] + 1]
                    member[first:last, c - y0 : d - y0 + 1, a - x0 : b - x0 + 1] |= part
                    held = (part & (cell[c - y0 : d - y0 + 1, a - x0 : b - x0 + 1] > 0)).sum((1, 2))
                spills[first:last] |= shape.sum((1, 2)) > held
            first = last
    member &= cell > 0
    found = []
    for k in range(1, steps + 1):
        band = member[k] & ~member[k - 1]
        # a closed ring that adds no pixel to the cell part of its predecessor does not exist
        if band.any():
            y, x = np.nonzero(band if spills[k - 1] else member[k])
            found.append(np.repeat(((k - 1) * height + y + y0) * width + x + x0, cell[y, x]))
    return np.concatenate(found) if found else np.zeros(0, "int64")


def fluor_rings(
    outlines: DataFrame,
    pixels: DataFrame,
    image: Sequence[str],
    width: int | Column,
    height: int | Column,
    steps: int = 20,
    growth: float = 0.5,
) -> DataFrame:
    """Intensity in rings grown from the nucleus and clipped to the cell.

    Ring ``k`` lies between the nucleus scaled by ``1 + growth * k`` and by one step more.
    Where the smaller shape lies wholly inside the cell the ring is a closed band, and its
    outer outline is measured as a filled shape, as the outline of a clipped ring has no hole.
    ``outlines(image, roi_id, nuc, cyto)``, both sides present; returns ``image, roi_id,
    ring, IntDen, RawIntDen``.
    """
    image = list(image)
    keys = [*image, "roi_id"]
    coordinates = [
        F.coalesce(F.col(side)[axis].cast("array<double>"), F.array()).alias(f"{side}_{axis}")
        for side in ("nuc", "cyto")
        for axis in ("x", "y")
    ]
    width, height = sides(width, height)
    # outlines of one number are one shape; its rings are made in one task, as its boundary is
    shapes = outlines.dropna(subset=keys).groupBy(*keys).agg(F.collect_list(F.struct(*coordinates)).alias("_p"))
    shapes = shapes.select(*keys, "_p", width.cast("long").alias("_w"), height.cast("long").alias("_h"))

    @F.pandas_udf("array<long>")
    def rings_of(shapes: pd.Series, widths: pd.Series, heights: pd.Series) -> pd.Series:
        args = zip(shapes, widths, heights)
        return pd.Series([_ring_pixels(list(p), int(w), int(h), steps, growth) for p, w, h in args], dtype=object)

    rings = shapes.select(*keys, "_w", "_h", F.explode(rings_of("_p", "_w", "_h")).alias("_at")).select(
        *keys,
        F.expr("cast(_at % _w as int)").alias("x"),
        F.expr("cast(_at div _w % _h as int)").alias("y"),
        F.expr("cast(_at div _w div _h as int)").alias("ring"),
    )
    # one row per pixel of every ring, expanded: more than Spark expects, not to be broadcast
    measured = rings.hint("merge").join(pixels.select(*image, "x", "y", "v"), [*image, "x", "y"])
    return measured.groupBy(*keys, "ring").agg(
        (F.count(F.lit(1)) * F.avg("v")).alias("IntDen"), F.sum("v").alias("RawIntDen")
    )


def flatten_rings(rings: DataFrame, steps: int = 20, label: str = "Label") -> DataFrame:
    """Ring rows labelled ``<image>:NewCell-<n>-and<ring>`` to one row per cell."""
    parsed = rings.select(
        ring_cell_id(label).alias("Cell_ID"), ring_number(label).alias("_ring"), "IntDen", "RawIntDen"
    ).filter("_ring is not null")
    return parsed.groupBy("Cell_ID").agg(
        *[
            F.max(F.when(F.col("_ring") == k, F.col(v))).alias(f"{v}-{k}")
            for v in ("IntDen", "RawIntDen")
            for k in range(steps)
        ]
    )


def ido_measure(label_pixels: DataFrame, pixels: DataFrame, image: Sequence[str]) -> DataFrame:
    """IDO response per cell on the true cytoplasm against the image background.

    ``IDO_BackgroundMean`` is the median of the pixels outside all cells, and ``IDO_IntDen``
    equals the corrected mean; only ``IDO_IntDen_BgSub`` multiplies by the area.
    """
    image = list(image)
    both = label_pixels.groupBy(*image, "label").agg(
        F.countDistinct("region").alias("_sides")
    ).filter("_sides = 2")
    lp = label_pixels.join(both.select(*image, "label"), [*image, "label"], "left_semi")
    per_label = lp.groupBy(*image, "label", "x", "y").agg(
        F.max((F.col("region") == "nuc").cast("int")).alias("_n"),
        F.max((F.col("region") == "cyto").cast("int")).alias("_c"),
    )
    covered = per_label.filter("_c = 1").select(*image, "x", "y").distinct()
    outside = pixels.select(*image, "x", "y", "v").join(covered, [*image, "x", "y"], "left_anti")
    background = summarise(outside, image, percentiles={"IDO_BackgroundMean": ("v", 0.5)})
    cells = (
        per_label.join(pixels.select(*image, "x", "y", "v"), [*image, "x", "y"])
        .groupBy(*image, "label")
        .agg(
            F.count_if((F.col("_c") == 1) & (F.col("_n") == 0)).alias("_area"),
            F.avg(F.when((F.col("_c") == 1) & (F.col("_n") == 0), F.col("v"))).alias("IDO_MeanIntensity"),
        )
        .join(background, image, "left")
    )
    corrected = F.col("IDO_MeanIntensity") - F.col("IDO_BackgroundMean")
    return cells.select(
        *image,
        "label",
        "IDO_BackgroundMean",
        "IDO_MeanIntensity",
        corrected.alias("IDO_MeanIntensity_BgSub"),
        corrected.alias("IDO_IntDen"),
        (F.col("_area") * corrected).alias("IDO_IntDen_BgSub"),
    )


def brightest_channel(pixels: DataFrame, image: Sequence[str], channels: Sequence[str] = ("b", "g", "r")) -> DataFrame:
    """Keep the channel with the highest mean as ``v``; the first one wins a tie."""
    stats = {f"_m_{c}": F.avg(c) for c in channels}
    df = with_group_stats(pixels, image, **stats)
    best = F.array_max(
        F.array(*[F.struct(F.col(f"_m_{c}").alias("m"), F.lit(-i).alias("i")) for i, c in enumerate(channels)])
    )
    value = None
    for i, c in enumerate(channels):
        hit = best.i == -i
        value = F.when(hit, F.col(c)) if value is None else value.when(hit, F.col(c))
    return df.select(*image, "x", "y", value.cast("double").alias("v"))


def ki67_binarize(
    pixels: DataFrame,
    image: Sequence[str],
    width: int,
    height: int,
    sigma: float = 1.5,
    clip: float = 2.0,
    scale: float = 0.85,
    min_area: int = 50,
    open_size: int = 3,
) -> DataFrame:
    """Positive pixels of a Ki67 channel: blur, stretch, equalise, Otsu, open, drop specks."""
    image = list(image)
    blurred = st.gaussian_blur(pixels, image, sigma)
    ranged = with_group_stats(blurred, image, _lo=F.min("v"), _hi=F.max("v"))
    share = F.try_divide(F.col("v") - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    stretched = materialize(
        ranged.select(
            *image, "x", "y", F.floor(F.round(F.coalesce(share, F.lit(0.0)) * 255.0, 9)).cast("double").alias("v")
        )
    )
    if clip and clip > 0:
        stretched = materialize(st.clahe(stretched, image, width, height, clip))
    level = gray_otsu(stretched, image).select(
        *image, F.greatest(F.lit(1.0), F.floor(F.col("threshold") * scale).cast("double")).alias("_level")
    )
    mask = stretched.join(level, image).filter(F.col("v") > F.col("_level")).select(*image, "x", "y")
    w, h = F.lit(width), F.lit(height)
    if open_size and open_size > 1:
        mask = materialize(st.open_mask(mask, image, w, h, open_size // 2))
    return st.remove_small(mask, image, min_area)


def fixed_threshold_mask(pixels: DataFrame, image: Sequence[str], level: float = 13.0, min_area: int = 50) -> DataFrame:
    """The alternative rule: a fixed gray level and a size limit."""
    return st.remove_small(pixels.filter(F.col("v") > level).select(*image, "x", "y"), image, min_area)


def gray_otsu(pixels: DataFrame, image: Sequence[str]) -> DataFrame:
    """Otsu level of 8-bit values on their own 256 gray levels."""
    image = list(image)
    levels = pixels.groupBy(*image, F.col("v").cast("int").alias("g")).agg(F.count(F.lit(1)).alias("_c"))
    from pyspark.sql import Window

    # at most 256 rows per image
    up = Window.partitionBy(*image).orderBy("g").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*image).orderBy("g").rowsBetween(1, Window.unboundedFollowing)
    mass = F.col("_c") * F.col("g")
    scored = levels.select(
        *image,
        "g",
        F.sum("_c").over(up).alias("_w1"),
        F.sum(mass).over(up).alias("_s1"),
        F.sum("_c").over(down).alias("_w2"),
        F.sum(mass).over(down).alias("_s2"),
    )
    gap = F.col("_s1") / F.col("_w1") - F.try_divide("_s2", "_w2")
    between = F.coalesce(F.col("_w1").cast("double") * F.col("_w2") * gap * gap, F.lit(-1.0))
    best = F.max(F.struct(F.round(between, 3).alias("q"), (-F.col("g")).alias("g")))
    return scored.groupBy(*image).agg((-best.getField("g")).cast("double").alias("threshold"))


def ki67_positive(
    label_pixels: DataFrame, mask: DataFrame, image: Sequence[str], threshold: float = 0.10
) -> DataFrame:
    """Nuclei with their mask share; positive at ``threshold`` and above."""
    lit = mask.select(*image, "x", "y").distinct().withColumn("_hit", F.lit(1))
    return (
        label_pixels.filter("region = 'nuc'")
        .join(lit, [*image, "x", "y"], "left")
        .groupBy(*image, "label")
        .agg((F.count("_hit") / F.count(F.lit(1))).alias("overlap"))
        .withColumn("ki67_positive", (F.col("overlap") >= threshold).cast("int"))
    )
