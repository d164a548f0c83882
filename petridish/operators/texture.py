"""Texture of one region: co-occurrence, local binary patterns, coarseness, Zernike moments.

``keys`` names one region. Region crops are gap-free grids, so neighbourhoods come from
windows over single pixel lines.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from petridish.functions.numeric import compute_once, sides
from petridish.operators import stencil as st
from petridish.operators.scale import with_group_stats

# Gray levels of the co-occurrence matrix and its four directions at distance
# 1 (0°, 45°, 90°, 135°), radii of the uniform patterns, degree of the Zernike moments.
GRAY_LEVELS = 64
DIRECTIONS = ((1, 0), (1, 1), (0, 1), (-1, 1))
RADII = (1, 2, 3)
DEGREE = 8
MIN_PIXELS = 16


def to_uint8(pixels: DataFrame, image: Sequence[str], value: str = "v") -> DataFrame:
    """8-bit gray ``u8``: [0, 1] is stretched by 255, 0..255 stays, other ranges are rescaled."""
    df = with_group_stats(pixels, image, _lo=F.min(value), _hi=F.max(value))
    lo, hi, v = F.col("_lo"), F.col("_hi"), F.col(value)
    scaled = (
        F.when((lo >= 0) & (hi <= 1), v * 255.0)
        .when((lo >= 0) & (hi <= 255), v)
        .when(hi > lo, (v - lo) / (hi - lo) * 255.0)
        .otherwise(0.0)
    )
    return df.withColumn(
        "u8", F.least(F.greatest(F.bround(scaled, 0), F.lit(0.0)), F.lit(255.0)).cast("int")
    ).drop("_lo", "_hi")


def quantize_levels(pixels: DataFrame, keys: Sequence[str], levels: int, value: str = "v") -> DataFrame:
    """``level`` from an even split of the key's own range."""
    df = with_group_stats(pixels, keys, _lo=F.min(value), _hi=F.max(value))
    share = (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    level = F.when(
        F.col("_hi") > F.col("_lo"), F.least(F.floor(share * levels), F.lit(levels - 1))
    ).otherwise(0)
    return df.withColumn("level", level.cast("int")).drop("_lo", "_hi")


def texture_crop(
    rows: DataFrame,
    keys: Sequence[str],
    width: Column,
    height: Column,
    erode_px: int = 2,
    distance: int = 1,
) -> DataFrame:
    """Gap-free crop ``keys, x, y, v, in_mask`` around each region.

    The region is eroded ``erode_px`` times by a cross unless too few pixels would remain,
    padded by ``distance`` inside the image, and filled with its mean outside the mask.
    Regions below the minimum size have no crop.
    """
    keys = list(keys)
    width, height = sides(width, height)
    need = max(MIN_PIXELS, (distance + 1) ** 2)
    px = rows.select(*keys, "x", "y", "v")
    if erode_px > 0:
        # erode_px crosses in a row are one diamond: the pixels within that many steps
        steps = F.array(
            *[
                F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
                for dy in range(-erode_px, erode_px + 1)
                for dx in range(-erode_px + abs(dy), erode_px - abs(dy) + 1)
            ]
        )
        marks = (
            px.select(*keys, "x", "y", "v", F.explode(steps).alias("_s"))
            .withColumn("_self", (F.col("_s.dx") == 0) & (F.col("_s.dy") == 0))
            .groupBy(
                *keys,
                (F.col("x") + F.col("_s.dx")).alias("x"),
                (F.col("y") + F.col("_s.dy")).alias("y"),
            )
            .agg(
                F.count(F.lit(1)).alias("_hits"),
                F.max(F.when(F.col("_self"), F.col("v"))).alias("v"),
                F.max("_self").alias("_self"),
            )
            .filter("_self")
        )

        size = None
        for dy in range(-erode_px, erode_px + 1):
            half = erode_px - abs(dy)
            span = (
                F.least(F.col("x") + half, width - 1) - F.greatest(F.col("x") - half, F.lit(0)) + 1
            )
            term = F.when((F.col("y") + dy >= 0) & (F.col("y") + dy < height), span).otherwise(0)
            size = term if size is None else size + term
        px = marks.withColumn("_core", F.col("_hits") == size)
        px = with_group_stats(px, keys, _left=F.count_if("_core"))
        px = px.filter(F.col("_core") | (F.col("_left") < need))
    stats = px.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg("v").alias("_fill"),
        F.greatest(F.min("x") - distance, F.lit(0)).alias("_x0"),
        F.least(F.max("x") + distance, (width - 1).cast("int")).alias("_x1"),
        F.greatest(F.min("y") - distance, F.lit(0)).alias("_y0"),
        F.least(F.max("y") + distance, (height - 1).cast("int")).alias("_y1"),
    )
    stats = stats.filter(
        (F.col("_n") >= need)
        & (F.col("_x1") - F.col("_x0") + 1 > distance)
        & (F.col("_y1") - F.col("_y0") + 1 > distance)
    )
    grid = (
        stats.withColumn("y", F.explode(F.sequence("_y0", "_y1")))
        .withColumn("x", F.explode(F.sequence("_x0", "_x1")))
        .select(*keys, "x", "y", "_fill")
    )
    mask = px.select(*keys, "x", "y", F.col("v").alias("_v"))
    return grid.join(mask, [*keys, "x", "y"], "left").select(
        *keys,
        "x",
        "y",
        F.coalesce("_v", "_fill").alias("v"),
        F.col("_v").isNotNull().alias("in_mask"),
    ).repartition(*keys)  # windows over the lines of a region reuse this partitioning


# --- co-occurrence ----------------------------------------------------------------------


def box_grid(rows: DataFrame, keys: Sequence[str], value: str, fill: float = 0) -> DataFrame:
    """Bounding-box grid of each region with ``fill`` outside of it."""
    keys = list(keys)
    box = rows.groupBy(*keys).agg(
        F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1")
    )
    grid = (
        box.withColumn("y", F.explode(F.sequence("_y0", "_y1")))
        .withColumn("x", F.explode(F.sequence("_x0", "_x1")))
        .select(*keys, "x", "y")
    )
    joined = grid.join(rows.select(*keys, "x", "y", value), [*keys, "x", "y"], "left").withColumn(
        value, F.coalesce(value, F.lit(fill))
    )
    # one region is one bounded crop: all windows and counts below reuse this partitioning
    return joined.repartition(*keys)


def glcm(rows: DataFrame, keys: Sequence[str], levels: int = GRAY_LEVELS, masked: bool = False) -> DataFrame:
    """Unordered gray-level pairs per direction: ``keys, angle, i <= j, n``.

    ``rows`` has the 8-bit value ``u8``. Pixels of the bounding box outside the region
    count as level 0; with ``masked`` only pairs inside the region count. The symmetric
    matrix has ``n / 2N`` in each of its two cells (``n / N`` on the diagonal).
    """
    keys = list(keys)
    if masked:
        grid = box_grid(rows, keys, "u8", -1)
    else:
        grid = box_grid(rows, keys, "u8", 0)
    grid = grid.withColumn(
        "level", F.when(F.col("u8") >= 0, F.floor(F.col("u8") / 256.0 * levels).cast("int"))
    )
    near = st.stencil(grid.select(*keys, "x", "y", "level"), keys, 1, "level")
    pairs = F.array(
        *[
            F.struct(F.lit(a).alias("angle"), st.neighbour(dx, dy, 1).alias("other"))
            for a, (dx, dy) in enumerate(DIRECTIONS)
        ]
    )
    return (
        near.withColumn("_p", F.explode(pairs))
        .filter(F.col("_p.other").isNotNull() & F.col("level").isNotNull())
        .groupBy(
            *keys,
            F.col("_p.angle").alias("angle"),
            F.least("level", "_p.other").alias("i"),
            F.greatest("level", "_p.other").alias("j"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )


def glcm_props(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Six properties of the symmetric normalised matrix, averaged over the directions.

    All sums are over counts and are divided by their total N afterwards (by N² for the second
    moment; the entropy is log N less a sum), so the pairs are read once.
    """
    keys = list(keys)
    n = F.col("n").cast("double")
    same = F.col("i") == F.col("j")
    d = (F.col("j") - F.col("i")).cast("double")
    i, j = F.col("i").cast("double"), F.col("j").cast("double")
    total = F.col("_total")
    sums = pairs.groupBy(*keys, "angle").agg(
        F.sum(n).alias("_total"),
        # an unordered pair of different levels is two cells of n / 2
        F.sum(F.when(same, n * n).otherwise(n * n / 2.0)).alias("_squares"),
        F.sum(n * F.log(F.when(same, n).otherwise(n / 2.0))).alias("_logs"),
        F.sum(n * d * d).alias("_dd"),
        F.sum(n / (1.0 + d * d)).alias("_near"),
        F.sum(n * d).alias("_d"),
        F.sum(n * (i + j) / 2.0).alias("_level"),
        F.sum(n * (i * i + j * j) / 2.0).alias("_level2"),
        F.sum(n * i * j).alias("_product"),
        F.count(F.lit(1)).alias("_kinds"),
        F.max(same.cast("int")).alias("_diag"),
    )
    per_angle = sums.select(
        *keys,
        (F.col("_squares") / (total * total)).alias("asm"),
        (F.col("_dd") / total).alias("contrast"),
        (F.col("_near") / total).alias("homogeneity"),
        F.abs(F.log(total) - F.col("_logs") / total).alias("entropy"),
        (F.col("_d") / total).alias("_md"),
        (F.col("_level") / total).alias("_mu"),
        (F.col("_level2") / total).alias("_sq"),
        (F.col("_product") / total).alias("_ij"),
        "_kinds",
        "_diag",
    )
    variance = F.col("_sq") - F.col("_mu") * F.col("_mu")
    flat = (F.col("_kinds") == 1) & (F.col("_diag") == 1)
    per_angle = per_angle.select(
        *keys,
        "asm",
        "contrast",
        F.when(flat, 1.0)
        .otherwise((F.col("_ij") - F.col("_mu") * F.col("_mu")) / variance)
        .alias("correlation"),
        (F.col("contrast") - F.col("_md") * F.col("_md")).alias("difference_variance"),
        "entropy",
        "homogeneity",
    )
    names = ("asm", "contrast", "correlation", "difference_variance", "entropy", "homogeneity")
    return per_angle.groupBy(*keys).agg(*[F.avg(n).alias(n) for n in names])


# --- local binary patterns --------------------------------------------------------------

# Fixed value: neighbour order of the 8-neighbour code, bit 0 first.
LBP_ORDER = ((-1, -1), (0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0))


def transitions(code: Column) -> Column:
    """Number of 0/1 changes around an 8-bit ring."""
    rotated = F.shiftleft(code.bitwiseAND(127), 1).bitwiseOR(F.shiftright(code, 7))
    return F.bit_count(code.bitwiseXOR(rotated))


def lbp_codes(crop: DataFrame, keys: Sequence[str]) -> DataFrame:
    """8-neighbour code of every mask pixel with a full neighbourhood."""
    levels = quantize_levels(crop, keys, 256)
    near = st.stencil(levels.select(*keys, "x", "y", "level", "in_mask"), keys, 1, "level")
    code = None
    complete = None
    for bit, (dx, dy) in enumerate(LBP_ORDER):
        n = st.neighbour(dx, dy, 1)
        term = F.when(n >= F.col("level"), 1 << bit).otherwise(0)
        code = term if code is None else code + term
        complete = n.isNotNull() if complete is None else complete & n.isNotNull()
    return near.filter(F.col("in_mask") & complete).select(*keys, "x", "y", code.alias("code"))


def lbp8(crop: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Code mean, deviation, entropy (bits), share of uniform codes, 16-bin histogram."""
    keys = list(keys)
    counts = lbp_codes(crop, keys).groupBy(*keys, "code").agg(F.count(F.lit(1)).alias("_c"))
    n, code = F.col("_c").cast("double"), F.col("code").cast("double")
    total = F.col("_n")
    sums = counts.groupBy(*keys).agg(
        F.sum(n).alias("_n"),
        F.sum(n * code).alias("_codes"),
        F.sum(n * code * code).alias("_squares"),
        F.sum(n * F.log2(n)).alias("_logs"),
        F.sum(F.when(transitions(F.col("code")) <= 2, n).otherwise(0.0)).alias("_uniform"),
        *[
            F.sum(F.when(F.floor(F.col("code") / 16) == b, n).otherwise(0.0)).alias(f"_bin_{b:02d}")
            for b in range(16)
        ],
    )
    mean = F.col("_codes") / total
    return sums.select(
        *keys,
        mean.alias("lbp_mean"),
        F.abs(F.log2(total) - F.col("_logs") / total).alias("lbp_entropy"),
        (F.col("_uniform") / total).alias("lbp_uniform_ratio"),
        *[(F.col(f"_bin_{b:02d}") / total).alias(f"lbp_bin_{b:02d}") for b in range(16)],
        F.sqrt(F.greatest(F.col("_squares") / total - mean * mean, F.lit(0.0))).alias("lbp_std"),
    )


def ring_samples(radius: int, snap: int = st.SNAP) -> list[list[tuple[int, int, float]]]:
    """Bilinear terms ``(dx, dy, weight)`` of the eight ring positions of a radius."""
    rings = []
    for k in range(8):
        angle = 2.0 * math.pi * k / 8
        px = round(radius * math.cos(angle) * snap) / snap
        py = round(-radius * math.sin(angle) * snap) / snap
        x0, y0 = math.floor(px), math.floor(py)
        fx, fy = px - x0, py - y0
        terms = [
            (x0 + i, y0 + j, (fx if i else 1 - fx) * (fy if j else 1 - fy)) for j in (0, 1) for i in (0, 1)
        ]
        rings.append([t for t in terms if t[2] > 0])
    return rings


def lbp_multiradius(
    crop: DataFrame, keys: Sequence[str], radii: Sequence[int] = RADII
) -> DataFrame:
    """Ten-bin uniform pattern histogram per radius: ``keys, radius, bin, share``.

    A pixel counts when the round element of the radius fits the mask and the pixel is at
    least a radius away from the crop's rim. The crop must be padded by the largest radius.
    """
    keys = list(keys)
    reach = max(radii)
    near = st.stencil(
        crop.withColumn("_m", F.struct("v", "in_mask")).select(*keys, "x", "y", "_m"), keys, reach, "_m"
    )
    entries = []
    for r in radii:
        here = st.neighbour(0, 0, reach)
        fits = here.in_mask
        for dy in range(-r, r + 1):
            half = round(r * math.sqrt(1 - dy * dy / (r * r)))
            for dx in range(-half, half + 1):
                n = st.neighbour(dx, dy, reach)
                fits = fits & F.coalesce(n.in_mask, F.lit(False))
        for dx, dy in ((r, 0), (-r, 0), (0, r), (0, -r)):
            fits = fits & st.neighbour(dx, dy, reach).isNotNull()
        code = None
        for bit, terms in enumerate(ring_samples(r)):
            sample = None
            for dx, dy, w in terms:
                t = st.neighbour(dx, dy, reach).v * F.lit(w)
                sample = t if sample is None else sample + t
            term = F.when(sample >= here.v, 1 << bit).otherwise(0)
            code = term if code is None else code + term
        entries.append(F.when(fits, F.struct(F.lit(r).alias("radius"), code.alias("code"))))
    codes = (
        near.select(*keys, F.explode(F.array(*entries)).alias("_e"))
        .filter("_e is not null")
        .select(*keys, F.col("_e.radius").alias("radius"), F.col("_e.code").alias("code"))
    )
    uniform = F.when(transitions(F.col("code")) <= 2, F.bit_count("code")).otherwise(9)
    counts = codes.groupBy(*keys, "radius", uniform.alias("bin")).agg(F.count(F.lit(1)).alias("_c"))
    ten = Window.partitionBy(*keys, "radius")  # ten rows at most
    return counts.select(*keys, "radius", "bin", (F.col("_c") / F.sum("_c").over(ten)).alias("share"))


# --- coarseness -------------------------------------------------------------------------


def tamura_coarseness(crop: DataFrame, keys: Sequence[str], max_power: int = 5) -> DataFrame:
    """Mean of the box size (1, 2, 4, …) with the strongest contrast per mask pixel."""
    keys = list(keys)
    powers = range(max_power + 1)

    def box(p):
        size = 2**p
        return {k: 1.0 / size for k in range(-(size // 2), size - size // 2)}

    boxed = crop.withColumn("_keep", F.col("in_mask").cast("double"))
    across = st.along(
        boxed, keys, "x", {**{f"a{p}": ("v", box(p)) for p in powers}, "m": ("_keep", {0: 1.0})}, "reflect"
    )
    full = st.along(
        across, keys, "y", {**{f"a{p}": (f"a{p}", box(p)) for p in powers}, "m": ("m", {0: 1.0})}, "reflect"
    )
    line = Window.partitionBy(*keys, "y").orderBy("x")
    column = Window.partitionBy(*keys, "x").orderBy("y")

    def contrast(p, w):
        o = max(1, 2**p // 2)
        return F.abs(F.lead(f"a{p}", o).over(w) - F.lag(f"a{p}", o).over(w))

    full = full.withColumns({f"h{p}": contrast(p, line) for p in powers})
    full = full.withColumns({f"w{p}": contrast(p, column) for p in powers})
    full = with_group_stats(
        full,
        keys,
        _side=F.least(F.max("x") - F.min("x") + 1, F.max("y") - F.min("y") + 1),
    )
    # greatest skips a missing direction; the smaller box wins a tie
    best = F.array_max(
        F.array(
            *[
                F.struct(
                    F.coalesce(
                        F.when(F.col("_side") >= 2**p, F.greatest(f"h{p}", f"w{p}")), F.lit(-1.0)
                    ).alias("r"),
                    F.lit(-p).alias("p"),
                )
                for p in powers
            ]
        )
    )
    return (
        full.withColumn("_best", best)
        .filter((F.col("m") > 0.5) & (F.col("_best.r") >= 0))
        .groupBy(*keys)
        .agg(F.avg(F.pow(F.lit(2.0), -F.col("_best.p"))).alias("tamura_coarseness"))
    )


# --- Zernike moments --------------------------------------------------------------------


def zernike_orders(degree: int = DEGREE) -> list[tuple[int, int]]:
    return [(n, l) for n in range(degree + 1) for l in range(n + 1) if (n - l) % 2 == 0]


def radial_terms(n: int, l: int) -> list[tuple[float, int]]:
    """Coefficients and powers of the radial polynomial."""
    f = math.factorial
    return [
        ((-1) ** m * f(n - m) / (f(m) * f((n - 2 * m + l) // 2) * f((n - 2 * m - l) // 2)), n - 2 * m)
        for m in range((n - l) // 2 + 1)
    ]


def zernike(rows: DataFrame, keys: Sequence[str], degree: int = DEGREE) -> DataFrame:
    """Magnitudes of the moments on a centred square of ``max(side) + 4`` pixels.

    Intensities are stretched to 1..255 in whole steps. Pure aggregation per region.
    """
    keys = list(keys)
    df = with_group_stats(
        rows.select(*keys, "x", "y", "v"),
        keys,
        _lo=F.min("v"),
        _hi=F.max("v"),
        _x0=F.min("x"),
        _y0=F.min("y"),
        _w=F.max("x") - F.min("x") + 1,
        _h=F.max("y") - F.min("y") + 1,
    )
    side = F.greatest("_w", "_h") + 4
    value = F.when(
        F.col("_hi") > F.col("_lo"),
        F.floor(F.lit(1.0) + 254.0 * (F.col("v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))),
    ).otherwise(255)
    radius = F.greatest(F.floor(side / 2), F.lit(2)).cast("double")

    def unit(axis, low, extent):
        pos = F.col(axis) - F.col(low) + F.floor((side - F.col(extent)) / 2)
        return (pos - (side - 1) / 2.0) / radius

    df = compute_once(
        df, _u=unit("x", "_x0", "_w"), _q=unit("y", "_y0", "_h"), _p=value.cast("double")
    )
    df = compute_once(
        df,
        _d=F.greatest(F.sqrt(F.col("_u") * F.col("_u") + F.col("_q") * F.col("_q")), F.lit(1e-9)),
        _t=F.atan2("_q", "_u"),
    ).filter("_d <= 1")
    sums = []
    for n, l in zernike_orders(degree):
        radial = None
        for c, power in radial_terms(n, l):
            t = F.lit(float(c)) * (F.pow("_d", F.lit(float(power))) if power else F.lit(1.0))
            radial = t if radial is None else radial + t
        sums.append(F.sum(F.col("_p") * radial * F.cos(F.col("_t") * l)).alias(f"_c{n}_{l}"))
        sums.append(F.sum(F.col("_p") * radial * F.sin(F.col("_t") * l)).alias(f"_s{n}_{l}"))
    totals = df.groupBy(*keys).agg(F.sum("_p").alias("_m"), *sums)
    return totals.select(
        *keys,
        *[
            (
                (n + 1)
                / math.pi
                * F.sqrt(
                    F.col(f"_c{n}_{l}") * F.col(f"_c{n}_{l}") + F.col(f"_s{n}_{l}") * F.col(f"_s{n}_{l}")
                )
                / F.col("_m")
            ).alias(f"zernike_{k:02d}")
            for k, (n, l) in enumerate(zernike_orders(degree))
        ],
    )


# --- all of it --------------------------------------------------------------------------


def texture_bundle(
    rows: DataFrame, keys: Sequence[str], image: Sequence[str], width: Column, height: Column
) -> DataFrame:
    """All texture columns of every region in ``rows(keys, x, y, v, u8)``.

    Regions too small for a texture crop keep NULL there.
    """
    keys = list(keys)
    near = texture_crop(rows, keys, width, height, 2, 1)
    wide = texture_crop(rows, keys, width, height, 2, max(RADII))
    patterns = lbp_multiradius(wide, keys)
    pivoted = patterns.groupBy(*keys).agg(
        *[
            F.when(
                F.count_if(F.col("radius") == r) > 0,
                F.sum(F.when((F.col("radius") == r) & (F.col("bin") == b), F.col("share")).otherwise(0.0)),
            ).alias(f"lbp_r{r}_bin_{b:02d}")
            for r in RADII
            for b in range(10)
        ]
    )
    out = rows.select(*keys).distinct()
    props = glcm_props(glcm(rows, keys), keys)
    for part in (
        props.select(*keys, *[F.col(c).alias(f"glcm_{c}") for c in props.columns if c not in keys]),
        lbp8(near, keys),
        pivoted,
        tamura_coarseness(near, keys),
        zernike(rows, keys),
    ):
        out = out.join(part, keys, "left")
    return out
