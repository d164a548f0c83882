"""Cell sub-structure: nucleoli, halo, outline complexity, debris."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from petridish.functions import polygons as poly
from petridish.functions.numeric import compute_once, safe_divide, sides
from petridish.operators import stencil as st
from petridish.operators.engines import nearest
from petridish.operators.scale import with_group_stats
from petridish.session import materialize

# Halo widths tried in order, rays and their reach, angular sectors.
HALO_WIDTHS = (3, 5, 7, 9, 11, 13, 15)
RAYS = 16
RAY_REACH = 15
SECTORS = 36
BOX_SIZES = (2, 4, 8, 16, 32)

# Debris settings.
DEBRIS = {
    "threshold_method": "triangle",
    "min_size_px": 5,
    "max_size_fraction_of_median_nucleus_area": 0.08,
    "cell_dilate_px": 3,
    "subtract_background": False,
    "rolling_ball_radius": 50.0,
    "watershed": False,
}


# --- nucleoli ---------------------------------------------------------------------------


def nucleolus(
    nuclei: DataFrame,
    pixels: DataFrame,
    image: Sequence[str],
    label: Sequence[str] = ("label",),
    min_distance: int = 3,
    threshold_rel: float = 0.3,
) -> DataFrame:
    """Bright spots inside each nucleus: count, mean and largest area.

    The signal is a fine blur minus a coarse one on the nucleus box. Spots are connected
    pixels above the threshold that hold a local maximum.
    """
    keys = [*image, *label]
    box = nuclei.groupBy(*keys).agg(
        F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1")
    )
    grid = (
        box.withColumn("y", F.explode(F.sequence("_y0", "_y1")))
        .withColumn("x", F.explode(F.sequence("_x0", "_x1")))
        .select(*keys, "x", "y")
        .join(pixels.select(*image, "x", "y", "v"), [*image, "x", "y"])
        .join(nuclei.select(*keys, "x", "y").withColumn("_m", F.lit(1.0)), [*keys, "x", "y"], "left")
        .withColumn("_m", F.coalesce("_m", F.lit(0.0)))
    )
    fine = st.gaussian_weights(1.0)
    coarse = st.gaussian_weights(max(2.0, float(min_distance)))
    same = {0: 1.0}
    rows = st.along(grid, keys, "x", {"_a": ("v", fine), "_b": ("v", coarse), "_m": ("_m", same)})
    both = st.along(rows, keys, "y", {"_a": ("_a", fine), "_b": ("_b", coarse), "_m": ("_m", same)})
    signal = both.withColumn("s", F.round(F.col("_a") - F.col("_b"), 9)).withColumn(
        "_in", F.col("_m") > 0.5
    )
    signal = materialize(st.window_maximum(signal, keys, min_distance, "s", "_top"))
    own = F.when(F.col("_in"), F.col("s"))
    stats = signal.groupBy(*keys).agg(
        F.min(own).alias("_lo"),
        F.max(own).alias("_hi"),
        F.avg(own).alias("_mean"),
        F.stddev_pop(own).alias("_std"),
        F.percentile(own, F.lit(0.9)).alias("_p90"),
    )
    limit = F.greatest(
        F.col("_lo") + threshold_rel * (F.col("_hi") - F.col("_lo")),
        F.col("_p90"),
        F.col("_mean") + F.col("_std"),
    )
    bright = (
        signal.filter("_in")
        .join(stats.filter("_hi > _lo").select(*keys, limit.alias("_limit")), keys)
        .filter("s >= _limit")
        .withColumn("_peak", F.col("s") >= F.col("_top") - 1e-7)
        .select(*keys, "x", "y", "_peak")
    )
    spots = st.label_components(bright, keys, 8).join(bright, [*keys, "x", "y"])
    sizes = (
        spots.groupBy(*keys, "component")
        .agg(F.count(F.lit(1)).alias("_area"), F.max("_peak").alias("_peak"))
        .filter("_peak")
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("nucleolus_count"),
            F.avg("_area").alias("mean_nucleolus_area"),
            F.max("_area").cast("double").alias("max_nucleolus_area"),
        )
    )
    return stats.select(*keys).join(sizes, keys, "left").na.fill(0, ["nucleolus_count"])


# --- halo -------------------------------------------------------------------------------


def halo_rings(cells: DataFrame, keys: Sequence[str], width: Column, height: Column) -> DataFrame:
    """Ring pixels of each cell: ``ring`` is inner, outer or boundary.

    Inner and outer rings are as wide as a tenth of the cell's diameter (at least 2).
    """
    keys = list(keys)
    sized = with_group_stats(cells.select(*keys, "x", "y"), keys, _n=F.count(F.lit(1)))
    radius = F.greatest(
        F.bround(0.2 * F.sqrt(F.col("_n") / math.pi), 0).cast("int"), F.lit(2)
    )
    sized = materialize(sized.withColumn("_r", radius).drop("_n"))
    halo = st.hits_around(sized, [*keys, "_r"], width, height, F.col("_r"))
    member = F.coalesce("member", F.lit(False))
    full = F.coalesce(F.col("hits") == F.col("size"), F.lit(False))
    rings = halo.filter(~(member & full)).select(
        *keys, "x", "y", F.when(member, "inner").otherwise("outer").alias("ring")
    )
    rim = st.hits_around(cells, keys, width, height, 1, "box")
    boundary = rim.filter(~(member & full)).select(*keys, "x", "y", F.lit("boundary").alias("ring"))
    return rings.unionByName(boundary)


def halo_stats(
    rings: DataFrame, pixels: DataFrame, edges: DataFrame, image: Sequence[str], keys: Sequence[str]
) -> DataFrame:
    """Ring intensities and mean edge strength on the boundary ring."""
    signal = pixels.select(*image, "x", "y", "v").join(
        edges.select(*image, "x", "y", F.col("v").alias("_edge")), [*image, "x", "y"]
    )
    joined = rings.join(signal, [*image, "x", "y"])

    def of(ring, c):
        return F.when(F.col("ring") == ring, F.col(c))

    out = joined.groupBy(*keys).agg(
        F.avg(of("outer", "v")).alias("halo_outer_mean"),
        F.stddev_pop(of("outer", "v")).alias("halo_outer_std"),
        F.avg(of("inner", "v")).alias("halo_inner_mean"),
        F.stddev_pop(of("inner", "v")).alias("halo_inner_std"),
        F.avg(of("boundary", "_edge")).alias("edge_sharpness"),
    )
    return out.withColumn("halo_outer_cv", safe_divide("halo_outer_std", "halo_outer_mean")).withColumn(
        "halo_inner_outer_diff", F.abs(F.col("halo_outer_mean") - F.col("halo_inner_mean"))
    )


def halo_angular_variance(
    rings: DataFrame, cells: DataFrame, pixels: DataFrame, image: Sequence[str], keys: Sequence[str]
) -> DataFrame:
    """Variance of the sector means of the outer ring; NULL with too few sectors."""
    keys = list(keys)
    centre = cells.groupBy(*keys).agg(F.avg("x").alias("_cx"), F.avg("y").alias("_cy"))
    outer = (
        rings.filter("ring = 'outer'")
        .join(pixels.select(*image, "x", "y", "v"), [*image, "x", "y"])
        .join(centre, keys)
    )
    turn = 2.0 * math.pi
    angle = F.pmod(F.atan2(F.col("y") - F.col("_cy"), F.col("x") - F.col("_cx")), F.lit(turn))
    sector = F.least(F.floor(angle / turn * SECTORS), F.lit(SECTORS - 1))
    means = outer.groupBy(*keys, sector.alias("_sector")).agg(F.avg("v").alias("_m"))
    return means.groupBy(*keys).agg(
        F.when(F.count(F.lit(1)) >= max(4, SECTORS // 4), F.var_pop("_m")).alias(
            "halo_angular_variance"
        )
    )


def halo_radial_gradient(
    cells: DataFrame,
    pixels: DataFrame,
    image: Sequence[str],
    keys: Sequence[str],
    width: Column,
    height: Column,
) -> DataFrame:
    """Mean intensity slope along 16 rays, from the cell edge 15 pixels outwards."""
    keys = list(keys)
    width, height = sides(width, height)
    centre = cells.groupBy(*keys).agg(
        F.avg("x").alias("_cx"),
        F.avg("y").alias("_cy"),
        # no ray can leave the box of the cell and come back
        F.ceil(
            F.sqrt(
                F.pow(F.max("x") - F.min("x") + 1, F.lit(2.0)) + F.pow(F.max("y") - F.min("y") + 1, F.lit(2.0))
            )
        ).alias("_reach"),
    )
    rays = F.array(
        *[
            F.struct(
                F.lit(k).alias("ray"),
                F.lit(math.cos(2 * math.pi * k / RAYS)).alias("c"),
                F.lit(math.sin(2 * math.pi * k / RAYS)).alias("s"),
            )
            for k in range(RAYS)
        ]
    )
    ray = centre.withColumn("_ray", F.explode(rays)).select(
        *keys, "_cx", "_cy", "_reach", F.col("_ray.ray").alias("ray"), F.col("_ray.c").alias("_c"), F.col("_ray.s").alias("_s")
    )

    def inside(px, py):
        return (px >= 0) & (py >= 0) & (px <= width - 1) & (py <= height - 1)

    steps = ray.withColumn("_t", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_reach"))))
    px, py = F.col("_cx") + F.col("_t") * F.col("_c"), F.col("_cy") + F.col("_t") * F.col("_s")
    steps = steps.filter(inside(px, py)).select(
        *keys, "ray", "_t", F.bround(px, 0).cast("int").alias("x"), F.bround(py, 0).cast("int").alias("y")
    )
    edge = (
        steps.join(cells.select(*keys, "x", "y"), [*keys, "x", "y"])
        .groupBy(*keys, "ray")
        .agg(F.max("_t").alias("_edge"))
    )
    probes = (
        ray.join(edge, [*keys, "ray"])
        .withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(RAY_REACH))))
        .withColumn("px", F.col("_cx") + (F.col("_edge") + F.col("_o")) * F.col("_c"))
        .withColumn("py", F.col("_cy") + (F.col("_edge") + F.col("_o")) * F.col("_s"))
        .filter(inside(F.col("px"), F.col("py")))
        .select(*keys, "ray", F.col("_o").cast("double").alias("_o"), "px", "py")
    )
    profile = st.bilinear_sample(probes, pixels, image, width, height, "_v")
    slopes = profile.groupBy(*keys, "ray").agg(
        F.count(F.lit(1)).alias("_n"), F.covar_pop("_o", "_v").alias("_cov"), F.var_pop("_o").alias("_var")
    )
    return (
        slopes.filter("_n >= 3 and _var > 0")
        .groupBy(*keys)
        .agg(F.avg(F.col("_cov") / F.col("_var")).alias("halo_radial_gradient"))
    )


def box_distance(
    cells: DataFrame, keys: Sequence[str], width: Column, height: Column, reach: int
) -> DataFrame:
    """Pixels around each cell with their box (Chebyshev) distance to it, up to ``reach``."""
    keys = list(keys)
    width, height = sides(width, height)
    box = cells.groupBy(*keys).agg(
        F.greatest(F.min("x") - reach, F.lit(0)).alias("_x0"),
        F.least(F.max("x") + reach, (width - 1).cast("int")).alias("_x1"),
        F.greatest(F.min("y") - reach, F.lit(0)).alias("_y0"),
        F.least(F.max("y") + reach, (height - 1).cast("int")).alias("_y1"),
    )
    grid = (
        box.withColumn("y", F.explode(F.sequence("_y0", "_y1")))
        .withColumn("x", F.explode(F.sequence("_x0", "_x1")))
        .select(*keys, "x", "y")
        .join(cells.select(*keys, "x", "y").withColumn("_m", F.lit(1)), [*keys, "x", "y"], "left")
    )
    line = Window.partitionBy(*keys, "y").orderBy("x")
    before = line.rowsBetween(Window.unboundedPreceding, 0)
    after = line.rowsBetween(0, Window.unboundedFollowing)
    own = F.when(F.col("_m") == 1, F.col("x"))
    across = grid.withColumn(
        "_h",
        F.least(
            F.col("x") - F.last(own, ignorenulls=True).over(before),
            F.first(own, ignorenulls=True).over(after) - F.col("x"),
        ),
    )
    column = Window.partitionBy(*keys, "x").orderBy("y")

    def at(dy):
        h = F.col("_h") if dy == 0 else (F.lag("_h", -dy) if dy < 0 else F.lead("_h", dy)).over(column)
        return F.when(h.isNotNull(), F.greatest(h, F.lit(abs(dy))))

    return across.withColumn("d", F.least(*[at(dy) for dy in range(-reach, reach + 1)])).filter(
        F.col("d") <= reach
    ).select(*keys, "x", "y", "d")


def halo_width(
    cells: DataFrame,
    pixels: DataFrame,
    background: DataFrame,
    image: Sequence[str],
    keys: Sequence[str],
    width: Column,
    height: Column,
) -> DataFrame:
    """First width whose ring is back at background level; NULL when none is.

    ``background(image, bg_mean, bg_std)`` describes the pixels outside all cells.
    """
    keys = list(keys)
    around = box_distance(cells, keys, width, height, max(HALO_WIDTHS)).filter("d > 0")
    band = F.when(F.col("d") <= HALO_WIDTHS[0], HALO_WIDTHS[0])
    for w in HALO_WIDTHS[1:]:
        band = band.when(F.col("d") <= w, w)
    rings = (
        around.withColumn("_w", band)
        .join(pixels.select(*image, "x", "y", "v"), [*image, "x", "y"])
        .groupBy(*keys, "_w")
        .agg(F.avg("v").alias("_mean"))
    )
    limit = F.col("bg_mean") + 1.5 * F.col("bg_std")
    found = (
        rings.join(background, list(image))
        .filter(F.col("_mean") <= limit)
        .groupBy(*keys)
        .agg(F.min("_w").cast("double").alias("halo_width"))
    )
    return cells.select(*keys).distinct().join(found, keys, "left")


# --- outline complexity -----------------------------------------------------------------


def fractal_dimension(cells: DataFrame, keys: Sequence[str], width: Column, height: Column) -> DataFrame:
    """Box-counting slope of the two-pixel boundary band over boxes of 2 to 32 pixels."""
    keys = list(keys)
    rim = st.hits_around(cells, keys, width, height, 1, "box")
    band = rim.filter(
        ~(F.coalesce("member", F.lit(False)) & F.coalesce(F.col("hits") == F.col("size"), F.lit(False)))
    )
    sizes = F.explode(F.array(*[F.lit(b) for b in BOX_SIZES]))
    boxes = (
        band.select(*keys, "x", "y", sizes.alias("_s"))
        .groupBy(*keys, "_s", F.floor(F.col("x") / F.col("_s")).alias("_bx"), F.floor(F.col("y") / F.col("_s")).alias("_by"))
        .agg(F.count(F.lit(1)).alias("_c"))
        .groupBy(*keys, "_s")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    lx, ly = F.log(1.0 / F.col("_s")), F.log(F.col("_n").cast("double"))
    return boxes.groupBy(*keys).agg(
        F.try_divide(F.covar_pop(lx, ly), F.var_pop(lx)).alias("fractal_dimension")
    )


def boundary_inflection(polygons: DataFrame, points: str, out: str = "boundary_inflection_count") -> DataFrame:
    """Changes of the turning direction along the closed outline; NULL below 8 vertices."""
    def at(a, i):
        return F.element_at(a, i + 1)

    n = F.size(points)
    turns = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.signum(
            (
                (at(F.col(points), i).x - at(F.col(points), F.pmod(i - 1, n)).x)
                * (at(F.col(points), F.pmod(i + 1, n)).y - at(F.col(points), i).y)
                - (at(F.col(points), i).y - at(F.col(points), F.pmod(i - 1, n)).y)
                * (at(F.col(points), F.pmod(i + 1, n)).x - at(F.col(points), i).x)
            ).cast("double")
        ),
    )
    signs = compute_once(polygons, _signs=F.filter(turns, lambda t: t != 0))
    changes = F.size(
        F.filter(
            F.transform(
                "_signs",
                lambda v, i: v
                != F.element_at(
                    F.col("_signs"), F.when(i == 0, F.size("_signs")).otherwise(i).cast("int")
                ),
            ),
            lambda b: b,
        )
    )
    return signs.withColumn(
        out, F.when(n >= 8, F.when(F.size("_signs") > 0, changes).otherwise(0))
    ).drop("_signs")


def convex_defects(polygons: DataFrame, points: str) -> DataFrame:
    """Hull gaps deeper than ``max(3, 3 % of the diameter)``: count, mean, largest depth."""
    p = compute_once(polygons, _area=poly.area(poly.closed_edges(points)), _d=poly.defect_depths(F.col(points)))
    diameter = 2.0 * F.sqrt(F.col("_area") / math.pi)
    limit = F.greatest(F.lit(3.0), 0.03 * diameter)
    p = compute_once(p, _deep=F.filter("_d", lambda d: d > limit))
    count = F.size("_deep")
    mean = F.when(
        count > 0, F.aggregate("_deep", F.lit(0.0), lambda a, d: a + d) / count
    )
    valid = F.col("_area") > 0
    return p.select(
        *[c for c in polygons.columns],
        F.when(valid, F.when(F.col("_d").isNotNull(), count)).alias("protrusion_count"),
        F.when(valid, mean).alias("mean_convex_defect_depth"),
        F.when(valid, safe_divide(mean, diameter)).alias("mean_protrusion_length_norm"),
        F.when(valid & (count > 0), F.array_max("_deep")).alias("max_convex_defect_depth"),
    )


# --- debris -----------------------------------------------------------------------------


def debris_particles(
    pixels: DataFrame,
    cells: DataFrame,
    image: Sequence[str],
    width: Column,
    height: Column,
    nucleus_area: DataFrame,
    config: dict | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Bright background components of usable size, and the background area per image.

    With ``subtract_background`` the signal above a rolling ball is measured, with ``watershed``
    touching particles are cut between their centres.
    ``cells`` holds the union of all cell pixels, ``nucleus_area(image, median_nucleus_area)``
    sets the largest particle. Images whose size window is empty have no row.
    """
    image = list(image)
    c = {**DEBRIS, **(config or {})}
    grown = st.dilate(
        cells.select(*image, "x", "y").distinct(), image, width, height, int(c["cell_dilate_px"])
    )
    limits = nucleus_area.select(
        *image, (F.col("median_nucleus_area") * float(c["max_size_fraction_of_median_nucleus_area"])).alias("_max")
    ).filter(F.col("_max") >= float(c["min_size_px"]))
    signal = pixels.select(*image, "x", "y", "v")
    if c["subtract_background"]:
        signal = st.rolling_ball(signal, image, float(c["rolling_ball_radius"])).select(*image, "x", "y", "v")
    background = materialize(
        signal.join(limits.select(*image), image, "left_semi")
        .join(grown, [*image, "x", "y"], "left_anti")
    )
    levels = st.threshold_auto(background, image, c["threshold_method"])
    bright = background.join(levels, image).filter(F.col("v") >= F.col("threshold"))
    parts = st.split_touching(bright, image) if c["watershed"] else st.label_components(bright, image, 4)
    particles = (
        st.component_stats(parts, image)
        .join(limits, image)
        .filter((F.col("area") >= float(c["min_size_px"])) & (F.col("area") <= F.col("_max")))
        .drop("_max")
    )
    areas = background.groupBy(*image).agg(F.count(F.lit(1)).alias("background_area"))
    return materialize(particles), areas


def debris_features(
    centres: DataFrame, particles: DataFrame, areas: DataFrame, image: Sequence[str]
) -> DataFrame:
    """Debris columns per cell; ``centres(image, label, x, y)``."""
    image = list(image)
    totals = particles.groupBy(*image).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("area").alias("_sum"), F.avg("area").alias("debris_mean_area")
    )
    per_image = areas.join(totals, image, "left").select(
        *image,
        F.coalesce("_n", F.lit(0)).cast("double").alias("debris_count"),
        (F.coalesce("_sum", F.lit(0)) / F.col("background_area")).alias("debris_area_fraction"),
        "debris_mean_area",
        (F.coalesce("_n", F.lit(0)) / F.col("background_area")).alias("debris_density"),
    )
    near = nearest(
        centres.select(*image, F.col("label").alias("lid"), "x", "y"),
        particles.select(
            *image, F.col("component").alias("rid"), F.col("cx").alias("x"), F.col("cy").alias("y")
        ),
        image,
    ).select(*image, F.col("lid").alias("label"), F.col("d").alias("nearest_debris_distance"))
    return (
        centres.select(*image, "label").join(per_image, image, "left").join(near, [*image, "label"], "left")
    )
