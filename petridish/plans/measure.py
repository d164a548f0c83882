"""From outlines and pixels to the final cell table of a dataset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petridish.functions import catalog
from petridish.functions import polygons as poly
from petridish.functions.numeric import safe_divide
from petridish.operators import (
    fluorescence,
    pairing,
    population,
    quality,
    roi,
    stencil,
    structure,
    texture,
)
from petridish.session import materialize

# Published column names of the cell table. Region columns get "_nuc"/"_cyto".
REGION_NAMES = {
    "area": "Area", "perimeter": "Perimeter", "convex_perimeter": "Convex Perimeter",
    "circular_diameter": "Circular Diameter", "feret_length": "Feret Length",
    "feret_width": "Feret Width", "extent": "Extent", "major_axis_length": "Major Axis Length",
    "minor_axis_length": "Minor Axis Length", "maximum_radius": "Maximum Radius",
    "mean_radius": "Mean Radius", "median_radius": "Median Radius",
    "perimeter_area_ratio": "Perimeter/Area Ratio", "solidity": "Solidity",
    "aspect_ratio": "Aspect Ratio", "eccentricity": "Eccentricity", "roundness": "Roundness",
    "circularity": "Circularity", "sphericity": "Sphericity", "roughness": "Roughness",
    "compactness": "Compactness",
}
SIGNAL_NAMES = {
    **{c: c for c in catalog.INTENSITY},
    "glcm_asm": "GLCM ASM", "glcm_contrast": "GLCM Contrast",
    "glcm_correlation": "GLCM Correlation",
    "glcm_difference_variance": "GLCM Difference Variance", "glcm_entropy": "GLCM Entropy",
    "glcm_homogeneity": "GLCM Homogeneity", "lbp_mean": "LBP Mean", "lbp_std": "LBP StdDev",
    "lbp_entropy": "LBP Entropy", "lbp_uniform_ratio": "LBP Uniform Ratio",
    **{f"lbp_bin_{b:02d}": f"LBP Hist Bin {b:02d}" for b in range(16)},
    **{
        f"lbp_r{r}_bin_{b:02d}": f"LBP Uniform R{r} Hist Bin {b:02d}"
        for r in texture.RADII
        for b in range(10)
    },
    "tamura_coarseness": "Tamura Coarseness",
    **{f"zernike_{k:02d}": f"Zernike Moment {k:02d}" for k in range(25)},
}
CELL_NAMES = {
    "karyoplasmic_ratio": "Karyoplasmic Ratio",
    "nucleolus_count": "Nucleolus Count", "mean_nucleolus_area": "Mean Nucleolus Area",
    "max_nucleolus_area": "Max Nucleolus Area", "halo_outer_mean": "Halo Outer Mean",
    "halo_outer_std": "Halo Outer StdDev", "halo_outer_cv": "Halo Outer CV",
    "halo_inner_mean": "Halo Inner Mean", "halo_inner_std": "Halo Inner StdDev",
    "halo_inner_outer_diff": "Halo Inner Outer Diff",
    "halo_angular_variance": "Halo Angular Variance",
    "halo_radial_gradient": "Halo Radial Gradient", "halo_width": "Halo Width",
    "edge_sharpness": "Edge Sharpness", "image_confluency": "Image Confluency",
    "population_area_cv": "Population Area CV",
    "population_circularity_cv": "Population Circularity CV",
    "nearest_distance": "Nearest Neighbor Distance",
    "nearest_distance_norm": "Nearest Neighbor Distance Norm",
    "local_neighbor_count": "Local Neighbor Count", "local_density": "Local Density",
    "neighbour_area_ratio": "Neighbour Area Ratio", "cluster_size": "Cluster Size",
    "cluster_size_norm": "Cluster Size Norm", "largest_cluster_ratio": "Largest Cluster Ratio",
    "mitotic_index": "Mitotic Index", "protrusion_count_cyto": "Protrusion Count",
    "mean_convex_defect_depth_cyto": "Mean Convex Defect Depth",
    "mean_protrusion_length_norm_cyto": "Mean Protrusion Length Norm",
    "max_convex_defect_depth_cyto": "Max Convex Defect Depth",
    "fractal_dimension": "Fractal Dimension",
    "boundary_inflection_count_cyto": "Boundary Inflection Count",
    "debris_count": "Debris Count", "debris_area_fraction": "Debris Area Fraction",
    "nearest_debris_distance": "Nearest Debris Distance", "debris_mean_area": "Debris Mean Area",
    "debris_density": "Debris Density", "mitotic_score": "Mitotic Score",
    "daughter_pair_flag": "Daughter Pair Flag",
    "protrusion_retraction_score": "Protrusion Retraction Score",
}


def published(table: DataFrame, ids: Sequence[str]) -> DataFrame:
    """The cell table under its published column names."""
    region = {**REGION_NAMES, **SIGNAL_NAMES}
    return table.select(
        *ids,
        *[
            F.col(f"`{c}_{r}`").cast("double").alias(f"{name}_{r}")
            for r in ("nuc", "cyto")
            for c, name in region.items()
        ],
        *[F.col(f"`{c}`").cast("double").alias(c) for c in (*catalog.CROSS_REGION, "Nucleus Centroid Offset")],
        *[F.col(f"`{c}_cyto`").cast("double").alias(f"Whole Cell {name}") for c, name in SIGNAL_NAMES.items()],
        *[F.col(f"`{c}`").cast("double").alias(name) for c, name in CELL_NAMES.items()],
    )


def mask_outlines(outlines: DataFrame, image: Sequence[str], width: int, height: int) -> DataFrame:
    """Label pixels of both regions from the outline polygons."""
    sides = F.array(
        F.struct(F.lit("nuc").alias("region"), F.col("nuc").alias("points")),
        F.struct(F.lit("cyto").alias("region"), F.col("cyto").alias("points")),
    )
    shapes = outlines.select(*image, F.col("roi_id").alias("label"), F.explode(sides).alias("_s")).select(
        *image, "label", F.col("_s.region").alias("region"), F.col("_s.points").alias("points")
    )
    return poly.rasterize(shapes.filter("points is not null"), "points", width, height)


def region_table(
    outlines: DataFrame, pixels: DataFrame, image: Sequence[str], width: int, height: int
) -> tuple[DataFrame, DataFrame]:
    """Geometry, intensity and texture of every region, and the label pixels behind it.

    The cell region is the whole cell, nucleus included.
    """
    image = list(image)
    keys = [*image, "region", "label"]
    w, h = F.lit(width), F.lit(height)
    gray = texture.to_uint8(pixels.select(*image, "x", "y", "v"), image)
    labels = mask_outlines(outlines, image, width, height)
    rows = materialize(labels.join(gray, [*image, "x", "y"]))
    sides = F.array(
        F.struct(F.lit("nuc").alias("region"), F.col("nuc").alias("points")),
        F.struct(F.lit("cyto").alias("region"), F.col("cyto").alias("points")),
    )
    shapes = (
        outlines.select(*image, F.col("roi_id").alias("label"), F.explode(sides).alias("_s"))
        .select(*image, "label", F.col("_s.region").alias("region"), F.col("_s.points").alias("points"))
        .filter("points is not null")
    )
    outline = structure.boundary_inflection(
        structure.convex_defects(roi.outline_geometry(shapes, "points"), "points"), "points"
    ).drop("points", "polygon_area")
    table = (
        roi.roi_moments(rows, keys)
        .join(roi.centroid_area(rows, keys).drop("area"), keys)
        .join(roi.roi_intensity(rows, keys), keys)
        .join(roi.roi_entropy(rows, keys), keys)
        .join(roi.roi_radii(rows, keys), keys)
        .join(outline, keys, "left")
        .join(texture.texture_bundle(rows, keys, image, w, h), keys)
    )
    # the short caliper is the short axis of the moment ellipse
    table = roi.geometry_derived(table).withColumn("feret_width", F.col("minor_axis_length"))
    return materialize(table), rows.select(*keys, "x", "y")


def param_table(
    outlines: DataFrame,
    pixels: DataFrame,
    image: Sequence[str],
    width: int,
    height: int,
    debris: dict | None = None,
) -> DataFrame:
    """One row per cell with all feature families under their published names.

    ``outlines(image, roi_id, nuc, cyto)``, ``pixels(image, x, y, v)``.
    """
    image = list(image)
    cell = [*image, "label"]
    w, h = F.lit(width), F.lit(height)
    signal = materialize(pixels.select(*image, "x", "y", "v"))
    regions, labels = region_table(outlines, signal, image, width, height)
    features = [c for c in regions.columns if c not in (*image, "region", "label")]
    wide = pairing.merge_roi_wide(regions, cell, features).withColumn(
        "karyoplasmic_ratio", roi.karyoplasmic_ratio("area_nuc", "area_cyto")
    )
    wide = materialize(roi.cross_region(wide))
    cells = materialize(labels.filter("region = 'cyto'").drop("region"))
    nuclei = labels.filter("region = 'nuc'").drop("region")
    with_cell = cells.select(*cell).distinct()
    reference = materialize(
        cells.unionByName(nuclei.join(with_cell, cell, "left_anti")).select(*image, "x", "y").distinct()
    )
    rings = materialize(structure.halo_rings(cells, cell, w, h))
    edges = stencil.sobel_edges(signal, image)
    background = (
        signal.join(reference, [*image, "x", "y"], "left_anti")
        .groupBy(*image)
        .agg(F.avg("v").alias("bg_mean"), F.stddev_pop("v").alias("bg_std"))
    )
    people = materialize(
        wide.select(
            *cell,
            F.coalesce("x_centroid_cyto", "x_centroid_nuc").alias("x"),
            F.coalesce("y_centroid_cyto", "y_centroid_nuc").alias("y"),
            F.coalesce("area_cyto", "area_nuc").alias("area"),
            F.col("area_nuc").alias("nuc_area"),
            F.coalesce("circularity_cyto", "circularity_nuc").alias("circularity"),
        )
    )
    stats = materialize(population.population_stats(people, image, width, height))
    near = materialize(population.nearest_cells(people, image, 3))
    first = near.filter("pos = 1").select(*cell, F.col("d").alias("nearest_distance"), "other")
    other_area = people.select(*image, F.col("label").alias("other"), F.col("area").alias("nearest_area"))
    particles, areas = structure.debris_particles(
        signal, reference, image, w, h, stats.select(*image, "median_nucleus_area"), debris
    )
    out = wide.join(stats.drop("cells"), image, "left").join(
        population.mitotic_index(people, stats, image), image, "left"
    )
    for part in (
        structure.nucleolus(nuclei, signal, image),
        structure.halo_stats(rings, signal, edges, image, cell),
        structure.halo_angular_variance(rings, cells, signal, image, cell),
        structure.halo_radial_gradient(cells, signal, image, cell, w, h),
        structure.halo_width(cells, signal, background, image, cell, w, h),
        structure.fractal_dimension(cells, cell, w, h),
        first.join(other_area, [*image, "other"], "left").drop("other"),
        population.knn_area_ratio(people, near, image),
        population.neighbour_count(people, stats, image),
        population.cluster_sizes(people, stats, image),
        structure.debris_features(people, particles, areas, image),
    ):
        out = out.join(part, cell, "left")
    out = out.withColumn(
        "nearest_distance_norm", safe_divide("nearest_distance", "median_diameter")
    )
    score_input = out.withColumns(
        {
            "area": F.coalesce("area_cyto", "area_nuc"),
            "circularity": F.coalesce("circularity_cyto", "circularity_nuc"),
            "glcm_entropy": F.col("glcm_entropy_cyto"),
            "protrusion_count": F.col("protrusion_count_cyto"),
        }
    )
    return published(population.mitosis_scores(score_input), cell)


def image_job(
    outlines: DataFrame,
    phase: DataFrame,
    image: Sequence[str],
    width: int,
    height: int,
    ido: DataFrame | None = None,
    ki67_mask: DataFrame | None = None,
    rings: DataFrame | None = None,
    debris: dict | None = None,
    ball: float = 50.0,
    span: float = 1.0,
) -> DataFrame:
    """Final cleaned cell table: features, ring and IDO columns, Ki67 label, status.

    ``rings`` is the channel measured in rings around the nucleus, after its background, that
    of a rolling ball of radius ``ball``, is taken off; its values lie within ``span``. Channels that are absent
    add no columns; without a Ki67 mask no label is made.
    """
    image = list(image)
    cell = [*image, "label"]
    outlines = materialize(outlines)
    table = param_table(outlines, phase, image, width, height, debris)
    labels = mask_outlines(outlines, image, width, height)
    if rings is not None:
        pairs = outlines.filter("nuc is not null and cyto is not null")
        signal = stencil.rolling_ball(rings.select(*image, "x", "y", "v"), image, ball, span=span)
        measured = fluorescence.fluor_rings(
            pairs, signal.drop("background"), image, width, height
        )
        flat = measured.groupBy(*image, F.col("roi_id").alias("label")).agg(
            *[
                F.max(F.when(F.col("ring") == k, F.col(v))).alias(f"{v}-{k}")
                for v in ("IntDen", "RawIntDen")
                for k in range(20)
            ]
        )
        table = table.join(flat, cell, "left")
    if ido is not None:
        table = table.join(fluorescence.ido_measure(labels, ido, image), cell, "left")
    if ki67_mask is not None:
        positive = fluorescence.ki67_positive(labels, ki67_mask, image).filter("ki67_positive = 1")
        table = pairing.merge_labels(table, positive, cell)
    statuses = quality.outline_status(outlines, F.lit(width), F.lit(height)).select(
        *image, F.col("roi_id").alias("label"), "status"
    )
    return quality.clean_cells([quality.add_status(table, statuses, cell)])
