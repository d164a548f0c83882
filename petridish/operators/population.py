"""Crowding, clusters and mitosis proxies of the cells of one image.

Cell rows are ``image, label, x, y, area[, circularity]``. Per-image values come from
aggregates joined back, neighbours from grid joins, so a crowded image spreads out.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from petridish.functions.numeric import clip, population_cv, safe_divide, scale_0_1
from petridish.operators.engines import connected_components, nearest
from petridish.operators.scale import summarise
from petridish.session import materialize

LEVELS = 64  # fixed value: gray levels behind the entropy bound of the mitotic score


def population_stats(
    cells: DataFrame, image: Sequence[str], width: int | Column, height: int | Column
) -> DataFrame:
    """Per image: cell count, confluency, variation and median sizes."""
    frame = (F.lit(width) if isinstance(width, int) else width) * (
        F.lit(height) if isinstance(height, int) else height
    )
    out = summarise(
        cells,
        image,
        {
            "cells": F.count(F.lit(1)),
            "image_confluency": F.sum("area") / F.max(frame),
            "population_area_cv": population_cv("area"),
            "population_circularity_cv": population_cv("circularity"),
        },
        {"median_area": ("area", 0.5), "median_nucleus_area": ("nuc_area", 0.5)},
    )
    return out.withColumn(
        "median_diameter",
        F.when(F.col("median_area") > 0, 2.0 * F.sqrt(F.col("median_area") / math.pi)),
    )


def mitotic_index(cells: DataFrame, stats: DataFrame, image: Sequence[str]) -> DataFrame:
    """Share of round, small cells among the measured ones."""
    known = F.col("area").isNotNull() & F.col("circularity").isNotNull()
    hit = (F.col("circularity") > 0.85) & (F.col("area") < 0.6 * F.col("median_area"))
    return (
        cells.join(stats.select(*image, "median_area"), list(image))
        .groupBy(*image)
        .agg(
            F.avg(F.when(known & (F.col("median_area") > 0), hit.cast("double"))).alias("mitotic_index")
        )
    )


def nearest_cells(cells: DataFrame, image: Sequence[str], k: int = 1) -> DataFrame:
    """The ``k`` nearest other cells: ``image, label, other, d, pos``; ties by label."""
    points = cells.select(*image, "label", "x", "y").filter("x is not null and y is not null")
    return nearest(
        points.withColumnRenamed("label", "lid"),
        points.withColumnRenamed("label", "rid"),
        image,
        k,
        same=True,
    ).withColumnsRenamed({"lid": "label", "rid": "other"})


def knn_area_ratio(cells: DataFrame, neighbours: DataFrame, image: Sequence[str]) -> DataFrame:
    """Own area over the mean area of the (three) nearest cells with an area."""
    other = cells.select(*image, F.col("label").alias("other"), F.col("area").alias("_oa"))
    means = (
        neighbours.join(other, [*image, "other"])
        .filter("_oa > 0")
        .groupBy(*image, "label")
        .agg(F.avg("_oa").alias("_mean"))
    )
    return cells.join(means, [*image, "label"], "left").select(
        *image, "label", safe_divide("area", "_mean").alias("neighbour_area_ratio")
    )


def _positions(cells: DataFrame, image: Sequence[str], radius: Column) -> DataFrame:
    """Distinct positions with the number of cells on them and their grid cell."""
    return (
        cells.groupBy(*image, "x", "y", radius.alias("_r"))
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_gx", F.floor(F.col("x") / F.col("_r")))
        .withColumn("_gy", F.floor(F.col("y") / F.col("_r")))
    )


def neighbour_count(cells: DataFrame, stats: DataFrame, image: Sequence[str]) -> DataFrame:
    """Other cells within two median diameters, and their density.

    Cells on one position are counted together, and the join key is the grid cell of the
    search radius, so each position only meets its surroundings.
    """
    image = list(image)
    sized = cells.filter("x is not null and y is not null").join(
        stats.select(*image, "median_diameter"), image
    )
    reach = 2.0 * F.col("median_diameter")
    spots = materialize(_positions(sized.filter("median_diameter > 0"), image, reach))
    step = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    around = (
        spots.withColumn("_ox", step)
        .withColumn("_oy", step)
        .withColumn("_gx", F.col("_gx") + F.col("_ox"))
        .withColumn("_gy", F.col("_gy") + F.col("_oy"))
        .select(*image, "_gx", "_gy", "x", "y", "_r")
    )
    other = spots.select(
        *image, "_gx", "_gy", F.col("x").alias("_x2"), F.col("y").alias("_y2"), F.col("_c").alias("_c2")
    )
    dx, dy = F.col("x") - F.col("_x2"), F.col("y") - F.col("_y2")
    counts = (
        around.join(other, [*image, "_gx", "_gy"])
        .filter(F.sqrt(dx * dx + dy * dy) <= F.col("_r"))
        .groupBy(*image, "x", "y")
        .agg((F.sum("_c2") - 1).alias("local_neighbor_count"))
    )
    return (
        sized.join(counts, [*image, "x", "y"], "left")
        .withColumn("local_neighbor_count", F.coalesce("local_neighbor_count", F.lit(0)))
        .select(
            *image,
            "label",
            "local_neighbor_count",
            safe_divide(F.col("local_neighbor_count").cast("double"), math.pi * reach * reach).alias(
                "local_density"
            ),
        )
    )


def cluster_sizes(cells: DataFrame, stats: DataFrame, image: Sequence[str], factor: float = 2.5) -> DataFrame:
    """Clusters of cells linked within ``factor`` median diameters.

    Cells that share a grid square whose diagonal is the link distance always belong
    together, so squares are the graph's nodes and only squares up to two apart can be
    linked; a link needs one close pair of positions.
    """
    image = list(image)
    sized = cells.filter("x is not null and y is not null").join(
        stats.select(*image, "median_diameter", "cells"), image
    )
    link = factor * F.col("median_diameter")
    spots = materialize(
        sized.groupBy(*image, "x", "y", link.alias("_r"))
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_gx", F.floor(F.col("x") / (F.col("_r") / math.sqrt(2.0))))
        .withColumn("_gy", F.floor(F.col("y") / (F.col("_r") / math.sqrt(2.0))))
        .withColumn("square", F.col("_gx") * 1_000_000_007 + F.col("_gy"))
    )
    # half of the 5 x 5 block: every pair of squares meets once
    steps = F.array(
        *[
            F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"))
            for a in range(0, 3)
            for b in range(-2, 3)
            if a > 0 or b > 0
        ]
    )
    left = spots.withColumn("_s", F.explode(steps)).select(
        *image,
        (F.col("_gx") + F.col("_s.a")).alias("_gx"),
        (F.col("_gy") + F.col("_s.b")).alias("_gy"),
        "x",
        "y",
        "_r",
        F.col("square").alias("a"),
    )
    right = spots.select(
        *image, "_gx", "_gy", F.col("x").alias("_x2"), F.col("y").alias("_y2"), F.col("square").alias("b")
    )
    dx, dy = F.col("x") - F.col("_x2"), F.col("y") - F.col("_y2")
    links = (
        left.join(right, [*image, "_gx", "_gy"])
        .filter(F.sqrt(dx * dx + dy * dy) <= F.col("_r"))
        .select(*image, "a", "b")
        .distinct()
    )
    nodes = spots.groupBy(*image, "square").agg(F.sum("_c").alias("_c"))
    labelled = connected_components(nodes, links, image, "square", "cluster")
    sizes = labelled.groupBy(*image, "cluster").agg(F.sum("_c").alias("cluster_size"))
    largest = sizes.groupBy(*image).agg(F.max("cluster_size").alias("_top"))
    member = spots.select(*image, "x", "y", "square").join(
        labelled.select(*image, "square", "cluster"), [*image, "square"]
    )
    return (
        sized.join(member, [*image, "x", "y"])
        .join(sizes, [*image, "cluster"])
        .join(largest, image)
        .select(
            *image,
            "label",
            "cluster_size",
            (F.col("cluster_size") / F.col("cells")).alias("cluster_size_norm"),
            (F.col("_top") / F.col("cells")).alias("largest_cluster_ratio"),
        )
    )


def mitosis_scores(cells: DataFrame) -> DataFrame:
    """Mitotic score, daughter pair flag and retraction score.

    Expects ``area, circularity, median_area, glcm_entropy, halo_angular_variance,
    halo_outer_std, nearest_distance, nearest_area, protrusion_count``.
    """
    rounding = clip("circularity", 0.0, 1.0)
    small = 1.0 - scale_0_1(safe_divide("area", "median_area"), 0.6, 1.4)
    uniform = clip(1.0 - F.col("glcm_entropy") / math.log(LEVELS**2), 0.0, 1.0)
    spread = F.when(
        F.col("halo_outer_std").isNotNull(),
        F.greatest(F.col("halo_outer_std") * F.col("halo_outer_std"), F.lit(1e-12)),
    )
    symmetry = clip(1.0 - F.col("halo_angular_variance") / spread, 0.0, 1.0)
    diameter = 2.0 * F.sqrt(F.col("median_area") / math.pi)
    delta = F.abs(F.col("area") - F.col("nearest_area")) / F.greatest(
        (F.col("area") + F.col("nearest_area")) / 2.0, F.lit(1e-12)
    )
    pair = (F.col("median_area") > 0) & (F.col("nearest_distance") < 0.5 * diameter) & (delta < 0.25)
    protrusion = 1.0 - scale_0_1("protrusion_count", 0.0, 6.0)
    parts = F.filter(F.array(rounding, small, protrusion), lambda v: v.isNotNull())
    return cells.withColumns(
        {
            "mitotic_score": rounding * small * uniform * symmetry,
            "daughter_pair_flag": F.when(F.coalesce(pair, F.lit(False)), 1.0).otherwise(0.0),
            "protrusion_retraction_score": F.when(
                F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda a, v: a + v) / F.size(parts)
            ),
        }
    )
