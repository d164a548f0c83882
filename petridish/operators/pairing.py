"""Joins that pair channels, nuclei with cells, and measurement tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from petridish.functions import polygons as poly
from petridish.functions.numeric import compute_once, number, sides
from petridish.functions.text import cell_index, file_stem, last_number, natural_sort_key
from petridish.operators.assignment import best_assignment, tile_candidates
from petridish.operators.engines import greedy_matching
from petridish.operators.scale import rank_within, summarise
from petridish.session import materialize


# --- channels ---------------------------------------------------------------------------


def image_mapping(files: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Pair the channels of a dataset by position in natural order; "" where one is shorter.

    ``files`` has ``dataset, channel, name``.
    """
    ranked = rank_within(
        files.filter(F.col("channel").isin(*channels)).withColumn(
            "_key", natural_sort_key("name")
        ),
        ["dataset", "channel"],
        ["_key", "name"],
        "position",
    )
    wide = ranked.groupBy("dataset", "position").agg(
        *[
            F.coalesce(F.max(F.when(F.col("channel") == c, F.col("name"))), F.lit("")).alias(
                f"{c}_Name"
            )
            for c in channels
        ]
    )
    return wide


def match_by_stem_or_index(main: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Give every main image one image of another channel, each used once.

    Both sides have ``keys, name``. Walking the main images in natural order, an image takes
    the first unused image with the same stem (case-insensitive), else the first unused one
    with the same last number. Unmatched main images keep a NULL partner (fall back).

    Only number groups that mix images with and without a stem partner need candidate
    pairs; in the others the k-th image simply takes the k-th one.
    """
    keys = list(keys)

    def prepare(df, pos):
        df = compute_once(df.select(*keys, "name"), _stem=F.lower(file_stem("name")))
        df = compute_once(df, _number=last_number("_stem"), _key=natural_sort_key("name"))
        return rank_within(df, keys, ["_key", "name"], pos).select(
            *keys, "name", "_stem", "_number", pos
        )

    left = prepare(main, "_l")
    right = prepare(other, "_r").withColumnRenamed("name", "partner")
    by_stem = materialize(
        left.join(right.drop("_number"), [*keys, "_stem"]).select(
            *keys, "_l", "_r", "_number", F.lit(0).alias("_kind")
        )
    )
    numbered_l = left.filter("_number is not null")
    numbered_r = right.filter("_number is not null")
    group = [*keys, "_number"]
    with_stem = by_stem.select(*keys, "_l").distinct().withColumn("_has", F.lit(1))
    kinds = (
        numbered_l.join(with_stem, [*keys, "_l"], "left")
        .groupBy(*group)
        .agg(F.count("_has").alias("_stems"), F.count(F.lit(1)).alias("_all"))
    )
    # the stems of one folder may repeat (same stem, other extension): treat as mixed too
    doubled = (
        by_stem.groupBy(*keys, "_r")
        .agg(F.count(F.lit(1)).alias("_n"), F.max("_number").alias("_number"))
        .filter("_n > 1")
        .select(*group)
        .distinct()
        .withColumn("_double", F.lit(True))
    )
    kinds = kinds.join(doubled, group, "left").withColumn(
        "_case",
        F.when(F.col("_stems") == 0, "rank")
        .when((F.col("_stems") == F.col("_all")) & F.col("_double").isNull(), "stem")
        .otherwise("mixed"),
    )
    kinds = materialize(kinds.select(*group, "_case"))
    plain = kinds.filter("_case = 'rank'").select(*group)
    ranked_l = rank_within(numbered_l.join(plain, group), group, ["_l"], "_k")
    ranked_r = rank_within(numbered_r.join(plain, group), group, ["_r"], "_k")
    paired = ranked_l.join(ranked_r.select(*group, "_k", "_r"), [*group, "_k"]).select(
        *keys, "_l", "_r"
    )
    mixed = kinds.filter("_case = 'mixed'").select(*group)
    by_number = (
        numbered_l.join(mixed, group)
        .join(numbered_r.select(*group, "_r"), group)
        .select(*keys, "_l", "_r", "_number", F.lit(1).alias("_kind"))
    )
    edges = by_stem.unionByName(by_number).groupBy(*keys, "_l", "_r").agg(
        F.min("_kind").alias("_kind")
    )
    greedy = greedy_matching(edges, keys, "_l", "_r", ["_l", "_kind", "_r"])
    matches = paired.unionByName(greedy.select(*keys, "_l", "_r"))
    return (
        left.select(*keys, "name", "_l")
        .join(matches, [*keys, "_l"], "left")
        .join(right.select(*keys, "_r", "partner"), [*keys, "_r"], "left")
        .select(*keys, "name", "partner")
    )


# --- nuclei and cells -------------------------------------------------------------------

TILE = 64


def polygon_candidates(nuclei: DataFrame, cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Nuclei whose vertex mean lies strictly inside a cell polygon.

    ``nuclei(keys, nuc_no, points)``, ``cells(keys, cell_no, points)``. Cell polygons are
    spread over the tiles their box touches, so the join is an equi-join on the tile.
    """
    keys = list(keys)
    n = compute_once(
        nuclei.filter(F.size("points") >= 3),
        _x=poly.vertex_mean("points", "x"),
        _y=poly.vertex_mean("points", "y"),
    ).select(
        *keys,
        "nuc_no",
        "_x",
        "_y",
        F.floor(F.col("_x") / TILE).alias("_tx"),
        F.floor(F.col("_y") / TILE).alias("_ty"),
    )
    c = compute_once(cells.filter(F.size("points") >= 3), _edges=poly.closed_edges("points"))
    c = c.filter(poly.area("_edges") > 0)

    def tiles(axis):
        values = F.transform("points", lambda p: p[axis])
        return F.explode(
            F.sequence(
                F.floor(F.array_min(values) / TILE), F.floor(F.array_max(values) / TILE)
            )
        )

    c = (
        c.withColumn("_tx", tiles("x"))
        .withColumn("_ty", tiles("y"))
        .select(*keys, "cell_no", "_edges", "_tx", "_ty")
    )
    return (
        n.join(c, [*keys, "_tx", "_ty"])
        .filter(poly.strictly_inside("_edges", "_x", "_y"))
        .select(*keys, "nuc_no", "cell_no")
    )


def pair_by_polygon(nuclei: DataFrame, cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One-to-one pairs in nucleus order, then unpaired nuclei, then unpaired cells.

    ``record`` numbers the output of each image from 1, ``nuc_no``/``cell_no`` is NULL on
    the missing side.
    """
    keys = list(keys)
    edges = polygon_candidates(nuclei, cells, keys)
    pairs = greedy_matching(edges, keys, "nuc_no", "cell_no", ["nuc_no", "cell_no"]).select(*keys, "nuc_no", "cell_no")
    rows = (
        nuclei.select(*keys, "nuc_no")
        .join(pairs, [*keys, "nuc_no"], "left")
        .join(cells.select(*keys, "cell_no"), [*keys, "cell_no"], "full")
        .withColumn(
            "_kind",
            F.when(F.col("cell_no").isNull(), 1).when(F.col("nuc_no").isNull(), 2).otherwise(0),
        )
        .withColumn("_order", F.coalesce("nuc_no", "cell_no"))
    )
    return rank_within(rows, keys, ["_kind", "_order"], "record").select(
        *keys, "record", "nuc_no", "cell_no"
    )


def label_centres(label_pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    return label_pixels.groupBy(*keys, "label").agg(
        F.count(F.lit(1)).alias("area"), F.avg("x").alias("cx"), F.avg("y").alias("cy")
    )


def pair_by_centroid(label_pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cell label under the truncated centre of each nucleus; cells may repeat."""
    nuc = label_pixels.filter("region = 'nuc'")
    cyto = label_pixels.filter("region = 'cyto'")
    centres = label_centres(nuc, keys).select(
        *keys,
        F.col("label").alias("nuc_label"),
        F.floor("cx").cast("int").alias("x"),
        F.floor("cy").cast("int").alias("y"),
    )
    return centres.join(
        cyto.select(*keys, "x", "y", F.col("label").alias("cyto_label")), [*keys, "x", "y"]
    ).select(*keys, "cyto_label", "nuc_label")


def label_boxes(label_pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    return label_pixels.groupBy(*keys, "region", "label").agg(
        F.count(F.lit(1)).alias("area"),
        F.min("x").alias("left"),
        F.min("y").alias("top"),
        (F.max("x") + 1).alias("right"),
        (F.max("y") + 1).alias("bottom"),
    )


def paired_region_counts(label_pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Raw and paired object counts per image."""
    keys = list(keys)
    raw = label_boxes(label_pixels, keys).groupBy(*keys).agg(
        F.count_if(F.col("region") == "nuc").alias("raw_nucleus_count"),
        F.count_if(F.col("region") == "cyto").alias("raw_cytoplasm_count"),
    )
    pairs = pair_by_centroid(label_pixels, keys).groupBy(*keys).agg(
        F.countDistinct("nuc_label").alias("paired_nucleus_count"),
        F.countDistinct("cyto_label").alias("paired_cytoplasm_count"),
    )
    return raw.join(pairs, keys, "left").na.fill(
        0, ["paired_nucleus_count", "paired_cytoplasm_count"]
    )


def border_labels(
    label_pixels: DataFrame, keys: Sequence[str], width: Column, height: Column
) -> DataFrame:
    """Objects with a pixel on the outermost line of the image."""
    width, height = sides(width, height)
    return (
        label_pixels.filter(
            (F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == width - 1) | (F.col("y") == height - 1)
        )
        .select(*keys, "region", "label")
        .distinct()
    )


def relabel_kept(label_pixels: DataFrame, kept: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keep the listed objects (``keys, region, label``) and number them densely from 1."""
    names = rank_within(
        kept.select(*keys, "region", "label").distinct(), [*keys, "region"], ["label"], "_new"
    )
    return (
        label_pixels.join(names, [*keys, "region", "label"])
        .drop("label")
        .withColumnRenamed("_new", "label")
    )


def filter_small_labels(
    label_pixels: DataFrame, keys: Sequence[str], ratio: float, floor: int
) -> DataFrame:
    """Drop objects below ``max(floor, ratio * median area)`` of their image and region."""
    keys = list(keys)
    areas = materialize(
        label_pixels.groupBy(*keys, "region", "label").agg(F.count(F.lit(1)).alias("area"))
    )
    medians = summarise(areas, [*keys, "region"], percentiles={"_median": ("area", 0.5)})
    kept = areas.join(medians, [*keys, "region"]).filter(
        F.col("area") >= F.greatest(F.lit(float(floor)), ratio * F.col("_median"))
    )
    return relabel_kept(label_pixels, kept, keys)


def filter_small_unpaired(
    label_pixels: DataFrame,
    keys: Sequence[str],
    width: Column,
    height: Column,
    ratio: float,
    floor: int,
    min_reference: int = 10,
    min_containment: float = 0.8,
) -> tuple[DataFrame, DataFrame]:
    """Drop small unpaired objects; paired ones always stay.

    The area threshold of an image comes from its trusted pairs (nucleus mostly inside, no
    border contact) when both regions have enough of them, else from all pairs, else from
    all objects. Returns the kept objects and the per-image diagnostics.
    """
    keys = list(keys)
    areas = label_pixels.groupBy(*keys, "region", "label").agg(F.count(F.lit(1)).alias("area"))
    pairs = pair_by_centroid(label_pixels, keys)
    nuc = label_pixels.filter("region = 'nuc'").select(*keys, "x", "y", F.col("label").alias("nuc_label"))
    cyto = label_pixels.filter("region = 'cyto'").select(
        *keys, "x", "y", F.col("label").alias("cyto_label")
    )
    inside = (
        nuc.join(cyto, [*keys, "x", "y"])
        .join(pairs, [*keys, "nuc_label", "cyto_label"])
        .groupBy(*keys, "nuc_label", "cyto_label")
        .agg(F.count(F.lit(1)).alias("_in"))
    )
    border = border_labels(label_pixels, keys, width, height).withColumn("_border", F.lit(True))

    def on_border(region, name):
        return border.filter(F.col("region") == region).select(
            *keys, F.col("label").alias(f"{region}_label"), F.col("_border").alias(name)
        )

    nuc_area = areas.filter("region = 'nuc'").select(
        *keys, F.col("label").alias("nuc_label"), F.col("area").alias("_na")
    )
    judged = (
        pairs.join(inside, [*keys, "nuc_label", "cyto_label"], "left")
        .join(nuc_area, [*keys, "nuc_label"])
        .join(on_border("nuc", "_bn"), [*keys, "nuc_label"], "left")
        .join(on_border("cyto", "_bc"), [*keys, "cyto_label"], "left")
        .withColumn(
            "_trusted",
            (F.coalesce("_in", F.lit(0)) / F.col("_na") >= min_containment)
            & F.col("_bn").isNull()
            & F.col("_bc").isNull(),
        )
    )
    sides = judged.select(
        *keys,
        "_trusted",
        F.explode(
            F.array(
                F.struct(F.lit("nuc").alias("region"), F.col("nuc_label").alias("label")),
                F.struct(F.lit("cyto").alias("region"), F.col("cyto_label").alias("label")),
            )
        ).alias("_s"),
    )
    roles = sides.groupBy(
        *keys, F.col("_s.region").alias("region"), F.col("_s.label").alias("label")
    ).agg(F.max("_trusted").alias("_trusted"))
    objects = materialize(
        areas.join(roles, [*keys, "region", "label"], "left")
        .withColumn("_paired", F.col("_trusted").isNotNull())
        .withColumn("_trusted", F.coalesce("_trusted", F.lit(False)))
        .withColumn("_a_trusted", F.when(F.col("_trusted"), F.col("area")))
        .withColumn("_a_paired", F.when(F.col("_paired"), F.col("area")))
    )
    stats = summarise(
        objects,
        [*keys, "region"],
        {
            "_n_trusted": F.count("_a_trusted"),
            "_n_paired": F.count("_a_paired"),
            "_n": F.count(F.lit(1)),
        },
        {
            "_m_trusted": ("_a_trusted", 0.5),
            "_m_paired": ("_a_paired", 0.5),
            "_m": ("area", 0.5),
        },
    )
    both = stats.groupBy(*keys).agg(
        F.min("_n_trusted").alias("_lt"),
        F.min("_n_paired").alias("_lp"),
        F.count(F.lit(1)).alias("_regions"),
    )
    trusted_ok = (F.col("_lt") >= min_reference) & (F.col("_regions") == 2)
    paired_ok = (F.col("_lp") >= 1) & (F.col("_regions") == 2)
    stats = (
        stats.join(both, keys)
        .withColumn(
            "_ref",
            F.when(trusted_ok, F.col("_m_trusted"))
            .when(paired_ok, F.col("_m_paired"))
            .otherwise(F.col("_m")),
        )
        .withColumn(
            "reference_count",
            F.when(trusted_ok, F.col("_n_trusted"))
            .when(paired_ok, F.col("_n_paired"))
            .otherwise(F.col("_n")),
        )
        .withColumn("threshold", F.greatest(F.lit(float(floor)), ratio * F.col("_ref")))
        .select(*keys, "region", "threshold", "reference_count")
    )
    decided = objects.join(stats, [*keys, "region"]).withColumn(
        "_keep", F.col("_paired") | (F.col("area") >= F.col("threshold"))
    )
    diagnostics = decided.groupBy(*keys, "region", "threshold", "reference_count").agg(
        F.count_if("_paired").alias("paired_count"),
        F.count_if(~F.col("_keep")).alias("removed_count"),
    )
    return decided.filter("_keep").select(*keys, "region", "label", "area"), diagnostics


# --- batch pairing ----------------------------------------------------------------------


def score_nucleus_pairs(
    candidates: DataFrame, label_pixels: DataFrame, keys: Sequence[str] = ("dataset",)
) -> DataFrame:
    """Score listed image pairs: nucleus centres of one image inside any cell of the other.

    ``candidates(keys, row_image, col_image)``; rows are cell images, columns nucleus images.
    Only listed pairs are scored, by equi-joins on the pixel position.
    """
    keys = list(keys)
    centres = label_centres(label_pixels.filter("region = 'nuc'"), [*keys, "image_id"]).select(
        *keys,
        F.col("image_id").alias("col_image"),
        F.bround("cx", 0).cast("int").alias("x"),
        F.bround("cy", 0).cast("int").alias("y"),
    )
    cover = (
        label_pixels.filter("region = 'cyto'")
        .select(*keys, F.col("image_id").alias("row_image"), "x", "y")
        .distinct()
        .withColumn("_hit", F.lit(1))
    )
    scored = (
        candidates.join(centres, [*keys, "col_image"])
        .join(cover, [*keys, "row_image", "x", "y"], "left")
        .groupBy(*keys, "row_image", "col_image")
        .agg(F.count("_hit").alias("inside"), F.count(F.lit(1)).alias("total"))
    )
    return (
        candidates.join(scored, [*keys, "row_image", "col_image"], "left")
        .na.fill(0, ["inside", "total"])
        .withColumn(
            "score",
            F.coalesce(
                F.try_divide("inside", "total") * 1000.0,
                F.lit(0.0),
            )
            + F.col("inside") * 0.001,
        )
        .withColumn("score", F.col("score").cast("float").cast("double"))
    )


def score_mask_pairs(
    candidates: DataFrame,
    label_pixels: DataFrame,
    mask: DataFrame,
    keys: Sequence[str] = ("dataset",),
    threshold: float = 0.10,
) -> DataFrame:
    """Score listed pairs of outline image and label mask by nucleus overlap.

    The score is ``1000 * positive nuclei + 100 * mean overlap``.
    """
    keys = list(keys)
    nuclei = label_pixels.filter("region = 'nuc'").select(
        *keys, F.col("image_id").alias("row_image"), "label", "x", "y"
    )
    lit = mask.select(*keys, F.col("image_id").alias("col_image"), "x", "y").withColumn(
        "_hit", F.lit(1)
    )
    scored = (
        candidates.join(nuclei, [*keys, "row_image"])
        .join(lit, [*keys, "col_image", "x", "y"], "left")
        .groupBy(*keys, "row_image", "col_image", "label")
        .agg((F.count("_hit") / F.count(F.lit(1))).alias("_share"))
        .groupBy(*keys, "row_image", "col_image")
        .agg(
            F.count_if(F.col("_share") >= threshold).alias("positive"),
            F.count(F.lit(1)).alias("total"),
            F.avg("_share").alias("mean_overlap"),
        )
    )
    return (
        candidates.join(scored, [*keys, "row_image", "col_image"], "left")
        .na.fill(0, ["positive", "total", "mean_overlap"])
        .withColumn(
            "score",
            (F.col("positive") * 1000.0 + F.col("mean_overlap") * 100.0)
            .cast("float")
            .cast("double"),
        )
    )


def nucleus_candidates(
    label_pixels: DataFrame, tile: float, keys: Sequence[str] = ("dataset",), **index
) -> DataFrame:
    """Image pairs whose cell centres and nucleus centres lie in similar tiles, with the given names."""
    keys = list(keys)

    def centres(region: str, name: str) -> DataFrame:
        found = label_centres(label_pixels.filter(F.col("region") == region), [*keys, "image_id"])
        return found.select(*keys, F.col("image_id").alias(name), F.col("cx").alias("x"), F.col("cy").alias("y"))

    return tile_candidates(centres("cyto", "row_image"), centres("nuc", "col_image"), keys, tile, **index)


def mask_candidates(
    label_pixels: DataFrame, mask: DataFrame, tile: float, keys: Sequence[str] = ("dataset",), **index
) -> DataFrame:
    """Image pairs whose nucleus centres and lit mask pixels lie in similar tiles, with the given names."""
    keys = list(keys)
    nuclei = label_centres(label_pixels.filter("region = 'nuc'"), [*keys, "image_id"])
    nuclei = nuclei.select(*keys, F.col("image_id").alias("row_image"), F.col("cx").alias("x"), F.col("cy").alias("y"))
    lit = mask.select(*keys, F.col("image_id").alias("col_image"), "x", "y")
    return tile_candidates(nuclei, lit, keys, tile, **index)


def remap_batch(
    scores: DataFrame,
    keys: Sequence[str] = ("dataset",),
    rule: str = "score",
    min_gain: float = 0.05,
    count: str = "positive",
    method: str = "best",
) -> DataFrame:
    """Accept a shifted pairing of a whole dataset when it clearly beats the given names.

    ``scores(keys, row_image, col_image, score[, count])``. The pairs have the largest total score
    (``method="best"``), or are taken greedily by falling score, ties by row and column.
    ``rule="score"`` needs a total score above the
    same-name total by ``max(1, min_gain * |total|)``; ``rule="count"`` needs at least three
    times and ``max(20, 2 * rows)`` more positives. Returns every row image with its
    ``source`` (its own image when the remap is refused) and the decision.
    """
    keys = list(keys)
    if method == "best":
        pairs = best_assignment(scores, keys).select(*keys, "row_image", "col_image")
        chosen = scores.join(pairs, [*keys, "row_image", "col_image"], "left_semi")
    else:
        edges = scores.withColumn("_neg", -F.col("score"))
        chosen = greedy_matching(
            edges, keys, "row_image", "col_image", ["_neg", "row_image", "col_image"]
        )
    amount = F.col("score") if rule == "score" else F.col(count).cast("double")
    assigned = chosen.groupBy(*keys).agg(
        F.sum(amount).alias("assigned"),
        F.max((F.col("row_image") != F.col("col_image")).cast("int")).alias("_changed"),
    )
    same = (
        scores.filter("row_image = col_image")
        .groupBy(*keys)
        .agg(F.sum(amount).alias("identity"))
    )
    rows = scores.groupBy(*keys).agg(F.countDistinct("row_image").alias("_rows"))
    totals = rows.join(assigned, keys).join(same, keys, "left").na.fill(0.0, ["identity"])
    if rule == "score":
        better = F.col("assigned") > F.col("identity") + F.greatest(
            F.lit(1.0), F.abs("identity") * min_gain
        )
    else:
        better = (F.col("assigned") >= F.col("identity") * 3) & (
            F.col("assigned") - F.col("identity")
            >= F.greatest(F.lit(20.0), F.col("_rows") * 2.0)
        )
    totals = totals.withColumn("accepted", (F.col("_changed") == 1) & better & (F.col("_rows") >= 2))
    return (
        scores.select(*keys, "row_image")
        .distinct()
        .join(chosen.select(*keys, "row_image", "col_image"), [*keys, "row_image"], "left")
        .join(totals.select(*keys, "accepted", "assigned", "identity"), keys)
        .withColumn(
            "source",
            F.when(F.col("accepted") & F.col("col_image").isNotNull(), F.col("col_image")).otherwise(
                F.col("row_image")
            ),
        )
        .drop("col_image")
    )


# --- measurement tables -----------------------------------------------------------------


def merge_roi_wide(
    long: DataFrame, cell: Sequence[str], region_features: Sequence[str], cell_features: Sequence[str] = ()
) -> DataFrame:
    """Long region rows to one row per cell: suffixed region features, cell-level ones once.

    One aggregate replaces the full outer join of the two regions.
    """
    def of(region, c):
        return F.max(F.when(F.col("region") == region, F.col(f"`{c}`")))

    return long.groupBy(*cell).agg(
        *[of(r, c).alias(f"{c}_{r}") for r in ("nuc", "cyto") for c in region_features],
        *[of("cyto", c).alias(c) for c in cell_features],
    )


def merge_fluor(cells: DataFrame, rings: DataFrame, keys: Sequence[str], cell: str = "Cell_ID") -> DataFrame:
    """Left join of ring columns by trailing cell index within one image."""
    right = rings.withColumn("_i", cell_index(cell)).drop(cell)
    return (
        cells.withColumn("_i", cell_index(cell)).join(right, [*keys, "_i"], "left").drop("_i")
    )


def merge_labels(cells: DataFrame, positives: DataFrame, keys: Sequence[str]) -> DataFrame:
    """1 for cells on the positive list, 0 for the others."""
    hit = positives.select(*keys).distinct().withColumn("_hit", F.lit(1))
    return (
        cells.drop("ki67_positive")
        .join(hit, list(keys), "left")
        .withColumn("ki67_positive", F.col("_hit").isNotNull().cast("int"))
        .drop("_hit")
    )


def repair_labels(
    cells: DataFrame,
    datasets: Sequence[str],
    positives: DataFrame,
    statuses: DataFrame,
    keys: Sequence[str],
) -> DataFrame:
    """Recomputed label, status and cleaning of the chosen datasets.

    Write the result with ``partition_by=["dataset"]``: only those partitions are replaced.
    """
    from petridish.operators.quality import add_status, clean_cells

    chosen = cells.filter(F.col("dataset").isin(*datasets))
    return clean_cells([add_status(merge_labels(chosen, positives, keys), statuses, keys)])


def attach_embeddings(cells: DataFrame, embeddings: DataFrame, size: int, key: str = "image_key") -> DataFrame:
    """Image vector on every cell, zeros where an image has none.

    ``embeddings(key, embedding)`` has one row per image; the size decides the join strategy
    at run time, and a hot image splits on the cell side.
    """
    return cells.join(embeddings.select(key, "embedding"), key, "left").withColumn(
        "embedding",
        F.coalesce("embedding", F.array_repeat(F.lit(0.0).cast("float"), size)),
    )


def resolve_image_fuzzy(images: DataFrame, files: DataFrame) -> DataFrame:
    """Source file of every image name in its folder.

    ``images(folder, image)``, ``files(folder, file)``. Equal stems win, then a stem that ends
    with the other, then one that contains the other; ties go to the first file name. Suffix
    and substring tests are equi-joins on the suffixes and on the substrings whose length
    occurs on the other side, each reduced to its first file beforehand.
    """
    want = compute_once(
        images.select("folder", "image").distinct(), _s=file_stem("image")
    ).filter("_s <> ''")
    have = compute_once(files.select("folder", "file").distinct(), _s=file_stem("file")).filter(
        "_s <> ''"
    )
    first = have.groupBy("folder", "_s").agg(F.min("file").alias("file"))
    exact = want.join(first, ["folder", "_s"]).select(
        "folder", "image", "file", F.lit(0).alias("_tier")
    )
    rest = materialize(want.join(exact, ["folder", "image"], "left_anti"))

    def suffixes(df):
        return df.withColumn(
            "_t", F.explode(F.expr("transform(sequence(1, length(_s)), i -> substring(_s, i))"))
        )

    end_a = suffixes(rest).select("folder", "image", F.col("_t").alias("_s")).join(
        first, ["folder", "_s"]
    )
    file_ends = suffixes(have).groupBy("folder", F.col("_t").alias("_s")).agg(
        F.min("file").alias("file")
    )
    end_b = rest.join(file_ends, ["folder", "_s"])
    ends = materialize(
        end_a.select("folder", "image", "file")
        .unionByName(end_b.select("folder", "image", "file"))
        .groupBy("folder", "image")
        .agg(F.min("file").alias("file"))
    )
    last = rest.join(ends, ["folder", "image"], "left_anti")

    def lengths(df):  # at most a few hundred distinct lengths per folder
        return df.groupBy("folder").agg(F.collect_set(F.length("_s")).alias("_l"))

    def pieces(df, other):
        return (
            df.join(lengths(other), "folder")
            .withColumn("_n", F.explode("_l"))
            .filter("_n <= length(_s)")
            .withColumn(
                "_t",
                F.explode(
                    F.expr("transform(sequence(1, length(_s) - _n + 1), i -> substring(_s, i, _n))")
                ),
            )
        )

    in_a = pieces(last, have).select("folder", "image", F.col("_t").alias("_s")).join(
        first, ["folder", "_s"]
    )
    file_parts = pieces(have, last).groupBy("folder", F.col("_t").alias("_s")).agg(
        F.min("file").alias("file")
    )
    in_b = last.join(file_parts, ["folder", "_s"])
    parts = (
        in_a.select("folder", "image", "file")
        .unionByName(in_b.select("folder", "image", "file"))
        .groupBy("folder", "image")
        .agg(F.min("file").alias("file"))
    )
    found = (
        exact.unionByName(ends.withColumn("_tier", F.lit(1)))
        .unionByName(parts.withColumn("_tier", F.lit(2)))
        .withColumnRenamed("_tier", "tier")
    )
    return images.select("folder", "image").distinct().join(found, ["folder", "image"], "left")


def image_set_difference(expected: DataFrame, used: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows on one side only, with ``side`` = ``missing`` (expected) or ``extra`` (used)."""
    e = expected.select(*keys).distinct()
    u = used.select(*keys).distinct()
    return e.join(u, list(keys), "left_anti").withColumn("side", F.lit("missing")).unionByName(
        u.join(e, list(keys), "left_anti").withColumn("side", F.lit("extra"))
    )


def folder_diagnostics(expected: DataFrame, used: DataFrame) -> DataFrame:
    """Image counts per folder: expected, used, missing, extra.

    The names behind the counts are the rows of :func:`image_set_difference`.
    """
    keys = ["source_folder", "image_name"]
    both = (
        expected.select(*keys, F.lit(1).alias("_e"), F.lit(0).alias("_u"))
        .unionByName(used.select(*keys, F.lit(0).alias("_e"), F.lit(1).alias("_u")))
        .groupBy(*keys)
        .agg(F.max("_e").alias("_e"), F.max("_u").alias("_u"))
    )
    return both.groupBy("source_folder").agg(
        F.sum("_e").alias("input_image_count"),
        F.sum("_u").alias("used_image_count"),
        F.sum(F.col("_e") * (1 - F.col("_u"))).alias("missing_image_count"),
        F.sum(F.col("_u") * (1 - F.col("_e"))).alias("extra_image_count"),
    )


def compare_backends(
    left: DataFrame, right: DataFrame, ids: Sequence[str], features: Sequence[str], by: Sequence[str]
) -> DataFrame:
    """Agreement of two measurement runs per ``by`` and feature, over cells in both."""
    ids = list(ids)

    def long(df, name):
        return df.select(*ids, *[number(f"`{f}`").alias(f) for f in features]).unpivot(
            ids, list(features), "feature", name
        )

    joined = (
        long(left, "_a")
        .join(long(right, "_b"), [*ids, "feature"])
        .filter(F.col("_a").isNotNull() & F.col("_b").isNotNull())
        .withColumn("_d", F.col("_b") - F.col("_a"))
        .withColumn("_ad", F.abs("_d"))
    )
    return summarise(
        joined,
        [*by, "feature"],
        {
            "pairs": F.count(F.lit(1)),
            "mean_left": F.avg("_a"),
            "mean_right": F.avg("_b"),
            "mean_difference": F.avg("_d"),
            "mean_abs_difference": F.avg("_ad"),
            "max_abs_difference": F.max("_ad"),
            "pearson": F.try_divide(
                F.covar_pop("_a", "_b"), F.stddev_pop("_a") * F.stddev_pop("_b")
            ),
        },
        {"median_abs_difference": ("_ad", 0.5)},
    )
