"""Completeness, cleaning and quality control of cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from petridish.functions.catalog import KEPT_STATUSES
from petridish.functions.numeric import number, safe_divide
from petridish.operators.scale import with_group_stats


def touches_edge(
    points: str, width: Column, height: Column, margin: int = 1, least: int = 2
) -> Column:
    """At least ``least`` vertices within ``margin`` of one image side; NULL polygon: False."""

    def near(test):
        return F.size(F.filter(F.col(points), test)) >= least

    return F.when(F.size(points) < 3, False).otherwise(
        F.coalesce(
            near(lambda p: p.x <= margin)
            | near(lambda p: p.y <= margin)
            | near(lambda p: p.x >= width - 1 - margin)
            | near(lambda p: p.y >= height - 1 - margin),
            F.lit(False),
        )
    )


def outline_status(
    outlines: DataFrame, width: Column, height: Column, nuc: str = "nuc", cyto: str = "cyto"
) -> DataFrame:
    """Add ``status`` from presence of both sides and their contact with the image edge."""
    has_nuc, has_cyto = F.col(nuc).isNotNull(), F.col(cyto).isNotNull()
    nuc_cut = F.when(has_nuc, touches_edge(nuc, width, height)).otherwise(False)
    cyto_cut = F.when(has_cyto, touches_edge(cyto, width, height)).otherwise(False)
    status = (
        F.when(has_nuc & ~has_cyto & nuc_cut, "nuc_cut")
        .when(has_nuc & ~has_cyto, "nuc_only")
        .when(has_cyto & ~has_nuc, "cyto_only")
        .when(nuc_cut & cyto_cut, "both_cut")
        .when(nuc_cut, "nuc_cut")
        .when(cyto_cut, "cyto_cut")
        .when(has_nuc & has_cyto, "full_cell")
        .otherwise("empty")
    )
    return outlines.withColumn("status", status)


def add_status(cells: DataFrame, statuses: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of the outline status; cells without an outline are ``unknown``."""
    found = statuses.select(*keys, F.col("status").alias("_status"))
    return (
        cells.drop("cell_status")
        .join(found, list(keys), "left")
        .withColumn("cell_status", F.coalesce("_status", F.lit("unknown")))
        .drop("_status")
    )


def clean_cells(tables: Sequence[DataFrame]) -> DataFrame:
    """Union of final tables without unusable rows; ``cell_status`` comes last.

    With a status column the six usable statuses stay. Without one, rows with any missing
    nucleus or cell feature go.
    """
    merged = tables[0]
    for t in tables[1:]:
        merged = merged.unionByName(t, allowMissingColumns=True)
    if "cell_status" in merged.columns:
        order = [c for c in merged.columns if c != "cell_status"] + ["cell_status"]
        return merged.filter(F.col("cell_status").isin(*KEPT_STATUSES)).select(*order)
    features = [c for c in merged.columns if c.endswith(("_nuc", "_cyto"))]
    return merged.dropna(how="any", subset=features) if features else merged


def filter_extreme_ratio(cells: DataFrame, image: str = "image_key") -> DataFrame:
    """Leave out images whose cells are all negative or all positive."""
    if "ki67_label" not in cells.columns:
        return cells
    return (
        with_group_stats(cells, [image], _ratio=F.avg("ki67_label"))
        .filter("_ratio > 0 and _ratio < 1")
        .drop("_ratio")
    )


def valid_area(cells: DataFrame, nuc: str = "Area_nuc", cell: str = "Area_cyto") -> DataFrame:
    missing = [c for c in (nuc, cell) if c not in cells.columns]
    if missing:
        raise KeyError(f"missing area columns {missing}")
    return (
        cells.withColumn(nuc, number(nuc))
        .withColumn(cell, number(cell))
        .filter((F.col(nuc) > 0) & (F.col(cell) > 0))
    )


def cell_overlap(label_pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per ``keys + label``: nucleus, cell, cytoplasm areas and the nucleus share outside."""
    px = label_pixels.groupBy(*keys, "label", "x", "y").agg(
        F.max((F.col("region") == "nuc").cast("int")).alias("_n"),
        F.max((F.col("region") == "cyto").cast("int")).alias("_c"),
    )
    return (
        px.groupBy(*keys, "label")
        .agg(
            F.sum("_n").alias("nuc_area"),
            F.sum("_c").alias("cell_area"),
            F.sum(F.col("_n") * (1 - F.col("_c"))).alias("_outside"),
            F.sum(F.col("_c") * (1 - F.col("_n"))).alias("cytoplasm_area"),
        )
        .withColumn(
            "outside_fraction",
            safe_divide(F.col("_outside").cast("double"), F.col("nuc_area").cast("double")),
        )
        .drop("_outside")
    )


def full_cell_qc(
    statuses: DataFrame, label_pixels: DataFrame, keys: Sequence[str], max_outside: float = 0.05
) -> tuple[DataFrame, DataFrame]:
    """Decide per complete cell and count per image.

    ``statuses`` has ``keys, label, status``. Returns the decided cells (``decision`` is
    ``kept``, ``outside``, ``no_cytoplasm`` or NULL for other statuses) and the image counts.
    """
    areas = cell_overlap(label_pixels, keys)
    full = F.col("status") == "full_cell"
    outside = F.coalesce(F.col("outside_fraction") > max_outside, F.lit(False))
    decided = statuses.join(areas, [*keys, "label"], "left").withColumn(
        "decision",
        F.when(full & outside, "outside")
        .when(full & (F.coalesce("cytoplasm_area", F.lit(0)) <= 0), "no_cytoplasm")
        .when(full, "kept"),
    )
    counts = decided.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("outline_pairs"),
        F.count_if(F.col("decision") == "kept").alias("kept_full_cells"),
        F.count_if(F.col("decision") == "outside").alias("excluded_nucleus_outside"),
        F.count_if(F.col("decision") == "no_cytoplasm").alias("excluded_empty_cytoplasm"),
        *[
            F.count_if(F.col("status") == s).alias(f"status_{s}")
            for s in (*KEPT_STATUSES, "empty")
        ],
    )
    return decided, counts


def append_prediction_cols(cells: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Class at the threshold and, where a label exists, whether it is right.

    A missing probability counts as negative.
    """
    prob = number("cell_prob")
    out = cells.withColumn("cell_prob", prob).withColumn(
        "cell_pred", F.coalesce((F.col("cell_prob") >= threshold).cast("int"), F.lit(0))
    )
    if "ki67_label" in cells.columns:
        out = out.withColumn("cell_correct", F.col("cell_pred") == number("ki67_label"))
    return out


def default_split(df: DataFrame) -> DataFrame:
    if "split" in df.columns:
        return df
    return df.withColumn("split", F.col("source_folder").cast("string"))


def append_error_cols(images: DataFrame) -> DataFrame:
    out = images.withColumn("pred_ratio", number("pred_ratio"))
    if "true_ratio" not in images.columns:
        return out
    return (
        out.withColumn("true_ratio", number("true_ratio"))
        .withColumn("signed_error", F.col("pred_ratio") - F.col("true_ratio"))
        .withColumn("abs_error", F.abs("signed_error"))
    )
