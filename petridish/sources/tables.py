"""Cell tables: discovery, loading, and the study manifest."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from petridish.functions.catalog import morphology_columns, resolve_column
from petridish.functions.numeric import number
from petridish.functions.text import (
    file_name,
    file_stem,
    image_key,
    passage_of,
    with_study_fields,
)
from petridish.operators.scale import rank_within

# Column names accepted for the label and the passage.
LABEL_COLUMNS = ("ki67_label", "ki67_positive", "Ki67_Positive", "label")
PASSAGE_COLUMNS = ("passage", "Passage")


def folder_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def select_cleaned_files(
    files: DataFrame,
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
    suffix: str = "_cleaned.csv",
) -> DataFrame:
    """Cleaned tables by folder name, compared in lower case; exclusion wins."""
    key = F.lower(F.trim(F.col("source_folder")))
    out = files.withColumn("source_folder", folder_of(F.col("path"))).filter(
        F.col("path").endswith(suffix)
    )
    if exclude:
        out = out.filter(~key.isin(*[e.strip().lower() for e in exclude]))
    if include:
        out = out.filter(key.isin(*[e.strip().lower() for e in include]))
    return out


def read_cleaned(
    spark: SparkSession, root: str, include: Sequence[str] = (), exclude: Sequence[str] = ()
) -> DataFrame:
    """All cleaned CSV tables below ``root`` as text columns, with path and folder."""
    raw = (
        spark.read.option("header", "true")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*_cleaned.csv")
        .csv(root)
        .withColumn("path", F.col("_metadata.file_path"))
    )
    return select_cleaned_files(raw, include, exclude)


def load_cells(
    tables: Sequence[DataFrame],
    row_order: str,
    require_label: bool = True,
    labels: Sequence[str] = LABEL_COLUMNS,
    passages: Sequence[str] = PASSAGE_COLUMNS,
) -> DataFrame:
    """Union of cell tables with one label, passage, image key and row number.

    Each table has ``source_file`` and ``source_folder`` and may name its label and passage
    column differently. The label becomes 0/1 and rows without one are dropped; tables
    without any label column are left out when a label is required. ``row_order`` is a
    unique column that gives the row order inside a file.
    """
    parts = []
    for t in tables:
        label = resolve_column(t.columns, labels)
        if label is None and require_label:
            continue
        if label is not None:
            t = t.withColumn("_label", number(label)).filter(F.col("_label").isNotNull())
            t = t.drop(label).withColumn("ki67_label", (F.col("_label") > 0).cast("int")).drop(
                "_label"
            )
        passage = resolve_column(t.columns, passages)
        t = t.withColumn(
            "passage", passage_of(passage if passage is not None else "source_folder")
        )
        if "Image" not in t.columns:
            t = t.withColumn(
                "Image", F.regexp_replace(file_name("source_file"), r"_cleaned\.csv$", "")
            )
        parts.append(t)
    if not parts:
        raise ValueError("no cell table with a label column")
    cells = parts[0]
    for t in parts[1:]:
        cells = cells.unionByName(t, allowMissingColumns=True)
    for name, kind in cells.dtypes:
        if kind in ("double", "float"):
            cells = cells.withColumn(name, number(name))
    cells = cells.withColumn("image_key", image_key("source_folder", "Image"))
    return rank_within(cells, ["source_file"], [row_order], "_source_row_id").withColumn(
        "_source_row_id", F.col("_source_row_id") - 1
    )


def parse_image_filename(files: DataFrame, path: str = "path") -> DataFrame:
    """Study fields of every file; ``parsed`` tells matched names from rejects."""
    fields = with_study_fields(files, file_stem(path))
    return fields.withColumn("parsed", F.col("image_key").isNotNull())


def triplet_manifest(files: DataFrame) -> DataFrame:
    """One row per complete phase/DAPI/IDO triplet of equal image sizes.

    ``files`` has ``path, width, height`` and the parsed study fields.
    """
    wide = (
        files.filter(F.col("image_key").isNotNull())
        .groupBy("image_key", "condition", "ifn_dose", "tnf_dose", "image_index")
        .agg(
            *[
                F.min(F.when(F.col("channel") == c, F.col("path"))).alias(f"{c}_path")
                for c in ("phase", "dapi", "ido")
            ],
            F.min("width").alias("width"),
            F.max("width").alias("_w"),
            F.min("height").alias("height"),
            F.max("height").alias("_h"),
        )
    )
    return (
        wide.dropna(subset=["phase_path", "dapi_path", "ido_path"])
        .filter("width = _w and height = _h")
        .drop("_w", "_h")
        .withColumn("pc_stem", file_stem("phase_path"))
    )


def manifest_violations(
    files: DataFrame,
    expected_triplets: int | None = None,
    expected_conditions: Mapping[tuple[float, float], int] | None = None,
) -> DataFrame:
    """Every reason to refuse a study folder: ``check, subject, found``."""
    parsed = files.filter(F.col("image_key").isNotNull())
    per_channel = parsed.groupBy("image_key", "channel").agg(F.count(F.lit(1)).alias("n"))
    duplicate = per_channel.filter("n > 1").select(
        F.lit("duplicate").alias("check"),
        F.concat_ws(":", "image_key", "channel").alias("subject"),
        F.col("n").alias("found"),
    )
    per_key = parsed.groupBy("image_key").agg(
        F.countDistinct("channel").alias("channels"),
        F.countDistinct("width", "height").alias("sizes"),
    )
    missing = per_key.filter("channels < 3").select(
        F.lit("missing channel"), "image_key", "channels"
    )
    sizes = per_key.filter("sizes > 1").select(F.lit("size mismatch"), "image_key", "sizes")
    unreadable = files.filter(F.col("image_key").isNull()).select(
        F.lit("unreadable name"), file_name("path"), F.lit(1).cast("bigint")
    )
    out = duplicate.union(missing).union(sizes).union(unreadable)
    complete = per_key.filter("channels = 3")
    if expected_triplets is not None:
        out = out.union(
            complete.agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") != expected_triplets)
            .select(F.lit("triplet count"), F.lit("all"), "n")
        )
    if expected_conditions:
        spark = files.sparkSession
        spec = spark.createDataFrame(
            [(float(i), float(t), int(n)) for (i, t), n in expected_conditions.items()],
            "ifn_dose double, tnf_dose double, expected long",
        )
        counts = (
            parsed.select("image_key", "ifn_dose", "tnf_dose")
            .distinct()
            .groupBy("ifn_dose", "tnf_dose")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        out = out.union(
            F.broadcast(spec)  # one row per configured condition
            .join(counts, ["ifn_dose", "tnf_dose"], "left")
            .withColumn("n", F.coalesce("n", F.lit(0)))
            .filter("n <> expected")
            .select(
                F.lit("condition count"),
                F.concat_ws(",", F.col("ifn_dose").cast("int"), F.col("tnf_dose").cast("int")),
                "n",
            )
        )
    return out


def load_study_cells(
    cells: DataFrame, manifest: DataFrame, features: Sequence[str] | None = None
) -> DataFrame:
    """Complete cells of a cleaned table joined to the manifest, with a numeric target.

    Raises when a needed column is missing; images unknown to the manifest are reported by
    :func:`unknown_images`.
    """
    features = list(morphology_columns() if features is None else features)
    needed = [
        "Cell_ID",
        "Image",
        "cell_status",
        "IDO_BackgroundMean",
        "IDO_MeanIntensity",
        "IDO_MeanIntensity_BgSub",
        *features,
    ]
    missing = sorted(set(needed) - set(cells.columns))
    if missing:
        raise ValueError(f"cell table lacks columns {missing}")
    meta = manifest.select(
        F.col("pc_stem").alias("Image"),
        "image_key",
        "condition",
        F.col("ifn_dose").alias("IFN_dose"),
        F.col("tnf_dose").alias("TNF_dose"),
        "image_index",
    )
    full = cells.select(*needed).filter(F.col("cell_status") == "full_cell").join(meta, "Image")
    out = full.withColumnsRenamed(
        {
            "Image": "pc_stem",
            "IDO_BackgroundMean": "IDO_background_median",
            "IDO_MeanIntensity": "IDO_cytoplasm_mean",
            "IDO_MeanIntensity_BgSub": "IDO_score",
        }
    )
    for c in ("IDO_background_median", "IDO_cytoplasm_mean", "IDO_score", *features):
        out = out.withColumn(c, number(c))
    return out.dropna(subset=["IDO_score"])


def unknown_images(cells: DataFrame, manifest: DataFrame) -> DataFrame:
    return (
        cells.select("Image")
        .distinct()
        .join(manifest.select(F.col("pc_stem").alias("Image")), "Image", "left_anti")
    )


def select_datasets(
    folders: DataFrame, only: Sequence[str] = (), exclude: Sequence[str] = ()
) -> DataFrame:
    """First-level dataset folders with their decision: ``selected`` and ``missing`` names.

    Folder names are compared in lower case without outer blanks.
    """
    only = sorted({n.strip().lower() for n in only if n.strip()})
    exclude = sorted({n.strip().lower() for n in exclude if n.strip()})
    names = folders.select("folder").distinct().withColumn("_key", F.lower("folder"))
    chosen = names
    if only:
        chosen = chosen.filter(F.col("_key").isin(*only))
    if exclude:
        chosen = chosen.filter(~F.col("_key").isin(*exclude))
    out = chosen.select("folder", F.lit("selected").alias("state"))
    if only:
        wanted = folders.sparkSession.createDataFrame([(n,) for n in only], "_key string")
        lost = wanted.join(names, "_key", "left_anti")
        out = out.union(lost.select(F.col("_key"), F.lit("missing")))
    return out


def dedupe(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """First row per key by ``order``, combined before the shuffle; no window over the key."""
    rest = [c for c in df.columns if c not in keys]
    packed = F.min_by(F.struct(*rest), order).alias("_row")
    return df.groupBy(*keys).agg(packed).select(*keys, "_row.*")
