"""Result tables as partitioned files, one folder per feature group where asked."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from petridish.functions.catalog import GROUP_SHEETS, SINGLE_GROUPS, UNKNOWN, describe
from petridish.functions.text import path_component
from petridish.operators.summary import cell_metrics, feature_mean_median, image_metrics


def write_table(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), fmt: str = "parquet"
) -> None:
    """Write a table; with partition columns only the partitions present are replaced."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.save(path)


def write_tables(tables: Mapping[str, DataFrame], root: str, fmt: str = "csv") -> None:
    for name, df in tables.items():
        write_table(df, f"{root.rstrip('/')}/{name}", fmt=fmt)


def feature_rows(
    cells: DataFrame, ids: Sequence[str], features: Sequence[str] | None = None
) -> DataFrame:
    """Long form: one row per cell and feature with a value or NULL."""
    features = [c for c in cells.columns if c not in ids] if features is None else list(features)
    return cells.select(
        *ids, *[F.col(f"`{c}`").cast("double").alias(c) for c in features]
    ).unpivot(list(ids), features, "feature", "value")


def feature_group_sheets(
    cells: DataFrame,
    profile: str = "engineer",
    ids: Sequence[str] = ("Cell_ID", "Image", "cell_status"),
) -> DataFrame:
    """Feature rows with their sheet group; write with ``partition_by=["feature_group"]``."""
    if profile not in UNKNOWN:
        raise ValueError(f"unknown profile {profile!r}")
    rows = feature_rows(cells, ids)
    return describe(rows).select(*rows.columns, F.col(profile).alias("feature_group"))


def prediction_sheets(
    cells: DataFrame,
    ids: Sequence[str],
    groups: Mapping[str, Sequence[str]],
) -> DataFrame:
    """Feature rows of the nine single groups, with folder and sheet names for partitioning.

    A feature that belongs to two groups appears in both sheets.
    """
    spark = cells.sparkSession
    member = [
        (feature, GROUP_SHEETS[g])
        for g in SINGLE_GROUPS
        for feature in groups.get(g, ())
        if feature in cells.columns
    ]
    wanted = list(dict.fromkeys(f for f, _ in member))
    lookup = spark.createDataFrame(member, "feature string, feature_group string")
    return (
        feature_rows(cells, ids, wanted)
        .join(F.broadcast(lookup), "feature")  # one row per known feature name
        .withColumn("folder", path_component("source_folder"))
    )


def image_prediction_sheets(
    cells: DataFrame, images: DataFrame, groups: Mapping[str, Sequence[str]]
) -> DataFrame:
    """Mean and median of every feature of the nine single groups, per image, in long form.

    Images without a value keep a row with NULL.
    """
    spark = cells.sparkSession
    member = [
        (f"{feature}_{stat}", GROUP_SHEETS[g])
        for g in SINGLE_GROUPS
        for feature in groups.get(g, ())
        if feature in cells.columns
        for stat in ("mean", "median")
    ]
    features = list(dict.fromkeys(f for g in SINGLE_GROUPS for f in groups.get(g, ()) if f in cells.columns))
    names = [f"{f}_{stat}" for f in features for stat in ("mean", "median")]
    ids = images.select("source_folder", "image_name", "image_key").dropDuplicates(["image_key"])
    wide = ids.join(feature_mean_median(cells, features), "image_key", "left").drop("image_key")
    lookup = spark.createDataFrame(member, "feature string, feature_group string")
    return (
        feature_rows(wide, ["source_folder", "image_name"], names)
        .join(F.broadcast(lookup), "feature")  # two rows per known feature name and group
        .withColumn("folder", path_component("source_folder"))
    )


def prediction_summary(cells: DataFrame, images: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Metrics of every source folder, cell and image level, as rows ``level, metric, value``.

    Cells without a label table give the mean probability and the share of positive predictions.
    """
    by = ["source_folder"]
    if "ki67_label" in cells.columns:
        own = cell_metrics(cells.withColumn("split", F.lit("all")), threshold, by)
        own = own.filter("split = 'overall'").drop("split")
    else:
        p = F.expr("try_cast(cell_prob AS DOUBLE)")
        own = cells.groupBy(*by).agg(
            F.count(p).alias("cell_num"),
            F.avg(p).alias("mean_cell_prob"),
            F.avg((p >= threshold).cast("double")).alias("predicted_positive_ratio"),
            F.lit(float(threshold)).alias("threshold"),
        )
    if "true_ratio" not in images.columns:
        images = images.withColumn("true_ratio", F.lit(None).cast("double"))
    whole = image_metrics(images.withColumn("split", F.lit("all")), by)
    whole = whole.filter("split = 'overall'").drop("split")

    def long(df: DataFrame, level: str) -> DataFrame:
        names = [c for c in df.columns if c not in by]
        rows = df.select(*by, *[F.col(c).cast("double").alias(c) for c in names])
        return rows.unpivot(by, names, "metric", "value").withColumn("level", F.lit(level))

    return (
        long(own, "cell")
        .unionByName(long(whole, "image"))
        .withColumn("folder", path_component("source_folder"))
    )


def write_prediction_sheets(
    cells: DataFrame,
    images: DataFrame,
    groups: Mapping[str, Sequence[str]],
    path: str,
    threshold: float = 0.5,
) -> None:
    """The sheets of every source folder: features and predictions of cells and images, metrics.

    Feature tables are partitioned by folder and sheet, the others by folder.
    """
    root = path.rstrip("/")
    write_table(prediction_sheets(cells, ["source_folder", "Image", "Cell_ID"], groups), f"{root}/cell_features", ["folder", "feature_group"])
    write_table(image_prediction_sheets(cells, images, groups), f"{root}/image_features", ["folder", "feature_group"])
    write_table(prediction_summary(cells, images, threshold), f"{root}/metrics", ["folder"])
    known = {f for columns in groups.values() for f in columns}
    for name, df in (("cells", cells), ("images", images)):
        kept = df.select(*[f"`{c}`" for c in df.columns if c not in known])
        write_table(kept.withColumn("folder", path_component("source_folder")), f"{root}/{name}", ["folder"])


def save_json(spark: SparkSession, value: Mapping, path: str) -> None:
    """A small document as one text file."""
    text = json.dumps(value, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])
