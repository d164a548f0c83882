"""Roll-ups from cells to images, folders and dose curves, and prediction metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from petridish.functions.numeric import log_base, number, weighted_mean
from petridish.operators.scale import average_ranks, summarise, with_group_stats

# The three dose curves (filter, dose axis, expected doses).
CURVES = {
    "IFN_response_AUC": ("TNF_dose", 0.0, "IFN_dose", (0.0, 25.0, 50.0, 100.0)),
    "TNF_response_AUC_IFN0": ("IFN_dose", 0.0, "TNF_dose", (0.0, 25.0, 50.0)),
    "TNF_response_AUC_IFN25": ("IFN_dose", 25.0, "TNF_dose", (0.0, 25.0, 50.0)),
}


# --- cells to images to folders ---------------------------------------------------------


def cell_to_image(
    cells: DataFrame,
    scores: Sequence[str] = (),
    probability: str = "cell_prob",
    by: Sequence[str] = (),
) -> DataFrame:
    """Probability summary per image (and ``by``), with true ratio and score means where present."""
    def above(t):
        return F.avg(F.coalesce(F.col(probability) > t, F.lit(False)).cast("double"))

    aggs = {
        "source_folder": F.min("source_folder"),
        "image_name": F.min("Image"),
        "passage": F.min("passage"),
        "cell_count": F.count(F.lit(1)),
        "mean_cell_prob": F.avg(probability),
        "frac_prob_gt_0_3": above(0.30),
        "frac_prob_gt_0_5": above(0.50),
        "frac_prob_gt_0_7": above(0.70),
    }
    percentiles = {
        "median_cell_prob": (probability, 0.5),
        "p90_cell_prob": (probability, 0.9),
    }
    if "ki67_label" in cells.columns:
        aggs["true_ratio"] = F.avg("ki67_label")
    for s in scores:
        if s in cells.columns:
            aggs[f"{s}_mean"] = F.avg(s)
            percentiles[f"{s}_median"] = (s, 0.5)
    return summarise(cells, [*by, "image_key"], aggs, percentiles)


def image_scores(cells: DataFrame, scores: Sequence[str]) -> DataFrame:
    """Mean and median of score columns per image."""
    return summarise(
        cells, ["image_key"], {f"{s}_mean": F.avg(s) for s in scores}, {f"{s}_median": (s, 0.5) for s in scores}
    )


def image_to_folder(images: DataFrame) -> DataFrame:
    """Folder ratios: the plain name is weighted by cell count."""
    has_truth = "true_ratio" in images.columns
    aggs = [
        F.countDistinct("image_key").alias("image_count"),
        F.sum("cell_count").alias("cell_count"),
        weighted_mean("pred_ratio", "cell_count").alias("pred_ratio"),
        F.avg(number("pred_ratio")).alias("pred_ratio_unweighted"),
    ]
    if has_truth:
        aggs += [
            weighted_mean("true_ratio", "cell_count").alias("true_ratio"),
            F.avg(number("true_ratio")).alias("true_ratio_unweighted"),
        ]
    out = images.groupBy("source_folder").agg(*aggs).withColumn(
        "pred_ratio_weighted", F.col("pred_ratio")
    )
    if has_truth:
        out = out.withColumns(
            {
                "true_ratio_weighted": F.col("true_ratio"),
                "abs_error": F.abs(F.col("pred_ratio") - F.col("true_ratio")),
                "abs_error_unweighted": F.abs(
                    F.col("pred_ratio_unweighted") - F.col("true_ratio_unweighted")
                ),
            }
        ).withColumn("abs_error_weighted", F.col("abs_error"))
    return out


def feature_mean_median(
    cells: DataFrame, features: Sequence[str]
) -> DataFrame:
    """Mean and median of every feature per image."""
    numeric = cells.select("image_key", *[number(f"`{f}`").alias(f) for f in features])
    return summarise(
        numeric,
        ["image_key"],
        {f"{f}_mean": F.avg(f) for f in features},
        {f"{f}_median": (f, 0.5) for f in features},
    )


def image_median_iqr(
    cells: DataFrame,
    features: Sequence[str],
    min_cells: int = 3,
    target: str = "IDO_score",
) -> DataFrame:
    """One row per image with enough cells: medians and inter-quartile ranges."""
    percentiles = {}
    for name, base in [(f, f"{f}__") for f in features] + [(target, "_t_")]:
        for tag, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
            percentiles[f"{base}{tag}"] = (name, p)
    keys = ["image_key", "condition", "IFN_dose", "TNF_dose", "image_index"]
    wide = summarise(
        cells.select(*keys, *[number(f"`{c}`").alias(c) for c in (*features, target)]),
        keys,
        {"cell_count": F.count(F.lit(1))},
        percentiles,
    ).filter(F.col("cell_count") >= min_cells)
    return wide.select(
        *keys,
        "cell_count",
        F.col("_t_q50").alias(target),
        (F.col("_t_q75") - F.col("_t_q25")).alias(f"{target}_IQR"),
        *[
            c
            for f in features
            for c in (
                F.col(f"`{f}__q50`").alias(f"{f}__median"),
                (F.col(f"`{f}__q75`") - F.col(f"`{f}__q25`")).alias(f"{f}__iqr"),
            )
        ],
    )


def images_without_cells(manifest: DataFrame, images: DataFrame) -> DataFrame:
    """Images of the manifest that did not reach the minimum number of cells."""
    return manifest.select("image_key").distinct().join(
        images.select("image_key"), "image_key", "left_anti"
    )


def area_histogram(
    cells: DataFrame,
    threshold: float = 6.0,
    width_um: float = 1.5896,
    height_um: float = 1.5876,
    bin_width: float = 0.2,
    area: str = "Area_cyto",
) -> DataFrame:
    """Percent of cells per 0.2-wide bin of log3(area in µm²), and the share above 6."""
    scale = width_um * height_um
    logs = cells.select(log_base(F.col(area) * scale, 3.0).alias("_l")).filter("_l is not null")
    # bin edges hang on the smallest value, so it is attached as one row
    df = with_group_stats(
        logs, [], _lo=F.min("_l"), _n=F.count(F.lit(1)), _above=F.count_if(F.col("_l") > threshold)
    )
    bin_ = F.floor(F.round((F.col("_l") - F.col("_lo")) / bin_width, 9))
    return df.groupBy(bin_.alias("bin"), "_lo", "_n", "_above").agg(
        F.count(F.lit(1)).alias("cells")
    ).select(
        "bin",
        (F.col("_lo") + F.col("bin") * bin_width).alias("left_edge"),
        "cells",
        (F.col("cells") / F.col("_n") * 100.0).alias("percent"),
        (F.col("_above") / F.col("_n") * 100.0).alias("percent_above"),
    )


# --- prediction metrics -----------------------------------------------------------------


def _by_split(df: DataFrame, by: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Aggregates per split and, as ``overall``, over all splits, each for every ``by``."""
    sets = df.groupingSets([[*by, "split"], list(by)], *by, "split") if by else df.rollup("split")
    out = sets.agg(*aggs, F.grouping("split").alias("_all"))
    return out.withColumn("split", F.when(F.col("_all") == 1, "overall").otherwise(F.col("split"))).drop("_all")


def cell_metrics(cells: DataFrame, threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, confusion counts and probability error, per split and ``overall``."""
    p, y = number("cell_prob"), number("ki67_label")
    rows = cells.select(*by, "split", p.alias("p"), y.cast("int").alias("y")).filter(
        "p is not null and y is not null"
    )
    pred = (F.col("p") >= threshold).cast("int")
    return _by_split(rows, by, [
        F.count(F.lit(1)).alias("cell_num"),
        F.avg("y").alias("positive_ratio"),
        F.avg((pred == F.col("y")).cast("double")).alias("accuracy"),
        F.avg(F.abs(F.col("p") - F.col("y"))).alias("probability_mae"),
        F.count_if((pred == 0) & (F.col("y") == 0)).alias("tn"),
        F.count_if((pred == 1) & (F.col("y") == 0)).alias("fp"),
        F.count_if((pred == 0) & (F.col("y") == 1)).alias("fn"),
        F.count_if((pred == 1) & (F.col("y") == 1)).alias("tp"),
    ])


def image_metrics(images: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Ratio errors, plain and weighted by cell count, per split and ``overall``."""
    df = images.select(
        *by,
        "split",
        "image_key",
        number("pred_ratio").alias("p"),
        number("true_ratio").alias("t"),
        number("cell_count").alias("w"),
    )
    both = F.col("p").isNotNull() & F.col("t").isNotNull()
    e = F.when(both, F.col("p") - F.col("t"))

    def valid(c):
        return F.when(both, F.col(c))

    out = _by_split(df, by, [
        F.countDistinct("image_key").alias("image_num"),
        F.sum(F.coalesce("w", F.lit(0.0))).cast("bigint").alias("cell_num"),
        F.avg("p").alias("pred_ratio"),
        weighted_mean("p", "w").alias("pred_ratio_weighted"),
        F.avg(valid("t")).alias("true_ratio"),
        weighted_mean(valid("t"), "w").alias("true_ratio_weighted"),
        F.avg(F.abs(e)).alias("image_mae"),
        F.avg(e).alias("image_bias"),
        F.sqrt(F.avg(e * e)).alias("image_rmse"),
        F.avg((F.abs(e) <= 0.10).cast("double")).alias("within_10pp"),
        F.abs(F.avg(valid("p")) - F.avg(valid("t"))).alias("abs_error"),
        F.abs(weighted_mean(valid("p"), "w") - weighted_mean(valid("t"), "w")).alias(
            "abs_error_weighted"
        ),
    ])
    return (
        out.withColumn("ratio_accuracy", 1.0 - F.col("abs_error"))
        .withColumn("ratio_accuracy_weighted", 1.0 - F.col("abs_error_weighted"))
    )


def split_summary(cells: DataFrame) -> DataFrame:
    """Folders, images, cells and positive ratio per split; names are in :func:`split_folders`."""
    return cells.groupBy("split").agg(
        F.countDistinct("source_folder").alias("source_folders"),
        F.countDistinct("image_key").alias("images"),
        F.count(F.lit(1)).alias("cells"),
        F.avg("ki67_label").alias("positive_ratio"),
    )


def split_folders(cells: DataFrame) -> DataFrame:
    return cells.select("split", "source_folder").distinct()


def status_crosstab(cells: DataFrame, images: DataFrame, statuses: Sequence[str]) -> DataFrame:
    """Cells per status and image, zero filled, for every listed image."""
    counts = cells.groupBy("image_key").agg(
        *[F.count_if(F.col("cell_status") == s).alias(f"status_{s}") for s in statuses],
        F.count_if((F.col("cell_status") == "full_cell") & F.col("IDO_score").isNotNull()).alias(
            "kept_full_cells"
        ),
    )
    return images.select("image_key").distinct().join(counts, "image_key", "left").na.fill(0)


def roc_auc(df: DataFrame, keys: Sequence[str], label: str, score: str) -> DataFrame:
    """Area under the ROC curve from average ranks; NULL with one class only."""
    counts = df.filter(F.col(score).isNotNull()).groupBy(*keys, score).agg(
        F.sum(F.col(label).cast("bigint")).alias("_pos")
    )
    ranks = average_ranks(df.select(*keys, score), keys, score, "_rank")
    joined = ranks.join(counts, [*keys, score])
    out = joined.groupBy(*keys).agg(
        F.sum("_pos").alias("_p"),
        F.sum("_c").alias("_n"),
        F.sum(F.col("_rank") * F.col("_pos")).alias("_r"),
    )
    p, n = F.col("_p").cast("double"), (F.col("_n") - F.col("_p")).cast("double")
    return out.select(
        *keys,
        F.when((p > 0) & (n > 0), (F.col("_r") - p * (p + 1) / 2.0) / (p * n)).alias("roc_auc"),
    )


def feature_group_relation(
    cells: DataFrame, groups: Mapping[str, str], threshold: float = 0.5
) -> DataFrame:
    """Per feature group and split: accuracy, AUC and image error of its evidence score.

    ``groups`` maps group names to score columns.
    """
    ids = ["split", "image_key", "ki67_label"]
    columns = list(groups.values())
    long = cells.select(*ids, *columns).unpivot(ids, columns, "score_column", "score")
    keys = ["score_column", "split"]
    accuracy = long.groupBy(*keys).agg(
        F.avg(((F.col("score") >= threshold).cast("int") == F.col("ki67_label")).cast("double")).alias(
            "cell_accuracy"
        )
    )
    per_image = long.groupBy(*keys, "image_key").agg(
        F.avg("ki67_label").alias("_t"), F.avg("score").alias("_p")
    )
    mae = per_image.groupBy(*keys).agg(F.avg(F.abs(F.col("_t") - F.col("_p"))).alias("image_mae"))
    auc = roc_auc(long, keys, "ki67_label", "score").withColumnRenamed("roc_auc", "cell_roc_auc")
    spark = cells.sparkSession
    names = spark.createDataFrame(
        [(c, g) for g, c in groups.items()], "score_column string, feature_group string"
    )
    return (
        accuracy.join(mae, keys)
        .join(auc, keys)
        .join(F.broadcast(names), "score_column")  # one row per feature group
        .drop("score_column")
    )


def confusion_by_model(predictions: DataFrame, metrics: DataFrame, best: int = 12) -> DataFrame:
    """2×2 counts of the ``best`` models by test image error (ties by name)."""
    top = metrics.orderBy("test_image_mae", "model").limit(best).select("model")
    return predictions.join(top, "model", "left_semi").groupBy("model").agg(
        *[
            F.count_if((F.col("ki67_label") == y) & (F.col("cell_pred") == p)).alias(n)
            for n, y, p in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))
        ]
    )


def embedding_ablation(summary: DataFrame, best: int = 16) -> DataFrame:
    """Error with and without embeddings per combination; complete ones only, best first."""
    wide = summary.groupBy("feature_combo").agg(
        F.avg(F.when(~F.col("with_image_embedding"), F.col("test_image_mae"))).alias("mae_without"),
        F.avg(F.when(F.col("with_image_embedding"), F.col("test_image_mae"))).alias("mae_with"),
    )
    return (
        wide.dropna()
        .orderBy("mae_without", "feature_combo")
        .limit(best)
        .withColumn("correct_without", (1.0 - F.col("mae_without")) * 100.0)
        .withColumn("correct_with", (1.0 - F.col("mae_with")) * 100.0)
    )


def top_k(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """The first ``k`` rows of a report; Spark keeps ``k`` rows per task, not a full sort."""
    return df.orderBy(*order).limit(k)


def union_levels(cells: DataFrame, images: DataFrame, folders: DataFrame) -> DataFrame:
    """All prediction levels in one table with ``level``."""
    out = None
    for name, df in (("cell", cells), ("image", images), ("folder", folders)):
        part = df.withColumn("level", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


# --- dose response ----------------------------------------------------------------------


def _curve_rows(images: DataFrame, value: str) -> DataFrame:
    """Rows of every curve they belong to, with the curve's dose."""
    memberships = F.array(
        *[
            F.when(
                F.col(fixed) == level, F.struct(F.lit(name).alias("curve"), F.col(axis).alias("dose"))
            )
            for name, (fixed, level, axis, _) in CURVES.items()
        ]
    )
    others = [c for c in images.columns if c not in ("curve", "dose")]
    rows = images.select(*others, F.explode(memberships).alias("_m")).filter("_m is not null")
    rows = rows.select(*others, F.col("_m.curve").alias("curve"), F.col("_m.dose").alias("dose"))
    expected = None
    for name, (_, _, _, doses) in CURVES.items():
        hit = (F.col("curve") == name) & F.col("dose").isin(*doses)
        expected = hit if expected is None else expected | hit
    return rows.filter(expected)


def dose_response(
    images: DataFrame, by: Sequence[str] = (), value: str = "IDO_score"
) -> DataFrame:
    """Per curve and dose: image count, mean, median, deviation, standard error."""
    keys = [*by, "curve", "dose"]
    out = summarise(
        _curve_rows(images, value),
        keys,
        {
            "n_images": F.count(F.lit(1)),
            "IDO_score_mean": F.avg(value),
            "IDO_score_std": F.when(F.count(value) > 1, F.stddev_samp(value)),
        },
        {"IDO_score_median": (value, 0.5)},
    )
    return out.withColumn("IDO_score_sem", F.col("IDO_score_std") / F.sqrt("n_images"))


def missing_doses(summary: DataFrame) -> DataFrame:
    """Expected doses without an image, per curve."""
    spark = summary.sparkSession
    spec = spark.createDataFrame(
        [(n, float(d)) for n, (_, _, _, doses) in CURVES.items() for d in doses],
        "curve string, dose double",
    )
    return spec.join(summary.select("curve", "dose"), ["curve", "dose"], "left_anti")


def dose_auc(summary: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Trapezoid area under each curve's medians; a curve has at most four doses."""
    w = Window.partitionBy(*by, "curve").orderBy("dose")
    steps = summary.select(
        *by,
        "curve",
        "dose",
        (
            (F.col("dose") - F.lag("dose").over(w))
            * (F.col("IDO_score_median") + F.lag("IDO_score_median").over(w))
            / 2.0
        ).alias("_a"),
    )
    out = steps.groupBy(*by, "curve").agg(
        F.min("dose").alias("dose_min"), F.max("dose").alias("dose_max"), F.sum("_a").alias("auc_raw")
    )
    return out.withColumn(
        "auc_normalized_by_dose_range", F.col("auc_raw") / (F.col("dose_max") - F.col("dose_min"))
    )


def predicted_auc(
    predictions: DataFrame, observed: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """AUC of out-of-fold predictions against the observed ones, and its spread over repeats."""
    by = ["validation", "repeat", "model"]
    auc = dose_auc(
        dose_response(
            predictions.select(
                *by, "IFN_dose", "TNF_dose", F.col("predicted_IDO_score").alias("IDO_score")
            ),
            by,
        ),
        by,
    )
    seen = observed.select(
        "curve",
        F.col("auc_raw").alias("observed_auc_raw"),
        F.col("auc_normalized_by_dose_range").alias("observed_auc_normalized"),
    )
    detail = auc.join(seen, "curve").select(
        *by,
        "curve",
        "observed_auc_raw",
        F.col("auc_raw").alias("predicted_auc_raw"),
        (F.col("auc_raw") - F.col("observed_auc_raw")).alias("auc_error_raw"),
        F.abs(F.col("auc_raw") - F.col("observed_auc_raw")).alias("absolute_auc_error_raw"),
        "observed_auc_normalized",
        F.col("auc_normalized_by_dose_range").alias("predicted_auc_normalized"),
        (F.col("auc_normalized_by_dose_range") - F.col("observed_auc_normalized")).alias(
            "auc_error_normalized"
        ),
        F.abs(F.col("auc_normalized_by_dose_range") - F.col("observed_auc_normalized")).alias(
            "absolute_auc_error_normalized"
        ),
    )
    return detail, median_iqr(
        detail,
        ["validation", "model", "curve", "observed_auc_raw", "observed_auc_normalized"],
        [
            "predicted_auc_raw",
            "absolute_auc_error_raw",
            "predicted_auc_normalized",
            "absolute_auc_error_normalized",
        ],
        {"repeats": F.count(F.lit(1))},
    )


def median_iqr(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], aggs: Mapping[str, Column] | None = None
) -> DataFrame:
    percentiles = {
        f"{c}_{tag}": (c, p) for c in columns for tag, p in (("q25", 0.25), ("median", 0.5), ("q75", 0.75))
    }
    aggs = dict(aggs or {})
    out = summarise(df, keys, aggs, percentiles)
    return out.select(
        *keys,
        *aggs,
        *[
            x
            for c in columns
            for x in (
                F.col(f"{c}_median"),
                (F.col(f"{c}_q75") - F.col(f"{c}_q25")).alias(f"{c}_iqr"),
            )
        ],
    )


def regression_metrics(
    df: DataFrame, keys: Sequence[str], observed: str = "observed", predicted: str = "predicted"
) -> DataFrame:
    """MAE, RMSE, R² and Spearman; the last is NULL for a constant side."""
    keys = list(keys)
    rows = df.select(*keys, F.col(observed).alias("o"), F.col(predicted).alias("p"))
    e = F.col("p") - F.col("o")
    base = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_images"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (1.0 - F.try_divide(F.sum(e * e), F.var_pop("o") * F.count(F.lit(1)))).alias("r2"),
    )
    ro = average_ranks(rows, keys, "o", "_ro").select(*keys, "o", "_ro")
    rp = average_ranks(rows, keys, "p", "_rp").select(*keys, "p", "_rp")
    ranked = rows.join(ro, [*keys, "o"]).join(rp, [*keys, "p"])
    rho = ranked.groupBy(*keys).agg(
        F.try_divide(
            F.covar_pop("_ro", "_rp"), F.stddev_pop("_ro") * F.stddev_pop("_rp")
        ).alias("spearman")
    )
    return base.join(rho, keys)


def summarize_metrics(metrics: DataFrame) -> DataFrame:
    return median_iqr(
        metrics,
        ["validation", "model"],
        ["mae", "rmse", "r2", "spearman"],
        {"repeats": F.count(F.lit(1)), "n_images": F.max("n_images")},
    )


def summarize_coefficients(coefficients: DataFrame) -> DataFrame:
    c = "coefficient_standardized"
    out = median_iqr(coefficients, ["validation", "model", "feature"], [c], {"coefficient_mean": F.avg(c)})
    return out.select(
        "validation",
        "model",
        "feature",
        F.col(f"{c}_median").alias("coefficient_median"),
        "coefficient_mean",
        F.col(f"{c}_iqr").alias("coefficient_iqr"),
        F.abs(f"{c}_median").alias("absolute_median"),
    )


def oof_average(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("model", "image_key").agg(
        F.min("observed_IDO_score").alias("observed_IDO_score"),
        F.avg("predicted_IDO_score").alias("predicted_IDO_score"),
    )


def signal_verdict(summary: DataFrame) -> DataFrame:
    """Does morphology beat the median model on error with a positive rank correlation?"""
    repeated = summary.filter("validation = 'repeated_cv'")

    def of(model, c):
        return F.max(F.when(F.col("model") == model, F.col(c)))

    return repeated.agg(
        of("morphology_ridge", "mae_median").alias("morphology_mae"),
        of("dummy_median", "mae_median").alias("dummy_mae"),
        of("morphology_ridge", "spearman_median").alias("morphology_spearman"),
    ).withColumn(
        "verdict",
        F.when(F.col("morphology_mae").isNull() | F.col("dummy_mae").isNull(), "undecided")
        .when(
            (F.col("morphology_mae") < F.col("dummy_mae")) & (F.col("morphology_spearman") > 0), "signal"
        )
        .otherwise("no stable signal"),
    )
