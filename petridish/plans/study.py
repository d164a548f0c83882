"""The dose-response study from cells to result tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petridish.operators import models, splits, summary
from petridish.session import materialize
from petridish.sources.sinks import write_tables


def study_job(
    cells: DataFrame,
    features: Sequence[str],
    manifest: DataFrame | None = None,
    grid: Mapping | None = None,
    min_cells: int = 3,
    path: str | None = None,
) -> dict[str, DataFrame]:
    """All result tables by name; ``path`` also writes them as CSV.

    Raises when a curve lacks a dose or, with a manifest, when an image lacks cells.
    """
    grid = {**models.STUDY_GRID, **(grid or {})}
    images = materialize(summary.image_median_iqr(cells, features, min_cells))
    if manifest is not None:
        lost = summary.images_without_cells(manifest, images)
        if not lost.isEmpty():
            raise ValueError(f"images with fewer than {min_cells} usable cells, e.g. {lost.first()[0]}")
    curves = summary.dose_response(images)
    gap = summary.missing_doses(curves)
    if not gap.isEmpty():
        raise ValueError(f"no image for {gap.first()}")
    auc = summary.dose_auc(curves)
    predictors = [c for c in images.columns if c.endswith(("__median", "__iqr"))]
    repeated = splits.stratified_kfold(images, int(grid["outer_splits"]), list(grid["seeds"]))
    loco = splits.leave_one_condition_out(images).withColumns(
        {"repeat": F.lit(0), "seed": F.lit(int(grid["loco_seed"]))}
    )
    p1, c1 = models.cross_validate(repeated, predictors, "repeated_cv", grid)
    p2, c2 = models.cross_validate(loco, predictors, "leave_one_condition_out", grid)
    predictions, coefficients = p1.unionByName(p2), c1.unionByName(c2)
    metrics = summary.regression_metrics(
        predictions, ["validation", "repeat", "model"], "observed_IDO_score", "predicted_IDO_score"
    )
    metric_summary = summary.summarize_metrics(metrics)
    detail, auc_summary = summary.predicted_auc(predictions, auc)
    tables = {
        "image_level_dataset": images,
        "dose_response_summary": curves,
        "dose_response_auc": auc,
        "oof_predictions": predictions,
        "oof_average": summary.oof_average(predictions.filter("validation = 'repeated_cv'")),
        "cv_metrics": metrics,
        "cv_metrics_summary": metric_summary,
        "fold_coefficients": coefficients,
        "feature_coefficients": summary.summarize_coefficients(coefficients),
        "predicted_dose_response_auc": detail,
        "predicted_dose_response_auc_summary": auc_summary,
        "final_models": models.final_models(images, predictors, grid),
        "verdict": summary.signal_verdict(metric_summary),
    }
    if path:
        write_tables(tables, path)
    return tables
