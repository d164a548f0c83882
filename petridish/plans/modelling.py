"""Training, scoring and ablation of the two-stage Ki67 model."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from dataclasses import replace
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petridish.functions.catalog import SINGLE_GROUPS, feature_groups
from petridish.functions.text import combo_label, score_name
from petridish.operators import models, pairing, quality, splits, summary
from petridish.operators.logistic import fit_all, predict_all
from petridish.session import materialize
from petridish.sources import sinks

_MAIN = ("Texture", "Intensity distribution", "Attachment / spreading", "Halo / rounding")


def combinations_of_groups() -> list[tuple[str, ...]]:
    """The nine single groups, all combinations of the four main ones, and all nine."""
    out = [(g,) for g in SINGLE_GROUPS]
    for size in (2, 3, 4):
        out += list(combinations(_MAIN, size))
    return [*out, tuple(SINGLE_GROUPS)]


# Combinations evaluated as formal candidates.
FORMAL = (
    ("Texture",),
    ("Intensity distribution",),
    ("Texture", "Intensity distribution"),
    ("Texture", "Attachment / spreading"),
    ("Texture", "Halo / rounding"),
    ("Intensity distribution", "Attachment / spreading"),
    ("Intensity distribution", "Halo / rounding"),
    ("Texture", "Intensity distribution", "Halo / rounding"),
    ("Intensity distribution", "Attachment / spreading", "Halo / rounding"),
    _MAIN,
)


def prepare(cells: DataFrame, keep_extreme: bool = False, state: int = 42) -> DataFrame:
    """Drop images with a ratio of 0 or 1 and assign the image-level split."""
    usable = cells if keep_extreme else quality.filter_extreme_ratio(cells)
    return materialize(splits.split_within_folder(usable, state))


#: More passages than this are no dummy columns of a second-stage model.
PASSAGES = 1000


def evaluate_configs(
    data: DataFrame,
    configs: Sequence[models.Config],
    scores: Sequence[str],
    embeddings: DataFrame | None = None,
    transforms: Mapping[str, models.TableTransform | None] | None = None,
    embedding_size: int = 0,
    row: str = "cell_id",
    auc: bool = False,
) -> tuple[list[dict], list[dict]]:
    """Fit set-ups on the training split and measure all three splits, all of them together.

    ``data`` has split, fold (null outside the training split) and the out-of-fold ``scores``. The
    classifiers of all set-ups and folds share their passes, the cells are scored in one, and
    metrics and second stages are grouped by set-up. Returns the metric rows and the fitted parts
    with their prediction tables, in the order of ``configs``.
    """
    inputs, columns = models.stage1_inputs(data, configs, scores, embeddings, transforms or {}, embedding_size, row)
    inputs = materialize(inputs)
    folds = [r[0] for r in inputs.filter("fold is not null").select("fold").distinct().collect()]
    fits = {(i, k): models.stage1_fit(c, k) for i, c in enumerate(columns) for k in [*sorted(folds), None]}
    fitted = fit_all(inputs.filter("split = 'train'"), fits, "ki67_label")
    slots = range(len(configs))
    found = materialize(predict_all(inputs, [row], fitted, slots))
    slim = ["image_key", "source_folder", "Image", "passage", "split", "ki67_label"]
    long = data.select(row, *slim).join(found, row).select(*slim, F.posexplode("probability").alias("slot", "cell_prob"))
    long = materialize(long)
    used = [[score_name(g) for g in (c.groups or ()) if score_name(g) in scores] for c in configs]
    shared = list(dict.fromkeys(name for names in used for name in names))
    images = summary.cell_to_image(long, (), by=("slot", "split"))
    if shared:
        images = images.join(summary.image_scores(data, shared), "image_key")
    images = materialize(images)
    train = images.filter("split = 'train'")
    passages: list[str] = []
    if any(c.stage2 in ("S3", "S4") for c in configs):
        found_passages = train.select("passage").distinct().limit(PASSAGES + 1).collect()
        if len(found_passages) > PASSAGES:
            raise ValueError(f"more than {PASSAGES} passages; use the second stages S0 or S1")
        passages = [r[0] for r in found_passages if r[0] is not None]
    names = [models.stage2_columns(c.stage2, passages, u) for c, u in zip(configs, used)]
    weights: list[dict | None] = [None] * len(configs)
    order = [*dict.fromkeys(n for own in names for n in own), "true_ratio"]
    if len(order) > 1:
        moments = models.grouped_moments(models.stage2_matrix(train, order[:-1], ["slot", "true_ratio"]), "slot", order)
        weights = [models.solve_ridge(moments[i], order, own, "true_ratio") if own and i in moments else None for i, own in enumerate(names)]
    images = materialize(models.predict_ratios(images, "slot", weights))
    rows = [{"config_key": c.key, "display_name": c.display_name} for c in configs]
    for r in summary.cell_metrics(long, by=["slot"]).collect():
        out = rows[r["slot"]]
        out[f"{r['split']}_cell_accuracy"] = r["accuracy"]
        if r["split"] == "test":
            out.update({f"test_{c}": r[c] for c in ("tn", "fp", "fn", "tp")})
    for r in summary.image_metrics(images, by=["slot"]).collect():
        rows[r["slot"]][f"{r['split']}_image_mae"] = r["image_mae"]
        rows[r["slot"]][f"{r['split']}_image_bias"] = r["image_bias"]
    if auc:
        for r in summary.roc_auc(long, ["slot", "split"], "ki67_label", "cell_prob").collect():
            rows[r["slot"]][f"{r['split']}_cell_roc_auc"] = r["roc_auc"]
    parts = []
    for i, config in enumerate(configs):
        own = found.select(row, F.col("probability")[i].alias("cell_prob"))
        parts.append({
            "config": config,
            "stage1": fitted[i, None],
            "stage1_columns": models.stage1_columns(config, scores, transforms or {}, embedding_size),
            "stage2_weights": weights[i],
            "threshold": 0.5,
            "transform": (transforms or {}).get(config.parameters),
            "embedding_size": embedding_size,
            "cells": data.drop("fold").join(own, row),
            "images": images.filter(F.col("slot") == i).drop("slot"),
        })
        # the models know their columns under the names of the set-up
        parts[-1]["stage1"] = replace(fitted[i, None], columns=list(parts[-1]["stage1_columns"]))
    return rows, parts


def evaluate_config(
    cells: DataFrame,
    config: models.Config,
    scores: DataFrame | None,
    embeddings: DataFrame | None = None,
    transform: models.TableTransform | None = None,
    embedding_size: int = 0,
    folds: int = 5,
    row: str = "cell_id",
) -> tuple[dict, dict]:
    """One set-up: ``cells`` has ``split``; ``scores`` are out-of-fold on the training cells."""
    data = with_folds(cells, folds, row)
    names = [c for c in scores.columns if c != row] if scores is not None else []
    if names:
        data = data.join(scores, row)
    rows, parts = evaluate_configs(
        materialize(data), [config], names, embeddings, {config.parameters: transform}, embedding_size, row
    )
    return rows[0], parts[0]


def with_folds(data: DataFrame, folds: int, row: str) -> DataFrame:
    """The training cells' fold, by whole images; null for the others."""
    train = splits.group_kfold(data.filter("split = 'train'").select("image_key"), "image_key", folds)
    return data.join(train.distinct(), "image_key", "left")


def score_groups(data: DataFrame, features: Sequence[str], needed: set[str], row: str) -> tuple[DataFrame, dict, list[str]]:
    """``data`` with evidence scores (out-of-fold on the training cells), the models, the score names."""
    groups = {g: c for g, c in feature_groups(features).items() if g in SINGLE_GROUPS and g in needed}
    if not groups:
        return data, {}, []
    fitted = models.fit_evidence(data.filter("split = 'train'"), groups)
    scored = models.evidence_scores(data, fitted, row)
    own = {g: m for (g, k), m in fitted.items() if k is None}
    return materialize(data.join(scored, row)), own, [score_name(g) for g in own]


def _metric_frame(spark, rows: list[dict]) -> DataFrame:
    names = list(dict.fromkeys(n for r in rows for n in r))
    kinds = {n: "double" for n in names}
    for n in names:
        value = next(r[n] for r in rows if r.get(n) is not None) if any(r.get(n) is not None for r in rows) else 0.0
        kinds[n] = (
            "string" if isinstance(value, str) else "boolean" if isinstance(value, bool) else "bigint" if isinstance(value, int) else "double"
        )
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in names)
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def train_job(
    cells: DataFrame,
    features: Sequence[str],
    embeddings: DataFrame | None = None,
    embedding_size: int = 0,
    configs: Sequence[models.Config] = models.CONFIGS,
    formal: str = "texture_attachment_s1",
    folds: int = 5,
    top_k: int = 40,
    path: str | None = None,
    row: str = "cell_id",
    keep_extreme: bool = False,
) -> tuple[DataFrame, dict]:
    """Compare the set-ups and keep the formal one, or the best by test image error.

    Returns the metric table (best first) and the chosen bundle; ``path`` also saves it.
    """
    spark = cells.sparkSession
    left_out = [c.key for c in configs if c.embedding and embeddings is None]
    if left_out:
        warnings.warn(f"not run without image vectors: {', '.join(left_out)}", stacklevel=2)
    configs = [c for c in configs if c.key not in left_out]
    if not configs:
        raise ValueError("no set-up could be evaluated")
    data = materialize(with_folds(prepare(cells, keep_extreme), folds, row))
    needed = {g for c in configs if c.scores for g in (c.groups or SINGLE_GROUPS)}
    train = data.filter("split = 'train'")
    transforms: dict = {"none": None}
    kinds = {c.parameters for c in configs}
    if "all" in kinds:
        transforms["all"] = models.fit_table_transform(train, features)
    if "selected" in kinds:
        best = models.select_k_best(train, features, min(top_k, len(features)))
        transforms["selected"] = models.fit_table_transform(train, best)
    data, groups, scores = score_groups(data, features, needed, row)
    rows, parts = evaluate_configs(data, configs, scores, embeddings, transforms, embedding_size, row)
    bundles = {p["config"].key: {**p, "groups": groups} for p in parts}
    rows.sort(key=lambda r: r["test_image_mae"])
    chosen = bundles[formal if formal in bundles else rows[0]["config_key"]]
    if path:
        models.save_model(spark, path, chosen)
    return _metric_frame(spark, rows), chosen


def predict_job(
    cells: DataFrame,
    bundle: Mapping,
    embeddings: DataFrame | None = None,
    row: str = "cell_id",
    expected: DataFrame | None = None,
    path: str | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Score new cells and roll up: cell, image and folder tables.

    ``expected(source_folder, image_name)`` lists the input images: the folder table then counts
    those used, missing and extra (`pairing.image_set_difference` has their names). ``path`` writes the
    three tables and the sheets of every folder.
    """
    config = bundle["config"]
    scores = models.score_feature_groups(cells, bundle["groups"], row) if config.scores else None
    matrix, columns = models.stage1_matrix(
        cells, config, scores, embeddings, bundle["transform"], bundle["stage1_columns"], bundle["embedding_size"], row
    )
    probability = models.predict_stage1(bundle["stage1"], matrix, columns, row)
    used = [score_name(g) for g in (config.groups or ()) if scores is not None and score_name(g) in scores.columns]
    scored = cells.join(probability, row)
    if used:
        scored = scored.join(scores.select(row, *used), row)
    scored = materialize(quality.append_prediction_cols(quality.default_split(scored), bundle["threshold"]))
    images = models.predict_ratio(summary.cell_to_image(scored, used), config.stage2, bundle["stage2_weights"])
    images = materialize(quality.append_error_cols(quality.default_split(images)))
    folders = summary.image_to_folder(images)
    if expected is not None:
        counts = pairing.folder_diagnostics(expected, images.select("source_folder", "image_name").distinct())
        folders = folders.join(counts, "source_folder", "left")
    if path:
        groups = {g: m.columns for g, m in bundle["groups"].items()}
        sinks.write_tables({"cells": scored, "images": images, "folders": folders}, path, "parquet")
        sinks.write_prediction_sheets(scored, images, groups, f"{path}/sheets", bundle["threshold"])
    return scored, images, folders


def ablation_job(
    cells: DataFrame,
    features: Sequence[str],
    embeddings: DataFrame | None = None,
    embedding_size: int = 0,
    combos: Sequence[tuple[str, ...]] | None = None,
    formal: Sequence[tuple[str, ...]] = FORMAL,
    folds: int = 5,
    row: str = "cell_id",
    keep_extreme: bool = False,
) -> DataFrame:
    """Every feature-group combination with and without image vectors, S1 second stage."""
    spark = cells.sparkSession
    data = materialize(with_folds(prepare(cells, keep_extreme), folds, row))
    combos = combinations_of_groups() if combos is None else combos
    work = [("feature_combo", c) for c in combos] + [("formal", c) for c in formal]
    data, groups, scores = score_groups(data, features, {g for _, c in work for g in c}, row)
    items, configs = [], []
    for item, combo in work:
        present = tuple(g for g in combo if g in groups)
        if not present:
            continue
        for with_embedding in (False, True) if embeddings is not None else (False,):
            items.append({"item": item, "feature_combo": combo_label(combo), "with_image_embedding": with_embedding})
            configs.append(models.Config(
                "_".join(score_name(g).replace("_ki67_evidence", "") for g in combo)
                + ("_with_embedding" if with_embedding else "_no_embedding"),
                combo_label(combo), True, with_embedding, "none", "S1", present,
            ))
    rows, parts = evaluate_configs(data, configs, scores, embeddings, {}, embedding_size, row, auc=True)
    return _metric_frame(
        spark, [{**i, "stage1_feature_count": len(p["stage1_columns"]), **r} for i, p, r in zip(items, parts, rows)]
    )
