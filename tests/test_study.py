"""Dose curves, cross-validation and model contracts on small fixtures."""

import hashlib
import json
import math

import numpy as np
from pyspark.sql import functions as F

from petridish.operators import models, splits, summary

DOSES = [(0, 0, 1), (25, 0, 2), (50, 0, 3), (100, 0, 5), (0, 25, 2), (0, 50, 4), (25, 25, 3), (25, 50, 5)]


def dose_table(spark):
    return spark.createDataFrame([tuple(map(float, d)) for d in DOSES], "IFN_dose double, TNF_dose double, IDO_score double")


def test_dose_auc(spark):
    curves = summary.dose_response(dose_table(spark))
    auc = {r.curve: r.auc_raw for r in summary.dose_auc(curves).collect()}
    assert len(auc) == 3 and auc["IFN_response_AUC"] == 300.0
    assert summary.missing_doses(curves).count() == 0
    assert summary.missing_doses(curves.filter("dose <> 100")).count() == 1


def test_exact_predictions_have_no_auc_error(spark):
    t = dose_table(spark)
    p = t.select(F.lit("repeated_cv").alias("validation"), F.lit(0).alias("repeat"), F.lit("m").alias("model"),
                 "IFN_dose", "TNF_dose", F.col("IDO_score").alias("predicted_IDO_score"))
    detail, total = summary.predicted_auc(p, summary.dose_auc(summary.dose_response(t)))
    assert all(r.absolute_auc_error_raw == 0 for r in detail.collect()) and total.count() == 3


def test_image_median_iqr(spark):
    rows = [(f"i{k}", "c", 0.0, 0.0, k, float(v), float(v * 2 + k)) for k in range(2) for v in range(4)]
    cells = spark.createDataFrame(rows, "image_key string, condition string, IFN_dose double, TNF_dose double, image_index int, IDO_score double, Area_nuc double")
    out = summary.image_median_iqr(cells, ["Area_nuc"])
    assert out.count() == 2
    r = out.orderBy("image_key").first()
    assert r["Area_nuc__median"] == 3.0 and r["Area_nuc__iqr"] == 3.0 and r.cell_count == 4
    assert summary.image_median_iqr(cells, ["Area_nuc"], min_cells=5).count() == 0


def cv_images(spark):
    rng = np.random.default_rng(42)
    rows = []
    for i, (a, b, s) in enumerate(DOSES):
        for k in range(4):
            signal = s + rng.normal(0, 0.1)
            rows.append((f"img{i}_{k}", f"c{i}", float(a), float(b), float(signal), float(signal * 2 + rng.normal(0, 0.1)), None if k == 3 else float(rng.normal())))
    return spark.createDataFrame(rows, "image_key string, condition string, IFN_dose double, TNF_dose double, IDO_score double, Area_nuc__median double, Solidity_cyto__iqr double")


GRID = {"inner_splits": 2, "ridge_alphas": (0.1, 1.0), "elasticnet_alphas": (0.01,), "elasticnet_l1_ratios": (0.5,)}


def test_one_prediction_per_image_and_model(spark):
    images = cv_images(spark)
    outer = splits.stratified_kfold(images, 4, (42,))
    features = ["Area_nuc__median", "Solidity_cyto__iqr"]
    predictions, coefficients = models.cross_validate(outer, features, "repeated_cv", GRID)
    rows = predictions.collect()
    assert len(rows) == 32 * 5 and len({(r.model, r.image_key) for r in rows}) == 32 * 5
    metrics = summary.regression_metrics(predictions, ["validation", "repeat", "model"], "observed_IDO_score", "predicted_IDO_score")
    mae = {r.model: r.mae for r in metrics.collect()}
    assert len(mae) == 5 and mae["morphology_ridge"] < mae["dummy_median"]
    assert {r.feature for r in coefficients.filter("model = 'morphology_ridge'").collect()} == set(features)
    # the ridge of one fold against a direct solution on its training rows
    table = {r.image_key: r for r in outer.collect()}
    one = next(r for r in rows if r.model == "morphology_ridge")
    train = [r for r in table.values() if str(r.fold) != one.fold]
    x = np.array([[r[f] if r[f] is not None else np.nan for f in features] for r in train], dtype=float)
    med = np.nanmedian(x, axis=0)
    x = np.where(np.isnan(x), med, x)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    y = np.array([r.IDO_score for r in train])
    alpha = float(one.best_params.split(":")[1].strip(" }"))
    w = np.linalg.solve(z.T @ z + alpha * np.eye(2), z.T @ (y - y.mean()))
    own = np.array([table[one.image_key][f] if table[one.image_key][f] is not None else np.nan for f in features], dtype=float)
    own = (np.where(np.isnan(own), med, own) - x.mean(axis=0)) / x.std(axis=0)
    assert math.isclose(one.predicted_IDO_score, y.mean() + own @ w, rel_tol=1e-9)


def test_cross_validation_as_plain(spark):
    """Choice of parameters and predictions of every fold against nested loops over arrays."""
    rng = np.random.default_rng(5)
    features = [*models.DOSE, "a__median", "b__iqr"]
    data = []
    for i in range(45):
        ifn, tnf = float(i % 3), float(i % 2)
        a, b = rng.normal(), None if i % 7 == 0 else float(rng.normal() * 3 + 50)
        data.append((f"img{i:02d}", f"c{i % 4}", ifn, tnf, float(a), b, float(2 * a + 0.1 * (b or 40) + ifn + rng.normal())))
    frame = spark.createDataFrame(data, "image_key string, condition string, IFN_dose double, TNF_dose double, a__median double, b__iqr double, IDO_score double")
    outer = splits.stratified_kfold(frame, 3, (42, 7))
    got, coefficients = models.cross_validate(outer, ["a__median", "b__iqr"], "v", GRID)
    rows = {(r.repeat, r.image_key): r for r in outer.collect()}
    table = {r[0]: [r[2], r[3], r[2] * r[3], r[4], np.nan if r[5] is None else r[5]] for r in data}
    target, condition = {r[0]: r[6] for r in data}, {r[0]: r[1] for r in data}
    pick = {"dose_ridge": [0, 1, 2], "morphology_ridge": [3, 4], "morphology_elasticnet": [3, 4], "dose_plus_morphology_ridge": [0, 1, 2, 3, 4]}
    grids = {m: models._grid(m, {**models.STUDY_GRID, **GRID}) for m in pick}

    def fit(keys, columns, params):
        x = np.array([table[k] for k in keys])[:, columns]
        median = np.nanmedian(x, axis=0)
        x = np.where(np.isnan(x), median, x)
        mean, std = x.mean(axis=0), x.std(axis=0)
        std[std < 1e-12] = 1.0
        z, y = (x - mean) / std, np.array([target[k] for k in keys])
        w = models.solve_linear(z.T @ z, z.T @ (y - y.mean()), len(y), params)

        def predict(k):
            v = np.array(table[k])[columns]
            return float((np.where(np.isnan(v), median, v) - mean) / std @ w + y.mean())

        return predict

    seen = 0
    found = {(r.repeat, r.model, r.image_key): r for r in got.collect()}
    for repeat, seed in ((0, 42), (1, 7)):
        for fold in (1, 2, 3):
            train = [k for k in table if rows[repeat, k].fold != fold]
            groups = {}
            for k in sorted(train, key=lambda k: (hashlib.md5(f"{k}#{seed}/{fold}".encode()).hexdigest(), k)):
                groups.setdefault(condition[k], []).append(k)
            g = min(GRID["inner_splits"], min(map(len, groups.values())))
            inner = {k: i % g for own in groups.values() for i, k in enumerate(own)}
            for m, columns in pick.items():
                errors = []
                for params in grids[m]:
                    per = []
                    for j in range(g):
                        predict = fit([k for k in train if inner[k] != j], columns, params)
                        per.append(np.mean([abs(predict(k) - target[k]) for k in train if inner[k] == j]))
                    errors.append(np.mean(per))
                best = grids[m][int(np.argmin(errors))]
                predict = fit(train, columns, best)
                for k in table:
                    if rows[repeat, k].fold == fold:
                        r = found[repeat, m, k]
                        assert json.loads(r.best_params) == best
                        assert math.isclose(r.predicted_IDO_score, predict(k), rel_tol=1e-9, abs_tol=1e-9)
                        seen += 1
            middle = np.median([target[k] for k in train])
            assert all(math.isclose(found[repeat, "dummy_median", k].predicted_IDO_score, middle) for k in table if rows[repeat, k].fold == fold)
    assert seen == 2 * 45 * 4 and len(found) == 2 * 45 * 5


def test_leave_one_condition_out_and_final(spark):
    images = cv_images(spark)
    loco = splits.leave_one_condition_out(images).withColumns({"repeat": F.lit(0), "seed": F.lit(42)})
    predictions, _ = models.cross_validate(loco, ["Area_nuc__median"], "loco", GRID)
    assert predictions.filter("fold <> condition").count() == 0 and predictions.count() == 160
    final = models.final_models(images, ["Area_nuc__median"], GRID)
    assert {r.model for r in final.collect()} == {"morphology_ridge", "morphology_elasticnet"}


def test_elastic_net_optimality():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 4))
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    y = x @ [2.0, 0.0, -1.0, 0.02] + rng.normal(0, 0.1, 60)
    y -= y.mean()
    a, l = 0.1, 0.5
    w = models.solve_linear(x.T @ x, x.T @ y, 60, {"alpha": a, "l1_ratio": l})
    gradient = x.T @ (x @ w - y) / 60 + a * (1 - l) * w
    for g, v in zip(gradient, w):
        assert abs(g + a * l * np.sign(v)) < 1e-6 if v else abs(g) <= a * l + 1e-6


def test_split_covers_each_image_once(spark):
    rows = [(i * 10 + c, f"f{i % 3}", f"f{i % 3}::{i}", int((i + c) % 3 == 0)) for i in range(40) for c in range(10)]
    cells = spark.createDataFrame(rows, "cell_id int, source_folder string, image_key string, ki67_label int")
    out = splits.split_within_folder(cells)
    per_image = out.groupBy("image_key").agg(F.countDistinct("split").alias("n")).collect()
    assert out.count() == 400 and all(r.n == 1 for r in per_image)
    counts = {(r.source_folder, r.split): r["count"] for r in out.select("source_folder", "image_key", "split").distinct().groupBy("source_folder", "split").count().collect()}
    assert counts[("f0", "train")] == 10 and counts[("f0", "valid")] + counts[("f0", "test")] == 4


def test_weights_and_transform(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 3.0, None), ("b", None, None)], "image_key string, v double, w double")
    weights = sorted(r.weight for r in splits.image_balanced_weight(df).collect())
    assert np.allclose(weights, [0.75, 0.75, 1.5])
    t = models.fit_table_transform(df, ["v", "w"])
    assert t.median == {"v": 2.0, "w": 0.0} and t.std["w"] == 1.0
    z = [r.v for r in t.apply(df, []).collect()]
    assert math.isclose(sum(z), 0.0, abs_tol=1e-12) and math.isclose(np.std(z), 1.0)


def test_roc_auc(spark):
    df = spark.createDataFrame([("s", 1, 0.9), ("s", 0, 0.5), ("s", 1, 0.5), ("s", 0, 0.1), ("o", 1, 0.3)], "split string, y int, p double")
    got = {r.split: r.roc_auc for r in summary.roc_auc(df, ["split"], "y", "p").collect()}
    assert got["s"] == 0.875 and got["o"] is None
