"""Queries over model operators and whole jobs."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from petridish.functions.catalog import SINGLE_GROUPS, feature_groups
from petridish.operators import models, splits
from petridish.plans import measure, modelling, study
from petridish.session import checkpoint_dir, materialize
from registry import standins as s
from registry.rounding import nround, nudged_sql, rounded
from registry.q_summary import CELL_TO_IMAGE_SQL, FEATURES, SCORED_SQL, SCORES, scored
from registry.standins import table, with_ctes
from petridish.operators import summary

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = nudged_sql(sql)
        return fn

    return register


TABLE_FEATURES = ["area", "nuc_area", "k", "cell_prob"]
STD_SQL = ",\n".join(
    f"""f{i} AS (SELECT cell_id, coalesce(CAST({f} AS DOUBLE), (SELECT median({f}) FROM cells)) AS v FROM cells),
t{i} AS (SELECT cell_id, (v - (SELECT avg(v) FROM f{i})) / (SELECT stddev_pop(v) FROM f{i}) AS v FROM f{i})"""
    for i, f in enumerate(TABLE_FEATURES)
)


@query("fit_table_transform", with_ctes(s.CELLS_SQL, STD_SQL, body="SELECT cell_id, " + ", ".join(
    f"round(t{i}.v, 6) AS {f}" for i, f in enumerate(TABLE_FEATURES)) + " FROM t0 " + " ".join(f"JOIN t{i} USING (cell_id)" for i in range(1, 4))))
def _(spark, sf):
    cells = s.cells(spark, sf)
    return rounded(models.fit_table_transform(cells, TABLE_FEATURES).apply(cells, ["cell_id"]))


@query("select_k_best", with_ctes(s.CELLS_SQL, body="""
, l AS (SELECT ki67_label AS y, unnest(['area', 'nuc_area', 'k', 'x']) AS feature, unnest([area, nuc_area, CAST(k AS DOUBLE), x]) AS v FROM cells),
c AS (SELECT feature, y, count(*) AS n, avg(v) AS m, var_pop(v) AS q FROM l GROUP BY ALL), t AS (SELECT feature, avg(v) AS g, count(*) AS total FROM l GROUP BY 1)
SELECT feature, round(sum(n * pow(m - g, 2)) / (count(*) - 1) / (sum(n * q) / (total - count(*))), 6) AS f_value FROM c JOIN t USING (feature) GROUP BY feature, total"""))
def _(spark, sf):
    return rounded(models.anova_f(s.cells(spark, sf), ["area", "nuc_area", "k", "x"]))


@query("positive_probability", with_ctes(s.CELLS_SQL, body="SELECT cell_id, round(1 / (1 + exp(-(k - 50) / 20.0)), 6) AS p FROM cells"))
def _(spark, sf):
    return s.cells(spark, sf).select("cell_id", nround(models.sigmoid((F.col("k") - 50) / 20.0), 6).alias("p"))


@query("stage1_matrix", with_ctes(SCORED_SQL, body=f"""
SELECT cell_id, image_key, ki67_label, round({SCORES[0]}, 6) AS {SCORES[0]}, """ + ", ".join(
    f"round(coalesce(CAST(embedding[{i + 1}] AS DOUBLE), 0), 6) AS cnn_emb_{i:04d}" for i in range(64)) + f""", 0.0::DOUBLE AS absent
FROM sc LEFT JOIN (SELECT {s.VECTOR_KEY} AS image_key, embedding FROM embeddings) USING (image_key)"""))
def _(spark, sf):
    cells = scored(spark, sf)
    config = models.Config("t", "t", True, True, "none", "S1", ("Texture",))
    columns = [SCORES[0], *[f"cnn_emb_{i:04d}" for i in range(64)], "absent"]
    out, _ = models.stage1_matrix(cells, config, cells.select("cell_id", *SCORES), vectors(spark, sf), None, columns, 64)
    return rounded(out)


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.expr(s.VECTOR_KEY).alias("image_key"), "embedding")


STAGE2 = models.stage2_columns("S4", [f"P{i}" for i in range(4)], [SCORES[0]])


@query("stage2_matrix", with_ctes(SCORED_SQL, f"img AS ({CELL_TO_IMAGE_SQL})", body="SELECT image_key, " + ", ".join(
    f"CAST(passage = '{c[8:]}' AS INT)::DOUBLE AS {c}" if c.startswith("passage_") else f"coalesce({c}, 0)::DOUBLE AS {c}" for c in STAGE2) + " FROM img"))
def _(spark, sf):
    images = summary.cell_to_image(scored(spark, sf), SCORES)
    return rounded(models.stage2_matrix(images, STAGE2, ["image_key"]))


@query("stage2_ratio", with_ctes(SCORED_SQL, body="""
, m AS (SELECT image_key, avg(cell_prob) AS a, avg(CASE WHEN cell_prob > 0.3 THEN 1.0 ELSE 0.0 END) AS b, avg(ki67_label) AS t FROM sc GROUP BY 1),
z AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(t) AS mt FROM m),
g AS (SELECT sum((a - ma) * (a - ma)) + 1 AS aa, sum((a - ma) * (b - mb)) AS ab, sum((b - mb) * (b - mb)) + 1 AS bb, sum((a - ma) * (t - mt)) AS ta, sum((b - mb) * (t - mt)) AS tb FROM m, z),
w AS (SELECT (ta * bb - tb * ab) / (aa * bb - ab * ab) AS wa, (tb * aa - ta * ab) / (aa * bb - ab * ab) AS wb FROM g)
SELECT image_key, round(least(greatest(mt + wa * (a - ma) + wb * (b - mb), 0), 1), 6) AS pred_ratio FROM m, z, w"""))
def _(spark, sf):
    images = summary.cell_to_image(scored(spark, sf))
    columns = ["mean_cell_prob", "frac_prob_gt_0_3"]
    weights = models.fit_ridge(images.select(*columns, "true_ratio"), columns, "true_ratio", 1.0)
    return rounded(models.predict_ratio(images, "S1", weights).select("image_key", "pred_ratio"))


@query("dose_interaction", with_ctes(s.STUDY_SQL, body="""
SELECT image_key, "IFN_dose" * "TNF_dose" AS "IFN_x_TNF", CASE WHEN image_index % 9 <> 0 THEN round("IDO_score", 6) END AS "IDO_score" FROM study"""))
def _(spark, sf):
    images = s.study_images(spark, sf).withColumn(
        "IDO_score", F.when(F.col("image_index") % 9 == 0, float("-inf")).otherwise(F.col("IDO_score"))
    )
    return rounded(models.dose_interaction(images).select("image_key", "IFN_x_TNF", "IDO_score"))


@query("dummy_median", with_ctes(s.STUDY_SQL, body="""
, f AS (SELECT image_key, "IDO_score" AS o, CAST((row_number() OVER (PARTITION BY condition ORDER BY md5(image_key || '#' || 42), image_key) - 1) % 5 + 1 AS INT) AS fold FROM study),
m AS (SELECT k.range AS fold, median(o) AS p FROM f, range(1, 6) k WHERE f.fold <> k.range GROUP BY 1)
SELECT CAST(0 AS INT) AS repeat, f.fold, image_key, round(o, 6) AS observed, round(p, 6) AS predicted FROM f JOIN m USING (fold)"""))
def _(spark, sf):
    outer = splits.stratified_kfold(s.study_images(spark, sf), 5, (42,))
    return rounded(models.dummy_median(outer))


# model inputs: columns of each feature group, with a signal in some
MODEL_FEATURES = (
    "GLCM ASM_cyto", "GLCM Contrast_cyto", "Area_cyto", "Perimeter_cyto", "Solidity_cyto", "Mean_nuc", "Halo Outer Mean",
    "Local Neighbor Count", "Mitotic Score", "Area_nuc", "Debris Count", "Image Confluency",
)


def model_cells(spark, sf):
    c = s.cells(spark, sf)
    noise = F.expr("(cell_id * 7919 % 1000) / 1000D")
    return c.select(
        "cell_id",
        "source_folder",
        "Image",
        "image_key",
        "passage",
        "ki67_label",
        (F.col("ki67_label") * 0.4 + noise).alias(MODEL_FEATURES[0]),
        F.when(F.col("cell_id") % 17 != 0, F.col("k") + F.col("ki67_label") * 20.0).alias(MODEL_FEATURES[1]),
        (F.col("area") - F.col("ki67_label") * 15).alias(MODEL_FEATURES[2]),
        F.sqrt("area").alias(MODEL_FEATURES[3]),
        noise.alias(MODEL_FEATURES[4]),
        (F.col("k") + noise * 40).alias(MODEL_FEATURES[5]),
        (F.col("k") * 0.5 + F.expr("cell_id * 104729 % 100")).alias(MODEL_FEATURES[6]),
        F.expr("CAST(cell_id * 31 % 7 AS DOUBLE)").alias(MODEL_FEATURES[7]),
        (F.col("ki67_label") * 0.2 + F.expr("(cell_id * 15485863 % 100) / 100D")).alias(MODEL_FEATURES[8]),
        F.col("nuc_area").cast("double").alias(MODEL_FEATURES[9]),
        F.expr("CAST(cell_id * 13 % 5 AS DOUBLE)").alias(MODEL_FEATURES[10]),
        (F.col("area") * 0.01 + noise).alias(MODEL_FEATURES[11]),
    )


MODEL_GROUPS = {g: c for g, c in feature_groups(MODEL_FEATURES).items() if g in SINGLE_GROUPS}


@query("evidence_model")
def _(spark, sf):
    _, scores = models.fit_feature_groups(model_cells(spark, sf), MODEL_GROUPS)
    return rounded(scores, 3)


@query("stage1_classifier")
def _(spark, sf):
    cells = model_cells(spark, sf)
    t = models.fit_table_transform(cells, MODEL_FEATURES)
    matrix, columns = models.stage1_matrix(cells, models.Config("p", "p", False, False, "all", "S1"), None, None, t)
    _, oof = models.stage1_with_oof(materialize(matrix), columns)
    return rounded(oof, 3)


@query("evaluate_config")
def _(spark, sf):
    data = modelling.prepare(model_cells(spark, sf))
    t = models.fit_table_transform(data.filter("split = 'train'"), MODEL_FEATURES)
    config = models.Config("parameters_only_s1", "Feature parameters only / S1", False, False, "all", "S1")
    row, _ = modelling.evaluate_config(data, config, None, None, t)
    return modelling._metric_frame(spark, [row])


@query("train_job")
def _(spark, sf):
    metrics, _ = modelling.train_job(model_cells(spark, sf), MODEL_FEATURES, vectors(spark, sf), 64)
    return metrics


@query("save_load_model")
def _(spark, sf):
    """Ratios of every image before and after the model was written and read again."""
    path = f"{checkpoint_dir(spark)}/model-{uuid.uuid4().hex}"
    cells = model_cells(spark, sf)
    _, bundle = modelling.train_job(cells, MODEL_FEATURES, vectors(spark, sf), 64, path=path)
    before = modelling.predict_job(cells, bundle)[1].select("image_key", F.col("pred_ratio").alias("before"))
    after = modelling.predict_job(cells, models.load_model(spark, path))[1].select("image_key", F.col("pred_ratio").alias("after"))
    return rounded(before.join(after, "image_key"))


@query("predict_job")
def _(spark, sf):
    cells = model_cells(spark, sf)
    _, bundle = modelling.train_job(cells, MODEL_FEATURES, vectors(spark, sf), 64)
    expected = cells.select("source_folder", F.col("Image").alias("image_name")).distinct()
    return rounded(modelling.predict_job(cells, bundle, expected=expected)[2], 3)


@query("ablation_job")
def _(spark, sf):
    return modelling.ablation_job(model_cells(spark, sf), MODEL_FEATURES, vectors(spark, sf), 64)


@query("repeated_cv")
def _(spark, sf):
    images = summary.image_median_iqr(s.study_cells(spark, sf), FEATURES)
    predictors = [c for c in images.columns if c.endswith(("__median", "__iqr"))]
    outer = splits.stratified_kfold(images, 5, models.STUDY_GRID["seeds"])
    predictions, _ = models.cross_validate(outer, predictors, "repeated_cv", None)
    return rounded(predictions)


@query("final_models")
def _(spark, sf):
    images = summary.image_median_iqr(s.study_cells(spark, sf), FEATURES)
    predictors = [c for c in images.columns if c.endswith(("__median", "__iqr"))]
    return rounded(models.final_models(images, predictors, None))


@query("study_job")
def _(spark, sf):
    tables = study.study_job(s.study_cells(spark, sf), FEATURES, grid=None)
    return rounded(tables["cv_metrics_summary"])


DEBRIS = {"threshold_method": "otsu", "min_size_px": 2, "max_size_fraction_of_median_nucleus_area": 0.9, "cell_dilate_px": 1}


@query("param_table")
def _(spark, sf):
    out = measure.param_table(
        s.outlines(spark, sf).drop("dataset"), s.pixels(spark, sf).drop("dataset"), ["image_id"], s.WIDTH, s.HEIGHT, DEBRIS
    )
    return rounded(out)


@query("image_job")
def _(spark, sf):
    out = measure.image_job(
        s.outlines(spark, sf).drop("dataset"),
        s.pixels(spark, sf).drop("dataset"),
        ["image_id"],
        s.WIDTH,
        s.HEIGHT,
        ido=s.pixels(spark, sf, "ido").drop("dataset"),
        ki67_mask=s.pixels(spark, sf, "ki67").filter("v > 150").drop("dataset"),
        rings=s.pixels(spark, sf, "ido").drop("dataset").withColumn("v", F.col("v") / 255),
        debris=DEBRIS,
    )
    return rounded(out)
