"""Queries over roll-ups, metrics, dose curves, splits and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from petridish.functions.text import combo_label, score_name
from petridish.operators import splits, summary
from registry import standins as s
from registry.rounding import nround, nudged_sql, rounded
from registry.q_quality import IMAGE_PRED_SQL, image_predictions
from registry.standins import table, with_ctes

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = nudged_sql(sql)
        return fn

    return register


SCORES = ("texture_ki67_evidence", "halo_rounding_ki67_evidence")
SCORED_SQL = s.CELLS_SQL + """,
sc AS (SELECT *, (k % 50) / 50.0 AS texture_ki67_evidence, least(area / 150, 1.0) AS halo_rounding_ki67_evidence FROM cells)"""


def scored(spark, sf):
    return s.cells(spark, sf).withColumn(SCORES[0], F.expr("(k % 50) / 50D")).withColumn(
        SCORES[1], F.least(F.col("area") / 150, F.lit(1.0))
    )


def fr(t):
    return f"avg(CASE WHEN cell_prob > {t} THEN 1.0 ELSE 0.0 END)"


CELL_TO_IMAGE_SQL = f"""
SELECT image_key, min(source_folder) AS source_folder, min("Image") AS image_name, min(passage) AS passage, count(*) AS cell_count,
  round(avg(cell_prob), 6) AS mean_cell_prob, round(median(cell_prob), 6) AS median_cell_prob, round(quantile_cont(cell_prob, 0.9), 6) AS p90_cell_prob,
  round({fr(0.3)}, 6) AS frac_prob_gt_0_3, round({fr(0.5)}, 6) AS frac_prob_gt_0_5, round({fr(0.7)}, 6) AS frac_prob_gt_0_7, round(avg(ki67_label), 6) AS true_ratio,
  """ + ", ".join(f"round(avg({c}), 6) AS {c}_mean, round(median({c}), 6) AS {c}_median" for c in SCORES) + " FROM sc GROUP BY 1"


@query("agg_cell_to_image", with_ctes(SCORED_SQL, body=CELL_TO_IMAGE_SQL))
def _(spark, sf):
    return rounded(summary.cell_to_image(scored(spark, sf), SCORES))


@query("agg_cell_to_image_hot", with_ctes(SCORED_SQL, body=CELL_TO_IMAGE_SQL))
def _(spark, sf):
    # the same table with every image treated as too large for one task
    return rounded(summary.cell_to_image(scored(spark, sf), SCORES))


@query("agg_image_to_folder", with_ctes(IMAGE_PRED_SQL, body="""
, f AS (SELECT source_folder, count(DISTINCT image_key) AS image_count, CAST(sum(cell_count) AS BIGINT) AS cell_count,
  sum(pred_ratio * cell_count) / sum(cell_count) FILTER (pred_ratio IS NOT NULL) AS pw, avg(pred_ratio) AS pu,
  sum(true_ratio * cell_count) / sum(cell_count) FILTER (true_ratio IS NOT NULL) AS tw, avg(true_ratio) AS tu FROM ipred GROUP BY 1)
SELECT source_folder, image_count, cell_count, round(pw, 6) AS pred_ratio, round(pu, 6) AS pred_ratio_unweighted, round(pw, 6) AS pred_ratio_weighted,
  round(tw, 6) AS true_ratio, round(tu, 6) AS true_ratio_unweighted, round(tw, 6) AS true_ratio_weighted, round(abs(pw - tw), 6) AS abs_error,
  round(abs(pu - tu), 6) AS abs_error_unweighted, round(abs(pw - tw), 6) AS abs_error_weighted FROM f"""))
def _(spark, sf):
    return rounded(summary.image_to_folder(image_predictions(spark, sf)))


@query("agg_feature_mean_median", with_ctes(s.CELLS_SQL, body="""
SELECT image_key, """ + ", ".join(f"round(avg({c}), 6) AS {c}_mean, round(median({c}), 6) AS {c}_median" for c in ("area", "nuc_area", "k", "cell_prob")) + " FROM cells GROUP BY 1"))
def _(spark, sf):
    return rounded(summary.feature_mean_median(s.cells(spark, sf), ["area", "nuc_area", "k", "cell_prob"]))


FEATURES = ["Area_nuc", "Extent_nuc", "Solidity_cyto"]
MEDIAN_IQR_SQL = s.STUDY_CELLS_SQL + """,
simg AS (SELECT image_key, condition, "IFN_dose", "TNF_dose", image_index, count(*) AS cell_count, median("IDO_score") AS "IDO_score",
  quantile_cont("IDO_score", 0.75) - quantile_cont("IDO_score", 0.25) AS "IDO_score_IQR", """ + ", ".join(
    f'median("{f}") AS "{f}__median", quantile_cont("{f}", 0.75) - quantile_cont("{f}", 0.25) AS "{f}__iqr"' for f in FEATURES
) + " FROM scells GROUP BY ALL HAVING count(*) >= 3)"


@query("agg_image_median_iqr", with_ctes(MEDIAN_IQR_SQL, body='SELECT image_key, condition, "IFN_dose", "TNF_dose", image_index, cell_count, round("IDO_score", 6) AS "IDO_score", round("IDO_score_IQR", 6) AS "IDO_score_IQR", ' + ", ".join(
    f'round("{f}__{t}", 6) AS "{f}__{t}"' for f in FEATURES for t in ("median", "iqr")) + " FROM simg"))
def _(spark, sf):
    return rounded(summary.image_median_iqr(s.study_cells(spark, sf), FEATURES))


@query("images_without_cells", with_ctes(MEDIAN_IQR_SQL, body="SELECT image_key FROM study ANTI JOIN simg USING (image_key)"))
def _(spark, sf):
    images = summary.image_median_iqr(s.study_cells(spark, sf), FEATURES)
    return summary.images_without_cells(s.study_images(spark, sf), images)


def overall(body, group="split"):
    return f"""{body.format(split="split")} GROUP BY split UNION ALL {body.format(split="'overall'")}"""


@query("cell_metrics", with_ctes(s.CELLS_SQL, body="""
, r AS (SELECT split, cell_prob AS p, ki67_label AS y, CASE WHEN cell_prob >= 0.3 THEN 1 ELSE 0 END AS c FROM cells WHERE cell_prob IS NOT NULL)
""" + overall("""SELECT {split} AS split, count(*) AS cell_num, round(avg(y), 6) AS positive_ratio, round(avg(CASE WHEN c = y THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
  round(avg(abs(p - y)), 6) AS probability_mae, count(*) FILTER (c = 0 AND y = 0) AS tn, count(*) FILTER (c = 1 AND y = 0) AS fp,
  count(*) FILTER (c = 0 AND y = 1) AS fn, count(*) FILTER (c = 1 AND y = 1) AS tp FROM r""")))
def _(spark, sf):
    return rounded(summary.cell_metrics(s.cells(spark, sf), 0.3))


@query("image_metrics", with_ctes(IMAGE_PRED_SQL, body="""
, v AS (SELECT split, image_key, cell_count AS w, pred_ratio AS p, true_ratio AS t, pred_ratio - true_ratio AS e,
   CASE WHEN true_ratio IS NOT NULL THEN pred_ratio END AS pv, CASE WHEN true_ratio IS NOT NULL THEN cell_count END AS wv FROM ipred)
""" + overall("""SELECT {split} AS split, count(DISTINCT image_key) AS image_num, CAST(sum(w) AS BIGINT) AS cell_num, round(avg(p), 6) AS pred_ratio,
  round(sum(p * w) / sum(w), 6) AS pred_ratio_weighted, round(avg(t), 6) AS true_ratio, round(sum(t * w) / sum(wv), 6) AS true_ratio_weighted,
  round(avg(abs(e)), 6) AS image_mae, round(avg(e), 6) AS image_bias, round(sqrt(avg(e * e)), 6) AS image_rmse, round(avg(CASE WHEN e IS NOT NULL THEN CASE WHEN abs(e) <= 0.1 THEN 1.0 ELSE 0.0 END END), 6) AS within_10pp,
  round(abs(avg(pv) - avg(t)), 6) AS abs_error, round(abs(sum(pv * w) / sum(wv) - sum(t * w) / sum(wv)), 6) AS abs_error_weighted,
  round(1 - abs(avg(pv) - avg(t)), 6) AS ratio_accuracy, round(1 - abs(sum(pv * w) / sum(wv) - sum(t * w) / sum(wv)), 6) AS ratio_accuracy_weighted FROM v""")))
def _(spark, sf):
    return rounded(summary.image_metrics(image_predictions(spark, sf)))


@query("split_summary", with_ctes(s.CELLS_SQL, body="""
SELECT split, count(DISTINCT source_folder) AS source_folders, count(DISTINCT image_key) AS images, count(*) AS cells, round(avg(ki67_label), 6) AS positive_ratio
FROM cells GROUP BY 1"""))
def _(spark, sf):
    return rounded(summary.split_summary(s.cells(spark, sf)))


@query("split_folders", with_ctes(s.CELLS_SQL, body="SELECT DISTINCT split, source_folder FROM cells"))
def _(spark, sf):
    return summary.split_folders(s.cells(spark, sf))


STATUSES = ("cyto_cut", "full_cell", "nuc_cut", "nuc_only", "unknown")


@query("status_crosstab", with_ctes(s.CELLS_SQL, body="""
, c AS (SELECT image_key, """ + ", ".join(f"count(*) FILTER (cell_status = '{x}') AS status_{x}" for x in STATUSES) + """,
  count(*) FILTER (cell_status = 'full_cell' AND cell_prob IS NOT NULL) AS kept_full_cells FROM cells WHERE passage <> 'P3' GROUP BY 1)
SELECT image_key, """ + ", ".join(f"coalesce(status_{x}, 0) AS status_{x}" for x in STATUSES) + """, coalesce(kept_full_cells, 0) AS kept_full_cells
FROM (SELECT DISTINCT image_key FROM cells) LEFT JOIN c USING (image_key)"""))
def _(spark, sf):
    c = s.cells(spark, sf)
    return summary.status_crosstab(
        c.filter("passage <> 'P3'").withColumn("IDO_score", F.col("cell_prob")), c, STATUSES
    )


CURVE_SQL = """
cv AS (SELECT 'IFN_response_AUC' AS curve, "IFN_dose" AS dose, "IDO_score" AS s FROM study WHERE "TNF_dose" = 0
  UNION ALL SELECT 'TNF_response_AUC_IFN0', "TNF_dose", "IDO_score" FROM study WHERE "IFN_dose" = 0
  UNION ALL SELECT 'TNF_response_AUC_IFN25', "TNF_dose", "IDO_score" FROM study WHERE "IFN_dose" = 25),
dr AS (SELECT curve, dose, count(*) AS n, avg(s) AS m, median(s) AS md, CASE WHEN count(*) > 1 THEN stddev_samp(s) END AS sd FROM cv GROUP BY ALL)"""


@query("dose_response", with_ctes(s.STUDY_SQL, CURVE_SQL, body="""
SELECT curve, dose, n AS n_images, round(m, 6) AS "IDO_score_mean", round(sd, 6) AS "IDO_score_std", round(md, 6) AS "IDO_score_median", round(sd / sqrt(n), 6) AS "IDO_score_sem" FROM dr"""))
def _(spark, sf):
    return rounded(summary.dose_response(s.study_images(spark, sf)))


AUC_SQL = """
st AS (SELECT curve, dose, (dose - lag(dose) OVER w) * (md + lag(md) OVER w) / 2 AS a FROM dr WINDOW w AS (PARTITION BY curve ORDER BY dose)),
au AS (SELECT curve, min(dose) AS dose_min, max(dose) AS dose_max, sum(a) AS auc_raw, sum(a) / (max(dose) - min(dose)) AS auc_n FROM st GROUP BY 1)"""


@query("dose_auc", with_ctes(s.STUDY_SQL, CURVE_SQL, AUC_SQL, body="""
SELECT curve, dose_min, dose_max, round(auc_raw, 4) AS auc_raw, round(auc_n, 6) AS auc_normalized_by_dose_range FROM au"""))
def _(spark, sf):
    out = summary.dose_auc(summary.dose_response(s.study_images(spark, sf)))
    return rounded(out.withColumn("auc_raw", nround("auc_raw", 4)))


OOF_SQL = """
oof AS (SELECT 'repeated_cv' AS validation, r.range AS repeat, CASE image_index % 2 WHEN 0 THEN 'm0' ELSE 'm1' END AS model, image_key, "IFN_dose", "TNF_dose",
   "IDO_score" AS o, "IDO_score" * (0.9 + 0.05 * r.range) + image_index % 7 AS p FROM study, range(3) r)"""


def oof(spark, sf):
    rep = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("repeat")
    return s.study_images(spark, sf).select("*", rep).select(
        F.lit("repeated_cv").alias("validation"),
        "repeat",
        F.when(F.col("image_index") % 2 == 0, "m0").otherwise("m1").alias("model"),
        "image_key",
        "IFN_dose",
        "TNF_dose",
        F.col("IDO_score").alias("observed_IDO_score"),
        F.expr("IDO_score * (0.9D + 0.05D * repeat) + image_index % 7").alias("predicted_IDO_score"),
    )


PRED_AUC_SQL = CURVE_SQL + "," + AUC_SQL + "," + OOF_SQL + """,
pc AS (SELECT repeat, model, 'IFN_response_AUC' AS curve, "IFN_dose" AS dose, p FROM oof WHERE "TNF_dose" = 0
  UNION ALL SELECT repeat, model, 'TNF_response_AUC_IFN0', "TNF_dose", p FROM oof WHERE "IFN_dose" = 0
  UNION ALL SELECT repeat, model, 'TNF_response_AUC_IFN25', "TNF_dose", p FROM oof WHERE "IFN_dose" = 25),
pd AS (SELECT repeat, model, curve, dose, median(p) AS md FROM pc GROUP BY ALL),
ps AS (SELECT *, (dose - lag(dose) OVER w) * (md + lag(md) OVER w) / 2 AS a FROM pd WINDOW w AS (PARTITION BY repeat, model, curve ORDER BY dose)),
pa AS (SELECT repeat, model, curve, sum(a) AS raw, sum(a) / (max(dose) - min(dose)) AS nrm FROM ps GROUP BY ALL),
pj AS (SELECT repeat, model, curve, auc_raw, auc_n, raw, nrm FROM pa JOIN au USING (curve))"""


@query("predicted_auc", with_ctes(s.STUDY_SQL, PRED_AUC_SQL, body="""
SELECT 'repeated_cv' AS validation, model, curve, round(auc_raw, 4) AS observed_auc_raw, round(auc_n, 4) AS observed_auc_normalized, count(*) AS repeats,
  """ + ", ".join(f"round(median({e}), 4) AS {n}_median, round(quantile_cont({e}, 0.75) - quantile_cont({e}, 0.25), 4) AS {n}_iqr" for n, e in (
    ("predicted_auc_raw", "raw"), ("absolute_auc_error_raw", "abs(raw - auc_raw)"), ("predicted_auc_normalized", "nrm"), ("absolute_auc_error_normalized", "abs(nrm - auc_n)"))) + """
FROM pj GROUP BY model, curve, auc_raw, auc_n"""))
def _(spark, sf):
    observed = summary.dose_auc(summary.dose_response(s.study_images(spark, sf)))
    return rounded(summary.predicted_auc(oof(spark, sf), observed)[1], 4)


REG_SQL = OOF_SQL + """,
rk AS (SELECT *, (rank() OVER (PARTITION BY repeat, model ORDER BY o) + (count(*) OVER (PARTITION BY repeat, model, o) - 1) / 2.0) AS ro,
  (rank() OVER (PARTITION BY repeat, model ORDER BY p) + (count(*) OVER (PARTITION BY repeat, model, p) - 1) / 2.0) AS rp FROM oof),
reg AS (SELECT validation, CAST(repeat AS INT) AS repeat, model, count(*) AS n_images, avg(abs(p - o)) AS mae, sqrt(avg(pow(p - o, 2))) AS rmse, 1 - sum(pow(p - o, 2)) / (var_pop(o) * count(*)) AS r2, corr(ro, rp) AS spearman
  FROM rk GROUP BY ALL)"""


@query("regression_metrics", with_ctes(s.STUDY_SQL, REG_SQL, body="""
SELECT validation, repeat, model, n_images, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(r2, 6) AS r2, round(spearman, 6) AS spearman FROM reg"""))
def _(spark, sf):
    return rounded(
        summary.regression_metrics(oof(spark, sf), ["validation", "repeat", "model"], "observed_IDO_score", "predicted_IDO_score")
    )


@query("summarize_metrics", with_ctes(s.STUDY_SQL, REG_SQL, body="""
SELECT validation, model, count(*) AS repeats, max(n_images) AS n_images, """ + ", ".join(
    f"round(median({m}), 6) AS {m}_median, round(quantile_cont({m}, 0.75) - quantile_cont({m}, 0.25), 6) AS {m}_iqr" for m in ("mae", "rmse", "r2", "spearman")
) + " FROM reg GROUP BY validation, model"))
def _(spark, sf):
    m = summary.regression_metrics(oof(spark, sf), ["validation", "repeat", "model"], "observed_IDO_score", "predicted_IDO_score")
    return rounded(summary.summarize_metrics(m))


@query("summarize_coefficients", """
WITH c AS (SELECT l_returnflag AS validation, l_linestatus AS model, 'f' || l_linenumber AS feature, l_extendedprice / 1000 - 50 AS v FROM lineitem)
SELECT validation, model, feature, round(median(v), 6) AS coefficient_median, round(avg(v), 6) AS coefficient_mean,
  round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS coefficient_iqr, round(abs(median(v)), 6) AS absolute_median FROM c GROUP BY ALL""")
def _(spark, sf):
    c = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("validation"),
        F.col("l_linestatus").alias("model"),
        F.concat(F.lit("f"), F.col("l_linenumber")).alias("feature"),
        (F.col("l_extendedprice") / 1000 - 50).alias("coefficient_standardized"),
    )
    return rounded(summary.summarize_coefficients(c))


@query("oof_average", with_ctes(s.STUDY_SQL, OOF_SQL, body="""
SELECT model, image_key, round(min(o), 6) AS "observed_IDO_score", round(avg(p), 6) AS "predicted_IDO_score" FROM oof GROUP BY ALL"""))
def _(spark, sf):
    return rounded(summary.oof_average(oof(spark, sf)))


@query("signal_verdict", with_ctes(s.STUDY_SQL, REG_SQL, body="""
, sm AS (SELECT model, median(mae) AS mae, median(spearman) AS sp FROM reg GROUP BY 1)
SELECT round(max(mae) FILTER (model = 'm0'), 6) AS morphology_mae, round(max(mae) FILTER (model = 'm1'), 6) AS dummy_mae, round(max(sp) FILTER (model = 'm0'), 6) AS morphology_spearman,
  CASE WHEN max(mae) FILTER (model = 'm0') < max(mae) FILTER (model = 'm1') AND max(sp) FILTER (model = 'm0') > 0 THEN 'signal' ELSE 'no stable signal' END AS verdict FROM sm"""))
def _(spark, sf):
    preds = oof(spark, sf).withColumn(
        "model", F.when(F.col("model") == "m0", "morphology_ridge").otherwise("dummy_median")
    )
    m = summary.regression_metrics(preds, ["validation", "repeat", "model"], "observed_IDO_score", "predicted_IDO_score")
    return rounded(summary.signal_verdict(summary.summarize_metrics(m)))


RANK_SQL = """
rc AS (SELECT {keys}, {score} AS s, {label} AS y, rank() OVER (PARTITION BY {keys} ORDER BY {score}) + (count(*) OVER (PARTITION BY {keys}, {score}) - 1) / 2.0 AS r FROM {src} WHERE {score} IS NOT NULL),
auc AS (SELECT {keys}, CASE WHEN sum(y) > 0 AND sum(y) < count(*) THEN (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) END AS a FROM rc GROUP BY ALL)"""


@query("roc_auc", with_ctes(s.CELLS_SQL, RANK_SQL.format(keys="split", score="cell_prob", label="ki67_label", src="cells"), body="""
SELECT split, round(a, 6) AS roc_auc FROM auc"""))
def _(spark, sf):
    return rounded(summary.roc_auc(s.cells(spark, sf), ["split"], "ki67_label", "cell_prob"))


GROUPS = {"Texture": SCORES[0], "Halo / rounding": SCORES[1]}


@query("feature_group_relation", with_ctes(SCORED_SQL, f"""
lg AS (SELECT split, image_key, ki67_label, 'Texture' AS feature_group, {SCORES[0]} AS score FROM sc UNION ALL SELECT split, image_key, ki67_label, 'Halo / rounding', {SCORES[1]} FROM sc)""",
    RANK_SQL.format(keys="feature_group, split", score="score", label="ki67_label", src="lg"), body="""
, ac AS (SELECT feature_group, split, avg(CASE WHEN (score >= 0.5) = (ki67_label = 1) THEN 1.0 ELSE 0.0 END) AS acc FROM lg GROUP BY ALL),
im AS (SELECT feature_group, split, image_key, abs(avg(ki67_label) - avg(score)) AS e FROM lg GROUP BY ALL),
ma AS (SELECT feature_group, split, avg(e) AS mae FROM im GROUP BY ALL)
SELECT feature_group, split, round(acc, 6) AS cell_accuracy, round(mae, 6) AS image_mae, round(a, 6) AS cell_roc_auc FROM ac JOIN ma USING (feature_group, split) JOIN auc USING (feature_group, split)"""))
def _(spark, sf):
    return rounded(summary.feature_group_relation(scored(spark, sf), GROUPS))


MODELS_SQL = s.CELLS_SQL + """,
pm AS (SELECT 'model_' || (k % 15) AS model, ki67_label, CASE WHEN area > 40 THEN 1 ELSE 0 END AS cell_pred FROM cells),
mm AS (SELECT model, avg(abs(ki67_label - cell_pred)) AS test_image_mae FROM pm GROUP BY 1)"""


def model_rows(spark, sf):
    p = s.cells(spark, sf).select(
        F.concat(F.lit("model_"), F.col("k") % 15).alias("model"),
        "ki67_label",
        F.when(F.col("area") > 40, 1).otherwise(0).alias("cell_pred"),
    )
    return p, p.groupBy("model").agg(F.avg(F.abs(F.col("ki67_label") - F.col("cell_pred"))).alias("test_image_mae"))


@query("confusion_by_model", with_ctes(MODELS_SQL, body="""
, top AS (SELECT model FROM mm ORDER BY test_image_mae, model LIMIT 12)
SELECT model, count(*) FILTER (ki67_label = 0 AND cell_pred = 0) AS tn, count(*) FILTER (ki67_label = 0 AND cell_pred = 1) AS fp,
  count(*) FILTER (ki67_label = 1 AND cell_pred = 0) AS fn, count(*) FILTER (ki67_label = 1 AND cell_pred = 1) AS tp FROM pm JOIN top USING (model) GROUP BY 1"""))
def _(spark, sf):
    return summary.confusion_by_model(*model_rows(spark, sf))


@query("embedding_ablation_pivot", """
WITH c AS (SELECT p_type || ' + ' || p_brand AS feature_combo, p_size % 2 = 0 AS w, avg(p_retailprice / 2000) AS m FROM part GROUP BY ALL),
p AS (SELECT feature_combo, max(m) FILTER (NOT w) AS a, max(m) FILTER (w) AS b FROM c GROUP BY 1)
SELECT feature_combo, round(a, 6) AS mae_without, round(b, 6) AS mae_with, round((1 - a) * 100, 4) AS correct_without, round((1 - b) * 100, 4) AS correct_with
FROM p WHERE a IS NOT NULL AND b IS NOT NULL ORDER BY a, feature_combo LIMIT 16""")
def _(spark, sf):
    c = table(spark, sf, "part").groupBy(
        F.concat_ws(" + ", "p_type", "p_brand").alias("feature_combo"), (F.col("p_size") % 2 == 0).alias("with_image_embedding")
    ).agg(F.avg(F.col("p_retailprice") / 2000).alias("test_image_mae"))
    out = summary.embedding_ablation(c)
    return rounded(out.withColumn("correct_without", nround("correct_without", 4)).withColumn("correct_with", nround("correct_with", 4)))


@query("area_histogram", with_ctes(s.CELLS_SQL, body="""
, l AS (SELECT ln(area * 10 * 1.5896 * 1.5876) / ln(3.0) AS l FROM cells), m AS (SELECT min(l) AS lo, count(*) AS n, count(*) FILTER (l > 6.0) AS ab FROM l)
SELECT CAST(floor(round((l - lo) / 0.2, 9)) AS BIGINT) AS bin, round(lo + floor(round((l - lo) / 0.2, 9)) * 0.2, 6) AS left_edge, count(*) AS cells, round(count(*) / n * 100, 6) AS percent, round(ab / n * 100, 6) AS percent_above
FROM l, m GROUP BY floor(round((l - lo) / 0.2, 9)), lo, n, ab"""))
def _(spark, sf):
    return rounded(summary.area_histogram(s.cells(spark, sf).withColumn("Area_cyto", F.col("area") * 10)))


@query("top_k", "SELECT part.p_partkey, p_retailprice, p_size FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 15")
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_retailprice", "p_size")
    return summary.top_k(p, 15, F.desc("p_retailprice"), "p_partkey")


@query("union_levels", with_ctes(IMAGE_PRED_SQL, body="""
SELECT 'cell' AS level, source_folder, image_key, cell_id, round(cell_prob, 6) AS cell_prob, NULL::DOUBLE AS pred_ratio FROM cells
UNION ALL SELECT 'image', source_folder, image_key, NULL, NULL, round(pred_ratio, 6) FROM ipred
UNION ALL SELECT 'folder', source_folder, NULL, NULL, NULL, round(sum(pred_ratio * cell_count) / sum(cell_count), 6) FROM ipred GROUP BY source_folder"""))
def _(spark, sf):
    images = image_predictions(spark, sf)
    cells = s.cells(spark, sf).select("source_folder", "image_key", "cell_id", "cell_prob")
    folders = summary.image_to_folder(images).select("source_folder", "pred_ratio")
    return rounded(summary.union_levels(cells, images.select("source_folder", "image_key", "pred_ratio"), folders))


# --- splits -------------------------------------------------------------------------------


@query("image_balanced_weight", with_ctes(s.CELLS_SQL, body="""
, n AS (SELECT image_key, count(*) AS c FROM cells GROUP BY 1)
SELECT cell_id, image_key, round((1.0 / c) / (SELECT avg(1.0 / c) FROM cells JOIN n USING (image_key)), 6) AS weight FROM cells JOIN n USING (image_key)"""))
def _(spark, sf):
    return rounded(splits.image_balanced_weight(s.cells(spark, sf).select("cell_id", "image_key")))


@query("split_by_folder", """
SELECT doc_id, source, CASE WHEN source IN ('src1', 'src2', 'src3') THEN 'valid' WHEN source IN ('src4', 'src5') THEN 'test' ELSE 'train' END AS split FROM documents""")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    return splits.split_by_folder(d, ["SRC1", "src2 ", "src3"], ["src3", "src4", "Src5"], "source")


@query("split_counts", """
WITH n AS (SELECT p_partkey AS n FROM part), r AS (SELECT n, round(n * 0.7, 9) AS a, round(n * 0.15, 9) AS b FROM n),
f AS (SELECT n, CAST(floor(a) AS BIGINT) AS fa, CAST(floor(b) AS BIGINT) AS fb, round(a - floor(a), 6) AS ra, round(b - floor(b), 6) AS rb FROM r),
g AS (SELECT *, n - fa - 2 * fb AS l FROM f),
h AS (SELECT n, fa + CASE WHEN (CASE WHEN rb >= ra THEN 2 ELSE 0 END) < l THEN 1 ELSE 0 END AS t,
  fb + CASE WHEN (1 + CASE WHEN ra > rb THEN 1 ELSE 0 END) < l THEN 1 ELSE 0 END AS v, fb + CASE WHEN (CASE WHEN ra > rb THEN 1 ELSE 0 END) < l THEN 1 ELSE 0 END AS e FROM g)
SELECT n, CASE WHEN n = 0 THEN 0 WHEN n <= 2 THEN 1 ELSE t - (v = 0)::INT - (e = 0)::INT END AS train,
  CASE WHEN n <= 2 THEN 0 ELSE greatest(v, 1) END AS valid, CASE WHEN n < 2 THEN 0 WHEN n = 2 THEN 1 ELSE greatest(e, 1) END AS test FROM h""")
def _(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("n")).select(
        "n", splits.split_counts(F.col("n")).alias("q")
    ).select("n", "q.train", "q.valid", "q.test")


STRATA_SQL = """
im AS (SELECT source_folder, image_key, avg(ki67_label) AS true_ratio FROM cells GROUP BY ALL),
ir AS (SELECT *, row_number() OVER (PARTITION BY source_folder ORDER BY true_ratio, image_key) AS r, count(*) OVER (PARTITION BY source_folder) AS n FROM im),
ik AS (SELECT source_folder, count(DISTINCT true_ratio) AS kinds FROM im GROUP BY 1),
ib AS (SELECT ir.*, kinds, CASE WHEN kinds >= 2 AND n > 1 THEN greatest(ceil(round((r - 1) * least(5, kinds, n) / (n - 1), 9)), 1) - 1 ELSE 0 END AS b FROM ir JOIN ik USING (source_folder)),
ic AS (SELECT *, count(*) OVER (PARTITION BY source_folder, b) AS c FROM ib),
strata AS (SELECT source_folder, image_key, true_ratio, n, CAST(CASE WHEN min(c) OVER (PARTITION BY source_folder) < 2 THEN 0 ELSE b END AS INT) AS stratum FROM ic)"""


@query("ratio_strata", with_ctes(s.CELLS_SQL, STRATA_SQL, body="SELECT source_folder, image_key, round(true_ratio, 6) AS true_ratio, stratum FROM strata"))
def _(spark, sf):
    images = s.cells(spark, sf).groupBy("source_folder", "image_key").agg(F.avg("ki67_label").alias("true_ratio"))
    return rounded(splits.ratio_strata(images))


def seed_case():
    import zlib

    return "CASE source_folder " + " ".join(
        f"WHEN 'folder_{i}' THEN {(42 + zlib.crc32(f'folder_{i}'.encode())) % (2**32 - 1)}" for i in range(12)
    ) + " END"


@query("stable_seed", with_ctes(s.CELLS_SQL, body=f"SELECT DISTINCT source_folder, CAST({seed_case()} AS BIGINT) AS seed FROM cells"))
def _(spark, sf):
    folders = s.cells(spark, sf).select("source_folder").distinct()
    return folders.select("source_folder", splits.stable_seed("source_folder", 42).alias("seed"))


@query("split_within_folder", with_ctes(s.CELLS_SQL, STRATA_SQL, body=f"""
, dw AS (SELECT *, md5(image_key || '#' || ({seed_case()})) AS d FROM strata),
dl AS (SELECT *, row_number() OVER (PARTITION BY source_folder, stratum ORDER BY d, image_key) AS deal, count(*) OVER (PARTITION BY source_folder, stratum) AS size FROM dw),
od AS (SELECT *, row_number() OVER (PARTITION BY source_folder ORDER BY round((deal - 0.5) / size, 9), stratum, d, image_key) AS o FROM dl),
qt AS (SELECT *, floor(round(n * 0.7, 9)) AS fa, floor(round(n * 0.15, 9)) AS fb, round(n * 0.7 - floor(round(n * 0.7, 9)), 6) AS ra, round(n * 0.15 - floor(round(n * 0.15, 9)), 6) AS rb FROM od),
qu AS (SELECT *, n - fa - 2 * fb AS l FROM qt),
qv AS (SELECT *, fa + CASE WHEN (CASE WHEN rb >= ra THEN 2 ELSE 0 END) < l THEN 1 ELSE 0 END AS t0, fb + CASE WHEN (1 + CASE WHEN ra > rb THEN 1 ELSE 0 END) < l THEN 1 ELSE 0 END AS v0,
  fb + CASE WHEN (CASE WHEN ra > rb THEN 1 ELSE 0 END) < l THEN 1 ELSE 0 END AS e0 FROM qu),
qw AS (SELECT *, CASE WHEN n <= 2 THEN 1 ELSE t0 - (v0 = 0)::INT - (e0 = 0)::INT END AS t, CASE WHEN n <= 2 THEN 0 ELSE greatest(v0, 1) END AS v FROM qv)
SELECT image_key, CASE WHEN o <= t THEN 'train' WHEN o <= t + v THEN 'valid' ELSE 'test' END AS split FROM qw"""))
def _(spark, sf):
    out = splits.split_within_folder(s.cells(spark, sf).select("cell_id", "source_folder", "image_key", "ki67_label"))
    return out.select("image_key", "split").distinct()


@query("group_kfold", with_ctes(s.CELLS_SQL, body="""
, g AS (SELECT image_key, count(*) AS c FROM cells GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY c DESC, image_key) - 1 AS r FROM g)
SELECT image_key, CAST(CASE WHEN r % 10 < 5 THEN r % 10 ELSE 9 - r % 10 END AS INT) AS fold, c AS cells FROM r"""))
def _(spark, sf):
    out = splits.group_kfold(s.cells(spark, sf).select("cell_id", "image_key"), "image_key", 5)
    return out.groupBy("image_key", "fold").agg(F.count(F.lit(1)).alias("cells"))


@query("stratified_kfold", with_ctes(s.STUDY_SQL, body="""
SELECT image_key, condition, CAST(i AS INT) AS repeat, CAST(seed AS INT) AS seed, CAST((row_number() OVER (PARTITION BY i, condition ORDER BY md5(image_key || '#' || seed), image_key) - 1) % 5 + 1 AS INT) AS fold
FROM study, (VALUES (0, 42), (1, 314), (2, 2026)) q(i, seed)"""))
def _(spark, sf):
    images = s.study_images(spark, sf).select("image_key", "condition")
    return splits.stratified_kfold(images, 5, (42, 314, 2026))


@query("inner_fold_count", with_ctes(s.STUDY_SQL, body="""
, c AS (SELECT "TNF_dose", condition, count(*) AS c FROM study GROUP BY ALL)
SELECT "TNF_dose", CAST(least(3, min(c)) AS INT) AS inner_folds FROM c GROUP BY 1"""))
def _(spark, sf):
    return splits.inner_fold_count(s.study_images(spark, sf), 3, ["TNF_dose"])


@query("leave_one_condition_out", with_ctes(s.STUDY_SQL, body="SELECT image_key, condition AS fold FROM study"))
def _(spark, sf):
    return splits.leave_one_condition_out(s.study_images(spark, sf)).select("image_key", "fold")


@query("score_names", """
SELECT DISTINCT p_type || ' / ' || p_brand AS grp, replace(replace(replace(lower(p_type || ' / ' || p_brand), ' / ', '_'), ' ', '_'), '-', '_') || '_ki67_evidence' AS score FROM part""")
def _(spark, sf):
    from petridish.functions.text import score_name_expr

    g = table(spark, sf, "part").select(F.concat_ws(" / ", "p_type", "p_brand").alias("grp")).distinct()
    return g.select("grp", score_name_expr("grp").alias("score"))


@query("formatted_rates", with_ctes(IMAGE_PRED_SQL, body="""
SELECT image_key, CASE WHEN true_ratio IS NULL THEN '-' ELSE format('{:.2f}%', true_ratio * 100) END AS percent, CASE WHEN true_ratio IS NULL THEN '-' ELSE format('{:.2f} pp', (pred_ratio - true_ratio) * 100) END AS points FROM ipred"""))
def _(spark, sf):
    from petridish.functions.text import percent_text, points_text

    return image_predictions(spark, sf).select(
        "image_key",
        percent_text("true_ratio").alias("percent"),
        points_text(F.col("pred_ratio") - F.col("true_ratio")).alias("points"),
    )
