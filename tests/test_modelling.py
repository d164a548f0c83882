"""Training, scoring and ablation run whole on a small table, against fits of one set-up at a time."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from petridish.operators import logistic, models, summary
from petridish.plans import modelling
from petridish.sources import sinks

FEATURES = ["GLCM ASM_cyto", "GLCM Contrast_cyto", "Mean_nuc", "Halo Outer Mean", "Area_cyto"]
CONFIGS = (
    models.Config("texture_attachment_s1", "a", True, False, "none", "S1", ("Texture", "Attachment / spreading")),
    models.Config("vectors_s4", "b", True, True, "selected", "S4", ("Texture", "Halo / rounding")),
    models.Config("all_s0", "c", False, False, "all", "S0"),
)


@pytest.fixture(scope="module")
def cells(spark):
    random = np.random.default_rng(6)
    rows = []
    for i in range(36):
        share = random.uniform(0.2, 0.8)
        for c in range(25):
            y = int(random.random() < share)
            x = random.normal(size=5) + y * np.array([1.2, 0.4, 0.8, 0.0, -0.5])
            rows.append((i * 100 + c, f"f{i % 3}", f"img{i}.tif", f"f{i % 3}::{i}", f"p{i % 2}", y, *map(float, x)))
    schema = "cell_id bigint, source_folder string, Image string, image_key string, passage string, ki67_label int, "
    frame = spark.createDataFrame(rows, schema + ", ".join(f"`{f}` double" for f in FEATURES))
    return frame.withColumn("Cell_ID", F.col("cell_id").cast("string")).repartition(4).cache()


@pytest.fixture(scope="module")
def vectors(spark):
    random = np.random.default_rng(7)
    return spark.createDataFrame([(f"f{i % 3}::{i}", random.normal(size=4).tolist()) for i in range(30)], "image_key string, embedding array<float>")


@pytest.fixture(scope="module")
def trained(spark, cells, vectors, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("model"))
    metrics, bundle = modelling.train_job(cells, FEATURES, vectors, 4, CONFIGS, folds=3, top_k=3, path=path)
    return metrics.collect(), bundle, path


def test_train_measures_every_set_up(cells, trained):
    rows, bundle, _ = trained
    assert {r["config_key"] for r in rows} == {c.key for c in CONFIGS} and bundle["config"].key == CONFIGS[0].key
    errors = [r["test_image_mae"] for r in rows]
    assert errors == sorted(errors) and all(r["test_cell_accuracy"] > 0.6 for r in rows)
    own = next(r for r in rows if r["config_key"] == CONFIGS[0].key)
    for r in summary.cell_metrics(bundle["cells"]).collect():
        assert math.isclose(own[f"{r['split']}_cell_accuracy"], r["accuracy"])
    for r in summary.image_metrics(bundle["images"]).collect():
        assert math.isclose(own[f"{r['split']}_image_mae"], r["image_mae"])
    assert bundle["cells"].count() == cells.count()


def test_batched_set_ups_as_one_at_a_time(cells, vectors, trained):
    """A set-up alone gives the metrics and coefficients it has among the others."""
    rows, bundle, _ = trained
    data = modelling.prepare(cells)
    data = modelling.with_folds(data, 3, "cell_id")
    scored, _, names = modelling.score_groups(data, FEATURES, {"Texture", "Attachment / spreading", "Halo / rounding"}, "cell_id")
    row, parts = modelling.evaluate_config(scored.drop("fold", *names), CONFIGS[0], scored.select("cell_id", *names), folds=3)
    own = next(r for r in rows if r["config_key"] == CONFIGS[0].key)
    for name, value in row.items():
        assert own[name] == value if isinstance(value, (str, int)) else math.isclose(own[name], value, abs_tol=1e-9), name
    np.testing.assert_allclose(parts["stage1"].weights, bundle["stage1"].weights, atol=1e-8)
    # the coefficients are those of a fit on the set-up's own matrix
    matrix, columns = models.stage1_matrix(scored.filter("split = 'train'"), CONFIGS[0], scored.select("cell_id", *names), None, None)
    alone = models.fit_stage1(matrix, columns)
    assert columns == bundle["stage1"].columns
    np.testing.assert_allclose(alone.weights, bundle["stage1"].weights, atol=1e-6)


def test_scores_after_saving_are_the_same(spark, cells, trained, tmp_path):
    _, bundle, path = trained
    expected = cells.select("source_folder", F.col("Image").alias("image_name")).distinct()
    expected = expected.union(spark.createDataFrame([("f0", "lost.tif")], "a string, b string"))
    out = str(tmp_path / "out")
    scored, images, folders = modelling.predict_job(cells, models.load_model(spark, path), expected=expected, path=out)
    again = modelling.predict_job(cells, bundle)[1]
    both = images.select("image_key", "pred_ratio").join(again.select("image_key", F.col("pred_ratio").alias("x")), "image_key")
    assert both.count() == 36 and both.filter(F.abs(F.col("pred_ratio") - F.col("x")) > 1e-12).count() == 0
    counts = {r["source_folder"]: r for r in folders.collect()}
    assert counts["f0"]["missing_image_count"] == 1 and counts["f1"]["missing_image_count"] == 0
    assert counts["f0"]["used_image_count"] == 12
    sheets = spark.read.parquet(f"{out}/sheets/image_features")
    assert sheets.filter("feature = 'Mean_nuc_median'").count() == 0  # its group is not in the model
    texture = sheets.filter("feature = 'GLCM ASM_cyto_median'")
    assert texture.select("image_name").distinct().count() == 36
    metrics = spark.read.parquet(f"{out}/sheets/metrics")
    assert {(r["level"], r["metric"]) for r in metrics.collect()} >= {("cell", "accuracy"), ("image", "image_mae")}
    assert spark.read.parquet(f"{out}/sheets/cells").count() == cells.count()


def test_ablation_lists_every_item(cells, vectors):
    combos = [("Texture",), ("Halo / rounding",), ("Mitosis likelihood",)]
    got = modelling.ablation_job(cells, FEATURES, vectors, 4, combos, [("Texture", "Halo / rounding")], folds=2).collect()
    assert [(r["item"], r["feature_combo"], r["with_image_embedding"]) for r in got] == [
        ("feature_combo", "Texture", False), ("feature_combo", "Texture", True),
        ("feature_combo", "Halo", False) if got[2]["feature_combo"] == "Halo" else ("feature_combo", got[2]["feature_combo"], False),
        ("feature_combo", got[3]["feature_combo"], True),
        ("formal", got[4]["feature_combo"], False), ("formal", got[5]["feature_combo"], True),
    ]
    assert [r["stage1_feature_count"] for r in got] == [1, 5, 1, 5, 2, 6]
    assert all(r["test_cell_roc_auc"] is not None for r in got)


def test_too_many_passages_are_refused(cells, monkeypatch):
    monkeypatch.setattr(modelling, "PASSAGES", 1)
    with pytest.raises(ValueError, match="passages"):
        modelling.train_job(cells, FEATURES, configs=[models.Config("x", "x", False, False, "all", "S3")], folds=2)


def test_summary_without_labels(spark):
    cells = spark.createDataFrame([("f", 0.6), ("f", 0.2), ("g", None)], "source_folder string, cell_prob double")
    images = spark.createDataFrame([("f", "a", 0.4, 2)], "source_folder string, image_key string, pred_ratio double, cell_count int")
    got = {(r.source_folder, r.level, r.metric): r.value for r in sinks.prediction_summary(cells, images).collect()}
    assert got["f", "cell", "predicted_positive_ratio"] == 0.5 and got["g", "cell", "cell_num"] == 0
    assert got["f", "image", "pred_ratio_weighted"] == 0.4 and got["f", "image", "true_ratio"] is None


def test_unknown_folds_take_the_whole_model():
    model = logistic.Logistic(["a"], [1.0], 0.0, {})
    assert model.probability({"a": np.array([0.0])}).tolist() == [0.5]
