"""The registered model jobs cover the whole job: what they hand to the operators, without fitting."""

import inspect

import pytest

import __spark_entry__ as entry
from petridish.functions.catalog import SINGLE_GROUPS, feature_groups
from petridish.operators import models
from petridish.plans import modelling
from registry import q_models

SF = "/root/testdata/sf0.001"


class Called(Exception):
    pass


def arguments(spark, monkeypatch, name, owner, function):
    """The arguments that the query `name` calls `function` with, defaults included."""
    real = inspect.signature(getattr(owner, function))

    def stop(*args, **more):
        bound = real.bind(*args, **more)
        bound.apply_defaults()
        raise Called(bound.arguments)

    monkeypatch.setattr(owner, function, stop)
    with pytest.raises(Called) as found:
        entry.queries()[name](spark, SF)
    return found.value.args[0]


def test_model_features_hold_every_group(spark):
    assert set(SINGLE_GROUPS) <= set(feature_groups(q_models.MODEL_FEATURES))
    assert set(q_models.MODEL_FEATURES) <= set(q_models.model_cells(spark, SF).columns)


@pytest.mark.parametrize("name", ["train_job", "save_load_model", "predict_job"])
def test_training_runs_all_set_ups(spark, monkeypatch, name):
    got = arguments(spark, monkeypatch, name, modelling, "train_job")
    assert got["configs"] == models.CONFIGS and len(got["configs"]) == 9
    assert got["folds"] == 5 and got["embeddings"] is not None and got["embedding_size"] == 64


def test_ablation_runs_all_items(spark, monkeypatch):
    got = arguments(spark, monkeypatch, "ablation_job", modelling, "ablation_job")
    assert len(modelling.combinations_of_groups()) == 21 and got["combos"] is None
    assert got["formal"] == modelling.FORMAL and got["folds"] == 5
    assert got["embeddings"] is not None and got["embedding_size"] == 64


@pytest.mark.parametrize(
    "name,owner,function",
    [
        ("evidence_model", models, "fit_feature_groups"),
        ("stage1_classifier", models, "stage1_with_oof"),
        ("evaluate_config", modelling, "evaluate_config"),
    ],
)
def test_models_use_all_folds(spark, monkeypatch, name, owner, function):
    got = arguments(spark, monkeypatch, name, owner, function)
    assert got["folds"] == 5
    if name == "evidence_model":
        assert set(got["groups"]) == set(SINGLE_GROUPS)
