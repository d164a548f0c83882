"""Two-stage Ki67 models and the dose-study regressions, fitted as Spark jobs.

Classifiers are logistic regressions, all folds and set-ups of a job in the same passes (see
`logistic`). Linear regressions are solved from sums of squares and products that Spark adds up
over all rows; only those small sums and the coefficients reach the driver.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from petridish.functions.numeric import clip, number
from petridish.functions.text import score_name
from petridish.operators.logistic import Fit, Logistic, fit_all, predict_all
from petridish.operators.pairing import attach_embeddings
from petridish.operators.scale import rank_within, summarise, with_group_stats
from petridish.operators.splits import draw, group_kfold, image_balanced_weight
from petridish.session import materialize
from petridish.sources.sinks import load_json, save_json

# Fixed value: probability summary columns of the second stage.
PROBABILITY_SUMMARY = (
    "mean_cell_prob", "median_cell_prob", "p90_cell_prob", "frac_prob_gt_0_3",
    "frac_prob_gt_0_5", "frac_prob_gt_0_7", "cell_count",
)


@dataclass(frozen=True)
class Config:
    """One model set-up: first-stage inputs and second-stage mode."""

    key: str
    display_name: str
    scores: bool
    embedding: bool
    parameters: str  # none, selected or all
    stage2: str  # S0, S1, S3 or S4
    groups: tuple[str, ...] | None = None


_STANDARD = ("Texture", "Intensity distribution", "Halo / rounding")

# The nine preset set-ups.
CONFIGS = (
    Config("texture_attachment_s1", "Texture + Attachment / S1 no embedding", True, False, "none", "S1",
           ("Texture", "Attachment / spreading")),
    Config("feature_cnn_s0", "Feature + CNN embedding / S0 direct mean", True, True, "none", "S0", _STANDARD),
    Config("feature_cnn_s1", "Feature + CNN embedding / S1 probability summary", True, True, "none", "S1", _STANDARD),
    Config("feature_cnn_s3", "Feature + CNN embedding / S3 probability + passage", True, True, "none", "S3", _STANDARD),
    Config("feature_cnn_selected_s1", "Feature + CNN embedding + selected parameters / S1", True, True, "selected", "S1", _STANDARD),
    Config("feature_cnn_selected_s4", "Feature + CNN embedding + selected parameters / S4", True, True, "selected", "S4", _STANDARD),
    Config("feature_only_s1", "Feature only / S1 baseline", True, False, "none", "S1", _STANDARD),
    Config("cnn_only_s1", "CNN embedding only / S1 baseline", False, True, "none", "S1"),
    Config("parameters_only_s1", "Feature parameters only / S1 baseline", False, False, "all", "S1"),
)


# --- table preparation ------------------------------------------------------------------


@dataclass
class TableTransform:
    """Median imputation and standardisation, learned on the training rows."""

    features: list[str]
    median: dict[str, float] = field(default_factory=dict)
    mean: dict[str, float] = field(default_factory=dict)
    std: dict[str, float] = field(default_factory=dict)

    def scaling(self) -> dict[str, tuple[float, float, float]]:
        return {f: (self.median[f], self.mean[f], self.std[f]) for f in self.features}

    def fill(self, feature: str) -> float:
        """What an absent value becomes."""
        return (self.median[feature] - self.mean[feature]) / self.std[feature]

    def expr(self, feature: str) -> Column:
        value = F.coalesce(number(f"`{feature}`"), F.lit(self.median[feature]))
        return (value - F.lit(self.mean[feature])) / F.lit(self.std[feature])

    def apply(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        missing = [f for f in self.features if f not in df.columns]
        for f in missing:
            df = df.withColumn(f, F.lit(None).cast("double"))
        return df.select(*keep, *[self.expr(f).alias(f) for f in self.features])


def fit_table_transform(
    df: DataFrame, features: Sequence[str]
) -> TableTransform:
    """Exact medians, then mean and deviation of the imputed columns.

    A column without any value is kept as zeros; a constant column keeps scale 1.
    """
    features = list(features)
    clean = df.select(*[number(f"`{f}`").alias(f) for f in features])
    row = summarise(clean, [], {}, {f: (f, 0.5) for f in features}).first()
    medians = {f: 0.0 if row[f] is None else float(row[f]) for f in features}
    filled = clean.select(*[F.coalesce(f"`{f}`", F.lit(medians[f])).alias(f) for f in features])
    stats = filled.agg(
        *[F.avg(f"`{f}`").alias(f"m{i}") for i, f in enumerate(features)],
        *[F.stddev_pop(f"`{f}`").alias(f"s{i}") for i, f in enumerate(features)],
    ).first()
    return TableTransform(
        features,
        medians,
        {f: float(stats[f"m{i}"] or 0.0) for i, f in enumerate(features)},
        {f: float(stats[f"s{i}"] or 0.0) or 1.0 for i, f in enumerate(features)},
    )


def fold_transforms(
    df: DataFrame, features: Sequence[str], fold: str = "fold"
) -> dict[int | None, TableTransform]:
    """Transform of every training set that leaves one fold out, and of all rows (None).

    Medians of a training set skip the held-out rows inside one pass; means and deviations come
    from sums per fold, each set being the total without its fold.
    """
    features = list(features)
    clean = df.select(F.col(fold).cast("int").alias("_fold"), *[number(f"`{f}`").alias(f"_{i}") for i, f in enumerate(features)])
    sets = [r[0] for r in clean.select("_fold").distinct().collect()]
    sets = [*sorted(k for k in sets if k is not None), None]
    columns = {
        f"{i}/{k}": F.col(f"_{i}") if k is None else F.when(F.coalesce(F.col("_fold"), F.lit(-1)) != k, F.col(f"_{i}"))
        for k in sets
        for i in range(len(features))
    }
    row = summarise(clean.select(*[c.alias(n) for n, c in columns.items()]), [], {}, {n: (n, 0.5) for n in columns}).first()
    middle = {n: 0.0 if row[n] is None else float(row[n]) for n in columns}
    values = [F.col(f"_{i}") for i in range(len(features))]
    sums = clean.groupBy("_fold").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(v).alias(f"c{i}") for i, v in enumerate(values)],
        *[F.coalesce(F.avg(v), F.lit(0.0)).alias(f"m{i}") for i, v in enumerate(values)],
        *[F.coalesce(F.var_pop(v), F.lit(0.0)).alias(f"v{i}") for i, v in enumerate(values)],
    ).collect()
    out = {}
    for k in sets:
        own = [r for r in sums if k is None or r["_fold"] != k]
        n = sum(r["n"] for r in own)
        median = {f: middle[f"{i}/{k}"] for i, f in enumerate(features)}
        mean, std = {}, {}
        for i, f in enumerate(features):
            # nulls count as the median
            parts = [(r[f"c{i}"], r[f"m{i}"], r[f"v{i}"]) for r in own]
            parts.append((n - sum(c for c, _, _ in parts), median[f], 0.0))
            mean[f] = sum(c * m for c, m, _ in parts) / n if n else 0.0
            spread = sum(c * (v + (m - mean[f]) ** 2) for c, m, v in parts) / n if n else 0.0
            std[f] = float(np.sqrt(spread)) or 1.0
        out[k] = TableTransform(features, median, mean, std)
    return out


def anova_f(df: DataFrame, features: Sequence[str], label: str = "ki67_label") -> DataFrame:
    """One-way ANOVA F of every feature against the label, from group sums."""
    features = list(features)
    long = df.select(F.col(label).alias("_y"), *[number(f"`{f}`").alias(f) for f in features]).unpivot(
        ["_y"], features, "feature", "v"
    )
    per_class = long.filter("v is not null").groupBy("feature", "_y").agg(
        F.count(F.lit(1)).alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("var")
    )
    total = with_group_stats(
        per_class, ["feature"], _n=F.sum("n"), _m=F.sum(F.col("n") * F.col("m"))
    ).withColumn("_m", F.col("_m") / F.col("_n"))
    gap = F.col("m") - F.col("_m")
    out = total.groupBy("feature", "_n").agg(
        F.sum(F.col("n") * gap * gap).alias("_between"),
        F.sum(F.col("n") * F.col("var")).alias("_within"),
        F.count(F.lit(1)).alias("_k"),
    )
    return out.select(
        "feature",
        F.try_divide(
            F.col("_between") / (F.col("_k") - 1), F.col("_within") / (F.col("_n") - F.col("_k"))
        ).alias("f_value"),
    ).filter("f_value is not null")


def select_k_best(df: DataFrame, features: Sequence[str], k: int = 40) -> list[str]:
    """Names of the ``k`` features with the largest F (after median imputation)."""
    t = fit_table_transform(df, features)
    filled = df.select(
        "ki67_label",
        *[F.coalesce(number(f"`{f}`"), F.lit(t.median[f])).alias(f) for f in features],
    )
    best = anova_f(filled, features).orderBy(F.desc("f_value"), "feature").limit(k).collect()
    return [r["feature"] for r in best]


# --- classifiers ------------------------------------------------------------------------


def positive_probability(vector: Column | str = "probability") -> Column:
    return vector_to_array(F.col(vector) if isinstance(vector, str) else vector)[1]


def sigmoid(margin: Column | str) -> Column:
    m = F.col(margin) if isinstance(margin, str) else margin
    return 1.0 / (1.0 + F.exp(-m))


def evidence_fit(columns: Sequence[str], transform: TableTransform, fold: int | None = None) -> Fit:
    """Image-balanced elastic-net logistic regression on standardised columns."""
    return Fit(tuple(columns), fold, transform.scaling(), l1=1e-4 * 0.15, l2=1e-4 * 0.85)


def fit_evidence(folded: DataFrame, groups: Mapping[str, Sequence[str]]) -> dict[tuple[str, int | None], Logistic]:
    """Evidence models of every feature group, for each training set without a fold and for all rows.

    ``folded`` has image_key, ki67_label, fold and the features; groups without a present column are
    left out.
    """
    groups = {g: [c for c in columns if c in folded.columns] for g, columns in groups.items()}
    groups = {g: columns for g, columns in groups.items() if columns}
    features = list(dict.fromkeys(c for columns in groups.values() for c in columns))
    transforms = fold_transforms(folded, features)
    fits = {(g, k): evidence_fit(columns, t, k) for k, t in transforms.items() for g, columns in groups.items()}
    weighted = image_balanced_weight(folded.select("image_key", "ki67_label", "fold", *[f"`{c}`" for c in features]))
    return fit_all(materialize(weighted.drop("image_key")), fits, "ki67_label", "weight")


def evidence_scores(
    df: DataFrame, models: Mapping[tuple[str, int | None], Logistic], row: str = "cell_id", fold: str | None = "fold"
) -> DataFrame:
    """``row`` and one score column per group; rows with a fold are scored by the model without it."""
    groups = [g for g, k in models if k is None]
    found = predict_all(df, [row], models, groups, fold)
    return found.select(row, *[F.col("probability")[i].alias(score_name(g)) for i, g in enumerate(groups)])


def fit_feature_groups(
    train: DataFrame, groups: Mapping[str, Sequence[str]], folds: int = 5, row: str = "cell_id"
) -> tuple[dict, DataFrame]:
    """Evidence models per feature group and out-of-fold scores of the training cells.

    Folds hold whole images. Returns ``{group: model}`` and ``row, scores…``.
    """
    folded = materialize(group_kfold(train, "image_key", folds))
    models = fit_evidence(folded, groups)
    return {g: m for (g, k), m in models.items() if k is None}, evidence_scores(folded, models, row)


def score_feature_groups(df: DataFrame, models: Mapping[str, Logistic], row: str = "cell_id") -> DataFrame:
    """Evidence scores of new cells: one column per group."""
    missing = {c for m in models.values() for c in m.columns} - set(df.columns)
    df = df.withColumns({c: F.lit(None).cast("double") for c in missing})
    return evidence_scores(df, {(g, None): m for g, m in models.items()}, row, None)


def stage1_matrix(
    cells: DataFrame,
    config: Config,
    scores: DataFrame | None,
    embeddings: DataFrame | None,
    transform: TableTransform | None,
    columns: Sequence[str] | None = None,
    embedding_size: int = 0,
    row: str = "cell_id",
) -> tuple[DataFrame, list[str]]:
    """First-stage inputs: evidence scores, image vector, standardised parameters.

    With ``columns`` from training the matrix is aligned to them, 0 where absent.
    """
    keep = [row, "image_key", *(["ki67_label"] if "ki67_label" in cells.columns else [])]
    names: list[str] = []
    table = {f"param_{i:03d}": f for i, f in enumerate(transform.features)} if config.parameters != "none" else {}
    given = set(cells.columns)
    out = cells.select(
        *keep,
        *[(transform.expr(f) if f in given else F.lit(transform.fill(f))).alias(p) for p, f in table.items()],
    )
    if config.scores:
        wanted = [score_name(g) for g in config.groups] if config.groups else [c for c in scores.columns if c != row]
        present = [c for c in wanted if c in scores.columns]
        out = out.join(scores.select(row, *present), row)
        names += present
    if config.embedding:
        out = attach_embeddings(out, embeddings, embedding_size)
        vector = [f"cnn_emb_{i:04d}" for i in range(embedding_size)]
        out = out.select(
            *[c for c in out.columns if c != "embedding"],
            *[F.col("embedding")[i].cast("double").alias(v) for i, v in enumerate(vector)],
        )
        names += vector
    names += list(table)
    if not names:
        raise ValueError(f"set-up {config.key} has no first-stage input")
    target = list(columns) if columns is not None else names
    return (
        out.select(
            *keep,
            *[
                F.coalesce(number(f"`{c}`"), F.lit(0.0)).alias(c) if c in names else F.lit(0.0).alias(c)
                for c in target
            ],
        ),
        target,
    )


def stage1_columns(
    config: Config, scores: Sequence[str], transforms: Mapping[str, TableTransform | None], embedding_size: int
) -> list[str]:
    """Names of a set-up's first-stage inputs, as `stage1_matrix` gives them."""
    names: list[str] = []
    if config.scores:
        names += [score_name(g) for g in config.groups if score_name(g) in scores] if config.groups else list(scores)
    if config.embedding:
        names += [f"cnn_emb_{i:04d}" for i in range(embedding_size)]
    if config.parameters != "none":
        names += [f"param_{i:03d}" for i in range(len(transforms[config.parameters].features))]
    if not names:
        raise ValueError(f"set-up {config.key} has no first-stage input")
    return names


def stage1_inputs(
    data: DataFrame,
    configs: Sequence[Config],
    scores: Sequence[str],
    embeddings: DataFrame | None,
    transforms: Mapping[str, TableTransform | None],
    embedding_size: int = 0,
    row: str = "cell_id",
) -> tuple[DataFrame, list[list[str]]]:
    """First-stage inputs of all set-ups in one table, each once, and the columns of each set-up.

    ``data`` has the score columns, split and fold. The vectors are the only join.
    """
    given, exprs, columns = set(data.columns), {}, []
    for config in configs:
        own = []
        for name in stage1_columns(config, scores, transforms, embedding_size):
            if name.startswith("param_"):
                t = transforms[config.parameters]
                feature = t.features[int(name[6:])]
                place = f"{config.parameters}_{name}"
                exprs[place] = F.coalesce(t.expr(feature) if feature in given else F.lit(t.fill(feature)), F.lit(0.0))
            elif name.startswith("cnn_emb_"):
                place = name
                exprs[place] = F.coalesce(number(F.col("embedding")[int(name[8:])].cast("double")), F.lit(0.0))
            else:
                place = name
                exprs[place] = F.coalesce(number(f"`{name}`"), F.lit(0.0))
            own.append(place)
        columns.append(own)
    if any(c.embedding for c in configs):
        data = attach_embeddings(data, embeddings, embedding_size)
    return data.select(row, "image_key", "split", "fold", "ki67_label", *[e.alias(n) for n, e in exprs.items()]), columns


def stage1_fit(columns: Sequence[str], fold: int | None = None) -> Fit:
    """Class-balanced ridge logistic regression (penalty 1/2·|w|² against the summed loss)."""
    return Fit(tuple(columns), fold, ridge=1.0, balanced=True)


def fit_stage1(matrix: DataFrame, columns: Sequence[str]) -> Logistic:
    rows = matrix.withColumn("fold", F.lit(None).cast("int"))
    return fit_all(rows, {0: stage1_fit(columns)}, "ki67_label")[0]


def predict_stage1(model: Logistic, matrix: DataFrame, columns: Sequence[str], row: str = "cell_id") -> DataFrame:
    found = predict_all(matrix, [row], {(0, None): model}, [0], None)
    return found.select(row, F.col("probability")[0].alias("cell_prob"))


def stage1_with_oof(
    matrix: DataFrame, columns: Sequence[str], folds: int = 5, row: str = "cell_id"
) -> tuple[Logistic, DataFrame]:
    """Final classifier and out-of-fold probabilities, folds by whole images."""
    folded = materialize(group_kfold(matrix, "image_key", folds))
    used = [r[0] for r in folded.select("fold").distinct().collect()]
    fitted = fit_all(folded, {(0, k): stage1_fit(columns, k) for k in [*sorted(used), None]}, "ki67_label")
    found = predict_all(folded, [row], fitted, [0])
    return fitted[0, None], found.select(row, F.col("probability")[0].alias("cell_prob"))


# --- second stage -----------------------------------------------------------------------


def stage2_columns(mode: str, passages: Sequence[str], scores: Sequence[str]) -> list[str]:
    mode = mode.upper()
    if mode == "S0":
        return []
    out = list(PROBABILITY_SUMMARY)
    if mode in ("S3", "S4"):
        out += [f"passage_{p}" for p in sorted(passages)]
    if mode == "S4":
        out += [f"{s}_{t}" for s in scores for t in ("mean", "median")]
    return out


def stage2_matrix(images: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Second-stage design columns; passage dummies and absent columns are 0."""
    return images.select(*keep, *[e.alias(c) for c, e in zip(columns, _design_columns(images, columns))])


def _design_columns(images: DataFrame, columns: Sequence[str]) -> list[Column]:
    exprs, given = [], set(images.columns)
    for c in columns:
        if c.startswith("passage_"):
            exprs.append(F.coalesce((F.col("passage") == c[len("passage_"):]).cast("double"), F.lit(0.0)))
        elif c in given:
            exprs.append(F.coalesce(number(f"`{c}`"), F.lit(0.0)))
        else:
            exprs.append(F.lit(0.0))
    return exprs


def grouped_moments(df: DataFrame, key: str, columns: Sequence[str]) -> dict:
    """Per key: rows, means and centred sums of products of ``columns``, merged where the rows are."""
    columns = list(columns)

    def merge(a, b):
        n = a[0] + b[0]
        gap = b[1] - a[1]
        return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for batch in batches:
            for k, part in batch.groupby("_key"):
                x = part[names].to_numpy(dtype="float64")
                mean = x.mean(axis=0)
                own = (float(len(x)), mean, (x - mean).T @ (x - mean))
                sums[k] = merge(sums[k], own) if k in sums else own
        if sums:  # an empty frame has no arrays in its columns
            yield pd.DataFrame({"_key": list(sums), "s": [np.concatenate([[n], m, g.ravel()]) for n, m, g in sums.values()]})

    def read(s):
        p = len(names)
        s = np.asarray(s)
        return float(s[0]), s[1 : p + 1], s[p + 1 :].reshape(p, p)

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = None
        for s in group["s"]:
            total = read(s) if total is None else merge(total, read(s))
        n, mean, gram = total
        return pd.DataFrame({"_key": group["_key"].iloc[:1], "s": [np.concatenate([[n], mean, gram.ravel()])]})

    names = [f"_{i}" for i in range(len(columns))]
    kind = df.schema[key].dataType.simpleString()
    parts = df.select(F.col(key).alias("_key"), *[F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(columns, names)])
    schema = f"_key {kind}, s array<double>"
    parts = parts.mapInPandas(partial, schema).withColumn("_branch", F.pmod(F.spark_partition_id(), F.lit(64)))
    near = parts.groupBy("_key", "_branch").applyInPandas(lambda g: add(g), schema)
    return {r["_key"]: read(r["s"]) for r in near.groupBy("_key").applyInPandas(add, schema).collect()}


def solve_ridge(moments: tuple, order: Sequence[str], columns: Sequence[str], target: str, alpha: float = 1.0) -> dict[str, float]:
    """Ridge with intercept from moments over ``order``; ``{column: weight, _intercept}``."""
    _, mean, gram = moments
    at, y = [order.index(c) for c in columns], order.index(target)
    w = np.linalg.solve(gram[np.ix_(at, at)] + alpha * np.eye(len(at)), gram[at, y])
    return {**{c: float(v) for c, v in zip(columns, w)}, "_intercept": float(mean[y] - w @ mean[at])}


def fit_ridge(df: DataFrame, columns: Sequence[str], target: str, alpha: float = 1.0) -> dict[str, float]:
    order = [*columns, target]
    moments = grouped_moments(df.withColumn("_one", F.lit(0)), "_one", order)
    return solve_ridge(moments[0], order, list(columns), target, alpha)


def predict_ratio(images: DataFrame, mode: str, weights: Mapping[str, float] | None) -> DataFrame:
    """``pred_ratio`` in [0, 1]: the linear model, or the mean probability for S0."""
    return predict_ratios(images.withColumn("_slot", F.lit(0)), "_slot", [weights if mode.upper() != "S0" else None]).drop("_slot")


def predict_ratios(images: DataFrame, slot: str, weights: Sequence[Mapping[str, float] | None]) -> DataFrame:
    """``pred_ratio`` by the linear model of the row's slot; the mean probability where it has none."""
    columns = list(dict.fromkeys(c for w in weights if w for c in w if c != "_intercept"))
    design = F.array(*[c.cast("double") for c in _design_columns(images, columns)], F.lit(1.0))
    each = [
        F.array(*[F.lit(float((w or {}).get(c, 0.0))) for c in columns], F.lit(float((w or {}).get("_intercept", 0.0))))
        for w in weights
    ]
    product = F.zip_with(design, F.get(F.array(*each), F.col(slot)), lambda x, w: x * w)
    value = F.aggregate(product, F.lit(0.0), lambda total, x: total + x)
    plain = F.get(F.array(*[F.lit(w is None) for w in weights]), F.col(slot))
    return images.withColumn("pred_ratio", clip(F.when(plain, F.col("mean_cell_prob")).otherwise(value), 0.0, 1.0))


# --- persistence ------------------------------------------------------------------------


def save_model(spark: SparkSession, path: str, bundle: Mapping) -> None:
    """Model bundle as one JSON document."""
    document = {
        "config": asdict(bundle["config"]),
        "stage1_columns": list(bundle["stage1_columns"]),
        "stage2_weights": bundle["stage2_weights"],
        "threshold": bundle.get("threshold", 0.5),
        "embedding_size": bundle.get("embedding_size", 0),
        "groups": {g: asdict(m) for g, m in bundle.get("groups", {}).items()},
        "stage1": asdict(bundle["stage1"]),
        "transform": asdict(bundle["transform"]) if bundle.get("transform") else None,
    }
    save_json(spark, document, f"{path}/bundle")


def load_model(spark: SparkSession, path: str) -> dict:
    d = load_json(spark, f"{path}/bundle")
    config = dict(d["config"])
    config["groups"] = tuple(config["groups"]) if config["groups"] else None
    return {
        "config": Config(**config),
        "stage1_columns": d["stage1_columns"],
        "stage2_weights": d["stage2_weights"],
        "threshold": d["threshold"],
        "embedding_size": d["embedding_size"],
        "transform": TableTransform(**d["transform"]) if d["transform"] else None,
        "groups": {g: Logistic(**m) for g, m in d["groups"].items()},
        "stage1": Logistic(**d["stage1"]),
    }


# --- dose study regressions -------------------------------------------------------------

DOSE = ["IFN_dose", "TNF_dose", "IFN_x_TNF"]

# The compared models and their tuning grids.
STUDY_MODELS = {
    "dummy_median": "dummy",
    "dose_ridge": "dose",
    "morphology_ridge": "morphology",
    "morphology_elasticnet": "morphology",
    "dose_plus_morphology_ridge": "both",
}
STUDY_GRID = {
    "outer_splits": 5,
    "inner_splits": 3,
    "seeds": (42, 314, 2026),
    "loco_seed": 42,
    "final_seed": 42,
    "ridge_alphas": (0.01, 0.1, 1.0, 10.0, 100.0, 1000.0),
    "elasticnet_alphas": (0.001, 0.01, 0.1, 1.0),
    "elasticnet_l1_ratios": (0.1, 0.5, 0.9),
    "elasticnet_max_iter": 50000,
}


def dose_interaction(images: DataFrame) -> DataFrame:
    """Add IFN × TNF; infinities become NULL."""
    out = images.withColumn("IFN_x_TNF", F.col("IFN_dose") * F.col("TNF_dose"))
    return out.select(*[number(f"`{c}`").alias(c) if t == "double" else F.col(f"`{c}`") for c, t in out.dtypes])


def _model_features(model: str, morphology: Sequence[str]) -> list[str]:
    kind = STUDY_MODELS[model]
    return {"dummy": [], "dose": DOSE, "morphology": list(morphology), "both": [*DOSE, *morphology]}[kind]


def _grid(model: str, grid: Mapping) -> list[dict]:
    if model == "dummy_median":
        return [{}]
    if model == "morphology_elasticnet":
        return [
            {"alpha": float(a), "l1_ratio": float(l)}
            for a in grid["elasticnet_alphas"]
            for l in grid["elasticnet_l1_ratios"]
        ]
    return [{"alpha": float(a)} for a in grid["ridge_alphas"]]


def solve_linear(gram: np.ndarray, cross: np.ndarray, n: float, params: Mapping, max_iter: int = 50000) -> np.ndarray:
    """Weights on standardised columns from ``X'X`` and ``X'y``: ridge or elastic net."""
    if "l1_ratio" not in params:
        return np.linalg.solve(gram + params["alpha"] * np.eye(len(cross)), cross)
    l1 = params["alpha"] * params["l1_ratio"] * n
    l2 = params["alpha"] * (1.0 - params["l1_ratio"]) * n
    w = np.zeros(len(cross))
    residual = cross.copy()
    diagonal = np.diag(gram)
    for _ in range(max_iter):
        largest = 0.0
        for j in range(len(w)):
            if diagonal[j] == 0.0:
                continue
            rho = residual[j] + diagonal[j] * w[j]
            new = np.sign(rho) * max(abs(rho) - l1, 0.0) / (diagonal[j] + l2)
            step = new - w[j]
            if step != 0.0:
                residual -= gram[:, j] * step
                w[j] = new
                largest = max(largest, abs(step))
        if largest < 1e-9 * max(1.0, float(np.abs(w).max())):
            break
    return w


@dataclass
class _Moments:
    """Centred, standardised sums of one training set."""

    n: float
    median: np.ndarray
    mean: np.ndarray
    std: np.ndarray
    gram: np.ndarray
    cross: np.ndarray
    y_mean: float
    y_median: float


Task = tuple[int, int, int]  # repeat, number of the fold left out, inner fold left out (-1: none)


def _added(parts: DataFrame, key: str, schema: str) -> DataFrame:
    """Element-wise sums of ``s`` per key, in two rounds."""

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: group[key].iloc[:1], "s": [np.sum(np.stack(group["s"]), axis=0)]})

    parts = parts.withColumn("_branch", F.pmod(F.spark_partition_id(), F.lit(64)))
    near = parts.groupBy(key, "_branch").applyInPandas(lambda g: add(g), schema)
    return near.groupBy(key).applyInPandas(add, schema)


def _task_medians(rows: DataFrame, wanted: Mapping[str, Sequence[Task]]) -> dict[tuple[str, Task], float]:
    """Median of a column over the rows of each training set, without copying a row per set."""
    inner = lambda i: F.get("_inner", i)
    member = {
        t: (F.col("repeat") == t[0]) & (inner(t[1]) >= 0) & (inner(t[1]) != t[2])
        for t in dict.fromkeys(t for tasks in wanted.values() for t in tasks)
    }
    work = [(c, t) for c, tasks in wanted.items() for t in tasks]
    found: dict[tuple[str, Task], float] = {}
    for at in range(0, len(work), 200):
        part = {f"m{i}": (c, t) for i, (c, t) in enumerate(work[at : at + 200])}
        columns = [F.when(member[t], F.col(f"`{c}`")).alias(n) for n, (c, t) in part.items()]
        row = summarise(rows.select(*columns), [], {}, {n: (n, 0.5) for n in part}).first()
        found.update({ct: 0.0 if row[n] is None else float(row[n]) for n, ct in part.items()})
    return found


def training_moments(rows: DataFrame, features: Sequence[str], target: str, sets: Mapping[tuple[int, int], int]) -> dict[Task, _Moments]:
    """Medians, scales and sums of products of every training set.

    ``rows`` has repeat and ``_inner``: for each fold the inner fold of the row, -1 where the row is
    held out. ``sets`` gives the number of inner folds. Every row is read once; sums are kept per
    (repeat, fold, inner fold), and a training set is the total without its held-out part. Nulls are
    summed as indicators, so a set's medians are put in afterwards.
    """
    features = list(features)
    p = len(features)
    known = rows.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(f"`{f}`").alias(f"c{i}") for i, f in enumerate(features)],
        *[F.avg(f"`{f}`").alias(f"a{i}") for i, f in enumerate([*features, target])],
    ).first()
    centre = np.array([known[f"a{i}"] or 0.0 for i in range(p + 1)])
    holes = [i for i in range(p) if known[f"c{i}"] < known["n"]]
    q = p + len(holes) + 2

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            x = batch[[*features, target]].to_numpy(dtype="float64") - centre
            empty = np.isnan(x[:, holes]).astype("float64")
            z = np.column_stack([np.ones(len(x)), np.nan_to_num(x[:, :p]), empty, x[:, p]])
            inner, repeat = np.stack(batch["_inner"].to_numpy()), batch["repeat"].to_numpy()
            for (r, f), g in sets.items():
                for k in range(g):
                    own = z[(repeat == r) & (inner[:, f] == k)]
                    if len(own):
                        name = f"{r}|{f}|{k}"
                        sums[name] = sums.get(name, 0.0) + own.T @ own
        if sums:  # an empty frame has no arrays in its columns
            yield pd.DataFrame({"task": list(sums), "s": [m.ravel() for m in sums.values()]})

    schema = "task string, s array<double>"
    parts = rows.select("repeat", "_inner", *[f"`{f}`" for f in features], target).mapInPandas(partial, schema)
    blocks = {r["task"]: np.array(r["s"]).reshape(q, q) for r in _added(parts, "task", schema).collect()}
    tasks = [(r, f, k) for (r, f), g in sets.items() for k in range(-1, g)]
    medians = _task_medians(
        rows, {target: [t for t in tasks if t[2] == -1], **{features[i]: tasks for i in holes}}
    )
    out = {}
    for r, f, k in tasks:
        own = [blocks.get(f"{r}|{f}|{i}", np.zeros((q, q))) for i in range(sets[r, f])]
        total = np.sum(own, axis=0) - (own[k] if k >= 0 else 0.0)
        # imputed columns: a null moves from the centre to the median
        turn = np.zeros((p + 2, q))
        turn[: p + 1, : p + 1] = np.eye(p + 1)
        turn[p + 1, q - 1] = 1.0
        median = centre[:p].copy()
        for j, i in enumerate(holes):
            median[i] = medians[features[i], (r, f, k)]
            turn[1 + i, p + 1 + j] = median[i] - centre[i]
        m = turn @ total @ turn.T
        n = m[0, 0]
        if n < 0.5:
            continue
        mean = m[0, 1:] / n
        centred = m[1:, 1:] - n * np.outer(mean, mean)
        std = np.sqrt(np.maximum(np.diag(centred)[:p] / n, 0.0))
        std[std < 1e-12] = 1.0
        out[r, f, k] = _Moments(
            n,
            median,
            centre[:p] + mean[:p],
            std,
            centred[:p, :p] / np.outer(std, std),
            centred[:p, p] / std,
            float(mean[p] + centre[p]),
            medians.get((target, (r, f, -1)), 0.0),
        )
    return out


def _design(part: pd.DataFrame, features, m: _Moments) -> np.ndarray:
    x = part[features].to_numpy(dtype="float64")
    return (np.where(np.isnan(x), m.median, x) - m.mean) / m.std


def cross_validate(
    outer: DataFrame,
    morphology: Sequence[str],
    validation: str,
    grid: Mapping | None = None,
    target: str = "IDO_score",
    fold_names: Sequence[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Nested cross-validation of the five study models.

    ``outer`` has every image once per ``repeat`` with its ``seed`` and test ``fold``.
    Imputation, scaling and tuning use training rows only. Returns out-of-fold predictions
    and the coefficients on standardised columns with their parameters. ``fold_names``
    replaces the folds found in the data; a name no image has trains on all images.
    """
    grid = {**STUDY_GRID, **(grid or {})}
    spark = outer.sparkSession
    features = [*DOSE, *morphology]
    ids = ["image_key", "condition", "IFN_dose", "TNF_dose"]
    base = materialize(
        dose_interaction(outer)
        .select(*ids, "IFN_x_TNF", *morphology, target, "repeat", "seed", F.col("fold").cast("string").alias("fold"))
    )
    folds = base.select("repeat", "seed", "fold").distinct()
    if fold_names is not None:
        listed = F.explode(F.array(*[F.lit(n) for n in fold_names]))
        folds = folds.select("repeat", "seed").distinct().withColumn("fold", listed)
    # keys only: the inner fold of an image in the training set of each other fold
    members = (
        base.select("image_key", "condition", "repeat", "seed", F.col("fold").alias("_own"))
        .join(folds, ["repeat", "seed"])
        .filter("_own <> fold")
    )
    ranked = rank_within(
        members.withColumn("_draw", draw("image_key", F.concat_ws("/", "seed", "fold"))),
        ["repeat", "fold", "condition"],
        ["_draw", "image_key"],
        "_r",
    )
    sizes = ranked.groupBy("repeat", "fold", "condition").agg(F.max("_r").alias("_c"))
    inner = materialize(
        sizes.groupBy("repeat", "fold").agg(F.least(F.lit(int(grid["inner_splits"])), F.min("_c")).cast("int").alias("_g"))
    )
    counts = {(r["repeat"], r["fold"]): r["_g"] for r in inner.collect()}
    names = sorted({f for _, f in counts} | {r[0] for r in folds.select("fold").distinct().collect()})
    number = {f: i for i, f in enumerate(names)}
    sets = {(r, number[f]): g for (r, f), g in counts.items()}
    placed = (
        ranked.join(inner, ["repeat", "fold"])
        .groupBy("repeat", "image_key")
        .agg(F.map_from_entries(F.collect_list(F.struct("fold", F.pmod(F.col("_r") - 1, F.col("_g")).cast("int")))).alias("_in"))
    )
    place = F.array(*[F.coalesce(F.try_element_at("_in", F.lit(f)), F.lit(-1)) for f in names])
    rows = materialize(base.join(placed, ["repeat", "image_key"], "left").withColumn("_inner", place).drop("_in"))
    moments = training_moments(rows, features, target, sets)
    index = {f: i for i, f in enumerate(features)}
    columns = {m: [index[f] for f in _model_features(m, morphology)] for m in STUDY_MODELS}
    grids = {m: _grid(m, grid) for m in STUDY_MODELS}
    max_iter = int(grid["elasticnet_max_iter"])

    def weights(mo: _Moments, model: str, params: Mapping) -> np.ndarray:
        w = np.zeros(len(features))
        pick = columns[model]
        if pick:
            w[pick] = solve_linear(mo.gram[np.ix_(pick, pick)], mo.cross[pick], mo.n, params, max_iter)
        return w

    tuned = [m for m in STUDY_MODELS if m != "dummy_median"]
    candidates = {
        t: np.column_stack([weights(mo, m, g) for m in tuned for g in grids[m]])
        for t, mo in moments.items()
        if t[2] >= 0
    }

    def errors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[Task, np.ndarray] = {}
        for batch in batches:
            inner, repeat = np.stack(batch["_inner"].to_numpy()), batch["repeat"].to_numpy()
            for (r, f, k), weight in candidates.items():
                part = batch[(repeat == r) & (inner[:, f] == k)]
                if len(part):
                    mo = moments[r, f, k]
                    y = part[target].to_numpy(dtype="float64")
                    e = np.abs(_design(part, features, mo) @ weight + mo.y_mean - y[:, None]).sum(axis=0)
                    sums[r, f, k] = sums.get((r, f, k), 0.0) + np.append(e, len(y))
        if sums:  # an empty frame has no arrays in its columns
            yield pd.DataFrame({"task": ["|".join(map(str, t)) for t in sums], "s": list(sums.values())})

    schema = "task string, s array<double>"
    partials = rows.select("repeat", "_inner", *[f"`{f}`" for f in features], target).mapInPandas(errors, schema)
    table = {tuple(map(int, r["task"].split("|"))): np.array(r["s"]) for r in _added(partials, "task", schema).collect()}
    count = sum(len(grids[m]) for m in tuned)
    by_fold: dict[tuple[int, int], list[np.ndarray]] = {}
    for t, sums in sorted(table.items()):
        by_fold.setdefault(t[:2], []).append(sums[:count] / sums[count])
    final: dict[str, dict[str, tuple[np.ndarray, dict]]] = {}
    whole: dict[str, _Moments] = {}
    for (r, f), maes in by_fold.items():
        mean = np.mean(maes, axis=0)
        name, mo = f"{r}|{names[f]}", moments[r, f, -1]
        start, whole[name] = 0, mo
        final[name] = {"dummy_median": (np.zeros(len(features)), {})}
        for m in tuned:
            own = mean[start : start + len(grids[m])]
            best = grids[m][int(own.argmin())]
            final[name][m] = (weights(mo, m, best), best)
            start += len(grids[m])
    task = F.concat_ws("|", F.col("repeat").cast("string"), "fold")

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t, part in batch.groupby("task"):
                if t not in final:
                    continue
                mo = whole[t]
                x = _design(part, features, mo)
                for m in STUDY_MODELS:
                    w, params = final[t][m]
                    level = mo.y_median if m == "dummy_median" else mo.y_mean
                    yield pd.DataFrame(
                        {
                            "validation": validation,
                            "repeat": part["repeat"].astype("int32"),
                            "seed": part["seed"].astype("int64"),
                            "fold": part["fold"],
                            "model": m,
                            "image_key": part["image_key"],
                            "condition": part["condition"],
                            "IFN_dose": part["IFN_dose"],
                            "TNF_dose": part["TNF_dose"],
                            "observed_IDO_score": part[target],
                            "predicted_IDO_score": x @ w + level,
                            "best_params": json.dumps(params, sort_keys=True),
                        }
                    )

    predictions = base.withColumn("task", task).mapInPandas(
        predict,
        "validation string, repeat int, seed bigint, fold string, model string, image_key string,"
        " condition string, IFN_dose double, TNF_dose double, observed_IDO_score double,"
        " predicted_IDO_score double, best_params string",
    )
    rows = [
        (validation, int(f.split("|", 1)[0]), f.split("|", 1)[1], m, features[i], float(w[i]), json.dumps(params, sort_keys=True))
        for f, per_model in final.items()
        for m, (w, params) in per_model.items()
        for i in columns[m]
    ]
    coefficients = spark.createDataFrame(
        rows,
        "validation string, repeat int, fold string, model string, feature string,"
        " coefficient_standardized double, best_params string",
    )
    return materialize(predictions), coefficients


def dummy_median(outer: DataFrame, target: str = "IDO_score") -> DataFrame:
    """Median of each fold's training rows as the prediction of its test rows."""
    folds = outer.select("repeat", "fold").distinct()
    train = (
        outer.select("repeat", F.col("fold").alias("_own"), target)
        .join(folds, "repeat")
        .filter("_own <> fold")
    )
    medians = summarise(train, ["repeat", "fold"], {}, {"predicted": (target, 0.5)})
    return outer.join(medians, ["repeat", "fold"]).select(
        "repeat", "fold", "image_key", F.col(target).alias("observed"), "predicted"
    )


def final_models(
    images: DataFrame, morphology: Sequence[str], grid: Mapping | None = None, target: str = "IDO_score"
) -> DataFrame:
    """Both morphology models fitted on all images: parameters and standardised weights."""
    grid = {**STUDY_GRID, **(grid or {})}
    marked = images.withColumns(
        {"repeat": F.lit(0), "seed": F.lit(int(grid["final_seed"])), "fold": F.lit("none")}
    )
    _, coefficients = cross_validate(marked, morphology, "final", grid, target, ["all"])
    return coefficients.filter(
        F.col("model").isin("morphology_ridge", "morphology_elasticnet")
    ).select("model", "best_params", "feature", "coefficient_standardized")
