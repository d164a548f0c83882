"""Weights, splits and folds by whole images, folders or conditions.

Random order is the md5 of key and seed. Positions inside a group come from a distributed
sort, so a folder may hold any share of the images.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from petridish.operators.scale import rank_within, with_group_stats
from petridish.session import materialize


def image_balanced_weight(cells: DataFrame, image: str = "image_key", out: str = "weight") -> DataFrame:
    """Every image weighs the same; the mean weight is 1 (= images / (cells · own size))."""
    sizes = cells.groupBy(image).agg(F.count(F.lit(1)).alias("_c"))
    # the sum over an image's cells of 1/size is 1, so the mean needs two counts only
    total = sizes.agg(F.count(F.lit(1)).alias("i"), F.sum("_c").alias("n")).first()
    mean = total["i"] / total["n"] if total["n"] else 1.0
    return cells.join(sizes.select(image, ((1.0 / F.col("_c")) / F.lit(mean)).alias(out)), image)


def split_by_folder(
    cells: DataFrame, valid: Sequence[str], test: Sequence[str], folder: str = "source_folder"
) -> DataFrame:
    """Fixed folder lists; validation wins where a folder is in both."""
    key = F.lower(F.trim(F.col(folder)))

    def names(values):
        return [v.strip().lower() for v in values]

    return cells.withColumn(
        "split",
        F.when(key.isin(*names(valid)), "valid").when(key.isin(*names(test)), "test").otherwise("train"),
    )


def split_counts(n: Column, ratios: Sequence[float] = (0.70, 0.15, 0.15)) -> Column:
    """``train, valid, test`` counts by largest remainder, none empty when possible."""
    total = float(sum(ratios))
    shares = [r / total for r in ratios]
    raw = [F.round(n * s, 9) for s in shares]
    base = [F.floor(r) for r in raw]
    left = n - (base[0] + base[1] + base[2])
    fraction = [r - b for r, b in zip(raw, base)]
    counts = []
    for i in range(3):
        # rank by falling remainder; on a tie the later part goes first
        ahead = F.lit(0)
        for j in range(3):
            if j != i:
                wins = (fraction[j] > fraction[i]) | ((fraction[j] == fraction[i]) & F.lit(j > i))
                ahead = ahead + wins.cast("int")
        counts.append(base[i] + (ahead < left).cast("int"))
    train, valid, test = counts
    # an empty part takes one from the largest; with these ratios that is the training part
    take = (valid == 0).cast("int") + (test == 0).cast("int")
    fair = F.struct(
        (train - take).alias("train"),
        F.greatest(valid, F.lit(1)).alias("valid"),
        F.greatest(test, F.lit(1)).alias("test"),
    )

    def fixed(a, b, c):
        return F.struct(
            F.lit(a).cast("bigint").alias("train"),
            F.lit(b).cast("bigint").alias("valid"),
            F.lit(c).cast("bigint").alias("test"),
        )

    return (
        F.when(n <= 0, fixed(0, 0, 0))
        .when(n == 1, fixed(1, 0, 0))
        .when(n == 2, fixed(1, 0, 1))
        .otherwise(fair)
    )


def ratio_strata(
    images: DataFrame, folder: str = "source_folder", key: str = "image_key", ratio: str = "true_ratio", max_bins: int = 5
) -> DataFrame:
    """``stratum`` per image: up to five equal-count bins of the ratio inside its folder.

    One stratum (0) when the folder has a single ratio or a bin would hold one image.
    """
    ranked = rank_within(images.filter(F.col(ratio).isNotNull()), [folder], [ratio, key], "_r")
    ranked = with_group_stats(
        ranked, [folder], _n=F.count(F.lit(1)), _kinds=F.countDistinct(ratio)
    )
    bins = F.least(F.lit(max_bins), F.col("_kinds"), F.col("_n"))
    # right-closed quantile bins of the ranks 1..n
    place = F.greatest(
        F.ceil(F.round((F.col("_r") - 1) * bins / (F.col("_n") - 1), 9)), F.lit(1)
    ) - 1
    binned = ranked.withColumn("_b", F.when((F.col("_kinds") >= 2) & (F.col("_n") > 1), place).otherwise(0))
    sizes = binned.groupBy(folder, "_b").agg(F.count(F.lit(1)).alias("_c"))
    small = sizes.groupBy(folder).agg(F.min("_c").alias("_min"))
    return (
        binned.join(small, folder)
        .withColumn("stratum", F.when(F.col("_min") < 2, 0).otherwise(F.col("_b")).cast("int"))
        .drop("_r", "_n", "_kinds", "_b", "_min")
    )


def stable_seed(folder: Column | str, state: int) -> Column:
    f = F.col(folder) if isinstance(folder, str) else folder
    return (F.lit(state).cast("bigint") + F.crc32(f.cast("binary"))) % F.lit((1 << 32) - 1)


def draw(key: str, seed: Column) -> Column:
    return F.md5(F.concat_ws("#", F.col(key), seed.cast("string")).cast("binary"))


def split_within_folder(
    cells: DataFrame,
    state: int = 42,
    ratios: Sequence[float] = (0.70, 0.15, 0.15),
    folder: str = "source_folder",
    key: str = "image_key",
) -> DataFrame:
    """Image-level train/valid/test split inside every folder; all cells follow their image.

    Images are dealt in the order (draw inside stratum, stratum), so each part gets an even
    mix of the strata and exactly its quota.
    """
    images = cells.groupBy(folder, key).agg(F.avg("ki67_label").alias("true_ratio"))
    strata = materialize(ratio_strata(images, folder, key))
    drawn = strata.withColumn("_draw", draw(key, stable_seed(folder, state)))
    dealt = rank_within(drawn, [folder, "stratum"], ["_draw", key], "_deal")
    dealt = with_group_stats(dealt, [folder, "stratum"], _size=F.count(F.lit(1)))
    # relative position inside the stratum spreads each stratum evenly over the order
    dealt = dealt.withColumn("_pos", F.round((F.col("_deal") - 0.5) / F.col("_size"), 9))
    ordered = rank_within(dealt, [folder], ["_pos", "stratum", "_draw", key], "_order")
    quota = ordered.groupBy(folder).agg(split_counts(F.count(F.lit(1))).alias("_q"))
    assigned = ordered.join(quota, folder).select(
        key,
        F.when(F.col("_order") <= F.col("_q.train"), "train")
        .when(F.col("_order") <= F.col("_q.train") + F.col("_q.valid"), "valid")
        .otherwise("test")
        .alias("split"),
    )
    return cells.drop("split").join(assigned, key)


def group_kfold(df: DataFrame, group: str, folds: int, out: str = "fold") -> DataFrame:
    """Folds by whole groups: groups in order of falling size are dealt in a snake.

    Fewer folds result when there are fewer groups.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_c"))
    ranked = rank_within(sizes, [], [F.desc("_c"), F.asc(group)], "_r")
    ranked = with_group_stats(ranked, [], _g=F.count(F.lit(1)))
    k = F.least(F.lit(max(2, folds)), F.col("_g"))
    step = F.pmod(F.col("_r") - 1, 2 * k)
    fold = F.when(step < k, step).otherwise(2 * k - 1 - step)
    return df.join(ranked.select(group, fold.cast("int").alias(out)), group)


def stratified_kfold(
    images: DataFrame, folds: int, seeds: Sequence[int], key: str = "image_key", label: str = "condition"
) -> DataFrame:
    """``repeat, seed, fold`` for every image and seed, balanced over the conditions."""
    repeats = F.explode(
        F.array(*[F.struct(F.lit(i).alias("repeat"), F.lit(s).alias("seed")) for i, s in enumerate(seeds)])
    )
    rows = images.select("*", repeats.alias("_s")).select(
        *images.columns, F.col("_s.repeat").alias("repeat"), F.col("_s.seed").alias("seed")
    )
    rows = rows.withColumn("_draw", draw(key, F.col("seed")))
    ranked = rank_within(rows, ["repeat", label], ["_draw", key], "_r")
    return ranked.withColumn("fold", (F.pmod(F.col("_r") - 1, F.lit(folds)) + 1).cast("int")).drop(
        "_r", "_draw"
    )


def inner_fold_count(images: DataFrame, requested: int, by: Sequence[str] = (), label: str = "condition") -> DataFrame:
    """Inner folds per training set: capped by its smallest condition."""
    sizes = images.groupBy(*by, label).agg(F.count(F.lit(1)).alias("_c"))
    return sizes.groupBy(*by).agg(F.least(F.lit(requested), F.min("_c")).cast("int").alias("inner_folds"))


def leave_one_condition_out(images: DataFrame, label: str = "condition") -> DataFrame:
    """Fold table: held-out condition and its test images.

    The training rows of a fold are all other images; they are not copied per fold, trainers
    filter ``condition <> fold``.
    """
    return images.withColumn("fold", F.col(label))
