"""Grouping helpers that stay balanced when one group holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from petridish.session import materialize

def with_group_stats(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Attach group aggregates to every row.

    A window over ``keys`` would bring each group into one task. The aggregate here is
    combined before its shuffle, and the join back has one row per group on its build
    side, so the runtime can split a skewed group on the row side.
    """
    stats = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    if keys:
        return df.join(stats, list(keys))
    row, kinds = stats.first(), dict(stats.dtypes)  # one row of totals
    return df.withColumns({n: F.lit(row[n]).cast(kinds[n]) for n in aggs})


def rank_within(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], out: str = "rank"
) -> DataFrame:
    """1-based position of each row in its group; ``order`` must be a total order.

    Rows are range-partitioned on ``keys + order``, so a hot group spans many partitions.
    Only the per-partition counts (at most one row per partition and group) meet in a window.
    """
    cols = [*keys, *order]
    placed = materialize(
        df.repartitionByRange(*cols)
        .sortWithinPartitions(*cols)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id())
    )
    blocks = placed.groupBy(*keys, "_pid").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first")
    )
    before = (
        Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    )
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return (
        _same_group(placed, blocks.drop("_n"), [*keys, "_pid"], "inner")
        .withColumn(out, F.col("_before") + F.col("_pos") - F.col("_first") + 1)
        .drop("_pid", "_pos", "_first", "_before")
    )


def _same_group(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on group keys, of which a null is one."""
    names = {k: f"_key_{k}" for k in keys}
    right = right.withColumnsRenamed(names)
    same = F.lit(True)
    for k, other in names.items():
        same = same & F.col(k).eqNullSafe(F.col(other))
    joined = left.join(right, same, how)
    return joined if how == "left_semi" else joined.drop(*names.values())


#: A percentile lies between the approximate ones this far below and above, and the sketch behind
#: those errs by one rank in so many. A group of up to WHOLE rows is its own bracket.
MARGIN, ACCURACY, WHOLE = 3e-4, 20_000, 10_000
#: Values between brackets that a group may gather; beyond, all values are sorted by range.
GATHERED = 1 << 20


def _percentiles(
    df: DataFrame, keys: Sequence[str], specs: Mapping[str, tuple[str, float]]
) -> DataFrame:
    """One row per group with the percentiles in ``specs``, linearly interpolated and exact.

    Selection by brackets: a mergeable sketch gives a lower and an upper bound of each percentile,
    one more aggregate counts the values below and keeps the few between, and the rank inside
    gives the value. No sort, and a group of any size leaves only its brackets to one task.
    """
    keys = list(keys)
    columns = list(dict.fromkeys(c for c, _ in specs.values()))
    wanted = {c: sorted({float(p) for o, p in specs.values() if o == c}) for c in columns}
    plain = df.select(*keys, *[F.col(f"`{c}`").cast("double").alias(f"_v{i}") for i, c in enumerate(columns)])
    sizes = plain.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    largest = sizes.agg(F.max("_rows")).first()[0] or 0
    most = max(len(ps) for ps in wanted.values())
    if largest > WHOLE and largest * (3 * MARGIN + 2 / ACCURACY) * most > GATHERED:
        return _sorted_percentiles(df, keys, specs)
    bounds: dict[tuple[int, float], list[Column | None]] = {
        (i, p): [None, None] for i, c in enumerate(columns) for p in wanted[c]
    }
    if largest > WHOLE:
        plain = _with_bounds(plain, keys, sizes, [wanted[c] for c in columns], bounds)
    aggs = []
    for i, c in enumerate(columns):
        v, inside = F.col(f"_v{i}"), None
        for j, p in enumerate(wanted[c]):
            low, high = bounds[i, p]
            if low is not None:
                aggs += [F.count_if(v < low).alias(f"_b{i}_{j}"), F.min(low).alias(f"_l{i}_{j}")]
            # bounds are null in groups that are their own bracket, and where they are open
            own = F.lit(True)
            own = own if low is None else own & F.coalesce(v >= low, F.lit(True))
            own = own if high is None else own & F.coalesce(v <= high, F.lit(True))
            inside = own if inside is None else inside | own
        aggs += [F.count(v).alias(f"_n{i}"), F.array_sort(F.collect_list(F.when(inside, v))).alias(f"_s{i}")]
    found = plain.groupBy(*keys).agg(*aggs)
    out = []
    for name, (c, p) in specs.items():
        i, j = columns.index(c), wanted[c].index(float(p))
        values, at = F.col(f"_s{i}"), F.lit(float(p)) * (F.col(f"_n{i}") - 1)
        low = F.floor(at)
        place = low
        if bounds[i, float(p)][0] is not None:
            bound = F.col(f"_l{i}_{j}")
            skipped = F.coalesce(F.size(F.filter(values, lambda x: x < bound)), F.lit(0))
            place = low - F.col(f"_b{i}_{j}") + skipped
        first = F.get(values, place.cast("int"))
        second = F.get(values, (place + 1).cast("int"))
        # the value itself where no share falls to the next one
        value = F.when(at > low, first * (1 - (at - low)) + second * (at - low)).otherwise(first)
        out.append(F.when(F.col(f"_n{i}") > 0, value).alias(name))
    return found.select(*keys, *out)


def _with_bounds(
    plain: DataFrame, keys: list[str], sizes: DataFrame, wanted: list[list[float]], bounds: dict
) -> DataFrame:
    """``plain`` with the brackets of large groups, null in the others; fills in ``bounds``."""
    sketches = []
    for i, ps in enumerate(wanted):
        ends = [(j, side, p + sign * MARGIN) for j, p in enumerate(ps) for side, sign in ((0, -1), (1, 1))]
        # within the margin of an end the bracket is open there
        ends = [(j, side, f) for j, side, f in ends if (f > MARGIN if side == 0 else f < 1 - MARGIN)]
        if ends:
            sketches.append((i, ends))
    rows = plain
    if keys:
        rows = _same_group(plain, sizes.filter(F.col("_rows") > WHOLE).select(*keys), keys, "left_semi")
    found = materialize(
        rows.groupBy(*keys).agg(
            *[
                F.percentile_approx(f"_v{i}", [f for _, _, f in ends], ACCURACY).alias(f"_q{i}")
                for i, ends in sketches
            ]
        )
    )
    if keys:
        plain = _same_group(plain, found, keys, "left")
    else:
        row = found.first()
        kinds = dict(found.dtypes)
        plain = plain.withColumns(
            {f"_q{i}": F.array(*[F.lit(x).cast("double") for x in row[f"_q{i}"] or []]).cast(kinds[f"_q{i}"]) for i, _ in sketches}
        )
    for i, ends in sketches:
        for at, (j, side, _) in enumerate(ends):
            bounds[i, wanted[i][j]][side] = F.get(F.col(f"_q{i}"), at)
    return plain


def _sorted_percentiles(
    df: DataFrame, keys: Sequence[str], specs: Mapping[str, tuple[str, float]]
) -> DataFrame:
    """One row per group with the percentiles in ``specs``, by a range-partitioned sort.

    Equal values are combined first; the running count of the distinct values, sorted by
    range, gives each value the ranks that it holds, and the values that hold the two ranks
    around a percentile are picked. No group is held by one task.
    """
    columns = list(dict.fromkeys(c for c, _ in specs.values()))
    long = (
        df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
        .unpivot(list(keys) or [F.lit(0).alias("_all")], columns, "_column", "_value")
        .filter(F.col("_value").isNotNull())
        .groupBy(*keys, "_column", "_value")
        .agg(F.count(F.lit(1)).alias("_count"))
    )
    ranked = running_total(long, [*keys, "_column"], ["_value"], "_count", "_upto")
    at = F.col("_p") * (F.col("_n") - 1)
    low = F.floor(at)
    wanted = F.array(
        *[
            F.struct(F.lit(n).alias("out"), F.lit(c).alias("of"), F.lit(float(p)).alias("p"))
            for n, (c, p) in specs.items()
        ]
    )
    # at most two ranks per group and percentile
    ranks = (
        ranked.groupBy(*keys, "_column")
        .agg(F.max("_upto").alias("_n"))
        .withColumn("_w", F.explode(F.filter(wanted, lambda w: w["of"] == F.col("_column"))))
        .withColumn("_p", F.col("_w.p"))
        .select(
            *keys,
            "_column",
            F.array(
                F.struct(F.col("_w.out").alias("out"), (low + 1).alias("rank"), (1 - (at - low)).alias("share")),
                F.struct(F.col("_w.out").alias("out"), (low + 2).alias("rank"), (at - low).alias("share")),
            ).alias("_ranks"),
        )
        .groupBy(*keys, "_column")
        .agg(F.flatten(F.collect_list("_ranks")).alias("_ranks"))
    )
    held = F.filter(
        "_ranks",
        lambda r: (r["share"] > 0)
        & (r["rank"] <= F.col("_upto"))
        & (r["rank"] > F.col("_upto") - F.col("_count")),
    )
    picked = _same_group(ranked, ranks, [*keys, "_column"], "inner").select(
        *keys, "_value", F.explode(held).alias("_r")
    )
    part = F.col("_value") * F.col("_r.share")
    return picked.groupBy(*keys).agg(
        *[F.sum(F.when(F.col("_r.out") == n, part)).alias(n) for n in specs]
    )


def summarise(
    df: DataFrame,
    keys: Sequence[str],
    aggs: Mapping[str, Column] | None = None,
    percentiles: Mapping[str, tuple[str, float]] | None = None,
) -> DataFrame:
    """Group aggregates plus exact, linearly interpolated percentiles.

    ``percentiles`` maps an output name to ``(column, p)``; all of them share their passes.
    """
    keys, specs = list(keys), dict(percentiles or {})
    plain = [c.alias(n) for n, c in (aggs or {}).items()]
    if not specs:
        return df.groupBy(*keys).agg(*plain)
    found = _percentiles(df, keys, specs)
    if not keys:
        row = found.first()
        return df.agg(*plain, F.count(F.lit(1)).alias("_rows")).select(
            *(aggs or {}), *[F.lit(row[n] if row else None).cast("double").alias(n) for n in specs]
        )
    groups = df.groupBy(*keys).agg(*plain) if plain else df.select(*keys).distinct()
    return _same_group(groups, found, keys, "left")


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Fractional ranks (ties share their mean rank), null values left out.

    Equal values are combined first, so only distinct values are sorted.
    """
    counts = (
        df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    )
    cum = running_total(counts, keys, [value], "_c", "_upto")
    return cum.withColumn(out, F.col("_upto") - F.col("_c") + (F.col("_c") + 1) / 2.0)


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], amount: str, out: str
) -> DataFrame:
    """Inclusive running sum of ``amount`` per group over a total order, balanced by range."""
    cols = [*keys, *order]
    placed = materialize(
        df.repartitionByRange(*cols)
        .sortWithinPartitions(*cols)
        .withColumn("_pid", F.spark_partition_id())
    )
    blocks = placed.groupBy(*keys, "_pid").agg(F.sum(amount).alias("_s"))
    before = (
        Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    )
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_s").over(before), F.lit(0)))
    inside = (
        Window.partitionBy(*keys, "_pid")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        _same_group(placed, blocks.drop("_s"), [*keys, "_pid"], "inner")
        .withColumn(out, F.col("_before") + F.sum(amount).over(inside))
        .drop("_pid", "_before")
    )
