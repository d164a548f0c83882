"""Iterative and spatial engines shared by pairing, population and structure operators.

Every loop writes its state to the shared folder in each round and stops when nothing
changes; a task gets a bounded part of a group.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from petridish.operators.scale import rank_within
from petridish.session import materialize, written


#: Edges of a group that one task walks at a time.
WALKED = 1 << 21


def greedy_matching(
    edges: DataFrame,
    keys: Sequence[str],
    left: str,
    right: str,
    priority: Sequence[str],
) -> DataFrame:
    """One-to-one matching per ``keys`` that takes edges in ``priority`` order.

    ``priority`` must order the edges of a group without ties. Each round walks the first WALKED edges
    of every group in a task of the group and removes all edges of the matched ends. All groups go
    through the rounds together; the last round finds no edge left. Edges without an end are left out.
    """
    keys = list(keys)
    rest = written(edges.dropna(subset=[*keys, left, right]))
    taken = rest.limit(0)
    schema = rest.select(*keys, F.lit(0).cast("long").alias("_at")).schema
    while not rest.isEmpty():
        ranked = written(rank_within(rest, [*keys], priority, "_at"))
        first = ranked.filter(F.col("_at") <= WALKED).select(*keys, left, right, "_at")
        picked = first.groupBy(*keys).applyInPandas(lambda g: _walked(g, keys, left, right), schema)
        chosen = written(ranked.join(picked, [*keys, "_at"], "left_semi").drop("_at"))
        taken = taken.unionByName(chosen)
        rest = ranked.filter(F.col("_at") > WALKED).drop("_at")
        rest = rest.join(chosen.select(*keys, left), [*keys, left], "left_anti")
        rest = written(rest.join(chosen.select(*keys, right), [*keys, right], "left_anti"))
    return taken


def _walked(edges: pd.DataFrame, keys: list[str], left: str, right: str) -> pd.DataFrame:
    """The edges that a walk in the order of ``_at`` takes."""
    edges = edges.sort_values("_at", ignore_index=True)
    (a, ends), (b, others) = pd.factorize(edges[left]), pd.factorize(edges[right])
    free, open_, used = bytearray(b"\x01" * len(ends)), bytearray(b"\x01" * len(others)), []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        if free[x] and open_[y]:
            free[x] = open_[y] = 0
            used.append(i)
    return edges.loc[used, [*keys, "_at"]]


def connected_components(
    nodes: DataFrame,
    edges: DataFrame,
    keys: Sequence[str],
    node: str = "id",
    out: str = "component",
) -> DataFrame:
    """Label every node with the smallest node of its component within ``keys``.

    ``edges(keys, a, b)``. Edges are contracted until none is left: every node moves to the
    least of itself and its neighbours, in the natural order in even rounds (a star is done in
    one) and by a fresh hash in odd rounds, which shrinks long chains as well. Nothing but
    minima and equi-joins; no neighbourhood is collected, and the end is exact.
    """
    keys = list(keys)
    left = written(edges.filter("a <> b").select(*keys, "a", "b").distinct())
    ends = left.select(*keys, F.col("a").alias("_at")).union(left.select(*keys, "b")).distinct()
    places = ends.withColumn("_to", F.col("_at"))  # where each node has moved so far
    turn = 0
    while not left.isEmpty():

        def order(c):
            first = F.xxhash64(F.lit(turn), c) if turn % 2 else F.lit(0)  # noqa: B023
            return F.struct(first.alias("h"), c.alias("x"))

        both = left.union(left.select(*keys, F.col("b"), F.col("a"))).toDF(*keys, "a", "b")
        moves = (
            both.groupBy(*keys, "a")
            .agg(F.min(order(F.col("b"))).alias("_m"))
            .select(*keys, "a", F.least("_m", order(F.col("a")))["x"].alias("_new"))
            .filter("_new <> a")
        )
        moves = written(moves)

        def moved(frame, name):
            step = moves.withColumnRenamed("a", name)  # noqa: B023
            return frame.join(step, [*keys, name], "left").withColumn(
                name, F.coalesce("_new", name)
            ).drop("_new")

        places = written(moved(places, "_to").select(*keys, "_at", "_to"))
        left = written(
            moved(moved(left, "a"), "b").select(*keys, "a", "b").filter("a <> b").distinct()
        )
        turn += 1
    least = places.groupBy(*keys, "_to").agg(F.min("_at").alias("_root"))
    roots = places.join(least, [*keys, "_to"]).select(*keys, F.col("_at").alias(node), "_root")
    return (
        nodes.join(roots, [*keys, node], "left")
        .withColumn(out, F.coalesce("_root", node))
        .drop("_root")
    )


def nearest(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    k: int = 1,
    same: bool = False,
) -> DataFrame:
    """The ``k`` nearest ``right`` points of each ``left`` point within ``keys``.

    ``left(keys, lid, x, y)``, ``right(keys, rid, x, y)``; ties go to the smaller ``rid``;
    ``same`` leaves out a point itself. Returns ``keys, lid, rid, d, pos``.

    Grid search: a point is settled once its k-th distance is within the grid edge, since
    every closer point lies in the 3×3 block; the others go on with a doubled edge. The
    first edge follows the density of the key and of its fullest square. At one position only the k + 1 smallest ids
    can be among the nearest, so larger piles of points are cut before the join.
    """
    keys = list(keys)
    pile = Window.partitionBy(*keys, "x", "y").orderBy("rid")
    right = (
        right.select(*keys, "rid", "x", "y")
        .withColumn("_n", F.row_number().over(pile))
        .filter(F.col("_n") <= k + 1)
        .drop("_n")
    )
    box = right.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_cnt"),
        F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.lit(1e-6)).alias("_ext"),
        F.min("x").alias("_x0"),
        F.min("y").alias("_y0"),
    )
    box = box.withColumn("_edge", F.col("_ext") / F.sqrt("_cnt"))
    # clustered points: start with an edge that keeps the fullest square small
    fullest = (
        right.join(box.select(*keys, "_edge"), keys)
        .groupBy(*keys, F.floor(F.col("x") / F.col("_edge")), F.floor(F.col("y") / F.col("_edge")))
        .agg(F.count(F.lit(1)).alias("_o"))
        .groupBy(*keys)
        .agg(F.max("_o").alias("_o"))
    )
    box = materialize(
        box.join(fullest, keys)
        .withColumn("_edge", F.col("_edge") / F.sqrt(F.greatest(F.col("_o") / 16.0, F.lit(1.0))))
        .drop("_o")
    )
    right = materialize(right.join(box.select(*keys, "_edge"), keys))
    todo = materialize(left.select(*keys, "lid", "x", "y").join(box, keys))
    best = Window.partitionBy(*keys, "lid").orderBy("d", "rid")
    done = None
    factor = 1.0
    while True:
        pairs = _grid_round(todo, right, keys, factor)
        if same:
            pairs = pairs.filter("rid <> lid")
        top = pairs.withColumn("pos", F.row_number().over(best)).filter(F.col("pos") <= k)
        state = top.groupBy(*keys, "lid").agg(
            F.count(F.lit(1)).alias("_found"), F.max("d").alias("_far")
        )
        reach = F.lit(factor) * F.col("_edge")
        # the whole key is inside the block once the edge passes both the extent of the
        # right points and the distance to them
        around = (
            F.greatest(
                F.abs(F.col("x") - F.col("_x0")),
                F.abs(F.col("y") - F.col("_y0")),
                F.lit(0.0),
            )
            + F.col("_ext")
        )
        judged = materialize(
            todo.join(state, [*keys, "lid"], "left").withColumn(
                "_ok",
                F.coalesce((F.col("_found") >= k) & (F.col("_far") <= reach), F.lit(False))
                | (reach >= around),
            )
        )
        settled = judged.filter("_ok").select(*keys, "lid")
        found = materialize(
            top.join(settled, [*keys, "lid"], "left_semi").select(*keys, "lid", "rid", "d", "pos")
        )
        done = found if done is None else done.unionByName(found)
        todo = judged.filter("not _ok").select(*todo.columns)
        if todo.isEmpty():
            return done
        factor *= 2.0


def _grid_round(todo: DataFrame, right: DataFrame, keys: list[str], factor: float) -> DataFrame:
    size = F.lit(factor) * F.col("_edge")
    l = todo.select(*keys, "lid", "x", "y", "_edge")
    r = right.select(*keys, "rid", "x", "y", "_edge")
    spread = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    l = (
        l.withColumn("_ox", spread)
        .withColumn("_oy", spread)
        .select(
            *keys,
            "lid",
            "x",
            "y",
            (F.floor(F.col("x") / size) + F.col("_ox")).alias("_gx"),
            (F.floor(F.col("y") / size) + F.col("_oy")).alias("_gy"),
        )
    )
    r = r.select(
        *keys,
        "rid",
        F.col("x").alias("_rx"),
        F.col("y").alias("_ry"),
        F.floor(F.col("x") / size).alias("_gx"),
        F.floor(F.col("y") / size).alias("_gy"),
    )
    dx, dy = F.col("x") - F.col("_rx"), F.col("y") - F.col("_ry")
    return l.join(r, [*keys, "_gx", "_gy"]).select(
        *keys, "lid", "rid", F.sqrt(dx * dx + dy * dy).alias("d")
    )
