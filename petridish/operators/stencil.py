"""Pixel-neighbourhood operators on pixel rows ``keys, x, y[, v]``.

Linear filters group one pixel line (bounded by the image side) into an array; morphology shifts
lines of bits, or scatters each mask pixel over its element and counts hits, in one shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from petridish.functions.numeric import compute_once, sides
from petridish.operators.engines import connected_components
from petridish.operators.roi import distance_to_outside
from petridish.operators.scale import with_group_stats
from petridish.session import written

# --- morphology -------------------------------------------------------------------------


def kernel_rows(radius: int | Column, shape: str = "ellipse") -> Column:
    """Element lines ``(dy, half)``: the element covers ``x ± half`` on line ``y + dy``."""
    r = F.lit(radius) if isinstance(radius, int) else radius.cast("int")
    lines = F.sequence(-r, r)
    if shape == "box":
        return F.transform(lines, lambda d: F.struct(d.alias("dy"), r.alias("half")))

    def half(d):
        share = 1.0 - (d * d).cast("double") / F.greatest(r * r, F.lit(1)).cast("double")
        return F.bround(r * F.sqrt(F.greatest(share, F.lit(0.0))), 0).cast("int")

    return F.transform(lines, lambda d: F.struct(d.alias("dy"), half(d).alias("half")))


def hits_around(
    mask: DataFrame,
    keys: Sequence[str],
    width: Column,
    height: Column,
    radius: int | Column = 1,
    shape: str = "ellipse",
) -> DataFrame:
    """For every image pixel the element reaches: ``hits`` mask pixels below the element,
    ``size`` element pixels inside the image, and whether the pixel is in the mask."""
    width, height = sides(width, height)
    base = compute_once(mask.select(*keys, "x", "y"), _k=kernel_rows(radius, shape))
    spread = (
        base.select(*keys, "x", "y", F.explode("_k").alias("_l"))
        .withColumn("ty", F.col("y") + F.col("_l.dy"))
        .filter((F.col("ty") >= 0) & (F.col("ty") < height))
        .select(
            *keys,
            "x",
            "y",
            "ty",
            F.explode(
                F.sequence(
                    F.greatest(F.col("x") - F.col("_l.half"), F.lit(0)),
                    F.least(F.col("x") + F.col("_l.half"), (width - 1).cast("int")),
                )
            ).alias("tx"),
        )
    )
    counted = spread.groupBy(*keys, F.col("tx").alias("x"), F.col("ty").alias("y")).agg(
        F.count(F.lit(1)).alias("hits"),
        F.max((F.col("x") == F.col("tx")) & (F.col("y") == F.col("ty"))).alias("member"),
    )
    inside = F.aggregate(
        kernel_rows(radius, shape),
        F.lit(0),
        lambda acc, l: acc
        + F.when(
            (F.col("y") + l.dy >= 0) & (F.col("y") + l.dy < height),
            F.least(F.col("x") + l.half, (width - 1).cast("int"))
            - F.greatest(F.col("x") - l.half, F.lit(0))
            + 1,
        ).otherwise(0),
    )
    return counted.withColumn("size", F.when(F.col("member"), inside))


# Pixels of a line in one word, and those it has of its neighbours on each side; up to
# this radius the lines of an element are shifted words.
WORD, MARGIN, WORD_RADIUS = 32, 16, 8


def _words(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, y, _c, _m, _rows``: bit ``b`` of word ``_c`` is the pixel ``x = WORD * _c - MARGIN + b`` of line ``y``."""
    px = mask.select(*keys, F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))
    last = F.shiftright(F.col("x") + MARGIN, 5)
    return (
        px.filter(F.col("x").isNotNull() & F.col("y").isNotNull())
        .select(*keys, "x", "y", F.explode(F.array(last - 1, last)).alias("_c"))
        .groupBy(*keys, "y", "_c")
        .agg(
            F.bit_or(F.expr(f"shiftleft(1L, x - _c * {WORD} + {MARGIN})")).alias("_m"),
            F.count(F.lit(1)).alias("_rows"),
        )
    )


def _element(radius: int, shape: str) -> list[tuple[int, int]]:
    """`kernel_rows` as numbers."""
    if shape == "box":
        return [(dy, radius) for dy in range(-radius, radius + 1)]
    return [(dy, round(radius * math.sqrt(1.0 - dy * dy / max(radius * radius, 1)))) for dy in range(-radius, radius + 1)]


def _shifted(words: DataFrame, keys: Sequence[str], height: Column, element, join) -> DataFrame:
    """``keys, y, _c, _b``: for each element line, the own pixels of a word joined with their neighbours."""

    def own(half):
        out = F.col("_m")
        for k in range(1, half + 1):
            out = join(join(out, F.shiftleft("_m", k)), F.shiftrightunsigned("_m", k))
        return F.shiftrightunsigned(out, MARGIN).bitwiseAND(F.lit(2**WORD - 1))

    lines = F.array(*[F.struct((F.col("y") + dy).alias("y"), own(half).alias("b")) for dy, half in element])
    return (
        words.select(*keys, "_c", F.explode(lines).alias("_l"))
        .select(*keys, F.col("_l.y").alias("y"), "_c", F.col("_l.b").alias("_b"))
        .filter((F.col("y") >= 0) & (F.col("y") < height) & (F.col("_b") != 0))
    )


def _pixels(words: DataFrame, keys: Sequence[str], width: Column) -> DataFrame:
    """``keys, x, y`` of the bits of ``_b``."""
    bits = F.explode(F.array(*[F.lit(b) for b in range(WORD)])).alias("_i")
    return (
        words.select(*keys, "y", "_c", "_b", bits)
        .filter(F.expr("shiftrightunsigned(_b, _i) & 1L = 1L"))
        .withColumn("x", F.col("_c") * WORD + F.col("_i"))
        .filter((F.col("x") >= 0) & (F.col("x") < width))
        .select(*keys, "x", "y")
    )


def dilate(mask, keys, width, height, radius=1, shape="ellipse") -> DataFrame:
    if not isinstance(radius, int) or radius > WORD_RADIUS:
        return hits_around(mask, keys, width, height, radius, shape).select(*keys, "x", "y")
    width, height = sides(width, height)
    reached = _shifted(_words(mask, keys), keys, height, _element(radius, shape), lambda a, b: a.bitwiseOR(b))
    return _pixels(reached.groupBy(*keys, "y", "_c").agg(F.bit_or("_b").alias("_b")), keys, width)


def erode(mask, keys, width, height, radius=1, shape="ellipse") -> DataFrame:
    """Pixels whose element lies in the mask; the outside of the image does not erode.

    A mask with repeated rows counts them all, as hits are counted.
    """
    words = None
    if isinstance(radius, int) and radius <= WORD_RADIUS:
        words = _words(mask, keys)
        if words.agg(F.max(F.col("_rows") > F.bit_count("_m"))).first()[0]:
            words = None
    if words is None:
        around = hits_around(mask, keys, width, height, radius, shape)
        return around.filter(F.col("member") & (F.col("hits") == F.col("size"))).select(
            *keys, "x", "y"
        )
    width, height = sides(width, height)
    element = _element(radius, shape)
    # bits on the left and on the right of the image are set
    left = F.when(F.col("_c") == 0, F.lit(2**MARGIN - 1)).otherwise(F.lit(0)).cast("long")
    words = words.withColumn("_e", (width - F.col("_c") * WORD + MARGIN).cast("int"))
    right = F.when(F.col("_e") < WORD + 2 * MARGIN, F.expr("shiftleft(-1L, greatest(_e, 0))")).otherwise(F.lit(0).cast("long"))
    words = words.withColumn("_m", F.col("_m").bitwiseOR(left).bitwiseOR(right))
    fits = _shifted(words, keys, height, element, lambda a, b: a.bitwiseAND(b))
    fits = fits.groupBy(*keys, "y", "_c").agg(F.bit_and("_b").alias("_b"), F.count(F.lit(1)).alias("_n"))
    lines = None
    for dy, _ in element:
        line = F.when((F.col("y") + dy >= 0) & (F.col("y") + dy < height), 1).otherwise(0)
        lines = line if lines is None else lines + line
    return _pixels(fits.filter(F.col("_n") == lines), keys, width)


def open_mask(mask, keys, width, height, radius=1, shape="ellipse") -> DataFrame:
    return dilate(erode(mask, keys, width, height, radius, shape), keys, width, height, radius, shape)


# --- linear filters ---------------------------------------------------------------------


def gaussian_weights(sigma: float, reach: float = 4.0) -> dict[int, float]:
    """Normalised weights by offset; the window holds ``reach`` sigmas on each side."""
    size = int(round(sigma * reach * 2 + 1)) | 1
    half = size // 2
    raw = {k: math.exp(-k * k / (2.0 * sigma * sigma)) for k in range(-half, half + 1)}
    total = sum(raw.values())
    return {k: w / total for k, w in raw.items()}


def mirrored(index: Column, n: Column, border: str) -> Column:
    """Index folded into ``0..n-1``: ``reflect101`` (edge once) or ``reflect`` (edge twice)."""
    if border == "reflect101":
        period = F.greatest(2 * n - 2, F.lit(1))
        m = F.pmod(index, period)
        return F.when(n == 1, 0).when(m < n, m).otherwise(period - m)
    if border == "reflect":
        m = F.pmod(index, 2 * n)
        return F.when(m < n, m).otherwise(2 * n - 1 - m)
    raise ValueError(border)


def _extended(positions: Column, values: str, n: Column, border: str) -> Column:
    return F.transform(
        positions, lambda i: F.get(F.col(values), mirrored(i, n, border).cast("int"))
    )


def along(
    pixels: DataFrame,
    keys: Sequence[str],
    axis: str,
    outputs: Mapping[str, tuple[str, Mapping[int, float]]],
    border: str = "reflect101",
) -> DataFrame:
    """Weighted sums along one axis of gap-free lines: ``out -> (value, {offset: weight})``."""
    other = "y" if axis == "x" else "x"
    values = list(dict.fromkeys(v for v, _ in outputs.values()))
    lines = pixels.groupBy(*keys, other).agg(
        F.sort_array(F.collect_list(F.struct(axis, *values))).alias("_l")
    )
    lines = compute_once(
        lines.withColumn("_n", F.size("_l")).withColumn("_first", F.col(f"_l.{axis}")[0]),
        **{f"_v_{v}": F.col("_l")[v] for v in values},
    ).drop("_l")
    n = F.col("_n")
    reach = max(abs(k) for _, w in outputs.values() for k in w)
    # mirror the ends once, so the sums below read plain positions
    positions = F.sequence(F.lit(-reach), n - 1 + reach)
    lines = compute_once(
        lines,
        **{
            f"_p_{v}": _extended(positions, f"_v_{v}", n, border)
            for v in values
        },
    )

    def filtered(value, weights):
        def at(i):
            total = None
            for offset, weight in sorted(weights.items()):
                term = F.get(F.col(f"_p_{value}"), i + (offset + reach)) * F.lit(float(weight))
                total = term if total is None else total + term
            return total

        return F.transform(F.sequence(F.lit(0), n - 1), at)

    packed = compute_once(
        lines, **{f"_o_{o}": filtered(v, w) for o, (v, w) in outputs.items()}
    )
    zipped = F.arrays_zip(*[F.col(f"_o_{o}").alias(o) for o in outputs])
    return packed.select(
        *keys, other, "_first", F.posexplode(zipped).alias("_i", "_z")
    ).select(
        *keys,
        (F.col("_first") + F.col("_i")).alias(axis),
        other,
        *[F.col("_z").getField(o).alias(o) for o in outputs],
    )


def gaussian_blur(
    pixels: DataFrame, keys: Sequence[str], sigma: float, value: str = "v", out: str = "v",
    reach: float = 4.0,
) -> DataFrame:
    weights = gaussian_weights(sigma, reach)
    rows = along(pixels, keys, "x", {"_b": (value, weights)})
    return along(rows, keys, "y", {out: ("_b", weights)})


def sobel_edges(pixels: DataFrame, keys: Sequence[str], value: str = "v", out: str = "v") -> DataFrame:
    """Gradient magnitude with the 3×3 Sobel pair, symmetric border."""
    smooth = {-1: 0.25, 0: 0.5, 1: 0.25}
    step = {-1: 1.0, 1: -1.0}
    rows = along(pixels, keys, "x", {"_s": (value, smooth), "_d": (value, step)}, "reflect")
    both = along(rows, keys, "y", {"_gx": ("_d", smooth), "_gy": ("_s", step)}, "reflect")
    return both.withColumn(
        out, F.sqrt((F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy")) / 2.0)
    ).drop("_gx", "_gy")


def window_maximum(pixels: DataFrame, keys: Sequence[str], distance: int, value: str = "v", out: str = "top") -> DataFrame:
    """Maximum over the ``(2d+1)²`` box on gap-free lines."""
    across = Window.partitionBy(*keys, "y").orderBy("x").rowsBetween(-distance, distance)
    down = Window.partitionBy(*keys, "x").orderBy("y").rowsBetween(-distance, distance)
    return (
        pixels.withColumn("_m", F.max(value).over(across))
        .withColumn(out, F.max("_m").over(down))
        .drop("_m")
    )


def local_maxima(pixels: DataFrame, keys: Sequence[str], distance: int, value: str = "v", slack: float = 1e-7) -> DataFrame:
    return (
        window_maximum(pixels, keys, distance, value, "_top")
        .filter(F.col(value) >= F.col("_top") - slack)
        .drop("_top")
    )


def stencil(pixels: DataFrame, keys: Sequence[str], reach: int, value: str = "v", out: str = "nb") -> DataFrame:
    """Attach the ``(2r+1)²`` neighbourhood as an array of lines; NULL outside the grid.

    Two windows over gap-free pixel lines; neighbours are ``nb[dy + r][dx + r]``.
    """
    across = Window.partitionBy(*keys, "y").orderBy("x")
    down = Window.partitionBy(*keys, "x").orderBy("y")

    def shifted(name, k, w):
        if k == 0:
            return F.col(name)
        return F.lag(name, -k).over(w) if k < 0 else F.lead(name, k).over(w)

    line = F.array(*[shifted(value, k, across) for k in range(-reach, reach + 1)])
    with_line = pixels.withColumn("_line", line)
    block = F.array(*[shifted("_line", k, down) for k in range(-reach, reach + 1)])
    return with_line.withColumn(out, block).drop("_line")


def neighbour(dx: int, dy: int, reach: int, name: str = "nb") -> Column:
    return F.col(name)[dy + reach][dx + reach]


SNAP = 32  # fixed value: bilinear positions are kept in steps of 1/32 pixel


def bilinear_sample(
    points: DataFrame, pixels: DataFrame, keys: Sequence[str], width: Column, height: Column,
    out: str = "sample", snap: int = SNAP,
) -> DataFrame:
    """Value at fractional ``px, py`` with replicated border.

    ``points`` carries its own id columns; each point meets at most four pixels.
    """
    width, height = sides(width, height)
    ids = points.columns
    sx = F.bround(F.col("px") * snap, 0) / snap if snap else F.col("px")
    sy = F.bround(F.col("py") * snap, 0) / snap if snap else F.col("py")
    p = compute_once(points, _sx=sx, _sy=sy)
    p = compute_once(
        p,
        _x0=F.floor("_sx").cast("int"),
        _y0=F.floor("_sy").cast("int"),
    )
    fx, fy = F.col("_sx") - F.col("_x0"), F.col("_sy") - F.col("_y0")
    corners = F.array(
        *[
            F.struct(
                F.lit(i).alias("i"),
                F.lit(j).alias("j"),
                ((fx if i else 1 - fx) * (fy if j else 1 - fy)).alias("w"),
            )
            for j in (0, 1)
            for i in (0, 1)
        ]
    )
    p = p.withColumn("_c", F.explode(corners)).filter("_c.w > 0")
    zero = F.lit(0)
    p = p.select(
        *ids,
        F.col("_c.w").alias("_w"),
        F.least(F.greatest(F.col("_x0") + F.col("_c.i"), zero), (width - 1).cast("int")).alias("x"),
        F.least(F.greatest(F.col("_y0") + F.col("_c.j"), zero), (height - 1).cast("int")).alias("y"),
    )
    signal = pixels.select(*keys, "x", "y", F.col("v").alias("_v"))
    return p.join(signal, [*keys, "x", "y"]).groupBy(*ids).agg(
        F.sum(F.col("_w") * F.col("_v")).alias(out)
    )


def rolling_ball(
    pixels: DataFrame, keys: Sequence[str], radius: float, value: str = "v", span: float | None = None
) -> DataFrame:
    """Ball background and the signal above it (``background``, ``v`` clipped at 0).

    The background is the lowest ball position that touches the signal:
    ``min(v[p+o] + r - sqrt(r² - |o|²))``. ``span`` is a known bound of ``max - min``
    (1 for gray values in [0, 1]): offsets that raise the ball by more than it can never
    win and are left out, which keeps the result exact.
    """
    reach = int(math.floor(radius))

    def rise(dx, dy):
        d2 = dx * dx + dy * dy
        return radius - math.sqrt(radius * radius - d2) if d2 <= radius * radius else None

    def useful(dx, dy):
        cost = rise(dx, dy)
        return cost is not None and (span is None or cost <= span)

    while reach > 0 and not useful(reach, 0):
        reach -= 1
    across = Window.partitionBy(*keys, "y").orderBy("x")
    down = Window.partitionBy(*keys, "x").orderBy("y")

    def at(name, k, w):
        if k == 0:
            return F.col(name)
        return F.lag(name, -k).over(w) if k < 0 else F.lead(name, k).over(w)

    lags = {f"_h{k + reach}": at(value, k, across) for k in range(-reach, reach + 1)}
    rows = pixels.withColumns(lags)

    def lowest(terms):
        return terms[0] if len(terms) == 1 else F.least(*terms)

    rows = rows.withColumns(
        {
            f"_r{dy}": lowest(
                [
                    F.col(f"_h{dx + reach}") + F.lit(rise(dx, dy))
                    for dx in range(-reach, reach + 1)
                    if useful(dx, dy)
                ]
            )
            for dy in range(0, reach + 1)
            if useful(0, dy)
        }
    ).drop(*lags)
    reaches = [dy for dy in range(-reach, reach + 1) if useful(0, dy)]
    rows = rows.withColumns({f"_d{dy + reach}": at(f"_r{abs(dy)}", dy, down) for dy in reaches})
    background = lowest([F.col(f"_d{dy + reach}") for dy in reaches])
    helper = [f"_d{dy + reach}" for dy in reaches] + [f"_r{dy}" for dy in range(reach + 1)]
    return (
        rows.withColumn("background", background)
        .drop(*helper)
        .withColumn(value, F.greatest(F.col(value) - F.col("background"), F.lit(0.0)))
    )


# --- components -------------------------------------------------------------------------

ROW_ID = 1 << 20  # component ids are y * ROW_ID + x of the first pixel


#: Side of the tiles that are labelled in one task each.
TILE = 128


def label_components(mask: DataFrame, keys: Sequence[str], connectivity: int = 8) -> DataFrame:
    """Mask pixels with ``component``, the id of the component's first pixel in row order.

    Two levels: a task labels a tile of bounded size, and only pairs of labels that touch across
    tile borders go through the distributed search, so its rounds follow the borders.
    """
    keys = list(keys)
    steps = [(1, 0), (0, 1)] if connectivity == 4 else [(1, 0), (0, 1), (1, 1), (-1, 1)]
    schema = mask.select(*keys, F.col("x").cast("int"), F.col("y").cast("int"), F.lit(0).cast("long").alias("_first")).schema
    tile = lambda c: F.floor(F.col(c) / TILE)

    def label(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["y", "x"])
        x, y = part["x"].to_numpy(np.int64), part["y"].to_numpy(np.int64)
        ids = y * ROW_ID + x
        links = [(np.searchsorted(ids, ids + dy * ROW_ID + dx), dx, dy) for dx, dy in steps]
        pairs = [
            (np.flatnonzero(hit), at[hit])
            for at, dx, dy in links
            for hit in [(at < ids.size) & (ids[np.minimum(at, ids.size - 1)] == ids + dy * ROW_ID + dx)]
        ]
        roots = least_roots(*(np.concatenate(side) for side in zip(*pairs)), ids.size)
        return part.assign(_first=ids[roots])[[*keys, "x", "y", "_first"]]

    px = mask.select(*keys, F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y")).distinct()
    labelled = written(
        px.withColumn("_tx", tile("x")).withColumn("_ty", tile("y")).groupBy(*keys, "_tx", "_ty").applyInPandas(label, schema)
    )
    edge = F.lit(TILE - 1)
    at_border = lambda c: F.pmod(F.col(c), F.lit(TILE)).isin(0, TILE - 1)
    border = labelled.filter(at_border("x") | at_border("y"))
    moves = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in steps])
    near = border.select(*keys, "x", "y", F.col("_first").alias("a"), F.explode(moves).alias("_m")).select(
        *keys,
        (F.col("x") + F.col("_m.dx")).alias("x"),
        (F.col("y") + F.col("_m.dy")).alias("y"),
        "a",
        # only steps into another tile
        ((F.pmod("x", F.lit(TILE)) == edge) & (F.col("_m.dx") == 1)
         | (F.pmod("x", F.lit(TILE)) == 0) & (F.col("_m.dx") == -1)
         | (F.pmod("y", F.lit(TILE)) == edge) & (F.col("_m.dy") == 1)).alias("_out"),
    )
    links = (
        near.filter("_out")
        .drop("_out")
        .join(border.select(*keys, "x", "y", F.col("_first").alias("b")), [*keys, "x", "y"])
        .select(*keys, "a", "b")
        .distinct()
    )
    roots = border.select(*keys, "_first").distinct()
    joined = connected_components(roots, links, keys, "_first", "component")
    return (
        labelled.join(joined, [*keys, "_first"], "left")
        .withColumn("component", F.coalesce("component", "_first"))
        .select(*keys, "x", "y", "component")
    )


def least_roots(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """The smallest node that is linked with each of ``size`` nodes."""
    top = np.arange(size)
    while a.size:
        a, b = top[a], top[b]
        a, b = a[a != b], b[a != b]
        np.minimum.at(top, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(top, top[top]):
            top = top[top]
    return top


def watershed(heights: DataFrame, markers: DataFrame, keys: Sequence[str], height: str = "v") -> DataFrame:
    """Pixels with ``component``, the marker whose basin holds them, on the 4-neighbour grid.

    ``markers(keys, x, y, marker)`` are pixels of ``heights(keys, x, y, height)``. The basins are a minimum
    spanning forest rooted in the markers, an edge being as high as the higher of its pixels; ties go
    to the first pixels in row order. Boruvka rounds: every tree without a marker takes its
    lowest edge, and trees that meet are joined, until no such tree has an edge. Pixels that no
    marker reaches are left out.
    """
    keys = list(keys)
    ident = F.col("y").cast("long") * ROW_ID + F.col("x")
    px = written(heights.select(*keys, "x", "y", F.col(height).cast("double").alias("_h"), ident.alias("_id")))
    steps = F.array(F.struct(F.lit(1).alias("dx"), F.lit(0).alias("dy")), F.struct(F.lit(0).alias("dx"), F.lit(1).alias("dy")))
    moved = px.select(*keys, "_h", "_id", F.explode(steps).alias("_m"), "x", "y").select(
        *keys, (F.col("x") + F.col("_m.dx")).alias("x"), (F.col("y") + F.col("_m.dy")).alias("y"), F.col("_h").alias("_h2"), F.col("_id").alias("_id2")
    )
    near = px.select(*keys, "x", "y", "_h", "_id").join(moved, [*keys, "x", "y"])
    seeds = markers.select(*keys, ident.alias("_id"), F.col("marker").cast("long").alias("marker"))
    # pixels of one marker are one tree from the start
    first = seeds.groupBy(*keys, "marker").agg(F.min("_id").alias("_tree"))
    own = seeds.join(first, [*keys, "marker"]).select(*keys, "_id", "_tree")
    trees = written(px.select(*keys, "_id").join(own, [*keys, "_id"], "left").withColumn("_tree", F.coalesce("_tree", "_id")))
    names = written(first.select(*keys, "_tree", "marker"))
    known = names.select(*keys, "_tree", F.lit(True).alias("_rooted"))
    edges = near.select(
        *keys, F.col("_id").alias("a"), F.col("_id2").alias("b"),
        F.struct(F.greatest("_h", "_h2").alias("h"), F.col("_id2").alias("p"), F.col("_id").alias("q")).alias("_w"),
    )

    def ends(frame: DataFrame, of: DataFrame) -> DataFrame:
        """Edges between different trees, one of them at least without a marker."""
        for end in ("a", "b"):
            to = of.withColumnsRenamed({"_from": end, "_to": f"_{end}"})
            frame = frame.join(to, [*keys, end], "left").withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
        frame = frame.filter("a <> b")
        for end in ("a", "b"):
            frame = frame.join(known.withColumnsRenamed({"_tree": end, "_rooted": f"_r{end}"}), [*keys, end], "left")
        frame = frame.filter("_ra IS NULL OR _rb IS NULL")
        # of the edges between two trees the lowest is enough
        low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
        return written(frame.groupBy(*keys, low, high).agg(F.min("_w").alias("_w")))

    edges = ends(edges, trees.select(*keys, F.col("_id").alias("_from"), F.col("_tree").alias("_to")))
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"), "_w"))
        free = both.join(known.withColumnRenamed("_tree", "a"), [*keys, "a"], "left_anti")
        picks = free.groupBy(*keys, "a").agg(F.min(F.struct("_w", "b")).alias("_p")).select(*keys, "a", F.col("_p.b").alias("b"))
        picks = written(picks)
        nodes = picks.select(*keys, F.col("a").alias("id")).union(picks.select(*keys, "b")).distinct()
        groups = connected_components(nodes, picks, keys)
        # a joined tree is named by its marker's tree, if it has one
        lead = groups.join(known.withColumnRenamed("_tree", "id"), [*keys, "id"], "left")
        lead = lead.groupBy(*keys, "component").agg(F.coalesce(F.max(F.when(F.col("_rooted"), F.col("id"))), F.min("id")).alias("_to"))
        move = written(groups.join(lead, [*keys, "component"]).select(*keys, F.col("id").alias("_from"), "_to"))
        trees = written(
            trees.join(move.withColumnRenamed("_from", "_tree"), [*keys, "_tree"], "left").select(
                *keys, "_id", F.coalesce("_to", "_tree").alias("_tree")
            )
        )
        edges = ends(edges, move)
    basins = trees.join(names, [*keys, "_tree"]).select(*keys, "_id", F.col("marker").alias("component"))
    return px.join(basins, [*keys, "_id"]).select(*keys, "x", "y", "component")


def split_touching(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Components of a mask, touching particles cut between their centres by a watershed.

    Markers are the 4-connected maxima of the distance to the outside, and the heights are that
    distance turned over on 256 levels per image. Pixels beyond the image count as outside.
    """
    keys = list(keys)
    depth = written(distance_to_outside(mask.select(*keys, "x", "y").distinct(), keys))
    peaks = _box_maximum(depth, keys)
    marked = label_components(peaks, keys, 4).withColumnRenamed("component", "marker")
    deepest = depth.groupBy(*keys).agg(F.max("distance").alias("_deep"))
    level = F.floor((F.col("_deep") - F.col("distance")) / F.col("_deep") * 255.0)
    heights = depth.join(deepest, keys).select(*keys, "x", "y", level.cast("double").alias("v"))
    return watershed(heights, marked, keys)


def _box_maximum(depth: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels not lower than any of their eight neighbours; lines of a mask have gaps."""
    around = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    seen = depth.select(*keys, "x", "y", "distance", F.explode(around).alias("_m")).select(
        *keys,
        (F.col("x") + F.col("_m.dx")).alias("x"),
        (F.col("y") + F.col("_m.dy")).alias("y"),
        "distance",
        F.when((F.col("_m.dx") == 0) & (F.col("_m.dy") == 0), F.col("distance")).alias("_own"),
    )
    top = seen.groupBy(*keys, "x", "y").agg(F.max("distance").alias("_top"), F.max("_own").alias("_own"))
    return top.filter("_own >= _top").select(*keys, "x", "y")


def component_stats(labelled: DataFrame, keys: Sequence[str]) -> DataFrame:
    return labelled.groupBy(*keys, "component").agg(
        F.count(F.lit(1)).alias("area"), F.avg("x").alias("cx"), F.avg("y").alias("cy")
    )


def remove_small(mask: DataFrame, keys: Sequence[str], min_area: int, connectivity: int = 8) -> DataFrame:
    if min_area <= 0:
        return mask
    labelled = label_components(mask, keys, connectivity)
    return (
        with_group_stats(labelled, [*keys, "component"], _area=F.count(F.lit(1)))
        .filter(F.col("_area") >= min_area)
        .select(*keys, "x", "y")
    )


# --- thresholds -------------------------------------------------------------------------

BINS = 256


def histogram(values: DataFrame, keys: Sequence[str], value: str = "v", bins: int = BINS) -> DataFrame:
    """Per key: ``lo, hi, n, total`` and the counts of ``bins`` equal bins as one array.

    Equal values are counted first; the array has a fixed length.
    """
    counts = values.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    ranged = with_group_stats(
        counts,
        keys,
        lo=F.min(value),
        hi=F.max(value),
        n=F.sum("_c"),
        total=F.sum(F.col("_c") * F.col(value)),
    )
    bin_ = F.when(
        F.col("hi") > F.col("lo"),
        F.least(
            F.floor((F.col(value) - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))),
            F.lit(bins - 1),
        ),
    ).otherwise(0)
    binned = ranged.groupBy(*keys, "lo", "hi", "n", "total", bin_.cast("int").alias("_b")).agg(
        F.sum("_c").alias("_c")
    )
    packed = binned.groupBy(*keys, "lo", "hi", "n", "total").agg(
        F.map_from_entries(F.collect_list(F.struct("_b", "_c"))).alias("_m")
    )
    return packed.withColumn(
        "counts",
        F.transform(
            F.sequence(F.lit(0), F.lit(bins - 1)),
            lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0)).cast("double"),
        ),
    ).drop("_m")


def otsu_bin(counts: np.ndarray, centers: np.ndarray) -> int:
    w1, w2 = counts.cumsum(), counts[::-1].cumsum()[::-1]
    s1, s2 = (counts * centers).cumsum(), (counts * centers)[::-1].cumsum()[::-1]
    with np.errstate(all="ignore"):
        between = w1[:-1] * w2[1:] * (s1[:-1] / w1[:-1] - s2[1:] / w2[1:]) ** 2
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1.0)))


def _triangle_bin(counts: np.ndarray) -> int:
    peak = int(counts.argmax())
    used = np.flatnonzero(counts)
    low, high = int(used[0]), int(used[-1])
    flip = peak - low < high - peak
    if flip:
        counts = counts[::-1]
        low, peak = len(counts) - high - 1, len(counts) - peak - 1
    width = peak - low
    steps = np.arange(width)
    height = counts[peak]
    norm = math.sqrt(height**2 + width**2)
    gap = (height / norm) * steps - (width / norm) * counts[steps + low]
    level = int(gap.argmax()) + low
    return len(counts) - level - 1 if flip else level


def _isodata(counts, centers):
    below = counts.cumsum()
    above = below[-1] - below
    mass = (counts * centers).cumsum()
    with np.errstate(all="ignore"):
        middle = (mass[:-1] / below[:-1] + (mass[-1] - mass[:-1]) / above[:-1]) / 2.0
    gap = middle - centers[:-1]
    found = centers[:-1][(gap >= 0) & (gap < centers[1] - centers[0])]
    return float(found[0])


def _yen_bin(counts):
    share = counts / counts.sum()
    p, q = share.cumsum(), (share**2).cumsum()
    r = (share[::-1] ** 2).cumsum()[::-1]
    with np.errstate(all="ignore"):
        gain = np.log((q[:-1] * r[1:]) ** -1 * (p[:-1] * (1.0 - p[:-1])) ** 2)
    return int(np.argmax(np.where(np.isnan(gain), -np.inf, gain)))


def _minimum(counts, centers):
    smooth = counts.astype("float64")
    for _ in range(10000):
        padded = np.concatenate([smooth[:1], smooth, smooth[-1:]])
        smooth = (padded[:-2] + padded[1:-1] + padded[2:]) / 3.0
        slope = np.sign(np.diff(smooth))
        peaks, rising = [], True
        for i, d in enumerate(slope):
            if d > 0:
                rising = True
            elif d < 0 and rising:
                peaks.append(i)
                rising = False
        if len(peaks) < 3:
            break
    if len(peaks) != 2:
        return None
    a, b = peaks
    return float(centers[a + int(smooth[a : b + 1].argmin())])


def _li(counts, centers):
    """Minimum cross-entropy iteration on the histogram."""
    low = centers[0]
    x = centers - low
    used = x[counts > 0]
    gap = np.diff(used).min() / 2.0 if len(used) > 1 else 0.0
    level = float((counts * x).sum() / counts.sum())
    previous = -2.0 * gap - 1.0
    while abs(level - previous) > gap:
        previous = level
        fore, back = x > level, x <= level
        mf = (counts * x)[fore].sum() / max(counts[fore].sum(), 1.0)
        mb = (counts * x)[back].sum() / max(counts[back].sum(), 1.0)
        if mb == 0.0:
            break
        level = (mb - mf) / (math.log(mb) - math.log(mf))
    return float(level + low)


METHODS = ("otsu", "triangle", "isodata", "li", "mean", "minimum", "yen")


def threshold_auto(
    values: DataFrame, keys: Sequence[str], method: str = "triangle", value: str = "v"
) -> DataFrame:
    """One threshold per key from the 256-bin histogram; unknown names mean triangle.

    Spark builds the histograms; the small per-row rule sees 256 counts. Where a rule has
    no answer the mean is used.
    """
    method = method.strip().lower()
    method = method if method in METHODS else "triangle"
    hist = histogram(values, keys, value)
    mean = F.col("total") / F.col("n")
    if method == "mean":
        return hist.select(*keys, mean.alias("threshold"))

    @F.pandas_udf("double")
    def rule(counts: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.Series:
        out = []
        for c, a, b in zip(counts, lo, hi):
            c = np.asarray(c, dtype="float64")
            if not b > a:
                out.append(a)
                continue
            edges = np.linspace(a, b, len(c) + 1)
            centers = (edges[:-1] + edges[1:]) / 2.0
            try:
                if method == "otsu":
                    out.append(float(centers[otsu_bin(c, centers)]))
                elif method == "triangle":
                    out.append(float(centers[_triangle_bin(c)]))
                elif method == "yen":
                    out.append(float(centers[_yen_bin(c)]))
                else:
                    out.append({"isodata": _isodata, "li": _li, "minimum": _minimum}[method](c, centers))
            except (ValueError, IndexError, ZeroDivisionError):
                out.append(None)
        return pd.Series(out, dtype="float64")

    return hist.select(
        *keys, F.coalesce(F.nanvl(rule("counts", "lo", "hi"), F.lit(None)), mean).alias("threshold")
    )


def clahe(
    pixels: DataFrame, keys: Sequence[str], width: int, height: int, clip: float = 2.0, tiles: int = 8
) -> DataFrame:
    """Contrast-limited adaptive equalisation of 8-bit values.

    Each tile's histogram becomes a 256-entry lookup array; a pixel mixes the entries of its
    four nearest tiles. Image sides that do not divide by ``tiles`` are extended by mirrored
    pixels for the histograms only.
    """
    tw, th = -(-width // tiles), -(-height // tiles)
    area = tw * th
    limit = max(1, int(clip * area / 256.0)) if clip > 0 else area

    def extended(axis, side, tile):
        pad = tile * tiles - side
        c = F.col(axis)
        return F.explode(
            F.when(
                (c >= side - 1 - pad) & (c < side - 1), F.array(c, 2 * (side - 1) - c)
            ).otherwise(F.array(c))
        )

    grid = pixels.withColumn("_x", extended("x", width, tw)).withColumn("_y", extended("y", height, th))
    counts = grid.groupBy(
        *keys,
        F.floor(F.col("_x") / tw).cast("int").alias("_tx"),
        F.floor(F.col("_y") / th).cast("int").alias("_ty"),
        F.col("v").cast("int").alias("_b"),
    ).agg(F.count(F.lit(1)).alias("_c"))
    lut = counts.groupBy(*keys, "_tx", "_ty").agg(
        F.collect_list(F.struct("_b", F.least("_c", F.lit(limit)).alias("_c"))).alias("_e"),
        F.sum(F.greatest(F.col("_c") - limit, F.lit(0))).alias("_over"),
    )
    # what is cut off goes back evenly: the same share to every bin, the rest in even steps
    rest = F.col("_over") % 256
    step = F.when(rest > 0, F.greatest(F.floor(256 / rest), F.lit(1))).otherwise(1)

    def upto(b):
        own = F.aggregate(
            "_e", F.lit(0).cast("bigint"), lambda acc, e: acc + F.when(e["_b"] <= b, e["_c"]).otherwise(0)
        )
        return own + (b + 1) * F.floor(F.col("_over") / 256) + F.least(rest, F.floor(b / step) + 1)

    lut = lut.select(
        *keys,
        "_tx",
        "_ty",
        F.transform(
            F.sequence(F.lit(0), F.lit(255)),
            lambda b: F.least(F.bround(upto(b) * (255.0 / area), 0), F.lit(255.0)),
        ).alias("_lut"),
    )

    def place(axis, tile):
        f = F.col(axis) / float(tile) - 0.5
        return F.floor(f), f - F.floor(f)

    x1, xa = place("x", tw)
    y1, ya = place("y", th)

    def clamp(c):
        return F.least(F.greatest(c, F.lit(0)), F.lit(tiles - 1)).cast("int")

    corners = F.array(
        *[
            F.struct(
                clamp(x1 + i).alias("tx"),
                clamp(y1 + j).alias("ty"),
                ((xa if i else 1 - xa) * (ya if j else 1 - ya)).alias("w"),
            )
            for j in (0, 1)
            for i in (0, 1)
        ]
    )
    four = pixels.withColumn("_c", F.explode(corners)).select(
        *keys, "x", "y", "v", F.col("_c.tx").alias("_tx"), F.col("_c.ty").alias("_ty"), F.col("_c.w").alias("_w")
    )
    mixed = four.join(lut, [*keys, "_tx", "_ty"]).groupBy(*keys, "x", "y").agg(
        F.sum(F.col("_w") * F.get("_lut", F.col("v").cast("int"))).alias("_s")
    )
    return mixed.select(*keys, "x", "y", F.bround("_s", 0).alias("v"))
