"""Queries over pixel neighbourhoods."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from petridish.operators import stencil
from registry import standins as s
from registry.rounding import nudged_sql, rounded
from registry.q_roi import BASE, ROI
from registry.standins import with_ctes

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = nudged_sql(sql)
        return fn

    return register


IMG = ["image_id"]
W, H = s.WIDTH, s.HEIGHT
PIXELS = (s.GEOMETRY_SQL, s.IMAGES_SQL, s.pixels_sql())


def px(spark, sf, channel="phase"):
    return s.pixels(spark, sf, channel).drop("dataset")


def ellipse(r):
    out = []
    for dy in range(-r, r + 1):
        half = round(r * math.sqrt(1 - dy * dy / (r * r)))
        out += [(dx, dy) for dx in range(-half, half + 1)]
    return out


def values(pairs):
    return ", ".join(f"({a}, {b})" for a, b in pairs)


def dilate_sql(name, source, keys, offsets):
    return f"""{name} AS (SELECT DISTINCT {keys}, x + dx AS x, y + dy AS y FROM {source}, (VALUES {values(offsets)}) o(dx, dy)
  WHERE x + dx BETWEEN 0 AND 31 AND y + dy BETWEEN 0 AND 31)"""


def erode_sql(name, source, keys, offsets):
    on = " AND ".join(f"q.{k.strip()} = m.{k.strip()}" for k in keys.split(","))
    cols = ", ".join(f"m.{k.strip()}" for k in keys.split(","))
    return f"""{name} AS (SELECT {cols}, m.x, m.y FROM {source} m, (VALUES {values(offsets)}) o(dx, dy)
  LEFT JOIN {source} q ON {on} AND q.x = m.x + dx AND q.y = m.y + dy
  GROUP BY ALL HAVING count(*) FILTER (m.x + dx BETWEEN 0 AND 31 AND m.y + dy BETWEEN 0 AND 31 AND q.x IS NULL) = 0)"""


@query("dilate_erode_open", with_ctes(s.GEOMETRY_SQL, s.LABELS_SQL,
    dilate_sql("di", "lp", "image_id, region, label", ellipse(2)),
    erode_sql("er", "lp", "image_id, region, label", ellipse(2)),
    erode_sql("e1", "lp", "image_id, region, label", ellipse(1)),
    dilate_sql("op", "e1", "image_id, region, label", ellipse(1)), body="""
SELECT 'dilate' AS op, image_id, region, label, count(*) AS n, CAST(sum(x * 40 + y) AS BIGINT) AS mark FROM di GROUP BY ALL
UNION ALL SELECT 'erode', image_id, region, label, count(*), CAST(sum(x * 40 + y) AS BIGINT) FROM er GROUP BY ALL
UNION ALL SELECT 'open', image_id, region, label, count(*), CAST(sum(x * 40 + y) AS BIGINT) FROM op GROUP BY ALL"""))
def _(spark, sf):
    lp = s.label_pixels(spark, sf).drop("dataset")

    def sums(df, name):
        return df.groupBy(*ROI).agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.expr("x * 40 + y")).alias("mark")
        ).withColumn("op", F.lit(name))

    return (
        sums(stencil.dilate(lp, ROI, W, H, 2), "dilate")
        .unionByName(sums(stencil.erode(lp, ROI, W, H, 2), "erode"))
        .unionByName(sums(stencil.open_mask(lp, ROI, W, H, 1), "open"))
    )


def conv_sql(name, source, keys, axis, terms, border="reflect101", size=32):
    """One linear pass; terms: {out: (value, {offset: weight})}."""
    other = "y" if axis == "x" else "x"
    offsets = sorted({k for _, w in terms.values() for k in w})
    period, top = (2 * size - 2, f"{2 * size - 2} - m") if border == "reflect101" else (2 * size, f"{2 * size - 1} - m")
    outs = ", ".join(
        f"sum(q.{v} * CASE k {' '.join(f'WHEN {o} THEN {wt!r}' for o, wt in w.items())} ELSE 0.0 END) AS {out}"
        for out, (v, w) in terms.items()
    )
    return f"""{name} AS (SELECT {', '.join('p.' + k for k in keys)}, p.x, p.y, {outs} FROM
   (SELECT *, (({axis} + k) % {period} + {period}) % {period} AS m FROM {source}, (SELECT unnest([{', '.join(map(str, offsets))}]) AS k)) p
   JOIN {source} q ON {' AND '.join(f'q.{k} = p.{k}' for k in keys)} AND q.{other} = p.{other}
    AND q.{axis} = CASE WHEN m < {size} THEN m ELSE {top} END GROUP BY ALL)"""


GAUSS = stencil.gaussian_weights(1.0)


@query("gaussian_blur", with_ctes(*PIXELS,
    conv_sql("b1", "px", ["image_id"], "x", {"v1": ("v", GAUSS)}),
    conv_sql("b2", "b1", ["image_id"], "y", {"v2": ("v1", GAUSS)}), body="""
SELECT image_id, x, y, round(v2, 6) AS v FROM b2"""))
def _(spark, sf):
    return rounded(stencil.gaussian_blur(px(spark, sf), IMG, 1.0))


SMOOTH, STEP = {-1: 0.25, 0: 0.5, 1: 0.25}, {-1: 1.0, 1: -1.0}
SOBEL_SQL = ",\n".join((
    conv_sql("s1", "px", ["image_id"], "x", {"sm": ("v", SMOOTH), "df": ("v", STEP)}, "reflect"),
    conv_sql("s2", "s1", ["image_id"], "y", {"gx": ("df", SMOOTH), "gy": ("sm", STEP)}, "reflect"),
    "sobel AS (SELECT image_id, x, y, sqrt((gx * gx + gy * gy) / 2) AS edge FROM s2)",
))


@query("sobel_edges", with_ctes(*PIXELS, SOBEL_SQL, body="SELECT image_id, x, y, round(edge, 6) AS v FROM sobel"))
def _(spark, sf):
    return rounded(stencil.sobel_edges(px(spark, sf), IMG))


@query("bilinear_sample", with_ctes(*BASE, body="""
, c AS (SELECT image_id, region, label, avg(x) + 0.3 AS px_, avg(y) * 1.1 AS py_ FROM lp GROUP BY ALL),
sn AS (SELECT *, round_even(px_ * 32, 0) / 32 AS sx, round_even(py_ * 32, 0) / 32 AS sy FROM c),
f AS (SELECT *, CAST(floor(sx) AS INT) AS x0, CAST(floor(sy) AS INT) AS y0, sx - floor(sx) AS fx, sy - floor(sy) AS fy FROM sn),
cr AS (SELECT f.*, i, j, (CASE i WHEN 1 THEN fx ELSE 1 - fx END) * (CASE j WHEN 1 THEN fy ELSE 1 - fy END) AS w FROM f, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(i, j))
SELECT cr.image_id, region, label, round(sum(w * v), 6) AS sample FROM cr JOIN px ON px.image_id = cr.image_id
  AND px.x = least(greatest(x0 + i, 0), 31) AND px.y = least(greatest(y0 + j, 0), 31) GROUP BY ALL"""))
def _(spark, sf):
    points = s.label_pixels(spark, sf).groupBy(*ROI).agg(
        (F.avg("x") + 0.3).alias("px"), (F.avg("y") * 1.1).alias("py")
    )
    out = stencil.bilinear_sample(points, px(spark, sf), IMG, W, H)
    return rounded(out.select(*ROI, "sample"))


@query("local_maxima", with_ctes(*PIXELS, body="""
SELECT image_id, x, y, v FROM (SELECT *, max(m) OVER (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS top
  FROM (SELECT *, max(v) OVER (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM px)) WHERE v >= top - 1e-7"""))
def _(spark, sf):
    return stencil.local_maxima(px(spark, sf), IMG, 2)


def ball_sql(r, span, source):
    """Lowest touching position of a ball; offsets that raise it by more than ``span`` never win."""

    def at(name, k, w):
        return name if k == 0 else f"{'lag' if k < 0 else 'lead'}({name}, {abs(k)}) OVER {w}"

    def rise(dx, dy):
        return r - math.sqrt(r * r - dx * dx - dy * dy)

    def low(terms):
        return terms[0] if len(terms) == 1 else f"least({', '.join(terms)})"

    reach = max(k for k in range(r + 1) if rise(k, 0) <= span)
    steps = range(-reach, reach + 1)
    rows = ", ".join(
        low([f"{at('v', dx, 'a')} + {rise(dx, dy)!r}" for dx in steps if rise(dx, dy) <= span]) + f" AS r{dy}"
        for dy in range(reach + 1)
    )
    down = low([at(f"r{abs(dy)}", dy, "d") for dy in steps])
    return (
        f"bh AS (SELECT image_id, x, y, v, {rows} FROM {source} WINDOW a AS (PARTITION BY image_id, y ORDER BY x)),\n"
        f"bg AS (SELECT image_id, x, y, v, {down} AS b FROM bh WINDOW d AS (PARTITION BY image_id, x ORDER BY y))"
    )


@query("rolling_ball", with_ctes(*PIXELS, "un AS (SELECT image_id, x, y, v / 255 AS v FROM px)", ball_sql(50, 1.0, "un"), body="""
SELECT image_id, x, y, round(b, 6) AS background, round(greatest(v - b, 0), 6) AS v FROM bg"""))
def _(spark, sf):
    gray = px(spark, sf).withColumn("v", F.col("v") / 255)
    return rounded(stencil.rolling_ball(gray, IMG, 50.0, span=1.0))


def component_sql(mask, keys, steps, name="comp"):
    """Components of horizontal runs; ``{name}_px`` has every pixel with its component."""
    cols = ", ".join(keys)
    same = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys)
    return f"""
{name}_i AS (SELECT {cols}, x, y, x - row_number() OVER (PARTITION BY {cols}, y ORDER BY x) AS isl FROM {mask}),
{name}_r AS (SELECT {cols}, x, y, CAST(y AS BIGINT) * {stencil.ROW_ID} + min(x) OVER (PARTITION BY {cols}, y, isl) AS run FROM {name}_i),
{name}_h AS (SELECT DISTINCT {', '.join('a.' + k for k in keys)}, a.run AS a, b.run AS b FROM {name}_r a, (VALUES {values(steps)}) o(dx, dy) JOIN {name}_r b
  ON {same('b', 'a')} AND b.x = a.x + dx AND b.y = a.y + dy WHERE a.run <> b.run),
{name}_e AS (SELECT * FROM {name}_h UNION SELECT {cols}, b, a FROM {name}_h),
{name}({cols}, run, comp) USING KEY ({cols}, run) AS (
  SELECT DISTINCT {cols}, run, run FROM {name}_r
  UNION
  SELECT {', '.join('e.' + k for k in keys)}, e.b, min(c.comp) FROM {name} c JOIN {name}_e e ON e.a = c.run AND {same('e', 'c')}
   JOIN recurring.{name} r ON r.run = e.b AND {same('r', 'e')} WHERE c.comp < r.comp GROUP BY ALL),
{name}_px AS (SELECT {', '.join('p.' + k for k in keys)}, p.x, p.y, c.comp FROM {name}_r p JOIN {name} c ON c.run = p.run AND {same('c', 'p')})"""


# steps to the next line; runs already join the pixels of one line
FOUR = [(0, 1)]
EIGHT = [(-1, 1), (0, 1), (1, 1)]


@query("connected_components", "WITH RECURSIVE " + ",".join((s.GEOMETRY_SQL, s.IMAGES_SQL, s.pixels_sql("ki67"), "mk AS (SELECT image_id, x, y FROM px WHERE v > 150)",
    component_sql("mk", ["image_id"], FOUR, "c4"), component_sql("mk", ["image_id"], EIGHT, "c8"))) + f"""
SELECT 4 AS connectivity, image_id, comp AS component, count(*) AS area, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy FROM c4_px GROUP BY ALL
UNION ALL SELECT 8, image_id, comp, count(*), round(avg(x), 6), round(avg(y), 6) FROM c8_px GROUP BY ALL""")
def _(spark, sf):
    mask = px(spark, sf, "ki67").filter("v > 150")
    parts = [
        rounded(stencil.component_stats(stencil.label_components(mask, IMG, c), IMG)).withColumn(
            "connectivity", F.lit(c)
        )
        for c in (4, 8)
    ]
    return parts[0].unionByName(parts[1])


HIST_SQL = """
hr AS (SELECT image_id, min(v) AS lo, max(v) AS hi FROM px GROUP BY 1),
hb AS (SELECT image_id, lo, hi, b.range AS b, lo + (b.range + 0.5) * (hi - lo) / 256 AS ctr FROM hr, range(256) b),
hc AS (SELECT px.image_id, CASE WHEN hi > lo THEN least(floor((v - lo) * 256 / (hi - lo)), 255) ELSE 0 END AS b, count(*) AS c FROM px JOIN hr USING (image_id) GROUP BY ALL),
hist AS (SELECT hb.image_id, hb.lo, hb.hi, hb.b, ctr, coalesce(c, 0) AS c FROM hb LEFT JOIN hc USING (image_id, b))"""
OTSU_SQL = """
ot AS (SELECT image_id, b, ctr, sum(c) OVER w AS w1, sum(c * ctr) OVER w AS s1, sum(c) OVER f AS w2, sum(c * ctr) OVER f AS s2 FROM hist
  WINDOW w AS (PARTITION BY image_id ORDER BY b ROWS UNBOUNDED PRECEDING),
   f AS (PARTITION BY image_id ORDER BY b ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
otsu AS (SELECT image_id, arg_max(ctr, (round(w1 * w2 * pow(s1 / w1 - s2 / w2, 2), 3), -b)) AS threshold FROM ot WHERE w1 > 0 AND w2 > 0 GROUP BY 1)"""
TRIANGLE_SQL = """
tp AS (SELECT image_id, arg_max(b, (c, -b)) AS peak, max(c) AS ph, min(b) FILTER (c > 0) AS alow, max(b) FILTER (c > 0) AS ahigh FROM hist GROUP BY 1),
tf AS (SELECT *, peak - alow < ahigh - peak AS flip FROM tp),
tg AS (SELECT image_id, flip, ph, CASE WHEN flip THEN 255 - ahigh ELSE alow END AS lo_, CASE WHEN flip THEN 255 - peak ELSE peak END AS pk FROM tf),
tl AS (SELECT h.image_id, h.ctr, g.flip, CASE WHEN flip THEN 255 - b ELSE b END AS bb, c, ph, lo_, pk FROM hist h JOIN tg g USING (image_id)),
triangle AS (SELECT image_id, arg_max(ctr, (round((ph * (bb - lo_) - (pk - lo_) * c) / sqrt(ph * ph + (pk - lo_) * (pk - lo_)), 9), -bb)) AS threshold
  FROM tl WHERE bb >= lo_ AND bb < pk GROUP BY 1)"""


@query("threshold_auto", with_ctes(*PIXELS, HIST_SQL, OTSU_SQL, TRIANGLE_SQL, body="""
SELECT 'otsu' AS method, image_id, round(threshold, 6) AS threshold FROM otsu
UNION ALL SELECT 'triangle', image_id, round(threshold, 6) FROM triangle
UNION ALL SELECT 'mean', image_id, round(avg(v), 6) FROM px GROUP BY image_id"""))
def _(spark, sf):
    p = px(spark, sf)
    parts = [
        stencil.threshold_auto(p, IMG, m).withColumn("method", F.lit(m)) for m in ("otsu", "triangle", "mean")
    ]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query("threshold_iterative")
def _(spark, sf):
    p = px(spark, sf, "ki67")
    out = None
    for m in ("isodata", "li", "minimum", "yen"):
        part = stencil.threshold_auto(p, IMG, m).withColumn("method", F.lit(m))
        out = part if out is None else out.unionByName(part)
    return rounded(out)


CLAHE_SQL = """
ch AS (SELECT image_id, x // 4 AS tx, y // 4 AS ty, CAST(v AS INT) AS b, count(*) AS c FROM px GROUP BY ALL),
co AS (SELECT image_id, tx, ty, CAST(sum(greatest(c - 1, 0)) AS BIGINT) AS over FROM ch GROUP BY ALL),
cl AS (SELECT co.image_id, co.tx, co.ty, b.range AS b, least(coalesce(c, 0), 1) + over // 256
   + CASE WHEN over % 256 > 0 AND b.range % greatest(256 // (over % 256), 1) = 0 AND b.range // greatest(256 // (over % 256), 1) < over % 256 THEN 1 ELSE 0 END AS h
  FROM co, range(256) b LEFT JOIN ch ON ch.image_id = co.image_id AND ch.tx = co.tx AND ch.ty = co.ty AND ch.b = b.range),
lut AS (SELECT image_id, tx, ty, b, least(round_even(sum(h) OVER (PARTITION BY image_id, tx, ty ORDER BY b) * (255.0 / 16), 0), 255.0) AS l FROM cl),
cp AS (SELECT image_id, x, y, v, x / 4.0 - 0.5 - floor(x / 4.0 - 0.5) AS xa, y / 4.0 - 0.5 - floor(y / 4.0 - 0.5) AS ya,
   CAST(floor(x / 4.0 - 0.5) AS INT) AS x1, CAST(floor(y / 4.0 - 0.5) AS INT) AS y1 FROM px),
cx AS (SELECT cp.*, least(greatest(x1 + i, 0), 7) AS tx, least(greatest(y1 + j, 0), 7) AS ty,
   (CASE i WHEN 1 THEN xa ELSE 1 - xa END) * (CASE j WHEN 1 THEN ya ELSE 1 - ya END) AS w FROM cp, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(i, j)),
eq AS (SELECT cx.image_id, x, y, round_even(sum(w * l), 0) AS v FROM cx JOIN lut ON lut.image_id = cx.image_id AND lut.tx = cx.tx AND lut.ty = cx.ty AND lut.b = CAST(v AS INT) GROUP BY ALL)"""


@query("clahe", with_ctes(*PIXELS, CLAHE_SQL, body="SELECT * FROM eq"))
def _(spark, sf):
    return stencil.clahe(px(spark, sf), IMG, s.WIDTH, s.HEIGHT)


@query("quantize_levels", with_ctes(*PIXELS, body="""
, q AS (SELECT px.image_id, x, y, v, min(v) OVER w AS lo, max(v) OVER w AS hi FROM px WINDOW w AS (PARTITION BY image_id))
SELECT image_id, x, y, CAST(CASE WHEN hi > lo THEN least(floor((v - lo) / (hi - lo) * 16), 15) ELSE 0 END AS INT) AS level,
  CAST(floor(round_even(v, 0) / 256 * 64) AS INT) AS gray_level FROM q"""))
def _(spark, sf):
    from petridish.operators import texture

    p = px(spark, sf)
    out = texture.quantize_levels(texture.to_uint8(p, IMG), IMG, 16)
    return out.select(
        "image_id", "x", "y", "level", F.floor(F.col("u8") / 256.0 * 64).cast("int").alias("gray_level")
    )
