"""Queries over cell sub-structure, populations and fluorescence."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from petridish.operators import fluorescence, population, stencil, structure
from petridish.operators.scale import with_group_stats
from petridish.session import materialize
from petridish.sources import outlines as outline_source
from registry import standins as s
from registry.rounding import nudged_sql, rounded
from registry.q_roi import BASE, EDGE2_SQL, HULL_SQL, RASTER_SQL, polygons
from registry.q_stencil import EIGHT, FOUR, SOBEL_SQL, component_sql, ellipse, values
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
CELL = ["image_id", "label"]
W, H = s.WIDTH, s.HEIGHT


def px(spark, sf, channel="phase"):
    return s.pixels(spark, sf, channel).drop("dataset")


def region(spark, sf, name):
    return s.label_pixels(spark, sf).filter(F.col("region") == name).drop("dataset", "region")


# --- nucleoli: blur with folded indices on each nucleus box -------------------------------


def nucleolus_sql():
    def terms(sigma):
        return stencil.gaussian_weights(sigma)

    fine, coarse = terms(1.0), terms(3.0)
    offs = sorted(coarse)
    rows = ", ".join(f"({k}, {fine.get(k, 0.0)!r}, {coarse[k]!r})" for k in offs)

    def fold(axis, low, n):
        i = f"(p.{axis} - {low} + k)"
        m = f"((({i} % greatest(2 * {n} - 2, 1)) + greatest(2 * {n} - 2, 1)) % greatest(2 * {n} - 2, 1))"
        return f"{low} + CASE WHEN {n} = 1 THEN 0 WHEN {m} < {n} THEN {m} ELSE 2 * {n} - 2 - {m} END"

    return f"""
kw(k, f, c) AS (VALUES {rows}),
nb AS (SELECT image_id, label, min(x) AS x0, max(x) - min(x) + 1 AS nx, min(y) AS y0, max(y) - min(y) + 1 AS ny FROM lp WHERE region = 'nuc' GROUP BY ALL),
ng AS (SELECT b.image_id, b.label, x0, nx, y0, ny, q.x, q.y, q.v, l.x IS NOT NULL AS m FROM nb b JOIN px q ON q.image_id = b.image_id AND q.x BETWEEN x0 AND x0 + nx - 1
   AND q.y BETWEEN y0 AND y0 + ny - 1 LEFT JOIN lp l ON l.image_id = b.image_id AND l.label = b.label AND l.region = 'nuc' AND l.x = q.x AND l.y = q.y),
n1 AS (SELECT p.image_id, p.label, p.x0, p.nx, p.y0, p.ny, p.x, p.y, p.m, sum(f * q.v) AS a, sum(c * q.v) AS b FROM ng p, kw
   JOIN ng q ON q.image_id = p.image_id AND q.label = p.label AND q.y = p.y AND q.x = {fold('x', 'p.x0', 'p.nx')} GROUP BY ALL),
n2 AS (SELECT p.image_id, p.label, p.x, p.y, p.m, round(sum(f * q.a) - sum(c * q.b), 9) AS s FROM n1 p, kw
   JOIN n1 q ON q.image_id = p.image_id AND q.label = p.label AND q.x = p.x AND q.y = {fold('y', 'p.y0', 'p.ny')} GROUP BY ALL),
n3 AS (SELECT *, max(t) OVER (PARTITION BY image_id, label, x ORDER BY y ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS top FROM
   (SELECT *, max(s) OVER (PARTITION BY image_id, label, y ORDER BY x ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS t FROM n2)),
nt AS (SELECT image_id, label, min(s) AS lo, max(s) AS hi, greatest(min(s) + 0.3 * (max(s) - min(s)), quantile_cont(s, 0.9), avg(s) + stddev_pop(s)) AS lim FROM n3 WHERE m GROUP BY ALL),
nbr AS (SELECT n3.image_id, n3.label, x, y, s >= top - 1e-7 AS peak FROM n3 JOIN nt USING (image_id, label) WHERE m AND hi > lo AND s >= lim)"""


@query("nucleolus", "WITH RECURSIVE " + ",".join((*BASE, nucleolus_sql(), component_sql("nbr", ["image_id", "label"], EIGHT, "ns"))) + """,
nsz AS (SELECT image_id, label, comp, count(*) AS area, bool_or(peak) AS pk FROM ns_px JOIN nbr USING (image_id, label, x, y) GROUP BY ALL)
SELECT b.image_id, b.label, count(area) AS nucleolus_count, round(avg(area), 6) AS mean_nucleolus_area, CAST(max(area) AS DOUBLE) AS max_nucleolus_area
FROM nb b LEFT JOIN (SELECT * FROM nsz WHERE pk) z USING (image_id, label) GROUP BY ALL""")
def _(spark, sf):
    return rounded(structure.nucleolus(region(spark, sf, "nuc"), px(spark, sf), IMG))


# --- halo ---------------------------------------------------------------------------------

HALO_SQL = f"""
cy AS (SELECT image_id, label, x, y FROM lp WHERE region = 'cyto'),
ca AS (SELECT image_id, label, greatest(2, CAST(round_even(0.2 * sqrt(count(*) / {math.pi}), 0) AS INT)) AS r FROM cy GROUP BY ALL),
hel(r, dx, dy) AS (VALUES {', '.join(f'({r}, {a}, {b})' for r in (2, 3) for a, b in ellipse(r))}),
box3(dx, dy) AS (VALUES {', '.join(f'({a}, {b})' for a in (-1, 0, 1) for b in (-1, 0, 1))}),
grown AS (SELECT DISTINCT cy.image_id, cy.label, x + dx AS x, y + dy AS y FROM cy JOIN ca USING (image_id, label) JOIN hel USING (r) WHERE x + dx BETWEEN 0 AND 31 AND y + dy BETWEEN 0 AND 31),
kept AS (SELECT a.image_id, a.label, a.x, a.y FROM cy a JOIN ca USING (image_id, label) JOIN hel USING (r) LEFT JOIN cy b ON b.image_id = a.image_id AND b.label = a.label AND b.x = a.x + dx AND b.y = a.y + dy
   GROUP BY ALL HAVING count(*) FILTER (a.x + dx BETWEEN 0 AND 31 AND a.y + dy BETWEEN 0 AND 31 AND b.x IS NULL) = 0),
bgrown AS (SELECT DISTINCT image_id, label, x + dx AS x, y + dy AS y FROM cy, box3 WHERE x + dx BETWEEN 0 AND 31 AND y + dy BETWEEN 0 AND 31),
bkept AS (SELECT a.image_id, a.label, a.x, a.y FROM cy a, box3 LEFT JOIN cy b ON b.image_id = a.image_id AND b.label = a.label AND b.x = a.x + dx AND b.y = a.y + dy
   GROUP BY ALL HAVING count(*) FILTER (a.x + dx BETWEEN 0 AND 31 AND a.y + dy BETWEEN 0 AND 31 AND b.x IS NULL) = 0),
rings AS (SELECT *, 'inner' AS ring FROM (SELECT * FROM cy EXCEPT SELECT * FROM kept)
  UNION ALL SELECT *, 'outer' FROM (SELECT * FROM grown EXCEPT SELECT * FROM cy)
  UNION ALL SELECT *, 'boundary' FROM (SELECT * FROM bgrown EXCEPT SELECT * FROM bkept))"""


@query("halo_rings", with_ctes(s.GEOMETRY_SQL, s.LABELS_SQL, HALO_SQL, body="SELECT image_id, label, ring, x, y FROM rings"))
def _(spark, sf):
    return structure.halo_rings(region(spark, sf, "cyto"), CELL, W, H)


@query("halo_stats", with_ctes(*BASE, SOBEL_SQL, HALO_SQL, body="""
, hj AS (SELECT r.image_id, r.label, ring, px.v, edge FROM rings r JOIN px USING (image_id, x, y) JOIN sobel USING (image_id, x, y)),
ha AS (SELECT image_id, label, avg(v) FILTER (ring = 'outer') AS om, stddev_pop(v) FILTER (ring = 'outer') AS os, avg(v) FILTER (ring = 'inner') AS im,
  stddev_pop(v) FILTER (ring = 'inner') AS isd, avg(edge) FILTER (ring = 'boundary') AS es FROM hj GROUP BY ALL)
SELECT image_id, label, round(om, 6) AS halo_outer_mean, round(os, 6) AS halo_outer_std, round(im, 6) AS halo_inner_mean, round(isd, 6) AS halo_inner_std,
  round(es, 6) AS edge_sharpness, round(os / om, 6) AS halo_outer_cv, round(abs(om - im), 6) AS halo_inner_outer_diff FROM ha"""))
@s.by_image
def _(spark, sf):
    cells, signal = region(spark, sf, "cyto"), px(spark, sf)
    rings = structure.halo_rings(cells, CELL, W, H)
    return rounded(structure.halo_stats(rings, signal, stencil.sobel_edges(signal, IMG), IMG, CELL))


@query("halo_angular_variance", with_ctes(*BASE, HALO_SQL, body=f"""
, cc AS (SELECT image_id, label, avg(x) AS cx, avg(y) AS cy_ FROM cy GROUP BY ALL),
an AS (SELECT r.image_id, r.label, v, atan2(r.y - cy_, r.x - cx) AS t FROM rings r JOIN cc USING (image_id, label) JOIN px USING (image_id, x, y) WHERE ring = 'outer'),
se AS (SELECT image_id, label, least(floor((CASE WHEN t < 0 THEN t + 2 * {math.pi!r} ELSE t END) / (2 * {math.pi!r}) * 36), 35) AS sec, avg(v) AS m FROM an GROUP BY ALL)
SELECT image_id, label, CASE WHEN count(*) >= 9 THEN round(var_pop(m), 6) END AS halo_angular_variance FROM se GROUP BY ALL"""))
@s.by_image
def _(spark, sf):
    cells = region(spark, sf, "cyto")
    rings = structure.halo_rings(cells, CELL, W, H)
    return rounded(structure.halo_angular_variance(rings, cells, px(spark, sf), IMG, CELL))


RAY_SQL = f"""
cy AS (SELECT image_id, label, x, y FROM lp WHERE region = 'cyto'),
cc AS (SELECT image_id, label, avg(x) AS cx, avg(y) AS cy_ FROM cy GROUP BY ALL),
ry(ray, c, s) AS (VALUES {', '.join(f'({k}, {math.cos(2 * math.pi * k / 16)!r}, {math.sin(2 * math.pi * k / 16)!r})' for k in range(16))}),
ed AS (SELECT cc.image_id, cc.label, ray, c, s, cx, cy_, max(t.range) AS edge FROM cc, ry, range(24) t
   JOIN cy ON cy.image_id = cc.image_id AND cy.label = cc.label AND cy.x = round_even(cx + t.range * c, 0) AND cy.y = round_even(cy_ + t.range * s, 0)
   WHERE cx + t.range * c BETWEEN 0 AND 31 AND cy_ + t.range * s BETWEEN 0 AND 31 GROUP BY ALL),
pr AS (SELECT image_id, label, ray, o.range AS o, round_even((cx + (edge + o.range) * c) * 32, 0) / 32 AS sx, round_even((cy_ + (edge + o.range) * s) * 32, 0) / 32 AS sy
   FROM ed, range(16) o WHERE cx + (edge + o.range) * c BETWEEN 0 AND 31 AND cy_ + (edge + o.range) * s BETWEEN 0 AND 31),
pc AS (SELECT pr.*, i, j, (CASE i WHEN 1 THEN sx - floor(sx) ELSE 1 - sx + floor(sx) END) * (CASE j WHEN 1 THEN sy - floor(sy) ELSE 1 - sy + floor(sy) END) AS w
   FROM pr, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) q(i, j)),
sm AS (SELECT pc.image_id, label, ray, o, sum(w * v) AS v FROM pc JOIN px ON px.image_id = pc.image_id AND px.x = least(floor(sx) + i, 31) AND px.y = least(floor(sy) + j, 31) WHERE w > 0 GROUP BY ALL),
sl AS (SELECT image_id, label, ray, regr_slope(v, o) AS slope FROM sm GROUP BY ALL HAVING count(*) >= 3)"""


@query("halo_radial_gradient", with_ctes(*BASE, RAY_SQL, body="""
SELECT image_id, label, round(avg(slope), 6) AS halo_radial_gradient FROM sl GROUP BY ALL"""))
@s.by_image
def _(spark, sf):
    cells = region(spark, sf, "cyto")
    return rounded(structure.halo_radial_gradient(cells, px(spark, sf), IMG, CELL, W, H))


BG_SQL = """
refs AS (SELECT image_id, x, y FROM lp WHERE region = 'cyto'
  UNION SELECT image_id, x, y FROM lp l WHERE region = 'nuc' AND NOT EXISTS (SELECT 1 FROM lp c WHERE c.image_id = l.image_id AND c.label = l.label AND c.region = 'cyto')),
bgp AS (SELECT px.* FROM px ANTI JOIN refs USING (image_id, x, y)),
bgs AS (SELECT image_id, avg(v) AS bm, stddev_pop(v) AS bs FROM bgp GROUP BY 1)"""


def reference_pixels(spark, sf):
    """Cell pixels; nucleus pixels where a cell has no outline."""
    lp = s.label_pixels(spark, sf).drop("dataset")
    with_cell = lp.filter("region = 'cyto'").select("image_id", "label").distinct()
    lone = lp.filter("region = 'nuc'").join(with_cell, CELL, "left_anti")
    return lp.filter("region = 'cyto'").unionByName(lone).drop("region")


@query("halo_width", with_ctes(*BASE, BG_SQL, """
cy AS (SELECT image_id, label, x, y FROM lp WHERE region = 'cyto'),
hd AS (SELECT cy.image_id, cy.label, px.x, px.y, px.v, min(greatest(abs(px.x - cy.x), abs(px.y - cy.y))) AS d FROM cy JOIN px ON px.image_id = cy.image_id
   AND abs(px.x - cy.x) <= 15 AND abs(px.y - cy.y) <= 15 GROUP BY ALL),
hw AS (SELECT image_id, label, CASE WHEN d <= 3 THEN 3 WHEN d <= 5 THEN 5 WHEN d <= 7 THEN 7 WHEN d <= 9 THEN 9 WHEN d <= 11 THEN 11 WHEN d <= 13 THEN 13 ELSE 15 END AS w, avg(v) AS m
   FROM hd WHERE d > 0 GROUP BY ALL)""", body="""
SELECT c.image_id, c.label, CAST(min(w) FILTER (m <= bm + 0.05 * bs) AS DOUBLE) AS halo_width FROM (SELECT DISTINCT image_id, label FROM cy) c
LEFT JOIN hw USING (image_id, label) LEFT JOIN bgs USING (image_id) GROUP BY ALL"""))
@s.by_image
def _(spark, sf):
    signal = px(spark, sf)
    background = signal.join(reference_pixels(spark, sf).select("image_id", "x", "y").distinct(), ["image_id", "x", "y"], "left_anti")
    # a tight limit (0.05 instead of 1.5 deviations) so that several widths occur
    stats = background.groupBy("image_id").agg(
        F.avg("v").alias("bg_mean"), (F.stddev_pop("v") / 30.0).alias("bg_std")
    )
    return structure.halo_width(region(spark, sf, "cyto"), signal, stats, IMG, CELL, W, H)


# --- outline complexity -------------------------------------------------------------------


@query("fractal_dimension", with_ctes(s.GEOMETRY_SQL, s.LABELS_SQL, HALO_SQL, body="""
, bx AS (SELECT image_id, label, s, count(DISTINCT (x // s) * 1000 + y // s) AS n FROM rings, (VALUES (2), (4), (8), (16), (32)) z(s) WHERE ring = 'boundary' GROUP BY ALL)
SELECT image_id, label, round(regr_slope(ln(n), ln(1.0 / s)), 6) AS fractal_dimension FROM bx GROUP BY ALL"""))
def _(spark, sf):
    return rounded(structure.fractal_dimension(region(spark, sf, "cyto"), CELL, W, H))


@query("boundary_inflection", with_ctes(s.GEOMETRY_SQL, s.VERTEX_SQL, body="""
, t AS (SELECT b.image_id, b.roi_id, b.region, b.pos, b.n, sign((b.x - a.x) * (c.y - b.y) - (b.y - a.y) * (c.x - b.x)) AS sg FROM vert a
  JOIN vert b ON b.image_id = a.image_id AND b.roi_id = a.roi_id AND b.region = a.region AND b.pos = (a.pos + 1) % a.n
  JOIN vert c ON c.image_id = a.image_id AND c.roi_id = a.roi_id AND c.region = a.region AND c.pos = (a.pos + 2) % a.n),
u AS (SELECT *, lag(sg) OVER (PARTITION BY image_id, roi_id, region ORDER BY pos) AS prev, last(sg) OVER (PARTITION BY image_id, roi_id, region ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fin FROM t WHERE sg <> 0)
SELECT image_id, roi_id, region, CAST(CASE WHEN max(n) >= 8 THEN count(*) FILTER (sg <> coalesce(prev, fin)) END AS INT) AS boundary_inflection_count FROM u GROUP BY ALL"""))
def _(spark, sf):
    return structure.boundary_inflection(polygons(spark, sf), "points").drop("points")


@query("convex_defects", with_ctes(s.GEOMETRY_SQL, s.VERTEX_SQL, HULL_SQL, body=f"""
, hv AS (SELECT v.image_id, v.roi_id, v.region, v.pos, v.n, v.x, v.y, h.p IS NOT NULL AS corner FROM vert v LEFT JOIN (SELECT DISTINCT image_id, roi_id, region, p FROM hull) h
  ON h.image_id = v.image_id AND h.roi_id = v.roi_id AND h.region = v.region AND h.p = v.pos),
gp AS (SELECT v.image_id, v.roi_id, v.region, v.x, v.y,
  (SELECT arg_max(struct_pack(x := c.x, y := c.y, p := c.pos), CASE WHEN c.pos < v.pos THEN c.pos ELSE c.pos - v.n END) FROM hv c WHERE c.image_id = v.image_id AND c.roi_id = v.roi_id AND c.region = v.region AND c.corner) AS a,
  (SELECT arg_min(struct_pack(x := c.x, y := c.y), CASE WHEN c.pos > v.pos THEN c.pos ELSE c.pos + v.n END) FROM hv c WHERE c.image_id = v.image_id AND c.roi_id = v.roi_id AND c.region = v.region AND c.corner) AS b
  FROM hv v WHERE NOT v.corner),
dp AS (SELECT image_id, roi_id, region, a.p AS gap, round_even(max(abs((b.x - a.x) * (y - a.y) - (b.y - a.y) * (x - a.x)) / sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2))) * 256, 0) / 256 AS d FROM gp GROUP BY ALL),
lim AS (SELECT image_id, roi_id, region, 2 * sqrt(parea / {math.pi}) AS dia, greatest(3.0, 0.06 * sqrt(parea / {math.pi})) AS t FROM per WHERE parea > 0)
SELECT l.image_id, l.roi_id, l.region, CAST(count(d) FILTER (d > t) AS INT) AS protrusion_count, round(avg(d) FILTER (d > t), 6) AS mean_convex_defect_depth,
  round(avg(d) FILTER (d > t) / max(dia), 6) AS mean_protrusion_length_norm, round(max(d) FILTER (d > t), 6) AS max_convex_defect_depth
FROM lim l LEFT JOIN dp USING (image_id, roi_id, region) GROUP BY ALL"""))
def _(spark, sf):
    return rounded(structure.convex_defects(polygons(spark, sf), "points").drop("points"))


# --- debris -------------------------------------------------------------------------------

DEBRIS_SQL = BG_SQL + f""",
gr AS (SELECT DISTINCT image_id, x + dx AS x, y + dy AS y FROM refs, (VALUES {values(ellipse(1))}) o(dx, dy)),
dbg AS (SELECT px.image_id, px.x, px.y, px.v FROM px ANTI JOIN gr USING (image_id, x, y) JOIN lim0 USING (image_id)),
dr AS (SELECT image_id, min(v) AS lo, max(v) AS hi FROM dbg GROUP BY 1),
dc AS (SELECT dbg.image_id, CASE WHEN hi > lo THEN least(floor((v - lo) * 256 / (hi - lo)), 255) ELSE 0 END AS b, count(*) AS c FROM dbg JOIN dr USING (image_id) GROUP BY ALL),
dh AS (SELECT dr.image_id, b.range AS b, lo + (b.range + 0.5) * (hi - lo) / 256 AS ctr, coalesce(c, 0) AS c FROM dr, range(256) b LEFT JOIN dc ON dc.image_id = dr.image_id AND dc.b = b.range),
dw AS (SELECT image_id, b, ctr, sum(c) OVER w AS w1, sum(c * ctr) OVER w AS s1, sum(c) OVER f AS w2, sum(c * ctr) OVER f AS s2 FROM dh
  WINDOW w AS (PARTITION BY image_id ORDER BY b ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY image_id ORDER BY b ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
dth AS (SELECT image_id, arg_max(ctr, (round(w1 * w2 * pow(s1 / w1 - s2 / w2, 2), 3), -b)) AS t FROM dw WHERE w1 > 0 AND w2 > 0 GROUP BY 1),
dm AS (SELECT dbg.image_id, x, y FROM dbg JOIN dth USING (image_id) WHERE v >= t)"""


@query("debris", "WITH RECURSIVE " + ",".join((*BASE, """
nar AS (SELECT image_id, label, count(*) AS a FROM lp WHERE region = 'nuc' GROUP BY ALL),
lim0 AS (SELECT image_id, median(a) * 0.9 AS mx FROM nar GROUP BY 1 HAVING median(a) * 0.9 >= 2)""", DEBRIS_SQL, component_sql("dm", ["image_id"], FOUR, "dp"))) + """,
pa AS (SELECT image_id, comp, count(*) AS area, avg(x) AS cx, avg(y) AS cy FROM dp_px GROUP BY ALL),
pk AS (SELECT pa.* FROM pa JOIN lim0 USING (image_id) WHERE area >= 2 AND area <= mx),
im AS (SELECT image_id, count(*) AS bg FROM dbg GROUP BY 1),
tt AS (SELECT image_id, count(*) AS n, sum(area) AS sm, avg(area) AS mn FROM pk GROUP BY 1),
ce AS (SELECT image_id, label, avg(x) AS x, avg(y) AS y FROM lp WHERE region = 'cyto' GROUP BY ALL),
nr AS (SELECT ce.image_id, label, min(sqrt(pow(ce.x - cx, 2) + pow(ce.y - cy, 2))) AS d FROM ce JOIN pk USING (image_id) GROUP BY ALL)
SELECT ce.image_id, ce.label, CASE WHEN bg IS NOT NULL THEN CAST(coalesce(n, 0) AS DOUBLE) END AS debris_count, round(coalesce(sm, 0) / bg, 6) AS debris_area_fraction,
  round(mn, 6) AS debris_mean_area, round(coalesce(n, 0) / bg, 6) AS debris_density, round(d, 6) AS nearest_debris_distance
FROM ce LEFT JOIN im USING (image_id) LEFT JOIN tt USING (image_id) LEFT JOIN nr USING (image_id, label)""")
@s.by_image
def _(spark, sf):
    nuc = region(spark, sf, "nuc").groupBy(*CELL).agg(F.count(F.lit(1)).alias("a"))
    medians = nuc.groupBy("image_id").agg(F.median("a").alias("median_nucleus_area"))
    # sizes fit the small stand-in cells
    config = {"threshold_method": "otsu", "min_size_px": 2, "max_size_fraction_of_median_nucleus_area": 0.9, "cell_dilate_px": 1}
    particles, areas = structure.debris_particles(
        px(spark, sf), reference_pixels(spark, sf), IMG, W, H, medians, config
    )
    centres = region(spark, sf, "cyto").groupBy(*CELL).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return rounded(structure.debris_features(centres, particles, areas, IMG))


@query("debris_watershed")
def _(spark, sf):
    """Particles above a rolling ball, touching ones cut by the watershed."""
    nuc = region(spark, sf, "nuc").groupBy(*CELL).agg(F.count(F.lit(1)).alias("a"))
    medians = nuc.groupBy("image_id").agg(F.median("a").alias("median_nucleus_area"))
    config = {
        "threshold_method": "otsu", "min_size_px": 2, "max_size_fraction_of_median_nucleus_area": 0.9, "cell_dilate_px": 1,
        "subtract_background": True, "rolling_ball_radius": 6.0, "watershed": True,
    }
    particles, _ = structure.debris_particles(px(spark, sf), reference_pixels(spark, sf), IMG, W, H, medians, config)
    return rounded(particles)


# --- population ---------------------------------------------------------------------------

POP_SQL = s.CELLS_SQL + f""",
pop AS (SELECT image_id, cell_id AS label, x, y, CASE WHEN cell_id % 29 <> 0 THEN area END AS area, nuc_area, CASE WHEN cell_id % 31 <> 0 THEN 0.5 + k / 200.0 END AS circularity FROM cells),
pst AS (SELECT image_id, count(*) AS cells, sum(area) / 1000000.0 AS conf, stddev_pop(area) / avg(area) AS acv, stddev_pop(circularity) / avg(circularity) AS ccv,
  median(area) AS median_area, median(nuc_area) AS median_nucleus_area, 2 * sqrt(median(area) / {math.pi}) AS dia FROM pop GROUP BY 1)"""
PAIR_SQL = POP_SQL + """,
pp AS (SELECT a.image_id, a.label, a.area, b.label AS other, b.area AS oarea, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d FROM pop a JOIN pop b ON a.image_id = b.image_id AND a.label <> b.label)"""


def pop(spark, sf):
    return s.cells(spark, sf).select(
        "image_id",
        F.col("cell_id").alias("label"),
        "x",
        "y",
        F.expr("case when cell_id % 29 <> 0 then area end").alias("area"),
        "nuc_area",
        F.expr("case when cell_id % 31 <> 0 then 0.5D + k / 200D end").alias("circularity"),
    )


def pop_stats(spark, sf):
    return population.population_stats(pop(spark, sf), IMG, 1000, 1000)


@query("confluency", with_ctes(POP_SQL, body="SELECT image_id, round(conf, 8) AS image_confluency FROM pst"))
def _(spark, sf):
    return rounded(pop_stats(spark, sf).select("image_id", "image_confluency"), 8)


@query("population_cv", with_ctes(POP_SQL, body="SELECT image_id, round(acv, 6) AS population_area_cv, round(ccv, 6) AS population_circularity_cv FROM pst"))
def _(spark, sf):
    return rounded(pop_stats(spark, sf).select("image_id", "population_area_cv", "population_circularity_cv"))


@query("median_cell_size", with_ctes(POP_SQL, body="""
SELECT image_id, cells, round(median_area, 6) AS median_area, round(median_nucleus_area, 6) AS median_nucleus_area, round(dia, 6) AS median_diameter FROM pst"""))
def _(spark, sf):
    return rounded(pop_stats(spark, sf).select("image_id", "cells", "median_area", "median_nucleus_area", "median_diameter"))


@query("mitotic_index", with_ctes(POP_SQL, body="""
SELECT image_id, round(avg(CASE WHEN circularity > 0.85 AND area < 0.6 * median_area THEN 1.0 ELSE 0.0 END) FILTER (area IS NOT NULL AND circularity IS NOT NULL), 6) AS mitotic_index
FROM pop JOIN pst USING (image_id) GROUP BY 1"""))
def _(spark, sf):
    return rounded(population.mitotic_index(pop(spark, sf), pop_stats(spark, sf), IMG))


@query("nearest_neighbor", with_ctes(PAIR_SQL, body="""
SELECT image_id, label, other, round(d, 6) AS d, round(d / dia, 6) AS d_norm FROM (SELECT * FROM pp QUALIFY row_number() OVER (PARTITION BY label ORDER BY d, other) = 1) JOIN pst USING (image_id)"""))
def _(spark, sf):
    from petridish.functions.numeric import safe_divide

    near = population.nearest_cells(pop(spark, sf), IMG).drop("pos")
    out = near.join(pop_stats(spark, sf).select("image_id", "median_diameter"), "image_id")
    return rounded(out.select("image_id", "label", "other", "d", safe_divide("d", "median_diameter").alias("d_norm")))


@query("knn_area_ratio", with_ctes(PAIR_SQL, body="""
, t AS (SELECT * FROM pp QUALIFY row_number() OVER (PARTITION BY label ORDER BY d, other) <= 3),
m AS (SELECT label, avg(oarea) AS mo FROM t WHERE oarea > 0 GROUP BY 1)
SELECT image_id, pop.label, round(area / mo, 6) AS neighbour_area_ratio FROM pop LEFT JOIN m USING (label)"""))
def _(spark, sf):
    c = pop(spark, sf)
    return rounded(population.knn_area_ratio(c, population.nearest_cells(c, IMG, 3), IMG))


@query("neighbor_count_density", with_ctes(PAIR_SQL, body=f"""
, n AS (SELECT label, count(*) AS c FROM pp JOIN pst USING (image_id) WHERE d <= 2 * dia GROUP BY 1)
SELECT image_id, pop.label, coalesce(c, 0) AS local_neighbor_count, round(coalesce(c, 0) / ({math.pi} * pow(2 * dia, 2)), 10) AS local_density
FROM pop JOIN pst USING (image_id) LEFT JOIN n USING (label)"""))
def _(spark, sf):
    return rounded(population.neighbour_count(pop(spark, sf), pop_stats(spark, sf), IMG), 10)


@query("cluster_sizes", "WITH RECURSIVE " + ",".join((PAIR_SQL, """
ce AS (SELECT image_id, label AS a, other AS b FROM pp JOIN pst USING (image_id) WHERE d <= 5 * dia),
cl(id, comp) USING KEY (id) AS (SELECT label, label FROM pop UNION
  SELECT e.b, min(c.comp) FROM cl c JOIN ce e ON e.a = c.id JOIN recurring.cl r ON r.id = e.b WHERE c.comp < r.comp GROUP BY e.b),
sz AS (SELECT image_id, comp, count(*) AS n FROM cl JOIN pop ON label = id GROUP BY ALL),
tp AS (SELECT image_id, max(n) AS top FROM sz GROUP BY 1)""")) + """
SELECT pop.image_id, pop.label, n AS cluster_size, round(n / cells, 6) AS cluster_size_norm, round(top / cells, 6) AS largest_cluster_ratio
FROM pop JOIN cl ON id = label JOIN sz ON sz.image_id = pop.image_id AND sz.comp = cl.comp JOIN tp ON tp.image_id = pop.image_id JOIN pst ON pst.image_id = pop.image_id""")
def _(spark, sf):
    return rounded(population.cluster_sizes(pop(spark, sf), pop_stats(spark, sf), IMG, 5.0))


@query("mitosis_scores", with_ctes(POP_SQL, body=f"""
, m AS (SELECT label, area, circularity + CASE WHEN label % 5 = 0 THEN 0.4 ELSE 0 END AS c, median_area AS ma, CASE WHEN label % 7 <> 0 THEN 2 + (label % 50) / 10.0 END AS ent,
  (label % 30) / 10.0 AS av, CASE WHEN label % 11 <> 0 THEN (label % 20) / 10.0 END AS os, (label % 23) / 2.0 AS nd, area * (0.7 + (label % 60) / 100.0) AS na,
  CASE WHEN label % 13 <> 0 THEN CAST(label % 9 AS DOUBLE) END AS pc FROM pop JOIN pst USING (image_id)),
p AS (SELECT *, CASE WHEN c IS NOT NULL THEN least(greatest(c, 0), 1) END AS r, CASE WHEN area IS NOT NULL THEN 1 - least(greatest((area / ma - 0.6) / (1.4 - 0.6), 0), 1) END AS sm,
  CASE WHEN ent IS NOT NULL THEN least(greatest(1 - ent / ln(4096), 0), 1) END AS un, CASE WHEN os IS NOT NULL THEN least(greatest(1 - av / greatest(os * os, 1e-12), 0), 1) END AS sy,
  CASE WHEN pc IS NOT NULL THEN 1 - least(greatest(pc / 6.0, 0), 1) END AS ps FROM m)
SELECT label, round(r * sm * un * sy, 6) AS mitotic_score,
  CASE WHEN nd < sqrt(ma / {math.pi}) AND abs(area - na) / greatest((area + na) / 2, 1e-12) < 0.25 THEN 1.0 ELSE 0.0 END::DOUBLE AS daughter_pair_flag,
  round(list_avg(list_filter([r, sm, ps], lambda v: v IS NOT NULL)), 6) AS protrusion_retraction_score FROM p"""))
def _(spark, sf):
    c = pop(spark, sf).join(pop_stats(spark, sf).select("image_id", "median_area"), "image_id")
    c = c.select(
        "label",
        "area",
        F.expr("circularity + case when label % 5 = 0 then 0.4D else 0D end").alias("circularity"),
        "median_area",
        F.expr("case when label % 7 <> 0 then 2 + (label % 50) / 10D end").alias("glcm_entropy"),
        F.expr("(label % 30) / 10D").alias("halo_angular_variance"),
        F.expr("case when label % 11 <> 0 then (label % 20) / 10D end").alias("halo_outer_std"),
        F.expr("(label % 23) / 2D").alias("nearest_distance"),
        F.expr("area * (0.7D + (label % 60) / 100D)").alias("nearest_area"),
        F.expr("case when label % 13 <> 0 then cast(label % 9 as double) end").alias("protrusion_count"),
    )
    out = population.mitosis_scores(c)
    return rounded(out.select("label", "mitotic_score", "daughter_pair_flag", "protrusion_retraction_score"))


# --- fluorescence -------------------------------------------------------------------------

# rings of the wide table; `fluor_rings` has all that the operator grows
STEPS = 5
RINGS = 20


def scaled_sql(steps):
    move = "CASE WHEN {0} >= 0 THEN floor({0}) ELSE ceil({0}) END"
    sx = move.format("(mx + (v.x - mx) * (1 + 0.5 * k.range))")
    sy = move.format("(my + (v.y - my) * (1 + 0.5 * k.range))")
    shape = RASTER_SQL[RASTER_SQL.index("bb AS") :]
    ring = shape.replace("bb AS", "rbb AS").replace("ras AS", "rras AS").replace("FROM vert", "FROM sv").replace("FROM bb", "FROM rbb bb").replace("JOIN eg ", "JOIN seg eg ")
    ring = ring.replace("image_id, roi_id, region", "image_id, roi_id, step").replace("bb.region", "bb.step").replace("eg.region", "eg.step")
    return f"""
pairs AS (SELECT image_id, roi_id FROM vert GROUP BY ALL HAVING count(DISTINCT region) = 2),
nbx AS (SELECT image_id, roi_id, (min(x) + max(x)) / 2 AS mx, (min(y) + max(y)) / 2 AS my FROM vert JOIN pairs USING (image_id, roi_id) WHERE region = 'nuc' GROUP BY ALL),
sv AS (SELECT v.image_id, v.roi_id, CAST(k.range AS INT) AS step, pos, n, CAST({sx} AS INT) AS x, CAST({sy} AS INT) AS y FROM vert v JOIN nbx USING (image_id, roi_id), range({steps + 1}) k WHERE region = 'nuc'),
seg AS (SELECT a.image_id, a.roi_id, a.step, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM sv a JOIN sv b ON a.image_id = b.image_id AND a.roi_id = b.roi_id AND a.step = b.step AND b.pos = (a.pos + 1) % a.n),
{shape},
{ring},
cp AS (SELECT ras.image_id, ras.roi_id, x, y FROM ras JOIN pairs USING (image_id, roi_id) WHERE region = 'cyto'),
sp AS (SELECT DISTINCT image_id, roi_id, step FROM (SELECT * FROM rras ANTI JOIN cp USING (image_id, roi_id, x, y))),
mem AS (SELECT r.* FROM rras r JOIN cp USING (image_id, roi_id, x, y)),
lag_ AS (SELECT m.image_id, m.roi_id, m.step, m.x, m.y, p.x IS NOT NULL AS inner_, sp.step IS NOT NULL AS spills FROM mem m
  LEFT JOIN rras p ON p.image_id = m.image_id AND p.roi_id = m.roi_id AND p.step = m.step - 1 AND p.x = m.x AND p.y = m.y
  LEFT JOIN sp ON sp.image_id = m.image_id AND sp.roi_id = m.roi_id AND sp.step = m.step - 1 WHERE m.step > 0),
fr AS (SELECT DISTINCT image_id, roi_id, step FROM lag_ WHERE NOT inner_),
rg AS (SELECT l.image_id, l.roi_id, l.step - 1 AS ring, l.x, l.y FROM lag_ l JOIN fr USING (image_id, roi_id, step) WHERE NOT spills OR NOT inner_)"""


RING_BODY = "SELECT rg.image_id, roi_id, ring, round(count(*) * avg(v), 6) AS \"IntDen\", sum(v) AS \"RawIntDen\" FROM rg JOIN px USING (image_id, x, y) GROUP BY ALL"


def rings(spark, sf, steps):
    pairs = outline_source.paired_only(s.outlines(spark, sf)).drop("dataset")
    return fluorescence.fluor_rings(pairs, px(spark, sf, "ido"), IMG, s.WIDTH, s.HEIGHT, steps=steps)


def ring_sql(steps):
    return (s.GEOMETRY_SQL, s.IMAGES_SQL, s.pixels_sql("ido"), s.VERTEX_SQL, EDGE2_SQL, scaled_sql(steps))


@query("fluor_rings", with_ctes(*ring_sql(RINGS), body=RING_BODY))
def _(spark, sf):
    return rounded(rings(spark, sf, RINGS))


@query("flatten_rings", with_ctes(*ring_sql(STEPS), f"res AS ({RING_BODY})", body="""
SELECT image_id || '.tif_' || roi_id AS "Cell_ID", """ + ", ".join(
    f'max("{v}") FILTER (ring = {k}) AS "{v}-{k}"' for v in ("IntDen", "RawIntDen") for k in range(STEPS)
) + " FROM res GROUP BY 1"))
def _(spark, sf):
    r = rings(spark, sf, STEPS).select(
        F.concat(F.col("image_id"), F.lit(".tif:NewCell-"), F.col("roi_id"), F.lit("-and"), F.col("ring")).alias("Label"),
        "IntDen",
        "RawIntDen",
    )
    return rounded(fluorescence.flatten_rings(r, STEPS))


@query("ido_measure", with_ctes(s.GEOMETRY_SQL, s.IMAGES_SQL, s.LABELS_SQL, s.pixels_sql("ido"), body="""
, pr AS (SELECT image_id, label FROM lp GROUP BY ALL HAVING count(DISTINCT region) = 2),
cv AS (SELECT DISTINCT lp.image_id, x, y FROM lp JOIN pr USING (image_id, label) WHERE region = 'cyto'),
bg AS (SELECT image_id, median(v) AS b FROM px ANTI JOIN cv USING (image_id, x, y) GROUP BY 1),
ct AS (SELECT c.image_id, c.label, c.x, c.y FROM lp c JOIN pr USING (image_id, label) ANTI JOIN (SELECT * FROM lp WHERE region = 'nuc') n USING (image_id, label, x, y) WHERE c.region = 'cyto'),
cm AS (SELECT pr.image_id, pr.label, count(v) AS a, avg(v) AS m FROM pr LEFT JOIN ct USING (image_id, label) LEFT JOIN px ON px.image_id = pr.image_id AND px.x = ct.x AND px.y = ct.y GROUP BY ALL)
SELECT image_id, label, b AS "IDO_BackgroundMean", round(m, 6) AS "IDO_MeanIntensity", round(m - b, 6) AS "IDO_MeanIntensity_BgSub", round(m - b, 6) AS "IDO_IntDen",
  round(a * (m - b), 6) AS "IDO_IntDen_BgSub" FROM cm LEFT JOIN bg USING (image_id)"""))
@s.by_image
def _(spark, sf):
    return rounded(fluorescence.ido_measure(s.label_pixels(spark, sf), px(spark, sf, "ido"), IMG))


@query("brightest_channel", with_ctes(s.GEOMETRY_SQL, s.IMAGES_SQL, s.pixels_sql("phase"), s.pixels_sql("ido", "pi"), s.pixels_sql("ki67", "pk"), """
every AS (SELECT image_id, x, y, v, 'b' AS c FROM px UNION ALL SELECT image_id, x, y, v, 'g' FROM pi UNION ALL SELECT image_id, x, y, v, 'r' FROM pk),
top AS (SELECT image_id, arg_min(c, (-m, c)) AS c FROM (SELECT image_id, c, avg(v) AS m FROM every GROUP BY ALL) GROUP BY 1)""", body="""
SELECT image_id, x, y, v FROM every JOIN top USING (image_id, c)"""))
@s.by_image
def _(spark, sf):
    p = [px(spark, sf, c).withColumnRenamed("v", n) for c, n in (("phase", "b"), ("ido", "g"), ("ki67", "r"))]
    xy = ["image_id", "x", "y"]
    return fluorescence.brightest_channel(p[0].join(p[1], xy).join(p[2], xy), IMG)


@query("ki67_binarize")
def _(spark, sf):
    mask = fluorescence.ki67_binarize(px(spark, sf, "ki67"), IMG, s.WIDTH, s.HEIGHT, min_area=20)
    return mask.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("positive_pixels"), F.sum(F.expr("x * 40 + y")).alias("mark")
    )


@query("ki67_fixed_threshold", "WITH RECURSIVE " + ",".join((s.GEOMETRY_SQL, s.IMAGES_SQL, s.pixels_sql("ki67"), "mk AS (SELECT image_id, x, y FROM px WHERE v > 150)",
    component_sql("mk", ["image_id"], EIGHT, "c8"))) + """,
big AS (SELECT image_id, comp FROM c8_px GROUP BY ALL HAVING count(*) >= 50)
SELECT image_id, x, y FROM c8_px JOIN big USING (image_id, comp)""")
def _(spark, sf):
    return fluorescence.fixed_threshold_mask(px(spark, sf, "ki67"), IMG, 150.0, 50)


@query("ki67_positive", with_ctes(s.GEOMETRY_SQL, s.IMAGES_SQL, s.LABELS_SQL, s.pixels_sql("ki67"), body="""
SELECT lp.image_id, label, round(count(m.x) / count(*), 6) AS overlap, CAST(count(m.x) / count(*) >= 0.1 AS INT) AS ki67_positive
FROM lp LEFT JOIN (SELECT image_id, x, y FROM px WHERE v > 150) m USING (image_id, x, y) WHERE region = 'nuc' GROUP BY lp.image_id, label"""))
def _(spark, sf):
    mask = px(spark, sf, "ki67").filter("v > 150")
    return rounded(fluorescence.ki67_positive(s.label_pixels(spark, sf), mask, IMG))
