"""Queries over region measurements."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from petridish.functions import polygons as poly
from petridish.operators import pairing, roi
from registry import standins as s
from registry.rounding import nround, nudged_sql, rounded
from registry.standins import with_ctes

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = nudged_sql(sql)
        return fn

    return register


ROI = ["image_id", "region", "label"]
BASE = (s.GEOMETRY_SQL, s.IMAGES_SQL, s.LABELS_SQL, s.pixels_sql())
ROWS_SQL = "rp AS (SELECT lp.image_id, region, label, lp.x, lp.y, v FROM lp JOIN px USING (image_id, x, y))"


def rows(spark, sf):
    return roi.join_signal(s.label_pixels(spark, sf), s.pixels(spark, sf).drop("dataset"), ["image_id"])


INTENSITY_SQL = """
i0 AS (SELECT image_id, region, label, count(v) AS n, avg(v) AS m, stddev_pop(v) AS sd, min(v) AS lo, max(v) AS hi, sum(v) AS sm,
   quantile_cont(v, 0.10) AS p10, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.75) AS p75, quantile_cont(v, 0.90) AS p90
  FROM rp GROUP BY ALL),
i1 AS (SELECT rp.image_id, rp.region, rp.label, avg(pow(v - m, 3)) AS m3, avg(pow(v - m, 4)) AS m4 FROM rp JOIN i0 USING (image_id, region, label) GROUP BY ALL)"""


@query("roi_intensity", with_ctes(*BASE, ROWS_SQL, INTENSITY_SQL, body="""
SELECT image_id, region, label, round(m, 6) AS "Mean", round(sd, 6) AS "StdDev", lo AS "Min", hi AS "Max", round(n * m, 6) AS "IntDen",
  sm AS "RawIntDen", CASE WHEN abs(m) >= 1e-12 THEN round(sd / m, 6) END AS "CV", hi - lo AS "Range", round(p10, 6) AS "P10", round(p25, 6) AS "P25",
  round(p75, 6) AS "P75", round(p90, 6) AS "P90", round(p90 - p10, 6) AS "IQR80",
  CASE WHEN n >= 3 AND sd > 0 THEN round(m3 / pow(sd, 3), 6) END AS "Skewness",
  CASE WHEN n >= 3 AND sd > 0 THEN round(m4 / pow(sd, 4) - 3, 6) END AS "Kurtosis"
FROM i0 JOIN i1 USING (image_id, region, label)"""))
@s.by_image
def _(spark, sf):
    return rounded(roi.roi_intensity(rows(spark, sf), ROI))


@query("roi_entropy", with_ctes(*BASE, ROWS_SQL, """
e0 AS (SELECT image_id, region, label, min(v) AS lo, max(v) AS hi, count(*) AS n FROM rp GROUP BY ALL),
e1 AS (SELECT image_id, region, label, n, CASE WHEN hi > lo THEN least(floor((v - lo) * 256 / (hi - lo)), 255) ELSE 0 END AS b, count(*) AS c
  FROM rp JOIN e0 USING (image_id, region, label) GROUP BY ALL)""", body="""
SELECT image_id, region, label, round(abs(sum(c / n * log2(c / n))), 6) AS "Entropy" FROM e1 GROUP BY ALL"""))
def _(spark, sf):
    return rounded(roi.roi_entropy(rows(spark, sf), ROI))


@query("roi_centroid_area", with_ctes(s.GEOMETRY_SQL, s.LABELS_SQL, body="""
SELECT image_id, region, label, count(*) AS area, round(avg(x), 6) AS x_centroid, round(avg(y), 6) AS y_centroid FROM lp GROUP BY ALL"""))
def _(spark, sf):
    return rounded(roi.centroid_area(s.label_pixels(spark, sf), ROI))


MOMENTS_SQL = f"""
mo AS (SELECT image_id, region, label, CAST(count(*) AS DOUBLE) AS area, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy,
  (max(x) - min(x) + 1) * (max(y) - min(y) + 1) AS box FROM lp GROUP BY ALL),
mm AS (SELECT *, (xx + yy) / 2 + sqrt(pow((xx - yy) / 2, 2) + xy * xy) AS l1, greatest((xx + yy) / 2 - sqrt(pow((xx - yy) / 2, 2) + xy * xy), 0) AS l2 FROM mo),
moments AS (SELECT image_id, region, label, area, 4 * sqrt(l1) AS major_axis_length, 4 * sqrt(l2) AS minor_axis_length,
  CASE WHEN l1 > 0 THEN sqrt(greatest(1 - l2 / l1, 0)) END AS eccentricity, area / box AS extent, 2 * {math.pi} * (xx + yy) / area AS compactness FROM mm)"""


@query("roi_moments", with_ctes(s.GEOMETRY_SQL, s.LABELS_SQL, MOMENTS_SQL, body="""
SELECT image_id, region, label, area, round(major_axis_length, 5) AS major_axis_length, round(minor_axis_length, 5) AS minor_axis_length,
  round(eccentricity, 5) AS eccentricity, round(extent, 5) AS extent, round(compactness, 5) AS compactness FROM moments"""))
def _(spark, sf):
    return rounded(roi.roi_moments(s.label_pixels(spark, sf), ROI), 5)


RADII_SQL = """
ring AS (SELECT DISTINCT image_id, region, label, x + dx AS x, y + dy AS y FROM lp, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) d(dx, dy)),
outer_ring AS (SELECT ring.* FROM ring ANTI JOIN lp USING (image_id, region, label, x, y)),
dist AS (SELECT lp.image_id, lp.region, lp.label, lp.x, lp.y, sqrt(min(pow(lp.x - o.x, 2) + pow(lp.y - o.y, 2))) AS d
  FROM lp JOIN outer_ring o USING (image_id, region, label) GROUP BY ALL)"""


@query("roi_radii", with_ctes(s.GEOMETRY_SQL, s.LABELS_SQL, RADII_SQL, body="""
SELECT image_id, region, label, round(max(d), 6) AS maximum_radius, round(avg(d), 6) AS mean_radius, round(median(d), 6) AS median_radius
FROM dist GROUP BY ALL"""))
def _(spark, sf):
    return rounded(roi.roi_radii(s.label_pixels(spark, sf), ROI))


def polygons(spark, sf):
    o = s.outlines(spark, sf)
    sides = F.array(
        F.struct(F.lit("nuc").alias("region"), F.col("nuc").alias("points")),
        F.struct(F.lit("cyto").alias("region"), F.col("cyto").alias("points")),
    )
    return (
        o.select("image_id", "roi_id", F.explode(sides).alias("s"))
        .select("image_id", "roi_id", "s.region", "s.points")
        .filter("points is not null")
    )


EDGE2_SQL = """
eg AS (SELECT a.image_id, a.roi_id, a.region, a.pos, a.n, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM vert a JOIN vert b
  ON a.image_id = b.image_id AND a.roi_id = b.roi_id AND a.region = b.region AND b.pos = (a.pos + 1) % a.n)"""
HULL_SQL = EDGE2_SQL + """,
hp AS (SELECT a.image_id, a.roi_id, a.region, a.pos AS p, b.pos AS q, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2
  FROM vert a JOIN vert b USING (image_id, roi_id, region) WHERE a.pos <> b.pos),
hull AS (SELECT hp.image_id, hp.roi_id, hp.region, p, q, x1, y1, x2, y2 FROM hp JOIN vert k USING (image_id, roi_id, region)
  GROUP BY ALL HAVING min((x2 - x1) * (k.y - y1) - (y2 - y1) * (k.x - x1)) >= 0
    AND count(*) FILTER (k.pos NOT IN (p, q) AND (x2 - x1) * (k.y - y1) = (y2 - y1) * (k.x - x1)
      AND ((k.x - x1) * (k.x - x2) > 0 OR (k.y - y1) * (k.y - y2) > 0)) = 0),
hm AS (SELECT image_id, roi_id, region, sum(sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2))) AS hper, abs(sum(x1 * y2 - x2 * y1)) / 2 AS harea FROM hull GROUP BY ALL),
fer AS (SELECT image_id, roi_id, region, max(sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2))) AS feret FROM hp GROUP BY ALL),
per AS (SELECT image_id, roi_id, region, sum(sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2))) AS perimeter, abs(sum(x1 * y2 - x2 * y1)) / 2 AS parea FROM eg GROUP BY ALL)"""


@query("roi_perimeter", with_ctes(s.GEOMETRY_SQL, s.VERTEX_SQL, EDGE2_SQL, body="""
SELECT image_id, roi_id, region, round(sum(sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2))), 6) AS perimeter FROM eg GROUP BY ALL"""))
def _(spark, sf):
    p = polygons(spark, sf)
    return p.select(
        "image_id", "roi_id", "region", nround(poly.perimeter(poly.closed_edges("points")), 6).alias("perimeter")
    )


@query("roi_hull", with_ctes(s.GEOMETRY_SQL, s.VERTEX_SQL, HULL_SQL, body="""
SELECT image_id, roi_id, region, round(perimeter, 6) AS perimeter, round(parea, 6) AS polygon_area, round(hper, 6) AS convex_perimeter,
  round(feret, 6) AS feret_length, round(parea / harea, 6) AS solidity FROM per JOIN hm USING (image_id, roi_id, region) JOIN fer USING (image_id, roi_id, region)"""))
def _(spark, sf):
    return rounded(roi.outline_geometry(polygons(spark, sf), "points").drop("points"))


@query("roi_geometry_derived", with_ctes(s.GEOMETRY_SQL, s.LABELS_SQL, s.VERTEX_SQL, MOMENTS_SQL, HULL_SQL, body=f"""
SELECT image_id, region, label, round(2 * sqrt(area / {math.pi}), 6) AS circular_diameter,
  CASE WHEN minor_axis_length >= 1e-12 THEN round(major_axis_length / minor_axis_length, 6) END AS aspect_ratio,
  CASE WHEN major_axis_length > 0 THEN round(4 * area / ({math.pi} * major_axis_length * major_axis_length), 6) END AS roundness,
  round(2 * sqrt({math.pi} * area) / (perimeter * perimeter), 6) AS circularity, round(4 * {math.pi} * area / (perimeter * perimeter), 6) AS sphericity,
  round(1 - hper / perimeter, 6) AS roughness, round(perimeter / area, 6) AS perimeter_area_ratio
FROM moments m JOIN per p ON p.image_id = m.image_id AND p.roi_id = m.label AND p.region = m.region
  JOIN hm h ON h.image_id = m.image_id AND h.roi_id = m.label AND h.region = m.region""".replace("SELECT image_id, region, label,", "SELECT m.image_id, m.region, m.label,")))
def _(spark, sf):
    m = roi.roi_moments(s.label_pixels(spark, sf), ROI)
    g = roi.outline_geometry(polygons(spark, sf), "points").drop("points").withColumnRenamed("roi_id", "label")
    out = roi.geometry_derived(m.join(g, ROI))
    return rounded(
        out.select(
            *ROI, "circular_diameter", "aspect_ratio", "roundness", "circularity", "sphericity", "roughness", "perimeter_area_ratio"
        )
    )


CROSS_SQL = """
en AS (SELECT image_id, region, label, abs(sum(c / n * log2(c / n))) AS ent FROM e1 GROUP BY ALL),
xy AS (SELECT image_id, region, label, count(*) AS area, avg(x) AS cx, avg(y) AS cy FROM rp GROUP BY ALL),
al AS (SELECT image_id, region, label, m, n * m AS intden, sm, sd / m AS cv, ent, area, cx, cy FROM i0 JOIN en USING (image_id, region, label) JOIN xy USING (image_id, region, label))"""
ENT_SQL = """
e0 AS (SELECT image_id, region, label, min(v) AS lo, max(v) AS hi, count(*) AS n FROM rp GROUP BY ALL),
e1 AS (SELECT image_id, region, label, n, CASE WHEN hi > lo THEN least(floor((v - lo) * 256 / (hi - lo)), 255) ELSE 0 END AS b, count(*) AS c
  FROM rp JOIN e0 USING (image_id, region, label) GROUP BY ALL)"""


@query("roi_cross_region", with_ctes(*BASE, ROWS_SQL, INTENSITY_SQL, ENT_SQL, CROSS_SQL, body=f"""
SELECT a.image_id, a.label, round(a.m / b.m, 6) AS "Nuc Cyto Mean Ratio", round(a.intden / b.intden, 6) AS "Nuc Cyto IntDen Ratio",
  round(a.sm / b.sm, 6) AS "Nuc Cyto RawIntDen Ratio", round(a.intden / b.intden, 6) AS "Nuc Cell IntDen Ratio",
  round(a.ent - b.ent, 6) AS "Nuc Cyto Entropy Difference", round(a.cv - b.cv, 6) AS "Nuc Cyto CV Difference",
  round(sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2)) / sqrt(b.area / {math.pi}), 6) AS "Nucleus Centroid Offset"
FROM (FROM al WHERE region = 'nuc') a JOIN (FROM al WHERE region = 'cyto') b ON a.image_id = b.image_id AND a.label = b.label"""))
@s.by_image
def _(spark, sf):
    r = rows(spark, sf)
    long = (
        roi.roi_intensity(r, ROI)
        .join(roi.roi_entropy(r, ROI), ROI)
        .join(roi.centroid_area(r, ROI), ROI)
    )
    wide = pairing.merge_roi_wide(
        long, ["image_id", "label"], ["Mean", "IntDen", "RawIntDen", "CV", "Entropy", "area", "x_centroid", "y_centroid"]
    ).filter("area_nuc is not null and area_cyto is not null")
    out = roi.cross_region(wide)
    names = [c for c in out.columns if c.startswith("Nuc")]
    return rounded(out.select("image_id", "label", *names))


@query("karyoplasmic_ratio", with_ctes(s.GEOMETRY_SQL, s.LABELS_SQL, body="""
, a AS (SELECT image_id, label, count(*) FILTER (region = 'nuc') AS n, count(*) FILTER (region = 'cyto') AS c FROM lp GROUP BY ALL)
SELECT image_id, label, CASE WHEN c - n > 0 THEN round(n / (c - n), 6) END AS ratio FROM a"""))
def _(spark, sf):
    a = s.label_pixels(spark, sf).groupBy("image_id", "label").agg(
        F.count_if(F.col("region") == "nuc").alias("n"), F.count_if(F.col("region") == "cyto").alias("c")
    )
    return a.select("image_id", "label", nround(roi.karyoplasmic_ratio("n", "c"), 6).alias("ratio"))


@query("label_stats", with_ctes(s.GEOMETRY_SQL, s.LABELS_SQL, body="""
, a AS (SELECT image_id, region, label, count(*) AS area FROM lp GROUP BY ALL), m AS (SELECT image_id, region, count(*) AS n, median(area) AS median FROM a GROUP BY ALL)
SELECT image_id, region, n, median, count(*) FILTER (area < 30) AS lt30, count(*) FILTER (area < 0.15 * median) AS lt15pct
FROM a JOIN m USING (image_id, region) GROUP BY ALL"""))
def _(spark, sf):
    return roi.label_stats(s.label_pixels(spark, sf), ["image_id", "region"])


RASTER_SQL = EDGE2_SQL + """,
bb AS (SELECT image_id, roi_id, region, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM vert GROUP BY ALL),
ras AS (SELECT bb.image_id, bb.roi_id, bb.region, CAST(gx.range AS INT) AS x, CAST(gy.range AS INT) AS y
  FROM bb JOIN range(32) gx ON gx.range BETWEEN x0 AND x1 JOIN range(32) gy ON gy.range BETWEEN y0 AND y1
  JOIN eg ON eg.image_id = bb.image_id AND eg.roi_id = bb.roi_id AND eg.region = bb.region GROUP BY ALL
  HAVING count(*) FILTER ((eg.y1 > gy.range) <> (eg.y2 > gy.range) AND gx.range < (eg.x2 - eg.x1) * (gy.range - eg.y1) / (eg.y2 - eg.y1) + eg.x1) % 2 = 1
    OR count(*) FILTER ((eg.x2 - eg.x1) * (gy.range - eg.y1) = (eg.y2 - eg.y1) * (gx.range - eg.x1) AND gx.range BETWEEN least(eg.x1, eg.x2) AND greatest(eg.x1, eg.x2)
      AND gy.range BETWEEN least(eg.y1, eg.y2) AND greatest(eg.y1, eg.y2)) > 0)"""


@query("rasterize", with_ctes(s.GEOMETRY_SQL, s.VERTEX_SQL, RASTER_SQL, body="SELECT * FROM ras"))
def _(spark, sf):
    return poly.rasterize(polygons(spark, sf), "points", s.WIDTH, s.HEIGHT)


@query("mask_to_outline", with_ctes(s.GEOMETRY_SQL, s.LABELS_SQL, body="""
, nb AS (SELECT image_id, region, label, lp.x, lp.y, (SELECT count(*) FROM lp q WHERE q.image_id = lp.image_id AND q.region = lp.region
   AND q.label = lp.label AND abs(q.x - lp.x) + abs(q.y - lp.y) = 1) AS n FROM lp),
b AS (SELECT * FROM nb WHERE n < 4), c AS (SELECT image_id, region, label, avg(x) AS cx, avg(y) AS cy FROM b GROUP BY ALL),
o AS (SELECT b.*, row_number() OVER (PARTITION BY image_id, region, label ORDER BY round(atan2(y - cy, x - cx), 9), round(pow(x - cx, 2) + pow(y - cy, 2), 9), x, y) AS pos
  FROM b JOIN c USING (image_id, region, label))
SELECT image_id, region, label, count(*) AS n, CAST(sum(x) AS BIGINT) AS sx, CAST(sum(y) AS BIGINT) AS sy FROM o GROUP BY ALL"""))
def _(spark, sf):
    loops = roi.mask_to_loops(s.label_pixels(spark, sf), ROI)
    points = loops.select(*ROI, F.explode("points").alias("p")).distinct()
    return points.groupBy(*ROI).agg(
        F.count(F.lit(1)).alias("n"), F.sum("p.x").cast("bigint").alias("sx"), F.sum("p.y").cast("bigint").alias("sy")
    )


@query("outline_of_mask", with_ctes(s.GEOMETRY_SQL, s.LABELS_SQL, body="""
SELECT image_id, region, label, count(*) AS area FROM lp GROUP BY ALL"""))
def _(spark, sf):
    """Area of every object from its traced outline: corner formula and border points (Pick's theorem)."""
    out = roi.mask_to_outline(s.label_pixels(spark, sf), ROI)
    nexts = F.concat(F.slice("points", 2, F.size("points") - 1), F.slice("points", 1, 1))
    terms = F.zip_with("points", nexts, lambda a, b: a.x * b.y - b.x * a.y)
    double = F.abs(F.aggregate(terms, F.lit(0), lambda a, t: a + t))
    steps = F.zip_with("points", nexts, lambda a, b: F.greatest(F.abs(a.x - b.x), F.abs(a.y - b.y)))
    border = F.aggregate(steps, F.lit(0), lambda a, t: a + t)
    return out.select(*ROI, ((double + border) / 2 + 1).cast("bigint").alias("area"))


@query("region_algebra", with_ctes(*BASE, body="""
, f AS (SELECT px.image_id, px.x, px.y, v, coalesce(bool_or(region = 'cyto'), false) AS c, coalesce(bool_or(region = 'nuc'), false) AS n
  FROM px LEFT JOIN lp USING (image_id, x, y) GROUP BY ALL)
SELECT image_id, count(*) FILTER (c) AS cell, count(*) FILTER (n) AS nucleus, count(*) FILTER (c AND NOT n) AS cytoplasm,
  count(*) FILTER (NOT c) AS background, round(avg(v) FILTER (NOT c), 6) AS background_mean FROM f GROUP BY 1"""))
def _(spark, sf):
    flags = roi.region_algebra(s.pixels(spark, sf), s.label_pixels(spark, sf), ["image_id"])
    return flags.groupBy("image_id").agg(
        F.count_if("in_cell").alias("cell"),
        F.count_if("in_nucleus").alias("nucleus"),
        F.count_if("in_cytoplasm").alias("cytoplasm"),
        F.count_if("background").alias("background"),
        nround(F.avg(F.when(F.col("background"), F.col("v"))), 6).alias("background_mean"),
    )
