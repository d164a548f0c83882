"""Queries over joins and pairing."""

from __future__ import annotations

from pyspark.sql import functions as F

from petridish.operators import pairing
from petridish.operators.assignment import best_assignment
from petridish.operators.scale import with_group_stats
from petridish.session import materialize
from petridish.sources import tables
from registry import standins as s
from registry.rounding import nround, nudged_sql, rounded
from registry.q_quality import EDGE_SQL, statuses
from registry.q_sources import NATURAL
from registry.standins import table, with_ctes

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = nudged_sql(sql)
        return fn

    return register


KEY = ["dataset", "image_id"]
MASKS = (s.GEOMETRY_SQL, s.LABELS_SQL)


@query("image_mapping", f"""
WITH f AS (SELECT source AS dataset, lang AS channel, 'img' || (doc_id * 7 % 1000) || '_' || doc_id || '.png' AS name FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY dataset, channel ORDER BY {NATURAL.format('name')}, name) AS position FROM f)
SELECT dataset, position, coalesce(max(name) FILTER (channel = 'en'), '') AS "en_Name",
  coalesce(max(name) FILTER (channel = 'fr'), '') AS "fr_Name", coalesce(max(name) FILTER (channel = 'de'), '') AS "de_Name"
FROM r WHERE channel IN ('en', 'fr', 'de') GROUP BY ALL""")
def _(spark, sf):
    files = table(spark, sf, "documents").select(
        F.col("source").alias("dataset"),
        F.col("lang").alias("channel"),
        F.expr("'img' || (doc_id * 7 % 1000) || '_' || doc_id || '.png'").alias("name"),
    )
    return pairing.image_mapping(files, ["en", "fr", "de"])


MAIN_NAME = "case j % 3 when 0 then 'Scan_' || j || '.png' when 1 then 'pc ' || j || '.png' else 'frame_' || j || '_' || j DIV 10 || '.png' end"
OTHER_NAME = "case j % 4 when 0 then 'scan_' || j || '.tif' when 1 then 'dapi_' || j || '_' || j DIV 10 || '.tif' else 'd' || j || '.tif' end"
STEM = "lower(regexp_replace(name, '\\.[a-z]+$', ''))"


@query("match_by_stem_or_index", f"""
WITH RECURSIVE d AS (SELECT 'd' || (doc_id // 100) AS dataset, doc_id % 100 AS j, lang FROM documents),
m0 AS (SELECT dataset, {MAIN_NAME.replace('DIV', '//')} AS name FROM d),
o0 AS (SELECT dataset, {OTHER_NAME.replace('DIV', '//')} AS name FROM d WHERE lang <> 'de'),
m AS (SELECT *, {STEM} AS stem, CAST(regexp_extract_all({STEM}, '\\d+')[-1] AS BIGINT) AS num,
  row_number() OVER (PARTITION BY dataset ORDER BY {NATURAL.format('name')}, name) AS l FROM m0),
o AS (SELECT *, {STEM} AS stem, CAST(regexp_extract_all({STEM}, '\\d+')[-1] AS BIGINT) AS num,
  row_number() OVER (PARTITION BY dataset ORDER BY {NATURAL.format('name')}, name) AS r FROM o0),
c AS (SELECT m.dataset, l, r, min(CASE WHEN m.stem = o.stem THEN 0 ELSE 1 END) AS kind
  FROM m JOIN o ON m.dataset = o.dataset AND (m.stem = o.stem OR m.num = o.num) GROUP BY ALL),
cl AS (SELECT m.dataset, m.l, list(r ORDER BY kind, r) FILTER (r IS NOT NULL) AS cands
  FROM m LEFT JOIN c USING (dataset, l) GROUP BY ALL),
walk AS (SELECT dataset, CAST(0 AS BIGINT) AS l, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS r FROM m GROUP BY dataset
  UNION ALL SELECT w.dataset, cl.l, CASE WHEN list_filter(coalesce(cands, []), lambda x: NOT list_contains(used, x))[1] IS NULL THEN used
     ELSE list_append(used, list_filter(cands, lambda x: NOT list_contains(used, x))[1]) END,
     list_filter(coalesce(cands, []), lambda x: NOT list_contains(used, x))[1]
  FROM walk w JOIN cl ON cl.dataset = w.dataset AND cl.l = w.l + 1)
SELECT m.dataset, m.name, o.name AS partner FROM m JOIN walk w USING (dataset, l)
LEFT JOIN o ON o.dataset = m.dataset AND o.r = w.r""")
def _(spark, sf):
    d = table(spark, sf, "documents").select(
        F.expr("'d' || (doc_id div 100)").alias("dataset"), F.expr("cast(doc_id % 100 as int)").alias("j"), "lang"
    )
    main = d.select("dataset", F.expr(MAIN_NAME.replace("j DIV 10", "(j div 10)")).alias("name"))
    other = d.filter("lang <> 'de'").select(
        "dataset", F.expr(OTHER_NAME.replace("j DIV 10", "(j div 10)")).alias("name")
    )
    return pairing.match_by_stem_or_index(main, other, ["dataset"])


# every nucleus polygon once more, one pixel to the right, so that nuclei compete for cells
NUCLEI_SQL = """
nv AS (SELECT image_id, roi_id AS nuc_no, x, y FROM vert WHERE region = 'nuc'
  UNION ALL SELECT image_id, roi_id + 4, x + 1, y FROM vert WHERE region = 'nuc'),
nc AS (SELECT image_id, nuc_no, avg(x) AS mx, avg(y) AS my FROM nv GROUP BY ALL),
ce AS (SELECT a.image_id, a.roi_id AS cell_no, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM vert a JOIN vert b
  ON a.image_id = b.image_id AND a.roi_id = b.roi_id AND b.region = 'cyto' AND b.pos = (a.pos + 1) % a.n WHERE a.region = 'cyto'),
cand AS (SELECT nc.image_id, nuc_no, cell_no FROM nc JOIN ce USING (image_id) GROUP BY ALL
  HAVING count(*) FILTER ((y1 > my) <> (y2 > my) AND mx < (x2 - x1) * (my - y1) / (y2 - y1) + x1) % 2 = 1
   AND count(*) FILTER ((x2 - x1) * (my - y1) = (y2 - y1) * (mx - x1) AND mx BETWEEN least(x1, x2) AND greatest(x1, x2)
     AND my BETWEEN least(y1, y2) AND greatest(y1, y2)) = 0)"""


def nuclei_and_cells(spark, sf):
    o = s.outlines(spark, sf)
    nuc = o.filter("nuc is not null")
    shifted = nuc.select(
        "image_id",
        (F.col("roi_id") + 4).alias("nuc_no"),
        F.expr("transform(nuc, p -> named_struct('x', p.x + 1, 'y', p.y))").alias("points"),
    )
    nuclei = nuc.select("image_id", F.col("roi_id").alias("nuc_no"), F.col("nuc").alias("points"))
    cells = o.filter("cyto is not null").select(
        "image_id", F.col("roi_id").alias("cell_no"), F.col("cyto").alias("points")
    )
    return nuclei.unionByName(shifted), cells


@query("pair_by_polygon_candidates", with_ctes(s.GEOMETRY_SQL, s.VERTEX_SQL, NUCLEI_SQL, body="SELECT * FROM cand"))
def _(spark, sf):
    nuclei, cells = nuclei_and_cells(spark, sf)
    return pairing.polygon_candidates(nuclei, cells, ["image_id"])


@query("pair_by_polygon", "WITH RECURSIVE " + ",".join((s.GEOMETRY_SQL, s.VERTEX_SQL, NUCLEI_SQL, """
cl AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY nuc_no) AS step FROM (
  SELECT image_id, nuc_no, list(cell_no ORDER BY cell_no) FILTER (cell_no IS NOT NULL) AS cands
  FROM (SELECT DISTINCT image_id, nuc_no FROM nv) LEFT JOIN cand USING (image_id, nuc_no) GROUP BY ALL)),
walk AS (SELECT image_id, CAST(0 AS BIGINT) AS step, CAST([] AS INT[]) AS used, CAST(NULL AS INT) AS nuc_no, CAST(NULL AS INT) AS cell_no
   FROM cl GROUP BY image_id
  UNION ALL SELECT w.image_id, cl.step, CASE WHEN list_filter(coalesce(cands, []), lambda x: NOT list_contains(used, x))[1] IS NULL THEN used
     ELSE list_append(used, list_filter(cands, lambda x: NOT list_contains(used, x))[1]) END, cl.nuc_no,
     list_filter(coalesce(cands, []), lambda x: NOT list_contains(used, x))[1]
  FROM walk w JOIN cl ON cl.image_id = w.image_id AND cl.step = w.step + 1),
allr AS (SELECT image_id, nuc_no, cell_no FROM walk WHERE step > 0
  UNION ALL SELECT image_id, NULL, cell_no FROM (SELECT DISTINCT image_id, cell_no FROM ce) c
    ANTI JOIN (SELECT image_id, cell_no FROM walk WHERE cell_no IS NOT NULL) u USING (image_id, cell_no))
SELECT image_id, nuc_no, cell_no, row_number() OVER (PARTITION BY image_id ORDER BY
  CASE WHEN cell_no IS NULL THEN 1 WHEN nuc_no IS NULL THEN 2 ELSE 0 END, coalesce(nuc_no, cell_no)) AS record FROM allr""")))
def _(spark, sf):
    nuclei, cells = nuclei_and_cells(spark, sf)
    return pairing.pair_by_polygon(nuclei, cells, ["image_id"])


CENTROID_SQL = """
cen AS (SELECT dataset, image_id, label, count(*) AS area, avg(x) AS cx, avg(y) AS cy FROM lp WHERE region = 'nuc' GROUP BY ALL),
pair AS (SELECT image_id, c.label AS cyto_label, cen.label AS nuc_label FROM cen JOIN lp c USING (image_id)
  WHERE c.region = 'cyto' AND c.x = floor(cx) AND c.y = floor(cy))"""


@query("pair_by_centroid", with_ctes(*MASKS, CENTROID_SQL, body="SELECT * FROM pair"))
def _(spark, sf):
    return pairing.pair_by_centroid(s.label_pixels(spark, sf), ["image_id"])


@query("paired_region_counts", with_ctes(*MASKS, CENTROID_SQL, body="""
, raw AS (SELECT image_id, count(DISTINCT label) FILTER (region = 'nuc') AS raw_nucleus_count,
   count(DISTINCT label) FILTER (region = 'cyto') AS raw_cytoplasm_count FROM lp GROUP BY 1),
pc AS (SELECT image_id, count(DISTINCT nuc_label) AS a, count(DISTINCT cyto_label) AS b FROM pair GROUP BY 1)
SELECT raw.*, coalesce(a, 0) AS paired_nucleus_count, coalesce(b, 0) AS paired_cytoplasm_count FROM raw LEFT JOIN pc USING (image_id)"""))
def _(spark, sf):
    return pairing.paired_region_counts(s.label_pixels(spark, sf), ["image_id"])


@query("label_boxes", with_ctes(*MASKS, body="""
SELECT image_id, region, label, count(*) AS area, min(x) AS "left", min(y) AS top, max(x) + 1 AS "right", max(y) + 1 AS bottom
FROM lp GROUP BY image_id, region, label"""))
def _(spark, sf):
    return pairing.label_boxes(s.label_pixels(spark, sf), ["image_id"])


@query("border_labels", with_ctes(*MASKS, body="""
SELECT DISTINCT image_id, region, label FROM lp WHERE x IN (0, 31) OR y IN (0, 31)"""))
def _(spark, sf):
    return pairing.border_labels(
        s.label_pixels(spark, sf), ["image_id"], F.lit(s.WIDTH), F.lit(s.HEIGHT)
    )


@query("relabel_kept", with_ctes(*MASKS, body="""
, kept AS (SELECT DISTINCT image_id, region, label FROM lp WHERE dataset NOT IN ('set_3', 'set_4') AND label <> 2),
new AS (SELECT *, row_number() OVER (PARTITION BY image_id, region ORDER BY label) AS n FROM kept)
SELECT image_id, region, n AS label, count(*) AS area, CAST(sum(x * 100 + y) AS BIGINT) AS mark
FROM lp JOIN new USING (image_id, region, label) GROUP BY ALL"""))
def _(spark, sf):
    lp = s.label_pixels(spark, sf)
    kept = lp.filter("dataset not in ('set_3', 'set_4') and label <> 2")
    out = pairing.relabel_kept(lp, kept, ["image_id"])
    return out.groupBy("image_id", "region", "label").agg(
        F.count(F.lit(1)).alias("area"), F.sum(F.expr("x * 100 + y")).alias("mark")
    )


@query("filter_small_labels", with_ctes(*MASKS, body="""
, a AS (SELECT image_id, region, label, count(*) AS area FROM lp GROUP BY ALL),
md AS (SELECT image_id, region, median(area) AS m FROM a GROUP BY ALL),
kept AS (SELECT a.*, row_number() OVER (PARTITION BY image_id, region ORDER BY label) AS n FROM a JOIN md USING (image_id, region)
  WHERE area >= greatest(20.0, 0.9 * m))
SELECT image_id, region, n AS label, area FROM kept"""))
def _(spark, sf):
    out = pairing.filter_small_labels(s.label_pixels(spark, sf), ["image_id"], 0.9, 20)
    return out.groupBy("image_id", "region", "label").agg(F.count(F.lit(1)).alias("area"))


@query("filter_small_unpaired", with_ctes(*MASKS, CENTROID_SQL, body="""
, a AS (SELECT image_id, region, label, count(*) AS area FROM lp GROUP BY ALL),
bl AS (SELECT DISTINCT image_id, region, label FROM lp WHERE x IN (0, 31) OR y IN (0, 31)),
ins AS (SELECT p.image_id, p.nuc_label, p.cyto_label, count(*) AS n FROM pair p
  JOIN lp a ON a.image_id = p.image_id AND a.region = 'nuc' AND a.label = p.nuc_label
  JOIN lp b ON b.image_id = p.image_id AND b.region = 'cyto' AND b.label = p.cyto_label AND a.x = b.x AND a.y = b.y GROUP BY ALL),
jd AS (SELECT p.*, coalesce(n, 0) / na.area >= 0.8 AND b1.label IS NULL AND b2.label IS NULL AS trusted FROM pair p
  LEFT JOIN ins USING (image_id, nuc_label, cyto_label)
  JOIN a na ON na.image_id = p.image_id AND na.region = 'nuc' AND na.label = p.nuc_label
  LEFT JOIN bl b1 ON b1.image_id = p.image_id AND b1.region = 'nuc' AND b1.label = p.nuc_label
  LEFT JOIN bl b2 ON b2.image_id = p.image_id AND b2.region = 'cyto' AND b2.label = p.cyto_label),
roles AS (SELECT image_id, region, label, bool_or(trusted) AS trusted FROM (
   SELECT image_id, 'nuc' AS region, nuc_label AS label, trusted FROM jd UNION ALL SELECT image_id, 'cyto', cyto_label, trusted FROM jd) GROUP BY ALL),
ob AS (SELECT a.*, r.label IS NOT NULL AS paired, coalesce(trusted, false) AS trusted FROM a LEFT JOIN roles r USING (image_id, region, label)),
st AS (SELECT image_id, region, count(*) FILTER (trusted) AS nt, count(*) FILTER (paired) AS np, count(*) AS n,
   median(area) FILTER (trusted) AS mt, median(area) FILTER (paired) AS mp, median(area) AS m FROM ob GROUP BY ALL),
bo AS (SELECT image_id, min(nt) AS lt, min(np) AS l2, count(*) AS regions FROM st GROUP BY 1),
th AS (SELECT image_id, region, greatest(4.0, 0.95 * CASE WHEN lt >= 2 AND regions = 2 THEN mt WHEN l2 >= 1 AND regions = 2 THEN mp ELSE m END) AS threshold,
   CASE WHEN lt >= 2 AND regions = 2 THEN nt WHEN l2 >= 1 AND regions = 2 THEN np ELSE n END AS reference_count FROM st JOIN bo USING (image_id))
SELECT image_id, region, round(threshold, 6) AS threshold, reference_count, count(*) FILTER (paired) AS paired_count,
  count(*) FILTER (NOT (paired OR area >= threshold)) AS removed_count
FROM ob JOIN th USING (image_id, region) GROUP BY ALL"""))
def _(spark, sf):
    _, diagnostics = pairing.filter_small_unpaired(
        s.label_pixels(spark, sf), ["image_id"], F.lit(s.WIDTH), F.lit(s.HEIGHT), 0.95, 4, min_reference=2
    )
    return diagnostics.withColumn("threshold", nround("threshold", 6))


# frame shifts: each image against the previous, same and next image of its dataset
def shift_candidates(spark, sf):
    images = s.geometry(spark, sf).select("dataset", "image_id").distinct()
    shifted = images.select(
        "dataset",
        F.col("image_id").alias("row_image"),
        F.explode(F.array(F.lit(-10), F.lit(0), F.lit(10))).alias("d"),
    ).withColumn("image_id", F.col("row_image") + F.col("d"))
    return shifted.join(images, ["dataset", "image_id"], "left_semi").select(
        "dataset", "row_image", F.col("image_id").alias("col_image")
    )


def all_candidates(spark, sf, slots=32):
    """Every pair of images of a dataset; a dataset's rows are dealt to slots that all see its columns."""
    images = s.geometry(spark, sf).select("dataset", "image_id").distinct()
    rows = images.select("dataset", F.col("image_id").alias("row_image"), F.expr(f"pmod(xxhash64(image_id), {slots})").alias("slot"))
    cols = images.select(
        "dataset", F.col("image_id").alias("col_image"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1))).alias("slot")
    )
    return rows.hint("merge").join(cols, ["dataset", "slot"]).drop("slot")


CANDIDATE_SQL = """
cnd AS (SELECT a.dataset, a.image_id AS row_image, b.image_id AS col_image FROM imgs a JOIN imgs b
  ON b.dataset = a.dataset AND b.image_id IN (a.image_id - 10, a.image_id, a.image_id + 10))"""
ALL_SQL = """
cnd AS (SELECT dataset, a.image_id AS row_image, b.image_id AS col_image FROM imgs a JOIN imgs b USING (dataset))"""
CENTRE_SCORE_SQL = """,
cc AS (SELECT image_id AS col_image, CAST(round_even(avg(x), 0) AS INT) AS x, CAST(round_even(avg(y), 0) AS INT) AS y
  FROM lp WHERE region = 'nuc' GROUP BY image_id, label),
cov AS (SELECT DISTINCT image_id AS row_image, x, y FROM lp WHERE region = 'cyto'),
sc0 AS (SELECT dataset, row_image, col_image, count(cov.x) AS inside, count(cc.x) AS total FROM cnd
  LEFT JOIN cc USING (col_image) LEFT JOIN cov USING (row_image, x, y) GROUP BY ALL),
scores AS (SELECT *, CAST(CAST(coalesce(inside / nullif(total, 0) * 1000.0, 0) + inside * 0.001 AS FLOAT) AS DOUBLE) AS score FROM sc0)"""
NUC_SCORE_SQL = CANDIDATE_SQL + CENTRE_SCORE_SQL
MASK_SQL = """
msk AS (SELECT image_id AS col_image, x, y FROM px WHERE v > 150)"""
KI_SCORE_SQL = CANDIDATE_SQL + """,
nsh AS (SELECT dataset, row_image, col_image, label, count(m.x) / count(*) AS share FROM cnd
  JOIN (SELECT image_id AS row_image, label, x, y FROM lp WHERE region = 'nuc') n USING (row_image)
  LEFT JOIN msk m USING (col_image, x, y) GROUP BY ALL),
sc0 AS (SELECT dataset, row_image, col_image, count(*) FILTER (share >= 0.1) AS positive, count(share) AS total,
   coalesce(avg(share), 0) AS mean_overlap FROM cnd LEFT JOIN nsh USING (dataset, row_image, col_image) GROUP BY ALL),
scores AS (SELECT *, CAST(CAST(positive * 1000.0 + mean_overlap * 100.0 AS FLOAT) AS DOUBLE) AS score FROM sc0)"""


@query("pair_scores", with_ctes(*MASKS, s.IMAGES_SQL, NUC_SCORE_SQL, body="""
SELECT dataset, row_image, col_image, inside, total, round(score, 2) AS score FROM scores"""))
def _(spark, sf):
    out = pairing.score_nucleus_pairs(shift_candidates(spark, sf), s.label_pixels(spark, sf))
    return out.withColumn("score", nround("score", 2))


def ki67_mask(spark, sf):
    return s.pixels(spark, sf, "ki67").filter("v > 150")


@query("ki67_scores", with_ctes(*MASKS, s.IMAGES_SQL, s.pixels_sql("ki67"), MASK_SQL, KI_SCORE_SQL, body="""
SELECT dataset, row_image, col_image, positive, total, round(mean_overlap, 6) AS mean_overlap, round(score, 1) AS score FROM scores"""))
def _(spark, sf):
    out = pairing.score_mask_pairs(
        shift_candidates(spark, sf), s.label_pixels(spark, sf), ki67_mask(spark, sf)
    )
    return out.withColumn("mean_overlap", nround("mean_overlap", 6)).withColumn("score", nround("score", 1))


REMAP_SQL = """
eo AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY -score, row_image, col_image) AS step FROM scores),
walk AS (SELECT dataset, CAST(0 AS BIGINT) AS step, CAST([] AS BIGINT[]) AS ur, CAST([] AS BIGINT[]) AS uc, false AS hit FROM eo GROUP BY dataset
  UNION ALL SELECT w.dataset, e.step,
    CASE WHEN list_contains(ur, row_image) OR list_contains(uc, col_image) THEN ur ELSE list_append(ur, row_image) END,
    CASE WHEN list_contains(ur, row_image) OR list_contains(uc, col_image) THEN uc ELSE list_append(uc, col_image) END,
    NOT (list_contains(ur, row_image) OR list_contains(uc, col_image))
  FROM walk w JOIN eo e ON e.dataset = w.dataset AND e.step = w.step + 1),
chosen AS (SELECT e.* FROM eo e JOIN walk w USING (dataset, step) WHERE hit)"""


@query("remap_batch", "WITH RECURSIVE " + ",".join((*MASKS, s.IMAGES_SQL, ALL_SQL + CENTRE_SCORE_SQL, REMAP_SQL)) + """,
tot AS (SELECT dataset, sum(score) AS assigned, bool_or(row_image <> col_image) AS changed FROM chosen GROUP BY 1),
idn AS (SELECT dataset, sum(score) AS identity, count(DISTINCT row_image) AS n FROM scores WHERE row_image = col_image GROUP BY 1),
dec AS (SELECT dataset, assigned, identity, changed AND n >= 2 AND assigned > identity + greatest(1.0, abs(identity) * 0.02) AS accepted FROM tot JOIN idn USING (dataset))
SELECT r.dataset, r.row_image, accepted, round(assigned, 1) AS assigned, round(identity, 1) AS identity,
  CASE WHEN accepted AND c.col_image IS NOT NULL THEN c.col_image ELSE r.row_image END AS source
FROM (SELECT DISTINCT dataset, row_image FROM scores) r JOIN dec USING (dataset) LEFT JOIN chosen c USING (dataset, row_image)""")
def _(spark, sf):
    # read several times by the matching and the totals
    scores = materialize(pairing.score_nucleus_pairs(all_candidates(spark, sf), s.label_pixels(spark, sf)))
    out = pairing.remap_batch(scores, min_gain=0.02, method="greedy")
    return out.withColumn("assigned", nround("assigned", 1)).withColumn("identity", nround("identity", 1))


# the largest total along a chain of images: which of this and the next column are in use
BEST_SQL = """
idx AS (SELECT dataset, image_id, row_number() OVER (PARTITION BY dataset ORDER BY image_id) AS i FROM imgs),
wt AS (SELECT dataset, i, max(score) FILTER (col_image < row_image) AS w0, max(score) FILTER (col_image = row_image) AS w1, max(score) FILTER (col_image > row_image) AS w2
  FROM scores JOIN idx USING (dataset) WHERE row_image = image_id GROUP BY ALL),
dp AS (SELECT DISTINCT dataset, CAST(0 AS BIGINT) AS i, false AS a, false AS b, CAST(0 AS DOUBLE) AS v FROM idx
  UNION ALL SELECT dataset, i, a, b, max(v) FROM (
    SELECT d.dataset, t.i, CASE k WHEN 1 THEN true ELSE d.b END AS a, k = 2 AS b,
      d.v + CASE k WHEN 0 THEN coalesce(w0, 0) WHEN 1 THEN coalesce(w1, 0) WHEN 2 THEN coalesce(w2, 0) ELSE 0 END AS v
    FROM dp d JOIN wt t ON t.dataset = d.dataset AND t.i = d.i + 1 CROSS JOIN (VALUES (0), (1), (2), (3)) m(k)
    WHERE NOT (k = 0 AND d.a) AND NOT (k = 1 AND d.b)) GROUP BY ALL)"""


@query("assignment_total", "WITH RECURSIVE " + ",".join((*MASKS, s.IMAGES_SQL, NUC_SCORE_SQL, BEST_SQL)) + """
SELECT dataset, round(max(v), 1) AS total FROM dp GROUP BY 1""")
def _(spark, sf):
    scores = pairing.score_nucleus_pairs(shift_candidates(spark, sf), s.label_pixels(spark, sf))
    best = best_assignment(scores, ["dataset"])
    return best.groupBy("dataset").agg(nround(F.sum("score"), 1).alias("total"))


@query("remap_by_tiles")
def _(spark, sf):
    """Re-pairing over candidates from the tile index, by the best assignment."""
    labels = s.label_pixels(spark, sf)
    scores = pairing.score_nucleus_pairs(pairing.nucleus_candidates(labels, 8.0), labels)
    return rounded(pairing.remap_batch(scores), 1)


@query("ki67_remap_by_tiles")
def _(spark, sf):
    labels, mask = s.label_pixels(spark, sf), ki67_mask(spark, sf)
    scores = pairing.score_mask_pairs(pairing.mask_candidates(labels, mask, 8.0), labels, mask)
    return rounded(pairing.remap_batch(scores, rule="count"), 1)


ROI_SQL = """
roi AS (SELECT lp.dataset, lp.image_id, region, label, count(*) AS area, avg(v) AS mean, min(v) AS vmin, max(v) AS vmax,
  avg(lp.x) AS cx, avg(lp.y) AS cy FROM lp JOIN px USING (image_id, x, y) GROUP BY ALL)"""


@query("merge_roi_wide", with_ctes(*MASKS, s.IMAGES_SQL, s.pixels_sql(), ROI_SQL, body="""
SELECT coalesce(n.image_id, c.image_id) AS image_id, coalesce(n.label, c.label) AS label,
  n.area AS area_nuc, round(n.mean, 6) AS mean_nuc, round(n.cx, 6) AS cx_nuc,
  c.area AS area_cyto, round(c.mean, 6) AS mean_cyto, round(c.cx, 6) AS cx_cyto,
  CASE WHEN c.area - n.area > 0 THEN round(n.area / (c.area - n.area), 6) END AS karyoplasmic_ratio
FROM (FROM roi WHERE region = 'nuc') n FULL JOIN (FROM roi WHERE region = 'cyto') c ON n.image_id = c.image_id AND n.label = c.label"""))
def _(spark, sf):
    from petridish.operators import roi

    keys = ["image_id", "label"]
    rows = roi.join_signal(s.label_pixels(spark, sf), s.pixels(spark, sf), ["image_id"])
    long = rows.groupBy("image_id", "region", "label").agg(
        F.count(F.lit(1)).alias("area"), nround(F.avg("v"), 6).alias("mean"), nround(F.avg("x"), 6).alias("cx")
    )
    wide = pairing.merge_roi_wide(long, keys, ["area", "mean", "cx"])
    return wide.withColumn(
        "karyoplasmic_ratio", nround(roi.karyoplasmic_ratio("area_nuc", "area_cyto"), 6)
    )


@query("merge_fluor", with_ctes(s.CELLS_SQL, body="""
SELECT a.image_id, "Image" || '_' || a.cell_id AS "Cell_ID", round(a.area, 6) AS area, round(b.area / 2, 6) AS ring0
FROM cells a LEFT JOIN (SELECT image_id, cell_id, area FROM cells WHERE cell_status <> 'unknown' AND cell_id > 0) b USING (image_id, cell_id)"""))
def _(spark, sf):
    c = s.cells(spark, sf)
    left = c.select("image_id", F.concat_ws("_", "Image", "cell_id").alias("Cell_ID"), nround("area", 6).alias("area"))
    right = c.filter("cell_status <> 'unknown'").select(
        "image_id",
        F.concat(F.col("Image"), F.lit(".tif_"), F.col("cell_id")).alias("Cell_ID"),
        nround(F.col("area") / 2, 6).alias("ring0"),
    )
    return pairing.merge_fluor(left, right, ["image_id"])


@query("merge_labels", with_ctes(s.CELLS_SQL, body="""
SELECT image_id, cell_id, CASE WHEN k > 70 THEN 1 ELSE 0 END AS ki67_positive FROM cells"""))
def _(spark, sf):
    c = s.cells(spark, sf).select("image_id", "cell_id", "k")
    return pairing.merge_labels(c, c.filter("k > 70"), ["image_id", "cell_id"]).drop("k")


@query("repair_labels", with_ctes(s.GEOMETRY_SQL, s.VERTEX_SQL, EDGE_SQL, body="""
SELECT g.dataset, g.image_id, g.roi_id, g.rc, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS ki67_positive, status AS cell_status
FROM geom g JOIN sts USING (image_id, roi_id) WHERE g.dataset IN ('set_2', 'set_5', 'set_7')"""))
def _(spark, sf):
    g = s.geometry(spark, sf)
    keys = ["image_id", "roi_id"]
    cells = g.select("dataset", *keys, "rc", F.lit(0).alias("ki67_positive"), F.lit("empty").alias("cell_status"))
    return pairing.repair_labels(
        cells, ["set_2", "set_5", "set_7"], g.filter("p_partkey % 3 = 0"), statuses(spark, sf), keys
    )


@query("attach_embeddings", with_ctes(s.CELLS_SQL, body=f"""
SELECT cell_id, image_key, CAST(coalesce(len(embedding), 64) AS INT) AS size, round(coalesce(list_sum(list_transform(embedding, lambda e: CAST(e AS DOUBLE))), 0), 4) AS total,
  round(coalesce(CAST(embedding[1] AS DOUBLE), 0), 6) AS first
FROM cells LEFT JOIN (SELECT {s.VECTOR_KEY} AS image_key, embedding FROM embeddings) USING (image_key)"""))
def _(spark, sf):
    vectors = table(spark, sf, "embeddings").select(F.expr(s.VECTOR_KEY).alias("image_key"), "embedding")
    cells = s.cells(spark, sf).select("cell_id", "image_key")
    out = pairing.attach_embeddings(cells, vectors, 64)
    return out.select(
        "cell_id",
        "image_key",
        F.size("embedding").alias("size"),
        nround(F.expr("aggregate(embedding, 0D, (a, e) -> a + cast(e as double))"), 4).alias("total"),
        nround(F.col("embedding")[0].cast("double"), 6).alias("first"),
    )


FUZZY_IMAGE = "case doc_id % 4 when 0 then 'scan' || doc_id when 1 then 'x_' || doc_id when 2 then 'pre ' || doc_id || ' post' else 'f' || doc_id end"
FUZZY_FILE = "case doc_id % 4 when 0 then 'scan' || doc_id || '.png' when 1 then 'long_x_' || doc_id || '.tif' when 2 then doc_id || '.jpg' else 'zz' || doc_id || '.png' end"


@query("resolve_image_fuzzy", f"""
WITH i AS (SELECT source AS folder, {FUZZY_IMAGE} AS image FROM documents),
f AS (SELECT source AS folder, {FUZZY_FILE} AS file FROM documents WHERE lang <> 'es'),
j AS (SELECT folder, image, file, CASE WHEN s = image THEN 0 WHEN ends_with(s, image) OR ends_with(image, s) THEN 1 ELSE 2 END AS tier
  FROM (SELECT *, regexp_replace(file, '\\.[^.]*$', '') AS s FROM f) JOIN i USING (folder)
  WHERE s = image OR contains(s, image) OR contains(image, s)),
b AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY folder, image ORDER BY tier, file) = 1)
SELECT i.folder, i.image, b.file, b.tier FROM i LEFT JOIN b USING (folder, image)""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    images = d.select(F.col("source").alias("folder"), F.expr(FUZZY_IMAGE).alias("image"))
    files = d.filter("lang <> 'es'").select(
        F.col("source").alias("folder"), F.expr(FUZZY_FILE).alias("file")
    )
    return pairing.resolve_image_fuzzy(images, files)


def _image_sets(spark, sf):
    d = table(spark, sf, "documents").select(
        F.col("source").alias("source_folder"), F.col("doc_id").cast("string").alias("image_name"), "lang"
    )
    return d.filter("lang <> 'fr'").drop("lang"), d.filter("lang <> 'de'").drop("lang")


@query("folder_diagnostics", """
SELECT source AS source_folder, count(*) FILTER (lang <> 'fr') AS input_image_count, count(*) FILTER (lang <> 'de') AS used_image_count,
  count(*) FILTER (lang = 'de') AS missing_image_count, count(*) FILTER (lang = 'fr') AS extra_image_count
FROM documents GROUP BY 1""")
def _(spark, sf):
    return pairing.folder_diagnostics(*_image_sets(spark, sf))


@query("set_difference", """
SELECT source AS source_folder, CAST(doc_id AS VARCHAR) AS image_name, CASE WHEN lang = 'de' THEN 'missing' ELSE 'extra' END AS side
FROM documents WHERE lang IN ('de', 'fr')""")
def _(spark, sf):
    return pairing.image_set_difference(*_image_sets(spark, sf), ["source_folder", "image_name"])


@query("compare_backends", with_ctes(s.CELLS_SQL, body="""
, a AS (SELECT image_id, cell_id, unnest(['area', 'nuc_area', 'k']) AS feature, unnest([area, nuc_area, CAST(k AS DOUBLE)]) AS va,
   unnest([area * 1.1 - k / 10.0, CASE WHEN k % 4 <> 0 THEN nuc_area + 1 END, 5.0]) AS vb FROM cells WHERE cell_status NOT IN ('unknown', 'nuc_only'))
SELECT image_id, feature, count(*) AS pairs, round(avg(va), 5) AS mean_left, round(avg(vb), 5) AS mean_right, round(avg(vb - va), 5) AS mean_difference,
  round(avg(abs(vb - va)), 5) AS mean_abs_difference, round(max(abs(vb - va)), 5) AS max_abs_difference,
  CASE WHEN stddev_pop(va) > 0 AND stddev_pop(vb) > 0 THEN round(corr(va, vb), 5) END AS pearson, round(median(abs(vb - va)), 5) AS median_abs_difference
FROM a WHERE va IS NOT NULL AND vb IS NOT NULL GROUP BY ALL"""))
def _(spark, sf):
    c = s.cells(spark, sf)
    left = c.filter("cell_status <> 'unknown'").select("image_id", "cell_id", "area", "nuc_area", "k")
    right = c.filter("cell_status <> 'nuc_only'").select(
        "image_id",
        "cell_id",
        F.expr("area * 1.1D - k / 10D").alias("area"),
        F.expr("case when k % 4 <> 0 then nuc_area + 1 else double('inf') end").alias("nuc_area"),
        F.lit(5.0).alias("k"),
    )
    out = pairing.compare_backends(left, right, ["image_id", "cell_id"], ["area", "nuc_area", "k"], ["image_id"])
    for name, kind in out.dtypes:
        if kind == "double":
            out = out.withColumn(name, nround(name, 5))
    return out


@query("select_datasets", """
SELECT DISTINCT source AS folder, 'selected' AS state FROM documents WHERE source IN ('src1', 'src12', 'src7')
UNION ALL SELECT 'nowhere', 'missing'""")
def _(spark, sf):
    folders = table(spark, sf, "documents").select(F.col("source").alias("folder"))
    return tables.select_datasets(folders, ["SRC1", "src12 ", "Src7", "src3", "Nowhere"], ["src3"])


@query("dedupe", """
SELECT source, lang, doc_id, n_chars FROM documents
QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) = 1""")
def _(spark, sf):
    d = table(spark, sf, "documents").select("source", "lang", "doc_id", "n_chars")
    return tables.dedupe(d, ["source", "lang"], "doc_id")
