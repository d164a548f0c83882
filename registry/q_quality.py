"""Queries over filters, predicates and quality control."""

from __future__ import annotations

from pyspark.sql import functions as F

from petridish.functions import text
from petridish.operators import quality
from petridish.sources import tables
from registry import standins as s
from registry.rounding import nround, nudged_sql
from registry.q_sources import FILE_SQL, study_files
from registry.standins import table, with_ctes

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = nudged_sql(sql)
        return fn

    return register


EDGE_SQL = """
edges AS (SELECT image_id, roi_id, region, count(*) >= 3 AND greatest(
    count(*) FILTER (x <= 1), count(*) FILTER (y <= 1), count(*) FILTER (x >= 30), count(*) FILTER (y >= 30)) >= 2 AS cut
  FROM vert GROUP BY ALL),
sts AS (SELECT coalesce(a.image_id, b.image_id) AS image_id, coalesce(a.roi_id, b.roi_id) AS roi_id,
  CASE WHEN b.cut IS NULL AND a.cut THEN 'nuc_cut' WHEN b.cut IS NULL THEN 'nuc_only'
    WHEN a.cut IS NULL THEN 'cyto_only' WHEN a.cut AND b.cut THEN 'both_cut' WHEN a.cut THEN 'nuc_cut'
    WHEN b.cut THEN 'cyto_cut' ELSE 'full_cell' END AS status
  FROM (FROM edges WHERE region = 'nuc') a FULL JOIN (FROM edges WHERE region = 'cyto') b
    ON a.image_id = b.image_id AND a.roi_id = b.roi_id)"""


def statuses(spark, sf):
    return quality.outline_status(s.outlines(spark, sf), F.lit(s.WIDTH), F.lit(s.HEIGHT))


@query("touches_edge", with_ctes(s.GEOMETRY_SQL, s.VERTEX_SQL, EDGE_SQL, body="""
SELECT image_id, roi_id, coalesce(bool_or(cut) FILTER (region = 'nuc'), false) AS nuc_cut,
  coalesce(bool_or(cut) FILTER (region = 'cyto'), false) AS cyto_cut FROM edges GROUP BY ALL"""))
def _(spark, sf):
    w, h = F.lit(s.WIDTH), F.lit(s.HEIGHT)
    return s.outlines(spark, sf).select(
        "image_id",
        "roi_id",
        *[
            F.coalesce(quality.touches_edge(c, w, h), F.lit(False)).alias(f"{c}_cut")
            for c in ("nuc", "cyto")
        ],
    )


@query("outline_status", with_ctes(s.GEOMETRY_SQL, s.VERTEX_SQL, EDGE_SQL, body="SELECT * FROM sts"))
def _(spark, sf):
    return statuses(spark, sf).select("image_id", "roi_id", "status")


@query("add_status", with_ctes(s.GEOMETRY_SQL, s.VERTEX_SQL, EDGE_SQL, body="""
SELECT g.image_id, g.roi_id, rc, coalesce(status, 'unknown') AS cell_status
FROM geom g LEFT JOIN sts USING (image_id, roi_id)"""))
def _(spark, sf):
    cells = s.geometry(spark, sf).select("image_id", "roi_id", "rc")
    return quality.add_status(cells, statuses(spark, sf), ["image_id", "roi_id"])


@query("clean_cells", with_ctes(s.CELLS_SQL, body="""
SELECT cell_id, round(CASE WHEN cell_id % 2 = 0 THEN area END, 6) AS area, k, cell_status FROM cells
WHERE cell_status <> 'unknown'
UNION ALL
SELECT cell_id + 1000000, round(area, 6), NULL, 'dropna' FROM cells
WHERE cell_id % 19 <> 0 AND cell_id % 23 <> 0"""))
def _(spark, sf):
    c = s.cells(spark, sf)
    first = c.filter("cell_id % 2 = 0").select("cell_id", "cell_status", "area", "k")
    second = c.filter("cell_id % 2 = 1").select("cell_id", "cell_status", "k")
    with_status = quality.clean_cells([first, second])
    bare = c.select(
        (F.col("cell_id") + 1000000).alias("cell_id"),
        F.expr("case when cell_id % 19 <> 0 then area end").alias("area_nuc"),
        F.expr("case when cell_id % 23 <> 0 then area end").alias("area_cyto"),
    )
    dropped = quality.clean_cells([bare]).select(
        "cell_id",
        F.col("area_nuc").alias("area"),
        F.lit(None).cast("int").alias("k"),
        F.lit("dropna").alias("cell_status"),
    )
    return with_status.unionByName(dropped).withColumn("area", nround("area", 6))


@query("filter_extreme_ratio", """
WITH d AS (SELECT doc_id, source || '::' || lang AS image_key, quality AS ki67_label FROM documents JOIN labels USING (doc_id)),
r AS (SELECT image_key, avg(ki67_label) AS ratio FROM d GROUP BY 1)
SELECT doc_id, image_key, ki67_label FROM d JOIN r USING (image_key) WHERE ratio > 0 AND ratio < 1""")
def _(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(
        "doc_id",
        F.concat_ws("::", "source", "lang").alias("image_key"),
        F.col("quality").alias("ki67_label"),
    )
    return quality.filter_extreme_ratio(d)


@query("valid_area", with_ctes(s.CELLS_SQL, body="""
SELECT cell_id, round(nuc_area, 6) AS "Area_nuc", round(area, 6) AS "Area_cyto" FROM cells
WHERE cell_id % 5 <> 0 AND cell_id % 7 <> 0 AND nuc_area > 0 AND area > 0 AND k <> 3"""))
def _(spark, sf):
    c = s.cells(spark, sf).select(
        "cell_id",
        F.expr("case when cell_id % 5 = 0 then 'bad' when k = 3 then '-2' else cast(nuc_area as string) end").alias("Area_nuc"),
        F.expr("case when cell_id % 7 = 0 then double('inf') else area end").alias("Area_cyto"),
    )
    return quality.valid_area(c).select(
        "cell_id", nround("Area_nuc", 6).alias("Area_nuc"), nround("Area_cyto", 6).alias("Area_cyto")
    )


QC_SQL = """
lpx AS (SELECT image_id, label, x, y, max(CAST(region = 'nuc' AS INT)) AS n, max(CAST(region = 'cyto' AS INT)) AS c FROM lp GROUP BY ALL),
areas AS (SELECT image_id, label, sum(n) AS na, sum(c) AS ca, sum(n * (1 - c)) AS outn, sum(c * (1 - n)) AS cyt FROM lpx GROUP BY ALL),
dec AS (SELECT st.image_id, roi_id, status, CASE WHEN status <> 'full_cell' THEN NULL
   WHEN na > 0 AND outn / na > 0.05 THEN 'outside' WHEN coalesce(cyt, 0) <= 0 THEN 'no_cytoplasm' ELSE 'kept' END AS decision
  FROM sts st LEFT JOIN areas a ON a.image_id = st.image_id AND a.label = st.roi_id)"""


@query("full_cell_qc", with_ctes(s.GEOMETRY_SQL, s.VERTEX_SQL, EDGE_SQL, s.LABELS_SQL, QC_SQL, body="""
SELECT image_id, count(*) AS outline_pairs, count(*) FILTER (decision = 'kept') AS kept_full_cells,
  count(*) FILTER (decision = 'outside') AS excluded_nucleus_outside,
  count(*) FILTER (decision = 'no_cytoplasm') AS excluded_empty_cytoplasm, """ + ", ".join(
    f"count(*) FILTER (status = '{x}') AS status_{x}"
    for x in ("full_cell", "nuc_only", "cyto_cut", "cyto_only", "nuc_cut", "both_cut", "empty")
) + " FROM dec GROUP BY 1"))
def _(spark, sf):
    st = statuses(spark, sf).select("image_id", F.col("roi_id").alias("label"), "status")
    _, counts = quality.full_cell_qc(st, s.label_pixels(spark, sf), ["image_id"])
    return counts


@query("load_study_cells", with_ctes(FILE_SQL, body="""
, man AS (SELECT image_key, condition, ifn_dose, tnf_dose, image_index,
    regexp_extract(path, '([^/]*)\\.jpg$', 1) AS stem FROM fields WHERE channel = 'phase'),
c AS (SELECT CAST(l_orderkey AS INT) AS idx, l_partkey, l_quantity, l_extendedprice, l_linestatus, l_returnflag FROM lineitem)
SELECT image_key, stem AS pc_stem, condition, ifn_dose AS "IFN_dose", tnf_dose AS "TNF_dose", image_index,
  'full_cell' AS cell_status, 'c_' || l_partkey AS "Cell_ID", round(l_quantity, 6) AS "Area_nuc",
  round(l_extendedprice / 7, 6) AS "IDO_score", round(l_quantity / 3, 6) AS "IDO_background_median",
  CASE WHEN l_partkey % 5 <> 0 THEN round(l_quantity / 9, 6) END AS "IDO_cytoplasm_mean"
FROM c JOIN man ON image_index = idx WHERE l_linestatus = 'F' AND l_partkey % 11 <> 0"""))
def _(spark, sf):
    manifest = tables.parse_image_filename(study_files(spark, sf)).filter("channel = 'phase'")
    manifest = manifest.withColumn("pc_stem", text.file_stem("path"))
    names = manifest.select("pc_stem", F.col("image_index").alias("idx"))
    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("int").alias("idx"),
        F.concat(F.lit("c_"), "l_partkey").alias("Cell_ID"),
        F.when(F.col("l_linestatus") == "F", "full_cell").otherwise("nuc_only").alias("cell_status"),
        F.col("l_quantity").cast("string").alias("Area_nuc"),
        (F.col("l_quantity") / 3).alias("IDO_BackgroundMean"),
        F.expr("case when l_partkey % 5 = 0 then 'x' else cast(l_quantity / 9 as string) end").alias("IDO_MeanIntensity"),
        F.expr("case when l_partkey % 11 = 0 then double('nan') else l_extendedprice / 7 end").alias("IDO_MeanIntensity_BgSub"),
    )
    cells = li.join(names, "idx").withColumnRenamed("pc_stem", "Image")
    out = tables.load_study_cells(cells, manifest, ["Area_nuc"])
    for c in ("Area_nuc", "IDO_score", "IDO_background_median", "IDO_cytoplasm_mean"):
        out = out.withColumn(c, nround(c, 6))
    return out


@query("append_prediction_cols", with_ctes(s.CELLS_SQL, body="""
SELECT cell_id, round(cell_prob, 6) AS cell_prob, ki67_label,
  CASE WHEN cell_prob >= 0.3 THEN 1 ELSE 0 END AS cell_pred,
  (CASE WHEN cell_prob >= 0.3 THEN 1 ELSE 0 END) = ki67_label AS cell_correct
FROM (SELECT cell_id, cell_prob, CASE WHEN k % 9 <> 0 THEN ki67_label END AS ki67_label FROM cells)"""))
def _(spark, sf):
    c = s.cells(spark, sf).select(
        "cell_id", "cell_prob", F.expr("case when k % 9 <> 0 then ki67_label end").alias("ki67_label")
    )
    return quality.append_prediction_cols(c, 0.3).withColumn("cell_prob", nround("cell_prob", 6))


@query("default_split", with_ctes(s.CELLS_SQL, body="""
SELECT cell_id, source_folder, source_folder AS split FROM cells
UNION ALL SELECT cell_id + 1000000, source_folder, split FROM cells"""))
def _(spark, sf):
    c = s.cells(spark, sf)
    filled = quality.default_split(c.select("cell_id", "source_folder"))
    kept = quality.default_split(
        c.select((F.col("cell_id") + 1000000).alias("cell_id"), "source_folder", "split")
    )
    return filled.unionByName(kept)


IMAGE_PRED_SQL = s.CELLS_SQL + """,
ipred AS (SELECT image_key, source_folder, split, count(*) AS cell_count, avg(cell_prob) AS pred_ratio,
  CASE WHEN max(image_id) % 9 <> 0 THEN avg(ki67_label) END AS true_ratio FROM cells GROUP BY ALL)"""


def image_predictions(spark, sf):
    return s.cells(spark, sf).groupBy("image_key", "source_folder", "split").agg(
        F.count(F.lit(1)).alias("cell_count"),
        F.avg("cell_prob").alias("pred_ratio"),
        F.when(F.max("image_id") % 9 != 0, F.avg("ki67_label")).alias("true_ratio"),
    )


@query("append_error_cols", with_ctes(IMAGE_PRED_SQL, body="""
SELECT image_key, round(pred_ratio, 6) AS pred_ratio, round(true_ratio, 6) AS true_ratio,
  round(pred_ratio - true_ratio, 6) AS signed_error, round(abs(pred_ratio - true_ratio), 6) AS abs_error FROM ipred"""))
def _(spark, sf):
    out = quality.append_error_cols(image_predictions(spark, sf))
    return out.select(
        "image_key",
        *[nround(c, 6).alias(c) for c in ("pred_ratio", "true_ratio", "signed_error", "abs_error")],
    )


@query("positive_value", """
SELECT event_id, CASE WHEN t IN ('true', 'yes', 'y', 'positive', 'pos') THEN true
  WHEN t IN ('', 'false', 'no', 'n', 'negative', 'neg') THEN false
  ELSE coalesce(TRY_CAST(t AS DOUBLE) > 0, false) END AS positive
FROM (SELECT event_id, lower(trim(CASE event_id % 7 WHEN 0 THEN ' YES ' WHEN 1 THEN CAST(value - 40 AS VARCHAR)
  WHEN 2 THEN event_type WHEN 3 THEN '' WHEN 4 THEN 'Neg' WHEN 5 THEN 'pos' ELSE '-0.0' END)) AS t FROM events)""")
def _(spark, sf):
    raw = F.expr(
        "case cast(event_id % 7 as int) when 0 then ' YES ' when 1 then cast(value - 40 as string)"
        " when 2 then event_type when 3 then '' when 4 then 'Neg' when 5 then 'pos' else '-0.0' end"
    )
    return table(spark, sf, "events").select("event_id", text.is_positive(raw).alias("positive"))
