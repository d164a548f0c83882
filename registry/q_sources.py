"""Queries over sources, keys and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from petridish.functions import text
from petridish.operators.scale import rank_within
from petridish.session import checkpoint_dir
from petridish.sources import images, outlines, sinks, tables
from registry import standins as s
from registry.rounding import nround, nudged_sql
from registry.standins import table, with_ctes

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = nudged_sql(sql)
        return fn

    return register


URL_STEM = "regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1')"
NATURAL = (
    "array_to_string(list_transform(regexp_extract_all({0}, '(\\d+|\\D+)'), lambda c:"
    " CASE WHEN regexp_full_match(c, '\\d+') THEN repeat('0', greatest(20 - length(c), 0)) || c ELSE c END), '')"
)


@query("scan_images", with_ctes(s.GEOMETRY_SQL, s.IMAGES_SQL, s.pixels_sql("phase"), body="""
SELECT 'img_' || image_id AS path, x, y, round(v / 255, 6) AS v FROM px"""))
def _(spark, sf):
    """Image rows with 8-bit samples, every third with 16 bits, decoded to pixels."""
    px = s.pixels(spark, sf)
    low = F.lpad(F.hex(F.col("v").cast("int")), 2, "0")
    # a 16-bit sample of the same brightness has the byte twice
    wide = F.when(F.col("image_id") % 3 == 0, F.concat(low, low)).otherwise(low)
    rows = px.groupBy("image_id").agg(
        F.array_sort(F.collect_list(F.struct("y", "x", wide.alias("hex")))).alias("samples")
    )
    data = F.unhex(F.array_join(F.transform("samples", lambda p: p["hex"]), ""))
    scans = rows.select(
        F.concat(F.lit("img_"), F.col("image_id")).alias("path"),
        F.lit(s.WIDTH).alias("width"),
        F.lit(s.HEIGHT).alias("height"),
        F.lit(1).alias("channels"),
        data.alias("data"),
    )
    return images.decode_pixels(scans).select("path", "x", "y", nround("v", 6).alias("v"))


@query("scan_filter_channel", f"""
SELECT page_id, {URL_STEM} AS stem FROM pages
WHERE NOT contains(lower({URL_STEM}), 'ki67') AND NOT contains(lower({URL_STEM}), 'df')
  AND NOT contains(lower({URL_STEM}), 'utm')""")
def _(spark, sf):
    files = table(spark, sf, "pages").select("page_id", text.file_stem("url").alias("stem"))
    return images.phase_only(files, words=(*images.NOT_PHASE, "utm"))


@query("natural_sort_key", f"""
SELECT page_id, {NATURAL.format('url')} AS sort_key,
  row_number() OVER (ORDER BY {NATURAL.format('url')}, page_id) AS pos FROM pages""")
def _(spark, sf):
    files = table(spark, sf, "pages").select(
        "page_id", text.natural_sort_key("url").alias("sort_key")
    )
    return rank_within(files, [], ["sort_key", "page_id"], "pos")


@query("explode_pixels", with_ctes(s.GEOMETRY_SQL, s.IMAGES_SQL, s.pixels_sql(), body="""
SELECT dataset, image_id, x, y, round(v / 255.0, 6) AS v FROM px"""))
def _(spark, sf):
    px = images.explode_pixels(s.images(spark, sf), ["dataset", "image_id"])
    return px.withColumn("v", nround("v", 6))


@query("read_binary_mask", with_ctes(s.GEOMETRY_SQL, s.IMAGES_SQL, s.pixels_sql(), body="""
SELECT image_id, x, y FROM px WHERE v - 128 > 0"""))
def _(spark, sf):
    px = s.pixels(spark, sf).withColumn("v", F.col("v") - 128)
    return images.mask_pixels(px).select("image_id", "x", "y")


OUTLINE_SUMS = """
sums AS (SELECT image_id, roi_id, region, count(*) AS n, CAST(sum(x * pos) AS BIGINT) AS sx,
  CAST(sum(y * pos) AS BIGINT) AS sy FROM vert GROUP BY ALL),
pairs AS (SELECT coalesce(a.image_id, b.image_id) AS image_id, coalesce(a.roi_id, b.roi_id) AS roi_id,
  a.n AS nuc_points, a.sx AS nuc_sx, a.sy AS nuc_sy, b.n AS cyto_points, b.sx AS cyto_sx, b.sy AS cyto_sy
  FROM (FROM sums WHERE region = 'nuc') a
  FULL JOIN (FROM sums WHERE region = 'cyto') b ON a.image_id = b.image_id AND a.roi_id = b.roi_id)"""


def _outline_sums(df):
    def weighted(side, axis):
        return F.expr(
            f"aggregate(transform({side}, (p, i) -> cast(p.{axis} * i as bigint)), 0L, (a, b) -> a + b)"
        )

    return df.select(
        "image_id",
        "roi_id",
        *[
            c
            for side in ("nuc", "cyto")
            for c in (
                F.when(F.col(side).isNotNull(), F.size(side).cast("bigint")).alias(f"{side}_points"),
                weighted(side, "x").alias(f"{side}_sx"),
                weighted(side, "y").alias(f"{side}_sy"),
            )
        ],
    )


@query("scan_outlines", with_ctes(s.GEOMETRY_SQL, s.VERTEX_SQL, OUTLINE_SUMS, body="SELECT * FROM pairs"))
def _(spark, sf):
    return _outline_sums(s.outlines(spark, sf))


@query("outline_pairs_only", with_ctes(s.GEOMETRY_SQL, s.VERTEX_SQL, OUTLINE_SUMS, body="""
SELECT * FROM pairs WHERE nuc_points IS NOT NULL AND cyto_points IS NOT NULL"""))
def _(spark, sf):
    return _outline_sums(outlines.paired_only(s.outlines(spark, sf)))


@query("scan_cleaned", """
SELECT 'results/' || source || '/' || doc_id || CASE WHEN lang = 'en' THEN '_final.csv' ELSE '_cleaned.csv' END AS path,
  source AS source_folder
FROM documents WHERE lang <> 'en' AND lower(source) NOT IN ('src3', 'src4') AND source <> 'src1'
  AND lower(source) IN ('src3', 'src5', 'src6', 'src7', 'src8', 'src9', 'src10')""")
def _(spark, sf):
    files = table(spark, sf, "documents").select(
        F.concat(
            F.lit("results/"),
            "source",
            F.lit("/"),
            F.col("doc_id").cast("string"),
            F.when(F.col("lang") == "en", "_final.csv").otherwise("_cleaned.csv"),
        ).alias("path")
    )
    keep = [f"SRC{i}" for i in (3, 5, 6, 7, 8, 9, 10)]
    return tables.select_cleaned_files(files, include=keep, exclude=["src3", "Src4 ", "src1"])


@query("load_cells", with_ctes(s.CELLS_SQL, body="""
, raw AS (SELECT *, source_folder || '/' || source_folder || '_cleaned.csv' AS source_file,
  CASE WHEN image_id % 2 = 0 THEN CASE WHEN cell_id % 11 = 0 THEN NULL ELSE ki67_label * 3 END
       ELSE CASE WHEN k = 7 THEN NULL ELSE k - 40 END END AS lab FROM cells)
SELECT cell_id, source_folder, "Image", image_key, source_file,
  CASE WHEN image_id % 2 = 0 THEN passage ELSE 'P_UNKNOWN' END AS passage,
  CASE WHEN lab > 0 THEN 1 ELSE 0 END AS ki67_label,
  CASE WHEN cell_id % 23 <> 0 THEN round(area, 6) END AS area,
  row_number() OVER (PARTITION BY source_file ORDER BY cell_id) - 1 AS _source_row_id
FROM raw WHERE lab IS NOT NULL"""))
def _(spark, sf):
    c = s.cells(spark, sf).withColumn(
        "source_file", F.concat_ws("/", "source_folder", F.concat("source_folder", F.lit("_cleaned.csv")))
    )
    c = c.withColumn("area", F.when(F.col("cell_id") % 23 == 0, float("inf")).otherwise(F.col("area")))
    base = ["cell_id", "source_folder", "source_file", "Image", "area"]
    even = c.filter("image_id % 2 = 0").select(
        *base,
        F.col("passage").alias("Passage "),
        F.when(F.col("cell_id") % 11 != 0, F.col("ki67_label") * 3).alias("KI67_label"),
    )
    odd = c.filter("image_id % 2 = 1").select(
        *base,
        F.when(F.col("k") != 7, (F.col("k") - 40).cast("string")).otherwise("n/a").alias("Ki67_positive"),
    )
    nolabel = c.select(*base)
    out = tables.load_cells([even, odd, nolabel], "cell_id")
    return out.select(
        "cell_id", "source_folder", "Image", "image_key", "source_file", "passage", "ki67_label",
        nround("area", 6).alias("area"), "_source_row_id",
    )


@query("parse_passage", """
SELECT doc_id, coalesce('P' || CAST(CAST(regexp_extract_all(t, '(?i)\\bP(?:assage)?[-_ ]?(\\d{1,2})\\b', 1)[-1] AS INT) AS VARCHAR), 'P_UNKNOWN') AS passage
FROM (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN ' ' || source || '-P' || (n_chars % 40)
  WHEN doc_id % 3 = 1 THEN ' passage_0' || (n_chars % 9) || ' ' ELSE '' END AS t FROM documents)""")
def _(spark, sf):
    full = F.concat(
        F.col("text"),
        F.expr(
            "case when doc_id % 3 = 0 then ' ' || source || '-P' || (n_chars % 40)"
            " when doc_id % 3 = 1 then ' passage_0' || (n_chars % 9) || ' ' else '' end"
        ),
    )
    return table(spark, sf, "documents").select("doc_id", text.passage_of(full).alias("passage"))


@query("image_key", "SELECT doc_id, source || '::' || doc_id AS image_key FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", text.image_key("source", F.col("doc_id").cast("string")).alias("image_key")
    )


# study file names: one file per order and channel, a few of them unreadable
FILE_SQL = """
files AS (SELECT o_orderkey, o_custkey, ch.unnest AS ch,
  CASE WHEN o_orderpriority = '2-HIGH' AND ch.unnest = 'IDO' THEN NULL ELSE
  'PC/' || CASE WHEN o_orderkey % 29 = 0 THEN 'x' ELSE '' END || 'IFN-r ' || [0, 25, 50, 100][o_custkey % 4 + 1]
  || CASE WHEN o_orderkey % 7 = 0 THEN '.5' ELSE '' END || 'ng'
  || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '_TNF-a ' || [0, 25, 50][o_orderkey % 3 + 1] || 'ng' END
  || '-' || ch.unnest || '-100X-' || o_orderkey || '.jpg' END AS path,
  20 + CASE WHEN o_orderkey % 37 = 0 AND ch.unnest = 'DAPI' THEN 1 ELSE 0 END AS width, 16 AS height
  FROM orders, unnest(['phase', 'DAPI', 'IDO']) ch),
parsed AS (SELECT *, regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^IFN-r\\s*(\\d+(?:\\.\\d+)?)\\s*ng', 1) AS ifn_t,
  o_orderkey % 29 <> 0 AS ok FROM files WHERE path IS NOT NULL),
fields AS (SELECT path, width, height, ok,
  CASE WHEN ok THEN CAST(ifn_t AS DOUBLE) END AS ifn_dose,
  CASE WHEN ok THEN CAST([0, 25, 50][o_orderkey % 3 + 1] AS DOUBLE) END AS tnf_dose,
  CASE WHEN ok THEN lower(ch) END AS channel,
  CASE WHEN ok THEN CAST(o_orderkey AS INT) END AS image_index,
  CASE WHEN ok THEN 'IFN' || ifn_t || '_TNF' || [0, 25, 50][o_orderkey % 3 + 1] END AS condition,
  CASE WHEN ok THEN 'IFN' || ifn_t || '_TNF' || [0, 25, 50][o_orderkey % 3 + 1] || '_FOV'
    || CASE WHEN o_orderkey < 10 THEN '0' ELSE '' END || o_orderkey END AS image_key FROM parsed)"""


def study_files(spark, sf):
    o = table(spark, sf, "orders").withColumn(
        "ch", F.explode(F.array(F.lit("phase"), F.lit("DAPI"), F.lit("IDO")))
    )
    path = F.expr(
        "'PC/' || case when o_orderkey % 29 = 0 then 'x' else '' end || 'IFN-r ' ||"
        " element_at(array(0, 25, 50, 100), cast(o_custkey % 4 + 1 as int)) ||"
        " case when o_orderkey % 7 = 0 then '.5' else '' end || 'ng' ||"
        " case when o_orderkey % 3 = 0 then '' else '_TNF-a ' || element_at(array(0, 25, 50), cast(o_orderkey % 3 + 1 as int)) || 'ng' end"
        " || '-' || ch || '-100X-' || o_orderkey || '.jpg'"
    )
    return o.filter("not (o_orderpriority = '2-HIGH' and ch = 'IDO')").select(
        path.alias("path"),
        F.expr("20 + case when o_orderkey % 37 = 0 and ch = 'DAPI' then 1 else 0 end").alias("width"),
        F.lit(16).alias("height"),
    )


@query("parse_image_filename", with_ctes(FILE_SQL, body="""
SELECT path, ifn_dose, tnf_dose, channel, image_index, condition, image_key, ok AS parsed FROM fields"""))
def _(spark, sf):
    return tables.parse_image_filename(study_files(spark, sf)).drop("width", "height")


@query("triplet_manifest", with_ctes(FILE_SQL, body="""
SELECT image_key, condition, ifn_dose, tnf_dose, image_index, phase_path, dapi_path, ido_path, width, height,
  regexp_extract(phase_path, '([^/]*)\\.jpg$', 1) AS pc_stem FROM (
  SELECT image_key, condition, ifn_dose, tnf_dose, image_index,
    max(path) FILTER (channel = 'phase') AS phase_path, max(path) FILTER (channel = 'dapi') AS dapi_path,
    max(path) FILTER (channel = 'ido') AS ido_path, min(width) AS width, max(width) AS w2, min(height) AS height
  FROM fields WHERE image_key IS NOT NULL GROUP BY ALL)
WHERE phase_path IS NOT NULL AND dapi_path IS NOT NULL AND ido_path IS NOT NULL AND width = w2"""))
def _(spark, sf):
    return tables.triplet_manifest(tables.parse_image_filename(study_files(spark, sf)))


@query("schema_check", with_ctes(FILE_SQL, body="""
, per_key AS (SELECT image_key, count(DISTINCT channel) AS n, count(DISTINCT width) AS w FROM fields WHERE ok GROUP BY 1),
cond AS (SELECT ifn_dose, tnf_dose, count(DISTINCT image_key) AS n FROM fields WHERE ok GROUP BY 1, 2)
SELECT 'missing channel' AS "check", image_key AS subject, n AS found FROM per_key WHERE n < 3
UNION ALL SELECT 'size mismatch', image_key, w FROM per_key WHERE w > 1
UNION ALL SELECT 'unreadable name', regexp_extract(path, '([^/]*)$', 1), 1 FROM fields WHERE NOT ok
UNION ALL SELECT 'triplet count', 'all', n FROM (SELECT count(*) AS n FROM per_key WHERE n = 3) WHERE n <> 80
UNION ALL SELECT 'condition count', CAST(e.i AS VARCHAR) || ',' || e.t, coalesce(n, 0)
  FROM (VALUES (0, 0, 9), (25, 50, 12), (75, 0, 1)) e(i, t, expected)
  LEFT JOIN cond ON ifn_dose = e.i AND tnf_dose = e.t WHERE coalesce(n, 0) <> expected"""))
def _(spark, sf):
    files = tables.parse_image_filename(study_files(spark, sf))
    return tables.manifest_violations(files, 80, {(0, 0): 9, (25, 50): 12, (75, 0): 1})


@query("parse_cell_id", with_ctes(s.CELLS_SQL, body="""
, ids AS (SELECT cell_id, CASE WHEN cell_id % 13 = 0 THEN 'broken' WHEN cell_id % 17 = 0 THEN "Image" || '_0'
  ELSE ' ' || "Image" || '_' || cell_id END AS id,
  "Image" || ':NewCell-' || cell_id || '-and' || k AS label FROM cells)
SELECT cell_id, CASE WHEN cell_id % 13 = 0 THEN NULL ELSE regexp_extract(trim(id), '^(.+)_\\d+$', 1) END AS stem,
  CASE WHEN cell_id % 13 = 0 OR cell_id % 17 = 0 OR cell_id < 1 THEN NULL ELSE cell_id - 1 END AS idx,
  split_part(label, ':', 1) || '_' || split_part(split_part(label, ':', 2), '-', 2) AS ring_cell,
  CAST(regexp_extract(label, '-and(\\d+)', 1) AS INT) AS ring FROM ids"""))
def _(spark, sf):
    c = s.cells(spark, sf).select(
        "cell_id",
        F.expr(
            "case when cell_id % 13 = 0 then 'broken' when cell_id % 17 = 0 then Image || '_0'"
            " else ' ' || Image || '_' || cell_id end"
        ).alias("id"),
        F.expr("Image || ':NewCell-' || cell_id || '-and' || k").alias("label"),
    )
    return c.select(
        "cell_id",
        text.cell_image_stem("id").alias("stem"),
        text.cell_index("id").alias("idx"),
        text.ring_cell_id("label").alias("ring_cell"),
        text.ring_number("label").alias("ring"),
    )


@query("last_numeric_token", """
SELECT page_id, CAST(regexp_extract_all(url, '(\\d+)', 1)[-1] AS BIGINT) AS token FROM pages
UNION ALL SELECT 1000000 + doc_id, TRY_CAST(regexp_extract_all(text, '(\\d+)', 1)[-1] AS BIGINT) FROM documents""")
def _(spark, sf):
    p = table(spark, sf, "pages").select("page_id", text.last_number("url").alias("token"))
    d = table(spark, sf, "documents").select(
        (F.col("doc_id") + 1000000).alias("page_id"), text.last_number("text").alias("token")
    )
    return p.union(d)


@query("write_tables", with_ctes(s.CELLS_SQL, body="""
SELECT source_folder, count(*) AS n, round(sum(area), 4) AS area, count(cell_prob) AS with_prob
FROM cells GROUP BY 1"""))
def _(spark, sf):
    path = f"{checkpoint_dir(spark)}/cells-{uuid.uuid4().hex}"
    cells = s.cells(spark, sf).select("source_folder", "cell_id", "area", "cell_prob")
    sinks.write_table(cells, path, partition_by=["source_folder"])
    return (
        spark.read.parquet(path)
        .groupBy(F.col("source_folder").cast("string").alias("source_folder"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            nround(F.sum("area"), 4).alias("area"),
            F.count("cell_prob").alias("with_prob"),
        )
    )


WIDE = {
    "Area_nuc": "nuc_area",
    "Area_cyto": "area",
    "Mean_nuc": "k",
    "GLCM ASM_cyto": "area / 7",
    "Whole Cell Mean": "area / 3",
    "Whole Cell LBP Entropy": "k / 5.0",
    "Karyoplasmic Ratio": "nuc_area / 9",
    "Nuc Cyto Mean Ratio": "k / 7.0",
    "Nucleus Centroid Offset": "k / 11.0",
    "Halo Width": "k % 7",
    "Local Density": "area / 11",
    "Cluster Size": "k % 5",
    "Mitotic Index": "k / 101.0",
    "Debris Count": "k % 3",
    "Nucleolus Count": "k % 4",
    "Perimeter_cyto": "area / 2",
    "Eccentricity_nuc": "k / 103.0",
    "IDO_MeanIntensity": "area / 13",
    "Custom Score": "k",
}


def wide_cells(spark, sf):
    return s.cells(spark, sf).select(
        F.concat_ws("_", "Image", "cell_id").alias("Cell_ID"),
        "Image",
        "source_folder",
        "image_key",
        "cell_status",
        "ki67_label",
        "cell_prob",
        *[F.expr(e).cast("double").alias(n) for n, e in WIDE.items()],
    )


WIDE_LONG_SQL = "long AS (" + "\nUNION ALL ".join(
    f"SELECT cell_id, \"Image\", source_folder, cell_status, '{n}' AS feature, CAST({e} AS DOUBLE) AS value FROM cells"
    for n, e in WIDE.items()
) + ")"
_SHEETS = {
    "engineer": {
        "Texture": ("GLCM ASM_cyto", "Whole Cell LBP Entropy"),
        "Intensity distribution": ("Mean_nuc", "Whole Cell Mean", "Nuc Cyto Mean Ratio"),
        "Halo-rounding": ("Halo Width",),
        "Local crowding": ("Local Density",),
        "Colony-FOV context": ("Cluster Size",),
        "Mitosis likelihood": ("Mitotic Index",),
        "Debris-culture health": ("Debris Count",),
        "Nuclear morphology": ("Area_nuc", "Karyoplasmic Ratio", "Nucleolus Count", "Eccentricity_nuc"),
        "Attachment-spreading": ("Area_cyto", "Nucleus Centroid Offset", "Perimeter_cyto"),
        "IDO response": ("IDO_MeanIntensity",),
        "Other": ("Custom Score",),
    },
    "biomedical": {
        "核與細胞關係": ("Karyoplasmic Ratio", "Nuc Cyto Mean Ratio", "Nucleus Centroid Offset", "Nucleolus Count"),
        "紋理與異質性": ("GLCM ASM_cyto", "Whole Cell LBP Entropy"),
        "強度與分布": ("Mean_nuc", "Whole Cell Mean"),
        "大小與尺度": ("Area_nuc", "Area_cyto"),
        "形狀與延展": ("Eccentricity_nuc",),
        "邊界與不規則": ("Perimeter_cyto", "Halo Width"),
        "群體與排列": ("Local Density", "Cluster Size", "Mitotic Index"),
        "分裂碎屑與健康": ("Debris Count",),
        "IDO反應": ("IDO_MeanIntensity",),
        "其他欄位": ("Custom Score",),
    },
}


def sheet_case(profile):
    return "CASE " + " ".join(
        f"WHEN feature IN ({', '.join(repr(f) for f in fs)}) THEN '{g}'" for g, fs in _SHEETS[profile].items()
    ) + " END"


@query("feature_group_sheets", with_ctes(s.CELLS_SQL, WIDE_LONG_SQL, body=f"""
SELECT "Image" || '_' || cell_id AS "Cell_ID", "Image", cell_status, feature, round(value, 6) AS value,
  {sheet_case('engineer')} AS feature_group FROM long"""))
def _(spark, sf):
    wide = wide_cells(spark, sf).drop("source_folder", "image_key", "ki67_label", "cell_prob")
    return sinks.feature_group_sheets(wide).withColumn("value", nround("value", 6))


@query("classify_feature", with_ctes(s.CELLS_SQL, WIDE_LONG_SQL, body=f"""
SELECT feature, regexp_replace(feature, '^Whole Cell |_nuc$|_cyto$', '') AS base,
  CASE WHEN feature LIKE 'Whole Cell %' THEN 'whole_cell' WHEN feature LIKE '%\\_nuc' ESCAPE '\\' THEN 'nucleus'
    WHEN feature LIKE '%\\_cyto' ESCAPE '\\' THEN 'cell_outline' ELSE 'none' END AS region,
  {sheet_case('engineer')} AS engineer, {sheet_case('biomedical')} AS biomedical,
  count(value) AS n, round(sum(value), 2) AS total FROM long GROUP BY ALL"""))
def _(spark, sf):
    from petridish.functions import catalog

    rows = sinks.feature_rows(
        wide_cells(spark, sf).drop("source_folder", "image_key", "ki67_label", "cell_prob"),
        ["Cell_ID", "Image", "cell_status"],
    )
    per_feature = rows.groupBy("feature").agg(
        F.count("value").alias("n"), nround(F.sum("value"), 2).alias("total")
    )
    return catalog.describe(per_feature).select(
        "feature", "base", "region", "engineer", "biomedical", "n", "total"
    )


_PRED = {
    "texture": ("GLCM ASM_cyto", "Whole Cell LBP Entropy"),
    "intensity": ("Mean_nuc", "Whole Cell Mean", "Nuc Cyto Mean Ratio"),
    "attachment": ("Area_cyto", "Perimeter_cyto", "Nucleus Centroid Offset"),
    "halo": ("Halo Width",),
    "local_crowding": ("Local Density",),
    "mitosis": ("Mitotic Index",),
    "nuclear": ("Area_nuc", "Eccentricity_nuc", "Karyoplasmic Ratio", "Nucleus Centroid Offset", "Nucleolus Count"),
    "debris": ("Debris Count",),
    "colony_context": ("Cluster Size",),
}


@query("prediction_sheets", with_ctes(s.CELLS_SQL, WIDE_LONG_SQL, body="""
SELECT source_folder, source_folder AS folder, "Image" || '_' || cell_id AS "Cell_ID", feature, feature_group,
  round(value, 6) AS value FROM long JOIN (""" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, '{g}' AS feature_group" for g, fs in _PRED.items() for f in fs
) + ") m USING (feature)"))
def _(spark, sf):
    from petridish.functions.catalog import feature_groups

    wide = wide_cells(spark, sf)
    out = sinks.prediction_sheets(wide, ["source_folder", "Cell_ID"], feature_groups(WIDE))
    return out.withColumn("value", nround("value", 6))


IMAGE_SHEETS_SQL = "img AS (SELECT DISTINCT source_folder, \"Image\" AS image_name FROM cells)"
_CELL_METRICS = "cell_num, positive_ratio, accuracy, probability_mae, tn, fp, fn, tp"
_IMAGE_METRICS = (
    "image_num, cell_num, pred_ratio, pred_ratio_weighted, true_ratio, true_ratio_weighted, image_mae, image_bias, image_rmse,"
    " within_10pp, abs_error, abs_error_weighted, ratio_accuracy, ratio_accuracy_weighted"
)


def _sheet_images(spark, sf):
    return s.cells(spark, sf).groupBy("image_key").agg(
        F.min("source_folder").alias("source_folder"), F.min("Image").alias("image_name")
    )


# some stand-in quotients have six decimals on one engine only, so both sides round before the mean
@query("image_prediction_sheets", with_ctes(s.CELLS_SQL, WIDE_LONG_SQL, IMAGE_SHEETS_SQL, body="""
, st AS (SELECT source_folder, "Image" AS image_name, feature, avg(w) AS mean, median(w) AS median
  FROM (SELECT *, round(value, 6) AS w FROM long) GROUP BY ALL)
SELECT i.source_folder, i.source_folder AS folder, i.image_name, st.feature || '_' || k.stat AS feature, feature_group,
  round(CASE k.stat WHEN 'mean' THEN mean ELSE median END, 6) AS value
FROM img i JOIN st ON st.source_folder = i.source_folder AND st.image_name = i.image_name CROSS JOIN (VALUES ('mean'), ('median')) k(stat) JOIN (""" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, '{g}' AS feature_group" for g, fs in _PRED.items() for f in fs
) + ") m ON m.feature = st.feature"))
def _(spark, sf):
    from petridish.functions.catalog import feature_groups

    wide = wide_cells(spark, sf).withColumns({f: nround(F.col(f"`{f}`").cast("double"), 6) for f in WIDE})
    out = sinks.image_prediction_sheets(wide, _sheet_images(spark, sf), feature_groups(WIDE))
    return out.withColumn("value", nround("value", 6))


@query("prediction_summary", with_ctes(s.CELLS_SQL, body=f"""
, ip AS (SELECT image_key, source_folder, count(*) AS w, avg(cell_prob) AS p, CASE WHEN max(image_id) % 9 <> 0 THEN avg(ki67_label) END AS t FROM cells GROUP BY ALL),
v AS (SELECT *, p - t AS e, CASE WHEN t IS NOT NULL THEN p END AS pv, CASE WHEN t IS NOT NULL THEN w END AS wv FROM ip),
c AS (SELECT source_folder, cell_prob AS p, ki67_label AS y, CASE WHEN cell_prob >= 0.3 THEN 1 ELSE 0 END AS c FROM cells WHERE cell_prob IS NOT NULL),
cm AS (SELECT source_folder, CAST(count(*) AS DOUBLE) AS cell_num, avg(y) AS positive_ratio, avg(CASE WHEN c = y THEN 1.0 ELSE 0.0 END) AS accuracy, avg(abs(p - y)) AS probability_mae,
  CAST(count(*) FILTER (c = 0 AND y = 0) AS DOUBLE) AS tn, CAST(count(*) FILTER (c = 1 AND y = 0) AS DOUBLE) AS fp,
  CAST(count(*) FILTER (c = 0 AND y = 1) AS DOUBLE) AS fn, CAST(count(*) FILTER (c = 1 AND y = 1) AS DOUBLE) AS tp FROM c GROUP BY 1),
im AS (SELECT source_folder, CAST(count(DISTINCT image_key) AS DOUBLE) AS image_num, CAST(sum(w) AS DOUBLE) AS cell_num, avg(p) AS pred_ratio, sum(p * w) / sum(w) AS pred_ratio_weighted,
  avg(t) AS true_ratio, sum(t * w) / sum(wv) AS true_ratio_weighted, avg(abs(e)) AS image_mae, avg(e) AS image_bias, sqrt(avg(e * e)) AS image_rmse,
  avg(CASE WHEN e IS NOT NULL THEN CASE WHEN abs(e) <= 0.1 THEN 1.0 ELSE 0.0 END END) AS within_10pp, abs(avg(pv) - avg(t)) AS abs_error,
  abs(sum(pv * w) / sum(wv) - sum(t * w) / sum(wv)) AS abs_error_weighted, 1 - abs(avg(pv) - avg(t)) AS ratio_accuracy,
  1 - abs(sum(pv * w) / sum(wv) - sum(t * w) / sum(wv)) AS ratio_accuracy_weighted FROM v GROUP BY 1)
SELECT source_folder, source_folder AS folder, 'cell' AS level, metric, round(value, 6) AS value FROM cm UNPIVOT INCLUDE NULLS (value FOR metric IN ({_CELL_METRICS}))
UNION ALL SELECT source_folder, source_folder, 'image', metric, round(value, 6) FROM im UNPIVOT INCLUDE NULLS (value FOR metric IN ({_IMAGE_METRICS}))"""))
def _(spark, sf):
    from registry.q_quality import image_predictions

    out = sinks.prediction_summary(s.cells(spark, sf), image_predictions(spark, sf), 0.3)
    return out.withColumn("value", nround("value", 6))
