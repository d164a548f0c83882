"""Stand-in tables: the given tables seen as images, masks, outlines and cell tables.

The given tables hold no images, so pixels, label masks, outlines and cell rows are derived
from them by fixed integer formulas. Each Spark view has a DuckDB twin in ``VIEW_SQL``.
Four ``part`` rows make one 32 x 32 image with up to four cells.

Every query reads its tables whole. Remainders of ids only shape the derived values: they
place cells, vary names and blank single fields so that the missing-value paths are used.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = HEIGHT = 32
#: cells (four to an image of 1024 pixels) in one part of the expanded tables
PART_CELLS = 2048
#: largest radius of a cell: 4 + p_size % 4
LARGEST = 7
# image key of a vector; those with label 3 belong to no image, so that some images have none
VECTOR_KEY = (
    "'folder_' || (vec_id % 12) || '::img_' || vec_id || CASE WHEN label = 3 THEN '_other' ELSE '' END"
)
STATUS_BY_EVENT = {
    "view": "full_cell",
    "click": "nuc_only",
    "signup": "cyto_cut",
    "purchase": "nuc_cut",
    "error": "unknown",
}


def by_image(query):
    """The query in a session of its own, with the caller's settings, whose joins keep rows dealt by image where they are.

    `geometry` deals the images out before they are expanded. Joins on image and pixel are planned on
    that: pixels are not written to disk to meet the labels of their own image.
    """

    @functools.wraps(query)
    def planned(spark: SparkSession, sf: str) -> DataFrame:
        own = spark.newSession()
        for key, value in spark.conf.getAll.items():
            if key.startswith("spark.sql.") and own.conf.isModifiable(key):
                own.conf.set(key, value)
        own.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        return query(own, sf)

    return planned


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def grid(spark, low: int, high: int) -> DataFrame:
    """``gx, gy`` of the square from ``low`` to ``high``, small enough for every task.

    Pixels come from a join with it, not from ``explode``: Spark's size estimate leaves out the
    rows that an ``explode`` makes, so that a join would broadcast whole pixel tables.
    """
    n = high - low + 1
    square = spark.range(0, n * n, 1, 1).select(
        F.expr(f"cast(id % {n} + {low} as int)").alias("gx"), F.expr(f"cast(id div {n} + {low} as int)").alias("gy")
    )
    return F.broadcast(square)


def geometry(spark, sf) -> DataFrame:
    """One row per cell: disc centre and radius of the cell and of its nucleus."""
    p = table(spark, sf, "part").select("p_partkey", "p_size")
    image = F.expr("p_partkey div 4")
    p = p.select(
        image.alias("image_id"),
        (F.col("p_partkey") % 4 + 1).cast("int").alias("roi_id"),
        "p_partkey",
        "p_size",
    ).withColumn("dataset", F.concat(F.lit("set_"), F.col("image_id") % 10))
    p = p.withColumn(
        "cx", F.expr("cast(8 + 16 * ((roi_id - 1) % 2) + image_id % 5 - 2 as int)")
    ).withColumn(
        "cy",
        F.expr("cast(8 + 16 * ((roi_id - 1) div 2) + (image_id div 5) % 5 - 2 as int)"),
    )
    # the given file is one small split: spread the images before they are expanded, into as many
    # parts as keep the pixels of one part, and so the memory of its task, bounded
    parts = max(spark.sparkContext.defaultParallelism, -(-p.count() // PART_CELLS))
    p = p.repartition(parts, "image_id")
    return p.select(
        "dataset",
        "image_id",
        "roi_id",
        "p_partkey",
        "p_size",
        "cx",
        "cy",
        F.expr("4 + p_size % 4").alias("rc"),
        F.expr(
            "cast(cx + p_partkey % 3 - 1 + case when p_size % 7 = 0 then 4 + p_size % 4 else 0 end as int)"
        ).alias("nx"),
        F.expr("cast(cy + (p_partkey div 3) % 3 - 1 as int)").alias("ny"),
        F.expr("2 + p_size % 2").alias("rn"),
        F.expr("p_size % 13 <> 0").alias("has_cyto"),
        F.expr("p_size % 11 <> 0").alias("has_nuc"),
    )


GEOMETRY_SQL = """
g0 AS (SELECT p_partkey // 4 AS image_id, CAST(p_partkey % 4 + 1 AS INT) AS roi_id, p_partkey, p_size
       FROM part),
geom AS (SELECT 'set_' || (image_id % 10) AS dataset, image_id, roi_id, p_partkey, p_size,
  8 + 16 * ((roi_id - 1) % 2) + image_id % 5 - 2 AS cx,
  8 + 16 * ((roi_id - 1) // 2) + (image_id // 5) % 5 - 2 AS cy,
  4 + p_size % 4 AS rc,
  8 + 16 * ((roi_id - 1) % 2) + image_id % 5 - 2 + p_partkey % 3 - 1
    + CASE WHEN p_size % 7 = 0 THEN 4 + p_size % 4 ELSE 0 END AS nx,
  8 + 16 * ((roi_id - 1) // 2) + (image_id // 5) % 5 - 2 + (p_partkey // 3) % 3 - 1 AS ny,
  2 + p_size % 2 AS rn,
  p_size % 13 <> 0 AS has_cyto, p_size % 11 <> 0 AS has_nuc
  FROM g0)"""


def images(spark, sf) -> DataFrame:
    """One row per image with the pixel array of its phase channel, row by row."""
    return (
        geometry(spark, sf)
        .select("dataset", "image_id")
        .distinct()
        .withColumn("width", F.lit(WIDTH))
        .withColumn("height", F.lit(HEIGHT))
        .withColumn(
            "data",
            F.expr(
                "transform(sequence(0, 1023), i -> cast((image_id * 7 + 3 * (i % 32) * (i % 32)"
                " + 5 * (i div 32) * (i div 32) + 11 * (i % 32) * (i div 32)) % 256 as int))"
            ),
        )
    )


IMAGES_SQL = "imgs AS (SELECT DISTINCT dataset, image_id FROM geom)"
SIGNAL = {
    "phase": "(image_id * 7 + 3 * x * x + 5 * y * y + 11 * x * y) % 256",
    "ido": "(image_id * 13 + 5 * x + 3 * y + x * y) % 256",
    "ki67": "(image_id * 5 + 40 * ((x // 6 + y // 5 + image_id) % 5) + x * y % 7) % 256",
}


def pixels(spark, sf, channel: str = "phase") -> DataFrame:
    """``dataset, image_id, x, y, v`` of one channel."""
    return (
        geometry(spark, sf)
        .select("dataset", "image_id")
        .distinct()
        .crossJoin(grid(spark, 0, WIDTH - 1).toDF("x", "y"))
        .select(
            "dataset",
            "image_id",
            "x",
            "y",
            F.expr(SIGNAL[channel].replace("//", "div")).cast("double").alias("v"),
        )
    )


def pixels_sql(channel: str = "phase", name: str = "px") -> str:
    value = re.sub(r"\bx\b", "gx.range", SIGNAL[channel])
    value = re.sub(r"\by\b", "gy.range", value)
    return (
        f"{name} AS (SELECT dataset, image_id, CAST(gx.range AS INT) AS x, CAST(gy.range AS INT) AS y,"
        f" CAST({value} AS DOUBLE) AS v FROM imgs, range(32) gx, range(32) gy)"
    )


def label_pixels(spark, sf) -> DataFrame:
    """``dataset, image_id, region, label, x, y`` for regions ``cyto`` (whole cell) and ``nuc``."""
    g = geometry(spark, sf)
    sides = g.select(
        "dataset",
        "image_id",
        F.explode(
            F.array(
                F.struct(
                    F.lit("cyto").alias("region"),
                    F.col("cx").alias("px"),
                    F.col("cy").alias("py"),
                    F.col("rc").alias("r"),
                    F.col("has_cyto").alias("on"),
                ),
                F.struct(
                    F.lit("nuc").alias("region"),
                    F.col("nx").alias("px"),
                    F.col("ny").alias("py"),
                    F.col("rn").alias("r"),
                    F.col("has_nuc").alias("on"),
                ),
            )
        ).alias("s"),
        F.col("roi_id").alias("label"),
    ).select("dataset", "image_id", "label", "s.*")
    return (
        sides.filter("on")
        .crossJoin(grid(spark, -LARGEST, LARGEST))
        .filter("gx * gx + gy * gy <= r * r")
        .withColumn("x", F.expr("px + gx"))
        .withColumn("y", F.expr("py + gy"))
        .filter(f"x between 0 and {WIDTH - 1} and y between 0 and {HEIGHT - 1}")
        .select("dataset", "image_id", "region", "label", "x", "y")
    )


LABELS_SQL = """
sides AS (SELECT dataset, image_id, 'cyto' AS region, roi_id AS label, cx AS px, cy AS py, rc AS r FROM geom WHERE has_cyto
  UNION ALL SELECT dataset, image_id, 'nuc', roi_id, nx, ny, rn FROM geom WHERE has_nuc),
lp AS (SELECT dataset, image_id, region, label, CAST(gx.range AS INT) AS x, CAST(gy.range AS INT) AS y
  FROM sides, range(32) gx, range(32) gy
  WHERE (gx.range - px) * (gx.range - px) + (gy.range - py) * (gy.range - py) <= r * r)"""


def _octagon(cx, cy, r, notch):
    a = f"({r} div 2)"
    points = [
        (f"{cx}+{r}", f"{cy}+{a}"),
        (f"{cx}+{a}", f"{cy}+{r}"),
        (f"{cx}", f"{cy}+case when {notch} then 1 else {r}+1 end"),
        (f"{cx}-{a}", f"{cy}+{r}"),
        (f"{cx}-{r}", f"{cy}+{a}"),
        (f"{cx}-{r}", f"{cy}-{a}"),
        (f"{cx}-{a}", f"{cy}-{r}"),
        (f"{cx}+{a}", f"{cy}-{r}"),
        (f"{cx}+{r}", f"{cy}-{a}"),
    ]
    return points


def _line_expr(cx, cy, r, on):
    parts = [c for p in _octagon(cx, cy, r, "p_partkey % 4 = 1") for c in p]
    joined = " || ',' || ".join(f"cast(cast({c} as int) as string)" for c in parts)
    return (
        f"case when not {on} then '-1,-1' when p_size % 17 = 0 then '3,4,x' else {joined} end"
    )


def outline_lines(spark, sf) -> DataFrame:
    """Merged outline text of each image: alternating nucleus and cell lines."""
    g = geometry(spark, sf).select(
        "dataset",
        "image_id",
        "roi_id",
        F.expr(_line_expr("nx", "ny", "rn", "has_nuc")).alias("nuc"),
        F.expr(_line_expr("cx", "cy", "rc", "has_cyto")).alias("cyto"),
    )
    # at most four cells per image
    return g.groupBy("dataset", "image_id").agg(
        F.expr(
            "concat_ws('\n', transform(sort_array(collect_list(struct(roi_id, nuc, cyto))),"
            " s -> s.nuc || '\n' || s.cyto))"
        ).alias("text")
    )


def outlines(spark, sf) -> DataFrame:
    """``dataset, image_id, roi_id, nuc, cyto`` with parsed polygons."""
    from petridish.sources.outlines import parse_outline_text

    return parse_outline_text(outline_lines(spark, sf))


def _line_sql(cx, cy, r, on):
    return (
        _line_expr(cx, cy, r, on)
        .replace(" div ", " // ")
        .replace("as string", "as varchar")
    )


OUTLINE_LINES_SQL = f"""
ol0 AS (SELECT dataset, image_id, roi_id, {_line_sql('nx', 'ny', 'rn', 'has_nuc')} AS nuc,
  {_line_sql('cx', 'cy', 'rc', 'has_cyto')} AS cyto FROM geom)"""
# one row per usable polygon vertex, region by region
VERTEX_SQL = (
    OUTLINE_LINES_SQL
    + """,
ol1 AS (SELECT dataset, image_id, roi_id, 'nuc' AS region, nuc AS line FROM ol0
  UNION ALL SELECT dataset, image_id, roi_id, 'cyto', cyto FROM ol0),
ol2 AS (SELECT dataset, image_id, roi_id, region, string_split(line, ',') AS tok FROM ol1
  WHERE line <> '-1,-1' AND line NOT LIKE '%x%'),
vert AS (SELECT dataset, image_id, roi_id, region, CAST(i.range AS INT) AS pos, CAST(len(tok) // 2 AS INT) AS n,
  CAST(tok[2 * i.range + 1] AS INT) AS x, CAST(tok[2 * i.range + 2] AS INT) AS y
  FROM ol2, range(16) i WHERE i.range < len(tok) // 2)"""
)


def cells(spark, sf) -> DataFrame:
    """A cell table from ``events``: one image per user, several folders of images."""
    e = table(spark, sf, "events")
    status = F.create_map(*[F.lit(v) for kv in STATUS_BY_EVENT.items() for v in kv])
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_id").alias("cell_id"),
        F.col("user_id").alias("image_id"),
        F.concat(F.lit("folder_"), F.col("user_id") % 12).alias("source_folder"),
        F.concat(F.lit("img_"), "user_id").alias("Image"),
        F.concat(
            F.lit("folder_"), F.col("user_id") % 12, F.lit("::img_"), F.col("user_id")
        ).alias("image_key"),
        F.concat(F.lit("P"), F.col("user_id") % 4).alias("passage"),
        status[F.col("event_type")].alias("cell_status"),
        F.col("value").alias("area"),
        (F.col("value") * (20 + F.expr("cast(get_json_object(props, '$.k') as int) % 30")) / 100).alias(
            "nuc_area"
        ),
        k.alias("k"),
        F.when(F.col("event_id") % 17 != 0, F.least(F.col("value") / 200, F.lit(1.0))).alias(
            "cell_prob"
        ),
        F.when(F.col("event_type").isin("purchase", "error"), 1).otherwise(0).alias("ki67_label"),
        F.element_at(
            F.array(F.lit("train"), F.lit("valid"), F.lit("test")),
            (F.col("user_id") % 3 + 1).cast("int"),
        ).alias("split"),
        ((F.col("event_id") * 7919) % 1000).cast("double").alias("x"),
        ((F.col("event_id") * 104729) % 1000).cast("double").alias("y"),
    )


CELLS_SQL = """
cells AS (SELECT event_id AS cell_id, user_id AS image_id, 'folder_' || (user_id % 12) AS source_folder,
  'img_' || user_id AS "Image", 'folder_' || (user_id % 12) || '::img_' || user_id AS image_key,
  'P' || (user_id % 4) AS passage,
  CASE event_type WHEN 'view' THEN 'full_cell' WHEN 'click' THEN 'nuc_only' WHEN 'signup' THEN 'cyto_cut'
    WHEN 'purchase' THEN 'nuc_cut' WHEN 'error' THEN 'unknown' END AS cell_status,
  value AS area,
  value * (20 + CAST(json_extract_string(props, '$.k') AS INT) % 30) / 100 AS nuc_area,
  CAST(json_extract_string(props, '$.k') AS INT) AS k,
  CASE WHEN event_id % 17 <> 0 THEN least(value / 200, 1.0) END AS cell_prob,
  CASE WHEN event_type IN ('purchase', 'error') THEN 1 ELSE 0 END AS ki67_label,
  CASE user_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'valid' ELSE 'test' END AS split,
  CAST((event_id * 7919) % 1000 AS DOUBLE) AS x, CAST((event_id * 104729) % 1000 AS DOUBLE) AS y
  FROM events)"""


def study_images(spark, sf) -> DataFrame:
    """Image-level dose study: one image per order, doses from its keys."""
    o = table(spark, sf, "orders")
    ifn = F.element_at(F.array(*map(F.lit, (0.0, 25.0, 50.0, 100.0))), (F.col("o_custkey") % 4 + 1).cast("int"))
    tnf = F.element_at(F.array(*map(F.lit, (0.0, 25.0, 50.0))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return o.select(
        F.concat(F.lit("img_"), "o_orderkey").alias("image_key"),
        F.col("o_orderkey").alias("image_index"),
        ifn.alias("IFN_dose"),
        tnf.alias("TNF_dose"),
        F.concat(
            F.lit("IFN"), ifn.cast("int"), F.lit("_TNF"), tnf.cast("int")
        ).alias("condition"),
        (F.col("o_totalprice") / 1000).alias("IDO_score"),
    )


STUDY_SQL = """
study AS (SELECT 'img_' || o_orderkey AS image_key, o_orderkey AS image_index,
  CAST([0, 25, 50, 100][o_custkey % 4 + 1] AS DOUBLE) AS "IFN_dose",
  CAST([0, 25, 50][o_orderkey % 3 + 1] AS DOUBLE) AS "TNF_dose",
  'IFN' || [0, 25, 50, 100][o_custkey % 4 + 1] || '_TNF' || [0, 25, 50][o_orderkey % 3 + 1] AS condition,
  o_totalprice / 1000 AS "IDO_score" FROM orders)"""


def study_cells(spark, sf) -> DataFrame:
    """Cells of the study images: one per order line, with a few morphology columns."""
    li = table(spark, sf, "lineitem")
    cells_ = li.select(
        F.concat(F.lit("img_"), "l_orderkey").alias("image_key"),
        F.col("l_quantity").alias("Area_nuc"),
        F.col("l_discount").alias("Extent_nuc"),
        F.when(F.col("l_partkey") % 19 != 0, F.col("l_tax")).alias("Solidity_cyto"),
        (F.col("l_extendedprice") / 100).alias("IDO_cell"),
    )
    return cells_.join(study_images(spark, sf).drop("IDO_score"), "image_key").withColumnRenamed(
        "IDO_cell", "IDO_score"
    )


STUDY_CELLS_SQL = (
    STUDY_SQL
    + """,
scells AS (SELECT s.image_key, s.image_index, s."IFN_dose", s."TNF_dose", s.condition, l_quantity AS "Area_nuc",
  l_discount AS "Extent_nuc", CASE WHEN l_partkey % 19 <> 0 THEN l_tax END AS "Solidity_cyto",
  l_extendedprice / 100 AS "IDO_score"
  FROM lineitem JOIN study s ON s.image_index = l_orderkey)"""
)


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + body
