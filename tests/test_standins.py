"""Stand-in tables: sizes that Spark can see, parts that grow with the input."""

import re

import pytest

from petridish.functions import polygons
from petridish.operators import fluorescence
from petridish.sources import images
from registry import standins as s


@pytest.fixture
def parts(spark, tmp_path):
    spark.range(0, 400, 1, 1).selectExpr("id as p_partkey", "cast(1 + id % 50 as int) as p_size").write.parquet(
        str(tmp_path / "part.parquet")
    )
    return str(tmp_path)


def estimate(df):
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def test_pixel_tables_are_not_taken_for_small_ones(spark, parts):
    for df in (s.pixels(spark, parts), s.label_pixels(spark, parts)):
        assert estimate(df) >= 12 * df.count()
    plan = s.label_pixels(spark, parts).join(s.pixels(spark, parts), ["image_id", "x", "y"])
    plan = plan._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_pixel_tables_are_whole(spark, parts):
    assert s.pixels(spark, parts).distinct().count() == s.pixels(spark, parts).count() == 100 * 1024
    cells = s.geometry(spark, parts)
    want = set()
    for g in cells.collect():
        sides = [("cyto", g["cx"], g["cy"], g["rc"], g["has_cyto"]), ("nuc", g["nx"], g["ny"], g["rn"], g["has_nuc"])]
        for region, cx, cy, r, on in sides:
            for x in range(32):
                for y in range(32):
                    if on and (x - cx) ** 2 + (y - cy) ** 2 <= r * r:
                        want.add((g["image_id"], region, g["roi_id"], x, y))
    got = [tuple(r) for r in s.label_pixels(spark, parts).drop("dataset").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_parts_grow_with_the_input(spark, parts, monkeypatch):
    monkeypatch.setattr(s, "PART_CELLS", 16)
    assert s.geometry(spark, parts).rdd.getNumPartitions() == 25


def test_pixel_arrays_are_made_once(spark, parts):
    made = images.explode_pixels(s.images(spark, parts), ["image_id"])
    assert made._jdf.queryExecution().optimizedPlan().toString().count("transform(") == 1
    assert made.count() == 100 * 1024


def test_images_without_pixels_give_no_rows(spark):
    rows = [(1, 2, [10, None, 30, 40]), (2, 2, []), (3, 2, None)]
    df = spark.createDataFrame(rows, "id int, width int, data array<int>")
    found = [tuple(r) for r in images.explode_pixels(df, ["id"], depth=10).collect()]
    assert sorted(found, key=lambda r: r[1:3]) == [(1, 0, 0, 1.0), (1, 0, 1, 3.0), (1, 1, 0, None), (1, 1, 1, 4.0)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pixels_of_polygons_are_not_broadcast(spark, parts):
    shapes = s.outlines(spark, parts).select("image_id", "roi_id", "cyto").filter("cyto is not null")
    filled = polygons.rasterize(shapes, "cyto", s.WIDTH, s.HEIGHT)
    joined = filled.join(s.pixels(spark, parts).drop("dataset"), ["image_id", "x", "y"])
    assert "BroadcastHashJoin" not in _plan(joined) and "SortMergeJoin" in _plan(joined)
    both = s.outlines(spark, parts).drop("dataset").filter("nuc is not null and cyto is not null")
    rings = fluorescence.fluor_rings(both, s.pixels(spark, parts).drop("dataset"), ["image_id"], s.WIDTH, s.HEIGHT, 2)
    joins = re.findall(r"(\w+Join) \[image_id#\d+L, x#\d+, y#\d+\]", _plan(rings))
    assert set(joins) == {"SortMergeJoin"}
