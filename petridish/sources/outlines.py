"""Merged outline text: alternating nucleus and cell polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from petridish.functions.numeric import compute_once
from petridish.functions.text import file_stem


def polygon_of(line: Column) -> Column:
    """``x1,y1,x2,y2,…`` to an array of points; NULL when missing, malformed or too short."""
    shape = r"^\s*[+-]?\d+\s*(,\s*[+-]?\d+\s*)+$"
    numbers = F.transform(F.split(line, ","), lambda t: F.trim(t).try_cast("int"))
    points = F.zip_with(
        F.filter(numbers, lambda n, i: i % 2 == 0),
        F.filter(numbers, lambda n, i: i % 2 == 1),
        lambda x, y: F.struct(x.alias("x"), y.alias("y")),
    )
    commas = F.length(line) - F.length(F.replace(line, F.lit(","), F.lit("")))
    usable = line.rlike(shape) & (commas >= 5) & (commas % 2 == 1)
    return F.when(usable, points)


def parse_outline_text(texts: DataFrame, text: str = "text") -> DataFrame:
    """One row per outline pair: ``roi_id`` (1-based), ``nuc`` and ``cyto`` polygons.

    Blank lines are dropped before lines are paired; an odd last line has no partner and is
    dropped; a pair with neither side is dropped. One text is one image, so it fits a row.
    """
    lines = F.filter(
        F.transform(F.split(F.col(text), r"\r?\n"), lambda s: F.trim(s)), lambda s: s != ""
    )
    others = [c for c in texts.columns if c != text]
    pairs = compute_once(texts, _lines=lines).filter(F.size("_lines") >= 2).withColumn(
        "_i", F.explode(F.expr("sequence(0, cast(size(_lines) div 2 as int) - 1)"))
    )
    pairs = compute_once(
        pairs,
        nuc=polygon_of(F.expr("_lines[2 * _i]")),
        cyto=polygon_of(F.expr("_lines[2 * _i + 1]")),
    ).select(*others, (F.col("_i") + 1).cast("int").alias("roi_id"), "nuc", "cyto")
    return pairs.filter(F.col("nuc").isNotNull() | F.col("cyto").isNotNull())


def scan_outlines(spark: SparkSession, folder: str) -> DataFrame:
    """Outline pairs of every ``*_merged_cp_outlines.txt`` below a folder."""
    texts = (
        spark.read.option("wholetext", "true")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*_merged_cp_outlines.txt")
        .text(folder)
        .select(
            F.regexp_replace(
                file_stem("_metadata.file_path"), "_merged_cp_outlines$", ""
            ).alias("image"),
            F.col("value").alias("text"),
        )
    )
    return parse_outline_text(texts)


def paired_only(outlines: DataFrame) -> DataFrame:
    """Pairs with both sides."""
    return outlines.filter(F.col("nuc").isNotNull() & F.col("cyto").isNotNull())
