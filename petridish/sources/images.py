"""Image files, pixel rows and masks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from petridish.functions.text import file_extension, file_stem, natural_sort_key

# Extensions of image files, and words that mark non-phase exports.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".tif", ".tiff", ".bmp")
NOT_PHASE = ("ki67", "df")


def scan_files(
    spark: SparkSession, folder: str, extensions: Sequence[str] = IMAGE_EXTENSIONS
) -> DataFrame:
    """Files below ``folder`` with one of the extensions, with a natural sort key.

    Only the listing columns are read; Spark prunes the file contents.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select("path", "length")
    )
    return (
        files.withColumn("extension", file_extension("path"))
        .filter(F.col("extension").isin(*[e.lower() for e in extensions]))
        .withColumn("stem", file_stem("path"))
        .withColumn("sort_key", natural_sort_key("stem"))
    )


def scan_images(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded images through Spark's image source: ``path, width, height, channels, data``."""
    return (
        spark.read.format("image")
        .option("recursiveFileLookup", "true")
        .option("dropInvalid", "true")
        .load(folder)
        .select(
            F.col("image.origin").alias("path"),
            F.col("image.width").alias("width"),
            F.col("image.height").alias("height"),
            F.col("image.nChannels").alias("channels"),
            F.col("image.data").alias("data"),
        )
    )


def phase_only(files: DataFrame, stem: str = "stem", words: Sequence[str] = NOT_PHASE) -> DataFrame:
    """Leave out files whose stem names another channel."""
    lowered = F.lower(F.col(stem))
    for word in words:
        files = files.filter(~lowered.contains(word.lower()))
    return files


def explode_pixels(
    images: DataFrame, keys: Sequence[str], data: str = "data", depth: int = 255
) -> DataFrame:
    """Pixel rows ``keys, x, y, v`` from an array column; ``v`` is scaled by the type's maximum.

    The outer form, because Spark puts a filter on the array's size below every other one, where it
    makes the arrays a second time before the images are spread. Images without pixels give no rows.
    """
    return images.select(
        *keys, "width", F.posexplode_outer(data).alias("_i", "_v")
    ).filter("_i is not null").select(
        *keys,
        (F.col("_i") % F.col("width")).cast("int").alias("x"),
        F.expr("cast(_i div width as int)").alias("y"),
        (F.col("_v") / float(depth)).alias("v"),
    )


# Sample types by their bytes, and the value that counts as 1 (floats stay).
SAMPLES = {1: ("<u1", 255.0), 2: ("<u2", 65535.0), 4: ("<f4", 1.0)}
PIXEL_ROWS = 1 << 16


def decode_pixels(images: DataFrame) -> DataFrame:
    """Pixel rows ``path, x, y, v, b, g, r`` from decoded image bytes.

    ``images(path, width, height, data)`` with samples of 8 or 16 bits or 32-bit floats, told by
    the length of the data for the ``channels`` (a column; 1 if absent, or 3 or 4 for 8-bit data
    of that length). ``v`` is the gray value in [0, 1] (Rec. 601 weights for colour; alpha is
    dropped), the other three are the raw channels. Rows leave in batches of many lines.
    """

    def pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                size = row["width"] * row["height"]
                if not size or not row["data"]:
                    continue
                samples = len(row["data"]) // size
                channels = row["channels"] or (samples if samples in (3, 4) else 1)
                kind, full = SAMPLES[samples // channels]
                flat = np.frombuffer(row["data"], kind).reshape(size, channels).astype("float64")
                b, g, r = flat[:, :3].T if channels >= 3 else (flat[:, 0],) * 3
                gray = 0.114 * b + 0.587 * g + 0.299 * r if channels >= 3 else flat[:, 0]
                place = np.arange(size, dtype="int32")
                for at in range(0, size, PIXEL_ROWS):
                    part = slice(at, at + PIXEL_ROWS)
                    n = place[part].size
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.repeat(pa.scalar(row["path"], pa.string()), n),
                            pa.array(place[part] % row["width"]),
                            pa.array(place[part] // row["width"]),
                            *[pa.array(x[part]) for x in (gray / full, b, g, r)],
                        ],
                        names=["path", "x", "y", "v", "b", "g", "r"],
                    )

    channels = F.col("channels") if "channels" in images.columns else F.lit(None)
    return images.select(
        "path", "width", "height", "data", channels.cast("int").alias("channels")
    ).mapInArrow(pixels, "path string, x int, y int, v double, b double, g double, r double")


def mask_pixels(pixels: DataFrame, value: Column | str = "v") -> DataFrame:
    """Pixels of a binary mask: every value above zero."""
    return pixels.filter((F.col(value) if isinstance(value, str) else value) > 0).drop("v")
