"""Data model: images as rows, pixels as a relation, errors.

ROW: ``image_id long, c int, h int, w int, data array<double>``, planar (channel, row, column).
PX: ``image_id long, ch int, y int, x int, v double``.
Frames add ``index``, ``pts_us``, ``duration_us`` and ``is_keyframe`` to ROW.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ImageError(ValueError):
    """Base of all errors of the library."""


class DimensionMismatch(ImageError):
    pass


class InvalidParameter(ImageError):
    pass


class ModelNotProvided(ImageError):
    """An operator that needs a trained model was called without one."""


class UnsupportedFormat(ImageError):
    pass


IMAGE = T.StructType([T.StructField("c", T.IntegerType()), T.StructField("h", T.IntegerType()), T.StructField("w", T.IntegerType()), T.StructField("data", T.ArrayType(T.DoubleType()))])
ROW = T.StructType([T.StructField("image_id", T.LongType()), *IMAGE.fields])
FRAME = T.StructType([T.StructField("video_id", T.LongType()), T.StructField("index", T.LongType()), T.StructField("pts_us", T.LongType()), T.StructField("duration_us", T.LongType()), T.StructField("is_keyframe", T.BooleanType()), *IMAGE.fields])
POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
RECT = T.StructType([T.StructField(k, T.LongType()) for k in ("x", "y", "width", "height")])
KEYPOINT = T.StructType([T.StructField(k, T.DoubleType()) for k in ("x", "y", "size", "angle", "response")] + [T.StructField("octave", T.IntegerType()), T.StructField("class_id", T.IntegerType())])


def to_pixels(images: DataFrame, *keep: str) -> DataFrame:
    """ROW to PX; no shuffle. ``keep`` names further columns to carry."""
    flat = images.select("image_id", *keep, "h", "w", F.posexplode("data").alias("i", "v"))
    plane = F.col("h") * F.col("w")
    return flat.select("image_id", *keep, (F.col("i") / plane).cast("int").alias("ch"), ((F.col("i") % plane) / F.col("w")).cast("int").alias("y"), (F.col("i") % F.col("w")).cast("int").alias("x"), F.col("v").cast("double").alias("v"))


def to_images(pixels: DataFrame) -> DataFrame:
    """PX to ROW: one shuffle on the image."""
    rows = pixels.groupBy("image_id").agg((F.max("ch") + 1).alias("c"), (F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"), F.array_sort(F.collect_list(F.struct("ch", "y", "x", "v"))).alias("p"))
    return rows.select("image_id", "c", "h", "w", F.transform("p", lambda p: p["v"]).alias("data"))
