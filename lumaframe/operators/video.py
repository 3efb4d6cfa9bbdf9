"""Frames in time: selection, durations, metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import InvalidParameter


def get_frame(frames: DataFrame, index: int) -> DataFrame:
    return frames.filter(F.col("index") == index)


def get_range(frames: DataFrame, start: int, end: int) -> DataFrame:
    if end < start:
        raise InvalidParameter("the range ends before it starts")
    return frames.filter((F.col("index") >= start) & (F.col("index") < end))


def seek_to_time(frames: DataFrame, seconds: float, fps: float) -> DataFrame:
    return get_frame(frames, int(seconds * fps + 0.5))


def seek_keyframe(frames: DataFrame, index: int) -> DataFrame:
    """The last key frame at or before ``index`` in each video."""
    best = frames.filter((F.col("index") <= index) & F.col("is_keyframe")).groupBy("video_id").agg(F.max("index").alias("index"))
    return frames.join(best, ["video_id", "index"], "left_semi")


def play(frames: DataFrame, loops: int = 1) -> DataFrame:
    """Frames ``loops`` times over, with their place in ``position``."""
    n = frames.groupBy("video_id").agg(F.count("*").alias("n"))
    return frames.join(n, "video_id").withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(loops - 1)))).withColumn("position", F.col("round") * F.col("n") + F.col("index")).drop("n", "round")


def total_duration(frames: DataFrame, fps: float = 30.0) -> DataFrame:
    """(video_id, duration_us); a frame without a duration lasts 1/fps."""
    us = F.when(F.col("duration_us") == 0, F.lit(int(1_000_000 / fps))).otherwise(F.col("duration_us"))
    return frames.groupBy("video_id").agg(F.sum(us).alias("duration_us"))


def metadata(frames: DataFrame) -> DataFrame:
    """(video_id, width, height, frame_count, duration_us, fps, aspect_ratio)."""
    m = frames.groupBy("video_id").agg(F.max("w").alias("width"), F.max("h").alias("height"), F.count("*").alias("frame_count"), F.sum("duration_us").alias("duration_us"))
    return m.withColumns({"fps": F.coalesce(F.try_divide(F.col("frame_count") * 1e6, F.col("duration_us")), F.lit(30.0)), "aspect_ratio": F.coalesce(F.try_divide(F.col("width").cast("double"), F.col("height").cast("double")), F.lit(0.0))})


def synthetic_metadata(spark: SparkSession, width: int, height: int, fps: float, frame_count: int) -> DataFrame:
    """Metadata of a video that no file holds."""
    seen = spark.range(1).select(F.lit(width).alias("width"), F.lit(height).alias("height"), F.lit(frame_count).cast("long").alias("frame_count"))
    return seen.withColumns({"duration_us": F.round(F.lit(frame_count * 1e6 / fps)).cast("long"), "fps": F.lit(float(fps)), "aspect_ratio": F.lit(width / height if height else 0.0)})


def stream_count(streams: Column, kind: str) -> Column:
    """Streams of a kind in an array of structs with a field ``kind``."""
    return F.size(F.filter(streams, lambda s: s["kind"] == kind))


def to_batch(frames: DataFrame, size: int = 16) -> DataFrame:
    """(video_id, part, n, batch): the data of ``size`` frames in a row, one array a frame."""
    if size < 1:
        raise InvalidParameter("a batch holds a frame at least")
    batch = frames.groupBy("video_id", F.floor(F.col("index") / size).alias("part")).agg(F.array_sort(F.collect_list(F.struct("index", "data"))).alias("b"))
    return batch.select("video_id", "part", F.size("b").alias("n"), F.transform("b", lambda x: x["data"]).alias("batch"))
