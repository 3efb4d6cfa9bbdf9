"""Image, sequence, animation and weight sources, and their sinks.

Files are read through Spark's binary source, so any store Spark reads will do;
writers run on the executors, one file a row or video.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import FRAME, IMAGE, DimensionMismatch, InvalidParameter, UnsupportedFormat
from . import codecs
from .files import Whole, written

IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "bmp", "tiff", "webp")
# Container formats by file suffix.
CONTAINERS = {"gif": "Gif", "png": "Png", "apng": "Png", "jpg": "Jpeg", "jpeg": "Jpeg", "webp": "WebP", "qoi": "Qoi", "avi": "Avi", "mp4": "Mp4", "mov": "Mp4", "mkv": "Mkv", "webm": "Webm"}
OUTPUTS = {"gif": "Gif", "png": "PngSequence", "jpg": "JpegSequence", "jpeg": "JpegSequence", "qoi": "QoiSequence"}
PIXEL_CHANNELS = {"Rgb8": 3, "Rgba8": 4, "Gray8": 1, "Rgb16": 3, "Rgba16": 4, "Rgb32F": 3, "Rgba32F": 4}


def _by_suffix(path: Column, names: dict[str, str], other: str) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.lit(other)
    for k, v in names.items():
        out = F.when(suffix == k, F.lit(v)).otherwise(out)
    return out


def container_format(path: Column) -> Column:
    return _by_suffix(path, CONTAINERS, "Unknown")


def output_format(path: Column) -> Column:
    return _by_suffix(path, OUTPUTS, "PngSequence")


def pixel_channels(pixel_format: Column) -> Column:
    out = F.lit(None).cast("int")
    for k, v in PIXEL_CHANNELS.items():
        out = F.when(pixel_format == k, F.lit(v)).otherwise(out)
    return out


#: Tasks a core that read a folder of files, at most: Spark deals 32 small files to a task, which costs more than their reading.
READERS = 4
#: Bytes of pixels and of a file up to which a PNG is decoded beside its reading, where Spark's image source would take longer to open it.
SMALL, SMALL_FILE = 8192, 65536


def files_of(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """The files of a folder as Spark's binary source gives them, in a bounded number of tasks."""
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path).coalesce(READERS * max(1, spark.sparkContext.defaultParallelism))


def _small_png() -> Column:
    """Whether ``content`` is a small PNG that :func:`.codecs.read_png` knows."""
    at = lambda k, n=1: F.substring("content", k, n)
    number = lambda k: F.conv(F.hex(at(k, 4)), 16, 10).cast("double")
    head = (at(1, 8) == F.lit(b"\x89PNG\r\n\x1a\n")) & (at(13, 4) == F.lit(b"IHDR")) & (at(25) == F.lit(b"\x08")) & at(26).isin(*(F.lit(bytes([k])) for k in (0, 2, 3, 4, 6))) & (at(29) == F.lit(b"\0"))
    return F.coalesce((F.col("length") <= SMALL_FILE) & head & (number(17) * number(21) * 4 <= SMALL), F.lit(False))


def _read_small(files: DataFrame) -> DataFrame:
    """:func:`read_images` of small PNGs; files that can't be decoded are left out."""

    @F.pandas_udf(IMAGE)
    def decode(content: pd.Series) -> pd.DataFrame:
        out: list[np.ndarray | None] = []
        for data in content:
            try:
                out.append(codecs.read_png(data))
            except Exception:  # of any kind: the file is not whole
                out.append(None)
        shapes = [a.shape if a is not None else (None, None, None) for a in out]
        return pd.DataFrame({"c": [t[0] for t in shapes], "h": [t[1] for t in shapes], "w": [t[2] for t in shapes], "data": [a.ravel() if a is not None else None for a in out]})

    path = F.regexp_replace("path", "^file:/+", "file:///")  # as the image source tells it
    done = files.select(path.alias("path"), decode("content").alias("i")).filter("i.data IS NOT NULL")
    return done.select("path", F.xxhash64("path").alias("image_id"), "i.*")


def read_images(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, image_id, c, h, w, data) of PNG, JPEG, BMP and GIF stills, always as RGB, in order of their paths' hash.

    Spark's image source decodes them, unless all are small PNGs.
    """
    files = files_of(spark, path, pattern)
    if not files.filter(~_small_png()).limit(1).count():
        return _read_small(files)
    reader = spark.read.format("image").option("dropInvalid", True)
    df = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path).select("image.*")

    @F.pandas_udf(IMAGE)
    def planar(h: pd.Series, w: pd.Series, k: pd.Series, data: pd.Series) -> pd.DataFrame:
        out = []
        for a, b, c, d in zip(h, w, k, data, strict=True):
            bgr = np.frombuffer(d, np.uint8).reshape(a, b, c)
            rgb = np.repeat(bgr, 3, 2) if c == 1 else bgr[..., 2::-1]
            out.append(codecs.from_rgb8(rgb))
        return pd.DataFrame({"c": 3, "h": h, "w": w, "data": [a.ravel() for a in out]})

    done = df.select(F.col("origin").alias("path"), F.xxhash64("origin").alias("image_id"), planar("height", "width", "nChannels", "data").alias("i"))
    return done.select("path", "image_id", "i.*")


def read_image_sequence(spark: SparkSession, path: str, pattern: str = "", fps: float = 30.0, video_id: int = 0) -> DataFrame:
    """A folder's images whose names hold ``pattern`` as frames, in order of their paths.

    Paths are numbered by a range partition: a path's place in its partition after what the partitions before hold. The images are decoded where they are read.
    """
    glob = "*.{" + ",".join(IMAGE_SUFFIXES) + "}"
    paths = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path").filter(F.element_at(F.split("path", "/"), -1).contains(pattern))
    placed = paths.repartitionByRange("path").sortWithinPartitions("path").select(_plain(F.col("path")).alias("place"), F.monotonically_increasing_id().alias("row"))
    placed = written(placed.withColumn("pid", F.shiftright("row", 33)), "paths")
    sizes = placed.groupBy("pid").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    sizes = sizes.select("pid", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = placed.join(sizes, "pid").select("place", (F.col("row") - F.col("first") + F.col("before")).alias("index"))
    return _framed(read_images(spark, path, glob).withColumn("place", _plain(F.col("path"))).join(numbered, "place"), fps, video_id)


def _plain(path: Column) -> Column:
    """A local file has one slash after its scheme or three."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def _framed(df: DataFrame, fps: float, video_id: int) -> DataFrame:
    us = 1_000_000 / fps
    return df.select(F.lit(video_id).cast("long").alias("video_id"), "index", F.floor(F.col("index") * us).cast("long").alias("pts_us"), F.lit(int(us)).cast("long").alias("duration_us"), (F.col("index") % 30 == 0).alias("is_keyframe"), "c", "h", "w", "data")


#: Numbers of frames that are given on together, but for the last frame's.
HELD = 1 << 18


def read_animation(spark: SparkSession, path: str, max_frames: int = 0) -> DataFrame:
    """Frames of GIF and APNG animations, one video a file; other files are one still. Start times add up the delays."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            held, size = [], 0
            for name, video, content in zip(pdf["path"], pdf["video_id"], pdf["content"], strict=True):
                frames = codecs.read_gif(content) if content[:3] == b"GIF" else [(codecs.read_qoi(content), 0)] if content[:4] == b"qoif" else codecs.read_apng(content)
                frames = frames[: max_frames or None]
                if not frames:
                    raise UnsupportedFormat(f"no frames in {name}")
                start = 0
                for i, (a, delay) in enumerate(frames):
                    held.append((video, i, start * 1000, delay * 1000, i % 30 == 0, 3, a.shape[1], a.shape[2], a.ravel()))
                    start, size = start + delay, size + a.size
                    if size >= HELD:
                        yield framed(held)
                        held, size = [], 0
            if held:
                yield framed(held)

    def framed(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["video_id", "index", "pts_us", "duration_us", "is_keyframe", "c", "h", "w", "data"])

    files = files_of(spark, path).select("path", F.xxhash64("path").alias("video_id"), "content")
    return files.mapInPandas(run, FRAME)


def from_frames(spark: SparkSession, frames: list[np.ndarray], fps: float = 30.0, video_id: int = 0) -> DataFrame:
    rows = [(i, *a.shape, a.ravel().tolist()) for i, a in enumerate(frames)]
    return _framed(spark.createDataFrame(rows, T.StructType([T.StructField("index", T.LongType()), *IMAGE.fields])), fps, video_id)


def synthetic_video(spark: SparkSession, frames: int = 100, width: int = 640, height: int = 480, fps: float = 30.0) -> DataFrame:
    """Frame n of N: red rises to the right, green downwards, blue with n."""
    n = width * height
    plane = lambda f: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), f)
    x, y = (lambda i: (i % width) / width), (lambda i: F.floor(i / width) / height)
    df = spark.range(frames).select(F.col("id").alias("index"), F.lit(3).alias("c"), F.lit(height).alias("h"), F.lit(width).alias("w"), F.concat(plane(x), plane(y), F.array_repeat(F.col("id") / frames, n)).alias("data"))
    return _framed(df, fps, 0)


def capture(spark: SparkSession) -> DataFrame:
    """A camera's stand-in: one mid-gray RGB frame of 640 x 480."""
    return spark.range(1).select(F.col("id").alias("image_id"), F.lit(3).alias("c"), F.lit(480).alias("h"), F.lit(640).alias("w"), F.array_repeat(F.lit(0.5), 3 * 480 * 640).alias("data"))


# --- weights --------------------------------------------------------------------------

WEIGHTS = "name string, shape array<int>, data array<float>"
# Safetensors types as NumPy reads them.
DTYPES = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "i1", "U8": "u1", "BOOL": "?"}


def parse_safetensors(data: bytes) -> list[tuple[str, list[int], np.ndarray]]:
    (n,) = struct.unpack("<Q", data[:8])
    out = []
    for name, t in json.loads(data[8 : 8 + n]).items():
        if name != "__metadata__":
            a, b = t["data_offsets"]
            raw = data[8 + n + a : 8 + n + b]
            flat = (np.frombuffer(raw, "<u2").astype("<u4") << 16).view("<f4") if t["dtype"] == "BF16" else np.frombuffer(raw, DTYPES[t["dtype"]])
            out.append((name, t["shape"], flat.astype(np.float32)))
    return out


def read_safetensors(spark: SparkSession, path: str) -> DataFrame:
    """(name, shape, data) of every tensor, by its own type and rank."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for content in pdf["content"]:
                got = parse_safetensors(content)
                yield pd.DataFrame({"name": [g[0] for g in got], "shape": [g[1] for g in got], "data": [g[2] for g in got]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, WEIGHTS)


def read_bin(spark: SparkSession, path: str, rows: int, cols: int) -> DataFrame:
    """A flat float file as one (rows, cols) tensor: padded with 0, or cut off."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                flat = np.zeros(rows * cols, np.float32)
                got = np.frombuffer(content[: len(content) // 4 * 4], "<f4")[: rows * cols]
                flat[: len(got)] = got
                yield pd.DataFrame({"name": [name], "shape": [[rows, cols]], "data": [flat]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, WEIGHTS)


# --- sinks ------------------------------------------------------------------------------

WRITERS = {"png": codecs.write_png, "qoi": codecs.write_qoi, "gif": lambda a: codecs.write_gif([a], [0])}


def encode(images: DataFrame, kind: str = "png", out: str = "content") -> DataFrame:
    """``images`` with each one's file in ``out``."""
    if kind not in WRITERS:
        raise UnsupportedFormat(f"no encoder for {kind!r}")
    write = WRITERS[kind]

    @F.pandas_udf(T.BinaryType())
    def run(c: pd.Series, h: pd.Series, w: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([write(np.asarray(d, float).reshape(int(a), int(b), int(e))) for a, b, e, d in zip(c, h, w, data, strict=True)])

    return images.withColumn(out, run("c", "h", "w", "data"))


def save_images(images: DataFrame, folder: str, kind: str = "png") -> None:
    """One file an image, ``{image_id}.{kind}``, in a folder that all executors share (a path or a URI)."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for i, content in zip(pdf["image_id"], pdf["content"], strict=True):
                with Whole(folder, f"{i}.{kind}") as f:
                    f.write(content)
            yield pd.DataFrame({"n": [len(pdf)]})

    encode(images, kind).select("image_id", "content").mapInPandas(run, "n long").agg(F.sum("n")).collect()


def write_video(frames: DataFrame, path: str, fps: float = 30.0, loops: int = 0) -> None:
    """An animation (``.gif``, delays by the frames' durations), or one file a frame: ``{stem}_{index:06}``.

    An animation's frames are sorted by Spark and streamed into its file; single frames are written side by side.
    """
    folder, name = path.rsplit("/", 1) if "/" in path else (".", path)
    stem, kind = name.rsplit(".", 1)[0], name.rsplit(".", 1)[-1].lower()
    sizes = frames.select("h", "w").distinct().limit(2).collect()
    if not sizes:
        raise InvalidParameter("no frames")
    if len(sizes) > 1:
        raise DimensionMismatch("frames differ in size")
    if kind not in WRITERS:
        raise UnsupportedFormat(f"no encoder for {kind!r}")

    def rows(pdfs: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for pdf in pdfs:
            for c, h, w, data, *rest in zip(pdf["c"], pdf["h"], pdf["w"], pdf["data"], pdf["video_id"], pdf["index"], pdf["duration_us"], strict=True):
                yield np.asarray(data, float).reshape(int(c), int(h), int(w)), *rest

    def animate(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, mine in groupby(rows(pdfs), key=lambda r: r[1]):
            n = 0
            with Whole(folder, name) as f:
                for array, _, _, us in mine:
                    f.write((b"" if n else codecs.gif_head(array, loops)) + codecs.gif_frame(array, int(us // 1000) or round(1000 / fps)))
                    n += 1
                f.write(codecs.GIF_END)
            yield pd.DataFrame({"n": [n]})

    def single(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for array, _, i, _ in rows(pdfs):
            with Whole(folder, f"{stem}_{i:06}.{kind}") as f:
                f.write(WRITERS[kind](array))
            yield pd.DataFrame({"n": [1]})

    told = frames.select("video_id", "index", "duration_us", "c", "h", "w", "data")
    if kind == "gif":
        told = told.repartition("video_id").sortWithinPartitions("video_id", "index")
    told.mapInPandas(animate if kind == "gif" else single, "n long").agg(F.sum("n")).collect()
