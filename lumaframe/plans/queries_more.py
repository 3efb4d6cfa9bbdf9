"""Queries of sources and sinks, colour helpers, matrix solvers, camera geometry and streams, with their SQL."""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color
from ..operators import geometry, models, tracking, video
from ..schema import to_pixels
from ..sources import images as sources
from ..sources.files import Whole, new_folder
from ..streaming import stateful
from . import oracles as O
from .queries_images import ORACLES, _out, add
from .queries_shapes import BACKGROUND
from .views import frames, img8, img8rgb, table

# --- sources and sinks: written to the shared folder and read again ---------------------------------

#: A gray image read back: bytes, the same in three channels.
_BACK = O.image(f"SELECT image_id, k AS ch, y, x, {O.BYTE.format('v')} / 255.0 AS v FROM px, (SELECT unnest(range(3)) AS k)")


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("image_id", F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("long"))


def _images_back(s: SparkSession, d: str) -> DataFrame:
    folder = new_folder(s, "images")
    sources.save_images(img8(s, d), folder)
    return _out(_named(sources.read_images(s, folder)))


def _qoi_back(s: SparkSession, d: str) -> DataFrame:
    folder = new_folder(s, "qoi")
    sources.save_images(img8(s, d), folder, "qoi")
    named = sources.files_of(s, folder).select(F.xxhash64("path").alias("video_id"), "path")
    return _out(_named(sources.read_animation(s, folder).join(named, "video_id")))


def _sequence_back(s: SparkSession, d: str) -> DataFrame:
    folder = new_folder(s, "sequence")
    sources.write_video(frames(s, d), f"{folder}/f.png")
    back = sources.read_image_sequence(s, folder, "f_", 25.0)
    return back.select(F.col("index").alias("idx"), "pts_us", F.round(F.aggregate(F.slice("data", 1, 768), F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


def _animation_back(s: SparkSession, d: str) -> DataFrame:
    folder = new_folder(s, "animation")
    sources.write_video(frames(s, d), f"{folder}/a.gif")
    return sources.read_animation(s, folder).select(F.col("index").alias("idx"), "pts_us", "duration_us", "c", "h", "w")


def _weights(s: SparkSession, d: str, kind: str) -> DataFrame:
    """Each embedding as a file of weights, written by the executors and read back."""
    folder = new_folder(s, "weights")

    def write(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for i, e in zip(pdf["vec_id"], pdf["embedding"], strict=True):
                raw = np.asarray(e, "<f4").tobytes()
                head = json.dumps({str(i): {"dtype": "F32", "shape": [8, 8], "data_offsets": [0, len(raw)]}}).encode()
                with Whole(folder, f"{i}.{kind}") as f:
                    f.write(struct.pack("<Q", len(head)) + head + raw if kind == "safetensors" else raw)
            yield pd.DataFrame({"n": [len(pdf)]})

    table(s, d, "embeddings").select("vec_id", "embedding").mapInPandas(write, "n long").agg(F.sum("n")).collect()
    back = sources.read_safetensors(s, folder) if kind == "safetensors" else sources.read_bin(s, folder, 8, 10)
    total = F.round(F.aggregate("data", F.lit(0.0), lambda a, v: a + v.cast("double")), 4).alias("total")
    if kind == "safetensors":
        return back.select(F.col("name").cast("long").alias("vec_id"), F.element_at("shape", 1).alias("rows"), F.size("data").alias("n"), total)
    return back.select(F.regexp_extract("name", r"(\d+)\.\w+$", 1).cast("long").alias("vec_id"), F.element_at("shape", 2).alias("cols"), F.size("data").alias("n"), total)


_SUM = "round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM embeddings"
add("image_files_round_trip", _images_back, _BACK)
add("qoi_files_round_trip", _qoi_back, _BACK)
add("image_sequence_round_trip", _sequence_back, f"WITH {O.FRAMES} SELECT CAST(idx AS BIGINT) AS idx, CAST(idx * 40000 AS BIGINT) AS pts_us, round(sum({O.BYTE.format('v')} / 255.0), 6) AS total FROM fr GROUP BY idx")
add("animation_round_trip", _animation_back, f"WITH {O.FRAMES} SELECT DISTINCT CAST(idx AS BIGINT) AS idx, CAST(idx * 40000 AS BIGINT) AS pts_us, CAST(40000 AS BIGINT) AS duration_us, CAST(3 AS INTEGER) AS c, CAST(24 AS INTEGER) AS h, CAST(32 AS INTEGER) AS w FROM fr")
add("safetensors_round_trip", lambda s, d: _weights(s, d, "safetensors"), f"SELECT vec_id, CAST(8 AS INTEGER) AS rows, CAST(64 AS INTEGER) AS n, {_SUM}")
add("flat_weights_round_trip", lambda s, d: _weights(s, d, "bin"), f"SELECT vec_id, CAST(10 AS INTEGER) AS cols, CAST(80 AS INTEGER) AS n, {_SUM}")
add("from_frames", lambda s, d: to_pixels(sources.from_frames(s, [np.full((1, 2, 3), k / 4) for k in range(3)], 50.0).withColumnRenamed("index", "image_id"), "pts_us"),
    "SELECT CAST(k AS BIGINT) AS image_id, CAST(k * 20000 AS BIGINT) AS pts_us, CAST(0 AS INTEGER) AS ch, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST(k / 4 AS DOUBLE) AS v FROM (SELECT unnest(range(3)) AS k), (SELECT unnest(range(2)) AS y), (SELECT unnest(range(3)) AS x)")
add("synthetic_metadata", lambda s, d: video.synthetic_metadata(s, 640, 480, 25.0, 50), "SELECT CAST(640 AS INTEGER) AS width, CAST(480 AS INTEGER) AS height, CAST(50 AS BIGINT) AS frame_count, CAST(2000000 AS BIGINT) AS duration_us, CAST(25.0 AS DOUBLE) AS fps, CAST(4 / 3 AS DOUBLE) AS aspect_ratio")
add("pixel_channels", lambda s, d: s.createDataFrame([(k,) for k in ("Rgb8", "Rgba8", "Gray8", "Rgb16", "Rgba16", "Rgb32F", "Rgba32F")], "format string").select("format", sources.pixel_channels(F.col("format")).alias("channels")),
    "SELECT format, CAST(CASE WHEN format LIKE 'Gray%' THEN 1 WHEN format LIKE 'Rgba%' THEN 4 ELSE 3 END AS INTEGER) AS channels FROM (SELECT unnest(['Rgb8', 'Rgba8', 'Gray8', 'Rgb16', 'Rgba16', 'Rgb32F', 'Rgba32F']) AS format)")

# --- colour helpers -------------------------------------------------------------------------------


def _helper(name: str, f: Callable, sql: str) -> None:
    add(name, lambda s, d: table(s, d, "lineitem").select((F.col("l_quantity") / 50).alias("v")).distinct().select(F.round("v", 6).alias("v"), F.round(f(F.col("v")), 6).alias("out")), f"SELECT round(v, 6) AS v, round({sql}, 6) AS out FROM (SELECT DISTINCT l_quantity / 50 AS v FROM lineitem)")


_helper("linearize", color.linearize, "CASE WHEN v <= 0.04045 THEN v / 12.92 ELSE pow((v + 0.055) / 1.055, 2.4) END")
_helper("delinearize", color.delinearize, "least(greatest(CASE WHEN v <= 0.0031308 THEN v * 12.92 ELSE 1.055 * pow(v, 1 / 2.4) - 0.055 END, 0), 1)")
_helper("lab_f", color.lab_f, "CASE WHEN v > 216.0 / 24389 THEN cbrt(v) ELSE (24389.0 / 27 * v + 16) / 116 END")
_helper("lab_f_inv", color.lab_f_inv, "CASE WHEN pow(v, 3) > 216.0 / 24389 THEN pow(v, 3) ELSE (116 * v - 16) / (24389.0 / 27) END")

# --- matrices: one row a cell ------------------------------------------------------------------------


def _matrix(name: str, make: Callable[[], np.ndarray], cells: list[str]) -> None:
    """``cells``: the matrix by rows, as SQL expressions."""
    add(name, lambda s, d: s.createDataFrame([(i, round(float(v), 6) + 0.0) for i, v in enumerate(np.asarray(make()).ravel())], "cell int, v double"), "SELECT * FROM (VALUES " + ", ".join(f"(CAST({i} AS INTEGER), round(CAST({c} AS DOUBLE), 6) + 0.0)" for i, c in enumerate(cells)) + ") t(cell, v)")


_C, _S = "1.5 * cos(radians(30))", "1.5 * sin(radians(30))"
_matrix("get_rotation_matrix_2d", lambda: geometry.get_rotation_matrix_2d((4, 3), 30, 1.5), [_C, _S, f"(1 - {_C}) * 4 - {_S} * 3", f"-{_S}", _C, f"{_S} * 4 + (1 - {_C}) * 3"])
# (0, 0), (2, 0), (0, 4) go to (1, 1), (5, 3), (-1, 9): columns of half and quarter differences.
_matrix("get_affine_transform", lambda: geometry.get_affine_transform([(0, 0), (2, 0), (0, 4)], [(1, 1), (5, 3), (-1, 9)]), ["(5 - 1) / 2.0", "(-1 - 1) / 4.0", "1", "(3 - 1) / 2.0", "(9 - 1) / 4.0", "1"])
# The unit square to (0, 0), (1, 0), (2, 2), (0, 1): the fourth corner gives both perspective terms.
_matrix("get_perspective_transform", lambda: geometry.get_perspective_transform([(0, 0), (1, 0), (1, 1), (0, 1)], [(0, 0), (1, 0), (2, 2), (0, 1)]), ["1 + g", "0", "0", "0", "1 + g", "0", "g", "g", "1"])
ORACLES["get_perspective_transform"] = ORACLES["get_perspective_transform"].replace("+ g", "+ (-1.0 / 3)").replace("CAST(g AS", "CAST(-1.0 / 3 AS")
_matrix("find_homography", lambda: geometry.find_homography([(0, 0), (1, 0), (1, 1), (0, 1)], [(2, 3), (4, 3), (4, 6), (2, 6)]), ["2", "0", "2", "0", "3", "3", "0", "0", "1"])
_matrix("find_essential_mat", lambda: geometry.find_essential_mat([[0, -1, 2], [1, 0, -3], [-2, 3, 0]], [[2, 0, 1], [0, 2, 1], [0, 0, 1]]), ["0", "-2.0 * 2", "2 * (-1 + 2)", "2.0 * 2", "0", "2 * (1 - 3)", "2 * (1 - 2)", "2 * (-1 + 3)", "0 - 1 + 2 + 1 + 0 - 3 - 2 + 3 + 0"])
_matrix("project_points", lambda: np.array(geometry.project_points([(1, 2, 4), (0, 1, 2)], np.eye(3), [0, 0, 1], [[2, 0, 1], [0, 2, 1], [0, 0, 1]], [0.1])), [f"2 * ({x} / {z}.0) * (1 + 0.1 * (pow({x} / {z}.0, 2) + pow({y} / {z}.0, 2))) + 1" if k == 0 else f"2 * ({y} / {z}.0) * (1 + 0.1 * (pow({x} / {z}.0, 2) + pow({y} / {z}.0, 2))) + 1" for x, y, z in ((1, 2, 5), (0, 1, 3)) for k in (0, 1)])


def _kalman_settings() -> np.ndarray:
    """State and covariance after one step of a filter whose every matrix has been set."""
    k = tracking.KalmanFilter(1, 1)
    k.set_transition([[2]]), k.set_measurement([[3]]), k.set_process_noise([[0.5]]), k.set_measurement_noise([[0.25]]), k.set_initial_state([1])
    k.predict()
    k.update([7])
    return np.array([k.x[0], k.p[0, 0]])


# Predicted: state 2, covariance 2 * 1 * 2 + 0.5; the gain is 4.5 * 3 / (3 * 4.5 * 3 + 0.25).
_matrix("kalman_settings", _kalman_settings, ["2 + 4.5 * 3 / (9 * 4.5 + 0.25) * (7 - 3 * 2)", "4.5 - 4.5 * 3 / (9 * 4.5 + 0.25) * 3 * 4.5"])

# --- streams ---------------------------------------------------------------------------------------


def _events(s: SparkSession, d: str) -> DataFrame:
    schema = s.read.parquet(f"{d}/events.parquet").schema
    return s.readStream.schema(schema).option("pathGlobFilter", "events.parquet*").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))


def _sessions(s: SparkSession, d: str) -> DataFrame:
    out = stateful.drained(stateful.sessions(_events(s, d)), "complete")
    return out.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


add("sessions_stream", _sessions, """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 30 MINUTE) AS end_us, count(*) AS n FROM k GROUP BY user_id, s""")


def _background_stream(s: SparkSession, d: str) -> DataFrame:
    """Frames written to the shared folder and read as a stream."""
    folder = new_folder(s, "frames")
    stored = frames(s, d).select("video_id", "index", "data")
    stored.write.parquet(folder)
    return stateful.drained(stateful.background_stream(s.readStream.schema(stored.schema).parquet(folder))).select(F.col("index").alias("idx"), "foreground")


add("background_stream", _background_stream, BACKGROUND)
