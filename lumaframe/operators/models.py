"""The model-dependent surface: detectors and recognisers with a pluggable model.

A model is a path to an ONNX file, run by onnxruntime where that is installed. Without a model an
operator raises :class:`ModelNotProvided`; with ``compat=True`` it gives the
constants that stand for a model's output.
"""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..schema import InvalidParameter, ModelNotProvided


class OnnxModel:
    """A network read from ``path``; sessions open on the executors."""

    def __init__(self, path: str):
        if not os.path.exists(path):
            raise InvalidParameter(f"no model at {path}")
        self.path, self._session = path, None

    def __getstate__(self) -> dict:
        return {"path": self.path, "_session": None}

    def predict_raw(self, batch: np.ndarray) -> np.ndarray:
        if self._session is None:
            import onnxruntime

            self._session = onnxruntime.InferenceSession(self.path)
        return self._session.run(None, {self._session.get_inputs()[0].name: batch.astype(np.float32)})[0]


def read_net(path: str) -> OnnxModel:
    return OnnxModel(path)


read_net_from_onnx = read_net


def preprocess(data: Column) -> Column:
    """A planar image is already (1, c, h, w) in order."""
    return data


def predict(images: DataFrame, model: OnnxModel | None, out: str = "prediction") -> DataFrame:
    """``images`` with the flattened network output of each."""
    _need(model, False)
    import pandas as pd

    @F.pandas_udf(ArrayType(DoubleType()))
    def run(c: pd.Series, h: pd.Series, w: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([model.predict_raw(np.asarray(d, float).reshape(1, int(a), int(b), int(e))).ravel().astype(float).tolist() for a, b, e, d in zip(c, h, w, data, strict=True)], dtype=object)

    return images.withColumn(out, run("c", "h", "w", "data"))


def _need(model: OnnxModel | None, compat: bool) -> None:
    if model is None and not compat:
        raise ModelNotProvided("a trained model is needed")


def _rect(x, y, w, h) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast("long").alias(k) for k, v in zip(("x", "y", "width", "height"), (x, y, w, h), strict=True)])


def segment(images: DataFrame, model: OnnxModel | None = None, compat: bool = False) -> DataFrame:
    """Class of each pixel in ``mask``; zeros in compat mode."""
    _need(model, compat)
    if model is None:
        return images.withColumn("mask", F.array_repeat(F.lit(0), F.col("h") * F.col("w")))
    scores = predict(images, model, "_s")
    n = F.col("h") * F.col("w")
    best = F.transform(F.sequence(F.lit(0), n - 1), lambda i: _argmax(i, n))
    return scores.withColumn("mask", best).drop("_s")


def _argmax(i: Column, n: Column) -> Column:
    each = F.transform(F.sequence(F.lit(0), (F.size("_s") / n).cast("int") - 1), lambda k: F.element_at("_s", (k * n + i + 1).cast("int")))
    return (F.array_position(each, F.array_max(each)) - 1).cast("int")


def detect_faces(images: DataFrame, model: OnnxModel | None = None, compat: bool = False) -> DataFrame:
    _need(model, compat)
    if model is not None:
        return predict(images, model, "faces")
    w, h = F.col("w"), F.col("h")
    return images.withColumn("faces", F.array(F.struct(_rect((w / 4).cast("int"), (h / 4).cast("int"), (w / 2).cast("int"), (h / 2).cast("int")).alias("bbox"), F.lit(0.98).alias("confidence"))))


def extract_embedding(images: DataFrame, model: OnnxModel | None = None, compat: bool = False) -> DataFrame:
    _need(model, compat)
    return predict(images, model, "embedding") if model is not None else images.withColumn("embedding", F.array_repeat(F.lit(0.0), 512))


def detect_objects(images: DataFrame, model: OnnxModel | None = None, compat: bool = False) -> DataFrame:
    _need(model, compat)
    if model is not None:
        return predict(images, model, "detections")
    return images.withColumn("detections", F.array(F.struct(F.lit(1).alias("class_id"), F.lit(0.92).alias("confidence"), _rect(50, 50, 200, 150).alias("bbox"))))


def _needs_model(what: str):
    def run(images: DataFrame, model: OnnxModel | None = None) -> DataFrame:
        _need(model, False)
        return predict(images, model, what)

    run.__doc__ = f"``images`` with the network output in ``{what}``."
    return run


recognize_text = _needs_model("text")
detect_qr = _needs_model("qr_codes")
detect_barcodes = _needs_model("barcodes")


def detect_markers(images: DataFrame, model: OnnxModel | None = None, compat: bool = False) -> DataFrame:
    _need(model, compat)
    if model is not None:
        return predict(images, model, "markers")
    at = lambda a, b: F.struct((F.col("w") * a).alias("x"), (F.col("h") * b).alias("y"))
    return images.withColumn("markers", F.array(F.struct(F.lit(42).alias("id"), F.array(at(0.1, 0.1), at(0.3, 0.1), at(0.3, 0.3), at(0.1, 0.3)).alias("corners"))))


def estimate_pose(markers: int, compat: bool = False):
    """Rotation and translation of each marker."""
    _need(None, compat)
    return [np.eye(3)] * markers, [np.array([[0.0], [0.0], [1.0]])] * markers


def calibrate_camera(compat: bool = False):
    _need(None, compat)
    return np.array([[500.0, 0, 320], [0, 500.0, 240], [0, 0, 1]]), [0.0] * 5


def solve_pnp(compat: bool = False):
    _need(None, compat)
    return np.eye(3), np.array([[0.0], [0.0], [1.0]])


def find_fundamental_mat(src, dst) -> np.ndarray:
    """By the normalised eight-point algorithm."""
    if len(src) < 8 or len(src) != len(dst):
        raise InvalidParameter("eight pairs are needed")
    from .features import _normalised

    (p, tp), (q, tq) = _normalised(np.asarray(src, float)), _normalised(np.asarray(dst, float))
    a = np.stack([q[:, 0] * p[:, 0], q[:, 0] * p[:, 1], q[:, 0], q[:, 1] * p[:, 0], q[:, 1] * p[:, 1], q[:, 1], p[:, 0], p[:, 1], np.ones(len(p))], 1)
    u, s, v = np.linalg.svd(np.linalg.svd(a)[2][-1].reshape(3, 3))
    f = tq.T @ (u @ np.diag([s[0], s[1], 0]) @ v) @ tp
    return f / f[2, 2] if abs(f[2, 2]) > 1e-12 else f
