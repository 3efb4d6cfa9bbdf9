"""Runs NumPy kernels over images in Arrow batches, without a shuffle.

Images of one Arrow batch with the same shape are stacked and go through a
*stack* kernel at once, ``(n, c, h, w) -> (n, c', h', w')``; kernels that are
sequential within an image get ``(c, h, w)`` arrays one by one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ..schema import IMAGE

Stack = Callable[..., np.ndarray]


def _groups(c: pd.Series, h: pd.Series, w: pd.Series) -> dict[tuple[int, int, int], list[int]]:
    out: dict[tuple[int, int, int], list[int]] = {}
    for i, key in enumerate(zip(c, h, w, strict=True)):
        out.setdefault(tuple(int(k) for k in key), []).append(i)
    return out


def _image_frame(arrays: list[np.ndarray | None]) -> pd.DataFrame:
    shapes = [a.shape if a is not None else (None, None, None) for a in arrays]
    return pd.DataFrame({"c": [s[0] for s in shapes], "h": [s[1] for s in shapes], "w": [s[2] for s in shapes], "data": [np.ascontiguousarray(a, np.float64).ravel() if a is not None else None for a in arrays]})


def stack_column(kernel: Stack, *columns: str, **options) -> Column:
    """An image struct: ``kernel`` over stacks of the image in ``columns`` (c, h, w, data)."""

    @F.pandas_udf(IMAGE)
    def run(c: pd.Series, h: pd.Series, w: pd.Series, data: pd.Series) -> pd.DataFrame:
        out: list[np.ndarray | None] = [None] * len(data)
        for (k, m, n), rows in _groups(c, h, w).items():
            stack = np.stack([np.asarray(data[i], np.float64) for i in rows]).reshape(len(rows), k, m, n)
            for i, a in zip(rows, kernel(stack, **options), strict=True):
                out[i] = a
        return _image_frame(out)

    return run(*(F.col(x) for x in (columns or ("c", "h", "w", "data"))))


def apply_stack(images: DataFrame, kernel: Stack, **options) -> DataFrame:
    """``images`` with each image replaced by the kernel's; other columns stay."""
    return _replaced(images, stack_column(kernel, **options))


def apply_image(images: DataFrame, kernel: Callable[..., np.ndarray], **options) -> DataFrame:
    """As :func:`apply_stack` for a kernel of one image."""
    return apply_stack(images, lambda stack: [kernel(a, **options) for a in stack])


def apply_pair(images: DataFrame, other: tuple[str, str, str, str], kernel: Callable[..., np.ndarray], **options) -> DataFrame:
    """Replaces each image by ``kernel(image, other image of the same row)``."""

    @F.pandas_udf(IMAGE)
    def run(c: pd.Series, h: pd.Series, w: pd.Series, data: pd.Series, c2: pd.Series, h2: pd.Series, w2: pd.Series, data2: pd.Series) -> pd.DataFrame:
        shape = lambda d, *s: np.asarray(d, np.float64).reshape([int(k) for k in s])
        return _image_frame([kernel(shape(a, *s), shape(b, *t), **options) for a, b, s, t in zip(data, data2, zip(c, h, w, strict=True), zip(c2, h2, w2, strict=True), strict=True)])

    return _replaced(images, run(*(F.col(x) for x in ("c", "h", "w", "data", *other))))


#: Numbers of one side that go through a kernel of stacks of pairs at once, but for the last image's.
STACK = 1 << 16


def apply_pairs(images: DataFrame, other: tuple[str, str, str, str], kernel: Stack, **options) -> DataFrame:
    """As :func:`apply_pair` for a kernel of two stacks; pairs of the same shapes go through it together."""

    @F.pandas_udf(IMAGE)
    def run(c: pd.Series, h: pd.Series, w: pd.Series, data: pd.Series, c2: pd.Series, h2: pd.Series, w2: pd.Series, data2: pd.Series) -> pd.DataFrame:
        out: list[np.ndarray | None] = [None] * len(data)
        alike: dict[tuple[int, ...], list[int]] = {}
        for i, key in enumerate(zip(c, h, w, c2, h2, w2, strict=True)):
            alike.setdefault(tuple(int(k) for k in key), []).append(i)
        for key, rows in alike.items():
            step = max(1, STACK // max(1, int(np.prod(key[:3])), int(np.prod(key[3:]))))
            for some in (rows[j : j + step] for j in range(0, len(rows), step)):
                one, two = (np.stack([np.asarray(d[i], np.float64) for i in some]).reshape(len(some), *shape) for d, shape in ((data, key[:3]), (data2, key[3:])))
                for i, a in zip(some, kernel(one, two, **options), strict=True):
                    out[i] = a
        return _image_frame(out)

    return _replaced(images, run(*(F.col(x) for x in ("c", "h", "w", "data", *other))))


def measure(images: DataFrame, name: str, kind: DataType | str, kernel: Callable, **options) -> DataFrame:
    """``images`` with a column ``name``: ``kernel(image, **options)`` of each image as ``kind``."""
    from pyspark.sql.types import ArrayType, StructType, _parse_datatype_string

    kind = _parse_datatype_string(kind) if isinstance(kind, str) else kind
    boxed = StructType().add("value", kind)

    @F.pandas_udf(boxed)
    def run(c: pd.Series, h: pd.Series, w: pd.Series, data: pd.Series) -> pd.DataFrame:
        out = [kernel(np.asarray(d, np.float64).reshape(int(a), int(b), int(e)), **options) for a, b, e, d in zip(c, h, w, data, strict=True)]
        return pd.DataFrame({"value": pd.Series(out, dtype=object if isinstance(kind, (ArrayType, StructType)) else None)})

    return images.withColumn(name, run(F.col("c"), F.col("h"), F.col("w"), F.col("data"))["value"])


def _replaced(images: DataFrame, image: Column) -> DataFrame:
    rest = [c for c in images.columns if c not in ("c", "h", "w", "data")]
    done = images.select(*rest, image.alias("_image"))
    return done.select(*rest, "_image.c", "_image.h", "_image.w", "_image.data")
