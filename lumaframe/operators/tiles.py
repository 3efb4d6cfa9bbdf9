"""Images larger than a row: a relation of tiles, window kernels with halos, components across tiles.

TILE: ``image_id long, c int, h int, w int, ty int, tx int, side int, data array<double>``. ``h`` and ``w`` are the
image's; a tile holds its rows ``ty * side`` to ``ty * side + side - 1`` (fewer at the lower edge), and columns likewise, planar. An image may have
any number of tiles; no operator here holds more than a tile and its surroundings in a task.

A window kernel needs what lies around a tile: :func:`with_halo` sends each tile's margins to its neighbours in one shuffle. At the
image's own edge the halo ends, so that a kernel meets the true edge there and keeps its border rule.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import InvalidParameter
from . import graph
from .segmentation import label

TILE = ("image_id", "c", "h", "w", "ty", "tx", "side")
SIDE = 512
#: Numbers of tiles with their surroundings that go through a kernel at once, but for the last tile's.
STACK = 1 << 18


def _checked(side: int) -> int:
    if side < 1:
        raise InvalidParameter("a tile has at least one pixel")
    return side


def tiles_of(images: DataFrame, side: int = SIDE) -> DataFrame:
    """ROW images cut into tiles; no shuffle."""
    _checked(side)

    @F.pandas_udf("array<struct<ty:int,tx:int,data:array<double>>>")
    def cut(c: pd.Series, h: pd.Series, w: pd.Series, data: pd.Series) -> pd.Series:
        out = []
        for k, m, n, d in zip(c, h, w, data, strict=True):
            a = np.asarray(d, float).reshape(k, m, n)
            out.append([{"ty": y // side, "tx": x // side, "data": a[:, y : y + side, x : x + side].ravel()} for y in range(0, m, side) for x in range(0, n, side)])
        return pd.Series(out)

    return images.select("image_id", "c", "h", "w", F.explode(cut("c", "h", "w", "data")).alias("t")).select("image_id", "c", "h", "w", "t.ty", "t.tx", F.lit(side).alias("side"), "t.data")


def tiles_from_pixels(pixels: DataFrame, side: int = SIDE) -> DataFrame:
    """Tiles of PX pixels (image_id, ch, y, x, v) of images of any size; absent pixels are 0. Images end with their last pixel."""
    _checked(side)
    ends = pixels.groupBy("image_id").agg((F.max("ch") + 1).cast("int").alias("c"), (F.max("y") + 1).cast("int").alias("h"), (F.max("x") + 1).cast("int").alias("w"))
    cut = pixels.select("image_id", F.floor(F.col("y") / side).cast("int").alias("ty"), F.floor(F.col("x") / side).cast("int").alias("tx"), "ch", "y", "x", F.col("v").cast("double").alias("v"))
    part = cut.groupBy("image_id", "ty", "tx").agg(F.collect_list(F.struct("ch", "y", "x", "v")).alias("p"))  # a tile's pixels at most
    # Tiles without any pixel exist too.
    grid = ends.withColumn("ty", F.explode(F.sequence(F.lit(0), F.floor((F.col("h") - 1) / side).cast("int")))).withColumn("tx", F.explode(F.sequence(F.lit(0), F.floor((F.col("w") - 1) / side).cast("int"))))

    @F.pandas_udf("array<double>")
    def placed(c: pd.Series, th: pd.Series, tw: pd.Series, at: pd.Series, v: pd.Series) -> pd.Series:
        out = []
        for k, m, n, i, values in zip(c, th, tw, at, v, strict=True):
            a = np.zeros(k * m * n)
            if i is not None:
                a[np.asarray(i, int)] = values
            out.append(a)
        return pd.Series(out)

    full = grid.join(part, ["image_id", "ty", "tx"], "left").withColumn("side", F.lit(side)).withColumn("th", _height()).withColumn("tw", _width())
    at = F.transform("p", lambda p: (p["ch"] * F.col("th") + p["y"] % side) * F.col("tw") + p["x"] % side)
    return full.select(*TILE, placed("c", "th", "tw", at, F.col("p.v")).alias("data"))


def _height() -> Column:
    return F.least(F.col("side"), F.col("h") - F.col("ty") * F.col("side"))


def _width() -> Column:
    return F.least(F.col("side"), F.col("w") - F.col("tx") * F.col("side"))


def pixels_of(tiles: DataFrame) -> DataFrame:
    """PX pixels of tiles; no shuffle."""
    flat = tiles.select("image_id", "side", "ty", "tx", _height().alias("th"), _width().alias("tw"), F.posexplode("data").alias("i", "v"))
    plane = F.col("th") * F.col("tw")
    y, x = ((F.col("i") % plane) / F.col("tw")).cast("int"), F.col("i") % F.col("tw")
    return flat.select("image_id", (F.col("i") / plane).cast("int").alias("ch"), (F.col("ty") * F.col("side") + y).cast("int").alias("y"), (F.col("tx") * F.col("side") + x).cast("int").alias("x"), F.col("v").cast("double").alias("v"))


def images_of(tiles: DataFrame) -> DataFrame:
    """Tiles put together to ROW images, for images that fit in a row."""

    @F.pandas_udf("array<double>")
    def join(c: pd.Series, h: pd.Series, w: pd.Series, side: pd.Series, parts: pd.Series) -> pd.Series:
        out = []
        for k, m, n, s, rows in zip(c, h, w, side, parts, strict=True):
            a = np.zeros((k, m, n))
            for t in rows:
                y, x = t["ty"] * s, t["tx"] * s
                a[:, y : y + s, x : x + s] = np.asarray(t["data"], float).reshape(k, min(s, m - y), min(s, n - x))
            out.append(a.ravel())
        return pd.Series(out)

    rows = tiles.groupBy("image_id", "c", "h", "w", "side").agg(F.collect_list(F.struct("ty", "tx", "data")).alias("parts"))
    return rows.select("image_id", "c", "h", "w", join("c", "h", "w", "side", "parts").alias("data"))


def with_halo(tiles: DataFrame, radius: int) -> DataFrame:
    """Tiles with ``pieces``: all parts of the image within ``radius`` of the tile, each (y, x, ph, pw, data) in the image's coordinates.

    Only a tile's margins travel, and its own rows once.
    """
    if radius < 0:
        raise InvalidParameter("a radius is not negative")
    reach = F.ceil(F.lit(radius) / F.col("side")).cast("int")
    offsets = F.sequence(-reach, reach)
    y0, x0 = F.col("ty") * F.col("side"), F.col("tx") * F.col("side")
    sent = tiles.withColumn("th", _height()).withColumn("tw", _width()).withColumn("dy", F.explode(offsets)).withColumn("dx", F.explode(offsets))
    sent = sent.withColumn("to_y", F.col("ty") + F.col("dy")).withColumn("to_x", F.col("tx") + F.col("dx"))
    sent = sent.filter((F.col("to_y") >= 0) & (F.col("to_x") >= 0) & (F.col("to_y") * F.col("side") < F.col("h")) & (F.col("to_x") * F.col("side") < F.col("w")))
    # The part of this tile within the radius of the one it is sent to.
    sent = sent.withColumn("top", F.greatest(y0, F.col("to_y") * F.col("side") - radius)).withColumn("left", F.greatest(x0, F.col("to_x") * F.col("side") - radius))
    sent = sent.withColumn("ph", F.least(y0 + F.col("th"), (F.col("to_y") + 1) * F.col("side") + radius) - F.col("top")).withColumn("pw", F.least(x0 + F.col("tw"), (F.col("to_x") + 1) * F.col("side") + radius) - F.col("left"))
    sent = sent.filter("ph > 0 AND pw > 0")
    rows = F.sequence(F.lit(0), F.col("c") * F.col("ph") - 1)
    first = lambda i: (F.floor(i / F.col("ph")).cast("int") * F.col("th") + F.col("top") - y0 + i % F.col("ph")) * F.col("tw") + F.col("left") - x0 + 1
    part = F.when((F.col("dy") == 0) & (F.col("dx") == 0), F.col("data")).otherwise(F.flatten(F.transform(rows, lambda i: F.slice("data", first(i), F.col("pw")))))
    piece = F.struct(F.col("top").alias("y"), F.col("left").alias("x"), "ph", "pw", part.alias("data"))
    sent = sent.withColumn("piece", piece)  # before ty and tx get other meanings, which a lambda would see
    sent = sent.select("image_id", "c", "h", "w", F.col("to_y").alias("ty"), F.col("to_x").alias("tx"), "side", "piece")
    return sent.groupBy(*TILE).agg(F.collect_list("piece").alias("pieces"))


def apply_tiled(tiles: DataFrame, kernel: Callable[..., np.ndarray], radius: int, **options) -> DataFrame:
    """``tiles`` after a window kernel over stacks (n, c, h, w) that sees ``radius`` pixels around each pixel, as over the whole images.

    Kernels whose result depends on more of the image than the window (a global maximum, say) don't qualify.
    """

    haloed = with_halo(tiles, radius)

    def told(b: pa.RecordBatch, rows: list[int], cores: list[np.ndarray]) -> pa.RecordBatch:
        data = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(a.size for a in cores)]), pa.int32()), pa.array(np.concatenate([a.ravel() for a in cores]), pa.float64()))
        values = {c: b.column(c).take(pa.array(rows, pa.int64())) for c in TILE} | {"c": pa.array([len(a) for a in cores], pa.int32()), "data": data}
        return pa.RecordBatch.from_arrays(list(values.values()), names=list(values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tiles of one shape are stacked up to ``STACK`` numbers; pieces are read as flat arrays, a tile at a time."""
        for b in batches:
            stacks: dict[tuple, list[tuple[int, np.ndarray]]] = {}

            def done(key: tuple, b=b, stacks=stacks) -> pa.RecordBatch:
                some, (y, x, th, tw) = stacks.pop(key), key[3:]
                out = kernel(np.stack([a for _, a in some]), **options)
                return told(b, [i for i, _ in some], [np.ascontiguousarray(a[:, y : y + th, x : x + tw], float) for a in out])

            pieces = b.column("pieces")
            ends, parts = pieces.offsets.to_numpy(), pieces.values
            at = np.column_stack([parts.field(c).to_numpy(zero_copy_only=False) for c in ("y", "x", "ph", "pw")]).astype(int).tolist()
            starts, numbers = parts.field("data").offsets.to_numpy(), parts.field("data").values.to_numpy(zero_copy_only=False)
            for i, (k, m, n, y, x, s) in enumerate(zip(*(b.column(c).to_pylist() for c in ("c", "h", "w", "ty", "tx", "side")), strict=True)):
                top, left = max(0, y * s - radius), max(0, x * s - radius)
                a = np.empty((k, min(m, (y + 1) * s + radius) - top, min(n, (x + 1) * s + radius) - left))
                for p in range(ends[i], ends[i + 1]):
                    py, px, ph, pw = at[p]
                    a[:, py - top : py - top + ph, px - left : px - left + pw] = numbers[starts[p] : starts[p + 1]].reshape(k, ph, pw)
                key = (*a.shape, y * s - top, x * s - left, min(s, m - y * s), min(s, n - x * s))
                stacks.setdefault(key, []).append((i, a))
                if len(stacks[key]) * a.size >= STACK:
                    yield done(key)
            for key in list(stacks):
                yield done(key)

    kinds = dict(haloed.dtypes)
    return haloed.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in TILE) + ", data array<double>")


# --- components ---------------------------------------------------------------------------

_LOCAL = "struct<labels:array<long>,top:array<long>,bottom:array<long>,left:array<long>,right:array<long>>"


def _local_labels(threshold: float) -> Column:
    """Each pixel's component within its tile, named by its first pixel's place in the image (from 1; 0 for background), and the tile's borders."""

    @F.pandas_udf(_LOCAL)
    def run(c: pd.Series, h: pd.Series, w: pd.Series, ty: pd.Series, tx: pd.Series, side: pd.Series, data: pd.Series) -> pd.DataFrame:
        out = []
        for k, m, n, y, x, s, d in zip(c, h, w, ty, tx, side, data, strict=True):
            th, tw = min(s, m - y * s), min(s, n - x * s)
            local = label(np.asarray(d, float).reshape(k, th, tw)[0] > threshold)
            first = np.unique(local, return_index=True)
            place = np.zeros(local.max(initial=0) + 1, np.int64)
            at = first[1][first[0] > 0]
            place[1:] = (y * s + at // tw) * np.int64(n) + x * s + at % tw + 1
            named = place[local]
            out.append((named.ravel(), named[0], named[-1], named[:, 0], named[:, -1]))
        return pd.DataFrame({name: [o[i] for o in out] for i, name in enumerate(("labels", "top", "bottom", "left", "right"))})

    return run("c", "h", "w", "ty", "tx", "side", "data")


def _touching(local: DataFrame) -> DataFrame:
    """Edges (image_id, u, v) between components of neighbouring tiles; a border travels as one row."""
    lower = local.select("image_id", "tx", "ty", F.col("l.bottom").alias("a")).join(local.select("image_id", "tx", (F.col("ty") - 1).alias("ty"), F.col("l.top").alias("b")), ["image_id", "tx", "ty"])
    right = local.select("image_id", "tx", "ty", F.col("l.right").alias("a")).join(local.select("image_id", (F.col("tx") - 1).alias("tx"), "ty", F.col("l.left").alias("b")), ["image_id", "tx", "ty"])
    met = lower.select("image_id", "a", "b").unionByName(right.select("image_id", "a", "b"))
    pairs = met.select("image_id", F.explode(F.array_distinct(F.arrays_zip("a", "b"))).alias("p"))
    return pairs.filter("p.a > 0 AND p.b > 0").select("image_id", F.col("p.a").alias("u"), F.col("p.b").alias("v")).distinct()


def label_tiles(tiles: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Tiles whose pixels over ``threshold`` (of the first channel) hold their 4-connected component: 1 + the place (row by row) of its first pixel.

    Components within tiles are found tile by tile; those that touch across a border are edges of a graph that is far smaller
    than the image, whose components name all.
    """
    local = tiles.withColumn("l", _local_labels(threshold))
    roots = graph.components(_touching(local)).select("image_id", F.col("node"), F.col("root"))
    # Only components at borders have another name; each tile is told those that it holds.
    held = local.select("image_id", "ty", "tx", F.explode(F.array_distinct(F.flatten(F.array("l.top", "l.bottom", "l.left", "l.right")))).alias("node"))
    told = held.filter("node > 0").join(roots.filter("node <> root"), ["image_id", "node"]).groupBy("image_id", "ty", "tx").agg(F.map_from_entries(F.collect_list(F.struct("node", "root"))).alias("names"))
    named = local.join(told, ["image_id", "ty", "tx"], "left")
    data = F.when(F.col("names").isNull(), F.col("l.labels")).otherwise(F.transform("l.labels", lambda v: F.coalesce(F.col("names")[v], v)))
    return named.select("image_id", F.lit(1).alias("c"), "h", "w", "ty", "tx", "side", F.transform(data, lambda v: v.cast("double")).alias("data"))


def tile_component_stats(labelled: DataFrame) -> DataFrame:
    """(image_id, label, x, y, width, height, area, cx, cy) of each component of :func:`label_tiles`, summed up within tiles first."""
    p = pixels_of(labelled).filter("v > 0")
    g = p.groupBy("image_id", F.col("v").cast("long").alias("label")).agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count("*").alias("area"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    return g.select("image_id", "label", "x", "y", (F.col("x1") - F.col("x") + 1).alias("width"), (F.col("y1") - F.col("y") + 1).alias("height"), "area", "cx", "cy")
