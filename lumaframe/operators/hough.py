"""Hough transforms as relations: points vote for cells, cells that no neighbour beats are peaks.

Inputs are points (image_id, h, w, y, x) of images of any size and number. Each point is exploded to the cells it votes for and
votes are counted with partial aggregation, so that what is shuffled is at most one row a task and cell.
Candidates are joined with the votes of their neighbours. Joins sort and merge: the planner takes exploded rows for as small as the file
they come from, and would send them whole to the driver and to all tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import InvalidParameter
from .filters import gaussian_blur, gradients, gray
from .graph import first_kept


def edge_points(images: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Pixels over ``threshold`` of the first channel of ROW images; no shuffle."""
    flat = images.select("image_id", "h", "w", F.posexplode(F.slice("data", 1, F.col("h") * F.col("w"))).alias("i", "v")).filter(F.col("v") > threshold)
    return flat.select("image_id", "h", "w", (F.col("i") / F.col("w")).cast("int").alias("y"), (F.col("i") % F.col("w")).alias("x"))


def _angles(theta: float) -> int:
    if theta <= 0:
        raise InvalidParameter("angles grow")
    return max(1, round(math.pi / theta))


def _cell(rho: float, theta: float) -> Column:
    angle = F.col("t") * F.lit(theta)
    return F.floor((F.col("x") * F.cos(angle) + F.col("y") * F.sin(angle) + F.sqrt(F.pow("h", F.lit(2)) + F.pow("w", F.lit(2)))) / F.lit(float(rho)) + 0.5).cast("int")


def _in_cells(points: DataFrame, rho: float, theta: float) -> DataFrame:
    return points.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(_angles(theta) - 1)))).withColumn("r", _cell(rho, theta))


def line_votes(points: DataFrame, rho: float, theta: float) -> DataFrame:
    """(image_id, r, t, votes): points on the line of angle ``t * theta`` whose distance, counted from minus the diagonal, is ``r * rho``."""
    return _in_cells(points, rho, theta).groupBy("image_id", "r", "t").agg(F.count("*").alias("votes"))


def _unbeaten(cells: DataFrame, candidates: DataFrame, keys: list[str], steps: list[tuple[int, ...]]) -> DataFrame:
    """``candidates`` without those that a cell some step away has more votes than."""
    away = F.explode(F.array(*[F.struct(*[(F.col(k) + F.lit(d)).alias(k) for k, d in zip(keys, step, strict=True)]) for step in steps]))
    same = [k for k in candidates.columns if k not in (*keys, "votes")]
    asked = candidates.select(*same, *[F.col(k).alias(f"own_{k}") for k in keys], F.col("votes").alias("own"), away.alias("n"))
    asked = asked.select(*same, *[f"own_{k}" for k in keys], "own", *[F.col(f"n.{k}").alias(k) for k in keys])
    beaten = asked.join(cells.hint("merge"), [*same, *keys]).filter("votes > own").select(*same, *[F.col(f"own_{k}").alias(k) for k in keys]).distinct()
    return candidates.join(beaten.hint("merge"), [*same, *keys], "left_anti")


def line_peaks(votes: DataFrame, theta: float, threshold: int) -> DataFrame:
    """Cells of ``threshold`` votes or more that have at least as many as the four cells around them; the first and last angle have none."""
    inside = votes.filter((F.col("votes") >= threshold) & (F.col("r") >= 1) & (F.col("t") >= 1) & (F.col("t") <= _angles(theta) - 2))
    return _unbeaten(votes, inside.select("image_id", "r", "t", "votes"), ["r", "t"], [(-1, 0), (1, 0), (0, -1), (0, 1)])


def line_segments(points: DataFrame, peaks: DataFrame, rho: float, theta: float, min_length: float, max_gap: float) -> DataFrame:
    """(image_id, r, t, x1, y1, x2, y2): the points on each peak's line in order, cut where they are more than ``max_gap`` apart."""
    on = _in_cells(points, rho, theta).join(peaks.select("image_id", "r", "t").hint("merge"), ["image_id", "r", "t"])
    angle = F.col("t") * F.lit(theta)
    along = F.when(F.abs(F.sin(angle)) < F.abs(F.cos(angle)), F.col("y")).otherwise(F.col("x"))
    line = Window.partitionBy("image_id", "r", "t").orderBy("along", "y", "x")  # a line's points at most
    far = F.sqrt(F.pow(F.col("x") - F.lag("x").over(line), 2) + F.pow(F.col("y") - F.lag("y").over(line), 2)) > max_gap
    cut = on.withColumn("along", along).withColumn("new", F.coalesce(far, F.lit(False)).cast("int")).withColumn("part", F.sum("new").over(line))
    ends = cut.groupBy("image_id", "r", "t", "part").agg(F.min(F.struct("along", "y", "x")).alias("a"), F.max(F.struct("along", "y", "x")).alias("b"))
    length = F.sqrt(F.pow(F.col("b.x") - F.col("a.x"), 2) + F.pow(F.col("b.y") - F.col("a.y"), 2))
    return ends.filter(length >= min_length).select("image_id", "r", "t", F.col("a.x").alias("x1"), F.col("a.y").alias("y1"), F.col("b.x").alias("x2"), F.col("b.y").alias("y2"))


def lines_p(points: DataFrame, rho: float, theta: float, threshold: int, min_length: float, max_gap: float) -> DataFrame:
    """Segments at the peaks of the votes: :func:`.segmentation.hough_lines_p` for points of any number."""
    return line_segments(points, line_peaks(line_votes(points, rho, theta), theta, threshold), rho, theta, min_length, max_gap)


# --- circles ------------------------------------------------------------------------------


def gradient_stack(s):
    """Horizontal and vertical gradient of smoothed stacks as two channels; a window kernel of radius 3."""
    import numpy as np

    return np.concatenate(gradients(gaussian_blur(gray(s), 5, 1.0)), 1)


def gradient_points(gradients_: DataFrame) -> DataFrame:
    """(image_id, h, w, y, x, gx, gy) of ROW images of two channels, such as :func:`gradient_stack` makes; no shuffle."""
    plane = F.col("h") * F.col("w")
    both = F.arrays_zip(F.slice("data", 1, plane).alias("gx"), F.slice("data", plane + 1, plane).alias("gy"))
    flat = gradients_.select("image_id", "h", "w", F.posexplode(both).alias("i", "g"))
    return flat.select("image_id", "h", "w", (F.col("i") / F.col("w")).cast("int").alias("y"), (F.col("i") % F.col("w")).alias("x"), F.col("g.gx").alias("gx"), F.col("g.gy").alias("gy"))


def circle_votes(points: DataFrame, param1: float, min_radius: int, max_radius: int) -> DataFrame:
    """(image_id, radius, cy, cx, votes): edge points vote for centres at each radius, along their gradient both ways."""
    if not 0 < min_radius <= max_radius:
        raise InvalidParameter("radii go up from one")
    size = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))
    edge = points.withColumn("size", size).filter((F.col("size") >= param1 / 2) & (F.col("size") > 0))
    far = edge.withColumn("radius", F.explode(F.sequence(F.lit(min_radius), F.lit(max_radius)))).withColumn("sign", F.explode(F.array(F.lit(1), F.lit(-1))))
    centre = lambda at, g: F.floor(F.col(at) + F.col("sign") * F.col("radius") * (F.col(g) / F.col("size")) + 0.5).cast("int")
    cells = far.withColumn("cx", centre("x", "gx")).withColumn("cy", centre("y", "gy")).filter("cx >= 0 AND cy >= 0 AND cx < w AND cy < h")
    return cells.groupBy("image_id", "radius", "cy", "cx").agg(F.count("*").alias("votes"))


def circle_peaks(votes: DataFrame, param2: float, step: int) -> DataFrame:
    """Centres of ``param2`` votes or more that none of the eight cells ``step`` away has more votes than."""
    around = [(dy * step, dx * step) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
    return _unbeaten(votes, votes.filter(F.col("votes") >= param2), ["cy", "cx"], around)


def apart(circles: DataFrame, min_dist: float) -> DataFrame:
    """Circles (image_id, radius, cy, cx), smaller ones first and then row by row, that are ``min_dist`` or more from all that stay before them.

    Circles that are too close meet by cells of a grid as wide as ``min_dist``, never all of an image.
    """
    named = circles.withColumn("name", F.struct("radius", "cy", "cx"))
    if min_dist <= 0:
        return circles
    cell = lambda c: F.floor(F.col(c) / F.lit(float(min_dist)))
    a = named.select("image_id", F.col("name").alias("a"), cell("cy").alias("gy"), cell("cx").alias("gx"))
    around = F.sequence(F.lit(-1), F.lit(1))
    b = named.select("image_id", F.col("name").alias("b"), cell("cy").alias("gy"), cell("cx").alias("gx"))
    b = b.withColumn("dy", F.explode(around)).withColumn("dx", F.explode(around)).select("image_id", "b", (F.col("gy") + F.col("dy")).alias("gy"), (F.col("gx") + F.col("dx")).alias("gx"))
    near = F.sqrt(F.pow(F.col("a.cx") - F.col("b.cx"), 2) + F.pow(F.col("a.cy") - F.col("b.cy"), 2)) < min_dist
    clashes = a.join(b.hint("merge"), ["image_id", "gy", "gx"]).filter((F.col("a") < F.col("b")) & near).select("image_id", "a", "b")
    kept = first_kept(named.select("image_id", F.col("name").alias("node")), clashes, "image_id")
    return kept.select("image_id", "node.radius", "node.cy", "node.cx")


def circles(points: DataFrame, dp: float, min_dist: float, param1: float, param2: float, min_radius: int, max_radius: int) -> DataFrame:
    """(image_id, radius, cy, cx): :func:`.segmentation.hough_circles` for gradients of any number of pixels."""
    peaks = circle_peaks(circle_votes(points, param1, min_radius, max_radius), param2, max(1, int(dp)))
    return apart(peaks.select("image_id", "radius", "cy", "cx"), min_dist)
