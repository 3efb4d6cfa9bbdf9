"""Queries of the Hough relations: over one small image a row, and over one image as high as its table is long."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hough, tiles
from . import queries_shapes  # the per-image forms, which get their SQL here
from .kernels import apply_stack
from .queries_images import add
from .queries_tiles import _PX, _SIDE
from .views import img8, sheet

_RHO, _THETA = 1.0, math.pi / 36
_N = 36

# --- lines --------------------------------------------------------------------------------


def _points(s: SparkSession, d: str) -> DataFrame:
    return hough.edge_points(img8(s, d))


def _on_sheet(s: SparkSession, d: str) -> DataFrame:
    p = sheet(s, d)
    ends = p.agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))  # one row
    return p.filter("v > 0.6").select("image_id", "y", "x").crossJoin(F.broadcast(ends))


_SMALL = "px AS (SELECT vec_id AS image_id, 8 AS h, 8 AS w, (i // 8) AS y, (i % 8) AS x FROM (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding) AS e FROM embeddings) WHERE least(greatest(e::DOUBLE * 0.5 + 0.5, 0), 1) > 0.5)"
_LARGE = f"s{_PX}, ends AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM spx), px AS (SELECT 0::BIGINT AS image_id, h, w, y, x FROM spx, ends WHERE v > 0.6)"


def _lines_sql(points: str, threshold: int, min_length: float, max_gap: float) -> str:
    return f"""WITH {points},
c AS MATERIALIZED (SELECT *, floor((x * cos(t * {_THETA}) + y * sin(t * {_THETA}) + sqrt(h * h + w * w)) / {_RHO} + 0.5)::INTEGER AS r FROM px, range({_N}) AS a(t)),
votes AS MATERIALIZED (SELECT image_id, r, t, count(*) AS votes FROM c GROUP BY image_id, r, t),
peaks AS MATERIALIZED (SELECT * FROM votes v WHERE votes >= {threshold} AND r >= 1 AND t BETWEEN 1 AND {_N - 2} AND NOT EXISTS (
  SELECT 1 FROM votes o WHERE o.image_id = v.image_id AND o.votes > v.votes AND ((o.r = v.r AND o.t = v.t - 1) OR (o.r = v.r AND o.t = v.t + 1) OR (o.t = v.t AND o.r = v.r - 1) OR (o.t = v.t AND o.r = v.r + 1)))),
o AS (SELECT c.*, CASE WHEN abs(sin(t * {_THETA})) < abs(cos(t * {_THETA})) THEN y ELSE x END AS along FROM c JOIN peaks USING (image_id, r, t)),
g AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER l, 2) + pow(y - lag(y) OVER l, 2)) > {max_gap}, false)::INTEGER AS new FROM o WINDOW l AS (PARTITION BY image_id, r, t ORDER BY along, y, x)),
p AS (SELECT *, sum(new) OVER (PARTITION BY image_id, r, t ORDER BY along, y, x) AS part FROM g),
e AS (SELECT image_id, r, t, min(struct_pack(along := along, y := y, x := x)) AS a, max(struct_pack(along := along, y := y, x := x)) AS b FROM p GROUP BY image_id, r, t, part),
seg AS (SELECT image_id, r, t::INTEGER AS t, a.x::INTEGER AS x1, a.y::INTEGER AS y1, b.x::INTEGER AS x2, b.y::INTEGER AS y2 FROM e WHERE sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) >= {min_length})"""


add("hough_line_votes", lambda s, d: hough.line_votes(_points(s, d), _RHO, _THETA), f"{_lines_sql(_SMALL, 4, 3, 2)} SELECT image_id, r, t::INTEGER AS t, votes FROM votes")
add("hough_line_peaks", lambda s, d: hough.line_peaks(hough.line_votes(_points(s, d), _RHO, _THETA), _THETA, 4), f"{_lines_sql(_SMALL, 4, 3, 2)} SELECT image_id, r, t::INTEGER AS t, votes FROM peaks")
add("hough_line_segments", lambda s, d: hough.lines_p(_points(s, d), _RHO, _THETA, 4, 3, 2), f"{_lines_sql(_SMALL, 4, 3, 2)} SELECT * FROM seg")
add("hough_lines_of_sheet", lambda s, d: hough.lines_p(_on_sheet(s, d), _RHO, _THETA, 8, 6, 8).drop("image_id"), f"{_lines_sql(_LARGE, 8, 6, 8)} SELECT r, t, x1, y1, x2, y2 FROM seg")
# The per-image form counts the same segments.
add("hough_lines_p", queries_shapes.QUERIES["hough_lines_p"], f"{_lines_sql(_SMALL, 4, 3, 2)} SELECT vec_id AS image_id, count(seg.r)::INTEGER AS n FROM embeddings LEFT JOIN seg ON seg.image_id = vec_id GROUP BY vec_id")

# --- circles ------------------------------------------------------------------------------


def _gradients(s: SparkSession, d: str) -> DataFrame:
    return hough.gradient_points(apply_stack(img8(s, d), hough.gradient_stack))


def _gradients_of_sheet(s: SparkSession, d: str) -> DataFrame:
    """Gradients of all tiles, each pixel with its place in the whole image."""
    done = tiles.apply_tiled(tiles.tiles_from_pixels(sheet(s, d), _SIDE), hough.gradient_stack, 3)
    local = hough.gradient_points(done.select("image_id", F.least("side", F.col("h") - F.col("ty") * F.col("side")).alias("h"), F.least("side", F.col("w") - F.col("tx") * F.col("side")).alias("w"), F.struct("h", "w", "ty", "tx", "side").alias("t"), "data").withColumnRenamed("image_id", "i").withColumn("image_id", F.struct("i", "t")))
    return local.select(F.col("image_id.i").alias("image_id"), "image_id.t.h", "image_id.t.w", (F.col("image_id.t.ty") * F.col("image_id.t.side") + F.col("y")).alias("y"), (F.col("image_id.t.tx") * F.col("image_id.t.side") + F.col("x")).alias("x"), "gx", "gy")


def _tap(k: int) -> float:
    g = [math.exp(-(i * i) / 2) for i in range(-2, 3)]
    return g[k] / sum(g)


def _circles_sql(pixels: str, param1: float, param2: float, low: int, high: int, min_dist: float) -> str:
    """``pixels`` is a relation px (image_id, h, w, y, x, v); smoothing repeats the edge, the outer ring has no gradient."""
    blur = lambda of, at, end: " + ".join(f"{_tap(k + 2)!r} * {of}[greatest(1, least({end}, {at} + {k + 1}))]" for k in range(-2, 3))
    return f"""WITH RECURSIVE {pixels},
rows_ AS (SELECT image_id, h, w, y, list(v ORDER BY x) AS l FROM px GROUP BY image_id, h, w, y),
bx AS (SELECT image_id, h, w, y, list_transform(range(w), lambda i: {blur("l", "i", "w")}) AS l FROM rows_),
cols AS (SELECT image_id, h, w, x, list(v ORDER BY y) AS l FROM (SELECT image_id, h, w, y, unnest(range(w)) AS x, unnest(l) AS v FROM bx) GROUP BY image_id, h, w, x),
b AS MATERIALIZED (SELECT image_id, h, w, unnest(range(h)) AS y, x, unnest(list_transform(range(h), lambda i: {blur("l", "i", "h")})) AS v FROM cols),
sx AS MATERIALIZED (SELECT *, lead(v) OVER l - lag(v) OVER l AS dx, lag(v) OVER l + 2 * v + lead(v) OVER l AS mx FROM b WINDOW l AS (PARTITION BY image_id, y ORDER BY x)),
g AS (SELECT image_id, h, w, y, x, lag(dx) OVER l + 2 * dx + lead(dx) OVER l AS gx, lead(mx) OVER l - lag(mx) OVER l AS gy FROM sx WINDOW l AS (PARTITION BY image_id, x ORDER BY y)),
z AS (SELECT *, sqrt(gx * gx + gy * gy) AS size FROM g),
far AS (SELECT image_id, h, w, radius, floor(x + sign * radius * (gx / size) + 0.5)::INTEGER AS cx, floor(y + sign * radius * (gy / size) + 0.5)::INTEGER AS cy
        FROM z, range({low}, {high + 1}) AS q(radius), (VALUES (1), (-1)) AS sg(sign) WHERE size >= {param1 / 2} AND size > 0),
votes AS MATERIALIZED (SELECT image_id, radius::INTEGER AS radius, cy, cx, count(*) AS votes FROM far WHERE cx >= 0 AND cy >= 0 AND cx < w AND cy < h GROUP BY image_id, radius, cy, cx),
around AS MATERIALIZED (SELECT v.*, o.votes AS other FROM votes v, (SELECT unnest([-1, 0, 1]) AS dy) AS a, (SELECT unnest([-1, 0, 1]) AS dx) AS c JOIN votes o ON o.image_id = v.image_id AND o.radius = v.radius AND o.cy = v.cy + dy AND o.cx = v.cx + dx),
peaks AS MATERIALIZED (SELECT image_id, radius, cy, cx, votes FROM around WHERE votes >= {param2} GROUP BY image_id, radius, cy, cx, votes HAVING max(other) <= votes),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY radius, cy, cx) AS k FROM peaks),
greedy(image_id, k, kept) AS (
  SELECT image_id, 1::BIGINT, [struct_pack(radius := radius, cy := cy, cx := cx)] FROM ranked WHERE k = 1
  UNION ALL
  SELECT r.image_id, r.k, CASE WHEN len(list_filter(kept, lambda c: sqrt(pow(c.cx - r.cx, 2) + pow(c.cy - r.cy, 2)) < {min_dist})) > 0 THEN kept ELSE list_append(kept, struct_pack(radius := r.radius, cy := r.cy, cx := r.cx)) END
  FROM greedy g JOIN ranked r ON r.image_id = g.image_id AND r.k = g.k + 1),
circles AS (SELECT image_id, unnest(arg_max(kept, k), recursive := true) FROM greedy GROUP BY image_id)"""


_SMALL_PX = "px AS (SELECT image_id, 8 AS h, 8 AS w, (i // 8) AS y, (i % 8) AS x, v FROM (SELECT vec_id AS image_id, unnest(range(64)) AS i, unnest(list_transform(embedding, lambda e: least(greatest(e::DOUBLE * 0.5 + 0.5, 0), 1))) AS v FROM embeddings))"
_LARGE_PX = f"s{_PX}, ends AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM spx), px AS (SELECT 0::BIGINT AS image_id, h, w, y, x, v FROM spx, ends)"
_ARGS = dict(dp=1, min_dist=2, param1=0.05, param2=2, min_radius=1, max_radius=3)
_SQL = _circles_sql(_SMALL_PX, 0.05, 2, 1, 3, 2)
add("hough_circle_votes", lambda s, d: hough.circle_votes(_gradients(s, d), 0.05, 1, 3), f"{_SQL} SELECT image_id, radius, cy, cx, votes FROM votes")
add("hough_circles_relation", lambda s, d: hough.circles(_gradients(s, d), **_ARGS), f"{_SQL} SELECT image_id, radius, cy, cx FROM circles")
add("hough_circles_of_sheet", lambda s, d: hough.circles(_gradients_of_sheet(s, d), 1, 6, 0.2, 5, 2, 5).drop("image_id"), f"{_circles_sql(_LARGE_PX, 0.2, 5, 2, 5, 6)} SELECT radius, cy, cx FROM circles")
add("hough_circles", queries_shapes.QUERIES["hough_circles"], f"{_SQL} SELECT vec_id AS image_id, count(radius)::INTEGER AS n FROM embeddings LEFT JOIN circles ON circles.image_id = vec_id GROUP BY vec_id")
