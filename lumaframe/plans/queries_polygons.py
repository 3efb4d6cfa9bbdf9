"""Queries of point relations: hulls, rectangles, simplification, nesting, suppression in large groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import shapes
from ..operators import matching, polygons
from . import oracles as O
from . import oracles_edges
from . import queries_shapes  # the per-polygon forms, some of which get their SQL here
from .queries_images import add
from .views import boxes, polys, table

# --- hulls --------------------------------------------------------------------------------


def _large(s: SparkSession, d: str) -> DataFrame:
    """Few groups with most of the table each: lines by their flags."""
    li = table(s, d, "lineitem")
    group = F.ascii("l_returnflag") * 1000 + F.ascii("l_linestatus")
    return li.select(group.cast("long").alias("group_id"), F.col("l_quantity").alias("x"), F.round(F.col("l_extendedprice") / 1000).alias("y"))


_LARGE = "pt AS (SELECT (ascii(l_returnflag) * 1000 + ascii(l_linestatus))::BIGINT AS group_id, l_quantity AS x, round(l_extendedprice / 1000) AS y FROM lineitem)"
_SMALL = f"{O.POLYS}, pt AS (SELECT group_id, x, y FROM pl)"


def _hull_sql(points: str) -> str:
    """A corner begins an edge that no point lies to the right of or beyond; only the ends of a column can be corners."""
    return f"""WITH {points}, c AS MATERIALIZED (SELECT DISTINCT group_id, x, unnest([min(y), max(y)]) AS y FROM pt GROUP BY group_id, x),
he AS MATERIALIZED (SELECT a.group_id, a.x, a.y, b.x AS nx, b.y AS ny FROM c a JOIN c b ON a.group_id = b.group_id AND (a.x <> b.x OR a.y <> b.y)
  WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.group_id = a.group_id AND ((b.x - a.x) * (o.y - a.y) - (b.y - a.y) * (o.x - a.x) < 0
    OR (b.x - a.x) * (o.y - a.y) - (b.y - a.y) * (o.x - a.x) = 0 AND (o.x - a.x) * (b.x - a.x) + (o.y - a.y) * (b.y - a.y) > pow(b.x - a.x, 2) + pow(b.y - a.y, 2)
    OR (b.x - a.x) * (o.y - a.y) - (b.y - a.y) * (o.x - a.x) = 0 AND (o.x - a.x) * (b.x - a.x) + (o.y - a.y) * (b.y - a.y) < 0))),
corner AS MATERIALIZED (SELECT group_id, x, y FROM he UNION SELECT group_id, x, y FROM c QUALIFY count(*) OVER (PARTITION BY group_id) = 1)"""


def _corners(p: DataFrame) -> DataFrame:
    return polygons.convex_hulls(p).select("group_id", F.explode("hull").alias("p")).select("group_id", "p.x", "p.y")


add("hull_corners", lambda s, d: _corners(polys(s, d)), f"{_hull_sql(_SMALL)} SELECT group_id, x, y FROM corner")
add("hull_corners_of_large_groups", lambda s, d: _corners(_large(s, d)), f"{_hull_sql(_LARGE)} SELECT group_id, x, y FROM corner")
add(
    "hull_areas", lambda s, d: polygons.convex_hulls(polys(s, d)).select("group_id", F.size("hull").alias("n"), F.round(F.when(F.size("hull") > 2, shapes.contour_area(F.col("hull"))).otherwise(0.0), 4).alias("area")),
    f"{_hull_sql(_SMALL)} SELECT corner.group_id, count(*)::INTEGER AS n, round(coalesce(any_value(a.area), 0), 4) AS area FROM corner LEFT JOIN (SELECT group_id, sum(x * ny - nx * y) / 2 AS area FROM he GROUP BY group_id) a ON a.group_id = corner.group_id GROUP BY corner.group_id",
)
_RECTS = """, turn AS (SELECT he.group_id, he.x AS ex, he.y AS ey, nx - he.x AS dx, ny - he.y AS dy, sqrt(pow(nx - he.x, 2) + pow(ny - he.y, 2)) AS n, corner.x, corner.y FROM he JOIN corner ON corner.group_id = he.group_id),
ext AS (SELECT group_id, max((x * dx + y * dy) / n) - min((x * dx + y * dy) / n) AS a, max((y * dx - x * dy) / n) - min((y * dx - x * dy) / n) AS b FROM turn GROUP BY group_id, ex, ey, dx, dy, n),
best AS (SELECT group_id, min(struct_pack(area := round(a * b, 4), l := round(greatest(a, b), 4), w := round(least(a, b), 4))) AS m FROM ext GROUP BY group_id)
SELECT group_id, coalesce(m.area, 0) + 0 AS area FROM (SELECT DISTINCT group_id FROM corner) LEFT JOIN best USING (group_id)"""


def _areas(p: DataFrame) -> DataFrame:
    return polygons.smallest_rects(polygons.convex_hulls(p)).select("group_id", (F.round("area", 4) + 0).alias("area"))


add("smallest_rects", lambda s, d: _areas(polys(s, d)), _hull_sql(_SMALL) + _RECTS)
add("smallest_rects_of_large_groups", lambda s, d: _areas(_large(s, d)), _hull_sql(_LARGE) + _RECTS)

# --- simplification -----------------------------------------------------------------------


def _simplify_sql(points: str, epsilon: float) -> str:
    """``points`` is a relation pt (group_id, seq, x, y)."""
    return f"""WITH RECURSIVE {points},
st(group_id, a, b) AS (
  SELECT group_id, min(struct_pack(seq := seq, x := x, y := y)), max(struct_pack(seq := seq, x := x, y := y)) FROM pt GROUP BY group_id
  UNION ALL
  SELECT group_id, unnest([a, m.k]), unnest([m.k, b]) FROM (
    SELECT group_id, a, b, max(struct_pack(d := d, back := -seq, k := struct_pack(seq := seq, x := x, y := y))) AS m FROM (
      SELECT q.*, pt.seq, pt.x, pt.y, sqrt(pow(pt.x - q.a.x - t * q.dx, 2) + pow(pt.y - q.a.y - t * q.dy, 2)) AS d FROM (
        SELECT w.*, s.seq AS at, least(greatest(((s.x - w.a.x) * w.dx + (s.y - w.a.y) * w.dy) / greatest(w.dx * w.dx + w.dy * w.dy, 1e-12), 0), 1) AS t
        FROM (SELECT group_id, a, b, b.x - a.x AS dx, b.y - a.y AS dy FROM st) w JOIN pt s ON s.group_id = w.group_id AND s.seq > w.a.seq AND s.seq < w.b.seq) q
      JOIN pt ON pt.group_id = q.group_id AND pt.seq = q.at) GROUP BY group_id, a, b HAVING max(d) > {epsilon})),
kept AS (SELECT DISTINCT group_id, e.seq AS seq, e.x AS x, e.y AS y FROM (SELECT group_id, unnest([a, b]) AS e FROM st))"""


def _walks(s: SparkSession, d: str) -> DataFrame:
    """The path of each type of event through the day: few long lines."""
    e = table(s, d, "events")
    return e.select(F.ascii("event_type").cast("long").alias("group_id"), F.col("event_id").alias("seq"), (F.col("event_id") / 10).alias("x"), F.round("value", 6).alias("y"))


_WALKS = "pt AS (SELECT ascii(event_type)::BIGINT AS group_id, event_id AS seq, event_id / 10 AS x, round(value, 6) AS y FROM events)"
_SMALL_SEQ = f"{O.POLYS}, pt AS (SELECT group_id, seq, x, y FROM pl)"
add("simplified_polygons", lambda s, d: polygons.simplified(polys(s, d), 5.0).select("group_id", F.col("seq").cast("int").alias("seq")), f"{_simplify_sql(_SMALL_SEQ, 5.0)} SELECT group_id, seq::INTEGER AS seq FROM kept")
add("simplified_walks", lambda s, d: polygons.simplified(_walks(s, d), 60.0), f"{_simplify_sql(_WALKS, 60.0)} SELECT group_id, seq, x, y FROM kept")
add("approx_poly_dp", queries_shapes.QUERIES["approx_poly_dp"], f"{_simplify_sql(_SMALL_SEQ, 5.0)} SELECT group_id, count(*)::INTEGER AS n FROM kept GROUP BY group_id")

# --- nesting ------------------------------------------------------------------------------


def _contours(s: SparkSession, d: str) -> DataFrame:
    """Polygons as the contours of fifty images."""
    p = polys(s, d).groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("p"))
    return p.select((F.col("group_id") % 50).alias("image_id"), F.col("group_id").alias("contour_id"), F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("points"))


add(
    "contour_nesting", lambda s, d: polygons.nesting(_contours(s, d)),
    f"""WITH {O.POLYS}, c AS MATERIALIZED (SELECT group_id % 50 AS image_id, group_id AS contour_id, sum(x ORDER BY seq) / count(*) AS mx, sum(y ORDER BY seq) / count(*) AS my, abs(sum(x * ny - nx * y)) / 2 AS area, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM edge GROUP BY group_id),
near AS MATERIALIZED (SELECT a.image_id, a.contour_id, a.mx, a.my, b.contour_id AS outer_id, b.area FROM c a JOIN c b ON a.image_id = b.image_id AND a.contour_id <> b.contour_id AND b.area > a.area AND a.mx BETWEEN b.x0 AND b.x1 AND a.my BETWEEN b.y0 AND b.y1),
held AS (SELECT near.image_id, near.contour_id, outer_id, any_value(area) AS area FROM near JOIN edge ON edge.group_id = outer_id WHERE (y > my) <> (ny > my) AND mx < (nx - x) * (my - y) / (ny - y + 1e-9) + x GROUP BY near.image_id, near.contour_id, outer_id HAVING count(*) % 2 = 1),
best AS (SELECT image_id, contour_id, min(struct_pack(area := area, id := outer_id)) AS m FROM held GROUP BY image_id, contour_id)
SELECT image_id, contour_id, coalesce(m.id, -1) AS parent FROM c LEFT JOIN best USING (image_id, contour_id)""",
)

# --- suppression --------------------------------------------------------------------------

_NMS = queries_shapes.ORACLES["nms_boxes"]
add("suppressed_boxes", lambda s, d: matching.suppressed_boxes(boxes(s, d), 0.2, 0.05), f"SELECT group_id, seq FROM ({_NMS})")

# --- the per-polygon and per-image forms get their SQL ---------------------------------------

for _name, _sql in (oracles_edges.hull_of_polygons(_hull_sql(_SMALL)) | oracles_edges.EDGES).items():
    add(_name, queries_shapes.QUERIES[_name], _sql)
