"""Queries of operators over tiles of one image that is as high as its table is long."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters, flooding, tiles
from .queries_images import add
from .views import img8, sheet

_SIDE = 16


def _sheet(s: SparkSession, d: str) -> DataFrame:
    return tiles.tiles_from_pixels(sheet(s, d), _SIDE)


def _pixels(t: DataFrame) -> DataFrame:
    return tiles.pixels_of(t).select("y", "x", F.round("v", 5).alias("v"))


_PX = "px AS (SELECT vec_id AS y, unnest(range(64)) AS x, unnest(list_transform(embedding, lambda e: least(greatest(e::DOUBLE * 0.5 + 0.5, 0), 1))) AS v FROM embeddings)"
_OUT = "CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x"
add(
    "tiled_box_blur", lambda s, d: _pixels(tiles.apply_tiled(_sheet(s, d), filters.box_blur, 2, kernel_size=5)),
    f"WITH {_PX}, r AS (SELECT y, x, sum(v) OVER w AS t, count(*) OVER w AS n FROM px WINDOW w AS (PARTITION BY y ORDER BY x RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING))"
    f" SELECT {_OUT}, round(sum(t) OVER w / sum(n) OVER w, 5) AS v FROM r WINDOW w AS (PARTITION BY x ORDER BY y RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)",
)
# A window wider than a tile: neighbours of neighbours send their margins too.
add(
    "tiled_dilate", lambda s, d: _pixels(tiles.apply_tiled(_sheet(s, d), filters.dilate, 18, kernel_size=37)),
    f"WITH {_PX}, r AS (SELECT y, x, max(v) OVER w AS t FROM px WINDOW w AS (PARTITION BY y ORDER BY x RANGE BETWEEN 18 PRECEDING AND 18 FOLLOWING))"
    f" SELECT {_OUT}, round(max(t) OVER w, 5) AS v FROM r WINDOW w AS (PARTITION BY x ORDER BY y RANGE BETWEEN 18 PRECEDING AND 18 FOLLOWING)",
)

_LIMIT = 0.52
_REACH = f"""WITH RECURSIVE {_PX}, f AS MATERIALIZED (SELECT y, x, y * 64 + x + 1 AS p FROM px WHERE v > {_LIMIT}),
e AS MATERIALIZED (SELECT a.p, b.p AS q FROM f a JOIN f b ON b.x = a.x AND b.y = a.y + 1 UNION ALL SELECT a.p, b.p FROM f a JOIN f b ON b.y = a.y AND b.x = a.x + 1),
b AS MATERIALIZED (SELECT p, q FROM e UNION ALL SELECT q, p FROM e),
r(p, q) AS (SELECT p, p FROM f UNION SELECT r.p, b.q FROM r JOIN b ON r.q = b.p),
lab AS (SELECT p, min(q) AS label FROM r GROUP BY p)"""
add(
    "tiled_components", lambda s, d: tiles.pixels_of(tiles.label_tiles(_sheet(s, d), _LIMIT)).select("y", "x", F.col("v").cast("long").alias("label")),
    f"{_REACH} SELECT {_OUT}, CAST(coalesce(label, 0) AS BIGINT) AS label FROM px LEFT JOIN lab ON p = y * 64 + x + 1",
)
add(
    "tiled_component_stats", lambda s, d: tiles.tile_component_stats(tiles.label_tiles(_sheet(s, d), _LIMIT)).select("label", "x", "y", "width", "height", "area", F.round("cx", 4).alias("cx"), F.round("cy", 4).alias("cy")),
    f"{_REACH} SELECT label, CAST(min(x) AS INTEGER) AS x, CAST(min(y) AS INTEGER) AS y, CAST(max(x) - min(x) + 1 AS INTEGER) AS width, CAST(max(y) - min(y) + 1 AS INTEGER) AS height, count(*) AS area, round(avg(x), 4) AS cx, round(avg(y), 4) AS cy FROM lab JOIN f USING (p) GROUP BY label",
)

# --- watershed ----------------------------------------------------------------------------

#: Every pixel whose number, moved on by the image, is a multiple of 16 is a marker.
_MARKER = "(i * 7 + image_id) % 16 = 0"


def _marked(s: SparkSession, d: str) -> DataFrame:
    """Small images with their markers as a second channel, cut into tiles so that basins spill across."""
    i = img8(s, d)
    marks = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when((i * 7 + F.col("image_id")) % 16 == 0, i + 1).otherwise(0).cast("double"))
    return tiles.tiles_of(i.select("image_id", F.lit(2).alias("c"), "h", "w", F.concat("data", marks).alias("data")), 3)


add(
    "watershed_tiles", lambda s, d: tiles.pixels_of(flooding.watershed_tiles(_marked(s, d))).select("image_id", "y", "x", F.col("v").cast("long").alias("label")),
    f"""WITH RECURSIVE px AS MATERIALIZED (SELECT vec_id AS image_id, list_transform(embedding, lambda e: least(greatest(e::DOUBLE * 0.5 + 0.5, 0), 1)) AS v FROM embeddings),
edge AS MATERIALIZED (SELECT i AS p, i + 1 AS q, 0 AS down FROM range(64) AS r(i) WHERE i % 8 < 7 UNION ALL SELECT i, i + 8, 1 FROM range(56) AS r(i)),
f(image_id, v, l) AS (
  SELECT image_id, v, list_transform(range(64), lambda i: CASE WHEN {_MARKER} THEN i + 1 ELSE 0 END) FROM px
  UNION ALL
  SELECT image_id, v, list_transform(range(64), lambda i: CASE WHEN i = best.dry THEN l[best.wet + 1] ELSE l[i + 1] END)
  FROM (SELECT image_id, any_value(v) AS v, any_value(l) AS l, min(struct_pack(high := greatest(v[p + 1], v[q + 1]), low := least(v[p + 1], v[q + 1]), p := p, down := down,
          dry := CASE WHEN l[p + 1] = 0 THEN p ELSE q END, wet := CASE WHEN l[p + 1] = 0 THEN q ELSE p END)) AS best
        FROM f, edge WHERE (l[p + 1] = 0) <> (l[q + 1] = 0) GROUP BY image_id)),
done AS (SELECT image_id, l FROM f WHERE len(list_filter(l, lambda e: e = 0)) = 0)
SELECT image_id, (i // 8)::INTEGER AS y, (i % 8)::INTEGER AS x, label FROM (SELECT image_id, unnest(range(64)) AS i, unnest(l) AS label FROM done)""",
)
