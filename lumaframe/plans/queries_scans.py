"""Queries of sequences by prefix scan: the results of the operators that go from row to row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scans
from . import queries_shapes
from .queries_images import add
from .views import frames, table, tracks

add(
    "background_scan", lambda s, d: scans.background_masks(frames(s, d), length=4, fan=3).select(F.col("index").alias("idx"), F.aggregate("data", F.lit(0.0), lambda a, v: a + v).cast("long").alias("foreground")),
    queries_shapes.ORACLES["background_subtractor"],
)


def _filtered(df: DataFrame) -> DataFrame:
    return df.select("track_id", "seq", F.round("position", 6).alias("position"), F.round("speed", 6).alias("speed"))


add("kalman_scan", lambda s, d: _filtered(scans.kalman_tracks(tracks(s, d), length=8, fan=4)), queries_shapes.ORACLES["kalman"])


def _long(s: SparkSession, d: str) -> DataFrame:
    """One track for each type of event, numbered by the events: a few tracks with most of the table each."""
    return table(s, d, "events").select(F.ascii("event_type").cast("long").alias("track_id"), F.col("event_id").cast("int").alias("seq"), F.col("value").alias("z"))


add(
    "kalman_of_long_tracks", lambda s, d: _filtered(scans.kalman_tracks(_long(s, d), length=256, fan=8)),
    """WITH RECURSIVE tr AS MATERIALIZED (SELECT ascii(event_type)::BIGINT AS track_id, event_id::INTEGER AS seq, value AS z, row_number() OVER (PARTITION BY ascii(event_type) ORDER BY event_id) AS k FROM events),
p AS (SELECT track_id, seq, k, z, 0.0::DOUBLE AS x0, 0.0::DOUBLE AS x1, 2.01::DOUBLE AS a, 1.0::DOUBLE AS b, 1.01::DOUBLE AS d FROM tr WHERE k = 1),
u(track_id, seq, k, x0, x1, a, b, d) AS (
  SELECT track_id, seq, k, x0 + a / (a + 0.1) * (z - x0), x1 + b / (a + 0.1) * (z - x0), a - a * a / (a + 0.1), b - a * b / (a + 0.1), d - b * b / (a + 0.1) FROM p
  UNION ALL
  SELECT track_id, seq, k, y0 + a / (a + 0.1) * (z - y0), x1 + b / (a + 0.1) * (z - y0), a - a * a / (a + 0.1), b - a * b / (a + 0.1), d - b * b / (a + 0.1) FROM (
    SELECT tr.track_id, tr.seq, tr.k, tr.z, u.x0 + u.x1 AS y0, u.x1, u.a + 2 * u.b + u.d + 0.01 AS a, u.b + u.d AS b, u.d + 0.01 AS d FROM u JOIN tr ON tr.track_id = u.track_id AND tr.k = u.k + 1))
SELECT track_id, seq, round(x0, 6) AS position, round(x1, 6) AS speed FROM u""",
)
