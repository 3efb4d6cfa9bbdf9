"""Queries of streams with timers and lists: rows that come out of order, and rows that come too late."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import new_folder, written
from ..streaming import ordered, stateful
from . import queries_shapes
from .queries_images import add
from .views import tracks


#: Rows of the table for which a batch gets one more file.
ROWS = 200_000


def _shuffled(s: SparkSession, d: str) -> DataFrame:
    """Tracks as a stream of four batches in which no track is in order; a fifth repeats every fiftieth measurement."""
    folder = new_folder(s, "measurements")
    t = written(tracks(s, d), "tracks")
    files = min(t.count() // ROWS + 1, int(s.conf.get("spark.sql.shuffle.partitions")))
    part = F.pmod(F.xxhash64("track_id", "seq"), F.lit(4))
    for some in (*(part == k for k in range(4)), F.expr("seq % 50 = 0")):
        t.filter(some).repartition(files).write.mode("append").parquet(folder)
    return s.readStream.schema(t.schema).option("maxFilesPerTrigger", files).parquet(folder)


def _results(s: SparkSession, d: str) -> DataFrame:
    return stateful.drained(ordered.ordered_kalman(_shuffled(s, d)))


add(
    "kalman_ordered_stream", lambda s, d: ordered.on_time(_results(s, d)).select("track_id", F.col("seq").cast("int").alias("seq"), F.round("position", 6).alias("position"), F.round("speed", 6).alias("speed")),
    queries_shapes.ORACLES["kalman"],
)
add(
    "late_rows_of_stream", lambda s, d: ordered.late(_results(s, d)),
    "SELECT track_id, seq, z FROM (SELECT user_id AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, value AS z FROM events) WHERE seq % 50 = 0",
)
