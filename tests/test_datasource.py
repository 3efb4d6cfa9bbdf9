"""Frame folders and flat floats as data sources; streams of tracks out of order."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumaframe.operators import tracking
from lumaframe.sources import datasource
from lumaframe.streaming import ordered, stateful

FRAME = "video_id long, `index` long, c int, h int, w int, data array<double>"


def frames_of(spark, *places):
    rng = np.random.default_rng(1)
    return spark.createDataFrame([(v, i, 3, 4, 5, (rng.integers(0, 256, 60) / 255).tolist()) for v, i in places], FRAME)


def read(spark, folder, **options):
    return {(r["video_id"], r["index"]): r["data"] for r in spark.read.format("frame_folder").options(path=folder, **options).load().collect()}


@pytest.mark.parametrize("kind", ["png", "qoi"])
def test_frames_round_trip(spark, tmp_path, kind):
    datasource.register(spark)
    folder = str(tmp_path / "f")
    df = frames_of(spark, *[(0, i) for i in range(9)], (-2, 0), (7, 10**11)).repartition(4).persist()
    df.write.format("frame_folder").options(path=folder, kind=kind).mode("append").save()
    want = {(r["video_id"], r["index"]): np.floor(np.array(r["data"]) * 255) / 255 for r in df.collect()}
    got = read(spark, folder, frames_per_partition=2)
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    assert read(spark, folder, start=3, end=5).keys() == {(0, 3), (0, 4)}
    assert spark.read.format("frame_folder").options(path=folder, frames_per_partition=2).load().rdd.getNumPartitions() == 6
    assert sorted(os.listdir(folder)) == sorted(datasource.frame_names(folder))  # nothing is left aside
    # Overwriting leaves only what was written; appending replaces frames of the same name.
    frames_of(spark, (0, 1), (0, 20)).write.format("frame_folder").options(path=folder, kind=kind).mode("overwrite").save()
    assert read(spark, folder).keys() == {(0, 1), (0, 20)}
    assert datasource.is_opened(folder) and not datasource.is_opened(f"{folder}/none")


def test_a_write_that_fails_leaves_nothing(spark, tmp_path):
    datasource.register(spark)
    folder = str(tmp_path / "f")
    good = frames_of(spark, *[(0, i) for i in range(6)])
    good.write.format("frame_folder").option("path", folder).mode("append").save()
    before = read(spark, folder)
    bad = frames_of(spark, *[(1, i) for i in range(40)]).withColumn("h", F.when(F.col("index") == 37, 3).otherwise(F.col("h"))).repartition(4)
    twice = frames_of(spark, (2, 5), (2, 5))
    for df in (bad, twice):
        with pytest.raises(Exception):
            df.write.format("frame_folder").option("path", folder).mode("append").save()
        assert read(spark, folder) == before and sorted(os.listdir(folder)) == sorted(datasource.frame_names(folder))
    for options in ({"start": -1}, {"frames_per_partition": 0}, {"fps": 0}):
        with pytest.raises(Exception):
            spark.read.format("frame_folder").options(path=folder, **options).load().count()


def test_a_camera_is_read_as_it_goes_on(spark, tmp_path):
    datasource.register(spark)
    folder, table, checkpoint = (str(tmp_path / k) for k in ("camera", "table", "checkpoint"))
    seen = []
    for some in ([0, 1, 2], [3], [], [4, 5]):
        frames_of(spark, *[(0, i) for i in some]).write.format("frame_folder").option("path", folder).mode("append").save()
        stream = spark.readStream.format("frame_folder").option("path", folder).load()
        stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).format("parquet").option("path", table).start().awaitTermination(60)
        seen += some
        assert sorted(r["index"] for r in spark.read.parquet(table).select("index").collect()) == seen


def test_flat_floats(spark, tmp_path):
    datasource.register(spark)
    a, b = np.arange(70, dtype="<f4").reshape(10, 7), np.arange(14, dtype="<f4").reshape(2, 7) / 3
    (tmp_path / "a.bin").write_bytes(a.tobytes())
    (tmp_path / "b.bin").write_bytes(b.tobytes())
    df = spark.read.format("flat_floats").options(path=str(tmp_path), columns=7, bytes_per_partition=60).load()
    got = {(r["file"], r["row"]): r["data"] for r in df.collect()}
    assert df.rdd.getNumPartitions() == 6 and len(got) == 12
    assert all(np.allclose(got["a.bin", k], a[k]) for k in range(10)) and all(np.allclose(got["b.bin", k], b[k]) for k in range(2))
    with pytest.raises(Exception):
        spark.read.format("flat_floats").options(path=str(tmp_path), columns=3).load().count()


# --- streams out of order ---------------------------------------------------------------------


def stream_of(spark, folder, batches):
    for rows in batches:
        spark.createDataFrame(rows, "track_id long, seq long, z double").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema("track_id long, seq long, z double").option("maxFilesPerTrigger", 1).parquet(folder)


def test_order_is_restored_across_batches(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(t, s, float(rng.normal())) for t in (1, 2) for s in range(1, 31)]
    mixed = [rows[i] for i in rng.permutation(len(rows))]
    late = [mixed[3], (1, 0, 9.0)]
    out = stateful.drained(ordered.ordered_kalman(stream_of(spark, str(tmp_path / "in"), [mixed[:20], mixed[20:45], mixed[45:], late])))
    want = {(r["track_id"], r["seq"]): (r["position"], r["speed"]) for r in tracking.kalman_tracks(spark.createDataFrame(rows, "track_id long, seq int, z double")).collect()}
    got = {(r["track_id"], r["seq"]): (r["position"], r["speed"]) for r in ordered.on_time(out).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    assert sorted(map(tuple, ordered.late(out).collect())) == sorted(late)


def test_tracks_go_on_from_an_initial_state(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(1, s, float(rng.normal())) for s in range(1, 21)]
    k = tracking.velocity_filter()
    for _, _, z in rows[:10]:
        k.predict()
        k.update([z])
    held = spark.createDataFrame([(1, 10, k.x.tolist(), k.p.ravel().tolist())], f"track_id long, {ordered.STATE}")
    out = stateful.drained(ordered.ordered_kalman(stream_of(spark, str(tmp_path / "in"), [rows[15:], rows[8:15]]), initial=held))
    want = {r["seq"]: r["position"] for r in tracking.kalman_tracks(spark.createDataFrame(rows, "track_id long, seq int, z double")).collect()}
    got = {r["seq"]: r["position"] for r in ordered.on_time(out).collect()}
    assert got.keys() == set(range(11, 21)) and all(np.isclose(got[s], want[s]) for s in got)
    assert {r["seq"] for r in ordered.late(out).collect()} == {9, 10}
    assert [tuple(r) for r in ordered.states(out).collect()] == [(1, 20)]


def test_a_timer_passes_over_gaps(spark, tmp_path):
    folder, table = str(tmp_path / "in"), str(tmp_path / "table")
    stream = stream_of(spark, folder, [[(1, 1, 1.0), (1, 3, 3.0), (1, 4, 4.0)]])
    query = ordered.ordered_kalman(stream, patience=500, ttl=3_600_000).writeStream.option("checkpointLocation", str(tmp_path / "c")).format("parquet").option("path", table).start()

    def seen():
        try:
            return {(r["seq"], r["late"]) for r in spark.read.parquet(table).collect()}
        except Exception:  # nothing is written yet
            return set()

    def until(want):
        end = time.time() + 60
        while seen() != want and time.time() < end:
            time.sleep(0.5)
        return seen()

    try:
        assert until({(1, False), (3, False), (4, False)}) == {(1, False), (3, False), (4, False)}
        spark.createDataFrame([(1, 2, 2.0), (1, 5, 5.0)], "track_id long, seq long, z double").coalesce(1).write.mode("append").parquet(folder)
        assert until({(1, False), (3, False), (4, False), (2, True), (5, False)}) == {(1, False), (3, False), (4, False), (2, True), (5, False)}
    finally:
        query.stop()


def test_waiting_rows_are_read_only_when_a_turn_comes():
    """Rows that wait are neither read nor written again by rows before whose turn others must come."""

    class Held:
        def __init__(self):
            self.value, self.rows, self.moved = None, [], 0

        def get(self):
            self.moved += len(self.rows)
            return self.value if self.value is not None else iter(self.rows) if self.rows else None

        def update(self, value):
            self.value = value

        def exists(self):
            return bool(self.rows or self.value)

        def put(self, rows):
            self.rows, self.moved = list(rows), self.moved + len(rows)

        def appendList(self, rows):
            self.rows, self.moved = self.rows + list(rows), self.moved + len(rows)

        def clear(self):
            self.rows = []

    p = ordered.OrderedKalman(None, None, 1)
    p.state, p.waiting = Held(), Held()
    said = []
    for first in (*range(91, 1, -10), 1):
        said += p.handleInputRows((7,), iter([{"seq": s, "z": float(s)} for s in range(first, first + 10)]), None)
    assert [r["seq"] for r in said] == list(range(1, 101)) and not any(r["late"] for r in said) and not p.waiting.rows
    assert p.waiting.moved == 18  # each of nine batches of waiting rows written once and read once
