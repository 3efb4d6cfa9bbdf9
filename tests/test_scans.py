"""Prefix scans against one pass from row to row."""

import numpy as np
import pytest

from lumaframe.operators import scans, tracking
from lumaframe.schema import InvalidParameter

FRAME = "video_id long, `index` long, c int, h int, w int, data array<double>"


@pytest.mark.parametrize("length,fan", [(1, 2), (3, 2), (5, 4), (1000, 64)])
def test_background_of_long_videos(spark, length, fan):
    rng = np.random.default_rng(1)
    rows = [(v, i, c, 3, 4, rng.random(c * 12).round(3).tolist()) for v, n, c in ((0, 41, 1), (1, 1, 1), (2, 17, 3)) for i in rng.permutation(200)[:n].tolist()]
    df = spark.createDataFrame(rows, FRAME).repartition(5)
    key = lambda r: (r["video_id"], r["index"])
    want = {key(r): r["data"] for r in tracking.background_masks(df).collect()}
    got = {key(r): r["data"] for r in scans.background_masks(df, length=length, fan=fan).collect()}
    assert got == want


@pytest.mark.parametrize("length,fan", [(1, 2), (7, 3), (10_000, 64)])
def test_kalman_of_long_tracks(spark, length, fan):
    rng = np.random.default_rng(2)
    rows = [(t, s, float(rng.normal() * 50)) for t, n in ((5, 300), (6, 1), (7, 40)) for s in rng.permutation(900)[:n].tolist()]
    df = spark.createDataFrame(rows, "track_id long, seq int, z double").repartition(6)
    want = {(r["track_id"], r["seq"]): (r["position"], r["speed"]) for r in tracking.kalman_tracks(df).collect()}
    got = {(r["track_id"], r["seq"]): (r["position"], r["speed"]) for r in scans.kalman_tracks(df, length=length, fan=fan).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-8) for k in want)


def test_elements_combine_in_any_order():
    import pandas as pd

    rng = np.random.default_rng(3)
    scan = scans.KalmanScan()
    parts = [scan.fold(None, pd.DataFrame({"z": rng.normal(size=n)})) for n in (1, 4, 2, 7)]
    left = scan.combine(scan.combine(scan.combine(parts[0], parts[1]), parts[2]), parts[3])
    right = scan.combine(parts[0], scan.combine(parts[1], scan.combine(parts[2], parts[3])))
    assert np.allclose(left, right)


def test_scans_of_nothing(spark):
    none = spark.createDataFrame([], "track_id long, seq int, z double")
    assert scans.kalman_tracks(none).count() == 0
    odd = spark.createDataFrame([(1, 1, None), (1, None, 2.0), (None, 1, 2.0), (1, 5, 2.0), (1, 6, float("nan"))], "track_id long, seq int, z double")
    assert [r["seq"] for r in scans.kalman_tracks(odd).collect()] == [5]
    with pytest.raises(InvalidParameter):
        scans.kalman_tracks(none, length=0)
