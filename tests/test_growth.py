"""Steps that must not grow faster than their input: what is broadcast, how wide numbers get, how many calls a row costs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumaframe.operators import graph, histograms, hough, matching, polygons
from lumaframe.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["hough_line_peaks", "hough_line_segments"])
def test_exploded_rows_are_not_broadcast(spark, name):
    assert "BroadcastExchange" not in plan_of(QUERIES[name](spark, DATA))


def test_circles_are_not_broadcast(spark, monkeypatch):
    plans = []
    real = graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: plans.append(plan_of(df)) or real(df, name))
    plans.append(plan_of(QUERIES["hough_circles_relation"](spark, DATA)))
    assert len(plans) > 2 and not [p for p in plans if "BroadcastExchange" in p]


def test_lines_of_a_very_high_image(spark):
    # 100,000 squared is no int.
    points = spark.createDataFrame([(0, 100_000, 64, y, 5) for y in range(50, 99_000, 9_000)], "image_id long, h int, w int, y int, x int")
    assert hough.line_votes(points, 1.0, np.pi / 36).agg(F.sum("votes")).first()[0] == 36 * points.count()


def test_simplification_of_equal_distances():
    # Of points equally far away the first stays, as in polygons.simplified and the SQL; fused products took another one here.
    p = np.array([[14, 27], [19, 25], [6, 22], [6, 17], [21, 9], [25, 5], [5, 7], [2, 25], [17, 29], [23, 21], [19, 11], [15, 4], [2, 23], [1, 1]], float)
    assert len(matching.approx_poly_dp(p, 5.0)) == 11


def test_otsu_of_mirrored_histograms():
    # Splits after 3 and after 4 part the pixels in mirrored ways; the first stays, whatever the rounding.
    bins = np.array([3] * 4 + [4] * 56 + [5] * 4)
    assert histograms.otsu_level(((bins + 0.5) / 255).reshape(1, 1, 8, 8))[0] == 3


def test_rectangles_take_few_calls(monkeypatch):
    calls = []
    real = np.ptp
    monkeypatch.setattr(np, "ptp", lambda *a, **k: calls.append(1) or real(*a, **k))
    p = np.array([[0, 0], [10, 0], [10, 4], [0, 4], [5, 2]], float)
    assert matching.min_area_rect(p) == {"cx": 5.0, "cy": 2.0, "width": 10.0, "height": 4.0, "angle": 0.0}
    assert not calls  # it measured angle by angle


def test_small_groups_take_no_tree(spark, monkeypatch):
    calls = []
    real = polygons.chain
    monkeypatch.setattr(polygons, "chain", lambda x, y: calls.append(len(x)) or real(x, y))
    rows = spark.range(0, 400, 1, 40).selectExpr("id % 80 AS group_id", "CAST(id * id % 13 AS double) AS x", "CAST(id % 7 AS double) AS y")
    hulls = polygons.convex_hulls(rows)
    assert plan_of(hulls).count("ArrowEvalPython") == 1  # with 40 parts there were three levels
    for r in hulls.collect():
        of = [(i * i % 13, i % 7) for i in range(r["group_id"], 400, 80)]
        assert [(q["x"], q["y"]) for q in r["hull"]] == list(zip(*(c.tolist() for c in real(*np.array(of, float).T)), strict=True))


def test_large_groups_take_the_tree(spark, monkeypatch):
    monkeypatch.setattr(polygons, "FEW", 20)
    monkeypatch.setattr(polygons, "RAW", 2)
    rows = spark.range(0, 4000, 1, 40).selectExpr("CASE WHEN id < 3800 THEN 1 ELSE id END AS group_id", "CAST(id * id % 97 AS double) AS x", "CAST(id * 31 % 89 AS double) AS y")
    hulls = {r["group_id"]: [(q["x"], q["y"]) for q in r["hull"]] for r in polygons.convex_hulls(rows).collect()}
    assert len(hulls) == 201
    i = np.arange(3800)
    assert hulls[1] == list(zip(*(c.tolist() for c in polygons.chain((i * i % 97).astype(float), (i * 31 % 89).astype(float))), strict=True))


def test_short_tracks_take_no_call_each(spark, monkeypatch):
    from lumaframe.operators import scans

    plans = []
    real = scans.written
    monkeypatch.setattr(scans, "written", lambda df, name: plans.append(plan_of(df)) or real(df, name))
    tracks = spark.range(3000).selectExpr("id % 90 AS track_id", "CAST(id / 90 AS int) AS seq", "CAST(id * 7 % 31 AS double) AS z")
    rows = scans.kalman_tracks(tracks, length=4, fan=3).collect()
    assert len(rows) == 3000 and len(plans) > 3 and not [p for p in plans if "FlatMapGroupsInPandas" in p]


def test_stretches_fold_as_rows_combine():
    import pandas as pd

    from lumaframe.operators import scans

    scan, z = scans.KalmanScan(), np.random.default_rng(3).normal(size=40)
    rows = [scan.fold(None, pd.DataFrame({"z": [v]})) for v in z]
    want = rows[0]
    for r in rows[1:]:
        want = scan.combine(want, r)
    assert np.allclose(scan.fold(None, pd.DataFrame({"z": z})), want, rtol=1e-12, atol=1e-12)
    assert np.allclose(scan.fold(scan.fold(None, pd.DataFrame({"z": z[:13]})), pd.DataFrame({"z": z[13:]})), want, rtol=1e-12, atol=1e-12)


def test_block_pairs_are_not_held_as_python_numbers(spark, monkeypatch):
    import tracemalloc

    import pyarrow as pa

    steps = []
    rows = spark.range(4).selectExpr("id AS idx", "array(CAST(id AS double)) AS vec")
    real = type(rows).mapInArrow
    monkeypatch.setattr(type(rows), "mapInArrow", lambda df, f, *a, **k: steps.append(f) or real(df, f, *a, **k))
    matching.match_descriptors(rows, rows)
    ids, data = [list(range(50))] * 16, [np.random.default_rng(1).normal(size=50 * 64)] * 16
    batch = pa.RecordBatch.from_pydict({"q_ids": ids, "q_data": data, "t_ids": ids, "t_data": data})
    tracemalloc.start()
    out = list(steps[0](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 16 and all(o.column("query_idx").equals(o.column("train_idx")) for o in out)
    assert peak < batch.nbytes  # it was several times the batch


def test_shapes_are_matched_without_a_join(spark):
    assert "Join" not in plan_of(QUERIES["match_shapes"](spark, DATA))
