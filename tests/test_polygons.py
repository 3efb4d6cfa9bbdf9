"""Point relations: hulls, rectangles, simplification, nesting and suppression against forms that hold a whole group."""

import math
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from lumaframe.operators import matching, polygons, segmentation
from lumaframe.schema import InvalidParameter

POINT = "group_id long, seq int, x double, y double"


def points_of(spark, groups, parts=5):
    rows = [(g, i, float(x), float(y)) for g, pts in groups.items() for i, (x, y) in enumerate(pts)]
    return spark.createDataFrame(rows, POINT).repartition(parts)


def corners(pts):
    """Points that no other lies to the right of, seen along some edge from them."""
    pts = sorted(set(map(tuple, pts)))
    if len(pts) == 1:
        return set(pts)
    out = set()
    for a in pts:
        for b in pts:
            if a == b:
                continue
            d = (b[0] - a[0], b[1] - a[1])
            side = [(d[0] * (c[1] - a[1]) - d[1] * (c[0] - a[0]), d[0] * (c[0] - a[0]) + d[1] * (c[1] - a[1])) for c in pts]
            if all(s > 0 or s == 0 and 0 <= t <= d[0] ** 2 + d[1] ** 2 for s, t in side):
                out.add(a)
    return out


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(2)
    out = {k: rng.integers(0, 9, (30, 2)).tolist() for k in range(5)}
    out |= {10: [(1, 1)] * 6, 11: [(k, 2 * k) for k in range(7)], 12: [(0, 0), (4, 0), (4, 4), (0, 4), (2, 2), (2, 0)], 13: [(3, k) for k in range(5)], 14: [(5, 6)]}
    return out


@pytest.mark.parametrize("fan_in", [2, 16])
def test_hulls_are_merged_in_a_tree(spark, groups, monkeypatch, fan_in):
    monkeypatch.setattr(polygons, "FAN_IN", fan_in)
    got = {r["group_id"]: [(p["x"], p["y"]) for p in r["hull"]] for r in polygons.convex_hulls(points_of(spark, groups, 9)).collect()}
    assert got.keys() == groups.keys()
    for g, pts in groups.items():
        assert set(got[g]) == corners(pts) and len(got[g]) == len(set(got[g])), g
        if len(got[g]) > 2:  # counter-clockwise
            x, y = np.array(got[g]).T
            assert (x * np.roll(y, -1) - np.roll(x, -1) * y).sum() > 0


def test_hulls_of_nothing(spark):
    assert polygons.convex_hulls(points_of(spark, {})).count() == 0
    odd = spark.createDataFrame([(1, 0, None, 1.0), (1, 0, float("nan"), 1.0), (None, 0, 1.0, 1.0), (2, 0, 1.0, 2.0)], POINT)
    assert [tuple(r) for r in polygons.convex_hulls(odd).selectExpr("group_id", "size(hull) AS n").collect()] == [(2, 1)]


def test_smallest_rects(spark, groups):
    got = {r["group_id"]: r for r in polygons.smallest_rects(polygons.convex_hulls(points_of(spark, groups))).collect()}
    for g, pts in groups.items():
        hull = list(corners(pts))
        p = np.array(pts, float)
        best = 0.0 if len(hull) < 3 else math.inf
        for a in hull:
            for b in hull:
                if len(hull) > 2 and a != b:
                    d = np.array(b) - a
                    d = d / np.hypot(*d)
                    best = min(best, np.ptp(p @ d) * np.ptp(p @ np.array([-d[1], d[0]])))  # a superset of the edges; none gives less
        assert math.isclose(got[g]["area"], best, abs_tol=1e-6), g
        assert math.isclose(got[g]["length"] * got[g]["breadth"], got[g]["area"], abs_tol=1e-5) and 0 <= got[g]["angle"] < 90
    turned = [(math.cos(0.3) * x - math.sin(0.3) * y, math.sin(0.3) * x + math.cos(0.3) * y) for x, y in ((0, 0), (5, 0), (5, 2), (0, 2))]
    r = polygons.smallest_rects(polygons.convex_hulls(points_of(spark, {1: turned}))).first()
    assert np.allclose([r["area"], r["length"], r["breadth"]], [10, 5, 2]) and math.isclose(r["angle"], math.degrees(0.3), abs_tol=1e-6)


@pytest.mark.parametrize("epsilon", [0.0, 0.7, 2.5, 100.0])
def test_simplified_level_by_level(spark, epsilon):
    rng = np.random.default_rng(4)
    lines = {g: np.column_stack([np.arange(n), rng.normal(size=n).cumsum()]).tolist() for g, n in ((1, 60), (2, 2), (3, 1), (4, 3), (5, 25))}
    lines[6] = [(0, 0), (1, 1), (0, 0), (1, 1), (0, 0)]  # ends that are equal
    got = {}
    for r in polygons.simplified(points_of(spark, lines), epsilon).collect():
        got.setdefault(r["group_id"], []).append((r["seq"], r["x"], r["y"]))
    for g, pts in lines.items():
        want = matching.approx_poly_dp(np.array(pts, float), epsilon)
        assert np.array_equal(np.array(sorted(got[g]))[:, 1:], want), g
    with pytest.raises(InvalidParameter):
        polygons.simplified(points_of(spark, lines), -1)


def test_nesting_is_that_of_traced_contours(spark):
    a = np.zeros((40, 40))
    for lo, hi, v in ((2, 38, 1), (5, 20, 0), (8, 17, 1), (10, 14, 0), (24, 34, 0), (27, 30, 1)):
        a[lo:hi, lo:hi] = v
    found = segmentation.contour_hierarchy(a[None])
    rows = [(i, k, [(float(p["x"]), float(p["y"])) for p in c["points"]]) for i in (0, 3) for k, c in enumerate(found)]
    df = spark.createDataFrame([(i, k, [{"x": x, "y": y} for x, y in pts]) for i, k, pts in rows], "image_id long, contour_id long, points array<struct<x:double,y:double>>")
    got = {(r["image_id"], r["contour_id"]): r["parent"] for r in polygons.nesting(df).collect()}
    assert got == {(i, k): c["parent"] for i in (0, 3) for k, c in enumerate(found)} and any(c["parent"] >= 0 for c in found)


def test_one_huge_box_meets_each_once(spark):
    """A huge box makes no more candidates than it has boxes under it: all others still meet by small cells."""
    rng = np.random.default_rng(1)
    n = 1500
    rows = [(1, k, int(x), int(y), 4, 4, float(s)) for k, (x, y, s) in enumerate(zip(rng.integers(0, 4000, n), rng.integers(0, 4000, n), rng.random(n), strict=True))]
    rows.append((1, n, 0, 0, 4100, 4100, 0.5))
    df = spark.createDataFrame(rows, "group_id long, seq int, x long, y long, width long, height long, score double")
    met = [(r["seq_a"], r["seq_b"]) for r in matching._met_boxes(df).collect()]
    assert len(met) == len(set(met)) and all(a < b for a, b in met)
    assert sum(b == n for _, b in met) == n and len(met) < 2 * n
    pairs = {(r["seq_a"], r["seq_b"]) for r in matching.iou_pairs(df, 0.01).collect()}
    over = lambda a, b: max(0, min(a[2], b[2]) + 4 - max(a[2], b[2])) * max(0, min(a[3], b[3]) + 4 - max(a[3], b[3]))
    assert pairs == {(a[1], b[1]) for a in rows[:n] for b in rows[:n] if a[1] < b[1] and over(a, b) / (32 - over(a, b)) >= 0.01}


def test_suppression_of_one_large_group(spark):
    rng = np.random.default_rng(3)
    rows = [(7, k, int(x), int(y), int(w), int(h), round(float(s), 2)) for k, (x, y, w, h, s) in enumerate(zip(*rng.integers(0, 120, (2, 400)), *rng.integers(1, 40, (2, 400)), rng.random(400), strict=True))]
    df = spark.createDataFrame(rows, "group_id long, seq int, x long, y long, width long, height long, score double")
    for threshold in (0.0, 0.3):
        want = {(r["group_id"], r["seq"]) for r in matching.nms_boxes(df, 0.2, threshold).collect()}
        assert {tuple(r) for r in matching.suppressed_boxes(df, 0.2, threshold).collect()} == want


def test_nesting_of_one_crowded_image(spark):
    """Contours of one cell: each middle meets the contours up to its parent, over the ends of blocks and tasks."""
    rng = np.random.default_rng(8)
    pts = {k: rng.integers(0, 60, (int(rng.integers(1, 7)), 2)).astype(float) for k in range(1200)}
    pts |= {2000 + k: np.array([[0, 0], [k, 0], [k, 64], [0, 64]], float) for k in (61, 62, 63)} | {3000 + k: pts[k] for k in range(50)}
    df = spark.createDataFrame([(1, k, [{"x": x, "y": y} for x, y in p.tolist()]) for k, p in pts.items()] + [(1, 5000, None), (1, 5001, [])], "image_id long, contour_id long, points array<struct<x:double,y:double>>")
    area = lambda p: abs(float((p[:, 0] * np.roll(p[:, 1], -1) - np.roll(p[:, 0], -1) * p[:, 1]).sum())) / 2
    order = sorted(pts, key=lambda k: (area(pts[k]), k))

    def holds(p, x, y):
        a, b = p[:, 0], p[:, 1]
        c, d = np.roll(a, -1), np.roll(b, -1)
        crossed = ((b > y) != (d > y)) & (x < (c - a) * (y - b) / (d - b + 1e-9) + a)
        return crossed.sum() % 2 == 1 and a.min() <= x <= a.max() and b.min() <= y <= b.max()

    want = {}
    for i, k in enumerate(order):
        x, y = (sum(v) / len(v) for v in pts[k].T.tolist())
        want[k] = next((o for o in order[i + 1 :] if area(pts[o]) > area(pts[k]) and holds(pts[o], x, y)), -1)
    for contours, waiting in ((64, 2048), (5, 3)):
        assert {r["contour_id"]: r["parent"] for r in polygons.nesting(df, contours, waiting).collect()} == want


def test_nesting_meets_few_of_a_crowded_cell(monkeypatch):
    """Middles compared with contours do not grow with the square of a cell's contours."""
    met = []
    first_around = polygons._Block.first_around
    monkeypatch.setattr(polygons, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    monkeypatch.setattr(polygons._Block, "first_around", lambda self, mx, *rest: met.append(len(mx) * len(self.arrays[0])) or first_around(self, mx, *rest))
    rng, n, rows = np.random.default_rng(9), 4000, []
    for k in range(n):
        x, y = rng.integers(0, 60, (2, 4)).astype(float).tolist()
        area = abs(sum(x[i - 1] * y[i] - x[i] * y[i - 1] for i in range(4))) / 2
        cell = {"image_id": 1, "level": 6, "gx": 0, "gy": 0, "id": k, "mx": sum(x) / 4, "my": sum(y) / 4, "area": area}
        rows += [cell | {"xs": x, "ys": y, "asks": False}, cell | {"xs": [], "ys": [], "asks": True}]
    rows.sort(key=lambda r: (r["area"], r["id"]))
    batch = pa.RecordBatch.from_pylist(rows, pa.schema([(c, pa.float64() if c in ("mx", "my", "area") else pa.list_(pa.float64()) if c in ("xs", "ys") else pa.bool_() if c == "asks" else pa.int32() if c == "level" else pa.int64()) for c in rows[0]]))
    told = pa.Table.from_batches(polygons._sweep(iter([batch]), 64, 2048)).to_pylist()
    assert sum(r["kind"] in (1, 2) for r in told) == n and sum(r["kind"] == 1 for r in told) > 0.9 * n
    assert sum(met) < n * n / 2 / 10


def test_suppression_of_many_small_groups(spark, monkeypatch):
    """Small groups are settled many at a time, as one by one; larger ones in rounds. Only the latter make pairs."""
    rng = np.random.default_rng(12)
    sizes = rng.integers(1, 41, 300)
    n = int(sizes.sum())
    boxes = np.column_stack([rng.integers(0, 60, (n, 2)), rng.integers(0, 30, (n, 2))]).astype(float)
    scores = np.round(rng.random(n), 1)
    scores[5] = np.nan
    ends = np.cumsum(sizes)
    want = [(a + i, rank) for a, b in zip(ends - sizes, ends, strict=True) for rank, i in enumerate(matching.suppress(boxes[a:b], scores[a:b], 0.2, 0.1))]
    alone = []
    suppress = matching.suppress
    monkeypatch.setattr(matching, "suppress", lambda *a: alone.append(len(a[0])) or suppress(*a))
    assert list(zip(*(v.tolist() for v in matching.suppress_groups(sizes, boxes, scores, 0.2, 0.1)), strict=True)) == want
    assert len(alone) < len(sizes) / 2 and min(alone) > matching.MOST_AT_ONCE
    group, first = np.repeat(np.arange(300), sizes), np.repeat(ends - sizes, sizes)
    rows = [(int(g), int(k - f), *map(int, b), float(s)) for k, (g, f, b, s) in enumerate(zip(group, first, boxes, scores, strict=True)) if s == s]
    df = spark.createDataFrame(rows, "group_id long, seq int, x long, y long, width long, height long, score double")
    met = []
    real = matching._met_boxes
    monkeypatch.setattr(matching, "_met_boxes", lambda b, *k: met.append(b.select("group_id").distinct().count()) or real(b, *k))
    kept = {(int(group[k]), int(k - first[k])) for k, _ in want}
    for few, large in ((100, []), (35, [int((np.bincount(group[scores >= 0.2]) > 35).sum())])):
        met.clear()
        assert {tuple(r) for r in matching.suppressed_boxes(df, 0.2, 0.1, few).collect()} == kept
        assert met == large


def test_short_stretches_are_finished_at_once(spark, monkeypatch):
    """A long line takes few levels, each of them a table, and gives what it gave level by level, for repeated numbers too."""
    rng = np.random.default_rng(13)
    rows = [(1, int(s), float(s), float(v)) for s, v in enumerate(rng.normal(size=3000).cumsum().round(1))] + [(2, int(s), float(s % 7), float(v)) for s, v in zip(rng.integers(0, 40, 80), rng.integers(0, 9, 80), strict=True)]
    df = spark.createDataFrame(rows, POINT).repartition(3)
    tables = []
    real = polygons.written
    monkeypatch.setattr(polygons, "written", lambda d, name: tables.append(name) or real(d, name))
    got = sorted(map(tuple, polygons.simplified(df, 1.0).collect()))
    assert tables.count("cuts") < 8
    monkeypatch.setattr(polygons, "SHORT", 1 << 30)
    tables.clear()
    assert sorted(map(tuple, polygons.simplified(df, 1.0).collect())) == got and tables.count("cuts") > 12
