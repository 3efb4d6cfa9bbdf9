"""Golden cases and invariants of the kernels."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumaframe.operators import drawing, features, filters, geometry, histograms, matching, models, segmentation, tracking
from lumaframe.schema import DimensionMismatch, InvalidParameter, ModelNotProvided

RNG = np.random.default_rng(1)


def stack(*shape):
    return RNG.random(shape)


def test_blurs_keep_constants():
    flat = np.full((2, 3, 8, 8), 0.5)
    for f in (filters.box_blur, filters.gaussian_blur, filters.median_blur, filters.bilateral_filter, filters.nlm):
        assert np.allclose(f(flat), 0.5)
    assert filters.filter2d(flat, np.full((3, 3), 1 / 9))[0, 0, 0, 0] < 0.5


def test_even_kernels_are_rejected():
    for f in (filters.box_blur, filters.median_blur, filters.dilate):
        with pytest.raises(InvalidParameter):
            f(stack(1, 1, 4, 4), kernel_size=2)


def test_box_blur_against_a_loop():
    s = stack(1, 1, 5, 6)
    got = filters.box_blur(s, 3)
    for y in range(5):
        for x in range(6):
            assert math.isclose(got[0, 0, y, x], s[0, 0, max(0, y - 1) : y + 2, max(0, x - 1) : x + 2].mean())


@settings(max_examples=20, deadline=None)
@given(st.integers(3, 9), st.integers(3, 9), st.integers(0, 1000))
def test_morphology_laws(h, w, seed):
    s = np.random.default_rng(seed).random((1, 1, h, w))
    assert (filters.erode(s) <= s).all() and (s <= filters.dilate(s)).all()
    opened = filters.morph_open(s)
    assert np.array_equal(filters.morph_open(opened), opened)


def test_geometry_inverses():
    s = stack(2, 3, 5, 7)
    turned = s
    for _ in range(4):
        turned = geometry.rotate(turned, 90)
    assert np.array_equal(turned, s)
    assert np.array_equal(geometry.flip(geometry.flip(s)), s)
    assert np.array_equal(geometry.undistort(s, [[5, 0, 3], [0, 5, 2], [0, 0, 1]], []), s)
    with pytest.raises(InvalidParameter):
        geometry.warp_affine(s, [[0, 0, 0], [0, 0, 0]], 3, 3)


def test_perspective_transform_maps_the_points():
    src, dst = [(0, 0), (4, 0), (4, 3), (0, 3)], [(1, 1), (6, 2), (5, 7), (0, 5)]
    h = geometry.get_perspective_transform(src, dst)
    for (x, y), want in zip(src, dst, strict=True):
        assert np.allclose(geometry.apply_homography(h, x, y), want)


def test_homography_of_moved_points():
    pts = np.array([(x, y) for x in range(4) for y in range(4)], float)
    h = features.ransac_homography(pts, pts + [3, -2])
    assert np.allclose(geometry.apply_homography(h, 1.0, 1.0), (4, -1), atol=1e-6)


def test_histogram_sums():
    s = stack(3, 2, 6, 7)
    assert (histograms.histogram(s).sum(-1) == 42).all()


def test_distance_transform():
    s = np.zeros((1, 1, 4, 4))
    s[0, 0, 0, 2] = s[0, 0, 2, 0] = 1
    d = filters.distance_transform(s)[0, 0]
    assert d[0, 2] == d[2, 0] == 0 and d.max() == 1 and math.isclose(d[1, 1] / d[0, 0], math.sqrt(2) / 2, rel_tol=1e-6)


def test_components():
    a = np.zeros((1, 5, 5))
    a.flat[[0, 1, 23, 24]] = 1
    got = segmentation.component_stats(a)
    assert [(c["label"], c["area"], c["width"], c["height"]) for c in got] == [(1, 2, 2, 1), (2, 2, 2, 1)]


def test_watershed():
    a = np.full((1, 8, 8), 0.2)
    a[:, :, 4:] = 0.8
    marks = np.zeros((8, 8), int)
    marks.flat[0], marks.flat[63] = 1, 2
    out = segmentation.watershed(a, marks)
    assert (out > 0).all() and out[0, 0, 0] == 1 and out[0, 7, 7] == 2
    with pytest.raises(InvalidParameter):
        segmentation.watershed(a, np.zeros((8, 8), int))


def test_template_and_stereo():
    a = np.zeros((3, 6, 6))
    a[:, :3, :3] = 1
    sq = features.template_match(a, np.ones((3, 3, 3)))
    assert sq.shape == (1, 4, 4) and sq[0, 0, 0] < 0.01
    left, right = np.zeros((1, 16, 48)), np.zeros((1, 16, 48))
    left[:, :, 24], right[:, :, 20] = 1, 1
    assert features.stereo_match(left, right, 3, 32)[0, 8, 24] == 64
    with pytest.raises(InvalidParameter):
        features.stereo_match(left, right, 4, 32)


def test_contour_of_a_block():
    a = np.zeros((1, 10, 10))
    a[:, 2:5, 2:5] = 1
    (c,) = segmentation.find_contours(a)
    assert c[0] == c[-1] and segmentation.polygon_area(c) == 4


def test_inpaint_and_flood():
    a = np.full((3, 8, 8), 0.3)
    mask = np.zeros((8, 8))
    mask[3:5, 3:5] = 1
    broken = a.copy()
    broken[:, 3:5, 3:5] = 9
    assert np.allclose(segmentation.inpaint(broken, mask), a)
    assert (segmentation.flood_fill(a[:1], 0, 0, 1.0, 0.1, 0.1) == 1).all()
    with pytest.raises(DimensionMismatch):
        segmentation.inpaint(a, np.zeros((2, 2)))


def test_nms_and_hull():
    boxes = np.array([(0, 0, 10, 10), (2, 2, 10, 10), (20, 20, 10, 10)], float)
    assert matching.suppress(boxes, np.array([0.9, 0.8, 0.7]), 0.5, 0.3) == [0, 2]
    square = np.array([(0, 0), (10, 0), (10, 10), (0, 10), (5, 5)], float)
    assert len(matching.convex_hull(square)) == 4
    assert matching.min_area_rect(square)["width"] == 10


def test_kalman():
    k = tracking.velocity_filter()
    for step in range(1, 11):
        k.predict()
        k.update([step + 0.05])
    assert abs(k.x[0] - 10) < 2
    with pytest.raises(DimensionMismatch):
        k.update([1, 2])


def test_background_and_trackers():
    b = tracking.BackgroundSubtractor(0.1, 0.05)
    assert b.apply(np.full((3, 8, 8), 0.5)).sum() == 0
    assert b.apply(np.full((3, 8, 8), 0.6)).sum() == 64
    a = np.zeros((3, 32, 32))
    a[0, 12:20, 12:20] = 1
    m = tracking.MeanShiftTracker()
    m.init(a, (12, 12, 8, 8))
    x, y, w, h = m.update(np.roll(a, 2, 2))
    assert abs(x + w / 2 - 18) <= 2 and abs(y + h / 2 - 16) <= 2
    t = tracking.Tracker()
    t.init(a, (8, 8, 16, 16))
    assert abs(t.update(np.roll(a, 2, 2))[0] - 10) <= 1
    with pytest.raises(InvalidParameter):
        tracking.Tracker("kcf")


def test_flow_follows_a_shift():
    y, x = np.mgrid[:32, :32]
    a = np.exp(-((x - 14) ** 2 + (y - 16) ** 2) / 40.0)[None]
    b = np.exp(-((x - 15) ** 2 + (y - 16) ** 2) / 40.0)[None]
    ((u, v, ok),) = tracking.sparse_flow(a, b, [(14.0, 16.0)])
    assert ok and abs(u - 15) < 0.2 and abs(v - 16) < 0.2


def test_noise_is_repeatable_and_checked():
    a = np.full((1, 4, 4), 0.5)
    assert np.array_equal(features.add_gaussian_noise(a, 0, 0.1), features.add_gaussian_noise(a, 0, 0.1))
    with pytest.raises(InvalidParameter):
        features.add_salt_pepper_noise(a, 1.5)


def test_drawing_clips():
    a = np.zeros((3, 4, 4))
    assert drawing.draw_line(a, (-2, -2), (9, 9), (1, 0, 0))[0].trace() == 4
    with pytest.raises(InvalidParameter):
        drawing.draw_marker(a, (1, 1), (1, 1, 1), "star")


def test_models_need_a_model():
    with pytest.raises(ModelNotProvided):
        models.solve_pnp()


def test_approximate_matches_answer_every_query(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=8) * (1 if i < 60 else 9)]) for i in range(80)]
    df = spark.createDataFrame(rows, "idx long, vec array<double>")
    query, train = df.filter("idx % 2 = 0"), df.filter("idx % 2 = 1")
    exact = {r[0]: r[1:] for r in matching.match_descriptors(query, train).collect()}
    got = {r[0]: r[1:] for r in matching.approximate_matches(query, train, radius=1.2).collect()}
    assert got.keys() == exact.keys() and len(exact) == 40
    assert sum(got[k][0] == exact[k][0] for k in exact) >= 36
    assert all(math.isclose(got[k][1], exact[k][1]) for k in exact if exact[k][1] > 1.2)
    assert matching.approximate_matches(train, train, radius=1.2).count() == 40


def test_suppression_streams_groups(spark):
    """Groups that span Arrow batches give what one batch gives."""
    from lumaframe.operators import matching

    rng = np.random.default_rng(2)
    rows = [(int(g), int(i), int(rng.integers(40)), int(rng.integers(40)), 10, 10, float(rng.random())) for g in range(7) for i in range(int(rng.integers(1, 60)))]
    df = spark.createDataFrame(rows, "group_id long, seq int, x long, y long, width long, height long, score double")
    whole = sorted(map(tuple, matching.nms_boxes(df, 0.1, 0.2).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        assert sorted(map(tuple, matching.nms_boxes(df, 0.1, 0.2).collect())) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pairs = {(r["group_id"], r["seq_a"], r["seq_b"]) for r in matching.iou_pairs(df, 0.15).collect()}
    over = lambda a, b: max(0, min(a[2], b[2]) + 10 - max(a[2], b[2])) * max(0, min(a[3], b[3]) + 10 - max(a[3], b[3]))
    assert pairs == {(a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and over(a, b) / (200 - over(a, b)) >= 0.15}


def test_flows_of_a_stack_are_those_of_its_pairs(monkeypatch):
    """Pairs of one shape go through the flow together, and are told apart in it."""
    rng = np.random.default_rng(14)
    for shape in ((7, 3, 21, 34), (5, 1, 8, 8)):
        a = rng.random(shape)
        b = np.roll(a, 1, 3) + rng.random(shape) * 0.01
        a[2] = b[2] = 0.5  # no flow can be told
        calls = []
        each = np.stack([tracking.dense_flow(x, y) for x, y in zip(a, b, strict=True)])
        plain = tracking.separable
        monkeypatch.setattr(tracking, "separable", lambda *args: calls.append(1) or plain(*args))
        got = tracking.dense_flows(a, b)
        assert got.shape == (len(a), 2, *shape[2:]) and np.allclose(got, each, rtol=1e-9, atol=1e-12)
        some = len(calls)
        tracking.dense_flows(a[:1], b[:1])
        assert len(calls) == 2 * some  # as many steps for all pairs as for one
        monkeypatch.undo()
