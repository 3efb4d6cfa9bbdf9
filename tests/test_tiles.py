"""Tiles, halos, components, watershed and Hough relations against the forms that hold a whole image, and pivots against all pairs."""

import numpy as np
import pandas as pd
import pytest

from lumaframe.operators import filters, flooding, graph, hough, matching, nearest, segmentation, tiles
from lumaframe.schema import DimensionMismatch, InvalidParameter, to_pixels

ROW = "image_id long, c int, h int, w int, data array<double>"


def images(spark, *arrays):
    return spark.createDataFrame([(i, *a.shape, a.ravel().tolist()) for i, a in enumerate(arrays)], ROW)


def arrays_of(df):
    return {r["image_id"]: np.array(r["data"]).reshape(r["c"], r["h"], r["w"]) for r in df.collect()}


@pytest.fixture(scope="module")
def some():
    rng = np.random.default_rng(11)
    return [rng.random((1, 23, 17)), rng.random((3, 8, 8)), rng.random((1, 1, 1)), rng.random((1, 5, 40))]


def test_tiles_round_trip(spark, some):
    rows = images(spark, *some)
    for side in (1, 4, 64):
        cut = tiles.tiles_of(rows, side)
        assert cut.count() == sum(-(-a.shape[1] // side) * -(-a.shape[2] // side) for a in some)
        for back in (tiles.images_of(cut), tiles.images_of(tiles.tiles_from_pixels(to_pixels(rows), side))):
            got = arrays_of(back)
            assert all(np.array_equal(got[i], a) for i, a in enumerate(some))
    assert sorted(map(tuple, tiles.pixels_of(tiles.tiles_of(rows, 5)).collect())) == sorted(map(tuple, to_pixels(rows).select("image_id", "ch", "y", "x", "v").collect()))
    with pytest.raises(InvalidParameter):
        tiles.tiles_of(rows, 0)


def test_pixels_that_are_absent_are_black(spark):
    px = spark.createDataFrame([(0, 0, 0, 0, 0.5), (0, 0, 9, 6, 0.25)], "image_id long, ch int, y int, x int, v double")
    want = np.zeros((1, 10, 7))
    want[0, 0, 0], want[0, 9, 6] = 0.5, 0.25
    assert np.array_equal(arrays_of(tiles.images_of(tiles.tiles_from_pixels(px, 3)))[0], want)


@pytest.mark.parametrize("side", [3, 8])
def test_window_kernels_over_tiles(spark, some, side):
    cut = tiles.tiles_of(images(spark, *some), side)
    for kernel, radius, options in ((filters.box_blur, 2, {"kernel_size": 5}), (filters.gaussian_blur, 3, {"kernel_size": 7, "sigma": 1.5}), (filters.median_blur, 1, {}), (filters.dilate, 4, {"kernel_size": 9}), (filters.erode, 1, {}), (filters.box_blur, 0, {"kernel_size": 1})):
        got = arrays_of(tiles.images_of(tiles.apply_tiled(cut, kernel, radius, **options)))
        for i, a in enumerate(some):
            assert np.allclose(got[i], kernel(a[None], **options)[0]), (kernel.__name__, i)
    gray = tiles.tiles_of(images(spark, *[a for a in some if a.shape[0] == 1]), side)
    got = arrays_of(tiles.images_of(tiles.apply_tiled(gray, filters.sobel, 1)))
    assert np.allclose(got[0], filters.sobel(some[0][None])[0])


def renumbered(labels):
    """Component numbers as the place of the component's first pixel, from 1."""
    flat = labels.ravel().astype(int)
    first = {}
    for i, v in enumerate(flat):
        first.setdefault(v, i + 1)
    return np.array([first[v] if v else 0 for v in flat]).reshape(labels.shape)


def spiral(n):
    """One component that winds through every tile."""
    a = np.zeros((n, n))
    y, x, dy, dx = 0, 0, 0, 1
    a[0, 0] = 1
    steps = n - 1
    for turn in range(2 * (n // 2)):
        for _ in range(steps):
            y, x = y + dy, x + dx
            a[y, x] = 1
        dy, dx = dx, -dy
        if turn and turn % 2 == 0 or turn == 0:
            pass
        steps -= 2 if turn % 2 and turn > 1 else 0
        if steps <= 0:
            break
    return a


@pytest.mark.parametrize("side", [4, 7])
def test_components_across_tiles(spark, side):
    rng = np.random.default_rng(3)
    planes = [(rng.random((20, 26)) > t).astype(float) for t in (0.3, 0.45, 0.6)] + [spiral(19), np.zeros((9, 9)), np.ones((9, 9))]
    labelled = tiles.label_tiles(tiles.tiles_of(images(spark, *[a[None] for a in planes]), side))
    got = arrays_of(tiles.images_of(labelled))
    for i, a in enumerate(planes):
        assert np.array_equal(got[i][0], renumbered(segmentation.label(a > 0.5))), i
    stats = {}
    for r in tiles.tile_component_stats(labelled).collect():
        stats.setdefault(r["image_id"], []).append((r["x"], r["y"], r["width"], r["height"], r["area"], round(r["cx"], 6), round(r["cy"], 6)))
    for i, a in enumerate(planes):
        want = [(q["x"], q["y"], q["width"], q["height"], q["area"], round(q["cx"], 6), round(q["cy"], 6)) for q in segmentation.component_stats(a[None])]
        assert sorted(stats.get(i, [])) == sorted(want)


def test_graph_components(spark):
    rng = np.random.default_rng(9)
    edges = [(g, int(a), int(b)) for g in range(3) for a, b in rng.integers(0, 60, (35, 2))] + [(7, k, k + 1) for k in range(50)] + [(8, 100, k) for k in range(30)] + [(8, 5, 5)]
    got = {(r["image_id"], r["node"]): r["root"] for r in graph.components(spark.createDataFrame(edges, "image_id long, u long, v long")).collect()}
    label = {(g, n): n for g, a, b in edges for n in (a, b) if a != b}
    for _ in range(60):
        for g, a, b in edges:
            if a != b:
                label[g, a] = label[g, b] = min(label[g, a], label[g, b])
    assert got == label
    assert graph.components(spark.createDataFrame([], "image_id long, u long, v long")).count() == 0


def test_first_kept(spark):
    rng = np.random.default_rng(6)
    nodes = [(g, k) for g in range(2) for k in range(40)]
    clashes = sorted({(g, int(min(a, b)), int(max(a, b))) for g in range(2) for a, b in rng.integers(0, 40, (70, 2)) if a != b} | {(1, k, k + 1) for k in range(30)})
    kept = set()
    for g, k in nodes:
        if not any((g, j) in kept and (g, j, k) in set(clashes) for j in range(k)):
            kept.add((g, k))
    got = graph.first_kept(spark.createDataFrame(nodes, "g long, node long"), spark.createDataFrame(clashes, "g long, a long, b long"), "g")
    assert {tuple(r) for r in got.collect()} == kept
    none = spark.createDataFrame([], "g long, a long, b long")
    assert graph.first_kept(spark.createDataFrame(nodes, "g long, node long"), none, "g").count() == len(nodes)


# --- watershed --------------------------------------------------------------------------------


@pytest.mark.parametrize("side,finish", [(5, 0), (5, 100_000), (16, 0)])
def test_watershed_of_tiles_is_that_of_the_image(spark, monkeypatch, side, finish):
    monkeypatch.setattr(flooding, "FINISH", finish)
    rng = np.random.default_rng(12)
    planes, marks = [], []
    for shape, levels, every in (((24, 21), 1000, 60), ((17, 30), 4, 45), ((12, 12), 1, 50)):  # all different, many equal, all equal
        planes.append(rng.integers(0, levels, shape).astype(float))
        marks.append(np.where(rng.integers(0, every, shape) == 0, rng.integers(1, 9, shape), 0))
        marks[-1][0, 0] = 5
    both = images(spark, *[np.stack([a, m.astype(float)]) for a, m in zip(planes, marks, strict=True)], np.zeros((2, 6, 6)))
    got = arrays_of(tiles.images_of(flooding.watershed_tiles(tiles.tiles_of(both, side))))
    for i, (a, m) in enumerate(zip(planes, marks, strict=True)):
        assert np.array_equal(got[i][0], flooding.flood(a, m)), i
    assert not got[3].any()  # without a marker all stays dry


def test_tiles_and_images_are_flooded_many_at_once():
    """Whole images as a stack of tiles that nothing borders, and the graphs of images whose basins have the same names."""
    rng = np.random.default_rng(13)
    planes, marks = rng.integers(0, 9, (20, 6, 5)).astype(float), np.where(rng.integers(0, 8, (20, 6, 5)) == 0, rng.integers(1, 9, (20, 6, 5)), 0)
    marks[:, 0, 0] = 3
    place = np.broadcast_to(np.arange(30).reshape(6, 5), planes.shape)
    for open_, settled in ((False, True), (True, False)):
        names, edges, wet = flooding._basins(planes, marks, np.full((20, 4), open_), place)
        e = pd.DataFrame(edges).rename(columns={"tile": "image_id"})
        known = pd.DataFrame(wet).rename(columns={"tile": "image_id"})
        for end in "uv":
            e = e.merge(known.rename(columns={"node": end, "label": f"{end}l"}), "left", ["image_id", end])
        assert (len(e) == 0) == settled
        told = pd.concat([flooding.risen(e).rename(columns={"basin": "node"}), known]) if len(e) else known
        told = dict(zip(zip(told["image_id"], told["node"], strict=True), told["label"], strict=True))
        for k, (a, m) in enumerate(zip(planes, marks, strict=True)):
            assert np.array_equal([[told[k, n] for n in line] for line in names[k].tolist()], flooding.flood(a, m)), k


def test_flooding_needs_markers():
    with pytest.raises(InvalidParameter):
        flooding.flood(np.zeros((2, 2)), np.zeros((2, 2), int))
    with pytest.raises(DimensionMismatch):
        flooding.flood(np.zeros((2, 2)), np.zeros((2, 3), int))


# --- Hough ------------------------------------------------------------------------------------


def test_lines_are_those_of_the_image(spark):
    rng = np.random.default_rng(7)
    a = np.zeros((1, 30, 40))
    a[0, 12, 3:36] = 1
    a[0, 2:28, 20] = 1
    for k in range(20):
        a[0, 5 + k, 10 + k] = 1
    planes = [a, (rng.random((1, 12, 9)) > 0.6).astype(float), np.zeros((1, 5, 5))]
    args = (1.0, np.pi / 45, 6, 5, 3)
    got = {}
    for r in hough.lines_p(hough.edge_points(images(spark, *planes)), *args).collect():
        got.setdefault(r["image_id"], []).append((r["x1"], r["y1"], r["x2"], r["y2"]))
    for i, p in enumerate(planes):
        assert sorted(got.get(i, [])) == sorted(tuple(q.values()) for q in segmentation.hough_lines_p(p, *args)), i
    with pytest.raises(InvalidParameter):
        hough.line_votes(hough.edge_points(images(spark, a)), 1.0, 0)


def test_circles_are_those_of_the_image(spark):
    from lumaframe.plans.kernels import apply_stack

    rng = np.random.default_rng(8)
    y, x = np.mgrid[:40, :40]
    disc = ((y - 18) ** 2 + (x - 22) ** 2 <= 81).astype(float)[None]
    planes = [disc, rng.random((1, 16, 20))]
    args = dict(dp=1, min_dist=5, param1=0.3, param2=4, min_radius=2, max_radius=11)
    got = {}
    for r in hough.circles(hough.gradient_points(apply_stack(images(spark, *planes), hough.gradient_stack)), **args).collect():
        got.setdefault(r["image_id"], []).append((r["cx"], r["cy"], r["radius"]))
    for i, p in enumerate(planes):
        assert sorted(got.get(i, [])) == sorted((c["x"], c["y"], c["radius"]) for c in segmentation.hough_circles(p, **args)), i
    with pytest.raises(InvalidParameter):
        hough.circle_votes(hough.gradient_points(apply_stack(images(spark, disc), hough.gradient_stack)), 0.1, 3, 2)


# --- pivots -----------------------------------------------------------------------------------

VEC = "idx long, vec array<double>"


def brute_nearest(query, train):
    t = sorted(train)
    out = {}
    for i, v in query:
        d = [(float(np.sqrt(((np.array(v) - np.array(u)) ** 2).sum())), k) for k, u in t]
        best = min(d)
        out[i] = (best[1], best[0])
    return out


@pytest.mark.parametrize("block,pivots", [(16, None), (5, 3), (2048, 1)])
def test_pivots_lose_no_row(spark, block, pivots):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 4)) * 20
    train = [(i, (centres[i % 6] + rng.normal(size=4)).tolist()) for i in range(300)]
    train += [(1000 + k, train[7][1]) for k in range(80)]  # equal rows, a hot cell
    query = [(i, (centres[i % 6] + rng.normal(size=4)).tolist()) for i in range(100)] + [(500, train[7][1]), (501, [1e6] * 4), (502, [0.0] * 4)]
    odd = [(900, None), (901, []), (902, [None] * 4), (903, [float("nan")] * 4)]
    got = nearest.pivot_matches(spark.createDataFrame(query + odd, VEC), spark.createDataFrame(train + odd, VEC), block=block, pivots=pivots)
    got = {r["query_idx"]: (r["train_idx"], r["distance"]) for r in got.collect()}
    want = brute_nearest(query, train)
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and np.isclose(got[k][1], want[k][1]) for k in want)


def test_pivots_leave_out_most_pairs(spark):
    rng = np.random.default_rng(6)
    points = lambda n: spark.createDataFrame([(i, v) for i, v in enumerate((rng.random((n, 2)) * 100).tolist())], VEC)
    search = nearest.PivotSearch(points(1500), points(1500), block=32)
    every = search.blocks.count() * search.shells.count()
    assert search.pairs.count() < every / 8
    assert search.matches().count() == 1500


def test_queries_that_any_cell_may_answer_are_sent_to_few(spark, monkeypatch):
    """Among independent directions nothing can be left out: a query goes to a bounded number of places, however many cells there are."""
    rng = np.random.default_rng(8)
    query, train = ([(i, v) for i, v in enumerate(np.round(rng.normal(size=(n, 24)), 2).tolist())] for n in (150, 900))
    train += [(5000 + i, v) for i, v in train[:40]]  # equal rows
    monkeypatch.setattr(nearest, "HELD", 40 * 8 * 25)  # several groups
    search = nearest.PivotSearch(spark.createDataFrame(query, VEC), spark.createDataFrame(train, VEC), block=16)
    sent = search.asked.agg({"n": "sum"}).first()[0]
    assert len(search.pivots) > 25 and sent <= len(query) * nearest.FEW_CELLS
    got = {r["query_idx"]: (r["train_idx"], r["distance"]) for r in search.matches().collect()}
    want = brute_nearest(query, train)
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and np.isclose(got[k][1], want[k][1]) for k in want)


def test_pivots_of_nothing(spark):
    some = spark.createDataFrame([(1, [1.0, 2.0])], VEC)
    none = spark.createDataFrame([], VEC)
    assert nearest.pivot_matches(some, none).count() == 0 and nearest.pivot_matches(none, some).count() == 0
    with pytest.raises(InvalidParameter):
        nearest.pivot_matches(some, some, block=0)
    assert matching.approximate_matches(some, some).collect()[0]["train_idx"] == 1


def test_pivots_leave_out_most_pairs_of_far_queries(spark):
    """Queries far outside of the rows are about as far from every pivot; the boxes of cells tell them apart."""
    rng = np.random.default_rng(7)
    points = lambda n, away: spark.createDataFrame([(i, [x + away, y]) for i, (x, y) in enumerate((rng.random((n, 2)) * 100).tolist())], VEC)
    search = nearest.PivotSearch(points(1500, 3000.0), points(1500, 0.0), block=32)
    assert search.pairs.count() < search.blocks.count() * search.shells.count() / 8
    assert search.matches().count() == 1500


def test_a_kernel_sees_few_small_tiles_at_once(spark):
    """However many tiles come in a batch, so many numbers are stacked."""
    pixels = spark.range(0, 600 * 64).selectExpr("0L AS image_id", "0 AS ch", "CAST(id / 64 AS INT) AS y", "CAST(id % 64 AS INT) AS x", "1.0D AS v").coalesce(1)
    made = tiles.apply_tiled(tiles.tiles_from_pixels(pixels, 4).coalesce(1), lambda s: np.full(s.shape, float(s.size)), 18)
    sizes = {v for r in made.select("data").collect() for v in r["data"]}
    assert max(sizes) < tiles.STACK + 40 * 40 and made.count() == 150 * 16
