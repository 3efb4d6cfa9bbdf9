"""Robust homographies as relations against the matrices that made the matches, and chains against plain products."""

import numpy as np
import pandas as pd
import pytest

from lumaframe.operators import hypotheses
from lumaframe.schema import InvalidParameter

MATCH = "pair_id long, idx long, x double, y double, u double, v double"


def made(h, n, wrong, rng, noise=0.0):
    p = rng.random((n, 2)) * 100
    q = np.column_stack([p, np.ones(n)]) @ h.T
    q = q[:, :2] / q[:, 2:] + rng.normal(size=(n, 2)) * noise
    q[:wrong] = rng.random((wrong, 2)) * 300
    return np.column_stack([p, q])


@pytest.fixture(scope="module")
def truth():
    rng = np.random.default_rng(1)
    out = {}
    for pair in range(4):
        h = np.eye(3) + rng.normal(size=(3, 3)) * [[0.1, 0.1, 10], [0.1, 0.1, 10], [1e-4, 1e-4, 0]]
        out[pair] = h, made(h, 300, 100, rng, 0.05)
    return out


def frame(spark, pairs):
    return spark.createDataFrame([(p, i, *map(float, row)) for p, rows in pairs.items() for i, row in enumerate(rows)], MATCH).repartition(5)


def test_matrices_are_found_among_wrong_matches(spark, truth, monkeypatch):
    monkeypatch.setattr(hypotheses, "MATCHES", 64)
    monkeypatch.setattr(hypotheses, "HYPOTHESES", 10)
    odd = {7: [(1, 1, 2, 2), (2, 1, 3, 2), (1, 2, 2, 3)], 8: [(1, 1, 2, 2)] * 9, 9: [(1.0, float("nan"), 2, 2)]}  # too few, and no four points apart
    df = frame(spark, {p: rows for p, (_, rows) in truth.items()} | odd)
    got = {r["pair_id"]: r for r in hypotheses.robust_homographies(df, n=128, reach=1.0).collect()}
    assert got.keys() == truth.keys()
    for p, (h, rows) in truth.items():
        x, y = rows[100:, :2].T
        found = np.array(got[p]["matrix"]).reshape(3, 3)
        a, b = (m @ np.stack([x, y, np.ones(len(x))]) for m in (h, found))
        assert np.abs(a[:2] / a[2] - b[:2] / b[2]).max() < 0.1 and got[p]["inliers"] >= 190


def test_inliers_are_counted_over_blocks(spark, truth, monkeypatch):
    monkeypatch.setattr(hypotheses, "MATCHES", 32)
    rng = np.random.default_rng(2)
    fixed = [(p, k, (h + rng.normal(size=(3, 3)) * k * 0.01).ravel().tolist()) for p, (h, _) in truth.items() for k in range(70)]
    df = spark.createDataFrame(fixed, "pair_id long, k int, matrix array<double>")
    got = {(r["pair_id"], r["k"]): r["inliers"] for r in hypotheses.inlier_counts(frame(spark, {p: rows for p, (_, rows) in truth.items()}), df, 2.0).collect()}
    assert got == {(p, k): int(hypotheses.within(np.array([m]), *truth[p][1].T, 2.0).sum()) for p, k, m in fixed}


def test_homographies_through_four_points():
    rng = np.random.default_rng(3)
    h = np.array([[1.1, 0.2, 5], [-0.1, 0.9, 3], [1e-3, 2e-3, 1]])
    four = made(h, 4, 0, rng)
    assert np.allclose(hypotheses.through_four(four[None])[0], h.ravel())
    line = np.column_stack([np.arange(4), np.arange(4), np.arange(4), np.arange(4)]).astype(float)
    assert np.isnan(hypotheses.through_four(np.stack([line, four]))[0]).all()


@pytest.mark.parametrize("length,fan", [(1, 2), (6, 3), (1000, 64)])
def test_chains_are_products(spark, length, fan):
    rng = np.random.default_rng(4)
    steps = [(p, i, (np.eye(3) + rng.normal(size=(3, 3)) * 0.01).ravel().tolist()) for p, n in ((1, 50), (2, 1)) for i in range(0, 3 * n, 3)]
    got = {(r["panorama_id"], r["image"]): r["matrix"] for r in hypotheses.chained(spark.createDataFrame(steps, "panorama_id long, image long, matrix array<double>").repartition(3), length=length, fan=fan).collect()}
    for p in (1, 2):
        m = np.eye(3)
        for q, i, step in steps:
            if q == p:
                m = m @ np.array(step).reshape(3, 3)
                assert np.allclose(got[p, i], (m / m[2, 2]).ravel())
    with pytest.raises(InvalidParameter):
        hypotheses.sampled_hypotheses(frame(spark, {}), 0)


def test_stretches_of_a_batch_are_multiplied_at_once():
    rng = np.random.default_rng(9)
    rows = pd.DataFrame({"panorama_id": 1, "image": range(40), "matrix": list((np.eye(3) + rng.normal(size=(40, 3, 3)) * 0.1).reshape(-1, 9))})
    rows.at[5, "matrix"] = np.zeros(9)  # products without a last entry are not scaled
    scan, cuts = hypotheses.ProductScan("panorama_id", "image"), [0, 1, 14, 17, 40]
    parts = [rows.iloc[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    assert np.allclose(scan.folds(rows, cuts), [scan.fold(None, p) for p in parts], rtol=1e-12, atol=1e-12)
    states = [m.ravel() for m in np.eye(3) + rng.normal(size=(5, 3, 3)) * 0.1]
    got, last = scan.emits(states, rows, [0, 1, 14, 14, 17, 40])  # one without rows
    each = [scan.emit(s, p) for s, p in zip([*states[:2], *states[3:]], parts, strict=True)]
    want = pd.concat([e[0] for e in each])
    assert got[["panorama_id", "image"]].values.tolist() == want[["panorama_id", "image"]].values.tolist()
    assert np.allclose(np.stack(got["matrix"]), np.stack(want["matrix"]), rtol=1e-12, atol=1e-12) and np.allclose(last, each[-1][1])
    _, kept = scan.emits(states[:2], rows[:1], [0, 1, 1])
    assert np.array_equal(kept, states[1])


def test_matches_are_made_once(spark, truth):
    """Whatever it costs to make the matches is paid once, not by every pass over them."""
    read = spark.sparkContext.accumulator(0)

    def seen(pdfs):
        for pdf in pdfs:
            read.add(len(pdf))
            yield pdf

    df = frame(spark, {p: rows for p, (_, rows) in truth.items()}).mapInPandas(seen, MATCH)
    assert hypotheses.robust_homographies(df, n=16, reach=1.0).count() == len(truth)
    assert read.value == sum(len(rows) for _, rows in truth.values())
