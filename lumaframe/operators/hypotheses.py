"""Robust homographies of many image pairs at once: sampled hypotheses as rows, inliers counted by partial aggregation.

Matches are rows (pair_id, idx, x, y, u, v): a point (x, y) of one image and (u, v) of the other. Each pair gets the same number of hypotheses, the
homographies through four matches drawn by a fixed rule. Matches and hypotheses are packed into blocks; a block of each meets in a task, which counts
the matches that each hypothesis explains, and the counts are summed up. The best hypothesis' inliers give the final matrix by a
second pass that sums their normal equations, so that no task holds all matches of a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import InvalidParameter
from ..sources.files import written
from .scans import scanned

#: Matches, and hypotheses, of one block.
MATCHES, HYPOTHESES = 1024, 64
MATRIX = "array<double>"


def _sound(matches: DataFrame) -> DataFrame:
    ok = F.lit(True)
    for c in ("x", "y", "u", "v"):
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c)
    return matches.filter(ok & F.col("pair_id").isNotNull()).select("pair_id", "idx", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "u", "v")])


def through_four(points: np.ndarray) -> np.ndarray:
    """(n, 9) homographies with a last entry of 1 through (n, 4, 4) points (x, y, u, v); not-a-number where there is none."""
    x, y, u, v = np.moveaxis(points, 2, 0)
    o, i = np.zeros_like(x), np.ones_like(x)
    a = np.concatenate([np.stack([x, y, i, o, o, o, -u * x, -u * y], 2), np.stack([o, o, o, x, y, i, -v * x, -v * y], 2)], 1)
    b = np.concatenate([u, v], 1)
    scale = np.abs(a).max(2, keepdims=True)
    good = np.linalg.cond(a / np.maximum(scale, 1e-300)) < 1e10
    out = np.full((len(points), 9), np.nan)
    if good.any():
        out[good, :8] = np.linalg.solve(a[good], b[good][..., None])[..., 0]
        out[good, 8] = 1
    return out


def sampled_hypotheses(matches: DataFrame, n: int) -> DataFrame:
    """(pair_id, k, matrix): ``n`` homographies a pair, each through four of its matches; draws without a homography are left out.

    Slot s of draw k takes the match whose place in the pair is a hash of (k, s) modulo their number.
    """
    if n < 1:
        raise InvalidParameter("a hypothesis is needed")
    rows = _sound(matches)
    size = rows.groupBy("pair_id").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("pair_id").orderBy("idx", "x", "y", "u", "v")) - 1
    placed = rows.withColumn("place", place)
    draws = size.filter("n >= 4").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(3))))
    draws = draws.select("pair_id", "k", "slot", F.pmod(F.xxhash64("k", "slot"), F.col("n")).cast("int").alias("place"))
    four = draws.join(placed, ["pair_id", "place"]).groupBy("pair_id", "k").agg(F.array_sort(F.collect_list(F.struct("slot", "x", "y", "u", "v"))).alias("p"))

    @F.pandas_udf(MATRIX)
    def solve(p: pd.Series) -> pd.Series:
        points = np.concatenate([np.empty(0), *p]).reshape(-1, 4, 4)
        return pd.Series([h if np.isfinite(h).all() else None for h in through_four(points)], dtype=object)

    flat = F.flatten(F.transform("p", lambda q: F.array(q["x"], q["y"], q["u"], q["v"])))
    return four.withColumn("matrix", solve(flat)).filter(F.col("matrix").isNotNull()).select("pair_id", "k", "matrix")


def inlier_counts(matches: DataFrame, hypotheses: DataFrame, reach: float) -> DataFrame:
    """(pair_id, k, inliers): matches that each hypothesis maps to within ``reach`` of their partner."""
    rows = _sound(matches)
    size = rows.groupBy("pair_id").agg(F.greatest(F.ceil(F.count("*") / MATCHES), F.lit(1)).alias("blocks"))
    m = rows.join(size, "pair_id").withColumn("block", F.pmod(F.xxhash64("idx", "x", "y", "u", "v"), F.col("blocks")))
    m = m.groupBy("pair_id", "block").agg(F.flatten(F.collect_list(F.array("x", "y", "u", "v"))).alias("m"))
    h = hypotheses.groupBy("pair_id", F.floor(F.col("k") / HYPOTHESES).alias("part")).agg(F.collect_list("k").alias("ks"), F.flatten(F.collect_list("matrix")).alias("hs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pair, points, ks, hs in zip(*(b.column(c) for c in ("pair_id", "m", "ks", "hs")), strict=True):
                # Flat arrays, without a Python object for each number.
                x, y, u, v = np.ascontiguousarray(points.values.to_numpy(zero_copy_only=False).reshape(-1, 4).T)
                inside = within(hs.values.to_numpy(zero_copy_only=False).reshape(-1, 9), x, y, u, v, reach)
                ks = ks.values
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ks), pair.as_py(), np.int64)), ks.cast(pa.int32()), pa.array(np.count_nonzero(inside, axis=1))], names=["pair_id", "k", "n"])

    met = m.join(h, "pair_id").select(F.col("pair_id").cast("long").alias("pair_id"), "m", "ks", "hs").mapInArrow(run, "pair_id long, k int, n long")
    return met.groupBy("pair_id", "k").agg(F.sum("n").alias("inliers"))


def within(h: np.ndarray, x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray, reach: float) -> np.ndarray:
    """Which of the points each of the (n, 9) matrices maps to within ``reach`` of (u, v)."""
    with np.errstate(divide="ignore", invalid="ignore"):
        spare = np.empty((len(h), len(x)))

        def linear(k: int) -> np.ndarray:
            out = h[:, k : k + 1] * x
            out += np.multiply(h[:, k + 1 : k + 2], y, out=spare)
            out += h[:, k + 2 : k + 3]
            return out

        w, dx, dy = linear(6), linear(0), linear(3)
        for d, to in ((dx, u), (dy, v)):
            d /= w
            d -= to
            d *= d
        dx += dy
        return (w != 0) & (np.sqrt(dx, out=dx) < reach)


def _mapped(h: Column, reach: float) -> Column:
    at = lambda i: h[i]
    w = at(6) * F.col("x") + at(7) * F.col("y") + at(8)
    dx = (at(0) * F.col("x") + at(1) * F.col("y") + at(2)) / w - F.col("u")
    dy = (at(3) * F.col("x") + at(4) * F.col("y") + at(5)) / w - F.col("v")
    return F.when(w != 0, F.sqrt(dx * dx + dy * dy) < reach).otherwise(False)


def robust_homographies(matches: DataFrame, n: int = 256, reach: float = 3.0) -> DataFrame:
    """(pair_id, k, inliers, matrix): of each pair the hypothesis with most inliers (the first of equals), and the homography that fits its inliers best.

    Pairs of fewer than four matches, or without any homography, have no row.
    """
    matches = written(_sound(matches), "matches")  # read five times
    found = written(sampled_hypotheses(matches, n), "hypotheses")
    counts = inlier_counts(matches, found, reach)
    best = counts.groupBy("pair_id").agg(F.max(F.struct("inliers", (-F.col("k")).alias("first"))).alias("m")).select("pair_id", (-F.col("m.first")).alias("k"), F.col("m.inliers").alias("inliers"))
    chosen = written(best.join(found, ["pair_id", "k"]), "chosen")
    good = _sound(matches).join(chosen.select("pair_id", "matrix"), "pair_id").filter(_mapped(F.col("matrix"), reach))
    # Points are centred and scaled by the inliers' extent, sums of the normal equations are taken by partial aggregation.
    extent = good.groupBy("pair_id").agg(*[f(c).alias(f"{c}_{e}") for c in ("x", "y", "u", "v") for e, f in (("m", F.avg), ("s", F.stddev_pop))])
    scaled = good.join(extent, "pair_id")
    part = lambda c: (F.col(c) - F.col(f"{c}_m")) / F.greatest(F.col(f"{c}_s"), F.lit(1e-12))
    scaled = scaled.select("pair_id", *[part(c).alias(c) for c in ("x", "y", "u", "v")])
    x, y, u, v = (F.col(c) for c in ("x", "y", "u", "v"))
    row1, row2 = [x, y, F.lit(1.0), *[F.lit(0.0)] * 3, -u * x, -u * y], [*[F.lit(0.0)] * 3, x, y, F.lit(1.0), -v * x, -v * y]
    sums = [F.sum(row1[i] * row1[j] + row2[i] * row2[j]).alias(f"a{i}{j}") for i in range(8) for j in range(i, 8)] + [F.sum(row1[i] * u + row2[i] * v).alias(f"b{i}") for i in range(8)]
    normal = scaled.groupBy("pair_id").agg(*sums)
    names = [f"a{i}{j}" for i in range(8) for j in range(i, 8)] + [f"b{i}" for i in range(8)]
    ends = [f"{c}_{e}" for c in ("x", "y", "u", "v") for e in ("m", "s")]

    @F.pandas_udf(MATRIX)
    def solve(row: pd.DataFrame, first: pd.Series) -> pd.Series:
        out = []
        for values, fallback in zip(row[names + ends].to_numpy(float), first, strict=True):
            a = np.zeros((8, 8))
            a[np.triu_indices(8)] = values[:36]
            a = a + np.triu(a, 1).T
            xm, xs, ym, ys, um, us, vm, vs = values[44:]
            xs, ys, us, vs = (max(s, 1e-12) for s in (xs, ys, us, vs))
            try:
                h = np.append(np.linalg.solve(a, values[36:44]), 1).reshape(3, 3)
            except np.linalg.LinAlgError:
                out.append(np.asarray(fallback, float))
                continue
            h = np.array([[us, 0, um], [0, vs, vm], [0, 0, 1]]) @ h @ np.array([[1 / xs, 0, -xm / xs], [0, 1 / ys, -ym / ys], [0, 0, 1]])
            out.append((h / h[2, 2]).ravel() if abs(h[2, 2]) > 1e-12 else np.asarray(fallback, float))
        return pd.Series(out)

    fit = normal.join(extent, "pair_id").join(chosen, "pair_id")
    return fit.select("pair_id", "k", "inliers", solve(F.struct(*names, *ends), "matrix").alias("matrix"))


# --- chains -------------------------------------------------------------------------------


class ProductScan:
    """Products of 3x3 matrices from left to right, each scaled to a last entry of 1 where it has one."""

    def __init__(self, key: str, order: str):
        self.key, self.order = key, order

    @staticmethod
    def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        m = a.reshape(3, 3) @ b.reshape(3, 3)
        return (m / m[2, 2] if abs(m[2, 2]) > 1e-12 else m).ravel()

    def fold(self, element: np.ndarray | None, rows: pd.DataFrame) -> np.ndarray:
        for m in rows["matrix"]:
            m = np.asarray(m, float)
            element = m if element is None else self._times(element, m)
        return element

    @staticmethod
    def _products(starts: np.ndarray, matrices: np.ndarray, cuts: list[int], out: np.ndarray | None = None) -> np.ndarray:
        """``starts`` times the matrices of each stretch, a place of all stretches at a time; ``out`` takes the products up to each matrix."""
        first, n = np.array(cuts[:-1], int), np.diff(cuts)
        longest = np.argsort(-n, kind="stable")
        state, left = starts[longest].copy(), np.sort(n)
        for k in range(n.max(initial=0)):
            some = len(n) - int(np.searchsorted(left, k, "right"))
            at = first[longest[:some]] + k
            m = state[:some] @ matrices[at]
            last = m[:, 2:, 2:]
            state[:some] = np.divide(m, last, out=m.copy(), where=np.abs(last) > 1e-12)
            if out is not None:
                out[at] = state[:some]
        back = np.empty_like(state)
        back[longest] = state
        return back

    @staticmethod
    def _matrices(rows: pd.DataFrame) -> np.ndarray:
        return np.array(rows["matrix"].tolist(), float).reshape(len(rows), 3, 3)

    def folds(self, rows: pd.DataFrame, cuts: list[int]) -> np.ndarray:
        matrices = self._matrices(rows)
        # The first matrix of a stretch is taken as it is.
        one, rest = np.zeros(len(rows), bool), np.arange(len(cuts) - 1)
        one[cuts[:-1]] = True
        return self._products(matrices[one], matrices[~one], [*(np.array(cuts[:-1]) - rest).tolist(), len(rows) - len(rest)]).reshape(-1, 9)

    def emits(self, states: list[np.ndarray], rows: pd.DataFrame, cuts: list[int]) -> tuple[pd.DataFrame, np.ndarray]:
        """A stretch may have no rows; its state stays."""
        out = np.empty((len(rows), 3, 3))
        last = self._products(np.array(states, float).reshape(-1, 3, 3), self._matrices(rows), cuts, out)[-1]
        return pd.DataFrame({self.key: rows[self.key].to_numpy(), self.order: rows[self.order].to_numpy(np.int64), "matrix": list(out.reshape(-1, 9))}), last.ravel()

    def combine(self, first: np.ndarray, then: np.ndarray) -> np.ndarray:
        return self._times(first, then)

    def start(self, first: np.ndarray) -> np.ndarray:
        return np.eye(3).ravel()

    push = combine

    def emit(self, state: np.ndarray, rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        out = []
        for m in rows["matrix"]:
            state = self._times(state, np.asarray(m, float))
            out.append(state)
        return pd.DataFrame({self.key: rows[self.key].to_numpy(), self.order: rows[self.order].to_numpy(np.int64), "matrix": out}), state


def chained(steps: DataFrame, key: str = "panorama_id", order: str = "image", length: int = 1024, fan: int = 64) -> DataFrame:
    """(key, order, matrix): of homographies from each image to the one before, the product from each image to the first, by a prefix scan."""
    return scanned(steps.select(key, order, "matrix"), key, order, ProductScan(key, order), f"`{key}` long, `{order}` long, matrix array<double>", length, fan)
