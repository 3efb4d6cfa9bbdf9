"""Histograms, equalisation and automatic thresholds.

The per-image operators are kernels; :func:`compare_hist` is a column function.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import InvalidParameter
from .filters import gray

BINS = 256


def bins_of(s: np.ndarray) -> np.ndarray:
    return (np.clip(s, 0, 1) * 255).astype(int)


def calc_hist(images: DataFrame) -> DataFrame:
    """(image_id, ch, bin, count) with all 256 bins, by built-in functions: a task counts the pixels of its images before the one shuffle of their cells."""
    from ..schema import to_pixels

    v = F.least(F.greatest(F.col("v"), F.lit(0.0)), F.lit(1.0))
    cells = to_pixels(images).groupBy("image_id", "ch", F.floor(v * (BINS - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    found = cells.groupBy("image_id", "ch").agg(F.collect_list(F.struct("bin", "n")).alias("found"))  # at most 256
    # A plane's counts are laid out by merging the cells that occur with zeros for all.
    zeros = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.struct(b.alias("bin"), F.lit(0).cast("long").alias("n")))
    absent = F.filter(zeros, lambda z: ~F.array_contains("bins", z["bin"]))
    full = found.withColumn("bins", F.col("found.bin")).select("image_id", "ch", F.inline(F.concat("found", absent)))
    return full.select("image_id", "ch", "bin", F.col("n").alias("count"))


def histogram(s: np.ndarray) -> np.ndarray:
    """(n, c, 256) counts."""
    n, c = s.shape[:2]
    b = bins_of(s).reshape(n * c, -1) + np.arange(n * c)[:, None] * BINS
    return np.bincount(b.ravel(), minlength=n * c * BINS).reshape(n, c, BINS)


def calc_hist_2d(a: np.ndarray, channel_x: int, channel_y: int, bins: int) -> np.ndarray:
    """Joint histogram of two channels of one image, as a share of its largest cell."""
    at = lambda ch: np.floor(np.clip(a[ch], 0, 1) * (bins - 1) + 0.5).astype(int).ravel()
    out = np.zeros((bins, bins))
    np.add.at(out, (at(channel_y), at(channel_x)), 1)
    return out / max(out.max(), 1)


def _equalise_lut(hist: np.ndarray) -> np.ndarray:
    cdf = hist.cumsum(-1).astype(float)
    first = np.where(hist > 0, cdf, np.inf).min(-1, keepdims=True)
    span = cdf[..., -1:] - first
    return np.where(span > 0, np.floor((cdf - first) / np.where(span > 0, span, 1) * 255 + 0.5) / 255, 0).clip(0, 1)


def equalize_hist(s: np.ndarray) -> np.ndarray:
    """Gray image through its cumulative histogram; a constant image becomes 0."""
    g = gray(s)
    lut = _equalise_lut(histogram(g))[:, 0]
    return np.take_along_axis(lut, bins_of(g).reshape(len(g), -1), 1).reshape(g.shape)


def rgb_to_ycrcb(s: np.ndarray) -> np.ndarray:
    r, g, b = s[:, 0], s[:, 1], s[:, 2]
    y = 0.299 * r + 0.587 * g + 0.114 * b
    return np.stack([y, (r - y) * 0.713 + 0.5, (b - y) * 0.564 + 0.5], 1).clip(0, 1)


def ycrcb_to_rgb(s: np.ndarray) -> np.ndarray:
    y, cr, cb = s[:, 0], s[:, 1] - 0.5, s[:, 2] - 0.5
    return np.stack([y + 1.402 * cr, y - 0.714 * cr - 0.344 * cb, y + 1.772 * cb], 1).clip(0, 1)


def equalize_hist_color(s: np.ndarray) -> np.ndarray:
    if s.shape[1] != 3:
        raise InvalidParameter("three channels are needed")
    t = rgb_to_ycrcb(s)
    return ycrcb_to_rgb(np.concatenate([equalize_hist(t[:, :1]), t[:, 1:]], 1))


def _tiles(size: int, grid: int) -> list[tuple[int, int]]:
    step = max(size // grid, 1)
    return [(k * step, (k + 1) * step if k < grid - 1 else size) for k in range(grid) if k * step < size]


def _clipped_lut(tile: np.ndarray, clip_limit: float) -> np.ndarray:
    """(n, 256) look-up tables of tiles (n, h, w): clipped, the excess dealt out evenly, cumulated."""
    n = tile.shape[1] * tile.shape[2]
    hist = histogram(tile[:, None])[:, 0]
    if clip_limit > 0:
        limit = int(clip_limit * n / BINS)
        excess = (hist - limit).clip(0).sum(1, keepdims=True)
        hist = np.minimum(hist, limit) + excess // BINS + (np.arange(BINS) < excess % BINS)
    return _equalise_lut(hist)


def _luts(g: np.ndarray, clip_limit: float, grid: int):
    rows, cols = _tiles(g.shape[2], grid), _tiles(g.shape[3], grid)
    return rows, cols, {(i, j): _clipped_lut(g[:, 0, a:b, c:d], clip_limit) for i, (a, b) in enumerate(rows) for j, (c, d) in enumerate(cols)}


def clahe(s: np.ndarray, clip_limit: float = 2.0, grid_size: int = 2) -> np.ndarray:
    """Equalisation a tile, without blending."""
    g = gray(s)
    rows, cols, luts = _luts(g, clip_limit, grid_size)
    out, b = np.zeros(g.shape), bins_of(g)
    for i, (a, e) in enumerate(rows):
        for j, (c, d) in enumerate(cols):
            part = b[:, 0, a:e, c:d]
            out[:, 0, a:e, c:d] = np.take_along_axis(luts[i, j], part.reshape(len(g), -1), 1).reshape(part.shape)
    return out


def equalize_hist_adaptive(s: np.ndarray, clip_limit: float = 2.0, grid_size: int = 2) -> np.ndarray:
    """As :func:`clahe`, blended between the centres of the four nearest tiles."""
    g = gray(s)
    rows, cols, luts = _luts(g, clip_limit, grid_size)
    b = bins_of(g)[:, 0]

    def weights(size: int, tiles: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mid = np.array([(a + e - 1) / 2 for a, e in tiles])
        at = np.arange(size)
        hi = np.searchsorted(mid, at).clip(0, len(mid) - 1)
        lo = (hi - 1).clip(0)
        lo = np.where(at >= mid[hi], hi, lo)
        gap = mid[hi] - mid[lo]
        return lo, hi, np.where(gap > 0, (at - mid[lo]) / np.where(gap > 0, gap, 1), 0).clip(0, 1)

    y0, y1, wy = weights(g.shape[2], rows)
    x0, x1, wx = weights(g.shape[3], cols)
    table = np.stack([np.stack([luts[i, j] for j in range(len(cols))]) for i in range(len(rows))])  # rows, cols, n, 256
    n = np.arange(len(g))[:, None, None]
    pick = lambda ys, xs: table[ys[:, None], xs[None, :], n, b]
    top = pick(y0, x0) * (1 - wx) + pick(y0, x1) * wx
    low = pick(y1, x0) * (1 - wx) + pick(y1, x1) * wx
    return (top * (1 - wy[:, None]) + low * wy[:, None])[:, None]


METHODS = ("correlation", "chi_square", "intersection", "hellinger")


def compare_hist(a: Column, b: Column, method: str) -> Column:
    """Of two histograms as arrays."""
    zero = F.lit(0.0)
    add = lambda arr: F.aggregate(arr, zero, lambda s, x: s + x)
    pair = lambda f: add(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))))
    if method == "correlation":
        n = F.size(a)
        ma, mb = pair(lambda x, y: x) / n, pair(lambda x, y: y) / n
        num, da, db = pair(lambda x, y: (x - ma) * (y - mb)), pair(lambda x, y: (x - ma) * (x - ma)), pair(lambda x, y: (y - mb) * (y - mb))
        return F.coalesce(F.try_divide(num, F.sqrt(da * db)), zero)
    if method == "chi_square":
        return pair(lambda x, y: F.coalesce(F.try_divide((x - y) * (x - y), x + y), zero))
    if method == "intersection":
        return pair(lambda x, y: F.least(x, y))
    if method == "hellinger":
        return F.sqrt(pair(lambda x, y: (F.sqrt(x) - F.sqrt(y)) * (F.sqrt(x) - F.sqrt(y))) / 2)
    raise InvalidParameter(f"no histogram comparison {method!r}")


def compare_hist_color(a: Column, b: Column, method: str) -> Column:
    """Of two arrays of histograms, channel by channel."""
    return F.zip_with(a, b, lambda x, y: compare_hist(x, y, method))


def otsu_level(s: np.ndarray) -> np.ndarray:
    """Bin with the first largest between-class variance of each gray image."""
    hist = histogram(gray(s))[:, 0].astype(float)
    k = np.arange(BINS)
    w0, m0 = hist.cumsum(1), (hist * k).cumsum(1)
    w1, m1 = w0[:, -1:] - w0, m0[:, -1:] - m0
    live = (w0 > 0) & (w1 > 0)
    gap = m0 / np.where(w0 > 0, w0, 1) - m1 / np.where(w1 > 0, w1, 1)
    # Bins that part the pixels alike, or in mirrored ways, differ by rounding only: the first of those equal to six digits is taken.
    return np.floor(np.where(live, w0 * w1 * (gap * gap), 0) * 1e6 + 0.5).argmax(1)


def triangle_level(s: np.ndarray) -> np.ndarray:
    """Bin farthest from the line between the histogram's peak and its last used bin."""
    out = []
    for hist in histogram(gray(s))[:, 0].astype(float):
        peak, last = int(hist.argmax()), int(np.flatnonzero(hist).max(initial=0))
        if peak == last:
            out.append(peak)
            continue
        k = np.arange(peak, last + 1)
        dx, dy = last - peak, -hist[peak]
        out.append(int(k[np.abs(dy * (k - peak) - dx * (hist[k] - hist[peak])).argmax()]))
    return np.array(out)


def _over(s: np.ndarray, level: np.ndarray, maxval: float) -> np.ndarray:
    return np.where(s > level[:, None, None, None] / 255.0, maxval, 0.0)


def threshold_otsu(s: np.ndarray, maxval: float = 1.0) -> np.ndarray:
    return _over(s, otsu_level(s), maxval)


def threshold_triangle(s: np.ndarray, maxval: float = 1.0) -> np.ndarray:
    return _over(s, triangle_level(s), maxval)


def hog(a: np.ndarray, cell_size: int = 4, block_size: int = 2, nbins: int = 9) -> list[float]:
    """Histogram of oriented gradients of one image: unsigned angles, linear votes, L2 blocks."""
    g = gray(a[None])[0, 0]
    p = np.pad(g, 1, mode="edge")
    gx, gy = p[1:-1, 2:] - p[1:-1, :-2], p[2:, 1:-1] - p[:-2, 1:-1]
    size, angle = np.hypot(gx, gy), np.mod(np.arctan2(gy, gx), np.pi)
    at = angle / np.pi * nbins - 0.5
    low = np.floor(at).astype(int)
    frac = at - low
    ch, cw = g.shape[0] // cell_size, g.shape[1] // cell_size
    cells = np.zeros((ch, cw, nbins))
    y, x = np.mgrid[: ch * cell_size, : cw * cell_size]
    part = (slice(0, ch * cell_size), slice(0, cw * cell_size))
    for b, v in ((low, 1 - frac), (low + 1, frac)):
        np.add.at(cells, (y // cell_size, x // cell_size, b[part] % nbins), (size * v)[part])
    out = []
    for i in range(ch - block_size + 1):
        for j in range(cw - block_size + 1):
            v = cells[i : i + block_size, j : j + block_size].ravel()
            out += (v / np.sqrt((v * v).sum() + 1e-12)).tolist()
    return out
