"""Neighbourhood filters, gradients, morphology and adaptive thresholds.

Kernels take stacks ``(n, c, h, w)``. Square and Gaussian kernels run as two
one-dimensional passes. Each operator keeps its border rule: *inside* counts only
neighbours within the image, *clamp* repeats the edge, *zero* pads with 0, *skip* gives 0
on the outer ring.
"""

from __future__ import annotations

import math

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

from ..schema import InvalidParameter

LUMA = np.array([0.299, 0.587, 0.114])


def odd(k: int) -> int:
    if k < 1 or k % 2 == 0:
        raise InvalidParameter("the kernel size must be odd")
    return k


def gray(s: np.ndarray) -> np.ndarray:
    if s.shape[1] == 1:
        return s
    if s.shape[1] < 3:
        raise InvalidParameter("one channel, or three, are needed")
    return np.tensordot(LUMA, s[:, :3], (0, 1))[:, None]


def padded(s: np.ndarray, r: int, mode: str, value: float = 0.0) -> np.ndarray:
    pad = [(0, 0), (0, 0), (r, r), (r, r)]
    return np.pad(s, pad, mode="edge") if mode == "clamp" else np.pad(s, pad, constant_values=value)


def windows(s: np.ndarray, kh: int, kw: int) -> np.ndarray:
    return sliding_window_view(s, (kh, kw), (2, 3))


def _pass(s: np.ndarray, kernel: np.ndarray, axis: int, mode: str) -> np.ndarray:
    r = len(kernel) // 2
    pad = [(0, 0)] * 4
    pad[axis] = (r, r)
    p = np.pad(s, pad, mode="edge") if mode == "clamp" else np.pad(s, pad)
    return sliding_window_view(p, len(kernel), axis) @ kernel


def separable(s: np.ndarray, kx: np.ndarray, ky: np.ndarray, mode: str = "clamp") -> np.ndarray:
    return _pass(_pass(s, np.asarray(kx, float), 3, mode), np.asarray(ky, float), 2, mode)


def gaussian_kernel(k: int, sigma: float) -> np.ndarray:
    d = np.arange(k) - k // 2
    g = np.exp(-(d * d) / (2 * sigma * sigma))
    return g / g.sum()


def box_blur(s: np.ndarray, kernel_size: int = 3) -> np.ndarray:
    ones = np.ones(odd(kernel_size))
    return separable(s, ones, ones, "zero") / separable(np.ones((1, 1, *s.shape[2:])), ones, ones, "zero")


def gaussian_blur(s: np.ndarray, kernel_size: int = 3, sigma: float = 1.0) -> np.ndarray:
    g = gaussian_kernel(odd(kernel_size), sigma)
    return separable(s, g, g, "clamp")


def median_blur(s: np.ndarray, kernel_size: int = 3) -> np.ndarray:
    """The upper median of the neighbours inside."""
    r = odd(kernel_size) // 2
    w = np.sort(windows(padded(s, r, "zero", np.inf), kernel_size, kernel_size).reshape(*s.shape, -1), -1)
    n = np.isfinite(w).sum(-1)
    return np.take_along_axis(w, (n // 2)[..., None], -1)[..., 0]


def filter2d(s: np.ndarray, kernel, anchor: tuple[int, int] | None = None, delta: float = 0.0) -> np.ndarray:
    """Correlation with zeros outside; ``anchor`` is (row, column), the centre by default."""
    k = np.asarray(kernel, float)
    kh, kw = k.shape
    ay, ax = anchor or (kh // 2, kw // 2)
    p = np.pad(s, [(0, 0), (0, 0), (ay, kh - 1 - ay), (ax, kw - 1 - ax)])
    return np.einsum("nchwij,ij->nchw", windows(p, kh, kw), k) + delta


def log_kernel(sigma: float) -> np.ndarray:
    k = int(6 * sigma) | 1
    y, x = np.mgrid[:k, :k] - k // 2
    q = (x * x + y * y) / (2 * sigma * sigma)
    g = -(1 - q) * np.exp(-q) / (math.pi * sigma**4)
    return g - g.mean()


def laplacian_of_gaussian(s: np.ndarray, sigma: float = 1.0, compat: bool = False) -> np.ndarray:
    """``compat`` starts the window at the pixel instead of centring it there."""
    k, g = log_kernel(sigma), gray(s)
    n = len(k)
    before = 0 if compat else n // 2
    p = np.pad(g, [(0, 0), (0, 0), (before, n - 1 - before), (before, n - 1 - before)], mode="edge")
    return np.einsum("nchwij,ij->nchw", windows(p, n, n), k)


def bilateral_filter(s: np.ndarray, d: int = 5, sigma_color: float = 0.1, sigma_space: float = 2.0) -> np.ndarray:
    r = int(math.floor(3 * sigma_space + 0.5)) if d <= 0 else d // 2
    w = windows(padded(s, r, "zero", np.nan), 2 * r + 1, 2 * r + 1)
    y, x = np.mgrid[-r : r + 1, -r : r + 1]
    near = np.exp(-(x * x + y * y) / (2 * sigma_space**2))
    weight = near * np.exp(-((w - s[..., None, None]) ** 2) / (2 * sigma_color**2))
    weight = np.where(np.isnan(w), 0, weight)
    return (weight * np.nan_to_num(w)).sum((-2, -1)) / weight.sum((-2, -1))


def sep_filter_2d(s: np.ndarray, kernel_x, kernel_y) -> np.ndarray:
    odd(len(kernel_x)), odd(len(kernel_y))
    return separable(s, np.asarray(kernel_x, float), np.asarray(kernel_y, float), "clamp")


def _inner(s: np.ndarray, f) -> np.ndarray:
    """``f`` on 3x3 windows, 0 on the outer ring."""
    out = np.zeros(s.shape)
    if min(s.shape[2:]) >= 3:
        out[:, :, 1:-1, 1:-1] = f(windows(s, 3, 3))
    return out


SOBEL = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]], float)
SCHARR = np.array([[-3, 0, 3], [-10, 0, 10], [-3, 0, 3]], float)
CROSS = np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0]], float)


def gradients(s: np.ndarray, kernel: np.ndarray = SOBEL) -> tuple[np.ndarray, np.ndarray]:
    g = gray(s)
    at = lambda k: _inner(g, lambda w: np.einsum("nchwij,ij->nchw", w, k))
    return at(kernel), at(kernel.T)


def sobel(s: np.ndarray) -> np.ndarray:
    return np.hypot(*gradients(s))


def scharr(s: np.ndarray) -> np.ndarray:
    return np.hypot(*gradients(s, SCHARR))


def laplacian(s: np.ndarray) -> np.ndarray:
    return np.abs(gradients(s, CROSS)[0])


# --- morphology ---------------------------------------------------------------


def _extreme(s: np.ndarray, k: int, low: bool) -> np.ndarray:
    r = odd(k) // 2
    w = padded(s, r, "zero", np.inf if low else -np.inf)
    f = np.min if low else np.max
    return f(sliding_window_view(f(sliding_window_view(w, k, 3), -1), k, 2), -1)


def dilate(s: np.ndarray, kernel_size: int = 3) -> np.ndarray:
    return _extreme(s, kernel_size, False)


def erode(s: np.ndarray, kernel_size: int = 3) -> np.ndarray:
    return _extreme(s, kernel_size, True)


def _masked(s: np.ndarray, kernel, low: bool) -> np.ndarray:
    k = np.asarray(kernel) != 0
    kh, kw = k.shape
    none = np.inf if low else -np.inf
    p = np.pad(s, [(0, 0), (0, 0), (kh // 2, kh - 1 - kh // 2), (kw // 2, kw - 1 - kw // 2)], constant_values=none)
    w = windows(p, kh, kw)[..., k]
    out = (w.min(-1, initial=np.inf) if low else w.max(-1, initial=-np.inf)) if k.any() else np.full(s.shape, none)
    return np.where(np.isinf(out), s, out)


def dilate_with_kernel(s: np.ndarray, kernel) -> np.ndarray:
    return _masked(s, kernel, False)


def erode_with_kernel(s: np.ndarray, kernel) -> np.ndarray:
    return _masked(s, kernel, True)


def morph_open(s: np.ndarray, kernel_size: int = 3) -> np.ndarray:
    return dilate(erode(s, kernel_size), kernel_size)


def morph_close(s: np.ndarray, kernel_size: int = 3) -> np.ndarray:
    return erode(dilate(s, kernel_size), kernel_size)


def morphology_ex(s: np.ndarray, op: str, kernel_size: int = 3) -> np.ndarray:
    forms = {
        "opening": lambda: morph_open(s, kernel_size),
        "closing": lambda: morph_close(s, kernel_size),
        "gradient": lambda: dilate(s, kernel_size) - erode(s, kernel_size),
        "top_hat": lambda: s - morph_open(s, kernel_size),
        "black_hat": lambda: morph_close(s, kernel_size) - s,
    }
    if op not in forms:
        raise InvalidParameter(f"no morphological operator {op!r}")
    return forms[op]()


def get_structuring_element(shape: str, width: int, height: int) -> list[list[int]]:
    y, x = np.mgrid[:height, :width]
    cy, cx = height // 2, width // 2
    if shape == "rect":
        out = np.ones((height, width), int)
    elif shape == "cross":
        out = ((y == cy) | (x == cx)).astype(int)
    elif shape == "ellipse":
        ry, rx = max(height / 2, 0.5), max(width / 2, 0.5)
        out = (((y - cy) / ry) ** 2 + ((x - cx) / rx) ** 2 <= 1.05).astype(int)
    else:
        raise InvalidParameter(f"no shape {shape!r}")
    return out.tolist()


def hit_or_miss(s: np.ndarray, pattern, background) -> np.ndarray:
    """1 where all of ``pattern`` is set (over 0.5) and all of ``background`` is not; outside never matches."""
    out = np.ones(s.shape, bool)
    for k, want in ((np.asarray(pattern) != 0, True), (np.asarray(background) != 0, False)):
        kh, kw = k.shape
        p = np.pad(s, [(0, 0), (0, 0), (kh // 2, kh - 1 - kh // 2), (kw // 2, kw - 1 - kw // 2)], constant_values=np.nan)
        w = windows(p, kh, kw)[..., k]
        out &= ((w > 0.5) if want else (w <= 0.5)).all(-1)
    return out.astype(float)


def thin(s: np.ndarray) -> np.ndarray:
    """Zhang-Suen thinning of each image's first plane until nothing changes."""
    out = s.copy()
    for a in out:
        on = np.pad(a[0] > 0.5, 1)
        while True:
            before = on.copy()
            for step in (0, 1):
                p = [np.roll(on, shift, (0, 1))[1:-1, 1:-1] for shift in ((1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1))]
                count = sum(q.astype(int) for q in p)
                turns = sum((~p[k] & p[(k + 1) % 8]).astype(int) for k in range(8))
                n, e, so, w = p[0], p[2], p[4], p[6]
                keep = (n & e & so) | (e & so & w) if step == 0 else (n & e & w) | (n & so & w)
                drop = on[1:-1, 1:-1] & (count >= 2) & (count <= 6) & (turns == 1) & ~keep
                drop[[0, -1]] = False
                drop[:, [0, -1]] = False
                on[1:-1, 1:-1] &= ~drop
            if (on == before).all():
                break
        a[:] = np.where(on[1:-1, 1:-1], a, 0)
        a[0] = on[1:-1, 1:-1]
    return out


def skeleton(s: np.ndarray, compat: bool = False) -> np.ndarray:
    """Union of what opening removes from successive erosions; ``compat`` goes on from the opened image."""
    cross, cur = [[0, 1, 0], [1, 1, 1], [0, 1, 0]], (s > 0.5).astype(float)
    out = np.zeros(s.shape, bool)
    for _ in range(max(s.shape[2:]) + 1):
        small = erode_with_kernel(np.pad(cur, [(0, 0), (0, 0), (1, 1), (1, 1)]), cross)[:, :, 1:-1, 1:-1]
        opened = dilate_with_kernel(small, cross)
        out |= cur - opened > 0.5
        nxt = opened if compat else small
        if (nxt == cur).all() or not nxt.any():
            break
        cur = nxt
    return out.astype(float)


def distance_transform(s: np.ndarray) -> np.ndarray:
    """Two-pass chamfer distance (1, sqrt 2) to the nearest pixel over 0.5, as a share of the largest."""
    g = gray(s)
    n, _, h, w = g.shape
    d = np.where(np.pad(g[:, 0], [(0, 0), (1, 1), (1, 1)]) > 0.5, 0.0, np.inf)
    q = math.sqrt(2)
    for ys, xs, sign in ((range(1, h + 1), range(1, w + 1), -1), (range(h, 0, -1), range(w, 0, -1), 1)):
        for y in ys:
            row = d[:, y + sign]
            d[:, y, 1:-1] = np.minimum(d[:, y, 1:-1], np.minimum(row[:, 1:-1] + 1, np.minimum(row[:, :-2], row[:, 2:]) + q))
            for x in xs:
                d[:, y, x] = np.minimum(d[:, y, x], d[:, y, x + sign] + 1)
            d[:, y, 0] = d[:, y, -1] = np.inf
    d = d[:, 1:-1, 1:-1]
    top = np.where(np.isfinite(d), d, 0).max((1, 2), keepdims=True)
    return np.where(np.isfinite(d), d / np.where(top > 0, top, 1), 1.0)[:, None]


def adaptive_threshold(s: np.ndarray, maxval: float, method: str, block_size: int, c: float) -> np.ndarray:
    """``maxval`` where a pixel is over its neighbourhood's mean less ``c``; weights outside the image do not count."""
    g = gray(s)
    if method == "mean":
        mean = box_blur(g, block_size)
    elif method == "gaussian":
        k = gaussian_kernel(odd(block_size), block_size / 6)
        mean = separable(g, k, k, "zero") / separable(np.ones_like(g[:1]), k, k, "zero")
    else:
        raise InvalidParameter(f"no adaptive method {method!r}")
    return np.where(g > mean - c, maxval, 0.0)


def nlm_photo(s: np.ndarray, h: float = 0.1, patch_radius: int = 1, search_radius: int = 2) -> np.ndarray:
    """Non-local means a channel; neighbours whose patch leaves the image are passed over."""
    r, p = search_radius, patch_radius
    size = s.shape[2:]
    big = padded(s, r + p, "zero", np.nan)
    own = windows(padded(s, p, "clamp"), 2 * p + 1, 2 * p + 1)
    num, den = np.zeros(s.shape), np.zeros(s.shape)
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            part = big[:, :, r + dy : r + dy + size[0] + 2 * p, r + dx : r + dx + size[1] + 2 * p]
            dist = ((windows(part, 2 * p + 1, 2 * p + 1) - own) ** 2).mean((-2, -1))
            weight = np.exp(-dist / (h * h)) * math.exp(-2 * (dx * dx + dy * dy) / max(r * r, 1))
            weight = np.where(np.isnan(weight), 0, weight)
            num += weight * np.nan_to_num(part[:, :, p : p + size[0], p : p + size[1]])
            den += weight
    return np.clip(np.where(den > 0, num / np.where(den > 0, den, 1), s), 0, 1)


def nlm(s: np.ndarray, h: float = 0.1, template_size: int = 3, search_size: int = 5) -> np.ndarray:
    """Non-local means over all channels together, edges repeated."""
    p, r = template_size // 2, search_size // 2
    size = s.shape[2:]
    big = padded(s, r + p, "clamp")
    own = windows(padded(s, p, "clamp"), 2 * p + 1, 2 * p + 1)
    num, den = np.zeros(s.shape), np.zeros((len(s), 1, *size))
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            part = big[:, :, r + dy : r + dy + size[0] + 2 * p, r + dx : r + dx + size[1] + 2 * p]
            dist = ((windows(part, 2 * p + 1, 2 * p + 1) - own) ** 2).mean((1, -2, -1))[:, None]
            weight = np.exp(-dist / (h * h))
            num += weight * part[:, :, p : p + size[0], p : p + size[1]]
            den += weight
    return num / den
