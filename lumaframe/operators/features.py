"""Key points, descriptors, template and stereo matching, homographies, stitching, exposure fusion."""

from __future__ import annotations

import math

import numpy as np

from ..schema import DimensionMismatch, InvalidParameter
from .filters import gray
from .geometry import apply_homography

#: The circle of radius 3 around a pixel, (dy, dx), clockwise from the top.
CIRCLE = ((-3, 0), (-3, 1), (-2, 2), (-1, 3), (0, 3), (1, 3), (2, 2), (3, 1), (3, 0), (3, -1), (2, -2), (1, -3), (0, -3), (-1, -3), (-2, -2), (-3, -1))
KEYPOINTS = "array<struct<x:double,y:double,size:double,angle:double,response:double,octave:int,class_id:int>>"


def orientation(g: np.ndarray, x: int, y: int, r: int = 15) -> float:
    """Degrees of the intensity centroid in a 31x31 window."""
    y0, y1, x0, x1 = max(0, y - r), min(g.shape[0], y + r + 1), max(0, x - r), min(g.shape[1], x + r + 1)
    gy, gx = np.mgrid[y0:y1, x0:x1]
    part = g[y0:y1, x0:x1]
    return math.degrees(math.atan2((part * (gy - y)).sum(), (part * (gx - x)).sum()))


def detect_keypoints(a: np.ndarray, max_features: int = 500, threshold: float = 10 / 255, apart: float = 7.0) -> list[dict]:
    """FAST-9 corners, best first; those within ``apart`` of a better one are dropped after the cut to ``max_features``."""
    g = gray(a[None])[0, 0]
    h, w = g.shape
    if h < 7 or w < 7:
        return []
    ring = np.stack([g[3 + dy : h - 3 + dy, 3 + dx : w - 3 + dx] for dy, dx in CIRCLE])
    d = ring - g[3:-3, 3:-3]
    found = np.zeros(d.shape[1:], bool)
    for sign in (1, -1):
        over = sign * d > threshold
        twice = np.concatenate([over, over[:8]])
        nine = np.logical_or.reduce([twice[k : k + 9].all(0) for k in range(16)])
        found |= nine & over[[0, 4, 8, 12]].all(0)
    score = np.abs(d).mean(0)
    ys, xs = np.nonzero(found)
    best = sorted(zip((-score[ys, xs]).tolist(), ys.tolist(), xs.tolist(), strict=True))[:max_features]
    out: list[dict] = []
    for s, y, x in best:
        if all(math.hypot(x + 3 - k["x"], y + 3 - k["y"]) >= apart for k in out):
            out.append({"x": float(x + 3), "y": float(y + 3), "size": 7.0, "angle": orientation(g, x + 3, y + 3), "response": -s, "octave": 0, "class_id": -1})
    return out


def lcg(seed: int):
    """Uniform 32-bit numbers of a linear congruential generator."""
    state = seed
    while True:
        state = (state * 1664525 + 1013904223) & 0xFFFFFFFF
        yield state


def brief_pattern(seed: int = 42, pairs: int = 256, reach: int = 15) -> np.ndarray:
    """Test pairs (x1, y1, x2, y2) within ``reach`` of the key point, from a fixed seed."""
    draw = lcg(seed)
    return np.array([(next(draw) >> 8) % (2 * reach + 1) - reach for _ in range(4 * pairs)]).reshape(pairs, 4)


def describe(a: np.ndarray, keypoints: list[dict]) -> list[list[float]]:
    """Rotated binary tests as 32 bytes each; tests outside the image read 0."""
    g, p = gray(a[None])[0, 0], brief_pattern()
    out = []
    for k in keypoints:
        c, s = math.cos(math.radians(k["angle"])), math.sin(math.radians(k["angle"]))

        def at(x, y, c=c, s=s, k=k):
            u, v = np.floor(k["x"] + c * x - s * y + 0.5).astype(int), np.floor(k["y"] + s * x + c * y + 0.5).astype(int)
            ok = (u >= 0) & (v >= 0) & (u < g.shape[1]) & (v < g.shape[0])
            return np.where(ok, g[np.clip(v, 0, g.shape[0] - 1), np.clip(u, 0, g.shape[1] - 1)], 0)

        bits = at(p[:, 0], p[:, 1]) < at(p[:, 2], p[:, 3])
        out.append(np.packbits(bits.reshape(32, 8)[:, ::-1], axis=1).ravel().astype(float).tolist())
    return out


def nearest(query: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and distance of each query's nearest row; the first of equals."""
    d = np.maximum((query**2).sum(1)[:, None] + (train**2).sum(1)[None] - 2 * query @ train.T, 0)
    best = d.argmin(1)
    return best, np.sqrt(((query - train[best]) ** 2).sum(1))


TEMPLATE_METHODS = ("sqdiff", "sqdiff_normed", "ccorr", "ccorr_normed", "ccoeff", "ccoeff_normed")


def template_match(a: np.ndarray, template: np.ndarray, method: str = "sqdiff") -> np.ndarray:
    """Score of each placement of the template; a zero denominator gives 0."""
    if method not in TEMPLATE_METHODS:
        raise InvalidParameter(f"no method {method!r}")
    c = min(len(a), len(template))
    a, t = a[:c], np.asarray(template, float)[:c]
    if t.shape[1] > a.shape[1] or t.shape[2] > a.shape[2]:
        raise DimensionMismatch("the template is larger than the image")
    w = np.lib.stride_tricks.sliding_window_view(a, t.shape[1:], (1, 2))
    if method.startswith("ccoeff"):
        w = w - w.mean((-2, -1), keepdims=True)
        t = t - t.mean((1, 2), keepdims=True)
    axes = "cyxij,cij->yx"
    cross, own, tt = np.einsum(axes, w, t), np.einsum("cyxij,cyxij->yx", w, w), (t * t).sum()
    value = own - 2 * cross + tt if method.startswith("sqdiff") else cross
    if method.endswith("normed"):
        den = np.sqrt(own * tt)
        value = np.where(den > 1e-12, value / np.where(den > 1e-12, den, 1), 0)
    return value[None]


def stereo_match(left: np.ndarray, right: np.ndarray, block_size: int = 5, num_disparities: int = 16, min_disparity: int = 0) -> np.ndarray:
    """Sixteen times the first disparity with the least sum of absolute differences; 0 where a block leaves the image."""
    if block_size % 2 == 0 or block_size < 1 or num_disparities < 1:
        raise InvalidParameter("block size must be odd, and disparities positive")
    if left.shape != right.shape or len(left) != 1:
        raise DimensionMismatch("one channel and equal sizes are needed")
    h, w = left.shape[1:]
    r, best, out = block_size // 2, np.full((h, w), np.inf), np.zeros((h, w))
    for d in range(min_disparity, min_disparity + num_disparities):
        moved = np.full((h, w), np.nan)
        if d < w:
            src = right[0, :, : w - d] if d >= 0 else right[0, :, -d:]
            moved[:, d:] = src if d >= 0 else np.nan
            if d < 0:
                moved[:, :d] = src
        cost = np.full((h, w), np.inf)
        sad = np.lib.stride_tricks.sliding_window_view(np.abs(left[0] - moved), (block_size, block_size)).sum((-2, -1)) if min(h, w) >= block_size else np.zeros((0, 0))
        if sad.size:
            cost[r : h - r, r : w - r] = np.where(np.isnan(sad), np.inf, sad)
        better = cost < best
        best[better], out[better] = cost[better], d
    return (out * 16)[None]


# --- homographies and stitching ----------------------------------------------------------


def _normalised(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points around the origin at a mean distance of sqrt 2, and the matrix."""
    mid = p.mean(0)
    far = np.hypot(*(p - mid).T).mean()
    s = math.sqrt(2) / far if far > 1e-12 else 1.0
    t = np.array([[s, 0, -s * mid[0]], [0, s, -s * mid[1]], [0, 0, 1]])
    return (p - mid) * s, t


def homography_dlt(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """By the normalised direct linear transform."""
    if len(src) < 4:
        raise InvalidParameter("four pairs are needed")
    (p, tp), (q, tq) = _normalised(np.asarray(src, float)), _normalised(np.asarray(dst, float))
    rows = []
    for (x, y), (u, v) in zip(p, q, strict=True):
        rows += [[-x, -y, -1, 0, 0, 0, u * x, u * y, u], [0, 0, 0, -x, -y, -1, v * x, v * y, v]]
    h = np.linalg.inv(tq) @ np.linalg.svd(np.array(rows))[2][-1].reshape(3, 3) @ tp
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else h


def ransac_homography(src, dst, iterations: int = 1000, inlier: float = 5.0, seed: int = 12345) -> np.ndarray:
    src, dst = np.asarray(src, float), np.asarray(dst, float)
    n, draw, best = len(src), lcg(seed), np.zeros(len(src), bool)
    if n < 4:
        raise InvalidParameter("four pairs are needed")
    for _ in range(iterations if n > 4 else 1):
        pick = list(range(4)) if n == 4 else []
        while len(pick) < 4:
            k = (next(draw) >> 8) % n
            if k not in pick:
                pick.append(k)
        try:
            h = homography_dlt(src[pick], dst[pick])
        except np.linalg.LinAlgError:
            continue
        with np.errstate(all="ignore"):
            u, v = apply_homography(h, src[:, 0], src[:, 1])
            ok = np.hypot(u - dst[:, 0], v - dst[:, 1]) < inlier
        if ok.sum() > best.sum():
            best = ok
        if best.all():
            break
    return homography_dlt(src[best], dst[best]) if best.sum() >= 4 else homography_dlt(src, dst)


def image_homography(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """From matched key points of two images; the identity where either has fewer than four."""
    ka, kb = detect_keypoints(a), detect_keypoints(b)
    if min(len(ka), len(kb)) < 4:
        return np.eye(3)
    da, db = np.array(describe(a, ka)), np.array(describe(b, kb))
    to, dist = nearest(da, db)
    keep = dist <= 1.5 * np.median(dist)
    if keep.sum() < 4:
        raise InvalidParameter("too few matches")
    at = lambda ks: np.array([(k["x"], k["y"]) for k in ks])
    return ransac_homography(at(ka)[keep], at(kb)[to[keep]])


def stitch(images: list[np.ndarray]) -> np.ndarray:
    """Images in the first one's plane, blended by the distance from their borders."""
    if not images:
        raise InvalidParameter("no images")
    chain = [np.eye(3)]
    for a, b in zip(images, images[1:], strict=False):
        chain.append(chain[-1] @ np.linalg.inv(image_homography(a, b)))
    corners = np.array([apply_homography(m, x, y) for a, m in zip(images, chain, strict=True) for x in (0, a.shape[2] - 1) for y in (0, a.shape[1] - 1)])
    low, high = np.floor(corners.min(0)).astype(int), np.ceil(corners.max(0)).astype(int)
    w, h = np.minimum(high - low + 1, 16_384)
    c = max(len(a) for a in images)
    total, weight = np.zeros((c, h, w)), np.zeros((h, w))
    gy, gx = np.mgrid[:h, :w]
    for a, m in zip(images, chain, strict=True):
        u, v = apply_homography(np.linalg.inv(m), gx + low[0], gy + low[1])
        iu, iv = np.floor(u + 0.5).astype(int), np.floor(v + 0.5).astype(int)
        ok = (iu >= 0) & (iv >= 0) & (iu < a.shape[2]) & (iv < a.shape[1])
        iu, iv = np.clip(iu, 0, a.shape[2] - 1), np.clip(iv, 0, a.shape[1] - 1)
        edge = np.minimum(np.minimum(iu, a.shape[2] - 1 - iu), np.minimum(iv, a.shape[1] - 1 - iv)) + 1.0
        k = np.where(ok, edge, 0)
        total[: len(a)] += a[:, iv, iu] * k
        weight += k
    return total / np.where(weight > 0, weight, 1)


def draw_matches(a: np.ndarray, ka: list[dict], b: np.ndarray, kb: list[dict], matches: list[tuple[int, int]]) -> np.ndarray:
    from .drawing import draw_line

    rgb = lambda x: np.repeat(x[:1], 3, 0) if len(x) < 3 else x[:3]
    out = np.zeros((3, max(a.shape[1], b.shape[1]), a.shape[2] + b.shape[2]))
    out[:, : a.shape[1], : a.shape[2]] = rgb(a)
    out[:, : b.shape[1], a.shape[2] :] = rgb(b)
    for i, j in matches:
        out = draw_line(out, (round(ka[i]["x"]), round(ka[i]["y"])), (round(kb[j]["x"]) + a.shape[2], round(kb[j]["y"])), (0, 1, 0))
    return out


def exposure_fusion(images: list[np.ndarray], contrast: float = 1.0, saturation: float = 1.0, exposure: float = 1.0) -> np.ndarray:
    """Mean of the exposures, weighted a pixel by contrast, saturation and closeness to middle gray."""
    weights = []
    for a in images:
        g = np.pad(gray(a[None])[0, 0], 1, mode="edge")
        edge = np.abs(g[1:-1, :-2] + g[1:-1, 2:] + g[:-2, 1:-1] + g[2:, 1:-1] - 4 * g[1:-1, 1:-1])
        weights.append(edge**contrast * a.std(0) ** saturation * np.exp(-((a - 0.5) ** 2) / (2 * 0.2**2)).prod(0) ** exposure)
    w = np.stack(weights)
    total = w.sum(0)
    w = np.where(total < 1e-10, 1 / len(images), w / np.where(total < 1e-10, 1, total))
    return (np.stack(images) * w[:, None]).sum(0)


# --- noise -------------------------------------------------------------------------------


def _uniforms(n: int, seed: int) -> np.ndarray:
    draw = lcg(seed)
    return np.array([next(draw) for _ in range(n)]) / 2.0**32


def _normals(n: int, seed: int) -> np.ndarray:
    u = _uniforms(2 * ((n + 1) // 2) + 2, seed)
    r, t = np.sqrt(-2 * np.log(np.maximum(u[0::2], 1e-12))), 2 * np.pi * u[1::2]
    return np.stack([r * np.cos(t), r * np.sin(t)], 1).ravel()[:n]


def add_gaussian_noise(a: np.ndarray, mean: float, std: float, seed: int = 42) -> np.ndarray:
    return np.clip(a + mean + std * _normals(a.size, seed).reshape(a.shape), 0, 1)


def add_speckle_noise(a: np.ndarray, std: float, seed: int = 42) -> np.ndarray:
    return np.clip(a + a * std * _normals(a.size, seed).reshape(a.shape), 0, 1)


def add_salt_pepper_noise(a: np.ndarray, amount: float, seed: int = 42) -> np.ndarray:
    if not 0 <= amount <= 1:
        raise InvalidParameter("the amount lies in [0, 1]")
    out, n = a.copy(), int(a.shape[1] * a.shape[2] * amount)
    u = _uniforms(3 * n, seed).reshape(n, 3)
    for y, x, salt in u:
        out[:, int(y * a.shape[1]), int(x * a.shape[2])] = float(salt >= 0.5)
    return out
