"""Operators that are sequential within an image: components, growing, tracing, lines, circles, inpainting."""

from __future__ import annotations

import heapq
import math
from collections import deque

import numpy as np

from ..schema import DimensionMismatch, InvalidParameter
from .filters import gaussian_blur, gradients, gray

FOUR = ((-1, 0), (1, 0), (0, -1), (0, 1))
EIGHT = tuple((dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx)


def _plane(a: np.ndarray) -> np.ndarray:
    return gray(a[None])[0, 0]


def label(mask: np.ndarray, around=FOUR) -> np.ndarray:
    """Component numbers in raster order, from 1."""
    out, h, w, k = np.zeros(mask.shape, int), *mask.shape, 0
    for y, x in zip(*np.nonzero(mask), strict=True):
        if out[y, x]:
            continue
        k += 1
        out[y, x] = k
        todo = deque([(y, x)])
        while todo:
            cy, cx = todo.popleft()
            for dy, dx in around:
                ny, nx = cy + dy, cx + dx
                if 0 <= ny < h and 0 <= nx < w and mask[ny, nx] and not out[ny, nx]:
                    out[ny, nx] = k
                    todo.append((ny, nx))
    return out


def connected_components(a: np.ndarray) -> np.ndarray:
    return label(a[0] > 0.5)[None].astype(float)


STATS = "array<struct<label:int,x:int,y:int,width:int,height:int,area:long,cx:double,cy:double>>"


def component_stats(a: np.ndarray) -> list[dict]:
    labels, out = label(a[0] > 0.5), []
    for k in range(1, labels.max(initial=0) + 1):
        y, x = np.nonzero(labels == k)
        out.append({"label": k, "x": int(x.min()), "y": int(y.min()), "width": int(np.ptp(x)) + 1, "height": int(np.ptp(y)) + 1, "area": len(x), "cx": float(x.mean()), "cy": float(y.mean())})
    return out


def watershed(a: np.ndarray, markers: np.ndarray, compat: bool = False) -> np.ndarray:
    """Markers over 0 grow into their neighbours, lowest pixel first (``compat``: highest first)."""
    g, out = _plane(a), np.asarray(markers, int).reshape(a.shape[1:]).copy()
    if not (out > 0).any():
        raise InvalidParameter("no markers")
    sign, seq, heap = (-1 if compat else 1), 0, []
    for y, x in zip(*np.nonzero(out > 0), strict=True):
        heap.append((sign * g[y, x], seq, y, x))
        seq += 1
    heapq.heapify(heap)
    h, w = g.shape
    while heap:
        _, _, y, x = heapq.heappop(heap)
        for dy, dx in FOUR:
            ny, nx = y + dy, x + dx
            if 0 <= ny < h and 0 <= nx < w and out[ny, nx] <= 0:
                out[ny, nx] = out[y, x]
                heapq.heappush(heap, (sign * g[ny, nx], seq, ny, nx))
                seq += 1
    return out[None].astype(float)


def flood_fill(a: np.ndarray, seed_x: int, seed_y: int, fill_value: float, lo_diff: float, hi_diff: float) -> np.ndarray:
    g = _plane(a).copy()
    if not (0 <= seed_y < g.shape[0] and 0 <= seed_x < g.shape[1]):
        raise InvalidParameter("the seed lies outside")
    s = g[seed_y, seed_x]
    labels = label((g >= s - lo_diff) & (g <= s + hi_diff))
    g[labels == labels[seed_y, seed_x]] = fill_value
    return g[None]


def canny(a: np.ndarray, low: float, high: float) -> np.ndarray:
    """Thresholds are in gradient units of [0, 1] pixels."""
    gx, gy = (v[0, 0] for v in gradients(gaussian_blur(gray(a[None]), 5, 1.4)))
    size, angle = np.hypot(gx, gy), np.degrees(np.arctan2(gy, gx)) % 180
    sector = (np.floor((angle + 22.5) / 45) % 4).astype(int)
    p = np.pad(size, 1)
    h, w = size.shape
    at = lambda dy, dx: p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    ahead = np.choose(sector, [at(0, 1), at(1, 1), at(1, 0), at(1, -1)])
    behind = np.choose(sector, [at(0, -1), at(-1, -1), at(-1, 0), at(-1, 1)])
    thin = np.where((size >= ahead) & (size >= behind), size, 0)
    thin[[0, -1]] = 0
    thin[:, [0, -1]] = 0
    weak = label(thin >= low, EIGHT)
    strong = np.unique(weak[(thin >= high) & (weak > 0)])
    return (np.isin(weak, strong) & (weak > 0)).astype(float)[None]


def hough_lines_p(a: np.ndarray, rho: float, theta: float, threshold: int, min_length: float, max_gap: float) -> list[dict]:
    """Segments of collinear pixels over 0.5 at local peaks of the (rho, theta) votes."""
    y, x = np.nonzero(a[0] > 0.5)
    n = max(1, round(math.pi / theta))
    t = np.arange(n) * theta
    far = math.hypot(*a.shape[1:])
    r = np.floor((np.outer(x, np.cos(t)) + np.outer(y, np.sin(t)) + far) / rho + 0.5).astype(int)
    votes = np.zeros((int(2 * far / rho) + 3, n), int)
    np.add.at(votes, (r, np.arange(n)[None]), 1)
    inner = votes[1:-1, 1:-1]
    peak = (inner >= threshold) & (inner >= votes[:-2, 1:-1]) & (inner >= votes[2:, 1:-1]) & (inner >= votes[1:-1, :-2]) & (inner >= votes[1:-1, 2:])
    out = []
    for i, j in zip(*np.nonzero(peak), strict=True):
        on = np.flatnonzero(r[:, j + 1] == i + 1)
        steep = abs(math.sin(t[j + 1])) < abs(math.cos(t[j + 1]))
        on = on[np.argsort(y[on] if steep else x[on], kind="stable")]
        cut = np.flatnonzero(np.hypot(np.diff(x[on]), np.diff(y[on])) > max_gap) + 1
        for part in np.split(on, cut):
            if len(part) and math.hypot(x[part[-1]] - x[part[0]], y[part[-1]] - y[part[0]]) >= min_length:
                out.append({"x1": int(x[part[0]]), "y1": int(y[part[0]]), "x2": int(x[part[-1]]), "y2": int(y[part[-1]])})
    return out


LINES = "array<struct<x1:int,y1:int,x2:int,y2:int>>"


def hough_circles(a: np.ndarray, dp: float, min_dist: float, param1: float, param2: float, min_radius: int, max_radius: int) -> list[dict]:
    gx, gy = (v[0, 0] for v in gradients(gaussian_blur(gray(a[None]), 5, 1.0)))
    size = np.hypot(gx, gy)
    h, w = size.shape
    y, x = np.nonzero((size >= param1 / 2) & (size > 0))
    ux, uy = gx[y, x] / size[y, x], gy[y, x] / size[y, x]
    step, out = max(1, int(dp)), []
    for r in range(min_radius, max_radius + 1):
        votes = np.zeros((h, w), int)
        for sign in (1, -1):
            cx, cy = np.floor(x + sign * r * ux + 0.5).astype(int), np.floor(y + sign * r * uy + 0.5).astype(int)
            ok = (cx >= 0) & (cy >= 0) & (cx < w) & (cy < h)
            np.add.at(votes, (cy[ok], cx[ok]), 1)
        p = np.pad(votes, step)
        near = [p[step + dy : step + dy + h, step + dx : step + dx + w] for dy in (-step, 0, step) for dx in (-step, 0, step) if dy or dx]
        for cy, cx in zip(*np.nonzero((votes >= param2) & (votes > 0) & np.logical_and.reduce([votes >= q for q in near])), strict=True):
            if all(math.hypot(cx - c["x"], cy - c["y"]) >= min_dist for c in out):
                out.append({"x": int(cx), "y": int(cy), "radius": r})
    return out


CIRCLES = "array<struct<x:int,y:int,radius:int>>"
RING = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))  # clockwise from the right, (dy, dx)


def find_contours(a: np.ndarray) -> list[list[tuple[int, int]]]:
    """Outer boundaries of the components over 0.5, as closed (x, y) lists of three points or more."""
    mask = a[0] > 0.5
    inner = np.zeros_like(mask)
    inner[1:-1, 1:-1] = mask[1:-1, 1:-1]
    labels, out = label(inner, EIGHT), []
    p = np.pad(inner, 1)
    for k in range(1, labels.max(initial=0) + 1):
        ys, xs = np.nonzero(labels == k)
        start = (int(ys[0]), int(xs[0]))
        at, came, path = start, 4, [start]
        for _ in range(10_000):
            for turn in range(1, 9):
                d = (came + turn) % 8
                dy, dx = RING[d]
                if p[at[0] + 1 + dy, at[1] + 1 + dx]:
                    at, came = (at[0] + dy, at[1] + dx), (d + 4) % 8
                    break
            else:
                break
            path.append(at)
            if at == start:
                break
        if len(path) >= 3:
            out.append([(x, y) for y, x in path])
    return out


def _holds(polygon: list[tuple[int, int]], x: float, y: float) -> bool:
    inside = False
    for (x1, y1), (x2, y2) in zip(polygon, polygon[1:] + polygon[:1], strict=True):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1 + 1e-9) + x1:
            inside = not inside
    return inside


def polygon_area(points: list[tuple[float, float]]) -> float:
    x, y = np.array(points, float).T
    return float(abs((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) / 2)


def contour_hierarchy(a: np.ndarray, mode: str = "tree") -> list[dict]:
    """Contours with (next, previous, first child, parent); ``external`` keeps roots only."""
    found = find_contours(a)
    mids = [np.mean(c, 0) for c in found]
    areas = [polygon_area(c) for c in found]
    parent = []
    for k, (x, y) in enumerate(mids):
        around = [j for j in range(len(found)) if j != k and areas[j] > areas[k] and _holds(found[j], x, y)]
        parent.append(min(around, key=lambda j: areas[j], default=-1))
    kept = [k for k in range(len(found)) if mode != "external" or parent[k] < 0]
    place = {k: i for i, k in enumerate(kept)}
    out = []
    for k in kept:
        kin = [j for j in kept if parent[j] == parent[k] and parent[k] >= 0]
        i = kin.index(k) if k in kin else 0
        child = next((place[j] for j in kept if parent[j] == k), -1)
        out.append({"points": [{"x": int(x), "y": int(y)} for x, y in found[k]], "next": place[kin[i + 1]] if i + 1 < len(kin) else -1, "prev": place[kin[i - 1]] if i > 0 else -1, "first_child": child, "parent": place.get(parent[k], -1)})
    return out


CONTOURS = "array<struct<points:array<struct<x:int,y:int>>,next:int,prev:int,first_child:int,parent:int>>"


def inpaint(a: np.ndarray, mask: np.ndarray, radius: float = 3.0) -> np.ndarray:
    """Fast marching from the rim of the mask inwards: each pixel is the distance-weighted mean of known ones near it."""
    mask = np.asarray(mask)
    if mask.shape[-2:] != a.shape[1:]:
        raise DimensionMismatch("image and mask differ in size")
    hole = mask.reshape(-1, *a.shape[1:])[0] != 0
    out, known = a.copy(), ~hole
    h, w = hole.shape
    r = max(1, int(math.ceil(radius)))
    heap = [(0.0, int(y), int(x)) for y, x in zip(*np.nonzero(known), strict=True) if any(0 <= y + dy < h and 0 <= x + dx < w and hole[y + dy, x + dx] for dy, dx in FOUR)]
    heapq.heapify(heap)
    while heap:
        t, y, x = heapq.heappop(heap)
        for dy, dx in FOUR:
            ny, nx = y + dy, x + dx
            if not (0 <= ny < h and 0 <= nx < w) or known[ny, nx]:
                continue
            y0, y1, x0, x1 = max(0, ny - r), min(h, ny + r + 1), max(0, nx - r), min(w, nx + r + 1)
            gy, gx = np.mgrid[y0:y1, x0:x1]
            d = (gy - ny) ** 2 + (gx - nx) ** 2
            weight = np.where(known[y0:y1, x0:x1] & (d > 0) & (d <= radius * radius), 1 / np.maximum(d, 1), 0)
            if weight.sum() > 0:
                out[:, ny, nx] = (out[:, y0:y1, x0:x1] * weight).sum((1, 2)) / weight.sum()
            known[ny, nx] = True
            heapq.heappush(heap, (t + 1, ny, nx))
    return out
