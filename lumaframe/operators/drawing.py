"""Drawing on one image ``(c, h, w)``; pixels outside are left out, colours are one value a channel."""

from __future__ import annotations

import math

import numpy as np

from ..schema import InvalidParameter

Point = tuple[int, int]


def _put(a: np.ndarray, ys, xs, color) -> np.ndarray:
    out = a.copy()
    ys, xs = np.asarray(ys, int).ravel(), np.asarray(xs, int).ravel()
    ok = (ys >= 0) & (xs >= 0) & (ys < a.shape[1]) & (xs < a.shape[2])
    for ch in range(a.shape[0]):
        out[ch, ys[ok], xs[ok]] = color[ch]
    return out


def line_pixels(p1: Point, p2: Point) -> list[Point]:
    """Bresenham's line as (x, y)."""
    (x, y), (x2, y2) = p1, p2
    dx, dy = abs(x2 - x), -abs(y2 - y)
    sx, sy, err, out = (1 if x < x2 else -1), (1 if y < y2 else -1), dx + dy, []
    while True:
        out.append((x, y))
        if (x, y) == (x2, y2):
            return out
        twice = 2 * err
        if twice >= dy:
            err, x = err + dy, x + sx
        if twice <= dx:
            err, y = err + dx, y + sy


def _lines(a: np.ndarray, parts: list[tuple[Point, Point]], color) -> np.ndarray:
    px = [p for ends in parts for p in line_pixels(*ends)]
    return _put(a, [p[1] for p in px], [p[0] for p in px], color)


def draw_line(a: np.ndarray, p1: Point, p2: Point, color) -> np.ndarray:
    return _lines(a, [(p1, p2)], color)


def draw_rectangle(a: np.ndarray, x: int, y: int, width: int, height: int, color, thickness: int = 1) -> np.ndarray:
    if thickness < 0:
        gy, gx = np.mgrid[y : y + height, x : x + width]
        return _put(a, gy, gx, color)
    c = [(x, y), (x + width, y), (x + width, y + height), (x, y + height)]
    return _lines(a, list(zip(c, c[1:] + c[:1], strict=True)), color)


def draw_circle(a: np.ndarray, center: Point, radius: int, color, thickness: int = 1) -> np.ndarray:
    cx, cy = center
    if thickness < 0:
        gy, gx = np.mgrid[-radius : radius + 1, -radius : radius + 1]
        on = gx * gx + gy * gy <= radius * radius
        return _put(a, gy[on] + cy, gx[on] + cx, color)
    x, y, err, pts = radius, 0, 1 - radius, []
    while x >= y:
        pts += [(cx + sx * u, cy + sy * v) for u, v in ((x, y), (y, x)) for sx in (1, -1) for sy in (1, -1)]
        y += 1
        if err < 0:
            err += 2 * y + 1
        else:
            x -= 1
            err += 2 * (y - x) + 1
    return _put(a, [p[1] for p in pts], [p[0] for p in pts], color)


def draw_ellipse(a: np.ndarray, center: Point, axes: tuple[int, int], angle: float, start: float, end: float, color, thickness: int = 1) -> np.ndarray:
    (cx, cy), (ra, rb), turn = center, axes, math.radians(angle)
    if thickness < 0:
        gy, gx = np.mgrid[: a.shape[1], : a.shape[2]]
        u = (gx - cx) * math.cos(turn) + (gy - cy) * math.sin(turn)
        v = -(gx - cx) * math.sin(turn) + (gy - cy) * math.cos(turn)
        on = (u / max(ra, 1e-9)) ** 2 + (v / max(rb, 1e-9)) ** 2 <= 1
        return _put(a, gy[on], gx[on], color)
    t = np.radians(start + (end - start) * np.arange(720) / 719)
    u, v = ra * np.cos(t), rb * np.sin(t)
    x, y = cx + u * math.cos(turn) - v * math.sin(turn), cy + u * math.sin(turn) + v * math.cos(turn)
    return _put(a, np.floor(y + 0.5), np.floor(x + 0.5), color)


def draw_polyline(a: np.ndarray, points: list[Point], color) -> np.ndarray:
    return _lines(a, list(zip(points, points[1:], strict=False)), color)


def fill_poly(a: np.ndarray, points: list[Point], color) -> np.ndarray:
    """Even-odd scan lines; crossings are cut off to whole pixels."""
    ys, xs = [], []
    for y in range(a.shape[1]):
        cuts = sorted(int(x1 + (y - y1) * (x2 - x1) / (y2 - y1)) for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1], strict=True) if (y1 <= y < y2) or (y2 <= y < y1))
        for lo, hi in zip(cuts[::2], cuts[1::2], strict=False):
            xs += range(lo, hi + 1)
            ys += [y] * (hi + 1 - lo)
    return _put(a, ys, xs, color)


def draw_arrowed_line(a: np.ndarray, p1: Point, p2: Point, color, tip_length: float = 0.1) -> np.ndarray:
    turn, size = math.atan2(p1[1] - p2[1], p1[0] - p2[0]), math.dist(p1, p2) * tip_length
    tips = [(round(p2[0] + size * math.cos(turn + s * math.pi / 6)), round(p2[1] + size * math.sin(turn + s * math.pi / 6))) for s in (1, -1)]
    return _lines(a, [(p1, p2), *((p2, t) for t in tips)], color)


MARKERS = ("cross", "tilted_cross", "diamond", "square", "circle", "filled")


def draw_marker(a: np.ndarray, center: Point, color, kind: str = "cross", size: int = 5) -> np.ndarray:
    (x, y), r = center, size // 2
    corners = [(x - r, y - r), (x + r, y - r), (x + r, y + r), (x - r, y + r)]
    tips = [(x, y - r), (x + r, y), (x, y + r), (x - r, y)]
    ring = lambda c: list(zip(c, c[1:] + c[:1], strict=True))
    if kind == "circle":
        return draw_circle(a, center, r, color)
    if kind == "filled":
        return draw_circle(a, center, r, color, -1)
    parts = {"cross": [(tips[0], tips[2]), (tips[1], tips[3])], "tilted_cross": [(corners[0], corners[2]), (corners[1], corners[3])], "diamond": ring(tips), "square": ring(corners)}
    if kind not in parts:
        raise InvalidParameter(f"no marker {kind!r}")
    return _lines(a, parts[kind], color)


# A 5x7 font, each glyph as seven rows of five bits.
FONT: dict[str, tuple[int, ...]] = {
    "0": (14, 17, 19, 21, 25, 17, 14), "1": (4, 12, 4, 4, 4, 4, 14), "2": (14, 17, 1, 2, 4, 8, 31), "3": (31, 2, 4, 2, 1, 17, 14), "4": (2, 6, 10, 18, 31, 2, 2),
    "5": (31, 16, 30, 1, 1, 17, 14), "6": (6, 8, 16, 30, 17, 17, 14), "7": (31, 1, 2, 4, 8, 8, 8), "8": (14, 17, 17, 14, 17, 17, 14), "9": (14, 17, 17, 15, 1, 2, 12),
    "A": (14, 17, 17, 31, 17, 17, 17), "B": (30, 17, 17, 30, 17, 17, 30), "C": (14, 17, 16, 16, 16, 17, 14), "D": (28, 18, 17, 17, 17, 18, 28), "E": (31, 16, 16, 30, 16, 16, 31),
    "F": (31, 16, 16, 30, 16, 16, 16), "G": (14, 17, 16, 23, 17, 17, 15), "H": (17, 17, 17, 31, 17, 17, 17), "I": (14, 4, 4, 4, 4, 4, 14), "J": (7, 2, 2, 2, 2, 18, 12),
    "K": (17, 18, 20, 24, 20, 18, 17), "L": (16, 16, 16, 16, 16, 16, 31), "M": (17, 27, 21, 21, 17, 17, 17), "N": (17, 17, 25, 21, 19, 17, 17), "O": (14, 17, 17, 17, 17, 17, 14),
    "P": (30, 17, 17, 30, 16, 16, 16), "Q": (14, 17, 17, 17, 21, 18, 13), "R": (30, 17, 17, 30, 20, 18, 17), "S": (15, 16, 16, 14, 1, 1, 30), "T": (31, 4, 4, 4, 4, 4, 4),
    "U": (17, 17, 17, 17, 17, 17, 14), "V": (17, 17, 17, 17, 17, 10, 4), "W": (17, 17, 17, 21, 21, 21, 10), "X": (17, 17, 10, 4, 10, 17, 17), "Y": (17, 17, 17, 10, 4, 4, 4),
    "Z": (31, 1, 2, 4, 8, 16, 31), ".": (0, 0, 0, 0, 0, 12, 12), "-": (0, 0, 0, 31, 0, 0, 0), ":": (0, 12, 12, 0, 12, 12, 0), "/": (0, 1, 2, 4, 8, 16, 0), "!": (4, 4, 4, 4, 4, 0, 4), "?": (14, 17, 1, 2, 4, 0, 4), " ": (0,) * 7,
}


def draw_text(a: np.ndarray, text: str, org: Point, scale: int, color) -> np.ndarray:
    """Letters are read as capitals; a character without a glyph is a question mark."""
    ys, xs = [], []
    for k, ch in enumerate(text):
        for i, bits in enumerate(FONT.get(ch.upper(), FONT["?"])):
            for j in range(5):
                if bits >> (4 - j) & 1:
                    gy, gx = np.mgrid[:scale, :scale]
                    ys += (org[1] + i * scale + gy).ravel().tolist()
                    xs += (org[0] + (k * 6 + j) * scale + gx).ravel().tolist()
    return _put(a, ys, xs, color)
