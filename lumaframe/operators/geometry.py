"""Geometric operators: index re-mapping of stacks ``(n, c, h, w)``, and transforms."""

from __future__ import annotations

import math

import numpy as np

from ..schema import InvalidParameter
from .filters import gaussian_blur, separable

BINOMIAL = np.array([1, 4, 6, 4, 1]) / 16


def half_away(v):
    return np.trunc(v + np.copysign(0.5, v))


def resize(s: np.ndarray, width: int, height: int) -> np.ndarray:
    """Nearest: source index is floor(i * in / out)."""
    if width < 1 or height < 1:
        raise InvalidParameter("a size must be positive")
    h, w = s.shape[2:]
    return s[:, :, (np.arange(height) * h // height)[:, None], np.arange(width) * w // width]


def crop(s: np.ndarray, x: int, y: int, width: int, height: int) -> np.ndarray:
    if x < 0 or y < 0 or y + height > s.shape[2] or x + width > s.shape[3]:
        raise InvalidParameter("the crop leaves the image")
    return s[:, :, y : y + height, x : x + width]


def flip(s: np.ndarray, horizontal: bool = True, vertical: bool = False) -> np.ndarray:
    return s[:, :, :: -1 if vertical else 1, :: -1 if horizontal else 1]


def rotate(s: np.ndarray, angle: int) -> np.ndarray:
    """Clockwise by a multiple of 90 degrees."""
    if angle not in (0, 90, 180, 270, 360):
        raise InvalidParameter("the angle must be a multiple of 90")
    return np.rot90(s, -(angle // 90), (2, 3))


def transpose(s: np.ndarray) -> np.ndarray:
    return s.swapaxes(2, 3)


def sample(s: np.ndarray, sx: np.ndarray, sy: np.ndarray) -> np.ndarray:
    """Nearest pixel at (sx, sy), 0 outside or where undefined."""
    fine = np.isfinite(sx) & np.isfinite(sy)
    x, y = half_away(np.where(fine, sx, -1)).astype(int), half_away(np.where(fine, sy, -1)).astype(int)
    inside = fine & (x >= 0) & (y >= 0) & (x < s.shape[3]) & (y < s.shape[2])
    return np.where(inside, s[:, :, np.clip(y, 0, s.shape[2] - 1), np.clip(x, 0, s.shape[3] - 1)], 0.0)


def _grid(width: int, height: int) -> tuple[np.ndarray, np.ndarray]:
    y, x = np.mgrid[:height, :width]
    return x.astype(float), y.astype(float)


def warp_affine(s: np.ndarray, m, width: int, height: int) -> np.ndarray:
    (a, b, tx), (c, d, ty) = np.asarray(m, float)
    det = a * d - b * c
    if abs(det) < 1e-9:
        raise InvalidParameter("the matrix is singular")
    x, y = _grid(width, height)
    x, y = x - tx, y - ty
    return sample(s, (d * x - b * y) / det, (a * y - c * x) / det)


def warp_perspective(s: np.ndarray, m, width: int, height: int) -> np.ndarray:
    m = np.asarray(m, float)
    if abs(np.linalg.det(m)) < 1e-9:
        raise InvalidParameter("the matrix is singular")
    x, y = _grid(width, height)
    u, v, z = np.einsum("ij,jhw->ihw", np.linalg.inv(m), np.stack([x, y, np.ones_like(x)]))
    z = np.where(np.abs(z) < 1e-9, np.nan, z)
    return sample(s, u / z, v / z)


def remap(s: np.ndarray, map_x, map_y) -> np.ndarray:
    mx, my = np.asarray(map_x, float), np.asarray(map_y, float)
    if mx.shape != my.shape:
        raise InvalidParameter("the maps differ in size")
    return sample(s, mx, my)


def undistort(s: np.ndarray, camera, distortion) -> np.ndarray:
    """Brown model with k1, k2, p1, p2, k3; missing ones are 0."""
    k = np.asarray(camera, float)
    k1, k2, p1, p2, k3 = [*distortion, 0, 0, 0, 0, 0][:5]
    x, y = _grid(s.shape[3], s.shape[2])
    x, y = (x - k[0, 2]) / k[0, 0], (y - k[1, 2]) / k[1, 1]
    r = x * x + y * y
    radial = 1 + r * (k1 + r * (k2 + r * k3))
    u = x * radial + 2 * p1 * x * y + p2 * (r + 2 * x * x)
    v = y * radial + p1 * (r + 2 * y * y) + 2 * p2 * x * y
    return sample(s, u * k[0, 0] + k[0, 2], v * k[1, 1] + k[1, 2])


def pyr_down(s: np.ndarray) -> np.ndarray:
    h, w = s.shape[2:]
    if min(h, w) < 2:
        raise InvalidParameter("too small for a pyramid")
    return separable(s, BINOMIAL, BINOMIAL)[:, :, : h // 2 * 2 : 2, : w // 2 * 2 : 2]


def pyr_up(s: np.ndarray) -> np.ndarray:
    n, c, h, w = s.shape
    wide = np.zeros((n, c, 2 * h - 1, 2 * w - 1))
    wide[:, :, ::2, ::2] = s
    return separable(wide, BINOMIAL * 2, BINOMIAL * 2, "zero")


def gaussian_pyramid(s: np.ndarray, levels: int) -> list[np.ndarray]:
    out = [s]
    while len(out) < levels and min(out[-1].shape[2:]) // 2 >= 1:
        last = gaussian_blur(out[-1], 3, 1.0)
        out.append(resize(last, last.shape[3] // 2, last.shape[2] // 2))
    return out


def integral_image(s: np.ndarray) -> np.ndarray:
    from .filters import gray

    return np.pad(gray(s).cumsum(2).cumsum(3), [(0, 0), (0, 0), (1, 0), (1, 0)])


# --- transforms from points --------------------------------------------------------


def get_rotation_matrix_2d(center: tuple[float, float], angle: float, scale: float) -> np.ndarray:
    a, b = scale * math.cos(math.radians(angle)), scale * math.sin(math.radians(angle))
    x, y = center
    return np.array([[a, b, (1 - a) * x - b * y], [-b, a, b * x + (1 - a) * y]])


def get_affine_transform(src, dst) -> np.ndarray:
    """From three points; zero for degenerate ones."""
    a = np.column_stack([np.asarray(src, float), np.ones(3)])
    if abs(np.linalg.det(a)) < 1e-12:
        return np.zeros((2, 3))
    return np.linalg.solve(a, np.asarray(dst, float)).T


def get_perspective_transform(src, dst) -> np.ndarray:
    """From four points; identity for degenerate ones."""
    rows, right = [], []
    for (x, y), (u, v) in zip(src, dst, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    a = np.array(rows, float)
    if abs(np.linalg.det(a)) < 1e-12:
        return np.eye(3)
    return np.append(np.linalg.solve(a, np.array(right, float)), 1.0).reshape(3, 3)


def find_homography(src, dst) -> np.ndarray:
    if len(src) < 4 or len(src) != len(dst):
        raise InvalidParameter("four pairs are needed")
    return get_perspective_transform(src[:4], dst[:4])


def apply_homography(h, x, y):
    h = np.asarray(h, float)
    z = h[2, 0] * x + h[2, 1] * y + h[2, 2]
    return (h[0, 0] * x + h[0, 1] * y + h[0, 2]) / z, (h[1, 0] * x + h[1, 1] * y + h[1, 2]) / z


def find_essential_mat(fundamental, camera) -> np.ndarray:
    k = np.asarray(camera, float)
    return k.T @ np.asarray(fundamental, float) @ k


def project_points(points, rotation, translation, camera, distortion=()) -> list[tuple[float, float] | None]:
    """Projections of 3-D points (2-D points lie at z = 0); points at depth 0 give None."""
    p = np.array([(*q, 0.0)[:3] for q in points], float).reshape(-1, 3)
    k, (k1, k2) = np.asarray(camera, float), ([*distortion, 0, 0])[:2]
    out: list[tuple[float, float] | None] = []
    for x, y, z in p @ np.asarray(rotation, float).T + np.asarray(translation, float).ravel():
        if abs(z) <= 1e-9:
            out.append(None)
            continue
        u, v = x / z, y / z
        r = u * u + v * v
        radial = 1 + k1 * r + k2 * r * r
        out.append((k[0, 0] * u * radial + k[0, 2], k[1, 1] * v * radial + k[1, 2]))
    return out
