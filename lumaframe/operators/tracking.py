"""Motion and state over ordered frames: background model, Kalman filter, trackers, optical flow."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import DimensionMismatch, InvalidParameter
from .filters import gaussian_kernel, gray, separable


@dataclass
class BackgroundSubtractor:
    """Running mean of gray frames; a frame's mask is what differs from the updated mean."""

    learning_rate: float = 0.05
    threshold: float = 0.1
    background: np.ndarray | None = None

    def apply(self, frame: np.ndarray) -> np.ndarray:
        g = gray(frame[None])[0]
        if self.background is None:
            self.background = g.copy()
        else:
            self.background = (1 - self.learning_rate) * self.background + self.learning_rate * g
        return (np.abs(g - self.background) > self.threshold).astype(float)


class KalmanFilter:
    def __init__(self, state_dim: int, measure_dim: int):
        self.n, self.m = state_dim, measure_dim
        self.f, self.h = np.eye(state_dim), np.eye(measure_dim, state_dim)
        self.q, self.r = np.eye(state_dim) * 0.01, np.eye(measure_dim) * 0.1
        self.x, self.p = np.zeros(state_dim), np.eye(state_dim)

    def _checked(self, v, *shape: int) -> np.ndarray:
        a = np.asarray(v, float)
        if a.shape != shape:
            raise DimensionMismatch(f"expected {shape}, got {a.shape}")
        return a

    def set_transition(self, f) -> None:
        self.f = self._checked(f, self.n, self.n)

    def set_measurement(self, h) -> None:
        self.h = self._checked(h, self.m, self.n)

    def set_process_noise(self, q) -> None:
        self.q = self._checked(q, self.n, self.n)

    def set_measurement_noise(self, r) -> None:
        self.r = self._checked(r, self.m, self.m)

    def set_initial_state(self, x) -> None:
        self.x = self._checked(x, self.n)

    def predict(self) -> np.ndarray:
        self.x, self.p = self.f @ self.x, self.f @ self.p @ self.f.T + self.q
        return self.x

    def update(self, z) -> np.ndarray:
        z = self._checked(z, self.m)
        s = self.h @ self.p @ self.h.T + self.r
        gain = self.p @ self.h.T @ np.linalg.inv(s)
        self.x = self.x + gain @ (z - self.h @ self.x)
        self.p = (np.eye(self.n) - gain @ self.h) @ self.p
        return self.x


def velocity_filter() -> KalmanFilter:
    """Position and speed, measured in position."""
    k = KalmanFilter(2, 1)
    k.set_transition([[1, 1], [0, 1]])
    return k


def velocity_step(x: list[float], p: list[float]) -> Callable[..., tuple]:
    """The filter of :func:`velocity_filter` from a state on, by plain numbers: a call takes a measurement and gives (position, speed), or without one the state."""
    k = velocity_filter()
    q0, q1, r = float(k.q[0, 0]), float(k.q[1, 1]), float(k.r[0, 0])
    a, b = map(float, x)
    p00, p01, p10, p11 = map(float, p)

    def step(z: float | None = None) -> tuple:
        nonlocal a, b, p00, p01, p10, p11
        if z is None:
            return [a, b], [p00, p01, p10, p11]
        a = a + b
        top, right = p00 + p10, p01 + p11
        p00, p01, p10, p11 = top + right + q0, right, p10 + p11, p11 + q1
        inverse = 1 / (p00 + r)
        g0, g1, y = p00 * inverse, p10 * inverse, z - a
        a, b = a + g0 * y, b + g1 * y
        p00, p01, p10, p11 = (1 - g0) * p00, (1 - g0) * p01, p10 - g1 * p00, p11 - g1 * p01
        return a, b

    return step


def kalman_tracks(tracks: DataFrame) -> DataFrame:
    """(track_id, seq, z) with the filtered position and speed.

    Rows are dealt by track and sorted outside Python; one task streams its tracks, holding one filter at a time.
    """

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, filt = None, None
        for pdf in pdfs:
            xs = np.zeros((len(pdf), 2))
            for i, (track, z) in enumerate(zip(pdf["track_id"], pdf["z"], strict=True)):
                if filt is None or track != now:
                    now, filt = track, velocity_filter()
                filt.predict()
                xs[i] = filt.update([z])
            yield pdf.assign(position=xs[:, 0], speed=xs[:, 1])

    ordered = tracks.select("track_id", "seq", "z").repartition("track_id").sortWithinPartitions("track_id", "seq")
    return ordered.mapInPandas(run, "track_id long, seq int, z double, position double, speed double")


def background_masks(frames: DataFrame, learning_rate: float = 0.05, threshold: float = 0.1) -> DataFrame:
    """Frames with their foreground masks, in frame order within each video."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, model = None, None
        for pdf in pdfs:
            masks = []
            for video, c, h, w, data in zip(pdf["video_id"], pdf["c"], pdf["h"], pdf["w"], pdf["data"], strict=True):
                if model is None or video != now:
                    now, model = video, BackgroundSubtractor(learning_rate, threshold)
                masks.append(model.apply(np.asarray(data, float).reshape(c, h, w)).ravel())
            yield pdf.assign(c=1, data=masks)[["video_id", "index", "c", "h", "w", "data"]]

    ordered = frames.select("video_id", "index", "c", "h", "w", "data").repartition("video_id").sortWithinPartitions("video_id", "index")
    return ordered.mapInPandas(run, "video_id long, index long, c int, h int, w int, data array<double>")


def frame_differences(frames: DataFrame) -> DataFrame:
    """Absolute difference of each frame from the one numbered one less.

    Frames meet by (video_id, index), so that a long video is dealt over all tasks.
    """
    before = frames.select("video_id", (F.col("index") + 1).alias("index"), F.col("data").alias("before"))
    return frames.join(before, ["video_id", "index"]).select("video_id", "index", "c", "h", "w", F.zip_with("data", "before", lambda a, b: F.abs(a - b)).alias("data"))


def motion_magnitudes(frames: DataFrame) -> DataFrame:
    """(video_id, index, magnitude): the sum of each difference."""
    return frame_differences(frames).select("video_id", "index", F.aggregate("data", F.lit(0.0), lambda s, v: s + v).alias("magnitude"))


# --- trackers ------------------------------------------------------------------------------


@dataclass
class MosseTracker:
    """Minimum output sum of squared errors filter on a square patch; the peak is found in the response itself."""

    rate: float = 0.125
    size: int = 0
    center: tuple[float, float] = (0.0, 0.0)
    num: np.ndarray | None = None
    den: np.ndarray | None = None
    box: tuple[int, int, int, int] = (0, 0, 0, 0)

    def _patch(self, g: np.ndarray) -> np.ndarray:
        cx, cy = round(self.center[0]), round(self.center[1])
        p = np.pad(g, self.size)
        part = p[cy + self.size - self.size // 2 :, cx + self.size - self.size // 2 :][: self.size, : self.size]
        out = np.zeros((self.size, self.size))
        out[: part.shape[0], : part.shape[1]] = part
        return np.fft.fft2(out - out.mean())

    def _target(self) -> np.ndarray:
        d = np.arange(self.size) - self.size // 2
        return np.fft.fft2(np.exp(-(d[:, None] ** 2 + d[None] ** 2) / (2 * max(self.size / 10, 1) ** 2)))

    def init(self, image: np.ndarray, box: tuple[int, int, int, int]) -> None:
        x, y, w, h = box
        self.box, self.size, self.center = box, max(w, h, 4), (x + w / 2, y + h / 2)
        f = self._patch(gray(image[None])[0, 0])
        self.num, self.den = self._target() * f.conj(), (f * f.conj()).real + 1e-4

    def update(self, image: np.ndarray) -> tuple[int, int, int, int]:
        if self.num is None:
            raise InvalidParameter("the tracker has not been started")
        g = gray(image[None])[0, 0]
        response = np.fft.ifft2(self.num / self.den * self._patch(g)).real
        py, px = np.unravel_index(response.argmax(), response.shape)
        self.center = (float(np.clip(self.center[0] + px - self.size // 2, 0, g.shape[1] - 1)), float(np.clip(self.center[1] + py - self.size // 2, 0, g.shape[0] - 1)))
        f = self._patch(g)
        self.num = (1 - self.rate) * self.num + self.rate * self._target() * f.conj()
        self.den = (1 - self.rate) * self.den + self.rate * ((f * f.conj()).real + 1e-4)
        _, _, w, h = self.box
        self.box = (round(self.center[0] - w / 2), round(self.center[1] - h / 2), w, h)
        return self.box


@dataclass
class MeanShiftTracker:
    """Moves a box to the weighted mean of pixels whose colours its first content is rich in."""

    bins: int = 8
    max_iter: int = 30
    hist: np.ndarray | None = None
    box: tuple[int, int, int, int] = (0, 0, 0, 0)

    def _region(self, image: np.ndarray):
        x, y, w, h = self.box
        y0, y1, x0, x1 = max(0, y), min(image.shape[1], y + h), max(0, x), min(image.shape[2], x + w)
        gy, gx = np.mgrid[y0:y1, x0:x1]
        q = (np.clip(image[:3, y0:y1, x0:x1], 0, 1) * self.bins).astype(int).clip(0, self.bins - 1)
        code = q[0] * self.bins**2 + q[1] * self.bins + q[2]
        far = ((gy - y - (h - 1) / 2) / max(h / 2, 1)) ** 2 + ((gx - x - (w - 1) / 2) / max(w / 2, 1)) ** 2
        return gy, gx, code, np.maximum(1 - far, 0)

    def _histogram(self, code: np.ndarray, weight: np.ndarray) -> np.ndarray:
        out = np.bincount(code.ravel(), weight.ravel(), self.bins**3)
        return out / max(out.sum(), 1e-12)

    def init(self, image: np.ndarray, box: tuple[int, int, int, int]) -> None:
        if len(image) < 3:
            raise InvalidParameter("three channels are needed")
        self.box = box
        _, _, code, weight = self._region(image)
        self.hist = self._histogram(code, weight)

    def update(self, image: np.ndarray) -> tuple[int, int, int, int]:
        if self.hist is None:
            raise InvalidParameter("the tracker has not been started")
        for _ in range(self.max_iter):
            x, y, w, h = self.box
            gy, gx, code, weight = self._region(image)
            now = self._histogram(code, weight)
            k = np.sqrt(self.hist[code] / np.maximum(now[code], 1e-12)) * (weight > 0)
            if k.sum() < 1e-12:
                break
            dx, dy = (k * gx).sum() / k.sum() - (x + (w - 1) / 2), (k * gy).sum() / k.sum() - (y + (h - 1) / 2)
            self.box = (round(x + dx), round(y + dy), w, h)
            if np.hypot(dx, dy) < 0.5:
                break
        return self.box


class Tracker:
    """Starts and updates the tracker of a given type; only MOSSE is provided."""

    def __init__(self, tracker_type: str = "mosse"):
        if tracker_type.lower() != "mosse":
            raise InvalidParameter(f"no tracker {tracker_type!r}")
        self.inner = MosseTracker()

    def init(self, image: np.ndarray, box: tuple[int, int, int, int]) -> None:
        self.inner.init(image, box)

    def update(self, image: np.ndarray) -> tuple[int, int, int, int]:
        return self.inner.update(image)


def track_boxes(frames: DataFrame, make=MosseTracker, box: tuple[int, int, int, int] = (8, 8, 8, 8)) -> DataFrame:
    """(video_id, index, x, y, width, height): ``box`` of the first frame followed through each video."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, tracker = None, None
        for pdf in pdfs:
            out = []
            for video, c, h, w, data in zip(pdf["video_id"], pdf["c"], pdf["h"], pdf["w"], pdf["data"], strict=True):
                image = np.asarray(data, float).reshape(c, h, w)
                if tracker is None or video != now:
                    now, tracker = video, make()
                    tracker.init(image, box)
                    out.append(box)
                else:
                    out.append(tracker.update(image))
            yield pd.DataFrame({"video_id": pdf["video_id"], "index": pdf["index"], **{k: [b[i] for b in out] for i, k in enumerate(("x", "y", "width", "height"))}})

    ordered = frames.select("video_id", "index", "c", "h", "w", "data").repartition("video_id").sortWithinPartitions("video_id", "index")
    return ordered.mapInPandas(run, "video_id long, index long, x long, y long, width long, height long")


# --- optical flow ---------------------------------------------------------------------------


def _bilinear(g: np.ndarray, y, x):
    y, x = np.clip(y, 0, g.shape[0] - 1), np.clip(x, 0, g.shape[1] - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, g.shape[0] - 1), np.minimum(x0 + 1, g.shape[1] - 1)
    fy, fx = y - y0, x - x0
    return (g[y0, x0] * (1 - fx) + g[y0, x1] * fx) * (1 - fy) + (g[y1, x0] * (1 - fx) + g[y1, x1] * fx) * fy


def sparse_flow(prev: np.ndarray, nxt: np.ndarray, points: list[tuple[float, float]], window: int = 15, iterations: int = 20, eps: float = 0.01) -> list[tuple[float, float, int]]:
    """Lucas-Kanade: (x, y, status) of each point in the next frame."""
    a, b = gray(prev[None])[0, 0], gray(nxt[None])[0, 0]
    gy, gx = np.gradient(a)
    r, out = window // 2, []
    for x, y in points:
        wy, wx = np.mgrid[-r : r + 1, -r : r + 1]
        ix, iy, base = _bilinear(gx, y + wy, x + wx), _bilinear(gy, y + wy, x + wx), _bilinear(a, y + wy, x + wx)
        m = np.array([[(ix * ix).sum(), (ix * iy).sum()], [(ix * iy).sum(), (iy * iy).sum()]])
        if abs(np.linalg.det(m)) < 1e-9:
            out.append((float(x), float(y), 0))
            continue
        d = np.zeros(2)
        for _ in range(iterations):
            t = _bilinear(b, y + d[1] + wy, x + d[0] + wx) - base
            step = -np.linalg.solve(m, [(ix * t).sum(), (iy * t).sum()])
            d += step
            if np.hypot(*step) < eps:
                break
        ok = 0 <= x + d[0] < a.shape[1] and 0 <= y + d[1] < a.shape[0]
        out.append((float(x + d[0]), float(y + d[1]), int(ok)))
    return out


def _poly(g: np.ndarray, n: int, sigma: float):
    """Second-order expansion of each neighbourhood of a stack of planes: (a11, a22, a12, b1, b2)."""
    k = gaussian_kernel(n, sigma)
    d = np.arange(n) - n // 2
    s = g[:, None]
    f = lambda px, py: separable(s, k * d**px, k * d**py)[:, 0]
    m2, m4 = (k * d**2).sum(), (k * d**4).sum()
    f00, f20, f02 = f(0, 0), f(2, 0), f(0, 2)
    mid = np.linalg.inv(np.array([[1, m2, m2], [m2, m4, m2 * m2], [m2, m2 * m2, m4]]))
    c = np.einsum("ij,jshw->ishw", mid, np.stack([f00, f20, f02]))
    return c[1], c[2], f(1, 1) / (m2 * m2), f(1, 0) / m2, f(0, 1) / m2


def _bilinear_stack(g: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """:func:`_bilinear` of each plane of a stack (n, h, w) at its own places."""
    n, h, w = g.shape
    y, x = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx, k = y - y0, x - x0, np.arange(n)[:, None, None]
    return (g[k, y0, x0] * (1 - fx) + g[k, y0, x1] * fx) * (1 - fy) + (g[k, y1, x0] * (1 - fx) + g[k, y1, x1] * fx) * fy


def dense_flow(prev: np.ndarray, nxt: np.ndarray, levels: int = 5, iterations: int = 3, poly_n: int = 7, poly_sigma: float = 1.5, window: int = 15) -> np.ndarray:
    """Polynomial-expansion flow (2, h, w): x, then y displacement."""
    return dense_flows(prev[None], nxt[None], levels, iterations, poly_n, poly_sigma, window)[0]


def dense_flows(prev: np.ndarray, nxt: np.ndarray, levels: int = 5, iterations: int = 3, poly_n: int = 7, poly_sigma: float = 1.5, window: int = 15) -> np.ndarray:
    """:func:`dense_flow` of each pair of two stacks (n, c, h, w)."""
    a, b = gray(prev)[:, 0], gray(nxt)[:, 0]
    pyramid = [(a, b)]
    blur = gaussian_kernel(5, 1.0)
    while len(pyramid) < levels and min(pyramid[-1][0].shape[1:]) >= 16:
        pyramid.append(tuple(separable(v[:, None], blur, blur)[:, 0, ::2, ::2] for v in pyramid[-1]))
    flow = np.zeros((2, *pyramid[-1][0].shape))
    smooth = gaussian_kernel(window, window / 6)
    for p, q in reversed(pyramid):
        h, w = p.shape[1:]
        if flow.shape[2:] != (h, w):
            ys, xs = np.arange(h) * flow.shape[2] // h, np.arange(w) * flow.shape[3] // w
            flow = flow[:, :, ys[:, None], xs] * np.array([w / flow.shape[3], h / flow.shape[2]])[:, None, None, None]
        pa, pb = _poly(p, poly_n, poly_sigma), _poly(q, poly_n, poly_sigma)
        gy, gx = np.mgrid[:h, :w].astype(float)
        for _ in range(iterations):
            moved = [_bilinear_stack(v, gy + flow[1], gx + flow[0]) for v in pb]
            a11, a22, a12 = ((x + y) / 2 for x, y in zip(pa[:3], moved[:3], strict=True))
            b1 = (pa[3] - moved[3]) / 2 + a11 * flow[0] + a12 / 2 * flow[1]
            b2 = (pa[4] - moved[4]) / 2 + a12 / 2 * flow[0] + a22 * flow[1]
            h12 = a12 / 2
            terms = np.stack([a11 * a11 + h12 * h12, h12 * (a11 + a22), a22 * a22 + h12 * h12, a11 * b1 + h12 * b2, h12 * b1 + a22 * b2], 1)
            g11, g12, g22, r1, r2 = separable(terms, smooth, smooth).swapaxes(0, 1)
            det = g11 * g22 - g12 * g12
            fine = np.abs(det) > 1e-12
            safe = np.where(fine, det, 1)
            flow = np.where(fine, np.stack([(g22 * r1 - g12 * r2) / safe, (g11 * r2 - g12 * r1) / safe]), flow)
    return flow.swapaxes(0, 1)
