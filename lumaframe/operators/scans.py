"""Sequences as prefix scans: long videos and tracks over many tasks.

A running state is folded by steps that compose: what a stretch of rows does to the state before it is an *element* of bounded size, and
elements combine associatively. Rows are cut into segments of ``length`` places by their number. Segments are summed up side by side, the elements of up to ``fan``
segments are combined in a tree, the states before all segments come down the same tree, and a second pass over the rows goes on from these.
No task sees more than a segment's rows one after the other, or ``fan`` elements, however long a sequence is.

Rounding apart (sums are taken in another order), results are those of one pass from row to row.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import InvalidParameter
from ..sources.files import written
from .filters import gray
from .tracking import velocity_filter


class Scan(Protocol):
    """Elements and states are flat arrays.

    A scan may also have ``folds`` and ``emits``, which do what ``fold`` and ``emit`` do for all stretches of a batch at once, told by where each begins and, last, by the number of rows.
    """

    def fold(self, element: np.ndarray | None, rows: pd.DataFrame) -> np.ndarray:
        """The element of the rows so far and ``rows``."""

    def combine(self, first: np.ndarray, then: np.ndarray) -> np.ndarray: ...

    def start(self, first: np.ndarray) -> np.ndarray:
        """The state before a sequence that begins with this element."""

    def push(self, state: np.ndarray, element: np.ndarray) -> np.ndarray: ...

    def emit(self, state: np.ndarray, rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        """Results of ``rows``, and the state after them."""


def _cuts(pdf: pd.DataFrame, key: str) -> list[int]:
    """Where stretches of rows of one sequence and segment begin, and the number of rows."""
    k, s = pdf[key].to_numpy(), pdf["seg"].to_numpy()
    return [0, *(np.flatnonzero((k[1:] != k[:-1]) | (s[1:] != s[:-1])) + 1).tolist(), len(pdf)]


def _runs(pdfs: Iterator[pd.DataFrame], key: str) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Stretches of rows of one sequence and segment, batch by batch."""
    for pdf in pdfs:
        k, s, cuts = pdf[key].to_numpy(), pdf["seg"].to_numpy(), _cuts(pdf, key)
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield (k[a], s[a]), pdf.iloc[a:b]


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` by ``keys`` in as many partitions as shuffles have: without a number they would be put together by their few bytes, though each row costs time."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _elements(rows: DataFrame, key: str, order: str, scan: Scan) -> DataFrame:
    kind = dict(rows.dtypes)[key]

    def stretches(pdf: pd.DataFrame, now: tuple | None, element: np.ndarray | None) -> Iterator[tuple[tuple, np.ndarray]]:
        """Each stretch of a batch with its element, the first one's going on from ``element`` of ``now``."""
        if not hasattr(scan, "folds"):
            for at, part in _runs([pdf], key):
                element = scan.fold(element if at == now else None, part)
                now = at
                yield at, element
        elif len(pdf):
            cuts = _cuts(pdf, key)
            first = cuts[:-1]
            for at, made in zip(zip(pdf[key].to_numpy()[first], pdf["seg"].to_numpy()[first], strict=True), scan.folds(pdf, cuts), strict=True):
                yield at, scan.combine(element, made) if at == now else made

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, element = None, None
        frame = lambda done: pd.DataFrame({key: [d[0][0] for d in done], "seg": [d[0][1] for d in done], "element": [d[1] for d in done]})
        for pdf in pdfs:
            done = []  # one frame a batch: sequences may be short and many
            for at, made in stretches(pdf, now, element):
                if now is not None and at != now:
                    done.append((now, element))
                now, element = at, made
            if done:
                yield frame(done)
        if now is not None:
            yield frame([(now, element)])

    dealt = _dealt(rows, key, "seg").sortWithinPartitions(key, "seg", order)
    return written(dealt.mapInPandas(run, f"`{key}` {kind}, seg long, element array<double>"), "elements")


def _states(elements: DataFrame, key: str, scan: Scan, fan: int) -> DataFrame:
    """(key, seg, state): the state before each segment, up and down a tree of elements."""
    kind = dict(elements.dtypes)[key]
    parent = F.floor(F.col("seg") / fan).cast("long")

    # Sequences may be short and many, so that groups are told apart in sorted streams; a call a group would cost more than its work.
    def up(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, total = None, None
        frame = lambda done: pd.DataFrame({key: [d[0][0] for d in done], "seg": [d[0][1] for d in done], "element": [d[1] for d in done]})
        for pdf in pdfs:
            done = []
            for k, u, e in zip(pdf[key], pdf["up"], pdf["element"], strict=True):
                if now != (k, u):
                    if now is not None:
                        done.append((now, total))
                    now, total = (k, u), np.asarray(e)
                else:
                    total = scan.combine(total, np.asarray(e))
            if done:
                yield frame(done)
        if now is not None:
            yield frame([(now, total)])

    def down(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, before = None, None
        for pdf in pdfs:
            out = []
            for k, u, e, state in zip(pdf[key], pdf["up"], pdf["element"], pdf["state"], strict=True):
                e = np.asarray(e)
                if now != (k, u):
                    now, before = (k, u), scan.start(e) if state is None else np.asarray(state)
                out.append(before)
                before = scan.push(before, e)
            if out:
                yield pd.DataFrame({key: pdf[key].to_numpy(), "seg": pdf["seg"].to_numpy(), "state": out})

    def streamed(rows: DataFrame, step, made: str) -> DataFrame:
        return _dealt(rows, key, "up").sortWithinPartitions(key, "up", "seg").mapInPandas(step, f"`{key}` {kind}, seg long, {made} array<double>")

    levels = [elements]
    while levels[-1].groupBy(key).count().filter(F.col("count") > 1).limit(1).count():
        levels.append(written(streamed(levels[-1].withColumn("up", parent), up, "element"), "elements"))
    states = levels[-1].select(key, "seg", F.lit(None).cast("array<double>").alias("state"))
    for level in levels[::-1]:
        # The topmost has one element a sequence, which starts it; below, a group goes on from its parent's state.
        top = level is levels[-1]
        above = states.select(key, F.col("seg").alias("up"), "state").hint("merge")
        joined = level.withColumn("up", F.col("seg") if top else parent).join(above, [key, "up"])
        states = streamed(joined, down, "state")
    return written(states, "states")


def scanned(df: DataFrame, key: str, order: str, scan: Scan, out: str, length: int = 1024, fan: int = 64) -> DataFrame:
    """``scan``'s results for all rows of ``df``, in order of ``order`` (whole numbers) within each ``key``; ``out`` is their schema. Rows without key or number are left out."""
    if length < 1 or fan < 2:
        raise InvalidParameter("a segment has a row, and a tree two branches")
    rows = df.filter(F.col(key).isNotNull() & F.col(order).isNotNull()).withColumn("seg", F.floor(F.col(order) / length).cast("long"))
    states = _states(_elements(rows, key, order, scan), key, scan, fan)
    # A segment's state comes as a row before its first, so that it travels once.
    lead = states.select(key, "seg", "state")
    for c in rows.columns:
        if c not in (key, "seg"):
            lead = lead.withColumn(c, F.lit(None).cast(rows.schema[c].dataType))
    both = rows.withColumn("state", F.lit(None).cast("array<double>")).unionByName(lead)

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None
        for pdf in pdfs:
            if hasattr(scan, "emits"):
                if len(pdf):
                    cuts, lead = np.array(_cuts(pdf, key)), pdf[order].isna().to_numpy()
                    starts = [np.asarray(pdf["state"].iloc[a]) if lead[a] else state for a in cuts[:-1].tolist()]
                    done, state = scan.emits(starts, pdf[~lead], (cuts - np.concatenate([[0], np.cumsum(lead)])[cuts]).tolist())
                    if len(done):
                        yield done
                continue
            parts = []
            for _, part in _runs([pdf], key):
                if pd.isna(part[order].iloc[0]):
                    state, part = np.asarray(part["state"].iloc[0]), part.iloc[1:]
                if len(part):
                    done, state = scan.emit(state, part)
                    parts.append(done)
            if parts:
                yield pd.concat(parts, ignore_index=True)

    return _dealt(both, key, "seg").sortWithinPartitions(key, "seg", F.col(order).asc_nulls_first()).mapInPandas(run, out)


# --- background ---------------------------------------------------------------------------


class BackgroundScan:
    """Running mean: after n frames it is ``keep ** n`` of the state before, plus a sum. Elements are (factor, first frame, sum)."""

    def __init__(self, learning_rate: float, threshold: float):
        self.rate, self.threshold = learning_rate, threshold

    def _frames(self, rows: pd.DataFrame) -> Iterator[np.ndarray]:
        for c, h, w, data in zip(rows["c"], rows["h"], rows["w"], rows["data"], strict=True):
            yield gray(np.asarray(data, float).reshape(1, int(c), int(h), int(w))).ravel()

    def fold(self, element: np.ndarray | None, rows: pd.DataFrame) -> np.ndarray:
        for g in self._frames(rows):
            if element is None:
                element = np.concatenate([[1.0], g, np.zeros(len(g))])
            n = len(g)
            element[0] *= 1 - self.rate
            element[1 + n :] = (1 - self.rate) * element[1 + n :] + self.rate * g
        return element

    def combine(self, first: np.ndarray, then: np.ndarray) -> np.ndarray:
        n = len(first) // 2
        return np.concatenate([[first[0] * then[0]], first[1 : 1 + n], then[0] * first[1 + n :] + then[1 + n :]])

    def start(self, first: np.ndarray) -> np.ndarray:
        return first[1 : 1 + len(first) // 2]  # the mean of the first frame with itself is that frame

    def push(self, state: np.ndarray, element: np.ndarray) -> np.ndarray:
        return element[0] * state + element[1 + len(state) :]

    def emit(self, state: np.ndarray, rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        masks = []
        for g in self._frames(rows):
            state = (1 - self.rate) * state + self.rate * g
            masks.append((np.abs(g - state) > self.threshold).astype(float))
        return rows[["video_id", "index", "h", "w"]].astype("int64").assign(c=1, data=masks)[["video_id", "index", "c", "h", "w", "data"]], state


def background_masks(frames: DataFrame, learning_rate: float = 0.05, threshold: float = 0.1, length: int = 64, fan: int = 16) -> DataFrame:
    """As :func:`.tracking.background_masks`, one video over many tasks."""
    scan = BackgroundScan(learning_rate, threshold)
    return scanned(frames.select("video_id", "index", "c", "h", "w", "data"), "video_id", "index", scan, "video_id long, index long, c int, h int, w int, data array<double>", length, fan)


# --- Kalman filter ------------------------------------------------------------------------


class KalmanScan:
    """Filter of position and speed. An element (A, b, C, eta, J) of a stretch gives mean and covariance after it for any before it,
    and how likely each state before it makes its measurements; states are (mean, covariance)."""

    def __init__(self):
        k = velocity_filter()
        self.n = n = k.n
        s = np.linalg.inv(k.h @ k.q @ k.h.T + k.r)
        self.gain = k.q @ k.h.T @ s
        rest = np.eye(n) - self.gain @ k.h
        back = k.f.T @ k.h.T @ s
        self.one = (rest @ k.f, rest @ k.q, back, back @ k.h @ k.f)
        # All but b and eta of a stretch depends on its length alone, so that it is computed once a length: (A, C, J), and how the next row moves b and eta.
        self.fixed, self.moves = [(rest @ k.f, rest @ k.q, back @ k.h @ k.f)], []

    def _split(self, e: np.ndarray) -> tuple[np.ndarray, ...]:
        n = self.n
        a, b, c, eta, j = np.split(e, np.cumsum([n * n, n, n * n, n]))
        return a.reshape(n, n), b, c.reshape(n, n), eta, j.reshape(n, n)

    def fold(self, element: np.ndarray | None, rows: pd.DataFrame) -> np.ndarray:
        zs = rows["z"].to_numpy(float)
        while len(self.moves) < len(zs) - 1:
            self._longer()
        back = self.one[2][:, 0]
        b, eta = self.gain[:, 0] * zs[0], back * zs[0]
        for z, (ahead, gain, behind, pull) in zip(zs[1:].tolist(), self.moves, strict=False):
            b, eta = ahead @ b + gain * z, eta + behind * z - pull @ b
        a, c, j = self.fixed[len(zs) - 1]
        stretch = np.concatenate([a.ravel(), b, c.ravel(), eta, j.ravel()])
        return stretch if element is None else self.combine(element, stretch)

    def _longer(self) -> None:
        """Adds the next length: :meth:`combine` with one row, but for b and eta."""
        a, c, j = self.fixed[len(self.moves)]
        a2, c2, back, j2 = self.one
        ahead = a2 @ np.linalg.inv(np.eye(self.n) + c @ j2)
        behind = a.T @ np.linalg.inv(np.eye(self.n) + j2 @ c)
        self.moves.append((ahead, (ahead @ c @ back + self.gain)[:, 0], (behind @ back)[:, 0], behind @ j2))
        self.fixed.append((ahead @ a, ahead @ c @ a2.T + c2, behind @ j2 @ a + j))

    def combine(self, first: np.ndarray, then: np.ndarray) -> np.ndarray:
        (a, b, c, eta, j), (a2, b2, c2, eta2, j2) = self._split(first), self._split(then)
        ahead = a2 @ np.linalg.inv(np.eye(self.n) + c @ j2)
        behind = a.T @ np.linalg.inv(np.eye(self.n) + j2 @ c)
        return np.concatenate([(ahead @ a).ravel(), ahead @ (b + c @ eta2) + b2, (ahead @ c @ a2.T + c2).ravel(), behind @ (eta2 - j2 @ b) + eta, (behind @ j2 @ a + j).ravel()])

    def start(self, first: np.ndarray) -> np.ndarray:
        k = velocity_filter()
        return np.concatenate([k.x, k.p.ravel()])

    def push(self, state: np.ndarray, element: np.ndarray) -> np.ndarray:
        n = self.n
        known = np.concatenate([np.zeros(n * n), state, np.zeros(n + n * n)])  # a stretch that forgets what was before
        _, b, c, _, _ = self._split(self.combine(known, element))
        return np.concatenate([b, c.ravel()])

    def emit(self, state: np.ndarray, rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        k = velocity_filter()
        k.x, k.p = state[: self.n].copy(), state[self.n :].reshape(self.n, self.n).copy()
        xs = np.zeros((len(rows), self.n))
        for i, z in enumerate(rows["z"]):
            k.predict()
            xs[i] = k.update([z])
        out = pd.DataFrame({"track_id": rows["track_id"].to_numpy(), "seq": rows["seq"].to_numpy(np.int64), "z": rows["z"].to_numpy(), "position": xs[:, 0], "speed": xs[:, 1]})
        return out, np.concatenate([k.x, k.p.ravel()])


def kalman_tracks(tracks: DataFrame, length: int = 4096, fan: int = 64) -> DataFrame:
    """As :func:`.tracking.kalman_tracks`, one track over many tasks; measurements are whole."""
    sound = tracks.filter("z IS NOT NULL AND NOT isnan(z)").select("track_id", "seq", F.col("z").cast("double").alias("z"))
    return scanned(sound, "track_id", "seq", KalmanScan(), "track_id long, seq int, z double, position double, speed double", length, fan)
