"""Shapes of point relations of any size: hulls as mergeable aggregates, rectangles, simplification by rounds, nesting.

Points are rows (group_id, x, y), with ``seq`` where their order counts; a group may hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import InvalidParameter
from ..sources.files import used_up, written
from .matching import POINTS

#: Partial hulls merged by one task in one round.
FAN_IN = 16
#: Points of a group that one task merges at once without a tree; of so few, a batch sends them as they are. Stretches shorter than ``SHORT`` are many, and not worth a call each.
FEW, RAW, SHORT = 4096, 16, 16
#: Points of a stretch that one task holds, some ten megabytes.
LONG = 1 << 17


def chain(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners of the convex hull, counter-clockwise from the leftmost; points on an edge are no corners."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    new = np.ones(len(x), bool)
    new[1:] = (np.diff(x) != 0) | (np.diff(y) != 0)
    # Only the lowest and the highest point of a column can be corners.
    x, y = x[new], y[new]
    first = np.ones(len(x), bool)
    first[1:] = np.diff(x) != 0
    keep = first | np.roll(first, -1)
    pts = list(zip(x[keep].tolist(), y[keep].tolist(), strict=True))
    if len(pts) < 3:
        return np.array([p[0] for p in pts]), np.array([p[1] for p in pts])

    def half(points):
        out: list = []
        for q in points:
            while len(out) >= 2 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    hull = half(pts) + half(pts[::-1])
    return np.array([p[0] for p in hull]), np.array([p[1] for p in hull])


def _partial(points: DataFrame) -> DataFrame:
    """Hulls of what a task holds of each group, batch by batch: the combining before the shuffle."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            group = pdf["group_id"].to_numpy()
            order = np.argsort(group, kind="stable")
            x, y = pdf["x"].to_numpy(float)[order], pdf["y"].to_numpy(float)[order]
            names, starts = np.unique(group[order], return_index=True)
            hulls = [chain(x[a:b], y[a:b]) if b - a > RAW else (x[a:b], y[a:b]) for a, b in zip(starts, [*starts[1:], len(x)], strict=True)]
            if hulls:
                yield pd.DataFrame({"group_id": np.repeat(names, [len(h[0]) for h in hulls]), "x": np.concatenate([h[0] for h in hulls]), "y": np.concatenate([h[1] for h in hulls])})

    return points.mapInPandas(run, "group_id long, x double, y double")


def _hulls_of(x: pd.Series, y: pd.Series) -> pd.Series:
    hulls = [chain(np.asarray(a, float), np.asarray(b, float)) for a, b in zip(x, y, strict=True)]
    return pd.Series([[{"x": float(a), "y": float(b)} for a, b in zip(*h, strict=True)] for h in hulls])


def convex_hulls(points: DataFrame) -> DataFrame:
    """(group_id, hull): the corners of each group's hull, counter-clockwise from the leftmost; points without both coordinates or a group are left out.

    Tasks send hulls of their own parts. Groups of which ``FEW`` points are left are merged at once; those with more in a tree of ``FAN_IN``,
    so that a task never holds more than so many hulls of one group, however many points it has.
    """
    sound = points.filter("group_id IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    rows = _partial(sound.select(F.col("group_id").cast("long").alias("group_id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))
    rows = written(rows.withColumn("part", F.spark_partition_id()), "hulls")
    large = written(rows.groupBy("group_id").count().filter(F.col("count") > FEW).select("group_id"), "large")  # each stands for many points

    corners = F.pandas_udf(_hulls_of, POINTS)

    def merged(rows: DataFrame, keys: list[str]) -> DataFrame:
        """One row a key with the hull of its points: of at most ``FAN_IN`` hulls, or ``FEW`` points, of a group."""
        return rows.groupBy(*keys).agg(F.collect_list(F.struct("x", "y")).alias("p")).select(*keys, corners(F.col("p.x"), F.col("p.y")).alias("hull"))

    if not large.limit(1).count():
        return merged(rows, ["group_id"])
    few = rows.join(large.hint("merge"), "group_id", "left_anti")
    rows = rows.join(large.hint("merge"), "group_id", "left_semi")
    most = rows.agg(F.max("part")).first()[0] or 0
    while most >= FAN_IN:
        rows = rows.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))
        rows, most = merged(rows, ["group_id", "part"]).select("group_id", "part", F.inline("hull")), most // FAN_IN
    return merged(few, ["group_id"]).unionByName(merged(rows, ["group_id"]))


def smallest_rects(hulls: DataFrame) -> DataFrame:
    """(group_id, area, length, breadth, angle): the smallest rectangle around each hull, which lies along one of its edges.

    Of equal rectangles (to nine digits) the one of the least length, then of the least angle in degrees is told; a hull of one point has no extent.
    """
    n = F.size("hull")

    # Step by step, as an expression used twice within a lambda is computed twice.
    def side(p: Column, q: Column) -> Column:
        return F.struct((q["x"] - p["x"]).alias("dx"), (q["y"] - p["y"]).alias("dy"))

    def turned(e: Column) -> Column:
        norm = F.sqrt(e["dx"] * e["dx"] + e["dy"] * e["dy"])
        return F.struct((e["dx"] / norm).alias("c"), (e["dy"] / norm).alias("s"), F.pmod(F.degrees(F.atan2(e["dy"], e["dx"])), F.lit(90.0)).alias("angle"))

    def spread(e: Column) -> Column:
        return F.struct(F.transform("hull", lambda p: p["x"] * e["c"] + p["y"] * e["s"]).alias("u"), F.transform("hull", lambda p: p["y"] * e["c"] - p["x"] * e["s"]).alias("v"), e["angle"].alias("angle"))

    def sizes(e: Column) -> Column:
        return F.struct((F.array_max(e["u"]) - F.array_min(e["u"])).alias("a"), (F.array_max(e["v"]) - F.array_min(e["v"])).alias("b"), e["angle"].alias("angle"))

    def rect(e: Column) -> Column:
        a, b = e["a"], e["b"]
        return F.struct(F.round(a * b, 9).alias("area"), F.round(F.greatest(a, b), 9).alias("length"), F.round(F.least(a, b), 9).alias("breadth"), F.round(e["angle"], 9).alias("angle"))

    rects = F.zip_with("hull", F.concat(F.slice("hull", 2, n), F.slice("hull", 1, 1)), side)
    for step in (turned, spread, sizes, rect):
        rects = F.transform(rects, step)
    edges = F.when(n > 1, rects).otherwise(F.array(F.struct(*[F.lit(0.0).alias(k) for k in ("area", "length", "breadth", "angle")])))
    return hulls.select("group_id", F.array_min(edges).alias("r")).select("group_id", "r.area", "r.length", "r.breadth", "r.angle")


def _segment_distance(x: Column, y: Column, a: Column, b: Column) -> Column:
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    t = F.least(F.greatest(((x - a["x"]) * dx + (y - a["y"]) * dy) / F.greatest(dx * dx + dy * dy, F.lit(1e-12)), F.lit(0.0)), F.lit(1.0))
    return F.sqrt(F.pow(x - a["x"] - t * dx, 2) + F.pow(y - a["y"] - t * dy, 2))


def _cuts(s: np.ndarray, x: np.ndarray, y: np.ndarray, a: tuple, b: tuple, epsilon: float) -> list[int]:
    """Places of the points that simplification keeps between ``a`` and ``b``; points are sorted by (s, -x, -y), so that the first of the farthest is the one to take."""
    keep, todo = [], [(0, len(s), a, b)]
    while todo:
        lo, hi, (ax, ay), (bx, by) = todo.pop()
        if lo == hi:
            continue
        px, py, dx, dy = x[lo:hi], y[lo:hi], bx - ax, by - ay
        t = np.clip(((px - ax) * dx + (py - ay) * dy) / max(dx * dx + dy * dy, 1e-12), 0, 1)
        far = np.sqrt((px - ax - t * dx) ** 2 + (py - ay - t * dy) ** 2)
        k = int(far.argmax())
        if far[k] > epsilon:
            k += lo
            keep.append(k)
            corner = (x[k], y[k])
            todo += [(lo, lo + int(np.searchsorted(s[lo:hi], s[k])), (ax, ay), corner), (lo + int(np.searchsorted(s[lo:hi], s[k], "right")), hi, corner, (bx, by))]
    return keep


def _finished(stretches: DataFrame, epsilon: float) -> DataFrame:
    """(group_id, p): points kept within stretches that fit in a task, one held at a time."""
    kinds = dict(stretches.dtypes)
    rows = stretches.select("group_id", "s", "px", "py", F.col("a.seq").alias("begin"), *[F.col(f"{e}.{c}").alias(f"{e}{c}") for e in ("a", "b") for c in ("x", "y")])

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def kept(pdf: pd.DataFrame) -> pd.DataFrame:
            group, begin = pdf["group_id"].to_numpy(), pdf["begin"].to_numpy()
            cuts = [0, *(np.flatnonzero((group[1:] != group[:-1]) | (begin[1:] != begin[:-1])) + 1).tolist(), len(pdf)]
            s, x, y, ax, ay, bx, by = (pdf[c].to_numpy() for c in ("s", "px", "py", "ax", "ay", "bx", "by"))
            at = [i + k for i, j in zip(cuts, cuts[1:], strict=False) for k in _cuts(s[i:j], x[i:j], y[i:j], (ax[i], ay[i]), (bx[i], by[i]), epsilon)]
            return pdf.iloc[at][["group_id", "s", "px", "py"]]

        held: list[pd.DataFrame] = []  # of the last stretch, which may go on
        for pdf in pdfs:
            if not len(pdf):
                continue
            pdf = pd.concat([*held, pdf]) if held else pdf
            last = np.flatnonzero((pdf["group_id"].to_numpy() == pdf["group_id"].iloc[-1]) & (pdf["begin"].to_numpy() == pdf["begin"].iloc[-1]))[0]
            if last:
                yield kept(pdf.iloc[:last])
            held = [pdf.iloc[last:]]
        if held:
            yield kept(held[0])

    parts = int(stretches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "group_id", "begin").sortWithinPartitions("group_id", "begin", "s", F.desc("px"), F.desc("py"))
    found = dealt.mapInPandas(run, f"group_id {kinds['group_id']}, s {kinds['s']}, px double, py double")
    return found.select("group_id", F.struct(F.col("s").alias("seq"), F.col("px").alias("x"), F.col("py").alias("y")).alias("p"))


def simplified(points: DataFrame, epsilon: float) -> DataFrame:
    """The points (group_id, seq, x, y) that Douglas and Peucker's simplification keeps, all groups and all stretches of a level at once.

    A level finds each stretch's farthest point by partial aggregation; stretches with none beyond ``epsilon`` are done and their points
    go. Stretches of ``SHORT`` to ``LONG`` points are finished by one task each, after the levels. Levels are as many as the deepest split of what is longer
    or shorter, each a table that replaces the one before.
    """
    if epsilon < 0:
        raise InvalidParameter("a distance is not negative")
    at = F.struct("seq", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    ends = points.groupBy("group_id").agg(F.min(at).alias("a"), F.max(at).alias("b"))
    kept = [ends.select("group_id", F.explode(F.array_distinct(F.array("a", "b"))).alias("p"))]
    inner = points.select("group_id", F.col("seq").alias("s"), F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py")).join(ends, "group_id").filter("s > a.seq AND s < b.seq")
    inner, short = written(inner, "stretches"), []
    while True:
        far = inner.withColumn("d", _segment_distance(F.col("px"), F.col("py"), F.col("a"), F.col("b")))
        # The farthest, the first of equals.
        top = far.groupBy("group_id", F.col("a.seq").alias("from"), F.col("b.seq").alias("to")).agg(F.max(F.struct("d", (-F.col("s")).alias("back"), "px", "py")).alias("m"), F.count("*").alias("n"), F.count("d").alias("known")).filter(F.col("m.d") > epsilon)
        ends_here = F.col("n").between(SHORT, LONG) & (F.col("n") == F.col("known")) & ~F.isnan("m.d")
        cut = written(top.select("group_id", "from", "to", ends_here.alias("last"), F.struct((-F.col("m.back")).alias("seq"), F.col("m.px").alias("x"), F.col("m.py").alias("y")).alias("k")), "cuts")
        if not cut.limit(1).count():
            break
        kept.append(cut.filter("NOT last").select("group_id", F.col("k").alias("p")))
        now = inner.join(cut, (inner["group_id"] == cut["group_id"]) & (inner["a.seq"] == cut["from"]) & (inner["b.seq"] == cut["to"])).drop(cut["group_id"]).filter("last OR s <> k.seq")
        before = F.col("s") < F.col("k.seq")
        begin, end = F.when(F.col("last") | before, F.col("a")).otherwise(F.col("k")), F.when(F.col("last") | ~before, F.col("b")).otherwise(F.col("k"))
        new = written(now.select("group_id", "s", "px", "py", begin.alias("a"), end.alias("b"), "last"), "stretches")
        if cut.filter("last").limit(1).count():
            short.append(written(new.filter("last").drop("last"), "short"))
        used_up(inner)
        inner = new.filter("NOT last").drop("last")
    if short:
        rest = short[0]
        for r in short[1:]:
            rest = rest.unionByName(r)
        kept.append(written(_finished(rest, epsilon), "finished"))
        for r in short:
            used_up(r)
    out = kept[0]
    for k in kept[1:]:
        out = out.unionByName(k)
    return out.select("group_id", "p.seq", "p.x", "p.y")


# --- nesting ------------------------------------------------------------------------------


#: Contours of a block, middles that one task holds while it looks for what holds them, and middles sent at once.
CONTOURS, WAITING, PACK = 64, 2048, 256
#: Crossings worked out at once, in numbers.
CROSSINGS = 1 << 20
_CELL = ["image_id", "level", "gx", "gy"]


class _Block:
    """Contours of one cell in order of (area, number), as flat arrays."""

    def __init__(self, ids: np.ndarray, areas: np.ndarray, counts: np.ndarray, xs: np.ndarray, ys: np.ndarray):
        self.arrays = ids, areas, counts, xs, ys

    def to_bytes(self) -> bytes:
        ids, areas, counts, xs, ys = self.arrays
        return b"".join((np.int64(len(ids)).tobytes(), ids.astype(np.int64).tobytes(), areas.tobytes(), counts.astype(np.int64).tobytes(), xs.tobytes(), ys.tobytes()))

    @classmethod
    def from_bytes(cls, data: bytes) -> _Block:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        ids, areas, counts = np.frombuffer(data, np.int64, n, 8), np.frombuffer(data, float, n, 8 + 8 * n), np.frombuffer(data, np.int64, n, 8 + 16 * n)
        points = np.frombuffer(data, float, -1, 8 + 24 * n)
        return cls(ids, areas, counts, points[: len(points) // 2], points[len(points) // 2 :])

    def first_around(self, mx: np.ndarray, my: np.ndarray, area: np.ndarray) -> np.ndarray:
        """Place of the first contour, larger than ``area``, that holds each point; -1 where none does."""
        _, areas, counts, xs, ys = self.arrays
        starts = np.cumsum(counts) - counts
        after = np.arange(1, len(xs) + 1)
        after[starts + counts - 1] = starts  # a contour's last point is followed by its first
        nx, ny = xs[after], ys[after]
        x0, x1, y0, y1 = (f.reduceat(v, starts) for v in (xs, ys) for f in (np.minimum, np.maximum))
        out = np.full(len(mx), -1)
        step = max(1, CROSSINGS // len(xs))
        for k in range(0, len(mx), step):
            x, y = mx[k : k + step, None], my[k : k + step, None]
            crossed = ((ys > y) != (ny > y)) & (x < (nx - xs) * (y - ys) / (ny - ys + 1e-9) + xs)
            inside = np.add.reduceat(crossed, starts, axis=1, dtype=np.int64) % 2 == 1
            inside &= (areas > area[k : k + step, None]) & (x0 <= x) & (x <= x1) & (y0 <= y) & (y <= y1)
            out[k : k + step] = np.where(inside.any(1), inside.argmax(1), -1)
        return out


_SWEPT = "kind int, image_id long, level int, gx long, gy long, pid int, seq long, contour_id long, mx double, my double, area double, outer long, outer_area double, data binary"


def _sweep(batches: Iterator[pa.RecordBatch], most: int, wait: int) -> Iterator[pa.RecordBatch]:
    """Rows of cells in order of area: blocks (kind 0), the least contour around a middle (1), and middles for which a later task may hold one (2).

    A middle waits while the cell's larger contours go by, and leaves with the first that holds it; at most ``2 * wait + most`` wait at once.
    """
    pid, cell, seq = TaskContext.get().partitionId(), None, 0
    block: list[tuple] = []
    waiting: list[tuple] = []
    out: list[tuple] = []

    def close(last: bool) -> None:
        """End a block; the middles that go on are those least in area, in front."""
        nonlocal block, waiting, seq
        if block:
            ids, areas, xs, ys = zip(*block, strict=True)
            made = _Block(np.array(ids), np.array(areas, float), np.array([len(x) for x in xs]), np.concatenate(xs), np.concatenate(ys))
            out.append((0, *cell, pid, seq, None, None, None, None, None, None, made.to_bytes()))
            if waiting:
                _, mx, my, area = (np.array(v) for v in zip(*waiting, strict=True))
                found = made.first_around(mx, my, area).tolist()
                out.extend((1, *cell, pid, seq, *w, ids[f], areas[f], None) for w, f in zip(waiting, found, strict=True) if f >= 0)
                waiting = [w for w, f in zip(waiting, found, strict=True) if f < 0]
            block, seq = [], seq + 1
        gone = len(waiting) if last else max(0, len(waiting) - wait)
        out.extend((2, *cell, pid, seq, *w, None, None, None) for w in waiting[:gone])
        waiting = waiting[gone:]

    def told() -> pa.RecordBatch:
        nonlocal out
        rows, out = out, []
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), _SWEPT_TYPES, strict=True)], schema=_SWEPT_TYPES)

    for b in batches:
        keys = list(zip(*(b.column(c).to_pylist() for c in _CELL), strict=True))
        ids, mx, my, area, asks = (b.column(c).to_pylist() for c in ("id", "mx", "my", "area", "asks"))
        xs, ys = (b.column(c) for c in ("xs", "ys"))
        ends = xs.offsets.to_numpy()
        flat_x, flat_y = (v.values.to_numpy(zero_copy_only=False) for v in (xs, ys))
        for k, key in enumerate(keys):
            if key != cell:
                if cell is not None:
                    close(True)
                cell, seq = key, 0
            if asks[k]:
                waiting.append((ids[k], mx[k], my[k], area[k]))
                if len(waiting) > 2 * wait:
                    close(False)
            else:
                block.append((ids[k], area[k], flat_x[ends[k] : ends[k + 1]].copy(), flat_y[ends[k] : ends[k + 1]].copy()))
                if len(block) == most:
                    close(False)
            if len(out) >= 4096:
                yield told()
    if cell is not None:
        close(True)
    if out:
        yield told()


_SWEPT_TYPES = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}[k]) for n, k in (c.split() for c in _SWEPT.split(", "))])
_ANSWER = "image_id long, level int, gx long, gy long, contour_id long, outer long, outer_area double"
_PACK = "image_id long, level int, gx long, gy long, at long, n long, asked binary"


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Middles (sorted) that ask one block, at most ``PACK`` a row."""
    for b in batches:
        keys = list(zip(*(b.column(c).to_pylist() for c in (*_CELL, "at")), strict=True))
        ids, mx, my, area = (b.column(c).to_numpy() for c in ("contour_id", "mx", "my", "area"))
        starts = [k for k in range(len(keys)) if not k or keys[k] != keys[k - 1]]
        cuts = [c for s, e in zip(starts, [*starts[1:], len(keys)], strict=True) for c in range(s, e, PACK)]
        rows = [(*keys[s], e - s, b"".join((ids[s:e].tobytes(), mx[s:e].tobytes(), my[s:e].tobytes(), area[s:e].tobytes()))) for s, e in zip(cuts, [*cuts[1:], len(keys)], strict=True)]
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip((*_CELL, "at", "n", "asked"), r, strict=True)) for r in rows], pa.schema([(c, pa.int32() if c == "level" else pa.binary() if c == "asked" else pa.int64()) for c in (*_CELL, "at", "n", "asked")]))


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first contour of a block around each middle of a pack."""
    names = [*_CELL, "contour_id", "outer", "outer_area"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
    for b in batches:
        for k in range(b.num_rows):
            n, asked, made = b.column("n")[k].as_py(), b.column("asked")[k].as_py(), _Block.from_bytes(b.column("data")[k].as_py())
            ids, (mx, my, area) = np.frombuffer(asked, np.int64, n), np.frombuffer(asked, float, 3 * n, 8 * n).reshape(3, n)
            found = made.first_around(mx, my, area)
            hit = np.flatnonzero(found >= 0)
            if len(hit):
                cell = [np.full(len(hit), b.column(c)[k].as_py()) for c in _CELL]
                values = [*cell, ids[hit], made.arrays[0][found[hit]], made.arrays[1][found[hit]]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names=names)


def _later(swept: DataFrame) -> DataFrame:
    """Answers to the middles that outlast their task's rows: rounds over the next blocks of their cell, four times as many each."""
    block = swept.filter("kind = 0")
    marks = swept.filter("kind IN (0, 2)").select(*_CELL, "pid", "seq", (F.col("kind") == 0).cast("long").alias("is_block"), "contour_id", "mx", "my", "area")
    order = Window.partitionBy(*_CELL).orderBy("pid", "seq", "is_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = written(marks.withColumn("at", F.sum("is_block").over(order)), "places")  # one row a block or middle left over
    blocks = block.join(placed.filter("is_block = 1").select(*_CELL, "pid", "seq", (F.col("at") - 1).alias("at")), [*_CELL, "pid", "seq"]).select(*_CELL, "at", "data")
    total = placed.filter("is_block = 1").groupBy(*_CELL).agg(F.count("*").alias("blocks"))
    left = placed.filter("is_block = 0").drop("is_block", "pid", "seq").join(total, _CELL).filter("at < blocks")
    left, width, found = written(left, "left"), 4, []
    parts = int(swept.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if left.limit(1).count():
        blocks = written(blocks, "blocks")
    while left.limit(1).count():
        asked = left.select(*_CELL, "contour_id", "mx", "my", "area", F.explode(F.sequence("at", F.least(F.col("at") + width, F.col("blocks")) - 1)).alias("at"))
        packs = written(asked.repartition(parts, *_CELL, "at").sortWithinPartitions(*_CELL, "at").mapInArrow(_packs, _PACK), "packs")
        found.append(written(packs.join(blocks, [*_CELL, "at"]).mapInArrow(_answers, _ANSWER), "answers"))
        more = written(left.join(found[-1].select(*_CELL, "contour_id").distinct(), [*_CELL, "contour_id"], "left_anti").withColumn("at", F.col("at") + width).filter("at < blocks"), "left")
        used_up(packs)
        used_up(left)
        left, width = more, 4 * width
    out = swept.filter("kind = 1").select("image_id", "contour_id", "outer", "outer_area")
    for f in found:
        out = out.unionByName(f.select(*out.columns))
    return out


def _level(side: Column) -> Column:
    """Class of a size: cells of the class are at least as wide as its members, and less than twice as wide but for the least."""
    return F.greatest(F.ceil(F.log2(F.greatest(side, F.lit(1.0)))), F.lit(0)).cast("int")


def nesting(contours: DataFrame, block: int = CONTOURS, waiting: int = WAITING) -> DataFrame:
    """(image_id, contour_id, parent): of each contour (image_id, contour_id, points) the smallest of the larger ones that hold its middle, or -1.

    A contour is entered in the cells of a grid of its size class that its bounding box touches, four at most. The middle of each contour asks one cell of every
    class in its image. A cell's contours and middles are dealt by ranges of area and go by in that order, and a middle goes once something holds it: so it meets the contours
    up to its parent, never all of a cell, unless nothing there holds it. Of equal areas the smaller number is the parent.
    """
    p = F.col("points")
    n = F.size(p)
    xs, ys = F.transform(p, lambda q: q["x"].cast("double")), F.transform(p, lambda q: q["y"].cast("double"))
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, e: s + e) / n
    rolled = F.concat(F.slice(p, 2, n - 1), F.slice(p, 1, 1))
    area = F.abs(F.aggregate(F.zip_with(p, rolled, lambda a, b: (a["x"] * b["y"] - b["x"] * a["y"]).cast("double")), F.lit(0.0), lambda s, e: s + e)) / 2
    c = contours.filter(n > 0).select("image_id", "contour_id", "points", mean(xs).alias("mx"), mean(ys).alias("my"), area.alias("area"), F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))
    c = written(c.withColumn("level", _level(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))), "contours")
    cell = lambda v, level: F.floor(v / F.pow(F.lit(2.0), level)).cast("long")
    held = c.withColumn("gx", F.explode(F.sequence(cell(F.col("x0"), F.col("level")), cell(F.col("x1"), F.col("level"))))).withColumn("gy", F.explode(F.sequence(cell(F.col("y0"), F.col("level")), cell(F.col("y1"), F.col("level")))))
    sound = "image_id IS NOT NULL AND contour_id IS NOT NULL AND NOT isnan(area) AND NOT isnan(mx) AND NOT isnan(my)"
    coordinates = [F.col(f"points.{k}").cast("array<double>").alias(f"{k}s") for k in ("x", "y")]
    keys = [F.col("image_id").cast("long").alias("image_id"), "level", "gx", "gy", F.col("contour_id").cast("long").alias("id"), "mx", "my", "area"]
    held = held.filter(sound).select(*keys, *coordinates, F.lit(False).alias("asks"))
    classes = c.groupBy("image_id").agg(F.collect_set("level").alias("levels"))  # a few dozen an image
    asked = c.filter(sound).select("image_id", "contour_id", "mx", "my", "area").join(classes, "image_id").withColumn("level", F.explode("levels")).drop("levels")
    asked = asked.withColumn("gx", cell(F.col("mx"), F.col("level"))).withColumn("gy", cell(F.col("my"), F.col("level")))
    none = F.array().cast("array<double>")
    asked = asked.select(*keys, none.alias("xs"), none.alias("ys"), F.lit(True).alias("asks"))
    parts = int(contours.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = held.unionByName(asked).repartitionByRange(parts, *_CELL, "area", "id").sortWithinPartitions(*_CELL, "area", "id")
    swept = written(dealt.mapInArrow(partial(_sweep, most=block, wait=waiting), _SWEPT), "swept")
    least = _later(swept).groupBy("image_id", "contour_id").agg(F.min(F.struct("outer_area", "outer")).alias("m"))
    parent = F.coalesce("m.outer", F.lit(-1)).cast(c.schema["contour_id"].dataType)
    return c.select("image_id", "contour_id").join(least, ["image_id", "contour_id"], "left").select("image_id", "contour_id", parent.alias("parent"))
