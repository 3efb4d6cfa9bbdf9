"""Matching over relations: nearest descriptors, k-means, box overlap and suppression, hulls."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shapes import iou
from ..schema import InvalidParameter

#: Rows of one block of descriptors.
BLOCK = 2048
#: Boxes of a group that one task holds, and of one that is settled together with others.
FEW_BOXES, MOST_AT_ONCE = 4096, 32


def _blocks(df: DataFrame, idx: str, vec: str, n: int, name: str) -> DataFrame:
    """Descriptors packed into blocks of about ``BLOCK`` rows by a hash of their index."""
    k = max(1, math.ceil(n / BLOCK))
    rows = df.select(F.col(idx).cast("long").alias("i"), F.col(vec).cast("array<double>").alias("v"), F.pmod(F.xxhash64(idx), F.lit(k)).alias("block"))
    return rows.groupBy("block").agg(F.collect_list("i").alias(f"{name}_ids"), F.flatten(F.collect_list("v")).alias(f"{name}_data")).select(F.col("block").alias(f"{name}_block"), f"{name}_ids", f"{name}_data")


def match_descriptors(query: DataFrame, train: DataFrame, idx: str = "idx", vec: str = "vec") -> DataFrame:
    """(query_idx, train_idx, distance): nearest training row by Euclidean distance, the first of equals.

    Both sides are packed into blocks; each pair of blocks is one small task's matrix product that gives a row
    a query, and the least of those is taken. No side is broadcast or held whole.
    """
    q, t = _blocks(query, idx, vec, query.count(), "q"), _blocks(train, idx, vec, train.count(), "t")
    # Every pair of blocks, met by equal keys: each block of one side is repeated for the blocks of the other.
    tb = t.select("t_block").agg(F.collect_list("t_block").alias("all"))
    pairs = q.crossJoin(F.broadcast(tb)).withColumn("t_block", F.explode("all")).drop("all").join(t, "t_block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # One pair at a time and as flat arrays; a batch of blocks as Python numbers would take several times its bytes.
            for row in range(b.num_rows):
                qi, qd, ti, td = (b.column(c)[row].values.to_numpy(zero_copy_only=False) for c in ("q_ids", "q_data", "t_ids", "t_data"))
                order = np.argsort(ti)
                tr = td.reshape(len(ti), -1)[order]
                qu = qd.reshape(len(qi), -1)
                d = np.maximum((qu**2).sum(1)[:, None] + (tr**2).sum(1)[None] - 2 * qu @ tr.T, 0)
                best = d.argmin(1)
                dist = np.sqrt(((qu - tr[best]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([pa.array(qi, pa.int64()), pa.array(ti[order][best]), pa.array(dist)], names=["query_idx", "train_idx", "distance"])

    near = pairs.mapInArrow(run, "query_idx long, train_idx long, distance double")
    return near.groupBy("query_idx").agg(F.min(F.struct("distance", "train_idx")).alias("m")).select("query_idx", F.col("m.train_idx").alias("train_idx"), F.col("m.distance").alias("distance"))


def approximate_matches(query: DataFrame, train: DataFrame, radius: float | None = None, idx: str = "idx", vec: str = "vec", **options) -> DataFrame:
    """As :func:`match_descriptors`, by a search that leaves out what can't be near; unlike a tree with a budget of checks it loses no row.

    ``radius`` is accepted for callers that give one; rows beyond it are found too.
    """
    from .nearest import pivot_matches

    return pivot_matches(query, train, idx, vec, **options)


def _distances(vec: Column, centroids: list[list[float]]) -> Column:
    one = lambda c: F.aggregate(F.zip_with(vec, F.array(*[F.lit(float(x)) for x in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    return F.array(*[one(c) for c in centroids])


def kmeans_predict(df: DataFrame, centroids: list[list[float]], vec: str = "vec") -> DataFrame:
    """``df`` with the nearest centroid in ``cluster``, the first of equals."""
    if not centroids:
        raise InvalidParameter("the model has not been fitted")
    d = _distances(F.col(vec).cast("array<double>"), centroids)
    return df.withColumn("_d", d).withColumn("cluster", (F.array_position("_d", F.array_min("_d")) - 1).cast("int")).drop("_d")


def kmeans_fit(df: DataFrame, k: int, max_iter: int, idx: str = "idx", vec: str = "vec") -> list[list[float]]:
    """Lloyd's algorithm from the first k rows, until the centroids rest; a cluster without rows becomes the zero vector.

    Only k centroids ever reach the driver; each round is one pass over the persisted vectors with partial sums.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    first = df.orderBy(idx).limit(k).select(F.col(vec).cast("array<double>").alias("v")).collect()
    centroids = [list(r["v"]) for r in first]
    if not centroids:
        return []
    vectors = df.select(F.col(vec).cast("array<double>").alias("vec")).persist()
    try:
        for _ in range(max_iter):
            means = kmeans_predict(vectors, centroids).groupBy("cluster").agg(Summarizer.mean(array_to_vector(F.col("vec"))).alias("m")).collect()
            new = {r["cluster"]: r["m"].toArray().tolist() for r in means}
            last, centroids = centroids, [new.get(c, [0.0] * len(centroids[0])) for c in range(len(centroids))]
            if centroids == last:
                break
    finally:
        vectors.unpersist()
    return centroids


def _met_boxes(boxes: DataFrame, *keep: str) -> DataFrame:
    """Pairs of boxes of a group that may overlap, each once: (group_id, and of both sides ``keep``, seq, box).

    A box is entered in the cells of a grid of its size class (cells as wide as its longer side, rounded up to a power of two; four cells at most), and asks the
    cells that it touches of every larger class in its group (four a class). So a huge box meets those under it, and others meet neighbours of their size.
    """
    level = F.greatest(F.ceil(F.log2(F.greatest(F.col("width"), F.col("height"), F.lit(1)).cast("double"))), F.lit(0)).cast("int")
    b = boxes.select("group_id", *keep, "seq", F.struct("x", "y", "width", "height").alias("box"), level.alias("level"))
    classes = b.groupBy("group_id").agg(F.collect_set("level").alias("levels"))  # a few dozen a group
    asking = b.join(classes, "group_id").withColumn("at", F.explode(F.filter("levels", lambda k: k >= F.col("level")))).drop("levels")
    cell = lambda v: F.floor(v / F.pow(F.lit(2.0), F.col("at"))).cast("long")
    low = asking.withColumn("x0", cell(F.col("box.x"))).withColumn("y0", cell(F.col("box.y")))
    ends = low.withColumn("cx", F.explode(F.sequence("x0", cell(F.col("box.x") + F.col("box.width"))))).withColumn("cy", F.explode(F.sequence("y0", cell(F.col("box.y") + F.col("box.height")))))
    side = lambda e, rows: rows.select("group_id", "at", "cx", "cy", *[F.col(c).alias(c + e) for c in (*keep, "seq", "box", "level", "x0", "y0")])
    # The larger box is at home in the cells; of one class the smaller number asks. A pair is taken in the first cell that both touch.
    met = side("_a", ends).join(side("_b", ends.filter("at = level")), ["group_id", "at", "cx", "cy"]).filter("(level_a < level_b OR level_a = level_b AND seq_a < seq_b) AND cx = greatest(x0_a, x0_b) AND cy = greatest(y0_a, y0_b)")
    swap = F.col("seq_a") > F.col("seq_b")
    both = [F.when(swap, F.col(f"{c}_{p}")).otherwise(F.col(f"{c}_{q}")).alias(f"{c}_{e}") for c in (*keep, "seq", "box") for e, p, q in (("a", "b", "a"), ("b", "a", "b"))]
    return met.select("group_id", *both)


def iou_pairs(boxes: DataFrame, least: float) -> DataFrame:
    """Pairs of boxes of a group (seq_a < seq_b) with an overlap of at least ``least``, which is over 0; boxes meet by cells of size classes."""
    if least <= 0:
        raise InvalidParameter("boxes that do not meet have no overlap")
    return _met_boxes(boxes).withColumn("iou", iou(F.col("box_a"), F.col("box_b"))).filter(F.col("iou") >= least).select("group_id", "seq_a", "seq_b", "iou")


def suppressed_boxes(boxes: DataFrame, score_threshold: float, nms_threshold: float, few: int = FEW_BOXES) -> DataFrame:
    """As :func:`nms_boxes` for groups of any size, without the rank: (group_id, seq) of the boxes that stay.

    Groups of at most ``few`` boxes are settled one at a time as they go by. In larger ones overlapping pairs come from cells of size classes, and the greedy choice
    by score is made in rounds over these pairs.
    """
    from ..sources.files import written
    from .graph import first_kept

    scored = written(boxes.filter(F.col("score") >= score_threshold), "scored")
    large = written(scored.groupBy("group_id").agg(F.count("*").alias("n")).filter(F.col("n") > few).select("group_id"), "large")  # each stands for many boxes
    kinds = dict(scored.dtypes)
    small = scored.filter("group_id IS NOT NULL").join(large.hint("merge"), "group_id", "left_anti")
    out = nms_boxes(small, score_threshold, nms_threshold).select(*[F.col(c).cast(kinds[c]).alias(c) for c in ("group_id", "seq")])
    if not large.limit(1).count():
        return out.unionByName(scored.filter("group_id IS NULL").select("group_id", "seq"))
    scored = scored.filter("group_id IS NULL").unionByName(scored.join(large.hint("merge"), "group_id", "left_semi").select(*scored.columns))
    met = _met_boxes(scored, "score").withColumn("iou", iou(F.col("box_a"), F.col("box_b"))).filter(F.col("iou") > nms_threshold)
    name = lambda e: F.struct((-F.col(f"score{e}")).alias("order"), F.col(f"seq{e}").alias("seq"))
    a, b = name("_a"), name("_b")
    clashes = met.select("group_id", F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    kept = first_kept(scored.select("group_id", name("").alias("node")), clashes, "group_id")
    return out.unionByName(kept.select("group_id", "node.seq"))


def suppress(boxes: np.ndarray, scores: np.ndarray, score_threshold: float, nms_threshold: float) -> list[int]:
    """Greedy non-maximum suppression of (x, y, width, height) rows; best first, earlier ones first among equals."""
    left = np.argsort(-scores, kind="stable")
    left = left[scores[left] >= score_threshold]
    keep: list[int] = []
    while len(left):
        i, left = left[0], left[1:]
        keep.append(int(i))
        x, y, w, h = boxes[i]
        u, v, m, n = boxes[left].T
        inter = np.clip(np.minimum(x + w, u + m) - np.maximum(x, u), 0, None) * np.clip(np.minimum(y + h, v + n) - np.maximum(y, v), 0, None)
        union = w * h + m * n - inter
        left = left[~((union > 0) & (inter > nms_threshold * union))]
    return keep


def suppress_groups(sizes: np.ndarray, boxes: np.ndarray, scores: np.ndarray, score_threshold: float, nms_threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """:func:`suppress` for consecutive groups of ``sizes`` rows: rows that stay, and their ranks, group by group. Small groups of about one size go at once."""
    group = np.repeat(np.arange(len(sizes)), sizes)
    valid = np.flatnonzero(scores >= score_threshold)
    order = valid[np.lexsort((valid, -scores[valid], group[valid]))]
    sizes = np.bincount(group[valid], minlength=len(sizes))
    starts = np.cumsum(sizes) - sizes
    rows, ranks = [np.empty(0, int)], [np.empty(0, int)]
    for g in np.flatnonzero(sizes > MOST_AT_ONCE):
        part = order[starts[g] : starts[g] + sizes[g]]
        rows.append(part[suppress(boxes[part], scores[part], score_threshold, nms_threshold)])
        ranks.append(np.arange(len(rows[-1])))
    width = 1
    while width <= MOST_AT_ONCE:
        some = np.flatnonzero((sizes > width // 2) & (sizes <= width))
        if len(some):
            there = np.arange(width) < sizes[some, None]
            at = order[np.where(there, starts[some, None] + np.arange(width), starts[some, None])]
            x, y, w, h = np.moveaxis(boxes[at], 2, 0)
            side = lambda p, e: np.clip(np.minimum((p + e)[:, :, None], (p + e)[:, None]) - np.maximum(p[:, :, None], p[:, None]), 0, None)
            inter = side(x, w) * side(y, h)
            union = (w * h)[:, :, None] + (w * h)[:, None] - inter
            clash = (union > 0) & (inter > nms_threshold * union)
            keep = there.copy()
            for k in range(width - 1):
                keep[:, k + 1 :] &= ~(clash[:, k, k + 1 :] & keep[:, k, None])
            rows.append(at[keep])
            ranks.append((np.cumsum(keep, 1) - 1)[keep])
        width *= 2
    rows, ranks = np.concatenate(rows), np.concatenate(ranks)
    told = np.lexsort((ranks, group[rows]))
    return rows[told], ranks[told]


def nms_boxes(boxes: DataFrame, score_threshold: float, nms_threshold: float) -> DataFrame:
    """The boxes (group_id, seq, x, y, width, height, score) that stay, with their rank in the group.

    Rows are dealt by group and sorted by Spark; a task streams its groups, holding one at a time.
    """

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: list[pd.DataFrame] = []  # of the last group, which may go on
        for pdf in pdfs:
            group = pdf["group_id"].to_numpy()
            if parts and group[0] != parts[0]["group_id"].iloc[0]:
                yield kept(pd.concat(parts))
                parts = []
            last = group.searchsorted(group[-1])
            if last and parts:
                first = group.searchsorted(group[0], "right")
                yield kept(pd.concat([*parts, pdf.iloc[:first]]))
                parts, pdf, last = [], pdf.iloc[first:], last - first
            if last:
                yield kept(pdf.iloc[:last])
            parts.append(pdf.iloc[last:])
        if parts:
            yield kept(pd.concat(parts))

    def kept(pdf: pd.DataFrame) -> pd.DataFrame:
        group, seq = pdf["group_id"].to_numpy(), pdf["seq"].to_numpy()
        box, score = pdf[["x", "y", "width", "height"]].to_numpy(float), pdf["score"].to_numpy(float)
        cuts = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]])
        at, rank = suppress_groups(np.diff(cuts), box, score, score_threshold, nms_threshold)
        return pd.DataFrame({"group_id": group[at], "seq": seq[at], "rank": rank})

    ordered = boxes.filter(F.col("score") >= score_threshold).select("group_id", "seq", "x", "y", "width", "height", "score").repartition("group_id").sortWithinPartitions("group_id", "seq")
    return ordered.mapInPandas(run, "group_id long, seq int, rank int")


# --- shapes that need an order of points ------------------------------------------------------


def convex_hull(p: np.ndarray) -> np.ndarray:
    """Monotone chain, counter-clockwise; three points or fewer stay as they are."""
    if len(p) <= 3:
        return p
    pts = sorted(map(tuple, p.tolist()))

    def half(points):
        out: list = []
        for q in points:
            while len(out) >= 2 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def approx_poly_dp(p: np.ndarray, epsilon: float) -> np.ndarray:
    """Douglas and Peucker's simplification, with a stack."""
    keep, todo = {0, len(p) - 1}, [(0, len(p) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        (x, y), (dx, dy) = p[a], p[b] - p[a]
        px, py = p[a + 1 : b].T
        # Plain products and sums, each rounded, in the order of the SQL and of polygons.simplified: of equal distances the first has to be found equal.
        t = np.clip(((px - x) * dx + (py - y) * dy) / max(dx * dx + dy * dy, 1e-12), 0, 1)
        far = np.sqrt((px - x - t * dx) ** 2 + (py - y - t * dy) ** 2)
        k = int(far.argmax())
        if far[k] > epsilon:
            keep.add(a + 1 + k)
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return p[sorted(keep)]


_COS = np.array([math.cos(math.radians(a)) for a in range(90)])
_SIN = np.array([math.sin(math.radians(a)) for a in range(90)])


def min_area_rect(p: np.ndarray) -> dict:
    """The smallest of the bounding boxes turned by 0 to 89 whole degrees."""
    hull = convex_hull(p)
    x, y = hull[:, :1], hull[:, 1:]
    u, v = x * _COS + y * _SIN, y * _COS - x * _SIN  # all angles at once
    u0, u1, v0, v1 = u.min(0), u.max(0), v.min(0), v.max(0)
    w, h = u1 - u0, v1 - v0
    k = int((w * h).argmin())
    c, s, mu, mv = _COS[k], _SIN[k], (u1[k] + u0[k]) / 2, (v1[k] + v0[k]) / 2
    return {"cx": float(mu * c - mv * s), "cy": float(mu * s + mv * c), "width": float(w[k]), "height": float(h[k]), "angle": float(k)}


def convexity_defects(p: np.ndarray) -> list[dict]:
    """Of each hull edge the contour point farthest from it, if over 1e-6."""
    hull, out = convex_hull(p), []
    for a, b in zip(hull, np.roll(hull, -1, 0), strict=True):
        d = b - a
        t = np.clip(((p - a) @ d) / max(d @ d, 1e-12), 0, 1)
        far = np.hypot(*(p - a - t[:, None] * d).T)
        k = int(far.argmax())
        if far[k] > 1e-6:
            out.append({"start_x": float(a[0]), "start_y": float(a[1]), "end_x": float(b[0]), "end_y": float(b[1]), "far_x": float(p[k][0]), "far_y": float(p[k][1]), "depth": float(far[k])})
    return out


POINTS = "array<struct<x:double,y:double>>"
RECT = "struct<cx:double,cy:double,width:double,height:double,angle:double>"
DEFECTS = "array<struct<start_x:double,start_y:double,end_x:double,end_y:double,far_x:double,far_y:double,depth:double>>"


def points_op(df: DataFrame, name: str, kind: str, kernel, **options) -> DataFrame:
    """``df`` with ``name``: ``kernel`` of each ``points`` array as an (n, 2) array."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    @F.pandas_udf(StructType().add("value", _parse_datatype_string(kind)))
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        out = []
        for q in zip(x, y, strict=True):
            value = kernel(np.array(q, float).T.reshape(-1, 2), **options)
            out.append([{"x": float(x), "y": float(y)} for x, y in value] if isinstance(value, np.ndarray) else value)
        return pd.DataFrame({"value": pd.Series(out, dtype=object)})

    # Two flat arrays a row: structs would come as one dictionary a point.
    return df.withColumn(name, run(F.col("points.x"), F.col("points.y"))["value"])
