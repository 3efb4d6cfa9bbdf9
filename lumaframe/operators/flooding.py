"""Watershed of images of any size: flooding within tiles, then spills between basins.

Water rises from the markers. Of all edges between a wet and a dry pixel (4 neighbours) the lowest is taken next, and the dry pixel gets the wet one's
label. An edge is as high as its higher end; equal edges are ordered by their lower end and then by their place. As that is a total order, the
result is the least spanning forest rooted at the markers and doesn't depend on where the work is done:

* A tile joins its own pixels by rising edges. A dry basin that doesn't reach the tile's border spills over its lowest edge whatever
  lies outside, so it is merged for good; edges that may still lose to one across the border are kept as candidates.
* What is left is a graph of basins at borders, far smaller than the image. In each round every basin without a marker spills over its lowest edge,
  basins that spill into each other become one, and edges inside go. Once an image's graph is small, the rest is one task's work.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DimensionMismatch, InvalidParameter
from ..sources.files import used_up, written
from . import graph


def flood(a: np.ndarray, markers: np.ndarray) -> np.ndarray:
    """The watershed of one plane in memory, edge by edge: labels of ``markers`` over 0 for all pixels that they reach."""
    h, w = a.shape
    if markers.shape != a.shape:
        raise DimensionMismatch("image and markers differ in size")
    if not (markers > 0).any():
        raise InvalidParameter("no markers")
    out, heap = np.where(markers > 0, markers, 0), []

    def wet(y: int, x: int) -> None:
        for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0)):
            v, u = y + dy, x + dx
            if 0 <= v < h and 0 <= u < w and not out[v, u]:
                first = (min(y, v) * w + min(x, u), int(dx == 0))
                heapq.heappush(heap, (max(a[y, x], a[v, u]), min(a[y, x], a[v, u]), *first, y, x, v, u))

    for y, x in zip(*np.nonzero(out), strict=True):
        wet(y, x)
    while heap:
        *_, y, x, v, u = heapq.heappop(heap)
        if not out[v, u]:
            out[v, u] = out[y, x]
            wet(v, u)
    return out


def _basins(a: np.ndarray, markers: np.ndarray, open_: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Of a stack of tiles (n, h, w): each pixel's basin (named by the first pixel's place, from 1), candidate edges between basins, and the labels of wet basins,
    the last two with the number of their ``tile``.

    ``open_`` says at which sides (top, bottom, left, right) of each tile the image goes on.
    """
    m, h, w = a.shape
    n = h * w
    flat, place = a.reshape(m, n), place.reshape(m, n)
    edge = np.zeros((m, h, w), bool)
    edge[:, 0] |= open_[:, 0, None]
    edge[:, -1] |= open_[:, 1, None]
    edge[:, :, 0] |= open_[:, 2, None]
    edge[:, :, -1] |= open_[:, 3, None]
    i = np.arange(n).reshape(h, w)
    p = np.concatenate([i[:, :-1].ravel(), i[:-1].ravel()])
    q = np.concatenate([i[:, 1:].ravel(), i[1:].ravel()])
    down = np.concatenate([np.zeros(h * (w - 1), int), np.ones((h - 1) * w, int)])
    high, low = np.maximum(flat[:, p], flat[:, q]), np.minimum(flat[:, p], flat[:, q])
    order = np.lexsort((np.broadcast_to(down, high.shape), place[:, p], low, high))
    names, found = np.empty((m, n), np.int64), ([], [])
    p_at, q_at = p.tolist(), q.tolist()

    def root(up: list[int], k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    for tile in range(m):
        open_now, label = edge[tile].ravel().tolist(), markers[tile].ravel().tolist()
        joined, settled = list(range(n)), list(range(n))  # by accepted edges, and by those that hold for good
        for k in order[tile].tolist():
            s, t = p_at[k], q_at[k]
            u, v = root(joined, s), root(joined, t)
            if u == v or (label[u] > 0 and label[v] > 0):
                continue
            sure = (not open_now[u] and label[u] <= 0) or (not open_now[v] and label[v] <= 0)
            low_root, high_root = min(u, v), max(u, v)
            joined[high_root] = low_root
            open_now[low_root] = open_now[u] or open_now[v]
            label[low_root] = max(label[u], label[v])
            if sure:
                x, y = root(settled, s), root(settled, t)
                settled[max(x, y)] = min(x, y)
            else:
                found[0].append(tile)
                found[1].append(k)
        names[tile] = [root(settled, k) for k in range(n)]
    named = np.take_along_axis(place, names, 1) + 1
    tile, k = (np.array(f, np.int64) for f in found)
    edges = {"tile": tile, "u": named[tile, p[k]], "v": named[tile, q[k]], "high": high[tile, k], "low": low[tile, k], "place": place[tile, p[k]], "down": down[k].astype(np.int32)}
    tile, k = np.nonzero(markers.reshape(m, n) > 0)
    return named.reshape(m, h, w), edges, {"tile": tile, "node": named[tile, k], "label": markers.reshape(m, n)[tile, k].astype(np.int64)}


#: An image with at most so many edges between basins left is finished in one task.
FINISH = 100_000
_EDGE = "struct<u:long,v:long,high:double,low:double,place:long,down:int>"
_TILE = f"struct<names:array<long>,edges:array<{_EDGE}>,wet:array<struct<node:long,label:long>>,top:array<struct<n:long,v:double>>,bottom:array<struct<n:long,v:double,p:long>>,left:array<struct<n:long,v:double>>,right:array<struct<n:long,v:double,p:long>>>"


#: Pixels of tiles that are flooded together.
AT_ONCE = 1 << 16


def _listed(n: int, parts: list[dict[str, np.ndarray]]) -> pa.Array:
    """A list of structs for each of ``n`` rows, from columns of which "tile" tells the row."""
    columns = {c: np.concatenate([e[c] for e in parts]) for c in parts[0]}
    rows = columns.pop("tile")
    order = np.argsort(rows, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(v[order]) for v in columns.values()], names=list(columns)))


def _tile_basins() -> Column:
    @F.arrow_udf(_TILE)
    def run(c: pa.Array, h: pa.Array, w: pa.Array, ty: pa.Array, tx: pa.Array, side: pa.Array, data: pa.Array) -> pa.Array:
        c, h, w, ty, tx, side = (v.to_numpy(zero_copy_only=False).astype(np.int64) for v in (c, h, w, ty, tx, side))
        first, values = data.offsets.to_numpy(), data.values.to_numpy(zero_copy_only=False)
        th, tw = np.minimum(side, h - ty * side), np.minimum(side, w - tx * side)
        places, parts = [], {k: [] for k in ("edges", "wet", "top", "bottom", "left", "right")}
        for k, m, n in sorted(set(zip(c.tolist(), th.tolist(), tw.tolist(), strict=True))):
            alike, step = np.flatnonzero((c == k) & (th == m) & (tw == n)), max(1, AT_ONCE // (m * n))
            for at in (alike[j : j + step] for j in range(0, len(alike), step)):
                planes = values[first[at][:, None] + np.arange(2 * m * n)].astype(float).reshape(len(at), 2, m, n)
                y, x = (ty * side)[at, None, None] + np.arange(m)[:, None], (tx * side)[at, None, None] + np.arange(n)
                place = y * w[at, None, None] + x
                open_ = np.stack([ty > 0, (ty + 1) * side < h, tx > 0, (tx + 1) * side < w], 1)[at]
                names, edges, wet = _basins(planes[:, 0], planes[:, 1].astype(np.int64), open_, place)
                parts["edges"].append(edges | {"tile": at[edges["tile"]]})
                parts["wet"].append(wet | {"tile": at[wet["tile"]]})
                places.append({"tile": np.repeat(at, m * n), "n": names.ravel()})
                for name, cut in (("top", np.s_[:, 0]), ("bottom", np.s_[:, -1]), ("left", np.s_[:, :, 0]), ("right", np.s_[:, :, -1])):
                    border = {"tile": np.repeat(at, names[cut].shape[1]), "n": names[cut].ravel(), "v": planes[:, 0][cut].ravel()}
                    parts[name].append(border | ({"p": place[cut].ravel()} if name in ("bottom", "right") else {}))
        if not places:
            from pyspark.sql.pandas.types import to_arrow_type
            from pyspark.sql.types import _parse_datatype_string

            return pa.array([], to_arrow_type(_parse_datatype_string(_TILE)))
        lists = _listed(len(c), places)
        lists = [pa.ListArray.from_arrays(lists.offsets, lists.values.field("n")), *[_listed(len(c), p) for p in parts.values()]]
        return pa.StructArray.from_arrays(lists, names=["names", *parts])

    return run("c", "h", "w", "ty", "tx", "side", "data")


def _across(local: DataFrame) -> DataFrame:
    """Edges between pixels of neighbouring tiles; a border travels as one row."""

    def met(first: DataFrame, second: DataFrame, down: int) -> DataFrame:
        pairs = first.join(second, ["image_id", "ty", "tx"]).select("image_id", F.explode(F.arrays_zip("a", "b")).alias("e"))
        a, b = F.col("e.a"), F.col("e.b")
        return pairs.select("image_id", a["n"].alias("u"), b["n"].alias("v"), F.greatest(a["v"], b["v"]).alias("high"), F.least(a["v"], b["v"]).alias("low"), a["p"].alias("place"), F.lit(down).alias("down"))

    below = met(local.select("image_id", "ty", "tx", F.col("l.bottom").alias("a")), local.select("image_id", (F.col("ty") - 1).alias("ty"), "tx", F.col("l.top").alias("b")), 1)
    beside = met(local.select("image_id", "ty", "tx", F.col("l.right").alias("a")), local.select("image_id", "ty", (F.col("tx") - 1).alias("tx"), F.col("l.left").alias("b")), 0)
    return below.unionByName(beside)


_KEY = ("high", "low", "place", "down")


def _lowest(edges: DataFrame) -> DataFrame:
    """The lowest edge between each two basins."""
    ends = edges.filter("u <> v").select("image_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.struct(*_KEY).alias("key"))
    return ends.groupBy("image_id", "u", "v").agg(F.min("key").alias("key")).select("image_id", "u", "v", *[F.col(f"key.{k}").alias(k) for k in _KEY])


def risen(edges: pd.DataFrame) -> pd.DataFrame:
    """(image_id, basin, label) of the basins that water reaches along ``edges`` (image_id, u, v, key, and labels ul and vl) of whole images, all at once: they share no basin."""
    edges = edges.sort_values(list(_KEY))
    n, image = len(edges), pd.factorize(edges["image_id"])
    names, rank = np.unique(np.concatenate([edges["u"], edges["v"]]), return_inverse=True)
    codes, at = np.unique(np.concatenate([image[0], image[0]]) * np.int64(len(names)) + rank, return_inverse=True)
    up, label = list(range(len(codes))), [0] * len(codes)
    for ends, labels in ((at[:n], edges["ul"]), (at[n:], edges["vl"])):
        for i, v in zip(ends.tolist(), labels.fillna(0).astype(np.int64).tolist(), strict=True):
            label[i] = max(label[i], v)

    def root(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    for i, j in zip(at[:n].tolist(), at[n:].tolist(), strict=True):
        i, j = root(i), root(j)
        if i != j and not (label[i] and label[j]):
            up[j], label[i] = i, label[i] or label[j]
    found = np.array([label[root(k)] for k in range(len(codes))], np.int64)
    wet = codes[found > 0]
    return pd.DataFrame({"image_id": np.asarray(image[1])[wet // len(names)], "basin": names[wet % len(names)], "label": found[found > 0]})


def _finish(e: DataFrame, state: DataFrame) -> DataFrame:
    """(image_id, basin, label) of basins that water reaches, for images whose graph is small: rising edges, the images of a batch at once."""
    known = state.filter("label IS NOT NULL")
    both = e.join(known.select("image_id", F.col("basin").alias("u"), F.col("label").alias("ul")), ["image_id", "u"], "left").join(known.select("image_id", F.col("basin").alias("v"), F.col("label").alias("vl")), ["image_id", "v"], "left")

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # of the last image, which may go on
        for pdf in pdfs:
            last = pdf["image_id"].to_numpy().searchsorted(pdf["image_id"].iloc[-1]) if len(pdf) else 0
            if held and len(pdf) and (last or held[-1]["image_id"].iloc[-1] != pdf["image_id"].iloc[0]):
                yield risen(pd.concat([*held, pdf.iloc[:last]]))
                held = []
            elif last:
                yield risen(pdf.iloc[:last])
            if len(pdf):
                held.append(pdf.iloc[last:])
        if held:
            yield risen(pd.concat(held))

    # A number of partitions: by their bytes they would be put together to few tasks.
    dealt = both.repartition(int(e.sparkSession.conf.get("spark.sql.shuffle.partitions")), "image_id").sortWithinPartitions("image_id")
    reached = dealt.mapInPandas(run, "image_id long, basin long, label long")
    return reached.union(known.select("image_id", "basin", "label")).distinct()  # basins without any edge too


def spill(edges: DataFrame, wet: DataFrame) -> DataFrame:
    """(image_id, node, label) of all basins that water reaches: ``edges`` (image_id, u, v, high, low, place, down), ``wet`` (image_id, node, label).

    Rounds go on while any image has more than ``FINISH`` edges between its basins; with fewer an image is one task's work.
    """
    wet = wet.groupBy("image_id", "node").agg(F.max("label").alias("label"))  # one label a basin
    e = written(_lowest(edges), "spills")
    nodes = e.select("image_id", F.col("u").alias("node")).union(e.select("image_id", F.col("v").alias("node"))).union(wet.select("image_id", "node")).distinct()
    now = written(nodes.withColumn("basin", F.col("node")).join(wet, ["image_id", "node"], "left"), "basins")
    while True:
        state = now.groupBy("image_id", F.col("basin")).agg(F.max("label").alias("label"))
        if not e.groupBy("image_id").count().filter(F.col("count") > FINISH).limit(1).count():
            break
        at = lambda end, state=state: state.select("image_id", F.col("basin").alias(end), F.col("label").alias(f"{end}_label"))
        told = e.join(at("u"), ["image_id", "u"]).join(at("v"), ["image_id", "v"]).filter("u_label IS NULL OR v_label IS NULL")
        ways = told.filter("u_label IS NULL").select("image_id", F.col("u").alias("c"), F.struct(*_KEY, F.col("v").alias("to")).alias("way"))
        ways = ways.union(told.filter("v_label IS NULL").select("image_id", F.col("v").alias("c"), F.struct(*_KEY, F.col("u").alias("to")).alias("way")))
        taken = written(ways.groupBy("image_id", "c").agg(F.min("way").alias("way")).select("image_id", F.col("c").alias("u"), F.col("way.to").alias("v")), "ways")
        if not taken.limit(1).count():
            break
        one = graph.components(taken).select("image_id", F.col("node").alias("basin"), F.col("root").alias("into"))
        merged = now.join(one, ["image_id", "basin"], "left").withColumn("basin", F.coalesce("into", "basin")).select("image_id", "node", "basin", "label")
        # Basins that became one have one label at most between them.
        label = merged.groupBy("image_id", "basin").agg(F.max("label").alias("label"))
        new = written(merged.drop("label").join(label, ["image_id", "basin"]).select("image_id", "node", "basin", "label"), "basins")
        renamed = lambda end, one=one: one.select("image_id", F.col("basin").alias(end), F.col("into").alias(f"{end}_into"))
        moved = told.join(renamed("u"), ["image_id", "u"], "left").join(renamed("v"), ["image_id", "v"], "left")
        moved = written(_lowest(moved.select("image_id", F.coalesce("u_into", "u").alias("u"), F.coalesce("v_into", "v").alias("v"), *_KEY)), "spills")
        for old in (e, now, taken):
            used_up(old)
        e, now = moved, new
    reached = _finish(e, state)
    return now.select("image_id", "node", "basin").join(reached, ["image_id", "basin"]).select("image_id", "node", "label")


def watershed_tiles(tiles: DataFrame) -> DataFrame:
    """Tiles of labels for tiles of two channels, the image and its markers (labels over 0); pixels that no water reaches are 0."""
    local = written(tiles.select("image_id", "h", "w", "ty", "tx", "side", _tile_basins().alias("l")), "floods")
    inside = local.select("image_id", F.explode("l.edges").alias("e")).select("image_id", "e.*")
    wet = local.select("image_id", F.explode("l.wet").alias("m")).select("image_id", "m.node", "m.label")
    labels = spill(inside.unionByName(_across(local)), wet)
    held = local.select("image_id", "ty", "tx", F.explode(F.array_distinct("l.names")).alias("node"))
    told = held.join(labels, ["image_id", "node"]).groupBy("image_id", "ty", "tx").agg(F.map_from_entries(F.collect_list(F.struct("node", "label"))).alias("labels"))

    @F.pandas_udf("array<double>")
    def painted(names: pd.Series, known: pd.Series, labels_: pd.Series) -> pd.Series:
        out = []
        for name, keys, values in zip(names, known, labels_, strict=True):
            if keys is None or not len(keys):
                out.append(np.zeros(len(name)))
                continue
            keys, values = np.asarray(keys, np.int64), np.asarray(values, float)
            order = np.argsort(keys)
            at = np.minimum(np.searchsorted(keys[order], name), len(keys) - 1)
            out.append(np.where(keys[order][at] == name, values[order][at], 0.0))
        return pd.Series(out)

    full = local.join(told, ["image_id", "ty", "tx"], "left")
    return full.select("image_id", F.lit(1).alias("c"), "h", "w", "ty", "tx", "side", painted("l.names", F.map_keys("labels"), F.map_values("labels")).alias("data"))
