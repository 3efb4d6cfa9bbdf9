"""Near-duplicate embeddings of equal label, by int8 tile products with rigorous error bounds.

Equal vectors of a label collapse to a class first. Classes are dealt into tiles of one label and of a bounded number of bytes; each pair
of tiles of a label is one cell of work, which holds two tiles, whatever the label's share of the rows. In a
cell unit vectors are quantised to int8; the product of the codes, exact in single precision, is off from the cosine by at most

    |u.v - u'.v'| <= |u - u'| |v| + |u'| |v - v'| <= e_u + (1 + e_u) e_v

with each vector's own measured error e. Only pairs whose estimate plus this bound reaches the threshold are computed again in double
precision. A cell reports no pairs: for each vector the number of vectors it links with and one root of the cell's
own components, at most one row a vector. Components over all cells follow from these rows by alternating stars.

All distinct vectors of a label are compared, so that the work of a label grows with the square of their number; each
tile travels once for every tile of its label.

Defined cases: a vector that is null, empty or zero or holds null or non-finite components, and a row without label, link with nothing and
stay; vectors of different lengths don't link; repeated rows and equal vectors link with each other; rows of null ids count as links, but name
no component unless all of it is null; an empty table gives an empty result; texts don't occur; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import bounded_batches, parts_of, spread_join, table_columns, written
from .components import connected_components

THRESHOLD = 0.93
#: Bytes of the vectors of one tile.
TILE_BYTES = 1 << 20
#: Rows of a tile multiplied at once.
STRIP = 256
#: Sums of products of int8 codes are exact in single precision up to this many components.
EXACT = 1024
#: Tasks that cells are dealt over at most.
MOST_TASKS = 65536
#: Rounding of the bounds and of the estimate, far above what double precision loses.
SLACK = 1e-9


class Tile:
    """Unit vectors with their int8 codes (as whole numbers in single precision), scales and errors."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, vectors: np.ndarray):
        self.ids, self.sizes = ids, sizes
        v = vectors.astype(float)
        v /= np.abs(v).max(1, keepdims=True)  # so that no square over- or underflows
        self.unit = v / np.sqrt((v**2).sum(1, keepdims=True))
        self.scale = np.abs(self.unit).max(1) / 127
        codes = np.rint(self.unit / self.scale[:, None])
        self.error = np.sqrt(((self.unit - codes * self.scale[:, None]) ** 2).sum(1)) + SLACK
        self.codes = codes.astype(np.int8).astype(np.float32)


def candidates(a: Tile, b: Tile, rows: slice, threshold: float) -> np.ndarray:
    """Which pairs of a strip of ``a`` with ``b`` may reach the threshold."""
    q = a.codes[rows]
    product = q[:, :EXACT] @ b.codes[:, :EXACT].T
    for at in range(EXACT, q.shape[1], EXACT):
        product = product.astype(float) + q[:, at : at + EXACT] @ b.codes[:, at : at + EXACT].T
    e = a.error[rows, None]
    bound = product * a.scale[rows, None] * b.scale + (1 + e) * b.error
    return bound >= threshold - SLACK - e


class Forest:
    """Components of links that come in blocks."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def _settle(self) -> None:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return
            self.parent = up

    def _root(self, i: int) -> int:
        while self.parent[i] != i:
            i = self.parent[i]
        return i

    def link(self, u: np.ndarray, v: np.ndarray) -> None:
        """First one link of each left node, then of each right node: few pairs of roots are left after these."""
        for pick in (0, 1, None):
            p, q = self.parent[u], self.parent[v]
            apart = p != q
            if not apart.any():
                return
            p, q = p[apart], q[apart]
            if pick is not None:
                first = np.unique((p, q)[pick], return_index=True)[1]
                p, q = p[first], q[first]
            else:
                p, q = np.unique(np.stack([p, q], 1), axis=0).T
            for i, j in zip(p.tolist(), q.tolist(), strict=True):
                i, j = self._root(i), self._root(j)
                self.parent[max(i, j)] = min(i, j)
            self._settle()


def cell_links(a: Tile, b: Tile, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of vectors with links in the cell, how many (copies counted), and a root of each; ``b is a`` for a tile with itself."""
    n, same = len(a.ids), b is a
    ids = a.ids if same else np.concatenate([a.ids, b.ids])
    links, forest, shift = np.zeros(len(ids), np.int64), Forest(len(ids)), 0 if same else n
    for at in range(0, n, STRIP):
        rows = slice(at, min(at + STRIP, n))
        maybe = candidates(a, b, rows, threshold)
        if same:
            maybe &= np.arange(len(b.ids))[None] > np.arange(rows.start, rows.stop)[:, None]
        i, j = np.nonzero(maybe)
        if not len(i):
            continue
        i += at
        if len(i) * 8 > maybe.size:  # dense: one product in double precision of the rows and columns with candidates
            r, c = np.unique(i), np.unique(j)
            cosine = (a.unit[r] @ b.unit[c].T)[np.searchsorted(r, i), np.searchsorted(c, j)]
        else:
            cosine = np.concatenate([np.einsum("ij,ij->i", a.unit[i[k : k + 65536]], b.unit[j[k : k + 65536]]) for k in range(0, len(i), 65536)])
        near = cosine >= threshold
        i, j = i[near], j[near]
        if not len(i):
            continue
        # Sums of whole numbers below 2^53 are exact in double precision.
        links += np.bincount(i, b.sizes[j], len(ids)).astype(np.int64) + np.bincount(j + shift, a.sizes[i], len(ids)).astype(np.int64)
        forest.link(i, j + shift)
    linked = np.flatnonzero(links)
    return ids[linked], links[linked], ids[forest.parent[linked]]


def _tiles(classes: DataFrame) -> DataFrame:
    """Tiles (label, dim, pid, seq, n, ids, sizes, data) of the classes (cls, label, vec, size): runs of rows sorted by label and length."""
    label = dict(classes.dtypes)["label"]
    float32 = isinstance(classes.schema["vec"].dataType.elementType, FloatType)
    kind = np.float32 if float32 else np.float64

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []  # of one label and length, under one tile
        rows, key, seq = 0, None, 0

        def tile() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            data = t.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind)
            values = [t.column("label")[0].as_py(), key[1], pid, seq, t.num_rows, t.column("cls").to_numpy().astype(np.int64).tobytes(), t.column("size").to_numpy().astype(np.int64).tobytes(), data.tobytes()]
            kinds = [t.schema.field("label").type, pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["label", "dim", "pid", "seq", "n", "ids", "sizes", "data"])

        for batch in batches:
            labels, dims = batch.column("label").to_pylist(), batch.column("dim").to_pylist()
            at = 0
            while at < batch.num_rows:
                now = (labels[at], dims[at])
                if held and (now != key or rows >= most):
                    yield tile()
                    seq = seq + 1 if now == key else 0
                    held, rows = [], 0
                elif now != key:
                    seq = 0
                key, most = now, max(STRIP, TILE_BYTES // (now[1] * kind().itemsize))
                end = at
                while end < batch.num_rows and end - at < most - rows and (labels[end], dims[end]) == now:
                    end += 1
                held.append(batch.slice(at, end - at))
                rows += end - at
                at = end
        if held:
            yield tile()

    sized = classes.select("cls", "label", F.size("vec").alias("dim"), "vec", "size")
    spread = F.xxhash64("cls")
    dealt = sized.repartitionByRange("label", "dim", spread).sortWithinPartitions("label", "dim", spread)
    return dealt.mapInArrow(pack, f"label {label}, dim int, pid int, seq long, n long, ids binary, sizes binary, data binary")


def tile_cells(tiles: DataFrame) -> tuple[DataFrame, int]:
    """Each tile once for every cell it is in, (a, b) with a <= b being the cell and ``no`` the tile's number in its label; the number of cells."""
    runs = tiles.groupBy("label", "dim", "pid").agg(F.count("*").alias("k"))
    of = Window.partitionBy("label", "dim")  # at most one row a partition
    runs = runs.select("label", "dim", "pid", F.coalesce(F.sum("k").over(of.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("k").over(of).alias("tiles"))
    cells = runs.groupBy("label", "dim").agg(F.max("tiles").alias("p")).agg(F.sum(F.col("p") * (F.col("p") + 1) / 2)).first()[0]
    placed = tiles.join(runs, ["label", "dim", "pid"]).withColumn("no", F.col("seq") + F.col("before"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    return met.select("label", "dim", F.least("no", "other").alias("a"), F.greatest("no", "other").alias("b"), "no", "ids", "sizes", "data"), int(cells or 0)


def _links(tiles: DataFrame, kind: type, threshold: float) -> DataFrame:
    """(cls, links, root) of every class with links, once for each cell that found some."""
    cells, n = tile_cells(tiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: Tile | None = None
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in ("dim", "a", "b", "no", "ids", "sizes", "data")}
                ids = np.frombuffer(row["ids"].as_buffer(), np.int64)
                tile = Tile(ids, np.frombuffer(row["sizes"].as_buffer(), np.int64), np.frombuffer(row["data"].as_buffer(), kind).reshape(len(ids), row["dim"].as_py()))
                a, b, no = (row[c].as_py() for c in ("a", "b", "no"))
                if no == a and a != b:
                    first = tile
                    continue
                found = cell_links(tile if a == b else first, tile, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["cls", "links", "root"])

    dealt = cells.repartition(min(max(2 * n, 1), MOST_TASKS), "label", "dim", "a", "b").sortWithinPartitions("label", "dim", "a", "b", "no")
    return dealt.select("dim", "a", "b", "no", "ids", "sizes", "data").mapInArrow(run, "cls long, links long, root long")


def embedding_near_dedup(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``df``: id, n_links (other vectors linked directly), component_id (the least id reachable), kept."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be over 0 and at most 1")
    table_columns(df, id_col, vec_col, label_col)
    bounded_batches(df.sparkSession)
    element = df.schema[vec_col].dataType.elementType if isinstance(df.schema[vec_col].dataType, ArrayType) else None
    v = F.col(f"`{vec_col}`").cast("array<float>" if isinstance(element, FloatType) else "array<double>")
    finite = F.size(v) > 0
    finite = finite & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    sound = F.coalesce(F.col(f"`{label_col}`").isNotNull() & finite, F.lit(False))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), v.alias("vec"), sound.alias("sound"))
    valid = rows.filter("sound").select("id", "label", F.transform("vec", lambda x: x + F.lit(0).cast("float")).alias("vec"))  # -0.0 is 0.0

    classes = valid.groupBy("label", "vec").agg(F.min("id").alias("least"), F.count("*").alias("size"), parts_of(F.col("id")))
    classes = written(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    tiles = written(_tiles(classes), "tiles")
    links = written(_links(tiles, np.float32 if isinstance(element, FloatType) else np.float64, threshold), "links")

    comp = connected_components(links.select(F.col("cls").alias("u"), F.col("root").alias("v"))).select(F.col("node").alias("cls"), "component")
    named = comp.join(classes.select("cls", "least"), "cls")
    heads = named.groupBy("component").agg(F.min("least").alias("head"), parts_of(F.col("cls")))
    headed = spread_join(named.select("cls", "component"), heads, ["component"], F.col("cls")).select("cls", "head")
    counted = links.groupBy("cls").agg(F.sum("links").alias("links"))
    facts = classes.join(counted, "cls", "left").join(headed, "cls", "left")
    key = F.sha2(F.array_join(F.col("vec").cast("array<string>"), ",").cast("binary"), 256)
    facts = facts.select("label", F.when(F.col("size") > 1, key).alias("sha"), "size", "parts", "least", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("head", "least").alias("component_id"))
    facts = written(facts, "facts")

    out = lambda d, i, n, c: d.select(i.alias(id_col), n.alias("n_links"), c.alias("component_id"), i.eqNullSafe(c).alias("kept"))
    found = lambda d, i: out(d, F.col(i), F.col("n_links"), F.col("component_id"))
    alone = found(facts.filter("size = 1"), "least")
    copies = found(spread_join(valid.select("id", "label", key.alias("sha")), facts.filter("size > 1").select("label", "sha", "parts", "n_links", "component_id"), ["label", "sha"], F.col("id")), "id")
    unsound = out(rows.filter("NOT sound"), F.col("id"), F.lit(0).cast("long"), F.col("id"))
    return alone.unionByName(copies).unionByName(unsound)
