"""Nearest neighbours by pivots: exact, with pairs of blocks left out by the triangle inequality.

Pivots are rows of the training side. Both sides are dealt to the cell of their nearest pivot, sorted by the distance to it and packed into
blocks, so that a block of a cell is a shell around its pivot. A query first meets the innermost block of its own cell, which
gives a distance ``b`` that its nearest row can't exceed. A row t of the shell [low, high] around pivot p is at least
``d(q, p) - high``, ``low - d(q, p)`` and, as p is t's nearest pivot, ``(d(q, p) - d(q, own pivot)) / 2`` away, and no nearer than the box around
the shell's rows. Only queries for which all four are at most b go to a cell: they are sent there by themselves, put together to packs of ``BLOCK``, and meet its shells
in a second join. A query that more than ``FEW_CELLS`` cells may answer is sent to none of them: such queries meet all shells in a grid of tasks, each of which holds a
bounded group of shells, so that what is sent grows with the rows and not with the number of cells. A cell may hold any share of the rows: it is then many blocks. Only the pivots and the boxes of their cells, of bounded number and size, reach the
driver and all tasks. The box matters for queries far outside of the rows, whose distances to all pivots are about the same.

Vectors of many independent directions lie at about the same distance from each other, and then few pairs of blocks can be left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import DimensionMismatch, InvalidParameter
from ..sources.files import written

#: Rows of a block, pivots, and bytes of all pivots at most.
BLOCK, MOST_PIVOTS, PIVOT_BYTES = 2048, 1024, 4 << 20
#: Cells that a query is sent to at most, and bytes of shells that one task holds for the others.
FEW_CELLS, HELD = 16, 32 << 20
#: Relative rounding of the bounds and of distances by matrix products.
SLACK = 1e-9


def _vectors(df: DataFrame, idx: str, vec: str) -> DataFrame:
    """Rows with whole finite vectors."""
    v = F.col(vec).cast("array<double>")
    whole = F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))), F.lit(False))
    return df.filter(whole & F.col(idx).isNotNull()).select(F.col(idx).cast("long").alias("i"), v.alias("v"))


def choose_pivots(rows: DataFrame, n: int) -> np.ndarray:
    """At most ``n`` different vectors of ``rows``: those of the least hashes of their numbers."""
    picked = rows.orderBy(F.xxhash64("i"), "i").limit(n).select("v").collect()
    if len({len(r["v"]) for r in picked}) > 1:
        raise DimensionMismatch("all vectors need one length")
    return np.unique(np.array([r["v"] for r in picked], float), axis=0)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x @ y.T, 0))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(column) * d:
        raise DimensionMismatch("all vectors need one length")
    return flat.reshape(-1, d)


def _blocks(rows: DataFrame, pivots: np.ndarray, name: str, size: int) -> DataFrame:
    """Blocks (block, cell, low, high, n, ids, data, box) of rows of one cell, in order of their distance from its pivot; a box is each component's least, then largest number."""
    d = pivots.shape[1]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("v"), d)
            away = distances(x, pivots)
            cell = away.argmin(1)
            exact = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([b.column("i"), b.column("v"), pa.array(cell, pa.int32()), pa.array(exact)], names=["i", "v", "cell", "away"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, held, rows, seq = TaskContext.get().partitionId(), [], 0, 0

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            away = t.column("away").to_numpy()
            x = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            values = [(pid << 33) + seq, t.column("cell")[0].as_py(), away.min(), away.max(), t.num_rows, t.column("i").to_numpy().astype(np.int64).tobytes(), x.tobytes(), np.concatenate([x.min(0), x.max(0)])]
            kinds = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["block", "cell", "low", "high", "n", "ids", "data", "box"])

        for b in batches:
            cells, at = b.column("cell").to_numpy(), 0
            while at < b.num_rows:
                if held and (held[0].column("cell")[0].as_py() != cells[at] or rows >= size):
                    yield block()
                    held, rows, seq = [], 0, seq + 1
                end = min(int(np.searchsorted(cells, cells[at], "right")), at + size - rows)
                held.append(b.slice(at, end - at))
                rows, at = rows + end - at, end
        if held:
            yield block()

    dealt = rows.mapInArrow(deal, "i long, v array<double>, cell int, away double")
    ordered = dealt.repartitionByRange("cell", "away", "i").sortWithinPartitions("cell", "away", "i")
    return written(ordered.mapInArrow(pack, "block long, cell int, low double, high double, n long, ids binary, data binary, box array<double>"), name)


def _nearest(q: np.ndarray, t: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and distance of the nearest row of ``t``, the smallest number of equals; rows near the least product are measured by differences."""
    square = (q**2).sum(1)[:, None] + (t**2).sum(1)[None]
    d2 = square - 2 * q @ t.T
    row, col = np.nonzero(d2 <= d2.min(1, keepdims=True) + SLACK * square.max(initial=0))
    exact = np.concatenate([np.sqrt(((q[row[k : k + 65536]] - t[col[k : k + 65536]]) ** 2).sum(1)) for k in range(0, len(row), 65536)])
    order = np.lexsort((ids[col], exact, row))
    first = order[np.searchsorted(row[order], np.arange(len(q)))]
    return ids[col[first]], exact[first]


def _margin(away: np.ndarray) -> np.ndarray:
    """Rounding of distances by matrix products: the root of what may be lost of a square."""
    return 1e-6 * (1 + away)


def _outside(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Distance of each row of ``q`` from a box, or from the box of the same row."""
    return np.sqrt((np.maximum(np.maximum(low - q, q - high), 0) ** 2).sum(1))


#: Queries that go to one cell, as bytes.
_ASKED = "cell int, block long, n long, least double, most double, ids binary, data binary, limit binary"


def _packed(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of one cell (sorted) put together until they have ``size`` queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def pack() -> pa.RecordBatch:
            first = {"cell": held[0]["cell"], "block": held[0]["block"], "n": sum(r["n"] for r in held), "least": min(r["least"] for r in held), "most": max(r["most"] for r in held)}
            joined = {c: b"".join(r[c] for r in held) for c in ("ids", "data", "limit")}
            return pa.RecordBatch.from_pylist([first | joined], pa.schema([("cell", pa.int32()), ("block", pa.int64()), ("n", pa.int64()), ("least", pa.float64()), ("most", pa.float64()), *[(c, pa.binary()) for c in joined]]))

        for b in batches:
            for k in range(b.num_rows):
                row = {c: b.column(c)[k].as_py() for c in b.schema.names}
                if held and (held[0]["cell"] != row["cell"] or sum(r["n"] for r in held) + row["n"] > size):
                    yield pack()
                    held = []
                held.append(row)
        if held:
            yield pack()

    return run


def _array(value: pa.Scalar, d: int | None = None, kind: type = float) -> np.ndarray:
    flat = np.frombuffer(value.as_buffer(), kind)
    return flat if d is None else flat.reshape(-1, d)


class PivotSearch:
    """Nearest rows of ``train`` (idx, vec) for each of ``query``; ``blocks``, ``shells`` and ``pairs`` show what was compared.

    Rows whose vector is null, empty or not finite, or whose number is null, take no part; vectors of different lengths raise.
    """

    def __init__(self, query: DataFrame, train: DataFrame, idx: str = "idx", vec: str = "vec", block: int = BLOCK, pivots: int | None = None):
        if block < 1 or pivots is not None and pivots < 1:
            raise InvalidParameter("blocks and pivots are counted from one")
        self.spark, self.size = query.sparkSession, block
        q, t = _vectors(query, idx, vec), _vectors(train, idx, vec)
        size = t.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
        self.empty = not size["n"]
        if self.empty:
            return
        most = max(1, min(MOST_PIVOTS, PIVOT_BYTES // (8 * size["d"])))
        self.pivots = choose_pivots(t, min(most, pivots or math.ceil(math.sqrt(size["n"]))))
        self.shells = _blocks(t, self.pivots, "shells", block)
        self.blocks = written(self._first_meeting(_blocks(q, self.pivots, "queries", block)), "first")
        self.asked = written(self._asked(), "asked")
        wide = self.asked.filter("cell < 0").select("pack")
        self.pairs = self._met().select("pack", "shell").unionByName(wide.crossJoin(self.shells.select(F.col("block").alias("shell"))))

    def _first_meeting(self, blocks: DataFrame) -> DataFrame:
        """Query blocks with the nearest row in the innermost block of their cell, which holds the pivot, and its distance as ``limit``."""
        d = self.pivots.shape[1]
        inner = self.shells.groupBy("cell").agg(F.min(F.struct("low", "block")).alias("m")).select("cell", F.col("m.block").alias("block"))  # one row a pivot
        inner = self.shells.drop("cell").join(inner, "block").select("cell", F.col("ids").alias("t_ids"), F.col("data").alias("t_data"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [_nearest(_array(q, d), _array(t, d), _array(i, kind=np.int64)) for q, t, i in zip(b.column("data"), b.column("t_data"), b.column("t_ids"), strict=True)]
                near = [pa.array([f[k].tobytes() for f in found], pa.binary()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("block", "cell", "ids", "data")], *near], names=["block", "cell", "ids", "data", "near", "limit"])

        return blocks.select("block", "cell", "ids", "data").join(inner, "cell").mapInArrow(run, "block long, cell int, ids binary, data binary, near binary, limit binary")

    def _asked(self) -> DataFrame:
        """Packs of the queries for which a cell can hold a row as near as the first found."""
        pivots = self.pivots
        d, k = pivots.shape[1], len(pivots)
        ends = {r["cell"]: r for r in self.shells.groupBy("cell").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()}  # one row a pivot
        low = np.array([ends[c]["low"] if c in ends else np.inf for c in range(k)])
        high = np.array([ends[c]["high"] if c in ends else -np.inf for c in range(k)])
        sides = self.shells.select("cell", F.posexplode("box").alias("at", "v")).groupBy("cell", "at").agg(F.min("v").alias("low"), F.max("v").alias("high")).toArrow()  # as large as the pivots
        cell, at = (sides.column(c).to_numpy() for c in ("cell", "at"))
        bottom, top = np.full((k, 2 * d), np.inf), np.full((k, 2 * d), -np.inf)
        bottom[cell, at], top[cell, at] = sides.column("low").to_numpy(), sides.column("high").to_numpy()
        bottom, top = bottom[:, :d].copy(), top[:, d:].copy()

        def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in range(b.num_rows):
                    q, ids, limit = _array(b.column("data")[row], d), _array(b.column("ids")[row], kind=np.int64), _array(b.column("limit")[row])
                    away = distances(q, pivots)
                    far = limit[:, None] + _margin(away)
                    need = ((away - away.min(1, keepdims=True)) / 2 <= far) & (away - far <= high) & (away + far >= low)
                    for c in np.flatnonzero(need.any(0)):
                        asks = np.flatnonzero(need[:, c])
                        need[asks, c] = _outside(q[asks], bottom[c], top[c]) <= limit[asks] + _margin(limit[asks])
                    wide = need.sum(1) > FEW_CELLS
                    need[wide] = False
                    for c in [-1, *np.flatnonzero(need.any(0))]:  # -1 stands for all cells
                        asks = np.flatnonzero(wide if c < 0 else need[:, c])
                        if len(asks):
                            values = [c, b.column("block")[row].as_py(), len(asks), (away - far)[asks, c].min(), (away + far)[asks, c].max(), ids[asks].tobytes(), q[asks].tobytes(), limit[asks].tobytes()]
                            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]
                            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=[c.split()[0] for c in _ASKED.split(", ")])

        asked = self.blocks.select("block", "data", "ids", "limit").mapInArrow(bounds, _ASKED)
        # A cell that many ask is dealt over several tasks.
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return asked.repartition(parts, "cell", F.pmod(F.hash("block"), F.lit(16))).sortWithinPartitions("cell").mapInArrow(_packed(self.size), _ASKED).withColumn("pack", F.monotonically_increasing_id())

    def _met(self) -> DataFrame:
        """Packs with the shells of their cell that are within reach; a wide pack has no cell here."""
        shells = self.shells.select(F.col("block").alias("shell"), "cell", "low", "high", "box", F.col("ids").alias("t_ids"), F.col("data").alias("t_data"))
        return self.asked.join(shells, "cell").filter("low <= most AND high >= least")

    def _second_meeting(self) -> DataFrame:
        pivots = self.pivots
        d = pivots.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in range(b.num_rows):
                    at = {c: b.column(c)[row] for c in b.schema.names}
                    q, ids, near = _array(at["data"], d), _array(at["ids"], kind=np.int64), _array(at["limit"])
                    there = np.sqrt(((q - pivots[at["cell"].as_py()]) ** 2).sum(1))
                    limit, (bottom, top) = near + _margin(there), np.array(at["box"].as_py()).reshape(2, d)
                    may = (there - limit <= at["high"].as_py()) & (there + limit >= at["low"].as_py()) & (_outside(q, bottom, top) <= near + _margin(near))
                    if may.any():
                        found, distance = _nearest(q[may], _array(at["t_data"], d), _array(at["t_ids"], kind=np.int64))
                        yield pa.RecordBatch.from_arrays([pa.array(ids[may]), pa.array(found), pa.array(distance)], names=["query_idx", "train_idx", "distance"])

        return self._met().select("cell", "low", "high", "box", "ids", "data", "limit", "t_ids", "t_data").mapInArrow(run, "query_idx long, train_idx long, distance double")

    def _wide_meeting(self) -> DataFrame | None:
        """Queries that many cells may answer with all shells: groups of queries go to each group of shells, which comes before them in a sorted stream."""
        pivots, wide = self.pivots, self.asked.filter("cell < 0")
        d, packs = pivots.shape[1], wide.count()
        if not packs:
            return None
        blocks, rows = self.shells.agg(F.count("*"), F.sum("n")).first()
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        columns = min(blocks, max(math.ceil(rows * 8 * (d + 1) / HELD), math.ceil(math.sqrt(2 * parts))))
        lines = min(packs, math.ceil(2 * parts / columns))
        part, every = (lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")), (lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        held = self.shells.select("cell", "low", "high", "box", "ids", "data", every(lines).alias("line"), part("block", columns).alias("column"))
        asks = wide.select("ids", "data", "limit", part("pack", lines).alias("line"), every(columns).alias("column"))
        for name, kind in (("cell", "int"), ("low", "double"), ("high", "double"), ("box", "array<double>")):
            asks = asks.withColumn(name, F.lit(None).cast(kind))
        both = held.withColumn("limit", F.lit(None).cast("binary")).unionByName(asks).withColumn("task", F.col("line") * columns + F.col("column"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, shells = None, []
            for b in batches:
                for row in range(b.num_rows):
                    at = {c: b.column(c)[row] for c in b.schema.names}
                    ids, x = _array(at["ids"], kind=np.int64), _array(at["data"], d)
                    if at["task"].as_py() != now:
                        now, shells = at["task"].as_py(), []
                    if at["cell"].is_valid:
                        shells.append((pivots[at["cell"].as_py()], at["low"].as_py(), at["high"].as_py(), *np.array(at["box"].as_py()).reshape(2, d), ids, x))
                        continue
                    limit, found = _array(at["limit"]).copy(), np.full(len(ids), np.iinfo(np.int64).max)
                    for pivot, low, high, bottom, top, numbers, rows in shells:
                        there = np.sqrt(((x - pivot) ** 2).sum(1))
                        far = limit + _margin(there)
                        may = np.flatnonzero((there - far <= high) & (there + far >= low) & (_outside(x, bottom, top) <= limit + _margin(limit)))
                        if len(may):
                            number, distance = _nearest(x[may], rows, numbers)
                            nearer = (distance < limit[may]) | ((distance == limit[may]) & (number < found[may]))
                            limit[may[nearer]], found[may[nearer]] = distance[nearer], number[nearer]
                    got = found < np.iinfo(np.int64).max
                    yield pa.RecordBatch.from_arrays([pa.array(ids[got]), pa.array(found[got]), pa.array(limit[got])], names=["query_idx", "train_idx", "distance"])

        dealt = both.repartitionById(min(parts, lines * columns), F.col("task") % min(parts, lines * columns)).sortWithinPartitions("task", F.col("cell").asc_nulls_last())
        return dealt.select("task", "cell", "low", "high", "box", "ids", "data", "limit").mapInArrow(run, "query_idx long, train_idx long, distance double")

    def matches(self) -> DataFrame:
        """(query_idx, train_idx, distance): nearest row by Euclidean distance, the one of the smallest number of equals."""
        shape = "query_idx long, train_idx long, distance double"
        if self.empty:
            return self.spark.createDataFrame([], shape)

        def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i, near, limit in zip(b.column("ids"), b.column("near"), b.column("limit"), strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array(_array(i, kind=np.int64)), pa.array(_array(near, kind=np.int64)), pa.array(_array(limit))], names=["query_idx", "train_idx", "distance"])

        found = self.blocks.select("ids", "near", "limit").mapInArrow(flat, shape).unionByName(self._second_meeting())
        wide = self._wide_meeting()
        found = found if wide is None else found.unionByName(wide)
        return found.groupBy("query_idx").agg(F.min(F.struct("distance", "train_idx")).alias("m")).select("query_idx", F.col("m.train_idx").alias("train_idx"), F.col("m.distance").alias("distance"))


def pivot_matches(query: DataFrame, train: DataFrame, idx: str = "idx", vec: str = "vec", **options) -> DataFrame:
    """As :func:`.matching.match_descriptors`, by :class:`PivotSearch`."""
    return PivotSearch(query, train, idx, vec, **options).matches()
