"""Compression of vectors to one code a part, with codebooks learned in whole numbers.

Components become integers ``floor(SCALE * x)``, vectors are cut into equal consecutive parts, and each part position
has a codebook that starts as that part of the first vectors and is refined by rounds of assignment and means. All sums
and distances are whole numbers, so results don't depend on how rows are dealt.

A part's nearest entry is found coarse to fine. Cutting a part into blocks splits it into block means and what is left of them;
for a part x and an entry c ``|x-c|^2 >= sum of len * (mean_x - mean_c)^2 + (|rest_x| - |rest_c|)^2``, which is the squared distance
of two short vectors of scaled means and one residual norm. From blocks as long as the part to blocks of two, entries whose bound
(less a margin for rounding) is over the distance of the best entry known are dropped; the others are compared exactly in integers.

Codebooks and one row of sums for each part and entry are all that the driver sees, whatever the table's size. Tasks combine their
own rows' sums before anything is shuffled.

Defined cases: rows whose vector is null or empty, or holds null or non-finite components, are dropped, and so are rows whose vector is not as long as that of the
smallest kept id, or holds a component so large that a squared distance might not fit a long (|floor(1024 * x)| of 2^27 and more for 64 components);
a length that the parts don't divide is cut as evenly as can be; null ids come last; repeated rows are rows of their own; with fewer rows than
entries the codebooks are as short; an empty table gives an empty result; of equally near entries the first is taken; texts don't occur; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table_columns, written

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Vectors whose bounds are computed at once.
CHUNK = 256


def _largest(length: int) -> int:
    """Integers below this have squared distances of whole vectors that fit a long."""
    return math.isqrt(2**63 // max(length, 1)) // 2


def _blocks(width: int) -> list[list[tuple[int, int]]]:
    """Cuts of a part, coarse to fine: one block, then each block halved, down to blocks of two."""
    levels = [[(0, width)]]
    while max(b - a for a, b in levels[-1]) > 2:
        levels.append([cut for a, b in levels[-1] for cut in ((a, (a + b) // 2), ((a + b) // 2, b)) if cut[0] < cut[1]])
    return levels


def short_forms(x: np.ndarray) -> list[np.ndarray]:
    """Of each level the block means, scaled by the roots of the blocks' lengths, and the norm of what is left."""
    square = (x.astype(float) ** 2).sum(1)
    out = []
    for cuts in _blocks(x.shape[1]):
        means = np.stack([x[:, a:b].sum(1) / math.sqrt(b - a) for a, b in cuts], 1)
        rest = np.sqrt(np.maximum(square - (means**2).sum(1), 0))
        out.append(np.column_stack([means, rest]))
    return out


class Codebook:
    """Entries of one part position with their short forms."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        self.forms = short_forms(self.entries)
        self.squares = [(g**2).sum(1) for g in self.forms]
        self.norm = np.sqrt((self.entries.astype(float) ** 2).sum(1))
        self.small = self.entries.astype(float)
        self.most = np.abs(self.entries).max(initial=0)
        self.compared = self.possible = 0  # pairs compared exactly, pairs in all

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each row, the first of equals."""
        found = [self._nearest(x[i : i + CHUNK]) for i in range(0, len(x), CHUNK)]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _exact(self, x: np.ndarray, entries: np.ndarray, row: np.ndarray, entry: np.ndarray) -> np.ndarray:
        d = x.take(row, 0)
        d -= entries.take(entry, 0)
        return np.einsum("ij,ij->i", d, d).astype(np.int64)

    def _nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, every = len(x), np.arange(len(x))
        forms = short_forms(x)
        norm = np.sqrt((x.astype(float) ** 2).sum(1))
        entries = self.entries
        # Doubles hold these whole numbers, their differences, squares and sums exactly.
        if (max(np.abs(x).max(initial=0), self.most) * 2) ** 2 * max(x.shape[1], 1) < 2**52:
            x, entries = x.astype(float), self.small
        # A residual norm's square is off by a few units in the last place of the vector's, so a norm near zero by some 1e-8
        # of the vector's norm; a bound is then off by less than this.
        margin = 1e-7 * (norm[:, None] + self.norm[None]) ** 2 + 1e-6
        alive = np.ones(margin.shape, bool)
        best = None
        for f, g, squares in zip(forms, self.forms, self.squares, strict=True):
            bound = (f**2).sum(1)[:, None] + squares[None] - 2 * (f @ g.T) - margin
            bound[~alive] = np.inf
            found = self._exact(x, entries, every, bound.argmin(1))
            best = found if best is None else np.minimum(best, found)
            alive &= bound <= best[:, None]
            if alive.sum() == n:  # one entry a row
                break
        row, entry = np.nonzero(alive)
        d = self._exact(x, entries, row, entry)
        self.compared += len(row)
        self.possible += alive.size
        least = np.minimum.reduceat(d, np.searchsorted(row, every))  # each row keeps its best entry at least
        at = np.flatnonzero(d == least[row])
        return entry[at[np.searchsorted(row[at], every)]], least


def _edges(length: int, parts: int) -> list[int]:
    return [p * length // parts for p in range(parts + 1)]


def _kept(df: DataFrame, id_col: str, vec_col: str, carry: list[Column]) -> DataFrame:
    """Rows with whole vectors as arrays of longs; components that are no whole number fit to be one make the row go."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    sound = F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float(2**52 // SCALE)))), F.lit(False))
    whole = F.transform(v, lambda x: F.floor(x * F.lit(float(SCALE))).cast("long"))
    return df.filter(sound).select(F.col(f"`{id_col}`").alias("id"), whole.alias("v"), *carry)


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def fit_codebooks(kept: DataFrame, length: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks (entries x width) of each part position, from rows (id, v) of vectors of whole numbers."""
    edges = _edges(length, parts)
    first = kept.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(entries).collect()  # at most ``entries`` rows
    start = np.array([r["v"] for r in first], np.int64)
    books = [start[:, a:b] for a, b in zip(edges, edges[1:], strict=False)]
    width = max(b.shape[1] for b in books)
    names = [f"s{i}" for i in range(width)]

    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], books=books) -> Iterator[pa.RecordBatch]:
            coded = [Codebook(b) for b in books]
            total = np.zeros((parts, len(books[0]), width), object)
            count = np.zeros((parts, len(books[0])), np.int64)
            for batch in batches:
                x = _matrix(batch.column("v"), length)
                if not len(x):
                    continue
                for p, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    code = coded[p].nearest(x[:, a:b])[0]
                    order = np.argsort(code, kind="stable")
                    used, starts = np.unique(code[order], return_index=True)
                    total[p, used, : b - a] += np.add.reduceat(x[order, a:b], starts, 0).astype(object)
                    count[p] += np.bincount(code, minlength=len(books[0]))
            part, entry = np.nonzero(count)
            if len(part):
                columns = [pa.array([int(t) for t in total[part, entry, i]], pa.decimal128(38, 0)) for i in range(width)]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry], pa.int64()), *columns], names=["part", "entry", "n", *names])

        shape = "part int, entry int, n long, " + ", ".join(f"{s} decimal(38,0)" for s in names)
        met = kept.select("v").mapInArrow(sums, shape).groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in names])
        books = [b.copy() for b in books]
        for r in met.collect():  # at most parts x entries rows
            for i in range(books[r["part"]].shape[1]):
                books[r["part"]][r["entry"], i] = int(r[names[i]]) // r["n"]
    return books


def encode(kept: DataFrame, books: list[np.ndarray], length: int, carry: str) -> DataFrame:
    """``kept`` with ``code`` (an array of entry numbers in part order) and ``error`` in place of ``v``; ``carry`` is the schema of the rest."""
    edges = _edges(length, len(books))
    rest = [c for c in kept.columns if c != "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = [Codebook(b) for b in books]
        for batch in batches:
            x = _matrix(batch.column("v"), length)
            if not len(x):
                continue
            found = [book.nearest(x[:, a:b]) for book, a, b in zip(coded, edges, edges[1:], strict=False)]
            code = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) * len(books) + 1, len(books)), pa.int32()), pa.array(np.stack([f[0] for f in found], 1).ravel(), pa.int32()))
            error = pa.array(sum(f[1] for f in found), pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], code, error], names=[*rest, "code", "error"])

    return kept.select(*rest, "v").mapInArrow(run, f"{carry}, code array<int>, error long")


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for b in books for entry in b for x in entry).encode()).hexdigest()


def vector_codes(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row per kept vector: id, code (two hex digits a part), error, label_error, codebooks_sha256."""
    table_columns(df, id_col, vec_col, label_col)
    spark = df.sparkSession
    kinds = dict(df.dtypes)
    carry = f"id {kinds[id_col]}, label {kinds[label_col]}"
    kept = written(_kept(df, id_col, vec_col, [F.col(f"`{label_col}`").alias("label")]), "vectors")
    lead = kept.orderBy(F.col("id").asc_nulls_last(), "v").select(F.size("v").alias("n")).first()
    shape = f"{carry.replace('id ', f'`{id_col}` ', 1).split(', label ')[0]}, code string, error long, label_error long, codebooks_sha256 string"
    if lead is None:
        return spark.createDataFrame([], shape)
    length = lead["n"]
    fits = F.forall("v", lambda x: F.abs(x) < F.lit(_largest(length)))
    whole = kept.filter((F.size("v") == length) & fits)
    books = fit_codebooks(whole, length, parts, entries, rounds)
    if not len(books[0]):
        return spark.createDataFrame([], shape)
    coded = written(encode(whole, books, length, carry), "codes")
    hexed = F.array_join(F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    # One row a label, summed before the shuffle; a label may hold any share of the rows, which AQE's skew join splits or a small table makes a broadcast.
    labels = coded.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"))
    out = coded.join(labels, coded["label"].eqNullSafe(labels["of"]))
    return out.select(F.col("id").alias(id_col), hexed.alias("code"), "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
