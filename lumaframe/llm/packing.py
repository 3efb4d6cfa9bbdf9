"""Best-fit packing of tokenised documents by hierarchical residual packing.

Each partition packs its own pieces best-fit decreasing. Bins that are nearly
full are final; underfull bins become items of the next round, where groups of
partitions are merged and packed best-fit again, up a tree, until one group is
left or no bin is small enough to be merged. Only bin fills travel up the tree,
never texts or token ids.

After a round a group holds at most one bin of half the capacity or less (two
such bins would have been put together), so what can still be improved shrinks
by the fan-in with each round. A merged group therefore gets the small bins of its
members, and of their other bins the emptiest ``REACH * FAN_IN``: far more than
that few small bins can fill. All others are final as they are.

Defined cases: a null text is empty and gives the one-token piece ``[end_id]``;
a repeated row is packed as often as it occurs; null ids are carried; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, written

CAPACITY = 4096
#: A bin with at most this many free places is final at once.
SLACK = 8
#: Partitions merged into one at each level of the tree.
FAN_IN = 16
#: Receiving bins of a merged group, in multiples of the fan-in.
REACH = 64
#: Cached chunks, and words, of a worker in each of two generations.
CACHE = 150_000
#: Characters of the longest chunk that is cached.
LONGEST = 64
#: Slices of a merged group whose emptiest bins are found side by side, so that no window holds all of its bins.
SLICES = 64


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Cache(dict):
    """What ``make`` gives for a key. Least recently made entries go first, a generation at a time; long keys are not kept."""

    def __init__(self, size: int, make: Callable[[str], bytes]):
        self.size, self.make, self.old = size, make, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def _packed(ids: list[int]) -> bytes:
    """The ids as little-endian unsigned 32-bit numbers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class ChunkTokenizer:
    """Ids of a text from cached ids of its chunks between ASCII white space.

    Exact for a tokenizer that lower-cases, drops white space and never forms a
    token across it: then a text's ids are its chunks' ids one after the other. Where letters
    and punctuation are split apart and words are byte-level, as here, a chunk of
    plain Latin letters and trailing signs goes to the vocabulary's model directly;
    any other chunk is encoded by the whole tokenizer. Chunks' ids are held packed, so that
    a text's ids are joined without a step in Python for each of its chunks.
    """

    SIGNS = ".,!?;:"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.chunks, self.words = Cache(CACHE, self._chunk), Cache(CACHE, self._word)

    def _word(self, word: str) -> bytes:
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return _packed([t.id for t in self.model.tokenize(shown)])

    def _chunk(self, chunk: str) -> bytes:
        core = chunk.rstrip(self.SIGNS)
        if core.isalpha() and (core.isascii() or (max(core) < "\u0250" and "\u0130" not in core)):
            return self.words[core.lower()] + (self.words[chunk[len(core) :]] if len(core) < len(chunk) else b"")
        return _packed(self.tokenizer.encode(chunk, add_special_tokens=False).ids)

    def ids(self, text: str) -> np.ndarray:
        chunks = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return np.frombuffer(b"".join(map(self.chunks.__getitem__, filter(None, chunks))), "<u4")


_TOKENIZERS: dict[str, ChunkTokenizer] = {}


def chunk_tokenizer(path: str) -> ChunkTokenizer:
    """One tokenizer, with its cache, for all tasks of a worker."""
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _TOKENIZERS[path] = ChunkTokenizer(path)
    return _TOKENIZERS[path]


class BestFit:
    """Best-fit decreasing over integer sizes; the open bins are found by free room in a bit set."""

    def __init__(self, capacity: int):
        self.capacity, self.rooms, self.open, self.fills = capacity, 0, [[] for _ in range(capacity + 1)], []

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset) of an item of ``size``."""
        fits = self.rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            k = self.open[room].pop()
            if not self.open[room]:
                self.rooms &= ~(1 << room)
        else:
            room, k = self.capacity, len(self.fills)
            self.fills.append(0)
        at = self.capacity - room
        self.fills[k] = at + size
        if room > size:
            self.open[room - size].append(k)
            self.rooms |= 1 << (room - size)
        return k, at


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """bin and offset of each item, fill of each bin."""
    pack, bins, offsets = BestFit(capacity), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable"):
        bins[i], offsets[i] = pack.place(int(sizes[i]))
    return bins, offsets, np.array(pack.fills, np.int64)


def _pieces(tokenizer: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, make, end, out, sizes = TaskContext.get().partitionId(), chunk_tokenizer(tokenizer), np.array([end_id], "<u4"), [], []
        for b in batches:
            owner, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(b.column("text").to_pylist()):
                ids = np.append(make.ids(text or ""), end)
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    owner.append(row), piece.append(k), start.append(at), length.append(len(part)), crc.append(zlib.crc32(part.tobytes()))
            out.append((b.column("id").take(pa.array(owner, pa.int64())), *(pa.array(x, t) for x, t in ((piece, pa.int32()), (start, pa.int64()), (length, pa.int64()), (crc, pa.int64())))))
            sizes += length
        bins, offsets, fills = best_fit(np.array(sizes, np.int64), capacity)
        at = 0
        for cols in out:  # pieces are a few dozen bytes each, whatever their texts
            n = len(cols[1])
            k = bins[at : at + n]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(k + (pid << 32)), pa.array(offsets[at : at + n]), pa.array(fills[k])], names=["id", "piece", "start", "length", "ids_crc32", "bin", "offset", "fill"])
            at += n

    return run


def _merge(capacity: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("bin")
        bins, offsets, fills = best_fit(group.column("fill").to_numpy(), capacity)
        ids = group.column("bin").to_numpy()
        lead = np.zeros(len(fills), np.int64)
        lead[bins[::-1]] = ids[::-1]  # a merged bin is named after one of its parts
        return pa.table({"bin": ids, "into": lead[bins], "shift": offsets, "fill": fills[bins], "node": group.column("node")})

    return run


def best_fit_packing(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = df.sparkSession
    bounded_batches(spark)
    t = df.schema[id_col].dataType.simpleString()
    items = written(
        df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(_pieces(tokenizer, end_id, capacity), f"id {t}, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long"),
        "pieces",
    )
    #: where each underfull bin of the first round ended
    under = items.filter(F.col("fill") < capacity - SLACK).groupBy("bin").agg(F.first("fill").alias("fill"))
    moved = under.select("bin", F.col("bin").alias("into"), F.lit(0).cast("long").alias("shift"), "fill")
    node = F.shiftright("into", 32)
    moved = written(moved.withColumn("node", node), "bins")
    nodes = (moved.agg(F.max("node")).first()[0] or 0) + 1
    while nodes > 1:
        nodes = -(-nodes // FAN_IN)
        tops = moved.select(F.col("into").alias("bin"), "fill", F.floor(F.col("node") / FAN_IN).alias("node")).distinct()
        going = tops.withColumn("slice", F.pmod(F.xxhash64("bin"), F.lit(SLICES)))
        for group in (("node", "slice"), ("node",)):
            rank = F.row_number().over(Window.partitionBy(*group).orderBy("fill", "bin"))
            going = going.withColumn("rank", rank).filter(F.col("rank") <= REACH * FAN_IN)
        going = going.drop("rank", "slice")
        if going.filter(F.col("fill") <= capacity // 2).limit(1).count() == 0:
            break
        done = written(going.groupBy("node").applyInArrow(_merge(capacity), "bin long, into long, shift long, fill long, node long"), "merged")
        up = done.select(F.col("bin").alias("b"), F.col("into").alias("i"), F.col("shift").alias("s"), F.col("fill").alias("f"))
        moved = written(
            moved.join(up, moved["into"] == up["b"], "left").select("bin", F.coalesce("i", "into").alias("into"), (F.col("shift") + F.coalesce("s", F.lit(0))).alias("shift"), F.coalesce("f", "fill").alias("fill"), F.floor(F.col("node") / FAN_IN).alias("node")),
            "bins",
        )
    out = items.join(moved.select("bin", "into", "shift"), "bin", "left")
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", F.coalesce("into", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
