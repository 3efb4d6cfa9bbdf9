"""Language-model scoring by prediction by partial matching over bytes.

A byte-context trie holds, for each context of up to ``ORDER`` bytes, the symbols seen after it. A
symbol is coded in its longest known context; where it is not among that context's
symbols, an escape is coded and the next shorter context is tried, without the symbols
already ruled out (exclusion). Each symbol of a context gives up ``DISCOUNT`` of its count; what they give up together is the escape's weight. Below the empty context all
remaining symbols are equally likely. Each text ends in an end symbol.

*Pretrained*: counts are gathered over all training texts and every pair is kept. A symbol's probability depends
on the gram (context and symbol) alone, so each distinct gram is coded once: grams are dealt into buckets by the last
``LOW + 1`` bytes of the context, which puts all that longer contexts need in one place; what contexts of up to ``LOW``
bytes need is sent to all, and has at most as many rows as there are strings of ``LOW + 1`` bytes. A chunk of documents sends
each bucket its distinct grams as one row of compressed arrays; the chunks' rows of a bucket are streamed, first to
be summed and coded, then to be told their logs, which go back to the chunk as one row a bucket. *Adaptive*: :class:`AdaptiveTrie` starts empty and learns
each symbol after coding it.

The base score is an add-one unigram model over words with counts of all training
texts. Words are exchanged by chunks of documents too, numbered in their order within the chunk, so
that a frequent one is one row of a chunk, not of each document.

Defined cases: a null text is empty and holds the end token alone; a null id hashes as the
empty text; repeated rows are scored and counted as often as they occur; without
training rows N and V are 0, base_score is 0 and the model is uniform; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import bounded_batches, crc_bucket, written

#: Longest context, in bytes; a gram is a context and its symbol.
ORDER = 5
#: Longest context, in bytes, whose counts are sent to all tasks.
LOW = 2
#: Buckets of grams: one for so many bytes of text, and at most so many.
BUCKET_BYTES, MOST_BUCKETS = 8_000_000, 4096
#: Chunks of a bucket told by one task: as many, and more by the root of how often that number goes into all of them.
PART_CHUNKS = 512
#: What a context's symbol gives up of its count for the escape.
DISCOUNT = 0.3
START, END = 0xFE, 0xFF  # never part of UTF-8
ALPHABET = 257  # 256 byte values and one spare
#: Distinct words and bytes of text in one chunk, about.
CHUNK_WORDS, CHUNK_BYTES = 400_000, 8_000_000
_BLOCK = 1 << 20
_CODEC = pa.Codec("zstd", 1)


def encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass") + bytes([END])


# --- adaptive, one symbol at a time ---------------------------------------------------


class AdaptiveTrie:
    """The model in its plainest form: counts by context, updated by :meth:`learn`."""

    def __init__(self, order: int = ORDER):
        self.order = order
        self.total: dict[bytes, int] = {}
        self.counts: dict[bytes, dict[int, int]] = {}

    def learn(self, context: bytes, symbol: int) -> None:
        for k in range(min(self.order, len(context)) + 1):
            c = context[len(context) - k :]
            self.total[c] = self.total.get(c, 0) + 1
            seen = self.counts.setdefault(c, {})
            seen[symbol] = seen.get(symbol, 0) + 1

    def log10(self, context: bytes, symbol: int) -> float:
        out, excluded = 0.0, frozenset()
        for k in range(min(self.order, len(context)), -1, -1):
            c = context[len(context) - k :]
            seen = self.counts.get(c)
            if not seen:
                continue
            escape = DISCOUNT * len(seen)
            room = escape + sum(n - DISCOUNT for s, n in seen.items() if s not in excluded)
            if symbol in seen:
                return out + math.log10((seen[symbol] - DISCOUNT) / room)
            out += math.log10(escape / room)
            excluded = seen.keys()
        return out - math.log10(ALPHABET - len(excluded))

    def score(self, text: str | None, learn: bool = True) -> float:
        """log10 probability of the text; ``learn`` makes it adaptive."""
        data, out = encoded(text), 0.0
        for i in range(len(data)):
            context = data[max(0, i - self.order) : i]
            out += self.log10(context, data[i])
            if learn:
                self.learn(context, data[i])
        return out

    def train(self, text: str | None) -> None:
        data = encoded(text)
        for i in range(len(data)):
            self.learn(data[max(0, i - self.order) : i], data[i])


# --- grams ---------------------------------------------------------------------------


def _grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The gram of order + 1 bytes that ends at each byte of the texts, filled up with START, and the number of its text."""
    pad = bytes([START]) * order
    data = np.frombuffer(b"".join(pad + t for t in texts), np.uint8).astype(np.int64)
    g = np.zeros(len(data), np.int64)
    for k in range(order + 1):
        g[k:] |= data[: len(data) - k] << np.int64(8 * k)
    solid = data != START
    return g[solid], np.repeat(np.arange(len(texts)), [len(t) + order for t in texts])[solid]


def _blocks(texts: list[bytes]) -> Iterator[list[bytes]]:
    block: list[bytes] = []
    size = 0
    for t in texts:
        block.append(t)
        size += len(t)
        if size > _BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


def _squeezed(values: np.ndarray) -> bytes:
    """64-bit whole numbers as compressed planes of bytes; for sorted values hand over the differences."""
    planes = np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + _CODEC.compress(planes.tobytes(), asbytes=True)


def _whole(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(_CODEC.decompress(data[8:], 8 * n, asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def _squeezed_logs(values: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(values.astype("<f4").view(np.uint8).reshape(-1, 4).T)
    return len(values).to_bytes(8, "little") + _CODEC.compress(planes.tobytes(), asbytes=True)


def _whole_logs(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(_CODEC.decompress(data[8:], 4 * n, asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<f4").ravel()


def _dealt(grams: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of sorted grams by bucket, and where each bucket begins; a bucket has all grams whose contexts end in the same ``LOW + 1`` bytes."""
    end = (grams >> np.int64(8)) & np.int64((1 << 8 * (LOW + 1)) - 1)
    mixed = (end.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
    bucket = (mixed % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    return by, np.searchsorted(bucket[by], np.arange(buckets + 1))


def _packed_texts(ids: list, held: list, texts: list[bytes], id_type: pa.DataType) -> bytes:
    t = pa.table({"id": pa.array(ids, id_type), "held": pa.array(held, pa.bool_()), "text": pa.array(texts, pa.binary())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression=_CODEC)) as out:
        out.write_table(t)
    return sink.getvalue().to_pybytes()


def _chunks(order: int, buckets: int, id_type: pa.DataType):
    """From documents, chunk by chunk: the documents in one piece (kind 0), words (kind 1), grams by bucket (kind 2) and the grams of short contexts (kind 3), with their counts in training texts."""
    kinds = {"bucket": pa.int32(), "word": pa.binary(), "gram": pa.int64(), "number": pa.int32(), "n": pa.int64(), "packed": pa.binary(), "counts": pa.binary()}

    def out(kind: int, rows: int, chunk: int, **cols) -> pa.RecordBatch:
        arrays = [pa.array([kind] * rows, pa.int8()), pa.array([chunk] * rows, pa.int64())]
        return pa.RecordBatch.from_arrays(arrays + [pa.array(cols[c], t) if c in cols else pa.nulls(rows, t) for c, t in kinds.items()], names=["kind", "chunk", *kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size = TaskContext.get().partitionId() << 24, 0
        words: dict[bytes, int] = {}
        ids: list = []
        helds: list[bool] = []
        coded: list[bytes] = []

        def close() -> Iterator[pa.RecordBatch]:
            yield out(0, 1, chunk, packed=[_packed_texts(ids, helds, coded, id_type)], n=[len(ids) - sum(helds)])
            items = sorted(words)
            for at in range(0, len(items), 20_000):
                part = items[at : at + 20_000]
                yield out(1, len(part), chunk, word=part, number=range(at, at + len(part)), n=[words[w] for w in part])
            grams = []
            for h in (True, False):
                for block in _blocks([t for t, x in zip(coded, helds, strict=True) if x == h]):
                    keys, n = np.unique(_grams(block, order)[0], return_counts=True)
                    grams.append(np.stack([keys, n * (not h)]))
            g = np.concatenate(grams, 1)
            grams.clear()
            keys, where = np.unique(g[0], return_inverse=True)
            n = np.bincount(where, g[1]).astype(np.int64)
            del g, where
            short, where = np.unique(keys & np.int64((1 << 8 * (LOW + 1)) - 1), return_inverse=True)
            few = np.bincount(where, n).astype(np.int64)
            short, few = short[few > 0], few[few > 0]
            for at in range(0, len(short), 50_000):
                part = short[at : at + 50_000]
                yield out(3, len(part), chunk, gram=part, n=few[at : at + 50_000])
            by, begin = _dealt(keys, buckets)
            keys, n = keys[by], n[by]
            for at in range(0, buckets, 64):
                some = [k for k in range(at, min(at + 64, buckets)) if begin[k] < begin[k + 1]]
                parts = [slice(begin[k], begin[k + 1]) for k in some]
                yield out(2, len(some), chunk, bucket=some, packed=[_squeezed(np.diff(keys[p], prepend=0)) for p in parts], counts=[_squeezed(n[p]) for p in parts])
            for held in (words, ids, helds, coded):
                held.clear()

        for b in batches:
            for i, text, h in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), b.column("held").to_pylist(), strict=True):
                data = encoded(text)
                ids.append(i), helds.append(h), coded.append(data)
                size += len(data)
                for w in data[:-1].lower().split():
                    words[w] = words.get(w, 0) + (not h)
                if len(words) >= CHUNK_WORDS or size >= CHUNK_BYTES:
                    yield from close()
                    chunk, size = chunk + 1, 0
        if ids:
            yield from close()

    return run


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted value in the sorted keys, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


@dataclass
class Level:
    """Grams whose context has one length, with counts, and their contexts."""

    keys: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    total: np.ndarray
    distinct: np.ndarray
    ruled: np.ndarray  # occurrences of the context's symbols under the next shorter context


def levels(grams: np.ndarray, n: np.ndarray, order: int, shorter: list[Level]) -> list[Level]:
    """``shorter``, and the levels above it up to ``order``, from grams of more bytes filled up with START."""
    out = list(shorter)
    for k in range(len(out), order + 1):
        whole = (grams >> np.int64(8 * k) & 0xFF) != START
        keys, where = np.unique(grams[whole] & np.int64((1 << 8 * (k + 1)) - 1), return_inverse=True)
        counts = np.bincount(where, n[whole], len(keys))
        first = np.flatnonzero(np.diff(keys >> 8, prepend=-1)) if len(keys) else np.zeros(0, np.int64)
        under = out[-1].counts[_find(out[-1].keys, keys & np.int64((1 << 8 * k) - 1))] if k and len(keys) else counts
        sums = lambda v: np.add.reduceat(v, first) if len(first) else np.zeros(0)  # noqa: E731,B023
        out.append(Level(keys, counts, keys[first] >> 8, sums(counts), np.diff(first, append=len(keys)), sums(under)))
    return out


def gram_logs(grams: np.ndarray, known: list[Level]) -> np.ndarray:
    """log10 probability of each gram's symbol after its context."""
    out, open_ = np.zeros(len(grams)), np.ones(len(grams), bool)
    ruled, gone = np.zeros(len(grams)), np.zeros(len(grams))  # occurrences and symbols already ruled out
    for k in range(len(known) - 1, -1, -1):
        level = known[k]
        at = np.flatnonzero(open_ & ((grams >> np.int64(8 * k) & 0xFF) != START))
        gram = grams[at] & np.int64((1 << 8 * (k + 1)) - 1)
        context = _find(level.contexts, gram >> 8)
        at, gram, context = at[context >= 0], gram[context >= 0], context[context >= 0]
        room = level.total[context] - (ruled[at] - DISCOUNT * gone[at])  # symbols ruled out have given up theirs
        hit = _find(level.keys, gram)
        seen = hit >= 0
        weight = DISCOUNT * level.distinct[context]
        weight[seen] = level.counts[hit[seen]] - DISCOUNT
        out[at] += np.log10(weight / room)
        open_[at[seen]] = False
        ruled[at], gone[at] = level.ruled[context], level.distinct[context]
    out[open_] -= np.log10(ALPHABET - gone[open_])
    return out


_LEVELS: dict[str, list[Level]] = {}


def _shorter(shared, name: str, order: int) -> list[Level]:
    """The broadcast levels, made ready once in each worker; ``name`` is this model's own."""
    if name not in _LEVELS:
        _LEVELS.clear()
        _LEVELS[name] = levels(*shared.value, min(LOW, order), [])
    return _LEVELS[name]


def _summed(grams: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate(grams), return_inverse=True)
    return keys, np.bincount(where, np.concatenate(counts), len(keys)).astype(np.int64)


def _coded(order: int, shared, name: str):
    """From chunks' grams sorted by bucket, one row at a time: each bucket's distinct grams and the log10 probabilities of their symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, grams, counts, waiting = None, [], [], 0

        def close() -> pa.RecordBatch:
            keys, n = _summed(grams, counts)
            grams.clear(), counts.clear()
            logs = gram_logs(keys, levels(keys[n > 0], n[n > 0], order, _shorter(shared, name, order)))
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([_squeezed(np.diff(keys, prepend=0))], pa.binary()), pa.array([_squeezed_logs(logs)], pa.binary())], names=["bucket", "packed", "logs"])

        for b in batches:
            packed, counted = b.column("packed"), b.column("counts")
            for i, k in enumerate(b.column("bucket").to_pylist()):
                if k != bucket and grams:
                    yield close()
                    waiting = 0
                bucket = k
                grams.append(np.cumsum(_whole(packed[i].as_py()))), counts.append(_whole(counted[i].as_py()))
                waiting += len(grams[-1])
                if waiting > 4_000_000:  # sum up what has come so far
                    both = _summed(grams, counts)
                    grams[:], counts[:] = [both[0]], [both[1]]
                    waiting = 0
        if grams:
            yield close()

    return run


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (bucket, part), a bucket's logs before chunks' grams: each chunk's logs, in the order of its grams."""
    keys = logs = None
    for b in batches:
        chunks, buckets, out = b.column("chunk").to_pylist(), b.column("bucket").to_pylist(), []
        packed, told = b.column("packed"), b.column("logs")
        of: list[tuple[int, int]] = []
        for i, (chunk, bucket) in enumerate(zip(chunks, buckets, strict=True)):
            grams = np.cumsum(_whole(packed[i].as_py()))
            if chunk is None:
                keys, logs = grams, _whole_logs(told[i].as_py())
            else:
                of.append((chunk, bucket))
                out.append(_squeezed_logs(logs[np.searchsorted(keys, grams)]))
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in of], pa.int64()), pa.array([k for _, k in of], pa.int32()), pa.array(out, pa.binary())], names=["of", "bucket", "logs"])


def gram_tables(got: DataFrame, order: int) -> DataFrame:
    """(of, bucket, logs): of each chunk, by bucket, the log10 probabilities of its grams' symbols."""
    spark = got.sparkSession
    low = got.filter("kind = 3").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()  # at most one row for each string of LOW + 1 bytes
    shared = spark.sparkContext.broadcast((low.column("gram").to_numpy(), low.column("n").to_numpy()))
    grams = got.filter("kind = 2").select("bucket", "chunk", "packed", "counts")
    code = _coded(order, shared, uuid.uuid4().hex)
    model = written(grams.select("bucket", "packed", "counts").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(code, "bucket int, packed binary, logs binary"), "model")
    # A bucket's chunks are dealt over several parts, each with its own copy of the bucket's logs.
    parts = max(1, math.isqrt(got.filter("kind = 0").count() // PART_CHUNKS))
    copies = model.select("bucket", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(None).cast("long").alias("chunk"), "packed", "logs")
    rows = grams.select("bucket", F.pmod(F.xxhash64("chunk"), F.lit(parts)).cast("int").alias("part"), "chunk", "packed", F.lit(None).cast("binary").alias("logs"))
    dealt = rows.unionByName(copies).repartition("bucket", "part").sortWithinPartitions("bucket", "part", F.col("chunk").asc_nulls_first())
    return dealt.mapInArrow(_told, "of long, bucket int, logs binary")


def adaptive_scores(df: DataFrame, text_col: str = "text", out: str = "score") -> DataFrame:
    """``df`` with each text's log10 probability under a model that starts empty and learns as it codes."""

    @F.pandas_udf(DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: AdaptiveTrie().score(t if isinstance(t, str) else None))

    bounded_batches(df.sparkSession)
    return df.withColumn(out, score(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))


def _scores(total: int, distinct: int, ends: int, order: int, buckets: int):
    """Of each chunk: its texts, and the counts of its words by number and the logs of its grams by bucket."""
    room = math.log10(total + distinct + 1)
    end = math.log10(ends + 1) - room

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        packed = docs.column("packed")[0].as_py()
        docs = pa.ipc.open_stream(packed).read_all()
        texts = docs.column("text").to_pylist()
        words = told.filter(pc.is_valid(told.column("number")))
        table = np.zeros(len(words))
        table[words.column("number").to_numpy()] = words.column("value").to_numpy()

        split = [t[:-1].lower().split() for t in texts]
        index = {w: k for k, w in enumerate(sorted({w for ws in split for w in ws}))}
        flat = np.fromiter((index[w] for ws in split for w in ws), np.int64)
        n = np.array([len(ws) for ws in split])
        del split, index
        of = np.repeat(np.arange(len(texts)), n)
        base = np.bincount(of, np.log10(table[flat] + 1.0) - room, len(texts)) + end
        known = np.bincount(of, table[flat] > 0, len(texts)).astype(np.int64) + int(ends > 0)
        del flat, of

        parts = []
        for block in _blocks(texts):
            g, which = _grams(block, order)
            keys, where = np.unique(g, return_inverse=True)
            parts.append((keys, where.astype(np.int32), which.astype(np.int32), len(block)))
        keys = np.unique(np.concatenate([p[0] for p in parts]))
        by, _ = _dealt(keys, buckets)
        gram_rows = told.filter(pc.is_valid(told.column("bucket"))).sort_by("bucket")
        logs = np.zeros(len(keys))
        logs[by] = np.concatenate([_whole_logs(x.as_py()) for x in gram_rows.column("logs")])
        score = np.concatenate([np.bincount(which, logs[np.searchsorted(keys, u)][where], rows) for u, where, which, rows in parts])
        return pa.table({"id": docs.column("id"), "held_out": docs.column("held"), "n_tokens": n + 1, "n_known": known, "train_tokens": np.full(len(n), total), "base_score": base, "score": score})

    return run


def score_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None, order: int = ORDER) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = df.sparkSession
    bounded_batches(spark)
    kind = df.schema[id_col].dataType
    t = kind.simpleString()
    held = held_out if held_out is not None else crc_bucket(F.col(f"`{id_col}`"), 7) == 2
    docs = df.select(F.col(f"`{id_col}`").alias("id"), held.alias("held"), F.col(f"`{text_col}`").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(MOST_BUCKETS, max(32, size // BUCKET_BYTES))
    got = written(docs.mapInArrow(_chunks(order, buckets, to_arrow_type(kind)), "kind tinyint, chunk long, bucket int, word binary, gram long, number int, n long, packed binary, counts binary"), "chunks")
    ends = got.filter("kind = 0").agg(F.sum("n")).first()[0] or 0
    # A word has one row a chunk; the first of them tells of the word.
    same = Window.partitionBy("word")
    words = got.filter("kind = 1").select("word", "chunk", "number", "n")
    words = written(words.select("chunk", "number", F.sum("n").over(same).alias("c"), "n", (F.col("chunk") == F.min("chunk").over(same)).alias("first")), "words")
    total, distinct = words.agg(F.sum("n"), F.count(F.when(F.col("first") & (F.col("c") > 0), 1))).first()
    total, distinct = (total or 0) + ends, distinct + (ends > 0)
    told = words.select(F.col("chunk").alias("of"), "number", F.col("c").cast("double").alias("value"), F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("logs"))
    told = told.unionByName(gram_tables(got, order).select("of", F.lit(None).cast("int").alias("number"), F.lit(None).cast("double").alias("value"), "bucket", "logs"))
    texts = got.filter("kind = 0").select("chunk", "packed")
    out = texts.groupBy("chunk").cogroup(told.groupBy("of")).applyInArrow(_scores(total, distinct, ends, order, buckets), f"id {t}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)
