"""N-gram Jaccard join by MinHash banding.

Texts with equal n-gram sets form one class, found by a digest, so copies are
never compared. The signatures of the classes are cut into bands whose number and
rows are chosen for a target recall; a shuffle on band hashes brings together
classes that share a band. Instead of all pairs of a bucket, only a link from each
member to the bucket's least class is kept; the connected clusters of these links hold every
candidate pair. Each cluster is verified once, on full n-gram sets, in pairs of blocks of
bounded size that are dealt over all tasks, so that no task holds a large cluster
and no list of pairs is ever written: a block pair gives, for each class, its number of
links and one link that spans its component. Blocks of a large cluster hold sets of one
level of size, where levels are so wide that linked sets are on the same or on neighbouring
levels; blocks further apart are never met.

Words are lower-cased runs of ASCII letters, digits and non-ASCII characters.

Defined cases: null texts are empty; a text without words has no n-gram, is linked to
nothing and is its own class; one of fewer than n words has one n-gram, all its
words; a repeated row is another document; null ids are carried (a class whose ids are
all null has a null class_id); an empty table gives an empty result; other columns
are ignored by :func:`ngram_jaccard_join` and carried by :func:`near_dedup`.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, parts_of, row_struct, spread_join, unrow, written
from .components import connected_components

NGRAM, SIMILARITY, RECALL = 5, 0.8, 0.999
#: Most hash functions of a signature.
SIGNATURE = 320
#: Classes and characters in one block of a cluster, about.
BLOCK, BLOCK_CHARS = 512, 4_000_000
_WORDS = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def choose_bands(similarity: float, recall: float, most: int = SIGNATURE) -> tuple[int, int]:
    """(bands, rows): the most rows a band whose recall at ``similarity`` reaches ``recall`` with at most ``most`` hashes."""
    best = None
    for rows in range(1, most + 1):
        p = similarity**rows
        if p < 1e-9:
            break
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - p))
        if bands * rows <= most:
            best = (bands, rows)
    return best or (most, 1)


class Shingles:
    """Sorted 64-bit hashes of the distinct word n-grams of a text."""

    def __init__(self, n: int = NGRAM):
        self.n, self.cache = n, {}
        self.powers = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(n)], np.uint64)

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()
        if not words:
            return np.zeros(0, np.uint64)
        cache = self.cache
        if len(cache) > 150_000:
            cache.clear()
        for w in words:
            if w not in cache:
                cache[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
        if len(h) < self.n:
            return np.array([xxhash.xxh64_intdigest(h.tobytes())], np.uint64)
        k = len(h) - self.n + 1
        out = np.zeros(k, np.uint64)
        for i, p in enumerate(self.powers):
            out += h[i : i + k] * p
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
        return np.unique(out)


def signatures(sets: list[np.ndarray], hashes: int) -> np.ndarray:
    """MinHash values, one row per non-empty set."""
    rng = np.random.default_rng(7)
    mul, flip = rng.integers(0, 1 << 31, hashes, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, hashes, np.uint32)
    out = np.empty((len(sets), hashes), np.uint32)
    at = 0
    while at < len(sets):  # about a MB of hashes at once
        end, n = at, 0
        while end < len(sets) and (n == 0 or n + len(sets[end]) <= 200_000):
            n += len(sets[end])
            end += 1
        h = np.concatenate(sets[at:end]).astype(np.uint32)
        starts = np.cumsum([0, *map(len, sets[at : end - 1])])
        for k in range(hashes):
            out[at:end, k] = np.minimum.reduceat((h ^ flip[k]) * mul[k], starts)
        at = end
    return out


FEATURES = "rid long, digest binary, bands array<long>, grams long, chars long, text string"


def _features(n: int, bands: int, rows: int, extra: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, row = Shingles(n), TaskContext.get().partitionId() << 33
        mix = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(rows)], np.uint64)
        for b in batches:
            texts = b.column("text").to_pylist()
            sets = [make(t) for t in texts]
            full = [s for s in sets if len(s)]
            hashed = (signatures(full, bands * rows).reshape(len(full), bands, rows).astype(np.uint64) * mix).sum(2, dtype=np.uint64).view(np.int64) if full else np.zeros((0, bands), np.int64)
            valid = np.array([len(s) > 0 for s in sets], bool)
            offsets = np.concatenate([[0], np.cumsum(np.where(valid, bands, 0))]).astype(np.int32)
            arrays = pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashed.reshape(-1)))
            digests = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary())
            rid = pa.array(np.arange(row, row + len(texts)))
            row += len(texts)
            yield pa.RecordBatch.from_arrays([rid, digests, arrays, pa.array(list(map(len, sets)), pa.int64()), pa.array(list(map(len, texts)), pa.int64()), b.column("text"), *(b.column(c) for c in extra)], names=["rid", "digest", "bands", "grams", "chars", "text", *extra])

    return run


def linked(sets: list[np.ndarray], similarity: float, cut: int = 0) -> np.ndarray:
    """Boolean matrix of the pairs of non-empty sets with Jaccard similarity of at least ``similarity``; with ``cut``, of the first so many sets with the others."""
    sizes = np.array([len(s) for s in sets], np.int64)
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    doc = np.repeat(np.arange(len(sets)), sizes)
    if cut:  # only what occurs on both sides can be shared
        left = np.bincount(inverse[doc < cut], minlength=len(values))
        wanted = (left > 0) & (counts > left)
    else:
        wanted = counts > 1
    column = np.cumsum(wanted) - 1
    doc, col = doc[wanted[inverse]], column[inverse[wanted[inverse]]]
    order = np.argsort(col, kind="stable")
    doc, col = doc[order], col[order]
    a, b = (slice(0, cut), slice(cut, len(sets))) if cut else (slice(0, len(sets)),) * 2
    both = np.zeros((len(sizes[a]), len(sizes[b])), np.float32)
    width = int(wanted.sum())
    for at in range(0, width, 4096):
        lo, hi = np.searchsorted(col, (at, at + 4096))
        m = np.zeros((len(sets), min(4096, width - at)), np.float32)
        m[doc[lo:hi], col[lo:hi] - at] = 1
        both += m[a] @ m[b].T
    union = sizes[a][:, None] + sizes[b][None, :] - both
    out = both >= similarity * union - 1e-9
    if not cut:
        np.fill_diagonal(out, False)
    return out


def _verify(n: int, similarity: float):
    """Batches sorted by unit (cluster, lo, hi) -> class, links, leader within the unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingles(n)
        unit, held, out = None, [], []
        never = np.iinfo(np.int64).max

        def solve():
            # Two blocks: pairs within one of them belong to its own unit.
            cut = sum(not x[2] for x in held) if unit[1] != unit[2] else 0
            if unit[1] != unit[2] and cut in (0, len(held)):
                return
            held.sort(key=lambda x: x[2])
            rep, size = np.array([x[0] for x in held]), np.array([x[1] for x in held])
            adj = linked([make(x[3]) for x in held], similarity, cut)
            leader = rep.copy()
            a, b = (slice(0, cut), slice(cut, len(held))) if cut else (slice(0, len(held)),) * 2
            while True:  # least class of each component inside the unit
                new = leader.copy()
                new[a] = np.minimum(new[a], np.where(adj, leader[b][None, :], never).min(1))
                if cut:
                    new[b] = np.minimum(new[b], np.where(adj, leader[a][:, None], never).min(0))
                if (new == leader).all():
                    break
                leader = new
            out.append((rep, np.concatenate([adj @ size[b], size[a] @ adj]) if cut else adj @ size, leader))

        def flush():
            cols = [np.concatenate(c) for c in zip(*out, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["rep", "links", "leader"])

        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("cluster", "lo", "hi", "rep", "size", "blk", "text")]
            for cluster, lo, hi, rep, size, blk, text in zip(*cols, strict=True):
                if (cluster, lo, hi) != unit:
                    if len(held) > 1:
                        solve()
                    unit, held = (cluster, lo, hi), []
                held.append((rep, size, blk != lo, text))
            if sum(len(x[0]) for x in out) > 4096:
                yield flush()
        if len(held) > 1:
            solve()
        if out:
            yield flush()

    return run


def _units(clusters: DataFrame, classes: DataFrame, feats: DataFrame, similarity: float) -> DataFrame:
    """Rows (cluster, lo, hi, rep, size, blk, text): each text once in every pair of blocks that it takes part in."""
    # Sizes of linked sets differ by the factor 1/similarity at most, so by one level at most.
    level = F.floor(F.log("grams") / (math.log(1 / similarity) + 1e-6)).cast("int")
    sized = clusters.join(classes.select("rep", "size", "chars", level.alias("level")), F.col("node") == F.col("rep")).select(F.col("component").alias("cluster"), "rep", "size", "chars", "level")
    each = sized.groupBy("cluster", "level").agg(F.count("*").alias("k"), F.sum("chars").alias("chars"), parts_of(F.col("rep")))
    need = F.greatest(F.ceil(F.col("k") / BLOCK), F.ceil(F.col("chars") / BLOCK_CHARS)).cast("int")
    shape = each.groupBy("cluster").agg(F.sum("k").alias("k"), F.sum("chars").alias("all_chars"), F.map_from_entries(F.collect_list(F.struct("level", need))).alias("blocks"), F.bit_or("parts").alias("parts"))
    shape = shape.select("cluster", "blocks", "parts", ((F.col("k") <= BLOCK) & (F.col("all_chars") <= BLOCK_CHARS)).alias("whole"))
    members = spread_join(sized, shape, ["cluster"], F.col("rep"))
    members = members.withColumn("level", F.when(F.col("whole"), 0).otherwise(F.col("level")))

    def blocks(step: int) -> Column:
        """Blocks on the level ``step`` above; a small cluster is one block."""
        other = F.coalesce(F.try_element_at("blocks", F.col("level") + step), F.lit(0))
        return F.when(F.col("whole"), 1 - abs(step)).otherwise(other)

    def code(step: int, blk: Column) -> Column:
        return F.shiftleft((F.col("level") + step).cast("long"), 32) + blk

    def reached(step: int) -> Column:
        numbers = F.when(blocks(step) > 0, F.sequence(F.lit(0), blocks(step) - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(numbers, lambda x: code(step, x))

    mine = code(0, F.pmod(F.xxhash64("rep"), blocks(0)))
    members = members.join(feats.select("rid", "text"), F.col("rid") == F.col("rep")).select("cluster", "rep", "size", "text", "level", "whole", "blocks", mine.alias("blk"))
    others = F.concat(*(reached(step) for step in (-1, 0, 1)))
    units = members.withColumn("other", F.explode(others))
    return units.select("cluster", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"), "rep", "size", "blk", "text")


def _classified(df: DataFrame, id_col: str, text_col: str, n: int, similarity: float, recall: float, carry: list[Column], extra_type: str) -> tuple[DataFrame, DataFrame]:
    """Rows (rid, digest, id, carried columns) of the documents, and classes (digest, parts, rep, min_id, first_rid, stays_rep, class_id, n_links)."""
    spark = df.sparkSession
    bounded_batches(spark)
    bands, rows = choose_bands(similarity, recall)
    extra = ["id", *(["row"] if carry else [])]
    t = df.schema[id_col].dataType.simpleString()
    source = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), *carry)
    feats = written(source.mapInArrow(_features(n, bands, rows, extra), f"{FEATURES}, id {t}{extra_type}"), "ngrams")
    # Equal sets form a class; its band hashes are those of any member.
    classes = written(
        feats.filter("digest is not null")
        .groupBy("digest")
        .agg(
            F.min("rid").alias("rep"),
            F.min("id").alias("min_id"),
            F.count("*").alias("size"),
            F.max("grams").alias("grams"),
            F.max("chars").alias("chars"),
            F.first("bands").alias("bands"),
            F.min(F.struct(F.col("id").isNull(), "id", "rid"))["rid"].alias("first_rid"),
            parts_of(F.col("rid")),
        ),
        "classes",
    )
    keyed = classes.select("rep", F.posexplode("bands").alias("band", "hash"))
    buckets = keyed.groupBy("band", "hash").agg(F.min("rep").alias("lead"), F.count("*").alias("k")).filter("k > 1")
    star = keyed.join(buckets.select("band", "hash", "lead"), ["band", "hash"]).filter("rep <> lead").select(F.col("rep").alias("u"), F.col("lead").alias("v"))
    clusters = written(connected_components(star), "clusters")
    units = _units(clusters, classes, feats, similarity)
    links = written(units.repartition("cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi").mapInArrow(_verify(n, similarity), "rep long, links long, leader long"), "links")
    groups = connected_components(links.filter("rep <> leader").select(F.col("rep").alias("u"), F.col("leader").alias("v")))
    degree = links.groupBy("rep").agg(F.sum("links").alias("links"))
    told = classes.select("digest", "parts", "rep", "min_id", "size", "first_rid").join(groups, F.col("rep") == F.col("node"), "left").join(degree, "rep", "left").withColumn("group", F.coalesce("component", "rep")).select("digest", "parts", "rep", "min_id", "size", "first_rid", "group", F.coalesce("links", F.lit(0)).alias("links"))
    told = written(told, "told")
    names = told.groupBy("group").agg(F.min("min_id").alias("class_id"), F.min(F.struct(F.col("min_id").isNull(), "min_id", "rep"))["rep"].alias("stays_rep"))
    told = told.join(names, "group").select("digest", "parts", "rep", "min_id", "first_rid", "stays_rep", "class_id", (F.col("links") + F.col("size") - 1).alias("n_links"))
    return feats.select("rid", "digest", *extra), told


def ngram_jaccard_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row per document.

    ``class_id``: the least id of its group, linked directly or through others;
    ``n_links``: number of other documents whose similarity reaches the threshold, copies included;
    ``set_class_id``: the least id of the documents with the same n-gram set.
    """
    docs, told = _classified(df, id_col, text_col, n, similarity, recall, [], "")
    facts = told.select("digest", "parts", "class_id", "n_links", F.col("min_id").alias("set_class_id"))
    known = spread_join(docs.filter("digest is not null"), facts, ["digest"], F.col("rid"))
    alone = docs.filter("digest is null").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("set_class_id"))
    return known.select("id", "class_id", "n_links", "set_class_id").unionByName(alone).select(F.col("id").alias(id_col), "class_id", "n_links", "set_class_id")


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """The rows of ``df`` that stay: of each group the one with the least id."""
    docs, told = _classified(df, id_col, text_col, n, similarity, recall, [row_struct(df)], f", row {df.schema.simpleString()}")
    # Of the class that stays, one row stays: the first of those with its least id. The rows that go are few, so that their numbers (a table, whose
    # size Spark knows) mostly reach the rows by broadcast and texts needn't be shuffled for them.
    stays = told.filter("rep = stays_rep").select(F.col("first_rid").alias("rid"))
    gone = written(docs.filter("digest is not null").select("rid").join(stays, "rid", "left_anti"), "gone")
    return unrow(docs.join(gone, "rid", "left_anti").select("row"), df.columns)
