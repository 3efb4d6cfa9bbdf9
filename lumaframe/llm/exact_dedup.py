"""Exact deduplication by content sort.

Normalised texts are range-partitioned by sampled splitters and sorted
externally inside each partition, which puts equal texts next to each other;
neighbours are then compared in full. The splitters are (first 64 characters,
digest, id): of bounded size however long texts are, and a group of copies that
holds a third of all rows is dealt over many partitions by id. Runs that touch
a partition's edge are joined over at most two rows per partition.

Defined cases: a null text counts as empty; null ids sort last, so a copy with an
id stays before one without; of repeated rows (same id, same text) one stays; an
empty table gives an empty result; other columns are ignored by
:func:`exact_groups` and carried unchanged by :func:`exact_dedup`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, row_struct, unrow, written

PREFIX = 64

HEAD, TAIL = 1, 2  # a run touches the first, the last row of its partition


def normalised(text: Column) -> Column:
    """Null is empty; each run of ASCII white space is one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _content_sorted(df: DataFrame, id_col: str, text_col: str, *carry: Column) -> DataFrame:
    keyed = df.select(F.col(f"`{id_col}`").alias("id"), normalised(F.col(f"`{text_col}`")).alias("norm"), *carry)
    keyed = keyed.withColumn("prefix", F.substring("norm", 1, PREFIX)).withColumn("sha", F.sha2(F.col("norm").cast("binary"), 256))
    by_id = F.col("id").asc_nulls_last()
    return keyed.repartitionByRange("prefix", "sha", by_id).sortWithinPartitions("prefix", "sha", "norm", by_id).drop("prefix")


def _runs(id_type: pa.DataType):
    """One row per document with its local run; a run's ids (not its texts) are held until it ends."""
    schema = pa.schema([("id", id_type), ("sha", pa.string()), ("pid", pa.int32()), ("edge", pa.int8()), ("first", pa.bool_()), ("keep", id_type), ("n", pa.int64()), ("edge_text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        norm = sha = None
        ids: list = []
        edge, ready, waiting = HEAD, [], 0
        for b in batches:
            for i, text, digest in zip(b.column("id").to_pylist(), b.column("norm").to_pylist(), b.column("sha").to_pylist(), strict=True):
                if ids and text == norm:  # neighbouring full comparison
                    ids.append(i)
                    continue
                if ids:
                    ready.append((ids, sha, edge, norm))
                    waiting += len(ids)
                    edge = 0
                norm, sha, ids = text, digest, [i]
            if waiting >= 4096:
                yield from _flat(ready, pid, schema, id_type)
                ready, waiting = [], 0
        if ids:
            ready.append((ids, sha, edge | TAIL, norm))
        if ready:
            yield from _flat(ready, pid, schema, id_type)

    return run, schema


def _flat(ready: list, pid: int, schema: pa.Schema, id_type: pa.DataType) -> list[pa.RecordBatch]:
    cols: list[list] = [[] for _ in schema]
    for ids, sha, edge, norm in ready:
        k = len(ids)
        for col, values in zip(cols, (ids, [sha] * k, [pid] * k, [edge] * k, [True] + [False] * (k - 1), [ids[0]] * k, [k] * k, [norm if edge else None] + [None] * (k - 1)), strict=True):
            col.extend(values)
    return [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)]


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    spark = df.sparkSession
    bounded_batches(spark)
    id_type = df.schema[id_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    run, _ = _runs(to_arrow_type(id_type))
    t = id_type.simpleString()
    local = written(_content_sorted(df, id_col, text_col).mapInArrow(run, f"id {t}, sha string, pid int, edge tinyint, first boolean, keep {t}, n long, edge_text string"), "dedup")
    edges = local.filter(F.col("edge_text").isNotNull()).select("pid", "edge", "edge_text", "keep", "n")  # at most two rows per partition
    whole = edges.groupBy("edge_text").agg(F.min("pid").alias("first_pid"), F.min("keep").alias("whole_keep"), F.sum("n").alias("whole_n"))
    found = edges.join(whole, "edge_text").select("pid", "edge", "first_pid", "whole_keep", "whole_n")
    out = lambda rows, keep, n, kept: rows.select(F.col("id").alias(id_col), keep.alias("keep_id"), n.alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"))
    inner = out(local.filter("edge = 0"), F.col("keep"), F.col("n"), F.col("first"))
    edge = out(local.filter("edge <> 0").join(found, ["pid", "edge"]), F.col("whole_keep"), F.col("whole_n"), F.col("first") & (F.col("pid") == F.col("first_pid")))
    return inner.unionByName(edge)


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each local run; the partition's first and last texts ride on its first and last runs."""
    pid = TaskContext.get().partitionId()
    held = norm = None  # the last run's first row, until it is known whether the run ends the partition
    lead = True

    def out(row, head, tail):
        n = row.num_rows
        return pa.RecordBatch.from_arrays([row.column("row"), pa.array([pid] * n, pa.int32()), head, tail], names=["row", "pid", "head", "tail"])

    for b in batches:
        texts = b.column("norm").to_pylist()
        new = [i for i, t in enumerate(texts) if (t != (texts[i - 1] if i else norm)) or (i == 0 and norm is None)]
        norm = texts[-1] if texts else norm
        if not new:
            continue
        rows = b.take(pa.array(new))
        if held is not None:
            yield out(held[0], held[1], pa.nulls(1, pa.string()))
        head = pa.array([texts[0] if lead and k == 0 else None for k in range(len(new))], pa.string())
        lead = False
        if len(new) > 1:
            yield out(rows.slice(0, len(new) - 1), head.slice(0, len(new) - 1), pa.nulls(len(new) - 1, pa.string()))
        held = (rows.slice(len(new) - 1), head.slice(len(new) - 1))
    if held is not None:
        yield out(held[0], held[1], pa.array([norm], pa.string()))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with its columns: of equal texts the one with the smallest id."""
    bounded_batches(df.sparkSession)
    ordered = _content_sorted(df, id_col, text_col, row_struct(df)).select("row", "norm")
    kind = df.schema.simpleString()
    local = written(ordered.mapInArrow(_firsts, f"row {kind}, pid int, head string, tail string"), "firsts")
    # A partition's first run continues the run before it if the nearest partition with rows ends in the same text.
    edges = local.filter(F.col("head").isNotNull() | F.col("tail").isNotNull())
    last = edges.filter(F.col("tail").isNotNull()).groupBy("tail").agg(F.min("pid").alias("tail_pid"))
    first = edges.filter(F.col("head").isNotNull()).select(F.col("pid").alias("head_pid"), "head")
    # Equal edge texts lie in neighbouring partitions with rows, and each such text ends all of them but the last.
    again = first.join(last, (F.col("head") == F.col("tail")) & (F.col("tail_pid") < F.col("head_pid"))).select("head_pid")
    rest = local.filter(F.col("head").isNull())
    lead = local.filter(F.col("head").isNotNull()).join(again, F.col("pid") == F.col("head_pid"), "left_anti")
    return unrow(rest.select("row").unionByName(lead.select("row")), df.columns)
