"""Shared plumbing: table access, scratch tables, Arrow batch size."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch. Texts can be very long, so batches stay small.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for very long texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


#: Whether a query's shuffle files are deleted when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where all of them are one machine, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN_DIRS:
            _OWN_DIRS[app] = tempfile.mkdtemp(prefix="lumaframe-")
            spark.sparkContext.setCheckpointDir(_OWN_DIRS[app])
        root = _OWN_DIRS[app]
    return root


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session ended before the interpreter did
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation,
    and row numbers given by a task are fixed once written. The shuffles that made it go
    at once, the table itself when the session's interpreter ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lumaframe-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


#: Parts into which the rows of one key are dealt by :func:`spread_join`.
PARTS = 64


def _part(by: Column) -> Column:
    return F.pmod(F.xxhash64(by), F.lit(PARTS)).cast("int")


def parts_of(by: Column) -> Column:
    """Aggregate: the set of parts that rows dealt by ``by`` are in, as bits; such sets are put together by ``bit_or``."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), _part(by))).alias("parts")


def spread_join(rows: DataFrame, facts: DataFrame, keys: list[str], by: Column) -> DataFrame:
    """``rows`` with the ``facts`` of their keys (one row a key), where one key may hold most of the rows.

    The rows of a key are dealt by ``by`` into parts. ``facts`` tells in its column ``parts`` (see :func:`parts_of`)
    which parts occur and is repeated for these, so that only keys with many rows are repeated. Null keys meet nothing.
    """
    occurring = F.filter(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda k: F.getbit("parts", k) == 1)
    spread = facts.withColumn("part", F.explode(occurring)).drop("parts")
    return rows.withColumn("part", _part(by)).join(spread, [*keys, "part"]).drop("part")


def table_columns(df: DataFrame, *names: str) -> None:
    """Say which columns are missing before any job runs."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")


def crc_bucket(id_col: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n`` (a null id: of the empty text)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % n


def row_struct(df: DataFrame, name: str = "row") -> Column:
    """All columns of ``df`` as one struct, so that no helper column can clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def unrow(df: DataFrame, columns: list[str], name: str = "row") -> DataFrame:
    return df.select(*[F.col(f"{name}.`{c}`").alias(c) for c in columns])
