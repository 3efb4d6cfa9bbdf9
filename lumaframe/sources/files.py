"""Files that executors write, and the folder shared by all of them."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where driver and executors are one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="lumaframe-")
    return root


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lumaframe-{name}-{uuid.uuid4().hex}"


def store(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder given as a URI or a plain path."""
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


class Whole:
    """A file that is seen under its name only once it is complete, so that a task that is tried again leaves no half of it."""

    def __init__(self, folder: str, name: str):
        self.fs, self.folder = store(folder)
        self.name, self.part = f"{self.folder}/{name}", f"{self.folder}/_{uuid.uuid4().hex}.part"

    def __enter__(self):
        self.fs.create_dir(self.folder, recursive=True)
        self.out = self.fs.open_output_stream(self.part)
        return self.out

    def __exit__(self, kind, *_):
        self.out.close()
        if kind is None:
            self.fs.move(self.part, self.name)
        else:
            self.fs.delete_file(self.part)


#: Folders still to be deleted, by session.
_LEFT: dict[str, SparkSession] = {}


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session ended before the interpreter did
        pass


@atexit.register
def _delete_all() -> None:
    for path, spark in list(_LEFT.items()):
        _delete(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: lineage ends here, and numbers that a task gave stay as they are.

    The table goes with the interpreter, or earlier by :func:`used_up`.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    _LEFT[path] = spark
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def used_up(table: DataFrame) -> None:
    """Delete a table of :func:`written` that nothing reads any more, such as one of an earlier round."""
    for path, spark in list(_LEFT.items()):
        if any(f"/{path.rsplit('/', 1)[1]}/" in f for f in table.inputFiles()[:1]):
            _delete(spark, path)
            del _LEFT[path]
