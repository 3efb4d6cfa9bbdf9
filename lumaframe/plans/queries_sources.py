"""Queries of the data sources: what is written through ``format`` and read back, whole, in part and as a stream."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import datasource
from ..sources.files import new_folder, store
from ..streaming.stateful import drained
from . import oracles as O
from .queries_images import add
from .views import frames, table


def _folder(s: SparkSession, d: str, kind: str = "png") -> str:
    datasource.register(s)
    folder = new_folder(s, "frames")
    frames(s, d).write.format("frame_folder").option("path", folder).option("kind", kind).mode("append").save()
    return folder


def _totals(df: DataFrame) -> DataFrame:
    plane = F.slice("data", 1, F.col("h") * F.col("w"))
    return df.select(F.col("index").alias("idx"), "pts_us", "c", "h", "w", F.round(F.aggregate(plane, F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


def _sql(where: str = "true") -> str:
    return f"WITH {O.FRAMES} SELECT CAST(idx AS BIGINT) AS idx, CAST(idx * 40000 AS BIGINT) AS pts_us, 3::INTEGER AS c, 24::INTEGER AS h, 32::INTEGER AS w, round(sum({O.BYTE.format('v')} / 255.0), 6) AS total FROM fr WHERE {where} GROUP BY idx"


def _read(s: SparkSession, folder: str, **options: int) -> DataFrame:
    return s.read.format("frame_folder").options(path=folder, fps=25, **options).load()


add("frame_folder_round_trip", lambda s, d: _totals(_read(s, _folder(s, d), frames_per_partition=4)), _sql())
add("frame_folder_window", lambda s, d: _totals(_read(s, _folder(s, d, "qoi"), start=3, end=9)), _sql("idx >= 3 AND idx < 9"))
add("frame_folder_stream", lambda s, d: _totals(drained(s.readStream.format("frame_folder").options(path=_folder(s, d), fps=25).load())), _sql())


def _floats(s: SparkSession, d: str) -> DataFrame:
    """Embeddings written as flat files by the tasks, read by ranges of bytes."""
    datasource.register(s)
    folder = new_folder(s, "floats")

    def write(pdfs):
        import uuid

        where, path = store(folder)
        where.create_dir(path, recursive=True)
        for pdf in pdfs:
            with where.open_output_stream(f"{path}/{uuid.uuid4().hex}.bin") as out:
                out.write(np.concatenate([[i, *v] for i, v in zip(pdf["vec_id"], pdf["embedding"], strict=True)]).astype("<f8").tobytes())
            yield pdf[["vec_id"]]

    table(s, d, "embeddings").select("vec_id", "embedding").mapInPandas(write, "vec_id long").count()
    read = s.read.format("flat_floats").options(path=folder, columns=65, dtype="<f8", bytes_per_partition=8192).load()
    return read.select(F.col("data")[0].cast("long").alias("vec_id"), F.round(F.aggregate(F.slice("data", 2, 64), F.lit(0.0), lambda a, v: a + v), 5).alias("total"))


add("flat_floats_round_trip", _floats, "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total FROM embeddings")
