"""Data sources for ``spark.read.format``: folders of frames, dealt by ranges of frames, and flat files of floats, dealt by ranges of bytes.

    register(spark)
    spark.read.format("frame_folder").option("path", folder).option("start", 100).option("end", 200).load()
    spark.readStream.format("frame_folder").option("path", folder).load()   # a camera's folder, frame by frame
    frames.write.format("frame_folder").option("path", folder).mode("append").save()

Only names are listed on the driver; files are read and decoded by the tasks. Writers put files aside first; they are moved to
their places once all tasks are done, and deleted if the write fails, so that a killed write leaves nothing under any frame's name.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..schema import FRAME, InvalidParameter, UnsupportedFormat
from . import codecs
from .files import store

#: Frames, and bytes, of one partition.
FRAMES, BYTES = 64, 64 << 20
NAME = re.compile(r"^(-?\d+)-(\d{12})\.(png|qoi)$")
ASIDE = "_aside"
DECODERS = {"png": codecs.read_png, "qoi": codecs.read_qoi}
ENCODERS = {"png": codecs.write_png, "qoi": codecs.write_qoi}


def _number(options: dict, key: str, default: int, least: int = 0) -> int:
    value = int(options.get(key, default))
    if value < least:
        raise InvalidParameter(f"{key} is at least {least}")
    return value


def frame_name(video: int, index: int, kind: str) -> str:
    return f"{video}-{index:012d}.{kind}"


def frame_names(folder: str) -> list[str]:
    """Names of a folder's frames, videos and then frames in order."""
    where, path = store(folder)
    info = where.get_file_info(path)
    if info.type != fs.FileType.Directory:
        raise UnsupportedFormat(f"no folder of frames: {folder}")
    found = [(int(m[1]), int(m[2]), f.base_name) for f in where.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File and (m := NAME.match(f.base_name))]
    return [name for *_, name in sorted(found)]


def is_opened(folder: str) -> bool:
    """Whether a camera's folder is there."""
    where, path = store(folder)
    return where.get_file_info(path).type == fs.FileType.Directory


@dataclass
class Frames(InputPartition):
    names: tuple[str, ...]


def _cut(names: list[str], size: int) -> list[Frames]:
    return [Frames(tuple(names[i : i + size])) for i in range(0, len(names), size)]


def _decoded(folder: str, names: tuple[str, ...], fps: float) -> Iterator[tuple]:
    where, path = store(folder)
    us = 1_000_000 / fps
    for name in names:
        m = NAME.match(name)
        with where.open_input_stream(f"{path}/{name}") as f:
            a = DECODERS[m[3]](f.read())
        index = int(m[2])
        yield (int(m[1]), index, int(index * us), int(us), index % 30 == 0, *a.shape, a.ravel().tolist())


class _Options:
    def __init__(self, options: dict):
        self.folder = options.get("path") or ""
        if not self.folder:
            raise InvalidParameter("a path is needed")
        self.size = _number(options, "frames_per_partition", FRAMES, 1)
        self.start, self.end = _number(options, "start", 0), _number(options, "end", 2**62)
        self.fps = float(options.get("fps", 30.0))
        self.kind = options.get("kind", "png")
        if self.fps <= 0 or self.kind not in ENCODERS:
            raise InvalidParameter("frames come at some rate, as png or qoi")


class FrameReader(DataSourceReader):
    """Frames ``start`` up to ``end`` of each video; others are never opened."""

    def __init__(self, options: _Options):
        self.o = options

    def partitions(self) -> list[InputPartition]:
        names = [n for n in frame_names(self.o.folder) if self.o.start <= int(NAME.match(n)[2]) < self.o.end]
        return _cut(names, self.o.size) or [Frames(())]

    def read(self, partition: Frames) -> Iterator[tuple]:
        yield from _decoded(self.o.folder, partition.names, self.o.fps)


class FrameStream(DataSourceStreamReader):
    """New frames of a folder. An offset is the last frame's (video, index); frames come with growing numbers, so a late one of an earlier number is not seen."""

    def __init__(self, options: _Options):
        self.o = options

    def initialOffset(self) -> dict:
        return {"video": -(2**62), "index": -1}

    def latestOffset(self) -> dict:
        names = frame_names(self.o.folder)
        if not names:
            return self.initialOffset()
        m = NAME.match(names[-1])
        return {"video": int(m[1]), "index": int(m[2])}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        place = lambda n: (int(NAME.match(n)[1]), int(NAME.match(n)[2]))
        after, last = (start["video"], start["index"]), (end["video"], end["index"])
        return _cut([n for n in frame_names(self.o.folder) if after < place(n) <= last], self.o.size)

    def read(self, partition: Frames) -> Iterator[tuple]:
        yield from _decoded(self.o.folder, partition.names, self.o.fps)


@dataclass
class Written(WriterCommitMessage):
    names: tuple[str, ...]


class FrameWriter(DataSourceWriter):
    """One file a frame. Files of all tasks lie in a folder of this write until it is committed; a task that is tried again writes other files."""

    def __init__(self, options: _Options, schema: StructType, overwrite: bool):
        self.o, self.overwrite, self.aside = options, overwrite, f"{ASIDE}/{uuid.uuid4().hex}"
        self.at = [schema.names.index(c) for c in ("video_id", "index", "c", "h", "w", "data")]

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        where, path = store(self.o.folder)
        part, names = f"{self.aside}/{uuid.uuid4().hex}", []
        where.create_dir(f"{path}/{part}", recursive=True)
        for row in iterator:
            video, index, c, h, w, data = (row[i] for i in self.at)
            if video is None or index is None or not 0 <= index < 10**12:
                raise InvalidParameter("a frame needs a video and a number")
            name = frame_name(video, index, self.o.kind)
            with where.open_output_stream(f"{path}/{part}/{name}") as out:
                out.write(ENCODERS[self.o.kind](np.asarray(data, float).reshape(c, h, w)))
            names.append(f"{part}/{name}")
        return Written(tuple(names))

    def commit(self, messages: list) -> None:
        where, path = store(self.o.folder)
        new = {}
        for m in messages:
            for name in m.names if m is not None else ():
                if new.setdefault(name.rsplit("/", 1)[1], name) != name:
                    self._drop()
                    raise InvalidParameter(f"two frames are named {name.rsplit('/', 1)[1]}")
        for last, name in new.items():
            where.move(f"{path}/{name}", f"{path}/{last}")
        if self.overwrite:
            for name in frame_names(self.o.folder):
                if name not in new:
                    where.delete_file(f"{path}/{name}")
        self._drop()

    def abort(self, messages: list) -> None:
        self._drop()

    def _drop(self) -> None:
        where, path = store(self.o.folder)
        if where.get_file_info(f"{path}/{self.aside}").type == fs.FileType.Directory:
            where.delete_dir(f"{path}/{self.aside}")
        if where.get_file_info(f"{path}/{ASIDE}").type == fs.FileType.Directory and not where.get_file_info(fs.FileSelector(f"{path}/{ASIDE}")):
            where.delete_dir(f"{path}/{ASIDE}")


class FrameFolder(DataSource):
    """Options: path, fps, start, end, frames_per_partition, kind (png or qoi, of what is written)."""

    @classmethod
    def name(cls) -> str:
        return "frame_folder"

    def schema(self) -> StructType:
        return FRAME

    def reader(self, schema: StructType) -> DataSourceReader:
        return FrameReader(_Options(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return FrameStream(_Options(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return FrameWriter(_Options(self.options), schema, overwrite)


# --- flat files of floats -----------------------------------------------------------------


@dataclass
class Bytes(InputPartition):
    file: str
    first: int
    rows: int


class FloatReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.columns = options.get("path") or "", _number(options, "columns", 0, 1)
        self.kind = np.dtype(options.get("dtype", "<f4"))
        self.bytes = _number(options, "bytes_per_partition", BYTES, 1)

    def partitions(self) -> list[InputPartition]:
        where, path = store(self.folder)
        info = where.get_file_info(path)
        files = [info] if info.type == fs.FileType.File else [f for f in where.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
        wide, out = self.columns * self.kind.itemsize, []
        for f in sorted(files, key=lambda f: f.path):
            rows, rest = divmod(f.size, wide)
            if rest:
                raise UnsupportedFormat(f"{f.path} is no whole number of rows of {wide} bytes")
            step = max(1, self.bytes // wide)
            out += [Bytes(f.path, k, min(step, rows - k)) for k in range(0, rows, step)]
        return out or [Bytes("", 0, 0)]

    def read(self, partition: Bytes) -> Iterator[tuple]:
        if not partition.rows:
            return
        where, _ = store(self.folder)
        wide = self.columns * self.kind.itemsize
        with where.open_input_file(partition.file) as f:
            f.seek(partition.first * wide)
            values = np.frombuffer(f.read(partition.rows * wide), self.kind).reshape(-1, self.columns).astype(float)
        for k, row in enumerate(values):
            yield partition.file.rsplit("/", 1)[-1], partition.first + k, row.tolist()


class FlatFloats(DataSource):
    """Rows of ``columns`` floats. Options: path (a file or a folder), columns, dtype (<f4), bytes_per_partition."""

    @classmethod
    def name(cls) -> str:
        return "flat_floats"

    def schema(self) -> str:
        return "file string, row long, data array<double>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return FloatReader(self.options)


def register(spark: SparkSession) -> None:
    for source in (FrameFolder, FlatFloats):
        spark.dataSource.register(source)
