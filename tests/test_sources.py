"""Codecs, readers and writers, round trips."""

import json
import struct
import zlib

import numpy as np
import pytest

from lumaframe.schema import DimensionMismatch, ROW, UnsupportedFormat, to_images, to_pixels
from lumaframe.sources import codecs
from lumaframe.sources import images as sources

RGB = np.random.default_rng(3).integers(0, 256, (3, 9, 11)) / 255.0


def test_codecs_round_trip():
    assert np.array_equal(codecs.read_png(codecs.write_png(RGB)), codecs.from_rgb8(codecs.to_rgb8(RGB)))
    assert np.array_equal(codecs.read_qoi(codecs.write_qoi(RGB)), codecs.from_rgb8(codecs.to_rgb8(RGB)))
    frames = codecs.read_gif(codecs.write_gif([RGB, RGB[:, ::-1]], [40, 120]))
    assert [d for _, d in frames] == [40, 120]
    assert np.abs(frames[0][0] - RGB).max() <= 0.1 + 1e-9


def test_long_gif():
    a = np.random.default_rng(5).random((3, 120, 130))
    ((b, _),) = codecs.read_gif(codecs.write_gif([a], [10]))
    assert np.abs(a - b).max() <= 0.11


def test_not_an_image():
    with pytest.raises(UnsupportedFormat):
        codecs.read_png(b"nothing")


def test_images_and_videos(spark, tmp_path):
    df = spark.createDataFrame([(1, 3, 9, 11, RGB.ravel().tolist())], ROW)
    sources.save_images(df, str(tmp_path / "img"))
    (back,) = sources.read_images(spark, str(tmp_path / "img")).collect()
    assert (back["c"], back["h"], back["w"]) == (3, 9, 11)
    assert np.abs(np.array(back["data"]) - RGB.ravel()).max() < 1 / 254
    video = sources.from_frames(spark, [RGB, RGB * 0.5, RGB * 0.25], fps=25)
    sources.write_video(video, str(tmp_path / "v" / "a.gif"))
    got = sources.read_animation(spark, str(tmp_path / "v" / "a.gif")).orderBy("index").collect()
    assert [r["pts_us"] for r in got] == [0, 40_000, 80_000]
    sources.write_video(video, str(tmp_path / "seq" / "f.png"))
    assert sources.read_image_sequence(spark, str(tmp_path / "seq"), "f_").count() == 3
    uneven = video.unionByName(sources.from_frames(spark, [RGB[:, :4]]))
    with pytest.raises(DimensionMismatch):
        sources.write_video(uneven, str(tmp_path / "b.gif"))


def test_weights(spark, tmp_path):
    raw = np.arange(6, dtype="<f4").tobytes()
    head = json.dumps({"w": {"dtype": "F32", "shape": [2, 3], "data_offsets": [0, 24]}}).encode()
    (tmp_path / "m.safetensors").write_bytes(struct.pack("<Q", len(head)) + head + raw)
    (row,) = sources.read_safetensors(spark, str(tmp_path / "m.safetensors")).collect()
    assert (row["name"], row["shape"], row["data"]) == ("w", [2, 3], [0, 1, 2, 3, 4, 5])
    (tmp_path / "m.bin").write_bytes(raw)
    (row,) = sources.read_bin(spark, str(tmp_path / "m.bin"), 2, 4).collect()
    assert row["data"] == [0, 1, 2, 3, 4, 5, 0, 0]


def test_rows_and_pixels(spark):
    df = spark.createDataFrame([(1, 3, 9, 11, RGB.ravel().tolist())], ROW)
    (back,) = to_images(to_pixels(df)).collect()
    assert back["data"] == RGB.ravel().tolist() and (back["c"], back["h"], back["w"]) == (3, 9, 11)


def test_apng():
    """Two frames, the second a part drawn over the first."""
    whole, part = np.zeros((3, 4, 5)), np.ones((3, 2, 2))

    def chunks(png):
        at, out = 8, []
        while at < len(png):
            (n,) = struct.unpack(">I", png[at : at + 4])
            out.append((png[at + 4 : at + 8], png[at + 8 : at + 8 + n]))
            at += 12 + n
        return out

    control = lambda seq, w, h, x, y: codecs._chunk(b"fcTL", struct.pack(">IIIIIHHBB", seq, w, h, x, y, 1, 20, 0, 0))
    first = codecs.write_png(whole)
    head, data = dict(chunks(first))[b"IHDR"], dict(chunks(first))[b"IDAT"]
    more = dict(chunks(codecs.write_png(part)))[b"IDAT"]
    file = first[:8] + codecs._chunk(b"IHDR", head) + codecs._chunk(b"acTL", struct.pack(">II", 2, 0)) + control(0, 5, 4, 0, 0) + codecs._chunk(b"IDAT", data) + control(1, 2, 2, 1, 1) + codecs._chunk(b"fdAT", struct.pack(">I", 2) + more) + codecs._chunk(b"IEND", b"")
    (a, d), (b, _) = codecs.read_apng(file)
    assert d == 50 and not a.any() and b[:, 1:3, 1:3].all() and b.sum() == 12
    assert len(codecs.read_apng(first)) == 1


def _png(color: int, px: np.ndarray, *chunks: tuple[bytes, bytes]) -> bytes:
    h, w = px.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), px.reshape(h, -1)], 1)
    head = codecs._chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, color, 0, 0, 0))
    return b"\x89PNG\r\n\x1a\n" + head + b"".join(codecs._chunk(*c) for c in chunks) + codecs._chunk(b"IDAT", zlib.compress(rows.tobytes())) + codecs._chunk(b"IEND", b"")


def test_small_images_are_read_in_few_tasks_as_spark_reads_them(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(15)
    px = lambda *shape: rng.integers(0, 256, shape, np.uint8)
    whole = {f"k{i}.png": codecs.write_png(rng.random((3, 2, 3))) for i in range(600)}
    whole |= {"gray.png": _png(0, px(4, 5, 1)), "rgb.png": _png(2, px(4, 5, 3)), "palette.png": _png(3, px(4, 5, 1) % 7, (b"PLTE", px(21).tobytes())), "ga.png": _png(4, px(4, 5, 2)), "rgba.png": _png(6, px(4, 5, 4))}
    for name, data in (whole | {"cut.png": whole["rgb.png"][:60]}).items():
        (tmp_path / name).write_bytes(data)
    got = sources.read_images(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() <= sources.READERS * spark.sparkContext.defaultParallelism
    assert sources.read_animation(spark, str(tmp_path)).rdd.getNumPartitions() <= sources.READERS * spark.sparkContext.defaultParallelism
    rows = lambda df: {r["path"].rsplit("/", 1)[1]: tuple(r) for r in df.collect()}
    small = rows(got)
    monkeypatch.setattr(sources, "SMALL", 0)
    assert small.keys() == whole.keys() and small == rows(sources.read_images(spark, str(tmp_path)))


def test_one_large_image_leaves_all_to_the_image_source(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(codecs.write_png(np.full((3, 2, 2), 0.4)))
    (tmp_path / "b.png").write_bytes(codecs.write_png(np.full((3, 90, 90), 0.2)))
    (tmp_path / "c.gif").write_bytes(codecs.write_gif([np.ones((3, 4, 4))], [0]))
    got = {r["path"].rsplit("/", 1)[1]: (r["c"], r["h"], r["w"]) for r in sources.read_images(spark, str(tmp_path)).collect()}
    assert got == {"a.png": (3, 2, 2), "b.png": (3, 90, 90), "c.gif": (3, 4, 4)}
    assert sources.read_images(spark, str(tmp_path), "a*").count() == 1


def test_frames_of_many_files_come_together(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"{k}.gif").write_bytes(codecs.write_gif([np.full((1, 2, 2), i / 4) for i in range(k + 1)], [100 + 10 * i for i in range(k + 1)]))
    (tmp_path / "s.qoi").write_bytes(codecs.write_qoi(np.zeros((1, 3, 2))))
    videos = {}
    for r in sources.read_animation(spark, str(tmp_path)).collect():
        videos.setdefault(r["video_id"], []).append((r["index"], r["pts_us"], r["duration_us"], len(r["data"])))
    want = [[(i, sum(100 + 10 * j for j in range(i)) * 1000, (100 + 10 * i) * 1000, 12) for i in range(k + 1)] for k in range(5)] + [[(0, 0, 0, 18)]]
    assert sorted(sorted(v) for v in videos.values()) == sorted(want)
