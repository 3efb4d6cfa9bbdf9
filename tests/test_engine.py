"""The fluent form and the SQL functions."""

import numpy as np
import pytest

from lumaframe.engine import ImageFrame
from lumaframe.functions.sql import register_functions
from lumaframe.schema import ROW, InvalidParameter

A = np.random.default_rng(7).random((3, 12, 10))


@pytest.fixture()
def frame(spark):
    return ImageFrame(spark.createDataFrame([(i, 3, 12, 10, (A * (i + 1) / 2).ravel().tolist()) for i in range(2)], ROW))


def test_chain(frame, tmp_path):
    edges = frame.grayscale().box_blur(kernel_size=3).canny(low=0.05, high=0.2).draw_line(p1=(0, 0), p2=(5, 5), color=(1, 1, 1))
    assert set(edges.pixels().select("v").distinct().toPandas().v) <= {0.0, 1.0}
    edges.save(str(tmp_path / "out"))
    assert len(list((tmp_path / "out").iterdir())) == 2
    assert frame.histogram().groupBy("image_id", "ch").sum("count").filter("`sum(count)` <> 120").count() == 0
    assert frame.absdiff(frame).pixels().filter("v <> 0").count() == 0
    assert frame.convert("rgb_to_hsv").threshold(0.5).component_stats().count() == 2
    with pytest.raises(AttributeError):
        frame.no_such_operator  # noqa: B018
    with pytest.raises(InvalidParameter):
        ImageFrame(frame.df.drop("c"))


def test_resize_reaches_the_scan(frame):
    assert frame.resize(width=5, height=4).df.select("w", "h").distinct().collect() == [(5, 4)]


def test_sql_functions(spark, frame):
    register_functions(spark)
    frame.df.createOrReplaceTempView("pictures")
    (row,) = spark.sql("SELECT lf_mean(data) AS m, lf_pixel(data, h, w, 1, 2, 3) AS p, lf_lerp(1, 3, 0.5) AS l, lf_bin(1) AS b FROM pictures WHERE image_id = 1").collect()
    assert abs(row.m - A.mean()) < 1e-9 and row.p == A[1, 2, 3] and row.l == 2 and row.b == 255
