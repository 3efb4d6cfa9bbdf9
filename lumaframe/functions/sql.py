"""Scalar and array functions for ``spark.sql``, as SQL functions that the optimizer inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "lf_clamp01(v DOUBLE)": ("DOUBLE", "least(greatest(v, 0D), 1D)"),
    "lf_lerp(a DOUBLE, b DOUBLE, t DOUBLE)": ("DOUBLE", "a + (b - a) * least(greatest(t, 0D), 1D)"),
    "lf_luma(r DOUBLE, g DOUBLE, b DOUBLE)": ("DOUBLE", "r * 0.299D + g * 0.587D + b * 0.114D"),
    "lf_linearize(v DOUBLE)": ("DOUBLE", "CASE WHEN v <= 0.04045D THEN v / 12.92D ELSE power((v + 0.055D) / 1.055D, 2.4D) END"),
    "lf_threshold(v DOUBLE, t DOUBLE, top DOUBLE)": ("DOUBLE", "CASE WHEN v > t THEN top ELSE 0D END"),
    "lf_bin(v DOUBLE)": ("INT", "CAST(least(greatest(v, 0D), 1D) * 255 AS INT)"),
    "lf_pixel(data ARRAY<DOUBLE>, h INT, w INT, ch INT, y INT, x INT)": ("DOUBLE", "element_at(data, (ch * h + y) * w + x + 1)"),
    "lf_mean(data ARRAY<DOUBLE>)": ("DOUBLE", "aggregate(data, 0D, (s, v) -> s + v) / size(data)"),
    "lf_duration(ms DOUBLE)": ("STRING", "format_string('%.2f ms', ms)"),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Creates the functions for the session and gives their names."""
    for head, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    return [head.split("(")[0] for head in FUNCTIONS]
