"""Queries of pixel, colour, geometric, neighbourhood and histogram operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color, pixel
from ..operators import filters, geometry, histograms
from ..schema import to_pixels
from . import oracles as O
from .kernels import apply_stack, measure
from .views import colors, img8, img8rgb

Query = Callable[[SparkSession, str], DataFrame]
#: Keeps colour values off the ties of rounding, which inputs of few digits would otherwise hit.
NUDGE = 1.7e-12
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _out(images: DataFrame) -> DataFrame:
    """Pixels, rounded; adding 0 turns -0 into 0."""
    return to_pixels(images).withColumn("v", F.round("v", 6) + 0.0)


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def column_query(name: str, make: Callable[[DataFrame], DataFrame], sql: str | None, rgb: bool = False) -> None:
    add(name, lambda s, d: _out(make((img8rgb if rgb else img8)(s, d))), sql)


def kernel_query(name: str, run: Callable, sql: str | None = None, rgb: bool = False, **options) -> None:
    add(name, lambda s, d: _out(apply_stack((img8rgb if rgb else img8)(s, d), lambda stack: run(stack, **options))), sql)


def _data(f) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumn("data", f(F.col("data")))


def _upside_down(df: DataFrame) -> DataFrame:
    """With the column ``other``: the image upside down, the second operand of binary operators."""
    return df.withColumn("other", F.flatten(F.reverse(F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda y: F.slice("data", y * F.col("w") + 1, F.col("w"))))))


def _pair(f) -> Callable[[DataFrame], DataFrame]:
    return lambda df: _upside_down(df).withColumn("data", f(F.col("data"), F.col("other"))).drop("other")


# --- per pixel ------------------------------------------------------------------

for _name, _f, _sql in (
    ("add", pixel.add, "v + u"),
    ("subtract", pixel.subtract, "v - u"),
    ("multiply", pixel.multiply, "v * u"),
    ("divide", pixel.divide, "v / u"),
    ("absdiff", pixel.absdiff, "abs(v - u)"),
    ("bitwise_and", pixel.bitwise_and, f"({O.BYTE.format('v')} & {O.BYTE.format('u')}) / 255.0"),
    ("bitwise_or", pixel.bitwise_or, f"({O.BYTE.format('v')} | {O.BYTE.format('u')}) / 255.0"),
    ("bitwise_xor", pixel.bitwise_xor, f"xor({O.BYTE.format('v')}, {O.BYTE.format('u')}) / 255.0"),
    ("add_weighted", lambda a, b: pixel.add_weighted(a, 0.7, b, 0.2, 0.05), "v * 0.7 + u * 0.2 + 0.05"),
    ("vector_add", pixel.vector_add, "v + u"),
    ("copy_to", lambda a, b: pixel.copy_to(a, b, pixel.threshold(a, 0.55, 1.0)), "CASE WHEN v > 0.55 THEN v ELSE u END"),
):
    column_query(_name, _pair(_f), O.pairwise(_sql))
column_query("bitwise_not", _data(pixel.bitwise_not), O.pixelwise(f"(255 - {O.BYTE.format('v')}) / 255.0"))
column_query("convert_scale_abs", _data(lambda a: pixel.convert_scale_abs(a, 1.5, -0.6)), O.pixelwise("least(abs(v * 1.5 - 0.6), 1)"))
column_query("apply_lut", _data(lambda a: pixel.apply_lut(a, [(k / 255) ** 2 for k in range(256)])), O.pixelwise(f"pow({O.BYTE.format('v')} / 255.0, 2)"))
for _kind, _sql in (("binary", "CASE WHEN v > 0.5 THEN 0.9 ELSE 0 END"), ("binary_inv", "CASE WHEN v > 0.5 THEN 0 ELSE 0.9 END"), ("trunc", "CASE WHEN v > 0.5 THEN 0.5 ELSE v END"), ("to_zero", "CASE WHEN v > 0.5 THEN v ELSE 0 END"), ("to_zero_inv", "CASE WHEN v > 0.5 THEN 0 ELSE v END")):
    column_query(f"threshold_{_kind}", _data(lambda a, k=_kind: pixel.threshold(a, 0.5, 0.9, k)), O.pixelwise(_sql))


def _cols() -> tuple:
    return F.col("data"), F.col("c"), F.col("h"), F.col("w")


column_query(
    "in_range",
    lambda df: df.withColumn("data", pixel.in_range(F.col("data"), 3, F.col("h"), F.col("w"), [0.42] * 3, [0.6] * 3)).withColumn("c", F.lit(1)),
    O.image("SELECT image_id, 0 AS ch, y, x, CASE WHEN bool_and(v BETWEEN 0.42 AND 0.6) THEN 1 ELSE 0 END AS v FROM px GROUP BY image_id, y, x", rgb=True),
    rgb=True,
)
column_query(
    "normalize",
    lambda df: df.withColumn("data", pixel.normalize(*_cols(), -1.0, 2.0)),
    O.image("SELECT image_id, ch, y, x, (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) * 3 - 1 AS v FROM px WINDOW w AS (PARTITION BY image_id, ch)", rgb=True),
    rgb=True,
)
_GRAY = "SELECT image_id, 0 AS ch, y, x, sum(v * CASE ch WHEN 0 THEN 0.299 WHEN 1 THEN 0.587 ELSE 0.114 END) AS v FROM px GROUP BY image_id, y, x"
column_query("grayscale", lambda df: df.withColumn("data", pixel.grayscale(*_cols())).withColumn("c", F.lit(1)), O.image(_GRAY, rgb=True), rgb=True)
column_query("to_rgb", lambda df: df.withColumn("data", pixel.to_rgb(F.col("data"), F.col("c"))).withColumn("c", F.lit(3)), O.image("SELECT image_id, k AS ch, y, x, v FROM px, (SELECT unnest(range(3)) AS k)"))
column_query("split_channels", lambda df: df.withColumn("data", pixel.split_channels(*_cols())[1]).withColumn("c", F.lit(1)), O.image("SELECT image_id, 0 AS ch, y, x, v FROM px WHERE ch = 1", rgb=True), rgb=True)


def _swapped(df: DataFrame) -> DataFrame:
    p = pixel.split_channels(*_cols())
    return df.withColumn("data", pixel.merge_channels(p[2], p[1], p[0]))


column_query("merge_channels", _swapped, O.image("SELECT image_id, 2 - ch AS ch, y, x, v FROM px", rgb=True), rgb=True)


def _blob(df: DataFrame) -> DataFrame:
    small = apply_stack(df, geometry.resize, width=4, height=4)
    return small.withColumn("data", pixel.preprocess_blob(F.col("data"), 3, F.col("h"), F.col("w"), 2.0, [0.1, 0.2, 0.3], True))


column_query(
    "blob_from_image",
    _blob,
    O.image("SELECT image_id, 2 - ch AS ch, y // 2 AS y, x // 2 AS x, (v - CASE 2 - ch WHEN 0 THEN 0.1 WHEN 1 THEN 0.2 ELSE 0.3 END) * 2 AS v FROM px WHERE y % 2 = 0 AND x % 2 = 0", rgb=True),
    rgb=True,
)

# --- colour ------------------------------------------------------------------------


def _color(name: str) -> Query:
    def query(s: SparkSession, d: str) -> DataFrame:
        df, made = colors(s, d), tuple(F.col(k) for k in "rgb")
        if not name.startswith("rgb"):  # there and back
            there = color.CODES["rgb_to_" + name.split("_to_")[0]](*made)
            df = df.select(*"rgb", *[v.alias(f"t{k}") for k, v in enumerate(there)])
            made = tuple(F.col(f"t{k}") for k in range(len(there)))
        out = color.CODES[name](*made)
        return df.select(*[F.round(F.col(k), 6).alias(k) for k in "rgb"], *[(F.round(v + NUDGE, 9) + 0.0).alias(f"c{k}") for k, v in enumerate(out)])

    return query


def _color_sql(parts: list[str], *steps: str) -> str:
    body = "cl"
    ctes = [O.COLORS]
    for k, step in enumerate(steps):
        ctes.append(f"s{k} AS (SELECT *, {step} FROM {body})")
        body = f"s{k}"
    return f"WITH {', '.join(ctes)} SELECT round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b, " + ", ".join(f"round({p} + {NUDGE!r}, 9) + 0.0 AS c{k}" for k, p in enumerate(parts)) + f" FROM {body}"


_HUE = (
    "greatest(r, g, b) AS mx, least(r, g, b) AS mn",
    "mx - mn AS d",
    "CASE WHEN d < 1e-6 THEN 0 WHEN mx = r THEN fmod((g - b) / d, 6) WHEN mx = g THEN (b - r) / d + 2 ELSE (r - g) / d + 4 END AS six",
    "CASE WHEN six < 0 THEN six * 60 + 360 ELSE six * 60 END / 360 AS hue, (mx + mn) / 2 AS light",
    "CASE WHEN d < 1e-6 OR abs(2 * light - 1) = 1 THEN 0 ELSE d / (1 - abs(2 * light - 1)) END AS sl",
)
_LIN = "CASE WHEN {0} <= 0.04045 THEN {0} / 12.92 ELSE pow(({0} + 0.055) / 1.055, 2.4) END"
_XYZ = (
    f"{_LIN.format('r')} AS lr, {_LIN.format('g')} AS lg, {_LIN.format('b')} AS lb",
    ", ".join(f"lr * {a!r} + lg * {b!r} + lb * {c!r} AS {n}" for (a, b, c), n in zip(color.RGB_TO_XYZ, ("cx", "cy", "cz"), strict=True)),
)
_F = "CASE WHEN {0} > 216.0 / 24389 THEN cbrt({0}) ELSE ({0} * (24389.0 / 27) + 16) / 116 END"
_LAB = (*_XYZ, f"{_F.format('(cx / 0.95047)')} AS fx, {_F.format('cy')} AS fy, {_F.format('(cz / 1.08883)')} AS fz")
_CLAMP = "least(greatest({}, 0), 1)"
_YUV = [_CLAMP.format("r * 0.299 + g * 0.587 + b * 0.114"), _CLAMP.format("r * -0.14713 - g * 0.28886 + b * 0.436 + 0.5"), _CLAMP.format("r * 0.615 - g * 0.51499 - b * 0.10001 + 0.5")]
_YCC = ("r * 0.299 + g * 0.587 + b * 0.114 AS yy", f"{_CLAMP.format('yy')} AS y0, {_CLAMP.format('(r - yy) * 0.713 + 0.5')} AS cr, {_CLAMP.format('(b - yy) * 0.564 + 0.5')} AS cb")
_CMYK = ("1 - greatest(r, g, b) AS k",)
_INK = "CASE WHEN 1 - k < 1e-6 THEN 0 ELSE (1 - {} - k) / (1 - k) END"
for _name, _sql in {
    "rgb_to_hsv": _color_sql(["hue", "CASE WHEN mx < 1e-6 THEN 0 ELSE d / mx END", "mx"], *_HUE),
    "rgb_to_hls": _color_sql(["hue", "light", "sl"], *_HUE),
    "rgb_to_hsl": _color_sql(["hue", _CLAMP.format("sl"), "light"], *_HUE),
    "rgb_to_xyz": _color_sql(["cx", "cy", "cz"], *_XYZ),
    "rgb_to_lab": _color_sql(["(fy * 116 - 16) / 100", "((fx - fy) * 500 + 128) / 255", "((fy - fz) * 200 + 128) / 255"], *_LAB),
    "rgb_to_yuv": _color_sql(_YUV),
    "rgb_to_ycrcb": _color_sql(["y0", "cr", "cb"], *_YCC),
    "rgb_to_cmyk": _color_sql([_INK.format("r"), _INK.format("g"), _INK.format("b"), "k"], *_CMYK),
    # there and back: the input, but for spaces that clamp
    "hsv_to_rgb": _color_sql(["r", "g", "b"]),
    "hls_to_rgb": _color_sql(["r", "g", "b"]),
    "hsl_to_rgb": _color_sql(["r", "g", "b"]),
    "cmyk_to_rgb": _color_sql(["r", "g", "b"]),
    "ycrcb_to_rgb": _color_sql([_CLAMP.format("y0 + (cr - 0.5) * 1.402"), _CLAMP.format("y0 - (cr - 0.5) * 0.714 - (cb - 0.5) * 0.344"), _CLAMP.format("y0 + (cb - 0.5) * 1.772")], *_YCC),
    "yuv_to_rgb": _color_sql([_CLAMP.format("y0 + (v0 - 0.5) * 1.13983"), _CLAMP.format("y0 - (u0 - 0.5) * 0.39465 - (v0 - 0.5) * 0.58060"), _CLAMP.format("y0 + (u0 - 0.5) * 2.03211")], f"{_YUV[0]} AS y0, {_YUV[1]} AS u0, {_YUV[2]} AS v0"),
    "xyz_to_rgb": None,
    "lab_to_rgb": None,
}.items():
    add(_name, _color(_name), _sql)
for _name in ("xyz_to_rgb", "lab_to_rgb"):
    _rgb = ", ".join(f"lr * {a!r} + lg * {b!r} + lb * {c!r} AS {n}" for (a, b, c), n in zip(color.RGB_TO_XYZ, ("cx", "cy", "cz"), strict=True))
    _inv = ", ".join(f"cx * {a!r} + cy * {b!r} + cz * {c!r} AS {n}" for (a, b, c), n in zip(color.XYZ_TO_RGB, ("br", "bg", "bb"), strict=True))
    _enc = "least(greatest(CASE WHEN {0} <= 0.0031308 THEN {0} * 12.92 ELSE pow(greatest({0}, 0), 1 / 2.4) * 1.055 - 0.055 END, 0), 1)"
    ORACLES[_name] = _color_sql([_enc.format("br"), _enc.format("bg"), _enc.format("bb")], _XYZ[0], _rgb, _inv)
column_query("convert_color_images", lambda df: color.convert(df, "rgb_to_ycrcb"), O.image(
    """SELECT image_id, k AS ch, y, x, CASE k WHEN 0 THEN yy WHEN 1 THEN least(greatest((r - yy) * 0.713 + 0.5, 0), 1) ELSE least(greatest((b - yy) * 0.564 + 0.5, 0), 1) END AS v
    FROM (SELECT *, r * 0.299 + g * 0.587 + b * 0.114 AS yy FROM (SELECT image_id, y, x, max(v) FILTER (ch = 0) AS r, max(v) FILTER (ch = 1) AS g, max(v) FILTER (ch = 2) AS b FROM px GROUP BY image_id, y, x)), (SELECT unnest(range(3)) AS k)""", rgb=True), rgb=True)

# --- geometry ----------------------------------------------------------------------

kernel_query("resize", geometry.resize, O.image("SELECT image_id, ch, ny AS y, nx AS x, v FROM px, (SELECT unnest(range(5)) AS ny), (SELECT unnest(range(11)) AS nx) WHERE px.y = ny * 8 // 5 AND px.x = nx * 8 // 11"), width=11, height=5)
kernel_query("crop", geometry.crop, O.image("SELECT image_id, ch, y - 1 AS y, x - 2 AS x, v FROM px WHERE y BETWEEN 1 AND 4 AND x BETWEEN 2 AND 6"), x=2, y=1, width=5, height=4)
kernel_query("flip_horizontal", geometry.flip, O.image("SELECT image_id, ch, y, 7 - x AS x, v FROM px"), horizontal=True, vertical=False)
kernel_query("flip_both", geometry.flip, O.image("SELECT image_id, ch, 7 - y AS y, 7 - x AS x, v FROM px"), horizontal=True, vertical=True)
kernel_query("rotate_90", geometry.rotate, O.image("SELECT image_id, ch, x AS y, 7 - y AS x, v FROM px"), angle=90)
kernel_query("rotate_180", geometry.rotate, O.image("SELECT image_id, ch, 7 - y AS y, 7 - x AS x, v FROM px"), angle=180)
kernel_query("rotate_270", geometry.rotate, O.image("SELECT image_id, ch, 7 - x AS y, y AS x, v FROM px"), angle=270)
kernel_query("transpose", geometry.transpose, O.image("SELECT image_id, ch, x AS y, y AS x, v FROM px"))
_GRID = "(SELECT unnest(range(8)) AS ty), (SELECT unnest(range(8)) AS tx), (SELECT DISTINCT image_id, ch FROM px)"


def _warp_sql(sx: str, sy: str) -> str:
    rnd = lambda e: f"trunc(({e}) + CASE WHEN ({e}) < 0 THEN -0.5 ELSE 0.5 END)"
    return O.image(f"""SELECT g.image_id, g.ch, g.ty AS y, g.tx AS x, coalesce(px.v, 0) AS v FROM (SELECT * FROM {_GRID}) g
      LEFT JOIN px ON px.image_id = g.image_id AND px.ch = g.ch AND px.x = {rnd(sx)} AND px.y = {rnd(sy)}""")


kernel_query("warp_affine", geometry.warp_affine, _warp_sql("(tx - 1.25) / 2.0", "(ty - 0.75) / 1.6"), m=[[2.0, 0, 1.25], [0, 1.6, 0.75]], width=8, height=8)
kernel_query("warp_perspective", geometry.warp_perspective, None, m=[[1.1, 0.1, 0.3], [0.05, 0.9, 0.2], [0.01, 0.02, 1.0]], width=8, height=8)
kernel_query("remap", geometry.remap, _warp_sql("(7 - tx) * 0.9", "ty * 0.7 + 1"), map_x=[[(7 - x) * 0.9 for x in range(8)]] * 8, map_y=[[y * 0.7 + 1] * 8 for y in range(8)])
kernel_query("undistort", geometry.undistort, _warp_sql("(tx - 3.5) / 6 * (1 + 0.1 * (pow((tx - 3.5) / 6, 2) + pow((ty - 3.5) / 6, 2))) * 6 + 3.5", "(ty - 3.5) / 6 * (1 + 0.1 * (pow((tx - 3.5) / 6, 2) + pow((ty - 3.5) / 6, 2))) * 6 + 3.5"), camera=[[6, 0, 3.5], [0, 6, 3.5], [0, 0, 1]], distortion=[0.1])
_B5 = [[a * b / 256 for b in (1, 4, 6, 4, 1)] for a in (1, 4, 6, 4, 1)]
kernel_query("pyr_down", geometry.pyr_down, O.image(f"SELECT image_id, ch, y // 2 AS y, x // 2 AS x, v FROM ({O.correlate('b5', 'clamp')}) WHERE y % 2 = 0 AND x % 2 = 0", O.kernel_cte("b5", _B5)))
kernel_query("pyr_up", geometry.pyr_up, O.image(
    """SELECT g.image_id, g.ch, g.ty AS y, g.tx AS x, coalesce(sum(px.v * k.w * 4), 0) AS v FROM (SELECT * FROM (SELECT unnest(range(15)) AS ty), (SELECT unnest(range(15)) AS tx), (SELECT DISTINCT image_id, ch FROM px)) g
    CROSS JOIN b5 k JOIN px ON px.image_id = g.image_id AND px.ch = g.ch AND px.y * 2 = g.ty + k.dy AND px.x * 2 = g.tx + k.dx GROUP BY ALL""", O.kernel_cte("b5", _B5)))
_G3 = [[float(a * b) for b in filters.gaussian_kernel(3, 1.0)] for a in filters.gaussian_kernel(3, 1.0)]
kernel_query("gaussian_pyramid", lambda s: geometry.gaussian_pyramid(s, 3)[1], O.image(f"SELECT image_id, ch, y // 2 AS y, x // 2 AS x, v FROM ({O.correlate('g3', 'clamp')}) WHERE y % 2 = 0 AND x % 2 = 0", O.kernel_cte("g3", _G3)))
kernel_query("integral_image", geometry.integral_image, O.image(
    "SELECT g.image_id, 0 AS ch, g.ty AS y, g.tx AS x, coalesce(sum(px.v), 0) AS v FROM (SELECT * FROM (SELECT unnest(range(9)) AS ty), (SELECT unnest(range(9)) AS tx), (SELECT DISTINCT image_id FROM px)) g LEFT JOIN px ON px.image_id = g.image_id AND px.y < g.ty AND px.x < g.tx GROUP BY ALL"))

# --- neighbourhoods ------------------------------------------------------------------

kernel_query("box_blur", filters.box_blur, O.image(O.neighbours("avg(b.v)", 1)), kernel_size=3)
kernel_query("gaussian_blur", filters.gaussian_blur, O.image(O.correlate("g3", "clamp"), O.kernel_cte("g3", _G3)), kernel_size=3, sigma=1.0)
kernel_query("median_blur", filters.median_blur, O.image(O.neighbours("list_sort(list(b.v))[len(list(b.v)) // 2 + 1]", 1)), kernel_size=3)
_EMBOSS = [[-2.0, -1.0, 0.0], [-1.0, 1.0, 1.0], [0.0, 1.0, 2.0]]
kernel_query("filter2d", filters.filter2d, O.image(f"SELECT image_id, ch, y, x, v + 0.1 AS v FROM ({O.correlate('kk', 'zero')})", O.kernel_cte("kk", _EMBOSS)), kernel=_EMBOSS, delta=0.1)
_LOG = filters.log_kernel(0.8).tolist()
kernel_query("laplacian_of_gaussian", filters.laplacian_of_gaussian, O.image(O.correlate("kk", "clamp"), O.kernel_cte("kk", _LOG)), sigma=0.8)
kernel_query("bilateral_filter", filters.bilateral_filter, O.image(O.neighbours(
    "sum(b.v * exp(-(pow(a.y - b.y, 2) + pow(a.x - b.x, 2)) / 4.5) * exp(-pow(b.v - a.v, 2) / 0.02)) / sum(exp(-(pow(a.y - b.y, 2) + pow(a.x - b.x, 2)) / 4.5) * exp(-pow(b.v - a.v, 2) / 0.02))", 2)), d=5, sigma_color=0.1, sigma_space=1.5)
_SEP = [[a * b for b in (0.25, 0.5, 0.25)] for a in (0.1, 0.8, 0.1)]
kernel_query("sep_filter_2d", filters.sep_filter_2d, O.image(O.correlate("kk", "clamp"), O.kernel_cte("kk", _SEP)), kernel_x=[0.25, 0.5, 0.25], kernel_y=[0.1, 0.8, 0.1])
for _name, _k in (("sobel", filters.SOBEL), ("scharr", filters.SCHARR)):
    kernel_query(_name, getattr(filters, _name), O.image(O.gradient("gk", "sqrt(a.v * a.v + b.v * b.v)"), O.two_kernels("gk", _k.tolist(), _k.T.tolist())))
kernel_query("laplacian", filters.laplacian, O.image(O.gradient("gk", "abs(a.v)"), O.two_kernels("gk", filters.CROSS.tolist(), filters.CROSS.tolist())))
_DIL, _ERO = O.neighbours("max(b.v)", 1), O.neighbours("min(b.v)", 1)
_CTE = lambda name, agg, source: f"{name} AS ({O.neighbours(agg, 1, source)})"
_OPEN = (_CTE("e1", "min(b.v)", "px"), _CTE("o1", "max(b.v)", "e1"))
_CLOSE = (_CTE("d1", "max(b.v)", "px"), _CTE("c1", "min(b.v)", "d1"))
kernel_query("dilate", filters.dilate, O.image(_DIL), kernel_size=3)
kernel_query("erode", filters.erode, O.image(_ERO), kernel_size=3)
_PLUS = [[0, 1, 0], [1, 1, 1], [0, 1, 0]]
for _name, _agg in (("dilate_with_kernel", "max"), ("erode_with_kernel", "min")):
    kernel_query(_name, getattr(filters, _name), O.image(O.neighbours(f"{_agg}(b.v) FILTER (abs(a.y - b.y) + abs(a.x - b.x) <= 1)", 1)), kernel=_PLUS)
kernel_query("morph_open", filters.morph_open, O.image("SELECT * FROM o1", *_OPEN), kernel_size=3)
kernel_query("morph_close", filters.morph_close, O.image("SELECT * FROM c1", *_CLOSE), kernel_size=3)
kernel_query("morphology_ex_opening", filters.morphology_ex, O.image("SELECT * FROM o1", *_OPEN), op="opening")
kernel_query("morphology_ex_closing", filters.morphology_ex, O.image("SELECT * FROM c1", *_CLOSE), op="closing")
kernel_query("morphology_ex_gradient", filters.morphology_ex, O.image(O.minus("d1", "e1"), _CLOSE[0], _OPEN[0]), op="gradient")
kernel_query("morphology_ex_top_hat", filters.morphology_ex, O.image(O.minus("px", "o1"), *_OPEN), op="top_hat")
kernel_query("morphology_ex_black_hat", filters.morphology_ex, O.image(O.minus("c1", "px"), *_CLOSE), op="black_hat")
kernel_query("hit_or_miss", filters.hit_or_miss, O.image(
    """SELECT a.image_id, a.ch, a.y, a.x, CASE WHEN a.v > 0.5 AND l.v > 0.5 AND r.v <= 0.5 THEN 1 ELSE 0 END AS v FROM px a LEFT JOIN px l ON l.image_id = a.image_id AND l.ch = a.ch AND l.y = a.y AND l.x = a.x - 1
    LEFT JOIN px r ON r.image_id = a.image_id AND r.ch = a.ch AND r.y = a.y AND r.x = a.x + 1"""), pattern=[[0, 0, 0], [1, 1, 0], [0, 0, 0]], background=[[0, 0, 0], [0, 0, 1], [0, 0, 0]])
kernel_query("adaptive_threshold_mean", filters.adaptive_threshold, O.image(O.neighbours("CASE WHEN a.v > avg(b.v) - 0.01 THEN 1 ELSE 0 END", 1).replace("GROUP BY a.image_id, a.ch, a.y, a.x", "GROUP BY a.image_id, a.ch, a.y, a.x, a.v")), maxval=1.0, method="mean", block_size=3, c=0.01)
_W5 = "exp(-(pow(a.y - b.y, 2) + pow(a.x - b.x, 2)) / (2 * pow(5.0 / 6, 2)))"
kernel_query("adaptive_threshold_gaussian", filters.adaptive_threshold, O.image(O.neighbours(f"CASE WHEN a.v > sum(b.v * {_W5}) / sum({_W5}) - 0.01 THEN 1 ELSE 0 END", 2).replace("GROUP BY a.image_id, a.ch, a.y, a.x", "GROUP BY a.image_id, a.ch, a.y, a.x, a.v")), maxval=1.0, method="gaussian", block_size=5, c=0.01)
kernel_query("distance_transform", filters.distance_transform)
kernel_query("thin", filters.thin)
kernel_query("skeleton", filters.skeleton)
kernel_query("fast_nl_means_photo", filters.nlm_photo)
kernel_query("fast_nl_means_nlm", filters.nlm, rgb=True)

# --- statistics and histograms ----------------------------------------------------------


def _planes(df: DataFrame) -> DataFrame:
    return df.select("image_id", F.posexplode(pixel.split_channels(*_cols())).alias("ch", "p"))


_PER = f"WITH {O.RGB8} SELECT CAST(image_id AS BIGINT) AS image_id, CAST(ch AS INTEGER) AS ch, {{}} FROM px GROUP BY image_id, ch"
add("mean", lambda s, d: _planes(img8rgb(s, d)).select("image_id", "ch", F.round(pixel.mean_std(F.col("p"))[0], 6).alias("mean")), _PER.format("round(avg(v), 6) AS mean"))
add("mean_std_dev", lambda s, d: _planes(img8rgb(s, d)).select("image_id", "ch", *[F.round(v, 6).alias(k) for k, v in zip(("mean", "std"), pixel.mean_std(F.col("p")), strict=True)]), _PER.format("round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std"))
add("count_non_zero", lambda s, d: img8(s, d).select("image_id", pixel.count_non_zero(pixel.threshold(F.col("data"), 0.5, 1.0)).alias("n")), f"WITH {O.IMG8} SELECT CAST(image_id AS BIGINT) AS image_id, count(*) FILTER (v > 0.5) AS n FROM px GROUP BY image_id")
add("total", lambda s, d: img8rgb(s, d).select("image_id", pixel.total(F.col("data")).cast("long").alias("n")), f"WITH {O.RGB8} SELECT CAST(image_id AS BIGINT) AS image_id, count(*) AS n FROM px GROUP BY image_id")


def _min_max_loc(s: SparkSession, d: str) -> DataFrame:
    at = lambda v: F.array_position("data", v) - 1
    df = img8(s, d).withColumns({"lo": F.array_min("data"), "hi": F.array_max("data")}).withColumns({"i": at(F.col("lo")), "j": at(F.col("hi"))})
    place = lambda i: ((F.col(i) / F.col("w")).cast("int"), (F.col(i) % F.col("w")).cast("int"))
    (iy, ix), (jy, jx) = place("i"), place("j")
    return df.select("image_id", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), iy.alias("lo_y"), ix.alias("lo_x"), jy.alias("hi_y"), jx.alias("hi_x"))


_PLANES = "im AS (SELECT image_id, ch, list(v ORDER BY y, x) AS p FROM px GROUP BY image_id, ch)"
add("min_max_loc", _min_max_loc, f"""WITH {O.IMG8}, {_PLANES}, ends AS (SELECT image_id, list_min(p) AS lo, list_max(p) AS hi, list_position(p, list_min(p)) - 1 AS i, list_position(p, list_max(p)) - 1 AS j FROM im)
SELECT CAST(image_id AS BIGINT) AS image_id, round(lo, 6) AS lo, round(hi, 6) AS hi, CAST(i // 8 AS INTEGER) AS lo_y, CAST(i % 8 AS INTEGER) AS lo_x, CAST(j // 8 AS INTEGER) AS hi_y, CAST(j % 8 AS INTEGER) AS hi_x FROM ends""")
_BINS = f"hs AS (SELECT image_id, ch, {O.BYTE.format('v')} AS bin, count(*) AS n FROM px GROUP BY ALL)"
_FULL = "full_hs AS (SELECT g.image_id, g.ch, g.bin, coalesce(n, 0) AS n FROM (SELECT * FROM (SELECT DISTINCT image_id, ch FROM px), (SELECT unnest(range(256)) AS bin)) g LEFT JOIN hs ON hs.image_id = g.image_id AND hs.ch = g.ch AND hs.bin = g.bin)"
add("calc_hist", lambda s, d: histograms.calc_hist(img8(s, d)), f"WITH {O.IMG8}, {_BINS}, {_FULL} SELECT CAST(image_id AS BIGINT) AS image_id, CAST(ch AS INTEGER) AS ch, CAST(bin AS INTEGER) AS bin, CAST(n AS BIGINT) AS count FROM full_hs")


def _hist_2d(s: SparkSession, d: str) -> DataFrame:
    m = measure(img8rgb(s, d), "m", "array<double>", lambda a: histograms.calc_hist_2d(a, 0, 2, 8).ravel())
    return m.select("image_id", F.posexplode("m").alias("cell", "v")).select("image_id", "cell", F.round("v", 6).alias("v"))


add("calc_hist_2d", _hist_2d, f"""WITH {O.RGB8}, c AS (SELECT image_id, floor(bv * 7 + 0.5) * 8 + floor(rv * 7 + 0.5) AS cell, count(*) AS n FROM (SELECT image_id, y, x, max(v) FILTER (ch = 0) AS rv, max(v) FILTER (ch = 2) AS bv FROM px GROUP BY image_id, y, x) GROUP BY ALL)
SELECT CAST(g.image_id AS BIGINT) AS image_id, CAST(g.cell AS INTEGER) AS cell, round(coalesce(n, 0) / max(n) OVER (PARTITION BY g.image_id), 6) AS v FROM (SELECT * FROM (SELECT DISTINCT image_id FROM px), (SELECT unnest(range(64)) AS cell)) g LEFT JOIN c ON c.image_id = g.image_id AND c.cell = g.cell""")
_EQ = "cd AS (SELECT image_id, ch, bin, sum(n) OVER (PARTITION BY image_id, ch ORDER BY bin) AS cdf, first_value(n) OVER (PARTITION BY image_id, ch ORDER BY bin) AS f FROM hs)"
kernel_query("equalize_hist", histograms.equalize_hist, O.image(f"SELECT image_id, ch, y, x, floor((cdf - f) / (64 - f) * 255 + 0.5) / 255 AS v FROM px JOIN cd ON cd.image_id = px.image_id AND cd.ch = px.ch AND cd.bin = {O.BYTE.format('px.v')}".replace("SELECT image_id, ch, y, x", "SELECT px.image_id, px.ch, y, x"), _BINS, _EQ))
kernel_query("equalize_hist_color", histograms.equalize_hist_color, rgb=True)
kernel_query("clahe", histograms.clahe)
kernel_query("equalize_hist_adaptive", histograms.equalize_hist_adaptive)
_OT = """ot AS (SELECT image_id, ch, bin, sum(n) OVER w AS w0, sum(n * bin) OVER w AS m0, 64 - sum(n) OVER w AS w1, sum(n * bin) OVER (PARTITION BY image_id, ch) - sum(n * bin) OVER w AS m1 FROM full_hs WINDOW w AS (PARTITION BY image_id, ch ORDER BY bin)),
lv AS (SELECT image_id, ch, bin FROM (SELECT *, CASE WHEN w0 > 0 AND w1 > 0 THEN CAST(w0 AS DOUBLE) * w1 * pow(CAST(m0 AS DOUBLE) / w0 - CAST(m1 AS DOUBLE) / w1, 2) ELSE 0 END AS var FROM ot) QUALIFY row_number() OVER (PARTITION BY image_id, ch ORDER BY round(var, 6) DESC, bin) = 1)"""
kernel_query("threshold_otsu", histograms.threshold_otsu, O.image("SELECT px.image_id, px.ch, y, x, CASE WHEN px.v > lv.bin / 255.0 THEN 1 ELSE 0 END AS v FROM px JOIN lv ON lv.image_id = px.image_id AND lv.ch = px.ch", _BINS, _FULL, _OT))
kernel_query("threshold_triangle", histograms.threshold_triangle)


def _hists(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/events.parquet").select("event_type", F.pmod(F.floor(F.col("value")), F.lit(256)).cast("int").alias("bin"))
    wide = e.groupBy("event_type").agg(*[F.count_if(F.col("bin") % 16 == k).cast("double").alias(f"b{k}") for k in range(16)])
    return wide.select("event_type", F.array(*[f"b{k}" for k in range(16)]).alias("h"))


def _compare(method: str) -> Query:
    def query(s: SparkSession, d: str) -> DataFrame:
        a = _hists(s, d)
        b = a.select(F.col("event_type").alias("other"), F.col("h").alias("g"))  # a row a type
        return a.join(b, F.col("event_type") < F.col("other")).select("event_type", "other", F.round(histograms.compare_hist(F.col("h"), F.col("g"), method), 6).alias("distance"))

    return query


_HB = """hb AS (SELECT t.event_type, b.bin, CAST(count(e.value) AS DOUBLE) AS n FROM (SELECT DISTINCT event_type FROM events) t CROSS JOIN (SELECT unnest(range(16)) AS bin) b
LEFT JOIN events e ON e.event_type = t.event_type AND ((CAST(floor(e.value) AS BIGINT) % 256 + 256) % 256) % 16 = b.bin GROUP BY ALL)"""
for _m, _e in {"correlation": "coalesce(corr(a.n, b.n), 0)", "chi_square": "sum(CASE WHEN a.n + b.n > 0 THEN pow(a.n - b.n, 2) / (a.n + b.n) ELSE 0 END)", "intersection": "sum(least(a.n, b.n))", "hellinger": "sqrt(sum(pow(sqrt(a.n) - sqrt(b.n), 2)) / 2)"}.items():
    add(f"compare_hist_{_m}", _compare(_m), f"WITH {_HB} SELECT a.event_type, b.event_type AS other, round({_e}, 6) AS distance FROM hb a JOIN hb b ON a.bin = b.bin AND a.event_type < b.event_type GROUP BY ALL")
add("compare_hist_color", lambda s, d: _hists(s, d).select("event_type", F.round(histograms.compare_hist_color(F.array("h", "h"), F.array(F.reverse("h"), F.col("h")), "intersection")[1], 6).alias("same")), f"WITH {_HB} SELECT event_type, round(sum(n), 6) AS same FROM hb GROUP BY event_type")
add("hog_compute", lambda s, d: measure(img8(s, d), "f", "array<double>", histograms.hog).select("image_id", F.posexplode("f").alias("bin", "v")).select("image_id", "bin", F.round("v", 6).alias("v")))
add("get_structuring_element", lambda s, d: s.createDataFrame([(k, filters.get_structuring_element(k, 5, 3)) for k in ("rect", "cross", "ellipse")], "shape string, element array<array<int>>").select("shape", F.posexplode("element").alias("y", "r")).select("shape", "y", F.posexplode("r").alias("x", "v")))
add("lerp", lambda s, d: s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.round(pixel.lerp(F.lit(1.0), F.lit(3.0), F.col("o_totalprice") / 300000), 6).alias("v")), "SELECT o_orderkey, round(1 + 2 * least(greatest(o_totalprice / 300000, 0), 1), 6) AS v FROM orders")
add("format_duration_ms", lambda s, d: s.read.parquet(f"{d}/nation.parquet").select("n_nationkey", pixel.format_duration_ms(F.col("n_nationkey") * 1.5).alias("t")), "SELECT n_nationkey, printf('%.2f ms', n_nationkey * 1.5) AS t FROM nation")
add("compute_similarity", lambda s, d: s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.round(pixel.cosine_similarity(F.col("embedding"), F.reverse("embedding")), 5).alias("sim")), "SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(list_reverse(embedding) AS DOUBLE[])), 5) AS sim FROM embeddings")
add("euclidean_dist_sq", lambda s, d: s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.round(pixel.euclidean_dist_sq(F.col("embedding"), F.reverse("embedding")), 5).alias("d")), "SELECT vec_id, round(pow(list_distance(CAST(embedding AS DOUBLE[]), CAST(list_reverse(embedding) AS DOUBLE[])), 2), 5) AS d FROM embeddings")
