"""Colour conversions of channel values in [0, 1], as column expressions.

Each function takes the channels of one pixel and returns those of the other
space; :func:`convert` applies one to planar images. ``CODES`` names them all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import InvalidParameter
from .pixel import _lit, clamp01

# sRGB primaries with the D65 white point, and luma weights.
RGB_TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
XYZ_TO_RGB = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
WHITE = (0.95047, 1.0, 1.08883)
LUMA = (0.299, 0.587, 0.114)
CIE_E, CIE_K = 216 / 24389, 24389 / 27

Channels = tuple[Column, ...]


def _times(m: tuple, v: Channels) -> Channels:
    return tuple(v[0] * a + v[1] * b + v[2] * c for a, b, c in m)


def linearize(v: Column) -> Column:
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, _lit(2.4)))


def delinearize(v: Column) -> Column:
    return clamp01(F.when(v <= 0.0031308, v * 12.92).otherwise(F.pow(F.greatest(v, _lit(0)), _lit(1 / 2.4)) * 1.055 - 0.055))


def lab_f(t: Column) -> Column:
    return F.when(t > CIE_E, F.cbrt(t)).otherwise((t * CIE_K + 16) / 116)


def lab_f_inv(t: Column) -> Column:
    return F.when(t * t * t > CIE_E, t * t * t).otherwise((t * 116 - 16) / CIE_K)


def _hue(r: Column, g: Column, b: Column, eps: float) -> tuple[Column, Column, Column]:
    """Hue in [0, 1), largest and least channel."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    part = lambda x: F.try_divide(x, d)
    six = F.when(top == r, part(g - b) % 6).when(top == g, part(b - r) + 2).otherwise(part(r - g) + 4)
    deg = F.when(d < eps, _lit(0)).otherwise(six * 60)
    return F.when(deg < 0, deg + 360).otherwise(deg) / 360, top, low


def _sextant(h: Column, c: Column, m: Column) -> Channels:
    """RGB of hue, chroma and least channel."""
    k = h * 6
    x = c * (_lit(1) - F.abs(k % 2 - 1))
    zero = _lit(0)
    pick = lambda *v: F.when(k < 1, v[0]).when(k < 2, v[1]).when(k < 3, v[2]).when(k < 4, v[3]).when(k < 5, v[4]).otherwise(v[5]) + m
    return pick(c, x, zero, zero, x, c), pick(x, c, c, x, zero, zero), pick(zero, zero, x, c, c, x)


def rgb_to_hsv(r: Column, g: Column, b: Column) -> Channels:
    h, top, low = _hue(r, g, b, 1e-6)
    return h, F.when(top < 1e-6, _lit(0)).otherwise(F.try_divide(top - low, top)), top


def hsv_to_rgb(h: Column, s: Column, v: Column) -> Channels:
    c = v * s
    return _sextant(h, c, v - c)


def _saturation(top: Column, low: Column, light: Column, eps: float) -> Column:
    d = top - low
    return F.when(d < eps, _lit(0)).otherwise(F.try_divide(d, _lit(1) - F.abs(light * 2 - 1)))


def rgb_to_hls(r: Column, g: Column, b: Column) -> Channels:
    h, top, low = _hue(r, g, b, 1e-6)
    light = (top + low) / 2
    return h, light, F.coalesce(_saturation(top, low, light, 1e-6), _lit(0))


def hls_to_rgb(h: Column, light: Column, s: Column) -> Channels:
    c = (_lit(1) - F.abs(light * 2 - 1)) * s
    return _sextant(h, c, light - c / 2)


def rgb_to_hsl(r: Column, g: Column, b: Column) -> Channels:
    h, top, low = _hue(r, g, b, 1e-10)
    light = (top + low) / 2
    return clamp01(h), clamp01(F.coalesce(_saturation(top, low, light, 1e-10), _lit(0))), clamp01(light)


def hsl_to_rgb(h: Column, s: Column, light: Column) -> Channels:
    return tuple(clamp01(v) for v in hls_to_rgb(h, light, s))


def rgb_to_xyz(r: Column, g: Column, b: Column) -> Channels:
    return _times(RGB_TO_XYZ, (linearize(r), linearize(g), linearize(b)))


def xyz_to_rgb(x: Column, y: Column, z: Column) -> Channels:
    return tuple(delinearize(v) for v in _times(XYZ_TO_RGB, (x, y, z)))


def rgb_to_lab(r: Column, g: Column, b: Column) -> Channels:
    fx, fy, fz = (lab_f(v / w) for v, w in zip(rgb_to_xyz(r, g, b), WHITE, strict=True))
    return (fy * 116 - 16) / 100, ((fx - fy) * 500 + 128) / 255, ((fy - fz) * 200 + 128) / 255


def lab_to_rgb(light: Column, a: Column, b: Column) -> Channels:
    fy = (light * 100 + 16) / 116
    fx, fz = (a * 255 - 128) / 500 + fy, fy - (b * 255 - 128) / 200
    return xyz_to_rgb(*(lab_f_inv(f) * w for f, w in zip((fx, fy, fz), WHITE, strict=True)))


def luma(r: Column, g: Column, b: Column) -> Column:
    return r * LUMA[0] + g * LUMA[1] + b * LUMA[2]


def rgb_to_yuv(r: Column, g: Column, b: Column) -> Channels:
    u, v = r * -0.14713 - g * 0.28886 + b * 0.436, r * 0.615 - g * 0.51499 - b * 0.10001
    return clamp01(luma(r, g, b)), clamp01(u + 0.5), clamp01(v + 0.5)


def yuv_to_rgb(y: Column, u: Column, v: Column) -> Channels:
    u, v = u - 0.5, v - 0.5
    return clamp01(y + v * 1.13983), clamp01(y - u * 0.39465 - v * 0.58060), clamp01(y + u * 2.03211)


def rgb_to_ycrcb(r: Column, g: Column, b: Column) -> Channels:
    y = luma(r, g, b)
    return clamp01(y), clamp01((r - y) * 0.713 + 0.5), clamp01((b - y) * 0.564 + 0.5)


def ycrcb_to_rgb(y: Column, cr: Column, cb: Column) -> Channels:
    cr, cb = cr - 0.5, cb - 0.5
    return clamp01(y + cr * 1.402), clamp01(y - cr * 0.714 - cb * 0.344), clamp01(y + cb * 1.772)


def rgb_to_cmyk(r: Column, g: Column, b: Column) -> Channels:
    k = _lit(1) - F.greatest(r, g, b)
    ink = lambda v: F.when(_lit(1) - k < 1e-6, _lit(0)).otherwise(F.try_divide(_lit(1) - v - k, _lit(1) - k))
    return ink(r), ink(g), ink(b), k


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> Channels:
    return tuple((_lit(1) - v) * (_lit(1) - k) for v in (c, m, y))


CODES: dict[str, Callable[..., Channels]] = {
    f.__name__: f
    for f in (rgb_to_hsv, hsv_to_rgb, rgb_to_hls, hls_to_rgb, rgb_to_hsl, hsl_to_rgb, rgb_to_xyz, xyz_to_rgb, rgb_to_lab, lab_to_rgb, rgb_to_yuv, yuv_to_rgb, rgb_to_ycrcb, ycrcb_to_rgb, rgb_to_cmyk, cmyk_to_rgb)
}


def convert(images, code: str):
    """Planar images in another colour space; the channel count must be the code's."""
    if code not in CODES:
        raise InvalidParameter(f"no colour conversion {code!r}")
    f = CODES[code]
    k = 4 if code.startswith("cmyk") else 3
    out = 4 if code.endswith("cmyk") else 3
    n = F.col("h") * F.col("w")
    at = lambda i, ch: F.element_at("data", i + n * ch + 1)
    pixels = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array(*f(*(at(i, ch) for ch in range(k)))))
    channel = lambda j: lambda p: p[j]
    planes = F.flatten(F.array(*[F.transform("_p", channel(j)) for j in range(out)]))
    bad = F.raise_error(F.lit(f"{code} needs {k} channels")).cast("array<array<double>>")
    rest = [c for c in images.columns if c not in ("c", "data")]
    done = images.withColumn("_p", F.when(F.col("c") == k, pixels).otherwise(bad))
    return done.select(*rest, F.lit(out).alias("c"), planes.alias("data")).select(*images.columns)
