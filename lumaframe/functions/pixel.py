"""Per-pixel functions on planar arrays: array expressions, no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import InvalidParameter


def _lit(v: float) -> Column:
    return F.lit(float(v))


def clamp01(v: Column) -> Column:
    return F.least(F.greatest(v, _lit(0)), _lit(1))


def same_size(a: Column, b: Column) -> Column:
    """``a``, or an error where the sizes differ."""
    return F.when(F.size(a) == F.size(b), a).otherwise(F.raise_error(F.lit("images differ in size")).cast("array<double>"))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(same_size(a, b), b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(same_size(a, b), b, lambda x, y: x - y)


def multiply(a: Column, b: Column) -> Column:
    return F.zip_with(same_size(a, b), b, lambda x, y: x * y)


def divide(a: Column, b: Column) -> Column:
    """IEEE division: a zero divisor gives infinity, or NaN for 0/0."""
    inf = lambda x: F.when(x > 0, _lit("inf")).when(x < 0, _lit("-inf")).otherwise(_lit("nan"))
    return F.zip_with(same_size(a, b), b, lambda x, y: F.when(y != 0, F.try_divide(x, y)).otherwise(inf(x)))


def absdiff(a: Column, b: Column) -> Column:
    return F.zip_with(same_size(a, b), b, lambda x, y: F.abs(x - y))


def byte(v: Column) -> Column:
    """Clamped to [0, 1], scaled to 255, cut off."""
    return (clamp01(v) * 255).cast("int")


def bitwise_and(a: Column, b: Column) -> Column:
    return F.zip_with(same_size(a, b), b, lambda x, y: byte(x).bitwiseAND(byte(y)) / 255.0)


def bitwise_or(a: Column, b: Column) -> Column:
    return F.zip_with(same_size(a, b), b, lambda x, y: byte(x).bitwiseOR(byte(y)) / 255.0)


def bitwise_xor(a: Column, b: Column) -> Column:
    return F.zip_with(same_size(a, b), b, lambda x, y: byte(x).bitwiseXOR(byte(y)) / 255.0)


def bitwise_not(a: Column) -> Column:
    return F.transform(a, lambda x: (255 - byte(x)) / 255.0)


def add_weighted(a: Column, alpha: float, b: Column, beta: float, gamma: float) -> Column:
    return F.zip_with(same_size(a, b), b, lambda x, y: x * alpha + y * beta + gamma)


def convert_scale_abs(a: Column, scale: float, shift: float) -> Column:
    return F.transform(a, lambda x: F.least(F.abs(x * scale + shift), _lit(1)))


def copy_to(src: Column, dst: Column, mask: Column | None = None) -> Column:
    """``src`` where ``mask`` (one plane, repeated for all channels) is positive, else ``dst``; without a mask ``src``."""
    if mask is None:
        return same_size(src, dst)
    pairs = F.arrays_zip(same_size(src, dst).alias("s"), dst.alias("d"))
    return F.transform(pairs, lambda p, i: F.when(F.element_at(mask, i % F.size(mask) + 1) > 0, p["s"]).otherwise(p["d"]))


def apply_lut(a: Column, lut: list[float]) -> Column:
    if len(lut) != 256:
        raise InvalidParameter("a lookup table has 256 entries")
    values = F.array(*[_lit(v) for v in lut])
    return F.transform(a, lambda x: F.element_at(values, byte(x) + 1))


THRESHOLDS = ("binary", "binary_inv", "trunc", "to_zero", "to_zero_inv")


def threshold_value(v: Column, thresh: Column | float, maxval: float, kind: str = "binary") -> Column:
    """One value; the comparison is strict."""
    over, zero, top = v > thresh, _lit(0), _lit(maxval)
    t = thresh if isinstance(thresh, Column) else _lit(thresh)
    forms = {"binary": (top, zero), "binary_inv": (zero, top), "trunc": (t, v), "to_zero": (v, zero), "to_zero_inv": (zero, v)}
    if kind not in forms:
        raise InvalidParameter(f"no threshold type {kind!r}")
    return F.when(over, forms[kind][0]).otherwise(forms[kind][1])


def threshold(a: Column, thresh: float, maxval: float, kind: str = "binary") -> Column:
    return F.transform(a, lambda x: threshold_value(x, thresh, maxval, kind))


def plane(data: Column, h: Column, w: Column, ch: Column | int) -> Column:
    return F.slice(data, (F.lit(ch) if isinstance(ch, int) else ch) * h * w + 1, h * w)


def in_range(data: Column, c: int, h: Column, w: Column, low: list[float], high: list[float]) -> Column:
    """One plane: 1 where every channel lies in [low, high]."""
    if len(low) != c or len(high) != c:
        raise InvalidParameter("one bound a channel")
    n = h * w
    inside = lambda i, k: F.element_at(data, i + n * k + 1).between(low[k], high[k])

    def all_in(i: Column) -> Column:
        out = inside(i, 0)
        for k in range(1, c):
            out = out & inside(i, k)
        return F.when(out, _lit(1)).otherwise(_lit(0))

    return F.transform(F.sequence(F.lit(0), n - 1), all_in)


def normalize(data: Column, c: Column, h: Column, w: Column, low: float, high: float) -> Column:
    """Each channel stretched to [low, high]; a constant channel becomes ``low``."""

    def stretched(k: Column) -> Column:
        p = plane(data, h, w, k)
        least, span = F.array_min(p), F.array_max(p) - F.array_min(p)
        return F.transform(p, lambda x: F.when(span < 1e-10, _lit(low)).otherwise(F.try_divide(x - least, span) * (high - low) + low))

    return F.flatten(F.transform(F.sequence(F.lit(0), c - 1), stretched))


def grayscale(data: Column, c: Column, h: Column, w: Column) -> Column:
    """One plane: luma of the first three channels; one channel passes through."""
    n = h * w
    luma = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(data, i + 1) * 0.299 + F.element_at(data, i + n + 1) * 0.587 + F.element_at(data, i + n * 2 + 1) * 0.114)
    bad = F.raise_error(F.lit("grayscale needs one channel, or three")).cast("array<double>")
    return F.when(c == 1, data).when(c >= 3, luma).otherwise(bad)


def to_rgb(data: Column, c: Column) -> Column:
    bad = F.raise_error(F.lit("to_rgb needs one channel, or three")).cast("array<double>")
    return F.when(c == 1, F.concat(data, data, data)).when(c == 3, data).otherwise(bad)


def split_channels(data: Column, c: Column, h: Column, w: Column) -> Column:
    """Array of planes."""
    return F.transform(F.sequence(F.lit(0), c - 1), lambda k: plane(data, h, w, k))


def merge_channels(*planes: Column) -> Column:
    return F.concat(*planes)


def vector_add(a: Column, b: Column) -> Column:
    return add(a, b)


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * clamp01(t)


def format_duration_ms(ms: Column) -> Column:
    return F.format_string("%.2f ms", ms.cast("double"))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x.cast("double") * y.cast("double")), _lit(0), lambda s, x: s + x)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, _lit(0)).otherwise(F.try_divide(dot(a, b), norm))


def euclidean_dist_sq(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), _lit(0), lambda s, x: s + x)


def total(data: Column) -> Column:
    return F.size(data)


def count_non_zero(data: Column) -> Column:
    return F.size(F.filter(data, lambda x: x > 0)).cast("long")


def channel_sum(data: Column) -> Column:
    return F.aggregate(data, _lit(0), lambda s, x: s + x)


def mean_std(data: Column) -> tuple[Column, Column]:
    """Mean and population deviation of one plane."""
    mean = channel_sum(data) / F.size(data)
    return mean, F.sqrt(F.aggregate(data, _lit(0), lambda s, x: s + (x - mean) * (x - mean)) / F.size(data))


def preprocess_blob(data: Column, c: int, h: Column, w: Column, scale: float, mean: list[float], swap_rb: bool) -> Column:
    """Planes, red and blue swapped if asked, as (v - mean[ch]) * scale."""
    order = [2, 1, 0, *range(3, c)] if swap_rb and c >= 3 else list(range(c))
    centred = lambda m: lambda x: (x - m) * scale
    return F.concat(*[F.transform(plane(data, h, w, k), centred(mean[j])) for j, k in enumerate(order)])
