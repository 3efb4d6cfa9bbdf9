"""Polygons as arrays of points: areas, lengths, moments and tests, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _edges(points: Column) -> Column:
    """(x, y, nx, ny) of each edge; the last one closes the polygon."""
    n = F.size(points)
    return F.transform(points, lambda p, i: F.struct(p["x"].alias("x"), p["y"].alias("y"), F.element_at(points, (i + 1) % n + 1)["x"].alias("nx"), F.element_at(points, (i + 1) % n + 1)["y"].alias("ny")))


def _sum(items: Column, f) -> Column:
    return F.aggregate(F.transform(items, f), F.lit(0.0), lambda s, v: s + v)


def _cross(e: Column) -> Column:
    return e["x"] * e["ny"] - e["nx"] * e["y"]


def contour_area(points: Column) -> Column:
    return F.abs(_sum(_edges(points), _cross)) / 2


polygon_area = contour_area


def arc_length(points: Column, closed: bool) -> Column:
    e = _edges(points)
    e = e if closed else F.slice(e, 1, F.size(points) - 1)
    return _sum(e, lambda e: F.sqrt((e["nx"] - e["x"]) * (e["nx"] - e["x"]) + (e["ny"] - e["y"]) * (e["ny"] - e["y"])))


def bounding_rect(points: Column) -> Column:
    """The width is the largest x less the smallest, and so the height."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs)).alias("width"), (F.array_max(ys) - F.array_min(ys)).alias("height"))


MOMENTS = ("m00", "m10", "m01", "m20", "m11", "m02", "m30", "m21", "m12", "m03")


def moments(points: Column) -> dict[str, Column]:
    """Of a polygon's area by Green's theorem, each without its sign."""
    e = _edges(points)

    def of(f, k: int) -> Column:
        return F.abs(_sum(e, lambda q: _cross(q) * f(q["x"], q["y"], q["nx"], q["ny"]))) / k

    return {
        "m00": of(lambda x, y, u, v: F.lit(1.0), 2),
        "m10": of(lambda x, y, u, v: x + u, 6),
        "m01": of(lambda x, y, u, v: y + v, 6),
        "m20": of(lambda x, y, u, v: x * x + x * u + u * u, 12),
        "m11": of(lambda x, y, u, v: x * (y * 2 + v) + u * (y + v * 2), 24),
        "m02": of(lambda x, y, u, v: y * y + y * v + v * v, 12),
        "m30": of(lambda x, y, u, v: (x + u) * (x * x + u * u), 20),
        "m21": of(lambda x, y, u, v: x * x * (y * 3 + v) + x * u * 2 * (y + v) + u * u * (y + v * 3), 60),
        "m12": of(lambda x, y, u, v: y * y * (x * 3 + u) + y * v * 2 * (x + u) + v * v * (x + u * 3), 60),
        "m03": of(lambda x, y, u, v: (y + v) * (y * y + v * v), 20),
    }


def centroid(m: dict[str, Column]) -> tuple[Column, Column]:
    """Null where the area is under 1e-9."""
    some = m["m00"] >= 1e-9
    return F.when(some, F.try_divide(m["m10"], m["m00"])), F.when(some, F.try_divide(m["m01"], m["m00"]))


def hu_moments(m: dict[str, Column], compat: bool = False) -> list[Column]:
    """Seven invariants; ``compat`` scales third-order terms by the cube of the area. 0 for no area."""
    cx, cy = centroid(m)
    mu = {
        "20": m["m20"] - cx * m["m10"],
        "11": m["m11"] - cx * m["m01"],
        "02": m["m02"] - cy * m["m01"],
        "30": m["m30"] - cx * m["m20"] * 3 + cx * cx * m["m10"] * 2,
        "21": m["m21"] - cx * m["m11"] * 2 - cy * m["m20"] + cx * cx * m["m01"] * 2,
        "12": m["m12"] - cy * m["m11"] * 2 - cx * m["m02"] + cy * cy * m["m10"] * 2,
        "03": m["m03"] - cy * m["m02"] * 3 + cy * cy * m["m01"] * 2,
    }
    n = {k: F.try_divide(v, F.pow(m["m00"], F.lit(2.0 if sum(map(int, k)) == 2 else 3.0 if compat else 2.5))) for k, v in mu.items()}
    a, b, c, d = n["30"] + n["12"], n["21"] + n["03"], n["30"] - n["12"] * 3, n["21"] * 3 - n["03"]
    diff = n["20"] - n["02"]
    out = [
        n["20"] + n["02"],
        diff * diff + n["11"] * n["11"] * 4,
        c * c + d * d,
        a * a + b * b,
        c * a * (a * a - b * b * 3) + d * b * (a * a * 3 - b * b),
        diff * (a * a - b * b) + n["11"] * a * b * 4,
        d * a * (a * a - b * b * 3) - c * b * (a * a * 3 - b * b),
    ]
    return [F.coalesce(v, F.lit(0.0)) for v in out]


def match_shapes(a: list[Column], b: list[Column]) -> Column:
    out = F.lit(0.0)
    for x, y in zip(a, b, strict=True):
        out = out + F.abs(x - y)
    return out


def point_inside_polygon(px: Column, py: Column, points: Column) -> Column:
    """By the parity of crossings to the right of the point."""
    crossed = lambda e: ((e["y"] > py) != (e["ny"] > py)) & (px < (e["nx"] - e["x"]) * (py - e["y"]) / (e["ny"] - e["y"] + 1e-9) + e["x"])
    safe = lambda e: F.when((e["y"] > py) != (e["ny"] > py), crossed(e)).otherwise(F.lit(False))
    return F.size(F.filter(_edges(points), safe)) % 2 == 1


def segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x2 - x1, y2 - y1
    t = F.coalesce(F.try_divide((px - x1) * dx + (py - y1) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    ex, ey = px - (x1 + t * dx), py - (y1 + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def point_polygon_test(px: Column, py: Column, points: Column, measure_dist: bool) -> Column:
    """1 inside, -1 outside, or the signed distance to the nearest edge; -1 for no points."""
    sign = F.when(point_inside_polygon(px, py, points), F.lit(1.0)).otherwise(F.lit(-1.0))
    if measure_dist:
        sign = sign * F.array_min(F.transform(_edges(points), lambda e: segment_distance(px, py, e["x"], e["y"], e["nx"], e["ny"])))
    return F.when(F.size(points) > 0, sign).otherwise(F.lit(-1.0))


def box_points(cx: Column, cy: Column, width: Column, height: Column, angle: Column) -> Column:
    c, s = F.cos(F.radians(angle)), F.sin(F.radians(angle))
    at = lambda u, v: F.struct((cx + width * u * c - height * v * s).alias("x"), (cy + width * u * s + height * v * c).alias("y"))
    return F.array(at(-0.5, -0.5), at(0.5, -0.5), at(0.5, 0.5), at(-0.5, 0.5))


def iou(a: Column, b: Column) -> Column:
    """Of two rectangles (x, y, width, height)."""
    side = lambda p, n: F.greatest(F.least(a[p] + a[n], b[p] + b[n]) - F.greatest(a[p], b[p]), F.lit(0))
    inter = side("x", "width") * side("y", "height")
    return F.coalesce(F.try_divide(inter.cast("double"), (a["width"] * a["height"] + b["width"] * b["height"] - inter).cast("double")), F.lit(0.0))
