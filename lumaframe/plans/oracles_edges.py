"""SQL of per-image and per-polygon operators that go on until nothing changes: edges, thinning, skeletons, hulls and what follows from these."""

from __future__ import annotations

import math

_V = "SELECT vec_id AS image_id, list_transform(embedding, lambda e: least(greatest(e::DOUBLE * 0.5 + 0.5, 0), 1)) AS v FROM embeddings"
_CELLS = "image_id, CAST(0 AS INTEGER) AS ch, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x"
_INNER = "i // 8 BETWEEN 1 AND 6 AND i % 8 BETWEEN 1 AND 6"


def _taps(sigma: float) -> list[float]:
    g = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-2, 3)]
    return [v / sum(g) for v in g]


def _smoothed(of: str, step: int, sigma: float) -> str:
    """One pass over a list of 64 along rows (step 1) or columns (step 8); the edge is repeated."""
    at = lambda k: f"i - i % 8 + greatest(0, least(7, i % 8 + {k}))" if step == 1 else f"greatest(0, least(7, i // 8 + {k})) * 8 + i % 8"
    return f"list_transform(range(64), lambda i: {' + '.join(f'{w!r} * {of}[{at(k)} + 1]' for k, w in zip(range(-2, 3), _taps(sigma), strict=True))})"


def _sobel(of: str, first: int, second: int) -> str:
    """Difference along ``first`` summed with weights 1, 2, 1 along ``second`` (steps in the list)."""
    terms = [f"{w} * ({of}[i + 1 + {first} + {k * second}] - {of}[i + 1 - {first} + {k * second}])" for k, w in ((-1, 1), (0, 2), (1, 1))]
    return f"list_transform(range(64), lambda i: CASE WHEN {_INNER} THEN {' + '.join(terms)} ELSE 0 END)"


_AHEAD = {0: 1, 1: 9, 2: 8, 3: 7}
CANNY = f"""WITH RECURSIVE a AS ({_V}),
r AS (SELECT image_id, {_smoothed("v", 1, 1.4)} AS v FROM a), b AS (SELECT image_id, {_smoothed("v", 8, 1.4)} AS v FROM r),
g AS (SELECT image_id, {_sobel("v", 1, 8)} AS gx, {_sobel("v", 8, 1)} AS gy FROM b),
s AS (SELECT image_id, list_transform(range(64), lambda i: sqrt(gx[i + 1] * gx[i + 1] + gy[i + 1] * gy[i + 1])) AS size,
      list_transform(range(64), lambda i: (floor(((degrees(atan2(gy[i + 1], gx[i + 1])) + 360) % 180 + 22.5) / 45))::INTEGER % 4) AS sector FROM g),
t AS (SELECT image_id, unnest(range(64)) AS i, unnest(list_transform(range(64), lambda i: CASE WHEN {_INNER} AND {" AND ".join(f"(sector[i + 1] <> {k} OR size[i + 1] >= size[i + 1 + {d}] AND size[i + 1] >= size[i + 1 - {d}])" for k, d in _AHEAD.items())} THEN size[i + 1] ELSE 0 END)) AS v FROM s),
w AS MATERIALIZED (SELECT image_id, i, v FROM t WHERE v >= 0.05),
e(image_id, i) AS (SELECT image_id, i FROM w WHERE v >= 0.15
  UNION SELECT w.image_id, w.i FROM e JOIN w ON w.image_id = e.image_id AND abs(w.i // 8 - e.i // 8) <= 1 AND abs(w.i % 8 - e.i % 8) <= 1)
SELECT t.{_CELLS.replace("i //", "t.i //").replace("i %", "t.i %")}, CASE WHEN e.i IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS v FROM t LEFT JOIN e ON e.image_id = t.image_id AND e.i = t.i"""

# Steps in the list to the eight neighbours, from the upper one clockwise.
_ROUND = (-8, -7, 1, 9, 8, 7, -1, -9)


def _peeled(of: str, keep: str) -> str:
    at = [f"{of}[i + 1 + {d}]" for d in _ROUND]
    turns = " + ".join(f"(CASE WHEN {at[k]} = 0 AND {at[(k + 1) % 8]} = 1 THEN 1 ELSE 0 END)" for k in range(8))
    n, e, s, w = (f"{at[k]} = 1" for k in (0, 2, 4, 6))
    kept = {"first": f"({n} AND {e} AND {s}) OR ({e} AND {s} AND {w})", "second": f"({n} AND {e} AND {w}) OR ({n} AND {s} AND {w})"}[keep]
    return f"list_transform(range(64), lambda i: CASE WHEN {_INNER} AND {of}[i + 1] = 1 AND {' + '.join(at)} BETWEEN 2 AND 6 AND {turns} = 1 AND NOT ({kept}) THEN 0 ELSE {of}[i + 1] END)"


THIN = f"""WITH RECURSIVE a AS ({_V}),
f(image_id, k, l) AS (SELECT image_id, 0, list_transform(v, lambda e: CASE WHEN e > 0.5 THEN 1 ELSE 0 END) FROM a
  UNION ALL SELECT image_id, k + 1, n FROM (SELECT image_id, k, l, {_peeled("m", "second")} AS n FROM (SELECT image_id, k, l, {_peeled("l", "first")} AS m FROM f)) WHERE n <> l),
d AS (SELECT image_id, arg_max(l, k) AS l FROM f GROUP BY image_id)
SELECT {_CELLS}, v::DOUBLE AS v FROM (SELECT image_id, unnest(range(64)) AS i, unnest(l) AS v FROM d)"""


def _crossed(of: str, pick: str, outside: str) -> str:
    """Least or greatest of a pixel and its four neighbours; ``outside`` stands for what lies beyond the edge."""
    sides = ((-8, "i // 8 > 0"), (8, "i // 8 < 7"), (-1, "i % 8 > 0"), (1, "i % 8 < 7"))
    around = ", ".join(f"CASE WHEN {inside} THEN {of}[i + 1 + {d}] ELSE {outside} END" for d, inside in sides)
    return f"list_transform(range(64), lambda i: {pick}({of}[i + 1], {around}))"


SKELETON = f"""WITH RECURSIVE a AS ({_V}),
f(image_id, k, cur, small, got) AS (
  SELECT image_id, 0, cur, small, list_transform(range(64), lambda i: 0) FROM (SELECT image_id, cur, {_crossed("cur", "least", "0")} AS small FROM (SELECT image_id, list_transform(v, lambda e: CASE WHEN e > 0.5 THEN 1 ELSE 0 END) AS cur FROM a))
  UNION ALL
  SELECT image_id, k + 1, small, {_crossed("small", "least", "0")}, list_transform(range(64), lambda i: greatest(got[i + 1], cur[i + 1] - opened[i + 1])) FROM (SELECT *, {_crossed("small", "greatest", "0")} AS opened FROM f WHERE list_sum(cur) > 0)),
d AS (SELECT image_id, arg_max(got, k) AS l FROM f GROUP BY image_id)
SELECT {_CELLS}, v::DOUBLE AS v FROM (SELECT image_id, unnest(range(64)) AS i, unnest(l) AS v FROM d)"""


# The lowest wet pixel that has not spread yet labels its dry neighbours, until all have spread; two opposite corners are wet at first.
WATERSHED = f"""WITH RECURSIVE a AS ({_V}),
f(image_id, k, v, l, done) AS (
  SELECT image_id, 0, v, list_transform(range(64), lambda i: CASE i WHEN 0 THEN 1 WHEN 63 THEN 2 ELSE 0 END), list_transform(range(64), lambda i: 0) FROM a
  UNION ALL
  SELECT image_id, k + 1, v, list_transform(range(64), lambda i: CASE WHEN l[i + 1] = 0 AND abs(i // 8 - p // 8) + abs(i % 8 - p % 8) = 1 THEN l[p + 1] ELSE l[i + 1] END), list_transform(range(64), lambda i: CASE WHEN i = p THEN 1 ELSE done[i + 1] END)
  FROM (SELECT *, list_sort(list_transform(list_filter(range(64), lambda i: l[i + 1] > 0 AND done[i + 1] = 0), lambda i: struct_pack(v := v[i + 1], i := i)))[1].i AS p FROM f WHERE k < 64)),
d AS (SELECT image_id, l FROM f WHERE k = 64)
SELECT {_CELLS}, v::DOUBLE AS v FROM (SELECT image_id, unnest(range(64)) AS i, unnest(l) AS v FROM d)"""


def hull_of_polygons(hull: str) -> dict[str, str]:
    """SQL of the per-polygon forms, given the relations corner and he (edges) of :mod:`.queries_polygons`; polygons of three points stay as they are."""
    size = "k AS (SELECT group_id, count(*) AS k FROM pl GROUP BY group_id)"
    angles = f"""{hull}, {size}, turn AS (SELECT group_id, a, cos(radians(a)) AS c, sin(radians(a)) AS s FROM k, range(90) AS r(a)),
ext AS (SELECT group_id, a, c, s, max(x * c + y * s) AS u1, min(x * c + y * s) AS u0, max(y * c - x * s) AS v1, min(y * c - x * s) AS v0 FROM turn JOIN pl USING (group_id) GROUP BY group_id, a, c, s),
best AS (SELECT *, (u1 + u0) / 2 AS mu, (v1 + v0) / 2 AS mv FROM ext QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY (u1 - u0) * (v1 - v0), a) = 1)
SELECT group_id, round(mu * c - mv * s, 4) + 0 AS cx, round(mu * s + mv * c, 4) + 0 AS cy, round(u1 - u0, 4) + 0 AS width, round(v1 - v0, 4) + 0 AS height, a::DOUBLE AS angle FROM best"""
    defects = f"""{hull}, {size}, side AS (SELECT he.* FROM he JOIN k USING (group_id) WHERE k > 3 UNION ALL SELECT group_id, x, y, nx, ny FROM edge WHERE k = 3),
far AS (SELECT s.group_id, s.x, s.y, s.nx, s.ny, p.x AS px, p.y AS py, least(greatest(((p.x - s.x) * (s.nx - s.x) + (p.y - s.y) * (s.ny - s.y)) / greatest(pow(s.nx - s.x, 2) + pow(s.ny - s.y, 2), 1e-12), 0), 1) AS t FROM side s JOIN pl p ON p.group_id = s.group_id),
depth AS (SELECT group_id, max(sqrt(pow(px - x - t * (nx - x), 2) + pow(py - y - t * (ny - y), 2))) AS d FROM far GROUP BY group_id, x, y, nx, ny)
SELECT k.group_id, count(d) FILTER (d > 1e-6)::INTEGER AS n, round(max(d) FILTER (d > 1e-6), 4) AS depth FROM k LEFT JOIN depth ON depth.group_id = k.group_id GROUP BY k.group_id"""
    areas = f"""{hull}, {size} SELECT k.group_id, CASE WHEN k = 3 THEN 3 ELSE n END::INTEGER AS n, round(coalesce(area, 0), 4) + 0 AS area FROM k JOIN (SELECT group_id, count(*) AS n FROM corner GROUP BY group_id) USING (group_id)
LEFT JOIN (SELECT group_id, abs(sum(x * ny - nx * y)) / 2 AS area FROM he GROUP BY group_id) USING (group_id)"""
    return {"convex_hull": areas, "min_area_rect": angles, "convexity_defects": defects}

EDGES = {"canny": CANNY, "thin": THIN, "skeleton": SKELETON, "watershed": WATERSHED}
