"""SQL of further queries, by name: each derived from the operator's definition, not from its NumPy form."""

from __future__ import annotations

import numpy as np

from . import oracles as O

#: Planes as lists, and bytes of pixels.
PLANES = "im AS MATERIALIZED (SELECT image_id, ch, list(v ORDER BY y, x) AS p FROM px GROUP BY image_id, ch)"
BYTES = f"bt AS (SELECT image_id, ch, y, x, v, {O.BYTE.format('v')} AS b FROM px)"


def perspective(m: list[list[float]]) -> str:
    i = np.linalg.inv(np.array(m)).tolist()
    u, v, w = (f"({a!r} * tx + {b!r} * ty + {c!r})" for a, b, c in i)
    rnd = lambda e: f"trunc({e} + CASE WHEN {e} < 0 THEN -0.5 ELSE 0.5 END)"
    return O.image(f"""SELECT image_id, ch, ty AS y, tx AS x, CASE WHEN sx BETWEEN 0 AND 7 AND sy BETWEEN 0 AND 7 THEN p[CAST(sy * 8 + sx + 1 AS INTEGER)] ELSE 0 END AS v
      FROM (SELECT *, {rnd(f'({u} / {w})')} AS sx, {rnd(f'({v} / {w})')} AS sy FROM im, (SELECT unnest(range(8)) AS ty), (SELECT unnest(range(8)) AS tx))""", PLANES)


DISTANCE = O.image("""SELECT image_id, 0 AS ch, y, x, CASE WHEN d IS NULL THEN 1 WHEN top > 0 THEN d / top ELSE 0 END AS v FROM (SELECT *, max(d) OVER (PARTITION BY image_id) AS top FROM (
  SELECT a.image_id, a.y, a.x, min(abs(abs(a.y - b.y) - abs(a.x - b.x)) + sqrt(2) * least(abs(a.y - b.y), abs(a.x - b.x))) AS d FROM px a LEFT JOIN px b ON b.image_id = a.image_id AND b.v > 0.5 GROUP BY a.image_id, a.y, a.x))""")

TRIANGLE = O.image("""SELECT b.image_id, 0 AS ch, y, x, CASE WHEN b.v > lv.level / 255.0 THEN 1 ELSE 0 END AS v FROM bt b JOIN lv ON lv.image_id = b.image_id""", BYTES,
    "hs AS (SELECT image_id, b AS bin, count(*) AS n FROM bt GROUP BY image_id, b)",
    "pk AS (SELECT image_id, max(n) AS top, arg_min(bin, (-n, bin)) AS peak, max(bin) AS last FROM hs GROUP BY image_id)",
    "ln AS (SELECT pk.*, bin, abs(-top * (bin - peak) - (last - peak) * (coalesce((SELECT n FROM hs WHERE hs.image_id = pk.image_id AND hs.bin = k.bin), 0) - top)) AS far FROM pk, (SELECT unnest(range(256)) AS bin) k WHERE bin BETWEEN peak AND last)",
    "lv AS (SELECT image_id, CASE WHEN any_value(peak) = any_value(last) THEN any_value(peak) ELSE arg_min(bin, (-far, bin)) END AS level FROM ln GROUP BY image_id)")

#: Rank of a pixel's bin among all pixels of its plane gives the cumulative histogram.
_EQUAL = "floor((cdf - first) / (64 - first) * 255 + 0.5) / 255"
EQUAL_COLOR = O.image(
    f"""SELECT image_id, k AS ch, y, x, least(greatest(CASE k WHEN 0 THEN e + 1.402 * (cr - 0.5) WHEN 1 THEN e - 0.714 * (cr - 0.5) - 0.344 * (cb - 0.5) ELSE e + 1.772 * (cb - 0.5) END, 0), 1) AS v
    FROM (SELECT *, {_EQUAL} AS e FROM (SELECT *, min(cdf) OVER (PARTITION BY image_id) AS first FROM (SELECT *, count(*) OVER (PARTITION BY image_id ORDER BY b) AS cdf FROM yc))), (SELECT unnest(range(3)) AS k)""",
    "rgb AS (SELECT image_id, y, x, max(v) FILTER (ch = 0) AS r, max(v) FILTER (ch = 1) AS g, max(v) FILTER (ch = 2) AS b FROM px GROUP BY image_id, y, x)",
    "yy AS (SELECT *, 0.299 * r + 0.587 * g + 0.114 * b AS t FROM rgb)",
    f"yc AS (SELECT image_id, y, x, {O.BYTE.format('t')} AS b, least(greatest((r - t) * 0.713 + 0.5, 0), 1) AS cr, least(greatest((b - t) * 0.564 + 0.5, 0), 1) AS cb FROM yy)",
    rgb=True,
)

#: Of each quarter of the image: the histogram cut at ``LIMIT``, the excess dealt out, cumulated and stretched.
_LIMIT = int(2.0 * 16 / 256)
_TILES = (
    BYTES,
    "tb AS (SELECT image_id, y // 4 AS i, x // 4 AS j, list(b) AS bs FROM bt GROUP BY ALL)",
    f"cut AS (SELECT image_id, i, j, k.bin, least(len(list_filter(bs, lambda q: q = k.bin)), {_LIMIT}) AS n, 16 - list_sum(list_transform(list_distinct(bs), lambda d: least(len(list_filter(bs, lambda q: q = d)), {_LIMIT}))) AS extra FROM tb, (SELECT unnest(range(256)) AS bin) k)",
    "dealt AS (SELECT image_id, i, j, bin, n + extra // 256 + CASE WHEN bin < extra % 256 THEN 1 ELSE 0 END AS n FROM cut)",
    "cum AS (SELECT *, sum(n) OVER (PARTITION BY image_id, i, j ORDER BY bin) AS cdf FROM dealt)",
    "spread AS (SELECT *, min(cdf) FILTER (n > 0) OVER (PARTITION BY image_id, i, j) AS first, max(cdf) OVER (PARTITION BY image_id, i, j) AS last FROM cum)",
    "lut AS MATERIALIZED (SELECT image_id, i, j, list(CASE WHEN last > first THEN least(greatest(floor((cdf - first) / (last - first) * 255 + 0.5) / 255, 0), 1) ELSE 0 END ORDER BY bin) AS t FROM spread GROUP BY image_id, i, j)",
)
CLAHE = O.image("SELECT b.image_id, 0 AS ch, b.y, b.x, lut.t[b.b + 1] AS v FROM bt b JOIN lut ON lut.image_id = b.image_id AND lut.i = b.y // 4 AND lut.j = b.x // 4", *_TILES)
# The tiles' centres lie at 1.5 and 5.5.
_W = "least(greatest((b.{} - 1.5) / 4, 0), 1)"
ADAPTIVE = O.image(f"""SELECT b.image_id, 0 AS ch, b.y, b.x, sum(lut.t[b.b + 1] * CASE lut.i WHEN 0 THEN 1 - {_W.format('y')} ELSE {_W.format('y')} END * CASE lut.j WHEN 0 THEN 1 - {_W.format('x')} ELSE {_W.format('x')} END) AS v
  FROM bt b JOIN lut ON lut.image_id = b.image_id GROUP BY b.image_id, b.y, b.x""", *_TILES)

ELEMENT = """SELECT shape, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST(CASE shape WHEN 'rect' THEN 1 WHEN 'cross' THEN CASE WHEN y = 1 OR x = 2 THEN 1 ELSE 0 END
  ELSE CASE WHEN pow((y - 1) / 1.5, 2) + pow((x - 2) / 2.5, 2) <= 1.05 THEN 1 ELSE 0 END END AS INTEGER) AS v
  FROM (SELECT unnest(['rect', 'cross', 'ellipse']) AS shape), (SELECT unnest(range(3)) AS y), (SELECT unnest(range(5)) AS x)"""

#: The right view is the left one moved by two pixels; a block's sum of absolute differences for each disparity.
STEREO = O.image("""SELECT image_id, 0 AS ch, y, x, CASE WHEN min(cost) IS NULL THEN 0 ELSE arg_min(d, (round(cost, 12), d)) * 16 END AS v FROM (
  SELECT image_id, y, x, d, CASE WHEN y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6 AND x - 1 - d >= 0 THEN list_sum(list_transform(range(9), lambda k: abs(p[(y + k // 3 - 1) * 8 + x + k % 3 - 1 + 1]
    - CASE WHEN x + k % 3 - 1 - d < 6 THEN p[(y + k // 3 - 1) * 8 + x + k % 3 - 1 - d + 3] ELSE 0 END))) END AS cost
  FROM im, (SELECT unnest(range(8)) AS y), (SELECT unnest(range(8)) AS x), (SELECT unnest(range(4)) AS d)) GROUP BY image_id, y, x""", PLANES)

#: Exposures: the image and its square.
FUSION = O.image(
    """SELECT image_id, ch, y, x, CASE WHEN t < 1e-10 THEN (v + v * v) / 2 ELSE (v * w1 + v * v * w2) / t END AS v FROM (
    SELECT pw.image_id, px.ch, px.y, px.x, px.v, w1, w2, w1 + w2 AS t FROM px JOIN pw ON pw.image_id = px.image_id AND pw.y = px.y AND pw.x = px.x)""",
    "two AS MATERIALIZED (SELECT image_id, ch, y, x, e, CASE e WHEN 0 THEN v ELSE v * v END AS v FROM px, (SELECT unnest(range(2)) AS e))",
    "gr AS MATERIALIZED (SELECT image_id, e, y, x, sum(v * CASE ch WHEN 0 THEN 0.299 WHEN 1 THEN 0.587 ELSE 0.114 END) AS g, stddev_pop(v) AS sat, exp(sum(-pow(v - 0.5, 2) / (2 * pow(0.2, 2)))) AS mid FROM two GROUP BY image_id, e, y, x)",
    "gp AS (SELECT image_id, e, list(g ORDER BY y, x) AS p FROM gr GROUP BY image_id, e)",
    """wt AS (SELECT gr.image_id, gr.e, gr.y, gr.x, sat * mid * abs(p[gr.y * 8 + greatest(gr.x - 1, 0) + 1] + p[gr.y * 8 + least(gr.x + 1, 7) + 1] + p[greatest(gr.y - 1, 0) * 8 + gr.x + 1] + p[least(gr.y + 1, 7) * 8 + gr.x + 1] - 4 * g) AS w
      FROM gr JOIN gp ON gp.image_id = gr.image_id AND gp.e = gr.e)""",
    "pw AS (SELECT image_id, y, x, sum(w) FILTER (e = 0) AS w1, sum(w) FILTER (e = 1) AS w2 FROM wt GROUP BY image_id, y, x)",
    rgb=True,
)

_AT = lambda y, x: f"p[least(greatest({y}, 0), 7) * 8 + least(greatest({x}, 0), 7) + 1]"
#: Cells of 4, one block of four cells, nine unsigned angles.
HOG = f"""WITH {O.IMG8}, {PLANES}, gd AS (SELECT image_id, y, x, {_AT('y', 'x + 1')} - {_AT('y', 'x - 1')} AS gx, {_AT('y + 1', 'x')} - {_AT('y - 1', 'x')} AS gy FROM im, (SELECT unnest(range(8)) AS y), (SELECT unnest(range(8)) AS x)),
po AS (SELECT *, sqrt(gx * gx + gy * gy) AS size, CASE WHEN ang < 0 THEN ang + pi() WHEN ang >= pi() THEN ang - pi() ELSE ang END / pi() * 9 - 0.5 AS pos FROM (SELECT *, atan2(gy, gx) AS ang FROM gd)),
vote AS (SELECT image_id, (y // 4) * 2 + x // 4 AS cell, (CAST(floor(pos) AS INTEGER) + s + 9) % 9 AS bin, size * CASE s WHEN 0 THEN 1 - (pos - floor(pos)) ELSE pos - floor(pos) END AS w FROM po, (SELECT unnest(range(2)) AS s)),
bins AS (SELECT image_id, k AS bin, coalesce(sum(w), 0) AS w FROM (SELECT image_id, w, cell * 9 + bin AS k FROM vote UNION ALL SELECT DISTINCT image_id, 0, z FROM vote, (SELECT unnest(range(36)) AS z)) GROUP BY image_id, k)
SELECT CAST(image_id AS BIGINT) AS image_id, CAST(bin AS INTEGER) AS bin, round(w / n, 6) AS v FROM (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY image_id) + 1e-12) AS n FROM bins)"""

FLOOD = f"""WITH RECURSIVE {O.IMG8}, ok AS (SELECT a.image_id, a.y, a.x FROM px a JOIN px s ON s.image_id = a.image_id AND s.y = 3 AND s.x = 3 WHERE a.v BETWEEN s.v - 0.05 AND s.v + 0.05),
wet AS (SELECT image_id, y, x FROM ok WHERE y = 3 AND x = 3 UNION SELECT o.image_id, o.y, o.x FROM wet w JOIN ok o ON o.image_id = w.image_id AND abs(o.y - w.y) + abs(o.x - w.x) = 1)
SELECT {O.CELL.replace('image_id', 'px.image_id', 1).replace('(y', '(px.y').replace('(x', '(px.x')}, round(CASE WHEN wet.image_id IS NULL THEN v ELSE 1 END, 6) + 0.0 AS v FROM px LEFT JOIN wet ON wet.image_id = px.image_id AND wet.y = px.y AND wet.x = px.x"""

_PATCH = "list_sum(list_transform(range(9), lambda k: pow({} - {}, 2)))"
NLM_PHOTO = O.image(
    f"""SELECT image_id, ch, y, x, least(greatest(sum(w * q) / sum(w), 0), 1) AS v FROM (SELECT image_id, ch, y, x, p[(y + dy) * 8 + x + dx + 1] AS q,
      exp(-{_PATCH.format(_AT('y + k // 3 - 1', 'x + k % 3 - 1'), _AT('y + dy + k // 3 - 1', 'x + dx + k % 3 - 1'))} / 9 / 0.01) * exp(-2 * (dx * dx + dy * dy) / 4.0) AS w
      FROM im, (SELECT unnest(range(8)) AS y), (SELECT unnest(range(8)) AS x), (SELECT unnest(range(-2, 3)) AS dy), (SELECT unnest(range(-2, 3)) AS dx)
      WHERE y + dy BETWEEN 1 AND 6 AND x + dx BETWEEN 1 AND 6) GROUP BY image_id, ch, y, x
    UNION ALL SELECT image_id, ch, y, x, v FROM px WHERE greatest(least(y, 6), 1) - y NOT BETWEEN -2 AND 2""",
    PLANES,
)
NLM = O.image(
    f"""SELECT image_id, ch, y, x, sum(w * {_AT('y + dy', 'x + dx')}) / sum(w) AS v FROM (SELECT im.image_id, im.ch, im.p, wt.y, wt.x, wt.dy, wt.dx, wt.w FROM im JOIN wt ON wt.image_id = im.image_id) GROUP BY image_id, ch, y, x""",
    PLANES,
    f"""wt AS MATERIALIZED (SELECT image_id, y, x, dy, dx, exp(-sum({_PATCH.format(_AT('y + k // 3 - 1', 'x + k % 3 - 1'), _AT('y + dy + k // 3 - 1', 'x + dx + k % 3 - 1'))}) / 27 / 0.01) AS w
      FROM im, (SELECT unnest(range(8)) AS y), (SELECT unnest(range(8)) AS x), (SELECT unnest(range(-2, 3)) AS dy), (SELECT unnest(range(-2, 3)) AS dx) GROUP BY image_id, y, x, dy, dx)""",
    rgb=True,
)

#: The first 2^k numbers of the generator x -> (1664525 x + 1013904223) mod 2^32 from 42.
_DRAWS = "rng(k, u) AS (SELECT 0, CAST(42 AS BIGINT) UNION ALL SELECT k + 1, (u * 1664525 + 1013904223) % 4294967296 FROM rng WHERE k < {})"


def _normal(value: str) -> str:
    """Box-Muller pairs of draws, by pixel."""
    return f"""WITH RECURSIVE {O.IMG8}, {_DRAWS.format(64)}, pr AS (SELECT (k - 1) // 2 AS j, max(u / 4294967296.0) FILTER (k % 2 = 1) AS a, max(u / 4294967296.0) FILTER (k % 2 = 0) AS b FROM rng WHERE k > 0 GROUP BY j),
nm AS (SELECT j * 2 + s AS i, sqrt(-2 * ln(greatest(a, 1e-12))) * CASE s WHEN 0 THEN cos(2 * pi() * b) ELSE sin(2 * pi() * b) END AS z FROM pr, (SELECT unnest(range(2)) AS s))
SELECT {O.CELL}, round(least(greatest({value}, 0), 1), 6) + 0.0 AS v FROM px JOIN nm ON nm.i = px.y * 8 + px.x"""


SALT = f"""WITH RECURSIVE {O.IMG8}, {_DRAWS.format(18)}, ds AS (SELECT (k - 1) // 3 AS j, max(u / 4294967296.0) FILTER (k % 3 = 1) AS a, max(u / 4294967296.0) FILTER (k % 3 = 2) AS b, max(u / 4294967296.0) FILTER (k % 3 = 0) AS c FROM rng WHERE k > 0 GROUP BY j),
hit AS (SELECT CAST(floor(a * 8) AS INTEGER) AS hy, CAST(floor(b * 8) AS INTEGER) AS hx, arg_max(CASE WHEN c >= 0.5 THEN 1.0 ELSE 0.0 END, j) AS s FROM ds GROUP BY ALL)
SELECT {O.CELL}, round(coalesce(s, v), 6) + 0.0 AS v FROM px LEFT JOIN hit ON hy = y AND hx = x"""

_CR = "(x * ny - nx * y)"
_SUMS = {
    "m00": f"abs(sum{_CR}) / 2", "m10": f"abs(sum({_CR} * (x + nx))) / 6", "m01": f"abs(sum({_CR} * (y + ny))) / 6",
    "m20": f"abs(sum({_CR} * (x * x + x * nx + nx * nx))) / 12", "m11": f"abs(sum({_CR} * (x * (2 * y + ny) + nx * (y + 2 * ny)))) / 24", "m02": f"abs(sum({_CR} * (y * y + y * ny + ny * ny))) / 12",
    "m30": f"abs(sum({_CR} * (x * x * x + x * x * nx + x * nx * nx + nx * nx * nx))) / 20",
    "m21": f"abs(sum({_CR} * (x * x * (3 * y + ny) + 2 * x * nx * (y + ny) + nx * nx * (y + 3 * ny)))) / 60",
    "m12": f"abs(sum({_CR} * (y * y * (3 * x + nx) + 2 * y * ny * (x + nx) + ny * ny * (x + 3 * nx)))) / 60",
    "m03": f"abs(sum({_CR} * (y * y * y + y * y * ny + y * ny * ny + ny * ny * ny))) / 20",
}
_ALL = ", ".join(f"{v} AS {k}" for k, v in _SUMS.items())
THIRD = f"WITH {O.POLYS} SELECT group_id, " + ", ".join(f"round({_SUMS[k]}, 4) + 0 AS {k}" for k in ("m30", "m21", "m12", "m03")) + " FROM edge GROUP BY group_id"
HU = f"""WITH {O.POLYS}, mo AS (SELECT group_id, {_ALL} FROM edge GROUP BY group_id), ce AS (SELECT *, CASE WHEN m00 >= 1e-9 THEN m10 / m00 END AS cx, CASE WHEN m00 >= 1e-9 THEN m01 / m00 END AS cy FROM mo),
mu AS (SELECT group_id, (m20 - cx * m10) / pow(m00, 2) AS n20, (m11 - cx * m01) / pow(m00, 2) AS n11, (m02 - cy * m01) / pow(m00, 2) AS n02,
  (m30 - 3 * cx * m20 + 2 * cx * cx * m10) / pow(m00, 2.5) AS n30, (m21 - 2 * cx * m11 - cy * m20 + 2 * cx * cx * m01) / pow(m00, 2.5) AS n21,
  (m12 - 2 * cy * m11 - cx * m02 + 2 * cy * cy * m10) / pow(m00, 2.5) AS n12, (m03 - 3 * cy * m02 + 2 * cy * cy * m01) / pow(m00, 2.5) AS n03 FROM ce),
hu AS (SELECT group_id, n20 + n02 AS h0, pow(n20 - n02, 2) + 4 * n11 * n11 AS h1, pow(n30 - 3 * n12, 2) + pow(3 * n21 - n03, 2) AS h2, pow(n30 + n12, 2) + pow(n21 + n03, 2) AS h3,
  (n30 - 3 * n12) * (n30 + n12) * (pow(n30 + n12, 2) - 3 * pow(n21 + n03, 2)) + (3 * n21 - n03) * (n21 + n03) * (3 * pow(n30 + n12, 2) - pow(n21 + n03, 2)) AS h4,
  (n20 - n02) * (pow(n30 + n12, 2) - pow(n21 + n03, 2)) + 4 * n11 * (n30 + n12) * (n21 + n03) AS h5,
  (3 * n21 - n03) * (n30 + n12) * (pow(n30 + n12, 2) - 3 * pow(n21 + n03, 2)) - (n30 - 3 * n12) * (n21 + n03) * (3 * pow(n30 + n12, 2) - pow(n21 + n03, 2)) AS h6 FROM mu)
SELECT group_id, {', '.join(f'round(sign(g{k}) * log10(1 + abs(g{k})), 3) + 0 AS h{k}' for k in range(7))} FROM (SELECT group_id, {', '.join(f'coalesce(CASE WHEN isfinite(h{k}) THEN h{k} END, 0) AS g{k}' for k in range(7))} FROM hu)"""

#: Pixels whose distance from the centre rounds to the radius.
RING = "floor(sqrt(pow(x - {0}, 2) + pow(y - {0}, 2)) + 0.5) = {1}"
ELLIPSE = """WITH {0}, pts AS (SELECT DISTINCT floor(4 + u * cos(radians(30)) - v * sin(radians(30)) + 0.5) AS ex, floor(4 + u * sin(radians(30)) + v * cos(radians(30)) + 0.5) AS ey
  FROM (SELECT 3 * cos(radians(k * 360 / 719.0)) AS u, 2 * sin(radians(k * 360 / 719.0)) AS v FROM (SELECT unnest(range(720)) AS k)))
SELECT {1}, round(CASE WHEN ex IS NULL THEN v ELSE 1 END, 6) + 0.0 AS v FROM px LEFT JOIN pts ON ex = x AND ey = y""".format(O.IMG8, O.CELL)

KALMAN_STREAM = """WITH RECURSIVE tr AS (SELECT user_id AS track_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, value AS z FROM events),
st(track_id, us, seq, x, s, a, b, c) AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(1 AS DOUBLE), CAST(0 AS DOUBLE), CAST(1 AS DOUBLE) FROM events
  UNION ALL SELECT track_id, us, seq, px + pa / (pa + 0.1) * (z - px), s + pb / (pa + 0.1) * (z - px), pa - pa * pa / (pa + 0.1), pb - pa * pb / (pa + 0.1), pc - pb * pb / (pa + 0.1)
  FROM (SELECT st.track_id, tr.us, tr.seq, tr.z, x + s AS px, s, a + 2 * b + c + 0.01 AS pa, b + c AS pb, c + 0.01 AS pc FROM st JOIN tr ON tr.track_id = st.track_id AND tr.seq = st.seq + 1))
SELECT track_id, us AS seq, round(x, 6) AS position FROM st WHERE seq > 0"""

MORE: dict[str, str] = {
    "warp_perspective": perspective([[1.1, 0.1, 0.3], [0.05, 0.9, 0.2], [0.01, 0.02, 1.0]]),
    "distance_transform": DISTANCE,
    "threshold_triangle": TRIANGLE,
    "equalize_hist_color": EQUAL_COLOR,
    "clahe": CLAHE,
    "equalize_hist_adaptive": ADAPTIVE,
    "get_structuring_element": ELEMENT,
    "stereo_match": STEREO,
    "exposure_fusion": FUSION,
    "hog_compute": HOG,
    "flood_fill": FLOOD,
    "fast_nl_means_photo": NLM_PHOTO,
    "fast_nl_means_nlm": NLM,
    "add_gaussian_noise": _normal("v + 0.1 * z"),
    "add_speckle_noise": _normal("v + v * 0.1 * z"),
    "add_salt_pepper_noise": SALT,
    "moments_third_order": THIRD,
    "hu_moments": HU,
    "draw_circle": O.pixelwise(f"CASE WHEN {RING.format(4, 3)} THEN 1 ELSE v END"),
    "draw_marker_circle": O.pixelwise(f"CASE WHEN {RING.format(4, 2)} THEN 1 ELSE v END"),
    "draw_ellipse": ELLIPSE,
    "draw_arrowed_line": O.pixelwise("CASE WHEN x = y AND x BETWEEN 1 AND 6 OR y BETWEEN 3 AND 6 AND x = round(5 + (y - 3) / 3) OR x BETWEEN 3 AND 6 AND y = round(5 + (x - 3) / 3) THEN 1 ELSE v END"),
    "kalman_stream": KALMAN_STREAM,
    "encode_png_round_trip": "SELECT vec_id AS image_id, true AS close FROM embeddings",
}
