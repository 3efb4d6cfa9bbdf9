"""DuckDB SQL for the derived views and for pixel relations."""

from __future__ import annotations

UNIT = "least(greatest(CAST({} AS DOUBLE) * 0.5 + 0.5, 0), 1)"
IMG8 = f"""px AS MATERIALIZED (SELECT vec_id AS image_id, 0 AS ch, CAST((i - 1) // 8 AS INTEGER) AS y, CAST((i - 1) % 8 AS INTEGER) AS x, {UNIT.format('embedding[i]')} AS v
  FROM embeddings, (SELECT unnest(range(1, 65)) AS i))"""
RGB8 = f"""px AS MATERIALIZED (SELECT vec_id // 3 AS image_id, CAST(vec_id % 3 AS INTEGER) AS ch, CAST((i - 1) // 8 AS INTEGER) AS y, CAST((i - 1) % 8 AS INTEGER) AS x, {UNIT.format('embedding[i]')} AS v
  FROM embeddings, (SELECT unnest(range(1, 65)) AS i) WHERE vec_id // 3 < (SELECT count(*) // 3 FROM embeddings))"""
#: Each pixel with ``u``, the pixel there of a second image: the first upside down.
PAIR8 = f"""px AS MATERIALIZED (SELECT vec_id AS image_id, 0 AS ch, CAST((i - 1) // 8 AS INTEGER) AS y, CAST((i - 1) % 8 AS INTEGER) AS x, {UNIT.format('embedding[i]')} AS v, {UNIT.format('embedding[(7 - (i - 1) // 8) * 8 + (i - 1) % 8 + 1]')} AS u
  FROM embeddings, (SELECT unnest(range(1, 65)) AS i))"""
CELL = "CAST(image_id AS BIGINT) AS image_id, CAST(ch AS INTEGER) AS ch, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x"
BYTE = "CAST(trunc(least(greatest({}, 0), 1) * 255) AS INTEGER)"


def image(body: str, *ctes: str, rgb: bool = False) -> str:
    """SQL of an image result; ``body`` gives image_id, ch, y, x, v."""
    return f"WITH {', '.join([RGB8 if rgb else IMG8, *ctes])} SELECT {CELL}, round(CAST(v AS DOUBLE), 6) + 0.0 AS v FROM ({body})"


def pixelwise(expr: str, rgb: bool = False) -> str:
    return image(f"SELECT image_id, ch, y, x, {expr} AS v FROM px", rgb=rgb)


def pairwise(expr: str) -> str:
    return f"WITH {PAIR8} SELECT {CELL}, round(CAST(v AS DOUBLE), 6) + 0.0 AS v FROM (SELECT image_id, ch, y, x, {expr} AS v FROM px)"


def neighbours(agg: str, r: int, source: str = "px") -> str:
    """``agg`` over b.v of the (2r+1)^2 neighbours inside (dy, dx are offsets)."""
    return f"""SELECT a.image_id, a.ch, a.y, a.x, {agg} AS v FROM {source} a JOIN {source} b
      ON a.image_id = b.image_id AND a.ch = b.ch AND abs(a.y - b.y) <= {r} AND abs(a.x - b.x) <= {r} GROUP BY a.image_id, a.ch, a.y, a.x"""


def kernel_cte(name: str, k: list[list[float]]) -> str:
    rows = ", ".join(f"({i - len(k) // 2}, {j - len(k[0]) // 2}, {float(v)!r})" for i, row in enumerate(k) for j, v in enumerate(row))
    return f"{name}(dy, dx, w) AS (VALUES {rows})"


def correlate(kernel: str, border: str, source: str = "px") -> str:
    """Weighted sum over kernel offsets; ``border`` is clamp or zero."""
    at = lambda c, d: f"least(greatest(a.{c} + k.{d}, 0), 7)" if border == "clamp" else f"a.{c} + k.{d}"
    return f"""SELECT a.image_id, a.ch, a.y, a.x, coalesce(sum(b.v * k.w), 0) AS v FROM {source} a CROSS JOIN {kernel} k LEFT JOIN {source} b
      ON a.image_id = b.image_id AND a.ch = b.ch AND b.y = {at('y', 'dy')} AND b.x = {at('x', 'dx')} GROUP BY a.image_id, a.ch, a.y, a.x"""


def two_kernels(name: str, kx: list[list[float]], ky: list[list[float]]) -> str:
    rows = ", ".join(f"({i - 1}, {j - 1}, {float(kx[i][j])!r}, {float(ky[i][j])!r})" for i in range(3) for j in range(3))
    return f"{name}(dy, dx, w, z) AS (VALUES {rows})"


def gradient(kernels: str, value: str, source: str = "px") -> str:
    """``value`` of the sums a.v and b.v over two 3x3 kernels, 0 on the outer ring."""
    return f"""SELECT image_id, ch, y, x, CASE WHEN y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6 THEN {value} ELSE 0 END AS v
      FROM (SELECT p.image_id, p.ch, p.y, p.x, {{'v': coalesce(sum(q.v * k.w), 0)}} AS a, {{'v': coalesce(sum(q.v * k.z), 0)}} AS b FROM {source} p CROSS JOIN {kernels} k LEFT JOIN {source} q
      ON q.image_id = p.image_id AND q.ch = p.ch AND q.y = p.y + k.dy AND q.x = p.x + k.dx GROUP BY p.image_id, p.ch, p.y, p.x)"""


def minus(a: str, b: str) -> str:
    return f"SELECT image_id, ch, y, x, sum(v) AS v FROM (SELECT image_id, ch, y, x, v FROM {a} UNION ALL SELECT image_id, ch, y, x, -v FROM {b}) GROUP BY image_id, ch, y, x"


BOXES = """bx AS (SELECT l_orderkey AS group_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS seq,
  l_partkey % 200 AS x, l_suppkey % 100 AS y, CAST(l_quantity AS BIGINT) AS width, CAST(l_linenumber * 5 AS BIGINT) AS height, l_discount * 10 AS score FROM lineitem)"""
POLYS = """pl AS (SELECT * FROM (SELECT l_orderkey AS group_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS seq,
  l_quantity AS x, round(l_extendedprice / 1000) AS y, count(*) OVER (PARTITION BY l_orderkey) AS k FROM lineitem) WHERE k >= 3),
edge AS (SELECT group_id, seq, k, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM pl
  WINDOW w AS (PARTITION BY group_id ORDER BY seq))"""
COLORS = """cl AS (SELECT DISTINCT least(greatest(l_quantity / 50, 0), 1) AS r, least(greatest(l_discount * 10, 0), 1) AS g, least(greatest(l_tax * 12.5, 0), 1) AS b FROM lineitem)"""
FRAMES = """cells AS (SELECT CAST(epoch(date_trunc('day', ts)) // 86400 AS BIGINT) AS day, hour(ts) AS y, user_id % 32 AS x, count(*) AS n FROM events GROUP BY ALL),
days AS (SELECT DISTINCT day FROM cells), grid AS (SELECT day, y, x FROM days, (SELECT unnest(range(24)) AS y), (SELECT unnest(range(32)) AS x)),
fr AS (SELECT grid.day - (SELECT min(day) FROM days) AS idx, grid.y, grid.x, coalesce(n, 0) / (SELECT max(n) FROM cells) AS v FROM grid LEFT JOIN cells ON cells.day = grid.day AND cells.y = grid.y AND cells.x = grid.x)"""
