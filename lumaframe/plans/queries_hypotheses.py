"""Queries of robust homographies: matches of a hundred image pairs made from the suppliers' lines, a quarter of them wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hypotheses
from .queries_images import add
from .views import table


def _entries(p: str, k: str = "0") -> list[str]:
    """Entries of a pair's homography, moved a little by k."""
    return [f"(1 + {p} % 7 * 0.05)", f"({p} % 5 * 0.02 + {k} * 0.001)", f"({p} % 11 * 1.0 + {k} * 0.5)", f"({p} % 3 * -0.03)", f"(0.9 + {p} % 4 * 0.04)", f"({p} % 13 * -0.5)", f"({p} % 6 * 0.0001)", f"({p} % 4 * 0.0002)", "1.0"]


def _mapped(p: str) -> tuple[str, str]:
    a, b, c, d, e, f, g, h, i = _entries(p)
    return f"({a} * x + {b} * y + {c}) / ({g} * x + {h} * y + {i})", f"({d} * x + {e} * y + {f}) / ({g} * x + {h} * y + {i})"


_U, _V = _mapped("pair_id")
_WRONG = "l_linenumber = 1"
_POINTS = "SELECT l_suppkey AS pair_id, l_orderkey * 10 + l_linenumber AS idx, l_linenumber, l_quantity AS x, round(l_extendedprice / 500) AS y FROM lineitem"
_MATCHES = f"SELECT pair_id, idx, x, y, {_U} + CASE WHEN {_WRONG} THEN 20 + idx % 50 ELSE 0 END AS u, {_V} - CASE WHEN {_WRONG} THEN 15 + idx % 40 ELSE 0 END AS v FROM ({_POINTS})"


def _matches(s: SparkSession, d: str) -> DataFrame:
    pairs = table(s, d, "lineitem").selectExpr("CAST(l_suppkey AS BIGINT) AS pair_id", "l_orderkey * 10 + l_linenumber AS idx", "l_linenumber", "l_quantity AS x", "round(l_extendedprice / 500) AS y")
    wrong = lambda by, n: f"CASE WHEN {_WRONG} THEN {by} + idx % {n} ELSE 0 END"
    return pairs.selectExpr("pair_id", "idx", "x", "y", f"{_U} + {wrong(20, 50)} AS u", f"{_V} - {wrong(15, 40)} AS v")


def _fixed(s: SparkSession, d: str) -> DataFrame:
    """Ten hypotheses a pair, from the true one further and further away."""
    pairs = table(s, d, "lineitem").select(F.col("l_suppkey").cast("long").alias("pair_id")).distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(9))))
    return pairs.selectExpr("pair_id", "k", f"transform(array({', '.join(_entries('pair_id', 'k'))}), e -> CAST(e AS DOUBLE)) AS matrix")


_A = _entries("pair_id", "k")
_ERROR = f"sqrt(pow(({_A[0]} * x + {_A[1]} * y + {_A[2]}) / ({_A[6]} * x + {_A[7]} * y + 1) - u, 2) + pow(({_A[3]} * x + {_A[4]} * y + {_A[5]}) / ({_A[6]} * x + {_A[7]} * y + 1) - v, 2))"
add(
    "hypothesis_inliers", lambda s, d: hypotheses.inlier_counts(_matches(s, d), _fixed(s, d), 1.7),
    f"SELECT pair_id, k::INTEGER AS k, count(*) FILTER ({_ERROR} < 1.7) AS inliers FROM ({_MATCHES}), range(10) AS r(k) GROUP BY pair_id, k",
)


def _told(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *[(F.round(F.col("matrix")[i], 4) + 0).alias(f"m{i}") for i in range(9)])


_ROUNDED = ", ".join(f"round({e}::DOUBLE, 4) + 0 AS m{i}" for i, e in enumerate(_entries("pair_id")))
add(
    "robust_homographies", lambda s, d: _told(hypotheses.robust_homographies(_matches(s, d), n=96, reach=0.5), "pair_id", "inliers"),
    f"SELECT pair_id, count(*) FILTER (sqrt(pow(u - {_U}, 2) + pow(v - {_V}, 2)) < 0.5) AS inliers, {_ROUNDED} FROM ({_MATCHES}) GROUP BY pair_id",
)


def _steps(s: SparkSession, d: str) -> DataFrame:
    """Small steps from image to image, one panorama for each priority of orders: few long chains."""
    o = table(s, d, "orders").selectExpr("CAST(ascii(o_orderpriority) AS BIGINT) AS panorama_id", "CAST(o_orderkey AS BIGINT) AS image", "CAST(o_custkey % 10 AS DOUBLE) AS t")
    return o.select("panorama_id", "image", F.array(*[F.expr(e).cast("double") for e in ("1 + (t - 4.5) * 0.001", "(t - 4.5) * 0.002", "t - 4.5", "(t - 4.5) * -0.002", "1 - (t - 4.5) * 0.001", "0.5 * t - 2", "0", "0", "1")]).alias("matrix"))


add(
    "homography_chain", lambda s, d: hypotheses.chained(_steps(s, d), length=128, fan=8).select("panorama_id", "image", *[(F.round(F.col("matrix")[i], 3) + 0).alias(f"m{i}") for i in range(6)]),
    """WITH RECURSIVE o AS MATERIALIZED (SELECT ascii(o_orderpriority)::BIGINT AS panorama_id, o_orderkey::BIGINT AS image, (o_custkey % 10)::DOUBLE AS t, row_number() OVER (PARTITION BY ascii(o_orderpriority) ORDER BY o_orderkey) AS k FROM orders),
m AS MATERIALIZED (SELECT panorama_id, image, k, 1 + (t - 4.5) * 0.001 AS a, (t - 4.5) * 0.002 AS b, t - 4.5 AS c, (t - 4.5) * -0.002 AS d, 1 - (t - 4.5) * 0.001 AS e, 0.5 * t - 2 AS f FROM o),
p(panorama_id, image, k, a, b, c, d, e, f) AS (
  SELECT * FROM m WHERE k = 1
  UNION ALL
  SELECT m.panorama_id, m.image, m.k, p.a * m.a + p.b * m.d, p.a * m.b + p.b * m.e, p.a * m.c + p.b * m.f + p.c, p.d * m.a + p.e * m.d, p.d * m.b + p.e * m.e, p.d * m.c + p.e * m.f + p.f
  FROM p JOIN m ON m.panorama_id = p.panorama_id AND m.k = p.k + 1)
SELECT panorama_id, image, round(a, 3) + 0 AS m0, round(b, 3) + 0 AS m1, round(c, 3) + 0 AS m2, round(d, 3) + 0 AS m3, round(e, 3) + 0 AS m4, round(f, 3) + 0 AS m5 FROM p""",
)
