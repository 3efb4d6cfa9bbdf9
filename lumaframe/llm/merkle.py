"""Merkle manifest of a dataset: roots, inclusion proofs and checks, by superblock reduction.

A row's leaf is the digest of its fields. The leaves of a group (a source) ascend by id and are numbered; numbers are
bucketed by ``FANOUT ** K`` (4,096), and ``applyInPandas`` collapses the K levels inside a bucket to the bucket's root. The
roots are nodes of the next round, until each group has one, its subroot; the subroots, ordered by group, form a
tree of their own in the same way. On the way back each bucket gets the proof above it once, and a row's proof is the levels inside
its bucket followed by that. So a task holds one bucket, and no proof is stored for each row.

Numbers come from a range partition by (group, id, leaf): a row's place in its partition plus what the partitions before
hold of its group, a sum over one row for each pair of partition and group. A group may hold any share of the rows.

Defined cases: a null field is ``-``; null ids come first in their group, are never tampered with, and their rows are
leaves as others are; rows of equal ids are ordered by their leaves, so that repeated rows are leaves of their own;
a null group is a group, the first, and groups that are not strings are ordered by their text; an empty table gives an empty result; very long texts are only hashed, by
the JVM, and do not travel; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table_columns, written

FANOUT = 16
#: Levels collapsed at once.
K = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LEVELS = "array<struct<before:string,after:string>>"
HEX = 64


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(*fields: Column) -> Column:
    """Digest of fields: each ``-`` if null, else the number of its UTF-8 bytes, a colon, and the value."""
    one = lambda f: F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-"))
    return F.sha2(F.concat(*[one(f.cast("string")) for f in fields]).cast("binary"), 256)


def _height(total: int) -> int:
    """Levels above ``total`` nodes."""
    h = 0
    while FANOUT**h < total:
        h += 1
    return h


def _runs_above(nodes: list[str], levels: int) -> list[list[str]]:
    """Of each of ``levels`` levels the joined digests of its runs; the last entry is the root alone."""
    out = []
    for _ in range(levels):
        runs = ["".join(nodes[i : i + FANOUT]) for i in range(0, len(nodes), FANOUT)]
        out.append(runs)
        nodes = [digest(r) for r in runs]
    return [*out, nodes]


def _path(runs: list[list[str]], at: int) -> list[tuple[str, str]]:
    """Siblings left and right of node ``at``, level by level."""
    out = []
    for level in runs[:-1]:
        at, place = divmod(at, FANOUT)
        out.append((level[at][: place * HEX], level[at][(place + 1) * HEX :]))
    return out


def fold(leaf: str, levels: list[tuple[str, str]]) -> str:
    """The root that a leaf and the siblings on its way give."""
    for before, after in levels:
        leaf = digest(before + leaf + after)
    return leaf


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``idx``, the place in the group by ``order``, and ``total``, the rows of the group."""
    by = [F.col(c).asc_nulls_first() for c in (group, *order)]
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("place", F.monotonically_increasing_id())
    placed = written(placed.withColumn("pid", F.shiftright("place", 33)), "places")
    runs = placed.groupBy(group, "pid").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy(group).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    runs = runs.select(F.col(group).alias("g"), F.col("pid").alias("p"), "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.sum("n").over(Window.partitionBy(group)).alias("total"))
    met = placed.join(runs, placed[group].eqNullSafe(runs["g"]) & (placed["pid"] == runs["p"]))
    return met.withColumn("idx", F.col("place") - F.col("first") + F.col("offset")).drop("place", "pid", "first", "offset", "g", "p")


def _collapsed(nodes: DataFrame, group: str, carried: list[str]) -> DataFrame:
    """One row a bucket: its number, the nodes of its group on this new level, its root, and the arrays of its nodes."""
    kinds = dict(nodes.dtypes)
    bucket = nodes.withColumn("bucket", F.floor(F.col("idx") / FANOUT**K).cast("long"))
    schema = f"`{group}` {kinds[group]}, idx long, total long, levels int, digest string, digests array<string>" + "".join(f", `{c}` array<{kinds[c]}>" for c in carried)

    def collapse(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        total = int(pdf["total"].iloc[0])
        levels = min(K, _height(total))
        digests = pdf["digest"].tolist()
        root = _runs_above(digests, levels)[-1][0]
        columns = [pdf[c].astype(object).where(pdf[c].notna(), None).tolist() for c in carried]
        name = key[0] if not pd.isna(key[0]) else None
        return pd.DataFrame([[name, int(key[1]), -(-total // FANOUT**levels), levels, root, digests, *columns]], columns=[group, "idx", "total", "levels", "digest", "digests", *carried])

    return bucket.groupBy(group, "bucket").applyInPandas(collapse, schema)


def _rounds(nodes: DataFrame, group: str, carried: list[str]) -> list[DataFrame]:
    """Written buckets of each round; those of the last are one a group, with its root as ``digest``."""
    out = [written(_collapsed(nodes, group, carried), "buckets")]
    while out[-1].filter("total > 1").limit(1).count():
        out.append(written(_collapsed(out[-1].select(group, "idx", "total", "digest"), group, []), "buckets"))
    return out


def _expanded(buckets: DataFrame, group: str, child: str | None) -> DataFrame:
    """Of each node in ``buckets`` (which have ``upper``, the proof above them) its number, or ``child``, and its proof."""
    kind = dict(buckets.dtypes)
    keyed = child or group
    of = f"`{keyed}` {kind[child][6:-1] if child else kind[group]}, idx long, upper {LEVELS}"

    def expand(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for row in pdf.to_dict("records"):
                runs = _runs_above(list(row["digests"]), row["levels"])
                upper = [(x["before"], x["after"]) for x in row["upper"]]
                n = len(row["digests"])
                names = list(row[child]) if child else [row[group] if not pd.isna(row[group]) else None] * n
                proofs = [[{"before": b, "after": a} for b, a in _path(runs, i) + upper] for i in range(n)]
                yield pd.DataFrame({keyed: pd.Series(names, dtype=object), "idx": [row["idx"] * FANOUT**K + i for i in range(n)], "upper": proofs})

    return buckets.mapInPandas(expand, of)


def _with_upper(buckets: DataFrame, upper: DataFrame, group: str) -> DataFrame:
    u = upper.select(F.col(group).alias("g"), F.col("idx").alias("i"), "upper")
    return buckets.join(u, buckets[group].eqNullSafe(u["g"]) & (buckets["idx"] == u["i"])).drop("g", "i")


def merkle_manifest(df: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = FIELDS, changed: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """One row per row of ``df``: id, leaf, subroot, root, proof (levels of siblings), tampered, folded_root, verified.

    ``changed`` names columns and what they read as after tampering, of the rows ``where`` holds; there
    ``folded_root`` is folded from the changed row's leaf and the original siblings, elsewhere from the leaf itself.
    """
    return _manifest(df, id_col, group_col, fields, changed, where, digest_only=False)


def _manifest(df: DataFrame, id_col: str, group_col: str, fields: tuple[str, ...], changed: dict[str, Column] | None, where: Column | None, digest_only: bool) -> DataFrame:
    table_columns(df, id_col, group_col, *fields)
    changed = changed or {}
    quoted = lambda c: F.col(f"`{c}`")
    now = leaf_digest(*[changed.get(f, quoted(f)) for f in fields])
    hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(False)
    leaves = written(df.select(quoted(group_col).cast("string").alias("grp"), quoted(id_col).alias("id"), leaf_digest(*[quoted(f) for f in fields]).alias("digest"), F.when(hit, now).alias("tampered")), "leaves")
    # Ids travel as text, as pandas would read longs beside nulls as doubles.
    kind = dict(leaves.dtypes)["id"]
    rounds = _rounds(numbered(leaves, "grp", ["id", "digest"]).withColumn("id", F.col("id").cast("string")), "grp", ["id", "tampered"])
    subroots = rounds[-1].select(F.lit(0).alias("all"), F.col("grp").alias("member"), "digest")
    top = _rounds(numbered(subroots, "all", ["member"]), "all", ["member"])

    root = top[-1].select(F.col("digest").alias("root"))
    none = F.array().cast(LEVELS)
    upper = top[-1].select("all", "idx", none.alias("upper"))
    for k in range(len(top) - 1, -1, -1):
        upper = _expanded(_with_upper(top[k], upper, "all"), "all", "member" if k == 0 else None)
    # The proofs of the subroots are those above the single bucket that each group ends with.
    upper = written(upper.select(F.col("member").alias("grp"), F.lit(0).cast("long").alias("idx"), "upper"), "proofs")
    for k in range(len(rounds) - 1, 0, -1):
        upper = written(_expanded(_with_upper(rounds[k], upper, "grp"), "grp", None), "proofs")
    ends = rounds[-1].select(F.col("grp").alias("g"), F.col("digest").alias("subroot"))
    buckets = _with_upper(rounds[0], upper, "grp")
    buckets = buckets.join(ends, buckets["grp"].eqNullSafe(ends["g"])).drop("g").crossJoin(F.broadcast(root))  # one row
    proof = "proof_sha256 string" if digest_only else f"proof {LEVELS}"

    def prove(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for row in pdf.to_dict("records"):
                digests = list(row["digests"])
                runs = _runs_above(digests, row["levels"])
                upper = [(x["before"], x["after"]) for x in row["upper"]]
                paths = [_path(runs, i) + upper for i in range(len(digests))]
                tampered = [t if isinstance(t, str) else None for t in row["tampered"]]
                folded = [fold(t or d, path) for d, t, path in zip(digests, tampered, paths, strict=True)]
                out = {"id": pd.Series(list(row["id"]), dtype=object), "leaf": digests, "subroot": row["subroot"], "root": row["root"]}
                if digest_only:
                    out["proof_sha256"] = [digest("".join(x for level in path for x in level)) for path in paths]
                else:
                    out["proof"] = [[{"before": b, "after": a} for b, a in path] for path in paths]
                yield pd.DataFrame(out | {"tampered": [t is not None for t in tampered], "folded_root": folded, "verified": [f == row["root"] for f in folded]})

    done = buckets.select("levels", "digests", "id", "tampered", "upper", "subroot", "root").mapInPandas(prove, f"id string, leaf string, subroot string, root string, {proof}, tampered boolean, folded_root string, verified boolean")
    return done.select(F.col("id").cast(kind).alias(id_col), *done.columns[1:])


def tampered_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[dict[str, Column], Column]:
    """The tampering of the registered query: texts in small letters, where 5 divides the id's checksum."""
    import string

    lower = F.translate(F.col(f"`{text_col}`"), string.ascii_uppercase, string.ascii_lowercase)
    return {text_col: lower}, F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5 == 0


def manifest_digests(df: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row of ``df`` (documents)."""
    changed, where = tampered_text(df)
    return _manifest(df, "doc_id", "source", FIELDS, changed, where, digest_only=True).drop("tampered")
