"""Embedding near duplicates, Merkle manifests and vector codes against brute force, with odd inputs."""

import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumaframe.llm import embedding_dedup, merkle, vector_codes
from lumaframe.llm.embedding_dedup import Forest, Tile, candidates, cell_links, embedding_near_dedup
from lumaframe.llm.merkle import manifest_digests, merkle_manifest
from lumaframe.llm.vector_codes import Codebook, short_forms
from lumaframe.llm.vector_codes import vector_codes as encode_vectors

VECTORS = "vec_id long, embedding array<float>, label int, cls string, id long, vec string"


def vectors_of(spark, rows):
    """Embeddings with further columns whose names clash with helper columns."""
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, "c", 1, "v") for i, v, label in rows], VECTORS)


# --- embedding near dedup ---------------------------------------------------------------


def brute_near(rows, threshold=0.93):
    def unit(v, label):
        if label is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        a = np.array(v, np.float32).astype(float)
        a /= np.abs(a).max()
        return a / np.linalg.norm(a)

    units = [unit(v, label) for _, v, label in rows]
    n = len(rows)
    links = [[j for j in range(n) if j != i and units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((rows[i][0], len(links[i]), least, rows[i][0] == least))
    return sorted(out, key=str)


def near_rows(seed=5):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for label in (0, 1, 1, 2):
        centre = rng.normal(size=12)
        for _ in range(40):  # a chain of neighbours, and near copies
            centre = centre + rng.normal(size=12) * 0.25
            rows.append((i, centre.tolist(), label))
            i += 1
    rows += [(i + k, rows[3][1], 0) for k in range(30)]  # equal vectors
    rows += [(i + 40, [x * 1e30 for x in rows[3][1]], 0), (i + 41, [x * 1e-30 for x in rows[3][1]], 0)]
    rows += [(rows[3][0], rows[3][1], 0), (None, rows[3][1], 0), (None, rng.normal(size=12).tolist(), 0), (i + 45, rows[3][1], None)]
    rows += [(i + 50, None, 0), (i + 51, [], 0), (i + 52, [0.0] * 12, 0), (i + 53, [float("nan")] + [1.0] * 11, 0), (i + 54, [None] + [1.0] * 11, 0), (i + 55, [float("inf")] + [1.0] * 11, 0)]
    rows += [(i + 56, [0.0] * 11 + [1.0], 7), (i + 57, [-0.0] * 11 + [1.0], 7), (i + 58, [1.0, 0.0], 7), (i + 59, [1.0], 7)]
    return rows


@pytest.mark.parametrize("tile", [1 << 20, 1])
def test_near_embeddings(spark, monkeypatch, tile):
    monkeypatch.setattr(embedding_dedup, "TILE_BYTES", tile)
    monkeypatch.setattr(embedding_dedup, "STRIP", 16)
    rows = near_rows()
    got = sorted(map(tuple, embedding_near_dedup(vectors_of(spark, rows).repartition(5)).collect()), key=str)
    assert got == brute_near(rows)


def test_near_embeddings_of_nothing(spark):
    got = embedding_near_dedup(vectors_of(spark, []))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"] and got.count() == 0
    with pytest.raises(ValueError):
        embedding_near_dedup(vectors_of(spark, []), threshold=0)


def test_bounds_lose_no_pair():
    rng = np.random.default_rng(1)
    for d in (2, 64, 2500):
        centre = rng.normal(size=d)
        x = centre + rng.normal(size=(300, d)) * rng.choice([0.05, 0.3, 0.4], size=(300, 1))
        x *= 10.0 ** rng.integers(-20, 20, size=(300, 1))
        a = Tile(np.arange(300), np.ones(300, int), x)
        cosine = a.unit @ a.unit.T
        maybe = candidates(a, a, slice(0, 300), 0.93)
        assert not (cosine >= 0.93)[~maybe].any()
        assert maybe.sum() < (cosine >= 0.93 - 0.05).sum() + 1  # and few others are computed again
        ids, links, _ = cell_links(a, a, 0.93)
        want = (cosine >= 0.93).sum(1) - 1
        assert dict(zip(ids, links, strict=True)) == {i: n for i, n in enumerate(want) if n}


def test_forest_of_blocks():
    rng = np.random.default_rng(3)
    u, v = rng.integers(0, 200, 150), rng.integers(0, 200, 150)
    forest = Forest(200)
    for k in range(0, 150, 40):
        forest.link(u[k : k + 40], v[k : k + 40])
    label = list(range(200))
    for a, b in zip(u, v, strict=True):
        low, high = sorted((label[a], label[b]))
        label = [low if x == high else x for x in label]
    assert forest.parent.tolist() == label


# --- Merkle manifest --------------------------------------------------------------------

DOCS = "doc_id long, source string, lang string, n_chars long, text string, idx string, grp long, digest string"


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def leaf_of(row, lower=False):
    i, source, lang, n, text = row
    if lower and text is not None:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in (i, source, lang, n, text)))


def tree_of(leaves):
    """Levels of digests, and each leaf's siblings."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    paths = []
    for at in range(len(leaves)):
        path = []
        for level in levels[:-1]:
            start = at - at % 16
            path.append((level[start:at], level[at + 1 : start + 16]))
            at //= 16
        paths.append(path)
    return levels[-1][0], paths


def brute_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in groups.values():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    trees = {s: tree_of([leaf_of(r) for r in groups[s]]) for s in names}
    root, tops = tree_of([trees[s][0] for s in names])
    out = []
    for s, top in zip(names, tops, strict=True):
        for r, path in zip(groups[s], trees[s][1], strict=True):
            path = path + top
            node = leaf_of(r, lower=r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0)
            for before, after in path:
                node = sha("".join([*before, node, *after]))
            out.append((r[0], leaf_of(r), trees[s][0], root, sha("".join(x for b, a in path for x in b + a)), node, node == root))
    return sorted(out, key=str)


def manifest_of(spark, rows, parts=6):
    df = spark.createDataFrame([(*r, "i", 3, "d") for r in rows], DOCS).repartition(parts)
    return sorted(map(tuple, manifest_digests(df).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


@pytest.mark.parametrize("k", [1, 2, 3])
def test_manifest(spark, monkeypatch, k):
    monkeypatch.setattr(merkle, "K", k)
    rows = [(i * 7, "hot" if i % 3 else f"s{i % 23}", "en", i, f"Text {i} Ä") for i in range(420)]
    rows += [(5000, None, None, None, None), (5001, "ω", "de", 1, "x" * 500_000), (None, "hot", "en", 1, "no id"), (None, "hot", "en", 1, "no id"), (7, "hot", "en", 1, "same id"), (2**53 + 1, "hot", "", 0, "")]
    assert manifest_of(spark, rows) == brute_manifest(rows)


def test_manifest_of_few_rows(spark):
    assert manifest_of(spark, []) == []
    one = [(10, "a", "en", 3, "ABC")]
    got = manifest_of(spark, one)
    assert got == brute_manifest(one) and got[0][1] == got[0][3] and got[0][4] == sha("")


def test_proofs_show_what_changed(spark):
    rows = [(i, f"s{i % 3}", "en", 1, f"T{i}") for i in range(60)]
    df = spark.createDataFrame([(*r, "i", 3, "d") for r in rows], DOCS)
    got = merkle_manifest(df, changed={"n_chars": F.col("n_chars") + 1}, where=F.col("doc_id") % 10 == 0).collect()
    assert {r["doc_id"] for r in got if not r["verified"]} == {r["doc_id"] for r in got if r["tampered"]} == set(range(0, 60, 10))
    for r in got:
        assert merkle.fold(r["leaf"], [(p["before"], p["after"]) for p in r["proof"]]) == r["root"]
    with pytest.raises(ValueError):
        merkle_manifest(df, id_col="absent")


def test_manifest_of_groups_that_are_numbers(spark):
    df = spark.createDataFrame([(i, i % 3 if i % 5 else None, "t") for i in range(30)], "doc_id long, source long, text string")
    got = merkle_manifest(df, fields=("doc_id", "text")).collect()
    assert len(got) == 30 and all(r["verified"] for r in got) and len({r["subroot"] for r in got}) == 4


# --- vector codes -----------------------------------------------------------------------


def brute_codes(rows, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = len(kept[0][1])
    cut = [p * d // 4 for p in range(5)]
    books = [[r[1][a:b] for r in kept[:entries]] for a, b in zip(cut, cut[1:], strict=False)]

    def nearest(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(nearest(books[p], v[a:b])[1], []).append(v[a:b])
            books[p] = [[sum(c) // len(c) for c in zip(*groups[e], strict=True)] if e in groups else old for e, old in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    out, sums = [], {}
    for i, v, label in kept:
        found = [nearest(books[p], v[cut[p] : cut[p + 1]]) for p in range(4)]
        error = sum(f[0] for f in found)
        sums[label] = sums.get(label, 0) + error
        out.append((i, "".join(f"{f[1]:02x}" for f in found), error, label))
    return sorted(((i, code, error, sums[label], digest) for i, code, error, label in out), key=str)


def test_vector_codes(spark):
    rng = np.random.default_rng(8)
    rows = [(int(i), (rng.normal(size=10) * 0.3).tolist(), int(rng.integers(0, 3)) if i % 7 else None) for i in rng.permutation(420)]
    rows += [(1000 + k, rows[0][1], 1) for k in range(150)] + [(1000, rows[1][1], 1), (1000, rows[1][1], 1), (None, rows[2][1], 2), (3000, [-900.0] * 10, 2)]
    odd = [(2000, None, 1), (2001, [], 1), (2002, [None] * 10, 1), (2003, [float("nan")] * 10, 1), (2004, [float("-inf")] * 10, 1)]
    got = encode_vectors(vectors_of(spark, rows + odd).repartition(5))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_codes(rows)
    # What doesn't fit the rest goes.
    more = [(4000, [1.0] * 9, 1), (4001, [1e30] * 10, 1), (4002, [1e6] * 10, 1)]
    assert sorted(map(tuple, encode_vectors(vectors_of(spark, rows + more)).collect()), key=str) == brute_codes(rows)


def test_vector_codes_of_few_rows(spark):
    assert encode_vectors(vectors_of(spark, [])).count() == 0
    assert encode_vectors(vectors_of(spark, [(1, None, 1), (2, [], None)])).count() == 0
    few = [(3, [0.5, -0.5, 0.25, 1.0], None), (1, [0.5, -0.5, 0.25, 1.0], 2), (2, [0.1, 0.2, 0.3, 0.4], 2)]
    assert sorted(map(tuple, encode_vectors(vectors_of(spark, few)).collect()), key=str) == brute_codes(few)


def test_segment_means_bound_and_filter():
    rng = np.random.default_rng(2)
    centres = rng.integers(-400, 400, size=(256, 16))
    x = centres[rng.integers(0, 256, 600)] + rng.integers(-40, 40, size=(600, 16))
    exact = ((x[:, None] - centres[None]) ** 2).sum(2)
    for f, g in zip(short_forms(x), short_forms(centres), strict=True):
        assert (((f[:, None] - g[None]) ** 2).sum(2) <= exact + 1e-6).all()
    book = Codebook(centres)
    code, distance = book.nearest(x)
    assert (code == exact.argmin(1)).all() and (distance == exact.min(1)).all()
    assert book.compared < book.possible / 20  # where there is structure, few entries are left


@pytest.mark.parametrize("scale", [1, 2**24])
def test_nearest_with_ties_and_large_numbers(scale):
    rng = np.random.default_rng(4)
    entries = rng.integers(-3, 4, size=(64, 5)) * scale
    x = np.concatenate([entries[:20], rng.integers(-3, 4, size=(200, 5)) * scale, np.zeros((3, 5), int)])
    code, distance = Codebook(entries).nearest(x)
    exact = ((x[:, None].astype(object) - entries[None].astype(object)) ** 2).sum(2)
    assert code.tolist() == [int(np.argmin(row)) for row in exact] and distance.tolist() == [min(row) for row in exact]
