"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel counts common subsequences of four letters inside a span of six, each
skipped letter weighing ``DECAY``, so ``idxiot`` and ``id-iot`` still share most of ``idiot``.
Punctuation and digits inside words are passed over, accents are dropped, common digit and sign
substitutions are read as letters, white space is one symbol.

Sentences of labelled documents are read in windows of a fixed number of letters. A
document is toxic if one of its windows is, so training alternates between
choosing the worst window of each toxic document and fitting a linear support vector
machine on Nyström features of the windows' kernel values with the landmarks. The
machine is linear in the kernel with the landmarks, which is a sum over subsequences: folded
into one weight per subsequence, a text is scored whole in one pass. A logistic function
of the highest window is the document's score.

Defined cases: null and empty texts have no window and get the score of a text without
signs of toxicity; labels that are null are not learned, of several labels of an id
the highest counts; without labels of both classes every score is the share of
toxic labels; repeated rows get equal results; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import bounded_batches, crc_bucket

#: Labelled documents of each class that a model is trained on, at most, and the longest text among them.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 1200, 2400, 8000
LANDMARKS, WINDOW, ROUNDS = 480, 14, 4
LETTERS, ORDER, SPAN, DECAY, SYMBOLS = 5, 4, 6, 0.75, 32
#: Letters of one block of texts.
BLOCK = 1 << 18

# Signs read as letters.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "ß": "s", "æ": "a", "ø": "o", "œ": "o", "ł": "l", "đ": "d"}

_OFFSETS = [(o, DECAY ** (o[-1] - ORDER + 1)) for o in combinations(range(1, SPAN), ORDER - 1)]
_PASS = 255


def _symbols() -> np.ndarray:
    """Symbol of each code point below 0x3000: 0 space, 1-26 letters, 27-31 other letters, 255 passed over."""
    out = np.full(0x3000, _PASS, np.uint8)
    for c in range(0x3000):
        ch = chr(c)
        base = unicodedata.normalize("NFKD", LOOKALIKES.get(ch.lower(), ch.lower()))[:1]
        if "a" <= base <= "z":
            out[c] = ord(base) - 96
        elif ch.isspace():
            out[c] = 0
        elif ch.isalpha():
            out[c] = 27 + c % 5
    return out


_TABLE = _symbols()
_NONE = np.zeros(2, np.uint8)


def symbols(text: str) -> np.ndarray:
    """The text's symbols, padded by a space on both sides; runs of spaces are one."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    s = np.where(points < 0x3000, _TABLE[np.minimum(points, 0x2FFF)], 27 + points % 5).astype(np.uint8)
    s = s[s != _PASS]
    s = np.concatenate([[0], s, [0]]).astype(np.uint8)
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
    return s[keep]


def subsequences(s: np.ndarray):
    """(codes, weight) for each pattern of gaps: codes[i] is the subsequence that starts at i, as far as it ends within ``s``."""
    wide = s.astype(np.int32)
    shifted = [wide << (LETTERS * (ORDER - 1 - k)) for k in range(ORDER)]
    for offsets, weight in _OFFSETS:
        n = max(len(s) - offsets[-1], 0)
        code = shifted[0][:n].copy()
        for k, o in enumerate(offsets):
            code |= shifted[k + 1][o : o + n]
        yield code, weight


def _by_start(s: np.ndarray, weights: np.ndarray) -> dict[int, np.ndarray]:
    """By the last offset of their patterns, the weighted subsequences that start at each place."""
    out: dict[int, np.ndarray] = {}
    for (offsets, _), (codes, weight) in zip(_OFFSETS, subsequences(s), strict=True):
        if offsets[-1] not in out:
            out[offsets[-1]] = np.zeros(len(s), np.float32)
        out[offsets[-1]][: len(codes)] += np.float32(weight) * weights[codes]
    return out


def feature_map(s: np.ndarray) -> dict[int, float]:
    """Weight of each subsequence in ``s``; the kernel of two strings is the product of their maps."""
    out: dict[int, float] = {}
    for codes, weight in subsequences(s):
        for c in codes.tolist():
            out[c] = out.get(c, 0.0) + weight
    return out


def kernel(a: str, b: str) -> float:
    """The normalised kernel of two strings."""
    x, y = feature_map(symbols(a)), feature_map(symbols(b))
    dot = lambda p, q: sum(v * q.get(c, 0.0) for c, v in p.items())
    return dot(x, y) / np.sqrt(dot(x, x) * dot(y, y))


@dataclass
class ToxicityModel:
    prior: float
    weights: np.ndarray | None = None
    slope: float = 0.0
    shift: float = 0.0

    def window_sums(self, s: np.ndarray) -> np.ndarray:
        """Kernel machine's value of each window: of the subsequences that lie wholly inside it."""
        width = min(WINDOW, len(s))
        out = np.zeros(len(s) - width + 1)
        for last, v in _by_start(s, self.weights).items():
            if width > last:
                total = np.concatenate([[0.0], np.cumsum(v, dtype=np.float64)])
                out += total[width - last : len(s) - last + 1] - total[: len(out)]
        return out

    def peak(self, text: str | None) -> float:
        return float(self.window_sums(symbols(text)).max()) if text else 0.0

    def peaks(self, texts: list[str | None]) -> np.ndarray:
        """Highest window of each text. Texts are joined by gaps longer than a window, so that none reaches into another."""
        out = np.zeros(len(texts))
        gap = np.zeros(WINDOW + SPAN, np.uint8)
        todo: list[tuple[int, np.ndarray]] = []
        size = 0

        def solve():
            joined = np.concatenate([x for _, s in todo for x in (s, gap)])
            starts = np.cumsum([0] + [len(s) + len(gap) for _, s in todo])
            v = self.window_sums(joined)
            ends = [min(len(v), max(a + 1, a + len(s) - WINDOW + 1)) for a, (_, s) in zip(starts, todo, strict=False)]
            for (i, _), a, b in zip(todo, starts, ends, strict=False):
                out[i] = v[a:b].max()

        for i, t in enumerate(texts):
            s = symbols(t) if t else _NONE
            if len(s) < WINDOW:
                out[i] = self.window_sums(s).max()
            else:
                todo.append((i, s))
                size += len(s)
                if size > BLOCK:
                    solve()
                    todo, size = [], 0
        if todo:
            solve()
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.peaks(texts) + self.shift, -30, 30)))


def _words(text: str) -> set[bytes]:
    return {w for w in symbols(text).tobytes().split(b"\0") if w}


def _linear_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Squared hinge loss with an L2 penalty, by Newton's method; rows are read in blocks."""
    n, d = x.shape
    ridge = np.eye(d + 1)
    ridge[d, d] = 1e-3
    w = np.zeros(d + 1)
    for _ in range(rounds):
        left, right = ridge.copy(), np.zeros(d + 1)
        for at in range(0, n, 2048):
            part, yp = x[at : at + 2048], y[at : at + 2048]
            on = yp * (part @ w[:d].astype(np.float32) + w[d]) < 1
            z = np.concatenate([part[on].astype(np.float64), np.ones((int(on.sum()), 1))], 1)
            zc = z * cost[at : at + 2048][on, None]
            left += zc.T @ z
            right += zc.T @ yp[on]
        new = np.linalg.solve(left, right)
        done = np.abs(new - w).max() < 1e-5
        w = new
        if done:
            break
    return w[:d], float(w[d])


def fit(texts: list[str], labels: list[int], share: float | None = None, seed: int = 0) -> ToxicityModel:
    """``share``: of toxic documents among all labelled ones, to which scores are calibrated (default: as in the sample)."""
    y = np.array(labels, int)
    if not len(y) or y.min() == y.max():
        return ToxicityModel(float(y.mean() if share is None else share) if len(y) else 0.0)
    share = min(max(y.mean() if share is None else share, 1e-6), 1 - 1e-6)
    odds_shift = np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
    rng = np.random.default_rng(seed)
    # Landmarks: words by how much likelier toxic documents hold them, and frequent words of both classes.
    seen: tuple[dict[bytes, int], dict[bytes, int]] = ({}, {})
    for t, c in zip(texts, y, strict=True):
        for w in _words(t):
            seen[c][w] = seen[c].get(w, 0) + 1
    n1, n0 = int(y.sum()), int((1 - y).sum())
    odds = {w: np.log((k + 0.1) / n1) - np.log((seen[0].get(w, 0) + 0.5) / n0) for w, k in seen[1].items()}
    evidence = {w: v * np.sqrt(seen[1][w]) for w, v in odds.items()}
    chosen = sorted(evidence, key=lambda w: (-evidence[w], w))[: LANDMARKS // 2]
    for side in (seen[0], seen[1]):
        chosen += sorted(side, key=lambda w: (-side[w], w))[: LANDMARKS // 4]
    marks = [np.concatenate([[0], np.frombuffer(w[:WINDOW], np.uint8), [0]]).astype(np.uint8) for w in dict.fromkeys(chosen)]
    maps = [feature_map(m) for m in marks]
    maps = [{c: v / np.sqrt(sum(u * u for u in m.values())) for c, v in m.items()} for m in maps]
    codes = {c: k for k, c in enumerate(sorted({c for m in maps for c in m}))}
    table = np.zeros((len(codes) + 1, len(maps)), np.float32)  # last row: subsequences of no landmark
    for j, m in enumerate(maps):
        for c, v in m.items():
            table[codes[c], j] = v
    place = np.full(SYMBOLS**ORDER, len(codes), np.int32)
    place[list(codes)] = list(codes.values())
    gram = table[:-1].T @ table[:-1]
    value, vector = np.linalg.eigh(gram.astype(np.float64))
    live = value > 1e-6 * value.max()
    root = (vector[:, live] / np.sqrt(value[live])).astype(np.float32)  # Nyström map: K(., landmarks) @ root

    def features(windows: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(windows), len(maps)), np.float32)
        for i, s in enumerate(windows):
            for cs, weight in subsequences(s):
                hits = place[cs]
                hits = hits[hits < len(codes)]
                if len(hits):
                    out[i] += np.float32(weight) * table[hits].sum(0)
        return out @ root

    strings = [symbols(t) for t in texts]

    def window(s: np.ndarray, at: int) -> np.ndarray:
        return s[max(0, at) : max(0, at) + WINDOW]

    def first_choice(s: np.ndarray) -> int:
        """The window around the word that most tells toxic documents."""
        best, where, at = -np.inf, 0, 0
        for w in s.tobytes().split(b"\0"):
            if w and evidence.get(w, -np.inf) > best:
                best, where = evidence[w], at
            at += len(w) + 1
        return where - (WINDOW - 8) // 2

    bad, good = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    positive = [window(strings[i], first_choice(strings[i])) for i in bad]
    negative = [window(s, int(rng.integers(max(1, len(s) - WINDOW)))) for i in good for s in (strings[i],) for _ in range(3)]
    model = ToxicityModel(float(y.mean()), np.zeros(SYMBOLS**ORDER, np.float32))
    clean = features(negative)

    def gapped(s: np.ndarray) -> np.ndarray:
        """The window with a letter put in where the machine sees most, as insults are disguised."""
        v = sum(_by_start(s, model.weights).values(), np.zeros(len(s), np.float32))
        at = int(v.argmax()) + 1 + int(rng.integers(3))
        return np.insert(s, min(at, len(s)), rng.integers(1, 27)).astype(np.uint8)

    disguised: list[np.ndarray] = []
    for turn in range(ROUNDS):
        x = np.concatenate([features(positive + disguised), clean])
        t = np.concatenate([np.ones(len(positive) + len(disguised)), -np.ones(len(clean))])
        cost = np.where(t > 0, 2.0 / (len(positive) + len(disguised)), 2.0 / len(clean)) * 200
        w, _bias = _linear_svm(x, t, cost)
        alpha = (root @ w).astype(np.float32)
        model.weights[:] = 0
        model.weights[list(codes)] = table[:-1] @ alpha
        positive = [window(s, int(model.window_sums(s).argmax())) for i in bad for s in (strings[i],)]
        disguised = [gapped(s) for s in positive]
        if turn < ROUNDS - 1:
            clean = np.concatenate([clean, features([window(s, int(model.window_sums(s).argmax())) for i in good for s in (strings[i],)])])
    # Logistic function of the highest window; disguised windows count as a quarter of a document each.
    peak = np.concatenate([model.peaks(texts), [model.window_sums(s).max() for s in disguised]])
    mass = np.concatenate([np.ones(len(y)), np.full(len(disguised), 0.25)])
    y = np.concatenate([y, np.ones(len(disguised))])
    a, b = 0.0, float(np.log(y.mean() / (1 - y.mean())))
    centre, scale = peak.mean(), peak.std() or 1.0
    u = (peak - centre) / scale
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * u + b, -30, 30)))
        h = np.maximum(p * (1 - p), 1e-9) * mass
        g = np.array([(mass * (p - y) * u).sum() + 1e-2 * a, (mass * (p - y)).sum()])
        hess = np.array([[(h * u * u).sum() + 1e-2, (h * u).sum()], [(h * u).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        step *= min(1.0, 3 / (np.abs(step).max() + 1e-12))
        a, b = a - step[0], b - step[1]
    model.slope, model.shift = float(a / scale), float(b - a * centre / scale + odds_shift)
    return model


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[list[str], list[int], float | None]:
    """Texts and labels of a bounded sample, and the share of toxic ids of all.

    Per class it holds the documents with a text whose ids have the least hash, toxic ones with a short text first; of a
    longer text a window is taken.
    """
    marked = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("key")).agg(F.max(label_col).alias("y")).withColumn("mark", F.xxhash64(F.lit(5), "key"))
    text = F.col(f"`{text_col}`")
    texts = docs.filter(text.isNotNull()).select(F.col(f"`{id_col}`").alias("key"), text.alias("text"))
    order = [(F.col("y") == 1) & F.col("long"), "mark"]
    there = texts.select("key", (F.length("text") > SAMPLE_CHARS).alias("long")).join(marked, "key")
    ids = {r["key"]: r for c, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN)) for r in there.filter(F.col("y") == c).orderBy(*order).limit(2 * n).collect()}
    if not ids:
        return [], [], None
    share = marked.agg(F.avg(F.col("y").cast("double"))).first()[0]
    spark = docs.sparkSession
    picked = F.broadcast(spark.createDataFrame([(k, int(r["y"]), r["mark"]) for k, r in ids.items()], f"key {docs.schema[id_col].dataType.simpleString()}, y int, mark long"))
    at = F.pmod(F.xxhash64(F.lit(6), "key"), F.greatest(F.length("text") - SAMPLE_CHARS + 1, F.lit(1))).cast("int") + 1
    found = texts.join(picked, "key").select("y", "mark", (F.length("text") > SAMPLE_CHARS).alias("long"), F.substring("text", at, F.lit(SAMPLE_CHARS)).alias("text"))
    per = {1: SAMPLE_TOXIC, 0: SAMPLE_CLEAN}
    rows = [r for c in per for r in found.filter(F.col("y") == c).orderBy(*order, "text").limit(per[c]).collect()]
    return [r["text"] for r in rows], [r["y"] for r in rows], share


def scorer(model: ToxicityModel, spark):
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores([t if isinstance(t, str) else None for t in texts]))

    return score


def _fitted(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, held: Column) -> ToxicityModel:
    return fit(*sample(docs, labels.filter(~held), id_col, text_col, label_col))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out: Column | None = None) -> DataFrame:
    """id, held_out, score, predicted of every row; learned from labels of rows not held out."""
    bounded_batches(docs.sparkSession)
    held = held_out if held_out is not None else crc_bucket(F.col(f"`{id_col}`"), 5) == 0
    model = _fitted(docs, labels, id_col, text_col, label_col, held)
    out = docs.select(F.col(f"`{id_col}`").alias(id_col), held.alias("held_out"), scorer(model, docs.sparkSession)(F.col(f"`{text_col}`")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows of ``docs`` with a score under 0.5."""
    bounded_batches(docs.sparkSession)
    model = _fitted(docs, labels, id_col, text_col, label_col, crc_bucket(F.col(f"`{id_col}`"), 5) == 0)
    return docs.filter(scorer(model, docs.sparkSession)(F.col(f"`{text_col}`")) < 0.5)
