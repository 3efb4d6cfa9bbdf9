"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded
sample of labelled rows. It reads whole texts in segments with some context on
both sides, labels every byte position with a distribution over the learned
languages, and pools a document's positions into its probabilities.

Defined cases: a null text, and one without a letter, is ``und`` with score 0; without any
labelled row everything is ``und``; labels that are null are not learned; repeated
rows get equal results; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from .common import bounded_batches, crc_bucket

#: Labelled rows and windows of each that a model is trained on, at most.
SAMPLE_ROWS, SAMPLE_WINDOWS, WINDOW_CHARS = 6000, 4, 80
#: Training rows of each language, where it has so many.
LEAST_ROWS = 50
HIDDEN, TRAIN_BYTES, BATCH, STEPS, RATE = 8, 64, 192, 360, 0.02
#: Bytes labelled in one segment, context on each side, segments at once.
SEGMENT, CONTEXT, ROWS = 112, 16, 1024
UND = "und"


def _gates(params: dict, side: str):
    return params["x" + side], params["u" + side]


def _run(x: np.ndarray, u: np.ndarray, data: np.ndarray, keep: bool = False):
    """States (steps, rows, hidden) of one direction over ``data`` (steps, rows) of bytes.

    Gates are ``tanh(a/2)/2 + 1/2``; ``x`` and ``u`` hold update, reset and candidate side by side.
    """
    steps, rows = data.shape
    n = u.shape[0]
    h = np.zeros((rows, n), np.float32)
    out = np.empty((steps, rows, n), np.float32)
    memo = []
    for t in range(steps):
        a = x[data[t]]
        b = h @ u
        g = np.tanh(a[:, : 2 * n] + b[:, : 2 * n])
        g *= 0.5
        g += 0.5
        z, r = g[:, :n], g[:, n:]
        c = r * b[:, 2 * n :]
        c += a[:, 2 * n :]
        np.tanh(c, out=c)
        if keep:
            memo.append((h, z, r, c, b[:, 2 * n :]))
        h = c + z * (h - c)
        out[t] = h
    return (out, memo) if keep else out


def _back(u: np.ndarray, data: np.ndarray, memo: list, grad: np.ndarray, gx: np.ndarray, gu: np.ndarray) -> None:
    """Adds the gradients of one direction, given those of its states."""
    n = u.shape[0]
    dh = np.zeros_like(grad[0])
    for t in range(len(memo) - 1, -1, -1):
        h, z, r, c, bc = memo[t]
        dh = dh + grad[t]
        dc = dh * (1 - z) * (1 - c * c)
        dz = dh * (h - c) * z * (1 - z) * 2
        dr = dc * bc * r * (1 - r) * 2
        da = np.concatenate([dz, dr, dc], 1)
        db = np.concatenate([dz, dr, dc * r], 1)
        np.add.at(gx, data[t], da)
        gu += h.T @ db
        dh = dh * z + db @ u.T


@dataclass
class LanguageModel:
    languages: list[str]
    params: dict[str, np.ndarray]

    def position_probabilities(self, texts: list[bytes]):
        """For blocks of segments: (owner of each segment, valid positions, probabilities (segments, positions, languages))."""
        p, k = self.params, len(self.languages)
        lengths = np.array([len(t) for t in texts], np.int64)
        buffer = np.frombuffer((b"\0" * CONTEXT).join([b"", *texts, b"\0" * (SEGMENT + CONTEXT)]), np.uint8)
        begins = np.cumsum(np.concatenate([[0], lengths[:-1] + CONTEXT])) + CONTEXT
        count = -(-lengths // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), count)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        first, ends = begins[owner] + nth * SEGMENT, (begins + lengths)[owner]
        span = np.arange(-CONTEXT, SEGMENT + CONTEXT)
        for at in range(0, len(owner), ROWS):
            where = first[at : at + ROWS, None] + span
            inside = where < ends[at : at + ROWS, None]
            data = np.where(inside, buffer[np.minimum(where, len(buffer) - 1)], 0).T
            # What comes after a position says nothing to the first direction, what comes before nothing to the second.
            ahead = _run(p["xf"], p["uf"], data[:-CONTEXT])[CONTEXT:]
            behind = _run(p["xb"], p["ub"], data[CONTEXT:][::-1])[::-1][:SEGMENT]
            n = p["uf"].shape[0]
            logits = ahead.reshape(-1, n) @ p["o"][:n] + behind.reshape(-1, n) @ p["o"][n:] + p["b"]
            logits -= logits.max(1, keepdims=True)
            np.exp(logits, out=logits)
            logits /= logits.sum(1, keepdims=True)
            yield owner[at : at + ROWS], inside[:, CONTEXT:-CONTEXT], logits.reshape(SEGMENT, -1, k).transpose(1, 0, 2)

    def label_positions(self, text: str) -> list[str]:
        """The language of every byte of the text's UTF-8 form."""
        out: list[str] = []
        for _, valid, probs in self.position_probabilities([text.encode("utf-8", "surrogatepass")]):
            out += [self.languages[k] for k in probs.argmax(2)[valid]]
        return out

    def pooled(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and probability of each text: the mean over its positions."""
        live = [i for i, t in enumerate(texts) if t and self.languages and any(map(str.isalpha, t))]
        langs, scores = [UND] * len(texts), np.zeros(len(texts))
        if live:
            total = np.zeros((len(live), len(self.languages)))
            data = [texts[i].encode("utf-8", "surrogatepass") for i in live]
            for owner, valid, probs in self.position_probabilities(data):
                np.add.at(total, owner, np.einsum("st,stk->sk", valid.astype(np.float32), probs))
            total /= total.sum(1, keepdims=True)
            for i, row in zip(live, total, strict=True):
                k = int(row.argmax())
                langs[i], scores[i] = self.languages[k], min(1.0, float(row[k]))
        return langs, scores


def fit(windows: list[tuple[str, str]], seed: int = 0) -> LanguageModel:
    """A model of (language, text) windows; languages are drawn equally often."""
    by: dict[str, list[bytes]] = {}
    for lang, text in windows:
        if data := text.encode("utf-8", "surrogatepass"):
            by.setdefault(lang, []).append(data)
    langs = sorted(by)
    k, n, rng = len(langs), HIDDEN, np.random.default_rng(seed)
    shape = {"xf": (256, 3 * n), "xb": (256, 3 * n), "uf": (n, 3 * n), "ub": (n, 3 * n), "o": (2 * n, k), "b": (k,)}
    p = {a: (rng.normal(0, 0.5 if a[0] == "x" else 0.3, s) * (a != "b")).astype(np.float32) for a, s in shape.items()}
    if k < 2:
        return LanguageModel(langs, p)
    m, v = ({a: np.zeros_like(x) for a, x in p.items()} for _ in range(2))
    for step in range(1, STEPS + 1):
        y = rng.integers(0, k, BATCH)
        rows = [by[langs[c]][rng.integers(len(by[langs[c]]))] for c in y]
        data = np.zeros((TRAIN_BYTES, BATCH), np.uint8)
        mask = np.zeros((TRAIN_BYTES, BATCH, 1), np.float32)
        for j, d in enumerate(rows):
            at = rng.integers(max(1, len(d) - TRAIN_BYTES + 1))
            part = np.frombuffer(d, np.uint8)[at : at + TRAIN_BYTES]
            data[: len(part), j] = part
            mask[: len(part), j] = 1
        fwd, memo_f = _run(p["xf"], p["uf"], data, True)
        bwd, memo_b = _run(p["xb"], p["ub"], data[::-1], True)
        both = np.concatenate([fwd, bwd[::-1]], 2)
        logits = both @ p["o"] + p["b"]
        probs = np.exp(logits - logits.max(2, keepdims=True))
        probs /= probs.sum(2, keepdims=True)
        d = probs
        d[:, np.arange(BATCH), y] -= 1
        d *= mask / mask.sum()
        g = {a: np.zeros_like(x) for a, x in p.items()}
        flat = d.reshape(-1, k)
        g["o"], g["b"] = both.reshape(-1, 2 * n).T @ flat, flat.sum(0)
        ds = d @ p["o"].T
        _back(p["uf"], data, memo_f, ds[:, :, :n], g["xf"], g["uf"])
        _back(p["ub"], data[::-1], memo_b, ds[::-1, :, n:], g["xb"], g["ub"])
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        for a in p:
            x = g[a] * min(1.0, 1.0 / (norm + 1e-9))
            m[a] = 0.9 * m[a] + 0.1 * x
            v[a] = 0.99 * v[a] + 0.01 * x * x
            p[a] -= (rate * (m[a] / (1 - 0.9**step)) / (np.sqrt(v[a] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return LanguageModel(langs, {a: x.astype(np.float32) for a, x in p.items()})


def sample_windows(df: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int = SAMPLE_ROWS) -> list[tuple[str, str]]:
    """(language, window) of at most ``rows`` labelled rows, those with the least hash of their id, and of up to ``LEAST_ROWS`` rows of each language.

    The hash threshold is found first, over ids alone, so that no text is sorted; that of a rare language follows from its count.
    """
    mark = F.xxhash64(F.lit(11), F.col(f"`{id_col}`"))
    text, lang = F.col(f"`{text_col}`"), F.col(f"`{lang_col}`")
    known = df.filter(lang.isNotNull())
    least = known.select(mark.alias("mark")).orderBy("mark").limit(rows).agg(F.max("mark")).first()[0]
    if least is None:
        return []
    cut = lambda k: F.substring(text, F.pmod(F.xxhash64(F.lit(k), F.col(f"`{id_col}`")), F.greatest(F.length(text) - WINDOW_CHARS, F.lit(1))).cast("int") + 1, F.lit(WINDOW_CHARS))
    drawn = known.filter(text.isNotNull()).select(lang.cast("string").alias("lang"), mark.alias("mark"), F.array(*[cut(k) for k in range(SAMPLE_WINDOWS)]).alias("windows"))
    found = drawn.filter(F.col("mark") <= least).orderBy("mark").limit(rows).collect()  # repeated ids share a hash
    have = Counter(r["lang"] for r in found)
    counts = {r["lang"]: r["count"] for r in known.filter(text.isNotNull()).groupBy(lang.cast("string").alias("lang")).count().collect()}
    rare = [(x, -(1 << 63) + min(4 * LEAST_ROWS * (1 << 64) // n, (1 << 64) - 1)) for x, n in counts.items() if have[x] < min(n, LEAST_ROWS)]
    if rare:
        limits = F.broadcast(df.sparkSession.createDataFrame(rare, "lang string, most long"))
        few = drawn.join(limits, "lang").filter(F.col("mark") <= F.col("most"))
        few = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("mark"))).filter(F.col("rank") <= LEAST_ROWS)
        rare_names = {x for x, _ in rare}
        found = [r for r in found if r["lang"] not in rare_names] + few.orderBy("lang", "mark").collect()
    return [(r["lang"], w) for r in found for w in r["windows"]]


PREDICTION = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])


def predictor(model: LanguageModel, spark):
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(PREDICTION)
    def predict(texts: pd.Series) -> pd.DataFrame:
        langs, scores = shared.value.pooled([t if isinstance(t, str) else None for t in texts])
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    return predict


def position_labeller(model: LanguageModel, spark):
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(ArrayType(StringType()))
    def label(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: shared.value.label_positions(t) if isinstance(t, str) else None)

    return label


def identify_language(df: DataFrame, train: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: Column | None = None) -> DataFrame:
    """id, held_out, lang_pred, score of every row; learned from ``train`` (default: the rows of ``df`` not held out)."""
    spark = df.sparkSession
    bounded_batches(spark)
    held = held_out if held_out is not None else crc_bucket(F.col(f"`{id_col}`"), 4) == 2
    model = fit(sample_windows(train if train is not None else df.filter(~held), id_col, text_col, lang_col))
    out = df.select(F.col(f"`{id_col}`").alias(id_col), held.alias("held_out"), predictor(model, spark)(F.col(f"`{text_col}`")).alias("p"))
    return out.select(F.col(f"`{id_col}`"), "held_out", "p.lang_pred", "p.score")
