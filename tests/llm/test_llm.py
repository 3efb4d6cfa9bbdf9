"""The training-data operators against brute force, round trips, held-out rows and odd inputs."""

import hashlib
import html
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumaframe.llm import chat_template as ct
from lumaframe.llm import html_text, language_id, licenses, lm_scoring, ngram_join, packing, toxicity
from lumaframe.llm.common import parts_of, spread_join
from lumaframe.llm.components import connected_components
from lumaframe.llm.decontamination import contamination, decontaminate
from lumaframe.llm.exact_dedup import exact_dedup, exact_groups
from lumaframe.llm.html_text import main_text
from lumaframe.llm.queries import QUERIES, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, norm string, row string, id long, keep_id long"
BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"


def docs_of(spark, *texts, start=0):
    """Documents with further columns whose names clash with helper columns."""
    return spark.createDataFrame([(None if i is None else start + i, t, "en", "n", "r", 7, 8) for i, t in enumerate(texts)], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- exact dedup ------------------------------------------------------------------------


def brute_dedup(rows):
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in rows}
    groups = {}
    for i, t in norm.items():
        groups.setdefault(t, []).append(i)
    return {i: (min(groups[t]), len(groups[t]), min(groups[t]) == i, hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items()}


def test_exact_dedup(spark):
    texts = ["a  b", "a b", "a\tb", None, "", " ", "A b", "x" * 300_000, "x" * 300_000] + ["hot copy"] * 500 + [f"t {k % 40}" for k in range(200)]
    df = docs_of(spark, *texts).repartition(7)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_groups(df).collect()}
    want = brute_dedup(list(enumerate(texts)))
    assert got == want
    kept = exact_dedup(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, v in want.items() if v[2])
    assert exact_groups(empty(spark)).count() == 0 and exact_dedup(empty(spark)).count() == 0


def test_exact_dedup_of_repeated_rows(spark):
    df = docs_of(spark, "same", "other")
    twice = df.union(df).union(spark.createDataFrame([(None, "same", "en", "n", "r", 7, 8)], SCHEMA))
    assert exact_dedup(twice).count() == 2
    assert sum(r["kept"] for r in exact_groups(twice).collect()) == 2


# --- decontamination --------------------------------------------------------------------


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_contamination(docs, items, window=10):
    out = {}
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            v = words(text)
            k = min(window, len(v))
            grams = {tuple(v[s : s + k]) for s in range(len(v) - k + 1)} if v else set()
            for s in range(len(w) - k + 1) if grams else ():
                if tuple(w[s : s + k]) in grams:
                    hit |= set(range(s, s + k))
                    found.add(str(item))
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def test_contamination(spark):
    items = [(1, BASE), (2, "Élan vital ÉLAN"), (3, "one"), (4, None), (5, ""), (10, " ".join(["the of"] * 12))]
    b = BASE.split()
    texts = ["x " + BASE.upper() + " y", " ".join(b[3:13]), " ".join(b[3:12]), "élan vital Élan", "Élan VITAL Élan vital", "none ONE two", None, "", "the of " * 400, BASE + " " + BASE, " ".join(b[:9] + ["x"] + b[9:])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = docs_of(spark, *texts)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in contamination(df, bench).collect()}
    want = brute_contamination(list(enumerate(texts)), items)
    assert got == want
    clean = decontaminate(df.union(df), bench)
    assert clean.columns == df.columns
    assert Counter(r["doc_id"] for r in clean.collect()) == {i: 2 for i, v in want.items() if not v[4]}
    assert contamination(empty(spark), bench).count() == 0
    assert contamination(df, bench.limit(0)).filter("contaminated").count() == 0


def test_proximity(spark):
    from lumaframe.llm.decontamination import build_index, proximity_matches
    from pyspark.sql import functions as F

    df = docs_of(spark, "red x x blue", "red x x x x x x blue", "blue green")
    vocabulary = spark.createDataFrame([("red",), ("blue",)], "word string").withColumn("term", F.xxhash64("word"))
    found = proximity_matches(build_index(df, vocabulary), vocabulary.select(F.lit(1).alias("query"), "term"), 5)
    assert found.count() == 1


# --- n-gram join ----------------------------------------------------------------------------


def brute_groups(texts):
    def grams(t):
        w = words(t)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [grams(t) for t in texts]
    link = lambda a, b: bool(a and b) and len(a & b) / len(a | b) >= 0.8
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if link(sets[i], sets[j])]
    lead = list(range(len(sets)))
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            k = min(lead[i], lead[j])
            if lead[i] != k or lead[j] != k:
                lead[i] = lead[j] = k
                changed = True
    degree = Counter(x for p in pairs for x in p)
    return lead, [degree[i] for i in range(len(sets))]


@pytest.fixture(scope="module")
def near_texts():
    rng = np.random.default_rng(2)
    long = [" ".join(rng.choice(BASE.split(), 120)) for _ in range(4)]
    out = [long[0], long[0].upper(), None, "", "...", "two words", "two  words!", "x"] + long[1:]
    for k in range(40):
        w = long[k % 4].split()
        for _ in range(k % 7):
            w[int(rng.integers(120))] = "edit"
        out.append(" ".join(w))
    return out


def test_ngram_join(spark, near_texts):
    df = docs_of(spark, *near_texts)
    got = {r["doc_id"]: r for r in ngram_join.ngram_jaccard_join(df).collect()}
    lead, degree = brute_groups(near_texts)
    assert [got[i]["class_id"] for i in range(len(lead))] == lead
    assert [got[i]["n_links"] for i in range(len(lead))] == degree
    kept = ngram_join.near_dedup(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(lead))
    assert ngram_join.ngram_jaccard_join(empty(spark)).count() == 0
    assert ngram_join.near_dedup(df.union(df)).filter("text is not null and length(text) > 3").count() == len({x for x, t in zip(lead, near_texts, strict=True) if t and len(t) > 3})


def test_ngram_join_in_blocks(spark, near_texts, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.ngram_jaccard_join(docs_of(spark, *near_texts)).collect()}
    lead, degree = brute_groups(near_texts)
    assert [got[i] for i in range(len(lead))] == list(zip(lead, degree, strict=True))


def test_ngram_join_of_many_sizes_in_blocks(spark, monkeypatch):
    """A large cluster of texts of many lengths: levels of size leave out no link."""
    monkeypatch.setattr(ngram_join, "BLOCK", 2)
    word = [f"w{k}" for k in range(200)]
    texts = [" ".join(word[:n]) for n in (5, 6, 9, 10, 11, 14, 18, 23, 28, 29, 34, 35, 44, 53, 54, 64, 66, 81, 84, 100, 104, 124, 129, 154, 160, 192, 200)]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.ngram_jaccard_join(docs_of(spark, *texts), recall=1 - 1e-9).collect()}
    lead, degree = brute_groups(texts)
    assert [got[i] for i in range(len(lead))] == list(zip(lead, degree, strict=True))


def test_spread_join(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 900, F.lit(1)).otherwise(F.col("id")).alias("key"), "id")
    rows = rows.unionByName(spark.createDataFrame([(None, 1)], "key long, id long"))
    names = spark.createDataFrame([(1, "hot"), (950, "one"), (5000, "none"), (None, "null")], "key long, fact string")
    facts = rows.groupBy("key").agg(parts_of(F.col("id"))).join(names, "key")
    got = Counter(r["fact"] for r in spread_join(rows, facts, ["key"], F.col("id")).collect())
    assert got == {"hot": 900, "one": 1}
    assert facts.filter("key = 950").first()["parts"] != 0


def test_bands_reach_the_recall():
    for similarity in (0.5, 0.8, 0.9):
        bands, rows = ngram_join.choose_bands(similarity, 0.99)
        assert 1 - (1 - similarity**rows) ** bands >= 0.99 and bands * rows <= ngram_join.SIGNATURE


def test_components(spark):
    chain = [(k, k + 1) for k in range(30)] + [(100, 101), (5, 5), (101, 100)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(31)} | {100: 100, 101: 100}


# --- packing ------------------------------------------------------------------------------------


def test_packing(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    rng = np.random.default_rng(4)
    texts = [None, "", BASE, "It's <|endoftext|> ΣΑΣ İ é ½!", "word " * 9000] + [" ".join(rng.choice(BASE.split(), int(n))) for n in rng.integers(5, 1500, 200)]
    rows = packing.best_fit_packing(docs_of(spark, *texts).repartition(9), tokenizer_path()).collect()
    ids = {i: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t in enumerate(texts)}
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_bin.setdefault(r["sequence_id"], []).append(r)
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
    for i, all_ids in ids.items():
        pieces = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces))) and sum(r["length"] for r in pieces) == len(all_ids)
        assert all(r["length"] == 4096 for r in pieces[:-1])
    for items in by_bin.values():
        at = 0
        for r in sorted(items, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    least = math.ceil(sum(map(len, ids.values())) / 4096)
    assert len(by_bin) <= least + 2
    assert packing.best_fit_packing(empty(spark), tokenizer_path()).count() == 0


# --- chat templates --------------------------------------------------------------------------------


def test_template_language():
    text, spans = ct.render("{# c #}{% set a = 'x' ~ 2 %}{% for m in ms -%} {{ loop.index }}{{ m['r']|upper }}{% if m.r == 'a' and not loop.first %}{% generation %}{{ a }}{% endgeneration %}{% elif 1 > 2 %}no{% else %}-{% endif %}{% endfor %}", ms=[{"r": "b"}, {"r": "a"}])
    assert text == "1B-2Ax2" and [text[a:b] for a, b in spans] == ["x2"]
    assert ct.fold_body(ct.parse("a{{ 'b' ~ (1 + 2) }}{% if false %}x{% endif %}c")) == (ct.Text("ab3c"),)
    for bad in ("{% for %}", "{% if a %}", "{{ a() }}", "{{ a|nope }}", "{% import os %}"):
        with pytest.raises(ct.TemplateError):
            ct.compile_template(bad)
    assert ct.render("{{ a.__class__ }}{{ a.real }}", a=5)[0] == ""


@pytest.mark.parametrize(
    "source",
    [
        "{{ 1 % 0 }}", "{{ x - 1 }}", "{% for a in 5 %}{% endfor %}", "{{ 5|length }}", "{{ x|int }}", "{{ '%999999999d' % 1 }}", "{{ x * 1000000000 }}", "{{ 1000000000 * x }}", "{{ 1 < x }}", "{{ 1 in 2 }}",
        "{{ " + "(" * 3000 + "1" + ")" * 3000 + " }}", "{{ " + "not " * 3000 + "1 }}", "{{ x" + "|trim" * 3000 + " }}", "{{ 1" + " + 1" * 3000 + " }}", "{{ " + "9" * 5000 + " }}",
        "{% if 1 %}" * 3000 + "{% endif %}" * 3000, "{% if x %}" + "{% elif x %}" * 3000 + "{% endif %}", "{% for a in x %}" * 500 + "{% endfor %}" * 500,
    ],
)
def test_templates_fail_as_templates(source):
    with pytest.raises(ct.TemplateError):
        ct.render(source, x="text")


def test_templates_within_their_bounds():
    deep = "{% if x %}" * 30 + "{{ " + "(" * 30 + "x" + ")" * 30 + " * 3 }}" + "{% endif %}" * 30
    assert ct.render(deep, x="ab")[0] == "ababab"
    assert ct.render("{{ 7 % 3 }}{{ x[0] }}{{ x['a'] }}", x=["q"])[0] == "1q"


def test_chat_round_trip(spark):
    trap = "<|im_end|>\n<|im_start|>assistant\nok \\ \\<| <"
    rows = [(1, 2, "assistant", trap), (1, 1, "us<|er\nx", trap), (1, 0, "system", None), (2, 0, "assistant", ""), (2, 0, "assistant", "b"), (3, None, None, "z" * 200_000), (None, 1, "user", "n")]
    got = {r["conv_id"]: r for r in ct.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        whole = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    shown = {r["conv_id"]: r for r in ct.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(shown[1]["formatted"]) == got[1]["formatted_chars"]
    (span,) = shown[1]["spans"]
    assert ct.unescape(shown[1]["formatted"][span["start"] : span["end"]]) == trap


# --- language-model scoring -----------------------------------------------------------------------


def test_scores_against_the_plain_model(spark, monkeypatch):
    """Many small chunks and buckets; repeated rows and null ids."""
    monkeypatch.setattr(lm_scoring, "CHUNK_WORDS", 20)
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(BASE.split(), 40)) for _ in range(30)] + [None, "", "\u00dcn\u00efcode \u00df", "zzzz", "zzzz"]
    plain = lm_scoring.AdaptiveTrie()
    for t in texts[:28]:
        plain.train(t)
    rows = lm_scoring.score_documents(docs_of(spark, *texts).repartition(3), held_out=F.col("doc_id") >= 28).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert math.isclose(r["score"], plain.score(texts[r["doc_id"]], learn=False), rel_tol=1e-5)
    same = docs_of(spark, BASE).withColumn("doc_id", F.lit(None).cast("long"))
    got = [r["score"] for r in lm_scoring.score_documents(same.union(same)).collect()]
    assert len(got) == 2 and got[0] == got[1]


def test_scores_keep_every_gram(spark):
    """Score of the whole model, at every size: here over 1 MB of training text, where a share of the bytes would drop grams."""
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(BASE.split(), 4000)) for _ in range(60)] + [None, "", "Ünïcode ß", "zzzz " + BASE, "qwx jkv"]
    plain = lm_scoring.AdaptiveTrie()
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    for t, h in zip(texts, held, strict=True):
        if not h:
            plain.train(t)
    assert plain.total[b""] > 1e6
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score_documents(docs_of(spark, *texts)).collect()}
    for i in [0, *range(58, len(texts))]:
        assert math.isclose(got[i], plain.score(texts[i], learn=False), rel_tol=1e-5), i


def test_contexts_of_five_bytes(spark):
    texts = ["abcdeX", "abcdeX", "bbcdeY", "bbcdeY", "abcdeX", "abcdeY"]
    df = docs_of(spark, *texts)
    plain = lm_scoring.AdaptiveTrie(5)
    for t in texts[:4]:
        plain.train(t)
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score_documents(df, held_out=F.col("doc_id") >= 4).collect()}
    assert all(math.isclose(got[i], plain.score(t, learn=False), rel_tol=1e-5) for i, t in enumerate(texts))
    assert got[4] > got[5] + 0.3  # four bytes of context say nothing of X and Y


def test_probabilities_sum_to_one():
    m = lm_scoring.AdaptiveTrie(2)
    m.train("abracadabra")
    assert math.isclose(sum(10 ** m.log10(b"br", s) for s in range(lm_scoring.ALPHABET)), 1.0, rel_tol=1e-9)
    first = lm_scoring.AdaptiveTrie().score("abababab" * 20)
    assert first > 2 * lm_scoring.AdaptiveTrie().score("abababab" * 10)


def test_bits_a_character_of_held_out_texts(spark):
    """Held-out texts of the smallest fixture; with escapes as heavy as the distinct symbols they take 2.444 bits."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    held = {r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2}
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score_documents(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()}
    size = sum(len(lm_scoring.encoded(r["text"])) for r in rows if r["doc_id"] in held)
    assert -sum(got[i] for i in held) / math.log10(2) / size < 2.43


def test_base_scores(spark):
    texts = [BASE, BASE.upper() + " new", None, "", " \t\n", "é É\x0b x", "y " * 3000]
    df = docs_of(spark, *texts, start=100)
    rows = lm_scoring.score_documents(df).collect()
    toks = {100 + i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) + [None] for i, t in enumerate(texts)}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in toks}
    c = Counter(w for i, ws in toks.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    assert len(rows) == len(texts)
    for r in rows:
        ws = toks[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), abs_tol=1e-6) and r["score"] < 0
    assert lm_scoring.score_documents(empty(spark)).count() == 0


# --- classifiers --------------------------------------------------------------------------------------


def test_language(spark):
    rng = np.random.default_rng(8)
    make = lambda parts: " ".join("".join(rng.choice(parts, 3)) for _ in range(30))
    kinds = {"aa": ["ka", "lo", "mi"], "bb": ["str", "end", "ung"]}
    rows = [(i, make(kinds[k]), k) for i, k in enumerate(["aa", "bb"] * 60)] + [(500, None, "aa"), (501, "12 !!", None), (502, "kalomi" * 20_000, None)]
    out = {r["doc_id"]: r for r in language_id.identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(out) == len(rows)
    assert out[500]["lang_pred"] == out[501]["lang_pred"] == "und" and out[502]["lang_pred"] == "aa"
    assert all(out[i]["lang_pred"] == k and 0 <= out[i]["score"] <= 1 for i, _, k in rows if k and i < 500)
    assert language_id.identify_language(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_rare_languages_are_sampled(spark):
    rows = [(i, f"text {i} " * 5, "xx" if i % 100 == 7 else "yy" if i == 5 else "en") for i in range(8000)]
    got = Counter(x for x, _ in language_id.sample_windows(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang", rows=20))
    assert got["xx"] == 50 * language_id.SAMPLE_WINDOWS and got["yy"] == language_id.SAMPLE_WINDOWS and got["en"] > 0


def test_every_position_is_labelled():
    m = language_id.fit([("x", "kalomi " * 12), ("y", "strung " * 12)] * 20)
    for n in (1, 50, 112, 113, 700):
        assert len(m.label_positions("k" * n)) == n
    assert language_id.fit([]).pooled(["abc"])[0] == ["und"]


def test_toxicity(spark):
    rng = np.random.default_rng(9)
    rows, labels = [], []
    for i in range(400):
        w = list(rng.choice(BASE.split(), 60))
        bad = i % 4 == 0
        if bad:
            w.insert(int(rng.integers(60)), str(rng.choice(["nastyword", "vileterm"])))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows + [(900, None), (901, ""), (902, "alpha beta " * 5000), (903, "alpha nast-yxword beta")], "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(0, None)], "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, marks).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i]["held_out"] == (i in set(held)) for i in range(400))
    assert np.mean([out[i]["predicted"] == labels[i][1] for i in held]) > 0.95
    assert out[900]["predicted"] == out[901]["predicted"] == out[902]["predicted"] == 0
    assert out[903]["score"] > out[902]["score"]
    assert toxicity.drop_toxic(docs, marks).columns == docs.columns
    none = toxicity.score_toxicity(docs, marks.limit(0))
    assert {r["score"] for r in none.collect()} == {0.0}


def test_toxicity_sample_of_long_and_absent_texts(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_TOXIC", 5)
    monkeypatch.setattr(toxicity, "SAMPLE_CLEAN", 5)
    docs = docs_of(spark, *["bad " * 4000] * 8, *["fine " * 4000] * 8)
    labels = spark.createDataFrame([(i, int(i < 8 or i >= 500)) for i in [*range(16), *range(500, 900)]], "doc_id long, toxic int")
    texts, y, share = toxicity.sample(docs, labels, "doc_id", "text", "toxic")
    assert sorted(y) == [0] * 5 + [1] * 5 and {len(t) for t in texts} == {toxicity.SAMPLE_CHARS}
    assert all(("bad" in t) == bool(c) for t, c in zip(texts, y, strict=True)) and math.isclose(share, 408 / 416)
    assert toxicity.fit(["fine"], [0], 0.25).scores(["fine"])[0] == 0.25


def test_kernel_tolerates_gaps():
    assert toxicity.kernel("idiot", "idiot") > toxicity.kernel("idxiot", "idiot") > 1.5 * toxicity.kernel("flower", "idiot")


# --- licenses and pages ---------------------------------------------------------------------------------


def test_licenses(spark):
    line = "Released under the MIT License."
    texts = [f"start {line} middle {line} end", licenses.TEMPLATES["apache-2.0"].replace("License", "license", 2), "released by others under a license", None, "", BASE, licenses.TEMPLATES["gpl-3.0-or-later"].replace("program", "fine program")]
    rows = licenses.scan_licenses(docs_of(spark, *texts)).collect()
    mit = sorted((r["span_start"], r["span_end"]) for r in rows if r["doc_id"] == 0 and r["license"] == "mit-line")
    assert [texts[0][a:b] + "." for a, b in mit] == [line, line]
    assert {r["license"] for r in rows if r["doc_id"] == 1} >= {"apache-2.0"} and {r["license"] for r in rows if r["doc_id"] == 6} >= {"gpl-3.0-or-later"}
    assert {r["doc_id"] for r in rows} == {0, 1, 6}
    assert licenses.scan_licenses(empty(spark)).count() == 0


def test_alignment_is_the_longest_common_subsequence():
    assert licenses.align(list("abcdef"), list("xabzcdyef"), 1, 5)[0] == 6
    assert licenses.align(list("abc"), list("xyz"), 0, 3)[0] == 0


def test_licenses_with_words_put_in_or_left_out():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for name in ("apache-2.0", "mit", "gpl-3.0-or-later", "bsd"):
        w = licenses.TEMPLATES[name].split()
        middle, size = len(w) // 2, len(licenses.words(licenses.TEMPLATES[name]))
        for put in (14, 40):
            text = " ".join(["before", *w[:middle], *(f"new{k}" for k in range(put)), *w[middle:], "after"])
            found = {x[0]: x for x in scanner.scan(text)}
            assert name in found and found[name][2] == size, (name, put)
            assert text[found[name][3] : found[name][4]].split()[0].lower() == w[0].lower()
        out = max(13, int(0.15 * size))
        if out < 0.19 * size:
            text = " ".join(w[: middle - out // 2] + w[middle - out // 2 + out :])
            assert name in {x[0] for x in scanner.scan(f"before {text} after")}, name
    twice = f"{licenses.TEMPLATES['apache-2.0']} {licenses.TEMPLATES['apache-2.0']}"
    assert [x[1] for x in scanner.scan(twice) if x[0] == "apache-2.0"] == [1.0, 1.0]


PAGE = """<html><head><title>t</title><script>if(a<b){}</script></head><body><header><a href=/>Home</a></header><nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div class=layout><aside>side</aside><div class="content"><h1>Head &amp; shoulders</h1><p>One two three four five, six seven eight <a href=x>nine</a> ten.
<p>More words that go on for a good while, so that the text is dense enough.</p><div class="ad">buy</div><ul><li>item one<li>item two</ul></div></div>
<div id="comments"><p>great read, I liked it very much indeed</p></div><form><input><p>Sign up</p></form><footer>&copy; us</footer></body></html>"""


def test_main_text():
    assert main_text(PAGE).split("\n\n") == ["Head & shoulders", "One two three four five, six seven eight nine ten.", "More words that go on for a good while, so that the text is dense enough.", "item one", "item two"]
    assert main_text(None) == main_text("") == main_text("<p></p>") == ""
    assert main_text("<article><p>cut off &am") == html.unescape("cut off &am")
    assert main_text("<div>" * 5000 + "deep") == "deep"
    assert main_text("a < b and <b>bold") == "a < b and bold"


def test_main_text_of_several_parts():
    def page(*parts):
        return "<html><body><nav><a href=/>Home</a></nav><div>" + "".join(parts) + "</div><footer>us</footer></body></html>"

    def paragraphs(n, size, mark):
        return [f"{mark}{i} ".ljust(size, "x") for i in range(n)]

    two, items = paragraphs(2, 200, "p"), paragraphs(20, 60, "i")
    got = main_text(page("<h1>Head</h1>", *(f"<p>{x}</p>" for x in two), "<ul>", *(f"<li>{x}</li>" for x in items), "</ul>"))
    assert got.split("\n\n") == ["Head", *two, *items]
    first, second = paragraphs(10, 300, "a"), paragraphs(8, 300, "b")
    sections = ["<section>" + "".join(f"<p>{x}</p>" for x in some) + "</section>" for some in (first, second)]
    for links in (0, 15, 30):  # without links, and with a tenth of the text in a list of links
        more = "<ul>" + "".join(f"<li><a href=/{k}>related page {k:02}</a></li>" for k in range(links)) + "</ul>"
        assert main_text(page(*sections, more)).split("\n\n") == [*first, *second]


def test_boilerplate_names():
    text = "<h1>Head</h1><p>" + "words of the article " * 20 + "</p><p>" + "and some more of them " * 20 + "</p>"
    want = ["Head", ("words of the article " * 20).strip(), ("and some more of them " * 20).strip()]
    for name in ("content has-sidebar", "layout-no-sidebar", "entry comments-open", "with-ads", "widget"):
        got = main_text(f"<body><div class='{name}'>{text}</div><div class='sidebar-box'><p>{'aside ' * 30}</p></div><div class='entry post-comments'><p>{'comment ' * 30}</p></div></body>")
        assert got.split("\n\n") == want, name
    assert main_text("<body><p>sum <math><mi>a</mi><mo>+</mo><mi>b</mi></math> of <label>two</label> terms<xmp>a <b> c</xmp></body>").split("\n\n") == ["sum a+b of two terms", "a <b> c"]


PARAGRAPHS = [f"{k} words of an article that goes on for quite a while, so that its paragraphs are dense" for k in range(12)]


@pytest.mark.parametrize("wrapper", ["article", "div"])
@pytest.mark.parametrize(
    "fragment, want",
    [
        ('<p title="the hidden valley">kept text</p>', "kept text"),
        ('<p><a title="hidden gem" href=/>kept text</a> and more</p>', "kept text and more"),
        ("<p data-state=hidden>kept text</p>", "kept text"),
        ("<p data-id='ad'>kept text</p>", "kept text"),
        ("<div data-class='sidebar' data-role='navigation'>kept text</div>", "kept text"),
        ('<h2 id="side-effects">kept text</h2>', "kept text"),
        ('<h2 id="related-work">kept text</h2>', "kept text"),
        ('<h2 id="navigation">kept text</h2>', "kept text"),
        ('<section id="legal-aspects"><h2>Legal aspects</h2><p>kept text</p></section>', "Legal aspects\n\nkept text"),
        ('<section id="navigation"><h2>Navigation</h2><p>kept text</p></section>', "Navigation\n\nkept text"),
        ('<div class="share-price">kept text</div>', "kept text"),
        ('<div class="social-science adaptive">kept text</div>', "kept text"),
        ("<pre>x = 1 <span class=comment>kept text</span></pre>", "x = 1 kept text"),
        ("<p>press <button>kept text</button> now</p>", "press kept text now"),
        ("<p><video src=x>kept text</video></p>", "kept text"),
        ("<p><object data=x>kept text</object><canvas>too</canvas><audio>as well</audio></p>", "kept texttooas well"),
        ("<fieldset>kept text</fieldset><p><select><option>one</option></select></p>", "kept text\n\none"),
        ("<textarea>kept &amp; text</textarea>", "kept & text"),
        ('<div class="ad">gone</div>', None),
        ('<div class="post-ads">gone</div>', None),
        ('<div class="socialShare">gone</div>', None),
        ('<div id="comments"><h2>Comments</h2><p>gone</p></div>', None),
        ('<section class="comment-list"><p>gone</p></section>', None),
        ('<div class="related-work"><a href=/>gone</a> <a href=/>gone</a></div>', None),
        ("<form><p>gone</p><button>gone</button></form>", None),
        ("<div hidden>gone</div><div style='DISPLAY: none'>gone</div><div role=navigation>gone</div>", None),
        ("<nav>gone</nav><aside>gone</aside><footer>gone</footer><script>gone</script>", None),
    ],
)
def test_what_stays_of_an_article(wrapper, fragment, want):
    half = ["".join(f"<p>{x}</p>" for x in part) for part in (PARAGRAPHS[:6], PARAGRAPHS[6:])]
    page = f"<html><body><nav><a href=/>Home</a></nav><{wrapper}>{half[0]}{fragment}{half[1]}</{wrapper}><footer>us</footer></body></html>"
    assert main_text(page) == "\n\n".join([*PARAGRAPHS[:6], *([want] if want else []), *PARAGRAPHS[6:]])


def test_headers_of_articles_stay():
    text = "".join(f"<p>{x}</p>" for x in PARAGRAPHS)
    page = f"<body><header><p>a site</p></header><article><header><p>by someone</p></header>{text}</article></body>"
    assert main_text(page) == "\n\n".join(["by someone", *PARAGRAPHS])


def brute_densities(node):
    """Density sums by the definition, each node's counts gathered anew."""

    def below(n):
        for c in n.children:
            if not isinstance(c, str):
                yield c
                yield from below(c)

    def texts(n, linked):
        for c in n.children:
            if isinstance(c, str):
                yield len(re.sub(r"\s+", " ", c.strip())), linked
            else:
                yield from texts(c, linked or c.tag == "a")

    def counts(n):
        found = list(texts(n, False))
        inside = list(below(n))
        return sum(k for k, _ in found), len(inside), sum(k for k, linked in found if linked), sum(c.tag == "a" for c in inside)

    body = next(n for n in [node, *below(node)] if n.tag == "body")
    chars, _, linked, _ = counts(body)

    def density(n):
        c, t, lc, lt = counts(n)
        if not c or n.noise:
            return 0.0
        base = math.log(c / max(c - lc, 1) * lc + linked / max(chars, 1) * c + math.e)
        return c / max(t, 1) * math.log(max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1.0)) / math.log(max(base, math.e))

    return {id(n): sum(density(c) for c in n.children if not isinstance(c, str)) for n in [node, *below(node)]}


def test_densities_by_definition(spark):
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(10).collect():
        for page in (r["html"], r["html"].replace("article>", "div>"), PAGE):
            root = html_text.parse(page)
            nodes = html_text.densities(root)
            want = brute_densities(root)
            assert all(math.isclose(n.total, want[id(n)], rel_tol=1e-9, abs_tol=1e-9) for n in nodes)
            best = max(nodes, key=lambda n: n.total)
            up = html_text.main_node(root)
            while best is not None and best is not up:  # the content holds the node of the largest sum
                best = best.parent
            assert best is up


def test_main_text_of_rows(spark):
    kind = "page_id long, html string, text string, row string"
    df = spark.createDataFrame([(1, None, "a", "b"), (2, "", "a", "b"), (3, PAGE, "a", "b"), (3, PAGE, "a", "b"), (None, "<p>" + "long text " * 200_000, "a", "b")], kind)
    rows = html_text.extract_main_text(df).collect()
    assert [r["row"] for r in rows] == ["b"] * 5 and html_text.extract_main_text(df).columns == df.columns
    assert [r["text"] for r in rows] == ["", "", main_text(PAGE), main_text(PAGE), ("long text " * 200_000).strip()]
    assert html_text.extract_main_text(spark.createDataFrame([], kind)).count() == 0


# --- queries and the pipeline ------------------------------------------------------------------------------


def test_articles_of_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").toPandas().set_index("page_id")
    for r in QUERIES["op10_html_extraction"](spark, "/root/testdata/sf0.001").collect():
        page = pages.html[r["page_id"]]
        a = page.index("<article>") + 9
        e = page.find("</article>", a)
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>?", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", page[a : e if e > 0 else len(page)])]
        assert r["text"] == "\n\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = {r["doc_id"]: r["text"] for r in toxicity.drop_toxic(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    left = {i: left[i] for i, v in brute_dedup(list(left.items())).items() if v[2]}
    ids = sorted(left)
    lead, _ = brute_groups([left[i] for i in ids])
    left = {ids[k]: left[ids[k]] for k in sorted(set(lead))}
    want = {i for i, v in brute_contamination(list(left.items()), bench).items() if not v[4]}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()} == want


# --- against brute force ------------------------------------------------------------------------------


def test_windows_are_scored_by_the_kernel_machine():
    """Each window's sum is that of the subsequences of the window alone, in long, short and empty texts."""
    rng = np.random.default_rng(4)
    m = toxicity.ToxicityModel(0.5, rng.random(toxicity.SYMBOLS**toxicity.ORDER).astype(np.float32), 1.0, 0.0)
    texts = ["some harmless words, and more of them", "short", "", "a", "x" * 30, "fourteen chars"]
    for t in texts:
        s = toxicity.symbols(t) if t else toxicity._NONE
        width = min(toxicity.WINDOW, len(s))
        brute = [sum(w * m.weights[c] for c, w in toxicity.feature_map(s[i : i + width]).items()) for i in range(len(s) - width + 1)]
        assert np.allclose(m.window_sums(s), brute, rtol=1e-4)
        assert math.isclose(m.peaks([None, t, BASE])[1], max(brute), rel_tol=1e-4, abs_tol=1e-6)


def test_letters_are_what_unicode_calls_so(spark):
    df = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("plain words here", "en"), ("mots simples ici", "fr")] * 20 + [("² ½ Ⅷ 12", None), ("é", None)])], "doc_id long, text string, lang string")
    out = {r["doc_id"]: r["lang_pred"] for r in language_id.identify_language(df).collect()}
    assert out[40] == "und" and out[41] != "und"


def test_deep_and_broken_pages_take_linear_time():
    import time

    def took(n):
        began = time.time()
        main_text("<body>" + "<div>" * n + "some text of a page" + "</p>" * n + "</section>" * n)
        return time.time() - began

    took(500)
    assert took(16000) < 12 * max(took(4000), 0.01)


def test_bins_of_many_nodes_stay_whole(spark, monkeypatch):
    """Packing over many partitions and slices: every piece once, no bin over its capacity, few bins."""
    monkeypatch.setattr(packing, "REACH", 2)
    rng = np.random.default_rng(1)
    df = docs_of(spark, *[" ".join(rng.choice(BASE.split(), int(rng.integers(1, 60)))) for _ in range(300)]).repartition(24)
    rows = packing.best_fit_packing(df, tokenizer_path(), capacity=128).collect()
    fills = Counter()
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fills[r["sequence_id"]]
        fills[r["sequence_id"]] += r["length"]
    assert max(fills.values()) <= 128 and len(fills) <= 1.15 * sum(fills.values()) / 128 + 2
