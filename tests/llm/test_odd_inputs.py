"""Every document operator and the pipeline over odd rows: repeated ones, null ids, very long and empty texts, further columns whose names clash."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumaframe.llm import language_id, licenses, lm_scoring, ngram_join, packing, toxicity
from lumaframe.llm.decontamination import contamination
from lumaframe.llm.exact_dedup import exact_groups
from lumaframe.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, row string, norm string, word string, part int, digest string, score double, label int, chunk long"
EN = "the quick brown fox jumps over the lazy dog and runs to the river where it drinks some water before the night comes".split()
FR = "le petit renard brun saute par dessus le chien et court vers la grande rivière où il boit avant la tombée du soir".split()


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.default_rng(1)
    rows = [(k, " ".join(rng.choice(FR if k % 2 else EN, 12)), "fr" if k % 2 else "en") for k in range(60)]
    rows += [(100, rows[0][1], "en"), (100, rows[0][1], "en"), (None, rows[0][1], "en"), (None, None, None), (101, None, None), (102, "", None), (103, " \t\n", None), (104, " ".join(rng.choice(EN, 120_000)), "en"), (105, "x" * 400_000, None), (106, rows[5][1], None)]
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), 1, "r", "n", "w", 2, "d", 0.5, 1, 3) for i, t, lang in rows], SCHEMA).repartition(3)


def results(df, key="doc_id"):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], []).append(r)
    return out


def same_rows(found, columns):
    """One result a row; repeated rows, and equal texts of other ids, give equal results."""
    assert sum(map(len, found.values())) == 70 and len(found[100]) == 2 and len(found[None]) == 2
    pick = lambda r: tuple(r[c] for c in columns)
    assert pick(found[100][0]) == pick(found[100][1]) == pick(found[0][0])
    assert any(pick(r) == pick(found[0][0]) for r in found[None])
    return {i: [pick(r) for r in rows] for i, rows in found.items()}


def test_languages_of_odd_rows(odd):
    got = same_rows(results(language_id.identify_language(odd)), ["lang_pred"])
    assert got[101] == got[102] == got[103] == [("und",)] and got[104] == [("en",)]


def test_contamination_of_odd_rows(spark, odd):
    items = spark.createDataFrame([("a", " ".join(EN[:10]), 1), (None, " ".join(FR[:10]), 1), ("a2", None, 1), ("a3", "", 1), ("a", " ".join(EN[:10]), 1)], "item_id string, text string, doc_id long")
    got = same_rows(results(contamination(odd, items)), ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"])
    assert got[101][0][0] == got[102][0][0] == 0 and got[104][0][0] == 120_000 and not got[105][0][4]


def test_licenses_of_odd_rows(odd):
    assert licenses.scan_licenses(odd).count() == 0  # words of no notice, long or short


def test_packing_of_odd_rows(odd):
    pieces = packing.best_fit_packing(odd, tokenizer_path()).collect()
    whole = {}
    for r in pieces:
        whole.setdefault(r["doc_id"], []).append(r)
    assert whole[101][0]["length"] == whole[102][0]["length"] == 1  # the end alone
    assert len(whole[100]) == 2 and len({(r["piece"], r["length"], r["ids_crc32"]) for r in whole[100]}) == 1 and len({(r["sequence_id"], r["offset"]) for r in whole[100]}) == 2
    long = sorted(whole[104], key=lambda r: r["piece"])
    assert [r["start"] for r in long] == [4096 * k for k in range(len(long))] and len(long) > 20
    fills = {}
    for r in pieces:
        fills.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in fills.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def test_near_copies_of_odd_rows(odd):
    got = results(ngram_join.ngram_jaccard_join(odd))
    assert len(got[100]) == 2 and {r["class_id"] for i in (0, 100, None) for r in got[i] if r["n_links"]} == {0}
    assert got[0][0]["n_links"] == 3 and got[101][0]["n_links"] == got[105][0]["n_links"] == 0 and got[106][0]["class_id"] == 5


def test_scores_of_odd_rows(odd):
    got = same_rows(results(lm_scoring.score_documents(odd, held_out=F.lit(False))), ["n_tokens", "n_known", "base_score", "score"])
    assert got[101][0][0] == got[102][0][0] == got[103][0][0] == 1 and got[104][0][0] == 120_001
    assert all(r[3] < 0 for rows in got.values() for r in rows)


def test_toxicity_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(k, 1, int(k % 2)) for k in range(60)] + [(100, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = same_rows(results(toxicity.score_toxicity(odd, labels)), ["score", "predicted"])
    assert all(0 <= r[0] <= 1 and r[1] == int(r[0] >= 0.5) for rows in got.values() for r in rows)


def test_copies_of_odd_rows(odd):
    got = results(exact_groups(odd))
    assert got[0][0]["group_size"] == 4 and sum(r["kept"] for i in (0, 100, None) for r in got[i] if r["keep_id"] == 0) == 1
    assert {r["keep_id"] for i in (101, 102, 103) for r in got[i]} == {101, 103}


def test_pipeline_of_odd_rows(spark, odd, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    for name, df in (("documents", odd), ("labels", spark.createDataFrame([(1, 1, 1), (2, 1, 0), (None, 0, None)], "doc_id long, quality int, toxic int")), ("benchmark", spark.createDataFrame([("a", None), ("b", "no such words here at all")], "item_id string, text string"))):
        df.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns
        docs = kept
    rows = docs.select("doc_id", "text").collect()
    assert len({" ".join((r["text"] or "").split()) for r in rows}) == len(rows)
