"""Benchmark decontamination with a distributed positional inverted index.

The index stores one posting (term, document, position) for each training token
that is a term of some test item; postings of other tokens could never be read.
It is written sorted by term, so a term's list lies together in each file and
row-group statistics skip the rest. An exact match starts from the two rarest terms of
each test window (by their postings in the corpus): their intersected offset-adjusted lists give
alignments of an item with a document, which are intersected with the
offset-adjusted lists of all other terms of the item; runs of at least a window's
length are matches. Everything is DataFrame operations; no Python runs on executors.

Defined cases: null texts have no words; rows are told apart by a 96-bit hash of id
and text, so repeated rows get equal results each; a null item_id reads as the empty
string; items with the same id and different texts count as one item; items
without words match nothing; empty tables give no matches; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_struct, unrow, written

WINDOW = 10
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows up to which a table of a few numbers is broadcast (some tens of MB); beyond, a shuffle join takes over.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    """Words as they are written; :func:`lower_ascii` lower-cases each."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def lower_ascii(word: Column) -> Column:
    return F.when(F.lower(word) == word, word).otherwise(F.translate(word, UPPER, LOWER))


def keys(id_col: Column, text: Column) -> list[Column]:
    return [F.xxhash64(id_col, text).alias("k1"), F.hash(text, id_col).alias("k2")]


KEY = ["k1", "k2"]


def small(df: DataFrame) -> DataFrame:
    """A broadcast hint if the written table is small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def test_terms(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row per word of each item: item_id, item, i, word, n (words of the item)."""
    items = benchmark.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("item_id"), F.col(f"`{text_col}`").alias("text")).distinct()
    split = items.select("item_id", F.xxhash64("item_id", "text").alias("item"), words(F.col("text")).alias("words"))
    return split.select("item_id", "item", F.size("words").alias("n"), F.posexplode("words").alias("i", "word")).withColumn("word", lower_ascii(F.col("word")))


def build_index(docs: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (term, k1, k2, pos) of the words in ``vocabulary`` (word, term), written sorted by term."""
    text = F.col(f"`{text_col}`")
    rows = docs.select(*keys(F.col(f"`{id_col}`"), text), words(text).alias("words"))  # hashed once a row, not once a word
    tokens = rows.select(*KEY, F.posexplode("words").alias("pos", "word")).withColumn("word", lower_ascii(F.col("word")))
    return written(tokens.join(small(vocabulary), "word").select("term", *KEY, "pos").sortWithinPartitions("term"), "postings")


def phrase_matches(index: DataFrame, terms: DataFrame, window: int = WINDOW) -> DataFrame:
    """Exact matches (k1, k2, item_id, start, end): maximal runs of at least a window of an item's consecutive words."""
    df = index.groupBy("term").agg(F.count("*").alias("postings"))
    terms = written(terms.join(df, "term", "left").fillna(0, ["postings"]).withColumn("length", F.least("n", F.lit(window))), "terms")
    # Of each window the two rarest terms; a window with a term that never occurs has no match.
    starts = terms.withColumn("w", F.explode(F.sequence(F.greatest(F.lit(0), F.col("i") - F.col("length") + 1), F.least("i", F.col("n") - F.col("length")))))
    rare = starts.groupBy("item", "w").agg(F.slice(F.array_sort(F.collect_list(F.struct("postings", "i", "term"))), 1, 2).alias("r")).filter(F.col("r")[0]["postings"] > 0)
    rare = written(rare.select("item", F.col("r")[0].alias("a"), F.element_at("r", -1).alias("b")), "rare")
    # Their offset-adjusted lists, intersected: alignments of an item with a document.
    adjusted = lambda end: index.join(small(rare.select("item", f"{end}.i", f"{end}.term").distinct()), "term").select(*KEY, "item", (F.col("pos") - F.col("i")).alias("delta"), F.col("i").alias(f"i_{end}"))
    pairs = rare.select("item", F.col("a.i").alias("i_a"), F.col("b.i").alias("i_b")).distinct()
    met = adjusted("a").join(adjusted("b"), [*KEY, "item", "delta"]).join(small(pairs), ["item", "i_a", "i_b"], "left_semi")
    aligned = written(met.select(*KEY, "item", "delta").distinct(), "alignments")
    # Intersected with the lists of all other terms, within documents that have an alignment.
    lists = index.join(small(written(aligned.select(*KEY).distinct(), "documents")), KEY, "left_semi")
    wanted = aligned.join(small(terms.select("item_id", "item", "i", "term", "length")), "item").withColumn("pos", F.col("delta") + F.col("i"))
    met = wanted.join(lists, [*KEY, "term", "pos"]).select(*KEY, "item_id", "item", "delta", "i", "length").distinct()
    place = Window.partitionBy(*KEY, "item", "delta").orderBy("i")
    runs = met.withColumn("run", F.col("i") - F.row_number().over(place)).groupBy(*KEY, "item_id", "item", "delta", "run").agg(F.min("i").alias("a"), F.max("i").alias("b"), F.first("length").alias("length"))
    return runs.filter(F.col("b") - F.col("a") + 1 >= F.col("length")).select(*KEY, "item_id", (F.col("delta") + F.col("a")).alias("start"), (F.col("delta") + F.col("b")).alias("end"))


def proximity_matches(index: DataFrame, queries: DataFrame, span: int) -> DataFrame:
    """(query, k1, k2, start): places where all terms of a query (query, term) lie within ``span`` words.

    ``start`` is the position of the query's rarest term; other terms are at most
    ``span - 1`` words from it. Lists are met in blocks of ``span`` positions.
    """
    sizes = index.groupBy("term").agg(F.count("*").alias("postings"))
    q = written(queries.distinct().join(sizes, "term", "left").fillna(0, ["postings"]), "queries")
    lead = q.groupBy("query").agg(F.min(F.struct("postings", "term")).alias("r"), F.count("*").alias("n")).filter("r.postings > 0")
    block = F.floor(F.col("pos") / span)
    anchors = index.join(small(lead.select("query", F.col("r.term").alias("term"), "n")), "term").select("query", "n", *KEY, F.col("pos").alias("start"), F.explode(F.array(block - 1, block, block + 1)).alias("block"))
    others = index.join(small(q.select("query", "term")), "term").select("query", "term", *KEY, "pos", block.alias("block"))
    near = anchors.join(others, ["query", *KEY, "block"]).filter(F.abs(F.col("pos") - F.col("start")) < span)
    return near.groupBy("query", *KEY, "start", "n").agg(F.countDistinct("term").alias("met")).filter("met = n").select("query", *KEY, "start")


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`phrase_matches` of all benchmark items in all documents, written."""
    terms = test_terms(benchmark)
    vocabulary = written(terms.select("word").distinct().withColumn("term", F.xxhash64("word")), "vocabulary")
    index = build_index(docs, vocabulary, id_col, text_col)
    return written(phrase_matches(index, terms.withColumn("term", F.xxhash64("word")), window), "matches")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = matches(docs, benchmark, window, id_col, text_col)
    hit = found.select(*KEY, F.explode(F.sequence("start", "end")).alias("pos")).distinct().groupBy(*KEY).agg(F.count("*").alias("n_hit"))
    items = found.groupBy(*KEY).agg(F.sort_array(F.collect_set("item_id")).alias("items"))  # at most the benchmark's items
    per_doc = hit.join(items, KEY)
    text = F.col(f"`{text_col}`")
    all_docs = docs.select(F.col(f"`{id_col}`").alias(id_col), *keys(F.col(f"`{id_col}`"), text), F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long").alias("n_words"))
    n_hit, ids = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return all_docs.join(per_doc, KEY, "left").select(
        id_col, "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no window of a benchmark item occurs."""
    dirty = written(matches(docs, benchmark, window, id_col, text_col).select(*KEY).distinct(), "dirty")
    rows = docs.select(row_struct(docs), *keys(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")))
    return unrow(rows.join(small(dirty), KEY, "left_anti"), docs.columns)
