"""Columns with clashing names and tables without rows, operator by operator."""

from __future__ import annotations

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, divergence, html_extract, language_id, line_dedup, packing, prefix_trie, warc

LINES = "the first line of many\nthe second line of many\nthe third line of many\nthe fourth line of many"
LONG = " ".join(f"word{k}" for k in range(60))


def documents(spark, *names):
    rows = [(1, f"{LONG}\nalone", "en", "s", 9), (2, f"other\n{LONG}", "en", "s", 9), (3, None, None, None, None), (4, "", "de", "t", 0), (None, LINES, "de", "t", 9)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return d.withColumns({c: F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in names})


@pytest.mark.parametrize("passages", [False, True])
def test_line_dedup_keeps_columns_of_its_own_names(spark, passages):
    names = ("_h", "_gone", "_later", "_Early", "_out", "_id", "_k", "_h_given")
    plain = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(documents(spark), passages=passages).collect()}
    out = line_dedup.dedup_lines(documents(spark, *names), passages=passages)
    assert out.columns[:13] == documents(spark, *names).columns
    rows = out.collect()
    assert {r.doc_id: (r.text, r.n_removed) for r in rows} == plain and plain[2] == ("other", 1) and plain[3] == (None, 0)
    assert all(r[c] == f"{c} {'-' if r.doc_id is None else r.doc_id}" for r in rows for c in names)


def test_line_dedup_with_key_and_text_of_its_own_names(spark):
    d = documents(spark).withColumnsRenamed({"doc_id": "_out", "text": "_h"})
    out = line_dedup.dedup_lines(d, "_out", "_h")
    assert {r["_out"]: r["_h"] for r in out.collect()}[2] == "other" and out.columns[:5] == d.columns


def test_line_dedup_stage_keeps_columns_with_the_names_of_its_counts(spark):
    names = ("n_removed", "removed_lines", "_gone", "n_chunks")
    d = documents(spark, *names)
    out = dict(corpus_pipeline.STAGES)["line_dedup"](spark, d, None)
    assert out.columns == d.columns
    rows = out.collect()
    assert all(r[c] == f"{c} {'-' if r.doc_id is None else r.doc_id}" for r in rows for c in names)
    assert {r.doc_id: r.text for r in rows}[2] == "other" and len(rows) == 5


def test_tables_without_rows(spark):
    none = documents(spark).limit(0)
    assert line_dedup.dedup_lines(none).count() == 0 and line_dedup.dedup_lines(none, passages=True).count() == 0
    assert divergence.audit(none).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.extract_pages(pages).count() == 0 and warc.round_trip(spark, pages).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert prefix_trie.prefix_trie(turns).count() == 0 or prefix_trie.prefix_trie(turns).first().n_convs == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<double>")
    some = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert ann.nearest_neighbours(vectors, some).count() == 0 and ann.nearest_neighbours(some, vectors).count() == 0
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    assert packing.pack(none, path).count() == 0


def test_other_operators_leave_clashing_columns_alone(spark):
    names = ("_id", "_text", "lang_pred", "score", "rank", "term", "value", "item", "n", "_row")
    d = documents(spark, *names)
    known = language_id.profiles(d)
    assert sorted(r._id or 0 for r in language_id.detect(d, known).collect()) == [0, 1, 2, 3, 4]
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))  # a source for each document
    plain = sorted(map(repr, divergence.audit(documents(spark).withColumn("source", own), min_docs=1).collect()))
    assert sorted(map(repr, divergence.audit(d.withColumn("source", own), min_docs=1).collect())) == plain and plain
    rows = [(1, "http://a/", "<p>One two three.</p>", "x", "y"), (2, None, None, "x", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string, archive string")
    assert sorted((r.name, r.payload_bytes) for r in warc.round_trip(spark, pages).collect()) == [("1", len(rows[0][2])), ("2", 0)]
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    extra = documents(spark, "start", "length", "offset", "sequence_id", "_id", "ids")
    assert packing.pack(extra, path).agg(F.sum("length")).first()[0] == packing.pack(documents(spark), path).agg(F.sum("length")).first()[0]
