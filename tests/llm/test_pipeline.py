from __future__ import annotations

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import packing, queries

DIR = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_rows(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    n = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        assert 0 < docs.count() <= n
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DIR).collect()
    by = {}
    for r in packed:
        by.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    assert set(by) == {r.doc_id for r in docs.collect()}
    assert all(sorted((s, k) for s, k, _ in x) == packing.pieces(x[0][2]) for x in by.values())
    run = corpus_pipeline.run(spark, DIR)
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in run.collect()) == sorted((r.doc_id, r.start, r.ids_crc32) for r in packed)


def test_stages_on_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, "en", "s", None), (2, "", None, None, 0), (None, "a b c " * 30, "en", "s", 180), (3, "a b c " * 30, "en", "s", 180), (3, "a b c " * 30, "en", "s", 180), (4, "x " * 20_000, "en", "s", 40_000)]
    for data in (rows, []):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, spark.createDataFrame(data, schema), DIR)
            assert out.count() >= 0, name


def _shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}


def test_near_copies_from_four_fifths_on_go(spark):
    docs = []
    for g in range(30):
        w = [f"g{g}w{k}" for k in range(104)]  # 100 shingles; each changed word inside takes 5 of them
        docs.append((3 * g, " ".join(w)))
        changed = {k: f"new{g}x{k}" for k in (20, 50)}  # 90 of 110 shingles shared: 0.818
        docs.append((3 * g + 1, " ".join(changed.get(k, x) for k, x in enumerate(w))))
        changed = {k: f"far{g}x{k}" for k in (10, 40, 70)}  # 85 of 115 shared: 0.739
        docs.append((3 * g + 2, " ".join(changed.get(k, x) for k, x in enumerate(w))))
    sets = {i: _shingles(t) for i, t in docs}
    group = {i: i for i in sets}
    for i in sets:
        for k in sets:
            if i < k and 100 * len(sets[i] & sets[k]) >= 80 * len(sets[i] | sets[k]):
                a, b = group[i], group[k]
                group = {x: min(a, b) if y in (a, b) else y for x, y in group.items()}
    want = sorted(i for i in sets if group[i] == i)
    assert len(want) == 60
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, DIR).collect()) == want


def test_rows_with_null_and_repeated_ids(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    near = " ".join(f"near{k}" for k in range(60))
    hit = "so said " + spark.read.parquet(f"{DIR}/benchmark.parquet").where("item_id is not null").first().text + " and more"
    rows = [(None, near), (None, near), (7, near), (7, near), (5, "clean one of id five"), (5, near), (None, "only one"), (8, None), (8, None)]
    path = str(tmp_path / "near")
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], schema).repartition(3).write.parquet(path)
    out = corpus_pipeline.drop_near_duplicates(spark, spark.read.parquet(path), DIR).collect()
    assert sorted(((r.doc_id, r.text) for r in out), key=repr) == sorted([(5, near), (5, "clean one of id five"), (None, "only one"), (8, None), (8, None)], key=repr)
    rows = [(None, hit), (None, "clean"), (1, hit), (1, "clean too"), (2, None)]
    path = str(tmp_path / "hits")
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], schema).repartition(3).write.parquet(path)
    out = corpus_pipeline.drop_contaminated(spark, spark.read.parquet(path), DIR).collect()
    assert sorted(((r.doc_id, r.text) for r in out), key=repr) == sorted([(None, "clean"), (1, "clean too"), (2, None)], key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings", "conversations"):
        con.sql(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    df = queries.QUERIES[name](spark, DIR)
    rel = con.sql(queries.ORACLE_SQL[name])
    at = [rel.columns.index(c) for c in df.columns]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(r[k] for k in at)) for r in rel.fetchall())


@pytest.mark.parametrize("stage", ["near_dedup", "decontamination"])
def test_rows_keep_their_keys_when_the_parallelism_changes(spark, tmp_path, monkeypatch, stage):
    """Between the search and the removal the files are cut otherwise, as when executors come or go."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet").withColumn("text", F.concat("text", F.lit(" tail "), F.col("doc_id") % 7))
    item = spark.read.parquet(f"{DIR}/benchmark.parquet").first().text
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit(" "), F.lit(item))).otherwise(F.col("text")))
    docs.repartition(16, "doc_id").write.parquet(str(tmp_path / "docs"))
    run, without = dict(corpus_pipeline.STAGES)[stage], corpus_pipeline._without
    spark.conf.set("spark.sql.files.openCostInBytes", 1000)
    try:
        want = sorted(r.doc_id for r in run(spark, spark.read.parquet(str(tmp_path / "docs")), DIR).collect())

        def changed(*args):
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", 1)
            return without(*args)

        monkeypatch.setattr(corpus_pipeline, "_without", changed)
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", 64)
        got = sorted(r.doc_id for r in run(spark, spark.read.parquet(str(tmp_path / "docs")), DIR).collect())
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert got == want and 0 < len(got) < docs.count()


def test_stages_leave_columns_of_their_own_names(spark):
    own = {c: F.concat(F.lit(f"{c} "), F.col("doc_id")) for c in ("_row", "_score", "_row_", "_best")}
    docs = spark.read.parquet(f"{DIR}/documents.parquet").withColumns(own)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "line_dedup":
            continue
        out = stage(spark, docs, DIR)
        assert out.columns == docs.columns
        assert all(r[c] == f"{c} {r.doc_id}" for r in out.collect() for c in own), name
