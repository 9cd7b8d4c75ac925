from __future__ import annotations

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import gbt, quality


def test_trees_walk_like_a_loop():
    rng = np.random.RandomState(0)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(int)
    m = gbt.fit(x, y, trees=12, depth=3)

    def one(row):
        total = m.base
        for node in m.roots:
            while m.left[node] != node:
                node = m.left[node] if row[m.feature[node]] <= m.threshold[node] else m.right[node]
            total += m.value[node]
        return total

    assert np.allclose(m.margin(x), [one(r) for r in x])
    assert ((m.score(x) > 0.5) == y).mean() > 0.97


def test_no_rows_and_one_class():
    assert gbt.fit(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert gbt.fit(np.zeros((5, 3)), np.ones(5)).score(np.zeros((1, 3)))[0] > 0.9


def test_statistics_are_finite():
    for text in (None, "", " ", "\n\n", "a", "x" * 100_000, "é" * 50, "A|B! 12\n" * 40):
        s = quality.statistics(text)
        assert len(s) == len(quality.NAMES) and np.isfinite(s).all()


def test_learns_outside_the_fold_and_ignores_bad_rows(spark):
    rng = random.Random(3)

    def good():
        return " ".join("".join(rng.choice("etaoin") for _ in range(rng.randrange(2, 8))) for _ in range(60)) + "."

    rows = [(i, good() if i % 3 else "BUY!! NOW!! | $$$ " * 20, i % 3 > 0) for i in range(600)]
    docs = spark.createDataFrame([(i, t, 5) for i, t, _ in rows] + [(1, rows[1][1], 5), (None, "x", 5), (9000, None, 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(q)) for i, _, q in rows] + [(None, 1), (3, None), (77777, 0)], "doc_id long, quality int")
    model = quality.train(docs, labels, sample_rows=300)
    out = quality.score(docs.drop("score"), model).withColumn("held", quality.held_out()).collect()
    assert len(out) == 603
    held = [r for r in out if r.held]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    assert all((r.score >= 0.5) == (r.doc_id % 3 > 0) for r in held if r.doc_id < 600)
    again = quality.train(docs.repartition(5), labels.repartition(3), sample_rows=300)
    assert np.array_equal(model.value, again.value)
    empty = quality.train(docs.limit(0), labels)
    assert quality.score(docs.select("doc_id", "text"), empty).agg(F.max("score")).first()[0] == 0.5


def test_query_on_the_held_out_fold(spark):
    from tidemark.llm import queries

    sf = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op2_quality"](spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    quality_of = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in rows if r.held_out and quality_of.get(r.doc_id) is not None]
    assert len(held) > 20 and sum(r.predicted == quality_of[r.doc_id] for r in held) / len(held) >= 0.9
