from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from tidemark.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window):
    grams = {}
    for i, text in items:
        w = words(text)
        for s in range(max(len(w) - window, 0) + 1 if w and i is not None else 0):
            grams.setdefault(tuple(w[s : s + window]), set()).add(i)
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(g) for g in grams}:
            for s in range(len(w) - n + 1):
                if (g := tuple(w[s : s + n])) in grams:
                    hit |= set(range(s, s + n))
                    found |= grams[g]
        out.append((d, len(w), len(hit), sorted(map(str, found))))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    rng = random.Random(4)

    def text(n):
        return " ".join(rng.choice("ab é9 The,the-Ü x.y".split(" ")) for _ in range(n))

    items = [(i, text(rng.randrange(0, 9))) for i in range(12)] + [(90, None), (91, "..."), (92, "é9"), (None, "ab the")]
    docs = [(i, text(rng.randrange(0, 60))) for i in range(60)] + [(100, None), (101, ""), (None, items[3][1]), (102, "ab"), (102, "ab"), (103, "the " * 30_000)]
    found = D.contamination(
        spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, segment string, ordinal int").repartition(3),
        spark.createDataFrame(items, "item_id long, text string"), window=4,
    )
    got = [(r.doc_id, r.n_words, r.n_hit or 0, sorted(map(str, r["items"] or []))) for r in found.collect()]
    assert sorted(got, key=repr) == brute(docs, items, 4)


def test_small_segments_and_blocks_change_nothing(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice("abcd") for _ in range(40))) for i in range(30)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    t = spark.createDataFrame([(i, docs[i][1][:21]) for i in range(5)], "item_id string, text string")
    index = D.build_index(d, segment_chars=100)
    whole = D.find_phrases(index, t, window=5)
    parts = D.find_phrases(index, t, window=5, block_windows=3)
    keys = ["doc_id", "item_id"]
    assert whole.select(*keys).distinct().count() == parts.select(*keys).distinct().count() > 0

    def covered(df):
        x = df.select("doc_id", "item_id", F.explode(F.sequence("start", F.col("stop") - 1)).alias("p")).distinct()
        return sorted(map(tuple, x.collect()))

    assert covered(whole) == covered(parts)


def test_proximity(spark):
    d = spark.createDataFrame([(1, "one x two y three"), (2, "three two one"), (3, "one two z z z z three"), (4, "one two"), (5, "two three"), (6, None)], "doc_id long, text string")
    t = spark.createDataFrame([("i", "one two three")], "item_id string, text string")
    near = D.find_near(D.build_index(d), t, window=3, slop=2).select("doc_id", "start", "stop").collect()
    assert sorted(map(tuple, near)) == [(1, 0, 5), (2, 0, 3)]


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    t = spark.createDataFrame([], "item_id long, text string")
    assert D.contamination(d, t).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert D.contamination(one, t).first().n_hit is None
