"""Rank-order profiles against plain counting of n-grams, and accuracy on the held-out quarter."""

from __future__ import annotations

import random
import unicodedata
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import language_id, queries

SCHEMA = "doc_id long, text string, lang string"


def words(text):
    out, word = [], ""
    for c in text.lower() + " ":
        if unicodedata.category(c)[0] in "LM":
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def plain_grams(text):
    count = Counter()
    for w in words(text):
        padded = f" {w} "
        for n in (1, 2, 3):
            for k in range(len(padded) - n + 1):
                if padded[k : k + n] != " ":
                    count[padded[k : k + n]] += 1
    return count


def number(gram):
    return sum(ord(c) << 21 * k for k, c in enumerate(reversed(gram)))


def ordered(count, most):
    return sorted(count, key=lambda g: (-count[g], number(g)))[:most]


def brute(rows, learned, ranks, own_ranks):
    total = defaultdict(Counter)
    for _, text, lang in learned:
        if lang is not None and any(c.isalpha() for c in text or ""):
            total[lang].update(plain_grams(text))
    profile = {lang: {g: k for k, g in enumerate(ordered(c, ranks))} for lang, c in total.items()}
    out = []
    for i, text, _ in rows:
        if not profile or not any(c.isalpha() for c in text or ""):
            out.append((i, "und", 0.0))
            continue
        own = ordered(plain_grams(text), own_ranks)
        apart = {lang: sum(min(abs(p[g] - k), ranks) if g in p else ranks for k, g in enumerate(own)) for lang, p in profile.items()}
        best = min(apart, key=lambda lang: (apart[lang], lang.encode()))
        out.append((i, best, round(1 - apart[best] / (len(own) * ranks), 9)))
    return sorted(out, key=str)


def made(seed, n=80):
    rng = random.Random(seed)
    stock = {"en": "the of and thing with", "de": "der die und über ung", "fr": "le la et é être ça", "ja": "日本語 の は", "": "x y z", "hi": "नमस्ते दुनिया"}
    rows = []
    for i in range(n):
        lang = rng.choice(list(stock))
        text = rng.choice([" ", "\n", ", 1 "]).join(rng.choices(stock[lang].split(), k=rng.choice([1, 3, 40])))
        rows.append((i, rng.choice([text, text, text, text.upper(), None, "12 !"]), rng.choice([lang, lang, None])))
    return rows + [(None, "the end", "en"), (5, "İstanbul ΣΑΣ", "tr"), (6, "́́", "en"), (7, "", "en")]


def found(df):
    return sorted(((r._id, r.lang_pred, round(r.score, 9)) for r in df.collect()), key=str)


@pytest.mark.parametrize("ranks,own,size,per_pass", [(400, 400, 1_000_000, 1000), (12, 7, 5, 2), (30, 30, 1, 1)])
def test_same_as_plain_counting(spark, monkeypatch, ranks, own, size, per_pass):
    monkeypatch.setattr(language_id, "_SLICE", size)
    monkeypatch.setattr(language_id, "_HELD", 50)
    monkeypatch.setattr(language_id, "PASS", per_pass)
    rows = made(size)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({"_text": F.lit("x"), "score": F.lit("y"), "gram": F.lit(1)})
    known = language_id.profiles(df, ranks=ranks)
    assert found(language_id.detect(df, known, ranks=ranks, own_ranks=own)) == brute(rows, rows, ranks, own)


def test_slices_of_a_long_text_add_up(monkeypatch):
    text = "Wörter und " * 50 + "x" * 500 + " 日本"
    whole = language_id.grams(text)
    assert dict(zip(map(int, whole[0]), map(int, whole[1]))) == {number(g): n for g, n in plain_grams(text).items()}
    for size in (1, 2, 3, 7, 549, 550, 551):
        monkeypatch.setattr(language_id, "_SLICE", size)
        part = language_id.grams(text)
        assert (part[0] == whole[0]).all() and (part[1] == whole[1]).all(), size


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    true = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = queries.op13_language_id(spark, sf).collect()
    assert len(got) == len(true)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == true[r.doc_id] for r in held) >= 0.98 * len(held)


def test_nothing_to_learn_from_and_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    rows = spark.createDataFrame([(1, "some text", None), (2, None, "en"), (3, "77", "en")], SCHEMA)
    assert found(language_id.detect(rows, language_id.profiles(rows))) == [(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)]
    assert found(language_id.detect(none, language_id.profiles(rows))) == []
