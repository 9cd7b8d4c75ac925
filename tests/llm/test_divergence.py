"""The divergence audit against plain dictionaries."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs, top):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = TERM.findall((text or "").translate(LOWER))
        docs[lang].update(set(words))
        counts[lang, source].update(words)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = {t for t, n in docs[lang].items() if n >= min_docs}
        total = {s: sum(n for t, n in counts[lang, s].items() if t in kept) for s in sources}
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])
        share = {s: {t: 1 + 10**9 * (counts[lang, s][t] + 5) // (total[s] + 5 * len(kept)) for t in kept} for s in sources}
        q = {t: 1 + 10**9 * (whole[t] + 5) // (sum(total.values()) + 5 * len(kept)) for t in kept}
        for s in sources:
            pairs = [(-sum(abs(share[s][t] - share[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(q[t] - share[s][t], t.encode()) for t in kept if counts[lang, s][t] and share[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -value, k + 1) for k, (value, item) in enumerate(found)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def made(seed, n=150):
    rng = random.Random(seed)
    stems = ["wort", "Élan", "été", "Été", "word", "words", "wordsmith", "wordsmiths", "日本語", "日本", "a", "b", "c"] + [f"pre{'x' * 40}{c}" for c in "abcdefgh"]
    rows = []
    for i in range(n):
        words = rng.choices(stems, k=rng.choice([0, 1, 5, 60]))
        text = None if rng.random() < 0.05 else rng.choice([" ", ", ", "\n1"]).join(words)
        source = rng.choice(["hot", "hot", "s1", "s2", "s3", "s4", "é", None, ""])
        rows.append((i, text, rng.choice(["en", "en", "de", None]), source))
    rows.append((n, "unheard", "xx", "only"))
    rows.append((n, None, "yy", "one"))
    return rows + [(n, "", "yy", "two")]


@pytest.mark.parametrize("block,top", [(256, 50), (2, 4), (1, 1)])
def test_same_as_dictionaries(spark, monkeypatch, block, top):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "HELD", 40)
    rows = made(block)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({"n": F.lit(1), "term": F.lit("x"), "base": F.lit(None).cast("string")})
    assert found(divergence.audit(df, min_docs=3, top=top)) == brute(rows, 3, top)


def test_ties_beyond_the_limit(spark):
    """Many terms with one value, some with a long start in common: the smallest in bytes are chosen."""
    items = [f"{'p' * 70}{k:03d}" for k in range(90)] + ["z", "é", "a", "ab", "abc", "日本", "\U0001f600"]
    rows = [("g", t, 7) for t in items] + [("g", f"q{k}", 2**30) for k in range(3)] + [("few", t, 7) for t in items[:4]] + [("low", t, 0) for t in items[:9]]
    df = spark.createDataFrame(rows, "grp string, item string, value long")
    for k in (1, 4, 10, 50, 99):
        got = sorted(tuple(r) for r in divergence.highest(df, ["grp"], k=k).collect())
        want = []
        for g in ("g", "few", "low"):
            want += sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1].encode()))[:k]
        assert got == sorted(want), k


def test_shares_are_exact_for_large_counts(spark):
    df = spark.createDataFrame([(10**13 + 3, 10**15 + 7, 12345)], "n long, total long, v long")
    got = df.select(divergence._share("n", "total")).first()[0]
    assert got == 1 + 10**9 * (10**13 + 8) // (10**15 + 7 + 5 * 12345)


def test_empty_table(spark):
    assert found(divergence.audit(spark.createDataFrame([], SCHEMA))) == []
