from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from tidemark.llm import line_dedup as L


def chunks(text):
    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    long = [x.count(" ") + 1 >= L.LONG_WORDS for x in lines]
    r = [((h[i - 1] if i else 0) * 31 + h[i]) % 2**32 for i in range(len(h))]
    out, own = [], []
    for i in range(len(lines)):
        own.append(i)
        if i == len(lines) - 1 or long[i] or long[i + 1] or i and r[i - 1] > r[i] <= r[i + 1]:
            out.append(("\n".join(lines[k] for k in own), len(own) >= 2 or long[own[0]]))
            own = []
    return out


def brute(docs):
    seen, out = {}, {}
    for i, text in sorted(docs):
        left = []
        for t, able in chunks(text):
            if able and t in seen:
                continue
            if able:
                seen[t] = i
            left.append(t)
        out[i] = "\n".join(left)
    return out


def _docs(n=80):
    rng = random.Random(6)
    lines = ["line %d" % i for i in range(30)] + [" ".join(f"w{i}{k}" for k in range(60)) for i in range(4)] + [""]
    return [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 25)))) for i in range(n)]


def test_against_brute_force(spark):
    docs = _docs()
    passage = "\n".join(f"shared {i}" for i in range(12))
    docs += [(900 + i, f"own {i}\n{passage}\nend {i}") for i in range(5)]
    df = spark.createDataFrame([(i, t, 7) for i, t in docs], "doc_id long, text string, n_chunks int").repartition(5)
    got = {r.doc_id: r for r in L.dedup_lines(df).collect()}
    expected = brute(docs)
    assert {i: r.text for i, r in got.items()} == expected
    assert all(r.removed_chars == len(dict(docs)[i]) - len(r.text) for i, r in got.items())
    assert passage in got[900].text
    assert all(got[901 + k].removed_lines >= 6 and f"own {1 + k}" in got[901 + k].text for k in range(4))


def test_nulls_repeats_and_long_lines(spark):
    long = " ".join(["word"] * 60)
    rows = [(1, f"a\n{long}"), (2, f"b\n{long}\nc"), (3, None), (4, ""), (None, f"z\n{long}"), (2, f"b\n{long}\nc"), (5, long + "\n" + long)]
    out = L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = sorted(((r.doc_id if r.doc_id is not None else -1, r.text) for r in out), key=repr)
    # the row without an id sorts first and keeps the passage; equal rows get the same result
    assert texts == sorted([(-1, f"z\n{long}"), (1, "a"), (2, "b\nc"), (2, "b\nc"), (3, None), (4, ""), (5, "")], key=repr)
    assert L.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_passages_of_two_to_six_short_lines(spark):
    docs, kept = [], {}
    for n in range(2, 7):
        for g in range(6):  # 60 words or more in lines of under 50; blank lines beside some
            passage = "\n".join(" ".join(f"p{n}g{g}l{k}w{w}" for w in range(120 // n if n > 2 else 40)) for k in range(n))
            for c in range(4):
                i = len(docs)
                gap = "\n\n" if c % 2 else "\n"
                own = [f"own {i} a\nown {i} b", f"own {i} c\nown {i} d"]
                docs.append((i, own[0] + gap + passage + gap + own[1]))
                kept[i] = (passage, c == 0, own)
    short = "few words\nof two lines"
    docs += [(900 + i, f"x {i}\n{short}\nu {i}\nv {i}") for i in range(3)] + [(990, None), (991, ""), (None, "z\n" + kept[0][0])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in L.dedup_lines(df, passages=True).collect()}
    first = got[None].text
    for i, (passage, stays, own) in kept.items():
        left = got[i].text
        lines = set(passage.split("\n")) & set(left.split("\n"))
        assert all(part in left for part in own)
        if passage in first:  # the row without an id sorts first
            assert not lines
        else:
            assert passage in left if stays else not lines, (i, left)
        assert got[i].removed_chars == len(dict(docs)[i]) - len(left)
        assert got[i].removed_lines == dict(docs)[i].count("\n") - left.count("\n")
    assert got[990].text is None and got[991].text == ""
    plain = {r.doc_id: r.text for r in L.dedup_lines(df).collect()}
    assert any(set(p.split("\n")) & set(plain[i].split("\n")) for i, (p, stays, _) in kept.items() if not stays)


def test_repeats_within_a_text_leave_one(spark):
    line = "a b c d e f"
    docs = [(1, "\n".join([line] * 40)), (2, "\n".join([line] * 40)), (2, "\n".join([line] * 40)), (3, "one line")]
    out = L.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), passages=True).collect()
    texts = sorted((r.doc_id, r.text) for r in out)
    assert line in texts[0][1] and texts[0][1].count(line) <= 3
    assert texts[1:] == [(2, ""), (2, ""), (3, "one line")]


def test_texts_that_share_a_hash_are_told_apart(spark):
    held = [(1, 10, 0, "a", 7), (2, 20, 0, "b", 7), (3, 30, 1, "a", 7), (4, 40, 0, "c", 8), (5, 50, 0, "c", 8), (None, 60, 0, "c", 8)]
    df = spark.createDataFrame(held, "_id long, _h long, _k int, _t string, _ch long")
    key = F.struct(F.col("_id"), F.col("_h"), F.col("_k"))
    gone = L._later_than_first(df.drop("_t"), df, key).select("_id").collect()
    assert sorted(r._id for r in gone) == [3, 4, 5]


def test_null_texts_stay_rows(spark, tmp_path):
    from tidemark.llm import queries

    spark.createDataFrame([(1, None), (2, ""), (None, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.QUERIES["op3_line_dedup"](spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.text, r.n_chunks, r.n_removed) for r in out} == {(1, None, 0, 0), (2, "", 1, 0), (None, None, 0, 0)}
