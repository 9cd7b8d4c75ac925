"""The trie of conversations against a plain trie of dicts."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def ordered(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    return {c: [t[2:] for t in sorted(turns)] for c, turns in convs.items()}


def brute(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        own = (len(members[path]) - 1) * len(path[-1][1]) if path else 0
        leaves[path] = sum(leaves[k] for k in children[path]) or 1
        saved[path] = own + sum(saved[k] for k in children[path])
    out = []
    for path, of in members.items():
        ends = ",".join(str(c) for c in sorted(of) if len(convs[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(of), len(path), parent, len(of), len(children[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def made(seed, n, longest=12):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        c = c * 3 - 20
        for turn in range(rng.choice([0, 1, 2, 3, 5, longest])):
            text = rng.choice(["a", "b", "é" * 3, "", None, "long " * 50]) if turn > 2 else rng.choice(["a", "a", "a", "b"])
            rows.append((c, turn * 2 if rng.random() > 0.05 else None, rng.choice(["user", "user", None]), text))
    return rows


@pytest.mark.parametrize("chunk,fan,parts", [(16_384, 256, 4), (16_384, 2, 13), (3, 2, 7), (1, 3, 5)])
def test_same_as_a_trie_of_dicts(spark, chunk, fan, parts):
    rows = made(parts, 150, 12 if chunk > 1 else 4)
    rows += [(10_000 + k, t, "user", x) for k in range(60) for t, x in enumerate(["a", "same", "same"])]  # a hot path
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, SCHEMA)
        turns = prefix_trie.numbered(prefix_trie.digests(df), ["_conv"], ["_turn", "_tie"])
        assert found(prefix_trie.trie(turns, chunk=chunk, fan=fan)) == brute(ordered(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_ids_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    rows = [(k, 0, "user", "hi") for k in range(20)] + [(k, 0, "user", "zz") for k in range(20, 31)]
    assert found(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(ordered(rows))


def test_rebuilt(spark):
    rows = [r for r in made(3, 60, 20) if r[0] % 5 or r[0] % 2]
    own = ordered(rows)
    want = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        want[c] = own.get(base, [])[:h] + own[c][h:]
    turns, ids = prefix_trie.rebuilt(spark.createDataFrame(rows, SCHEMA))
    assert found(prefix_trie.trie(turns, ids)) == brute(want)
    assert any(not turns for turns in want.values())


def test_numbering_over_several_runs(spark):
    rows = spark.range(1000).select((F.col("id") % 3 == 0).cast("int").alias("g"), (F.col("id") * 7919 % 1000).alias("x"))
    spark.conf.set("spark.sql.shuffle.partitions", 9)
    try:
        got = prefix_trie.numbered(rows, ["g"], ["x"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    for g in (0, 1):
        mine = sorted((r.x, r._pos) for r in got if r.g == g)
        assert [p for _, p in mine] == list(range(len(mine)))


def test_odd_input(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert found(prefix_trie.prefix_trie(none)) == []
    turns, ids = prefix_trie.rebuilt(none)
    assert found(prefix_trie.trie(turns, ids)) == []
    assert found(prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA))) == []
    # repeated rows are repeated turns; rows of one turn stand by role and text; the role is part of a turn
    rows = [(1, 0, "u", "b"), (1, 0, "u", "a"), (1, 0, "u", "a"), (2, None, "u", "a"), (2, 0, "v", "a"), (3, 7, "u", "a" * 100_000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"_id": F.lit(1), "_conv": F.lit("x"), "key": F.lit(None).cast("string")})
    assert found(prefix_trie.prefix_trie(df)) == brute(ordered(rows))
