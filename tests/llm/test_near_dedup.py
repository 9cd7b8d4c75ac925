from __future__ import annotations

import random

import numpy as np
import pytest

from tidemark.llm import near_dedup as N
from tidemark.llm.components import components


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(docs, percent=85):
    sets = [(i, shingles(t)) for i, t in docs]
    parent = {i: i for i, _ in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[x + 1 :]:
            if a and 100 * len(a & b) >= percent * len(a | b):
                lo, hi = sorted((root(i), root(j)))
                parent[hi] = lo
    return {i: (len(s), root(i)) for i, s in sets}


def _docs(seed, groups=12, vocabulary=400):
    rng = random.Random(seed)
    docs = []
    for g in range(groups):
        words = [f"w{rng.randrange(vocabulary)}" for _ in range(rng.choice([3, 8, 60, 200]))]
        for _ in range(rng.choice([1, 2, 9])):
            own = list(words)
            for _ in range(rng.choice([0, 0, 1, 2])):
                own[rng.randrange(len(own))] = f"x{rng.randrange(9)}"
            docs.append((len(docs), " ".join(own)))
    return docs + [(len(docs), ""), (len(docs) + 1, "  \n"), (len(docs) + 2, "a b"), (len(docs) + 3, "A\tB")]


@pytest.mark.parametrize("rows", [2048, 6])
def test_against_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(N, "NODE_ROWS", rows)  # six: nodes branch, and blocks of what stays large meet each other
    docs = _docs(1, groups=25)
    found = N.near_duplicates(spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_shingles int").repartition(4))
    assert {r._id: (r.n_shingles, r.component_id) for r in found.collect()} == brute(docs)


def test_nulls_and_repeats(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (2, "A b c d e f"), (None, "a b c d e f"), (7, None), (9, "q r s t u v w")]
    out = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted(((r._id if r._id is not None else -1, r.n_shingles, r.component_id) for r in out), key=repr)
    assert got == sorted([(5, 2, 2), (5, 2, 2), (2, 2, 2), (-1, 2, None), (7, 0, 7), (9, 3, 9)], key=repr)
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_links_are_exact():
    rng = np.random.RandomState(0)
    sets = [np.unique(rng.randint(0, 40, 30)) for _ in range(300)]
    counts = np.array([len(s) for s in sets])
    linked = N._linked(counts, np.concatenate(sets), np.repeat(np.arange(len(sets)), counts), 60)
    for i in range(0, 300, 7):
        for j in range(300):
            both = len(np.intersect1d(sets[i], sets[j]))
            assert linked[i, j] == (100 * both >= 60 * (counts[i] + counts[j] - both))


def test_components_of_paths_and_stars(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 20)] + [(7, 7), (None, 3), (200, 300), (300, 200)]
    rng.shuffle(edges)
    out = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(20)} | {200: 200, 300: 200}
