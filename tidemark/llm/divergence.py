"""Source divergence audit: how far the vocabulary of each source of a language is from the others', and by which terms.

Documents are counted where they lie, so what travels is counts by (language, source, term), never words. Every source
gives every kept term a share per thousand million, with ``PRIOR`` added to each count; a source that lacks a term gives it its baseline.

*Pairs.* The distance of two sources is a sum over all kept terms, but only terms that a source has differ from its baseline.
So it is the distance of the baselines for every term, plus a correction for the terms of either source against the other's
baseline (from the counts of equal shares, looked up in blocks of sources), plus a correction for the terms that both
have. The last one is added up in numpy for blocks of sources, term by term; no row is made for a pair of a term.

*Terms.* The highest terms of each group are found by a radix select: distributed histograms over the upper and then the lower
bits of the values give each group's threshold. Ties at it are refined by the bytes of the term, two at a time after what
the candidates have in common. Only what lies above the threshold is ranked.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import written

#: Documents of a language that a kept term is in, what is added to each count, terms reported for each group.
MIN_DOCS, PRIOR, TOP = 30, 5, 50
SCALE = 1_000_000_000
#: Sources that are compared in one block, and distinct (group, term) counts that a task holds before it hands them on.
BLOCK, HELD = 256, 300_000
#: Values have at most 30 bits and one more; a histogram is over 15 of them.
_LOW = 1 << 15

_UPPER = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of each term, in parts that are still to be added up.

    Terms are runs of letters A-Z (lower-cased), a-z and characters beyond ASCII. Each (lang, source) also has rows with a null term.
    """
    schema = "lang string, source string, term binary, n long, docs long"

    def told(held: dict) -> pa.RecordBatch:
        lang, source, term, n, in_docs = [], [], [], [], []
        for (a, b), (times, documents) in held.items():
            lang += [a] * (len(times) + 1)
            source += [b] * (len(times) + 1)
            term += [None, *times]
            n += [0, *times.values()]
            in_docs += [0, *map(documents.__getitem__, times)]
        columns = [pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()), pa.array(n, pa.int64()), pa.array(in_docs, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                times, documents = held.setdefault((lang, source), (Counter(), Counter()))
                before = len(times)
                words = text.translate(_UPPER).split()
                times.update(words)
                documents.update(set(words))
                size += len(times) - before
                if size > HELD:
                    yield told(held)
                    held, size = {}, 0
        yield told(held)

    lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang_col, source_col))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.select(lang.alias("lang"), source.alias("source"), text.alias("text")).mapInArrow(count, schema)


def _share(n: str, total: str) -> Column:
    """Share of a term in ``SCALE``, in exact arithmetic."""
    return F.expr(f"cast(1 + (cast({SCALE} as decimal(38,0)) * ({n} + {PRIOR})) div ({total} + {PRIOR} * v) as bigint)")


def kept_terms(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """The groups and the terms that they hold.

    Groups: ``lang, source, total`` (occurrences of kept terms), ``v`` (kept terms of the language), ``lang_total``, ``base`` (share of an absent
    term, 0 if none is kept), and a place ``block, at`` among ``blocks`` of its language's sources. Terms: ``lang, source, term, n, lang_n``.
    """
    parts = term_counts(docs, text_col, lang_col, source_col).withColumn("term", F.col("term").cast("string"))
    by_term = parts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    w = Window.partitionBy("lang", "term")
    rows = by_term.select(
        "lang", "source", "term", "n", F.sum("n").over(w).alias("lang_n"), F.sum("docs").over(w).alias("lang_docs"),
        (F.col("term").isNotNull() & (F.row_number().over(w.orderBy("source")) == 1)).cast("long").alias("head"),
    )
    rows = written(rows.where((F.col("lang_docs") >= min_docs) | F.col("term").isNull()).drop("lang_docs"))
    langs = rows.groupBy("lang").agg(F.sum("head").alias("v"), F.sum("n").alias("lang_total"), F.sum(F.col("term").isNull().cast("long")).alias("sources"))
    groups = rows.groupBy("lang", "source").agg(F.sum("n").alias("total")).join(langs, "lang")
    blocks = F.ceil(F.col("sources") / BLOCK).cast("int")
    groups = groups.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    at = F.row_number().over(Window.partitionBy("lang", "block").orderBy("source")) - 1
    base = F.when(F.col("v") > 0, _share("0", "total")).otherwise(F.lit(0))
    groups = written(groups.withColumns({"at": at, "base": base}).drop("sources"))
    return groups, rows.where("term is not null").drop("head")


def _both(shares: DataFrame) -> DataFrame:
    """``lang, a, i, b, j, part``: corrections for the terms that both of two sources hold, in parts by task, ``a <= b``.

    Every row of a term goes to the pairs of blocks that its source's block is in, so a task sees at most two blocks of a term.
    """
    met = shares.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumns({"a": F.least("block", "other"), "b": F.greatest("block", "other")})
    rows = met.groupBy("lang", "a", "b", "term").agg(F.collect_list(F.struct("block", "at", "p", "base")).alias("has"))
    rows = rows.where(F.size("has") > 1).drop("term")

    def told(sums: dict) -> Iterator[pa.RecordBatch]:
        for (lang, a, b), m in sums.items():
            i, j = np.nonzero(m)
            yield pa.RecordBatch.from_pydict(
                {"lang": pa.array([lang] * len(i), pa.string()), "a": pa.array([a] * len(i), pa.int32()), "i": pa.array(i, pa.int32()),
                 "b": pa.array([b] * len(i), pa.int32()), "j": pa.array(j, pa.int32()), "part": pa.array(m[i, j], pa.int64())}
            )

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            has = batch.column(3)
            edges = has.offsets.to_numpy()
            flat = has.values
            block, at, p, base = (flat.field(k).to_numpy() for k in range(4))
            for r, key in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)))):
                x = np.arange(edges[r], edges[r + 1])
                own, others = (x, x) if key[1] == key[2] else (x[block[x] == key[1]], x[block[x] == key[2]])
                if not len(own) or not len(others):
                    continue
                if key not in sums and len(sums) >= 64:
                    yield from told(sums)
                    sums = {}
                m = sums.get(key)
                need = at[own].max() + 1, at[others].max() + 1
                if m is None or m.shape[0] < need[0] or m.shape[1] < need[1]:
                    grown = np.zeros(np.maximum(need, m.shape if m is not None else (BLOCK, BLOCK)), np.int64)
                    if m is not None:
                        grown[: m.shape[0], : m.shape[1]] = m
                    m = sums[key] = grown
                p1, b1, p2, b2 = p[own, None], base[own, None], p[None, others], base[None, others]
                m[np.ix_(at[own], at[others])] += np.abs(p1 - p2) - np.abs(p1 - b2) - np.abs(b1 - p2) + np.abs(b1 - b2)
        yield from told(sums)

    return rows.mapInArrow(add_up, "lang string, a int, i int, b int, j int, part long")


def _one_sided(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """``lang, a, i, b, j, part``: for each two sources the distance of their baselines and, both ways, the correction for the terms
    of one against the baseline of the other.

    A source's shares are counted by value first; there are at most about the root of twice its occurrences. Each source meets
    its language's others block by block.
    """
    equal = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("c"))
    lists = equal.groupBy("lang", "source").agg(F.array_sort(F.collect_list(F.struct("p", "c"))).alias("counts"))
    each = groups.join(lists, ["lang", "source"], "left").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    each = each.select("lang", "other", "block", "at", "v", "base", F.col("counts.p").alias("p"), F.col("counts.c").alias("c"))
    blocks = groups.groupBy("lang", F.col("block").alias("other")).agg(F.collect_list(F.struct("at", "base")).alias("has"))
    rows = each.join(blocks, ["lang", "other"]).withColumns({"ats": F.col("has.at"), "bases": F.col("has.base")}).drop("has")
    names = rows.columns

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                r = dict(zip(names, r))
                j, b = np.array(r["ats"], np.int64), np.array(r["bases"], np.int64)
                p, c = np.array(r["p"] or [], np.int64), np.array(r["c"] or [], np.int64)
                below = np.searchsorted(p, b)
                n, s = np.append(0, np.cumsum(c)), np.append(0, np.cumsum(p * c))
                apart = np.abs(r["base"] - b)
                mine = s[-1] - s[below] - b * (n[-1] - n[below]) + b * n[below] - s[below] - n[-1] * apart
                use = (j != r["at"]) if r["block"] == r["other"] else np.ones(len(j), bool)
                j, mine, apart = j[use], mine[use], apart[use]
                k = len(j)
                here, there = [r["block"]] * k, [r["other"]] * k
                at = np.full(k, r["at"])
                yield pa.RecordBatch.from_pydict(
                    {"lang": pa.array([r["lang"]] * 2 * k, pa.string()), "a": pa.array(here + there, pa.int32()), "i": pa.array(np.append(at, j), pa.int32()),
                     "b": pa.array(there + here, pa.int32()), "j": pa.array(np.append(j, at), pa.int32()), "part": pa.array(np.append(mine + r["v"] * apart, mine), pa.int64())}
                )

    return rows.mapInArrow(look_up, "lang string, a int, i int, b int, j int, part long")


def pair_distances(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """``lang, source, item, value``: summed difference of the shares of each source and each other source of its language."""
    both = _both(shares)
    off = both.where("a != b or i != j")
    turned = off.where("a != b").select("lang", F.col("b").alias("a"), F.col("j").alias("i"), F.col("a").alias("b"), F.col("i").alias("j"), "part")
    parts = _one_sided(groups, shares).unionByName(off).unionByName(turned)
    sums = parts.groupBy("lang", "a", "i", "b", "j").agg(F.sum("part").alias("value"))
    own = groups.select("lang", "source", F.col("block").alias("a"), F.col("at").alias("i"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("block").alias("b"), F.col("at").alias("j"))
    return sums.join(own, ["lang", "a", "i"]).join(other, ["lang", "b", "j"]).select("lang", "source", "item", "value")


def _cut_at(histogram: DataFrame, group: list[str], digit: Column, need: Column) -> DataFrame:
    """The digit of each group's histogram (``digit, c``) at which the running count reaches ``need``; ``before`` is the count ahead of it."""
    w = Window.partitionBy(*group).orderBy(digit)
    run = histogram.withColumn("upto", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.withColumn("before", F.col("upto") - F.col("c")).where((F.col("upto") >= need) & (F.col("before") < need))


def _in_common(low: bytes, high: bytes) -> int:
    """Leading bytes that two terms share."""
    n = min(len(low), len(high))
    return next((k for k in range(n) if low[k] != high[k]), n)


def highest(rows: DataFrame, group: list[str], item: str = "item", value: str = "value", k: int = TOP) -> DataFrame:
    """The ``k`` rows of each group with the highest ``value``, ties to the smaller item in UTF-8 bytes; all of a group with fewer.

    Values are from 0 to 2^30. An item occurs once in a group. Columns other than group, item and value go.
    """
    rows = written(rows.select(*group, F.col(item).alias("item"), F.col(value).alias("value")))
    high, low = F.floor(F.col("value") / _LOW).cast("int"), (F.col("value") % _LOW).cast("int")
    first = _cut_at(rows.groupBy(*group, high.alias("digit")).agg(F.count("*").alias("c")), group, F.desc("digit"), F.lit(k))
    first = written(first.select(*group, F.col("digit").alias("_high"), (k - F.col("before")).alias("_need")))
    same = rows.join(first, group).where(high == F.col("_high"))
    second = same.groupBy(*group, "_high", "_need", low.alias("digit")).agg(F.count("*").alias("c"))
    second = _cut_at(second, group, F.desc("digit"), F.col("_need"))
    at = written(
        second.select(*group, (F.col("_high") * F.lit(_LOW).cast("long") + F.col("digit")).alias("_at"), (F.col("_need") - F.col("before")).alias("_need"), (F.col("c")).alias("_ties"))
    )
    placed = rows.join(at, group, "left")  # a group without a threshold has fewer than k rows
    chosen = [placed.where("_at is null or value > _at or (value = _at and _ties = _need)").select(*group, "item", "value")]
    ties = written(placed.where("value = _at and _ties > _need").select(*group, "item", "value", "_need"))
    shared = F.udf(_in_common, "int", useArrow=True)
    while not ties.isEmpty():
        ends = ties.groupBy(*group, "_need").agg(F.min("item").cast("binary").alias("_a"), F.max("item").cast("binary").alias("_b"))
        ends = written(ends.select(*group, "_need", shared("_a", "_b").alias("_skip")))
        digit = F.hex(F.substring(F.col("item").cast("binary"), F.col("_skip") + 1, F.lit(2)))
        split = written(ties.drop("_need").join(ends, group).select(*group, "item", "value", "_need", digit.alias("digit")))
        cuts = _cut_at(split.groupBy(*group, "_need", "digit").agg(F.count("*").alias("c")), group, F.asc("digit"), F.col("_need"))
        cuts = written(cuts.select(*group, F.col("digit").alias("_digit"), "before", "upto"))
        placed = split.join(cuts, group)
        done = (F.col("digit") < F.col("_digit")) | ((F.col("digit") == F.col("_digit")) & (F.col("upto") == F.col("_need")))
        chosen.append(placed.where(done).select(*group, "item", "value"))
        rest = placed.where((F.col("digit") == F.col("_digit")) & (F.col("upto") > F.col("_need")))
        ties = written(rest.select(*group, "item", "value", (F.col("_need") - F.col("before")).alias("_need")))
    out = chosen[0]
    for more in chosen[1:]:
        out = out.unionByName(more)
    return out


def audit(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP
) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every (lang, source) that occurs in ``docs``.

    Part ``pair``: distance to each other source of the language. Part ``term``: the ``top`` kept terms that the source has and gives a larger
    share than its language does, by how much. Ranks are by value, descending, ties by the item's UTF-8 bytes. Null text, lang and
    source count as empty; a language without kept terms has distances of 0. Repeated rows count each; other columns are not
    looked at; an empty table gives no rows.
    """
    groups, terms = kept_terms(docs, text_col, lang_col, source_col, min_docs)
    known = groups.select("lang", "source", "total", "v", "lang_total", "base", "blocks", "block", "at")
    shares = terms.join(known, ["lang", "source"]).withColumns({"p": _share("n", "total"), "q": _share("lang_n", "lang_total")})
    above = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    found = highest(above, ["lang", "source"], k=top).withColumn("part", F.lit("term"))
    both = found.unionByName(pair_distances(groups, shares).withColumn("part", F.lit("pair")))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return both.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), rank.alias("rank"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30),
l AS (SELECT g.lang, count(term) AS v, coalesce(sum(lang_n), 0)::BIGINT AS lang_total FROM (SELECT DISTINCT lang FROM d) g LEFT JOIN k ON k.lang = g.lang GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT d.lang, d.source, coalesce(any_value(total), 0)::BIGINT AS total FROM d LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY 1, 2) x ON x.lang = d.lang AND x.source = d.source GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (total + 5 * v) AS p, 1 + (1000000000::HUGEINT * (lang_n + 5)) // (lang_total + 5 * v) AS q
      FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY 1, 2, 3),
terms AS (SELECT lang, source, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM o WHERE part = 'pair' OR rank <= 50
"""
