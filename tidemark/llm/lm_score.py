"""Stupid-backoff scores of documents under the n-gram counts of the whole corpus.

Documents are dealt to segments of a few million characters. The distinct n-grams of a segment, with their counts in it,
travel to hash partitions as one row for each segment and partition; there they are exploded to n-gram rows, whose
counts over all segments are the count table; those that several segments have are joined back to their rows. The counts go
back to the segments that asked, where all others occur as often as in the segment, and the scores of the words are summed for each document. An n-gram crosses once for a segment however
often it occurs there, so a very common one is no hot key. Partitions grow with the corpus; they are gone through in a few
rounds, so that only a part of the n-grams is on disk at a time.

N-grams are named by 64 bits of hash. Counts leave out the document that is scored, so a text is never its own evidence.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import written

#: Distinct n-grams of all segments that a hash partition holds, about.
PARTITION_GRAMS = 500_000
#: Rows with the same id and text that may lie in one segment.
SAME_ROWS = 1000
#: Rounds in which the n-grams are counted; the shuffled n-grams of one are on disk at a time.
ROUNDS = 2
#: Spark's setting by which a query's shuffle files are removed when it ends.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting for the groups up to which a task collects lists without sorting all its rows once more; the default of 128 is
#: passed as soon as there are 128 segments. A task's rows are bounded by ``PARTITION_GRAMS``, its empty lists by ``LISTS``.
UNSORTED = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
LISTS = 50_000
#: Bytes up to which words are hashed together.
LONG_WORD = 64
#: Masks of the first 0 to 8 bytes of a little-endian number.
_FIRST = np.array([256**k - 1 for k in range(9)], np.uint64)
_ODD = np.random.RandomState(9).randint(0, 2**63, 16, np.int64).astype(np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts, one after the other, and how many each text has."""
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    real = pc.greater(pc.binary_length(trimmed), 0)  # an empty text would give an empty word
    parts = pc.ascii_split_whitespace(trimmed.filter(real))
    sizes = np.zeros(len(texts), np.int64)
    sizes[real.to_numpy(zero_copy_only=False)] = pc.list_value_length(parts).to_numpy()
    return parts.flatten(), sizes


def _hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, and how many words each text has.

    Words of up to ``LONG_WORD`` bytes are hashed together, eight bytes at a time; each step is one to one, so different words of
    one length of up to eight bytes never clash.
    """
    words, sizes = _words(texts)
    if not len(words):
        return np.zeros(0, np.uint64), sizes
    _, offsets, data = words.buffers()
    edges = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(words.type) else np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    padded = np.append(np.frombuffer(data, np.uint8), np.zeros(8, np.uint8))
    eights = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    start, size = edges[:-1], np.diff(edges)
    out = _mixed((eights[start] & _FIRST[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * _ODD[7]))
    more = np.flatnonzero((size > 8) & (size <= LONG_WORD))
    for k in range(8, LONG_WORD, 8):
        more = more[size[more] > k]
        out[more] = _mixed(out[more] ^ (eights[start[more] + k] & _FIRST[np.minimum(size[more] - k, 8)]))
    for k in np.flatnonzero(size > LONG_WORD):
        out[k] = xxhash.xxh3_64_intdigest(padded[edges[k] : edges[k + 1]])
    return out, sizes


def _grams(texts: pa.ChunkedArray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the n-grams that end at each word (a row for each order, 0 where there is none), each word's document
    and its place in it."""
    hashed = [_hashes(chunk) for chunk in texts.chunks]
    h = np.concatenate([np.zeros(0, np.uint64), *(x for x, _ in hashed)])
    sizes = np.concatenate([np.zeros(0, np.int64), *(n for _, n in hashed)])
    total = len(h)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.zeros((order, total), np.uint64)
    run = np.zeros(total, np.uint64)
    for n in range(order):
        run[n:] += h[: total - n] * _ODD[n]
        out[n] = np.where(place >= n, np.maximum(_mixed(run + _ODD[8 + n]), np.uint64(1)), np.uint64(0))
    return out, doc, place


def _sizes(docs: DataFrame) -> tuple[int, int, int]:
    """Characters and words of all texts, and the most rows that have the same id and text, in one reading."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chars = pc.fill_null(pc.utf8_length(b.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), chars, pa.array(_words(b.column(1))[1], pa.int64())], names=["_h", "chars", "words"])

    rows = docs.select(F.xxhash64("_id", "_text").alias("_h"), "_text").mapInArrow(count, "_h long, chars long, words long")
    alike = rows.groupBy("_h").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.sum("words").alias("words"))
    row = alike.agg(F.sum("chars"), F.sum("words"), F.max("n")).first()
    return row[0] or 0, row[1] or 0, row[2] or 0


def _part(names: np.ndarray, partitions: int) -> np.ndarray:
    """Hash partitions of n-grams: ranges of names, so sorted names are in the order of the partitions."""
    return ((names >> np.uint64(32)) * np.uint64(partitions) >> np.uint64(32)).astype(np.int64)


def _least(parts: range, partitions: int) -> np.ndarray:
    """The smallest name of each hash partition of ``parts``."""
    return ((np.arange(parts.start, parts.stop, dtype=np.uint64) << np.uint64(32)) + np.uint64(partitions - 1)) // np.uint64(partitions) << np.uint64(32)


def _order(names: np.ndarray) -> np.ndarray:
    """``np.argsort(names, kind="stable")``, faster: high bits of a name and its place are sorted as one number."""
    bits = np.uint64(max(1, len(names)).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    order = (np.sort((names & ~low) | np.arange(len(names), dtype=np.uint64)) & low).astype(np.int64)
    found = names[order]
    if (found[1:] < found[:-1]).any():  # names that differ in the low bits only
        return np.argsort(names, kind="stable")
    return order


def _asked(dealt: DataFrame, order: int, partitions: int, within: range) -> DataFrame:
    """``_segment, _part, _grams, _n``: each segment's distinct n-grams in order and their counts, by hash partition, of
    the hash partitions ``within``."""

    def ask(table: pa.Table) -> pa.Table:
        grams = _grams(table.column("_text"), order)[0].ravel()
        least = _least(within, partitions)
        real = grams >= max(least[0], np.uint64(1))
        if within.stop < partitions:
            real &= grams < _least(range(within.stop, within.stop + 1), partitions)[0]
        names, counts = np.unique(grams[real], return_counts=True)
        starts = np.append(np.searchsorted(names, least), len(names))
        full = np.flatnonzero(starts[1:] > starts[:-1])
        part, edges = full + within.start, pa.array(np.append(starts[full], len(names)).astype(np.int32))
        return pa.table(
            {
                "_segment": pa.array([table.column("_segment")[0].as_py()] * len(part), pa.int32()),
                "_part": pa.array(part.astype(np.int32)),
                "_grams": pa.ListArray.from_arrays(edges, pa.array(names.view(np.int64))),
                "_n": pa.ListArray.from_arrays(edges, pa.array(counts.astype(np.int32))),
            }
        )

    return dealt.groupBy("_segment").applyInArrow(ask, "_segment int, _part int, _grams array<long>, _n array<int>")


def exploded(asked: DataFrame, partitions: int) -> DataFrame:
    """``_part, _segment, _k, _gram, _n``: one row for each n-gram of each segment, dealt by hash partition."""
    placed = asked.repartition(partitions, "_part")
    each = placed.select("_part", "_segment", "_n", F.posexplode("_grams").alias("_k", "_gram"))
    return each.select("_part", "_segment", "_k", "_gram", F.get("_n", "_k").alias("_n"))


def _answers(grams: DataFrame) -> DataFrame:
    """``_segment, _part, _ks, _totals``: place and count of each n-gram of a segment that other segments have too.

    An n-gram's rows of all segments lie in one hash partition, so its entry of the count table is made and joined back
    to them by one window there; neither side is shuffled again.
    """
    total = F.sum("_n").over(Window.partitionBy("_gram", "_part"))
    shared = grams.withColumn("_total", total).where(F.col("_total") > F.col("_n"))
    lists = F.collect_list("_k").alias("_ks"), F.collect_list("_total").alias("_totals")  # of the same rows in the same order
    return shared.groupBy("_segment", "_part").agg(*lists)


def _in_rounds(dealt: DataFrame, order: int, partitions: int) -> DataFrame:
    """The answers for all n-grams, found in ``ROUNDS`` rounds, each for a range of the hash partitions.

    Only the answers of a round are written out; its n-gram rows leave the executors' disks when it ends.
    """
    conf, out, during = dealt.sparkSession.conf, [], {FREED: "true", UNSORTED: str(LISTS)}
    before = {name: conf.get(name, None) for name in during}
    try:
        for name, value in during.items():
            conf.set(name, value)
        for k in range(ROUNDS):
            within = range(partitions * k // ROUNDS, partitions * (k + 1) // ROUNDS)
            if within:
                out.append(written(_answers(exploded(_asked(dealt, order, partitions, within), len(within))), "zstd"))
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)
    return reduce(DataFrame.unionAll, out)


def score(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = 3,
    backoff: float = 0.4,
    segment_chars: int = 4_000_000,
) -> DataFrame:
    """``_id, n_words, n_unseen, log_score`` of each row: words, words seen nowhere else, and the summed natural log.

    A word has the relative frequency of the longest n-gram (up to ``order``) ending there that occurs in another
    document, times ``backoff`` for every order given up; a word seen nowhere else counts as ``backoff`` occurrences among
    all words of the others. Words are lower-cased A-Z and split at ASCII white space. Null and empty texts have no words
    and a log score of 0. Rows are scored each by itself, also if their id is null or repeated; a text that occurs twice
    is evidence for its copy. Segments are dealt by id and text, so copies of a text spread over them; rows with equal ids and
    texts are spread too where there are more than ``SAME_ROWS``.
    """
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    chars, corpus, alike = _sizes(own)
    segments = max(1, math.ceil(chars / segment_chars))
    partitions = max(1, math.ceil(chars * order / 6 / PARTITION_GRAMS))
    # rows are read twice, so their segment must not depend on how a scan is cut: it is that of their content; only where very many
    # rows have the same id and text are they numbered, and then written out with their segments
    spread = segments > 1 and alike > SAME_ROWS
    place = F.xxhash64("_id", "_text", F.monotonically_increasing_id()) if spread else F.xxhash64("_id", "_text")
    dealt = own.withColumn("_segment", F.pmod(place, F.lit(segments)).cast("int"))
    dealt = written(dealt) if spread else dealt
    schema = T.StructType(
        [
            T.StructField("_id", docs.schema[id_col].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_unseen", T.LongType()),
            T.StructField("log_score", T.DoubleType()),
        ]
    )

    def sum_up(table: pa.Table, answer: pa.Table) -> pa.Table:
        grams, doc, place = _grams(table.column("_text"), order)
        sizes = np.bincount(doc, minlength=len(table))
        total = np.zeros(len(doc))
        unseen = np.zeros(len(doc), bool)
        if len(doc):
            # equal n-grams stand together, in the order in which they were asked for, and within them those of each document
            real = _order(grams.ravel())[grams.size - np.count_nonzero(grams) :]
            name, owner = grams.ravel()[real], np.tile(doc.astype(np.int32), order)[real]
            fresh = np.append(True, name[1:] != name[:-1])
            mine = np.diff(np.append(np.flatnonzero(fresh | np.append(True, owner[1:] != owner[:-1])), len(name)))
            # what no other segment has occurs as often as it does here
            first = np.flatnonzero(fresh)
            times, parts = np.diff(np.append(first, len(name))), _part(name[first], partitions)
            totals = times.copy()
            for batch in answer.to_batches():
                ks, found = (batch.column(c).flatten().to_numpy() for c in ("_ks", "_totals"))
                at = np.repeat(np.searchsorted(parts, batch.column("_part").to_numpy()), pc.list_value_length(batch.column("_ks")).to_numpy()) + ks
                if (at >= len(totals)).any() or (found <= times[at]).any():
                    raise ValueError("the answers are not those of this segment's n-grams")
                totals[at] = found
            seen = np.zeros(grams.size)
            seen[real] = np.repeat(totals, times) - np.repeat(mine, mine)
            seen = seen.reshape(grams.shape)
            logs = np.log(np.maximum(seen, 1))
            others = np.log(np.maximum(corpus - sizes, 1))[doc]
            top = np.minimum(place + 1, order)
            total = top * math.log(backoff) - others
            unseen = seen[0] <= 0
            for n in range(order):
                use, below = seen[n] > 0, others
                if n:  # the context is the shorter n-gram that ends one word before
                    use[1:] &= seen[n - 1][:-1] > 0  # a context that only a clash of names could have left out
                    below = np.append(0.0, logs[n - 1][:-1])
                total = np.where(use, logs[n] - below + (top - n - 1) * math.log(backoff), total)
        return pa.table(
            {
                "_id": table.column("_id"),
                "n_words": pa.array(sizes, pa.int64()),
                "n_unseen": pa.array(np.bincount(doc, unseen, len(table)).astype(np.int64)),
                "log_score": pa.array(np.bincount(doc, total, len(table))),
            }
        )

    answers = _in_rounds(dealt, order, partitions)
    return dealt.groupBy("_segment").cogroup(answers.groupBy("_segment")).applyInArrow(sum_up, schema)


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
t AS (SELECT r, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM d),
g AS (SELECT r, i, w AS g1, CASE WHEN i > 1 THEN lag(w) OVER o || ' ' || w END AS g2,
             CASE WHEN i > 2 THEN lag(w, 2) OVER o || ' ' || lag(w) OVER o || ' ' || w END AS g3 FROM t WINDOW o AS (PARTITION BY r ORDER BY i)),
c AS (SELECT *, count(*) OVER (PARTITION BY g1) - count(*) OVER (PARTITION BY r, g1) AS c1,
             CASE WHEN g2 IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY g2) - count(*) OVER (PARTITION BY r, g2) END AS c2,
             CASE WHEN g3 IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY g3) - count(*) OVER (PARTITION BY r, g3) END AS c3,
             count(*) OVER () - count(*) OVER (PARTITION BY r) AS n FROM g),
x AS (SELECT *, lag(c1) OVER o AS b1, lag(c2) OVER o AS b2, least(i, 3) AS m FROM c WINDOW o AS (PARTITION BY r ORDER BY i)),
s AS (SELECT r, count(*) AS n_words, count(*) FILTER (c1 = 0) AS n_unseen,
             sum(CASE WHEN c3 > 0 THEN ln(c3) - ln(b2) WHEN c2 > 0 THEN ln(c2) - ln(b1) + (m - 2) * ln(0.4)
                      WHEN c1 > 0 THEN ln(c1) - ln(greatest(n, 1)) + (m - 1) * ln(0.4) ELSE m * ln(0.4) - ln(greatest(n, 1)) END) AS log_score FROM x GROUP BY r)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_unseen, 0)::BIGINT AS n_unseen,
       round(coalesce(log_score / n_words, 0), 6) AS mean_log_score
FROM d LEFT JOIN s USING (r)
"""
