"""Benchmark decontamination by a distributed positional inverted index.

``build_index`` stores the postings of the training texts in segments: one row for a few million characters, holding
for each term the sorted word positions within the segment. Positions run on from one document to the next with a gap
of one, so a phrase never crosses documents. A segment is bounded in size, is written to the shared checkpoint folder
and is searched where it lies; postings are never shuffled.

``find_phrases`` and ``find_near`` look the test texts up in every segment. Terms are taken in the order of their
frequency in the whole corpus, rarest first; each further list is shifted by the term's offset and intersected with
the candidates that are left. Test texts travel to the tasks in blocks of at most ``block_windows`` windows, so what is
broadcast has a fixed bound whatever the size of the test set.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut

_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Words as UTF-8: runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def _segment(texts: list, vocabulary: dict | None) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids, places, bases, sizes, base = [], [], [], [], 0
    terms = vocabulary if vocabulary is not None else {}
    for text in texts:
        words = words_of(text)
        if vocabulary is None:
            for w in words:
                terms.setdefault(w, len(terms))
        of = np.fromiter(map(terms.get, words, repeat(-1)), np.int32, len(words))
        kept = np.flatnonzero(of >= 0).astype(np.int32)
        ids.append(of[kept])
        places.append(kept + base)
        bases.append(base)
        sizes.append(len(words))
        base += len(words) + 1
    of, at = np.concatenate(ids), np.concatenate(places)
    order = np.argsort(of, kind="stable")
    found, starts = np.unique(of[order], return_index=True)
    names = list(terms)
    return [names[i] for i in found], np.append(starts, len(of)), at[order], np.array(bases), np.array(sizes)


def build_index(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: list[bytes] | None = None,
    segment_chars: int = 8_000_000,
) -> DataFrame:
    """Postings of ``docs`` as stored segments: ``segment, terms, counts, positions, ids, bases, sizes``.

    A null text has no words. Every row is a document of its own, also if its id is null or occurs again. The index
    serves any later search; with a ``vocabulary``, for those who want a smaller one, only its terms are kept. ``segment_chars`` bounds a
    segment (a single longer text is a segment of its own). Only the two named columns are read.
    """
    of_id = docs.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField("segment", T.LongType()),
            T.StructField("terms", T.ArrayType(T.BinaryType())),
            T.StructField("counts", T.ArrayType(T.LongType())),
            T.StructField("positions", T.BinaryType()),
            T.StructField("ids", T.ArrayType(of_id)),
            T.StructField("bases", T.ArrayType(T.LongType())),
            T.StructField("sizes", T.ArrayType(T.LongType())),
        ]
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = {w: i for i, w in enumerate(vocabulary)} if vocabulary is not None else None
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            edges = np.cumsum([len(t or "") for t in texts]) // segment_chars
            cuts = [0, *(np.flatnonzero(np.diff(edges)) + 1).tolist(), len(texts)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                names, starts, at, bases, sizes = _segment(texts[a:b], terms)
                columns = [
                    pa.array([number], pa.int64()),
                    pa.array([names], pa.list_(pa.binary())),
                    pa.array([np.diff(starts)], pa.list_(pa.int64())),
                    pa.array([at.astype("<i4").tobytes()], pa.binary()),
                    pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), ids.slice(a, b - a)),
                    pa.array([bases], pa.list_(pa.int64())),
                    pa.array([sizes], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
                number += 1

    return cut(docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(build, schema))


def documents_in(index: DataFrame) -> DataFrame:
    """``segment, ordinal, doc_id, n_words`` of every document in the index."""
    each = index.select("segment", F.posexplode(F.arrays_zip("ids", "sizes")).alias("ordinal", "d"))
    return each.select("segment", "ordinal", F.col("d.ids").alias("doc_id"), F.col("d.sizes").alias("n_words"))


def term_counts(index: DataFrame) -> DataFrame:
    """Occurrences of each term in the whole corpus, pre-aggregated by segment: ``term, n``."""
    each = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t"))
    return each.groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.counts").alias("n"))


class _Queries:
    """A block of test windows: term numbers in order, and for each window its item and the terms' search order."""

    def __init__(self, windows: dict[tuple, set], items: list, frequency: dict[bytes, int]):
        terms = sorted({w for window in windows for w in window})
        number = {w: i for i, w in enumerate(terms)}
        self.terms, self.items = terms, items
        self.windows = [np.array([number[w] for w in window], np.int32) for window in windows]
        self.of_items = [sorted(x) for x in windows.values()]
        rarity = np.array([frequency.get(w, 0) for w in terms] or [0])
        self.order = [np.argsort(rarity[w], kind="stable") for w in self.windows]


def _lists(row: dict, terms: list[bytes]) -> list[np.ndarray | None]:
    at = np.frombuffer(row["positions"], "<i4")
    ends = np.cumsum(row["counts"])
    where = {t: i for i, t in enumerate(row["terms"])}
    out: list[np.ndarray | None] = []
    for t in terms:
        i = where.get(t)
        out.append(None if i is None else at[ends[i] - row["counts"][i] : ends[i]])
    return out


def _member(sought: np.ndarray, among: np.ndarray) -> np.ndarray:
    at = np.searchsorted(among, sought)
    return (at < len(among)) & (among[np.minimum(at, len(among) - 1)] == sought)


def _phrase(window: np.ndarray, order: np.ndarray, lists: list) -> np.ndarray:
    """Start positions of the window: the rarest term's list, then the others shifted to the same start."""
    starts = lists[window[order[0]]] - order[0]
    for k in order[1:]:
        if not len(starts):
            break
        starts = starts[_member(starts + k, lists[window[k]])]
    return starts


def _near(window: np.ndarray, order: np.ndarray, lists: list, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest stretches of at most ``most`` words that hold every term of the window, in any order."""
    own = list(dict.fromkeys(window[order].tolist()))
    anchors, starts = lists[own[0]], []
    for t in own:
        at = lists[t]
        i = np.minimum(np.searchsorted(anchors, at), len(anchors) - 1)
        starts.append(at[(anchors[i] >= at) & (anchors[i] - at < most)])
    start = np.unique(np.concatenate(starts))
    stop = start.copy()
    for t in own:
        i = np.searchsorted(lists[t], start)
        start, stop, i = start[i < len(lists[t])], stop[i < len(lists[t])], i[i < len(lists[t])]
        stop = np.maximum(stop, lists[t][i])
    kept = stop - start < most
    start, stop = start[kept], stop[kept] + 1
    last = np.append(stop[1:] != stop[:-1], True) if len(stop) else np.zeros(0, bool)
    return start[last], stop[last]


def _search(index: DataFrame, block: _Queries, item_type: T.DataType, slop: int | None) -> DataFrame:
    of_id = index.schema["ids"].dataType.elementType
    schema = T.StructType(
        [
            T.StructField("segment", T.LongType()),
            T.StructField("ordinal", T.IntegerType()),
            T.StructField("doc_id", of_id),
            T.StructField("item_id", item_type),
            T.StructField("start", T.LongType()),
            T.StructField("stop", T.LongType()),
        ]
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lists = _lists(row, block.terms)
                bases, out = np.array(row["bases"]), []
                for window, order, items in zip(block.windows, block.order, block.of_items):
                    if any(lists[t] is None for t in window):
                        continue
                    if slop is None:
                        start = _phrase(window, order, lists)
                        stop = start + len(window)
                    else:
                        start, stop = _near(window, order, lists, len(window) + slop)
                    if len(start):
                        doc = np.searchsorted(bases, start, "right") - 1
                        kept = np.searchsorted(bases, stop - 1, "right") - 1 == doc
                        out += [(i, d, a, b) for i in items for d, a, b in zip(doc[kept], start[kept], stop[kept])]
                # overlapping windows of one item in one document become one span
                spans: list[list] = []
                for i, d, a, b in sorted(out):
                    if spans and spans[-1][:2] == [i, d] and a <= spans[-1][3]:
                        spans[-1][3] = max(b, spans[-1][3])
                    else:
                        spans.append([i, d, a, b])
                if spans:
                    of = [d for _, d, _, _ in spans]
                    columns = [
                        [row["segment"]] * len(spans),
                        of,
                        [row["ids"][d] for d in of],
                        [block.items[i] for i, _, _, _ in spans],
                        [int(a - bases[d]) for _, d, a, _ in spans],
                        [int(b - bases[d]) for _, d, _, b in spans],
                    ]
                    fields = pa_schema
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields)

    from pyspark.sql.pandas.types import to_arrow_schema

    pa_schema = to_arrow_schema(schema)
    return index.mapInArrow(search, schema)


def _blocks(tests: DataFrame, id_col: str, text_col: str, window: int, block_windows: int) -> Iterator[tuple[dict, list]]:
    """Windows of the test texts in blocks; the driver holds one block at a time."""
    windows: dict[tuple, set] = {}
    items: list = []
    rows = tests.select(id_col, F.col(text_col).cast("string")).where(F.col(id_col).isNotNull())
    for item, text in rows.toLocalIterator():
        words = words_of(text)
        items.append(item)
        for i in range(max(len(words) - window, 0) + 1) if words else ():
            windows.setdefault(tuple(words[i : i + window]), set()).add(len(items) - 1)
            if len(windows) >= block_windows:
                yield windows, items
                windows, items = {}, [item]
    if windows:
        yield windows, items


def _find(index, tests, id_col, text_col, window, slop, block_windows) -> DataFrame:
    spark, found = index.sparkSession, []
    item_type = tests.schema[id_col].dataType
    counts = term_counts(index)
    for windows, items in _blocks(tests, id_col, text_col, window, block_windows):
        terms = [(bytearray(w),) for w in {w for x in windows for w in x}]
        asked = F.broadcast(spark.createDataFrame(terms, "term binary"))
        frequency = {bytes(r.term): r.n for r in counts.join(asked, "term", "left_semi").collect()}
        found.append(_search(index, _Queries(windows, items, frequency), item_type, slop))
    if not found:
        return _search(index, _Queries({}, [], {}), item_type, slop)
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def find_phrases(
    index: DataFrame,
    tests: DataFrame,
    id_col: str = "item_id",
    text_col: str = "text",
    window: int = 10,
    block_windows: int = 200_000,
) -> DataFrame:
    """Exact occurrences of every run of ``window`` words of the tests: ``segment, ordinal, doc_id, item_id, start, stop``.

    A test of fewer words, but not none, is one window. ``start`` and ``stop`` count words of the document; overlapping
    windows of one item are one span. Tests with a null id or without words find nothing.
    """
    return _find(index, tests, id_col, text_col, window, None, block_windows)


def find_near(
    index: DataFrame,
    tests: DataFrame,
    id_col: str = "item_id",
    text_col: str = "text",
    window: int = 10,
    slop: int = 5,
    block_windows: int = 200_000,
) -> DataFrame:
    """Proximity matches: stretches of at most ``window + slop`` words that hold all words of a window, in any order."""
    return _find(index, tests, id_col, text_col, window, slop, block_windows)


def contamination(
    docs: DataFrame, tests: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each row of ``docs``: ``segment, ordinal, doc_id, n_words, n_hit, items, spans``.

    ``n_hit`` counts the words inside any occurrence, once each; ``items`` are the ids of the tests found, ``spans``
    the occurrences. Null texts have no words; repeated rows are reported each; empty inputs give no rows or no hits.
    The index holds every term of ``docs``, whatever the tests are.
    """
    index = build_index(docs, id_col, text_col)
    spans = find_phrases(index, tests, window=window)
    by_doc = spans.groupBy("segment", "ordinal").agg(
        F.collect_set("item_id").alias("items"),
        F.sort_array(F.collect_list(F.struct("start", "stop", "item_id"))).alias("spans"),
    )
    hit = F.expr(
        "aggregate(spans, named_struct('n', 0L, 'e', 0L), (a, s) -> named_struct("
        "'n', a.n + greatest(0L, s.stop - greatest(a.e, s.start)), 'e', greatest(a.e, s.stop)), a -> a.n)"
    )
    return documents_in(index).join(by_doc.withColumn("n_hit", hit), ["segment", "ordinal"], "left")
