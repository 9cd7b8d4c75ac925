"""Near-duplicate documents by a chosen-path set similarity join.

Every document becomes the set of the hashes of its word shingles; equal sets are one class, and one document of each
class goes on. In each of ``trees`` independent trees a document walks from the root to the child named by its minwise
token under the tree's hash function. Nodes that hold few documents are compared exhaustively on the full sets; larger
ones branch again, each document into ``BRANCHES`` children, up to ``LEVELS`` levels. What is still large after that is
compared block against block, so no pair of a node is left out. Nodes with the same members in several trees are
compared once. A task holds one node (at most ``NODE_ROWS`` documents) at a time and emits a spanning forest of the links
it confirmed, never the pairs.

Two sets with similarity s share a node of one tree with probability ``s * (1 - (1 - s) ** BRANCHES) ** k`` if their
nodes branch k more times. With eight trees a link at 0.85 is missed about once in four million times when nodes stay
small, and once in 600,000 times after two more levels; a component loses a member only if all its links are missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut
from tidemark.llm.components import components

SHINGLE = 5
TREES, LEVELS, BRANCHES = 8, 4, 2
#: Documents that one task compares exhaustively, and their shingles in all.
NODE_ROWS, NODE_SHINGLES = 2048, 2_000_000

_ROWS = 256
_SLOTS = 1 + BRANCHES * (LEVELS - 1)
_ODD = np.random.RandomState(20).randint(0, 2**63, (2, TREES * _SLOTS + 16), np.int64).astype(np.uint64) | np.uint64(1)


class _WordHashes(dict):
    """64-bit hashes of words, kept for the words seen last."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _sets(texts: list, hashes: _WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, one after the other and sorted within a text, and each text's count."""
    words = [t.encode("utf-8", "surrogatepass").lower().split() if t else [] for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    h = np.fromiter(map(hashes.__getitem__, chain.from_iterable(words)), np.uint64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(words)), sizes)
    rolled = np.zeros(max(len(h) - SHINGLE + 1, 0), np.uint64)
    for k in range(SHINGLE):
        rolled += h[k : k + len(rolled)] * _ODD[0, k]
    inside = doc[: len(rolled)] == doc[SHINGLE - 1 :]
    values, of = [rolled[inside]], [doc[: len(rolled)][inside]]
    ends = np.cumsum(sizes)
    for d in np.flatnonzero((sizes > 0) & (sizes < SHINGLE)):  # the whole sequence is the one shingle
        own = h[ends[d] - sizes[d] : ends[d]]
        values.append(np.array([(own * _ODD[0, 5 + sizes[d] : 5 + 2 * sizes[d]]).sum() ^ _ODD[1, sizes[d]]], np.uint64))
        of.append(np.array([d]))
    value, of_doc = _mixed(np.concatenate(values)), np.concatenate(of)
    order = np.lexsort((value, of_doc))
    value, of_doc = value[order], of_doc[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (of_doc[1:] != of_doc[:-1])
    return value[fresh], np.bincount(of_doc[fresh], minlength=len(words))


def _tokens(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Minwise token of every non-empty set for every slot of every tree."""
    full = counts > 0
    starts = (np.cumsum(counts) - counts)[full]
    out = np.zeros((len(counts), TREES * _SLOTS), np.uint64)
    for k in range(TREES * _SLOTS if len(starts) else 0):
        out[full, k] = np.minimum.reduceat((values ^ _ODD[1, k]) * _ODD[0, k], starts)
    return out


def _pieces(texts: list, most: int = 2_000_000) -> Iterator[slice]:
    """Runs of texts with at most ``most`` characters together (or a single longer one)."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if size and size + n > most:
            yield slice(start, i)
            start, size = i, 0
        size += n
    if start < len(texts):
        yield slice(start, len(texts))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id, _n, _fp, _tokens`` of each row: size and 128-bit fingerprint of its set (null if empty), minwise tokens."""
    schema = T.StructType(
        [
            T.StructField("_id", docs.schema[id_col].dataType),
            T.StructField("_n", T.LongType()),
            T.StructField("_fp", T.BinaryType()),
            T.StructField("_tokens", T.ArrayType(T.LongType())),
        ]
    )

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for piece in _pieces(texts):
                values, counts = _sets(texts[piece], hashes)
                ends = np.cumsum(counts)
                prints = [
                    xxhash.xxh3_128_digest(values[e - n : e].tobytes()) if n else None for e, n in zip(ends, counts)
                ]
                tokens = _tokens(values, counts).view(np.int64)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(tokens.ravel()), tokens.shape[1])
                columns = [
                    batch.column(0).slice(piece.start, len(counts)),
                    pa.array(counts, pa.int64()),
                    pa.array(prints, pa.binary()),
                    lists.cast(pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(sign, schema)


def _full_sets(docs: DataFrame, of_id: T.DataType) -> DataFrame:
    """``_id, _set``: the whole shingle set of each row (columns ``_id, _text``)."""

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for piece in _pieces(texts):
                values, counts = _sets(texts[piece], hashes)
                edges = np.append(0, np.cumsum(counts)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(piece.start, len(counts)), lists], names=["_id", "_set"]
                )

    schema = T.StructType([T.StructField("_id", of_id), T.StructField("_set", T.ArrayType(T.LongType()))])
    return docs.mapInArrow(shingled, schema)


def _leaves(classes: DataFrame) -> DataFrame:
    """``_node, _id``: the members of all nodes that are compared, each set of members once."""
    walk = classes.select(
        "_id",
        "_n",
        F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.slice("_tokens", t * _SLOTS + 1, _SLOTS))).alias("_tree", "_own"),
    ).withColumn("_node", F.xxhash64("_tree", F.get("_own", F.lit(0))))
    small = []
    for level in range(1, LEVELS + 1):
        # written out first, so that adaptive execution can split the join at a node that many documents share
        nodes = cut(walk.groupBy("_node").agg(F.count("*").alias("_rows"), F.sum("_n").alias("_all")).where("_rows > 1"))
        placed = cut(walk.join(nodes, "_node"))
        fits = (F.col("_rows") <= NODE_ROWS) & ((F.col("_all") <= NODE_SHINGLES) | (F.col("_rows") <= 8))
        small.append(placed.where(fits).select("_node", "_id"))
        large = placed.where(~fits)
        if level == LEVELS or large.isEmpty():
            break
        slot = 1 + BRANCHES * (level - 1)
        branch = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BRANCHES - 1)), lambda b: F.xxhash64(F.col("_node"), b, F.get("_own", slot + b))))
        walk = large.select("_id", "_n", "_own", branch.alias("_node"))
    # what no level made small: every block of members meets every other block of its node
    blocks = F.ceil(F.greatest(F.col("_rows") * 2 / NODE_ROWS, F.col("_all") * 2 / NODE_SHINGLES)).cast("int")
    own = F.pmod(F.xxhash64("_id", F.lit(3)), blocks).cast("int")
    met = large.select("_node", "_id", own.alias("_own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_other"))
    pair = F.xxhash64("_node", F.least("_own", "_other"), F.greatest("_own", "_other"))
    small.append(met.select(pair.alias("_node"), "_id"))
    members = small[0]
    for more in small[1:]:
        members = members.unionAll(more)
    same = members.groupBy("_node").agg(F.count("*").alias("_rows"), F.sum(F.xxhash64("_id").cast("decimal(20,0)")).alias("_sum"))
    once = same.groupBy("_rows", "_sum").agg(F.min("_node").alias("_node")).select("_node")
    return members.join(once, "_node")


def _linked(counts: np.ndarray, values: np.ndarray, of: np.ndarray, percent: int) -> np.ndarray:
    """Whether the sets of each pair of rows have 100 * intersection >= percent * union."""
    n = len(counts)
    shared = np.zeros((n, n), np.float32)
    _, code, times = np.unique(values, return_inverse=True, return_counts=True)
    often = times > 1
    column = np.cumsum(often) - 1
    kept = often[code]
    code, row = column[code[kept]], of[kept]
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    width = 1024
    for start in range(0, int(often.sum()), width):
        a, b = np.searchsorted(code, (start, start + width))
        m = np.zeros((n, width), np.float32)
        m[row[a:b], code[a:b] - start] = 1
        shared += m @ m.T
    linked = np.empty((n, n), bool)
    for a in range(0, n, _ROWS):  # by rows, for the memory
        both = np.rint(shared[a : a + _ROWS]).astype(np.int64)
        linked[a : a + _ROWS] = 100 * both >= percent * (counts[a : a + _ROWS, None] + counts[None, :] - both)
    np.fill_diagonal(linked, True)
    return linked


def _links(nodes: DataFrame, of_id: T.DataType, percent: int) -> DataFrame:
    """``a, b``: within each node, every document of a linked group with the group's first."""
    schema = T.StructType([T.StructField("a", of_id), T.StructField("b", of_id)])

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("_id")
        ids = table.column("_id").combine_chunks()
        sets = table.column("_set").combine_chunks()
        counts = sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        values = sets.flatten().to_numpy(zero_copy_only=False)
        linked = _linked(counts, values, np.repeat(np.arange(len(counts)), counts), percent)
        label = np.arange(len(counts))
        while True:
            rows = range(0, len(label), _ROWS)
            new = np.concatenate([np.where(linked[r : r + _ROWS], label[None, :], len(label)).min(axis=1) for r in rows])
            new = new[new]
            if (new == label).all():
                break
            label = new
        a = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": ids.take(pa.array(a)), "b": ids.take(pa.array(label[a]))})

    return nodes.groupBy("_node").applyInArrow(compare, schema)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85
) -> DataFrame:
    """One row for each row of ``docs``: ``_id, n_shingles, component_id``.

    Documents are linked if their sets of five-word shingles (words lower-cased A-Z, split at ASCII white space) have
    100 * intersection >= ``percent`` * union; a text of one to four words has the whole sequence as its shingle, a null,
    empty or blank text has no shingle and no link. ``component_id`` is the smallest id reachable. Rows that repeat an id
    are one document with several texts; rows without an id take no part and have a null component.
    """
    of_id = docs.schema[id_col].dataType
    signed = cut(signatures(docs, id_col, text_col))
    full = signed.where("_fp is not null and _id is not null")
    classes = full.groupBy("_fp").agg(F.min("_id").alias("_id"), F.first("_n").alias("_n"), F.first("_tokens").alias("_tokens"))
    classes = cut(classes)
    leaves = cut(_leaves(classes))
    asked = leaves.select("_id").distinct()
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    held = texts.join(asked, "_id")
    sets = _full_sets(held.select("_id", "_text"), of_id)
    if not full.groupBy("_id").count().where("count > 1").isEmpty():
        sets = sets.distinct()
    links = _links(leaves.join(sets, "_id").select("_node", "_id", "_set"), of_id, percent)
    reached = components(links)
    by_class = classes.join(reached.withColumnRenamed("node", "_id"), "_id", "left")
    by_class = by_class.select("_fp", F.coalesce("component", "_id").alias("_component"))
    out = signed.drop("_tokens").join(by_class, "_fp", "left")
    own = F.when(F.col("_id").isNotNull(), F.coalesce("_component", "_id"))
    return out.select("_id", F.col("_n").alias("n_shingles"), own.alias("component_id"))
