"""Nearest neighbours by vantage-point trees, one for each shard of the vectors.

Vectors are dealt by a hash to shards of about ``shard_rows``, each vector to one; queries travel to every shard. A shard's
vectors come first, become its tree once, and the queries stream through it in blocks of at most ``block_rows``, so a task
holds one shard and one block whatever the size of the table. The tree halves its points by their distance to a vantage
point until ``leaf_rows`` are left, and all queries of a block walk it together.
A subtree whose distances to the vantage point lie in [low, high] holds nothing nearer to the query than
max(d - high, low - d); it is left out if ``factor`` times this bound exceeds the query's k-th distance so far. Factor one
is exact; a larger factor leaves out more and may lose neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a and b in double precision, summed in the order of the components."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        d = a[:, j, None] - b[None, :, j]
        out += d * d
    return np.sqrt(out)


class Tree:
    """Vantage-point tree; children are ranges of ``order``, nodes are (start, stop, vantage, inner child, outer child)."""

    def __init__(self, x: np.ndarray, leaf_rows: int):
        self.x, self.nodes, self.order = x, [], np.arange(len(x))
        self._build(0, len(x), leaf_rows)

    def _build(self, start: int, stop: int, leaf_rows: int) -> int:
        me = len(self.nodes)
        self.nodes.append([start, stop, -1, None, None])
        if stop - start > leaf_rows:
            own = self.order[start:stop]
            # the point farthest from the first is a vantage point that tells the others apart
            vantage = own[np.argmax(((self.x[own] - self.x[own[0]]) ** 2).sum(1))]
            d = np.sqrt(((self.x[own] - self.x[vantage]) ** 2).sum(1))
            half = len(own) // 2
            split = np.argpartition(d, half)
            self.order[start:stop], d = own[split], d[split]
            # bounds are widened by what rounding can move a distance
            self.nodes[me][2:] = [
                int(vantage),
                (self._build(start, start + half, leaf_rows), d[:half].min() * (1 - 1e-9), d[:half].max() * (1 + 1e-9)),
                (self._build(start + half, stop, leaf_rows), d[half:].min() * (1 - 1e-9), d[half:].max() * (1 + 1e-9)),
            ]
        return me

    def nearest(self, q: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Distances and ids of the k nearest of each query, nearest first; rows with the query's own id don't count."""
        best = np.full((len(q), k), np.inf)
        found = np.full((len(q), k), np.iinfo(np.int64).max)

        def leaf(rows: np.ndarray, start: int, stop: int) -> None:
            at = self.order[start:stop]
            d = distances(q[rows], self.x[at])
            d[own[rows][:, None] == ids[at][None, :]] = np.inf
            d = np.concatenate([best[rows], d], 1)
            i = np.concatenate([found[rows], np.broadcast_to(ids[at], (len(rows), len(at)))], 1)
            kept = np.lexsort((i, d), axis=1)[:, :k]
            best[rows], found[rows] = np.take_along_axis(d, kept, 1), np.take_along_axis(i, kept, 1)

        def visit(node: int, rows: np.ndarray) -> None:
            start, stop, vantage, inner, outer = self.nodes[node]
            if vantage < 0:
                leaf(rows, start, stop)
                return
            d = np.sqrt(((q[rows] - self.x[vantage]) ** 2).sum(1))
            near = np.abs(d - inner[2]) <= np.abs(d - outer[1])
            near |= d < inner[2]
            for (child, low, high), first in ((inner, near), (outer, ~near), (inner, ~near), (outer, near)):
                bound = np.maximum(np.maximum(d - high, low - d), 0) * factor
                go = first & (bound <= best[rows, k - 1] * (1 + 1e-9))
                if go.any():
                    visit(child, rows[go])

        if len(q) and len(self.x):
            visit(0, np.arange(len(q)))
        return best, found


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    own = vectors.select(F.col(id_col).cast("long").alias("_id"), v.alias("_v"))
    return own.where(F.col("_id").isNotNull() & finite & F.exists("_v", lambda e: e != 0)).distinct()


def nearest_neighbours(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    factor: float = 1.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard_rows: int = 16_384,
    block_rows: int = 2048,
    leaf_rows: int = 256,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest rows of ``vectors`` for each row of ``queries``.

    Nearness is the Euclidean distance, ties go to the smaller id, a query's own id does not count; with fewer
    candidates all are returned. Vectors that are null, zero, or hold a null or non-finite component take no part, nor do
    rows without an id; rows repeated in full count once, and vectors meet only vectors of their own length.
    """
    points, asked = _usable(vectors, id_col, vector_col), _usable(queries, id_col, vector_col)
    shards = max(1, math.ceil(vectors.count() / shard_rows))
    width = F.size("_v").alias("_width")
    shard = F.pmod(F.xxhash64("_id", "_v"), F.lit(shards)).cast("int")
    dealt = points.select(width, shard.alias("_shard"), F.lit(0).alias("_asks"), "_id", "_v")
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    sent = asked.select(width, every.alias("_shard"), F.lit(1).alias("_asks"), "_id", "_v")
    schema = T.StructType(
        [
            T.StructField("query_id", T.LongType()),
            T.StructField("vec_id", T.LongType()),
            T.StructField("score", T.DoubleType()),
        ]
    )

    def matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        ids = batch.column("_id").to_numpy()
        return ids, batch.column("_v").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        tree = ids = None
        asked = False
        for batch in batches:
            asks = batch.column("_asks").to_numpy()
            split = int((asks == 0).sum())
            if asked and split or asks[:split].any():
                raise ValueError("a vector came after a query of its shard, so the query may have missed it")
            asked = split < len(asks)
            if split:
                parts.append(matrix(batch.slice(0, split)))
            for start in range(split, len(batch), block_rows):
                if not parts and tree is None:
                    break
                if tree is None:
                    ids = np.concatenate([i for i, _ in parts])
                    tree, parts = Tree(np.concatenate([v for _, v in parts]), leaf_rows), []
                own, q = matrix(batch.slice(start, block_rows))
                best, found = tree.nearest(q, own, ids, k, factor)
                real = np.isfinite(best)
                columns = [np.repeat(own, real.sum(1)), found[real], best[real]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=schema.names)

    # the rows of a shard are sorted, so that its vectors are there before the queries; the grouping keeps that order
    key = ["_width", "_shard"]
    both = dealt.unionByName(sent).repartition(*key).sortWithinPartitions(*key, "_asks")
    found = both.groupBy(*key).applyInArrow(search, schema)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
