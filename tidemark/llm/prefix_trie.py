"""Prefix trie of conversations: which first turns conversations share, and what sharing them saves.

Every turn becomes a 128-bit digest of its role and text, every conversation the array of its turns' digests. The arrays
are sorted over the whole cluster by range, so conversations that share their first turns stand together. Each task sweeps
its sorted run once with a stack: the common prefix (LCP) with the row before says which open nodes are over, and a node that
is over hands its counts to its parent. Nodes that reach the run's first or last row may go on in the neighbouring run;
those two open stacks are handed on as two rows, and the same sweep over the handed-on rows of up to ``FAN`` neighbouring runs
stitches them together, round after round, until one run is left.

Nothing depends on one conversation fitting into a task: turns are numbered by a range sort too, and an array has at most
``CHUNK`` turns. Longer conversations go on in further arrays, which are sorted under the digest of what stands before
them; those deeper tries are swept first, and their sums enter the trie above at the node where they hang.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut, written

#: Turns in one array, runs that one task stitches, ids in one piece of a list of ids.
CHUNK, FAN, PIECE = 16_384, 256, 50_000
_WIDTH = 16
_NONE = np.iinfo(np.int64).max


def digests(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``_conv, _turn, _tie, _id, _bytes`` of each row with a conversation: digest of role and text and the UTF-8 bytes of the text.

    Null roles and texts are empty. ``_tie`` orders different rows of one turn by role and text (in bytes); texts travel only
    for such rows.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).alias("_conv"), F.col(turn_col).alias("_turn"), role.alias("_role"), text.alias("_text")
    )
    rows = rows.withColumn("_id", F.unhex(F.md5(F.concat_ws(":", F.length("_role").cast("string"), "_role", "_text"))))
    narrow = rows.select("_conv", "_turn", "_id", F.octet_length("_text").cast("long").alias("_bytes"))
    same = ["_conv", "_turn"]
    kinds = narrow.groupBy(*same, "_id").agg(F.count("*").alias("_n"))
    tied = written(kinds.groupBy(*same).agg(F.count("*").alias("_kinds")).where("_kinds > 1").select(*same))
    if tied.isEmpty():
        return narrow.withColumn("_tie", F.lit(0).cast("long"))
    t = tied.select(F.col("_conv").alias("_c"), F.col("_turn").alias("_t"))
    held = rows.join(t, (F.col("_conv") == F.col("_c")) & F.col("_turn").eqNullSafe(F.col("_t")), "left_semi").distinct()
    ranked = numbered(held, same, ["_role", "_text"], "_tie").select(
        F.col("_conv").alias("_c"), F.col("_turn").alias("_t"), F.col("_id").alias("_i"), "_tie"
    )
    on = (F.col("_conv") == F.col("_c")) & F.col("_turn").eqNullSafe(F.col("_t")) & (F.col("_id") == F.col("_i"))
    return narrow.join(ranked, on, "left").select(*narrow.columns, F.coalesce("_tie", F.lit(0).cast("long")).alias("_tie"))


def numbered(rows: DataFrame, group: list[str], order: list[str], out: str = "_pos") -> DataFrame:
    """``rows`` with their place (from 0) within their group by ``order``, nulls first; equal rows in any order.

    Rows are sorted by range, so a group may lie in several tasks. Each counts its own, and what stands in the tasks before
    is added to the first group of each.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("_run", T.IntegerType()), T.StructField("_first", T.BooleanType()), T.StructField(out, T.LongType())])
    keys = [rows.columns.index(g) for g in group]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = TaskContext.get().partitionId()
        last, seen, is_first = None, 0, True
        for batch in batches:
            if not batch.num_rows:
                continue
            places, firsts = [], []
            for key in zip(*(batch.column(k).to_pylist() for k in keys)):
                if key != last:
                    is_first = last is None
                    last, seen = key, 0
                places.append(seen)
                firsts.append(is_first)
                seen += 1
            more = [pa.array([run] * len(places), pa.int32()), pa.array(firsts, pa.bool_()), pa.array(places, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=schema.names)

    by = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    local = written(rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(number, schema))
    key = F.struct(*group)
    edges = local.where(F.col("_first") & (F.col(out) == 0)).select(key.alias("_g")).distinct()
    counts = local.select(key.alias("_g"), "_run").join(edges, "_g", "left_semi").groupBy("_g", "_run").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_g").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1))
    shifts = written(counts.withColumn("_shift", before).where("_shift is not null").select("_g", F.col("_run").alias("_r"), "_shift"))
    done = local.withColumn("_k", key).join(shifts, (F.col("_k") == F.col("_g")) & (F.col("_run") == F.col("_r")), "left")
    return done.withColumn(out, F.col(out) + F.coalesce("_shift", F.lit(0))).select(*rows.columns, out)


class _Node:
    """An open node: what its closed children and the rows that end at it have added up to."""

    __slots__ = ("conv", "n", "children", "leaves", "saved", "bytes", "left", "held", "split", "pending")

    def __init__(self, bytes_: int, left: bool):
        self.conv, self.n, self.children, self.leaves, self.saved = _NONE, 0, 0, 0, 0
        self.bytes, self.left = bytes_, left  # left: on the path of the run's first row
        self.held, self.split = [], False  # ids that end here; whether some of them are written out as pieces
        self.pending = []  # closed children that wait for the smallest member

    def add(self, conv: int, n: int, children: int, leaves: int, saved: int) -> None:
        self.conv = min(self.conv, conv)
        self.n += n
        self.children += children
        self.leaves += leaves
        self.saved += saved


def _common(a: bytes, b: bytes) -> int:
    """Turns that two arrays share from their start."""
    n = min(len(a), len(b)) // _WIDTH
    if a[: n * _WIDTH] == b[: n * _WIDTH]:
        return n
    x, y = (np.frombuffer(k, np.uint64, 2 * n) for k in (a, b))
    return int((x != y).argmax()) // 2


def _identity(above: bytes, key: bytes, depth: int) -> bytes:
    return hashlib.md5(above + key[: depth * _WIDTH]).digest()


_SUMS = ("conv", "n", "children", "leaves", "saved")
_LISTS = T.ArrayType(T.LongType())
_ITEM = T.StructType(
    [T.StructField("run", T.IntegerType()), T.StructField("place", T.IntegerType()), T.StructField("above", T.BinaryType()), T.StructField("key", T.BinaryType()), T.StructField("bytes", _LISTS)]
    + [T.StructField(c, _LISTS) for c in _SUMS]
)
_SWEPT = T.StructType(
    [
        # a node that is over
        T.StructField("depth", T.LongType()),
        *(T.StructField(f"node_{c}", T.LongType()) for c in _SUMS),
        T.StructField("parent", T.LongType()),
        T.StructField("parent_id", T.BinaryType()),
        T.StructField("own_id", T.BinaryType()),
        T.StructField("ends", T.StringType()),
        # ids that end at a node that may go on elsewhere
        T.StructField("seq", T.LongType()),
        T.StructField("ids", T.StringType()),
        # an open stack that is handed on
        *(T.StructField(f"_{f.name}", f.dataType) for f in _ITEM),
    ]
)


class _Sweep:
    """One pass over the sorted rows of a run. ``final``: no neighbours, so everything is over at the end."""

    def __init__(self, run: int, final: bool, stitching: bool, chunk: int):
        self.run, self.final, self.stitching, self.chunk = run, final, stitching, chunk
        self.stack: list[_Node] = []
        self.above, self.key = None, b""
        self.first: tuple | None = None
        self.spine: list[_Node] = []  # the path of the first row
        self.seq = 0
        self.out: list[dict] = []

    def row(self, above: bytes, key: bytes, sizes: list[int], sums: list[tuple], ends: int | None) -> None:
        """The next row: its path, the text bytes of its turns, sums to add by depth (the last ones of the path), and the id
        that ends there."""
        same = -1 if self.above != above else _common(self.key, key)
        self._close(same + 1)
        fresh = self.first is None
        if fresh:
            self.first = (above, key, sizes)
        self.above, self.key = above, key
        for d in range(same + 1, len(key) // _WIDTH + 1):
            self.stack.append(_Node(sizes[d - 1] if d else 0, fresh and not self.final))
        if fresh:
            self.spine = list(self.stack)
        top = len(self.stack) - len(sums)
        for d, s in enumerate(sums):
            self.stack[top + d].add(*s)
        if ends is not None:
            self.stack[-1].held.append(ends)
            if len(self.stack[-1].held) >= PIECE:
                self._flush(self.stack[-1], len(self.stack) - 1)

    def _flush(self, node: _Node, depth: int) -> None:
        """Write the ids held at a node out as a piece; they are hashed with the other pieces of the node afterwards."""
        if node.held:
            self.out.append({"own_id": _identity(self.above, self.key, depth), "seq": (self.run << 40) + self.seq, "ids": ",".join(map(str, node.held))})
            self.seq += 1
            node.held, node.split = [], True

    def _close(self, depth: int) -> None:
        """All open nodes from ``depth`` on are over in this run."""
        while len(self.stack) > depth:
            d = len(self.stack) - 1
            node = self.stack.pop()
            if node.left:  # may have begun in the run before
                self._flush(node, d)
                self._tell(node, d)
                continue
            node.leaves = node.leaves or 1
            node.saved += (node.n - 1) * node.bytes
            known = not self.stitching and not node.split
            if not known:
                self._flush(node, d)
            me = dict(
                depth=d, node_conv=node.conv, node_n=node.n, node_children=node.children, node_leaves=node.leaves, node_saved=node.saved,
                own_id=None if known and d < self.chunk else _identity(self.above, self.key, d),
                ends=hashlib.sha256(",".join(map(str, node.held)).encode()).hexdigest() if known else None,
            )
            self._tell(node, d, node.conv)
            if self.stack:
                parent = self.stack[-1]
                parent.add(node.conv, node.n, 1, node.leaves, node.saved)
                if parent.left:
                    self.out.append(me | {"parent_id": _identity(self.above, self.key, d - 1)})
                else:
                    parent.pending.append(me)
            else:
                self.out.append(me)

    def _tell(self, node: _Node, depth: int, conv: int | None = None) -> None:
        """Let the waiting children of a node go: with its smallest member, or with its name where that is not known yet."""
        if node.pending:
            ref = {"parent": conv} if conv is not None else {"parent_id": _identity(self.above, self.key, depth)}
            self.out.extend(child | ref for child in node.pending)
            node.pending = []

    def finish(self) -> None:
        if self.final:
            self._close(0)
        if self.final or self.first is None:
            return
        above, key, sizes = self.first
        self._hand_on(0, above, key, sizes, self.spine)
        if any(not node.left for node in self.stack):
            for d, node in enumerate(self.stack):
                self._flush(node, d)
                self._tell(node, d)
            mine = [_Node(node.bytes, False) if node.left else node for node in self.stack]
            self._hand_on(1, self.above, self.key, [node.bytes for node in self.stack[1:]], mine)
        else:
            for d, node in enumerate(self.stack):
                self._flush(node, d)

    def _hand_on(self, place: int, above: bytes, key: bytes, sizes: list[int], nodes: list[_Node]) -> None:
        sums = {f"_{c}": [getattr(node, c) for node in nodes] for c in _SUMS}
        self.out.append({"_run": self.run, "_place": place, "_above": above, "_key": key, "_bytes": sizes, **sums})


def _batch(rows: list[dict]) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(_SWEPT)
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def _swept(rows: DataFrame, stitching: bool, final: bool, chunk: int, fan: int) -> DataFrame:
    """One sweep of every run; ``rows`` are conversations, or open stacks that a sweep before handed on."""

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: _Sweep | None = None
        for batch in batches:
            for r in batch.to_pylist():
                run = r["run"] // fan if stitching else TaskContext.get().partitionId()
                if at is None or at.run != run:
                    if at is not None:
                        at.finish()
                        yield _batch(at.out)
                    at = _Sweep(run, final, stitching, chunk)
                if stitching:
                    at.row(r["above"], r["key"], r["bytes"], list(zip(*(r[c] for c in _SUMS))), None)
                else:
                    own = (r["conv"], 1, r["x_children"] or 0, r["x_leaves"] or 0, r["x_saved"] or 0)
                    at.row(r["above"], r["key"], r["bytes"], [own], None if r["more"] else r["conv"])
                if len(at.out) >= 10_000:
                    yield _batch(at.out)
                    at.out = []
        if at is not None:
            at.finish()
            yield _batch(at.out)

    if stitching:
        placed = rows.repartition((F.col("run") / fan).cast("int")).sortWithinPartitions("run", "place")
    else:
        placed = rows.repartitionByRange("above", "key", "conv").sortWithinPartitions("above", "key", "conv")
    return written(placed.mapInArrow(sweep, _SWEPT))


def _hashed(pieces: DataFrame) -> DataFrame:
    """``own_id, sha``: hash of the ids of each node, read piece by piece in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, out = None, None, []
        for batch in batches:
            for own, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if own != at:
                    if at is not None:
                        out.append((at, state.hexdigest()))
                    at, state = own, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([o for o, _ in out], pa.binary()), pa.array([s for _, s in out], pa.string())], names=["own_id", "sha"])
            out = []
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["own_id", "sha"])

    placed = pieces.select("own_id", "ids", "seq").repartition("own_id").sortWithinPartitions("own_id", "seq")
    return placed.mapInArrow(run, "own_id binary, sha string")


def _nodes(rows: DataFrame, chunk: int, fan: int) -> DataFrame:
    """Nodes of the tries of ``above, key, bytes, conv, more, x_children, x_leaves, x_saved``, one trie for each ``above``. Those
    of full arrays have their digest as ``own_id``."""
    swept = [_swept(rows, False, False, chunk, fan)]
    items = [F.col(f"_{f.name}").alias(f.name) for f in _ITEM]
    while True:
        open_ = swept[-1].where("_run is not null").select(*items)
        top = open_.agg(F.max("run")).first()[0]
        if top is None:
            break
        final = top < fan
        swept.append(_swept(open_, True, final, chunk, fan))
        if final:
            break
    every = swept[0]
    for more in swept[1:]:
        every = every.unionByName(more)
    nodes = every.where("depth is not null")
    sums = written(_hashed(every.where("ids is not null")))
    stitched = every.where("depth is not null and own_id is not null")
    over = written(stitched.select(F.col("own_id").alias("parent_id"), F.col("node_conv").alias("_of")))
    nodes = nodes.join(over, "parent_id", "left").join(sums, "own_id", "left")
    ends = F.coalesce("ends", "sha", F.lit(hashlib.sha256().hexdigest()))
    return nodes.select(
        F.col("node_conv").alias("conv_id"), "depth", F.coalesce("parent", "_of").alias("parent_conv_id"), F.col("node_n").alias("n_convs"),
        F.col("node_children").alias("n_children"), F.col("node_leaves").alias("n_leaves"), F.col("node_saved").alias("saved_tokens"),
        ends.alias("ends_sha256"), "own_id",
    )


def trie(turns: DataFrame, ids: DataFrame | None = None, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """One row for each node of the trie of ``_conv, _pos, _id, _bytes``: ``conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256``.

    A node is a distinct sequence of first turns; the root, the empty sequence, is at depth 0. ``conv_id`` is its smallest
    member (conversation that starts with it), ``n_leaves`` and ``saved_tokens`` cover its subtree with itself, and
    ``ends_sha256`` is the SHA-256 of the comma-joined ids, in ascending order, of the members that end there. ``_pos`` counts from 0
    without gaps. ``ids`` (one column) names conversations that may have no turn. Without any conversation there is no node. Conversations
    have integer ids.
    """
    spark = turns.sparkSession
    arrays = turns.groupBy(F.col("_conv").alias("conv"), F.floor(F.col("_pos") / chunk).cast("int").alias("level")).agg(
        F.array_sort(F.collect_list(F.struct("_pos", "_id", "_bytes"))).alias("_t")
    )
    arrays = written(
        arrays.select(
            "conv", "level", F.transform("_t", lambda t: t["_bytes"]).alias("bytes"),
            F.unhex(F.array_join(F.transform("_t", lambda t: F.hex(t["_id"])), "")).alias("key"),
        )
    )
    levels = (arrays.agg(F.max("level")).first()[0] or 0) + 1
    start = arrays.where("level = 0").drop("level").withColumn("above", F.lit(b""))
    if ids is not None:
        every = ids.select(F.col(ids.columns[0]).alias("conv")).where("conv is not null").distinct()
        empty = {"key": F.coalesce("key", F.lit(b"")), "bytes": F.coalesce("bytes", F.array().cast("array<bigint>")), "above": F.lit(b"")}
        start = every.join(start, "conv", "left").withColumns(empty)
    rows = [start]
    for level in range(1, levels):  # a longer conversation's next array hangs at what stands before it
        before = rows[-1].select("conv", F.unhex(F.md5(F.concat("above", "key"))).alias("above"))
        rows.append(written(arrays.where(F.col("level") == level).drop("level").join(before, "conv")))
    below = None
    found = {}
    for level in reversed(range(levels)):
        own = rows[level]
        if level + 1 < levels:
            more = rows[level + 1].select("conv", F.lit(True).alias("more"))
            own = own.join(more, "conv", "left").join(below, "conv", "left")
        else:
            own = own.withColumns({"more": F.lit(False), **{c: F.lit(0).cast("long") for c in ("x_children", "x_leaves", "x_saved")}})
        own = own.withColumn("more", F.coalesce("more", F.lit(False)))
        found[level] = _nodes(own, chunk, fan) if levels == 1 else written(_nodes(own, chunk, fan))
        roots = found[level].where("depth = 0")
        below = roots.select(F.col("conv_id").alias("conv"), F.col("n_children").alias("x_children"), F.col("n_leaves").alias("x_leaves"), F.col("saved_tokens").alias("x_saved"))
    done = found[0].drop("own_id")
    for level in range(1, levels):
        nodes = found[level].where("depth > 0").drop("own_id")
        # the trie above knows the smallest member of the node where a deeper trie hangs, also of those that end there
        hang = found[level].where("depth = 0").select(F.col("conv_id").alias("conv")).join(rows[level].select("conv", "above"), "conv")
        at = found[level - 1].where(F.col("depth") == chunk).select(F.col("own_id").alias("above"), F.col("conv_id").alias("_top"))
        tops = hang.join(at, "above").select(F.col("conv").alias("parent_conv_id"), F.lit(1).cast("long").alias("depth"), "_top")
        nodes = nodes.join(tops, ["parent_conv_id", "depth"], "left").withColumn("parent_conv_id", F.coalesce("_top", "parent_conv_id")).drop("_top")
        done = done.unionByName(nodes.withColumn("depth", F.col("depth") + level * chunk))
    return done


def prefix_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie of whole conversations, as in ``trie``.

    Turns stand in the order of ``turn_col``, nulls first, and rows of one turn by role and text; a repeated row is a repeated
    turn. Null roles and texts are empty. Rows without a conversation take no part, other columns are not looked at.
    """
    rows = digests(turns, conv_col, turn_col, role_col, text_col)
    return trie(numbered(rows, ["_conv"], ["_turn", "_tie"]))


def rebuilt(turns: DataFrame, conv_col: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are those of another one, and the ids of all: conversation c begins with the first h turns of
    c - c % 5 and goes on with its own after its first h, with h = crc32(decimal c) % 9."""
    rows = written(numbered(digests(turns, conv_col), ["_conv"], ["_turn", "_tie"]).select("_conv", "_pos", "_id", "_bytes"))
    ids = cut(turns.select(F.col(conv_col).cast("long").alias("_conv")).where("_conv is not null").distinct())
    h = F.crc32(F.col("_conv").cast("string").cast("binary")) % 9
    own = rows.where(F.col("_pos") >= h).withColumn("_from", F.lit(1))
    asked = ids.select(F.col("_conv").alias("_c"), (F.col("_conv") - F.col("_conv") % 5).alias("_base"), h.alias("_h"))
    heads = rows.where("_pos < 8").join(asked, F.col("_conv") == F.col("_base")).where("_pos < _h")
    heads = heads.select(F.col("_c").alias("_conv"), "_pos", "_id", "_bytes", F.lit(0).alias("_from"))
    both = own.unionByName(heads).withColumnRenamed("_pos", "_old")
    return numbered(both, ["_conv"], ["_from", "_old"]).select("_conv", "_pos", "_id", "_bytes"), ids


ORACLE = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
bits AS (SELECT i, i AS v FROM range(256) r(i)),
b1 AS (SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END AS v FROM (SELECT i, v::BIGINT AS v FROM bits)),
b2 AS (SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END AS v FROM b1),
b3 AS (SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END AS v FROM b2),
b4 AS (SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END AS v FROM b3),
b5 AS (SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END AS v FROM b4),
b6 AS (SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END AS v FROM b5),
b7 AS (SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END AS v FROM b6),
b8 AS (SELECT list(CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END ORDER BY i) AS tab FROM b7),
c AS (SELECT DISTINCT conv_id FROM t),
h AS (SELECT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295) % 9 AS h FROM c, b8),
u AS (SELECT h.conv_id, 0 AS f, pos, role, text FROM h JOIN t ON t.conv_id = h.base AND t.pos < h.h
      UNION ALL SELECT t.conv_id, 1, pos, role, text FROM t JOIN h ON t.conv_id = h.conv_id AND t.pos >= h.h),
p AS (SELECT conv_id, row_number() OVER w AS depth, string_agg(md5(length(role) || ':' || role || ':' || text), '') OVER w AS path, strlen(text) AS bytes FROM u WINDOW w AS (PARTITION BY conv_id ORDER BY f, pos)),
e AS (SELECT conv_id, depth, path, bytes FROM p UNION ALL SELECT conv_id, 0, '', 0 FROM c),
l AS (SELECT conv_id, max(depth) AS len FROM e GROUP BY 1),
n AS (SELECT depth, path, min(e.conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saved,
             coalesce(string_agg(e.conv_id::VARCHAR, ',' ORDER BY e.conv_id) FILTER (len = depth), '') AS ends FROM e JOIN l USING (conv_id) GROUP BY 1, 2),
k AS (SELECT depth - 1 AS depth, substr(path, 1, 32 * (depth - 1)::INT) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (depth, path)),
a AS (SELECT substr(path, 1, 32 * d::INT) AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens
      FROM (SELECT *, unnest(generate_series(0, depth)) AS d FROM m) GROUP BY 1)
SELECT m.conv_id, m.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children::BIGINT AS n_children, n_leaves, saved_tokens, sha256(m.ends) AS ends_sha256
FROM m JOIN a USING (path) LEFT JOIN n q ON m.depth > 0 AND q.depth = m.depth - 1 AND q.path = substr(m.path, 1, 32 * (m.depth - 1)::INT)
"""
