"""First-in-first-out matching of two legs whose waiting lots are also used up by sells and merges.

A buy meets the waiting lots of the other leg and waits with what is left; a sell uses up waiting lots of its own leg, a merge of
whichever leg waits. So at most one leg waits at a time, and the state of a key is one signed quantity: what waits on leg 0, or
less what waits on leg 1. A buy moves it, a sell or merge moves it towards zero on its side only and stops there.

What a stretch of events does to that state is a rising function of straight pieces of slope 0 or 1, and a stretch after
another is one function after the other. So every stretch (the events of a key in one cell of time) is summed up
by itself, the states at the starts of stretches follow from these functions, and each stretch is then walked by itself from
its state. No key's history is in one task. With the states known, lots and what uses them up are intervals of cumulative
quantity, and ``disjoint_matches`` pairs them.

Quantities are whole numbers of millionths, so nothing is rounded on the way.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import ordered as O

UNIT = 1_000_000
#: Seconds in one stretch.
CELL = 86_400


def _through(x: list[int], y: list[int], low: int, high: int, by: int) -> tuple[list[int], list[int]]:
    """The function with knots (x, y), slope 1 outside, followed by s -> s - clip(s, low, high) + by."""
    if low < high:
        for v in (low, high):
            i = bisect_left(y, v)
            if i == len(y) or y[i] != v:
                k = max(i - 1, 0)
                x.insert(i, x[k] + v - y[k])
                y.insert(i, v)
        y = [s - min(max(s, low), high) + by for s in y]
        if len(x) > 2:  # a knot on a straight line says nothing
            keep = [0, *(i for i in range(1, len(x) - 1) if (y[i] - y[i - 1] > 0) != (y[i + 1] - y[i] > 0)), len(x) - 1]
            x, y = [x[i] for i in keep], [y[i] for i in keep]
        return x, y
    return x, [s + by for s in y]


def _value(x: list[int], y: list[int], s: int) -> int:
    """The function with knots (x, y) at ``s``."""
    i = bisect_right(x, s) - 1
    if i < 0:
        return y[0] + s - x[0]
    return y[i] + (s - x[i] if i == len(x) - 1 or y[i + 1] > y[i] else 0)


def _moves(events: DataFrame, cell: int) -> DataFrame:
    """Events as what they do to the state: ``- clip(state, low, high) + by``."""
    q = F.round(F.col("size") * UNIT).cast("long")
    buy, zero = F.col("kind") == "buy", F.lit(0).cast("long")
    leg0 = F.col("leg") == 0
    takes0 = (F.col("kind") == "merge") | (F.col("kind") == "sell") & leg0
    takes1 = (F.col("kind") == "merge") | (F.col("kind") == "sell") & ~leg0
    return events.withColumns(
        {
            "_q": q, "_by": F.when(buy & leg0, q).when(buy, -q).otherwise(zero), "_high": F.when(takes0, q).otherwise(zero),
            "_low": F.when(takes1, -q).otherwise(zero), "_cell": F.floor(F.col("ts") / cell).cast("long"),
        }
    )


def waiting_states(events: DataFrame, keys: list[str], cell: int = CELL) -> DataFrame:
    """``events`` (``kind`` buy, sell or merge, ``leg`` 0 or 1, null for a merge, ``size``, ``ts``, ``id``) with ``state_before`` and ``state``, the
    signed waiting quantity in millionths around each, in the order of (ts, id) within ``keys`` (strings)."""
    run = [*keys, "_cell"]
    moves = _moves(events, cell)
    spec = ", ".join(f"{k} string" for k in keys) + ", _cell long"

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, x, y = None, [0], [0]
        for batch in batches:
            done = []
            for *key, low, high, by in zip(*(batch.column(c).to_pylist() for c in (*run, "_low", "_high", "_by"))):
                if key != at:
                    if at is not None:
                        done.append((*at, x, y))
                    at, x, y = key, [0], [0]
                x, y = _through(x, y, low, high, by)
            yield told(done)
        yield told([(*at, x, y)] if at is not None else [])

    def told(done: list) -> pa.RecordBatch:
        kinds = [pa.string()] * len(keys) + [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], kind) for k, kind in enumerate(kinds)], names=[*run, "_x", "_y"])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, 0
        for batch in batches:
            starts = []
            for *key, x, y in zip(*(batch.column(k).to_pylist() for k in (*keys, "_x", "_y"))):
                if key != at:
                    at, state = key, 0
                starts.append(state)
                state = _value(x, y, state)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in run), pa.array(starts, pa.int64())], names=[*run, "_start"])

    names = [*events.columns, "_q"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = 0
        for batch in batches:
            before, after = [], []
            for start, low, high, by in zip(*(batch.column(c).to_pylist() for c in ("_start", "_low", "_high", "_by"))):
                if start is not None:
                    state = start
                    continue
                before.append(state)
                state += by - min(max(state, low), high)
                after.append(state)
            own = batch.filter(batch.column("_start").is_null())
            around = [pa.array(before, pa.int64()), pa.array(after, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(own.column(c) for c in names), *around], names=[*names, "state_before", "state"])

    placed = moves.repartition(*run).sortWithinPartitions(*run, "ts", "id")
    summed = placed.select(*run, "_low", "_high", "_by").mapInArrow(sum_up, f"{spec}, _x array<long>, _y array<long>")
    starts = summed.repartition(*keys).sortWithinPartitions(*run).mapInArrow(chain, f"{spec}, _start long")
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields) + ", _q long, state_before long, state long"
    # A start is a row ahead of its stretch. Were it joined, Spark would drop the repartition after the join and then read a broadcast
    # join's other side file by file, so stretches would come in pieces.
    rows = moves.withColumn("_start", F.lit(None).cast("long")).unionByName(starts, allowMissingColumns=True)
    met = rows.repartition(*run).sortWithinPartitions(*run, F.col("_start").isNull(), "ts", "id")
    return met.mapInArrow(walk, out)


def consuming_matches(states: DataFrame, keys: list[str], values: tuple[str, ...] = ()) -> DataFrame:
    """Matches of waiting lots (``a_``) and the later buys of the other leg that meet them (``b_``): ``leg`` of the lot, ``matched``
    shares, and ``id`` and ``values`` of both. ``states`` are from ``waiting_states``."""
    side = F.when(F.col("leg") == 0, F.col("state")).otherwise(-F.col("state"))
    lots = states.where("kind = 'buy'").withColumn("_n", F.greatest(F.least(side, F.col("_q")), F.lit(0)))
    own = F.when(F.col("state_before") > 0, 0).when(F.col("state_before") < 0, 1)
    used = F.abs("state_before") - F.when(F.signum("state") == F.signum("state_before"), F.abs("state")).otherwise(F.lit(0))
    taken = states.withColumns({"_leg": own, "_n": used}).where("_n > 0 and (kind != 'buy' or leg != _leg)").drop("leg").withColumnRenamed("_leg", "leg")
    on = [*keys, "leg"]

    def intervals(df: DataFrame) -> DataFrame:
        return df.withColumn("hi", F.sum("_n").over(O.upto(on))).withColumn("lo", F.col("hi") - F.col("_n"))

    met = O.disjoint_matches(intervals(lots), intervals(taken).where("kind = 'buy'"), on, values)
    return met.withColumn("matched", F.col("matched") / UNIT)
