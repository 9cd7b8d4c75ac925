"""First and last quote within a price band and a time window, by as-of lookups in an index of bands.

Prices are whole numbers of ticks. Every quoted price is entered in the bands of 1, 2, 4, ... 2^``SCALES`` ticks that hold it, and a
range of prices is covered by a few such bands that don't overlap (at most two of each width, and as many of the widest as are
needed). In each band the first quote from the window's start on and the last one up to its end are as-of lookups, so the work
follows the asks and the quotes, not the pairs of both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import ordered as O

SCALES = 8


def _band(scale: int, number: Column) -> Column:
    return F.lit(scale).cast("long") * (1 << 48) + number.cast("long")


def bands_of(tick: Column) -> Column:
    """The bands that hold a price, one of each width."""
    return F.array(*(_band(s, F.floor(tick / (1 << s))) for s in range(SCALES + 1)))


def cover(low: Column, high: Column) -> Column:
    """Bands that hold exactly the prices from ``low`` to ``high``, both included; none if there is no such price."""
    parts = []
    for s in range(SCALES + 1):
        left, right = F.ceil(low / (1 << s)), F.floor((high + 1) / (1 << s))
        if s == SCALES:
            rest = F.transform(F.sequence(left, F.greatest(right - 1, left)), lambda n: _band(s, n))
            parts.append(F.when(left < right, rest).otherwise(F.array().cast("array<bigint>")))
            break
        odd_left = F.when((left < right) & (left % 2 != 0), _band(s, left))
        odd_right = F.when((left < right) & (right % 2 != 0), _band(s, right - 1))
        parts.append(F.filter(F.array(odd_left, odd_right), lambda b: b.isNotNull()))
    return F.concat(*parts)


def seen_within(asks: DataFrame, quotes: DataFrame, on: list[str], lookback: int) -> DataFrame:
    """``id, first_seen_ts, last_seen_ts`` of the ``asks`` (``id``, keys, ``ts``, ``low``, ``high``) that some of the ``quotes`` (keys, ``ts``, ``tick``)
    of their key falls to: from ``lookback`` before their time up to it, from low to high. Others give no row."""
    keys = [*on, "_band"]
    q = quotes.select(*on, "ts", F.explode(bands_of(F.col("tick"))).alias("_band")).distinct()
    a = asks.select("id", *on, "ts", F.explode(cover(F.col("low"), F.col("high"))).alias("_band"))
    last = O.asof_backward(a, q, keys, []).where(F.col("asof_ts") >= F.col("ts") - lookback).select("id", F.lit(None).cast("long").alias("f"), F.col("asof_ts").alias("l"))
    first = O.asof_forward(a.withColumn("ts", F.col("ts") - lookback), q, keys, []).where(F.col("asof_ts") <= F.col("ts") + lookback)
    first = first.select("id", F.col("asof_ts").alias("f"), F.lit(None).cast("long").alias("l"))
    return first.unionByName(last).groupBy("id").agg(F.min("f").alias("first_seen_ts"), F.max("l").alias("last_seen_ts"))
