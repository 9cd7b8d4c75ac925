"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component``: every node that has an edge, with the smallest node that it reaches.

    Every round contracts the paths of all components at once, so the number of rounds grows with the logarithm of the
    longest path. Minima are combined before each shuffle, nothing is gathered by node, and every round is written to
    the checkpoint folder. Edges with a null end and loops are left out.
    """
    proper = edges.where(F.col(a) != F.col(b))
    e = cut(proper.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = _state(e)
    while before[0]:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")
        )
        e = cut(small.select("x.u", "x.v").where("u != v").distinct())
        after = _state(e)
        if after == before:
            break
        before = after
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots).distinct()
