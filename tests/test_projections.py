"""Projections: only keys whose source rows changed are built again."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.sources.projections import Projections

SCHEMA = "wallet string, x long"


def test_only_changed_keys_are_built(spark, tmp_path):
    p = Projections(spark, str(tmp_path / "p"))
    built = []

    def build(rows):
        built.append(sorted(r.wallet for r in rows.select("wallet").distinct().collect()))
        return rows.groupBy("wallet").agg(F.sum("x").alias("total"))

    def refresh(version, *data):
        n = p.refresh("totals", version, spark.createDataFrame(list(data), SCHEMA), build)
        return n, {r.wallet: r.total for r in p.read("totals").collect()}

    a, b, c = ("a", 1), ("b", 2), ("c", 3)
    with pytest.raises(ValueError):
        p.read("totals")
    assert refresh(1, a, b, c, (None, 9)) == (3, {"a": 1, "b": 2, "c": 3})
    assert refresh(1, c, b, a) == (0, {"a": 1, "b": 2, "c": 3})  # the order does not matter
    assert refresh(1, a, b, c, ("b", 5)) == (1, {"a": 1, "b": 7, "c": 3})
    assert refresh(1, a, b, c, ("b", 5), ("b", 5)) == (1, {"a": 1, "b": 12, "c": 3})  # a repeated row does
    assert refresh(1, a, b, ("d", 4)) == (3, {"a": 1, "b": 2, "d": 4})  # c is gone
    assert built == [["a", "b", "c"], ["b"], ["b"], ["b", "d"]]
    assert refresh(2, ("a", 10)) == (1, {"a": 10})
    assert p.versions("totals") == [1, 2] and p.read("totals", 1).count() == 3
    assert refresh(2) == (1, {})
    with pytest.raises(ValueError):
        p.read("totals", 3)


def test_a_killed_refresh_runs_again(spark, tmp_path):
    p = Projections(spark, str(tmp_path / "p"))
    df = spark.createDataFrame([("a", 1), ("b", 2)], SCHEMA)
    p.refresh("t", 1, df, lambda rows: rows)
    more = df.union(spark.createDataFrame([("a", 5)], SCHEMA))
    tables, stop = p._tables, [True]

    def broken(name, version):
        rows, marks = tables(name, version)
        if stop[0]:
            marks.rebuild = lambda *a, **k: (_ for _ in ()).throw(OSError("killed"))
        return rows, marks

    p._tables = broken
    with pytest.raises(OSError):
        p.refresh("t", 1, more, lambda rows: rows)
    stop[0] = False
    assert p.refresh("t", 1, more, lambda rows: rows) == 1
    assert sorted((r.wallet, r.x) for r in p.read("t").collect()) == [("a", 1), ("a", 5), ("b", 2)]
