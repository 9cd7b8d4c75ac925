"""Grouped summaries and the refresh rule by hand."""

from __future__ import annotations

from tidemark.plans import summaries as S


def test_refresh_rule(spark):
    events = spark.createDataFrame([(c,) for c in ("A", "a", "b", "c", "d", "e", "", None)], "condition_id string")
    markets = spark.createDataFrame([("a", True, 1.0), ("b", None, None), ("c", True, None), ("d", True, 0.0), ("x", False, None)], "condition_id string, closed boolean, price0 double")
    tokens = spark.createDataFrame([("A",), ("b",), ("b",), ("c",), ("e",)], "condition_id string")
    got = sorted(tuple(r) for r in S.to_refresh(events, markets, tokens).collect())
    assert got == [("b", "open"), ("c", "unresolved"), ("d", "no_tokens"), ("e", "missing")]
    assert S.to_refresh(events.limit(0), markets, tokens).count() == 0


def test_summary_with_and_without_books(spark):
    rows = [("w", 0.4, 0.5, 10.0, 1.0, True), ("w", 0.6, None, 30.0, None, False), ("v", 0.2, None, 0.0, None, False)]
    d = spark.createDataFrame([(k, p, m, s, p * s, e, x) for k, p, m, s, e, x in rows], "k string, price double, mid double, size double, notional double, edge double, strict boolean")
    by = {r.k: r for r in S.summary(d, "k").collect()}
    w, v = by["w"], by["v"]
    assert (w.fills, w.notional, w.estimated_edge, w.edge_bps, w.avg_edge_per_fill) == (2, 22.0, 1.0, 454.55, 0.5)
    assert (w.avg_fill_price, w.weighted_fill_price, w.avg_mid_before, w.positive_edge_share, w.strict_context_share) == (0.5, 0.55, 0.5, 50.0, 50.0)
    assert (v.estimated_edge, v.edge_bps, v.weighted_fill_price, v.positive_edge_share) == (None, None, None, 0.0)
