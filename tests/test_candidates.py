"""Rule candidates: triggers by hand and the product-limit estimate against its definition."""

from __future__ import annotations

import random
import time
from statistics import median

import pytest
from pyspark.sql import functions as F

from tidemark.plans import candidates


def test_product_limit_by_definition(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.randrange(1, 30), rng.random() < 0.6) for _ in range(200)] + [("all", 5, True), ("all", 5, True), ("none", 5, False)]
    got = candidates.outlasting(spark.createDataFrame(rows, "k string, duration_s long, ended boolean"), ["k"]).collect()
    want = {}
    for k in ("a", "b", "all", "none"):
        s = 1.0
        for t in sorted({d for key, d, e in rows if key == k and e}):
            n = sum(key == k and d >= t for key, d, _ in rows)
            s *= 1 - sum(key == k and d == t and e for key, d, e in rows) / n
            want[k, t] = (n, s)
    assert {(r.k, r.duration_s): (r.at_risk, pytest.approx(r.survival, abs=1e-9)) for r in got} == want
    assert want["all", 5] == (2, 0.0) and not any(k == "none" for k, _ in want)


def test_product_limit_of_many_durations(spark):
    """120,000 durations of one key; work that grows with their square would take minutes."""
    n = 120_000
    began = time.monotonic()
    got = candidates.outlasting(spark.range(n).selectExpr("'k' AS k", "id AS duration_s", "true AS ended"), ["k"])
    row = got.agg(F.count("*").alias("n"), F.max("at_risk").alias("most"), F.sum("at_risk").alias("all"), F.min(F.when(F.round("survival", 9) <= 0.5, F.col("duration_s"))).alias("half")).first()
    assert tuple(row) == (n, n, n * (n + 1) // 2, n // 2 - 1) and time.monotonic() - began < 30


def test_ranks_of_counted_values(spark):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), rng.choice("xy"), float(rng.randrange(9)), rng.randrange(1, 4)) for _ in range(60)] + [("c", "x", 4.0, 1), ("c", "x", 5.0, 1), ("c", "y", None, 3)]
    df = spark.createDataFrame(rows, "k string, measure string, value double, n long")
    got = {r.k: (r.mx, r.my, r.px) for r in candidates.counted_ranks(df, ["k"], {"x": "mx", "y": "my"}, {"x": "px"}).collect()}
    for k in "abc":
        x, y = (sorted(v for key, m, v, n in rows if key == k and m == name and v is not None for _ in range(n)) for name in "xy")
        assert got[k] == (median(x), median(y) if y else None, int(x[(9 * len(x) + 9) // 10 - 1]))


FILL = {
    "fill_token_side": "YES", "unpaired_yes_before": 0.0, "unpaired_no_before": 0.0, "bond_delta": 0.0, "unpaired_delta": 0.0, "event_market_count_active_before": 0,
    "event_unpaired_inventory_before": 0.0, "event_bond_qty_before": 0.0, "role": "taker", "order_time_confidence": "fill_only_unknown", "fill_after_first_seen_s": None,
}


@pytest.mark.parametrize("change,rules", [
    ({}, "EF"),
    ({"unpaired_no_before": 5.0, "bond_delta": 2.0, "unpaired_delta": -2.0}, "ABCEF"),
    ({"unpaired_yes_before": 5.0, "bond_delta": 2.0}, "BEF"),
    ({"fill_token_side": "NO", "unpaired_yes_before": 5.0, "bond_delta": 2.0}, "ABEF"),
    ({"fill_token_side": None, "bond_delta": 2.0, "unpaired_delta": -1.0}, "ABCEF"),
    ({"event_market_count_active_before": 2}, "EF"),
    ({"event_market_count_active_before": 2, "event_bond_qty_before": 1.0}, "DEF"),
    ({"role": "Maker", "order_time_confidence": "estimated_book_seen", "fill_after_first_seen_s": 3}, "EFG"),
    ({"role": "maker", "order_time_confidence": "estimated_book_seen", "fill_after_first_seen_s": 0}, "EF"),
])
def test_triggers(spark, change, rules):
    schema = "fill_token_side string, unpaired_yes_before double, unpaired_no_before double, bond_delta double, unpaired_delta double, event_market_count_active_before long, event_unpaired_inventory_before double, event_bond_qty_before double, role string, order_time_confidence string, fill_after_first_seen_s long"
    row = spark.createDataFrame([tuple((FILL | change).values())], schema).select(*(F.coalesce(p, F.lit(False)).alias(k) for k, p in candidates.triggers().items())).first()
    assert "".join(k for k in "ABCDEFG" if row[k]) == rules


def test_classes_of_events(spark):
    fills = [("w", "e1", "c1", 1, 1, "post_event"), ("w", "e1", "c2", 2, 2, "unknown"), ("w", "e2", "c3", 3, 3, "late_live"), ("w", "e3", "c4", 4, 4, "post_event"), ("v", "e1", "c1", 5, 5, "post_event"), ("w", None, "c5", 6, 6, "unknown")]
    f = spark.createDataFrame(fills, "wallet string, event_id string, condition_id string, id long, fill_ts long, event_phase string")
    periods = spark.createDataFrame([("w", "c1", 5, True), ("v", "c1", 5, False)], "wallet string, condition_id string, duration_s long, ended boolean")
    done = spark.createDataFrame([("w", "c1", 1), ("w", "c2", 1), ("w", "c3", 1), ("v", "c1", 1)], "wallet string, condition_id string, redeemed int")
    got = {(r.wallet, r.event_id): r.event_class for r in candidates.event_classes(f, periods, done).collect()}
    assert got == {("w", "e1"): "closed_complete", ("w", "e2"): "live_or_in_progress", ("w", "e3"): "open_unknown", ("v", "e1"): "live_or_in_progress"}
