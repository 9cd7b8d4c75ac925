"""Order times: optional tables, the band index against every pair, phases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bands
from tidemark.plans import timing


def test_bands_cover_exactly_the_range(spark):
    rows = [(a, a + n) for a in (0, 1, 7, 255, 256, 1000, 9_999) for n in (-1, 0, 1, 2, 5, 100, 255, 256, 257, 1500)]
    df = spark.createDataFrame(rows, "low long, high long").withColumn("cover", bands.cover(F.col("low"), F.col("high")))
    for r in df.collect():
        held = []
        for b in r.cover:
            scale, number = b >> 48, b & (1 << 48) - 1
            held += range(number << scale, (number + 1) << scale)
        assert sorted(held) == list(range(r.low, r.high + 1)), (r.low, r.high)


def test_seen_within_against_every_pair(spark):
    rng = random.Random(3)
    quotes = [(rng.choice("ab"), rng.randrange(2000), rng.randrange(300, 1400)) for _ in range(400)]
    asks = []
    for i in range(150):
        low = rng.randrange(250, 1400)
        asks.append((i, rng.choice("abz"), rng.randrange(2500), low, low + rng.choice([-1, 0, 3, 40, 700])))
    want = {}
    for i, key, ts, low, high in asks:
        seen = [t for k, t, p in quotes if k == key and ts - 500 <= t <= ts and low <= p <= high]
        if seen:
            want[i] = (min(seen), max(seen))
    got = bands.seen_within(spark.createDataFrame(asks, "id long, k string, ts long, low long, high long"), spark.createDataFrame(quotes, "k string, ts long, tick long"), ["k"], 500)
    assert {r.id: (r.first_seen_ts, r.last_seen_ts) for r in got.collect()} == want and want
    assert bands.seen_within(spark.createDataFrame(asks, "id long, k string, ts long, low long, high long"), spark.createDataFrame([], "k string, ts long, tick long"), ["k"], 500).count() == 0


FILL = "id long, order_hash string, token_id string, side string, role string, ts long, price double"


def one(spark, orders, *fill):
    levels = spark.createDataFrame([("tok0", 900, "BUY", 0.40), ("tok0", 950, "BUY", 0.4001), ("tok0", 960, "SELL", 0.40), ("tok0", 990, "BUY", 0.45)], "token_id string, ts long, side string, price double")
    f = spark.createDataFrame([(1, *fill)], FILL)
    return timing.order_timing_of(f, levels, orders).first().asDict()


def test_exact_time_before_books_before_nothing(spark):
    orders = timing.exact_order_times({"orders": spark.createDataFrame([("0xABC", 800, None, "rpc")], "order_hash string, created_ts long, cancelled_ts long, source string")})
    exact = one(spark, orders, "0xabc", "tok0", "BUY", "maker", 1000, 0.40)
    assert (exact["order_time_confidence"], exact["order_created_ts"], exact["order_first_seen_book_ts"], exact["order_lifetime_s"]) == ("exact_onchain", 800, None, 200)
    seen = one(spark, orders, None, "tok0", "BUY", "maker", 1000, 0.40)
    assert (seen["order_time_confidence"], seen["order_first_seen_book_ts"], seen["order_last_seen_book_ts"], seen["fill_after_first_seen_s"]) == ("estimated_book_seen", 900, 950, 100)
    assert one(spark, None, "0xabc", "tok0", "BUY", "taker", 1000, 0.40)["order_time_confidence"] == "fill_only_unknown"
    assert one(spark, None, None, "tok0", "BUY", "maker", 890, 0.40)["order_time_confidence"] == "fill_only_unknown"
    assert one(spark, None, None, "tok0", "BUY", "maker", 1000, None)["order_time_confidence"] == "fill_only_unknown"


def test_tables_that_may_or_may_not_be_there(spark):
    bare = spark.createDataFrame([("0xA", 5), ("0xb", 7), ("0xB", 6), (None, 1)], "order_hash string, created_at_ts long")
    first = spark.createDataFrame([("0xa", 9, 11, "Subgraph"), ("0xb", None, 3, "rpc")], "order_hash string, order_created_ts long, order_cancelled_ts long, source string")
    got = timing.exact_order_times({"clob_orders": bare, "order_timing": first, "orders": spark.createDataFrame([(1,)], "created_ts long")})
    assert {tuple(r) for r in got.collect()} == {("0xa", 9, 11, "exact_subgraph"), ("0xb", 6, None, "exact_subgraph")}
    assert timing.exact_order_times({}) is None and timing.exact_order_times({"orders": None}) is None
    bare.createOrReplaceTempView("clob_orders")
    try:
        assert set(timing.catalog_order_tables(spark)) == {"clob_orders"}
    finally:
        spark.catalog.dropTempView("clob_orders")


@pytest.mark.parametrize("ts,start,end,want", [
    (5, None, 9, "unknown"), (5, 6, 9, "pregame"), (10, 6, 9, "post_event"), (10, 6, None, "early_live"), (103, 100, 110, "early_live"), (104, 100, 110, "late_live"),
    (105, 100, 110, "halftime_or_pause"), (109, 100, 110, "late_live"),
])
def test_phases(spark, ts, start, end, want):
    df = spark.createDataFrame([(ts, start, end)], "ts long, a long, b long")
    assert df.select(timing.phase(F.col("ts"), F.col("a"), F.col("b"))).first()[0] == want


def test_bundle_writes_seven_reports(spark, tmp_path):
    folders = timing.pattern_bundle(spark, "/root/testdata/sf0.001", str(tmp_path / "bundle"))
    assert len(folders) == 7
    for f in folders:
        df = spark.read.option("header", True).csv(f)
        assert df.count() > 0 and df.columns, f
