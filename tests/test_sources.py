from __future__ import annotations

import gzip
import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.sources import readers, sinks

ROW = {"proxyWallet": "0xAB", "timestamp": 10, "conditionId": "\\xAB01", "type": "TRADE", "size": "2.5", "usdcSize": "1.25", "transactionHash": "0x1", "price": "0.5", "asset": "7", "side": "BUY", "outcomeIndex": 0}


def test_activity_pages_dedupe_and_signs(spark, tmp_path):
    rows = [ROW, ROW, ROW | {"side": "SELL"}, ROW | {"type": "MERGE", "asset": "", "side": ""}, ROW | {"type": "NEW_KIND", "side": "", "asset": ""}, ROW | {"size": "bad", "timestamp": 11}]
    with gzip.open(tmp_path / "a.json.gz", "wt") as f:
        json.dump(rows, f)
    out = readers.normalise_activity(readers.read_activity(spark, str(tmp_path))).orderBy("dedupe_key").collect()
    assert len(out) == 6 and len({r.dedupe_key for r in out}) == 6
    by = {(r.event_type, r.side, r.duplicate_index, r.ts): (float(r.delta_shares), float(r.delta_usdc)) for r in out}
    assert by["TRADE", "BUY", 0, 10] == by["TRADE", "BUY", 1, 10] == (2.5, -1.25)
    assert by["TRADE", "SELL", 0, 10] == (-2.5, 1.25) and by["MERGE", None, 0, 10] == (-2.5, 1.25)
    assert by["NEW_KIND", None, 0, 10] == (0, 0) and by["TRADE", "BUY", 0, 11] == (0, -1.25)
    assert {r.condition_id for r in out} == {"0xab01"}


def test_books_are_sorted_and_bad_payloads_are_empty(spark):
    book = {"bids": [{"price": "0.4", "size": "1"}, {"price": "0.45", "size": "2"}, {"price": "x", "size": "1"}], "asks": [{"price": "0.6", "size": "3"}, {"price": "0.55", "size": "4"}]}
    df = spark.createDataFrame([(1, json.dumps(book)), (2, "not json"), (3, None)], "id long, payload string")
    a, b, c = readers.parse_books(df).orderBy("id").collect()
    assert (a.best_bid, a.best_ask, a.mid, len(a.bids)) == (0.45, 0.55, 0.5, 2)
    assert a.imbalance == pytest.approx((3 - 7) / 10)
    assert b.best_bid is None and b.bids == [] and c.mid is None


def test_history_and_logs(spark):
    df = spark.createDataFrame([("t", '{"history":[{"t":1,"p":0.5},{"t":2,"p":0.25}]}')], "token string, payload string")
    assert [(r.token, r.ts, r.price) for r in readers.parse_history(df).orderBy("ts").collect()] == [("t", 1, 0.5), ("t", 2, 0.25)]
    big = 2**250 + 7
    data = "0x" + "".join(f"{v:064x}" for v in (0, big, 1_500_000, 3_000_000, 10))
    one, two = ("0x" + readers.keccak256(x.encode()).hex() for x in (readers.FILL_V1, readers.FILL_V2))
    topics = [one, "0xFEED", "0x" + "00" * 12 + "aa" * 20, "0x" + "00" * 12 + "BB" * 20]
    r = readers.decode_order_filled(spark.createDataFrame([(topics, data)], "topics array<string>, data string")).first()
    assert (r.taker_asset_id, r.maker_amount, r.taker_amount, r.fee) == (str(big), 1.5, 3.0, 0.00001)
    assert (r.layout, r.order_hash, r.maker, r.taker) == (1, "0xfeed", "0x" + "aa" * 20, "0x" + "bb" * 20)

    def words(*values):
        return "0x" + "".join(f"{v:064x}" for v in values)

    logs = [
        (1, [two.upper().replace("0X", "0x"), *topics[1:]], words(0, big, 2_000_000, 4 * 10**20, 7, 0, 0)),
        (2, [two, *topics[1:]], words(1, big, 2_000_000, 1_000_000, 0, 0, 0)),
        (3, [two, *topics[1:]], words(2, big, 1, 1, 0, 0, 0)),  # no such side
        (4, ["0xother", *topics[1:]], words(0, big, 1, 1, 0)),
        (5, topics[:3], data),
        (6, [two, *topics[1:]], data),  # too few words
        (7, topics, None),
    ]
    out = {r.id: r for r in readers.decode_order_filled(spark.createDataFrame(logs, "id long, topics array<string>, data string")).collect()}
    assert (out[1].layout, out[1].maker_asset_id, out[1].taker_asset_id, out[1].maker_amount, out[1].taker_amount) == (2, "0", str(big), 2.0, 4e14)
    assert (out[2].maker_asset_id, out[2].taker_asset_id, out[2].taker_amount) == (str(big), "0", 1.0)
    assert all(out[k].layout is None and out[k].maker is None and out[k].fee is None for k in (3, 4, 5, 6, 7))


def test_positions_and_values(spark):
    page = [{"asset": "7", "conditionId": "0xAB", "size": "2.5", "avgPrice": 0.4, "realizedPnl": "x"}, {"asset": "", "size": "1"}, {"size": "1"}]
    df = spark.createDataFrame([("w", json.dumps(page)), ("v", "no json"), ("u", None)], "wallet string, payload string")
    (r,) = readers.parse_positions(df).collect()
    assert (r.wallet, r.token_id, r.condition_id, float(r.size), float(r.avg_price), float(r.realized_pnl)) == ("w", "7", "0xab", 2.5, 0.4, 0)
    assert (r.has_avg_price, r.has_realized, float(r.cur_price)) == (True, True, 0)
    values = ['{"totalValue": 3, "currentValue": 9}', '[{"value": "1.5"}, {"portfolioValue": 2}, 4, "bad"]', "7.25", '{"x": 1}', "[]", "bad", None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v string")
    got = [float(r.x) for r in rows.select("i", readers.parse_value(F.col("v")).alias("x")).orderBy("i").collect()]
    assert got == [3, 7.5, 7.25, 0, 0, 0, 0]


def test_exported_fills_are_cleaned(spark):
    columns = [*readers.FILL_NUMBERS, *readers.FILL_TIMES, "role", "side", "context_status"]
    row = dict.fromkeys(columns, None) | {"fill_size": "5", "delta_usdc": "-2.5", "book_before_age_s": "20", "side": "SELL", "role": "Maker", "trade_utc": "2024-01-02 03:04:05", "fill_price": "x"}
    rows = [row, row | {"side": "BUY", "book_before_age_s": None}, row | {"side": "other", "book_before_age_s": "10"}]
    df = spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], ", ".join(f"{c} string" for c in columns))
    a, b, c = readers.clean_fills(df, "me").collect()
    assert (a.signed_shares, a.notional, a.side, a.role, a.fill_price, a.wallet_label, a.trade_utc.hour) == (-5, 2.5, "sell", "maker", None, "me", 3)
    assert (a.valid_before_book, a.strict_before_book, b.signed_shares, b.valid_before_book, c.signed_shares, c.strict_before_book) == (True, False, 5, False, None, True)
    with pytest.raises(ValueError, match="missing columns: role"):
        readers.clean_fills(df.drop("role"), "me")


def test_keccak_known_values():
    assert readers.keccak256(b"").hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert readers.keccak256(b"Transfer(address,address,uint256)").hex().startswith("ddf252ad1be2c89b")
    assert readers.keccak256(b"a" * 136) != readers.keccak256(b"a" * 135)


def test_csv_columns_and_optional_tables(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    assert readers.read_csv(spark, str(tmp_path / "x.csv"), "a long, b long", ("a",)).first().b == 2
    with pytest.raises(ValueError, match="missing columns: c"):
        readers.read_csv(spark, str(tmp_path / "x.csv"), "a long, b long", ("c",))
    assert readers.optional_table(spark, "nowhere") is None


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2)], "dedupe_key string, v long")
    sinks.append_new(df, path)
    sinks.append_new(spark.createDataFrame([("b", 9), ("c", 3)], df.schema), path)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", 1), ("b", 2), ("c", 3)]
    raw = spark.createDataFrame([("s", "e", "p", "x", 5)], "source string, endpoint string, params string, payload string, ts long")
    for _ in range(2):
        sinks.persist_raw(raw, str(tmp_path / "raw"))
    assert spark.read.parquet(str(tmp_path / "raw")).count() == 1
    assert sinks.pruned(raw, 6).first().payload is None and sinks.pruned(raw, 5).first().payload == "x"
    p = str(tmp_path / "p")
    sinks.rebuild(spark.createDataFrame([("w1", 1), ("w2", 2)], "wallet string, v long"), p)
    sinks.rebuild(spark.createDataFrame([("w1", 7)], "wallet string, v long"), p)
    assert sorted((r.wallet, r.v) for r in spark.read.parquet(p).collect()) == [("w1", 7), ("w2", 2)]
    last = sinks.latest(spark.createDataFrame([(1, "old", 1), (1, None, 2)], "k long, c string, at long"), ["k"], "at", ("c",)).first()
    assert (last.c, last.at) == ("old", 2)
    with pytest.raises(ValueError):
        sinks.export(df, path, "xml")


def test_scalars(spark):
    df = spark.range(1).select(
        scalars.condition_id(F.lit("\\xAB")).alias("a"), scalars.condition_id(F.lit("zz")).alias("b"), scalars.context_status(F.lit(5)).alias("c"),
        scalars.context_status(F.lit(None).cast("long")).alias("d"), scalars.price_bucket(F.lit(1.0)).alias("e"), scalars.category(F.lit("  ")).alias("f"),
        scalars.category_of_tags(F.array(F.lit("x"), F.lit("Crypto"), F.lit("sports"))).alias("g"), scalars.fee(F.lit(10.0), F.lit(1.0), F.lit(0.1), F.lit(1.0)).alias("h"),
        scalars.json_list(F.lit("nope")).alias("i"), scalars.trade_price(F.lit(0.0), F.lit(-3.0), F.lit(6.0)).alias("j"),
        scalars.structure_type(F.lit(2), F.lit(True), F.lit("e")).alias("k"), scalars.keyword_match(("world cup",), F.lit("The  WORLD\n cup")).alias("l"),
    )
    assert list(df.first()) == ["0xab", "zz", "good", "missing", 9, "unclassified", "crypto", 0.0, [], 0.5, "negRisk-event-member", True]


def test_buckets_paths_and_verdicts(spark):
    df = spark.createDataFrame([(None, None), (9, 0.89), (10, 0.9), (59, 0.95), (60, 0.98), (299, 1.0), (300, 1.01), (900, 1.0), (3600, 1.0)], "s long, c double")
    rows = df.select(scalars.time_bucket(F.col("s")).alias("t"), scalars.cost_bucket(F.col("c")).alias("c")).collect()
    assert [r.t for r in rows] == ["not_completed", "under_10s", "under_60s", "under_60s", "1m_5m", "1m_5m", "5m_15m", "15m_60m", "over_60m"]
    assert [r.c for r in rows][:7] == ["unknown", "lt_0_90", "0_90_0_95", "0_95_0_98", "0_98_1_00", "0_98_1_00", "gt_1_00"]
    ends = [("open", "TRADE"), ("flat", "TRADE"), ("flat", "MERGE"), ("flat", "SPLIT"), ("resolution", "REDEEM"), ("resolution", "RESOLUTION_SETTLEMENT"), ("resolution", "x"), ("other", "TRADE")]
    paths = spark.createDataFrame(ends, "a string, b string").select(scalars.close_path(F.col("a"), F.col("b")).alias("p")).collect()
    assert [r.p for r in paths] == ["OPEN", "SELL", "MERGE", "MIXED", "REDEEM", "RESOLUTION", "UNKNOWN", "UNKNOWN"]
    cases = [(0, 0, 0.0, 0.0, 0.0, 0.0, 0.0), (10, 8, 3.0, 0.6, 0.0, 1.0, 1.0), (10, 8, 60.0, 0.4, 0.1, 1.0, 1.0), (10, 8, 60.0, 0.1, 0.1, 0.5, 1.0), (10, 2, 900.0, 0.4, 0.9, 0.1, 9.0), (100, 2, 900.0, 0.4, 0.9, 0.1, 9.0)]
    names = "total long, matched long, delay double, token double, first double, event double, size double"
    v = spark.createDataFrame(cases, names).select(scalars.cluster_verdict(*(F.col(c.split()[0]) for c in names.split(", "))).alias("v")).collect()
    assert [r.v for r in v] == ["independent", "same_system_candidate", "follower", "shared_signal", "research_candidate", "independent"]
    null = "0x" + "0" * 40
    moves = spark.createDataFrame([(null, "w"), ("w", null), ("x", "w"), ("w", "x"), ("x", "y")], "a string, b string")
    assert [r.k for r in moves.select(scalars.transfer_class(F.col("a"), F.col("b"), F.lit("w")).alias("k")).collect()] == ["MINT", "BURN", "TRANSFER_IN", "TRANSFER_OUT", "OTHER"]
    one = spark.range(1).select(scalars.research_priority(F.lit(0.5), F.lit(0.5), F.lit(20000.0)).alias("a"), scalars.research_priority(F.lit(0.0), F.lit(0.0), F.lit(-5.0)).alias("b")).first()
    assert one.a == pytest.approx(0.65) and one.b == 0


def test_append_reads_the_partitions_of_the_increment(spark, tmp_path):
    path = str(tmp_path / "by_day")
    schema = "dedupe_key string, v long, day string"
    sinks.append_new(spark.createDataFrame([("a", 1, "d1"), ("b", 2, "d2")], schema), path, partition="day")
    sinks.append_new(spark.createDataFrame([("a", 9, "d1"), ("c", 3, "d2"), ("c", 3, "d2")], schema), path, partition="day")
    assert sorted((r.dedupe_key, r.v, r.day) for r in spark.read.parquet(path).collect()) == [("a", 1, "d1"), ("b", 2, "d2"), ("c", 3, "d2")]
    bundle = sinks.export_bundle({"b": spark.range(2), "a": spark.range(1)}, str(tmp_path / "bundle"))
    assert [spark.read.option("header", True).csv(p).count() for p in bundle] == [1, 2]
