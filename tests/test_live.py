"""Streams that keep state and ticks: restarts, late and repeated data, and batches that are killed and run again."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql.utils import StreamingQueryException

from tidemark.operators import ordered as O
from tidemark.plans import accounting as A
from tidemark.plans.views import fanout, ledger, ledger_of, tokens
from tidemark.sources.versioned import VersionedTable
from tidemark.streaming import kept, tick
from tidemark.streaming.flows import EVENTS

DIR = "/root/testdata/sf0.001"
MOVE = "wallet string, token_id string, id long, ts long, kind string, shares double, usdc double"


def events(spark):
    e = spark.read.parquet(f"{DIR}/events.parquet")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props")


def near(a, b):
    assert len(a) == len(b)
    for x, y in zip(sorted(a, key=str), sorted(b, key=str)):
        assert x == pytest.approx(y, abs=1e-6), (x, y)


def drained(spark, path, folder, late_s):
    stream = spark.readStream.schema(MOVE).option("maxFilesPerTrigger", 1000).parquet(path)
    kept.drain_positions(stream, folder, late_s)
    h = {(r.wallet, r.token_id): r for r in kept.told_holdings(spark, folder).collect()}
    return h, sorted((r.token_id, r.episode, r.open_ts, r.close_ts, r.close_reason) for r in kept.told_episodes(spark, folder).collect())


def test_late_repeated_and_too_late_moves(spark, tmp_path):
    path, folder = str(tmp_path / "in"), str(tmp_path / "run")

    def land(*rows):
        spark.createDataFrame([("w", "t", *r) for r in rows], MOVE).coalesce(1).write.mode("append").parquet(path)
        return drained(spark, path, folder, 100)

    h, e = land((1, 0, "add", 10.0, 4.0), (2, 50, "remove", 10.0, 6.0))
    assert (h["w", "t"].qty, h["w", "t"].realized, e) == (0.0, 2.0, [("t", 0, 0, 50, "flat")])
    # a late buy comes between the two, so the episode that was closed is open again; a repeat counts once
    h, e = land((3, 20, "add", 5.0, 5.0), (2, 50, "remove", 10.0, 6.0))
    assert h["w", "t"].qty == 5 and h["w", "t"].n_moves == 3 and h["w", "t"].cost == pytest.approx(3) and e == [("t", 0, 0, None, "open")]
    h, e = land((4, 300, "remove", 5.0, 1.0), (5, 310, "add", 1.0, 1.0))
    assert e == [("t", 0, 0, 300, "flat"), ("t", 1, 310, None, "open")]
    h, e = land((6, 49, "add", 7.0, 1.0), (7, 250, "add", 2.0, 1.0))  # the first is older than what can still change
    assert h["w", "t"].too_late == 1 and h["w", "t"].qty == 3 and e == [("t", 0, 0, None, "open")]


def test_an_episode_that_late_moves_leave_empty_is_told_no_more(spark, tmp_path):
    path, folder = str(tmp_path / "in"), str(tmp_path / "run")

    def land(*rows):
        spark.createDataFrame([("w", "t", *r) for r in rows], MOVE).coalesce(1).write.mode("append").parquet(path)
        return drained(spark, path, folder, 100)[1]

    e = land((1, 0, "add", 1.0, 1.0), (2, 10, "reset", 0.0, 0.0), (3, 20, "add", 1.0, 1.0), (4, 30, "reset", 0.0, 0.0))
    assert e == [("t", 0, 0, 10, "resolution"), ("t", 1, 20, 30, "resolution")]
    # a late reset ends the first episode, so the number of the second is left to a reset alone
    e = land((5, 5, "reset", 0.0, 0.0), (6, 40, "add", 1.0, 1.0))
    assert e == [("t", 0, 0, 5, "resolution"), ("t", 2, 20, 30, "resolution"), ("t", 3, 40, None, "open")]
    e = land((7, 500, "remove", 1.0, 1.0), (8, 510, "add", 1.0, 1.0))
    assert e == [("t", 0, 0, 5, "resolution"), ("t", 2, 20, 30, "resolution"), ("t", 3, 40, 500, "flat"), ("t", 4, 510, None, "open")]


def test_state_holds_only_what_can_change(spark, tmp_path):
    """The same results whether a key's moves stay in the state for long or hardly at all."""
    moves = fanout(ledger(spark, DIR), tokens(spark)).select(*(c.split()[0] for c in MOVE.split(", ")))
    span = moves.agg(F.min("ts"), F.max("ts")).first()
    want = None
    for late_s in (0, 10**9):
        path, folder = str(tmp_path / f"in{late_s}"), str(tmp_path / f"run{late_s}")
        for k in range(3):
            low, high = (span[0] + (span[1] - span[0] + 1) * x / 3 for x in (k, k + 1))
            moves.where((F.col("ts") >= low) & (F.col("ts") < high)).write.mode("append").parquet(path)
            h, e = drained(spark, path, folder, late_s)
        got = [(*k, r.qty, r.cost, r.realized, r.n_moves) for k, r in h.items()]
        if want:
            near(got, want[0])
            assert e == want[1]
        want = got, e
    p = A.positions(spark, DIR).groupBy("wallet", "token_id").agg(F.max_by("qty", F.struct("ts", "id")), F.max_by("cost", F.struct("ts", "id")), F.sum("realized"), F.count("*"))
    near(want[0], [tuple(r) for r in p.collect()])


def tables(t):
    out = []
    for name in ("ledger", "holdings", "watchlist", "context", "log"):
        df = getattr(t, name).read()
        rounded = [F.round(f.name, 6).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema]
        out.append(sorted(map(str, df.select(*rounded).collect())))
    return out


def test_a_killed_batch_runs_again_and_changes_nothing_twice(spark, tmp_path):
    landing = str(tmp_path / "landing")
    e = events(spark)

    def land(k):
        part = e.where(F.pmod(F.dayofmonth("ts"), F.lit(3)) == k)
        part.union(part.where("event_id % 5 = 0")).write.mode("append").parquet(landing)

    whole = tick.Tick(spark, str(tmp_path / "whole"))
    stops = {1: "ledger", 2: "context"}
    broken = tick.Tick(spark, str(tmp_path / "broken"))
    for k in range(3):
        land(k)
        tick.run(spark, landing, str(tmp_path / "whole"), tick=whole)

        def stop(step, at=stops.get(k)):
            if step == at:
                raise OSError("killed")

        broken.after = stop
        if k in stops:
            with pytest.raises(StreamingQueryException):
                tick.run(spark, landing, str(tmp_path / "broken"), tick=broken)
        broken.after = lambda step: None
        tick.run(spark, landing, str(tmp_path / "broken"), tick=broken)
    assert tables(broken) == tables(whole)
    assert whole.ledger.read().count() == e.count() and [r.n_late_keys > 0 for r in whole.log.read().orderBy("batch").collect()] == [False, True, True]
    want = A.latest(A.positions(spark, DIR)).select("wallet", "token_id", "qty", "cost")
    near([tuple(r) for r in whole.holdings.read().select("wallet", "token_id", "qty", "cost").collect()], [tuple(r) for r in want.collect()])
    versions = [getattr(whole, n).versions() for n in ("ledger", "holdings", "watchlist", "context", "log")]
    whole(e.where("event_id < 9"), 2)  # the last batch once more
    assert versions == [getattr(whole, n).versions() for n in ("ledger", "holdings", "watchlist", "context", "log")]


def test_watchlist_and_context_of_a_batch(spark, tmp_path):
    t = tick.Tick(spark, str(tmp_path / "t"))
    t(events(spark), 0)
    trades = [r.asDict() for r in ledger_of(events(spark)).where("event_type = 'TRADE'").collect()]
    got = {r.id: (r.last_price, r.age_s) for r in t.context.read().collect()}
    for r in trades:
        before = [x for x in trades if x["token_id"] == r["token_id"] and 0 < r["ts"] - x["ts"] <= tick.LOOKBACK_S]
        last = max(before, key=lambda x: (x["ts"], x["price"]), default=None)
        assert got[r["id"]] == ((last["price"], r["ts"] - last["ts"]) if last else (None, None))
    held = {(r.wallet, r.token_id): r for r in t.holdings.read().collect()}
    newest = max(r.last_ts for r in held.values())
    for r in t.watchlist.read().collect():
        h = held[r.wallet, r.token_id]
        recent = h.last_ts >= newest - tick.RECENT_S
        assert r.priority == (10 if recent else 20) and r.active == (recent or h.qty > O.EPSILON)


def test_backfill_goes_on_where_it_stopped(spark, tmp_path):
    source = spark.range(100).select("id", (F.col("id") * 10).alias("ts"))
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.append(source.where("id in (95, 60)"))  # known before
    assert tick.backfill(source, t, 1000, 205, 100, pages=3) == 3
    assert sorted(r.id for r in t.read().collect()) == [60, *range(70, 100)]
    assert tick.backfill(source, t, 1000, 205, 100) == 5
    assert sorted(r.id for r in t.read().collect()) == list(range(21, 100))
    assert tick.backfill(source, t, 1000, 205, 100) == 0


def test_no_events(spark, tmp_path):
    none = spark.createDataFrame([], EVENTS)
    t = tick.Tick(spark, str(tmp_path / "t"))
    t(none, 0)
    t(events(spark), 1)
    t(none, 2)
    assert t.log.read().count() == 3 and t.ledger.read().count() == 1000
