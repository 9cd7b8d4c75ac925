"""Registered queries against their SQL, and simulators against their folds."""

from __future__ import annotations

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark import plans
from tidemark.plans import sets, simulate
from tidemark.plans.views import ledger, markets

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql(f"create view events as select * from read_parquet('{DIR}/events.parquet')")
    return con


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "-"
    return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query_against_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, DIR)
    rel = duck.sql(plans.ORACLE[name])
    assert sorted(df.columns) == sorted(rel.columns)
    at = [rel.columns.index(c) for c in df.columns]
    got = sorted([_plain(v) for v in row] for row in df.collect())
    assert got == sorted([_plain(row[k]) for k in at] for row in rel.fetchall())


def test_every_query_is_named_once():
    assert set(plans.ORACLE) <= set(plans.QUERIES) and len(plans.QUERIES) >= 80


def test_simulations_repeat_their_folds(spark):
    rows = {}
    for r in simulate.decisions(spark, DIR).collect():
        rows.setdefault((r.wallet, r.condition_id), []).append(r.asDict())
    fills = {}
    for (wallet, _), own in rows.items():
        own.sort(key=lambda r: (r["trade_ts"], r["id"]))
        for s in simulate.SCENARIOS:
            out = simulate.fold_spread_capture(own, s)
            fills[wallet, s] = fills.get((wallet, s), 0) + out["fills"]
    got = {(r.wallet, r.scenario): r.fills for r in simulate.sim_spread_capture(spark, DIR).collect()}
    assert got == fills


def test_inventory_cycling_by_hand():
    rows = [{"outcome_index": 0, "fill_price": 0.4}, {"outcome_index": 1, "fill_price": 0.5}, {"outcome_index": 0, "fill_price": 0.4}]
    out = simulate.fold_inventory_cycling(rows)
    assert out["buys"] == 2 and out["merged"] == 10 and out["profit"] == pytest.approx(1) and out["left0"] == out["left1"] == 0
    assert simulate.fold_inventory_cycling([])["buys"] == 0


def test_stream_dedupe_over_many_unordered_files(spark, tmp_path):
    import datetime as dt

    from pyspark.sql import functions as F

    from tidemark.streaming import flows

    rows = [(k * 10 + i, dt.datetime(2024, 3, 1) - dt.timedelta(days=k), 1, "view", 1.0, "{}") for k in range(40) for i in range(3)]
    df = spark.createDataFrame(rows, flows.EVENTS)
    df.repartitionByRange(40, F.desc("ts")).write.parquet(str(tmp_path / "events.parquet"))
    assert [tuple(r) for r in flows.stream_dedupe(spark, str(tmp_path)).collect()] == [("view", 120, 120)]


def test_strategy_search_covers_every_wallet(spark):
    from tidemark.plans import sets, simulate

    path = "/root/testdata/sf0.001"
    every = {r.wallet for r in simulate.decisions(spark, path).select("wallet").distinct().collect()}
    out = simulate.strategy_search(spark, path).collect()
    assert len(every) > 3 and {r.wallet for r in out} <= every and not {r.wallet for r in out} <= {"w1", "w2", "w3"}
    by = {}
    for r in out:
        by.setdefault(r.wallet, []).append(r["rank"])
    assert all(sorted(x) == list(range(1, len(x) + 1)) for x in by.values())


def test_composite_search_against_plain_python(spark):
    from tidemark.plans import strategies

    rows = strategies._rows(spark, DIR).selectExpr("split", "markout_1h", *(f"coalesce({p}, false) AS {k}" for k, p in strategies.FAMILIES.items())).collect()

    def means(names):
        out = []
        for split in ("train", "validation", "test"):
            own = [r.markout_1h for r in rows if r.split == split and r.markout_1h is not None and all(r[k] for k in names)]
            out.append((sum(own) / len(own) if own else None, len(own)))
        return out

    kept, front = [], [(float("-inf"), ())]
    for _ in range(3):
        found = {}
        for score, names in front:
            for k in strategies.FAMILIES:
                if k not in names:
                    found[tuple(sorted({*names, k}))] = score
        scored = []
        for names in sorted(found):
            parts = means(names)
            if parts[0][0] is None or parts[1][0] is None:
                continue
            score = round(min(parts[0][0], parts[1][0]) - 0.015 * (len(names) - 1), 9)
            if score > found[names]:
                scored.append((score, names, parts))
        scored.sort(key=lambda x: (-x[0], x[1]))
        kept += scored[:6]
        front = [(s, n) for s, n, _ in scored[:6]]
    want = [("+".join(n), round(s, 6), p[2][1]) for s, n, p in sorted(kept, key=lambda x: (-x[0], x[1]))]
    got = [(r.rules, round(r.score, 6), r.n_test) for r in strategies.composite_search(spark, DIR).orderBy("rank").collect()]
    assert got == want


def test_completion_set_audit_adds_up(spark):
    lots = sets.fifo_consuming_lots(spark, DIR).collect()
    category = {r.condition_id: r.category for r in markets(spark).collect()}
    merged = {(r.wallet, r.condition_id): r.m for r in ledger(spark, DIR).where("event_type = 'MERGE'").groupBy("wallet", "condition_id").agg(F.sum("size").alias("m")).collect()}
    want = {}
    own = {(r.wallet, r.condition_id): (r.matched, r.waiting) for r in lots}
    for key in own.keys() | merged.keys():
        n = want.setdefault(category.get(key[1], "unclassified"), [0, 0.0, 0.0, 0.0, 0])
        matched, waiting = own.get(key, (0.0, 0.0))
        n[0] += 1
        n[1] += matched
        n[2] += merged.get(key, 0.0)
        n[3] += waiting
        n[4] += merged.get(key, 0.0) > matched
    got = {r.category: [r.n, r.matched, r.merged, r.orphans, r.n_over_merged] for r in sets.completion_set_audit(spark, DIR).collect()}
    assert got.keys() == want.keys()
    assert all(got[c] == pytest.approx(want[c], abs=0.01) for c in got)


def test_wallet_clusters_read_the_features_once(spark, monkeypatch):
    from tidemark.plans import strategies

    names = ["maker_fill_share", "merge_frequency", "episode_count", "adds_per_episode", "avg_position_size"]
    rows = [(f"w{i}", "all", f, float((i * (k + 3)) % 7 + 10 * (i % 3))) for i in range(12) for k, f in enumerate(names)]
    seen = spark.sparkContext.accumulator(0)

    def value(v):
        seen.add(1)
        return v

    made = spark.createDataFrame(rows, "wallet string, scope string, feature string, value double").withColumn("value", F.udf(value, "double")("value"))
    monkeypatch.setattr(strategies.B, "fingerprint_features", lambda *_: made)
    assert len(strategies.wallet_clusters(spark, DIR).collect()) == 12 and seen.value == len(rows)


def test_wallet_clusters_cover_every_scope(spark):
    from tidemark.plans import behaviour, strategies

    rows = strategies.wallet_clusters(spark, DIR).collect()
    scopes = behaviour.fingerprint_features(spark, DIR).select("wallet", "scope").distinct().count()
    assert len(rows) == scopes == len({(r.wallet, r.scope) for r in rows}) and {r.cluster for r in rows} <= set(range(5))
