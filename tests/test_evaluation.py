"""Rules with reasons, their verdicts and storage, buckets, and marks from price histories, by hand."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tidemark.plans import evaluation as E
from tidemark.plans import history as H
from tidemark.sources import readers
from tidemark.sources.versioned import VersionedTable

FILL = "id long, wallet string, trade_ts long, split string, side string, fill_price double, mid double, spread_bps double, best_ask double, imbalance_top5 double, trade_hour_utc long, time_to_event_start_s long, directional_before double, bond_before double, qty_token_before double, qty_complement_before double, event_exposure_before double, markout_5m double, markout_1h double, pnl_episode double"


def fills(spark, *rows):
    base = dict(id=1, wallet="w", trade_ts=10, split="train", side="BUY", fill_price=0.4, mid=0.5, spread_bps=100.0, best_ask=0.52, imbalance_top5=0.5, trade_hour_utc=9, time_to_event_start_s=100,
                directional_before=-4.0, bond_before=1.0, qty_token_before=1.0, qty_complement_before=5.0, event_exposure_before=-9.0, markout_5m=0.1, markout_1h=0.1, pnl_episode=None)
    names = [c.strip().split(" ")[0] for c in FILL.split(",")]
    return spark.createDataFrame([tuple((base | r)[n] for n in names) for r in rows], FILL)


def told(spark, rule, **changed):
    r = E.evaluated(fills(spark, changed), [rule]).first()
    return r.applies, r.explanation


@pytest.mark.parametrize(
    "rule, changed, applies, why",
    [
        (E.spread_capture(), {}, True, "spread and improvement suffice"),
        (E.spread_capture(), {"mid": None}, False, "missing required feature(s)"),
        (E.spread_capture(), {"spread_bps": 49.9}, False, "spread_bps below 50"),
        (E.spread_capture(), {"mid": 0.0}, False, "mid is zero"),
        (E.spread_capture(), {"side": "SELL"}, False, "fill improvement below 10 bps"),
        (E.inventory_balancing(), {"side": "SELL"}, False, "does not reduce directional"),
        (E.inventory_balancing(), {"bond_before": None}, False, "missing directional_before or bond_before"),
        (E.inventory_balancing(bond=True), {"qty_complement_before": None}, False, "does not increase bond"),
        (E.inventory_balancing(reduce=False), {"side": "SELL"}, True, "fill balances the inventory"),
        (E.completion_set_edge(0.92), {}, True, "total bond cost is low"),
        (E.completion_set_edge(0.91), {}, False, "total bond cost above 0.91"),
        (E.depth_imbalance(), {"side": "SELL"}, False, "SELL against the imbalance"),
        (E.depth_imbalance(favourable=False), {"side": "SELL"}, True, "imbalance favours the side"),
        (E.event_timing(), {"time_to_event_start_s": None}, True, "hour within allowed window"),
        (E.event_timing((8, 10)), {}, False, "hour not allowed"),
        (E.event_timing((), 99), {}, False, "time to event start above 99 s"),
        (E.event_timing((), None, 101), {}, False, "time to event start below 101 s"),
        (E.event_timing((9,), 100, 100), {}, True, "hour within allowed window"),
        (E.event_timing((), 5), {"time_to_event_start_s": None}, True, "hour within allowed window"),
        (E.correlated_siblings(), {"side": "SELL"}, False, "not improving"),
        (E.correlated_siblings(), {}, True, "improving"),
        (E.closed_cycle(), {"event_exposure_before": None}, False, "no event-level exposure"),
    ],
)
def test_first_failing_check_explains(spark, rule, changed, applies, why):
    assert told(spark, rule, **changed) == (applies, why)


def test_features_are_told_and_nulls_named(spark):
    r = E.evaluated(fills(spark, {"time_to_event_start_s": None}), [E.event_timing()]).first()
    assert r.features_used == "trade_hour_utc=9.0000,time_to_event_start_s=null"


def test_verdicts_need_both_later_splits_and_a_filter(spark):
    rows = [{"id": i, "split": s, "pnl_episode": p, "markout_5m": m} for i, (s, p, m) in enumerate([("train", 1.0, None), ("validation", 2.0, -1.0), ("test", None, 0.5)])]
    rules = [E.spread_capture(), E.event_timing()]
    got = {r.rule: (r.n_fills, r.n_explained, r.promoted, r.rejection_reason) for r in E.verdicts(E.evaluated(fills(spark, *rows), rules), rules).collect()}
    assert got == {"spread_capture": (3, 3, True, None), "event_timing": (3, 3, False, "no_active_predicate")}
    rows[2]["markout_5m"] = 0.0
    got = {r.rule: r.rejection_reason for r in E.verdicts(E.evaluated(fills(spark, *rows), rules), rules).collect()}
    assert got["spread_capture"] == "insufficient_oos_signal"
    assert E.verdicts(E.evaluated(fills(spark, *rows).limit(0), rules), rules).count() == 0


def test_stored_rules_are_replaced_one_by_one(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "rules"), "rule")
    d = fills(spark, {"id": 1}, {"id": 2, "spread_bps": 60.0})
    E.store_evaluations(table, d, [E.spread_capture(), E.event_timing()])
    assert {(r.rule, r.applies) for r in E.explain_fill(table, 2).collect()} == {("spread_capture", True), ("event_timing", True)}
    E.store_evaluations(table, d, [E.spread_capture(min_spread_bps=70)])
    got = {r.rule: r.explanation for r in E.explain_fill(table, 2).collect()}
    assert got == {"spread_capture": "spread_bps below 70", "event_timing": "hour within allowed window"}
    assert E.explain_fill(table, 3).count() == 0 and table.read().count() == 4


def test_event_times_phases_flags_and_reasons(spark):
    names = "condition_id string, trade_ts long, side string, fill_notional double, fill_shares double, qty_complement double, close_path string, close_ts long, realized_pnl_wac double, event_id string, " + ", ".join(
        f"{c} double" for c in E.NULL_REASONS if c not in ("close_path", "market_category", "time_to_event_start_s", "pnl_episode", "realized_pnl_wac")
    )
    n = len(names.split(",")) - 10
    rows = [("a", t, "BUY", 2.0, 4.0, 1.0, "SELL", 90, 3.0, "e", *[0.5] * n) for t in (99, 100, 134, 150, 170, 201)]
    rows.append(("z", 99, "SELL", 2.0, 4.0, None, "UNKNOWN", None, None, None, *[None] * n))
    rows.append(("a", 99, "SELL", 2.0, 4.0, 1.0, "OPEN", None, None, "e", *[0.5] * n))
    starts = spark.createDataFrame([("a", 100, 200)], "condition_id string, start_ts long, closed_ts long")
    out = E.with_event_times(spark.createDataFrame(rows, names), starts).collect()
    by = {(r.condition_id, r.trade_ts, r.close_path): r for r in out}
    phases = [by["a", t, "SELL"].event_phase for t in (99, 100, 134, 150, 170, 201)]
    assert phases == ["pregame", "early_live", "early_live", "halftime_or_pause", "late_live", "post_event"]
    r = by["a", 99, "SELL"]
    assert (r.time_to_event_start_s, r.time_since_start_s, r.delta_usdc, r.closed_by_sell, r.closed_by_merge, r.trade_utc) == (1, -1, -2.0, 1, 0, "1970-01-01 00:01:39")
    assert json.loads(r.null_reasons_json) == {"pnl_at_resolution": "no_resolution_yet"}
    assert json.loads(by["a", 99, "OPEN"].null_reasons_json) == dict.fromkeys(("pnl_at_resolution", "pnl_episode", "realized_pnl_wac"), "position_still_open")
    z = by["z", 99, "UNKNOWN"]
    why = json.loads(z.null_reasons_json)
    assert z.event_phase == "unknown" and z.time_to_event_start_s is None and why["close_path"] == "episode_not_built"
    assert why["time_to_event_start_s"] == why["market_category"] == "missing_market_metadata" and why["bond_before"] == "no_complement_token" and why["markout_5m"] == "no_price_point"


def test_buckets_at_their_edges(spark):
    d = spark.createDataFrame([(0.1, 5, -1, 9), (0.9, 6, 0, 10), (None, 61, 604800, 23), (0.0999, None, None, None)], "fill_price double, book_before_age_s long, time_to_event_start_s long, trade_hour_utc long")
    out = d.select(*(F.expr(E.bucket(f)).alias(f) for f in ("price", "book_age", "time_to_event", "hour"))).collect()
    assert [tuple(r) for r in out] == [("0.10-0.25", "0-5s", "past_start", "09"), (">=0.90", "6-15s", "0-1h", "10"), ("unknown", ">60s", ">7d", "23"), ("<0.10", "unknown", "unknown", "unknown")]


def test_history_marks_at_edges(spark):
    points = spark.createDataFrame([("t", 100, 0.2), ("t", 100, 0.3), ("t", 200_000, 0.5)], "token_id string, ts long, price double")
    asked = spark.createDataFrame([(1, "t", 99), (2, "t", 100), (3, "t", 86_500), (4, "t", 86_501), (5, "t", 200_000), (6, "u", 5), (7, None, 5)], "id long, token_id string, ts long")
    got = {r.id: (r.mark, r.mark_age_s, r.stale) for r in H.history_marks_of(asked, points).collect()}
    none = (None, None, None)
    assert got == {1: none, 2: (0.3, 0, False), 3: (0.3, 86_400, False), 4: (0.3, 86_401, True), 5: (0.5, 0, False), 6: none, 7: none}
    assert {r.mark for r in H.history_marks_of(asked, points.limit(0)).collect()} == {None}


def test_histories_of_other_forms(spark):
    payloads = ['[{"timestamp": 5, "price": "0.5"}]', '{"history": [{"ts": "7", "p": 0.25}, {"t": 8}, {"p": 1}, {"t": "x", "p": 1}]}', '{"history": 3}', "bad", None, "[]"]
    raw = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "n int, payload string")
    assert sorted(tuple(r) for r in readers.parse_history(raw).collect()) == [(0, 5, 0.5), (1, 7, 0.25)]


def test_splits_are_each_wallets_own(spark):
    from tidemark.plans import fitting

    rows = [(k, w, k % 7 * 86_400 + k // 3, 1) for w, n in (("a", 23), ("b", 4), ("c", 1)) for k in range(n)]
    d = spark.createDataFrame(rows, "id long, wallet string, trade_ts long, x int")
    got = {(r.wallet, r.id): r.split for r in fitting.split_by_wallet(d).collect()}
    for w in "abc":
        own = sorted((t, i) for i, v, t, _ in rows if v == w)
        for k, (_, i) in enumerate(own):
            assert got[w, i] == ("train" if k < int(len(own) * 0.6) else "validation" if k < int(len(own) * 0.8) else "test")
    assert len(got) == len(rows) and fitting.split_by_wallet(d.limit(0)).count() == 0


def test_fit_against_plain_python(spark):
    import random

    from tidemark.plans import fitting

    dice = random.Random(5)
    rules = [E.spread_capture(20, 5), E.spread_capture(100, 5), E.event_timing(), E.event_timing((9,)), E.completion_set_edge(0.1)]
    rows = []
    for i in range(120):
        rows.append({"id": i, "wallet": dice.choice("ab"), "split": dice.choice(fitting.SPLITS), "spread_bps": dice.choice([10.0, 50.0, 150.0, None]), "fill_price": dice.choice([0.4, 0.6]), "trade_hour_utc": dice.choice([9, 10]),
                     "pnl_episode": dice.choice([None, 1.0, -1.0]), "markout_5m": dice.choice([None, 0.5, -0.5]), "qty_token_before": dice.choice([-3.0, 2.0])})
    rows.append({"id": 999, "wallet": "z", "split": "test"})

    def fires(k, r):
        if k < 2:
            s, p = r.get("spread_bps", 100.0), r.get("fill_price", 0.4)
            return s is not None and s >= (20, 100)[k] and p < 0.5
        return k == 2 or k == 3 and r.get("trade_hour_utc", 9) == 9

    want = {}
    for w in "abz":
        own = [r for r in rows if r["wallet"] == w]
        for names in ((0, 1), (2, 3), (4,)):
            scored = []
            for k in names:
                train = [r for r in own if r["split"] == "train"]
                hit = [r for r in train if fires(k, r)]
                labels = [x for x in ((r["pnl_episode"] if r["pnl_episode"] is not None else r["markout_5m"]) for r in hit) if x is not None]
                score = sum(x > 0 for x in labels) / len(labels) * len(hit) / len(train) if labels else 0.0
                scored.append((round(score, 12), -k))
            score, k = max(scored)
            want[w, rules[-k].name] = (json.dumps(rules[-k].parameters), pytest.approx(score), sum(fires(-k, r) for r in own))
    got = {(r.wallet, r.rule): (r.parameters, r.train_score, r.n_explained) for r in fitting.fitted(fills(spark, *rows), rules).collect()}
    assert got == want
    reasons = {(r.wallet, r.rule): r.rejection_reason for r in fitting.fitted(fills(spark, *rows), rules).collect()}
    assert reasons["z", "completion_set_edge"] == "insufficient_oos_signal"


def test_grid_has_every_configuration_once():
    from tidemark.plans import fitting

    g = fitting.grid()
    assert len(g) == len({(r.name, json.dumps(r.parameters)) for r in g}) == 54 and sum(not r.active for r in g) == 1
