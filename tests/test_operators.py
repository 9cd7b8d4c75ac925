"""Ordered operators against direct folds and scans in Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ordered as O
from tidemark.plans.views import fanout

C = [("t101", "c1", 0), ("t102", "c1", 1)]
EVENTS = "id long, wallet string, ts long, condition_id string, event_type string, side string, token_id string, outcome_index long, size double, price double, delta_usdc double"


def trade(i, ts, token, side, size, usdc):
    return (i, "w", ts, "c1", "TRADE", side, token, 0, float(size), usdc / size, float(-usdc if side == "BUY" else usdc))


def wide(i, ts, kind, size, usdc):
    return (i, "w", ts, "c1", kind, None, None, None, float(size), None, float(usdc))


GOLDEN = {
    "buy_sell_wac": ([trade(1, 1, "t101", "BUY", 100, 55), trade(2, 2, "t101", "BUY", 100, 65), trade(3, 3, "t101", "SELL", 50, 40)], {"t101": (150, 0.6)}),
    "sell_to_flat": ([trade(1, 1, "t101", "BUY", 10, 5), trade(2, 2, "t101", "SELL", 10, 6)], {"t101": (0, 0)}),
    "merge_reduces_both": ([trade(1, 1, "t101", "BUY", 100, 60), trade(2, 2, "t102", "BUY", 80, 40), wide(3, 3, "MERGE", 50, 50)], {"t101": (50, 0.6), "t102": (30, 0.5)}),
    "split_adds_both": ([wide(1, 1, "SPLIT", 100, -100)], {"t101": (100, 0.5), "t102": (100, 0.5)}),
    "redeem_zeroes": ([trade(1, 1, "t101", "BUY", 10, 5), trade(2, 2, "t102", "BUY", 10, 5), wide(3, 3, "REDEEM", 10, 10)], {"t101": (0, 0), "t102": (0, 0)}),
    "same_ts_tie_id_order": ([trade(1, 100, "t101", "BUY", 10, 5), trade(2, 100, "t101", "SELL", 10, 5), trade(3, 100, "t101", "BUY", 5, 3)], {"t101": (5, 0.6)}),
    "negative_not_clamped": ([trade(1, 1, "t101", "SELL", 10, 5)], {"t101": (-10, 0)}),
    "dust_flat": ([trade(1, 1, "t101", "BUY", 10, 5), trade(2, 2, "t101", "SELL", 9.9999995, 5)], {"t101": (5e-7, 0)}),
    "reward_has_no_effect": ([trade(1, 1, "t101", "BUY", 10, 5), wide(2, 2, "REWARD", 3, 3)], {"t101": (10, 0.5)}),
}


@pytest.mark.parametrize("name", GOLDEN)
def test_holdings_golden(spark, name):
    events, expected = GOLDEN[name]
    tokens = spark.createDataFrame(C, "token_id string, condition_id string, outcome_index long")
    moves = fanout(spark.createDataFrame(events, EVENTS), tokens)
    p = O.running_positions(moves, ["wallet", "token_id"])
    last = p.groupBy("token_id").agg(F.max_by(F.struct("qty", "cost"), F.struct("ts", "id")).alias("s")).select("token_id", "s.*").collect()
    got = {r.token_id: (r.qty, r.cost / r.qty if r.qty > O.EPSILON else 0) for r in last}
    for token, (qty, wac) in expected.items():
        assert got[token] == pytest.approx((qty, wac), abs=1e-9)


def _moves(seed, n=120):
    rng = random.Random(seed)
    kinds = ["add"] * 4 + ["remove"] * 4 + ["reset"]
    return [(i, "w", f"t{rng.randrange(3)}", rng.randrange(40), rng.choice(kinds), float(rng.randrange(1, 20)), float(rng.randrange(1, 15))) for i in range(n)]


MOVES = "id long, wallet string, token_id string, ts long, kind string, shares double, usdc double"


def _fold(rows):
    """Quantity, cost and realized profit after each row of one key, and its episodes."""
    qty = cost = 0.0
    out, eps, open_ = {}, [], None
    for i, _, _, ts, kind, shares, usdc in sorted(rows, key=lambda r: (r[3], r[0])):
        before, cost_before, realized = qty, cost, 0.0
        if kind == "add":
            qty, cost = qty + shares, cost + usdc
        elif kind == "reset":
            realized = usdc - cost if qty > 0 else usdc
            qty = cost = 0.0
        else:
            if qty > 0:
                cost = cost * (qty - shares) / qty if shares < qty else 0.0
                realized = usdc - (cost_before - cost)
            else:
                cost, realized = 0.0, usdc
            qty -= shares
        out[i] = (qty, cost, realized)
        if open_ is None and kind == "reset":
            continue
        if open_ is None:
            open_ = [ts, 0]
        open_[1] += 1
        if kind == "reset" or kind == "remove" and abs(qty) <= 1e-6:
            eps.append((open_[0], ts, "resolution" if kind == "reset" else "flat", open_[1]))
            open_ = None
        del before
    if open_:
        eps.append((open_[0], None, "open", open_[1]))
    return out, eps


@pytest.mark.parametrize("seed", range(4))
def test_positions_and_episodes_against_a_fold(spark, seed):
    rows = _moves(seed)
    p = O.running_positions(spark.createDataFrame(rows, MOVES).repartition(3), ["wallet", "token_id"]).cache()
    got = {r.id: (r.qty, r.cost, r.realized) for r in p.collect()}
    episodes = {}
    for r in O.episodes(p, ["wallet", "token_id"]).orderBy("token_id", "episode").collect():
        episodes.setdefault(r.token_id, []).append((r.open_ts, r.close_ts, r.close_reason, r.n_events))
    for token in {r[2] for r in rows}:
        out, eps = _fold([r for r in rows if r[2] == token])
        for i, state in out.items():
            assert got[i] == pytest.approx(state, abs=1e-8)
        assert episodes[token] == eps


@pytest.mark.parametrize("n, keep", [(2000, 0.1), (10000, 0.9)])
def test_cost_over_a_history_of_any_length(spark, n, keep):
    """Thousands of partial sells without a flat moment between them; the product of ratios underflows many times."""
    rows = [(0, "w", "t0", 0, "add", 10.0, 5.0)]
    sold = round(10.0 * (1 - keep), 6)
    for i in range(1, n + 1):
        rows.append((i, "w", "t0", i, "remove" if i % 2 else "add", sold, sold * (i * 37 % 98 + 1) / 100))
    out, _ = _fold(rows)
    p = O.running_positions(spark.createDataFrame(rows, MOVES).repartition(3), ["wallet", "token_id"])
    for r in p.select("id", "qty", "cost", "realized").collect():
        assert (r.qty, r.cost, r.realized) == pytest.approx(out[r.id], abs=1e-6)


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("bucket", [None, 7])
def test_asof_against_a_scan(spark, forward, bucket):
    rng = random.Random(5)
    left = [(i, f"k{rng.randrange(3)}", rng.randrange(60)) for i in range(60)]
    right = [(f"k{rng.randrange(4)}", rng.randrange(60), float(i)) for i in range(30)]
    f = O.asof_forward if forward else O.asof_backward
    out = f(spark.createDataFrame(left, "id long, k string, ts long"), spark.createDataFrame(right, "k string, ts long, v double"), ["k"], ["v"], bucket_s=bucket)
    got = {r.id: (r.asof_ts, r.v) for r in out.collect()}
    assert len(got) == len(left)
    for i, k, ts in left:
        ok = [(t, v) for kk, t, v in right if kk == k and (t >= ts if forward else t <= ts)]
        best = None
        if ok:
            at = min(t for t, _ in ok) if forward else max(t for t, _ in ok)
            best = at, max(v for t, v in ok if t == at)
        assert got[i] == (best or (None, None))


def test_interval_matches_against_all_pairs(spark):
    rng = random.Random(2)

    def side():
        return [(i, rng.choice("ab"), lo := rng.randrange(100) / 2, lo + rng.randrange(0, 60) / 2) for i in range(40)]

    a, b = side(), side()
    schema = "id long, k string, lo double, hi double"
    for width in (3.0, 1000.0):
        out = O.interval_matches(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["k"], width)
        got = sorted((r.a_id, r.b_id, r.matched) for r in out.collect())
        assert got == sorted((i, j, min(h, z) - max(x, y)) for i, k, x, h in a for j, q, y, z in b if k == q and h > y and z > x and h > x and z > y)


def test_disjoint_matches_against_all_pairs(spark):
    rng = random.Random(11)

    def side():
        rows = []
        for k in "abc":
            at = 0.0
            for _ in range(30):
                at += rng.choice([0, 0, 0.5, 3])  # gaps and none
                size = rng.choice([0, 0.5, 1, 1, 40])
                rows.append((len(rows), k, at, at + size))
                at += size
        return rows

    a, b = side(), side()
    schema = "id long, k string, lo double, hi double"
    out = O.disjoint_matches(spark.createDataFrame(a, schema).repartition(3), spark.createDataFrame(b, schema), ["k"])
    got = sorted((r.a_id, r.b_id, r.matched) for r in out.collect())
    assert got == sorted((i, j, min(h, z) - max(x, y)) for i, k, x, h in a for j, q, y, z in b if k == q and h > y and z > x and h > x and z > y)


def test_ranks_and_weighted_percentiles(spark):
    df = spark.createDataFrame([("a", float(v), float(w)) for v, w in zip([5, 1, 4, 2, 3], [1, 1, 1, 1, 6])], "k string, v double, w double")
    ranks = [O.ranked_values(df, ["k"], "v", {"q": 0.9}, half_even).first().q for half_even in (False, True)]
    assert ranks == [4.0, 5.0]
    r = O.weighted_percentiles(df, ["k"], "v", "w", {"p10": 0.1, "p50": 0.5, "p100": 1.0}).first()
    assert (r.p10, r.p50, r.p100) == (1.0, 3.0, 5.0)


def test_sessions_join_at_the_gap(spark):
    df = spark.createDataFrame([(1, "k", 0), (2, "k", 5), (3, "k", 11), (4, "k", 11)], "id long, k string, ts long")
    assert [r.session for r in O.sessions(df, ["k"], 5).orderBy("id").collect()] == [1, 1, 2, 2]


def test_effective_rule_bounds(spark):
    rules = spark.createDataFrame([("a", 0, 10, 0.1, 1.0), ("a", 10, None, 0.2, 1.0), ("default", 0, None, 0.3, 1.0)], "category string, effective_from long, effective_to long, rate double, exponent double")
    facts = spark.createDataFrame([(1, "a", 9), (2, "a", 10), (3, "b", 5), (4, None, 5)], "id long, category string, ts long")
    assert [r.rate for r in O.effective_rule(facts, rules, "category").orderBy("id").collect()] == [0.1, 0.2, 0.3, 0.3]


def test_regression_against_least_squares(spark):
    import random

    import numpy as np

    from tidemark.plans import strategies

    rng = random.Random(2)
    rows = []
    for i in range(300):
        a, b, c = rng.gauss(3, 2), rng.gauss(0, 1), rng.random()
        rows.append((rng.choice("uv"), a, b + 0.5 * a, c, 2 * a - b + rng.gauss(0, 0.5)))
    rows += [("u", None, 1.0, 1.0, 1.0), ("flat", 1.0, 2.0, 3.0, 4.0), ("flat", 1.0, 2.5, 3.5, 4.5), ("one", 1.0, 2.0, 3.0, 4.0)]
    rows += [("twin", float(i), 2.0 * i, float(i * i), float(i % 3)) for i in range(6)]
    got = {r.k: r for r in strategies.standardised_regression(spark.createDataFrame(rows, "k string, a double, b double, c double, y double"), ["k"], "y", ["a", "b", "c"]).collect()}
    for k in "uv":
        m = np.array([r[1:] for r in rows if r[0] == k and None not in r])
        z = (m - m.mean(0)) / m.std(0)
        beta, rest, *_ = np.linalg.lstsq(z[:, :3], z[:, 3], rcond=None)
        assert got[k].n == len(m) and np.allclose(got[k].beta, beta) and abs(got[k].r2 - (1 - rest[0] / len(m))) < 1e-9
    assert got["flat"].beta is None and got["one"].beta is None and got["twin"].beta is None
