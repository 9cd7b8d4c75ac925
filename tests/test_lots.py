"""Lot matching by composed states against a plain fold with queues."""

from __future__ import annotations

import random
from collections import defaultdict, deque

import pytest

from tidemark.operators import lots
from tidemark.plans import sets

SCHEMA = "wallet string, condition_id string, id long, ts long, kind string, leg int, size double, price double"
KEYS = ["wallet", "condition_id"]


def fold(rows):
    """Matches (lot, buy, shares) and what waits on each leg after all rows."""
    waiting, out = (deque(), deque()), []
    for r in rows:
        left = round(r["size"] * lots.UNIT)
        if r["kind"] == "buy":
            other = waiting[1 - r["leg"]]
            while left and other:
                q = min(left, other[0][0])
                out.append((other[0][1], r["id"], q / lots.UNIT))
                left -= q
                other[0][0] -= q
                if not other[0][0]:
                    other.popleft()
            if left:
                waiting[r["leg"]].append([left, r["id"]])
            continue
        for k in (0, 1) if r["kind"] == "merge" else (r["leg"],):
            left = round(r["size"] * lots.UNIT)
            while left and waiting[k]:
                q = min(left, waiting[k][0][0])
                left -= q
                waiting[k][0][0] -= q
                if not waiting[k][0][0]:
                    waiting[k].popleft()
    return out, [sum(x[0] for x in leg) for leg in waiting]


def made(seed, n, sizes=(1.0, 2.0, 2.5, 10.0, 0.000001, 0.0)):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rng.choices(["buy", "sell", "merge"], [5, 3, 1])[0]
        leg = None if kind == "merge" else rng.choice([0, 1])
        rows.append(dict(wallet=rng.choice(["w", "v"]), condition_id="c", id=i, ts=rng.randrange(n), kind=kind, leg=leg, size=rng.choice(sizes), price=0.3))
    return rows


@pytest.mark.parametrize("cell", [1, 7, 40, 10_000])
def test_same_as_a_fold(spark, cell):
    rows = made(cell, 400)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA).repartition(3)
    states = lots.waiting_states(df, KEYS, cell)
    got = defaultdict(list)
    for r in lots.consuming_matches(states, KEYS).collect():
        got[r.wallet].append((r.a_id, r.b_id, r.matched))
    last = {}
    for r in sorted(states.collect(), key=lambda r: (r.ts, r.id)):
        last[r.wallet] = r.state
    for wallet in ("w", "v"):
        own = sorted((r for r in rows if r["wallet"] == wallet), key=lambda r: (r["ts"], r["id"]))
        want, left = fold(own)
        assert sorted(got[wallet]) == sorted(want)
        assert last[wallet] == left[0] - left[1] and not (left[0] and left[1])


def test_functions_of_stretches():
    """The function of a stretch gives what walking it gives, from every start."""
    rng = random.Random(5)
    for _ in range(60):
        moves = []
        for _ in range(rng.randrange(12)):
            q = rng.randrange(6)
            moves.append(rng.choice([(0, 0, q), (0, 0, -q), (0, q, 0), (-q, 0, 0), (-q, q, 0)]))
        x, y = [0], [0]
        for m in moves:
            x, y = lots._through(x, y, *m)
        for start in range(-40, 41):
            s = start
            for low, high, by in moves:
                s += by - min(max(s, low), high)
            assert lots._value(x, y, s=start) == s


def test_by_hand(spark):
    """A buy of 100 waits, 60 of the other leg meet it ten seconds later, a merge of 30 uses up what is left but for 10."""
    rows = [("w", "c", 1, 0, "buy", 0, 100.0, 0.4), ("w", "c", 2, 10, "buy", 1, 60.0, 0.5), ("w", "c", 3, 20, "merge", None, 30.0, None)]
    states = lots.waiting_states(spark.createDataFrame(rows, SCHEMA), KEYS)
    (m,) = lots.consuming_matches(states, KEYS, ("ts", "price")).collect()
    assert (m.a_id, m.b_id, m.leg, m.matched, m.b_ts - m.a_ts, m.a_price, m.b_price) == (1, 2, 0, 60.0, 10, 0.4, 0.5)
    assert states.orderBy("ts").collect()[-1].state == 10 * lots.UNIT


def test_no_events(spark):
    states = lots.waiting_states(spark.createDataFrame([], SCHEMA), KEYS)
    assert states.collect() == [] and lots.consuming_matches(states, KEYS).collect() == []


def test_orphans_add_up(spark):
    """Of each wallet and resolved market: complete sets and the unmatched rest make up what was held."""
    for r in sets.set_orphans(spark, "/root/testdata/sf0.001").collect():
        assert min(r.qty0_at_resolution, r.qty1_at_resolution, 0) or r.matched_at_resolution == pytest.approx(min(r.qty0_at_resolution, r.qty1_at_resolution))
        gap = abs(r.qty0_at_resolution - r.qty1_at_resolution)
        assert r.unmatched_winner_qty + r.unmatched_loser_qty == pytest.approx(gap if r.winner_token else 0, abs=1e-3)


def test_stretches_stay_whole_over_many_files(spark, tmp_path):
    """Events read from many files, and too large to be broadcast when the plan is made, as large tables are."""
    rows = made(3, 3000)
    path = str(tmp_path / "events")
    spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA).repartition(8).write.parquet(path)
    limits = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "20k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    try:
        for k, v in limits.items():
            spark.conf.set(k, v)
        got = {(r.wallet, r.id): (r.state_before, r.state) for r in lots.waiting_states(spark.read.parquet(path), KEYS, 500).collect()}
    finally:
        for k in limits:
            spark.conf.unset(k)
    want, state = {}, {}
    for r in sorted(rows, key=lambda r: (r["ts"], r["id"])):
        q, s = round(r["size"] * lots.UNIT), state.get(r["wallet"], 0)
        if r["kind"] == "buy":
            to = s + q if r["leg"] == 0 else s - q
        elif s > 0 and r["leg"] != 1:
            to = max(s - q, 0)
        else:
            to = min(s + q, 0) if s < 0 and r["leg"] != 0 else s
        want[r["wallet"], r["id"]] = s, to
        state[r["wallet"]] = to
    assert got == want
