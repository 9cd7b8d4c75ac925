"""Audit of completed sets: how the two legs of a market meet, what was waiting, and what was held when the market was resolved."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import lots
from tidemark.operators import ordered as O
from tidemark.operators.storage import stored
from tidemark.plans import accounting as A
from tidemark.plans.views import POSITIONS, ledger, markets, r4, sql, tokens

KEYS = ["wallet", "condition_id"]
#: Price of an outcome from which it counts as the winner.
WINNER = 0.99


def lot_events(spark, sf_dir):
    """Trades and merges as the lot matching reads them."""
    kind = F.when(F.col("event_type") == "MERGE", "merge").when(F.col("side") == "BUY", "buy").otherwise("sell")
    leg = F.when(F.col("event_type") == "TRADE", F.col("outcome_index").cast("int"))
    t = ledger(spark, sf_dir).where("event_type in ('TRADE', 'MERGE')")
    return t.select("wallet", "condition_id", "id", "ts", kind.alias("kind"), leg.alias("leg"), "size", "price")


def _states(spark, sf_dir):
    return stored(lots.waiting_states(lot_events(spark, sf_dir), KEYS))


def _matches(states):
    m = lots.consuming_matches(states, KEYS, ("ts", "price"))
    edge = F.col("matched") * (1 - F.col("a_price") - F.col("b_price"))
    return m.select(*KEYS, "matched", (F.col("b_ts") - F.col("a_ts")).alias("wait_s"), edge.alias("edge"))


def fifo_consuming_lots(spark, sf_dir):
    """Two-leg first-in-first-out matching: a buy meets waiting lots of the other leg; sells and merges use up own lots."""
    states = _states(spark, sf_dir)
    left = states.groupBy(*KEYS).agg((F.abs(F.max_by("state", F.struct("ts", "id"))) / lots.UNIT).alias("waiting"))
    waited = F.sum(F.col("matched") * F.col("wait_s"))
    m = _matches(states).groupBy(*KEYS).agg(F.sum("matched").alias("m"), F.sum("edge").alias("e"), waited.alias("w"))
    out = left.join(m, KEYS, "left")
    z = F.lit(0.0)
    return out.select(*KEYS, r4(F.coalesce("m", z), "matched"), r4(F.coalesce("e", z), "edge"), r4(F.col("w") / F.col("m"), "mean_wait_s"), r4("waiting"))


def completion_set_audit(spark, sf_dir):
    """Matched sets against merges by category: what was completed, merged, and left over."""
    found = fifo_consuming_lots(spark, sf_dir)
    merged = ledger(spark, sf_dir).where("event_type = 'MERGE'").groupBy(*KEYS).agg(F.sum("size").alias("merged"))
    j = found.join(merged, KEYS, "full").join(markets(spark).select("condition_id", "category"), "condition_id", "left")
    z = F.lit(0.0)
    merged, matched = F.round(F.coalesce("merged", z), 4), F.coalesce("matched", z)
    return j.groupBy(F.coalesce("category", F.lit("unclassified")).alias("category")).agg(
        F.count("*").alias("n"), r4(F.sum(matched), "matched"), r4(F.sum(merged), "merged"), r4(F.sum(F.coalesce("waiting", z)), "orphans"), F.count_if(merged > matched).alias("n_over_merged")
    )


def _temporal(matches, events):
    """For each key what was bought on each leg and how long its matched sets waited for their second leg."""
    bought = [F.sum(F.when((F.col("kind") == "buy") & (F.col("leg") == k), F.col("size")).otherwise(0.0)).alias(f"buy{k}") for k in (0, 1)]
    g = events.groupBy(*KEYS).agg(*bought)
    m = matches.groupBy(*KEYS).agg(
        F.sum("matched").alias("m"), F.sum(F.col("matched") * F.col("wait_s")).alias("w"), F.max("wait_s").alias("longest"),
        F.sum(F.when(F.col("wait_s") <= 60, F.col("matched")).otherwise(0.0)).alias("soon"),
    )
    most = F.greatest("buy0", "buy1")
    out = g.join(m, KEYS, "left").withColumn("gap", F.round(F.abs(F.col("buy0") - F.col("buy1")), 6))
    return out.withColumn("ratio", F.when(most > 0, F.col("gap") / most).otherwise(0.0))


def set_temporal(spark, sf_dir):
    """Temporal audit of each (wallet, market): bought quantities, their imbalance, and the seconds between the legs of matched sets."""
    t = _temporal(_matches(_states(spark, sf_dir)), lot_events(spark, sf_dir))
    t = t.join(markets(spark).select("condition_id", "category"), "condition_id", "left")
    z = F.lit(0.0)
    return t.select(
        *KEYS, F.coalesce("category", F.lit("unclassified")).alias("category"), r4("buy0", "token0_qty"), r4("buy1", "token1_qty"), r4(F.coalesce("m", z), "matched_pair_qty"), r4("gap", "directional_imbalance_qty"), r4("ratio", "imbalance_ratio"),
        r4(F.coalesce(F.col("w") / F.col("m"), z), "mean_seconds_between_legs"), F.coalesce("longest", F.lit(0)).cast("long").alias("max_seconds_between_legs"), r4(F.coalesce(F.col("soon") / F.col("m") * 100, z), "pct_pairs_under_60s"),
    )


def _orphans(spark, sf_dir):
    p = A.positions(spark, sf_dir)
    legs = A.token_prices(spark).join(tokens(spark).select("token_id", F.col("outcome_index").alias("leg")), "token_id")
    binary = legs.join(tokens(spark).select("token_id", "condition_id"), "token_id").groupBy("condition_id").agg(
        F.count("*").alias("n"), F.max_by("token_id", F.when(F.col("res_price") >= WINNER, F.col("leg"))).alias("winner"), F.max(F.when(F.col("res_price") >= WINNER, F.col("leg"))).alias("winner_leg")
    )
    own = p.join(legs.select("token_id", "leg", "res_price"), "token_id")
    order = F.struct("ts", "id")
    first = F.min(F.when(F.col("kind") == "reset", F.struct("ts", "id", "qty_before")))["qty_before"]
    held = own.groupBy(*KEYS, "leg").agg(F.coalesce(first, F.max_by("qty", order)).alias("q"))
    held = held.groupBy(*KEYS).agg(*(F.sum(F.when(F.col("leg") == k, F.col("q")).otherwise(0.0)).alias(f"q{k}") for k in (0, 1)))
    positive = F.greatest("qty_before", F.lit(0.0))
    paid = F.when(F.col("usdc") == 0, positive * F.col("res_price")).otherwise(F.col("usdc"))
    closed = own.where("kind = 'reset'").groupBy(*KEYS).agg(
        F.sum(positive).alias("redeem_qty"), F.sum(paid).alias("redeem_usdc"), F.sum(F.when(F.col("qty_before") > 0, F.col("cost_before")).otherwise(0.0)).alias("redeem_cost")
    )
    out = held.join(binary.where("n = 2"), "condition_id").join(closed, KEYS, "left").fillna(0.0, ["redeem_qty", "redeem_usdc", "redeem_cost"])
    gap = F.abs(F.col("q0") - F.col("q1"))
    side = F.when(F.col("q0") > F.col("q1"), 0).otherwise(1)
    won = side == F.col("winner_leg")
    return out.withColumns(
        {
            "matched": F.greatest(F.least("q0", "q1"), F.lit(0.0)), "unmatched_winner": F.when(won, gap).otherwise(0.0),
            "unmatched_loser": F.when(F.col("winner_leg").isNotNull() & ~won, gap).otherwise(0.0),
        }
    )


def set_orphans(spark, sf_dir):
    """Each (wallet, resolved market): what was held of both legs when the market was first redeemed (or is held now), the complete
    sets among it, what remained of the winning or losing leg, and what redeeming paid and had cost."""
    o = _orphans(spark, sf_dir).join(markets(spark).select("condition_id", "category"), "condition_id", "left")
    names = {"redeem_qty": "redeem_qty", "redeem_usdc": "redeem_payout_usdc", "redeem_cost": "cost_basis_of_redeemed_qty", "q0": "qty0_at_resolution", "q1": "qty1_at_resolution", "matched": "matched_at_resolution", "unmatched_winner": "unmatched_winner_qty", "unmatched_loser": "unmatched_loser_qty"}
    return o.select(*KEYS, F.coalesce("category", F.lit("unclassified")).alias("category"), F.coalesce("winner", F.lit("")).alias("winner_token"), *(r4(c, n) for c, n in names.items()), (F.col("matched") > 1e-6).alias("ambiguous"))


def set_summary(spark, sf_dir):
    """For each wallet: waiting times of matched lots (by count), imbalance across its markets, and its orphans on resolved markets."""
    matches = stored(_matches(_states(spark, sf_dir)))
    t = stored(_temporal(matches, lot_events(spark, sf_dir)))
    pct = {k: F.round(F.count_if(F.col("wait_s") <= k) / F.count("*") * 100, 4).alias(f"pct_under_{k}s") for k in (60, 300)}
    waits = matches.groupBy("wallet").agg(F.count("*").alias("n_matched_lots"), *pct.values())
    at = O.ranked_values(matches, ["wallet"], "wait_s", {"p50_seconds": 0.5, "p90_seconds": 0.9, "p99_seconds": 0.99})
    gaps = O.ranked_values(t, ["wallet"], "gap", {"imbalance_qty_p50": 0.5, "imbalance_qty_p90": 0.9, "imbalance_qty_max": 1.0})
    ratios = O.ranked_values(t, ["wallet"], "ratio", {"imbalance_ratio_p50": 0.5, "imbalance_ratio_p90": 0.9})
    o = _orphans(spark, sf_dir)
    won, lost = F.sum("unmatched_winner"), F.sum("unmatched_loser")
    share = F.when(F.round(won + lost, 6) > 0, won / (won + lost) * 100).otherwise(0.0)
    orphans = o.groupBy("wallet").agg(
        F.count("*").alias("resolved_markets"), r4(won, "unmatched_winner_qty"), r4(lost, "unmatched_loser_qty"),
        r4(F.sum(F.when(F.col("winner").isNotNull(), F.col("matched")).otherwise(0.0)), "ambiguous_matched_qty"), r4(share, "pct_unmatched_residual_winner"),
    )
    out = t.select("wallet").distinct()
    for part in (waits, at, gaps, ratios, orphans):
        out = out.join(part, "wallet", "left")
    rounded = {c: r4(c) for c in ("imbalance_qty_p50", "imbalance_qty_p90", "imbalance_qty_max", "imbalance_ratio_p50", "imbalance_ratio_p90")}
    return out.withColumns(rounded)


QUERIES = {f.__name__: f for f in (fifo_consuming_lots, completion_set_audit, set_temporal, set_orphans, set_summary)}

#: The states by recursion over the events of a key, then lots and what uses them up as intervals of cumulative quantity.
_LOTS = """
le AS (SELECT wallet, condition_id, id, ts, price, size, CASE WHEN event_type = 'MERGE' THEN 'merge' WHEN side = 'BUY' THEN 'buy' ELSE 'sell' END AS kind, CASE WHEN event_type = 'TRADE' THEN outcome_index END AS leg,
   round(size * 1000000)::BIGINT AS q, row_number() OVER (PARTITION BY wallet, condition_id ORDER BY ts, id) AS rn FROM ledger WHERE event_type IN ('TRADE', 'MERGE')),
st AS (SELECT DISTINCT wallet, condition_id, 0::BIGINT AS rn, 0::BIGINT AS s0, 0::BIGINT AS s FROM le UNION ALL
   SELECT le.wallet, le.condition_id, le.rn, st.s, CASE WHEN kind = 'buy' AND leg = 0 THEN st.s + q WHEN kind = 'buy' THEN st.s - q WHEN st.s > 0 AND (kind = 'merge' OR leg = 0) THEN greatest(st.s - q, 0) WHEN st.s < 0 AND (kind = 'merge' OR leg = 1) THEN least(st.s + q, 0) ELSE st.s END
   FROM st JOIN le ON le.wallet = st.wallet AND le.condition_id = st.condition_id AND le.rn = st.rn + 1),
ls AS (SELECT le.*, s0, s FROM le JOIN st USING (wallet, condition_id, rn)),
la AS (SELECT *, sum(n) OVER (PARTITION BY wallet, condition_id, leg ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS hi FROM (SELECT *, greatest(least(CASE WHEN leg = 0 THEN s ELSE -s END, q), 0) AS n FROM ls WHERE kind = 'buy') WHERE n > 0),
lb AS (SELECT *, sum(n) OVER (PARTITION BY wallet, condition_id, wl ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS hi FROM
   (SELECT *, CASE WHEN s0 > 0 THEN 0 ELSE 1 END AS wl, abs(s0) - CASE WHEN sign(s) = sign(s0) THEN abs(s) ELSE 0 END AS n FROM ls WHERE s0 <> 0) WHERE n > 0 AND (kind <> 'buy' OR leg <> wl)),
lm AS (SELECT a.wallet, a.condition_id, (least(a.hi, b.hi) - greatest(a.hi - a.n, b.hi - b.n))::BIGINT / 1000000.0::DOUBLE AS matched, b.ts - a.ts AS wait_s, 1 - a.price - b.price AS per FROM la a JOIN lb b ON a.wallet = b.wallet AND a.condition_id = b.condition_id AND a.leg = b.wl AND b.kind = 'buy' AND a.hi > b.hi - b.n AND b.hi > a.hi - a.n),
lw AS (SELECT wallet, condition_id, abs(arg_max(s, rn)) / 1000000.0::DOUBLE AS waiting FROM ls GROUP BY 1, 2),
lf AS (SELECT wallet, condition_id, round(coalesce(m, 0), 4) + 0 AS matched, round(coalesce(e, 0), 4) + 0 AS edge, round(w / m, 4) + 0 AS mean_wait_s, round(waiting, 4) + 0 AS waiting FROM lw LEFT JOIN (SELECT wallet, condition_id, sum(matched) AS m, sum(matched * per) AS e, sum(matched * wait_s) AS w FROM lm GROUP BY 1, 2) USING (wallet, condition_id)),
lt AS (SELECT *, CASE WHEN greatest(b0, b1) > 0 THEN gap / greatest(b0, b1) ELSE 0 END AS ratio FROM (SELECT *, round(abs(b0 - b1), 6) AS gap FROM
   (SELECT wallet, condition_id, sum(CASE WHEN kind = 'buy' AND leg = 0 THEN size ELSE 0 END) AS b0, sum(CASE WHEN kind = 'buy' AND leg = 1 THEN size ELSE 0 END) AS b1 FROM le GROUP BY 1, 2)
   LEFT JOIN (SELECT wallet, condition_id, sum(matched) AS m, sum(matched * wait_s) AS w, max(wait_s) AS longest, sum(CASE WHEN wait_s <= 60 THEN matched ELSE 0 END) AS soon FROM lm GROUP BY 1, 2) USING (wallet, condition_id)))"""
_ORPHANS = """
tp AS (SELECT token_id, condition_id, outcome_index AS leg, CASE WHEN outcome_index = 0 THEN price0 ELSE 1 - price0 END AS res_price FROM tokens JOIN markets USING (condition_id) WHERE closed),
bn AS (SELECT condition_id, max(CASE WHEN res_price >= 0.99 THEN token_id END) AS winner, max(CASE WHEN res_price >= 0.99 THEN leg END) AS winner_leg FROM tp GROUP BY 1 HAVING count(*) = 2),
ow AS (SELECT p.*, leg, res_price FROM positions p JOIN tp USING (token_id)),
h1 AS (SELECT wallet, condition_id, leg, coalesce(arg_min(qty_before, (ts, id)) FILTER (kind = 'reset'), arg_max(qty, (ts, id))) AS q FROM ow GROUP BY 1, 2, 3),
h2 AS (SELECT wallet, condition_id, sum(CASE WHEN leg = 0 THEN q ELSE 0 END) AS q0, sum(CASE WHEN leg = 1 THEN q ELSE 0 END) AS q1 FROM h1 GROUP BY 1, 2),
cl AS (SELECT wallet, condition_id, sum(greatest(qty_before, 0)) AS redeem_qty, sum(CASE WHEN usdc = 0 THEN greatest(qty_before, 0) * res_price ELSE usdc END) AS redeem_usdc, sum(CASE WHEN qty_before > 0 THEN cost_before ELSE 0 END) AS redeem_cost FROM ow WHERE kind = 'reset' GROUP BY 1, 2),
orph AS (SELECT *, greatest(least(q0, q1), 0) AS matched, CASE WHEN side = winner_leg THEN gap ELSE 0 END AS uw, CASE WHEN winner_leg IS NOT NULL AND side <> winner_leg THEN gap ELSE 0 END AS ul
   FROM (SELECT *, abs(q0 - q1) AS gap, CASE WHEN q0 > q1 THEN 0 ELSE 1 END AS side FROM h2 JOIN bn USING (condition_id) LEFT JOIN cl USING (wallet, condition_id)))"""


def _recursive(body: str, *more: str) -> str:
    return "WITH RECURSIVE" + sql(body, *more).removeprefix("WITH")


def _pick(value: str, q: str, name: str) -> str:
    return f"list_sort(list({value}))[floor((count(*) - 1) * {q})::INT + 1] AS {name}"


ORACLE = {
    "fifo_consuming_lots": _recursive("SELECT * FROM lf", _LOTS),
    "completion_set_audit": _recursive("""SELECT coalesce(category, 'unclassified') AS category, count(*) AS n, round(sum(coalesce(matched, 0)), 4) + 0 AS matched, round(sum(round(coalesce(mg, 0), 4)), 4) + 0 AS merged, round(sum(coalesce(waiting, 0)), 4) + 0 AS orphans, count(*) FILTER (round(coalesce(mg, 0), 4) > coalesce(matched, 0)) AS n_over_merged
FROM lf FULL JOIN (SELECT wallet, condition_id, sum(size) AS mg FROM ledger WHERE event_type = 'MERGE' GROUP BY 1, 2) USING (wallet, condition_id) LEFT JOIN (SELECT condition_id, category FROM markets) USING (condition_id) GROUP BY 1""", _LOTS),
    "set_temporal": _recursive("""SELECT wallet, condition_id, coalesce(category, 'unclassified') AS category, round(b0, 4) + 0 AS token0_qty, round(b1, 4) + 0 AS token1_qty, round(coalesce(m, 0), 4) + 0 AS matched_pair_qty, round(gap, 4) + 0 AS directional_imbalance_qty, round(ratio, 4) + 0 AS imbalance_ratio,
round(coalesce(w / m, 0), 4) + 0 AS mean_seconds_between_legs, coalesce(longest, 0)::BIGINT AS max_seconds_between_legs, round(coalesce(soon / m * 100, 0), 4) + 0 AS pct_pairs_under_60s FROM lt LEFT JOIN (SELECT condition_id, category FROM markets) USING (condition_id)""", _LOTS),
    "set_orphans": sql("""SELECT wallet, condition_id, category, coalesce(winner, '') AS winner_token, round(coalesce(redeem_qty, 0), 4) + 0 AS redeem_qty, round(coalesce(redeem_usdc, 0), 4) + 0 AS redeem_payout_usdc, round(coalesce(redeem_cost, 0), 4) + 0 AS cost_basis_of_redeemed_qty, round(q0, 4) + 0 AS qty0_at_resolution, round(q1, 4) + 0 AS qty1_at_resolution,
round(matched, 4) + 0 AS matched_at_resolution, round(uw, 4) + 0 AS unmatched_winner_qty, round(ul, 4) + 0 AS unmatched_loser_qty, matched > 1e-6 AS ambiguous FROM orph JOIN (SELECT condition_id, category FROM markets) USING (condition_id)""", POSITIONS, _ORPHANS),
    "set_summary": _recursive(f"""SELECT * FROM (SELECT wallet, {_pick('gap', '0.5', 'a')}, {_pick('gap', '0.9', 'b')}, {_pick('gap', '1.0', 'c')}, {_pick('ratio', '0.5', 'd')}, {_pick('ratio', '0.9', 'e')}, round(a, 4) + 0 AS imbalance_qty_p50, round(b, 4) + 0 AS imbalance_qty_p90, round(c, 4) + 0 AS imbalance_qty_max, round(d, 4) + 0 AS imbalance_ratio_p50, round(e, 4) + 0 AS imbalance_ratio_p90 FROM lt GROUP BY 1)
LEFT JOIN (SELECT wallet, count(*) AS n_matched_lots, round(count(*) FILTER (wait_s <= 60) / count(*) * 100, 4) AS pct_under_60s, round(count(*) FILTER (wait_s <= 300) / count(*) * 100, 4) AS pct_under_300s, {_pick('wait_s', '0.5', 'p50_seconds')}, {_pick('wait_s', '0.9', 'p90_seconds')}, {_pick('wait_s', '0.99', 'p99_seconds')} FROM lm GROUP BY 1) USING (wallet)
LEFT JOIN (SELECT wallet, count(*) AS resolved_markets, round(sum(uw), 4) + 0 AS unmatched_winner_qty, round(sum(ul), 4) + 0 AS unmatched_loser_qty, round(sum(CASE WHEN winner IS NOT NULL THEN matched ELSE 0 END), 4) + 0 AS ambiguous_matched_qty, round(CASE WHEN round(sum(uw) + sum(ul), 6) > 0 THEN sum(uw) / (sum(uw) + sum(ul)) * 100 ELSE 0 END, 4) + 0 AS pct_unmatched_residual_winner FROM orph GROUP BY 1) USING (wallet)""".replace("SELECT * FROM (SELECT wallet", "SELECT * EXCLUDE (a, b, c, d, e) FROM (SELECT wallet"), _LOTS, POSITIONS, _ORPHANS),
}
