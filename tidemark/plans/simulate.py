"""Counterfactual simulation: sequential state per key in Arrow-batched functions, everything around it relational.

Decisions see only what was known before a fill. A simulation is a left fold, so it runs once for each (wallet, condition,
scenario) as a grouped function; wallets, conditions, scenarios and parameters are independent and run side by side, and
a wallet with millions of fills is spread over its conditions.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.plans import behaviour as B
from tidemark.plans import matching as M
from tidemark.plans.views import POSITIONS, ledger, markets, r4, sql

#: Fill assumptions: share of a book's depth that fills, slippage, oldest book in seconds, orders of five that fill.
SCENARIOS = {"optimistic": (1.0, 0.0, 7200, 5), "medium": (0.6, 0.005, 3600, 4), "conservative": (0.3, 0.01, 1800, 2)}
FEE_RATE = 0.002
ALLOWED = ["id", "wallet", "condition_id", "event_id", "trade_ts", "outcome_index", "side", "fill_price", "fill_shares", "book_age_s", "spread_bps", "mid"]


def decisions(spark, sf_dir):
    """What a simulated strategy may look at: one row for each fill that it could react to."""
    d = M.microstructure_dataset(spark, sf_dir)
    return d.select(
        "id", "wallet", "condition_id", F.coalesce("event_id", F.lit("-")).alias("event_id"), "trade_ts",
        "outcome_index", "side", "fill_price", "fill_shares", F.col("book_before_age_s").alias("book_age_s"), "spread_bps", "mid",
    )


def fold_spread_capture(rows, scenario: str, min_spread: float = 200.0, order: float = 10.0, cap: float = 100.0, budget: float = 100.0) -> dict:
    """Buy below the mid when the spread is wide, sell when inventory is there; ``rows`` are dicts in order of time."""
    depth, slip, oldest, of_five = SCENARIOS[scenario]
    cash = qty = cost = realized = peak = drawdown = most = fees = 0.0
    n = {"orders": 0, "fills": 0, "no_book": 0, "stale": 0, "narrow": 0, "risk": 0, "gate": 0}
    mark = 0.0
    for r in rows:
        if r["mid"] is None or r["mid"] != r["mid"]:
            n["no_book"] += 1
            continue
        mark = r["mid"]
        equity = cash + qty * mark
        peak = max(peak, equity)
        drawdown = max(drawdown, peak - equity)
        if r["spread_bps"] < min_spread:
            n["narrow"] += 1
            continue
        if r["book_age_s"] > oldest:
            n["stale"] += 1
            continue
        sell = qty > 0 and r["side"] == "BUY"
        if not sell and (qty + order > cap or -cash + order * mark > budget):
            n["risk"] += 1
            continue
        n["orders"] += 1
        if n["orders"] % 5 >= of_five:
            n["gate"] += 1
            continue
        size = min(order, r["fill_shares"] * depth, qty if sell else order)
        price = mark - slip if sell else mark + slip
        fee = FEE_RATE * size * price
        fees += fee
        n["fills"] += 1
        if sell:
            released = cost * size / qty
            realized += size * price - released - fee
            cost -= released
            qty -= size
            cash += size * price - fee
        else:
            realized -= fee
            cost += size * price
            qty += size
            cash -= size * price + fee
        most = max(most, qty)
    return n | {"qty": qty, "realized": realized, "unrealized": qty * mark - cost, "drawdown": drawdown, "max_inventory": most, "fees": fees}


_OUT = "wallet string, condition_id string, event_id string, scenario string, min_spread double, split string, orders long, fills long, no_book long, stale long, narrow long, risk long, gate long, qty double, realized double, unrealized double, drawdown double, max_inventory double, fees double"


def _simulate(df, keys: list[str]):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["trade_ts", "id"])
        own = dict(zip(keys, key))
        rows = pdf[["mid", "spread_bps", "book_age_s", "side", "fill_shares"]].to_dict("records")
        return pd.DataFrame([own | fold_spread_capture(rows, own["scenario"], own["min_spread"])])

    return df.groupBy(*keys).applyInPandas(run, _OUT)


_KEYS = ["wallet", "condition_id", "event_id", "scenario", "min_spread", "split"]


def _runs(spark, sf_dir):
    d = decisions(spark, sf_dir).withColumn("scenario", F.explode(F.array(*map(F.lit, SCENARIOS))))
    return _simulate(d.withColumns({"min_spread": F.lit(200.0), "split": F.lit("all")}), _KEYS)


def sim_spread_capture(spark, sf_dir):
    g = _runs(spark, sf_dir).groupBy("wallet", "scenario")
    sums = [F.sum(c).alias(c) for c in ("orders", "fills", "no_book", "stale", "narrow", "risk", "gate")]
    return g.agg(*sums, r4(F.sum("realized"), "realized"), r4(F.sum("unrealized"), "unrealized"), r4(F.max("drawdown"), "worst_drawdown"), r4(F.sum("fees"), "fees"))


def sim_attribution(spark, sf_dir):
    """Profit of the medium scenario by event: markets, sum, and the share of the largest market in absolute profit."""
    m = _runs(spark, sf_dir).where("scenario = 'medium'").withColumn("pnl", F.col("realized") + F.col("unrealized"))
    rank = F.row_number().over(Window.partitionBy("event_id").orderBy(F.desc(F.abs("pnl")), "wallet", "condition_id"))
    g = m.withColumn("rank", rank).groupBy("event_id").agg(
        F.countDistinct("condition_id").alias("n_markets"), F.sum("pnl").alias("p"), F.sum(F.abs("pnl")).alias("a"), F.sum(F.when(F.col("rank") <= 1, F.abs("pnl")).otherwise(0.0)).alias("top")
    )
    return g.select("event_id", "n_markets", r4("p", "pnl"), r4(F.try_divide("top", F.nullif(F.col("a"), F.lit(0.0))), "top1_share"))


def sim_skip_funnel(spark, sf_dir):
    """How many decisions each gate of the simulator stopped, by scenario."""
    r = _runs(spark, sf_dir)
    gates = ["no_book", "narrow", "stale", "risk", "gate", "fills"]
    tall = r.select("scenario", F.explode(F.array(*(F.struct(F.lit(g).alias("gate"), F.col(g).alias("n")) for g in gates))).alias("x"))
    return tall.groupBy("scenario", F.col("x.gate").alias("gate")).agg(F.sum("x.n").alias("n"))


def fold_inventory_cycling(rows, most_ask: float = 0.98, order: float = 10.0, cap: float = 200.0) -> dict:
    """Buy the leg that completes sets while a set costs less than one; merge sets at once and use the cash again."""
    qty, cost = [0.0, 0.0], [0.0, 0.0]
    spent = merged = profit = 0.0
    last = [None, None]
    buys = 0
    for r in rows:
        k = int(r["outcome_index"])
        last[k] = r["fill_price"]
        if last[1 - k] is None or last[k] + last[1 - k] > most_ask or qty[k] > qty[1 - k] or spent + order * last[k] > cap:
            continue
        qty[k] += order
        cost[k] += order * last[k]
        spent += order * last[k]
        buys += 1
        sets = min(qty)
        if sets > 0:
            basis = sum(c * sets / q for c, q in zip(cost, qty))
            cost = [c - c * sets / q for c, q in zip(cost, qty)]
            qty = [q - sets for q in qty]
            merged += sets
            profit += sets - basis
            spent -= basis
    return {"buys": buys, "merged": merged, "profit": profit, "left0": qty[0], "left1": qty[1], "left_cost": sum(cost)}


def sim_inventory_cycling(spark, sf_dir):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["ts", "id"])[["outcome_index", "fill_price"]].to_dict("records")
        return pd.DataFrame([{"wallet": key[0], "condition_id": key[1]} | fold_inventory_cycling(rows)])

    t = ledger(spark, sf_dir).where("event_type = 'TRADE'").select("id", "ts", "wallet", "condition_id", "outcome_index", F.col("price").alias("fill_price"))
    out = t.groupBy("wallet", "condition_id").applyInPandas(run, "wallet string, condition_id string, buys long, merged double, profit double, left0 double, left1 double, left_cost double")
    m = markets(spark).select("condition_id", "price0")
    out = out.join(m, "condition_id", "left")  # what is left is redeemed at the outcome, if there is one
    redeemed = F.coalesce(F.col("left0") * F.col("price0") + F.col("left1") * (1 - F.col("price0")), F.lit(0.0))
    return out.select("wallet", "condition_id", "buys", r4("merged"), r4("profit"), r4(redeemed, "redeemed"), r4("left_cost"))


def strategy_search(spark, sf_dir):
    """Grid of spread thresholds of every wallet on train and validation; the survivors ranked by their worse split, tested once."""
    d = B._split_dataset(spark, sf_dir).select("id", "split")
    rows = decisions(spark, sf_dir).join(d, "id")
    rows = rows.withColumn("min_spread", F.explode(F.array(*(F.lit(float(x)) for x in (100, 200, 400, 800)))))
    rows = rows.withColumn("scenario", F.explode(F.array(F.lit("medium"), F.lit("conservative"))))
    r = _simulate(rows, _KEYS).withColumn("pnl", F.col("realized") + F.col("unrealized"))
    g = r.groupBy("wallet", "scenario", "min_spread").pivot("split", ["train", "validation", "test"]).agg(F.sum("pnl").alias("pnl"), F.sum("fills").alias("fills"), F.max("drawdown").alias("drawdown"))
    worse = F.least("train_pnl", "validation_pnl") - 0.5 * F.greatest("train_drawdown", "validation_drawdown") - F.abs(F.col("train_pnl") - F.col("validation_pnl")) / 10
    g = g.withColumn("score", F.round(worse, 6)).withColumn("passes", (F.col("train_fills") > 0) & (F.col("validation_fills") > 0))
    order = Window.partitionBy("wallet").orderBy(F.desc("passes"), F.desc("score"), F.desc("train_fills"), "scenario", "min_spread")  # the grid's rows
    return g.select("wallet", "scenario", "min_spread", r4("train_pnl"), r4("validation_pnl"), r4("test_pnl"), r4("score"), F.row_number().over(order).alias("rank"))


def search_holdout_breakdown(spark, sf_dir):
    """Markouts of the holdout's fills by bucket of price, age and hour: where a rule fails."""
    d = B._split_dataset(spark, sf_dir).where("split = 'test'")
    buckets = F.array(
        F.concat(F.lit("price:"), F.floor(F.col("fill_price") * 5)), F.concat(F.lit("side:"), "side"), F.concat(F.lit("hour:"), F.floor(F.col("trade_hour") / 6)),
        F.concat(F.lit("age:"), F.when(F.col("book_before_age_s") <= 600, "fresh").when(F.col("book_before_age_s") <= 3600, "hour").otherwise("old")),
        F.concat(F.lit("spread:"), F.when(F.col("spread_bps") < 200, "narrow").when(F.col("spread_bps") < 800, "mid").otherwise("wide")),
    )
    x = d.select("markout_1h", F.explode(buckets).alias("bucket")).where("bucket is not null")
    return x.groupBy("bucket").agg(F.count("*").alias("n"), F.count("markout_1h").alias("n_markout"), r4(F.avg("markout_1h"), "avg_markout"))


QUERIES = {
    f.__name__: f
    for f in (
        sim_spread_capture, sim_attribution, sim_skip_funnel, sim_inventory_cycling, strategy_search, search_holdout_breakdown,
    )
}
ORACLE = {
    "search_holdout_breakdown": sql("""SELECT bucket, count(*) AS n, count(markout_1h) AS n_markout, round(avg(markout_1h), 4) + 0 AS avg_markout FROM (SELECT markout_1h, unnest(['price:' || floor(fill_price * 5)::BIGINT, 'side:' || side, 'hour:' || trade_hour // 6,
'age:' || CASE WHEN book_before_age_s <= 600 THEN 'fresh' WHEN book_before_age_s <= 3600 THEN 'hour' ELSE 'old' END, 'spread:' || CASE WHEN spread_bps < 200 THEN 'narrow' WHEN spread_bps < 800 THEN 'mid' ELSE 'wide' END]) AS bucket FROM sp WHERE split = 'test') GROUP BY 1""", POSITIONS, M._BOOKS, M._DATASET, B._SPLIT),
}
