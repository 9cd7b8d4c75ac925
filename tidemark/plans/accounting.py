"""Ledger statistics, holdings, episodes, profit and loss, equity and exposure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import ordered as O
from tidemark.operators.storage import stored
from tidemark.plans.views import CLOSED_TS, POSITIONS, fanout, ledger, markets, moves, r4, sql, tokens

KEY = ["wallet", "token_id"]


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.running_positions(moves(spark, sf_dir), KEY)


def latest(states: DataFrame) -> DataFrame:
    """Last state of every key."""
    last = states.groupBy(*KEY).agg(F.max_by(F.struct("qty", "cost", "ts", "condition_id"), F.struct("ts", "id")).alias("s"))
    return last.select(*KEY, "s.*")


def leg_states(spark, sf_dir, p: DataFrame | None = None):
    """Positions with the quantities and costs of both legs of their condition after every move, and the condition's net change.

    One window for each (wallet, condition); moves of tokens without metadata have no legs.
    """
    legs = tokens(spark).select("token_id", F.col("outcome_index").alias("leg"))
    p = O.episode_events(positions(spark, sf_dir) if p is None else p, KEY).join(legs, "token_id", "left")
    order = ["ts", "id", "leg"]
    run = O.upto(["wallet", "condition_id"], *order)
    cols = {}
    for k in (0, 1):
        for name, of in (("q", "qty"), ("c", "cost")):
            cols[f"{name}{k}"] = F.coalesce(F.last(F.when(F.col("leg") == k, F.col(of)), ignorenulls=True).over(run), F.lit(0.0))
    p = p.withColumns(cols).withColumn("net", F.col("q0") - F.col("q1"))
    before = F.lag("net").over(Window.partitionBy("wallet", "condition_id").orderBy(*order))
    p = p.withColumn("net_change", F.col("net") - F.coalesce(before, F.lit(0.0)))
    return p


def ledger_event_counts(spark, sf_dir):
    g = ledger(spark, sf_dir).groupBy("wallet", "event_type")
    return g.agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def ledger_totals_roi(spark, sf_dir):
    e = ledger(spark, sf_dir)

    def total(cond):
        return F.sum(F.when(cond, F.col("delta_usdc")).otherwise(0.0))

    bought, sold = -total(F.col("side") == "BUY"), total(F.col("side") == "SELL")
    other = total(F.col("event_type").isin("MERGE", "REDEEM", "REWARD")) + total(F.col("event_type") == "SPLIT")
    out = e.groupBy("wallet").agg(bought.alias("b"), sold.alias("s"), other.alias("o"))
    net = F.col("s") + F.col("o") - F.col("b")
    return out.select("wallet", r4("b", "bought"), r4("s", "sold"), r4("o", "other"), r4(net, "net"), r4(F.try_divide(net, "b"), "roi"))


def wallet_stage_event_rollup(spark, sf_dir):
    e = ledger(spark, sf_dir).join(markets(spark), "condition_id", "left")
    stage = F.when(F.col("ts") < CLOSED_TS, "live").when(F.col("closed"), "closed").otherwise("late")
    g = e.groupBy("wallet", stage.alias("stage"), F.coalesce("event_id", F.lit("-")).alias("event_id"))
    out = g.agg(
        F.count("*").alias("n_events"),
        F.count_if(F.col("side") == "BUY").alias("n_buys"),
        F.count_if(F.col("side") == "SELL").alias("n_sells"),
        F.countDistinct("condition_id").alias("n_conditions"),
        r4(F.sum("delta_usdc"), "net_usdc"),
        r4(F.try_divide(F.count_if(F.col("side") == "BUY"), F.nullif(F.count_if(F.col("event_type") == "TRADE"), F.lit(0))), "buy_share"),
    )
    return out.where("n_events >= 3")


def market_search_activity(spark, sf_dir):
    """Markets whose question holds a term, with their trading by leg; the terms are a literal list."""
    terms = spark.sql("SELECT * FROM VALUES ('world  cup'), ('MARKET 1'), ('yes') AS t(term)").select(F.regexp_replace(F.lower("term"), r"\s+", " ").alias("term"))
    clean = F.regexp_replace(F.lower("question"), r"\s+", " ")
    found = markets(spark).join(F.broadcast(terms), F.contains(clean, F.col("term")))
    trades = ledger(spark, sf_dir).where("event_type = 'TRADE'").groupBy("condition_id").agg(
        F.count("*").alias("n"),
        F.sum(F.when(F.col("outcome_index") == 0, F.col("size")).otherwise(0.0)).alias("yes"),
        F.sum(F.when(F.col("outcome_index") == 1, F.col("size")).otherwise(0.0)).alias("no"),
        F.max("ts").alias("last_ts"),
    )
    out = found.join(trades, "condition_id", "left")
    return out.select("condition_id", "term", F.coalesce("n", F.lit(0)).alias("n_trades"), r4("yes", "yes_shares"), r4("no", "no_shares"), "last_ts")


def dedupe_duplicate_index(spark, sf_dir):
    """Equal fills get a running number, which becomes part of the key that makes ingest repeatable."""
    e = ledger(spark, sf_dir).where("event_type = 'TRADE'")
    same = ["wallet", "token_id", "side", "day"]
    e = e.withColumn("day", scalars.day_of(F.col("ts")))
    e = e.withColumn("n", F.row_number().over(Window.partitionBy(*same).orderBy("ts", "id")) - 1)
    key = scalars.dedupe_key(F.col("wallet"), F.col("token_id"), F.col("side"), F.col("day"), scalars.fixed(F.col("price"), 2), F.col("n"))
    return e.select("id", F.col("n").cast("long").alias("duplicate_index"), key.alias("dedupe_key"))


def fanout_unmapped_conditions(spark, sf_dir):
    wide = ledger(spark, sf_dir).where("token_id is null")
    gone = wide.join(markets(spark), "condition_id", "left_anti")
    return gone.groupBy("condition_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("wallet")), ",").alias("wallets"))


def missing_metadata_anti(spark, sf_dir):
    held = latest(positions(spark, sf_dir)).where(F.abs("qty") > O.EPSILON)
    mapped = tokens(spark).join(markets(spark), "condition_id", "left_semi")
    return held.join(mapped, "token_id", "left_anti").select("wallet", "token_id", r4("qty"))


def running_inventory_edge(spark, sf_dir):
    """Per-fill inventory of both legs of a condition, its average prices and the edge of complete sets."""
    e = ledger(spark, sf_dir).where("event_type = 'TRADE'")
    keys = ["wallet", "condition_id"]

    def leg(k, c):
        return F.when(F.col("outcome_index") == k, c).otherwise(0.0)

    buy = F.col("side") == "BUY"
    cols = {}
    for k in (0, 1):
        cols[f"q{k}_before"] = F.coalesce(F.sum(leg(k, F.col("delta_shares"))).over(O.before(keys)), F.lit(0.0))
        cols[f"q{k}"] = F.sum(leg(k, F.col("delta_shares"))).over(O.upto(keys))
        cols[f"bs{k}"] = F.sum(F.when(buy, leg(k, F.col("size"))).otherwise(0.0)).over(O.upto(keys))
        cols[f"bu{k}"] = F.sum(F.when(buy, leg(k, -F.col("delta_usdc"))).otherwise(0.0)).over(O.upto(keys))
    e = e.withColumns(cols)
    wap = [F.try_divide(f"bu{k}", F.nullif(F.round(f"bs{k}", 6), F.lit(0.0))) for k in (0, 1)]
    own = F.when(F.col("outcome_index") == 0, F.col("q0_before")).otherwise(F.col("q1_before"))
    other = F.when(F.col("outcome_index") == 0, F.col("q1_before")).otherwise(F.col("q0_before"))
    action = scalars.inventory_action(F.round(own, 6), F.round(other, 6), F.col("delta_shares"))
    return e.select("id", r4("q0_before"), r4("q1_before"), r4("q0"), r4("q1"), r4(wap[0], "wap0"), r4(wap[1], "wap1"), r4(1 - wap[0] - wap[1], "edge"), action.alias("action"))


def holdings_wac(spark, sf_dir):
    last = latest(positions(spark, sf_dir))
    wac = F.when(F.col("qty") > O.EPSILON, F.col("cost") / F.col("qty")).otherwise(0.0)
    return last.select(*KEY, r4("qty"), r4(wac, "wac"), F.col("ts").alias("as_of_ts"))


def holdings_negative_runs(spark, sf_dir, p: DataFrame | None = None):
    """The event that began the last unbroken run of negative quantity of each holding that ends negative."""
    p = (positions(spark, sf_dir) if p is None else p).withColumn("neg", F.col("qty") < -O.EPSILON)
    p = p.withColumn("run", F.sum(F.when(F.col("neg"), 0).otherwise(1)).over(O.upto(KEY)))
    ends = p.groupBy(*KEY).agg(F.max_by("neg", F.struct("ts", "id")).alias("ends"), F.max("run").alias("run")).where("ends").drop("ends")
    first = p.where("neg").join(ends, [*KEY, "run"]).groupBy(*KEY).agg(F.min_by(F.struct("id", "ts", "event_type"), F.struct("ts", "id")).alias("c"))
    return first.select(*KEY, F.col("c.id").alias("cause_id"), F.col("c.ts").alias("cause_ts"), F.col("c.event_type").alias("cause_type"))


def episodes_flat_to_flat(spark, sf_dir):
    e = O.episodes(positions(spark, sf_dir), KEY)
    return e.select(*KEY, "episode", "open_ts", "close_ts", "close_reason", r4("peak_qty"), "num_adds", "num_partial_exits", r4("realized_pnl"), "n_events")


def episode_stats(spark, sf_dir):
    e = O.episodes(positions(spark, sf_dir), KEY).withColumn("d", F.when(F.col("close_reason") != "open", F.col("close_ts") - F.col("open_ts")))
    ranks = O.ranked_values(e, ["wallet"], "d", {"p50_s": 0.5, "p90_s": 0.9})
    g = e.groupBy("wallet").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("close_reason") == "open").alias("n_open"),
        F.count_if(F.col("close_reason") == "flat").alias("n_flat"),
        F.count_if(F.col("close_reason") == "resolution").alias("n_resolution"),
        F.min("d").alias("min_s"),
        F.max("d").alias("max_s"),
        r4(F.percentile("d", 0.5), "median_s"),
        r4(F.try_divide(F.count_if(F.col("d") <= 60), F.count("d")), "micro_share"),
    )
    return g.join(ranks, "wallet", "left")


def long_history_moves(spark, sf_dir):
    """One endless position for each of three wallets: ten bought once, then nine sold and nine bought again and again."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    wallet = F.concat(F.lit("h"), F.col("user_id") % 3)
    n = F.row_number().over(Window.partitionBy(wallet).orderBy("event_id"))
    e = e.select(F.col("event_id").alias("id"), wallet.alias("wallet"), F.lit("t0").alias("token_id"), n.alias("n"), F.col("event_id").alias("ts"))
    price = (F.col("id") * 37 % 98 + 1) / F.lit(100.0)
    shares = F.when(F.col("n") == 1, 10.0).otherwise(9.0)
    return e.select("id", "wallet", "token_id", "ts", F.when(F.col("n") % 2 == 1, "add").otherwise("remove").alias("kind"), shares.alias("shares"), (shares * price).alias("usdc"), F.lit("TRADE").alias("event_type"), F.lit("c0").alias("condition_id"))


def holdings_long_history(spark, sf_dir):
    """Cost over histories whose running product of ratios falls below any double."""
    p = O.running_positions(long_history_moves(spark, sf_dir), KEY)
    g = p.groupBy(*KEY).agg(F.count("*").alias("n"), F.max_by(F.struct("qty", "cost"), "id").alias("s"), F.sum("realized").alias("realized"), F.max("cost").alias("most"))
    return g.select(*KEY, "n", r4("s.qty", "qty"), r4("s.cost", "cost"), r4("realized"), r4("most", "largest_cost"))


def token_prices(spark):
    m = markets(spark).where("closed")
    t = tokens(spark).join(m, "condition_id")
    return t.select("token_id", "closed_ts", F.when(F.col("outcome_index") == 0, F.col("price0")).otherwise(1 - F.col("price0")).alias("res_price"))


def derived_redeem_payouts(spark, sf_dir):
    """The first cash-less redeem of each wallet and resolved condition pays its positive quantities at the outcome."""
    free = ledger(spark, sf_dir).where("event_type = 'REDEEM' and delta_usdc = 0").select("id")
    p = positions(spark, sf_dir).where("kind = 'reset'").join(free, "id", "left_semi").join(token_prices(spark), "token_id")
    paid = p.groupBy("wallet", "condition_id", "ts", "id").agg(F.sum(F.greatest("qty_before", F.lit(0.0)) * F.col("res_price")).alias("payout"))
    first = paid.withColumn("n", F.row_number().over(Window.partitionBy("wallet", "condition_id").orderBy("ts", "id"))).where("n = 1")
    return first.select("wallet", "condition_id", "ts", F.col("id").alias("source_id"), r4("payout"))


def derived_settlements(spark, sf_dir):
    """Quantities still held on resolved markets close at the outcome, after the wallet's last move."""
    last = latest(positions(spark, sf_dir)).where("qty > 1e-6").join(token_prices(spark), "token_id")
    ts = F.greatest("closed_ts", F.col("ts") + 1)
    return last.select(*KEY, ts.alias("settle_ts"), r4("qty"), "res_price", r4(F.col("qty") * F.col("res_price"), "proceeds"))


def pnl_decomposition_scoped(spark, sf_dir):
    """Realized profit by component for each wallet, in all and by category."""
    p = positions(spark, sf_dir).where("kind != 'add'")
    component = F.when(F.col("event_type") == "TRADE", "directional").when(F.col("event_type") == "MERGE", "bond_merge").otherwise("redemption")
    p = p.select("wallet", "condition_id", component.alias("component"), F.col("realized").alias("v"))
    rewards = ledger(spark, sf_dir).where("event_type = 'REWARD'").select("wallet", "condition_id", F.lit("rewards").alias("component"), F.col("delta_usdc").alias("v"))
    both = p.unionByName(rewards).join(markets(spark).select("condition_id", "category"), "condition_id", "left")
    both = both.withColumn("category", F.coalesce("category", F.lit("unclassified")))
    sums = both.groupBy("wallet", "category").pivot("component", ["directional", "bond_merge", "redemption", "rewards"]).agg(F.sum("v"))
    sums = sums.fillna(0.0)
    parts = ["directional", "bond_merge", "redemption", "rewards"]
    rolled = sums.groupingSets([["wallet"], ["wallet", "category"]], "wallet", "category").agg(*(F.sum(c).alias(c) for c in parts), F.grouping("category").alias("whole"))
    scope = F.when(F.col("whole") == 1, "all").otherwise(F.concat(F.lit("category:"), F.col("category")))
    total = sum((F.col(c) for c in parts[1:]), F.col(parts[0]))
    return rolled.select("wallet", scope.alias("scope"), *(r4(c) for c in parts), r4(total, "total"))


def _daily_states(p: DataFrame):
    """Quantity, cost and last trade price of every holding at the end of each of its days, while it is held.

    A day's last state stands until the day before the next one, or to the last day of all; one that is flat has no days
    after its own, however long the table goes on.
    """
    price = F.when(F.col("event_type") == "TRADE", F.try_divide("usdc", F.nullif("shares", F.lit(0.0))))
    p = p.withColumn("px", F.last(price, ignorenulls=True).over(O.upto(KEY))).withColumn("day", F.floor(F.col("ts") / 86400))
    last = F.struct("ts", "id")
    daily = p.groupBy(*KEY, "day").agg(*(F.max_by(c, last).alias(c) for c in ("qty", "cost", "px", "condition_id")), F.max("ts").alias("at"))
    end = p.agg(F.max("day").alias("_end"))
    daily = daily.withColumn("_next", F.lead("day").over(Window.partitionBy(*KEY).orderBy("day"))).crossJoin(F.broadcast(end))  # one row
    until = F.when(F.abs("qty") <= O.EPSILON, F.col("day")).otherwise(F.coalesce(F.col("_next") - 1, F.col("_end")))
    out = daily.select(*KEY, F.explode(F.sequence("day", until)).alias("day"), "qty", "cost", "px", "condition_id", "at")
    return out.withColumn("ts", (F.col("day") + 1) * 86400 - 1)


def daily_equity(spark, sf_dir):
    """Per wallet and day: value at marks, realized and unrealized profit, drawdown from the running peak, stale share."""
    p = stored(positions(spark, sf_dir).select("id", *KEY, "ts", "event_type", "condition_id", "shares", "usdc", "qty", "cost", "realized"))
    d = _daily_states(p).join(token_prices(spark), "token_id", "left")
    resolved = F.col("res_price").isNotNull() & (F.col("ts") >= F.col("closed_ts"))
    mark = F.when(resolved, F.col("res_price")).otherwise(F.coalesce("px", F.lit(0.0)))
    held = F.when(F.col("qty") > 0, F.col("qty")).otherwise(0.0)
    d = d.withColumns({"v": held * mark, "stale": ~resolved & (F.col("ts") - F.col("at") > 86400)})
    d = d.groupBy("wallet", "day").agg(
        F.sum("v").alias("value"),
        F.sum(F.col("v") - F.when(F.col("qty") > 0, F.col("cost")).otherwise(0.0)).alias("unrealized"),
        F.sum(F.when(F.col("stale"), F.col("v")).otherwise(0.0)).alias("stale_v"),
    )
    # realized profit is carried by wallet, on every day from its first to the last of all
    r = p.groupBy("wallet", F.floor(F.col("ts") / 86400).alias("day")).agg(F.sum("realized").alias("r"))
    grid = r.groupBy("wallet").agg(F.min("day").alias("_a")).crossJoin(F.broadcast(r.agg(F.max("day").alias("_b"))))  # one row
    grid = grid.select("wallet", F.explode(F.sequence("_a", "_b")).alias("day"))
    g = grid.join(r, ["wallet", "day"], "left").join(d, ["wallet", "day"], "left").fillna(0.0)
    run = Window.partitionBy("wallet").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumn("realized", F.sum("r").over(run)).withColumn("marked", F.round(F.col("realized") + F.col("unrealized"), 6))
    peak = F.greatest(F.max("marked").over(run), F.lit(0.0))
    return g.select(
        "wallet", "day", r4("value"), r4("realized"), r4("unrealized"), r4("marked", "marked_pnl"), r4(peak - F.col("marked"), "drawdown"), r4(F.coalesce(F.try_divide("stale_v", F.nullif(F.round("value", 6), F.lit(0.0))), F.lit(0.0)), "stale_share")
    )


def _exposure(spark, sf_dir):
    d = _daily_states(positions(spark, sf_dir)).join(tokens(spark).select("token_id", "outcome_index"), "token_id")
    q = [F.coalesce(F.max(F.when(F.col("outcome_index") == k, F.col("qty"))), F.lit(0.0)) for k in (0, 1)]
    return d.groupBy("wallet", "condition_id", "day").agg(q[0].alias("q0"), q[1].alias("q1")).where("abs(q0) > 1e-6 or abs(q1) > 1e-6")


def exposures_daily(spark, sf_dir):
    n = tokens(spark).groupBy("condition_id").agg(F.count("*").alias("n_tokens"))
    e = _exposure(spark, sf_dir).join(n, "condition_id").join(markets(spark), "condition_id", "left")
    structure = scalars.structure_type(F.col("n_tokens"), F.coalesce("neg_risk", F.lit(False)), F.col("event_id"))
    return e.select("wallet", "condition_id", "day", structure.alias("structure_type"), r4(scalars.directional(F.col("q0"), F.col("q1")), "directional"), r4(scalars.bond(F.col("q0"), F.col("q1")), "bond"))


def event_exposure_netting(spark, sf_dir):
    e = _exposure(spark, sf_dir).join(markets(spark).where("neg_risk"), "condition_id")
    g = e.groupBy("wallet", "event_id", "day").agg(
        F.sum(F.col("q0") - F.col("q1")).alias("net"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("condition_id", F.col("q0") - F.col("q1"))))).alias("vector"),
    )
    return g.select("wallet", "event_id", "day", r4("net"), F.size("vector").cast("long").alias("n_siblings"))


QUERIES = {
    f.__name__: f
    for f in (
        ledger_event_counts, ledger_totals_roi, wallet_stage_event_rollup, market_search_activity, dedupe_duplicate_index,
        fanout_unmapped_conditions, missing_metadata_anti, running_inventory_edge, holdings_wac, holdings_negative_runs,
        episodes_flat_to_flat, episode_stats, derived_redeem_payouts, derived_settlements, pnl_decomposition_scoped,
        daily_equity, exposures_daily, event_exposure_netting, holdings_long_history,
    )
}

_LAST = "last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY wallet, token_id ORDER BY ts DESC, id DESC) AS rn FROM positions) WHERE rn = 1)"
_LEGS = """
lg0 AS (SELECT p.*, t.outcome_index AS leg, coalesce(sum(CASE WHEN kind = 'reset' OR (kind = 'remove' AND abs(qty) <= 1e-6) THEN 1 ELSE 0 END) OVER (PARTITION BY p.wallet, p.token_id ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS episode
   FROM positions p LEFT JOIN tokens t ON t.token_id = p.token_id),
lg1 AS (SELECT *, coalesce(last_value(CASE WHEN leg = 0 THEN qty END IGNORE NULLS) OVER w, 0) AS q0, coalesce(last_value(CASE WHEN leg = 1 THEN qty END IGNORE NULLS) OVER w, 0) AS q1,
   coalesce(last_value(CASE WHEN leg = 0 THEN cost END IGNORE NULLS) OVER w, 0) AS c0, coalesce(last_value(CASE WHEN leg = 1 THEN cost END IGNORE NULLS) OVER w, 0) AS c1
   FROM lg0 WINDOW w AS (PARTITION BY wallet, condition_id ORDER BY ts, id, leg NULLS FIRST ROWS UNBOUNDED PRECEDING)),
legs AS (SELECT *, q0 - q1 - coalesce(lag(q0 - q1) OVER (PARTITION BY wallet, condition_id ORDER BY ts, id, leg NULLS FIRST), 0) AS net_change FROM lg1)"""
_PRICES = "prices AS (SELECT t.token_id, closed_ts, CASE WHEN outcome_index = 0 THEN price0 ELSE 1 - price0 END AS res_price FROM tokens t JOIN markets USING (condition_id) WHERE closed)"
_EPISODES = """
x1 AS (SELECT *, kind = 'reset' OR (kind = 'remove' AND abs(qty) <= 1e-6) AS closes FROM positions),
x2 AS (SELECT *, coalesce(sum(CASE WHEN closes THEN 1 ELSE 0 END) OVER (PARTITION BY wallet, token_id ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS episode FROM x1),
x3 AS (SELECT *, row_number() OVER (PARTITION BY wallet, token_id, episode ORDER BY ts, id) AS nth FROM x2),
episodes AS (SELECT wallet, token_id, episode, min(ts) AS open_ts, max(ts) FILTER (closes) AS close_ts,
   CASE WHEN NOT bool_or(closes) THEN 'open' WHEN arg_max(kind, (ts, id)) = 'reset' THEN 'resolution' ELSE 'flat' END AS close_reason,
   greatest(max(qty), 0) AS peak_qty, count(*) FILTER (kind = 'add' AND nth > 1) AS num_adds,
   count(*) FILTER (kind = 'remove' AND qty_before > 0 AND shares <= qty_before AND NOT closes) AS num_partial_exits,
   sum(CASE WHEN qty_before > 0 THEN realized ELSE 0 END) AS realized_pnl, count(*) AS n_events FROM x3
   GROUP BY wallet, token_id, episode HAVING count(*) FILTER (kind <> 'reset') > 0)"""
_DAILY = """
y1 AS (SELECT *, ts // 86400 AS day, last_value(CASE WHEN event_type = 'TRADE' THEN usdc / nullif(shares, 0) END IGNORE NULLS) OVER (PARTITION BY wallet, token_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS px,
   sum(realized) OVER (PARTITION BY wallet, token_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS cum FROM positions),
y2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY wallet, token_id, day ORDER BY ts DESC, id DESC) AS rn FROM y1) WHERE rn = 1),
y3 AS (SELECT wallet, token_id, unnest(generate_series(min(day), (SELECT max(day) FROM y1))) AS day FROM y1 GROUP BY 1, 2),
daily AS (SELECT g.wallet, g.token_id, g.day, g.day * 86400 + 86399 AS ts, y2.ts AS seen_ts, qty, cost, px, cum, condition_id
   FROM y3 g ASOF LEFT JOIN y2 ON g.wallet = y2.wallet AND g.token_id = y2.token_id AND g.day >= y2.day)"""
_EXPOSURE = """
exposure AS (SELECT wallet, d.condition_id, day, coalesce(max(qty) FILTER (outcome_index = 0), 0) AS q0, coalesce(max(qty) FILTER (outcome_index = 1), 0) AS q1
   FROM daily d JOIN tokens t USING (token_id) GROUP BY 1, 2, 3 HAVING abs(coalesce(max(qty) FILTER (outcome_index = 0), 0)) > 1e-6 OR abs(coalesce(max(qty) FILTER (outcome_index = 1), 0)) > 1e-6)"""


_LONG = """
lm1 AS (SELECT event_id AS id, 'h' || (user_id % 3) AS wallet, 't0' AS token_id, event_id AS ts, row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) AS n FROM events),
lm2 AS (SELECT *, CASE WHEN n = 1 THEN 10.0 ELSE 9.0 END::DOUBLE AS shares FROM lm1),
moves AS (SELECT id, wallet, token_id, ts, CASE WHEN n % 2 = 1 THEN 'add' ELSE 'remove' END AS kind, shares, shares * ((id * 37 % 98 + 1) / 100.0::DOUBLE) AS usdc FROM lm2)"""

ORACLE = {
    "holdings_long_history": "WITH " + (_LONG + "," + POSITIONS).strip() + """
SELECT wallet, token_id, count(*) AS n, round(arg_max(qty, id), 4) + 0 AS qty, round(arg_max(cost, id), 4) + 0 AS cost, round(sum(realized), 4) + 0 AS realized, round(max(cost), 4) + 0 AS largest_cost FROM positions GROUP BY 1, 2""",
    "ledger_event_counts": sql("SELECT wallet, event_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM ledger GROUP BY 1, 2"),
    "ledger_totals_roi": sql("""SELECT wallet, round(b, 4) + 0 AS bought, round(s, 4) + 0 AS sold, round(o, 4) + 0 AS other, round(s + o - b, 4) + 0 AS net, round((s + o - b) / nullif(b, 0), 4) + 0 AS roi
FROM (SELECT wallet, -sum(CASE WHEN side = 'BUY' THEN delta_usdc ELSE 0 END) AS b, sum(CASE WHEN side = 'SELL' THEN delta_usdc ELSE 0 END) AS s,
      sum(CASE WHEN event_type <> 'TRADE' THEN delta_usdc ELSE 0 END) AS o FROM ledger GROUP BY wallet)"""),
    "wallet_stage_event_rollup": sql("""SELECT wallet, CASE WHEN ts < 1705795200 THEN 'live' WHEN closed THEN 'closed' ELSE 'late' END AS stage, coalesce(event_id, '-') AS event_id,
count(*) AS n_events, count(*) FILTER (side = 'BUY') AS n_buys, count(*) FILTER (side = 'SELL') AS n_sells, count(DISTINCT condition_id) AS n_conditions,
round(sum(delta_usdc), 4) + 0 AS net_usdc, round(count(*) FILTER (side = 'BUY') / nullif(count(*) FILTER (event_type = 'TRADE'), 0), 4) AS buy_share
FROM ledger LEFT JOIN markets USING (condition_id) GROUP BY 1, 2, 3 HAVING count(*) >= 3"""),
    "market_search_activity": sql("""SELECT m.condition_id, term, coalesce(n, 0) AS n_trades, round(yes, 4) + 0 AS yes_shares, round(no, 4) + 0 AS no_shares, last_ts
FROM markets m JOIN (VALUES ('world cup'), ('market 1'), ('yes')) v(term) ON regexp_replace(lower(question), '\\s+', ' ', 'g') LIKE '%' || term || '%'
LEFT JOIN (SELECT condition_id, count(*) AS n, sum(CASE WHEN outcome_index = 0 THEN size ELSE 0 END) AS yes, sum(CASE WHEN outcome_index = 1 THEN size ELSE 0 END) AS no, max(ts) AS last_ts
           FROM ledger WHERE event_type = 'TRADE' GROUP BY 1) t USING (condition_id)"""),
    "dedupe_duplicate_index": sql("""SELECT id, n AS duplicate_index, sha256(wallet || '|' || token_id || '|' || side || '|' || day || '|' || (price::DECIMAL(28, 2))::VARCHAR || '|' || n) AS dedupe_key
FROM (SELECT *, row_number() OVER (PARTITION BY wallet, token_id, side, day ORDER BY ts, id) - 1 AS n FROM (SELECT *, strftime(make_timestamp(ts * 1000000), '%Y-%m-%d') AS day FROM ledger WHERE event_type = 'TRADE'))"""),
    "fanout_unmapped_conditions": sql("SELECT condition_id, count(*) AS n, string_agg(DISTINCT wallet, ',' ORDER BY wallet) AS wallets FROM ledger WHERE token_id IS NULL AND condition_id NOT IN (SELECT condition_id FROM markets) GROUP BY 1"),
    "missing_metadata_anti": sql("SELECT wallet, token_id, round(qty, 4) + 0 AS qty FROM last WHERE abs(qty) > 1e-6 AND token_id NOT IN (SELECT token_id FROM tokens JOIN markets USING (condition_id))", POSITIONS, _LAST),
    "running_inventory_edge": sql("""SELECT id, round(q0_before, 4) + 0 AS q0_before, round(q1_before, 4) + 0 AS q1_before, round(q0, 4) + 0 AS q0, round(q1, 4) + 0 AS q1, round(w0, 4) AS wap0, round(w1, 4) AS wap1, round(1 - w0 - w1, 4) + 0 AS edge,
CASE WHEN delta_shares > 0 AND round(CASE WHEN outcome_index = 0 THEN q1_before ELSE q0_before END, 6) > round(CASE WHEN outcome_index = 0 THEN q0_before ELSE q1_before END, 6) THEN 'forms set' WHEN delta_shares > 0 THEN 'increases directional' WHEN delta_shares < 0 THEN 'reduces directional' ELSE 'none' END AS action
FROM (SELECT *, bu0 / nullif(round(bs0, 6), 0) AS w0, bu1 / nullif(round(bs1, 6), 0) AS w1 FROM (SELECT id, outcome_index, delta_shares,
  coalesce(sum(CASE WHEN outcome_index = 0 THEN delta_shares ELSE 0 END) OVER b, 0) AS q0_before, coalesce(sum(CASE WHEN outcome_index = 1 THEN delta_shares ELSE 0 END) OVER b, 0) AS q1_before,
  sum(CASE WHEN outcome_index = 0 THEN delta_shares ELSE 0 END) OVER u AS q0, sum(CASE WHEN outcome_index = 1 THEN delta_shares ELSE 0 END) OVER u AS q1,
  sum(CASE WHEN side = 'BUY' AND outcome_index = 0 THEN size ELSE 0 END) OVER u AS bs0, sum(CASE WHEN side = 'BUY' AND outcome_index = 1 THEN size ELSE 0 END) OVER u AS bs1,
  sum(CASE WHEN side = 'BUY' AND outcome_index = 0 THEN -delta_usdc ELSE 0 END) OVER u AS bu0, sum(CASE WHEN side = 'BUY' AND outcome_index = 1 THEN -delta_usdc ELSE 0 END) OVER u AS bu1
  FROM ledger WHERE event_type = 'TRADE' WINDOW u AS (PARTITION BY wallet, condition_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY wallet, condition_id ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))"""),
    "holdings_wac": sql("SELECT wallet, token_id, round(qty, 4) + 0 AS qty, round(CASE WHEN qty > 1e-6 THEN cost / qty ELSE 0 END, 4) + 0 AS wac, ts AS as_of_ts FROM last", POSITIONS, _LAST),
    "holdings_negative_runs": sql("""SELECT wallet, token_id, id AS cause_id, ts AS cause_ts, event_type AS cause_type FROM
(SELECT *, row_number() OVER (PARTITION BY wallet, token_id ORDER BY ts, id) AS first FROM
 (SELECT *, max(run) OVER (PARTITION BY wallet, token_id) AS last_run, last_value(neg) OVER (PARTITION BY wallet, token_id ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ends FROM
  (SELECT *, qty < -1e-6 AS neg, sum(CASE WHEN qty < -1e-6 THEN 0 ELSE 1 END) OVER (PARTITION BY wallet, token_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS run FROM positions)) WHERE neg AND ends AND run = last_run) WHERE first = 1""", POSITIONS),
    "episodes_flat_to_flat": sql("SELECT wallet, token_id, episode, open_ts, close_ts, close_reason, round(peak_qty, 4) + 0 AS peak_qty, num_adds, num_partial_exits, round(realized_pnl, 4) + 0 AS realized_pnl, n_events FROM episodes", POSITIONS, _EPISODES),
    "episode_stats": sql("""SELECT wallet, count(*) AS n, count(*) FILTER (close_reason = 'open') AS n_open, count(*) FILTER (close_reason = 'flat') AS n_flat, count(*) FILTER (close_reason = 'resolution') AS n_resolution,
min(d) AS min_s, list_sort(list(d) FILTER (d IS NOT NULL))[((count(d) - 1) * 0.5)::DOUBLE.floor()::INT + 1] AS p50_s, list_sort(list(d) FILTER (d IS NOT NULL))[floor((count(d) - 1) * 0.9)::INT + 1] AS p90_s, max(d) AS max_s,
round(median(d), 4) AS median_s, round(count(*) FILTER (d <= 60) / nullif(count(d), 0), 4) AS micro_share
FROM (SELECT *, CASE WHEN close_reason <> 'open' THEN close_ts - open_ts END AS d FROM episodes) GROUP BY wallet""".replace("((count(d) - 1) * 0.5)::DOUBLE.floor()::INT", "floor((count(d) - 1) * 0.5)::INT"), POSITIONS, _EPISODES),
    "derived_redeem_payouts": sql("""SELECT wallet, condition_id, ts, id AS source_id, round(payout, 4) + 0 AS payout FROM (SELECT *, row_number() OVER (PARTITION BY wallet, condition_id ORDER BY ts, id) AS n FROM
(SELECT p.wallet, p.condition_id, p.ts, p.id, sum(greatest(qty_before, 0) * res_price) AS payout FROM positions p JOIN prices USING (token_id) JOIN ledger l ON l.id = p.id AND l.delta_usdc = 0 WHERE kind = 'reset' GROUP BY 1, 2, 3, 4)) WHERE n = 1""", POSITIONS, _PRICES),
    "derived_settlements": sql("SELECT wallet, token_id, greatest(closed_ts, ts + 1) AS settle_ts, round(qty, 4) + 0 AS qty, res_price, round(qty * res_price, 4) + 0 AS proceeds FROM last JOIN prices USING (token_id) WHERE qty > 1e-6", POSITIONS, _LAST, _PRICES),
    "pnl_decomposition_scoped": sql("""SELECT wallet, CASE WHEN grouping(category) = 1 THEN 'all' ELSE 'category:' || category END AS scope, round(sum(d), 4) + 0 AS directional, round(sum(m), 4) + 0 AS bond_merge, round(sum(r), 4) + 0 AS redemption, round(sum(w), 4) + 0 AS rewards, round(sum(d + m + r + w), 4) + 0 AS total FROM
(SELECT wallet, coalesce(category, 'unclassified') AS category, CASE WHEN event_type = 'TRADE' THEN v ELSE 0 END AS d, CASE WHEN event_type = 'MERGE' THEN v ELSE 0 END AS m, CASE WHEN event_type = 'REDEEM' THEN v ELSE 0 END AS r, CASE WHEN event_type = 'REWARD' THEN v ELSE 0 END AS w
 FROM (SELECT wallet, condition_id, event_type, realized AS v FROM positions WHERE kind <> 'add' UNION ALL SELECT wallet, condition_id, event_type, delta_usdc FROM ledger WHERE event_type = 'REWARD') LEFT JOIN markets USING (condition_id))
GROUP BY GROUPING SETS ((wallet), (wallet, category))""", POSITIONS),
    "daily_equity": sql("""SELECT wallet, day, round(value, 4) + 0 AS value, round(realized, 4) + 0 AS realized, round(unrealized, 4) + 0 AS unrealized, round(marked, 4) + 0 AS marked_pnl,
round(greatest(max(marked) OVER (PARTITION BY wallet ORDER BY day ROWS UNBOUNDED PRECEDING), 0) - marked, 4) + 0 AS drawdown, round(coalesce(stale_v / nullif(round(value, 6), 0), 0), 4) + 0 AS stale_share FROM
(SELECT *, round(realized + unrealized, 6) AS marked FROM (SELECT wallet, day, sum(v) AS value, sum(cum) AS realized, sum(v - CASE WHEN qty > 0 THEN cost ELSE 0 END) AS unrealized, sum(CASE WHEN stale THEN v ELSE 0 END) AS stale_v FROM
 (SELECT *, (CASE WHEN qty > 0 THEN qty ELSE 0 END) * (CASE WHEN resolved THEN res_price ELSE coalesce(px, 0) END) AS v, NOT resolved AND ts - seen_ts > 86400 AS stale FROM
  (SELECT d.*, res_price, res_price IS NOT NULL AND d.ts >= closed_ts AS resolved FROM daily d LEFT JOIN prices USING (token_id))) GROUP BY 1, 2))""", POSITIONS, _PRICES, _DAILY),
    "exposures_daily": sql("""SELECT wallet, x.condition_id, day, CASE WHEN n_tokens = 2 AND coalesce(neg_risk, false) AND event_id IS NOT NULL THEN 'negRisk-event-member' WHEN n_tokens = 2 THEN 'binary' ELSE 'unclassified' END AS structure_type,
round(q0 - q1, 4) + 0 AS directional, round(least(q0, q1), 4) + 0 AS bond FROM exposure x JOIN (SELECT condition_id, count(*) AS n_tokens FROM tokens GROUP BY 1) n USING (condition_id) LEFT JOIN markets USING (condition_id)""", POSITIONS, _DAILY, _EXPOSURE),
    "event_exposure_netting": sql("SELECT wallet, event_id, day, round(sum(q0 - q1), 4) + 0 AS net, count(*) AS n_siblings FROM exposure JOIN markets USING (condition_id) WHERE neg_risk GROUP BY 1, 2, 3", POSITIONS, _DAILY, _EXPOSURE),
}
