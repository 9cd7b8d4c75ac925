"""The per-fill lifecycle dataset, running state of conditions and events, timelines, totals, audits and cluster comparison."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import ordered as O
from tidemark.operators.storage import stored
from tidemark.plans import accounting as A
from tidemark.plans import behaviour as B
from tidemark.plans import matching as M
from tidemark.plans.accounting import KEY
from tidemark.plans.views import CLOSED_TS, POSITIONS, ledger, markets, r4, sql, tokens

DUST = 1e-6
DEPTH = ["bid_depth_top1", "ask_depth_top1", "bid_depth_top5", "ask_depth_top5", "imbalance_top1", "imbalance_top5"]
HORIZONS = {"markout_5m": 300, "markout_15m": 900, "markout_1h": 3600, "markout_24h": 86400}


def condition_state(spark, sf_dir):
    """Both legs of a condition after each trade: quantities, average costs, paired and unpaired quantity, cost of the pairs."""
    p = A.leg_states(spark, sf_dir).where("event_type = 'TRADE' and leg is not null")
    # a little more keeps averages that are ties in the last digit from falling either way
    wac = {k: F.when(F.col(f"q{k}") > DUST, F.col(f"c{k}") / F.col(f"q{k}") + 1e-9).otherwise(0.0) for k in (0, 1)}
    paired = F.greatest(F.least("q0", "q1"), F.lit(0.0))
    return p.select(
        "id", "wallet", "condition_id", r4("q0", "qty_yes"), r4("q1", "qty_no"), r4("c0", "cost_yes"), r4("c1", "cost_no"), r4(wac[0], "wac_yes"), r4(wac[1], "wac_no"),
        r4(paired, "paired_qty"), r4(F.greatest(F.col("q0") - paired, F.lit(0.0)), "unpaired_yes"), r4(F.greatest(F.col("q1") - paired, F.lit(0.0)), "unpaired_no"),
        r4(F.least("c0", "c1"), "bond_cost"), r4(F.col("q0") - F.col("q1"), "directional"),
    )


def event_state(spark, sf_dir):
    """Totals over all conditions of an event after each trade: sums of what each condition's state changed by."""
    p = A.leg_states(spark, sf_dir).where("leg is not null")
    p = p.join(markets(spark).select("condition_id", "event_id"), "condition_id")
    paired = F.greatest(F.least("q0", "q1"), F.lit(0.0))
    state = {
        "total_qty": F.col("q0") + F.col("q1"), "total_cost": F.col("c0") + F.col("c1"), "bond_qty": paired,
        "unpaired": F.greatest(F.col("q0") - paired, F.lit(0.0)) + F.greatest(F.col("q1") - paired, F.lit(0.0)),
        "exposure": F.abs(F.col("q0") - F.col("q1")), "active": F.when(F.abs(F.col("q0") + F.col("q1")) > DUST, 1).otherwise(0),
    }
    p = p.withColumns(state)
    own = Window.partitionBy("wallet", "condition_id").orderBy("ts", "id", "leg")
    p = p.withColumns({k: F.col(k) - F.coalesce(F.lag(k).over(own), F.lit(0)) for k in state})
    run = O.upto(["wallet", "event_id"], "ts", "id", "condition_id", "leg")
    p = p.withColumns({k: F.sum(k).over(run) for k in state}).where("event_type = 'TRADE'")
    return p.select("id", "wallet", "event_id", *(r4(k) for k in list(state)[:-1]), F.col("active").cast("long").alias("market_count_active"))


def lifecycle_dataset(spark, sf_dir):
    """One row for each fill: its book with depth, both legs around it, the event's exposure, how its episode ended, what was
    left after a day, and markouts. Only keys and times travel through the as-of joins; other columns are joined on the id."""
    key = ["id", "token_id"]
    f = B.trades(spark, sf_dir).where("not (side = 'BUY' and id % 3 = 0)")
    keys = f.select("id", "wallet", "token_id", "ts")
    p = stored(A.positions(spark, sf_dir))  # read by three parts below
    s = A.leg_states(spark, sf_dir, p)
    of_event = markets(spark).select("condition_id", "event_id", F.col("neg_risk").alias("_neg"))
    s = s.join(of_event, "condition_id", "left")
    net = F.sum(F.when(F.col("leg").isNotNull(), F.col("net_change")).otherwise(0.0)).over(O.upto(["wallet", "event_id"], "ts", "id", "condition_id", "leg"))
    s = s.withColumn("event_net", F.when(F.col("_neg"), net))
    state = s.where("event_type = 'TRADE'").select(*key, "episode", "leg", "qty", "qty_before", "q0", "q1", "net_change", "event_net")
    e = O.episodes(p, KEY).select(*KEY, "episode", "open_ts", "close_ts", "close_reason", "last_type", "peak_qty", "wac_entry", "realized_pnl")
    b = M.depth_books(spark, sf_dir)
    at = O.asof_backward(keys.drop("wallet"), b, ["token_id"], ["mid", "best_bid", "best_ask", *DEPTH]).withColumnRenamed("asof_ts", "book_ts").drop("ts")
    after = O.asof_forward(keys.drop("wallet"), b, ["token_id"], ["mid"]).select(*key, F.col("asof_ts").alias("after_ts"), F.col("mid").alias("mid_after"))
    last = p.groupBy(*KEY, "ts").agg(F.max_by("qty", "id").alias("later_qty"))
    later = O.asof_backward(keys.withColumn("ts", F.col("ts") + 86400), last, KEY, ["later_qty"]).select(*key, "later_qty")
    cuts = F.array(*(F.struct(F.lit(n).alias("horizon"), F.lit(h).alias("h")) for n, h in HORIZONS.items()))
    points = keys.drop("wallet").withColumn("c", F.explode(cuts)).select(*key, (F.col("ts") + F.col("c.h")).alias("ts"), "c.*")
    points = O.asof_forward(points, b, ["token_id"], ["mid"]).where("asof_ts <= ts + 2 * h")
    points = points.groupBy(*key).pivot("horizon", list(HORIZONS)).agg(F.first("mid"))
    out = f.join(state, key, "left").join(at, key, "left").join(after, key, "left").join(later, key, "left").join(points, key, "left")
    out = out.join(e, [*KEY, "episode"], "left").join(markets(spark).select("condition_id", "closed_ts", "neg_risk"), "condition_id", "left")
    pair = F.col("leg").isNotNull()
    other = F.when(F.col("leg") == 0, F.col("q1")).when(F.col("leg") == 1, F.col("q0"))
    q = {"before": (F.col("qty_before"), other), "after": (F.col("qty"), other)}
    sides = {w: [F.when(F.col("leg") == 0, a).when(F.col("leg") == 1, o), F.when(F.col("leg") == 0, o).when(F.col("leg") == 1, a)] for w, (a, o) in q.items()}
    d = {w: scalars.directional(*v) for w, v in sides.items()}
    bond = {w: F.least(*v) for w, v in sides.items()}
    ratio = {w: F.try_divide(bond[w], F.nullif(F.round(bond[w] + F.abs(d[w]), 8), F.lit(0.0))) for w in q}
    price, spread = F.col("price"), F.col("best_ask") - F.col("best_bid")
    path = F.coalesce(scalars.close_path(F.col("close_reason"), F.col("last_type")), F.lit("UNKNOWN"))
    done = path.isin("OPEN", "UNKNOWN") == F.lit(False)
    pnl = F.when(done, F.col("realized_pnl"))
    reasons = F.concat_ws(
        ",", F.when(F.col("mid").isNull(), "no_book"), F.when(F.col("closed_ts").isNull(), "missing_market_metadata"), F.when(~pair, "no_complement_token"),
        F.when(path == "OPEN", "position_still_open"), F.when(F.col("later_qty").isNull(), "no_quantity_after_24h"),
    )
    markouts = [r4(scalars.signed_by_side(F.col(n) - price, F.col("side")), n) for n in HORIZONS]
    return out.select(
        "id", "wallet", "token_id", "condition_id", F.col("ts").alias("trade_ts"), "side", "role", price.alias("fill_price"), r4("size", "fill_shares"), r4(F.col("size") * price, "fill_notional"),
        "category", "event_id", (F.col("closed_ts") - F.col("ts")).alias("time_to_close_s"), F.floor(F.col("ts") % 86400 / 3600).alias("trade_hour_utc"),
        (F.col("ts") - F.col("book_ts")).alias("book_before_age_s"), (F.col("after_ts") - F.col("ts")).alias("book_after_age_s"), scalars.context_status(F.floor((F.col("ts") - F.col("book_ts")) / 60), 240).alias("context_status"),
        "best_bid", "best_ask", "mid", r4(spread, "spread"), r4(spread / F.nullif(F.col("mid"), F.lit(0.0)) * 10000, "spread_bps"), *(r4(c) for c in DEPTH),
        r4(price - F.col("mid"), "distance_fill_to_mid"), r4(price - F.col("best_bid"), "distance_fill_to_bid"), r4(price - F.col("best_ask"), "distance_fill_to_ask"),
        ((price > F.col("best_bid")) & (price < F.col("best_ask"))).cast("int").alias("fill_inside_spread"), (price == F.col("best_bid")).cast("int").alias("fill_at_best_bid"), (price == F.col("best_ask")).cast("int").alias("fill_at_best_ask"),
        r4("qty_before", "qty_token_before"), r4("qty", "qty_token_after"), r4(other, "qty_complement"),
        *(r4(x[w], f"{n}_{w}") for w in q for n, x in (("directional", d), ("bond", bond), ("bond_ratio", ratio))), r4(bond["after"] - bond["before"], "bond_delta"), r4(d["after"] - d["before"], "directional_delta"),
        r4(F.col("event_net") - F.col("net_change"), "event_exposure_before"), r4("event_net", "event_exposure_after"), r4(F.when(F.col("event_net").isNotNull(), F.col("net_change")), "event_exposure_delta"),
        path.alias("close_path"), "close_ts", (F.col("close_ts") - F.col("open_ts")).alias("hold_seconds"), r4(pnl, "realized_pnl_wac"),
        r4(F.try_divide(pnl, F.nullif(F.round("peak_qty", 6), F.lit(0.0))), "realized_pnl_per_share"), r4(F.round(F.try_divide(pnl, F.nullif(F.round(F.col("wac_entry") * F.col("peak_qty"), 6), F.lit(0.0))) * 10000, 2), "realized_pnl_bps_on_cost"),
        r4("later_qty", "remaining_open_qty_after_24h"), (F.abs("later_qty") > DUST).cast("int").alias("is_open_after_24h"), *markouts,
        r4(F.when(path == "RESOLUTION", pnl), "pnl_at_resolution"), F.nullif(reasons, F.lit("")).alias("null_reasons"),
    )


def rule_predicates(
    min_spread_bps: float = 50, min_improvement_bps: float = 10, min_directional: float = 1, bond_too: bool = False, max_set_cost: float = 0.98, min_imbalance: float = 0.3,
    max_time_to_close_s: int = 7 * 86400, hours: tuple[int, int] = (0, 23), min_event_exposure: float = 5, cycle_spread_bps: float = 30,
) -> dict[str, str]:
    """The rule families over what was known before a fill, as predicates that both engines read; unknown values never fire."""
    reduces = "(side = 'SELL' AND {0} > 0 OR side = 'BUY' AND {0} < 0)"
    bond = " AND (side = 'BUY' AND qty_complement > 0 OR side = 'SELL' AND qty_token_before > 0)" if bond_too else ""
    better = "CASE WHEN side = 'BUY' THEN mid - fill_price ELSE fill_price - mid END"
    return {
        "spread_capture": f"spread_bps >= {min_spread_bps} AND mid > 0 AND round({better} / mid * 10000, 6) >= {min_improvement_bps}",
        "inventory_balancing": f"abs(directional_before) >= {min_directional} AND {reduces.format('directional_before')}{bond}",
        "completion_set_edge": f"qty_complement IS NOT NULL AND round(fill_price + best_ask, 6) <= {max_set_cost}",
        "depth_imbalance": f"abs(imbalance_top5) >= {min_imbalance} AND (side = 'BUY' AND imbalance_top5 > 0 OR side = 'SELL' AND imbalance_top5 < 0)",
        "event_timing": f"time_to_close_s BETWEEN 0 AND {max_time_to_close_s} AND trade_hour_utc BETWEEN {hours[0]} AND {hours[1]}",
        "correlated_siblings": f"abs(event_exposure_before) >= {min_event_exposure} AND {reduces.format('event_exposure_before')}",
        "closed_cycle": f"spread_bps >= {cycle_spread_bps} AND abs(event_exposure_before) >= {min_event_exposure}",
    }


def rule_split_metrics(spark, sf_dir):
    """Each rule on each temporal split: coverage, precision and false positives by the episode's profit (else the first
    markout), mean markouts, profit and changes of bond and exposure, the largest inventory, edge and summed profit."""
    d = B.temporal_split(lifecycle_dataset(spark, sf_dir))
    fired = F.array(*(F.struct(F.lit(k).alias("rule"), F.coalesce(F.expr(p), F.lit(False)).alias("on")) for k, p in rule_predicates().items()))
    d = d.withColumn("label", F.coalesce("realized_pnl_wac", "markout_5m")).withColumn("f", F.explode(fired))
    on = F.col("f.on")

    def mean(c, name):
        return r4(F.avg(F.when(on, F.col(c))), name)

    known, up = F.count(F.when(on, F.col("label"))), F.count_if(on & (F.col("label") > 0))
    g = d.groupBy(F.col("f.rule").alias("rule"), "split").agg(
        F.count("*").alias("total_fills"), F.count_if(on).alias("explained_fills"), r4(F.count_if(on) / F.count("*"), "coverage"),
        r4(F.coalesce(F.try_divide(up, F.nullif(known, F.lit(0))), F.lit(0.0)), "precision"), r4(F.coalesce(F.try_divide(known - up, F.nullif(known, F.lit(0))), F.lit(0.0)), "false_positive_rate"),
        mean("markout_5m", "avg_markout_5m"), mean("markout_1h", "avg_markout_1h"), mean("realized_pnl_wac", "avg_pnl"), mean("bond_delta", "avg_bond_delta"), mean("event_exposure_delta", "avg_exposure_delta"),
        r4(F.max(F.when(on, F.abs("qty_token_before"))), "max_inventory"), F.round(F.avg(F.when(on, F.col("markout_5m"))) * 10000, 2).alias("edge_bps"), r4(F.sum(F.when(on, F.col("realized_pnl_wac"))), "pnl"),
    )
    return g


def event_timeline(spark, sf_dir):
    """Every event with running quantity and cash of its series and the books around it.

    A series is a (wallet, token); events without a token run by condition, so they never mix with a token's (nor with each
    other under a null key).
    """
    e = ledger(spark, sf_dir)
    run = O.upto(["wallet", "series"])
    e = e.withColumn("series", F.coalesce("token_id", "condition_id"))
    held = F.sum(F.when(F.col("token_id").isNotNull(), F.col("delta_shares")).otherwise(0.0)).over(run)
    cash = -F.sum("delta_usdc").over(run)
    e = e.select("id", "wallet", "token_id", "condition_id", "ts", "event_type", "side", "price", F.round(held, 6).alias("qty_after"), "delta_shares", cash.alias("cash_out_after"), "delta_usdc")
    b = M.books(spark, sf_dir)
    k = e.where("token_id is not null").select("id", "token_id", "ts")
    before = O.asof_backward(k, b, ["token_id"], ["mid", "best_bid", "best_ask"]).select("id", F.col("asof_ts").alias("b_ts"), "mid", "best_bid", "best_ask")
    after = O.asof_forward(k, b, ["token_id"], ["mid"]).select("id", F.col("asof_ts").alias("a_ts"), F.col("mid").alias("mid_after"))
    out = e.join(before, "id", "left").join(after, "id", "left")
    age = F.col("ts") - F.col("b_ts")
    status = (
        F.when(F.col("event_type") != "TRADE", "non_trade").when(age.isNull(), "missing").when(age <= 5, "excellent").when(age <= 15, "good")
        .when(age <= 30, "usable").when(age <= 60, "weak").otherwise("stale")
    )
    return out.select(
        "id", "wallet", "ts", "event_type", r4(F.col("qty_after") - F.when(F.col("token_id").isNotNull(), F.col("delta_shares")).otherwise(0.0), "qty_before"), r4("qty_after"), r4("cash_out_after"),
        r4(F.try_divide("cash_out_after", F.nullif(F.col("qty_after"), F.lit(0.0))), "running_wac_after"), age.alias("book_before_age_s"), "mid", r4(F.col("price") - F.col("mid"), "fill_minus_mid"), r4(F.col("best_ask") - F.col("price"), "ask_minus_fill"),
        (F.col("a_ts") - F.col("ts")).alias("book_after_age_s"), "mid_after", status.alias("context_status"),
    )


def event_totals(spark, sf_dir):
    """Cash flow of a wallet in an event by type, and the edge of the sets that its buys completed there."""
    of = markets(spark).select("condition_id", "event_id")
    e = ledger(spark, sf_dir).join(of, "condition_id")

    def total(kind):
        return F.sum(F.when(F.col("event_type") == kind, F.col("delta_usdc")).otherwise(0.0))

    cash = e.groupBy("wallet", "event_id").agg(
        F.sum("delta_usdc").alias("net"), total("TRADE").alias("trade"), total("MERGE").alias("merge"), total("REDEEM").alias("redeem"),
        F.countDistinct(F.when(F.col("event_type") == "REDEEM", F.col("condition_id"))).alias("conditions_redeemed"),
    )
    m = M.fifo_matches(spark, sf_dir).join(of, "condition_id").groupBy("wallet", "event_id").agg(
        F.count("*").alias("n_pairs"), F.countDistinct("condition_id").alias("n_markets"), F.sum("matched").alias("matched"), F.sum("edge").alias("edge"), F.avg("gap_s").alias("gap")
    )
    out = cash.join(m, ["wallet", "event_id"], "left")
    return out.select(
        "wallet", "event_id", r4("net", "net_cashflow"), r4("trade", "trade_cashflow"), r4("merge", "merge_cashflow"), r4("redeem", "redeem_cashflow"), "conditions_redeemed", "n_pairs", "n_markets",
        r4("matched", "matched_sets"), r4(F.col("matched") - F.col("edge"), "pair_cost"), r4("edge", "theoretical_edge"), r4(F.col("edge") / F.col("matched"), "weighted_edge"), r4(F.col("gap") / 60, "avg_gap_min"),
    )


def maker_context(spark, sf_dir, max_age: int = 30):
    """Books around fills that the wallet made: freshness in minutes; fills with neither book are left out."""
    f = B.trades(spark, sf_dir).where("role = 'maker' and not (side = 'BUY' and id % 3 = 0)").select("id", "wallet", "token_id", "ts")
    b = M.books(spark, sf_dir)
    out = O.asof_backward(f, b, ["token_id"], ["mid"]).withColumnsRenamed({"mid": "mid_before", "asof_ts": "b_ts"})
    out = O.asof_forward(out, b, ["token_id"], ["mid"])
    near = F.col("asof_ts") - F.col("ts") <= max_age * 60
    out = out.withColumns({"age": F.floor((F.col("ts") - F.col("b_ts")) / 60), "after": F.when(near, F.col("mid"))})
    out = out.where("mid_before is not null or after is not null")
    status = scalars.context_status(F.col("age"), max_age)
    return out.groupBy("wallet", status.alias("context_status")).agg(F.count("*").alias("n"), F.count("after").alias("n_after"))


def edge_decay(spark, sf_dir):
    """Drift of the mid in a fill's favour from the book before it to the one after, and the edge left against the latter."""
    c = M.book_asof_context(spark, sf_dir).select("id", "mid_before", "mid_after")
    f = B.trades(spark, sf_dir).select("id", "wallet", "role", "side", "price").join(c, "id")
    alpha = scalars.signed_by_side(scalars.drift_bps(F.col("mid_before"), F.col("mid_after")), F.col("side"))
    edge = [scalars.signed_by_side(scalars.drift_bps(F.col("price"), F.col(m)), F.col("side")) for m in ("mid_before", "mid_after")]
    f = f.where("mid_before is not null and mid_after is not null").withColumns({"alpha": alpha, "e0": edge[0], "e1": edge[1]})
    g = f.groupBy("wallet", F.coalesce("role", F.lit("unenriched")).alias("role"))
    return g.agg(F.count("*").alias("n"), *(F.round(F.avg(c), 2).alias(n) for c, n in (("alpha", "avg_alpha_bps"), ("e0", "avg_edge_bps"), ("e1", "avg_edge_after_bps"))), F.round(F.avg("e0") - F.avg("e1"), 2).alias("decay_bps"))


def transfer_classes(spark, sf_dir):
    """Token transfers of the ledger's moves seen from each wallet: trades between wallets, splits and merges with the null address."""
    null = "0x" + "0" * 40
    t = ledger(spark, sf_dir).where("event_type in ('TRADE', 'SPLIT', 'MERGE')")
    other = F.when(F.col("event_type") != "TRADE", F.lit(null)).otherwise(F.concat(F.lit("w"), F.col("id") % 10))
    gains = (F.col("side") == "BUY") | (F.col("event_type") == "SPLIT")
    t = t.select("wallet", "size", F.when(F.coalesce(gains, F.lit(False)), other).otherwise(F.col("wallet")).alias("sender"), F.when(F.coalesce(gains, F.lit(False)), F.col("wallet")).otherwise(other).alias("receiver"))
    return t.groupBy("wallet", scalars.transfer_class(F.col("sender"), F.col("receiver"), F.col("wallet")).alias("kind")).agg(F.count("*").alias("n"), r4(F.sum("size"), "shares"))


def venue_positions(spark, sf_dir, p):
    """What the venue states: most local holdings, some of another size, price or profit, and a token that nobody holds."""
    last = A.latest(p).where("abs(qty) > 1e-6")
    e = O.episodes(p, KEY).where("close_reason = 'open'").select(*KEY, "wac_entry", F.col("realized_pnl").alias("own_pnl"))
    k = F.substring("token_id", 2, 9).cast("long")
    size = F.when(k % 5 == 0, F.col("qty") + 5).when(k % 3 == 0, F.col("qty") * 1.01).otherwise(F.col("qty"))
    v = last.where(k % 7 != 0).join(e, KEY, "left")
    v = v.select(*KEY, F.round(size, 4).alias("size"), F.round(F.col("wac_entry") + F.when(k % 4 == 0, 0.01).otherwise(0.0), 4).alias("avg_price"), F.round(F.col("own_pnl") + F.when(k % 2 == 0, 1.0).otherwise(0.0), 4).alias("realized_pnl"))
    extra = spark.range(10).select(F.concat(F.lit("w"), "id").alias("wallet"), F.lit("t99").alias("token_id"), F.lit(1.0).alias("size"), F.lit(0.5).alias("avg_price"), F.lit(0.0).alias("realized_pnl"))
    return v.unionByName(extra)


def reconciliation_checks(spark, sf_dir, tolerance: float = 1e-4, wac_tolerance: float = 1e-3, pnl_tolerance: float = 1e-2):
    """Size, average price and realized profit of every position against the venue's: the first reason that applies, and its status.

    Prices and profits are compared where both sides have the position and the local quantity is positive.
    """
    e = ledger(spark, sf_dir)
    p = stored(A.positions(spark, sf_dir))  # read by all parts below
    local = A.latest(p).select(*KEY, F.round("qty", 4).alias("local"), F.col("ts").alias("as_of"))
    venue = venue_positions(spark, sf_dir, p)
    mapped = tokens(spark).join(markets(spark), "condition_id").select("token_id", "closed").withColumn("mapped", F.lit(True))
    neg = A.holdings_negative_runs(spark, sf_dir, p).join(tokens(spark).select("token_id", "condition_id"), "token_id")
    both_kinds = e.where("event_type in ('REDEEM', 'MERGE')").groupBy("wallet", "condition_id", "ts").agg(F.countDistinct("event_type").alias("kinds")).where("kinds = 2").select("wallet", "condition_id", F.col("ts").alias("cause_ts"), F.lit(True).alias("same_ts"))
    neg = neg.join(both_kinds, ["wallet", "condition_id", "cause_ts"], "left")
    merge_caused = neg.where("cause_type = 'MERGE'").select("wallet", "condition_id").distinct().withColumn("merge_near", F.lit(True))
    merged = e.where("event_type = 'MERGE'").groupBy("wallet", "condition_id").agg(F.sum("size").alias("merged"))
    # the wallet's ledger reaches further than its holdings, or has been silent for ten minutes before the run
    run_ts = e.agg(F.max("ts").alias("run_ts"))
    sync = e.groupBy("wallet").agg(F.max("ts").alias("synced")).crossJoin(F.broadcast(run_ts))  # one row
    sync = sync.join(local.groupBy("wallet").agg(F.max("as_of").alias("local_ts")), "wallet", "left")
    skew = (F.col("synced") > F.coalesce("local_ts", F.lit(0))) | (F.col("run_ts") - F.col("synced") > 600)
    sync = sync.select("wallet", skew.alias("skew"))
    j = local.join(venue, KEY, "full").where("abs(local) > 1e-6 or size is not null")
    j = j.join(tokens(spark).select("token_id", "condition_id"), "token_id", "left").join(mapped, "token_id", "left").join(neg.drop("condition_id"), KEY, "left")
    j = j.join(merge_caused, ["wallet", "condition_id"], "left").join(merged, ["wallet", "condition_id"], "left").join(sync, "wallet", "left")
    diff = F.round(F.abs(F.coalesce("local", F.lit(0.0)) - F.coalesce("size", F.lit(0.0))), 6)
    gap = F.col("closed") & (F.col("local") < 0) & (F.coalesce("merged", F.lit(0.0)) >= F.abs("local"))
    reason = (
        F.when(diff == 0, "exact_match").when(diff <= tolerance, "dust_only").when(F.col("mapped").isNull(), "metadata_unavailable_upstream")
        .when(F.col("same_ts"), "same_timestamp_redeem_merge_ordering_ambiguity").when((F.col("cause_type") == "MERGE") | F.col("merge_near"), "merge_condition_scoped_size_gap")
        .when(F.col("cause_type") == "TRADE", F.when(gap, "merge_condition_scoped_size_gap").otherwise("source_api_missing_fill"))
        .when(F.col("local") < -tolerance, "local_negative_holding").when(F.col("skew"), "timing_skew").when(F.col("size").isNull() & (F.col("local") > tolerance), "remote_missing_local_present")
        .when(F.col("local").isNull() & (F.col("size") > tolerance), "local_missing_remote_present").otherwise("unknown")
    )
    j = j.withColumns({"diff": diff, "reason": reason})
    j = stored(j.withColumn("status", _status(F.col("reason"))))  # the size check, read again for prices and profits
    size = j.select(*KEY, F.lit("positions_size").alias("check_type"), F.coalesce("size", F.lit(0.0)).alias("expected"), F.coalesce("local", F.lit(0.0)).alias("computed"), "diff", "reason", "status")
    ep = O.episodes(p, KEY).where("close_reason = 'open'").select(*KEY, "episode", "wac_entry", F.col("realized_pnl").alias("own_pnl"))
    kinds = O.episode_events(p, KEY).join(ep.select(*KEY, "episode"), [*KEY, "episode"]).groupBy(*KEY).agg(F.max((F.col("event_type") == "REDEEM").cast("int")).alias("redeems"), F.max(F.col("event_type").isin("MERGE", "SPLIT").cast("int")).alias("merges"))
    k = j.where(F.col("size").isNotNull() & (F.col("local") > tolerance)).select(*KEY, "avg_price", "realized_pnl", "skew", F.col("status").alias("size_status"))
    k = k.join(ep, KEY, "left").join(kinds, KEY, "left")
    wac_diff = F.round(F.abs(F.col("avg_price") - F.col("wac_entry")), 6)
    wac_reason = (
        F.when(F.col("wac_entry").isNull(), "local_open_episode_missing").when(wac_diff == 0, "exact_match").when(wac_diff <= wac_tolerance, "dust_only")
        .when(F.col("size_status") != "pass", "wac_size_reconciliation_not_clean").when(F.col("skew"), "wac_timing_skew").otherwise("wac_drift")
    )
    pnl_diff = F.round(F.abs(F.col("realized_pnl") - F.col("own_pnl")), 6)
    pnl_reason = (
        F.when(F.col("own_pnl").isNull(), "local_open_episode_missing").when(pnl_diff == 0, "exact_match").when(pnl_diff <= pnl_tolerance, "within_realized_pnl_band").when(F.col("skew"), "timing_skew")
        .when(F.col("redeems") == 1, "realized_pnl_resolution_semantics").when(F.col("merges") == 1, "realized_pnl_merge_split_semantics").otherwise("realized_pnl_trade_accounting_drift")
    )

    def fact(name, expected, computed, d, why):
        return k.select(*KEY, F.lit(name).alias("check_type"), expected.alias("expected"), F.coalesce(computed, F.lit(0.0)).alias("computed"), F.coalesce(d, F.abs(expected)).alias("diff"), why.alias("reason"), _status(why).alias("status"))

    wac = fact("positions_wac_avg_price", F.col("avg_price"), F.col("wac_entry"), wac_diff, wac_reason)
    pnl = fact("positions_realized_pnl", F.col("realized_pnl"), F.col("own_pnl"), pnl_diff, pnl_reason)
    out = size.unionByName(wac).unionByName(pnl)
    return out.select(*KEY, "check_type", r4("expected"), r4("computed"), r4("diff"), "reason", "status")


#: Reasons of a check that has passed, and of one that has failed; all others are warnings. Fixed values.
PASSES = ("exact_match", "dust_only", "within_realized_pnl_band")
FAILS = ("local_negative_holding", "remote_missing_local_present", "local_missing_remote_present", "source_api_missing_fill", "wac_drift", "local_open_episode_missing", "unknown")


def _status(reason):
    return F.when(reason.isin(*PASSES), "pass").when(reason.isin(*FAILS), "fail").otherwise("warn")


def wallet_trust_checks(spark, sf_dir):
    """Trust in a wallet's numbers: a failed size or price check, then a warning of them, then one of profit decides.

    ``since_ts`` is kept from the state before (here: trusted since 1) while the status stays.
    """
    c = reconciliation_checks(spark, sf_dir)
    hard = F.col("check_type") != "positions_realized_pnl"
    g = c.groupBy("wallet").agg(
        F.count_if(hard & (F.col("status") == "fail")).alias("n_fail"), F.count_if(hard & (F.col("status") == "warn")).alias("n_warn"), F.count_if(~hard & (F.col("status") != "pass")).alias("n_pnl"),
    )
    status = F.when(F.col("n_fail") > 0, "untrusted").when(F.col("n_warn") + F.col("n_pnl") > 0, "warn").otherwise("trusted")
    kept = spark.range(10).select(F.concat(F.lit("w"), "id").alias("wallet"), F.when(F.col("id") % 2 == 0, "untrusted").otherwise("trusted").alias("was"))
    out = g.withColumn("status", status).join(kept, "wallet", "left")
    return out.select("wallet", "n_fail", "n_warn", "n_pnl", "status", F.when(F.col("was") == F.col("status"), 1).otherwise(2).cast("long").alias("since_ts"))


def top_discrepancies(spark, sf_dir):
    """The twenty largest differences of the checks that have not passed."""
    f = reconciliation_checks(spark, sf_dir).where("status != 'pass'")
    return f.orderBy(F.desc("diff"), *KEY, "check_type").limit(20).select(*KEY, "check_type", "reason", "diff")


def portfolio_value_check(spark, sf_dir, band: float = 0.02):
    """Value of what a wallet holds against that of what the venue states, both at the outcome or the last trade's price."""
    px = ledger(spark, sf_dir).where("event_type = 'TRADE'").groupBy("token_id").agg(F.max_by("price", F.struct("ts", "id")).alias("px"))
    p = stored(A.positions(spark, sf_dir))
    local = A.latest(p).select(*KEY, "qty")
    j = local.join(venue_positions(spark, sf_dir, p).select(*KEY, "size"), KEY, "full").join(px, "token_id", "left").join(A.token_prices(spark), "token_id", "left")
    mark = F.coalesce("res_price", "px", F.lit(0.0))

    def value(c):
        return F.sum(F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0)) * mark)

    g = j.groupBy("wallet").agg(value("qty").alias("l"), value("size").alias("v"))
    gap = F.when(F.round("v", 6) == 0, F.when(F.round("l", 6) == 0, 0.0).otherwise(1.0)).otherwise(F.abs(F.col("v") - F.col("l")) / F.abs("v"))
    return g.select("wallet", r4("l", "local_value"), r4("v", "venue_value"), r4(gap, "pct_diff"), F.when(gap <= band, "within_value_band").otherwise("value_drift_categorized").alias("reason"), F.when(gap <= band, "pass").otherwise("warn").alias("status"))


def cluster_ranking(spark, sf_dir, leader: str = "w2", window_s: int = 3600):
    """Every other wallet against the leader: share of its trades that match one of the leader's, how, when and at what size,
    the verdict, and the wallets in order of research priority."""
    t = ledger(spark, sf_dir).where("event_type = 'TRADE'").join(markets(spark).select("condition_id", "event_id"), "condition_id")
    t = t.select("id", "ts", "wallet", "token_id", "condition_id", "side", "event_id", "size")
    token, side = F.col("l_token_id") == F.col("r_token_id"), F.col("l_side") == F.col("r_side")
    condition = F.col("l_condition_id") == F.col("r_condition_id")
    tiers = [token & side, token, condition & side, condition]
    m = O.tiered_match(t.where(F.col("wallet") != leader), t.where(F.col("wallet") == leader), tiers, "event_id", window_s)
    lead = t.where(F.col("wallet") == leader).select(F.col("id").alias("r_id"), F.col("size").alias("r_size"))
    m = m.join(lead, "r_id", "left").withColumns({"delay": F.col("l_ts") - F.col("r_ts"), "ratio": F.try_divide("l_size", F.nullif(F.col("r_size"), F.lit(0.0)))})
    hit = F.col("tier").isNotNull()
    g = m.groupBy(F.col("l_wallet").alias("wallet")).agg(
        F.count("*").alias("total"), F.count_if(hit).alias("matched"), F.count_if(F.col("tier") <= 2).alias("same_token"), F.count_if(F.col("delay") < 0).alias("first"),
        F.percentile(F.when(hit, F.abs("delay")), 0.5).alias("delay"), F.percentile(F.when(hit, F.col("ratio")), 0.5).alias("ratio"),
    )
    rate = F.col("same_token") / F.col("total")
    first = F.coalesce(F.try_divide("first", F.nullif(F.col("matched"), F.lit(0))), F.lit(0.0))
    event = F.coalesce(F.try_divide("matched", F.nullif(F.col("matched"), F.lit(0))), F.lit(0.0))  # matches are within one event
    verdict = scalars.cluster_verdict(F.col("total"), F.col("matched"), F.coalesce("delay", F.lit(0.0)), rate, first, event, F.coalesce("ratio", F.lit(0.0)))
    cycles = B.closed_cycle_score(spark, sf_dir).select("wallet", F.col("score").alias("cycles"))
    e = A.daily_equity(spark, sf_dir)
    end = e.groupBy("wallet").agg(F.max("day").alias("_end"))
    week = e.join(end, "wallet").groupBy("wallet").agg(F.max_by("marked_pnl", "day").alias("now"), F.max_by("marked_pnl", F.when(F.col("day") <= F.col("_end") - 7, F.col("day"))).alias("then"))
    g = g.join(cycles, "wallet", "left").join(week.select("wallet", F.coalesce(F.col("now") - F.col("then"), F.lit(0.0)).alias("pnl_1w")), "wallet", "left")
    g = g.withColumn("priority", F.round(scalars.research_priority(rate, F.coalesce("cycles", F.lit(0.0)), F.coalesce("pnl_1w", F.lit(0.0))), 6))
    rank = F.row_number().over(Window.orderBy(F.desc("priority"), "wallet"))  # one row a wallet
    return g.select("wallet", "total", "matched", r4(rate, "same_token_rate"), r4("delay", "median_delay_s"), r4(first, "candidate_first_share"), r4("ratio", "size_ratio_median"), verdict.alias("verdict"), r4("pnl_1w"), r4("priority", "research_priority"), rank.cast("long").alias("rank"))


def pnl_bridge(spark, sf_dir):
    """From cash to profit by wallet, for all markets and for sports: buys, sells, merges, redeems, rewards, and the realized
    profit that completed sets, redeems and plain sells gave, with the share that completion explains."""
    c = F.coalesce("category", F.lit("unclassified"))
    scope = F.explode(F.when(c == "sports", F.array(F.lit("all"), F.lit("sports"))).otherwise(F.array(F.lit("all"))))
    of = markets(spark).select("condition_id", "category")
    e = ledger(spark, sf_dir).join(of, "condition_id", "left").withColumn("scope", scope)

    def total(cond, sign=1):
        return F.sum(F.when(cond, sign * F.col("delta_usdc")).otherwise(0.0))

    kind = F.col("event_type")
    cash = e.groupBy("wallet", "scope").agg(
        total(F.col("side") == "BUY", -1).alias("buy_cost"), total(F.col("side") == "SELL").alias("sell_proceeds"), total(kind == "MERGE").alias("merge_proceeds"),
        total(kind == "REDEEM").alias("redeem_proceeds"), total(kind == "REWARD").alias("rewards"),
    )
    p = A.positions(spark, sf_dir).where("kind != 'add'").join(of, "condition_id", "left").withColumn("scope", scope)
    edge = p.groupBy("wallet", "scope").agg(*(F.sum(F.when(kind == k, F.col("realized")).otherwise(0.0)).alias(n) for k, n in (("MERGE", "merge_edge"), ("REDEEM", "redeem_edge"), ("TRADE", "directional"))))
    fees = B.fee_estimates_scd2(spark, sf_dir).join(ledger(spark, sf_dir).select("id", "wallet"), "id").groupBy("wallet").agg(F.sum("fee").alias("fees"))
    out = cash.join(edge, ["wallet", "scope"], "left").fillna(0.0).join(fees, "wallet", "left")
    done = F.col("merge_edge") + F.col("redeem_edge")
    gross = done + F.col("directional") + F.col("rewards")
    names = ["buy_cost", "sell_proceeds", "merge_proceeds", "redeem_proceeds", "rewards", "merge_edge", "redeem_edge", "directional"]
    return out.select("wallet", "scope", *(r4(n) for n in names), r4("fees", "estimated_fees"), r4(done, "completion_pnl"), r4(gross, "gross_pnl"), r4(F.round(F.try_divide(done, F.nullif(F.round(gross, 6), F.lit(0.0))) * 100, 2), "pct_from_completion"), r4(gross - F.coalesce("fees", F.lit(0.0)), "net_after_fees"))


def set_audit(spark, sf_dir):
    """Each (wallet, condition): bought on both legs, merged, split and redeemed; the realized edge of its merges a set; and how
    unequal the legs are."""
    e = ledger(spark, sf_dir)
    kind = F.col("event_type")

    def total(cond, value):
        return F.sum(F.when(cond, F.col(value)).otherwise(0.0))

    buy = F.col("side") == "BUY"
    g = e.groupBy("wallet", "condition_id").agg(
        *(total(buy & (F.col("outcome_index") == k), "size").alias(f"buy{k}") for k in (0, 1)), total(kind == "MERGE", "size").alias("merged"), total(kind == "MERGE", "delta_usdc").alias("merge_usdc"),
        total(kind == "SPLIT", "size").alias("split"), total(kind == "REDEEM", "delta_usdc").alias("redeem_usdc"),
    )
    edge = A.positions(spark, sf_dir).where("event_type = 'MERGE'").groupBy("wallet", "condition_id").agg(F.sum("realized").alias("edge"), F.sum("usdc").alias("paid"))
    out = g.join(edge, ["wallet", "condition_id"], "left")
    pairs = F.least("buy0", "buy1")
    gap = F.abs(F.col("buy0") - F.col("buy1"))
    some = F.nullif(F.round("merged", 6), F.lit(0.0))
    return out.select(
        "wallet", "condition_id", r4("buy0", "token0_buy_qty"), r4("buy1", "token1_buy_qty"), r4(pairs, "matched_pair_qty"), r4("merged", "merge_sets"), r4(pairs - F.col("merged"), "pair_qty_vs_merge_diff"), r4("split", "split_sets"), r4("merge_usdc"), r4("redeem_usdc"),
        r4(F.try_divide(F.col("paid") - F.col("edge"), some), "pair_cost_per_set"), r4("edge", "realized_edge"), r4(F.try_divide("edge", some), "realized_edge_per_set"), r4(gap, "imbalance_qty"), r4(F.try_divide(gap, F.nullif(F.round(F.greatest("buy0", "buy1"), 6), F.lit(0.0))), "imbalance_ratio"),
    )


def redeem_pro_rata(spark, sf_dir):
    """Redeem cash of a (wallet, condition) over the buys before it, in proportion to their shares; nothing to redeem, nothing given."""
    e = ledger(spark, sf_dir)
    keys = ["wallet", "condition_id"]
    seg = F.coalesce(F.sum(F.when(F.col("event_type") == "REDEEM", 1).otherwise(0)).over(O.before(keys)), F.lit(0))
    e = e.where("side = 'BUY' or event_type = 'REDEEM'").withColumn("seg", seg)
    paid = e.where("event_type = 'REDEEM'").groupBy(*keys, "seg").agg(F.sum("delta_usdc").alias("paid"))
    lots = e.where("side = 'BUY'").withColumn("all", F.sum("size").over(Window.partitionBy(*keys, "seg")))
    out = lots.join(paid, [*keys, "seg"])
    return out.select("id", *keys, r4("size"), r4(F.try_divide(F.col("paid") * F.col("size"), F.nullif(F.round("all", 6), F.lit(0.0))), "redeemed_usdc"))


def profit_by_event(spark, sf_dir):
    """Realized profit by market rolled up to events, with the share of the largest and the three largest in absolute profit, and
    the events of a wallet ranked by profit, then markets, then name."""
    p = A.positions(spark, sf_dir).where("kind != 'add'").join(markets(spark).select("condition_id", "event_id"), "condition_id")
    m = p.groupBy("wallet", "event_id", "condition_id").agg(F.round(F.sum("realized"), 6).alias("pnl"))
    big = Window.partitionBy("wallet", "event_id").orderBy(F.desc(F.abs("pnl")), "condition_id")
    m = m.withColumn("nth", F.row_number().over(big))
    g = m.groupBy("wallet", "event_id").agg(
        F.count("*").alias("n_markets"), F.sum("pnl").alias("pnl"), F.sum(F.abs("pnl")).alias("all"), *(F.sum(F.when(F.col("nth") <= n, F.abs("pnl")).otherwise(0.0)).alias(f"top{n}") for n in (1, 3))
    )
    rank = F.row_number().over(Window.partitionBy("wallet").orderBy(F.desc(F.round("pnl", 4)), F.desc("n_markets"), "event_id"))
    share = [r4(F.try_divide(f"top{n}", F.nullif(F.round("all", 6), F.lit(0.0))), f"top{n}_share") for n in (1, 3)]
    return g.select("wallet", "event_id", "n_markets", r4("pnl"), *share, rank.cast("long").alias("rank"))


def watch_acceptance(spark, sf_dir):
    """Checks that the watch is fit for use, each with its number and whether it holds."""
    books, fills = M.books(spark, sf_dir), M.book_asof_context(spark, sf_dir)
    b = books.agg(F.count("*").alias("n"), F.countDistinct("token_id").alias("tokens"), (F.max("ts") - F.min("ts")).alias("span"), F.count_if(F.col("best_ask") <= F.col("best_bid")).alias("crossed"))
    c = fills.agg(F.count("*").alias("fills"), F.count_if(F.col("status") != "missing").alias("with_book"), F.count_if(F.col("age_before_s") < 0).alias("future"))
    w = B.watchlist(spark, sf_dir).agg(F.count("*").alias("watched"))
    one = b.crossJoin(c).crossJoin(w)  # one row each
    checks = {
        "books_written": ("n", F.col("n") > 0), "tokens_sampled": ("tokens", F.col("tokens") >= 10), "span_s": ("span", F.col("span") >= 3600), "no_crossed_books": ("crossed", F.col("crossed") == 0),
        "fills_with_context": ("with_book", F.col("with_book") * 2 >= F.col("fills")), "no_book_from_the_future": ("future", F.col("future") == 0), "watchlist_filled": ("watched", F.col("watched") > 0),
    }
    tall = F.array(*(F.struct(F.lit(k).alias("check"), F.col(v).cast("long").alias("value"), ok.alias("passed")) for k, (v, ok) in checks.items()))
    return one.select(F.explode(tall).alias("x")).select("x.*")


QUERIES = {
    f.__name__: f
    for f in (
        top_discrepancies, condition_state, event_state, lifecycle_dataset, rule_split_metrics, event_timeline, event_totals, maker_context, edge_decay, transfer_classes, reconciliation_checks, wallet_trust_checks, portfolio_value_check,
        cluster_ranking, pnl_bridge, set_audit, redeem_pro_rata, profit_by_event, watch_acceptance,
    )
}

_EP2 = """
ep2 AS (SELECT wallet, token_id, episode, min(ts) AS open_ts, max(ts) FILTER (closes) AS close_ts, CASE WHEN NOT bool_or(closes) THEN 'open' WHEN arg_max(kind, (ts, id)) = 'reset' THEN 'resolution' ELSE 'flat' END AS close_reason,
   arg_max(event_type, (ts, id)) AS last_type, greatest(max(qty), 0) AS peak_qty, arg_max(w, (ts, id)) FILTER (w IS NOT NULL) AS wac_entry, sum(CASE WHEN qty_before > 0 THEN realized ELSE 0 END) AS realized_pnl
   FROM (SELECT *, CASE WHEN NOT closes AND qty > 0 THEN cost / qty WHEN NOT closes AND kind = 'remove' AND qty_before > 0 AND qty < 0 THEN 0 END AS w FROM x3) GROUP BY 1, 2, 3 HAVING count(*) FILTER (kind <> 'reset') > 0)"""
_DEEP = """
deep AS (SELECT * FROM (SELECT *, (bid1 - ask1) / nullif(bid1 + ask1, 0) AS imb1, (bid5 - ask5) / (bid5 + ask5) AS imb5, row_number() OVER (PARTITION BY token_id, ts ORDER BY mid DESC, best_bid DESC, best_ask DESC, bid1 DESC, ask1 DESC, bid5 DESC, ask5 DESC) AS rn FROM books) WHERE rn = 1)"""
_LIFE = """
lf0 AS (SELECT *, CASE WHEN neg_risk THEN sum(CASE WHEN leg IS NOT NULL THEN net_change ELSE 0 END) OVER (PARTITION BY wallet, event_id ORDER BY ts, id, condition_id, leg NULLS FIRST ROWS UNBOUNDED PRECEDING) END AS event_net FROM legs LEFT JOIN (SELECT condition_id, event_id, neg_risk FROM markets) USING (condition_id)),
lf1 AS (SELECT t.*, s.episode, s.leg, s.qty, s.qty_before, s.q0, s.q1, s.net_change, s.event_net FROM trades t LEFT JOIN (SELECT * FROM lf0 WHERE event_type = 'TRADE') s ON s.id = t.id AND s.token_id = t.token_id WHERE NOT (t.side = 'BUY' AND t.id % 3 = 0)),
lf2 AS (SELECT f.*, b.ts AS book_ts, b.mid, b.best_bid, b.best_ask, b.bid1, b.ask1, b.bid5, b.ask5, b.imb1, b.imb5 FROM lf1 f ASOF LEFT JOIN deep b ON f.token_id = b.token_id AND f.ts >= b.ts),
lf3 AS (SELECT f.*, b.ts AS after_ts, f.ts + 86400 AS t24, f.ts + 300 AS t5, f.ts + 900 AS t15, f.ts + 3600 AS t60 FROM lf2 f ASOF LEFT JOIN deep b ON f.token_id = b.token_id AND f.ts <= b.ts),
pl AS (SELECT wallet, token_id, ts, arg_max(qty, id) AS later_qty FROM positions GROUP BY 1, 2, 3),
lf4 AS (SELECT f.*, pl.later_qty FROM lf3 f ASOF LEFT JOIN pl ON f.wallet = pl.wallet AND f.token_id = pl.token_id AND f.t24 >= pl.ts),
lf5 AS (SELECT f.*, CASE WHEN b.ts <= f.t5 + 600 THEN b.mid END AS m5 FROM lf4 f ASOF LEFT JOIN deep b ON f.token_id = b.token_id AND f.t5 <= b.ts),
lf6 AS (SELECT f.*, CASE WHEN b.ts <= f.t15 + 1800 THEN b.mid END AS m15 FROM lf5 f ASOF LEFT JOIN deep b ON f.token_id = b.token_id AND f.t15 <= b.ts),
lf7 AS (SELECT f.*, CASE WHEN b.ts <= f.t60 + 7200 THEN b.mid END AS m60 FROM lf6 f ASOF LEFT JOIN deep b ON f.token_id = b.token_id AND f.t60 <= b.ts),
lf8 AS (SELECT f.*, CASE WHEN b.ts <= f.t24 + 172800 THEN b.mid END AS m24 FROM lf7 f ASOF LEFT JOIN deep b ON f.token_id = b.token_id AND f.t24 <= b.ts),
lf9 AS (SELECT f.*, e.open_ts, e.close_ts, e.peak_qty, e.wac_entry, e.realized_pnl, m.closed_ts, CASE WHEN leg = 0 THEN q1 WHEN leg = 1 THEN q0 END AS other,
   CASE WHEN close_reason = 'open' THEN 'OPEN' WHEN close_reason = 'flat' THEN CASE last_type WHEN 'TRADE' THEN 'SELL' WHEN 'MERGE' THEN 'MERGE' ELSE 'MIXED' END WHEN close_reason = 'resolution' THEN CASE WHEN last_type IN ('REDEEM', 'REDEEM_PAYOUT') THEN 'REDEEM' ELSE 'UNKNOWN' END ELSE 'UNKNOWN' END AS path
   FROM lf8 f LEFT JOIN ep2 e ON e.wallet = f.wallet AND e.token_id = f.token_id AND e.episode = f.episode LEFT JOIN markets m ON m.condition_id = f.condition_id),
life AS (SELECT *, CASE WHEN leg = 0 THEN qty_before - other WHEN leg = 1 THEN other - qty_before END AS db, CASE WHEN leg = 0 THEN qty - other WHEN leg = 1 THEN other - qty END AS da,
   CASE WHEN leg IS NOT NULL THEN least(qty_before, other) END AS bb, CASE WHEN leg IS NOT NULL THEN least(qty, other) END AS ba, CASE WHEN path NOT IN ('OPEN', 'UNKNOWN') THEN realized_pnl END AS pnl, CASE WHEN side = 'BUY' THEN 1 ELSE -1 END AS sign FROM lf9)"""


def _r(expr: str, name: str) -> str:
    return f"round({expr}, 4) + 0 AS {name}"


_LIFE_SELECT = "SELECT id, wallet, token_id, condition_id, ts AS trade_ts, side, role, price AS fill_price, " + ", ".join([
    _r("size", "fill_shares"), _r("size * price", "fill_notional"), "category, event_id, closed_ts - ts AS time_to_close_s, ts % 86400 // 3600 AS trade_hour_utc, ts - book_ts AS book_before_age_s, after_ts - ts AS book_after_age_s",
    "CASE WHEN book_ts IS NULL THEN 'missing' WHEN (ts - book_ts) // 60 > 240 THEN 'stale' WHEN (ts - book_ts) // 60 <= 2 THEN 'excellent' WHEN (ts - book_ts) // 60 <= 5 THEN 'good' WHEN (ts - book_ts) // 60 <= 10 THEN 'usable' ELSE 'weak' END AS context_status",
    "best_bid, best_ask, mid", _r("best_ask - best_bid", "spread"), _r("(best_ask - best_bid) / nullif(mid, 0) * 10000", "spread_bps"), _r("bid1", "bid_depth_top1"), _r("ask1", "ask_depth_top1"), _r("bid5", "bid_depth_top5"), _r("ask5", "ask_depth_top5"), _r("imb1", "imbalance_top1"), _r("imb5", "imbalance_top5"),
    _r("price - mid", "distance_fill_to_mid"), _r("price - best_bid", "distance_fill_to_bid"), _r("price - best_ask", "distance_fill_to_ask"), "(price > best_bid AND price < best_ask)::INT AS fill_inside_spread, (price = best_bid)::INT AS fill_at_best_bid, (price = best_ask)::INT AS fill_at_best_ask",
    _r("qty_before", "qty_token_before"), _r("qty", "qty_token_after"), _r("other", "qty_complement"), _r("db", "directional_before"), _r("bb", "bond_before"), _r("bb / nullif(round(bb + abs(db), 8), 0)", "bond_ratio_before"), _r("da", "directional_after"), _r("ba", "bond_after"), _r("ba / nullif(round(ba + abs(da), 8), 0)", "bond_ratio_after"),
    _r("ba - bb", "bond_delta"), _r("da - db", "directional_delta"), _r("event_net - net_change", "event_exposure_before"), _r("event_net", "event_exposure_after"), _r("CASE WHEN event_net IS NOT NULL THEN net_change END", "event_exposure_delta"), "path AS close_path, close_ts, close_ts - open_ts AS hold_seconds",
    _r("pnl", "realized_pnl_wac"), _r("pnl / nullif(round(peak_qty, 6), 0)", "realized_pnl_per_share"), _r("round(pnl / nullif(round(wac_entry * peak_qty, 6), 0) * 10000, 2)", "realized_pnl_bps_on_cost"), _r("later_qty", "remaining_open_qty_after_24h"), "(abs(later_qty) > 1e-6)::INT AS is_open_after_24h",
    _r("sign * (m5 - price)", "markout_5m"), _r("sign * (m15 - price)", "markout_15m"), _r("sign * (m60 - price)", "markout_1h"), _r("sign * (m24 - price)", "markout_24h"), _r("CASE WHEN path = 'RESOLUTION' THEN pnl END", "pnl_at_resolution"),
    "nullif(concat_ws(',', CASE WHEN mid IS NULL THEN 'no_book' END, CASE WHEN closed_ts IS NULL THEN 'missing_market_metadata' END, CASE WHEN leg IS NULL THEN 'no_complement_token' END, CASE WHEN path = 'OPEN' THEN 'position_still_open' END, CASE WHEN later_qty IS NULL THEN 'no_quantity_after_24h' END), '') AS null_reasons",
]) + " FROM life"

ORACLE = {
    "condition_state": sql("""SELECT id, wallet, condition_id, round(q0, 4) + 0 AS qty_yes, round(q1, 4) + 0 AS qty_no, round(c0, 4) + 0 AS cost_yes, round(c1, 4) + 0 AS cost_no, round(CASE WHEN q0 > 1e-6 THEN c0 / q0 + 1e-9 ELSE 0 END, 4) + 0 AS wac_yes, round(CASE WHEN q1 > 1e-6 THEN c1 / q1 + 1e-9 ELSE 0 END, 4) + 0 AS wac_no,
round(greatest(least(q0, q1), 0), 4) + 0 AS paired_qty, round(greatest(q0 - greatest(least(q0, q1), 0), 0), 4) + 0 AS unpaired_yes, round(greatest(q1 - greatest(least(q0, q1), 0), 0), 4) + 0 AS unpaired_no, round(least(c0, c1), 4) + 0 AS bond_cost, round(q0 - q1, 4) + 0 AS directional FROM legs WHERE event_type = 'TRADE' AND leg IS NOT NULL""", POSITIONS, A._LEGS),
    "event_state": sql("""SELECT id, wallet, event_id, round(tq, 4) + 0 AS total_qty, round(tc, 4) + 0 AS total_cost, round(bq, 4) + 0 AS bond_qty, round(up, 4) + 0 AS unpaired, round(ex, 4) + 0 AS exposure, ac::BIGINT AS market_count_active FROM
(SELECT id, wallet, event_id, event_type, sum(tq) OVER w AS tq, sum(tc) OVER w AS tc, sum(bq) OVER w AS bq, sum(up) OVER w AS up, sum(ex) OVER w AS ex, sum(ac) OVER w AS ac FROM
 (SELECT id, wallet, event_id, event_type, ts, condition_id, leg, va - coalesce(lag(va) OVER o, 0) AS tq, vb - coalesce(lag(vb) OVER o, 0) AS tc, vc - coalesce(lag(vc) OVER o, 0) AS bq, vd - coalesce(lag(vd) OVER o, 0) AS up, ve - coalesce(lag(ve) OVER o, 0) AS ex, vf - coalesce(lag(vf) OVER o, 0) AS ac FROM
  (SELECT l.*, m.event_id, q0 + q1 AS va, c0 + c1 AS vb, greatest(least(q0, q1), 0) AS vc, greatest(q0 - greatest(least(q0, q1), 0), 0) + greatest(q1 - greatest(least(q0, q1), 0), 0) AS vd, abs(q0 - q1) AS ve, CASE WHEN abs(q0 + q1) > 1e-6 THEN 1 ELSE 0 END AS vf FROM legs l JOIN markets m USING (condition_id) WHERE leg IS NOT NULL)
  WINDOW o AS (PARTITION BY wallet, condition_id ORDER BY ts, id, leg)) WINDOW w AS (PARTITION BY wallet, event_id ORDER BY ts, id, condition_id, leg ROWS UNBOUNDED PRECEDING)) WHERE event_type = 'TRADE'""", POSITIONS, A._LEGS),
    "lifecycle_dataset": sql(_LIFE_SELECT, POSITIONS, A._EPISODES, _EP2, B._FEES, M._BOOKS, _DEEP, A._LEGS, _LIFE),
    "rule_split_metrics": sql("""SELECT rule, split, count(*) AS total_fills, count(*) FILTER (f) AS explained_fills, round(count(*) FILTER (f) / count(*), 4) AS coverage, round(coalesce(count(*) FILTER (f AND label > 0) / nullif(count(label) FILTER (f), 0), 0), 4) AS precision,
round(coalesce(count(*) FILTER (f AND label <= 0) / nullif(count(label) FILTER (f), 0), 0), 4) AS false_positive_rate, round(avg(markout_5m) FILTER (f), 4) + 0 AS avg_markout_5m, round(avg(markout_1h) FILTER (f), 4) + 0 AS avg_markout_1h, round(avg(realized_pnl_wac) FILTER (f), 4) + 0 AS avg_pnl, round(avg(bond_delta) FILTER (f), 4) + 0 AS avg_bond_delta,
round(avg(event_exposure_delta) FILTER (f), 4) + 0 AS avg_exposure_delta, round(max(abs(qty_token_before)) FILTER (f), 4) + 0 AS max_inventory, round(avg(markout_5m) FILTER (f) * 10000, 2) AS edge_bps, round(sum(realized_pnl_wac) FILTER (f), 4) + 0 AS pnl FROM (SELECT rule, split, f, coalesce(realized_pnl_wac, markout_5m) AS label, markout_5m, markout_1h, realized_pnl_wac, bond_delta, event_exposure_delta, qty_token_before FROM (
""" + " UNION ALL ".join(f"SELECT *, '{k}' AS rule, coalesce({p}, false) AS f FROM rs" for k, p in rule_predicates().items()) + ")) GROUP BY 1, 2", POSITIONS, A._EPISODES, _EP2, B._FEES, M._BOOKS, _DEEP, A._LEGS, _LIFE, "ld AS (" + _LIFE_SELECT + ")",
        "rs AS (SELECT *, CASE WHEN r < floor(n * 0.6) THEN 'train' WHEN r < floor(n * 0.8) THEN 'validation' ELSE 'test' END AS split FROM (SELECT *, row_number() OVER (ORDER BY trade_ts, id) - 1 AS r, count(*) OVER () AS n FROM ld))"),
    "event_timeline": sql("""SELECT id, wallet, ts, event_type, round(qa - CASE WHEN token_id IS NOT NULL THEN delta_shares ELSE 0 END, 4) + 0 AS qty_before, round(qa, 4) + 0 AS qty_after, round(ca, 4) + 0 AS cash_out_after, round(ca / nullif(qa, 0), 4) + 0 AS running_wac_after, ts - b_ts AS book_before_age_s, mid,
round(price - mid, 4) + 0 AS fill_minus_mid, round(best_ask - price, 4) + 0 AS ask_minus_fill, a_ts - ts AS book_after_age_s, mid_after, CASE WHEN event_type <> 'TRADE' THEN 'non_trade' WHEN b_ts IS NULL THEN 'missing' WHEN ts - b_ts <= 5 THEN 'excellent' WHEN ts - b_ts <= 15 THEN 'good' WHEN ts - b_ts <= 30 THEN 'usable' WHEN ts - b_ts <= 60 THEN 'weak' ELSE 'stale' END AS context_status
FROM (SELECT e.*, b.ts AS b_ts, b.mid, b.best_ask, a.ts AS a_ts, a.mid AS mid_after FROM (SELECT *, round(sum(CASE WHEN token_id IS NOT NULL THEN delta_shares ELSE 0 END) OVER w, 6) AS qa, -sum(delta_usdc) OVER w AS ca FROM ledger WINDOW w AS (PARTITION BY wallet, coalesce(token_id, condition_id) ORDER BY ts, id ROWS UNBOUNDED PRECEDING)) e
ASOF LEFT JOIN one_book b ON e.token_id = b.token_id AND e.ts >= b.ts ASOF LEFT JOIN one_book a ON e.token_id = a.token_id AND e.ts <= a.ts)""", M._BOOKS),
    "event_totals": sql("""SELECT wallet, event_id, round(net, 4) + 0 AS net_cashflow, round(t, 4) + 0 AS trade_cashflow, round(mg, 4) + 0 AS merge_cashflow, round(rd, 4) + 0 AS redeem_cashflow, conditions_redeemed, n_pairs, n_markets, round(matched, 4) + 0 AS matched_sets, round(matched - edge, 4) + 0 AS pair_cost, round(edge, 4) + 0 AS theoretical_edge, round(edge / matched, 4) + 0 AS weighted_edge, round(gap / 60, 4) + 0 AS avg_gap_min
FROM (SELECT wallet, event_id, sum(delta_usdc) AS net, sum(CASE WHEN event_type = 'TRADE' THEN delta_usdc ELSE 0 END) AS t, sum(CASE WHEN event_type = 'MERGE' THEN delta_usdc ELSE 0 END) AS mg, sum(CASE WHEN event_type = 'REDEEM' THEN delta_usdc ELSE 0 END) AS rd, count(DISTINCT CASE WHEN event_type = 'REDEEM' THEN condition_id END) AS conditions_redeemed FROM ledger JOIN markets USING (condition_id) GROUP BY 1, 2)
LEFT JOIN (SELECT wallet, event_id, count(*) AS n_pairs, count(DISTINCT condition_id) AS n_markets, sum(matched) AS matched, sum(edge) AS edge, avg(gap_s) AS gap FROM matches JOIN markets USING (condition_id) GROUP BY 1, 2) USING (wallet, event_id)""", M._fifo()),
    "maker_context": sql("""SELECT wallet, CASE WHEN age IS NULL THEN 'missing' WHEN age > 30 THEN 'stale' WHEN age <= 2 THEN 'excellent' WHEN age <= 5 THEN 'good' WHEN age <= 10 THEN 'usable' ELSE 'weak' END AS context_status, count(*) AS n, count(after) AS n_after FROM (SELECT f.wallet, (f.ts - b.ts) // 60 AS age, b.mid AS before, CASE WHEN a.ts - f.ts <= 1800 THEN a.mid END AS after
FROM (SELECT * FROM trades WHERE role = 'maker' AND NOT (side = 'BUY' AND id % 3 = 0)) f ASOF LEFT JOIN one_book b ON f.token_id = b.token_id AND f.ts >= b.ts ASOF LEFT JOIN one_book a ON f.token_id = a.token_id AND f.ts <= a.ts) WHERE before IS NOT NULL OR after IS NOT NULL GROUP BY 1, 2""", M._BOOKS, B._FEES),
    "edge_decay": sql("""SELECT wallet, coalesce(role, 'unenriched') AS role, count(*) AS n, round(avg(s * (mid_after - mid_before) / nullif(mid_before, 0) * 10000), 2) AS avg_alpha_bps, round(avg(s * (mid_before - price) / price * 10000), 2) AS avg_edge_bps, round(avg(s * (mid_after - price) / price * 10000), 2) AS avg_edge_after_bps,
round(avg(s * (mid_before - price) / price * 10000) - avg(s * (mid_after - price) / price * 10000), 2) AS decay_bps FROM (SELECT t.*, c.mid_before, c.mid_after, CASE WHEN side = 'BUY' THEN 1 ELSE -1 END AS s FROM trades t JOIN context c USING (id) WHERE mid_before IS NOT NULL AND mid_after IS NOT NULL) GROUP BY 1, 2""", M._BOOKS, M._CONTEXT, B._FEES),
    "transfer_classes": sql("""SELECT wallet, CASE WHEN NOT gains AND event_type <> 'TRADE' THEN 'BURN' WHEN gains AND event_type <> 'TRADE' THEN 'MINT' WHEN gains OR 'w' || (id % 10) = wallet THEN 'TRANSFER_IN' ELSE 'TRANSFER_OUT' END AS kind, count(*) AS n, round(sum(size), 4) AS shares
FROM (SELECT *, coalesce(side = 'BUY', false) OR event_type = 'SPLIT' AS gains FROM ledger WHERE event_type IN ('TRADE', 'SPLIT', 'MERGE')) GROUP BY 1, 2"""),
}
_NEG = """
ng AS (SELECT wallet, token_id, id AS cause_id, ts AS cause_ts, event_type AS cause_type FROM
 (SELECT *, row_number() OVER (PARTITION BY wallet, token_id ORDER BY ts, id) AS first FROM
  (SELECT *, max(run) OVER (PARTITION BY wallet, token_id) AS last_run, last_value(neg) OVER (PARTITION BY wallet, token_id ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ends FROM
   (SELECT *, qty < -1e-6 AS neg, sum(CASE WHEN qty < -1e-6 THEN 0 ELSE 1 END) OVER (PARTITION BY wallet, token_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS run FROM positions)) WHERE neg AND ends AND run = last_run) WHERE first = 1)"""
_CHECKS = """
oe AS (SELECT * FROM ep2 WHERE close_reason = 'open'),
vp AS (SELECT wallet, token_id, round(CASE WHEN k % 5 = 0 THEN qty + 5 WHEN k % 3 = 0 THEN qty * 1.01::DOUBLE ELSE qty END, 4) AS size, round(wac_entry + CASE WHEN k % 4 = 0 THEN 0.01::DOUBLE ELSE 0 END, 4) AS avg_price, round(realized_pnl + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END, 4) AS realized_pnl
   FROM (SELECT *, substr(token_id, 2)::BIGINT AS k FROM last WHERE abs(qty) > 1e-6) LEFT JOIN oe USING (wallet, token_id) WHERE k % 7 <> 0 UNION ALL SELECT 'w' || r, 't99', 1.0, 0.5, 0.0 FROM range(10) g(r)),
lo AS (SELECT wallet, token_id, round(qty, 4) AS local, ts AS as_of FROM last),
nt AS (SELECT ng.*, t.condition_id, EXISTS (SELECT 1 FROM ledger l WHERE l.wallet = ng.wallet AND l.condition_id = t.condition_id AND l.ts = ng.cause_ts AND l.event_type = 'MERGE') AND EXISTS (SELECT 1 FROM ledger l WHERE l.wallet = ng.wallet AND l.condition_id = t.condition_id AND l.ts = ng.cause_ts AND l.event_type = 'REDEEM') AS same_ts FROM ng JOIN tokens t USING (token_id)),
mn AS (SELECT DISTINCT wallet, condition_id FROM nt WHERE cause_type = 'MERGE'),
mz AS (SELECT wallet, condition_id, sum(size) AS merged FROM ledger WHERE event_type = 'MERGE' GROUP BY 1, 2),
sy AS (SELECT wallet, synced > coalesce(local_ts, 0) OR (SELECT max(ts) FROM ledger) - synced > 600 AS skew FROM (SELECT wallet, max(ts) AS synced FROM ledger GROUP BY 1) LEFT JOIN (SELECT wallet, max(as_of) AS local_ts FROM lo GROUP BY 1) USING (wallet)),
k0 AS (SELECT coalesce(lo.wallet, vp.wallet) AS wallet, coalesce(lo.token_id, vp.token_id) AS token_id, local, size, avg_price, realized_pnl FROM lo FULL JOIN vp ON lo.wallet = vp.wallet AND lo.token_id = vp.token_id WHERE abs(local) > 1e-6 OR size IS NOT NULL),
k1 AS (SELECT k0.*, t.condition_id, m.closed, m.condition_id IS NOT NULL AS mapped, nt.cause_type, nt.same_ts, mn.wallet IS NOT NULL AS merge_near, mz.merged, sy.skew, round(abs(coalesce(local, 0) - coalesce(size, 0)), 6) AS diff
   FROM k0 LEFT JOIN tokens t ON t.token_id = k0.token_id LEFT JOIN markets m ON m.condition_id = t.condition_id LEFT JOIN nt ON nt.wallet = k0.wallet AND nt.token_id = k0.token_id LEFT JOIN mn ON mn.wallet = k0.wallet AND mn.condition_id = t.condition_id LEFT JOIN mz ON mz.wallet = k0.wallet AND mz.condition_id = t.condition_id LEFT JOIN sy ON sy.wallet = k0.wallet),
k2 AS (SELECT *, CASE WHEN diff = 0 THEN 'exact_match' WHEN diff <= 1e-4 THEN 'dust_only' WHEN NOT mapped THEN 'metadata_unavailable_upstream' WHEN same_ts THEN 'same_timestamp_redeem_merge_ordering_ambiguity' WHEN cause_type = 'MERGE' OR merge_near THEN 'merge_condition_scoped_size_gap'
   WHEN cause_type = 'TRADE' THEN CASE WHEN closed AND local < 0 AND coalesce(merged, 0) >= abs(local) THEN 'merge_condition_scoped_size_gap' ELSE 'source_api_missing_fill' END WHEN local < -1e-4 THEN 'local_negative_holding' WHEN skew THEN 'timing_skew' WHEN size IS NULL AND local > 1e-4 THEN 'remote_missing_local_present' WHEN local IS NULL AND size > 1e-4 THEN 'local_missing_remote_present' ELSE 'unknown' END AS reason FROM k1),
kt AS (SELECT wallet, token_id, bool_or(event_type = 'REDEEM') AS redeems, bool_or(event_type IN ('MERGE', 'SPLIT')) AS merges FROM x2 JOIN (SELECT wallet, token_id, episode FROM oe) USING (wallet, token_id, episode) GROUP BY 1, 2),
k3 AS (SELECT k2.*, oe.wac_entry, oe.realized_pnl AS own_pnl, kt.redeems, kt.merges, round(abs(k2.avg_price - wac_entry), 6) AS wd, round(abs(k2.realized_pnl - oe.realized_pnl), 6) AS pd FROM k2 LEFT JOIN oe ON oe.wallet = k2.wallet AND oe.token_id = k2.token_id LEFT JOIN kt ON kt.wallet = k2.wallet AND kt.token_id = k2.token_id WHERE size IS NOT NULL AND local > 1e-4),
k4 AS (SELECT wallet, token_id, 'positions_size' AS check_type, coalesce(size, 0) AS expected, coalesce(local, 0) AS computed, diff, reason FROM k2
   UNION ALL SELECT wallet, token_id, 'positions_wac_avg_price', avg_price, coalesce(wac_entry, 0), coalesce(wd, abs(avg_price)), CASE WHEN wac_entry IS NULL THEN 'local_open_episode_missing' WHEN wd = 0 THEN 'exact_match' WHEN wd <= 1e-3 THEN 'dust_only' WHEN reason NOT IN ('exact_match', 'dust_only') THEN 'wac_size_reconciliation_not_clean' WHEN skew THEN 'wac_timing_skew' ELSE 'wac_drift' END FROM k3
   UNION ALL SELECT wallet, token_id, 'positions_realized_pnl', realized_pnl, coalesce(own_pnl, 0), coalesce(pd, abs(realized_pnl)), CASE WHEN own_pnl IS NULL THEN 'local_open_episode_missing' WHEN pd = 0 THEN 'exact_match' WHEN pd <= 1e-2 THEN 'within_realized_pnl_band' WHEN skew THEN 'timing_skew' WHEN redeems THEN 'realized_pnl_resolution_semantics' WHEN merges THEN 'realized_pnl_merge_split_semantics' ELSE 'realized_pnl_trade_accounting_drift' END FROM k3),
checks AS (SELECT *, CASE WHEN reason IN ('exact_match', 'dust_only', 'within_realized_pnl_band') THEN 'pass' WHEN reason IN ('local_negative_holding', 'remote_missing_local_present', 'local_missing_remote_present', 'source_api_missing_fill', 'wac_drift', 'local_open_episode_missing', 'unknown') THEN 'fail' ELSE 'warn' END AS status FROM k4)"""
_CHECKED = (POSITIONS, A._EPISODES, _EP2, A._LAST, _NEG, _CHECKS)
ORACLE |= {
    "reconciliation_checks": sql("SELECT wallet, token_id, check_type, round(expected, 4) + 0 AS expected, round(computed, 4) + 0 AS computed, round(diff, 4) + 0 AS diff, reason, status FROM checks", *_CHECKED),
    "wallet_trust_checks": sql("""SELECT wallet, n_fail, n_warn, n_pnl, status, CASE WHEN status = CASE WHEN substr(wallet, 2)::BIGINT % 2 = 0 THEN 'untrusted' ELSE 'trusted' END THEN 1 ELSE 2 END::BIGINT AS since_ts FROM (SELECT *, CASE WHEN n_fail > 0 THEN 'untrusted' WHEN n_warn + n_pnl > 0 THEN 'warn' ELSE 'trusted' END AS status FROM
(SELECT wallet, count(*) FILTER (check_type <> 'positions_realized_pnl' AND status = 'fail') AS n_fail, count(*) FILTER (check_type <> 'positions_realized_pnl' AND status = 'warn') AS n_warn, count(*) FILTER (check_type = 'positions_realized_pnl' AND status <> 'pass') AS n_pnl FROM checks GROUP BY 1))""", *_CHECKED),
    "portfolio_value_check": sql("""SELECT wallet, round(l, 4) + 0 AS local_value, round(v, 4) + 0 AS venue_value, round(gap, 4) + 0 AS pct_diff, CASE WHEN gap <= 0.02 THEN 'within_value_band' ELSE 'value_drift_categorized' END AS reason, CASE WHEN gap <= 0.02 THEN 'pass' ELSE 'warn' END AS status FROM
(SELECT *, CASE WHEN round(v, 6) = 0 THEN CASE WHEN round(l, 6) = 0 THEN 0 ELSE 1 END ELSE abs(v - l) / abs(v) END AS gap FROM (SELECT wallet, sum(greatest(coalesce(qty, 0), 0) * mark) AS l, sum(greatest(coalesce(size, 0), 0) * mark) AS v FROM
(SELECT coalesce(la.wallet, vp.wallet) AS wallet, coalesce(la.token_id, vp.token_id) AS token_id, qty, size FROM last la FULL JOIN vp ON la.wallet = vp.wallet AND la.token_id = vp.token_id) LEFT JOIN (SELECT token_id, coalesce(any_value(res_price), any_value(px), 0) AS mark FROM (SELECT token_id, arg_max(price, (ts, id)) AS px FROM ledger WHERE event_type = 'TRADE' GROUP BY 1) FULL JOIN prices USING (token_id) GROUP BY 1) USING (token_id) GROUP BY 1))""", *_CHECKED, A._PRICES),
    "pnl_bridge": sql("""SELECT wallet, scope, round(b, 4) + 0 AS buy_cost, round(s, 4) + 0 AS sell_proceeds, round(m, 4) + 0 AS merge_proceeds, round(r, 4) + 0 AS redeem_proceeds, round(w, 4) + 0 AS rewards, round(me, 4) + 0 AS merge_edge, round(re, 4) + 0 AS redeem_edge, round(d, 4) + 0 AS directional, round(fees, 4) + 0 AS estimated_fees, round(me + re, 4) + 0 AS completion_pnl,
round(me + re + d + w, 4) + 0 AS gross_pnl, round(round((me + re) / nullif(round(me + re + d + w, 6), 0) * 100, 2), 4) + 0 AS pct_from_completion, round(me + re + d + w - coalesce(fees, 0), 4) + 0 AS net_after_fees FROM
(SELECT wallet, scope, sum(CASE WHEN side = 'BUY' THEN -delta_usdc ELSE 0 END) AS b, sum(CASE WHEN side = 'SELL' THEN delta_usdc ELSE 0 END) AS s, sum(CASE WHEN event_type = 'MERGE' THEN delta_usdc ELSE 0 END) AS m, sum(CASE WHEN event_type = 'REDEEM' THEN delta_usdc ELSE 0 END) AS r, sum(CASE WHEN event_type = 'REWARD' THEN delta_usdc ELSE 0 END) AS w
 FROM (SELECT *, unnest(CASE WHEN category = 'sports' THEN ['all', 'sports'] ELSE ['all'] END) AS scope FROM ledger LEFT JOIN markets USING (condition_id)) GROUP BY 1, 2) JOIN
(SELECT wallet, scope, sum(CASE WHEN event_type = 'MERGE' THEN realized ELSE 0 END) AS me, sum(CASE WHEN event_type = 'REDEEM' THEN realized ELSE 0 END) AS re, sum(CASE WHEN event_type = 'TRADE' THEN realized ELSE 0 END) AS d FROM (SELECT p.*, unnest(CASE WHEN category = 'sports' THEN ['all', 'sports'] ELSE ['all'] END) AS scope FROM positions p LEFT JOIN markets USING (condition_id) WHERE kind <> 'add') GROUP BY 1, 2) USING (wallet, scope)
LEFT JOIN (SELECT wallet, sum(fee) AS fees FROM fee GROUP BY 1) USING (wallet)""", POSITIONS, B._FEES),
    "set_audit": sql("""SELECT wallet, condition_id, round(b0, 4) + 0 AS token0_buy_qty, round(b1, 4) + 0 AS token1_buy_qty, round(least(b0, b1), 4) + 0 AS matched_pair_qty, round(mg, 4) + 0 AS merge_sets, round(least(b0, b1) - mg, 4) + 0 AS pair_qty_vs_merge_diff, round(sp, 4) + 0 AS split_sets, round(mu, 4) + 0 AS merge_usdc, round(ru, 4) + 0 AS redeem_usdc,
round((paid - edge) / nullif(round(mg, 6), 0), 4) + 0 AS pair_cost_per_set, round(edge, 4) + 0 AS realized_edge, round(edge / nullif(round(mg, 6), 0), 4) + 0 AS realized_edge_per_set, round(abs(b0 - b1), 4) + 0 AS imbalance_qty, round(abs(b0 - b1) / nullif(round(greatest(b0, b1), 6), 0), 4) + 0 AS imbalance_ratio FROM
(SELECT wallet, condition_id, sum(CASE WHEN side = 'BUY' AND outcome_index = 0 THEN size ELSE 0 END) AS b0, sum(CASE WHEN side = 'BUY' AND outcome_index = 1 THEN size ELSE 0 END) AS b1, sum(CASE WHEN event_type = 'MERGE' THEN size ELSE 0 END) AS mg, sum(CASE WHEN event_type = 'MERGE' THEN delta_usdc ELSE 0 END) AS mu, sum(CASE WHEN event_type = 'SPLIT' THEN size ELSE 0 END) AS sp, sum(CASE WHEN event_type = 'REDEEM' THEN delta_usdc ELSE 0 END) AS ru FROM ledger GROUP BY 1, 2)
LEFT JOIN (SELECT wallet, condition_id, sum(realized) AS edge, sum(usdc) AS paid FROM positions WHERE event_type = 'MERGE' GROUP BY 1, 2) USING (wallet, condition_id)""", POSITIONS),
    "redeem_pro_rata": sql("""SELECT id, wallet, condition_id, round(size, 4) + 0 AS size, round(paid * size / nullif(round(al, 6), 0), 4) + 0 AS redeemed_usdc FROM (SELECT *, sum(size) OVER (PARTITION BY wallet, condition_id, seg) AS al FROM rp WHERE side = 'BUY') JOIN (SELECT wallet, condition_id, seg, sum(delta_usdc) AS paid FROM rp WHERE event_type = 'REDEEM' GROUP BY 1, 2, 3) USING (wallet, condition_id, seg)""",
        "rp AS (SELECT *, coalesce(sum(CASE WHEN event_type = 'REDEEM' THEN 1 ELSE 0 END) OVER (PARTITION BY wallet, condition_id ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM ledger WHERE side = 'BUY' OR event_type = 'REDEEM')"),
    "profit_by_event": sql("""SELECT wallet, event_id, n_markets, round(pnl, 4) + 0 AS pnl, round(top1 / nullif(round(al, 6), 0), 4) + 0 AS top1_share, round(top3 / nullif(round(al, 6), 0), 4) + 0 AS top3_share, row_number() OVER (PARTITION BY wallet ORDER BY round(pnl, 4) DESC, n_markets DESC, event_id) AS rank FROM
(SELECT wallet, event_id, count(*) AS n_markets, sum(pnl) AS pnl, sum(abs(pnl)) AS al, sum(CASE WHEN nth <= 1 THEN abs(pnl) ELSE 0 END) AS top1, sum(CASE WHEN nth <= 3 THEN abs(pnl) ELSE 0 END) AS top3 FROM
 (SELECT *, row_number() OVER (PARTITION BY wallet, event_id ORDER BY abs(pnl) DESC, condition_id) AS nth FROM (SELECT wallet, event_id, condition_id, round(sum(realized), 6) AS pnl FROM positions JOIN markets USING (condition_id) WHERE kind <> 'add' GROUP BY 1, 2, 3)) GROUP BY 1, 2)""", POSITIONS),
    "watch_acceptance": "WITH wl AS (" + B.ORACLE["watchlist"] + "), cx AS (" + sql("SELECT * FROM context", M._BOOKS, M._CONTEXT) + "), bk AS (" + sql("SELECT * FROM books", M._BOOKS) + """)
SELECT x.check AS "check", x.value AS value, x.passed AS passed FROM (SELECT unnest([{'check': 'books_written', 'value': n, 'passed': n > 0}, {'check': 'tokens_sampled', 'value': t, 'passed': t >= 10}, {'check': 'span_s', 'value': sp, 'passed': sp >= 3600}, {'check': 'no_crossed_books', 'value': cr, 'passed': cr = 0},
{'check': 'fills_with_context', 'value': wb, 'passed': wb * 2 >= f}, {'check': 'no_book_from_the_future', 'value': fu, 'passed': fu = 0}, {'check': 'watchlist_filled', 'value': w, 'passed': w > 0}]) AS x FROM (SELECT count(*) AS n, count(DISTINCT token_id) AS t, max(ts) - min(ts) AS sp, count(*) FILTER (best_ask <= best_bid) AS cr FROM bk), (SELECT count(*) AS f, count(*) FILTER (status <> 'missing') AS wb, count(*) FILTER (age_before_s < 0) AS fu FROM cx), (SELECT count(*) AS w FROM wl))""",
    "cluster_ranking": "WITH eq AS (" + A.ORACLE["daily_equity"] + "), cy AS (" + B.ORACLE["closed_cycle_score"] + "), tm AS (" + sql("""SELECT l.wallet, l.id, tier, delay, ratio FROM (SELECT l.* FROM ledger l JOIN markets USING (condition_id) WHERE event_type = 'TRADE' AND wallet <> 'w2') l LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tier, abs(delay), r_ts, r_id) AS rn FROM
(SELECT l.id, r.id AS r_id, r.ts AS r_ts, l.ts - r.ts AS delay, l.size / nullif(r.size, 0) AS ratio, CASE WHEN l.token_id = r.token_id AND l.side = r.side THEN 1 WHEN l.token_id = r.token_id THEN 2 WHEN l.condition_id = r.condition_id AND l.side = r.side THEN 3 WHEN l.condition_id = r.condition_id THEN 4 END AS tier
 FROM (SELECT * FROM ledger JOIN markets USING (condition_id)) l JOIN (SELECT * FROM ledger JOIN markets USING (condition_id)) r ON l.event_id = r.event_id AND abs(l.ts - r.ts) <= 3600 WHERE l.event_type = 'TRADE' AND r.event_type = 'TRADE' AND l.wallet <> 'w2' AND r.wallet = 'w2') WHERE tier IS NOT NULL) WHERE rn = 1) m ON m.id = l.id""") + """),
g AS (SELECT wallet, count(*) AS total, count(tier) AS matched, count(*) FILTER (tier <= 2) AS st, count(*) FILTER (delay < 0) AS fi, median(abs(delay)) AS delay, median(ratio) AS ratio FROM tm GROUP BY 1),
wk AS (SELECT wallet, coalesce(arg_max(marked_pnl, day) - arg_max(marked_pnl, day) FILTER (day <= e - 7), 0) AS pnl_1w FROM eq JOIN (SELECT wallet, max(day) AS e FROM eq GROUP BY 1) USING (wallet) GROUP BY 1),
z AS (SELECT g.*, pnl_1w, st / total AS rate, coalesce(fi / nullif(matched, 0), 0) AS first, round(st / total * 0.4 + coalesce(score, 0) * 0.3 + least(greatest(coalesce(pnl_1w, 0), 0), 10000) / 10000 * 0.3, 6) AS pr FROM g LEFT JOIN wk USING (wallet) LEFT JOIN (SELECT wallet, score FROM cy) USING (wallet))
SELECT wallet, total, matched, round(rate, 4) AS same_token_rate, round(delay, 4) AS median_delay_s, round(first, 4) AS candidate_first_share, round(ratio, 4) AS size_ratio_median,
CASE WHEN total = 0 OR matched = 0 THEN 'independent' WHEN delay <= 5 AND rate >= 0.5 AND ratio BETWEEN 0.5 AND 2 THEN 'same_system_candidate' WHEN delay > 5 AND delay <= 300 AND rate >= 0.3 AND first <= 0.2 THEN 'follower' WHEN rate < 0.3 THEN 'shared_signal' WHEN matched / total >= 0.1 THEN 'research_candidate' ELSE 'independent' END AS verdict,
round(pnl_1w, 4) + 0 AS pnl_1w, round(pr, 4) AS research_priority, row_number() OVER (ORDER BY pr DESC, wallet) AS rank FROM z""",
}
ORACLE["top_discrepancies"] = "WITH rc AS (" + ORACLE["reconciliation_checks"] + ") SELECT wallet, token_id, check_type, reason, diff FROM rc WHERE status <> 'pass' ORDER BY diff DESC, wallet, token_id, check_type LIMIT 20"
