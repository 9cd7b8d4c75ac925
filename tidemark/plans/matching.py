"""Complete-set matching by quantity, order-book context by time, markouts and the per-fill dataset."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import ordered as O
from tidemark.plans import accounting as A
from tidemark.plans.views import POSITIONS, ledger, markets, r4, sql, tokens
from tidemark.sources import readers

HORIZONS = {"5m": 300, "15m": 900, "1h": 3600, "24h": 86400}


def buy_intervals(spark, sf_dir, since: int = 0):
    """Cumulative quantity bought on each leg of a condition: [lo, hi) of every buy."""
    b = ledger(spark, sf_dir).where(f"side = 'BUY' and ts >= {since}")
    keys = ["wallet", "condition_id", "outcome_index"]
    hi = F.round(F.sum("size").over(O.upto(keys)), 2)
    return b.withColumn("hi", hi).withColumn("lo", F.round(F.col("hi") - F.col("size"), 2))


def fifo_matches(spark, sf_dir, since: int = 0):
    b = buy_intervals(spark, sf_dir, since)
    legs = [b.where(F.col("outcome_index") == k) for k in (0, 1)]
    m = O.disjoint_matches(legs[0], legs[1], ["wallet", "condition_id"], ("price", "ts"))
    m = m.withColumn("matched", F.round("matched", 2)).where("matched > 0")
    return m.withColumn("edge", F.col("matched") * (1 - F.col("a_price") - F.col("b_price"))).withColumn("gap_s", F.abs(F.col("a_ts") - F.col("b_ts")))


def fifo_complete_sets(spark, sf_dir):
    g = fifo_matches(spark, sf_dir).groupBy("wallet").agg(F.sum("matched").alias("m"), F.sum("edge").alias("e"), F.count("*").alias("n_matches"))
    return g.select("wallet", "n_matches", r4("m", "matched"), r4("e", "edge"), r4(F.col("e") / F.col("m"), "edge_per_set"))


def _by_market(spark, sf_dir, since: int = 0):
    return fifo_matches(spark, sf_dir, since).groupBy("wallet", "condition_id").agg(F.sum("matched").alias("matched"), F.round(F.sum("edge"), 4).alias("edge"))


def edge_by_market(spark, sf_dir):
    """The hundred (wallet, market) pairs with the largest edge."""
    top = _by_market(spark, sf_dir).orderBy(F.desc("edge"), "wallet", "condition_id").limit(100)
    return top.select("wallet", "condition_id", r4("matched"), r4("edge"))


def edge_since_date(spark, sf_dir):
    g = _by_market(spark, sf_dir, 1704067200 + 10 * 86400).groupBy("wallet").agg(F.sum("matched").alias("m"), F.sum("edge").alias("e"))
    return g.select("wallet", r4("m", "matched"), r4("e", "edge"))


def leg_gap_weighted_pct(spark, sf_dir):
    """Seconds between the two legs of a set, at shares of the matched quantity."""
    return O.weighted_percentiles(fifo_matches(spark, sf_dir), ["wallet"], "gap_s", "matched", {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p99": 0.99})


def edge_volume_bucket(spark, sf_dir):
    g = _by_market(spark, sf_dir).withColumn("bucket", scalars.volume_bucket(F.col("matched"))).groupBy("bucket")
    return g.agg(F.count("*").alias("n"), r4(F.sum("matched"), "matched"), r4(F.sum("edge"), "edge"), F.count_if(F.col("edge") > 0).alias("n_positive"))


def edge_concentration_hhi(spark, sf_dir):
    """Share of the top markets in a wallet's positive edge, markets needed for half of it, and its concentration."""
    e = _by_market(spark, sf_dir).where("edge > 0")
    w = Window.partitionBy("wallet")
    by_edge = w.orderBy(F.desc("edge"), "condition_id")
    e = e.withColumns({"rank": F.row_number().over(by_edge), "share": F.col("edge") / F.sum("edge").over(w), "run": F.round(F.sum("edge").over(by_edge.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("edge").over(w), 8)})
    return e.groupBy("wallet").agg(
        F.count("*").alias("n_markets"),
        r4(F.sum(F.when(F.col("rank") <= 3, F.col("share")).otherwise(0.0)), "top3_share"),
        F.min(F.when(F.col("run") >= 0.5, F.col("rank"))).cast("long").alias("to_half"),
        F.min(F.when(F.col("run") >= 0.8, F.col("rank"))).cast("long").alias("to_80"),
        r4(F.sum(F.col("share") * F.col("share")), "hhi"),
    )


def common_markets_side_by_side(spark, sf_dir):
    """Edge of two wallets in the markets where both matched sets."""
    m = _by_market(spark, sf_dir)
    a, b = m.where("wallet = 'w1'").alias("a"), m.where("wallet = 'w2'").alias("b")
    both = a.join(b, F.col("a.condition_id") == F.col("b.condition_id"))
    return both.select(F.col("a.condition_id").alias("condition_id"), r4("a.matched", "matched_1"), r4("b.matched", "matched_2"), r4("a.edge", "edge_1"), r4("b.edge", "edge_2"))


def books(spark, sf_dir):
    """Quotes of every token: the buys of ids that divide by three stand for polled books."""
    b = ledger(spark, sf_dir).where("side = 'BUY' and id % 3 = 0")
    half = ((F.col("id") * 13) % 9 + 1) / F.lit(200.0)
    return b.select("token_id", "ts", F.col("price").alias("mid"), F.round(F.col("price") - half, 4).alias("best_bid"), F.round(F.col("price") + half, 4).alias("best_ask"))


def depth_books(spark, sf_dir):
    """The same books with two levels a side, by way of their JSON payload: depth and imbalance as ``parse_books`` has them."""
    b = ledger(spark, sf_dir).where("side = 'BUY' and id % 3 = 0")
    half = ((F.col("id") * 13) % 9 + 1) / F.lit(200.0)
    bid, ask = F.round(F.col("price") - half, 4), F.round(F.col("price") + half, 4)

    def level(p, s):
        return F.struct(F.round(p, 4).cast("string").alias("price"), s.cast("string").alias("size"))

    payload = F.to_json(F.struct(
        F.array(level(bid - 0.01, (F.col("id") * 7) % 5 * 3 + 1), level(bid, F.col("size"))).alias("bids"),
        F.array(level(ask + 0.01, (F.col("id") * 3) % 7 * 2 + 1), level(ask, (F.col("id") * 11) % 40 + 1)).alias("asks"),
    ))
    p = readers.parse_books(b.select("token_id", "ts", F.col("price").alias("stated_mid"), payload.alias("payload")))
    top = F.col("bid_depth_top1") + F.col("ask_depth_top1")
    one = F.try_divide(F.col("bid_depth_top1") - F.col("ask_depth_top1"), F.nullif(top, F.lit(0.0)))
    return p.select("token_id", "ts", F.col("stated_mid").alias("mid"), "best_bid", "best_ask", "bid_depth_top1", "ask_depth_top1", "bid_depth_top5", "ask_depth_top5", one.alias("imbalance_top1"), F.col("imbalance").alias("imbalance_top5"))


def fills(spark, sf_dir):
    return ledger(spark, sf_dir).where("event_type = 'TRADE' and not (side = 'BUY' and id % 3 = 0)")


def book_asof_context(spark, sf_dir, max_age: int = 3600):
    """Last book before and first book after every fill, with the freshness of the one before."""
    f, b = fills(spark, sf_dir).select("id", "wallet", "token_id", "ts"), books(spark, sf_dir)
    out = O.asof_backward(f, b, ["token_id"], ["mid"]).withColumnsRenamed({"mid": "mid_before", "asof_ts": "ts_before"})
    out = O.asof_forward(out, b, ["token_id"], ["mid"])
    near = F.col("asof_ts") - F.col("ts") <= max_age
    age = F.col("ts") - F.col("ts_before")
    return out.select("id", "mid_before", age.alias("age_before_s"), scalars.context_status(F.floor(age / 60), 240).alias("status"), F.when(near, F.col("mid")).alias("mid_after"), F.when(near, F.col("asof_ts") - F.col("ts")).alias("age_after_s"))


def context_coverage(spark, sf_dir):
    c = book_asof_context(spark, sf_dir)
    return c.groupBy("status").agg(F.count("*").alias("n"), F.count("mid_after").alias("n_after"), F.min("age_before_s").alias("youngest_s"), F.max("age_before_s").alias("oldest_s"))


def markout_horizons(spark, sf_dir):
    """Move of the mid in the fill's favour after each horizon: first mid within twice the horizon beyond it."""
    f, b = fills(spark, sf_dir).select("id", "token_id", "ts", "side", "price"), books(spark, sf_dir)
    sign = F.when(F.col("side") == "BUY", 1.0).otherwise(-1.0)
    cuts = F.array(*(F.struct(F.lit(n).alias("horizon"), F.lit(s).alias("h")) for n, s in HORIZONS.items()))
    f = f.withColumn("c", F.explode(cuts)).select("*", "c.*").drop("c").withColumn("fill_ts", F.col("ts")).withColumn("ts", F.col("ts") + F.col("h"))
    out = O.asof_forward(f, b, ["token_id"], ["mid"])
    value = F.when(F.col("asof_ts") <= F.col("ts") + 2 * F.col("h"), sign * (F.col("mid") - F.col("price")))
    out = out.withColumn("markout", value)
    return out.groupBy("horizon").agg(F.count("markout").alias("n"), F.count("*").alias("n_fills"), r4(F.avg("markout"), "mean"), F.count_if(F.col("markout") > 0).alias("n_up"))


def microstructure_dataset(spark, sf_dir):
    """One row for each fill: book before it, quantities of its token and complement around it, markout after an hour.

    Both legs come from one window over (wallet, condition). Only keys and times travel through the as-of joins; what they
    find is joined back on the id.
    """
    f = fills(spark, sf_dir)
    key = f.select("id", "token_id", "ts")
    s = A.leg_states(spark, sf_dir).where("event_type = 'TRADE'")
    other = F.when(F.col("leg") == 0, F.col("q1")).when(F.col("leg") == 1, F.col("q0"))
    s = s.select("id", F.col("qty_before").alias("q_before"), F.col("qty").alias("q_after"), other.alias("other_qty"))
    b = depth_books(spark, sf_dir).withColumnRenamed("imbalance_top5", "imbalance").select("token_id", "ts", "mid", "best_bid", "best_ask", "imbalance")
    book = O.asof_backward(key, b, ["token_id"], ["mid", "best_bid", "best_ask", "imbalance"]).withColumnRenamed("asof_ts", "book_ts").drop("token_id", "ts")
    later = O.asof_forward(key.withColumn("ts", F.col("ts") + 3600), b, ["token_id"], ["mid"]).select("id", "asof_ts", F.col("mid").alias("mid_1h"))
    out = f.withColumn("fill_ts", F.col("ts")).join(s, "id").join(book, "id").join(later, "id")
    m = markets(spark).select("condition_id", "category", "event_id")
    out = out.join(m, "condition_id", "left")
    sign = F.when(F.col("side") == "BUY", 1.0).otherwise(-1.0)
    q0 = F.when(F.col("outcome_index") == 0, F.col("q_before")).otherwise(F.coalesce("other_qty", F.lit(0.0)))
    q1 = F.when(F.col("outcome_index") == 1, F.col("q_before")).otherwise(F.coalesce("other_qty", F.lit(0.0)))
    reasons = F.concat_ws(",", F.when(F.col("mid").isNull(), "book:none"), F.when(F.col("event_id").isNull(), "market:none"))
    age = F.col("fill_ts") - F.col("book_ts")
    return out.select(
        "id", "wallet", "token_id", "condition_id", "outcome_index", F.col("fill_ts").alias("trade_ts"), "side", F.col("price").alias("fill_price"), r4("size", "fill_shares"),
        r4(F.col("size") * F.col("price"), "fill_notional"), F.coalesce("category", F.lit("unclassified")).alias("category"), "event_id",
        age.alias("book_before_age_s"), "mid", r4((F.col("best_ask") - F.col("best_bid")) / F.nullif(F.col("mid"), F.lit(0.0)) * 10000, "spread_bps"),
        ((F.col("price") > F.col("best_bid")) & (F.col("price") < F.col("best_ask"))).alias("inside"), r4("imbalance"),
        r4("q_before", "qty_before"), r4("q_after", "qty_after"), r4(scalars.directional(q0, q1), "directional_before"), r4(scalars.bond(q0, q1), "bond_before"),
        F.floor(F.col("fill_ts") % 86400 / 3600).alias("trade_hour"),
        r4(F.when(F.col("asof_ts") <= F.col("fill_ts") + 3 * 3600, sign * (F.col("mid_1h") - F.col("price"))), "markout_1h"),
        F.nullif(reasons, F.lit("")).alias("null_reasons"),
    )


def dataset_null_reasons(spark, sf_dir):
    d = microstructure_dataset(spark, sf_dir).select(F.explode(F.split("null_reasons", ",")).alias("reason"))
    return d.groupBy("reason").agg(F.count("*").alias("n"))


def merge_like_tx(spark, sf_dir):
    """Transactions of a wallet that trade two tokens or more."""
    g = ledger(spark, sf_dir).where("event_type = 'TRADE'").groupBy("wallet", "tx_hash")
    out = g.agg(F.countDistinct("token_id").alias("n_tokens"), F.array_join(F.array_sort(F.collect_set("token_id")), ",").alias("tokens"), r4(F.sum("delta_usdc"), "net_usdc"))
    return out.where("n_tokens >= 2")


def merge_batches(spark, sf_dir, gap: int = 7200):
    """Merges of a wallet and event in runs with gaps of at most ``gap`` seconds; runs of one are none."""
    m = ledger(spark, sf_dir).where("event_type = 'MERGE'").join(markets(spark), "condition_id")
    s = O.sessions(m, ["wallet", "event_id"], gap)
    g = s.groupBy("wallet", "event_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), r4(F.sum("size"), "size"))
    return g.where("n > 1").select("wallet", "event_id", F.col("session").cast("long").alias("session"), "n", "first_ts", "last_ts", "size")


def unpaired_periods(spark, sf_dir):
    """Stretches in which a wallet's two legs of a condition differ, with the largest difference and what ended them."""
    e = ledger(spark, sf_dir).where("event_type in ('TRADE', 'REDEEM')")
    keys = ["wallet", "condition_id"]
    e = e.withColumn("seg", F.sum(F.when(F.col("event_type") == "REDEEM", 1).otherwise(0)).over(O.upto(keys)))
    leg = F.when(F.col("event_type") == "REDEEM", 0.0).when(F.col("outcome_index") == 0, F.col("delta_shares")).otherwise(-F.col("delta_shares"))
    e = e.withColumn("gap", F.round(F.abs(F.sum(leg).over(O.upto([*keys, "seg"]))), 4)).withColumn("open", F.col("gap") > O.EPSILON)
    e = e.withColumn("island", F.coalesce(F.sum(F.when(F.col("open"), 0).otherwise(1)).over(O.before(keys)), F.lit(0)))
    g = e.groupBy(*keys, "island").agg(
        F.min("ts").alias("open_ts"), F.max(F.when(~F.col("open"), F.col("ts"))).alias("close_ts"), F.max("gap").alias("max_gap"),
        F.max(F.when(~F.col("open"), F.col("event_type"))).alias("resolved_by"), F.count_if("open").alias("n_open"),
    )
    return g.where("n_open > 0").select(*keys, "open_ts", "close_ts", r4("max_gap"), F.coalesce("resolved_by", F.lit("OPEN")).alias("resolved_by"))


def next_complements(spark, sf_dir):
    """Buys with the first later fill of the other token of their condition as ``o`` (``id, ts, price``), null if there is none."""
    t = ledger(spark, sf_dir).where("event_type = 'TRADE'")
    after = O.before(["wallet", "condition_id"], F.desc("ts"), F.desc("id"))  # backwards: a frame up to the end is gone through anew for each row
    nxt = {k: F.last(F.when(F.col("outcome_index") == k, F.struct("id", "ts", "price")), ignorenulls=True).over(after) for k in (0, 1)}
    t = t.withColumns({"n0": nxt[0], "n1": nxt[1]}).where("side = 'BUY'")
    other = F.when(F.col("outcome_index") == 0, F.col("n1")).otherwise(F.col("n0"))
    return t.withColumn("o", other)


def pair_completion(spark, sf_dir):
    """For each buy the first later fill of the other token of its condition, and the wait for it."""
    t = next_complements(spark, sf_dir)
    return t.select("id", F.col("o.id").alias("pair_id"), (F.col("o.ts") - F.col("ts")).alias("wait_s"), r4(1 - F.col("price") - F.col("o.price"), "pair_edge"), scalars.time_bucket(F.col("o.ts") - F.col("ts")).alias("bucket"), scalars.cost_bucket(F.round(F.col("price") + F.col("o.price"), 4)).alias("cost_bucket"))


def sibling_pairs(f, series: list[str], group: str, kind: str, window_s: int):
    """Counts of pairs of rows of a series, the first at most ``window_s`` before the second and in another ``group``, by both rows'
    ``kind``: ``kind`` of first and second, ``n``, ``least_s``, ``n_series``. Order is by ``ts, id``.

    No pair is made. A row counts the earlier rows of each kind in its range less those of its own group; the nearest of another
    group is the last row or, if that is of its own group, the last one before that group's run. Series are cut in cells of
    ``window_s``; a row is also context in the next cell.
    """
    cell = F.floor(F.col("ts") / window_s)
    placed = f.withColumn("_c", F.explode(F.array(F.struct(cell.alias("cell"), F.lit(True).alias("own")), F.struct((cell + 1).alias("cell"), F.lit(False).alias("own")))))
    placed = placed.select("*", F.col("_c.cell").alias("_cell"), F.col("_c.own").alias("_own")).drop("_c")
    part = [*series, "_cell"]
    kinds = F.explode(F.array(*(F.lit(k) for k in ("BUY", "SELL"))))
    asked = placed.withColumn("_of", kinds)  # each row asks for the rows of each kind before it
    is_of = F.col(kind) == F.col("_of")

    def earlier(keys: list[str]):
        seconds = Window.partitionBy(*keys).orderBy("ts").rangeBetween(-window_s, -1)
        same = Window.partitionBy(*keys, "ts").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
        return F.count(F.when(is_of, 1)).over(seconds) + F.count(F.when(is_of, 1)).over(same)

    run = O.before([*part, "_of"])
    last = F.last(F.when(is_of, F.struct(F.col(group).alias("g"), "ts", "_before")), ignorenulls=True).over(run)
    prior = F.last(F.when(is_of, F.struct(F.col(group).alias("g"), "ts")), ignorenulls=True).over(run)
    x = asked.withColumn("_prior", prior)
    starts = is_of & (F.col("_prior.g") != F.col(group))  # the run of a group begins: what is before is of another one
    x = x.withColumn("_start", F.when(starts, F.col("_prior.ts")))
    x = x.withColumn("_before", F.last("_start", ignorenulls=True).over(O.upto([*part, "_of"])))
    x = x.withColumns({"_last": last, "_n": earlier([*part, "_of"]) - earlier([*part, "_of", group])})
    near = F.when(F.col("_last.g") != F.col(group), F.col("_last.ts")).otherwise(F.col("_last._before"))
    x = x.where(F.col("_own") & (F.col("_n") > 0)).withColumn("_gap", F.col("ts") - near)
    return x.groupBy(F.col("_of").alias("first"), F.col(kind).alias("second")).agg(F.sum("_n").alias("n"), F.min("_gap").alias("least_s"), F.countDistinct(*series).alias("n_series"))


def sibling_sequences(spark, sf_dir, window_s: int = 3600):
    """Pairs of fills of a wallet in different conditions of an event within an hour, by their sides."""
    f = fills(spark, sf_dir).join(markets(spark).select("condition_id", "event_id"), "condition_id")
    found = sibling_pairs(f.select("id", "ts", "condition_id", "side", "wallet", "event_id"), ["wallet", "event_id"], "condition_id", "side", window_s)
    return found.select(F.concat_ws("->", "first", "second").alias("kind"), "n", "least_s", "n_series")


def order_timing(spark, sf_dir, lookback: int = 86400, tolerance: float = 0.02):
    """First and last book within the lookback of a fill whose bid or ask was within tolerance of its price."""
    f = fills(spark, sf_dir).select("id", "token_id", F.col("ts").alias("f_ts"), "price")
    b = books(spark, sf_dir).withColumn("cell", F.floor(F.col("ts") / lookback))
    f = f.withColumn("cell", F.explode(F.array(F.floor(F.col("f_ts") / lookback), F.floor(F.col("f_ts") / lookback) - 1)))
    near = F.least(F.abs(F.col("best_bid") - F.col("price")), F.abs(F.col("best_ask") - F.col("price"))) <= tolerance + 1e-9
    met = f.join(b, ["token_id", "cell"]).where(F.col("ts").between(F.col("f_ts") - lookback, F.col("f_ts")) & near)
    return met.groupBy("id").agg(F.min("ts").alias("first_seen_ts"), F.max("ts").alias("last_seen_ts"), F.count("*").alias("n_books"))


def leader_follower_tiers(spark, sf_dir, window_s: int = 3600):
    """Each trade of w1 with the trade of w2 that it may follow: same token and side first, down to the same event."""
    m = markets(spark).select("condition_id", "event_id")
    t = ledger(spark, sf_dir).where("event_type = 'TRADE'").join(m, "condition_id")
    t = t.select("id", "ts", "wallet", "token_id", "condition_id", "side", "event_id")
    token, side = F.col("l_token_id") == F.col("r_token_id"), F.col("l_side") == F.col("r_side")
    condition = F.col("l_condition_id") == F.col("r_condition_id")
    tiers = [token & side, token, condition & side, condition, ~condition]
    out = O.tiered_match(t.where("wallet = 'w1'"), t.where("wallet = 'w2'"), tiers, "event_id", window_s)
    return out.select(F.col("l_id").alias("id"), F.col("tier").cast("long").alias("tier"), "gap_s", F.col("r_id").alias("leader_id"))


QUERIES = {
    f.__name__: f
    for f in (
        fifo_complete_sets, edge_by_market, edge_since_date, leg_gap_weighted_pct, edge_volume_bucket, edge_concentration_hhi,
        common_markets_side_by_side, book_asof_context, context_coverage, markout_horizons, microstructure_dataset,
        dataset_null_reasons, merge_like_tx, merge_batches, unpaired_periods, pair_completion, sibling_sequences,
        order_timing, leader_follower_tiers,
    )
}


def _fifo(since: int = 0) -> str:
    return f"""
buys AS (SELECT *, round(hi - size, 2) AS lo FROM (SELECT *, round(sum(size) OVER (PARTITION BY wallet, condition_id, outcome_index ORDER BY ts, id ROWS UNBOUNDED PRECEDING), 2) AS hi FROM ledger WHERE side = 'BUY' AND ts >= {since})),
matches AS (SELECT *, matched * (1 - p0 - p1) AS edge FROM (SELECT a.wallet, a.condition_id, a.price AS p0, b.price AS p1, abs(a.ts - b.ts) AS gap_s, round(least(a.hi, b.hi) - greatest(a.lo, b.lo), 2) AS matched
   FROM buys a JOIN buys b ON a.wallet = b.wallet AND a.condition_id = b.condition_id AND a.outcome_index = 0 AND b.outcome_index = 1 AND a.hi > b.lo AND b.hi > a.lo) WHERE matched > 0),
by_market AS (SELECT wallet, condition_id, sum(matched) AS matched, round(sum(edge), 4) AS edge FROM matches GROUP BY 1, 2)"""


_BOOKS = """
books AS (SELECT token_id, ts, price AS mid, round(price - ((id * 13) % 9 + 1) / 200.0::DOUBLE, 4) AS best_bid, round(price + ((id * 13) % 9 + 1) / 200.0::DOUBLE, 4) AS best_ask,
   size AS bid1, size + (id * 7) % 5 * 3 + 1 AS bid5, (id * 11) % 40 + 1 AS ask1, (id * 11) % 40 + 1 + (id * 3) % 7 * 2 + 1 AS ask5 FROM ledger WHERE side = 'BUY' AND id % 3 = 0),
fills AS (SELECT * FROM ledger WHERE event_type = 'TRADE' AND NOT (side = 'BUY' AND id % 3 = 0)),
one_book AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY token_id, ts ORDER BY mid DESC, best_bid DESC, best_ask DESC, (bid5 - ask5) / (bid5 + ask5) DESC) AS rn FROM books) WHERE rn = 1)"""
_CONTEXT = """
context AS (SELECT id, mid_before, ts - ts_before AS age_before_s,
   CASE WHEN ts_before IS NULL THEN 'missing' WHEN (ts - ts_before) // 60 > 240 THEN 'stale' WHEN (ts - ts_before) // 60 <= 2 THEN 'excellent' WHEN (ts - ts_before) // 60 <= 5 THEN 'good' WHEN (ts - ts_before) // 60 <= 10 THEN 'usable' ELSE 'weak' END AS status,
   CASE WHEN ts_after - ts <= 3600 THEN mid_after END AS mid_after, CASE WHEN ts_after - ts <= 3600 THEN ts_after - ts END AS age_after_s
   FROM (SELECT f.id, f.ts, b.ts AS ts_before, b.mid AS mid_before, a.ts AS ts_after, a.mid AS mid_after FROM fills f
     ASOF LEFT JOIN one_book b ON f.token_id = b.token_id AND f.ts >= b.ts ASOF LEFT JOIN one_book a ON f.token_id = a.token_id AND f.ts <= a.ts))"""
_DATASET = A._LEGS + """,
d2 AS (SELECT f.*, p.qty_before AS qb, p.qty AS qa, f.ts + 3600 AS t2, CASE WHEN p.leg = 0 THEN p.q1 WHEN p.leg = 1 THEN p.q0 END AS other_qty FROM fills f JOIN legs p ON p.id = f.id AND p.token_id = f.token_id),
d3 AS (SELECT d2.*, b.ts AS book_ts, b.mid, b.best_bid, b.best_ask, (b.bid5 - b.ask5) / (b.bid5 + b.ask5) AS imb FROM d2 ASOF LEFT JOIN one_book b ON d2.token_id = b.token_id AND d2.ts >= b.ts),
d4 AS (SELECT d3.*, b.ts AS after_ts, b.mid AS mid_1h FROM d3 ASOF LEFT JOIN one_book b ON d3.token_id = b.token_id AND d3.t2 <= b.ts),
d5 AS (SELECT d4.*, m.category, m.event_id, CASE WHEN outcome_index = 0 THEN qb ELSE coalesce(other_qty, 0) END AS q0, CASE WHEN outcome_index = 1 THEN qb ELSE coalesce(other_qty, 0) END AS q1 FROM d4 LEFT JOIN markets m USING (condition_id)),
dataset AS (SELECT id, wallet, token_id, condition_id, outcome_index, ts AS trade_ts, side, price AS fill_price, round(size, 4) AS fill_shares, round(size * price, 4) AS fill_notional, coalesce(category, 'unclassified') AS category, event_id,
   ts - book_ts AS book_before_age_s, mid, round((best_ask - best_bid) / nullif(mid, 0) * 10000, 4) + 0 AS spread_bps, price > best_bid AND price < best_ask AS inside, round(imb, 4) + 0 AS imbalance,
   round(qb, 4) + 0 AS qty_before, round(qa, 4) + 0 AS qty_after, round(q0 - q1, 4) + 0 AS directional_before, round(least(q0, q1), 4) + 0 AS bond_before, ts % 86400 // 3600 AS trade_hour,
   round(CASE WHEN after_ts <= ts + 10800 THEN CASE WHEN side = 'BUY' THEN 1 ELSE -1 END * (mid_1h - price) END, 4) + 0 AS markout_1h,
   nullif(concat_ws(',', CASE WHEN mid IS NULL THEN 'book:none' END, CASE WHEN event_id IS NULL THEN 'market:none' END), '') AS null_reasons FROM d5)"""
_UP = "ORDER BY ts, id ROWS UNBOUNDED PRECEDING"

ORACLE = {
    "fifo_complete_sets": sql("SELECT wallet, count(*) AS n_matches, round(sum(matched), 4) + 0 AS matched, round(sum(edge), 4) + 0 AS edge, round(sum(edge) / sum(matched), 4) + 0 AS edge_per_set FROM matches GROUP BY 1", _fifo()),
    "edge_by_market": sql("SELECT wallet, condition_id, round(matched, 4) + 0 AS matched, round(edge, 4) + 0 AS edge FROM by_market ORDER BY by_market.edge DESC, wallet, condition_id LIMIT 100", _fifo()),
    "edge_since_date": sql("SELECT wallet, round(sum(matched), 4) + 0 AS matched, round(sum(edge), 4) + 0 AS edge FROM by_market GROUP BY 1", _fifo(1704067200 + 864000)),
    "leg_gap_weighted_pct": sql("""SELECT wallet, min(gap_s) FILTER (run >= round(tot * 0.1, 6)) AS p10, min(gap_s) FILTER (run >= round(tot * 0.5, 6)) AS p50, min(gap_s) FILTER (run >= round(tot * 0.9, 6)) AS p90, min(gap_s) FILTER (run >= round(tot * 0.99, 6)) AS p99 FROM
(SELECT wallet, gap_s, round(sum(w) OVER (PARTITION BY wallet ORDER BY gap_s ROWS UNBOUNDED PRECEDING), 6) AS run, sum(w) OVER (PARTITION BY wallet) AS tot FROM (SELECT wallet, gap_s, sum(matched) AS w FROM matches GROUP BY 1, 2)) GROUP BY 1""", _fifo()),
    "edge_volume_bucket": sql("SELECT CASE WHEN matched < 100 THEN '<100' WHEN matched < 500 THEN '100-500' WHEN matched < 1000 THEN '500-1000' ELSE '>=1000' END AS bucket, count(*) AS n, round(sum(matched), 4) + 0 AS matched, round(sum(edge), 4) + 0 AS edge, count(*) FILTER (edge > 0) AS n_positive FROM by_market GROUP BY 1", _fifo()),
    "edge_concentration_hhi": sql("""SELECT wallet, count(*) AS n_markets, round(sum(CASE WHEN rank <= 3 THEN share ELSE 0 END), 4) AS top3_share, min(rank) FILTER (run >= 0.5) AS to_half, min(rank) FILTER (run >= 0.8) AS to_80, round(sum(share * share), 4) AS hhi FROM
(SELECT *, row_number() OVER w AS rank, edge / sum(edge) OVER (PARTITION BY wallet) AS share, round(sum(edge) OVER (PARTITION BY wallet ORDER BY edge DESC, condition_id ROWS UNBOUNDED PRECEDING) / sum(edge) OVER (PARTITION BY wallet), 8) AS run FROM by_market WHERE edge > 0 WINDOW w AS (PARTITION BY wallet ORDER BY edge DESC, condition_id)) GROUP BY 1""", _fifo()),
    "common_markets_side_by_side": sql("SELECT a.condition_id, round(a.matched, 4) AS matched_1, round(b.matched, 4) AS matched_2, round(a.edge, 4) + 0 AS edge_1, round(b.edge, 4) + 0 AS edge_2 FROM by_market a JOIN by_market b USING (condition_id) WHERE a.wallet = 'w1' AND b.wallet = 'w2'", _fifo()),
    "book_asof_context": sql("SELECT * FROM context", _BOOKS, _CONTEXT),
    "context_coverage": sql("SELECT status, count(*) AS n, count(mid_after) AS n_after, min(age_before_s) AS youngest_s, max(age_before_s) AS oldest_s FROM context GROUP BY 1", _BOOKS, _CONTEXT),
    "markout_horizons": sql("""SELECT horizon, count(m) AS n, count(*) AS n_fills, round(avg(m), 4) + 0 AS mean, count(*) FILTER (m > 0) AS n_up FROM (SELECT horizon, CASE WHEN b.ts <= f.t + 2 * h THEN CASE WHEN side = 'BUY' THEN 1 ELSE -1 END * (b.mid - f.price) END AS m FROM
(SELECT *, ts + h AS t FROM fills, (VALUES ('5m', 300), ('15m', 900), ('1h', 3600), ('24h', 86400)) v(horizon, h)) f ASOF LEFT JOIN one_book b ON f.token_id = b.token_id AND f.t <= b.ts) GROUP BY 1""", _BOOKS),
    "microstructure_dataset": sql("SELECT * FROM dataset", POSITIONS, _BOOKS, _DATASET),
    "dataset_null_reasons": sql("SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(null_reasons, ',')) AS reason FROM dataset WHERE null_reasons IS NOT NULL) GROUP BY 1", POSITIONS, _BOOKS, _DATASET),
    "merge_like_tx": sql("SELECT wallet, tx_hash, count(DISTINCT token_id) AS n_tokens, string_agg(DISTINCT token_id, ',' ORDER BY token_id) AS tokens, round(sum(delta_usdc), 4) + 0 AS net_usdc FROM ledger WHERE event_type = 'TRADE' GROUP BY 1, 2 HAVING count(DISTINCT token_id) >= 2"),
    "merge_batches": sql(f"""SELECT wallet, event_id, session, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, round(sum(size), 4) AS size FROM
(SELECT *, sum(s) OVER (PARTITION BY wallet, event_id {_UP})::BIGINT AS session FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY wallet, event_id ORDER BY ts, id) <= 7200 THEN 0 ELSE 1 END AS s FROM ledger JOIN markets USING (condition_id) WHERE event_type = 'MERGE')) GROUP BY 1, 2, 3 HAVING count(*) > 1"""),
    "unpaired_periods": sql(f"""SELECT wallet, condition_id, min(ts) AS open_ts, max(ts) FILTER (NOT o) AS close_ts, round(max(gap), 4) AS max_gap, coalesce(max(event_type) FILTER (NOT o), 'OPEN') AS resolved_by FROM
(SELECT *, coalesce(sum(CASE WHEN o THEN 0 ELSE 1 END) OVER (PARTITION BY wallet, condition_id ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM
 (SELECT *, gap > 1e-6 AS o FROM (SELECT *, round(abs(sum(CASE WHEN event_type = 'REDEEM' THEN 0 WHEN outcome_index = 0 THEN delta_shares ELSE -delta_shares END) OVER (PARTITION BY wallet, condition_id, seg {_UP})), 4) AS gap FROM
  (SELECT *, sum(CASE WHEN event_type = 'REDEEM' THEN 1 ELSE 0 END) OVER (PARTITION BY wallet, condition_id {_UP}) AS seg FROM ledger WHERE event_type IN ('TRADE', 'REDEEM'))))) GROUP BY wallet, condition_id, island HAVING count(*) FILTER (o) > 0"""),
    "pair_completion": sql("""SELECT t.id, o.id AS pair_id, o.ts - t.ts AS wait_s, round(1 - t.price - o.price, 4) + 0 AS pair_edge, CASE WHEN o.ts IS NULL THEN 'not_completed' WHEN o.ts - t.ts < 10 THEN 'under_10s' WHEN o.ts - t.ts < 60 THEN 'under_60s' WHEN o.ts - t.ts < 300 THEN '1m_5m' WHEN o.ts - t.ts < 900 THEN '5m_15m' WHEN o.ts - t.ts < 3600 THEN '15m_60m' ELSE 'over_60m' END AS bucket,
CASE WHEN o.ts IS NULL THEN 'unknown' WHEN round(t.price + o.price, 4) < 0.90 THEN 'lt_0_90' WHEN round(t.price + o.price, 4) < 0.95 THEN '0_90_0_95' WHEN round(t.price + o.price, 4) < 0.98 THEN '0_95_0_98' WHEN round(t.price + o.price, 4) <= 1.00 THEN '0_98_1_00' ELSE 'gt_1_00' END AS cost_bucket
FROM ledger t LEFT JOIN LATERAL (SELECT id, ts, price FROM ledger x WHERE x.event_type = 'TRADE' AND x.wallet = t.wallet AND x.condition_id = t.condition_id AND x.outcome_index <> t.outcome_index AND (x.ts, x.id) > (t.ts, t.id) ORDER BY ts, id LIMIT 1) o ON true WHERE t.side = 'BUY'"""),
    "sibling_sequences": sql("""SELECT a.side || '->' || b.side AS kind, count(*) AS n, min(b.ts - a.ts) AS least_s, count(DISTINCT a.wallet || '/' || a.event_id) AS n_series FROM (SELECT * FROM fills JOIN markets USING (condition_id)) a JOIN (SELECT * FROM fills JOIN markets USING (condition_id)) b
ON a.wallet = b.wallet AND a.event_id = b.event_id AND a.condition_id <> b.condition_id AND b.ts - a.ts BETWEEN 0 AND 3600 AND (b.ts > a.ts OR b.id > a.id) GROUP BY 1""", _BOOKS),
    "order_timing": sql("SELECT f.id, min(b.ts) AS first_seen_ts, max(b.ts) AS last_seen_ts, count(*) AS n_books FROM fills f JOIN books b ON f.token_id = b.token_id AND b.ts BETWEEN f.ts - 86400 AND f.ts AND least(abs(best_bid - f.price), abs(best_ask - f.price)) <= 0.02 + 1e-9 GROUP BY 1", _BOOKS),
    "leader_follower_tiers": sql("""SELECT id, tier::BIGINT AS tier, gap_s, leader_id FROM (SELECT l.id, tier, gap_s, leader_id, row_number() OVER (PARTITION BY l.id ORDER BY tier, gap_s, r_ts, leader_id) AS rn FROM (SELECT l.* FROM ledger l JOIN markets USING (condition_id) WHERE event_type = 'TRADE' AND wallet = 'w1') l LEFT JOIN
(SELECT l.id, r.id AS leader_id, r.ts AS r_ts, abs(l.ts - r.ts) AS gap_s, CASE WHEN l.token_id = r.token_id AND l.side = r.side THEN 1 WHEN l.token_id = r.token_id THEN 2 WHEN l.condition_id = r.condition_id AND l.side = r.side THEN 3 WHEN l.condition_id = r.condition_id THEN 4 ELSE 5 END AS tier
 FROM (SELECT * FROM ledger JOIN markets USING (condition_id)) l JOIN (SELECT * FROM ledger JOIN markets USING (condition_id)) r ON l.event_id = r.event_id AND abs(l.ts - r.ts) <= 3600 WHERE l.event_type = 'TRADE' AND r.event_type = 'TRADE' AND l.wallet = 'w1' AND r.wallet = 'w2') m ON m.id = l.id) WHERE rn = 1"""),
}
