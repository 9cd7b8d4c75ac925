"""Fees, enrichment, reconciliation, fingerprints, detectors, interpretable rules and monitoring."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import ordered as O
from tidemark.plans import accounting as A
from tidemark.plans import matching as M
from tidemark.plans.accounting import KEY
from tidemark.plans.views import POSITIONS, ledger, markets, r4, sql, tokens

D = 1704067200
#: Fee schedule: category, in force from and to, rate, exponent.
RULES = [
    ("sports", 0, D + 10 * 86400, 0.02, 1.0),
    ("sports", D + 10 * 86400, None, 0.03, 1.0),
    ("politics", D + 5 * 86400, None, 0.01, 0.5),
    ("default", 0, None, 0.015, 1.0),
]
#: Weights of the detectors' signals: detector, feature, weight, half-saturation or none.
SIGNALS = [
    ("market_making", "maker_fill_share", 0.35, None),
    ("market_making", "reward_income_share", 0.25, None),
    ("market_making", "bond_inventory_ratio", 0.20, None),
    ("market_making", "micro_episode_share", 0.20, None),
    ("inventory_cycling", "bond_inventory_ratio", 0.40, None),
    ("inventory_cycling", "merge_frequency", 0.35, 0.5),
    ("inventory_cycling", "redeem_frequency", 0.25, 0.5),
    ("value_betting", "taker_fill_share", 0.30, None),
    ("value_betting", "episode_duration_p50", 0.25, 86400.0),
    ("value_betting", "calibration_edge", 0.25, None),
    ("value_betting", "market_category_concentration", 0.20, None),
]


def _values(spark, rows, schema):
    """A few literal rows as a table."""
    def lit(v):
        return "NULL" if v is None else repr(v) if isinstance(v, str) else str(v)

    body = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({schema})")


def trades(spark, sf_dir):
    """Trades with their market's category and the role that enrichment found, if any."""
    t = ledger(spark, sf_dir).where("event_type = 'TRADE'")
    t = t.join(markets(spark).select("condition_id", "category", "event_id"), "condition_id", "left")
    x = F.col("id") * 7 % 10
    return t.withColumns({"category": F.coalesce("category", F.lit("unclassified")), "role": F.when(x < 6, "maker").when(x < 9, "taker")})


def fee_estimates_scd2(spark, sf_dir):
    rules = _values(spark, RULES, "category, effective_from, effective_to, rate, exponent")
    rules = rules.withColumns({"rate": F.col("rate").cast("double"), "exponent": F.col("exponent").cast("double")})
    out = O.effective_rule(trades(spark, sf_dir), rules, "category")
    return out.select("id", "category", "role", "rate", scalars.fee(F.col("size"), F.col("price"), F.col("rate"), F.col("exponent")).alias("fee"), "ts", (F.col("size") * F.col("price")).alias("notional"))


def fee_estimates(spark, sf_dir):
    return fee_estimates_scd2(spark, sf_dir).select("id", "category", "rate", "fee")


def fee_attribution(spark, sf_dir):
    f = fee_estimates_scd2(spark, sf_dir).withColumn("week", F.floor((F.col("ts") - D) / 604800))
    return f.groupBy("week", "category").agg(
        F.count("*").alias("n"), r4(F.sum("fee"), "fees"), r4(F.sum(F.when(F.col("role") == "maker", F.col("fee")).otherwise(0.0)), "maker_fees"),
        r4(F.sum(F.when(F.col("role") == "taker", F.col("fee")).otherwise(0.0)), "taker_fees"), F.count_if(F.col("role").isNull()).alias("n_unknown"), r4(F.sum("notional"), "notional"),
    )


def fee_coverage(spark, sf_dir):
    f = fee_estimates_scd2(spark, sf_dir)
    return f.agg(F.count("*").alias("n"), F.count("fee").alias("n_fee"), F.count("role").alias("n_role"), F.count_if(F.col("fee") > 0).alias("n_charged"))


def chain_fills(spark, sf_dir):
    """Fills as the chain has them: most trades, every fourth with a quantity that the ledger does not state."""
    t = ledger(spark, sf_dir).where("event_type = 'TRADE' and id % 5 != 0")
    shares = F.round(F.col("size") + F.when(F.col("id") % 4 == 0, 0.1).otherwise(0.0), 6)
    return t.select("wallet", "tx_hash", "token_id", F.col("id").alias("fill_id"), F.col("ts").alias("fill_ts"), shares.alias("f_size"), F.abs("delta_usdc").alias("f_usdc"))


def enrichment_candidates(spark, sf_dir):
    """Trades of the ledger that a fill may be; every seventh comes twice, half of these for other cash."""
    t = ledger(spark, sf_dir).where("event_type = 'TRADE'").select("wallet", "tx_hash", "token_id", "id", "size", F.abs("delta_usdc").alias("usdc"))
    twin = t.where("id % 7 = 0").withColumns({"usdc": F.col("usdc") + F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.0), "id": F.col("id") + 1_000_000_000_000})
    return t.unionByName(twin)


def enrichment_match(spark, sf_dir, tolerance: float = 1e-6):
    """Every fill seen on the chain with the trade that it is, by transaction, wallet and token.

    One trade of its shares is it; of several the one of its cash, none of its cash is no match, more are ambiguous. Fills
    without a trade stay as ``none``.
    """
    key = ["wallet", "tx_hash", "token_id"]
    met = chain_fills(spark, sf_dir).join(enrichment_candidates(spark, sf_dir), key, "left")
    hit = F.coalesce(F.abs(F.col("size") - F.col("f_size")) <= tolerance, F.lit(False))
    close = hit & (F.abs(F.col("usdc") - F.col("f_usdc")) <= tolerance)
    g = met.groupBy("fill_id").agg(
        F.count_if(hit).alias("hits"), F.min(F.when(hit, F.col("id"))).alias("one"), F.count_if(close).alias("by_usdc"), F.min(F.when(close, F.col("id"))).alias("one_usdc"),
        F.max(F.when(hit, F.col("usdc"))).alias("most_usdc"), F.max("f_usdc").alias("f_usdc"),
    )
    paid = (F.col("f_usdc") != 0) & (F.col("most_usdc") != 0)
    event = F.when(F.col("hits") == 1, F.col("one")).when((F.col("hits") > 1) & paid & (F.col("by_usdc") == 1), F.col("one_usdc"))
    none = (F.col("hits") == 0) | paid & (F.col("by_usdc") == 0)
    status = F.when(event.isNotNull(), "matched").when(none, "none").otherwise("ambiguous")
    return g.select("fill_id", "hits", event.alias("event_id"), status.alias("status"))


def enrichment_watermark(spark, sf_dir):
    """How far each wallet's chain fills reach, and its trades by whether enrichment has come to them yet."""
    head = chain_fills(spark, sf_dir).where("fill_ts < 1706400000").groupBy("wallet").agg(F.max("fill_ts").alias("head_ts"))
    m = enrichment_match(spark, sf_dir).where("status = 'matched'").select(F.col("event_id").alias("id")).distinct().withColumn("found", F.lit(True))
    t = ledger(spark, sf_dir).where("event_type = 'TRADE'").select("id", "wallet", "ts").join(m, "id", "left").join(head, "wallet", "left")
    late = F.col("ts") > F.coalesce("head_ts", F.lit(0))
    return t.groupBy("wallet", "head_ts").agg(
        F.count("*").alias("n"), F.count_if(~late & F.col("found").isNotNull()).alias("n_enriched"), F.count_if(late).alias("n_pending"), F.count_if(~late & F.col("found").isNull()).alias("n_missing"),
    )


def enrichment_resolution(spark, sf_dir):
    """Several observations of a fill: a role that all agree on, else ambiguous; the smallest source wins."""
    t = trades(spark, sf_dir).select("id", "wallet", F.col("ts"), "role")
    seen = t.withColumn("source", F.explode(F.array(F.lit("a_logs"), F.lit("b_graph"))))
    flips = (F.col("source") == "b_graph") & (F.col("id") % 11 == 0)
    seen = seen.withColumn("role", F.when(flips, "taker").otherwise(F.coalesce("role", F.lit("ambiguous"))))
    g = seen.groupBy("id").agg(F.collect_set("role").alias("roles"), F.min_by("source", "source").alias("source"))
    role = F.when((F.size("roles") == 1), F.get("roles", F.lit(0))).otherwise("ambiguous")
    return g.groupBy(role.alias("role"), "source").agg(F.count("*").alias("n"))


def enrichment_coverage(spark, sf_dir):
    t = trades(spark, sf_dir)
    age = F.floor((F.lit(D + 30 * 86400) - F.col("ts")) / 86400)
    bucket = F.when(age < 2, "pending").when(age < 7, "recent").when(age < 15, "mid").otherwise("old")
    g = t.groupBy("wallet", bucket.alias("recency"))
    return g.agg(F.count("*").alias("n"), F.count("role").alias("n_enriched"), r4(F.count("role") / F.count("*"), "coverage"))


def reconciliation_facts(spark, sf_dir):
    """Holdings against the positions that the venue states, with the first reason that applies."""
    local = A.latest(A.positions(spark, sf_dir)).where("abs(qty) > 1e-6").select(*KEY, F.round("qty", 4).alias("local"))
    number = F.substring("token_id", 2, 9).cast("long")
    venue = local.where(number % 7 != 0).select(*KEY, F.when(number % 5 == 0, F.col("local") + 5).when(number % 3 == 0, F.col("local") * 1.01).otherwise(F.col("local")).alias("venue"))
    extra = spark.range(10).select(F.concat(F.lit("w"), "id").alias("wallet"), F.lit("t99").alias("token_id"), F.lit(1.0).alias("venue"))
    both = local.join(venue.unionByName(extra), KEY, "full").join(A.token_prices(spark), "token_id", "left")
    diff = F.abs(F.coalesce("local", F.lit(0.0)) - F.coalesce("venue", F.lit(0.0)))
    reason = (
        F.when(diff <= 0.01, "match").when(F.col("local").isNull(), "missing_local")
        .when(F.col("venue").isNull() & F.col("res_price").isNotNull(), "resolved_unlisted").when(F.col("venue").isNull(), "missing_venue")
        .when(F.col("local") < 0, "negative_local").when(diff <= 0.02 * F.abs("venue"), "small_difference").otherwise("size_mismatch")
    )
    status = F.when(reason == "match", "pass").when(reason.isin("resolved_unlisted", "negative_local", "small_difference"), "warn").otherwise("fail")
    return both.select(*KEY, r4("local"), r4("venue"), reason.alias("reason"), status.alias("status"), r4(diff, "diff"))


def wallet_trust(spark, sf_dir):
    g = reconciliation_facts(spark, sf_dir).groupBy("wallet").agg(F.count_if(F.col("status") == "fail").alias("n_fail"), F.count_if(F.col("status") == "warn").alias("n_warn"))
    return g.select("wallet", "n_fail", "n_warn", F.when(F.col("n_fail") > 4, "untrusted").when(F.col("n_fail") + F.col("n_warn") > 4, "caution").otherwise("trusted").alias("trust"))


def _scoped(df):
    """Every row once for all and once for its category."""
    return df.withColumn("scope", F.explode(F.array(F.lit("all"), F.concat(F.lit("category:"), "category"))))


def fingerprint_features(spark, sf_dir):
    """Features of each wallet in each scope as (feature, value, null_reason)."""
    m = markets(spark).select("condition_id", "category")
    day = F.floor(F.col("ts") / 86400)
    t = _scoped(trades(spark, sf_dir)).groupBy("wallet", "scope").agg(
        F.count_if(F.col("role") == "maker").alias("maker"), F.count_if(F.col("role") == "taker").alias("taker"), F.count("*").alias("n_trades"), F.count("role").alias("n_role")
    )
    e = ledger(spark, sf_dir).join(m, "condition_id", "left").withColumn("category", F.coalesce("category", F.lit("unclassified")))
    e = _scoped(e).groupBy("wallet", "scope").agg(
        F.count_if(F.col("event_type") == "MERGE").alias("merges"), F.count_if(F.col("event_type") == "REDEEM").alias("redeems"), F.countDistinct(day).alias("days"),
        F.sum(F.when(F.col("event_type") == "REWARD", F.col("delta_usdc")).otherwise(0.0)).alias("rewards"),
    )
    of = tokens(spark).select("token_id", "condition_id")
    ep = O.episodes(A.positions(spark, sf_dir), KEY).join(of, "token_id", "left").join(m, "condition_id", "left")
    ep = ep.withColumn("category", F.coalesce("category", F.lit("unclassified")))
    ep = ep.withColumn("d", F.when(F.col("close_reason") != "open", F.col("close_ts") - F.col("open_ts")))
    g = _scoped(ep).groupBy("wallet", "scope").agg(
        F.count("*").alias("episodes"),
        F.count_if(F.col("d") <= 60).alias("micro"), F.count("d").alias("closed"), F.avg("num_adds").alias("adds"), F.avg("num_partial_exits").alias("exits"),
        F.avg("peak_qty").alias("avg_size"), F.median("peak_qty").alias("median_size"), F.sum("realized_pnl").alias("pnl"),
    )
    ranks = O.ranked_values(_scoped(ep).withColumn("d", F.col("d").cast("double")), ["wallet", "scope"], "d", {"p50": 0.5, "p90": 0.9})
    g = g.join(ranks, ["wallet", "scope"], "left")
    n = ep.groupBy("wallet", "category").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("wallet"))
    hhi = n.withColumn("s", F.col("n") / total).groupBy("wallet").agg(F.sum(F.col("s") * F.col("s")).alias("hhi")).withColumn("scope", F.lit("all"))
    w = g.join(t, ["wallet", "scope"], "left").join(e, ["wallet", "scope"], "left").join(hhi, ["wallet", "scope"], "left")

    def ratio(a, b):
        return F.try_divide(F.col(a).cast("double"), F.nullif(F.col(b).cast("double"), F.lit(0.0)))

    income = F.try_divide("rewards", F.nullif(F.abs("pnl") + F.col("rewards"), F.lit(0.0)))
    values = {
        "maker_fill_share": (ratio("maker", "n_role"), "no_role"), "taker_fill_share": (ratio("taker", "n_role"), "no_role"),
        "enrichment_coverage": (ratio("n_role", "n_trades"), "no_trades"), "merge_frequency": (ratio("merges", "days"), "no_days"),
        "redeem_frequency": (ratio("redeems", "days"), "no_days"), "episode_count": (F.col("episodes").cast("double"), "no_episodes"),
        "episode_duration_p50": (F.col("p50"), "no_closed"), "episode_duration_p90": (F.col("p90"), "no_closed"),
        "micro_episode_share": (ratio("micro", "closed"), "no_closed"), "adds_per_episode": (F.col("adds"), "no_episodes"),
        "partial_exit_frequency": (F.col("exits"), "no_episodes"), "avg_position_size": (F.col("avg_size") + 1e-9, "no_episodes"),
        "median_position_size": (F.col("median_size"), "no_episodes"), "market_category_concentration": (F.col("hhi"), "all_scope_only"),
        "realized_pnl": (F.col("pnl"), "no_episodes"), "reward_income_share": (income, "no_income"),
    }
    tall = F.array(*(F.struct(F.lit(k).alias("feature"), r4(v, "value"), F.when(v.isNull(), F.lit(r)).alias("null_reason")) for k, (v, r) in values.items()))
    return w.select("wallet", "scope", F.explode(tall).alias("f")).select("wallet", "scope", "f.*")


def fingerprint_daily_features(spark, sf_dir):
    """Features from the daily tables: bond share of exposure, unrealized profit at the end, stale share, time to the close."""
    x = A.exposures_daily(spark, sf_dir)
    size = F.abs("bond") + F.abs("directional")
    x = x.groupBy("wallet", "day").agg(F.sum(F.abs("bond")).alias("b"), F.sum(size).alias("s"))
    x = x.where("s > 0").groupBy("wallet").agg(F.avg(F.col("b") / F.col("s")).alias("bond_inventory_ratio"))
    e = A.daily_equity(spark, sf_dir).groupBy("wallet").agg(F.max_by("unrealized", "day").alias("unrealized_pnl"), F.avg("stale_share").alias("stale_mark_share"))
    ep = O.episodes(A.positions(spark, sf_dir), KEY).join(A.token_prices(spark), "token_id").where("open_ts <= closed_ts")
    ep = ep.groupBy("wallet").agg(F.percentile(F.col("closed_ts") - F.col("open_ts"), 0.5).alias("time_to_close"))
    out = e.join(x, "wallet", "left").join(ep, "wallet", "left")
    return out.select("wallet", r4(F.col("bond_inventory_ratio") + 1e-9, "bond_inventory_ratio"), r4("unrealized_pnl"), r4(F.col("stale_mark_share") + 1e-9, "stale_mark_share"), r4("time_to_close", "time_to_close_s"))


def entry_price_distribution(spark, sf_dir):
    """Share of a wallet's buys in each price decile."""
    b = ledger(spark, sf_dir).where("side = 'BUY'").groupBy("wallet", scalars.price_bucket(F.col("price")).alias("decile")).agg(F.count("*").alias("n"))
    return b.select("wallet", "decile", "n", r4(F.col("n") / F.sum("n").over(Window.partitionBy("wallet")), "share"))


def resolution_calibration(spark, sf_dir):
    b = ledger(spark, sf_dir).where("side = 'BUY'").join(A.token_prices(spark), "token_id")
    bucket = scalars.price_bucket(F.col("price"))
    g = b.groupBy(bucket.alias("decile")).agg(F.count("*").alias("n"), F.avg("res_price").alias("win"))
    return g.select("decile", "n", r4("win", "win_rate"), scalars.bucket_midpoint(F.col("decile")).alias("implied"), r4(F.col("win") - scalars.bucket_midpoint(F.col("decile")), "edge"))


def _detector_features(spark, sf_dir):
    """What the detectors read beside the fingerprints, in each scope: the bond share of exposure, averaged over days, and
    half plus the mean win rate over the implied one, over all buys of resolved tokens."""
    category = F.coalesce("category", F.lit("unclassified")).alias("category")
    of = markets(spark).select("condition_id", "category")
    x = A.exposures_daily(spark, sf_dir).join(of, "condition_id", "left").select("*", category.alias("c")).drop("category").withColumnRenamed("c", "category")
    size = F.abs("bond") + F.abs("directional")
    days = _scoped(x).groupBy("wallet", "scope", "day").agg(F.sum(F.abs("bond")).alias("b"), F.sum(size).alias("s")).where("s > 0")
    bond = days.groupBy("wallet", "scope").agg(F.avg(F.col("b") / F.col("s")).alias("value")).withColumn("feature", F.lit("bond_inventory_ratio"))
    buys = trades(spark, sf_dir).where("side = 'BUY'").join(A.token_prices(spark), "token_id")
    edge = F.avg(F.col("res_price") - scalars.bucket_midpoint(scalars.price_bucket(F.col("price"))))
    edges = _scoped(buys).groupBy("wallet", "scope").agg((edge + 0.5).alias("value")).withColumn("feature", F.lit("calibration_edge"))
    return bond.unionByName(edges)


def detector_inputs(spark, sf_dir):
    """All features that the detectors read, ``wallet, scope, feature, value``; a missing one has a null value."""
    own = fingerprint_features(spark, sf_dir).select("wallet", "scope", "feature", "value")
    scopes = own.where("feature = 'episode_count'").select("wallet", "scope")
    more = scopes.crossJoin(F.broadcast(_values(spark, [("bond_inventory_ratio",), ("calibration_edge",)], "feature")))  # two literal rows
    more = more.join(_detector_features(spark, sf_dir), ["wallet", "scope", "feature"], "left")
    return own.unionByName(more.select("wallet", "scope", "feature", "value"))


def detector_scores(spark, sf_dir):
    """Weighted mean of the signals that are there; confidence is their share of all weight."""
    return scores_of(detector_inputs(spark, sf_dir))


def scores_of(features):
    """The detectors' scores over ``detector_inputs``, however they are kept."""
    s = _values(features.sparkSession, SIGNALS, "detector, feature, weight, half")
    s = s.withColumns({"weight": F.col("weight").cast("double"), "half": F.col("half").cast("double")})
    f = features.join(F.broadcast(s), "feature")
    raw = F.when(F.col("half").isNotNull(), F.col("value") / (F.col("value") + F.col("half"))).otherwise(F.col("value"))
    f = f.withColumn("signal", scalars.clamp01(raw)).withColumn("there", F.col("value").isNotNull())
    weight = F.when(F.col("there"), F.col("weight")).otherwise(0.0)
    g = f.groupBy("wallet", "scope", "detector").agg(F.sum(F.when(F.col("there"), F.col("signal") * F.col("weight")).otherwise(0.0)).alias("s"), F.sum(weight).alias("w"), F.sum("weight").alias("all"), F.count_if("there").alias("n_signals"))
    return g.select("wallet", "scope", "detector", r4(F.try_divide("s", F.nullif(F.col("w"), F.lit(0.0))), "score"), r4(F.col("w") / F.col("all"), "confidence"), "n_signals")


PRE_FILL = ["id", "trade_ts", "side", "fill_price", "fill_shares", "book_before_age_s", "mid", "spread_bps", "inside", "qty_before", "directional_before", "bond_before", "trade_hour", "imbalance"]


def _split_dataset(spark, sf_dir):
    """Fills in order of time, 60/20/20 in train, validation and test; rules see only what was known before the fill."""
    return temporal_split(M.microstructure_dataset(spark, sf_dir).select(*PRE_FILL, "markout_1h"))


def temporal_split(d):
    """``d`` with ``split``: the first 60 % of its fills in order of time are train, the next 20 % validation, the rest test."""
    # a global order without a single task: ranks within a day, after the days before it
    d = d.withColumn("day", F.floor(F.col("trade_ts") / 86400))
    sizes = d.groupBy("day").agg(F.count("*").alias("n"))
    run = Window.orderBy("day")  # one row a day
    sizes = sizes.withColumns({"ahead": F.sum("n").over(run) - F.col("n"), "total": F.sum("n").over(Window.partitionBy(F.lit(1)))})
    d = d.join(F.broadcast(sizes.drop("n")), "day")
    rank = F.col("ahead") + F.row_number().over(Window.partitionBy("day").orderBy("trade_ts", "id")) - 1
    split = F.when(rank < F.floor(F.col("total") * 0.6), "train").when(rank < F.floor(F.col("total") * 0.8), "validation").otherwise("test")
    return d.withColumn("split", split)


def _grid_metrics(spark, sf_dir):
    grid = _values(spark, [(s, a, h) for s in (100, 400, 900) for a in (600, 3600, 14400) for h in (0, 1)], "min_spread, max_age, need_inside")
    d = _split_dataset(spark, sf_dir)
    fires = (F.col("spread_bps") >= F.col("min_spread")) & (F.col("book_before_age_s") <= F.col("max_age")) & ((F.col("need_inside") == 0) | F.col("inside"))
    x = d.crossJoin(F.broadcast(grid)).withColumn("fires", F.coalesce(fires, F.lit(False)))  # the grid is 18 literal rows
    up = F.col("fires") & (F.col("markout_1h") > 0)
    g = x.groupBy("min_spread", "max_age", "need_inside", "split").agg(
        F.count("*").alias("n"), F.count_if("fires").alias("n_fired"), F.count_if(up).alias("n_up"), F.count_if(F.col("markout_1h") > 0).alias("n_up_all"),
        F.avg(F.when(F.col("fires"), F.col("markout_1h"))).alias("markout"), F.max(F.when(F.col("fires"), F.abs("qty_before"))).alias("max_inventory"),
    )
    precision = F.try_divide("n_up", F.nullif(F.col("n_fired"), F.lit(0)))
    explained = F.try_divide("n_up", F.nullif(F.col("n_up_all"), F.lit(0)))
    return g.withColumns({"precision": precision, "explained": explained, "score": F.coalesce(precision * explained, F.lit(0.0))})


def rule_grid_metrics(spark, sf_dir):
    g = _grid_metrics(spark, sf_dir)
    return g.select("min_spread", "max_age", "need_inside", "split", "n", "n_fired", r4(F.col("n_fired") / F.col("n"), "coverage"), r4("precision"), r4("explained"), r4("markout", "avg_markout"), r4("max_inventory"))


def rule_promotion(spark, sf_dir):
    """The grid's best rule on train, promoted if its markout is positive on validation and on test."""
    g = _grid_metrics(spark, sf_dir)
    keys = ["min_spread", "max_age", "need_inside"]
    wide = g.groupBy(*keys).pivot("split", ["train", "validation", "test"]).agg(F.round(F.first("score"), 8).alias("score"), F.first("markout").alias("markout"), F.first("n_fired").alias("fired"))
    best = wide.orderBy(F.desc("train_score"), *keys).limit(1)
    ok = (F.col("validation_markout") > 0) & (F.col("test_markout") > 0) & (F.col("test_fired") > 0)
    return best.select(*keys, r4("train_score"), r4("validation_markout"), r4("test_markout"), F.coalesce(ok, F.lit(False)).alias("promoted"))


def predicate_markouts(spark, sf_dir):
    """Support, share and markout of fixed predicates over the fills, one pass for all."""
    d = _split_dataset(spark, sf_dir)
    preds = {
        "A_wide_spread": F.col("spread_bps") >= 500, "B_fresh_book": F.col("book_before_age_s") <= 900, "C_balances": F.col("directional_before") * F.when(F.col("side") == "BUY", -1).otherwise(1) > 0,
        "D_has_pairs": F.col("bond_before") > 0, "E_cheap": F.col("fill_price") <= 0.2, "F_evening": F.col("trade_hour") >= 18, "G_inside": F.col("inside"),
    }
    hits = F.filter(F.array(*(F.struct(F.lit(k).alias("rule"), F.coalesce(p, F.lit(False)).alias("on")) for k, p in preds.items())), lambda s: s["on"])
    x = d.select("split", "markout_1h", F.explode(hits).alias("h"))
    return x.groupBy(F.col("h.rule").alias("rule"), "split").agg(F.count("*").alias("n"), F.count("markout_1h").alias("n_markout"), r4(F.avg("markout_1h"), "avg_markout"))


#: Words that mark a market as derived from a match or tournament. Fixed values.
DERIVATIVES = ("o/u", "over", "under", "spread", "exact score", "team to advance", "quarterfinal", "semifinal", "final")


def watchlist(spark, sf_dir):
    """Tokens to watch with their smallest priority: traded lately 10, held 20, keyword 30, keyword and derived market 40."""
    t = ledger(spark, sf_dir).where("event_type = 'TRADE'")
    recent = t.where(F.col("ts") >= D + 29 * 86400).select("token_id", F.lit(10).alias("priority"))
    held = A.latest(A.positions(spark, sf_dir)).where("qty > 1e-6").select("token_id", F.lit(20).alias("priority"))
    named = tokens(spark).join(markets(spark).where(scalars.keyword_match(("world cup",), F.col("question"))), "condition_id")
    named = named.select("token_id", F.when(scalars.keyword_match(DERIVATIVES, F.col("question")), 40).otherwise(30).alias("priority"))
    dead = A.token_prices(spark).where(F.col("closed_ts") < D + 21 * 86400).select("token_id")
    every = recent.unionAll(held).unionAll(named)
    return every.groupBy("token_id").agg(F.min("priority").cast("long").alias("priority"), F.count("*").alias("n_reasons")).join(dead, "token_id", "left_anti")


def sync_alerts(spark, sf_dir, cadence_s: int = 3600, multiplier: float = 2.0, failures: int = 3):
    """Alerts from the state of each wallet's syncs, one row each: never synced, stale, and failing again and again.

    Every event stands for a sync, an error for one that failed; the failures since the last success are consecutive.
    """
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e = e.select(F.concat(F.lit("w"), F.col("user_id") % 10).alias("wallet"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("ts"), "event_id", (F.col("event_type") == "error").alias("failed"))
    last = e.where("not failed").groupBy("wallet").agg(F.max(F.struct("ts", "event_id")).alias("ok"))
    j = e.join(last, "wallet", "left")
    since = F.count_if(F.col("failed") & (F.col("ok").isNull() | (F.struct("ts", "event_id") > F.col("ok"))))
    g = j.groupBy("wallet").agg(F.max("ok.ts").alias("last_success"), since.alias("n_failures"))
    now = F.lit(D + 30 * 86400)
    found = F.array(
        F.when(F.col("last_success").isNull(), F.struct(F.lit("wallet_new").alias("alert"), F.lit("info").alias("severity"))),
        F.when(now - F.col("last_success") > cadence_s * multiplier, F.struct(F.lit("sync_stale").alias("alert"), F.lit("warning").alias("severity"))),
        F.when(F.col("last_success").isNotNull() & (F.col("n_failures") >= failures), F.struct(F.lit("sync_failing").alias("alert"), F.lit("error").alias("severity"))),
    )
    g = g.select("wallet", "last_success", "n_failures", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("a"))
    return g.select("wallet", "a.alert", "a.severity", "last_success", "n_failures")


def wallet_alerts(spark, sf_dir):
    g = ledger(spark, sf_dir).groupBy("wallet").agg(F.max("ts").alias("last_ts"), F.count("*").alias("n"))
    late = F.lit(D + 30 * 86400) - F.col("last_ts")
    return g.select("wallet", "n", late.alias("silence_s"), F.when(late > 7200, "stale").when(late > 3600, "late").otherwise("ok").alias("state"))


def closed_cycle_score(spark, sf_dir):
    t = ledger(spark, sf_dir).where("event_type = 'TRADE'").select("wallet", "condition_id").distinct()
    open_ = A.latest(A.positions(spark, sf_dir)).where("qty > 1e-6").select("wallet", "condition_id").distinct().withColumn("open", F.lit(1))
    g = t.join(open_, ["wallet", "condition_id"], "left").groupBy("wallet").agg(F.count("*").alias("n"), F.count("open").alias("n_open"))
    return g.select("wallet", "n", "n_open", r4(1 - F.col("n_open") / F.col("n"), "score"))


def lifecycle_rollup(spark, sf_dir):
    last = A.latest(A.positions(spark, sf_dir)).join(markets(spark), "condition_id", "left")
    state = F.when(F.col("question").isNull(), "unknown").when(F.abs("qty") <= O.EPSILON, "closed_complete").when(F.col("closed"), "pending").otherwise("live")
    return last.groupBy(F.coalesce("event_id", F.lit("-")).alias("event_id"), state.alias("state")).agg(F.count("*").alias("n"), F.countDistinct("wallet").alias("n_wallets"))


def wallets_in_both(spark, sf_dir):
    """Set operations: (wallet, condition) pairs with buys of both outcomes and no redeem on an odd day."""
    e = ledger(spark, sf_dir)

    def bought(k):
        return e.where((F.col("side") == "BUY") & (F.col("outcome_index") == k)).select("wallet", "condition_id")

    odd = F.floor(F.col("ts") / 86400) % 2 == 1
    gone = e.where((F.col("event_type") == "REDEEM") & odd).select("wallet", "condition_id")
    return bought(0).intersect(bought(1)).exceptAll(gone.distinct())


def ledger_page(spark, sf_dir):
    e = ledger(spark, sf_dir).where("wallet = 'w1'").orderBy(F.desc("ts"), F.desc("id")).offset(50).limit(25)
    return e.select("id", "ts", "event_type", "side", "token_id")


def token_cooccurrence(spark, sf_dir):
    """Tokens traded by a wallet in the same hour at least three times, and each token's weighted degree."""
    t = ledger(spark, sf_dir).where("event_type = 'TRADE'").select("wallet", F.floor(F.col("ts") / 3600).alias("hour"), "token_id").distinct()
    a, b = t.withColumnRenamed("token_id", "a"), t.withColumnRenamed("token_id", "b")
    pairs = a.join(b, ["wallet", "hour"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n")).where("n >= 3")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("token_id"), "n")
    return ends.groupBy("token_id").agg(F.count("*").alias("degree"), F.sum("n").alias("weighted_degree"))


def activity_pivot(spark, sf_dir):
    """Trades of each wallet by hour of the day, a column for each side."""
    t = ledger(spark, sf_dir).where("event_type = 'TRADE'").withColumn("hour", F.floor(F.col("ts") % 86400 / 3600))
    return t.groupBy("wallet", "hour").pivot("side", ["BUY", "SELL"]).agg(F.count("id")).fillna(0).withColumnsRenamed({"BUY": "buys", "SELL": "sells"})


def activity_rank_correlation(spark, sf_dir):
    """Spearman correlation of each wallet's daily trade counts with those of all wallets: correlation of average ranks."""
    t = ledger(spark, sf_dir).where("event_type = 'TRADE'").withColumn("day", F.floor(F.col("ts") / 86400))
    own = t.groupBy("wallet", "day").agg(F.count("*").alias("n"))
    every = own.groupBy("day").agg(F.sum("n").alias("total"))
    grid = own.select("wallet").distinct().crossJoin(F.broadcast(every))  # one row a day
    g = grid.join(own, ["wallet", "day"], "left").fillna(0, ["n"])

    def rank(c):
        return F.rank().over(Window.partitionBy("wallet").orderBy(c)) + (F.count("*").over(Window.partitionBy("wallet", c)) - 1) / 2

    g = g.select("wallet", rank("n").alias("a"), rank("total").alias("b"))
    return g.groupBy("wallet").agg(F.count("*").alias("n_days"), r4(F.corr("a", "b"), "rho"))


def rolling_fill_means(spark, sf_dir):
    """Mean price of a wallet's last 20 fills, null until there are 20, and running notional."""
    t = ledger(spark, sf_dir).where("event_type = 'TRADE'")
    w = Window.partitionBy("wallet").orderBy("ts", "id")
    last = w.rowsBetween(-19, 0)
    return t.select("id", r4(F.when(F.count("*").over(last) == 20, F.avg("price").over(last)), "mean_20"), r4(F.sum(F.col("size") * F.col("price")).over(O.upto(["wallet"])), "cum_notional"))


def equity_week_change(spark, sf_dir):
    """Marked profit against that of the latest day at least a week earlier."""
    e = A.daily_equity(spark, sf_dir)
    back = Window.partitionBy("wallet").orderBy("day").rangeBetween(Window.unboundedPreceding, -7)
    return e.select("wallet", "day", r4(F.col("marked_pnl") - F.last("marked_pnl").over(back), "week_change"))


QUERIES = {
    f.__name__: f
    for f in (
        fee_estimates, fee_attribution, fee_coverage, enrichment_match, enrichment_watermark, enrichment_resolution, enrichment_coverage, reconciliation_facts,
        wallet_trust, fingerprint_features, fingerprint_daily_features, entry_price_distribution, resolution_calibration,
        detector_scores, rule_grid_metrics, rule_promotion, predicate_markouts, watchlist, sync_alerts, wallet_alerts, closed_cycle_score,
        lifecycle_rollup, wallets_in_both, ledger_page, token_cooccurrence, activity_pivot, activity_rank_correlation,
        rolling_fill_means, equity_week_change,
    )
}

_FEES = f"""
rules(category, effective_from, effective_to, rate, exponent) AS (VALUES ('sports', 0, {D + 864000}, 0.02::DOUBLE, 1.0::DOUBLE), ('sports', {D + 864000}, NULL, 0.03, 1.0), ('politics', {D + 432000}, NULL, 0.01, 0.5), ('default', 0, NULL, 0.015, 1.0)),
trades AS (SELECT l.*, coalesce(m.category, 'unclassified') AS category, m.event_id, CASE WHEN l.id * 7 % 10 < 6 THEN 'maker' WHEN l.id * 7 % 10 < 9 THEN 'taker' END AS role FROM ledger l LEFT JOIN markets m USING (condition_id) WHERE event_type = 'TRADE'),
fees AS (SELECT t.*, size * price AS notional, rate, CASE WHEN price > 0 AND price < 1 THEN round_even(size * price * rate * pow(price * (1 - price), exponent), 4) ELSE 0 END AS fee_raw
   FROM trades t LEFT JOIN rules r ON r.category = CASE WHEN t.category IN (SELECT category FROM rules) THEN t.category ELSE 'default' END AND r.effective_from <= ts AND (r.effective_to IS NULL OR ts < r.effective_to)),
fee AS (SELECT *, CASE WHEN rate IS NOT NULL THEN fee_raw END AS fee FROM fees)"""
_ENRICH = """
chain AS (SELECT wallet, tx_hash, token_id, id AS fill_id, ts AS fill_ts, round(size + CASE WHEN id % 4 = 0 THEN 0.1::DOUBLE ELSE 0 END, 6) AS f_size, abs(delta_usdc) AS f_usdc FROM ledger WHERE event_type = 'TRADE' AND id % 5 <> 0),
cand AS (SELECT wallet, tx_hash, token_id, id, size, abs(delta_usdc) AS usdc FROM ledger WHERE event_type = 'TRADE' UNION ALL SELECT wallet, tx_hash, token_id, id + 1000000000000, size, abs(delta_usdc) + CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END FROM ledger WHERE event_type = 'TRADE' AND id % 7 = 0),
met AS (SELECT fill_id, f_usdc, c.id, c.usdc, abs(c.usdc - f_usdc) <= 1e-6 AS close FROM chain f LEFT JOIN cand c ON f.wallet = c.wallet AND f.tx_hash = c.tx_hash AND f.token_id = c.token_id AND abs(c.size - f_size) <= 1e-6),
tally AS (SELECT fill_id, max(f_usdc) AS f_usdc, count(id) AS hits, min(id) AS one, count(*) FILTER (close) AS by_usdc, min(id) FILTER (close) AS one_usdc, max(usdc) AS most FROM met GROUP BY 1),
matched AS (SELECT fill_id, hits, CASE WHEN hits = 1 THEN one WHEN hits > 1 AND f_usdc <> 0 AND most <> 0 AND by_usdc = 1 THEN one_usdc END AS event_id,
   CASE WHEN hits = 1 OR (hits > 1 AND f_usdc <> 0 AND most <> 0 AND by_usdc = 1) THEN 'matched' WHEN hits = 0 OR (f_usdc <> 0 AND most <> 0 AND by_usdc = 0) THEN 'none' ELSE 'ambiguous' END AS status FROM tally)"""
_FACTS = """
loc AS (SELECT wallet, token_id, round(qty, 4) AS local, substr(token_id, 2)::BIGINT AS k FROM last WHERE abs(qty) > 1e-6),
ven AS (SELECT wallet, token_id, CASE WHEN k % 5 = 0 THEN local + 5 WHEN k % 3 = 0 THEN local * 1.01::DOUBLE ELSE local END AS venue FROM loc WHERE k % 7 <> 0 UNION ALL SELECT 'w' || r, 't99', 1.0 FROM range(10) g(r)),
f1 AS (SELECT wallet, token_id, local, venue, res_price, abs(coalesce(local, 0) - coalesce(venue, 0)) AS diff FROM loc FULL JOIN ven USING (wallet, token_id) LEFT JOIN prices USING (token_id)),
f2 AS (SELECT *, CASE WHEN diff <= 0.01 THEN 'match' WHEN local IS NULL THEN 'missing_local' WHEN venue IS NULL AND res_price IS NOT NULL THEN 'resolved_unlisted' WHEN venue IS NULL THEN 'missing_venue' WHEN local < 0 THEN 'negative_local' WHEN diff <= 0.02 * abs(venue) THEN 'small_difference' ELSE 'size_mismatch' END AS reason FROM f1),
facts AS (SELECT wallet, token_id, round(local, 4) + 0 AS local, round(venue, 4) + 0 AS venue, reason, CASE WHEN reason = 'match' THEN 'pass' WHEN reason IN ('resolved_unlisted', 'negative_local', 'small_difference') THEN 'warn' ELSE 'fail' END AS status, round(diff, 4) + 0 AS diff FROM f2)"""
_FINGER = """
ep AS (SELECT e.*, coalesce(category, 'unclassified') AS category, CASE WHEN close_reason <> 'open' THEN close_ts - open_ts END AS d FROM episodes e LEFT JOIN tokens USING (token_id) LEFT JOIN markets m USING (condition_id)),
g AS (SELECT wallet, scope, count(*) AS episodes, list_sort(list(d) FILTER (d IS NOT NULL))[floor((count(d) - 1) * 0.5)::INT + 1] AS p50, list_sort(list(d) FILTER (d IS NOT NULL))[floor((count(d) - 1) * 0.9)::INT + 1] AS p90,
   count(*) FILTER (d <= 60) AS micro, count(d) AS closed, avg(num_adds) AS adds, avg(num_partial_exits) AS exits, avg(peak_qty) AS avg_size, median(peak_qty) AS median_size, sum(realized_pnl) AS pnl
   FROM (SELECT *, unnest(['all', 'category:' || category]) AS scope FROM ep) GROUP BY 1, 2),
t AS (SELECT wallet, scope, count(*) FILTER (role = 'maker') AS maker, count(*) FILTER (role = 'taker') AS taker, count(*) AS n_trades, count(role) AS n_role FROM (SELECT *, unnest(['all', 'category:' || category]) AS scope FROM trades) GROUP BY 1, 2),
ev AS (SELECT wallet, scope, count(*) FILTER (event_type = 'MERGE') AS merges, count(*) FILTER (event_type = 'REDEEM') AS redeems, count(DISTINCT ts // 86400) AS days, sum(CASE WHEN event_type = 'REWARD' THEN delta_usdc ELSE 0 END) AS rewards
   FROM (SELECT *, unnest(['all', 'category:' || coalesce(category, 'unclassified')]) AS scope FROM ledger LEFT JOIN markets USING (condition_id)) GROUP BY 1, 2),
hh AS (SELECT wallet, 'all' AS scope, sum(s * s) AS hhi FROM (SELECT wallet, n / sum(n) OVER (PARTITION BY wallet) AS s FROM (SELECT wallet, category, count(*) AS n FROM ep GROUP BY 1, 2)) GROUP BY 1),
wide AS (SELECT * FROM g LEFT JOIN t USING (wallet, scope) LEFT JOIN ev USING (wallet, scope) LEFT JOIN hh USING (wallet, scope)),
features AS (SELECT wallet, scope, x.feature, round(x.value, 4) + 0 AS value, CASE WHEN x.value IS NULL THEN x.reason END AS null_reason FROM (SELECT wallet, scope, unnest([
   {'feature': 'maker_fill_share', 'value': (maker / nullif(n_role, 0))::DOUBLE, 'reason': 'no_role'}, {'feature': 'taker_fill_share', 'value': taker / nullif(n_role, 0), 'reason': 'no_role'}, {'feature': 'enrichment_coverage', 'value': n_role / nullif(n_trades, 0), 'reason': 'no_trades'},
   {'feature': 'merge_frequency', 'value': merges / nullif(days, 0), 'reason': 'no_days'}, {'feature': 'redeem_frequency', 'value': redeems / nullif(days, 0), 'reason': 'no_days'}, {'feature': 'episode_count', 'value': episodes, 'reason': 'no_episodes'},
   {'feature': 'episode_duration_p50', 'value': p50, 'reason': 'no_closed'}, {'feature': 'episode_duration_p90', 'value': p90, 'reason': 'no_closed'}, {'feature': 'micro_episode_share', 'value': micro / nullif(closed, 0), 'reason': 'no_closed'},
   {'feature': 'adds_per_episode', 'value': adds, 'reason': 'no_episodes'}, {'feature': 'partial_exit_frequency', 'value': exits, 'reason': 'no_episodes'}, {'feature': 'avg_position_size', 'value': avg_size + 1e-9, 'reason': 'no_episodes'}, {'feature': 'median_position_size', 'value': median_size, 'reason': 'no_episodes'},
   {'feature': 'market_category_concentration', 'value': hhi, 'reason': 'all_scope_only'}, {'feature': 'realized_pnl', 'value': pnl, 'reason': 'no_episodes'}, {'feature': 'reward_income_share', 'value': rewards / nullif(abs(pnl) + rewards, 0), 'reason': 'no_income'}]) AS x FROM wide))"""
_MORE = """
ed AS (SELECT wallet, coalesce(category, 'unclassified') AS category, day, round(q0 - q1, 4) + 0 AS dir, round(least(q0, q1), 4) + 0 AS bond FROM exposure x JOIN (SELECT DISTINCT condition_id FROM tokens) USING (condition_id) LEFT JOIN markets USING (condition_id)),
more AS (SELECT wallet, scope, 'bond_inventory_ratio' AS feature, avg(b / s) AS value FROM (SELECT wallet, scope, day, sum(abs(bond)) AS b, sum(abs(bond) + abs(dir)) AS s FROM (SELECT *, unnest(['all', 'category:' || category]) AS scope FROM ed) GROUP BY 1, 2, 3) WHERE s > 0 GROUP BY 1, 2
   UNION ALL SELECT wallet, scope, 'calibration_edge', avg(res_price - (least(floor(price * 10), 9) + 0.5) / 10) + 0.5 FROM (SELECT *, unnest(['all', 'category:' || category]) AS scope FROM trades JOIN prices USING (token_id) WHERE side = 'BUY') GROUP BY 1, 2)"""
_SIGNALS = "signals(detector, feature, weight, half) AS (VALUES " + ", ".join(f"('{d}', '{f}', {w}::DOUBLE, {'NULL' if h is None else h}::DOUBLE)" for d, f, w, h in SIGNALS) + ")"
_SPLIT = """
sp AS (SELECT *, CASE WHEN r < floor(n * 0.6) THEN 'train' WHEN r < floor(n * 0.8) THEN 'validation' ELSE 'test' END AS split FROM (SELECT *, row_number() OVER (ORDER BY trade_ts, id) - 1 AS r, count(*) OVER () AS n FROM dataset))"""
_GRID = """
grid AS (SELECT s AS min_spread, a AS max_age, h AS need_inside FROM (VALUES (100), (400), (900)) x(s), (VALUES (600), (3600), (14400)) y(a), (VALUES (0), (1)) z(h)),
m1 AS (SELECT min_spread, max_age, need_inside, split, count(*) AS n, count(*) FILTER (f) AS n_fired, count(*) FILTER (f AND markout_1h > 0) AS n_up, count(*) FILTER (markout_1h > 0) AS n_up_all, avg(markout_1h) FILTER (f) AS markout, max(abs(qty_before)) FILTER (f) AS max_inventory
   FROM (SELECT *, coalesce(spread_bps >= min_spread AND book_before_age_s <= max_age AND (need_inside = 0 OR inside), false) AS f FROM sp, grid) GROUP BY 1, 2, 3, 4),
metrics AS (SELECT *, n_up / nullif(n_fired, 0) AS p, n_up / nullif(n_up_all, 0) AS x, coalesce(n_up / nullif(n_fired, 0) * (n_up / nullif(n_up_all, 0)), 0) AS score FROM m1)"""
_DS = (POSITIONS, M._BOOKS, M._DATASET)

ORACLE = {
    "fee_estimates": sql("SELECT id, category, rate, fee FROM fee", _FEES),
    "fee_attribution": sql(f"""SELECT (ts - {D}) // 604800 AS week, category, count(*) AS n, round(sum(fee), 4) + 0 AS fees, round(sum(CASE WHEN role = 'maker' THEN fee ELSE 0 END), 4) + 0 AS maker_fees, round(sum(CASE WHEN role = 'taker' THEN fee ELSE 0 END), 4) + 0 AS taker_fees,
count(*) FILTER (role IS NULL) AS n_unknown, round(sum(notional), 4) + 0 AS notional FROM fee GROUP BY 1, 2""", _FEES),
    "fee_coverage": sql("SELECT count(*) AS n, count(fee) AS n_fee, count(role) AS n_role, count(*) FILTER (fee > 0) AS n_charged FROM fee", _FEES),
    "enrichment_match": sql("SELECT fill_id, hits, event_id, status FROM matched", _ENRICH),
    "enrichment_watermark": sql("""SELECT t.wallet, head_ts, count(*) AS n, count(*) FILTER (NOT late AND found) AS n_enriched, count(*) FILTER (late) AS n_pending, count(*) FILTER (NOT late AND NOT found) AS n_missing
FROM (SELECT l.wallet, head_ts, l.ts > coalesce(head_ts, 0) AS late, l.id IN (SELECT event_id FROM matched WHERE status = 'matched') AS found FROM ledger l LEFT JOIN (SELECT wallet, max(fill_ts) AS head_ts FROM chain WHERE fill_ts < 1706400000 GROUP BY 1) USING (wallet) WHERE event_type = 'TRADE') t GROUP BY 1, 2""", _ENRICH),
    "enrichment_resolution": sql("""SELECT CASE WHEN n_roles = 1 THEN role ELSE 'ambiguous' END AS role, 'a_logs' AS source, count(*) AS n FROM (SELECT id, count(DISTINCT role) AS n_roles, min(role) AS role FROM
(SELECT id, coalesce(role, 'ambiguous') AS role FROM trades UNION ALL SELECT id, CASE WHEN id % 11 = 0 THEN 'taker' ELSE coalesce(role, 'ambiguous') END FROM trades) GROUP BY id) GROUP BY 1""", _FEES),
    "enrichment_coverage": sql(f"SELECT wallet, CASE WHEN ({D + 2592000} - ts) // 86400 < 2 THEN 'pending' WHEN ({D + 2592000} - ts) // 86400 < 7 THEN 'recent' WHEN ({D + 2592000} - ts) // 86400 < 15 THEN 'mid' ELSE 'old' END AS recency, count(*) AS n, count(role) AS n_enriched, round(count(role) / count(*), 4) AS coverage FROM trades GROUP BY 1, 2", _FEES),
    "reconciliation_facts": sql("SELECT * FROM facts", POSITIONS, A._LAST, A._PRICES, _FACTS),
    "wallet_trust": sql("SELECT wallet, nf AS n_fail, nw AS n_warn, CASE WHEN nf > 4 THEN 'untrusted' WHEN nf + nw > 4 THEN 'caution' ELSE 'trusted' END AS trust FROM (SELECT wallet, count(*) FILTER (status = 'fail') AS nf, count(*) FILTER (status = 'warn') AS nw FROM facts GROUP BY 1)", POSITIONS, A._LAST, A._PRICES, _FACTS),
    "fingerprint_features": sql("SELECT * FROM features", POSITIONS, A._EPISODES, _FEES, _FINGER),
    "fingerprint_daily_features": "WITH eq AS (" + A.ORACLE["daily_equity"] + "), ex AS (" + A.ORACLE["exposures_daily"] + "), ep AS (" + sql("SELECT wallet, median(closed_ts - open_ts) AS t FROM episodes JOIN prices USING (token_id) WHERE open_ts <= closed_ts GROUP BY 1", POSITIONS, A._EPISODES, A._PRICES) + """)
SELECT wallet, round(ratio + 1e-9, 4) + 0 AS bond_inventory_ratio, round(u, 4) + 0 AS unrealized_pnl, round(st + 1e-9, 4) + 0 AS stale_mark_share, round(t, 4) + 0 AS time_to_close_s
FROM (SELECT wallet, arg_max(unrealized, day) AS u, avg(stale_share) AS st FROM eq GROUP BY 1) LEFT JOIN (SELECT wallet, avg(b / s) AS ratio FROM (SELECT wallet, day, sum(abs(bond)) AS b, sum(abs(bond) + abs(directional)) AS s FROM ex GROUP BY 1, 2) WHERE s > 0 GROUP BY 1) USING (wallet) LEFT JOIN ep USING (wallet)""",
    "entry_price_distribution": sql("SELECT wallet, least(floor(price * 10), 9)::BIGINT AS decile, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY wallet), 4) AS share FROM ledger WHERE side = 'BUY' GROUP BY 1, 2"),
    "resolution_calibration": sql("SELECT decile, count(*) AS n, round(avg(res_price), 4) AS win_rate, (decile + 0.5) / 10 AS implied, round(avg(res_price) - (decile + 0.5) / 10, 4) + 0 AS edge FROM (SELECT least(floor(price * 10), 9)::BIGINT AS decile, res_price FROM ledger JOIN prices USING (token_id) WHERE side = 'BUY') GROUP BY 1", A._PRICES).replace("(decile + 0.5) / 10", "(decile + 0.5::DOUBLE) / 10"),
    "detector_scores": sql("""SELECT wallet, scope, detector, round(s / nullif(w, 0), 4) AS score, round(w / a, 4) AS confidence, n_signals FROM (SELECT wallet, scope, detector, sum(CASE WHEN value IS NOT NULL THEN greatest(0, least(1, CASE WHEN half IS NOT NULL THEN value / (value + half) ELSE value END)) * weight ELSE 0 END) AS s,
sum(CASE WHEN value IS NOT NULL THEN weight ELSE 0 END) AS w, sum(weight) AS a, count(value) AS n_signals FROM (SELECT wallet, scope, feature, value FROM features UNION ALL
SELECT wallet, scope, feature, value FROM (SELECT wallet, scope, n.feature FROM features, (VALUES ('bond_inventory_ratio'), ('calibration_edge')) n(feature) WHERE features.feature = 'episode_count') LEFT JOIN more USING (wallet, scope, feature)) JOIN signals USING (feature) GROUP BY 1, 2, 3)""", POSITIONS, A._EPISODES, _FEES, _FINGER, A._PRICES, A._DAILY, A._EXPOSURE, _MORE, _SIGNALS),
    "rule_grid_metrics": sql("SELECT min_spread, max_age, need_inside, split, n, n_fired, round(n_fired / n, 4) AS coverage, round(p, 4) AS precision, round(x, 4) AS explained, round(markout, 4) + 0 AS avg_markout, round(max_inventory, 4) + 0 AS max_inventory FROM metrics", *_DS, _SPLIT, _GRID),
    "rule_promotion": sql("""SELECT t.min_spread, t.max_age, t.need_inside, round(t.score, 4) AS train_score, round(v.markout, 4) + 0 AS validation_markout, round(e.markout, 4) + 0 AS test_markout, coalesce(v.markout > 0 AND e.markout > 0 AND e.n_fired > 0, false) AS promoted
FROM (SELECT * FROM metrics WHERE split = 'train' ORDER BY round(score, 8) DESC, min_spread, max_age, need_inside LIMIT 1) t JOIN metrics v ON (v.min_spread, v.max_age, v.need_inside, v.split) = (t.min_spread, t.max_age, t.need_inside, 'validation') JOIN metrics e ON (e.min_spread, e.max_age, e.need_inside, e.split) = (t.min_spread, t.max_age, t.need_inside, 'test')""", *_DS, _SPLIT, _GRID),
    "predicate_markouts": sql("SELECT rule, split, count(*) AS n, count(markout_1h) AS n_markout, round(avg(markout_1h), 4) + 0 AS avg_markout FROM (" + " UNION ALL ".join(
        f"SELECT '{k}' AS rule, split, markout_1h FROM sp WHERE {c}" for k, c in {
            "A_wide_spread": "spread_bps >= 500", "B_fresh_book": "book_before_age_s <= 900", "C_balances": "directional_before * CASE WHEN side = 'BUY' THEN -1 ELSE 1 END > 0",
            "D_has_pairs": "bond_before > 0", "E_cheap": "fill_price <= 0.2", "F_evening": "trade_hour >= 18", "G_inside": "inside"}.items()) + ") GROUP BY 1, 2", *_DS, _SPLIT),
    "watchlist": sql(f"""SELECT token_id, min(priority) AS priority, count(*) AS n_reasons FROM (SELECT token_id, 10 AS priority FROM ledger WHERE event_type = 'TRADE' AND ts >= {D + 29 * 86400} UNION ALL SELECT token_id, 20 FROM last WHERE qty > 1e-6
UNION ALL SELECT token_id, CASE WHEN regexp_matches(lower(question), 'o/u|over|under|spread|exact score|team to advance|quarterfinal|semifinal|final') THEN 40 ELSE 30 END FROM tokens JOIN markets USING (condition_id) WHERE lower(question) LIKE '%world cup%') WHERE token_id NOT IN (SELECT token_id FROM prices WHERE closed_ts < {D + 21 * 86400}) GROUP BY 1""", POSITIONS, A._LAST, A._PRICES),
    "sync_alerts": f"""WITH e AS (SELECT 'w' || (user_id % 10) AS wallet, floor(epoch(ts))::BIGINT AS ts, event_id, event_type = 'error' AS failed FROM events),
ok AS (SELECT wallet, max((ts, event_id)) AS k FROM e WHERE NOT failed GROUP BY 1), g AS (SELECT e.wallet, max(k[1]) AS last_success, count(*) FILTER (failed AND (k IS NULL OR (ts, event_id) > k)) AS n_failures FROM e LEFT JOIN ok USING (wallet) GROUP BY 1)
SELECT wallet, 'wallet_new' AS alert, 'info' AS severity, last_success, n_failures FROM g WHERE last_success IS NULL UNION ALL SELECT wallet, 'sync_stale', 'warning', last_success, n_failures FROM g WHERE {D + 2592000} - last_success > 7200
UNION ALL SELECT wallet, 'sync_failing', 'error', last_success, n_failures FROM g WHERE last_success IS NOT NULL AND n_failures >= 3""",
    "wallet_alerts": sql(f"SELECT wallet, n, s AS silence_s, CASE WHEN s > 7200 THEN 'stale' WHEN s > 3600 THEN 'late' ELSE 'ok' END AS state FROM (SELECT wallet, count(*) AS n, {D + 2592000} - max(ts) AS s FROM ledger GROUP BY 1)"),
    "closed_cycle_score": sql("SELECT wallet, count(*) AS n, count(o) AS n_open, round(1 - count(o) / count(*), 4) + 0 AS score FROM (SELECT DISTINCT wallet, condition_id FROM ledger WHERE event_type = 'TRADE') LEFT JOIN (SELECT DISTINCT wallet, condition_id, 1 AS o FROM last WHERE qty > 1e-6) USING (wallet, condition_id) GROUP BY 1", POSITIONS, A._LAST),
    "lifecycle_rollup": sql("SELECT coalesce(event_id, '-') AS event_id, CASE WHEN question IS NULL THEN 'unknown' WHEN abs(qty) <= 1e-6 THEN 'closed_complete' WHEN closed THEN 'pending' ELSE 'live' END AS state, count(*) AS n, count(DISTINCT wallet) AS n_wallets FROM last LEFT JOIN markets USING (condition_id) GROUP BY 1, 2", POSITIONS, A._LAST),
    "wallets_in_both": sql("SELECT wallet, condition_id FROM ledger WHERE side = 'BUY' AND outcome_index = 0 INTERSECT SELECT wallet, condition_id FROM ledger WHERE side = 'BUY' AND outcome_index = 1 EXCEPT SELECT wallet, condition_id FROM ledger WHERE event_type = 'REDEEM' AND ts // 86400 % 2 = 1"),
    "ledger_page": sql("SELECT id, ts, event_type, side, token_id FROM ledger WHERE wallet = 'w1' ORDER BY ts DESC, id DESC LIMIT 25 OFFSET 50"),
    "token_cooccurrence": sql("""SELECT token_id, count(*) AS degree, sum(n)::BIGINT AS weighted_degree FROM (SELECT unnest([a, b]) AS token_id, n FROM (SELECT x.token_id AS a, y.token_id AS b, count(*) AS n FROM h x JOIN h y ON x.wallet = y.wallet AND x.hour = y.hour AND x.token_id < y.token_id GROUP BY 1, 2 HAVING count(*) >= 3)) GROUP BY 1""", "h AS (SELECT DISTINCT wallet, ts // 3600 AS hour, token_id FROM ledger WHERE event_type = 'TRADE')"),
    "activity_pivot": sql("SELECT wallet, ts % 86400 // 3600 AS hour, count(*) FILTER (side = 'BUY') AS buys, count(*) FILTER (side = 'SELL') AS sells FROM ledger WHERE event_type = 'TRADE' GROUP BY 1, 2"),
    "activity_rank_correlation": sql("""SELECT wallet, count(*) AS n_days, round(corr(a, b), 4) + 0 AS rho FROM (SELECT wallet, rank() OVER (PARTITION BY wallet ORDER BY n) + (count(*) OVER (PARTITION BY wallet, n) - 1) / 2 AS a, rank() OVER (PARTITION BY wallet ORDER BY total) + (count(*) OVER (PARTITION BY wallet, total) - 1) / 2 AS b
FROM (SELECT w.wallet, d.total, coalesce(o.n, 0) AS n FROM (SELECT DISTINCT wallet FROM tr) w CROSS JOIN (SELECT day, count(*) AS total FROM tr GROUP BY 1) d LEFT JOIN (SELECT wallet, day, count(*) AS n FROM tr GROUP BY 1, 2) o ON o.wallet = w.wallet AND o.day = d.day)) GROUP BY 1""", "tr AS (SELECT wallet, ts // 86400 AS day FROM ledger WHERE event_type = 'TRADE')"),
    "rolling_fill_means": sql("SELECT id, round(CASE WHEN count(*) OVER l = 20 THEN avg(price) OVER l END, 4) AS mean_20, round(sum(size * price) OVER (PARTITION BY wallet ORDER BY ts, id ROWS UNBOUNDED PRECEDING), 4) AS cum_notional FROM ledger WHERE event_type = 'TRADE' WINDOW l AS (PARTITION BY wallet ORDER BY ts, id ROWS 19 PRECEDING)"),
    "equity_week_change": "WITH eq AS (" + A.ORACLE["daily_equity"] + ") SELECT wallet, day, round(marked_pnl - last_value(marked_pnl) OVER (PARTITION BY wallet ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 7 PRECEDING), 4) + 0 AS week_change FROM eq",
}
