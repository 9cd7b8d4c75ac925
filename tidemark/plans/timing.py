"""The order-timing dataset: for each fill when its order was made or first seen, and what the wallet held around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import bands
from tidemark.operators import ordered as O
from tidemark.operators.storage import stored
from tidemark.plans import accounting as A
from tidemark.plans import behaviour as B
from tidemark.plans import matching as M
from tidemark.plans.views import POSITIONS, ledger, markets, r4, sql, tokens
from tidemark.sources import sinks

TICKS = 10_000
DUST = 1e-6
#: Tables that may hold order times, in the order in which they are asked, and the names that their columns go by. Fixed values.
ORDER_TABLES = ("order_timing", "orders", "clob_orders")
CREATED, CANCELLED = ("order_created_ts", "created_ts", "created_at_ts"), ("order_cancelled_ts", "cancelled_ts")
ON_CHAIN = ("rpc", "onchain", "polygonscan")


def exact_order_times(tables: dict[str, DataFrame | None]) -> DataFrame | None:
    """``order_hash`` (lower case), ``order_created_ts, order_cancelled_ts, order_time_confidence`` from those of the ``ORDER_TABLES`` that exist.

    A table counts if it has an order hash and a time of creation under one of their names. The first table that has a time for
    an order wins, and in it the earliest time. None if no table counts.
    """
    found = None
    for place, name in enumerate(ORDER_TABLES):
        t = tables.get(name)
        created = t is not None and next((c for c in CREATED if c in t.columns), None)
        if not created or "order_hash" not in t.columns:
            continue
        cancelled = next((c for c in CANCELLED if c in t.columns), None)
        source = F.lower(F.col("source").cast("string")) if "source" in t.columns else F.lit("")
        one = t.select(
            F.lower("order_hash").alias("order_hash"), F.lit(place).alias("place"), F.col(created).cast("long").alias("created"),
            (F.col(cancelled) if cancelled else F.lit(None)).cast("long").alias("cancelled"), F.coalesce(source, F.lit("")).isin(*ON_CHAIN).alias("on_chain"),
        ).where("order_hash is not null and created is not null")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return None
    best = found.groupBy("order_hash").agg(F.min(F.struct("place", "created", F.coalesce("cancelled", F.lit(2**62)).alias("c"), "cancelled", "on_chain")).alias("b"))
    confidence = F.when(F.col("b.on_chain"), "exact_onchain").otherwise("exact_subgraph")
    return best.select("order_hash", F.col("b.created").alias("order_created_ts"), F.col("b.cancelled").alias("order_cancelled_ts"), confidence.alias("order_time_confidence"))


def catalog_order_tables(spark) -> dict[str, DataFrame | None]:
    """Those of the ``ORDER_TABLES`` that the session's catalog has."""
    return {name: spark.table(name) for name in ORDER_TABLES if spark.catalog.tableExists(name)}


def order_timing_of(fills: DataFrame, levels: DataFrame, orders: DataFrame | None, lookback: int = 7200, tolerance_bps: float = 5) -> DataFrame:
    """``id`` of each fill with its order's times and how sure they are.

    ``fills``: ``id, order_hash, token_id, side, role, ts, price``. ``levels``: quoted prices, ``token_id, side`` (BUY for bids), ``ts, price``. An order
    with an exact time (``orders``) has that; else a maker's order may have been seen in the books of the ``lookback`` seconds before: a level
    of the fill's side within ``tolerance_bps`` of its price. Prices count in ticks of a ten-thousandth.
    """
    tick = F.round(F.col("price") * TICKS)
    wide = tick * (tolerance_bps / 10_000)
    asks = fills.where("lower(role) = 'maker' and price > 0").select("id", "token_id", "side", "ts", F.ceil(tick - wide - 1e-6).alias("low"), F.floor(tick + wide + 1e-6).alias("high"))
    seen = bands.seen_within(asks, levels.select("token_id", "side", "ts", tick.cast("long").alias("tick")), ["token_id", "side"], lookback)
    f = fills.select("id", F.lower("order_hash").alias("order_hash"), "ts")
    if orders is None:
        none = {"order_created_ts": "long", "order_cancelled_ts": "long", "order_time_confidence": "string"}
        f = f.withColumns({c: F.lit(None).cast(t) for c, t in none.items()})
    else:
        f = f.join(orders, "order_hash", "left")
    f = f.join(seen, "id", "left")
    exact, ts = F.col("order_created_ts").isNotNull(), F.col("ts")
    first, last = (F.when(~exact, F.col(c)) for c in ("first_seen_ts", "last_seen_ts"))
    lifetime = F.when(exact, F.coalesce("order_cancelled_ts", "ts") - F.col("order_created_ts")).otherwise(ts - first)
    confidence = F.when(exact, F.col("order_time_confidence")).when(first.isNotNull(), "estimated_book_seen").otherwise("fill_only_unknown")
    return f.select(
        "id", "order_created_ts", first.alias("order_first_seen_book_ts"), last.alias("order_last_seen_book_ts"), "order_cancelled_ts", lifetime.alias("order_lifetime_s"),
        (ts - F.col("order_created_ts")).alias("fill_after_created_s"), (ts - first).alias("fill_after_first_seen_s"), confidence.alias("order_time_confidence"),
    )


def timed_fills(spark, sf_dir) -> DataFrame:
    f = B.trades(spark, sf_dir).where("not (side = 'BUY' and id % 3 = 0)")
    return f.withColumn("order_hash", F.when(F.col("id") % 4 != 3, F.concat(F.lit("0xab"), F.col("id"))))


def known_orders(spark, sf_dir) -> dict[str, DataFrame | None]:
    """Two of the optional order tables, as the ledger's ids and times give them: one with all columns, one with few."""
    t = ledger(spark, sf_dir).where("event_type = 'TRADE'")
    i, ts = F.col("id"), F.col("ts")
    name = F.concat(F.lit("0xAB"), i).alias("order_hash")
    orders = t.where("id % 5 = 0").select(name, (ts - i % 900).alias("created_ts"), F.when(i % 10 == 0, ts + 60).alias("cancelled_ts"), F.when(i % 15 == 0, "RPC").otherwise("graph").alias("source"))
    clob = t.where("id % 7 = 0").select(name, F.explode(F.array(ts - i % 400 - 1, F.when(i % 14 == 0, ts - 1000))).alias("created_at_ts"))
    return {"orders": orders, "clob_orders": clob}


def book_levels(spark, sf_dir) -> DataFrame:
    """Every price that the polled books quote: two bids and two asks."""
    b = M.books(spark, sf_dir)
    quoted = [("BUY", F.col("best_bid")), ("BUY", F.round(F.col("best_bid") - 0.01, 4)), ("SELL", F.col("best_ask")), ("SELL", F.round(F.col("best_ask") + 0.01, 4))]
    return b.select("token_id", "ts", F.inline(F.array(*(F.struct(F.lit(s).alias("side"), p.alias("price")) for s, p in quoted))))


def _condition(q0: Column, q1: Column, c0: Column, c1: Column) -> dict[str, Column]:
    paired = F.greatest(F.least(q0, q1), F.lit(0.0))
    wac = [F.when(q > DUST, c / q + 1e-9) for q, c in ((q0, c0), (q1, c1))]
    return {
        "qty_yes": q0, "qty_no": q1, "cost_yes": c0, "cost_no": c1, "wac_yes": wac[0], "wac_no": wac[1], "paired_qty": paired, "unpaired_yes": F.greatest(q0 - paired, F.lit(0.0)),
        "unpaired_no": F.greatest(q1 - paired, F.lit(0.0)), "bond_cost": F.least(c0, c1), "directional": q0 - q1,
    }


EVENT = ("total_cost", "total_qty", "bond_qty", "unpaired_inventory", "exposure", "market_count_active")


def _event(q0: Column, q1: Column, c0: Column, c1: Column) -> dict[str, Column]:
    s = _condition(q0, q1, c0, c1)
    values = (c0 + c1, q0 + q1, s["paired_qty"], s["unpaired_yes"] + s["unpaired_no"], F.abs(q0 - q1), F.when(F.abs(q0 + q1) > DUST, 1.0).otherwise(0.0))
    return dict(zip(EVENT, values))


def _around(spark, sf_dir) -> DataFrame:
    """State of the condition and the event of each trade before and after it, for conditions of two tokens."""
    t = tokens(spark)
    two = t.groupBy("condition_id").agg(F.count("*").alias("n")).where("n = 2").select("condition_id")
    p = A.leg_states(spark, sf_dir).where("leg is not null").join(two, "condition_id").join(markets(spark).select("condition_id", "event_id"), "condition_id", "left")
    own = Window.partitionBy("wallet", "condition_id").orderBy("ts", "id", "leg")
    names = ("q0", "q1", "c0", "c1")
    p = p.withColumns({f"p{c}": F.coalesce(F.lag(c).over(own), F.lit(0.0)) for c in names})
    now, was = [F.col(c) for c in names], [F.col(f"p{c}") for c in names]
    then = _event(*was)
    p = p.withColumns({f"_{k}": v - then[k] for k, v in _event(*now).items()})
    run = O.upto(["wallet", "event_id"], "ts", "id", "condition_id", "leg")
    p = p.withColumns({f"event_{k}_after": F.when(F.col("event_id").isNotNull(), F.sum(f"_{k}").over(run)).otherwise(0.0) for k in EVENT})
    p = p.withColumns({f"event_{k}_before": F.when(F.col("event_id").isNotNull(), F.col(f"event_{k}_after") - F.col(f"_{k}")).otherwise(0.0) for k in EVENT})
    state = {f"{k}_{w}": v for w, of in (("before", was), ("after", now)) for k, v in _condition(*of).items()}
    return p.where("event_type = 'TRADE'").select("id", *(v.alias(k) for k, v in state.items()), *(f"event_{k}_{w}" for k in EVENT for w in ("before", "after")))


def _amount(c, name: str) -> Column:
    """Rounded to four places; a little more keeps sums that are ties in the last digit from falling either way."""
    return r4((F.col(c) if isinstance(c, str) else c) + 1e-9, name)


def starts(spark) -> DataFrame:
    """When the markets' events begin, where that is known."""
    c = F.regexp_extract("condition_id", "[0-9]+", 0).cast("long")
    return markets(spark).select("condition_id", "question", "closed_ts", F.when(c % 3 != 2, 1704067200 + c * 86400).alias("start_ts"))


def phase(ts: Column, start: Column, end: Column) -> Column:
    progress = (ts - start) / (end - start)
    live = F.when(end <= start, "early_live").when(progress < 0.35, "early_live").when(progress.between(0.45, 0.60), "halftime_or_pause").otherwise("late_live")
    return F.when(start.isNull(), "unknown").when(ts < start, "pregame").when(ts > end, "post_event").otherwise(F.when(end.isNull(), "early_live").otherwise(live))


def order_timing_dataset(spark, sf_dir, valued: bool = True):
    """One row for each fill: its order's times, both legs and the event around it, what the legs were worth, and the phase of the event.
    Not ``valued``, what the legs were worth is not looked up: market values are null, and ``null_reasons`` says so."""
    f = stored(timed_fills(spark, sf_dir))
    timing = order_timing_of(f, book_levels(spark, sf_dir), exact_order_times(known_orders(spark, sf_dir)), tolerance_bps=200)
    t = tokens(spark)
    two = t.groupBy("condition_id").agg(F.count("*").alias("n"), F.min_by("token_id", "outcome_index").alias("yes_token_id"), F.max_by("token_id", "outcome_index").alias("no_token_id")).where("n = 2").drop("n")
    out = f.join(timing, "id").join(two, "condition_id", "left")
    if valued:
        asked = f.select("id", "condition_id", "ts").join(two, "condition_id")
        asked = asked.select("id", "ts", F.inline(F.array(*(F.struct(F.lit(s).alias("leg"), F.col(f"{s}_token_id").alias("token_id")) for s in ("yes", "no")))))
        mids = O.asof_backward(asked, M.books(spark, sf_dir), ["token_id"], ["mid"]).groupBy("id").pivot("leg", ["yes", "no"]).agg(F.first("mid"))
        mids = mids.select("id", F.col("yes").alias("mid_yes"), F.col("no").alias("mid_no"))
        out = out.join(mids, "id", "left")
    else:
        out = out.withColumns({f"mid_{s}": F.lit(None).cast("double") for s in ("yes", "no")})
    out = out.join(_around(spark, sf_dir), "id", "left").join(starts(spark), "condition_id", "left")
    pair = F.col("yes_token_id").isNotNull()
    zero = [c for c in out.columns if c.endswith(("_before", "_after")) and not c.startswith("wac_")]
    out = out.fillna(0.0, zero)
    value = {f"market_value_{s}_{w}": F.col(f"qty_{s}_{w}") * F.col(f"mid_{s}") for s in ("yes", "no") for w in ("before", "after")}
    unpaired = {w: F.col(f"unpaired_yes_{w}") + F.col(f"unpaired_no_{w}") for w in ("before", "after")}
    ts, start = F.col("ts"), F.col("start_ts")
    sure = F.col("order_time_confidence")
    reasons = F.concat_ws(
        ",", F.when(~pair, "binary_pair"), F.when(F.col("directional_after").isNull() | ~pair, "inventory"), F.when(pair & (F.col("mid_yes").isNull() | F.col("mid_no").isNull()), "market_value"),
        F.when(sure == "fill_only_unknown", "order_timing:none").when(sure == "estimated_book_seen", "order_timing:book_seen"),
    )
    at = F.timestamp_seconds
    utc = {f"{c}_utc": F.date_format(at(F.col(f"{c}_ts")), "yyyy-MM-dd HH:mm:ss") for c in ("order_created", "order_first_seen_book", "order_last_seen_book")}
    states = [f"{k}_{w}" for k in _condition(*[F.lit(0.0)] * 4) for w in ("before", "after")]
    events = [f"event_{k}_{w}" for k in EVENT[:-1] for w in ("before", "after")]
    return out.select(
        "id", "wallet", "tx_hash", "event_id", "condition_id", "question", F.col("category").alias("market_family"), "token_id", "outcome_index", "side", "role", "order_hash",
        ts.alias("fill_ts"), F.date_format(at(ts), "yyyy-MM-dd HH:mm:ss").alias("fill_utc"), F.col("price").alias("fill_price"), r4("size", "fill_size"), r4(F.col("size") * F.col("price"), "fill_notional_usdc"),
        *(c for c in timing.columns if c != "id"), *(v.alias(k) for k, v in utc.items()), "yes_token_id", "no_token_id", *(_amount(c, c) for c in states), *(_amount(v, k) for k, v in value.items()),
        _amount(F.col("paired_qty_after") - F.col("paired_qty_before"), "bond_delta"), _amount(unpaired["after"] - unpaired["before"], "unpaired_delta"), _amount(F.col("directional_after") - F.col("directional_before"), "directional_delta"),
        *(_amount(c, c) for c in events), *(_amount(f"event_total_cost_{w}", f"event_capital_used_{w}") for w in ("before", "after")), *(F.round(f"event_market_count_active_{w}").cast("long").alias(f"event_market_count_active_{w}") for w in ("before", "after")),
        phase(ts, start, F.col("closed_ts")).alias("event_phase"), (start - ts).alias("time_to_start_s"), (ts - start).alias("time_since_start_s"),
        F.when(pair, F.when(F.col("token_id") == F.col("yes_token_id"), "YES").otherwise("NO")).alias("fill_token_side"), F.lit("post_fill_diagnostic").alias("feature_availability"), reasons.alias("null_reasons"),
    )


def order_time_coverage(spark, sf_dir):
    """Fills by how their order's time is known, with mean and longest life of the orders."""
    f = timed_fills(spark, sf_dir)
    t = order_timing_of(f, book_levels(spark, sf_dir), exact_order_times(known_orders(spark, sf_dir)), tolerance_bps=200).join(f.select("id", "role"), "id")
    return t.groupBy("order_time_confidence", "role").agg(F.count("*").alias("n"), r4(F.avg("order_lifetime_s"), "mean_lifetime_s"), F.max("order_lifetime_s").alias("longest_s"))


def merge_timing(spark, sf_dir, gap: int = 5):
    """Each merge of a market of two tokens: the wait since the wallet's last fill there and since the last one that completed sets, the
    pairs around it, and its batch: merges of a wallet and event with pauses of at most ``gap`` seconds, if there is more than one."""
    keys = ["wallet", "condition_id"]
    d = stored(order_timing_dataset(spark, sf_dir).select("id", *keys, F.col("fill_ts").alias("ts"), "bond_delta"))
    two = tokens(spark).groupBy("condition_id").agg(F.count("*").alias("n")).where("n = 2").select("condition_id")
    m = ledger(spark, sf_dir).where("event_type = 'MERGE'").join(two, "condition_id").join(markets(spark).select("condition_id", "event_id", "question"), "condition_id", "left")
    m = stored(m.select("id", "ts", *keys, "event_id", "question", "size", F.abs("delta_usdc").alias("released")))
    last = O.asof_backward(m.select("id", *keys, "ts"), d, keys, []).select("id", F.col("asof_ts").alias("last_fill"))
    made = O.asof_backward(m.select("id", *keys, "ts"), d.where(F.col("bond_delta") > DUST), keys, []).select("id", F.col("asof_ts").alias("last_complement"))
    p = A.leg_states(spark, sf_dir).where("leg is not null").join(two, "condition_id")
    own = Window.partitionBy(*keys).orderBy("ts", "id", "leg")
    p = p.withColumns({f"p{c}": F.coalesce(F.lag(c).over(own), F.lit(0.0)) for c in ("q0", "q1")}).where("event_type = 'MERGE'")
    p = p.groupBy("id").agg(F.min_by(F.struct("pq0", "pq1"), "leg").alias("b"), F.max_by(F.struct("q0", "q1"), "leg").alias("a"))
    before, after = (_condition(q0, q1, F.lit(0.0), F.lit(0.0)) for q0, q1 in ((F.col("b.pq0"), F.col("b.pq1")), (F.col("a.q0"), F.col("a.q1"))))
    s = O.sessions(m, ["wallet", "event_id"], gap).withColumn("_n", F.count("*").over(Window.partitionBy("wallet", "event_id", "session")))
    batch = F.when(F.col("_n") > 1, F.concat_ws("/", "wallet", "event_id", F.col("session").cast("string")))
    out = s.join(last, "id", "left").join(made, "id", "left").join(p, "id", "left")
    return out.select(
        "id", *keys, "event_id", "question", F.col("ts").alias("merge_ts"), r4("size", "merge_qty"), r4("released", "capital_released"), (F.col("ts") - F.col("last_fill")).alias("time_from_last_fill_s"),
        (F.col("ts") - F.col("last_complement")).alias("time_from_last_complement_fill_s"), *(r4(before[k], f"{k}_before_merge") for k in ("paired_qty", "unpaired_yes", "unpaired_no")),
        r4(after["paired_qty"], "paired_qty_after_merge"), batch.alias("merge_batch_id"),
    )


def inventory_timeline(spark, sf_dir):
    """What a wallet held of both tokens of a market and of its event before and after each fill."""
    d = order_timing_dataset(spark, sf_dir)
    return d.select("id", "wallet", "event_id", "condition_id", "fill_ts", "fill_utc", "side", "fill_token_side", *(c for c in d.columns if c.endswith(("_before", "_after", "_delta"))))


def pattern_summary(spark, sf_dir):
    """Answers of the pattern reports for each wallet: what its buys do to its inventory, and how soon sets are made and merged."""
    d = order_timing_dataset(spark, sf_dir)
    buy = F.col("side") == "BUY"

    def share(cond: Column) -> Column:
        return F.round(F.try_divide(F.count_if(buy & cond), F.nullif(F.count_if(buy), F.lit(0))) * 100, 4)

    wait = F.coalesce("fill_after_created_s", "fill_after_first_seen_s")
    g = d.groupBy("wallet").agg(
        F.count("*").alias("n_fills"), F.count_if(buy).alias("n_buys"), share(F.col("bond_delta") > 0).alias("pct_increases_bond"), share(F.col("unpaired_delta") < 0).alias("pct_reduces_unpaired"),
        share(F.col("unpaired_delta") > 0).alias("pct_increases_unpaired"), (F.round(F.median(wait), 6) + 0.0).alias("median_wait_s"), F.count_if(F.col("order_time_confidence") == "fill_only_unknown").alias("n_unknown_times"),
    )
    since = F.col("time_from_last_complement_fill_s")
    m = merge_timing(spark, sf_dir).groupBy("wallet").agg(
        F.count("*").alias("n_merges"), r4(F.sum("capital_released"), "capital_released"), F.count_if(since <= 60).alias("n_merged_within_60s"), F.count("merge_batch_id").alias("n_in_batches")
    )
    return g.join(m, "wallet", "left")


def pattern_bundle(spark, sf_dir, path: str, fmt: str = "csv") -> list[str]:
    """Write the seven pattern reports below ``path``; their folders."""
    reports = {
        "order_timing_dataset": order_timing_dataset, "condition_inventory_timeline": inventory_timeline, "pair_completion_report": M.pair_completion, "merge_timing_report": merge_timing,
        "sibling_market_sequence_report": M.sibling_sequences, "unpaired_inventory_duration_report": M.unpaired_periods, "pattern_summary": pattern_summary,
    }
    return sinks.export_bundle({name: report(spark, sf_dir) for name, report in reports.items()}, path, fmt)


QUERIES = {f.__name__: f for f in (order_timing_dataset, order_time_coverage, merge_timing, inventory_timeline, pattern_summary)}

_TIMES = """
tf AS (SELECT *, CASE WHEN id % 4 <> 3 THEN '0xab' || id END AS order_hash FROM trades WHERE NOT (side = 'BUY' AND id % 3 = 0)),
lv AS (SELECT token_id, ts, unnest(['BUY', 'BUY', 'SELL', 'SELL']) AS side, unnest([best_bid, round(best_bid - 0.01, 4), best_ask, round(best_ask + 0.01, 4)]) AS price FROM books),
ot AS (SELECT '0xab' || id AS order_hash, 1 AS place, ts - id % 900 AS created, CASE WHEN id % 10 = 0 THEN ts + 60 END AS cancelled, id % 15 = 0 AS chain FROM ledger WHERE event_type = 'TRADE' AND id % 5 = 0
  UNION ALL SELECT '0xab' || id, 2, ts - id % 400 - 1, NULL, false FROM ledger WHERE event_type = 'TRADE' AND id % 7 = 0 UNION ALL SELECT '0xab' || id, 2, ts - 1000, NULL, false FROM ledger WHERE event_type = 'TRADE' AND id % 14 = 0),
o1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY order_hash ORDER BY place, created) AS rn FROM ot) WHERE rn = 1),
sn AS (SELECT f.id, min(l.ts) AS first_ts, max(l.ts) AS last_ts FROM tf f JOIN lv l ON f.token_id = l.token_id AND f.side = l.side AND f.role = 'maker' AND l.ts BETWEEN f.ts - 7200 AND f.ts AND abs(l.price - f.price) <= f.price * 0.02 + 1e-9 GROUP BY 1),
tm AS (SELECT f.*, created AS order_created_ts, cancelled AS order_cancelled_ts, CASE WHEN created IS NULL THEN first_ts END AS order_first_seen_book_ts, CASE WHEN created IS NULL THEN last_ts END AS order_last_seen_book_ts,
   CASE WHEN created IS NOT NULL THEN coalesce(cancelled, ts) - created ELSE ts - first_ts END AS order_lifetime_s, ts - created AS fill_after_created_s, CASE WHEN created IS NULL THEN ts - first_ts END AS fill_after_first_seen_s,
   CASE WHEN created IS NOT NULL THEN CASE WHEN chain THEN 'exact_onchain' ELSE 'exact_subgraph' END WHEN first_ts IS NOT NULL THEN 'estimated_book_seen' ELSE 'fill_only_unknown' END AS order_time_confidence
   FROM tf f LEFT JOIN o1 USING (order_hash) LEFT JOIN sn USING (id))"""

_CONDITION_SQL = {
    "qty_yes": "{0}", "qty_no": "{1}", "cost_yes": "{2}", "cost_no": "{3}", "wac_yes": "CASE WHEN {0} > 1e-6 THEN {2} / {0} + 1e-9 END", "wac_no": "CASE WHEN {1} > 1e-6 THEN {3} / {1} + 1e-9 END",
    "paired_qty": "greatest(least({0}, {1}), 0)", "unpaired_yes": "greatest({0} - greatest(least({0}, {1}), 0), 0)", "unpaired_no": "greatest({1} - greatest(least({0}, {1}), 0), 0)", "bond_cost": "least({2}, {3})", "directional": "{0} - {1}",
}
_EVENT_SQL = dict(zip(EVENT, (
    "{2} + {3}", "{0} + {1}", _CONDITION_SQL["paired_qty"], f"{_CONDITION_SQL['unpaired_yes']} + {_CONDITION_SQL['unpaired_no']}", "abs({0} - {1})", "CASE WHEN abs({0} + {1}) > 1e-6 THEN 1 ELSE 0 END",
)))
_NOW, _WAS = ("q0", "q1", "c0", "c1"), ("pq0", "pq1", "pc0", "pc1")
_AROUND = f"""
two AS (SELECT condition_id, arg_min(token_id, outcome_index) AS yes_token_id, arg_max(token_id, outcome_index) AS no_token_id FROM tokens GROUP BY 1 HAVING count(*) = 2),
ar0 AS (SELECT l.*, m.event_id AS ev, {', '.join(f'coalesce(lag({c}) OVER o, 0) AS p{c}' for c in _NOW)} FROM legs l JOIN two USING (condition_id) LEFT JOIN markets m USING (condition_id) WHERE leg IS NOT NULL WINDOW o AS (PARTITION BY wallet, condition_id ORDER BY ts, id, leg)),
ar1 AS (SELECT *, {', '.join(f'({v.format(*_NOW)}) - ({v.format(*_WAS)}) AS d_{k}' for k, v in _EVENT_SQL.items())} FROM ar0),
ar2 AS (SELECT *, {', '.join(f'sum(d_{k}) OVER w AS s_{k}' for k in EVENT)} FROM ar1 WINDOW w AS (PARTITION BY wallet, ev ORDER BY ts, id, condition_id, leg ROWS UNBOUNDED PRECEDING)),
ar AS (SELECT id, {', '.join(f'{v.format(*of)} AS {k}_{w}' for w, of in (('before', _WAS), ('after', _NOW)) for k, v in _CONDITION_SQL.items())},
   {', '.join(f'CASE WHEN ev IS NOT NULL THEN s_{k} - d_{k} ELSE 0 END AS event_{k}_before, CASE WHEN ev IS NOT NULL THEN s_{k} ELSE 0 END AS event_{k}_after' for k in EVENT)} FROM ar2 WHERE event_type = 'TRADE'),
my AS (SELECT f.id, b.mid AS mid_yes FROM (SELECT * FROM tf JOIN two USING (condition_id)) f ASOF LEFT JOIN one_book b ON f.yes_token_id = b.token_id AND f.ts >= b.ts),
mn AS (SELECT f.id, b.mid AS mid_no FROM (SELECT * FROM tf JOIN two USING (condition_id)) f ASOF LEFT JOIN one_book b ON f.no_token_id = b.token_id AND f.ts >= b.ts),
sta AS (SELECT condition_id, question, closed_ts, CASE WHEN c % 3 <> 2 THEN 1704067200 + c * 86400 END AS start_ts FROM (SELECT *, substr(condition_id, 2)::BIGINT AS c FROM markets))"""


def _rounded(expr: str, name: str, zero: bool = True) -> str:
    return f"round({f'coalesce({expr}, 0)' if zero else expr} + 1e-9, 4) + 0 AS {name}"


_STATES = [_rounded(f"{k}_{w}", f"{k}_{w}", not k.startswith("wac")) for k in _CONDITION_SQL for w in ("before", "after")]
_VALUES = [_rounded(f"qty_{s}_{w} * mid_{s}", f"market_value_{s}_{w}", False) for s in ("yes", "no") for w in ("before", "after")]
_EVENTS = [_rounded(f"event_{k}_{w}", f"event_{k}_{w}") for k in EVENT[:-1] for w in ("before", "after")] + [_rounded(f"event_total_cost_{w}", f"event_capital_used_{w}") for w in ("before", "after")]
_EVENTS += [f"round(coalesce(event_market_count_active_{w}, 0))::BIGINT AS event_market_count_active_{w}" for w in ("before", "after")]
ORACLE = {
    "order_timing_dataset": sql(f"""SELECT tm.id, wallet, tx_hash, event_id, tm.condition_id, question, category AS market_family, token_id, outcome_index, side, role, order_hash, ts AS fill_ts, strftime(to_timestamp(ts) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS fill_utc, price AS fill_price, round(size, 4) + 0 AS fill_size, round(size * price, 4) + 0 AS fill_notional_usdc,
order_created_ts, order_first_seen_book_ts, order_last_seen_book_ts, order_cancelled_ts, order_lifetime_s, fill_after_created_s, fill_after_first_seen_s, order_time_confidence, {', '.join(f"strftime(to_timestamp({c}_ts) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS {c}_utc" for c in ('order_created', 'order_first_seen_book', 'order_last_seen_book'))},
yes_token_id, no_token_id, {', '.join(_STATES + _VALUES)}, {_rounded('paired_qty_after - paired_qty_before', 'bond_delta')}, {_rounded('unpaired_yes_after + unpaired_no_after - (unpaired_yes_before + unpaired_no_before)', 'unpaired_delta')}, {_rounded('directional_after - directional_before', 'directional_delta')}, {', '.join(_EVENTS)},
CASE WHEN start_ts IS NULL THEN 'unknown' WHEN ts < start_ts THEN 'pregame' WHEN ts > closed_ts THEN 'post_event' WHEN closed_ts <= start_ts THEN 'early_live' WHEN (ts - start_ts) / (closed_ts - start_ts) < 0.35 THEN 'early_live' WHEN (ts - start_ts) / (closed_ts - start_ts) BETWEEN 0.45 AND 0.60 THEN 'halftime_or_pause' ELSE 'late_live' END AS event_phase,
start_ts - ts AS time_to_start_s, ts - start_ts AS time_since_start_s, CASE WHEN token_id = yes_token_id THEN 'YES' WHEN yes_token_id IS NOT NULL THEN 'NO' END AS fill_token_side, 'post_fill_diagnostic' AS feature_availability,
concat_ws(',', CASE WHEN yes_token_id IS NULL THEN 'binary_pair' END, CASE WHEN yes_token_id IS NULL THEN 'inventory' END, CASE WHEN yes_token_id IS NOT NULL AND (mid_yes IS NULL OR mid_no IS NULL) THEN 'market_value' END, CASE WHEN order_time_confidence = 'fill_only_unknown' THEN 'order_timing:none' WHEN order_time_confidence = 'estimated_book_seen' THEN 'order_timing:book_seen' END) AS null_reasons
FROM tm LEFT JOIN two USING (condition_id) LEFT JOIN my USING (id) LEFT JOIN mn USING (id) LEFT JOIN ar USING (id) LEFT JOIN sta USING (condition_id)""", POSITIONS, B._FEES, M._BOOKS, A._LEGS, _TIMES, _AROUND),
    "order_time_coverage": sql("SELECT order_time_confidence, role, count(*) AS n, round(avg(order_lifetime_s), 4) + 0 AS mean_lifetime_s, max(order_lifetime_s) AS longest_s FROM tm GROUP BY 1, 2", B._FEES, M._BOOKS, _TIMES),
}
_MERGES = f"""
od AS ({ORACLE['order_timing_dataset']}),
mg AS (SELECT l.id, l.ts, l.wallet, l.condition_id, m.event_id, m.question, l.size, abs(l.delta_usdc) AS released FROM ledger l JOIN two USING (condition_id) LEFT JOIN markets m USING (condition_id) WHERE event_type = 'MERGE'),
lf AS (SELECT g.id, f.fill_ts AS last_fill FROM mg g ASOF LEFT JOIN (SELECT DISTINCT wallet, condition_id, fill_ts FROM od) f ON g.wallet = f.wallet AND g.condition_id = f.condition_id AND g.ts >= f.fill_ts),
lc AS (SELECT g.id, f.fill_ts AS last_complement FROM mg g ASOF LEFT JOIN (SELECT DISTINCT wallet, condition_id, fill_ts FROM od WHERE bond_delta > 1e-6) f ON g.wallet = f.wallet AND g.condition_id = f.condition_id AND g.ts >= f.fill_ts),
ms AS (SELECT id, arg_min(pq0, leg) AS b0, arg_min(pq1, leg) AS b1, arg_max(q0, leg) AS a0, arg_max(q1, leg) AS a1 FROM ar0 WHERE event_type = 'MERGE' GROUP BY 1),
mb AS (SELECT *, count(*) OVER (PARTITION BY wallet, event_id, session) AS n FROM (SELECT *, sum(s) OVER (PARTITION BY wallet, event_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY wallet, event_id ORDER BY ts, id) <= 5 THEN 0 ELSE 1 END AS s FROM mg))),
mt AS (SELECT id, wallet, condition_id, event_id, question, ts AS merge_ts, round(size, 4) + 0 AS merge_qty, round(released, 4) + 0 AS capital_released, ts - last_fill AS time_from_last_fill_s, ts - last_complement AS time_from_last_complement_fill_s,
  round(greatest(least(b0, b1), 0), 4) + 0 AS paired_qty_before_merge, round(greatest(b0 - greatest(least(b0, b1), 0), 0), 4) + 0 AS unpaired_yes_before_merge, round(greatest(b1 - greatest(least(b0, b1), 0), 0), 4) + 0 AS unpaired_no_before_merge,
  round(greatest(least(a0, a1), 0), 4) + 0 AS paired_qty_after_merge, CASE WHEN n > 1 THEN concat_ws('/', wallet, event_id, session) END AS merge_batch_id FROM mb LEFT JOIN lf USING (id) LEFT JOIN lc USING (id) LEFT JOIN ms USING (id))"""
_ALL = (POSITIONS, B._FEES, M._BOOKS, A._LEGS, _TIMES, _AROUND, _MERGES)
_BUY = "round(count(*) FILTER (side = 'BUY' AND {}) / nullif(count(*) FILTER (side = 'BUY'), 0) * 100, 4)"
ORACLE |= {
    "merge_timing": sql("SELECT * FROM mt", *_ALL),
    "inventory_timeline": sql("SELECT id, wallet, event_id, condition_id, fill_ts, fill_utc, side, fill_token_side, COLUMNS('.*(_before|_after|_delta)$') FROM od", *_ALL),
    "pattern_summary": sql(f"""SELECT * FROM (SELECT wallet, count(*) AS n_fills, count(*) FILTER (side = 'BUY') AS n_buys, {_BUY.format('bond_delta > 0')} AS pct_increases_bond, {_BUY.format('unpaired_delta < 0')} AS pct_reduces_unpaired, {_BUY.format('unpaired_delta > 0')} AS pct_increases_unpaired,
round(median(coalesce(fill_after_created_s, fill_after_first_seen_s)), 6) + 0 AS median_wait_s, count(*) FILTER (order_time_confidence = 'fill_only_unknown') AS n_unknown_times FROM od GROUP BY 1)
LEFT JOIN (SELECT wallet, count(*) AS n_merges, round(sum(capital_released), 4) + 0 AS capital_released, count(*) FILTER (time_from_last_complement_fill_s <= 60) AS n_merged_within_60s, count(merge_batch_id) AS n_in_batches FROM mt GROUP BY 1) USING (wallet)""", *_ALL),
}
