"""Rule candidates: what a wallet's fills have in common before they happen, and how well that is supported.

Seven triggers (A to G) are read off the order-timing dataset. Each is described by the fills and markets that it holds for, by
how its support is spread over events and time, and by how long the wallet's unpaired inventory lasts in these markets. Periods
that still last are right-censored, so their median comes from the product-limit estimate: at each duration the share that outlasts
it is that at the one before, less the periods that end there among those that lasted as long. It is two running sums by window.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import ordered as O
from tidemark.operators.storage import stored
from tidemark.plans import matching as M
from tidemark.plans import timing
from tidemark.plans.views import ledger, r4, sql

DUST = 1e-6
#: Names and types of the triggers. Fixed values.
RULES = {
    "A": ("Complement Catch-Up", "entry"), "B": ("Bond-Increasing BUY", "entry"), "C": ("Unpaired-Reducing BUY", "entry"), "D": ("Event Basket Activation", "gating"),
    "E": ("Unpaired Inventory Tolerance", "risk_management"), "F": ("Batch Merge", "exit_capital_recycling"), "G": ("Passive Maker Wait", "execution_style"),
}
#: Slices of a wallet's time in which support is looked for.
SLICES = 10
KEYS = ["wallet", "rule_id"]


def triggers() -> dict:
    """Whether a fill of the order-timing dataset supports each rule; E and F are about what follows, so every fill does."""
    bond, unpaired = F.col("bond_delta") > DUST, F.col("unpaired_delta") < -DUST
    side = F.col("fill_token_side")
    catch_up = F.when(side == "YES", F.col("unpaired_no_before") > DUST).when(side == "NO", F.col("unpaired_yes_before") > DUST).otherwise(unpaired)
    basket = (F.col("event_market_count_active_before") >= 2) & ((F.col("event_unpaired_inventory_before") > DUST) | (F.col("event_bond_qty_before") > DUST))
    waits = F.col("order_time_confidence").isin("estimated_book_seen", "exact_onchain") & (F.col("fill_after_first_seen_s") > 0)
    return {"A": catch_up & bond, "B": bond, "C": unpaired, "D": basket, "E": F.lit(True), "F": F.lit(True), "G": (F.lower("role") == "maker") & waits}


#: What medians are taken of: columns of a fill.
MEASURES = ("fill_price", "fill_size", "fill_notional_usdc", "event_market_count_active_before", "event_unpaired_inventory_before", "event_bond_qty_before", "fill_after_first_seen_s")


def counted_ranks(counted, keys: list[str], medians: dict[str, str], p90: dict[str, str]):
    """Medians, rounded to six places, and the smallest values that nine tenths don't pass, of ``counted`` values (``keys, measure, value, n``).

    ``medians`` and ``p90`` name the results by measure. A key's distinct values of a measure are one window; nothing is gathered.
    The mean of two amounts of four places is no tie in the sixth.
    """
    own = [*keys, "measure"]
    v = counted.where("value is not null").groupBy(*own, "value").agg(F.sum("n").alias("n"))
    v = v.withColumns({"_run": F.sum("n").over(O.upto(own, "value")), "_all": F.sum("n").over(Window.partitionBy(*own))})

    def least(measure: str, enough):
        return F.min(F.when((F.col("measure") == measure) & enough, F.col("value")))

    run, total = F.col("_run"), F.col("_all")
    mid = {m: (least(m, run * 2 >= total) + least(m, run * 2 > total)) / 2 for m in medians}
    return v.groupBy(*keys).agg(
        *((F.round(mid[m], 6) + 0.0).alias(n) for m, n in medians.items()), *(least(m, run * 10 >= total * 9).cast("long").alias(n) for m, n in p90.items())
    )


def _share(part, whole=None):
    return F.round(F.try_divide(part, whole if whole is not None else F.count("*")) * 100, 4)


def outlasting(periods, keys: list[str], duration: str = "duration_s", ended: str = "ended", n: str | None = None):
    """For each key the product-limit estimate at each duration at which a period ends: ``duration``, ``at_risk``, ``survival``.

    Periods are counted by duration first, so a key's window holds its distinct durations. A row stands for ``n`` periods, if named.
    """
    each = F.lit(1) if n is None else F.col(n)
    n = periods.groupBy(*keys, duration).agg(F.sum(each).alias("_n"), F.sum(F.when(F.col(ended), each).otherwise(0)).alias("_d"))
    n = n.withColumn("at_risk", F.sum("_n").over(O.upto(keys, F.desc(duration))))  # backwards: a frame up to the end is gone through anew for each row
    kept = F.when(F.col("_d") < F.col("at_risk"), F.ln(1 - F.col("_d") / F.col("at_risk"))).otherwise(-1e9)
    return n.withColumn("survival", F.exp(F.sum(kept).over(O.upto(keys, duration)))).where("_d > 0").drop("_n", "_d")


def event_classes(fills, periods, redeemed):
    """Of each (wallet, event) whether all its markets are closed: live while one has open unpaired inventory or its last fill lies in the
    event's time, closed if all others were redeemed, else unknown."""
    key = ["wallet", "condition_id"]
    last = fills.groupBy(*key).agg(F.max_by("event_phase", F.struct("fill_ts", "id")).alias("phase"), F.first("event_id").alias("event_id"))
    c = last.join(periods.groupBy(*key).agg(F.max((~F.col("ended")).cast("int")).alias("open")), key, "left").join(redeemed, key, "left")
    live = (F.coalesce("open", F.lit(0)) > 0) | F.col("phase").isin("early_live", "late_live", "halftime_or_pause")
    c = c.withColumn("class", F.when(live, 2).when(F.col("redeemed").isNull(), 1).otherwise(0)).where("event_id is not null")
    worst = F.max("class")
    return c.groupBy("wallet", "event_id").agg(F.when(worst == 2, "live_or_in_progress").when(worst == 1, "open_unknown").otherwise("closed_complete").alias("event_class"))


def rule_candidates(spark, sf_dir):
    """Support, stability, concentration and censoring of the triggers A to G, for each wallet."""
    read = ["id", "wallet", "event_id", "condition_id", "event_phase", "fill_ts", "fill_token_side", "role", "order_time_confidence", "unpaired_yes_before", "unpaired_no_before", "bond_delta", "unpaired_delta"]
    d = stored(timing.order_timing_dataset(spark, sf_dir, valued=False).select(*read, *MEASURES))
    l = ledger(spark, sf_dir)
    ends = l.groupBy("wallet").agg(F.max("ts").alias("_end"))
    periods = M.unpaired_periods(spark, sf_dir).join(ends, "wallet")
    periods = periods.select("wallet", "condition_id", (F.coalesce("close_ts", "_end") - F.col("open_ts")).alias("duration_s"), F.col("close_ts").isNotNull().alias("ended"))
    periods = stored(periods.groupBy("wallet", "condition_id", "duration_s", "ended").agg(F.count("*").alias("n")))
    redeemed = l.where("event_type = 'REDEEM'").select("wallet", "condition_id", F.lit(1).alias("redeemed")).distinct()
    classes = event_classes(d, periods, redeemed)
    time = d.groupBy("wallet").agg(F.min("fill_ts").alias("_t0"), F.max("fill_ts").alias("_t1"), F.count("*").alias("_all"))
    rules = F.concat(*(F.when(p, k).otherwise("") for k, p in triggers().items()))  # the letters of a fill's rules
    of_fill = F.explode(F.split("_rules", "")).alias("rule_id")
    part = F.least(F.floor((F.col("fill_ts") - F.col("_t0")) * SLICES / F.greatest(F.col("_t1") - F.col("_t0"), F.lit(1))), F.lit(SLICES - 1))
    # Fills are counted by all that is asked of them before their rules are told apart; what follows reads few rows.
    x = d.join(time, "wallet").withColumns({"_slice": part, "_rules": rules})
    bond, gap = F.col("bond_delta") > DUST, F.col("unpaired_delta")
    cells = x.groupBy("wallet", "_rules", "event_id", "condition_id", "_slice", "_all").agg(F.count("*").alias("n"), F.count_if(bond).alias("_bond"), F.count_if(gap < -DUST).alias("_less"), F.count_if(gap > DUST).alias("_more"))
    x = cells.select("*", of_fill).where("rule_id != ''").join(classes, ["wallet", "event_id"], "left")
    x = stored(x.withColumn("_closed", F.coalesce(F.col("event_class") == "closed_complete", F.lit(False))))
    n, closed = F.sum("n"), F.col("_closed")
    g = x.groupBy(*KEYS).agg(
        n.alias("fills_supported"), _share(n, F.first("_all")).alias("fills_supported_pct"), F.countDistinct("event_id").alias("events_supported"), F.countDistinct("condition_id").alias("conditions_supported"),
        _share(F.sum("_bond"), n).alias("pct_increases_bond"), _share(F.sum("_less"), n).alias("pct_reduces_unpaired"), _share(F.sum("_more"), n).alias("pct_increases_unpaired"),
        F.countDistinct(F.when(closed, F.col("event_id"))).alias("closed_complete_events_supported"), _share(F.sum(F.when(closed, 0).otherwise(F.col("n"))), n).alias("censored_observation_share"), F.countDistinct("_slice").alias("slices_supported"),
    )
    by_event = x.where("event_id is not null").groupBy(*KEYS, "event_id").agg(n.alias("n"))
    top = by_event.groupBy(*KEYS).agg(F.max("n").alias("_top"), F.min_by("event_id", F.struct(-F.col("n"), "event_id")).alias("top_event"))
    by_slice = x.groupBy(*KEYS, "_slice").agg(n.alias("n")).groupBy(*KEYS).agg(F.max("n").alias("_top_slice"))
    markets_of = x.select(*KEYS, "condition_id").distinct()
    pairs = M.next_complements(spark, sf_dir).where("o is not null")
    cost = F.round(1 - r4(1 - F.col("price") - F.col("o.price"), "pair_edge"), 4)
    pairs = pairs.groupBy("wallet", "condition_id", cost.alias("cost"), (F.col("o.ts") - F.col("ts")).alias("wait_s")).agg(F.count("*").alias("n"))
    pairs = stored(pairs.join(markets_of, ["wallet", "condition_id"]).groupBy(*KEYS, "cost", "wait_s").agg(n.alias("n")))
    below = {name: F.sum(F.when(F.col("cost") < v, F.col("n")).otherwise(0)) for name, v in (("095", 0.95), ("098", 0.98), ("100", 1.0))}
    costs = pairs.groupBy(*KEYS).agg(*(_share(v, n).alias(f"pct_complete_set_cost_lt_{name}") for name, v in below.items()))
    of_rule = periods.join(markets_of, ["wallet", "condition_id"])
    over = of_rule.groupBy(*KEYS).agg(n.alias("unpaired_periods"), F.sum(F.when(F.col("ended"), 0).otherwise(F.col("n"))).alias("censored_periods"))
    limit = outlasting(of_rule, KEYS, n="n").where(F.round("survival", 9) <= 0.5).groupBy(*KEYS).agg(F.min("duration_s").alias("product_limit_median_s"))

    def values(names: tuple[str, ...]):
        return F.inline(F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in names)))

    seen = d.withColumn("_rules", rules).select("wallet", "_rules", values(MEASURES)).where("value is not null").groupBy("wallet", "_rules", "measure", "value").agg(F.count("*").alias("n"))
    counted = seen.select("wallet", of_fill, "measure", "value", "n").where("rule_id != ''")
    counted = counted.unionByName(pairs.select(*KEYS, values(("cost", "wait_s")), "n")).unionByName(of_rule.where("ended").select(*KEYS, values(("duration_s",)), "n"))
    medians = {c: f"median_{c}" for c in MEASURES} | {"cost": "median_complete_set_cost", "wait_s": "p50_time_to_complement_s", "duration_s": "median_unpaired_duration_s"}
    ranks = counted_ranks(counted, KEYS, medians, {"wait_s": "p90_time_to_complement_s", "duration_s": "p90_unpaired_duration_s"})
    out = g
    for more in (ranks, top, by_slice, costs, over, limit):
        out = out.join(more, KEYS, "left")
    share, events = F.round(F.col("_top") / F.col("fills_supported") * 100, 4), F.col("events_supported")
    stability = F.when(events == 0, "no support").when((events >= 10) & (share < 35), "broad").when((events >= 4) & (share < 60), "moderate").otherwise("thin")
    risk = F.when(events == 0, "high").when(share >= 60, "high").when(share >= 35, "medium").otherwise("low")
    reliable = (F.col("censored_observation_share") <= 50) & (F.col("unpaired_periods") - F.col("censored_periods") >= 10)
    reliable = F.when(F.col("rule_id").isin("E", "F"), F.col("unpaired_periods") - F.col("censored_periods") >= 10).otherwise(reliable)
    names = F.create_map(*(F.lit(v) for k, (n, _) in RULES.items() for v in (k, n)))
    types = F.create_map(*(F.lit(v) for k, (_, t) in RULES.items() for v in (k, t)))
    out = out.withColumns(
        {
            "rule_name": F.element_at(names, F.col("rule_id")), "rule_type": F.element_at(types, F.col("rule_id")), "top_event_share_pct": share, "support_stability": stability, "concentration_risk": risk,
            "top_slice_share_pct": F.round(F.col("_top_slice") / F.col("fills_supported") * 100, 4), "lifecycle_metrics_reliable": F.coalesce(reliable, F.lit(False)),
        }
    )
    return out.drop("_top", "_top_slice")


def unpaired_survival(spark, sf_dir):
    """How long a wallet's unpaired inventory outlasts: the product-limit estimate at each duration, open periods censored at its last event."""
    ends = ledger(spark, sf_dir).groupBy("wallet").agg(F.max("ts").alias("_end"))
    p = M.unpaired_periods(spark, sf_dir).join(ends, "wallet")
    p = p.select("wallet", (F.coalesce("close_ts", "_end") - F.col("open_ts")).alias("duration_s"), F.col("close_ts").isNotNull().alias("ended"))
    return outlasting(p, ["wallet"]).select("wallet", "duration_s", "at_risk", F.round("survival", 6).alias("survival"))


QUERIES = {f.__name__: f for f in (rule_candidates, unpaired_survival)}

_PERIODS = f"""
up AS ({M.ORACLE['unpaired_periods']}),
en AS (SELECT wallet, max(ts) AS last_ts FROM ledger GROUP BY 1),
pd AS (SELECT wallet, condition_id, coalesce(close_ts, last_ts) - open_ts AS duration_s, close_ts IS NOT NULL AS ended FROM up JOIN en USING (wallet))"""


def _limit(of: str, keys: str, name: str) -> str:
    return f"""
{name}0 AS (SELECT {keys}, duration_s, count(*) AS n, count(*) FILTER (ended) AS d FROM {of} GROUP BY ALL),
{name}1 AS (SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY duration_s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS at_risk FROM {name}0),
{name} AS (SELECT * FROM (SELECT *, exp(sum(CASE WHEN d < at_risk THEN ln(1 - d / at_risk) ELSE -1e9 END) OVER (PARTITION BY {keys} ORDER BY duration_s ROWS UNBOUNDED PRECEDING)) AS survival FROM {name}1) WHERE d > 0)"""


_WHEN = {
    "A": "coalesce(CASE fill_token_side WHEN 'YES' THEN unpaired_no_before > 1e-6 WHEN 'NO' THEN unpaired_yes_before > 1e-6 ELSE unpaired_delta < -1e-6 END AND bond_delta > 1e-6, false)",
    "B": "bond_delta > 1e-6", "C": "unpaired_delta < -1e-6", "D": "event_market_count_active_before >= 2 AND (event_unpaired_inventory_before > 1e-6 OR event_bond_qty_before > 1e-6)", "E": "true", "F": "true",
    "G": "lower(role) = 'maker' AND order_time_confidence IN ('estimated_book_seen', 'exact_onchain') AND fill_after_first_seen_s > 0",
}
_SUPPORT = f"""
od AS ({timing.ORACLE['order_timing_dataset']}),
pc AS ({M.ORACLE['pair_completion']}),
{_PERIODS},
rd AS (SELECT DISTINCT wallet, condition_id FROM ledger WHERE event_type = 'REDEEM'),
c0 AS (SELECT wallet, condition_id, arg_max(event_phase, (fill_ts, id)) AS phase, any_value(event_id) AS event_id FROM od GROUP BY 1, 2),
c1 AS (SELECT wallet, event_id, max(CASE WHEN coalesce(op, false) OR phase IN ('early_live', 'late_live', 'halftime_or_pause') THEN 2 WHEN rd.wallet IS NULL THEN 1 ELSE 0 END) AS worst FROM c0
  LEFT JOIN (SELECT wallet, condition_id, bool_or(NOT ended) AS op FROM pd GROUP BY 1, 2) USING (wallet, condition_id) LEFT JOIN rd ON rd.wallet = c0.wallet AND rd.condition_id = c0.condition_id WHERE event_id IS NOT NULL GROUP BY 1, 2),
tt AS (SELECT wallet, min(fill_ts) AS t0, max(fill_ts) AS t1, count(*) AS al FROM od GROUP BY 1),
xx AS (SELECT od.*, al, coalesce(worst = 0, false) AS closed, least(floor((fill_ts - t0) * 10 / greatest(t1 - t0, 1)), 9) AS slice FROM od JOIN tt USING (wallet) LEFT JOIN c1 ON c1.wallet = od.wallet AND c1.event_id = od.event_id),
xr AS ({' UNION ALL '.join(f"SELECT '{k}' AS rule_id, '{RULES[k][0]}' AS rule_name, '{RULES[k][1]}' AS rule_type, * FROM xx WHERE {w}" for k, w in _WHEN.items())}),
mk AS (SELECT DISTINCT wallet, rule_id, condition_id FROM xr),
pp AS (SELECT mk.wallet, mk.rule_id, round(1 - pair_edge, 4) AS cost, wait_s FROM pc JOIN (SELECT id, wallet, condition_id FROM ledger) l USING (id) JOIN mk USING (wallet, condition_id) WHERE pair_id IS NOT NULL),
pr AS (SELECT wallet, rule_id, duration_s, ended FROM pd JOIN mk USING (wallet, condition_id)),
{_limit('pr', 'wallet, rule_id', 'kl')}"""


def _pct(cond: str, name: str) -> str:
    return f"round(count(*) FILTER ({cond}) / count(*) * 100, 4) AS {name}"


_MEDIANS = ", ".join(
    f"round(median({c}), 6) + 0 AS median_{c}" for c in ("fill_price", "fill_size", "fill_notional_usdc", "event_market_count_active_before", "event_unpaired_inventory_before", "event_bond_qty_before", "fill_after_first_seen_s")
)
ORACLE = {
    "unpaired_survival": sql("SELECT wallet, duration_s, at_risk::BIGINT AS at_risk, round(survival, 6) AS survival FROM kl", _PERIODS + ", " + _limit("pd", "wallet", "kl")),
    "rule_candidates": sql(f"""SELECT g.*, top_event, round(top / fills_supported * 100, 4) AS top_event_share_pct, round(top_slice / fills_supported * 100, 4) AS top_slice_share_pct, c.* EXCLUDE (wallet, rule_id), o.* EXCLUDE (wallet, rule_id), product_limit_median_s,
CASE WHEN events_supported = 0 THEN 'no support' WHEN events_supported >= 10 AND round(top / fills_supported * 100, 4) < 35 THEN 'broad' WHEN events_supported >= 4 AND round(top / fills_supported * 100, 4) < 60 THEN 'moderate' ELSE 'thin' END AS support_stability,
CASE WHEN events_supported = 0 OR round(top / fills_supported * 100, 4) >= 60 THEN 'high' WHEN round(top / fills_supported * 100, 4) >= 35 THEN 'medium' ELSE 'low' END AS concentration_risk,
coalesce(CASE WHEN rule_id IN ('E', 'F') THEN unpaired_periods - censored_periods >= 10 ELSE censored_observation_share <= 50 AND unpaired_periods - censored_periods >= 10 END, false) AS lifecycle_metrics_reliable FROM
(SELECT wallet, rule_id, any_value(rule_name) AS rule_name, any_value(rule_type) AS rule_type, count(*) AS fills_supported, round(count(*) / any_value(al) * 100, 4) AS fills_supported_pct, count(DISTINCT event_id) AS events_supported, count(DISTINCT condition_id) AS conditions_supported, {_MEDIANS},
 {_pct('bond_delta > 1e-6', 'pct_increases_bond')}, {_pct('unpaired_delta < -1e-6', 'pct_reduces_unpaired')}, {_pct('unpaired_delta > 1e-6', 'pct_increases_unpaired')}, count(DISTINCT event_id) FILTER (closed) AS closed_complete_events_supported, {_pct('NOT closed', 'censored_observation_share')}, count(DISTINCT slice) AS slices_supported FROM xr GROUP BY 1, 2) g
LEFT JOIN (SELECT wallet, rule_id, max(n) AS top, arg_min(event_id, (-n, event_id)) AS top_event FROM (SELECT wallet, rule_id, event_id, count(*) AS n FROM xr WHERE event_id IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (wallet, rule_id)
LEFT JOIN (SELECT wallet, rule_id, max(n) AS top_slice FROM (SELECT wallet, rule_id, slice, count(*) AS n FROM xr GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (wallet, rule_id)
LEFT JOIN (SELECT wallet, rule_id, round(median(cost), 6) + 0 AS median_complete_set_cost, {_pct('cost < 0.95', 'pct_complete_set_cost_lt_095')}, {_pct('cost < 0.98', 'pct_complete_set_cost_lt_098')}, {_pct('cost < 1', 'pct_complete_set_cost_lt_100')}, round(median(wait_s), 6) + 0 AS p50_time_to_complement_s, quantile_disc(wait_s, 0.9) AS p90_time_to_complement_s FROM pp GROUP BY 1, 2) c USING (wallet, rule_id)
LEFT JOIN (SELECT wallet, rule_id, count(*) AS unpaired_periods, count(*) FILTER (NOT ended) AS censored_periods, round(median(duration_s) FILTER (ended), 6) + 0 AS median_unpaired_duration_s, quantile_disc(duration_s, 0.9) FILTER (ended) AS p90_unpaired_duration_s FROM pr GROUP BY 1, 2) o USING (wallet, rule_id)
LEFT JOIN (SELECT wallet, rule_id, min(duration_s) AS product_limit_median_s FROM kl WHERE round(survival, 9) <= 0.5 GROUP BY 1, 2) USING (wallet, rule_id)""", _SUPPORT),
}
