"""Rules fitted to each wallet: every configuration of a grid scored on the wallet's earliest fills in one aggregation, the best one of a
rule judged on later fills."""

from __future__ import annotations

import json
from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.storage import stored
from tidemark.plans import evaluation as E
from tidemark.plans.evaluation import Rule
from tidemark.plans.views import r4, sql

SPLITS = ("train", "validation", "test")


def grid() -> list[Rule]:
    """The 54 configurations, in the order in which equal scores are resolved. Fixed values."""
    hours = ((), tuple(range(12, 21)), tuple(range(9)))
    return [
        *(E.spread_capture(s, i) for s, i in product((20, 50, 100, 200), (5, 10, 20))),
        *(E.inventory_balancing(m, reduce, bond) for reduce, bond, m in product((True, False), (True, False), (0.5, 1, 5)) if reduce or bond),
        *(E.completion_set_edge(c) for c in (0.95, 0.98, 0.99)),
        *(E.depth_imbalance(i, favourable) for i, favourable in product((0.2, 0.3, 0.5), (True, False))),
        *(E.event_timing(h, longest) for h, longest in product(hours, (None, 3600, 7200, 86400))),
        *(E.correlated_siblings(e) for e in (1, 5, 10)),
        *(E.closed_cycle(s, e) for s, e in product((20, 30, 50), (3, 5, 10))),
    ]


def split_by_wallet(d: DataFrame) -> DataFrame:
    """``d`` with ``split``: of each wallet's fills in order of ``trade_ts, id`` the first 60 % are train, the next 20 % validation, the rest
    test. Ranks are taken within a day and moved by the counts of the days before, so no task orders a wallet's whole history."""
    d = d.withColumn("_day", F.floor(F.col("trade_ts") / 86_400))
    days = d.groupBy("wallet", "_day").agg(F.count("*").alias("_n"))
    run = Window.partitionBy("wallet").orderBy("_day")
    days = days.withColumns({"_ahead": F.sum("_n").over(run) - F.col("_n"), "_total": F.sum("_n").over(Window.partitionBy("wallet"))}).drop("_n")
    d = d.join(days, ["wallet", "_day"])
    rank = F.col("_ahead") + F.row_number().over(Window.partitionBy("wallet", "_day").orderBy("trade_ts", "id")) - 1
    split = F.when(rank < F.floor(F.col("_total") * 0.6), "train").when(rank < F.floor(F.col("_total") * 0.8), "validation").otherwise("test")
    return d.withColumn("split", split).drop("_day", "_ahead", "_total")


def fitted(d: DataFrame, rules: list[Rule]) -> DataFrame:
    """For each wallet and rule name the configuration with the best score on train, the first of equals, and what became of it.

    ``d``: fills with ``split``. The score is the share of explained fills with a profit (of the episode, else of the first markout) times
    the share of fills explained. A fill makes a narrow row for each configuration that fires on it, summed up before the shuffle;
    what travels are sums for (wallet, configuration, split). Wallets are not null; one without train fills scores zero everywhere.
    """
    label = F.coalesce("pnl_episode", "markout_5m")
    rows = d.select(
        "wallet", "split", label.alias("label"), "pnl_episode", "markout_5m", F.abs("qty_token_before").alias("held"),
        F.explode(F.filter(F.array(*(F.when(F.expr(r.applies()), F.lit(k)) for k, r in enumerate(rules))), lambda x: x.isNotNull())).alias("config"),
    )
    sums = rows.groupBy("wallet", "config", "split").agg(
        F.count("*").alias("fired"), F.count("label").alias("known"), F.count_if(F.col("label") > 0).alias("up"), F.avg("pnl_episode").alias("pnl"), F.avg("markout_5m").alias("early"), F.max("held").alias("held")
    )
    size = d.groupBy("wallet").pivot("split", list(SPLITS)).agg(F.count(F.lit(1))).na.fill(0)
    every = size.withColumn("config", F.explode(F.sequence(F.lit(0), F.lit(len(rules) - 1))))
    parts = sums.groupBy("wallet", "config").pivot("split", list(SPLITS)).agg(*(F.first(c).alias(c) for c in ("fired", "known", "up", "pnl", "early", "held")))
    c = every.join(parts, ["wallet", "config"], "left")
    score = F.try_divide("train_up", "train_known") * F.try_divide("train_fired", "train")
    of = {key: F.element_at(F.array(*(F.lit(v) for v in values)), F.col("config") + 1) for key, values in {
        "rule": [r.name for r in rules], "parameters": [json.dumps(r.parameters) for r in rules], "active": [r.active for r in rules],
    }.items()}
    c = c.withColumns({"score": F.coalesce(F.round(score, 12), F.lit(0.0)), **of})
    best = c.groupBy("wallet", "rule").agg(F.max_by(F.struct("*"), F.struct("score", -F.col("config"))).alias("b")).select("b.*")

    def good(s: str):
        return F.coalesce((F.col(f"{s}_fired") >= 1) & (F.round(F.coalesce(f"{s}_pnl", f"{s}_early"), 8) > 0), F.lit(False))

    why = F.when(~F.col("active"), "no_active_predicate").when(~(good("validation") & good("test")), "insufficient_oos_signal")
    explained = sum((F.coalesce(f"{s}_fired", F.lit(0)) for s in SPLITS), F.lit(0))
    return best.select(
        "wallet", "rule", "parameters", F.col("score").alias("train_score"), explained.cast("long").alias("n_explained"), (explained / sum((F.col(s) for s in SPLITS), F.lit(0))).alias("explained_share"),
        F.coalesce("test_pnl", "test_early").alias("expected"), F.col("test_held").alias("max_inventory"), why.isNull().alias("promoted"), why.alias("rejection_reason"),
    )


def rule_fit(spark, sf_dir):
    """The best configuration of every rule for every wallet out of 54, with its fate on later fills."""
    d = stored(E.lifecycle_events(spark, sf_dir))
    out = fitted(split_by_wallet(d), grid())
    return out.select("wallet", "rule", "parameters", r4("train_score"), "n_explained", r4("explained_share"), r4(F.col("expected") + 1e-9, "expected"), r4("max_inventory"), "promoted", "rejection_reason")


QUERIES = {"rule_fit": rule_fit}

_G = grid()
_FIT = f"""
lew AS MATERIALIZED (SELECT *, CASE WHEN r < floor(n * 0.6) THEN 'train' WHEN r < floor(n * 0.8) THEN 'validation' ELSE 'test' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY trade_ts, id) - 1 AS r, count(*) OVER (PARTITION BY wallet) AS n FROM le)),
cfg AS (SELECT unnest(range({len(_G)})) AS config, unnest([{', '.join(f"'{r.name}'" for r in _G)}]) AS rule, unnest([{', '.join(f"'{json.dumps(r.parameters)}'" for r in _G)}]) AS parameters, unnest([{', '.join(str(r.active).lower() for r in _G)}]) AS active),
hit AS (SELECT wallet, split, coalesce(pnl_episode, markout_5m) AS label, pnl_episode, markout_5m, abs(qty_token_before) AS held, unnest([{', '.join(r.applies() for r in _G)}]) AS fires, unnest(range({len(_G)})) AS config FROM lew),
cs AS MATERIALIZED (SELECT wallet, config, split, count(*) FILTER (fires) AS fired, count(*) AS n, count(label) FILTER (fires) AS known, count(*) FILTER (fires AND label > 0) AS up, avg(pnl_episode) FILTER (fires) AS pnl, avg(markout_5m) FILTER (fires) AS early, max(held) FILTER (fires) AS held FROM hit GROUP BY 1, 2, 3),
cw AS (SELECT wallet, config, coalesce(round(max(up / nullif(known, 0) * (fired / n)) FILTER (split = 'train'), 12), 0) AS score, sum(fired)::BIGINT AS n_explained, sum(fired) / sum(n) AS explained_share, max(coalesce(pnl, early)) FILTER (split = 'test') AS expected, max(held) FILTER (split = 'test') AS max_inventory,
  coalesce(bool_or(fired >= 1 AND round(coalesce(pnl, early), 8) > 0) FILTER (split = 'validation'), false) AS v_ok, coalesce(bool_or(fired >= 1 AND round(coalesce(pnl, early), 8) > 0) FILTER (split = 'test'), false) AS t_ok FROM cs GROUP BY 1, 2)"""
ORACLE = {
    "rule_fit": sql("""SELECT wallet, rule, parameters, round(score, 4) AS train_score, n_explained, round(explained_share, 4) AS explained_share, round(expected + 1e-9, 4) + 0 AS expected, round(max_inventory, 4) + 0 AS max_inventory, active AND v_ok AND t_ok AS promoted,
CASE WHEN NOT active THEN 'no_active_predicate' WHEN NOT (v_ok AND t_ok) THEN 'insufficient_oos_signal' END AS rejection_reason FROM (SELECT *, row_number() OVER (PARTITION BY wallet, rule ORDER BY score DESC, config) AS nth FROM cw JOIN cfg USING (config)) WHERE nth = 1""", *E._WITH, _FIT),
}
