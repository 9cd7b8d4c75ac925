"""Rules evaluated fill by fill with reasons, over the lifecycle dataset with the times of events; verdicts, and where a rule fails."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import ordered as O
from tidemark.operators.storage import ready
from tidemark.plans import accounting as A
from tidemark.plans import behaviour as B
from tidemark.plans import lifecycle as L
from tidemark.plans import matching as M
from tidemark.plans import timing
from tidemark.plans.views import POSITIONS, markets, r4, sql, tokens
from tidemark.sources.versioned import VersionedTable

VERSION = 1

#: Why a column has no value: the condition, in SQL that both engines read, and the reason. Fixed names, in their own order.
_OPEN, _NONE, _DONE = "close_path = 'OPEN'", "close_path = 'UNKNOWN' AND close_ts IS NULL", "close_path NOT IN ('OPEN', 'RESOLUTION') AND NOT (close_path = 'UNKNOWN' AND close_ts IS NULL)"
NULL_REASONS: dict[str, list[tuple[str, str]]] = {
    "ask_depth_top1": [("ask_depth_top1 IS NULL", "no_book_depth")],
    "ask_depth_top5": [("ask_depth_top5 IS NULL", "no_book_depth")],
    "bid_depth_top1": [("bid_depth_top1 IS NULL", "no_book_depth")],
    "bid_depth_top5": [("bid_depth_top5 IS NULL", "no_book_depth")],
    "bond_after": [("bond_after IS NULL", "no_complement_token")],
    "bond_before": [("bond_before IS NULL", "no_complement_token")],
    "close_path": [(_NONE, "episode_not_built")],
    "directional_after": [("directional_after IS NULL", "no_complement_token")],
    "directional_before": [("directional_before IS NULL", "no_complement_token")],
    "imbalance_top1": [("imbalance_top1 IS NULL", "no_book_depth")],
    "imbalance_top5": [("imbalance_top5 IS NULL", "no_book_depth")],
    "market_category": [("event_id IS NULL", "missing_market_metadata")],
    "markout_15m": [("markout_15m IS NULL", "no_price_point")],
    "markout_1h": [("markout_1h IS NULL", "no_price_point")],
    "markout_24h": [("markout_24h IS NULL", "no_price_point")],
    "markout_5m": [("markout_5m IS NULL", "no_price_point")],
    "pnl_at_resolution": [(_OPEN, "position_still_open"), (_DONE, "no_resolution_yet")],
    "pnl_episode": [(_OPEN, "position_still_open")],
    "realized_pnl_wac": [(_OPEN, "position_still_open")],
    "remaining_open_qty_after_24h": [("remaining_open_qty_after_24h IS NULL", "no_price_point")],
    "time_to_event_start_s": [("start_ts IS NULL", "missing_market_metadata")],
}
CLOSED_BY = {"merge": "MERGE", "redeem": "REDEEM", "sell": "SELL", "resolution": "RESOLUTION", "unresolved_open": "OPEN"}


def with_event_times(d: DataFrame, starts: DataFrame) -> DataFrame:
    """Lifecycle rows with the times of their events, flags of how they closed, and the reason of each missing value as JSON.

    ``starts`` has ``condition_id, start_ts, closed_ts``, a row for each condition; it is joined plainly. Fills of conditions that it
    lacks keep null times and the phase ``unknown``.
    """
    d = d.join(starts.select("condition_id", "start_ts", F.col("closed_ts").alias("_end")), "condition_id", "left")
    ts, start = F.col("trade_ts"), F.col("start_ts")
    reasons = []
    for name, cases in NULL_REASONS.items():
        why = F.lit(None).cast("string")
        for condition, reason in reversed(cases):
            why = F.when(F.expr(condition), reason).otherwise(why)
        reasons.append(why.alias(name))
    cash = F.when(F.col("side") == "BUY", -F.col("fill_notional")).otherwise(F.col("fill_notional")) + F.lit(0.0)
    return d.withColumns(
        {
            "trade_utc": F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd HH:mm:ss"), "fill_size": F.col("fill_shares"), "delta_usdc": cash,
            "time_to_event_start_s": start - ts, "time_since_start_s": ts - start, "event_phase": timing.phase(ts, start, F.col("_end")),
            "qty_complement_before": F.col("qty_complement"), "qty_complement_after": F.col("qty_complement"),  # a fill moves one token
            **{f"closed_by_{k}": (F.col("close_path") == v).cast("int") for k, v in CLOSED_BY.items()},
            "pnl_episode": F.col("realized_pnl_wac"), "null_reasons_json": F.to_json(F.struct(*reasons)), "dataset_version": F.lit(VERSION),
        }
    ).drop("_end")


def lifecycle_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lifecycle dataset with what it lacks of the full one: times to and since the event's start, its phase, flags and reasons."""
    return with_event_times(L.lifecycle_dataset(spark, sf_dir), timing.starts(spark)).drop("null_reasons")


def entry_to_start(spark, sf_dir):
    """Median seconds from the start of the event to the opening of an episode there (negative: before), by wallet, for all markets and
    for each category. The middle two values come from counts by value, so no group is gathered."""
    e = O.episodes(A.positions(spark, sf_dir), A.KEY).select("wallet", "token_id", "open_ts")
    at = timing.starts(spark).select("condition_id", "start_ts").join(markets(spark).select("condition_id", "category"), "condition_id")
    e = e.join(tokens(spark).select("token_id", "condition_id"), "token_id").join(at, "condition_id").where("start_ts is not null")
    e = e.select("wallet", F.explode(F.array(F.lit("all"), F.col("category"))).alias("scope"), (F.col("open_ts") - F.col("start_ts")).alias("wait"))
    keys = ["wallet", "scope"]
    low = O.ranked_values(e, keys, "wait", {"low": 0.5})
    high = O.ranked_values(e.withColumn("wait", -F.col("wait")), keys, "wait", {"high": 0.5})
    n = e.groupBy(*keys).agg(F.count("*").alias("n"))
    return n.join(low, keys).join(high, keys).select(*keys, "n", ((F.col("low") - F.col("high")) / 2).alias("median_s"))


@dataclass(frozen=True)
class Rule:
    """A rule as the checks that a fill must not fail, each a condition in SQL with the explanation it gives; the first counts.

    ``features`` are the columns it reads, all known before the fill. ``active`` says whether any check filters.
    """

    name: str
    checks: tuple[tuple[str, str], ...]
    features: tuple[str, ...]
    passed: str
    active: bool = True
    version: int = 1
    parameters: dict = field(default_factory=dict)

    def explanation(self) -> str:
        """What is said of a fill, as one SQL expression; an unknown condition fails nothing."""
        return "CASE " + " ".join(f"WHEN {c} THEN '{e}'" for c, e in self.checks) + f" ELSE '{self.passed}' END" if self.checks else f"'{self.passed}'"

    def applies(self) -> str:
        return "CASE " + " ".join(f"WHEN {c} THEN false" for c, _ in self.checks) + " ELSE true END" if self.checks else "true"


_BETTER = "round(CASE WHEN side = 'BUY' THEN mid - fill_price ELSE fill_price - mid END / nullif(mid, 0) * 10000, 6)"


def _reduces(c: str) -> str:
    return f"(side = 'SELL' AND {c} > 0 OR side = 'BUY' AND {c} < 0)"


def spread_capture(min_spread_bps: float = 50, min_improvement_bps: float = 10) -> Rule:
    return Rule("spread_capture", (
        ("spread_bps IS NULL OR mid IS NULL OR fill_price IS NULL OR side IS NULL", "missing required feature(s)"), (f"spread_bps < {min_spread_bps}", f"spread_bps below {min_spread_bps}"),
        ("mid = 0", "mid is zero"), (f"{_BETTER} < {min_improvement_bps}", f"fill improvement below {min_improvement_bps} bps"),
    ), ("spread_bps", "mid", "fill_price", "side"), "spread and improvement suffice", parameters={"min_spread_bps": min_spread_bps, "min_improvement_bps": min_improvement_bps})


def inventory_balancing(min_directional: float = 1, reduce: bool = True, bond: bool = False) -> Rule:
    checks = [("directional_before IS NULL OR bond_before IS NULL", "missing directional_before or bond_before"), (f"abs(directional_before) < {min_directional}", f"|directional_before| below {min_directional}")]
    if reduce:
        checks.append((f"NOT {_reduces('directional_before')}", "does not reduce directional"))
    if bond:
        checks.append(("NOT (side = 'BUY' AND coalesce(qty_complement_before, 0) > 0 OR side = 'SELL' AND coalesce(qty_token_before, 0) > 0)", "does not increase bond"))
    features = ("directional_before", "bond_before", "qty_token_before", "qty_complement_before", "side")
    return Rule("inventory_balancing", tuple(checks), features, "fill balances the inventory", parameters={"min_directional": min_directional, "reduce": reduce, "bond": bond})


def completion_set_edge(max_cost: float = 0.98) -> Rule:
    return Rule("completion_set_edge", (
        ("fill_price IS NULL OR best_ask IS NULL OR side IS NULL", "missing fill_price, best_ask, or side"), ("qty_token_before IS NULL OR qty_complement_before IS NULL", "missing position data"),
        (f"round(fill_price + best_ask, 6) > {max_cost}", f"total bond cost above {max_cost}"),
    ), ("fill_price", "best_ask", "qty_token_before", "qty_complement_before", "side"), "total bond cost is low", parameters={"max_cost": max_cost})


def depth_imbalance(min_imbalance: float = 0.3, favourable: bool = True) -> Rule:
    checks = [("imbalance_top5 IS NULL OR side IS NULL", "missing imbalance_top5 or side"), (f"abs(imbalance_top5) < {min_imbalance}", f"|imbalance| below {min_imbalance}")]
    if favourable:
        checks += [("side = 'BUY' AND imbalance_top5 < 0", "BUY against the imbalance"), ("side = 'SELL' AND imbalance_top5 > 0", "SELL against the imbalance")]
    return Rule("depth_imbalance", tuple(checks), ("imbalance_top5", "side"), "imbalance favours the side", parameters={"min_imbalance": min_imbalance, "favourable": favourable})


def event_timing(hours: tuple[int, ...] = (), longest_s: int | None = None, shortest_s: int | None = None) -> Rule:
    """Fills in the given hours (UTC; none: all) and in a window of seconds to the event's start; an unknown start fails nothing."""
    checks = [("trade_hour_utc IS NULL", "missing trade_hour_utc")]
    if hours:
        checks.append((f"trade_hour_utc NOT IN ({', '.join(map(str, sorted(hours)))})", "hour not allowed"))
    if longest_s is not None:
        checks.append((f"time_to_event_start_s > {longest_s}", f"time to event start above {longest_s} s"))
    if shortest_s is not None:
        checks.append((f"time_to_event_start_s < {shortest_s}", f"time to event start below {shortest_s} s"))
    active = bool(hours) or longest_s is not None or shortest_s is not None
    return Rule("event_timing", tuple(checks), ("trade_hour_utc", "time_to_event_start_s"), "hour within allowed window", active, parameters={"hours": list(hours), "longest_s": longest_s, "shortest_s": shortest_s})


def correlated_siblings(min_exposure: float = 5) -> Rule:
    return Rule("correlated_siblings", (
        ("event_exposure_before IS NULL", "missing event_exposure_before"), ("side IS NULL", "missing side"), (f"abs(event_exposure_before) < {min_exposure}", f"|event_exposure_before| below {min_exposure}"),
        (f"NOT {_reduces('event_exposure_before')}", "not improving"),
    ), ("event_exposure_before", "side"), "improving", parameters={"min_exposure": min_exposure})


def closed_cycle(min_spread_bps: float = 30, min_exposure: float = 5) -> Rule:
    return Rule("closed_cycle", (
        ("spread_bps IS NULL", "missing spread_bps"), (f"spread_bps < {min_spread_bps}", f"spread below {min_spread_bps} bps"), ("event_exposure_before IS NULL", "no event-level exposure"),
        (f"abs(event_exposure_before) < {min_exposure}", f"|event_exposure| below {min_exposure}"),
    ), ("spread_bps", "event_exposure_before", "side", "directional_before"), "spread and exposure suffice", parameters={"min_spread_bps": min_spread_bps, "min_exposure": min_exposure})


def default_rules() -> list[Rule]:
    return [spread_capture(), inventory_balancing(), completion_set_edge(), depth_imbalance(), event_timing(tuple(range(8, 22)), 20 * 86400, -20 * 86400), correlated_siblings(), closed_cycle()]


def evaluated(d: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row for each fill and rule: whether it applies, why (not), and the features that the rule read, as ``name=value`` text.

    ``d`` has the columns of ``lifecycle_events``, ``id`` and, for ``verdicts``, ``split``. Fills stay in their partitions.
    """

    def told(r: Rule):
        def value(c: str):
            v = F.col(c) if dict(d.dtypes)[c] == "string" else F.format_string("%.4f", F.col(c).cast("double"))
            return F.concat(F.lit(f"{c}="), F.when(F.col(c).isNotNull(), v).otherwise("null"))

        said = F.concat_ws(",", *(value(c) for c in r.features))
        return F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("rule_version"), F.expr(r.applies()).alias("applies"), F.expr(r.explanation()).alias("explanation"), said.alias("features_used"))

    return d.withColumn("_r", F.explode(F.array(*(told(r) for r in rules)))).select(*d.columns, "_r.*")


def verdicts(e: DataFrame, rules: list[Rule]) -> DataFrame:
    """Each rule over all fills: the share it explains, and whether it is promoted, or why not.

    A rule is promoted if it filters and both validation and test have fills that it explains whose mean episode profit (without any
    profit known, mean first markout) is above zero.
    """
    per = e.groupBy("rule", "split").agg(
        F.count("*").alias("n"), F.count_if("applies").alias("fired"), F.avg(F.when(F.col("applies"), F.col("pnl_episode"))).alias("pnl"), F.avg(F.when(F.col("applies"), F.col("markout_5m"))).alias("early")
    )
    good = F.coalesce((F.col("fired") >= 1) & (F.round(F.coalesce("pnl", "early"), 8) > 0), F.lit(False))
    g = per.groupBy("rule").agg(
        F.sum("n").alias("n_fills"), F.sum("fired").alias("n_explained"), *(F.coalesce(F.bool_or(F.when(F.col("split") == s, good)), F.lit(False)).alias(f"{s}_ok") for s in ("validation", "test"))
    )
    names = [r.name for r in rules if r.active]
    active = F.col("rule").isin(names) if names else F.lit(False)
    why = F.when(~active, "no_active_predicate").when(~(F.col("validation_ok") & F.col("test_ok")), "insufficient_oos_signal")
    return g.select("rule", "n_fills", "n_explained", r4(F.col("n_explained") / F.col("n_fills"), "explained_share"), why.isNull().alias("promoted"), why.alias("rejection_reason"))


def store_evaluations(table: VersionedTable, d: DataFrame, rules: list[Rule]) -> int:
    """Keep the evaluations of ``rules``, in a table with partitions by rule: those of the same rules are replaced, others stay."""
    keep = ["id", "wallet", "trade_ts", "split", "markout_5m", "markout_1h", "pnl_episode"]
    out = evaluated(d, rules).select(*keep, "rule", "rule_version", "applies", "explanation", "features_used")
    return table.rebuild(out, partitions={r.name for r in rules})


def explain_fill(table: VersionedTable, fill: int) -> DataFrame:
    """What the stored rules say of one fill; no rows for one that they have not seen."""
    return table.read().where(F.col("id") == fill).select("rule", "rule_version", "applies", "explanation", "features_used")


def _stored(spark, sf_dir) -> DataFrame:
    table = VersionedTable(spark, f"{ready(spark)}/rules-{uuid.uuid4().hex}", "rule")
    store_evaluations(table, B.temporal_split(lifecycle_events(spark, sf_dir)), default_rules())
    return table.read()


def rule_evaluations(spark, sf_dir):
    """Every fill and rule with the reason of the outcome, stored and read back."""
    return _stored(spark, sf_dir).select("id", "rule", "split", "applies", "explanation", "features_used")


def rule_verdicts(spark, sf_dir):
    return verdicts(_stored(spark, sf_dir), default_rules())


#: Upper edges of the buckets (the edge itself belongs to the next, for ages to its own) and their names. Fixed values.
BUCKETS = {
    "price": ("fill_price", "<", (0.10, 0.25, 0.50, 0.75, 0.90), ("<0.10", "0.10-0.25", "0.25-0.50", "0.50-0.75", "0.75-0.90", ">=0.90")),
    "spread": ("spread_bps", "<", (50, 100, 250, 500, 1000), ("<50", "50-100", "100-250", "250-500", "500-1000", ">=1000")),
    "book_age": ("book_before_age_s", "<=", (5, 15, 30, 60), ("0-5s", "6-15s", "16-30s", "31-60s", ">60s")),
    "depth": ("CASE WHEN side = 'SELL' THEN bid_depth_top1 ELSE ask_depth_top1 END", "<", (10, 50, 100, 250, 500), ("<10", "10-50", "50-100", "100-250", "250-500", ">=500")),
    "time_to_event": ("time_to_event_start_s", "<", (0, 3600, 21600, 86400, 259200, 604800), ("past_start", "0-1h", "1-6h", "6-24h", "1-3d", "3-7d", ">7d")),
}


def bucket(family: str) -> str:
    """A family's bucket of a fill as SQL that both engines read; ``unknown`` without a value."""
    if family == "side":
        return "coalesce(side, 'unknown')"
    if family == "hour":
        return "coalesce(lpad(CAST(trade_hour_utc AS VARCHAR(2)), 2, '0'), 'unknown')"
    value, how, edges, names = BUCKETS[family]
    return f"CASE WHEN ({value}) IS NULL THEN 'unknown' " + " ".join(f"WHEN ({value}) {how} {e} THEN '{n}'" for e, n in zip(edges, names)) + f" ELSE '{names[-1]}' END"


FAMILIES = (*BUCKETS, "hour", "side")


def _held_out(spark, sf_dir) -> DataFrame:
    return B.temporal_split(lifecycle_events(spark, sf_dir)).where("split = 'test'")


def _outcomes() -> list:
    def near(c, name):  # a little more keeps means that are ties in the last digit from falling either way
        return r4(c + 1e-9, name)

    return [
        F.count("*").alias("n_fills"), near(F.sum("fill_notional"), "notional"), F.count("markout_1h").alias("n_markout"), near(F.avg("markout_1h"), "avg_markout_1h"),
        near(F.coalesce(F.sum(F.col("markout_24h") * F.col("fill_shares")), F.lit(0.0)), "net_pnl_24h"), near(F.avg("pnl_episode"), "avg_pnl_episode"),
    ]


def holdout_buckets(spark, sf_dir):
    """Outcomes of the holdout's fills by seven families of buckets: price, spread, age of the book, depth on the fill's side, time to the
    event, hour, side."""
    cells = F.array(*(F.struct(F.lit(f).alias("family"), F.expr(bucket(f)).alias("bucket")) for f in FAMILIES))
    return _held_out(spark, sf_dir).withColumn("_c", F.explode(cells)).groupBy("_c.family", "_c.bucket").agg(*_outcomes())


def holdout_conditions(spark, sf_dir):
    """The same by event and condition."""
    return _held_out(spark, sf_dir).groupBy("event_id", "condition_id").agg(*_outcomes())


QUERIES = {f.__name__: f for f in (lifecycle_events, entry_to_start, rule_evaluations, rule_verdicts, holdout_buckets, holdout_conditions)}


def _reasons_sql() -> str:
    parts = []
    for name, cases in NULL_REASONS.items():
        whens = " ".join(f"WHEN {c} THEN '\"{name}\":\"{r}\"'" for c, r in cases)
        parts.append(f"CASE {whens} END")
    return "'{' || concat_ws(',', " + ", ".join(parts) + ") || '}'"


_EVENTS = f"""
sta AS (SELECT condition_id, closed_ts, CASE WHEN c % 3 <> 2 THEN 1704067200 + c * 86400 END AS start_ts FROM (SELECT *, substr(condition_id, 2)::BIGINT AS c FROM markets)),
ld AS ({L._LIFE_SELECT}),
le AS (SELECT * EXCLUDE (null_reasons, closed_ts, event_start), {_reasons_sql()} AS null_reasons_json FROM (SELECT ld.*, start_ts, start_ts AS event_start, closed_ts, strftime(to_timestamp(trade_ts) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS trade_utc, fill_shares AS fill_size,
   CASE WHEN side = 'BUY' THEN -fill_notional ELSE fill_notional END + 0 AS delta_usdc, start_ts - trade_ts AS time_to_event_start_s, trade_ts - start_ts AS time_since_start_s,
   CASE WHEN start_ts IS NULL THEN 'unknown' WHEN trade_ts < start_ts THEN 'pregame' WHEN trade_ts > closed_ts THEN 'post_event' WHEN closed_ts <= start_ts THEN 'early_live' WHEN (trade_ts - start_ts) / (closed_ts - start_ts) < 0.35 THEN 'early_live' WHEN (trade_ts - start_ts) / (closed_ts - start_ts) BETWEEN 0.45 AND 0.60 THEN 'halftime_or_pause' ELSE 'late_live' END AS event_phase,
   qty_complement AS qty_complement_before, qty_complement AS qty_complement_after, {', '.join(f"(close_path = '{v}')::INT AS closed_by_{k}" for k, v in CLOSED_BY.items())}, realized_pnl_wac AS pnl_episode, 1 AS dataset_version FROM ld LEFT JOIN sta USING (condition_id))),
les AS (SELECT *, CASE WHEN r < floor(n * 0.6) THEN 'train' WHEN r < floor(n * 0.8) THEN 'validation' ELSE 'test' END AS split FROM (SELECT *, row_number() OVER (ORDER BY trade_ts, id) - 1 AS r, count(*) OVER () AS n FROM le))"""
_WITH = (POSITIONS, A._EPISODES, L._EP2, B._FEES, M._BOOKS, L._DEEP, A._LEGS, L._LIFE, _EVENTS)


def _told_sql(r: Rule) -> str:
    said = ", ".join(f"'{c}=' || " + (f"coalesce({c}, 'null')" if c == "side" else f"coalesce(printf('%.4f', {c}::DOUBLE), 'null')") for c in r.features)
    return f"SELECT id, split, pnl_episode, markout_5m, '{r.name}' AS rule, {str(r.active).lower()} AS active, {r.applies()} AS applies, {r.explanation()} AS explanation, concat_ws(',', {said}) AS features_used FROM les"


_TOLD = "told AS (" + " UNION ALL ".join(_told_sql(r) for r in default_rules()) + ")"
_OUT = """count(*) AS n_fills, round(sum(fill_notional) + 1e-9, 4) + 0 AS notional, count(markout_1h) AS n_markout, round(avg(markout_1h) + 1e-9, 4) + 0 AS avg_markout_1h, round(coalesce(sum(markout_24h * fill_shares), 0) + 1e-9, 4) + 0 AS net_pnl_24h, round(avg(pnl_episode) + 1e-9, 4) + 0 AS avg_pnl_episode"""
ORACLE = {
    "lifecycle_events": sql("SELECT * FROM le", *_WITH),
    "entry_to_start": sql("""SELECT wallet, scope, count(*) AS n, median(wait) AS median_s FROM (SELECT wallet, unnest(['all', category]) AS scope, open_ts - start_ts AS wait FROM ep2 JOIN tokens USING (token_id) JOIN sta USING (condition_id) JOIN markets USING (condition_id) WHERE start_ts IS NOT NULL) GROUP BY 1, 2""", POSITIONS, A._EPISODES, L._EP2, _EVENTS.split("\nld AS")[0].rstrip(",")),
    "rule_evaluations": sql("SELECT id, rule, split, applies, explanation, features_used FROM told", *_WITH, _TOLD),
    "rule_verdicts": sql("""SELECT rule, n_fills, n_explained, round(n_explained / n_fills, 4) AS explained_share, active AND v_ok AND t_ok AS promoted, CASE WHEN NOT active THEN 'no_active_predicate' WHEN NOT (v_ok AND t_ok) THEN 'insufficient_oos_signal' END AS rejection_reason
FROM (SELECT rule, bool_or(active) AS active, sum(n)::BIGINT AS n_fills, sum(fired)::BIGINT AS n_explained, coalesce(bool_or(good) FILTER (split = 'validation'), false) AS v_ok, coalesce(bool_or(good) FILTER (split = 'test'), false) AS t_ok
FROM (SELECT rule, split, bool_or(active) AS active, count(*) AS n, count(*) FILTER (applies) AS fired, coalesce(count(*) FILTER (applies) >= 1 AND round(coalesce(avg(pnl_episode) FILTER (applies), avg(markout_5m) FILTER (applies)), 8) > 0, false) AS good FROM told GROUP BY 1, 2) GROUP BY 1)""", *_WITH, _TOLD),
    "holdout_buckets": sql(" UNION ALL ".join(f"SELECT '{f}' AS family, {bucket(f)} AS bucket, {_OUT} FROM les WHERE split = 'test' GROUP BY 2" for f in FAMILIES), *_WITH),
    "holdout_conditions": sql(f"SELECT event_id, condition_id, {_OUT} FROM les WHERE split = 'test' GROUP BY 1, 2", *_WITH),
}
