"""Operators whose result depends on an order: running state, as-of joins, islands, ranks and interval matches.

All of them are windows and joins over keys such as (wallet, token); nothing walks rows in Python. Every order ends with
a unique id, so results do not depend on how rows are dealt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-6
#: Most that the logarithm of a product of ratios falls within a block of a running cost.
BLOCK = 300.0


def _ordered(keys: list[str], *order):
    return Window.partitionBy(*keys).orderBy(*(order or ("ts", "id")))


def upto(keys: list[str], *order):
    """Rows of a key from its first to the current one."""
    return _ordered(keys, *order).rowsBetween(Window.unboundedPreceding, 0)


def before(keys: list[str], *order):
    """Rows of a key ahead of the current one."""
    return _ordered(keys, *order).rowsBetween(Window.unboundedPreceding, -1)


def running_positions(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Quantity and weighted-average cost after every row, in closed form.

    ``stream`` has ``kind`` (add, remove or reset), ``shares``, ``usdc`` (cost of an add, proceeds otherwise), ``ts`` and
    ``id``. A remove releases cost in proportion while the quantity is positive; a reset, and a remove of all or more,
    leaves no cost. The cost is affine in what it was before, so it is a running sum scaled by running products between
    the rows where it starts anew. Added columns: ``qty_before, qty, cost_before, cost, realized``. Negative quantities
    are kept as they are.

    The products shrink without bound over a long history, so they are taken in blocks in each of which they fall by
    at most ``exp(-BLOCK)``; a block starts with the cost at the end of the one before. What an even earlier block adds to
    that is below 1e-100 of it, because a quantity above the dust can't fall that far without being bought again.
    """
    delta = F.expr("CASE kind WHEN 'add' THEN shares WHEN 'remove' THEN -shares ELSE 0 END")
    out = stream.withColumn("_seg", F.sum(F.expr("CASE kind WHEN 'reset' THEN 1 ELSE 0 END")).over(upto(keys)))
    out = out.withColumn("qty", F.round(F.sum(delta).over(upto([*keys, "_seg"])), 8))
    out = out.withColumn("qty_before", F.coalesce(F.lag("qty").over(_ordered(keys)), F.lit(0.0)))
    partial = (F.col("kind") == "remove") & (F.col("qty_before") > 0) & (F.col("qty") > EPSILON)
    out = out.withColumn("_a", F.when(F.col("kind") == "add", 1.0).when(partial, F.col("qty") / F.col("qty_before")).otherwise(0.0))
    out = out.withColumn("_g", F.sum(F.when(F.col("_a") == 0, 1).otherwise(0)).over(upto(keys)))
    out = out.withColumn("_lp", F.sum(F.when(F.col("_a") > 0, F.ln("_a")).otherwise(0.0)).over(upto([*keys, "_g"])))
    out = out.withColumn("_b", F.floor(-F.col("_lp") / BLOCK)).withColumn("_l", F.col("_lp") + F.col("_b") * BLOCK)
    inside = upto([*keys, "_g", "_b"])
    bought = F.when(F.col("kind") == "add", F.col("usdc")).otherwise(0.0)
    out = out.withColumn("_own", F.exp("_l") * F.sum(bought * F.exp(-F.col("_l"))).over(inside))
    out = out.withColumn("_last", F.lag(F.struct("_lp", "_own")).over(_ordered([*keys, "_g"])))
    out = out.withColumn("_from", F.first("_last").over(inside))
    carried = F.col("_from._own") * F.exp(F.col("_lp") - F.col("_from._lp"))
    out = out.withColumn("cost", F.col("_own") + F.coalesce(carried, F.lit(0.0)))
    out = out.withColumn("cost_before", F.coalesce(F.lag("cost").over(_ordered(keys)), F.lit(0.0)))
    realized = F.when(F.col("qty_before") > 0, F.col("usdc") - F.col("cost_before") + F.col("cost")).otherwise(F.col("usdc"))
    out = out.withColumn("realized", F.when(F.col("kind") != "add", realized).otherwise(0.0))
    return out.drop("_seg", "_a", "_g", "_lp", "_b", "_l", "_own", "_last", "_from")


def episodes(positions: DataFrame, keys: list[str]) -> DataFrame:
    """Flat-to-flat episodes from ``running_positions``: one row for each key and ``episode``.

    An episode ends where a reset comes or a remove leaves at most the dust of a quantity; the next row opens another.
    Resets without an open episode are no episode. ``wac_entry`` is the last average cost before the end, ``last_type`` the
    type of the last event (its kind, where positions have no ``event_type``).
    """
    closes = (F.col("kind") == "reset") | (F.col("kind") == "remove") & (F.abs("qty") <= EPSILON)
    out = episode_events(positions, keys).withColumn("_closes", closes)
    out = out.withColumn("_nth", F.row_number().over(_ordered([*keys, "episode"])))
    add, remove = F.col("kind") == "add", F.col("kind") == "remove"
    over = remove & (F.col("qty_before") > 0) & (F.col("qty") < 0)
    held = F.when(~F.col("_closes") & (F.col("qty") > 0), F.col("cost") / F.col("qty")).when(over & ~F.col("_closes"), F.lit(0.0))
    out = out.withColumn("_wac", held)
    part = remove & (F.col("qty_before") > 0) & (F.col("shares") <= F.col("qty_before")) & ~F.col("_closes")
    grouped = out.groupBy(*keys, "episode").agg(
        F.min("ts").alias("open_ts"),
        F.max(F.when(F.col("_closes"), F.col("ts"))).alias("close_ts"),
        F.max_by("kind", F.struct("ts", "id")).alias("_last"),
        F.max(F.col("_closes").cast("int")).alias("_closed"),
        F.greatest(F.max("qty"), F.lit(0.0)).alias("peak_qty"),
        F.count_if(add & (F.col("_nth") > 1)).alias("num_adds"),
        F.count_if(part).alias("num_partial_exits"),
        F.sum(F.when(F.col("qty_before") > 0, F.col("realized")).otherwise(0.0)).alias("realized_pnl"),
        F.max_by("_wac", F.when(F.col("_wac").isNotNull(), F.struct("ts", "id"))).alias("wac_entry"),
        F.max_by("event_type" if "event_type" in positions.columns else "kind", F.struct("ts", "id")).alias("last_type"),
        F.count("*").alias("n_events"),
        F.count_if(F.col("kind") != "reset").alias("_moves"),
    )
    reason = F.when(F.col("_closed") == 0, "open").when(F.col("_last") == "reset", "resolution").otherwise("flat")
    grouped = grouped.where("_moves > 0").withColumn("close_reason", reason)
    return grouped.drop("_last", "_closed", "_moves")


def episode_events(positions: DataFrame, keys: list[str]) -> DataFrame:
    """``positions`` with the number of the episode that consumed each row; joins to ``episodes`` on keys and ``episode``."""
    closes = (F.col("kind") == "reset") | (F.col("kind") == "remove") & (F.abs("qty") <= EPSILON)
    number = F.coalesce(F.sum(F.when(closes, 1).otherwise(0)).over(before(keys)), F.lit(0))
    return positions.withColumn("episode", number.cast("long"))


def asof_backward(
    left: DataFrame, right: DataFrame, on: list[str], values: list[str], ts: str = "ts", bucket_s: int | None = 86_400
) -> DataFrame:
    """``left`` with the ``values`` (and ``asof_ts``) of the last row of ``right`` at or before its time.

    Rows of both sides are merged in one ordering per key and time bucket; what a bucket starts with comes from the
    last row of an earlier bucket, found among one row for each key and bucket. So no task holds more than a key's rows
    of one bucket, however long its history. ``left`` needs a unique ``id``; ties on the right go to its larger values.
    """
    return _asof(left, right, on, values, ts, bucket_s, forward=False)


def asof_forward(
    left: DataFrame, right: DataFrame, on: list[str], values: list[str], ts: str = "ts", bucket_s: int | None = 86_400
) -> DataFrame:
    """As ``asof_backward`` for the first row of ``right`` at or after the time."""
    return _asof(left, right, on, values, ts, bucket_s, forward=True)


def _asof(left, right, on, values, ts, bucket_s, forward) -> DataFrame:
    bucket = F.floor(F.col(ts) / bucket_s) if bucket_s else F.lit(0)
    payload = F.struct(F.col(ts).alias("asof_ts"), *values) if values else F.col(ts)  # a plain number is hashed where a struct is sorted
    r = right.select(*on, F.col(ts).alias("_ts"), bucket.alias("_bucket"), payload.alias("_value")).where(F.col(ts).isNotNull())
    sign = -1 if forward else 1
    rows = left.select(*on, F.col(ts).alias("_ts"), bucket.alias("_bucket"), F.struct("*").alias("_row"))
    both = rows.withColumn("_value", F.lit(None).cast(r.schema["_value"].dataType)).unionByName(
        r.withColumn("_row", F.lit(None).cast(rows.schema["_row"].dataType))
    )
    tie = F.col("_row").isNotNull()
    order = [(F.col("_ts") * sign).asc(), tie.asc(), F.col("_value").asc()]
    inside = Window.partitionBy(*on, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_found", F.last("_value", ignorenulls=True).over(inside)).where("_row is not null")
    ends = r.groupBy(*on, "_bucket").agg((F.min if forward else F.max)("_value").alias("_end"))
    if forward and values:  # ties on the first time go to the larger values, as within a bucket
        first = r.groupBy(*on, "_bucket").agg(F.min("_ts").alias("_ts"))
        ends = r.join(first, [*on, "_bucket", "_ts"]).groupBy(*on, "_bucket").agg(F.max("_value").alias("_end"))
    marks = both.select(*on, "_bucket").distinct().withColumn("_end", F.lit(None).cast(r.schema["_value"].dataType))
    known = ends.unionByName(marks).groupBy(*on, "_bucket").agg(F.max("_end").alias("_end"))
    earlier = Window.partitionBy(*on).orderBy((F.col("_bucket") * sign).asc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = known.withColumn("_carried", F.last("_end", ignorenulls=True).over(earlier)).drop("_end")
    out = both.join(carried, [*on, "_bucket"], "left").withColumn("_found", F.coalesce("_found", "_carried"))
    if not values:
        return out.select("_row.*", F.col("_found").alias("asof_ts"))
    return out.select("_row.*", *(F.col(f"_found.{c}").alias(c) for c in ["asof_ts", *values]))


def effective_rule(facts: DataFrame, rules: DataFrame, on: str, ts: str = "ts", default: str = "default") -> DataFrame:
    """Facts with the rule in force: largest ``effective_from`` at or before the time and before ``effective_to``.

    ``rules`` has a few rows for each key; Spark broadcasts them while their size allows. Facts whose key has no rule get the rules
    of ``default``, one row. Facts need a unique ``id``.
    """
    of = rules.groupBy(on).agg(
        F.array_sort(F.collect_list(F.struct("effective_from", "effective_to", "rate", "exponent"))).alias("_rules")
    )
    rest = F.broadcast(of.where(F.col(on) == default).select(F.col(on).alias("_default"), F.col("_rules").alias("_rest")))
    out = facts.join(of, on, "left").withColumn("_default", F.lit(default)).join(rest, "_default", "left").drop("_default")

    def live(r: Column) -> Column:
        return (r["effective_from"] <= F.col(ts)) & (r["effective_to"].isNull() | (F.col(ts) < r["effective_to"]))

    out = out.withColumn("_in", F.filter(F.coalesce("_rules", "_rest"), live))
    rule = F.try_element_at("_in", F.lit(-1))
    return out.withColumns({"rate": rule["rate"], "exponent": rule["exponent"]}).drop("_rules", "_rest", "_in")


def interval_matches(
    a: DataFrame, b: DataFrame, on: list[str], width: float = 50.0, values: tuple[str, ...] = ()
) -> DataFrame:
    """Overlaps of the intervals [lo, hi) of two sides with equal keys: ``matched`` quantity and both sides' values.

    An interval is entered in every stretch of ``width`` that it touches, and two intervals meet in the stretch where the
    later one starts; so the join compares neighbours only and its work follows the overlaps, not the product of sides.
    """

    def spread(df: DataFrame, side: str) -> DataFrame:
        own = df.where("hi > lo").select(*on, *(F.col(c).alias(f"{side}_{c}") for c in ("id", "lo", "hi", *values)))
        cells = F.sequence(F.floor(F.col(f"{side}_lo") / width), F.floor(F.col(f"{side}_hi") / width))
        return own.withColumn("_cell", F.explode(cells))

    met = spread(a, "a").join(spread(b, "b"), [*on, "_cell"]).where("a_hi > b_lo and b_hi > a_lo")
    met = met.where(F.col("_cell") == F.floor(F.greatest("a_lo", "b_lo") / width))
    return met.withColumn("matched", F.least("a_hi", "b_hi") - F.greatest("a_lo", "b_lo")).drop("_cell")


def disjoint_matches(a: DataFrame, b: DataFrame, on: list[str], values: tuple[str, ...] = ()) -> DataFrame:
    """As ``interval_matches`` where the intervals of a side don't overlap each other, such as cumulative quantities.

    Two intervals meet where the later of them starts; there each side's interval is the last that has started. So one
    window over the starts of both sides finds all overlaps: the work follows the intervals, whatever their length.
    """

    def side(df: DataFrame, name: str, order: int) -> DataFrame:
        own = F.struct(*(F.col(c).alias(f"{name}_{c}") for c in ("id", "lo", "hi", *values)))
        return df.where("hi > lo").select(*on, F.col("lo").alias("_at"), F.lit(order).alias("_side"), own.alias(f"_{name}"))

    both = side(a, "a", 0).unionByName(side(b, "b", 1), allowMissingColumns=True)
    run = upto(on, "_at", "_side")
    met = both.select(*on, *(F.last(f"_{n}", ignorenulls=True).over(run).alias(f"_{n}") for n in "ab")).select(*on, "_a.*", "_b.*")
    met = met.where("a_hi > b_lo and b_hi > a_lo")
    return met.withColumn("matched", F.least("a_hi", "b_hi") - F.greatest("a_lo", "b_lo"))


def sessions(df: DataFrame, keys: list[str], gap: int, ts: str = "ts", tie: str = "id") -> DataFrame:
    """``df`` with ``session``: rows of a key no more than ``gap`` apart (inclusive) share a number."""
    order = _ordered(keys, ts, tie)
    starts = F.when(F.col(ts) - F.lag(ts).over(order) <= gap, 0).otherwise(1)
    return df.withColumn("_starts", starts).withColumn("session", F.sum("_starts").over(upto(keys, ts, tie))).drop("_starts")


def ranked_values(df: DataFrame, keys: list[str], value: str, qs: dict[str, float], half_even: bool = False) -> DataFrame:
    """For each key the value at index floor((n - 1) * q) of its sorted non-null values; no interpolation.

    With ``half_even`` the index is rounded, half to even. Values are counted before they are ordered, so a key's rows are
    never gathered; its distinct values are one window.
    """
    by_value = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    run, total = F.sum("_n").over(upto(keys, value)), F.sum("_n").over(Window.partitionBy(*keys))
    out = by_value.withColumns({"_run": run, "_total": total})

    def index(q: float) -> Column:
        place = (F.col("_total") - 1) * F.lit(q)
        return F.bround(place, 0) if half_even else F.floor(place)

    return out.groupBy(*keys).agg(*(F.min(F.when(F.col("_run") > index(q), F.col(value))).alias(n) for n, q in qs.items()))


def weighted_percentiles(df: DataFrame, keys: list[str], value: str, weight: str, qs: dict[str, float]) -> DataFrame:
    """Smallest value at which the running weight, by value, reaches each share of the key's total weight."""
    by_value = df.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    run = F.sum("_w").over(upto(keys, value))
    total = F.sum("_w").over(Window.partitionBy(*keys))
    out = by_value.withColumns({"_run": run, "_total": total})
    return out.groupBy(*keys).agg(
        *(F.min(F.when(F.round("_run", 6) >= F.round(F.col("_total") * q, 6), F.col(value))).alias(n) for n, q in qs.items())
    )


def tiered_match(left: DataFrame, right: DataFrame, tiers: list[Column], on: str, window_s: int) -> DataFrame:
    """For each left row the best right row within ``window_s`` seconds: lowest tier, nearest time, earliest (ts, id).

    ``tiers`` are conditions over columns ``l_*`` and ``r_*``, best first; the sides meet on ``on`` and on time cells of
    the window's width, so a left row sees three cells of its key only. Left rows without a match stay.
    """
    li = left.select(*(F.col(c).alias(f"l_{c}") for c in left.columns))
    ri = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns))
    li_cells = li.withColumn("_cell", F.explode(F.array(*(F.floor(F.col("l_ts") / window_s) + d for d in (-1, 0, 1)))))
    ri = ri.withColumn("_cell", F.floor(F.col("r_ts") / window_s))
    near = F.abs(F.col("l_ts") - F.col("r_ts")) <= window_s
    met = li_cells.join(ri, (F.col(f"l_{on}") == F.col(f"r_{on}")) & (li_cells["_cell"] == ri["_cell"]) & near)
    tier = F.lit(None).cast("int")
    for k in range(len(tiers) - 1, -1, -1):
        tier = F.when(tiers[k], k + 1).otherwise(tier)
    met = met.withColumn("tier", tier).where("tier is not null").withColumn("gap_s", F.abs(F.col("l_ts") - F.col("r_ts")))
    best = met.groupBy("l_id").agg(F.min(F.struct("tier", "gap_s", F.col("r_ts"), F.col("r_id"))).alias("_best"))
    return li.join(best, "l_id", "left").select(*li.columns, "_best.tier", "_best.gap_s", "_best.r_ts", "_best.r_id")
