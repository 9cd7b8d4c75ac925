"""Grouped summaries of fills with their edge to the book, markets by positive edge, and the markets whose metadata must be read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import ordered as O
from tidemark.plans import behaviour as B
from tidemark.plans import matching as M
from tidemark.plans.views import ledger, markets, r4, sql, tokens

STRICT_S = 360  # books of less than six minutes are excellent or good


def _near(c, name: str, places: int = 4):
    """Rounded; a little more keeps means that are ties in the last digit from falling either way."""
    return (F.round(c + 1e-9, places) + 0.0).alias(name)


def to_refresh(events: DataFrame, markets: DataFrame, tokens: DataFrame) -> DataFrame:
    """``condition_id, why`` of the conditions in ``events`` whose metadata must be read (again): the market is ``missing``, has no tokens
    (``no_tokens``), is ``open``, or is closed without a price (``unresolved``). ``price0`` is the market's price, ``closed`` may be null
    (open). Null and empty ids take no part; ids count in lower case."""
    own = F.lower("condition_id").alias("condition_id")
    seen = events.where("condition_id is not null and condition_id != ''").select(own).distinct()
    known = markets.select(own, F.coalesce("closed", F.lit(False)).alias("closed"), F.col("price0").isNotNull().alias("priced"), F.lit(True).alias("known"))
    with_tokens = tokens.select(own).distinct().withColumn("tokens", F.lit(True))
    j = seen.join(known, "condition_id", "left").join(with_tokens, "condition_id", "left")
    why = F.when(F.col("known").isNull(), "missing").when(F.col("tokens").isNull(), "no_tokens").when(~F.col("closed"), "open").when(~F.col("priced"), "unresolved")
    return j.select("condition_id", why.alias("why")).where("why is not null")


def markets_to_refresh(spark, sf_dir):
    """The refresh rule over the ledger; of the closed markets every eighth has no price yet."""
    m = markets(spark).withColumn("price0", F.when(F.col("condition_id") != "c8", F.col("price0")))
    return to_refresh(ledger(spark, sf_dir), m, tokens(spark).where("condition_id != 'c6'"))


def top_positive_edge(spark, sf_dir, top: int = 50):
    """For each wallet the ``top`` markets by the positive edge of their complete sets, with their share of the wallet's positive edge and
    the share of all up to them. Equal edges are in order of the market's id."""
    m = M.fifo_matches(spark, sf_dir)
    pair = F.round(1 - F.col("a_price") - F.col("b_price"), 6)
    g = m.groupBy("wallet", "condition_id").agg(
        F.sum("matched").alias("matched"), F.round(F.sum("edge"), 4).alias("net"), F.sum(F.when(pair > 0, F.col("matched")).otherwise(0.0)).alias("up"), F.avg("gap_s").alias("gap")
    )
    g = g.withColumn("gain", F.greatest("net", F.lit(0.0)))
    order = Window.partitionBy("wallet").orderBy(F.desc("gain"), "condition_id")  # one row a market
    g = g.withColumns({"edge_rank": F.row_number().over(order), "run": F.sum("gain").over(order.rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("gain").over(Window.partitionBy("wallet"))})
    g = g.where(F.col("edge_rank") <= top).join(markets(spark).select("condition_id", "question"), "condition_id", "left")

    def share(c: str, name: str):
        return _near(F.try_divide(c, F.nullif(F.col("all"), F.lit(0.0))) * 100, name, 2)

    return g.select(
        "wallet", "edge_rank", "condition_id", F.coalesce("question", F.lit("[missing question]")).alias("question"), r4("matched", "matched_sets"), r4("net", "net_edge"), r4("gain", "positive_edge"),
        _near(F.col("net") / F.col("matched") * 100, "edge_cents"), _near(F.col("up") / F.col("matched") * 100, "pct_qty_positive_edge", 2), _near(F.col("gap") / 60, "avg_leg_gap_min", 2),
        share("gain", "edge_share_pct"), share("run", "cumulative_edge_share_pct"),
    )


def fills_with_edge(spark, sf_dir) -> DataFrame:
    """Fills with role and side, the middle of the last book before them, and the edge of the fill to it."""
    f = B.trades(spark, sf_dir).where("not (side = 'BUY' and id % 3 = 0)")
    at = O.asof_backward(f.select("id", "token_id", "ts"), M.books(spark, sf_dir), ["token_id"], ["mid"])
    at = at.select("id", "mid", (F.col("ts") - F.col("asof_ts")).alias("age_s"))
    edge = F.when(F.col("side") == "BUY", F.col("mid") - F.col("price")).otherwise(F.col("price") - F.col("mid"))
    return f.join(at, "id").withColumns({"notional": F.col("size") * F.col("price"), "edge": F.round(edge, 6) * F.col("size"), "strict": F.coalesce(F.col("age_s") < STRICT_S, F.lit(False))})


def summary(d: DataFrame, *keys: str) -> DataFrame:
    """Counts, notional, edge, plain and weighted mean prices and shares of fills with a positive edge or a fresh book, by ``keys``.

    Fills without a book count as fills without edge; means and edges are null where no fill of the group has one.
    """
    n = F.count("*")
    zero = F.lit(0.0)
    return d.groupBy(*keys).agg(
        n.alias("fills"), _near(F.sum("notional"), "notional", 2), _near(F.sum("edge"), "estimated_edge", 2), _near(F.try_divide(F.sum("edge"), F.nullif(F.sum("notional"), zero)) * 10_000, "edge_bps", 2),
        _near(F.sum("edge") / n, "avg_edge_per_fill", 2), _near(F.avg("price"), "avg_fill_price"), _near(F.try_divide(F.sum("notional"), F.nullif(F.sum("size"), zero)), "weighted_fill_price"), _near(F.avg("mid"), "avg_mid_before"),
        _near(F.count_if(F.col("edge") > 0) / n * 100, "positive_edge_share", 2), _near(F.count_if("strict") / n * 100, "strict_context_share", 2),
    )


def role_side_summary(spark, sf_dir):
    d = fills_with_edge(spark, sf_dir).withColumn("role", F.coalesce("role", F.lit("unenriched")))
    return summary(d, "wallet", "role", "side")


def question_outcome_summary(spark, sf_dir):
    d = fills_with_edge(spark, sf_dir).join(markets(spark).select("condition_id", "question"), "condition_id", "left")
    return summary(d.withColumn("question", F.coalesce("question", F.lit("[missing question]"))), "question", "outcome_index")


QUERIES = {f.__name__: f for f in (markets_to_refresh, top_positive_edge, role_side_summary, question_outcome_summary)}

_EDGES = """
fe AS (SELECT *, round(CASE WHEN side = 'BUY' THEN mid - price ELSE price - mid END, 6) * size AS edge, size * price AS notional, coalesce(ts - book_ts < 360, false) AS strict
   FROM (SELECT f.*, b.mid, b.ts AS book_ts FROM (SELECT * FROM trades WHERE NOT (side = 'BUY' AND id % 3 = 0)) f ASOF LEFT JOIN one_book b ON f.token_id = b.token_id AND f.ts >= b.ts))"""
_SUMS = """count(*) AS fills, round(sum(notional) + 1e-9, 2) + 0 AS notional, round(sum(edge) + 1e-9, 2) + 0 AS estimated_edge, round(sum(edge) / nullif(sum(notional), 0) * 10000 + 1e-9, 2) + 0 AS edge_bps, round(sum(edge) / count(*) + 1e-9, 2) + 0 AS avg_edge_per_fill,
round(avg(price) + 1e-9, 4) + 0 AS avg_fill_price, round(sum(notional) / nullif(sum(size), 0) + 1e-9, 4) + 0 AS weighted_fill_price, round(avg(mid) + 1e-9, 4) + 0 AS avg_mid_before, round(count(*) FILTER (edge > 0) / count(*) * 100 + 1e-9, 2) + 0 AS positive_edge_share, round(count(*) FILTER (strict) / count(*) * 100 + 1e-9, 2) + 0 AS strict_context_share"""
ORACLE = {
    "markets_to_refresh": sql("""SELECT condition_id, why FROM (SELECT condition_id, CASE WHEN m.closed IS NULL THEN 'missing' WHEN NOT EXISTS (SELECT 1 FROM tokens t WHERE t.condition_id = s.condition_id AND t.condition_id <> 'c6') THEN 'no_tokens' WHEN NOT m.closed THEN 'open' WHEN m.price0 IS NULL OR condition_id = 'c8' THEN 'unresolved' END AS why
FROM (SELECT DISTINCT condition_id FROM ledger WHERE condition_id IS NOT NULL) s LEFT JOIN markets m USING (condition_id)) WHERE why IS NOT NULL"""),
    "top_positive_edge": sql("""SELECT wallet, edge_rank, condition_id, coalesce(question, '[missing question]') AS question, round(matched, 4) + 0 AS matched_sets, round(net, 4) + 0 AS net_edge, round(gain, 4) + 0 AS positive_edge, round(net / matched * 100 + 1e-9, 4) + 0 AS edge_cents, round(up / matched * 100 + 1e-9, 2) + 0 AS pct_qty_positive_edge,
round(gap / 60 + 1e-9, 2) + 0 AS avg_leg_gap_min, round(gain / nullif(total, 0) * 100 + 1e-9, 2) + 0 AS edge_share_pct, round(run / nullif(total, 0) * 100 + 1e-9, 2) + 0 AS cumulative_edge_share_pct
FROM (SELECT *, row_number() OVER w AS edge_rank, sum(gain) OVER (w ROWS UNBOUNDED PRECEDING) AS run, sum(gain) OVER (PARTITION BY wallet) AS total FROM
 (SELECT *, greatest(net, 0) AS gain FROM (SELECT wallet, condition_id, sum(matched) AS matched, round(sum(edge), 4) AS net, sum(CASE WHEN round(1 - p0 - p1, 6) > 0 THEN matched ELSE 0 END) AS up, avg(gap_s) AS gap FROM matches GROUP BY 1, 2)) WINDOW w AS (PARTITION BY wallet ORDER BY gain DESC, condition_id))
LEFT JOIN (SELECT condition_id, question FROM markets) USING (condition_id) WHERE edge_rank <= 50""", M._fifo()),
    "role_side_summary": sql(f"SELECT wallet, coalesce(role, 'unenriched') AS role, side, {_SUMS} FROM (SELECT * REPLACE (coalesce(role, 'unenriched') AS role) FROM fe) GROUP BY wallet, role, side", M._BOOKS, B._FEES, _EDGES),
    "question_outcome_summary": sql(f"SELECT question, outcome_index, {_SUMS} FROM (SELECT fe.*, coalesce(m.question, '[missing question]') AS question FROM fe LEFT JOIN markets m USING (condition_id)) GROUP BY question, outcome_index", M._BOOKS, B._FEES, _EDGES),
}
