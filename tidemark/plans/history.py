"""Marks from price histories: the last point at or before a time, stale after a day, and their place among other marks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import ordered as O
from tidemark.operators.storage import stored
from tidemark.plans import accounting as A
from tidemark.plans import matching as M
from tidemark.plans.views import ledger, r4, sql
from tidemark.sources import readers

STALE_S = 86_400
FIDELITY_S = 3_600


def history_marks_of(asked: DataFrame, points: DataFrame, stale_s: int = STALE_S) -> DataFrame:
    """``asked`` (unique ``id``, ``token_id``, ``ts``) with ``mark, mark_age_s, stale``: the last of ``points`` (``token_id, ts, price``) at or
    before its time, stale if older than ``stale_s``. Without one all three are null; of points of one time the dearer counts."""
    at = O.asof_backward(asked, points, ["token_id"], ["price"])
    age = F.col("ts") - F.col("asof_ts")
    return at.select(*asked.columns, F.col("price").alias("mark"), age.alias("mark_age_s"), (age > stale_s).alias("stale"))


def landed_histories(spark, sf_dir) -> DataFrame:
    """Price histories as they are fetched: a payload for each token and day, a point for each hour with trades, at its end."""
    t = ledger(spark, sf_dir).where("event_type = 'TRADE'")
    end = (F.floor(F.col("ts") / FIDELITY_S) + 1) * FIDELITY_S
    hours = t.groupBy("token_id", end.alias("t")).agg(F.max_by("price", F.struct("ts", "id")).alias("p"))
    page = hours.groupBy("token_id", F.floor(F.col("t") / 86_400).alias("day")).agg(F.collect_list(F.struct("t", "p")).alias("history"))  # at most 24 points
    return page.select("token_id", F.to_json(F.struct("history")).alias("payload"))


def history_points(spark, sf_dir) -> DataFrame:
    return readers.parse_history(landed_histories(spark, sf_dir))


def history_marks(spark, sf_dir):
    """What the price history says of each fill's token at the time of the fill."""
    f = M.fills(spark, sf_dir).select("id", "token_id", "ts")
    return history_marks_of(f, history_points(spark, sf_dir)).select("id", "mark", "mark_age_s", "stale")


def day_end_marks(spark, sf_dir):
    """Marks of every token at the end of each day after its first trade: the outcome once the market has closed, else a book of the last
    day, else the price history (stale or not), else the last trade, which is always stale."""
    e = stored(ledger(spark, sf_dir).where("event_type = 'TRADE'").select("id", "token_id", "ts", "price"))
    days = e.agg((F.floor(F.max("ts") / 86_400)).alias("last"))
    seen = e.groupBy("token_id").agg(F.floor(F.min("ts") / 86_400).alias("first")).join(F.broadcast(days))  # one row
    asked = seen.select("token_id", F.explode(F.sequence("first", "last")).alias("day")).select("token_id", ((F.col("day") + 1) * 86_400).alias("ts"))
    asked = stored(asked.withColumn("id", F.concat_ws("@", "token_id", "ts")))
    history = history_marks_of(asked, history_points(spark, sf_dir)).withColumnRenamed("stale", "history_stale")
    book = O.asof_backward(asked, M.books(spark, sf_dir), ["token_id"], ["mid"]).select("id", "mid", F.col("asof_ts").alias("book_ts"))
    trade = O.asof_backward(asked, e.select("token_id", "ts", F.struct(F.col("id").alias("nth"), "price").alias("last")), ["token_id"], ["last"]).select("id", "last.price", F.col("asof_ts").alias("trade_ts"))
    j = history.join(book, "id").join(trade, "id").join(A.token_prices(spark), "token_id", "left")
    fresh = F.col("ts") - F.col("book_ts") <= STALE_S
    source = F.when(F.col("res_price").isNotNull() & (F.col("ts") >= F.col("closed_ts")), "resolution").when(fresh, "book").when(F.col("mark").isNotNull(), "history").when(F.col("price").isNotNull(), "trade").otherwise("none")
    value = F.when(source == "resolution", F.col("res_price")).when(source == "book", F.col("mid")).when(source == "history", F.col("mark")).otherwise(F.col("price"))
    age = F.when(source == "resolution", 0).when(source == "book", F.col("ts") - F.col("book_ts")).when(source == "history", F.col("mark_age_s")).otherwise(F.col("ts") - F.col("trade_ts"))
    stale = F.when(source == "history", F.col("history_stale")).otherwise(source == "trade")
    return j.select("token_id", F.floor((F.col("ts") - 1) / 86_400).alias("day"), source.alias("source"), r4(value, "mark"), age.cast("long").alias("mark_age_s"), stale.alias("stale"))


QUERIES = {f.__name__: f for f in (history_marks, day_end_marks)}

_POINTS = """
pts AS (SELECT token_id, (ts // 3600 + 1) * 3600 AS t, arg_max(price, (ts, id)) AS p FROM ledger WHERE event_type = 'TRADE' GROUP BY 1, 2)"""
_DAYS = """
dt AS (SELECT token_id, (unnest(range(first, last + 1)) + 1) * 86400 AS until FROM (SELECT token_id, min(ts) // 86400 AS first FROM ledger WHERE event_type = 'TRADE' GROUP BY 1), (SELECT max(ts) // 86400 AS last FROM ledger WHERE event_type = 'TRADE')),
lt AS (SELECT token_id, ts, arg_max(price, id) AS price FROM ledger WHERE event_type = 'TRADE' GROUP BY 1, 2),
dm AS (SELECT d.token_id, d.until, h.t AS h_ts, h.p AS h_price, b.ts AS b_ts, b.mid, l.ts AS l_ts, l.price AS l_price FROM dt d ASOF LEFT JOIN pts h ON d.token_id = h.token_id AND d.until >= h.t ASOF LEFT JOIN one_book b ON d.token_id = b.token_id AND d.until >= b.ts ASOF LEFT JOIN lt l ON d.token_id = l.token_id AND d.until >= l.ts),
dp AS (SELECT dm.*, CASE WHEN t.outcome_index = 0 THEN m.price0 ELSE 1 - m.price0 END AS res, m.closed_ts FROM dm LEFT JOIN tokens t USING (token_id) LEFT JOIN markets m ON m.condition_id = t.condition_id AND m.closed),
ds AS (SELECT *, CASE WHEN res IS NOT NULL AND until >= closed_ts THEN 'resolution' WHEN until - b_ts <= 86400 THEN 'book' WHEN h_price IS NOT NULL THEN 'history' WHEN l_price IS NOT NULL THEN 'trade' ELSE 'none' END AS source FROM dp)"""
ORACLE = {
    "history_marks": sql("SELECT f.id, h.p AS mark, f.ts - h.t AS mark_age_s, f.ts - h.t > 86400 AS stale FROM fills f ASOF LEFT JOIN pts h ON f.token_id = h.token_id AND f.ts >= h.t", M._BOOKS, _POINTS),
    "day_end_marks": sql("""SELECT token_id, (until - 1) // 86400 AS day, source, round(CASE source WHEN 'resolution' THEN res WHEN 'book' THEN mid WHEN 'history' THEN h_price ELSE l_price END, 4) + 0 AS mark,
CASE source WHEN 'resolution' THEN 0 WHEN 'book' THEN until - b_ts WHEN 'history' THEN until - h_ts ELSE until - l_ts END AS mark_age_s, CASE source WHEN 'history' THEN until - h_ts > 86400 ELSE source = 'trade' END AS stale FROM ds""", M._BOOKS, _POINTS, _DAYS),
}
