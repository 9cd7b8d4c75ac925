"""Raw payloads to rows: activity, books, price histories, chain logs, marks and upserts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.plans import accounting as A
from tidemark.plans import matching as M
from tidemark.plans.views import CLOSED_TS, ledger, markets, r4, sql
from tidemark.sources import readers, sinks


def activity_parse(spark, sf_dir):
    """The ledger written as activity payloads, read back and normalised, by type and side."""
    e = ledger(spark, sf_dir)
    payload = F.to_json(F.struct(
        F.upper("wallet").alias("proxyWallet"), F.col("ts").alias("timestamp"), F.concat(F.lit("\\x"), F.lpad(F.hex(F.substring("condition_id", 2, 9).cast("long")), 8, "0")).alias("conditionId"),
        F.col("event_type").alias("type"), F.col("size").cast("string").alias("size"), F.round(F.abs("delta_usdc"), 4).cast("string").alias("usdcSize"), F.col("tx_hash").alias("transactionHash"),
        F.col("price").cast("string").alias("price"), F.coalesce("token_id", F.lit("")).alias("asset"), F.coalesce("side", F.lit("")).alias("side"), F.col("outcome_index").cast("int").alias("outcomeIndex"),
    ))
    raw = e.select(F.from_json(payload, readers.ACTIVITY).alias("j")).select("j.*")
    n = readers.normalise_activity(raw)
    return n.groupBy("event_type", "side").agg(
        F.count("*").alias("n"), F.countDistinct("dedupe_key").alias("n_keys"), F.count("token_id").alias("n_tokens"), F.countDistinct("condition_id").alias("n_conditions"),
        r4(F.sum("delta_shares").cast("double"), "shares"), r4(F.sum("delta_usdc").cast("double"), "usdc"),
    )


def books_parse(spark, sf_dir):
    """Books written as JSON with levels in any order, read back with best prices, depth and imbalance."""
    b = M.books(spark, sf_dir).where("best_bid > 0")

    def level(p, s):
        return F.struct(F.round(p, 4).cast("string").alias("price"), F.lit(str(s)).alias("size"))

    payload = F.to_json(F.struct(
        F.array(level(F.col("best_bid") - 0.02, 30), level(F.col("best_bid"), 10), level(F.col("best_bid") - 0.01, 20)).alias("bids"),
        F.array(level(F.col("best_ask") + 0.01, 15), level(F.col("best_ask"), 5)).alias("asks"),
    ))
    p = readers.parse_books(b.select("token_id", "ts", payload.alias("payload")))
    return p.groupBy("token_id").agg(F.count("*").alias("n"), r4(F.sum("mid"), "mids"), r4(F.sum("spread"), "spreads"), r4(F.sum("bid_depth_top5"), "bid_depth"), r4(F.avg("imbalance"), "imbalance"), F.sum(F.size("bids")).alias("n_levels"))


def evm_log_decode(spark, sf_dir):
    """Trades written as chain logs of both layouts (256-bit words), and some of neither, decoded again by their first topic."""
    t = ledger(spark, sf_dir).where("event_type = 'TRADE'")

    def word(c):
        return F.lpad(F.hex(c), 64, "0")

    zero = F.lit(0)
    token = F.substring("token_id", 2, 9).cast("long") + 1
    usdc, shares = F.round(F.abs("delta_usdc") * 1_000_000).cast("long"), F.round(F.col("size") * 1_000_000).cast("long")
    buys = F.col("side") == "BUY"
    amounts = [F.when(buys, usdc).otherwise(shares), F.when(buys, shares).otherwise(usdc), zero]
    one = F.concat(F.lit("0x"), word(F.when(buys, zero).otherwise(token)), word(F.when(buys, token).otherwise(zero)), *map(word, amounts))
    two = F.concat(F.lit("0x"), word(F.when(buys, 0).otherwise(1)), word(token), *map(word, amounts), word(zero), word(zero))
    address = F.concat(F.lit("0x"), F.lpad(F.hex(F.substring("wallet", 2, 9).cast("long")), 64, "0"))
    kind = F.col("id") % 10
    name = F.when(kind < 5, readers.FILL_V1).when(kind < 9, readers.FILL_V2).otherwise("Transfer(address,address,uint256)")
    names = t.select(name.alias("name")).distinct().withColumn("topic", readers.keccak_hex("name"))
    logs = t.withColumn("name", name).join(F.broadcast(names), "name")  # three rows
    logs = logs.select("id", F.array(F.col("topic"), F.concat(F.lit("0x"), word(F.col("id"))), address, address).alias("topics"), F.when(kind < 5, one).otherwise(two).alias("data"))
    d = readers.decode_order_filled(logs)
    assets = [F.col("maker_asset_id"), F.col("taker_asset_id")]
    paid = [F.col("maker_amount"), F.col("taker_amount")]
    d = d.withColumns({"token": scalars.traded_token(*assets), "shares": scalars.traded_amount(assets[0], *paid), "usdc": scalars.collateral_amount(*assets, *paid)})
    return d.groupBy("layout", F.col("token").alias("asset_id"), "maker").agg(F.count("*").alias("n"), r4(F.sum("usdc"), "usdc"), r4(F.sum("shares"), "shares"))


def positions_parse(spark, sf_dir):
    """Positions written as a venue's JSON pages, read back: sizes, prices and the portfolio's value."""
    held = A.latest(A.positions(spark, sf_dir)).where("qty > 1e-6")
    k = F.substring("token_id", 2, 9).cast("long")
    row = F.struct(
        F.when(k % 6 != 5, F.col("token_id")).alias("asset"), F.upper("condition_id").alias("conditionId"), F.round("qty", 4).cast("string").alias("size"),
        F.when(k % 4 != 3, F.round(F.col("cost") / F.col("qty"), 4).cast("string")).alias("avgPrice"), F.lit("0.5").alias("curPrice"), F.lit("bad").alias("currentValue"),
    )
    pages = held.groupBy("wallet", (k % 3).alias("page")).agg(F.to_json(F.collect_list(row)).alias("payload"))
    p = readers.parse_positions(pages)
    value = F.concat(F.lit('[{"totalValue": '), F.col("n"), F.lit('}, {"value": "7.5", "currentValue": 3}, "bad"]'))
    return p.groupBy("wallet").agg(
        F.count("*").alias("n"), r4(F.sum("size").cast("double"), "size"), F.count_if("has_avg_price").alias("n_avg_price"), r4(F.sum("avg_price").cast("double"), "avg_price"), r4(F.sum("current_value").cast("double"), "current_value"),
    ).select("*", readers.parse_value(value).cast("double").alias("stated_value"))


def block_lookup(spark, sf_dir):
    """The first block (ids that divide by ten) at or after each of four times."""
    blocks = ledger(spark, sf_dir).where("id % 10 = 0").select(F.col("id").alias("number"), "ts")
    asked = spark.range(4).select("id", (F.lit(1704067200) + F.col("id") * 604800).alias("ts"))
    after = asked.withColumnRenamed("ts", "asked_ts").join(blocks, F.col("ts") >= F.col("asked_ts"))  # four rows on one side
    return after.groupBy("asked_ts").agg(F.min_by("number", F.struct("ts", "number")).alias("number"), F.min("ts").alias("block_ts"))


def marks(spark, sf_dir):
    """Mark of every held token at the end: outcome, else fresh book, else last trade as stale, else old book."""
    at = CLOSED_TS + 9 * 86400
    held = A.latest(A.positions(spark, sf_dir)).where("qty > 1e-6").select("wallet", "token_id")
    book = M.books(spark, sf_dir).groupBy("token_id").agg(F.max(F.struct("ts", "mid")).alias("b"))
    trade = ledger(spark, sf_dir).where("event_type = 'TRADE'").groupBy("token_id").agg(F.max_by("price", F.struct("ts", "id")).alias("t"))
    j = held.join(book, "token_id", "left").join(trade, "token_id", "left").join(A.token_prices(spark), "token_id", "left")
    fresh = F.col("b.ts") >= at - 86400
    source = F.when(F.col("res_price").isNotNull(), "resolution").when(fresh, "book").when(F.col("t").isNotNull(), "trade").when(F.col("b").isNotNull(), "old_book").otherwise("none")
    value = F.when(source == "resolution", F.col("res_price")).when(source == "book", F.col("b.mid")).when(source == "trade", F.col("t")).otherwise(F.col("b.mid"))
    return j.select("wallet", "token_id", source.alias("source"), r4(value, "mark"), source.isin("trade", "old_book").alias("stale"))


def upsert_markets(spark, sf_dir):
    """Two versions of each market: the later wins, and a category that the later lacks is kept."""
    m = markets(spark).select("condition_id", "question", "category", "closed")
    old = m.withColumns({"closed": F.lit(False), "updated_at": F.lit(1)})
    new = m.withColumns({"category": F.when(F.col("closed"), F.col("category")), "updated_at": F.lit(2)})
    return sinks.latest(old.unionByName(new), ["condition_id"], "updated_at", ("category",)).select("condition_id", "category", "closed", F.col("updated_at").cast("long").alias("updated_at"))


def incremental_append(spark, sf_dir):
    """Insert-ignore of overlapping pages: the union of two page ranges holds every event once."""
    e = ledger(spark, sf_dir).select("id", "wallet", "ts")
    first, again = e.where("id < 3000"), e.where("id >= 2500")
    new = again.join(first.select("id"), "id", "left_anti")
    both = first.unionByName(new)
    return both.groupBy("wallet").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))


def cashflow_by_day(spark, sf_dir):
    e = ledger(spark, sf_dir)
    kind = F.when(F.col("event_type") == "TRADE", F.concat(F.lit("trade_"), F.lower("side"))).otherwise(F.lower("event_type"))
    g = e.groupBy(scalars.day_of(F.col("ts")).alias("day"), kind.alias("kind")).agg(F.count("*").alias("n"), F.sum("delta_usdc").alias("u"))
    return g.select("day", "kind", "n", r4("u", "usdc"), r4(F.sum("u").over(Window.partitionBy("kind").orderBy("day")), "running"))


QUERIES = {f.__name__: f for f in (activity_parse, books_parse, evm_log_decode, positions_parse, block_lookup, marks, upsert_markets, incremental_append, cashflow_by_day)}
ORACLE = {
    "activity_parse": sql("SELECT event_type, side, count(*) AS n, count(*) AS n_keys, count(token_id) AS n_tokens, count(DISTINCT condition_id) AS n_conditions, round(sum(delta_shares), 4) + 0 AS shares, round(sum(round(delta_usdc, 4)), 4) + 0 AS usdc FROM ledger GROUP BY 1, 2"),
    "books_parse": sql("SELECT token_id, count(*) AS n, round(sum(mid), 4) AS mids, round(sum(best_ask - best_bid), 4) AS spreads, count(*) * 60.0::DOUBLE AS bid_depth, round(40 / 80, 4) AS imbalance, count(*) * 3 AS n_levels FROM books WHERE best_bid > 0 GROUP BY 1", M._BOOKS),
    "evm_log_decode": sql("""SELECT layout, CASE WHEN layout IS NOT NULL THEN (substr(token_id, 2)::BIGINT + 1)::VARCHAR END AS asset_id, CASE WHEN layout IS NOT NULL THEN '0x' || repeat('0', 39) || substr(wallet, 2) END AS maker, count(*) AS n,
CASE WHEN layout IS NOT NULL THEN round(sum(abs(delta_usdc)), 4) END AS usdc, CASE WHEN layout IS NOT NULL THEN round(sum(size), 4) END AS shares FROM (SELECT *, CASE WHEN id % 10 < 5 THEN 1 WHEN id % 10 < 9 THEN 2 END AS layout FROM ledger WHERE event_type = 'TRADE') GROUP BY layout, CASE WHEN layout IS NOT NULL THEN token_id END, CASE WHEN layout IS NOT NULL THEN wallet END, asset_id, maker""".replace(", asset_id, maker", ", 2, 3")),
    "positions_parse": sql("""SELECT wallet, count(*) AS n, round(sum(round(qty, 4)), 4) + 0 AS size, count(*) FILTER (k % 4 <> 3) AS n_avg_price, round(coalesce(sum(round(cost / qty, 4)) FILTER (k % 4 <> 3), 0), 4) + 0 AS avg_price, 0.0::DOUBLE AS current_value, count(*) + 7.5::DOUBLE AS stated_value
FROM (SELECT *, substr(token_id, 2)::BIGINT AS k FROM last WHERE qty > 1e-6) WHERE k % 6 <> 5 GROUP BY 1""", A.POSITIONS, A._LAST),
    "block_lookup": sql("SELECT 1704067200 + r * 604800 AS asked_ts, arg_min(id, (ts, id)) AS number, min(ts) AS block_ts FROM range(4) g(r) JOIN ledger ON id % 10 = 0 AND ts >= 1704067200 + r * 604800 GROUP BY 1"),
    "marks": sql(f"""SELECT wallet, token_id, source, round(CASE source WHEN 'resolution' THEN res_price WHEN 'trade' THEN px ELSE mid END, 4) + 0 AS mark, source IN ('trade', 'old_book') AS stale FROM (SELECT *, CASE WHEN res_price IS NOT NULL THEN 'resolution' WHEN b_ts >= {CLOSED_TS + 8 * 86400} THEN 'book' WHEN px IS NOT NULL THEN 'trade' WHEN mid IS NOT NULL THEN 'old_book' ELSE 'none' END AS source
FROM (SELECT wallet, token_id FROM last WHERE qty > 1e-6) h LEFT JOIN (SELECT token_id, max(ts) AS b_ts, arg_max(mid, (ts, mid)) AS mid FROM books GROUP BY 1) b USING (token_id) LEFT JOIN (SELECT token_id, arg_max(price, (ts, id)) AS px FROM ledger WHERE event_type = 'TRADE' GROUP BY 1) t USING (token_id) LEFT JOIN prices USING (token_id))""", A.POSITIONS, A._LAST, A._PRICES, M._BOOKS),
    "upsert_markets": sql("SELECT condition_id, category, closed, 2::BIGINT AS updated_at FROM markets"),
    "incremental_append": sql("SELECT wallet, count(*) AS n, max(ts) AS last_ts FROM ledger GROUP BY 1"),
    "cashflow_by_day": sql("SELECT day, kind, n, round(u, 4) + 0 AS usdc, round(sum(u) OVER (PARTITION BY kind ORDER BY day), 4) + 0 AS running FROM (SELECT strftime(make_timestamp(ts * 1000000), '%Y-%m-%d') AS day, CASE WHEN event_type = 'TRADE' THEN 'trade_' || lower(side) ELSE lower(event_type) END AS kind, count(*) AS n, sum(delta_usdc) AS u FROM ledger GROUP BY 1, 2)"),
}
