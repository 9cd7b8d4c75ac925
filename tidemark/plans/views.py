"""The trading ledger and its dimensions as views over the event stream, the same in Spark and in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY0 = 19723  # 2024-01-01 as a number of days
CLOSED_TS = 1704067200 + 20 * 86400

#: Common table expressions that every SQL check starts from.
VIEWS = """
raw AS (SELECT event_id AS id, event_type AS et, user_id, floor(epoch(ts))::BIGINT AS ts, round(value, 2) AS size,
        regexp_extract(props, '"k": ?([0-9]+)', 1)::BIGINT AS k FROM events),
ledger AS (SELECT id, 'w' || (user_id % 10) AS wallet, ts, 'x' || (id // 3) AS tx_hash,
        CASE WHEN et IN ('purchase', 'view', 'click') THEN 'TRADE' WHEN et = 'error' THEN 'MERGE' WHEN id % 3 = 0 THEN 'REDEEM' WHEN id % 3 = 1 THEN 'SPLIT' ELSE 'REWARD' END AS event_type,
        CASE WHEN et IN ('purchase', 'view') THEN 'BUY' WHEN et = 'click' THEN 'SELL' END AS side,
        'c' || ((k // 2) % 10) AS condition_id, k % 2 AS outcome_index,
        CASE WHEN et IN ('purchase', 'view', 'click') THEN 't' || (((k // 2) % 10) * 2 + k % 2) END AS token_id,
        size, CASE WHEN et IN ('purchase', 'view', 'click') THEN ((id * 37) % 98 + 1) / 100.0::DOUBLE END AS price,
        CASE WHEN et IN ('purchase', 'view', 'signup') AND NOT (et = 'signup' AND id % 3 <> 1) THEN size WHEN et = 'signup' AND id % 3 = 2 THEN 0 ELSE -size END AS delta_shares,
        CASE WHEN et IN ('purchase', 'view') THEN -size * (((id * 37) % 98 + 1) / 100.0::DOUBLE) WHEN et = 'click' THEN size * (((id * 37) % 98 + 1) / 100.0::DOUBLE)
             WHEN et = 'error' THEN size WHEN id % 3 = 0 THEN CASE WHEN id % 2 = 0 THEN 0 ELSE size END WHEN id % 3 = 1 THEN -size ELSE size * 0.01 END AS delta_usdc FROM raw),
markets AS (SELECT 'c' || c AS condition_id, 'Will  Market ' || c || ' resolve ' || CASE WHEN c % 3 = 0 THEN 'World Cup' ELSE 'Yes' END AS question,
        CASE c % 4 WHEN 0 THEN 'sports' WHEN 1 THEN 'politics' WHEN 2 THEN 'crypto' ELSE 'unclassified' END AS category,
        'e' || (c // 3) AS event_id, c // 3 = 1 AS neg_risk, c % 2 = 0 AS closed, CASE WHEN c % 2 = 0 THEN CASE WHEN c % 4 = 0 THEN 1.0 ELSE 0.0 END END::DOUBLE AS price0,
        1705795200 + c * 3600 AS closed_ts FROM range(9) r(c)),
tokens AS (SELECT 't' || t AS token_id, 'c' || (t // 2) AS condition_id, t % 2 AS outcome_index FROM range(19) r(t)),
moves AS (SELECT l.id, l.wallet, l.ts, l.condition_id, l.event_type, coalesce(l.token_id, t.token_id) AS token_id,
        CASE WHEN l.event_type = 'SPLIT' OR l.side = 'BUY' THEN 'add' WHEN l.event_type = 'REDEEM' THEN 'reset' ELSE 'remove' END AS kind,
        l.size AS shares, CASE WHEN l.event_type = 'TRADE' THEN l.size * l.price ELSE abs(l.delta_usdc) / 2 END AS usdc
        FROM ledger l LEFT JOIN tokens t ON l.token_id IS NULL AND t.condition_id = l.condition_id
        WHERE l.event_type <> 'REWARD' AND coalesce(l.token_id, t.token_id) IS NOT NULL)"""

_KEY = "PARTITION BY wallet, token_id ORDER BY ts, id"
#: Running quantity and cost of every (wallet, token), as ``running_positions`` has them.
POSITIONS = f"""
p1 AS (SELECT *, sum(CASE kind WHEN 'reset' THEN 1 ELSE 0 END) OVER ({_KEY} ROWS UNBOUNDED PRECEDING) AS seg FROM moves),
p2 AS (SELECT *, round(sum(CASE kind WHEN 'add' THEN shares WHEN 'remove' THEN -shares ELSE 0 END) OVER (PARTITION BY wallet, token_id, seg ORDER BY ts, id ROWS UNBOUNDED PRECEDING), 8) AS qty FROM p1),
p3 AS (SELECT *, coalesce(lag(qty) OVER ({_KEY}), 0) AS qty_before FROM p2),
p4 AS (SELECT *, CASE WHEN kind = 'add' THEN 1.0 WHEN kind = 'remove' AND qty_before > 0 AND qty > 1e-6 THEN qty / qty_before ELSE 0.0 END::DOUBLE AS a FROM p3),
p5 AS (SELECT *, sum(CASE WHEN a = 0 THEN 1 ELSE 0 END) OVER ({_KEY} ROWS UNBOUNDED PRECEDING) AS g FROM p4),
p6 AS (SELECT *, sum(CASE WHEN a > 0 THEN ln(a) ELSE 0 END) OVER (PARTITION BY wallet, token_id, g ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS lp FROM p5),
p6b AS (SELECT *, floor(-lp / 300) AS b, lp + floor(-lp / 300) * 300 AS l FROM p6),
p6c AS (SELECT *, exp(l) * sum(CASE WHEN kind = 'add' THEN usdc ELSE 0 END * exp(-l)) OVER (PARTITION BY wallet, token_id, g, b ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS own FROM p6b),
p6d AS (SELECT *, lag(lp) OVER h AS plp, lag(own) OVER h AS pown FROM p6c WINDOW h AS (PARTITION BY wallet, token_id, g ORDER BY ts, id)),
p7 AS (SELECT *, own + coalesce(first_value(pown) OVER h * exp(lp - first_value(plp) OVER h), 0) AS cost FROM p6d WINDOW h AS (PARTITION BY wallet, token_id, g, b ORDER BY ts, id ROWS UNBOUNDED PRECEDING)),
p8 AS (SELECT *, coalesce(lag(cost) OVER ({_KEY}), 0) AS cost_before FROM p7),
positions AS (SELECT *, CASE WHEN kind = 'add' THEN 0 WHEN qty_before > 0 THEN usdc - cost_before + cost ELSE usdc END AS realized FROM p8)"""


def sql(body: str, *more: str) -> str:
    return "WITH " + ",".join([VIEWS, *more]) + "\n" + body


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append-only trading events, ordered by (ts, id); condition-wide events have no token."""
    return ledger_of(spark.read.parquet(f"{sf_dir}/events.parquet"))


def ledger_of(e: DataFrame) -> DataFrame:
    """The ledger's rows of some events, row by row; also for a stream."""
    k = F.get_json_object("props", "$.k").cast("long")
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long")
    e = e.select(
        F.col("event_id").alias("id"), "event_type", "user_id", seconds.alias("ts"), F.round("value", 2).alias("size"), k.alias("k")
    )
    third = F.col("id") % 3
    trade = F.col("event_type").isin("purchase", "view", "click")
    kind = (
        F.when(trade, "TRADE").when(F.col("event_type") == "error", "MERGE").when(third == 0, "REDEEM")
        .when(third == 1, "SPLIT").otherwise("REWARD")
    )
    side = F.when(F.col("event_type") == "click", "SELL").when(trade, "BUY")
    condition = F.floor(F.col("k") / 2) % 10
    out = e.select(
        "id",
        F.concat(F.lit("w"), F.col("user_id") % 10).alias("wallet"),
        "ts",
        F.concat(F.lit("x"), F.floor(F.col("id") / 3)).alias("tx_hash"),
        kind.alias("event_type"),
        side.alias("side"),
        F.concat(F.lit("c"), condition).alias("condition_id"),
        (F.col("k") % 2).alias("outcome_index"),
        F.when(trade, F.concat(F.lit("t"), condition * 2 + F.col("k") % 2)).alias("token_id"),
        "size",
        F.when(trade, ((F.col("id") * 37) % 98 + 1) / F.lit(100.0)).alias("price"),
    )
    return signed(out)


def signed(events: DataFrame) -> DataFrame:
    """Share and cash deltas by the sign convention of the ledger; unknown types keep zero deltas.

    A merge or split of n sets moves n of each token for n cash; every second redeem states no cash.
    """
    notional = F.col("size") * F.col("price")
    by_type = F.col("event_type")
    shares = (
        F.when(F.col("side") == "BUY", F.col("size")).when(F.col("side") == "SELL", -F.col("size"))
        .when(by_type == "SPLIT", F.col("size")).when(by_type.isin("MERGE", "REDEEM"), -F.col("size")).otherwise(0.0)
    )
    usdc = (
        F.when(F.col("side") == "BUY", -notional).when(F.col("side") == "SELL", notional)
        .when(by_type == "MERGE", F.col("size")).when(by_type == "SPLIT", -F.col("size"))
        .when(by_type == "REDEEM", F.when(F.col("id") % 2 == 0, 0.0).otherwise(F.col("size")))
        .when(by_type == "REWARD", F.col("size") * 0.01).otherwise(0.0)
    )
    return events.withColumns({"delta_shares": shares, "delta_usdc": usdc})


def markets(spark: SparkSession) -> DataFrame:
    """Conditions that have metadata; one of the ten in the ledger has none."""
    c = F.col("id")
    return spark.range(9).select(
        F.concat(F.lit("c"), c).alias("condition_id"),
        F.concat(F.lit("Will  Market "), c, F.lit(" resolve "), F.when(c % 3 == 0, "World Cup").otherwise("Yes")).alias("question"),
        F.when(c % 4 == 0, "sports").when(c % 4 == 1, "politics").when(c % 4 == 2, "crypto").otherwise("unclassified").alias("category"),
        F.concat(F.lit("e"), F.floor(c / 3)).alias("event_id"),
        (F.floor(c / 3) == 1).alias("neg_risk"),
        (c % 2 == 0).alias("closed"),
        F.when(c % 2 == 0, F.when(c % 4 == 0, 1.0).otherwise(0.0)).alias("price0"),
        (F.lit(CLOSED_TS) + c * 3600).alias("closed_ts"),
    )


def tokens(spark: SparkSession) -> DataFrame:
    """Tokens that have metadata: two for most conditions, one for c9."""
    t = F.col("id")
    return spark.range(19).select(
        F.concat(F.lit("t"), t).alias("token_id"), F.concat(F.lit("c"), F.floor(t / 2)).alias("condition_id"), (t % 2).alias("outcome_index")
    )


def fanout(events: DataFrame, tokens: DataFrame) -> DataFrame:
    """Token moves: trades as they are, condition-wide events once for each token of their condition.

    ``tokens`` is a dimension; Spark broadcasts it if its size allows. Events that move nothing are left out.
    """
    own = events.where("token_id is not null")
    wide = events.where("token_id is null and event_type != 'REWARD'").drop("token_id", "outcome_index")
    both = own.unionByName(wide.join(tokens, "condition_id"))
    kind = F.when((F.col("event_type") == "SPLIT") | F.col("side").eqNullSafe("BUY"), "add").when(F.col("event_type") == "REDEEM", "reset").otherwise("remove")
    usdc = F.when(F.col("event_type") == "TRADE", F.col("size") * F.col("price")).otherwise(F.abs("delta_usdc") / 2)
    return both.select(
        "id", "wallet", "ts", "condition_id", "event_type", "token_id", kind.alias("kind"), F.col("size").alias("shares"), usdc.alias("usdc")
    )


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fanout(ledger(spark, sf_dir), tokens(spark))


def r4(column, name: str | None = None):
    """Rounded to four places, without a negative zero."""
    c = F.round(column, 4) + F.lit(0.0)
    return c.alias(name or column)
