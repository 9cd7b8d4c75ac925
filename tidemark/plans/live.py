"""Queries over live tables: streams that keep state, ticks, and tables in versions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.operators import ordered as O
from tidemark.operators.storage import ready, stored
from tidemark.plans import accounting as A
from tidemark.plans import behaviour as B
from tidemark.plans.views import POSITIONS, fanout, ledger_of, r4, sql, tokens
from tidemark.sources.projections import Projections
from tidemark.sources.versioned import VersionedTable
from tidemark.streaming import kept, tick
from tidemark.streaming.flows import EVENTS


def _landed(spark, sf_dir) -> str:
    """The table's events as they might land: in three deliveries, some rows a day late and some twice; each is drained by a stream of
    its own that goes on where the one before stopped."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props")
    first, last = (r.cast("long") for r in (F.min("ts").cast("timestamp"), F.max("ts").cast("timestamp")))
    span = e.agg(first.alias("a"), last.alias("b")).first()
    folder = f"{ready(spark)}/kept-{uuid.uuid4().hex}"
    third = (span.b - span.a) // 3 + 1 if span.a is not None else 1
    part = F.floor((F.col("ts").cast("long") - F.lit(span.a or 0)) / third)
    until = (part + 1) * third + F.lit(span.a or 0) - F.col("ts").cast("long")  # seconds to the end of its third
    close = until < 86_400
    at = F.when(close & (F.col("event_id") % 7 == 0), F.array(part + 1)).when(close & (F.col("event_id") % 5 == 0), F.array(part, part + 1)).otherwise(F.array(part))
    placed = e.withColumn("_part", F.explode(at))
    for k in range(4):
        placed.where(F.col("_part") == k).drop("_part").write.mode("append").parquet(f"{folder}/landing")
        events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1000).parquet(f"{folder}/landing")
        kept.drain_positions(fanout(ledger_of(events), tokens(spark)), folder, late_s=2 * 86_400)
    return folder


def stream_positions(spark, sf_dir):
    """Holdings as a stateful stream keeps them over late, repeated and restarted deliveries."""
    h = kept.told_holdings(spark, _landed(spark, sf_dir))
    return h.select("wallet", "token_id", r4("qty"), r4("cost"), r4("realized"), "n_moves", "last_ts", "too_late")


def stream_episodes(spark, sf_dir):
    """Episodes as the same stream tells them."""
    e = kept.told_episodes(spark, _landed(spark, sf_dir))
    return e.select("wallet", "token_id", "episode", "open_ts", "close_ts", "close_reason", r4("peak_qty"), "num_adds", "num_partial_exits", r4("realized_pnl"), "n_events")


def tick_holdings(spark, sf_dir):
    """Holdings after ticks over the table's events in three deliveries, some of them late and some repeated."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props")
    folder = f"{ready(spark)}/tick-{uuid.uuid4().hex}"
    day = F.dayofmonth("ts")
    at = F.when((day == 12) & (F.col("event_id") % 9 == 0), F.array(F.lit(1), F.lit(2))).when((day == 20) & (F.col("event_id") % 4 == 0), F.array(F.lit(2))).otherwise(F.array(F.floor((day - 1) / 12).cast("int")))
    placed = e.withColumn("_part", F.explode(at))
    for k in range(3):
        placed.where(F.col("_part") == k).drop("_part").write.mode("append").parquet(f"{folder}/landing")
        tick.run(spark, f"{folder}/landing", folder)
    h = tick.Tick(spark, folder).holdings.read()
    wac = F.when(F.col("qty") > O.EPSILON, F.col("cost") / F.col("qty")).otherwise(0.0)
    return h.select("wallet", "token_id", r4("qty"), r4(wac, "wac"), F.col("last_ts").alias("as_of_ts"))


def table_versions(spark, sf_dir):
    """Rows and quantity of each version of a ledger table that grows, is corrected, rebuilt, restored and pruned; version 0 is a
    backup of the third, read after the older versions are gone."""
    t = VersionedTable(spark, f"{ready(spark)}/versions-{uuid.uuid4().hex}", "day")
    l = ledger_of(spark.read.parquet(f"{sf_dir}/events.parquet")).select("id", "wallet", F.floor(F.col("ts") / 86_400).cast("long").alias("day"), "size", F.lit(0).alias("revision"))
    t.append(l.where("id % 3 = 0"))
    t.append_new(l.where("id % 2 = 0"), "id")
    t.upsert(l.where("day % 5 = 0 and id % 4 = 0").withColumns({"size": F.col("size") + 1, "revision": F.lit(1)}), ["id"], "revision")
    t.rebuild(l.where("day % 7 = 0 and id % 10 = 0"))
    t.restore(2)
    t.drop_partitions(lambda day: int(day) % 2 == 1)
    states = [(v, t.read(v)) for v in t.versions()] + [(0, t.backup(f"{t.path}-copy", 3).read())]
    rows = [df.agg(F.count("*").alias("n"), F.countDistinct("day").alias("n_days"), F.sum("size").alias("size")).withColumn("version", F.lit(v)) for v, df in states]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    out = stored(out.select("version", "n", "n_days", r4(F.coalesce("size", F.lit(0.0)), "size")))
    t.vacuum(keep=1)
    last = t.read().agg(F.count("*").alias("n"), F.countDistinct("day").alias("n_days"), F.sum("size").alias("size"))
    return out.where("version != 6").unionByName(last.select(F.lit(6).alias("version"), "n", "n_days", r4(F.coalesce("size", F.lit(0.0)), "size")))


def detectors_of_newest(spark, sf_dir):
    """Detectors over the newest version of stored features: an old version of half the wallets, then a new one that first has half
    of them and then all, of which the second refresh builds only those that are new."""
    folder = f"{ready(spark)}/projections-{uuid.uuid4().hex}"
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("wallet", F.concat(F.lit("w"), F.col("user_id") % 10))

    def build(events):
        at = f"{folder}/source-{uuid.uuid4().hex}"
        events.drop("wallet").write.parquet(f"{at}/events.parquet")
        return B.detector_inputs(spark, at)

    kept_features = Projections(spark, folder)
    half = e.where("user_id % 2 = 0")
    kept_features.refresh("features", 1, half, lambda events: build(events).withColumn("value", F.lit(0.0)))
    kept_features.refresh("features", 2, half, build)
    kept_features.refresh("features", 2, e, build)
    return B.scores_of(kept_features.read("features"))


QUERIES = {f.__name__: f for f in (stream_positions, stream_episodes, tick_holdings, table_versions, detectors_of_newest)}
ORACLE = {
    "stream_positions": sql("""SELECT wallet, token_id, round(qty, 4) + 0 AS qty, round(cost, 4) + 0 AS cost, round(realized_all, 4) + 0 AS realized, n_moves, ts AS last_ts, 0::BIGINT AS too_late FROM last
JOIN (SELECT wallet, token_id, sum(realized) AS realized_all, count(*) AS n_moves FROM positions GROUP BY 1, 2) USING (wallet, token_id)""", POSITIONS, A._LAST),
    "stream_episodes": A.ORACLE["episodes_flat_to_flat"],
    "detectors_of_newest": B.ORACLE["detector_scores"],
    "tick_holdings": A.ORACLE["holdings_wac"],
    "table_versions": sql("""SELECT version, count(id) AS n, count(DISTINCT day) AS n_days, round(coalesce(sum(size), 0), 4) + 0 AS size FROM (SELECT unnest(range(7))::INTEGER AS version) LEFT JOIN tv USING (version) GROUP BY 1""", """
tl AS (SELECT id, floor(ts / 86400)::BIGINT AS day, size FROM ledger),
t2 AS (SELECT * FROM tl WHERE id % 3 = 0 OR id % 2 = 0),
t3 AS (SELECT coalesce(u.id, t2.id) AS id, coalesce(u.day, t2.day) AS day, coalesce(u.size + 1, t2.size) AS size FROM t2 FULL JOIN (SELECT * FROM tl WHERE day % 5 = 0 AND id % 4 = 0) u ON u.id = t2.id),
rb AS (SELECT * FROM tl WHERE day % 7 = 0 AND id % 10 = 0),
tv AS (SELECT 1 AS version, * FROM tl WHERE id % 3 = 0 UNION ALL SELECT 2, * FROM t2 UNION ALL SELECT 3, * FROM t3 UNION ALL SELECT 0, * FROM t3
   UNION ALL SELECT 4, * FROM t3 WHERE day NOT IN (SELECT day FROM rb) UNION ALL SELECT 4, * FROM rb UNION ALL SELECT 5, * FROM t2 UNION ALL SELECT 6, * FROM t2 WHERE day % 2 = 0)"""),
}
