"""Structured Streaming: deduplicated ingest, windowed counts, sessions and holdings that are kept up to date."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.storage import ready

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Files of events as a stream, a few at a time."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 16).parquet(path)


def deduplicated(stream: DataFrame, key: str = "event_id", ts: str = "ts", late: str | None = "1 hour") -> DataFrame:
    """Each key once, for repeats that arrive within ``late`` of each other; with None for all, and no row is too late."""
    if late is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def tumbling(stream: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sessions(stream: DataFrame, gap: str = "2 hours 1 microsecond", late: str = "1 hour") -> DataFrame:
    """Sessions of a user's errors; a pause longer than two hours ends one. Times have microseconds, so the smallest one above
    the pause that still joins is the gap."""
    w = stream.where("event_type = 'error'").withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return w.agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def _move(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    qty, n = state.get if state.exists else (0.0, 0)
    for pdf in batches:
        signs = pdf["event_type"].map({"purchase": 1.0, "view": 1.0, "click": -1.0}).fillna(0.0)
        qty += float((signs * pdf["value"]).sum())
        n += len(pdf)
    state.update((qty, n))
    yield pd.DataFrame({"wallet": [key[0]], "token": [key[1]], "qty": [qty], "n": [n]})


def holdings(stream: DataFrame) -> DataFrame:
    """Net quantity of every (wallet, token), kept in state; each batch emits the keys that it moved."""
    k = F.get_json_object("props", "$.k").cast("long") % 20
    keyed = stream.select((F.col("user_id") % 10).alias("wallet"), k.alias("token"), "event_type", F.round("value", 2).alias("value"))
    out = "wallet long, token long, qty double, n long"
    return keyed.groupBy("wallet", "token").applyInPandasWithState(_move, out, "qty double, n long", "update", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and return what it wrote; files and checkpoint lie in the shared folder."""
    spark = stream.sparkSession
    folder = f"{ready(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_events(spark, f"{sf_dir}/events*.parquet")


def stream_dedupe(spark, sf_dir):
    """The backlog is read in the order of its files, not of time, so nothing in it may count as late."""
    once = deduplicated(_events(spark, sf_dir).withColumn("twice", F.explode(F.array(F.lit(0), F.lit(1)))), late=None)
    out = drained(once.select("event_id", "event_type", "value"))
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("n_ids"))


def stream_daily(spark, sf_dir):
    """Each batch writes the windows that it changed, and the watermark lets go of the state of closed ones; the last version
    of a window counts. The backlog's files are not in order of time, so its lateness is that of the whole table."""
    span = spark.read.parquet(f"{sf_dir}/events*.parquet").agg(F.ceil((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 3.6e9).alias("h")).first().h or 0
    out = drained(tumbling(_events(spark, sf_dir), late=f"{span + 1} hours"), "update")
    out = out.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "value"), "batch").alias("s")).select("start", "event_type", "s.*")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", (F.round("value", 2) + 0.0).alias("value"))


def stream_sessions(spark, sf_dir):
    out = drained(sessions(_events(spark, sf_dir)), "complete")
    last = out.agg(F.max("batch").alias("batch"))
    return out.join(F.broadcast(last), "batch").groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.sum("n").alias("n_events"), F.max("n").alias("longest"))


def stream_holdings(spark, sf_dir):
    out = drained(holdings(_events(spark, sf_dir)), "update")
    last = out.groupBy("wallet", "token").agg(F.max_by(F.struct("qty", "n"), "batch").alias("s"))
    return last.select("wallet", "token", (F.round("s.qty", 2) + 0.0).alias("qty"), F.col("s.n").alias("n"))


QUERIES = {f.__name__: f for f in (stream_dedupe, stream_daily, stream_sessions, stream_holdings)}
ORACLE = {
    "stream_dedupe": "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS n_ids FROM events GROUP BY 1",
    "stream_daily": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) + 0 AS value FROM events GROUP BY 1, 2",
    "stream_sessions": """SELECT user_id, count(*) AS n_sessions, sum(n)::BIGINT AS n_events, max(n) AS longest FROM (SELECT user_id, s, count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM
(SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS b FROM events WHERE event_type = 'error')) GROUP BY 1, 2) GROUP BY 1""",
    "stream_holdings": """SELECT user_id % 10 AS wallet, k % 20 AS token, round(sum(CASE WHEN event_type IN ('purchase', 'view') THEN round(value, 2) WHEN event_type = 'click' THEN -round(value, 2) ELSE 0 END), 2) + 0 AS qty, count(*) AS n
FROM (SELECT *, regexp_extract(props, '"k": ?([0-9]+)', 1)::BIGINT AS k FROM events) GROUP BY 1, 2""",
}
