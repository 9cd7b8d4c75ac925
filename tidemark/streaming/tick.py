"""The tick of a live ledger: each batch of a stream is ingested and brings holdings, watchlist and fill context up to date.

Every table is versioned and every commit names its batch, so a batch that was killed half-way runs again and does only what is missing.
What a later table needs is read from the tables, not from memory: the new events of a batch are the ledger's rows of
that batch. Work follows the batch: its days of the ledger, its wallets' holdings. A key is carried on from its stored
position, which enters as its first move; only keys with a move older than that are replayed from the ledger.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import ordered as O
from tidemark.operators.storage import stored
from tidemark.plans.views import fanout, ledger_of, tokens
from tidemark.sources.versioned import VersionedTable
from tidemark.streaming.flows import EVENTS

KEYS = ["wallet", "token_id"]
#: Seconds that a token stays a recent one, and that a fill looks back for the trade before it.
RECENT_S, LOOKBACK_S = 7 * 86_400, 86_400
RECENT, HELD = 10, 20


class Tick:
    """The tables of a live ledger under ``path``, and what a batch does to them."""

    def __init__(self, spark: SparkSession, path: str, name: str = "tick"):
        self.spark, self.name = spark, name
        self.ledger = VersionedTable(spark, f"{path}/ledger", "day")
        self.holdings = VersionedTable(spark, f"{path}/holdings", "wallet")
        self.watchlist = VersionedTable(spark, f"{path}/watchlist")
        self.context = VersionedTable(spark, f"{path}/context", "day")
        self.log = VersionedTable(spark, f"{path}/log")
        #: Called with the name of each step after it; tests stop a batch here.
        self.after: Callable[[str], None] = lambda step: None

    def __call__(self, events: DataFrame, number: int) -> None:
        batch = (self.name, number)
        rows = ledger_of(events).withColumns({"day": F.floor(F.col("ts") / 86_400).cast("long"), "batch": F.lit(number).cast("long")})
        rows = stored(rows)
        self.ledger.append_new(rows, "id", batch)
        self.after("ledger")
        days = [r.day for r in rows.select("day").distinct().collect()]  # the few days of a batch
        new = stored(self.ledger.read().where(F.col("day").isin(days) & (F.col("batch") == number)))
        if self.holdings.manifest()["batches"].get(self.name, -1) < number:
            self._hold(new, number, batch)
        late = self.holdings.read().where((F.col("batch") == number) & F.col("replayed")).count()
        self.after("holdings")
        self._watch(new, number, batch)
        self.after("watchlist")
        self._look_back(new, days, batch)
        self.after("context")
        done = new.agg(F.count("*").alias("n_new"), F.countDistinct("wallet").alias("n_wallets"), F.max("ts").alias("newest"))
        self.log.append(done.withColumns({"batch": F.lit(number).cast("long"), "n_late_keys": F.lit(late).cast("long")}), batch)

    def _hold(self, new: DataFrame, number: int, batch: tuple[str, int]) -> None:
        """Positions of the keys that moved, and whether they had to be ``replayed``."""
        of = tokens(self.spark)
        begun = moves = fanout(new, of)
        late = None
        if self.holdings.versions():
            first = moves.groupBy(*KEYS).agg(F.min(F.struct("ts", "id")).alias("_first"))
            wallets = [r.wallet for r in new.select("wallet").distinct().collect()] if self.holdings.partition else []
            known = self.holdings.read().where(F.col("wallet").isin(wallets)).join(first, KEYS)
            behind = F.col("_first") <= F.struct("last_ts", "last_id")
            known = stored(known.withColumn("_behind", behind))
            opening = known.where("not _behind").select(
                F.col("last_id").alias("id"), "wallet", F.col("last_ts").alias("ts"), "condition_id", F.lit("OPENING").alias("event_type"), "token_id", F.lit("add").alias("kind"),
                F.col("qty").alias("shares"), F.col("cost").alias("usdc"),
            )
            late = again = known.where("_behind").select(*KEYS)
            if not again.isEmpty():  # their whole history, from the ledger
                conditions = known.where("_behind").select("wallet", "condition_id").distinct()
                history = fanout(self.ledger.read().join(conditions, ["wallet", "condition_id"], "left_semi"), of).join(again, KEYS, "left_semi")
                begun = moves.join(again, KEYS, "left_anti").unionByName(history)
            begun = begun.unionByName(opening)
        p = O.running_positions(begun, KEYS)
        order = F.struct("ts", "id")
        last = p.groupBy(*KEYS).agg(F.max_by(F.struct("qty", "cost", "condition_id", F.col("ts").alias("last_ts"), F.col("id").alias("last_id")), order).alias("s"))
        last = last.select(*KEYS, "s.*", F.lit(number).cast("long").alias("batch"))
        replayed = F.coalesce("replayed", F.lit(False))
        last = last.join(late.withColumn("replayed", F.lit(True)), KEYS, "left").withColumn("replayed", replayed) if late else last.withColumn("replayed", F.lit(False))
        self.holdings.upsert(last, KEYS, "batch", batch=batch)

    def _watch(self, new: DataFrame, number: int, batch: tuple[str, int]) -> None:
        """Tokens to watch: traded lately, or held by the wallets that moved; the others of these wallets are retired."""
        wallets = [r.wallet for r in new.select("wallet").distinct().collect()]  # those of one batch
        held = self.holdings.read().where(F.col("wallet").isin(wallets))
        newest = new.agg(F.max("ts")).first()[0] or 0
        priority = F.when(F.col("last_ts") >= newest - RECENT_S, RECENT).otherwise(HELD)
        rows = held.select(*KEYS, priority.cast("long").alias("priority"), ((F.col("qty") > O.EPSILON) | (F.col("last_ts") >= newest - RECENT_S)).alias("active"), F.lit(number).cast("long").alias("batch"))
        self.watchlist.upsert(rows, KEYS, "batch", batch=batch)

    def _look_back(self, new: DataFrame, days: list[int], batch: tuple[str, int]) -> None:
        """The last trade of its token before each new fill, up to a day back."""
        near = sorted({d - k for d in days for k in range(LOOKBACK_S // 86_400 + 1)})
        trades = self.ledger.read().where(F.col("day").isin(near) & (F.col("event_type") == "TRADE"))
        fills = new.where("event_type = 'TRADE'").select("id", "token_id", "ts", "day", "price")
        before = trades.select("token_id", (F.col("ts") + 1).alias("ts"), F.col("price").alias("last_price"))  # of an earlier second
        found = O.asof_backward(fills, before, ["token_id"], ["last_price"])
        age = F.col("ts") - F.col("asof_ts") + 1
        ok = age <= LOOKBACK_S
        self.context.append(found.select("id", "token_id", "ts", "day", "price", F.when(ok, F.col("last_price")).alias("last_price"), F.when(ok, age).alias("age_s")), batch)


def run(spark: SparkSession, landing: str, path: str, files: int = 1000, tick: Tick | None = None) -> None:
    """Tick over all event files in ``landing`` that were not ingested yet."""
    tick = tick or Tick(spark, path)
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(landing)
    q = events.writeStream.foreachBatch(tick).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()


def backfill(source: DataFrame, table: VersionedTable, start: int, floor: int, step_s: int, key: str = "id", ts: str = "ts", pages: int | None = None) -> int:
    """Read the history of ``source`` downward from ``start`` to ``floor`` (times in seconds) in pages of ``step_s``, into ``table``.

    The cursor is the number of the last page, which is committed with the page's rows: a run that was stopped goes on with
    the next page, and a page that runs again changes nothing. Rows that are there already are not added again. Returns
    the pages done, at most ``pages``.
    """
    name = f"backfill:{start}:{step_s}"
    done = 0
    while pages is None or done < pages:
        k = table.manifest()["batches"].get(name, -1) + 1
        high = start - k * step_s
        if high <= floor:
            break
        low = max(high - step_s, floor)
        table.append_new(source.where((F.col(ts) >= low) & (F.col(ts) < high)), key, (name, k))
        done += 1
    return done
