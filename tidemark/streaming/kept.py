"""Holdings and episodes kept up to date in a stream's state: quantity, cost, realized profit and closed episodes of every key.

State of a (wallet, token): a *base* (value state), the position after all moves that can no longer change, and the *recent* moves
(map state, by time and id). A batch merges its moves into the recent ones, folds them in order from the base, tells where the
position and its episodes now stand, and moves into the base what is older than ``late_s`` before the key's newest move.

Late data: a move up to ``late_s`` behind the newest of its key takes its place in the order, and what was told since is told
again; a repeated move has the same time and id and counts once. An older one is not applied but counted in ``too_late``, so
that its key can be rebuilt from the ledger. The state of a key is its base and the moves of ``late_s`` seconds, whatever its
history. It needs the RocksDB state store, and goes on after a restart from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators import ordered as O
from tidemark.operators.ordered import EPSILON

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_EPISODE = "episode long, open_ts long, close_ts long, close_reason string, peak_qty double, num_adds long, num_partial_exits long, realized_pnl double, n_events long"
#: A position and its open episode. ``moves`` are the episode's events that are no reset; ``ts, id`` are the last event's.
_BASE = "qty double, cost double, realized double, n long, ts long, id long, too_late long, episode long, open_ts long, peak double, adds long, parts long, pnl double, events long, moves long"
_FIELDS = [f.split()[0] for f in _BASE.split(", ")]
_START = dict.fromkeys(_FIELDS, 0) | {"qty": 0.0, "cost": 0.0, "realized": 0.0, "pnl": 0.0, "peak": 0.0}
OUT = f"wallet string, token_id string, qty double, cost double, realized double, n_moves long, last_ts long, last_id long, too_late long, episode long, told_from long, told array<struct<{', '.join(f.replace(' ', ':') for f in _EPISODE.split(', '))}>>"


def _told(s: dict, close_ts: int | None, reason: str) -> Row:
    return Row(
        episode=s["episode"], open_ts=s["open_ts"], close_ts=close_ts, close_reason=reason, peak_qty=max(s["peak"], 0.0), num_adds=s["adds"],
        num_partial_exits=s["parts"], realized_pnl=s["pnl"], n_events=s["events"],
    )


def apply_move(s: dict, ts: int, id_: int, kind: str, shares: float, usdc: float) -> Row | None:
    """Apply a move to a position ``s`` in place; the episode that it closes, if any. The rules are those of the batch operators."""
    held, cost = s["qty"], s["cost"]
    if not s["events"]:
        s |= {"open_ts": ts, "peak": 0.0}
    s |= {"ts": ts, "id": id_, "n": s["n"] + 1, "events": s["events"] + 1, "open_ts": min(s["open_ts"], ts)}
    if kind == "add":
        s |= {"qty": round(held + shares, 8), "cost": cost + usdc, "adds": s["adds"] + (s["events"] > 1)}
    else:
        s["qty"] = 0.0 if kind == "reset" else round(held - shares, 8)
        s["cost"] = cost * s["qty"] / held if kind == "remove" and held > 0 and s["qty"] > EPSILON else 0.0
        gain = usdc - cost + s["cost"] if held > 0 else usdc
        s["realized"] += gain
        s["pnl"] += gain if held > 0 else 0.0
    s["moves"] += kind != "reset"
    s["peak"] = max(s["peak"], s["qty"])
    closes = kind == "reset" or kind == "remove" and abs(s["qty"]) <= EPSILON
    if kind == "remove" and held > 0 and shares <= held and not closes:
        s["parts"] += 1
    if not closes:
        return None
    done = _told(s, ts, "resolution" if kind == "reset" else "flat") if s["moves"] else None
    s |= {"episode": s["episode"] + 1, "events": 0, "moves": 0, "adds": 0, "parts": 0, "pnl": 0.0, "peak": 0.0, "open_ts": 0}
    return done


class _Positions(StatefulProcessor):
    def __init__(self, late_s: int):
        self.late_s = late_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.base = handle.getValueState("base", _BASE)
        self.recent = handle.getMapState("recent", "ts long, id long", "kind string, shares double, usdc double")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timers) -> Iterator[Row]:
        base = dict(zip(_FIELDS, self.base.get())) if self.base.exists() else dict(_START)
        stored = {tuple(k): tuple(v) for k, v in self.recent.iterator()}
        moves, told_from = dict(stored), base["episode"]
        for r in rows:
            if base["n"] and (r.ts, r.id) <= (base["ts"], base["id"]):
                base["too_late"] += 1
            else:
                moves[r.ts, r.id] = (r.kind, r.shares, r.usdc)
        order = sorted(moves)
        safe = order[-1][0] - self.late_s if order else 0
        state, told = dict(base), []
        for at in order:
            if (done := apply_move(state, *at, *moves[at])) is not None:
                told.append(done)
            if at[0] < safe:
                base = dict(state)
                if at in stored:
                    self.recent.removeKey(at)
            elif at not in stored:
                self.recent.updateValue(at, moves[at])
        self.base.update(tuple(base[f] for f in _FIELDS))
        if state["moves"]:
            told.append(_told(state, None, "open"))
        yield Row(
            wallet=key[0], token_id=key[1], qty=state["qty"], cost=state["cost"], realized=state["realized"], n_moves=state["n"], last_ts=state["ts"], last_id=state["id"],
            too_late=base["too_late"], episode=state["episode"], told_from=told_from, told=told,
        )

    def close(self) -> None:
        pass


def positions(moves: DataFrame, late_s: int) -> DataFrame:
    """A stream of moves (``wallet, token_id, id, ts, kind, shares, usdc``) to the states of the keys that each batch moved (``OUT``)."""
    own = moves.select("wallet", "token_id", F.col("ts").cast("long").alias("ts"), F.col("id").cast("long").alias("id"), "kind", F.col("shares").cast("double").alias("shares"), F.col("usdc").cast("double").alias("usdc"))
    return own.groupBy("wallet", "token_id").transformWithState(_Positions(late_s), OUT, "Update", "None")


@contextmanager
def state_store(spark: SparkSession):
    """The RocksDB state store for the streams started inside."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def drain_positions(stream: DataFrame, folder: str, late_s: int) -> None:
    """Run ``positions`` over what there is of a stream of moves and was not read yet; ``folder`` keeps checkpoint and results."""

    def keep(batch: DataFrame, number: int) -> None:  # the same batch again replaces what it wrote before
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    with state_store(stream.sparkSession):
        states = positions(stream, late_s)
        q = states.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()


def told_holdings(spark: SparkSession, folder: str) -> DataFrame:
    """The last state of every key."""
    out = spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out")
    rest = [c for c in out.columns if c not in ("wallet", "token_id", "batch")]
    return out.groupBy("wallet", "token_id").agg(F.max_by(F.struct(*rest), "batch").alias("s")).select("wallet", "token_id", "s.*")


def told_episodes(spark: SparkSession, folder: str) -> DataFrame:
    """Every episode as it was told last. A batch tells all episodes of its keys anew from ``told_from`` on, so what earlier batches told
    of these numbers is void, also where it tells no episode of a number: late moves can leave only resets for it."""
    out = spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out")
    later = O.before(["wallet", "token_id"], F.desc("batch"))
    each = out.withColumn("_void", F.min("told_from").over(later)).select("wallet", "token_id", "_void", F.explode("told").alias("e"))
    return each.where("_void is null or e.episode < _void").select("wallet", "token_id", "e.*")
