"""Matching of fills over a long history of one key."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from tidemark.plans import matching as M


def test_pairs_of_a_long_history(spark, tmp_path):
    """60,000 events of one wallet and market, many at one second, against a walk from the end; quadratic work would take minutes."""
    rng, n = random.Random(5), 60_000
    rows = [(i, 1_704_067_200 + rng.randrange(n // 4), rng.choice(["view", "click", "purchase", "error"]), rng.randrange(2)) for i in range(n)]
    df = spark.createDataFrame(rows, "event_id long, s long, event_type string, k int")
    path = str(tmp_path / "t")
    df.select("event_id", F.timestamp_seconds("s").alias("ts"), F.lit(1).cast("long").alias("user_id"), "event_type", F.lit(1.0).alias("value"), F.format_string('{"k": %d}', "k").alias("props")).write.parquet(f"{path}/events.parquet")
    want, last = {}, {}
    for i, s, kind, k in sorted(rows, key=lambda r: (r[1], r[0]), reverse=True):
        if kind == "error":
            continue
        if kind != "click":
            i2, s2 = last.get(1 - k, (None, s))
            want[i] = (i2, s2 - s if i2 is not None else None)
        last[k] = (i, s)
    began = time.monotonic()
    got = {r.id: (r.pair_id, r.wait_s) for r in M.pair_completion(spark, path).collect()}
    assert got == want and time.monotonic() - began < 30
