"""Rule families over the per-fill dataset, composite search, wallet profiles and exploratory clustering."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.storage import stored
from tidemark.plans import accounting as A
from tidemark.plans import behaviour as B
from tidemark.plans import lifecycle as L
from tidemark.plans import matching as M
from tidemark.plans.views import POSITIONS, markets, r4, sql

#: Predicates by family, in SQL that both engines read.
FAMILIES = {
    "spread_capture": "spread_bps >= 300 AND book_before_age_s <= 3600 AND inside",
    "inventory_balancing": "(directional_before > 0 AND side = 'SELL') OR (directional_before < 0 AND side = 'BUY')",
    "completion_set_edge": "side = 'BUY' AND fill_price + mid <= 0.9",
    "depth_imbalance": "imbalance >= 0.5 AND side = 'BUY' OR imbalance <= -0.5 AND side = 'SELL'",
    "event_timing": "trade_hour BETWEEN 12 AND 19",
    "correlated_siblings": "n_siblings >= 1",
    "closed_cycle": "qty_before = 0",
}


def _rows(spark, sf_dir) -> DataFrame:
    """Split fills with the number of sibling fills in the hour before."""
    d = B._split_dataset(spark, sf_dir)
    s = M.fills(spark, sf_dir).join(markets(spark).select("condition_id", "event_id"), "condition_id", "left")
    s = s.select("id", "wallet", "event_id", F.col("condition_id").alias("condition"), F.col("ts").alias("trade_ts"))
    hour = Window.partitionBy("wallet", "event_id").orderBy("trade_ts").rangeBetween(-3600, -1)
    own = Window.partitionBy("wallet", "event_id", "condition").orderBy("trade_ts").rangeBetween(-3600, -1)
    siblings = F.when(F.col("event_id").isNotNull(), F.count("*").over(hour) - F.count("*").over(own)).otherwise(0)
    return d.join(s.select("id", siblings.alias("n_siblings")), "id")


def rule_families(spark, sf_dir):
    """Coverage, precision and markout of every rule family on each split."""
    d = _rows(spark, sf_dir)
    fired = F.array(*(F.struct(F.lit(k).alias("rule"), F.coalesce(F.expr(p), F.lit(False)).alias("on")) for k, p in FAMILIES.items()))
    x = d.select("split", "markout_1h", F.explode(fired).alias("f"))
    g = x.groupBy(F.col("f.rule").alias("rule"), "split").agg(
        F.count("*").alias("n"), F.count_if("f.on").alias("fired"), F.count_if(F.col("f.on") & (F.col("markout_1h") > 0)).alias("up"),
        F.count_if(F.col("f.on") & F.col("markout_1h").isNotNull()).alias("known"), F.avg(F.when(F.col("f.on"), F.col("markout_1h"))).alias("m"),
    )
    return g.select("rule", "split", "n", "fired", r4(F.col("fired") / F.col("n"), "coverage"), r4(F.try_divide("up", F.nullif(F.col("known"), F.lit(0))), "precision"), r4("m", "avg_markout"))


def rule_explain(spark, sf_dir):
    """For every fill the rule families that fire on it, in order of their names, and its markout."""
    d = _rows(spark, sf_dir)
    names = F.filter(F.array(*(F.when(F.coalesce(F.expr(p), F.lit(False)), F.lit(k)) for k, p in sorted(FAMILIES.items()))), lambda x: x.isNotNull())
    return d.select("id", "split", F.array_join(names, ",").alias("rules"), F.size(names).cast("long").alias("n_rules"), "markout_1h")


def composite_search(spark, sf_dir, beam: int = 6, longest: int = 3, penalty: float = 0.015):
    """Beam search over conjunctions of rule families: one Spark job a stage scores all candidates of the stage.

    A candidate adds one family that it lacks; its score is its worse mean markout of train and validation less a
    penalty for each further family, and it must beat what it was made from. The test split is reported, never used.
    """
    d = _rows(spark, sf_dir).withColumns({f"on_{k}": F.coalesce(F.expr(p), F.lit(False)) for k, p in FAMILIES.items()}).select("split", "markout_1h", *(f"on_{k}" for k in FAMILIES))
    kept: list[tuple[float, tuple[str, ...], list]] = []
    front: list[tuple[float, tuple[str, ...]]] = [(float("-inf"), ())]
    for _ in range(longest):
        found = {tuple(sorted({*c, k})): s for s, c in front for k in FAMILIES if k not in c}
        names = sorted(found)
        sums = []
        for i, c in enumerate(names):
            on = F.lit(True)
            for k in c:
                on = on & F.col(f"on_{k}")
            for split in ("train", "validation", "test"):
                here = on & (F.col("split") == split)
                sums.append(F.struct(F.avg(F.when(here, F.col("markout_1h"))).alias("m"), F.count(F.when(here, F.col("markout_1h"))).alias("n")).alias(f"{split}_{i}"))
        row = d.agg(*sums).first()  # a few numbers for each candidate
        scored = []
        for i, c in enumerate(names):
            parts = [row[f"{s}_{i}"] for s in ("train", "validation", "test")]
            if parts[0].m is None or parts[1].m is None:
                continue
            score = round(min(parts[0].m, parts[1].m) - penalty * (len(c) - 1), 9)
            if score > found[c]:
                scored.append((score, c, parts))
        scored.sort(key=lambda x: (-x[0], x[1]))
        kept += scored[:beam]
        front = [(s, c) for s, c, _ in scored[:beam]]
        if not front:
            break
    rows = [(i + 1, "+".join(c), s, *(v for p in parts for v in (p.m, p.n))) for i, (s, c, parts) in enumerate(sorted(kept, key=lambda x: (-x[0], x[1])))]
    schema = "rank long, rules string, score double, train double, n_train long, validation double, n_validation long, test double, n_test long"
    return spark.createDataFrame(rows, schema)


def wallet_profile(spark, sf_dir):
    """One row for each wallet from the trust in its numbers, open alerts, profit and its best-scored detector."""
    trust = L.wallet_trust_checks(spark, sf_dir).select("wallet", F.col("status").alias("trust"), "n_fail", "n_warn", "n_pnl")
    alerts = B.sync_alerts(spark, sf_dir).groupBy("wallet").agg(F.array_join(F.sort_array(F.collect_set("alert")), ",").alias("alerts"))  # of a few kinds
    pnl = A.pnl_decomposition_scoped(spark, sf_dir).where("scope = 'all'").select("wallet", "total")
    scores = B.detector_scores(spark, sf_dir).where("scope = 'all'")
    best = scores.groupBy("wallet").agg(F.max(F.struct("score", "detector", "confidence")).alias("d"))
    out = trust.join(alerts, "wallet", "left").join(pnl, "wallet", "left").join(best, "wallet", "left")
    return out.select(
        "wallet", "trust", "n_fail", "n_warn", "n_pnl", F.coalesce("alerts", F.lit("")).alias("alerts"), F.col("total").alias("realized_total"), F.col("d.detector").alias("detector"), F.col("d.score").alias("score"), F.col("d.confidence").alias("confidence")
    )


def wallet_clusters(spark, sf_dir, ks: tuple[int, ...] = (3, 4, 5)):
    """Wallet and scope rows of the fingerprints, standardised, in clusters and two principal components. Of the numbers of clusters
    in ``ks`` the one with the best silhouette is taken, the smallest of equals."""
    names = ["maker_fill_share", "merge_frequency", "episode_count", "adds_per_episode", "avg_position_size"]
    wide = B.fingerprint_features(spark, sf_dir).groupBy("wallet", "scope").pivot("feature", names).agg(F.first("value")).fillna(0.0)
    wide = stored(wide)  # one row for each wallet and scope; fits and scores read it some twenty times
    x = VectorAssembler(inputCols=names, outputCol="raw").transform(wide)
    x = StandardScaler(inputCol="raw", outputCol="z", withMean=True).fit(x).transform(x)
    judge, best = ClusteringEvaluator(featuresCol="z", predictionCol="cluster"), None
    for k in ks:
        found = KMeans(k=k, seed=7, featuresCol="z", predictionCol="cluster").fit(x).transform(x)
        score = round(judge.evaluate(found), 9) if len(ks) > 1 else 0.0
        if best is None or score > best[0]:
            best = score, found
    x = best[1]
    x = PCA(k=2, inputCol="z", outputCol="pc").fit(x).transform(x)
    pc = vector_to_array("pc")
    return x.select("wallet", "scope", "cluster", r4(F.abs(pc[0]), "pc1"), r4(F.abs(pc[1]), "pc2"))


def standardised_regression(df: DataFrame, keys: list[str], y: str, xs: list[str]) -> DataFrame:
    """For each key the least-squares coefficients of ``y`` on ``xs``, all standardised: ``n``, ``r2``, ``beta`` (array in the order of ``xs``).

    One aggregation gives counts, sums and sums of products, whatever the number of rows; each key's normal equations are
    solved from them. Rows with a null take no part. Coefficients are null where a variable is constant or they are not unique.
    """
    names = [*xs, y]
    whole = F.coalesce(*(F.when(F.col(c).isNull(), 1) for c in names)).isNull()
    rows = df.where(whole).select(*keys, *(F.col(c).cast("double").alias(f"_{k}") for k, c in enumerate(names)))
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.array(*(F.covar_pop(f"_{i}", f"_{j}") for i, j in pairs)).alias("_c"), F.array(*(F.stddev_pop(f"_{k}") for k in range(len(names)))).alias("_s")
    )

    def solved(c: list, s: list) -> dict | None:
        if not all(v > 0 for v in s):
            return None
        m = np.zeros((len(names), len(names)))
        m[tuple(np.transpose(pairs))] = c
        m = (m + np.triu(m, 1).T) / np.outer(s, s)
        a, b = m[:-1, :-1], m[:-1, -1]
        if np.linalg.cond(a) > 1e12:
            return None
        beta = np.linalg.solve(a, b)
        return {"beta": beta.tolist(), "r2": float(beta @ b)}

    solve = F.udf(solved, "beta array<double>, r2 double", useArrow=True)
    return sums.withColumn("_f", solve("_c", "_s")).select(*keys, "n", F.col("_f.r2").alias("r2"), F.col("_f.beta").alias("beta"))


def markout_regression(spark, sf_dir):
    """Markouts of a wallet's fills explained by the spread and the price, as standardised coefficients."""
    d = M.microstructure_dataset(spark, sf_dir)
    found = standardised_regression(d, ["wallet"], "markout_1h", ["spread_bps", "fill_price"])
    return found.select("wallet", "n", F.round("r2", 6).alias("r2"), F.round(F.col("beta")[0], 6).alias("beta_spread"), F.round(F.col("beta")[1], 6).alias("beta_price"))


def markdown(df: DataFrame, title: str, most: int = 200) -> str:
    """A small result as a Markdown table; more than ``most`` rows are an error, never cut silently."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    head = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    return "\n".join(head + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows])


QUERIES = {f.__name__: f for f in (rule_families, rule_explain, composite_search, wallet_profile, wallet_clusters, markout_regression)}

_ROWS = """
sib AS (SELECT id, CASE WHEN event_id IS NOT NULL THEN count(*) OVER (PARTITION BY wallet, event_id ORDER BY trade_ts RANGE BETWEEN 3600 PRECEDING AND 1 PRECEDING) - count(*) OVER (PARTITION BY wallet, event_id, condition_id ORDER BY trade_ts RANGE BETWEEN 3600 PRECEDING AND 1 PRECEDING) ELSE 0 END AS n_siblings FROM dataset),
rr AS (SELECT sp.*, n_siblings FROM sp JOIN sib USING (id))"""
ORACLE = {
    "rule_explain": sql("SELECT id, split, concat_ws(',', " + ", ".join(f"CASE WHEN coalesce({p}, false) THEN '{k}' END" for k, p in sorted(FAMILIES.items())) + ") AS rules, (" + " + ".join(f"coalesce({p}, false)::INT" for _, p in sorted(FAMILIES.items())) + ")::BIGINT AS n_rules, markout_1h FROM rr", POSITIONS, M._BOOKS, M._DATASET, B._SPLIT, _ROWS),
    "rule_families": sql("SELECT rule, split, count(*) AS n, count(*) FILTER (f) AS fired, round(count(*) FILTER (f) / count(*), 4) AS coverage, round(count(*) FILTER (f AND markout_1h > 0) / nullif(count(*) FILTER (f AND markout_1h IS NOT NULL), 0), 4) AS precision, round(avg(markout_1h) FILTER (f), 4) + 0 AS avg_markout FROM ("
        + " UNION ALL ".join(f"SELECT '{k}' AS rule, split, markout_1h, coalesce({p}, false) AS f FROM rr" for k, p in FAMILIES.items()) + ") GROUP BY 1, 2", POSITIONS, M._BOOKS, M._DATASET, B._SPLIT, _ROWS),
    "markout_regression": sql("""SELECT wallet, n, round(b1 * r1 + b2 * r2, 6) AS r2, round(b1, 6) AS beta_spread, round(b2, 6) AS beta_price FROM (SELECT *, (r1 - r2 * r12) / (1 - r12 * r12) AS b1, (r2 - r1 * r12) / (1 - r12 * r12) AS b2 FROM
(SELECT wallet, count(*) AS n, corr(markout_1h, spread_bps) AS r1, corr(markout_1h, fill_price) AS r2, CASE WHEN 1 - abs(corr(spread_bps, fill_price)) > 2e-12 THEN corr(spread_bps, fill_price) END AS r12 FROM dataset WHERE markout_1h IS NOT NULL AND spread_bps IS NOT NULL AND fill_price IS NOT NULL GROUP BY 1))""", POSITIONS, M._BOOKS, M._DATASET),
    "wallet_profile": "WITH tr AS (" + L.ORACLE["wallet_trust_checks"] + "), al AS (" + B.ORACLE["sync_alerts"] + "), pn AS (" + A.ORACLE["pnl_decomposition_scoped"] + "), ds AS (" + B.ORACLE["detector_scores"] + """)
SELECT wallet, status AS trust, n_fail, n_warn, n_pnl, coalesce(alerts, '') AS alerts, total AS realized_total, detector, score, confidence FROM tr LEFT JOIN (SELECT wallet, string_agg(alert, ',' ORDER BY alert) AS alerts FROM (SELECT DISTINCT wallet, alert FROM al) GROUP BY 1) USING (wallet) LEFT JOIN (SELECT wallet, total FROM pn WHERE scope = 'all') USING (wallet)
LEFT JOIN (SELECT * FROM (SELECT wallet, detector, score, confidence, row_number() OVER (PARTITION BY wallet ORDER BY score DESC, detector DESC, confidence DESC) AS rn FROM ds WHERE scope = 'all') WHERE rn = 1) b USING (wallet)""",
}
