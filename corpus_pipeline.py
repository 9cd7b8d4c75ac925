"""A corpus from raw documents to packed sequences, in five stages that each apply one operator to all that is left.

Quality classifier (rejected documents go), line dedup (repeated passages go; a document of which nothing is left goes),
near-duplicates (one document of each group stays), benchmark decontamination (documents that hold a test window go),
packing. A stage reads what the stage before wrote as Parquet.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, line_dedup, near_dedup, packing, quality
from tidemark.llm.common import cut, ready, table, unused, written

#: Similarity in percent from which documents are near-duplicates of each other in this job.
NEAR_PERCENT = 80


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key of each row, for ids that are null or repeated, and the key's name.

    The key is written out with the rows: it counts partitions, and a later scan of the same files may cut them otherwise
    (executors come and go, and lost tasks run again).
    """
    key = unused("_row", docs)
    return written(docs.withColumn(key, F.monotonically_increasing_id())), key


def _without(keyed: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``keyed`` without the given rows, and without the key. The rows are written out, so Spark knows their size and sends them
    to the documents where they are few."""
    return keyed.join(written(rows.select(key).distinct()), key, "left_anti").drop(key)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least the threshold; null and empty texts are scored as empty texts."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    score = unused("_score", docs)
    scored = quality.score(docs, model, out_col=score)
    return scored.where(F.col(score) >= quality.THRESHOLD).select(docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand elsewhere before; ``n_chars`` follows the text."""
    clash = {c: unused(f"{c}_given", docs) for c in docs.columns if c.lower() in line_dedup.MADE}
    done = line_dedup.dedup_lines(docs.withColumnsRenamed(clash) if clash else docs, passages=True)
    done = done.where((F.col("removed_lines") == 0) | (F.trim("text") != "") | F.col("text").isNull())
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    if clash:  # the operator's own counts give way to the documents' columns
        done = done.drop(*line_dedup.MADE).withColumnsRenamed({new: old for old, new in clash.items()})
    return done.select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates; one without an id only if none has an id."""
    keyed, key = _keyed(docs)
    found = near_dedup.near_duplicates(keyed, id_col=key, percent=NEAR_PERCENT)
    found = cut(found.select(F.col("_id").alias(key), F.col("component_id").alias("_group")))
    others = found.where(F.col(key) != F.col("_group"))
    heads = others.select("_group").distinct().select(F.col("_group").alias(key), "_group")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(key).alias("row"))
    members = others.unionByName(heads).join(keyed.select(key, "doc_id"), key).withColumn("_rank", rank)
    best = members.groupBy("_group").agg(F.min("_rank").alias("_best"))
    return _without(keyed, members.join(best, "_group").where("_rank.row != _best.row"), key)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an occurrence of a ten-word window of the benchmark."""
    keyed, key = _keyed(docs)
    found = decontaminate.contamination(keyed.select(key, "text"), table(spark, sf_dir, "benchmark"), id_col=key)
    return _without(keyed, found.where("n_hit > 0").select(F.col("doc_id").alias(key)), key)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents that are left, as in the packing query."""
    import public_tokenizers

    packed = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
    return packed.withColumnRenamed("_id", "doc_id")


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_passages),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: The classifier's trees can't be fitted in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder and read again."""
    folder = f"{ready(spark).sparkContext.getCheckpointDir()}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return done
        done.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
