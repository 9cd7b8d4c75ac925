"""Writers: append what is new, keep the last state, rebuild partitions, export and prune."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def _existing(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    try:
        return spark.read.schema(like.schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], like.schema)


def append_new(df: DataFrame, path: str, key: str = "dedupe_key", partition: str | None = None) -> None:
    """Append the rows whose key is not there yet; of equal keys in ``df`` one goes in.

    With a ``partition`` column that is the same for equal keys (such as the day), the target is written in its folders and
    only those that occur in ``df`` are read for their keys.
    """
    old = _existing(df.sparkSession, path, df)
    if partition:
        values = [r[0] for r in df.select(partition).distinct().collect()]  # the few partitions of an increment
        old = old.where(F.col(partition).isin(values))
    new = df.dropDuplicates([key]).join(old.select(key), key, "left_anti").select(df.columns).write.mode("append")
    (new.partitionBy(partition) if partition else new).parquet(path)


def persist_raw(df: DataFrame, path: str, columns: tuple[str, ...] = ("source", "endpoint", "params", "payload")) -> None:
    """Append raw payloads whose content hash is not there yet, as ``content_sha``."""
    hashed = df.withColumn("content_sha", F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256))
    append_new(hashed, path, "content_sha")


def latest(df: DataFrame, keys: list[str], order: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Last row of each key by ``order``; columns in ``keep`` hold their last value that was not null."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), order).alias("_r"), *(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_{c}") for c in keep)
    )
    return last.select(*keys, *(F.col(f"_{c}").alias(c) if c in keep else F.col(f"_r.{c}").alias(c) for c in rest))


def rebuild(df: DataFrame, path: str, partition: str = "wallet") -> None:
    """Replace the partitions that occur in ``df`` and leave the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def export(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    if fmt not in ("csv", "parquet"):
        raise ValueError(f"unknown format: {fmt}")
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)


def export_bundle(tables: dict[str, DataFrame], path: str, fmt: str = "csv") -> list[str]:
    """Write several results side by side under ``path``, one folder each; the folders in order of their names."""
    for name, df in sorted(tables.items()):
        export(df, f"{path}/{name}", fmt)
    return [f"{path}/{name}" for name in sorted(tables)]


def pruned(raw: DataFrame, cutoff: int, ts: str = "ts", payload: str = "payload") -> DataFrame:
    """Rows older than the cutoff without their payload; summaries stay."""
    return raw.withColumn(payload, F.when(F.col(ts) >= cutoff, F.col(payload)))


def copy(spark: SparkSession, source: str, target: str) -> int:
    """Copy a table's files to a new place; the number of rows that were copied."""
    spark.read.parquet(source).write.mode("errorifexists").parquet(target)
    return spark.read.parquet(target).count()
