"""Named projections in versions, kept per key: only keys whose source rows have changed are computed again.

A projection (features of wallets, say) has a name and a version, the version of its definition. For each key it remembers how
many source rows it was made from and the sum of their hashes. A refresh compares these, builds the keys that differ from their
source rows alone, and replaces their rows; others are carried over. Keys lie in buckets, so that a table of many keys has few
folders. Results are published before what they were made from, so a refresh that was killed runs again with the same outcome.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.storage import stored
from tidemark.sources.versioned import VersionedTable

BUCKETS = 64


class Projections:
    """The projections under ``path``, of rows with a ``key`` column."""

    def __init__(self, spark: SparkSession, path: str, key: str = "wallet"):
        self.spark, self.path, self.key = spark, path, key
        self.registry = VersionedTable(spark, f"{path}/registry")

    def _tables(self, name: str, version: int) -> tuple[VersionedTable, VersionedTable]:
        at = f"{self.path}/{name}/v{version:06d}"
        return VersionedTable(self.spark, f"{at}/rows", "_bucket"), VersionedTable(self.spark, f"{at}/marks", "_bucket")

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_bucket", F.pmod(F.xxhash64(self.key), F.lit(BUCKETS)).cast("int"))

    def refresh(self, name: str, version: int, source: DataFrame, build: Callable[[DataFrame], DataFrame]) -> int:
        """Bring a projection up to date with ``source``; the number of keys that were built or dropped.

        ``build`` makes the rows of some keys (with the key column) from all source rows of these keys. Source rows without a key
        take no part. The order of source rows does not matter, a repeated row does.
        """
        rows, marks = self._tables(name, version)
        source = source.where(F.col(self.key).isNotNull())
        print_ = F.sum(F.xxhash64(*source.columns).cast("decimal(38,0)"))
        now = stored(self._bucketed(source.groupBy(self.key).agg(F.count("*").alias("n"), print_.alias("hash"))))
        if marks.versions():
            old = marks.read().select(self.key, F.col("n").alias("_n"), F.col("hash").alias("_hash"))
            j = now.drop("_bucket").join(old, self.key, "full")
            changed = j.where(F.col("n").isNull() | ~(F.col("n").eqNullSafe(F.col("_n")) & F.col("hash").eqNullSafe(F.col("_hash"))))
        else:
            changed = now
        changed = stored(self._bucketed(changed.select(self.key)))
        count = changed.count()
        if count:
            touched = {str(r[0]) for r in changed.select("_bucket").distinct().collect()}  # at most BUCKETS
            in_touched = F.col("_bucket").cast("string").isin(*touched)
            made = self._bucketed(build(source.join(changed.select(self.key), self.key, "left_semi")))
            if rows.versions():
                carried = rows.read().where(in_touched).join(changed.select(self.key), self.key, "left_anti")
                made = made.unionByName(carried)
            rows.rebuild(stored(made), partitions=touched)
            marks.rebuild(now.where(in_touched), partitions=touched)
        entry = self.spark.createDataFrame([(f"{name}/{version}", name, version)], "id string, name string, version int")
        self.registry.append_new(entry, "id")
        return count

    def versions(self, name: str) -> list[int]:
        """Versions of a projection, ascending."""
        if not self.registry.versions():
            return []
        return sorted(r.version for r in self.registry.read().where(F.col("name") == name).select("version").collect())

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """The rows of a projection, of its newest version by default."""
        known = self.versions(name)
        if not known or version is not None and version not in known:
            raise ValueError(f"no projection {name} {version or ''}")
        return self._tables(name, version or known[-1])[0].read().drop("_bucket")
