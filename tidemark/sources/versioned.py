"""Tables in versions: immutable folders of Parquet files, and a manifest for each version that names those which belong to it.

A change writes new folders first and then one small manifest; a version exists once its manifest does, and manifests are never
changed, so a reader sees a whole version or none, also while others write. Two writers of one version can't both succeed: the
later one starts again from the newer version. An append, an upsert or a restore writes only what is new; a partitioned table
replaces whole partitions, those that the change touches. A manifest has one entry for each folder (a write, or a partition of it),
not for each file, and may name the last batch that a stream has written, so that a batch which runs twice changes nothing.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.sinks import latest

#: Times that a writer starts again because another one was first.
TRIES = 20
_NULL = "__HIVE_DEFAULT_PARTITION__"


class VersionedTable:
    """A table at ``path``. ``partition``: name of the column whose values have folders of their own; given when it is created."""

    def __init__(self, spark: SparkSession, path: str, partition: str | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(self._hadoop)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._hadoop)
        self._no_overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        now = self.manifest() if self.versions() else None
        self.partition = now["partition"] if now else partition

    # versions

    def versions(self) -> list[int]:
        """Numbers of the versions there are, ascending."""
        folder = self._path(f"{self.path}/versions")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")

    def manifest(self, version: int | None = None) -> dict:
        """What a version consists of, the newest by default; without any, of nothing."""
        if version is None:
            known = self.versions()
            if not known:
                return {"version": 0, "entries": [], "schema": None, "partition": getattr(self, "partition", None), "batches": {}, "op": "none", "at": 0}
            version = known[-1]
        stream = self._fs.open(self._path(f"{self.path}/versions/{version:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, change: Callable[[dict], dict | None], op: str, batch: tuple[str, int] | None) -> int:
        """Publish what ``change`` makes of the newest manifest; None leaves it as it is."""
        for _ in range(TRIES):
            now = self.manifest()
            if batch and now["batches"].get(batch[0], -1) >= batch[1]:
                return now["version"]
            made = change(now)
            if made is None:
                return now["version"]
            made = now | made | {"version": now["version"] + 1, "op": op, "at": time.time(), "partition": self.partition}
            if batch:
                made["batches"] = now["batches"] | {batch[0]: batch[1]}
            if self._publish(made):
                return made["version"]
        raise RuntimeError(f"others kept writing to {self.path}")

    def _publish(self, made: dict) -> bool:
        """Write a manifest under a name of its own and give it its number, unless another writer has taken that."""
        folder = f"{self.path}/versions"
        own, final = self._path(f"{folder}/.{uuid.uuid4().hex}"), self._path(f"{folder}/{made['version']:012d}.json")
        stream = self._fs.create(own, False)
        stream.write(bytearray(json.dumps(made).encode()))
        stream.close()
        if not self._fs.exists(final):
            try:
                self._files.rename(own, final, self._no_overwrite)
                return True
            except Exception as e:  # py4j wraps what the store throws
                if "FileAlreadyExists" not in str(e):
                    raise
        self._fs.delete(own, False)
        return False

    # reading

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default."""
        return self._rows(self.manifest(version))

    def _rows(self, manifest: dict, values: set[str] | None = None) -> DataFrame:
        if manifest["schema"] is None:
            raise ValueError(f"nothing was ever written to {self.path}")
        schema = T.StructType.fromJson(manifest["schema"])
        folders = [f"{self.path}/{e['folder']}" for e in manifest["entries"] if values is None or e["value"] in values]
        if not folders:
            return self.spark.createDataFrame([], schema)
        # Spark reads partition values from the folders' names below the base path
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*folders).select(*schema.names)

    # writing

    def _write(self, df: DataFrame) -> list[dict]:
        """Write rows to new folders, one for each partition; what a manifest says of them."""
        folder = f"data/_write={uuid.uuid4().hex}"
        writer = df.write
        (writer.partitionBy(self.partition) if self.partition else writer).parquet(f"{self.path}/{folder}")
        if not self.partition:
            return [{"folder": folder, "value": None}]
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/{folder}")) if s.isDirectory()]
        return [{"folder": f"{folder}/{n}", "value": unquote(n.split("=", 1)[1])} for n in sorted(found) if n.startswith(f"{self.partition}=")]

    def _touched(self, df: DataFrame) -> set[str] | None:
        """The partitions that ``df`` has rows of, by their folders' names; None if the table has no partitions."""
        if not self.partition:
            return None
        name = F.coalesce(F.col(self.partition).cast("string"), F.lit(_NULL))
        return {r[0] for r in df.select(name).distinct().collect()}  # the few partitions of an increment

    def append(self, df: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Add rows; the version they are in."""
        entries = None

        def change(now: dict) -> dict:
            nonlocal entries
            entries = entries or self._write(df)
            return {"entries": now["entries"] + entries, "schema": now["schema"] or df.schema.jsonValue()}

        return self._commit(change, "append", batch)

    def append_new(self, df: DataFrame, key: str = "dedupe_key", batch: tuple[str, int] | None = None) -> int:
        """Add the rows whose key is not there yet; of equal keys in ``df`` one. With partitions, equal keys must have equal partitions,
        and only those that occur in ``df`` are read."""
        values = self._touched(df)

        def change(now: dict) -> dict:
            new = df.dropDuplicates([key])
            if now["schema"]:
                new = new.join(self._rows(now, values).select(key), key, "left_anti").select(df.columns)
            return {"entries": now["entries"] + self._write(new), "schema": now["schema"] or df.schema.jsonValue()}

        return self._commit(change, "append_new", batch)

    def _replace(self, make: Callable[[dict], DataFrame], values: set[str] | None, schema: dict, op: str, batch: tuple[str, int] | None) -> int:
        def change(now: dict) -> dict:
            rest = [e for e in now["entries"] if values is not None and e["value"] not in values]
            return {"entries": rest + self._write(make(now)), "schema": now["schema"] or schema}

        return self._commit(change, op, batch)

    def upsert(self, df: DataFrame, keys: list[str], order: str, keep: tuple[str, ...] = (), batch: tuple[str, int] | None = None) -> int:
        """The last row of each key by ``order`` among those there and those of ``df``; columns in ``keep`` keep their last value that
        was not null. Keys with equal values must have equal partitions; partitions that ``df`` does not touch stay as they are."""
        values = self._touched(df)

        def make(now: dict) -> DataFrame:
            both = df if not now["schema"] else self._rows(now, values).unionByName(df)
            return latest(both, keys, order, keep).select(df.columns)

        return self._replace(make, values, df.schema.jsonValue(), "upsert", batch)

    def rebuild(self, df: DataFrame, batch: tuple[str, int] | None = None, partitions: set[str] | None = None) -> int:
        """Replace the partitions that occur in ``df`` (or the given ones, as text) by its rows, or all rows without partitions."""
        return self._replace(lambda now: df, partitions or self._touched(df), df.schema.jsonValue(), "rebuild", batch)

    def restore(self, version: int) -> int:
        """A new version with the rows of an old one; nothing is copied."""
        old = self.manifest(version)
        return self._commit(lambda now: {"entries": old["entries"], "schema": old["schema"]}, f"restore {version}", None)

    def drop_partitions(self, gone: Callable[[str], bool]) -> int:
        """A new version without the partitions whose value (as text) ``gone`` says; the files go with ``vacuum``."""
        return self._commit(lambda now: {"entries": [e for e in now["entries"] if not gone(e["value"])]}, "drop", None)

    def backup(self, target: str, version: int | None = None) -> "VersionedTable":
        """Copy a version to a new table; its rows are written by Spark."""
        rows = self.read(version)
        other = VersionedTable(self.spark, target, self.partition)
        if other.versions():
            raise ValueError(f"there is a table at {target}")
        other.append(rows)
        return other

    def vacuum(self, keep: int = 1, older_than_s: float = 0) -> int:
        """Delete all but the last ``keep`` versions, and the folders that none of these names; the number of folders deleted.

        Folders younger than ``older_than_s`` stay, since a writer may still be about to publish them; readers of deleted
        versions fail, so it should exceed the longest read and write.
        """
        known = self.versions()
        kept = known[-keep:]
        used = {e["folder"] for v in kept for e in self.manifest(v)["entries"]}
        for v in known[:-keep]:
            self._fs.delete(self._path(f"{self.path}/versions/{v:012d}.json"), False)
        gone, data = 0, self._path(f"{self.path}/data")
        for write in self._fs.listStatus(data) if self._fs.exists(data) else []:
            if time.time() - write.getModificationTime() / 1000 < older_than_s:
                continue
            name = f"data/{write.getPath().getName()}"
            parts = [s.getPath() for s in self._fs.listStatus(write.getPath()) if s.isDirectory()] if self.partition else [write.getPath()]
            own = {f"{name}/{p.getName()}" if self.partition else name: p for p in parts}
            for folder, p in own.items():
                if folder not in used:
                    self._fs.delete(p, True)
                    gone += 1
            if not own.keys() & used:
                self._fs.delete(write.getPath(), True)
        return gone
