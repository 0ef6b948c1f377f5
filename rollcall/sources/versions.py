"""A keyed table of Parquet files that changes by whole versions.

Rows are dealt into buckets by their keys. A version is a small file that names the folder of each bucket; it appears by one rename, so that readers
see the old version or the new one. A change rewrites only the buckets that it touches. Every change carries the number of its batch; one
that was committed isn't applied again, and what a batch wrote before it died is never named by a version and is cleared later.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class VersionedTable:
    """``path``: a folder that driver and executors share, on any file system that Spark writes to. One writer at a time: of two, one fails."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: T.StructType | str, bucket_keys: list[str] | None = None, buckets: int = 16):
        self.spark, self.path, self.keys, self.bucket_keys, self.buckets = spark, path.rstrip("/"), keys, bucket_keys or keys, buckets
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self._fs = spark._jvm.org.apache.hadoop.fs

    def _path(self, at: str):
        return self._fs.Path(f"{self.path}/{at}")

    def _system(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """The numbers of the versions that are there, ascending."""
        system, at = self._system(), self._path("versions")
        if not system.exists(at):
            return []
        names = [s.getPath().getName() for s in system.listStatus(at)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def manifest(self, version: int | None = None) -> dict:
        """What a version says, the last one by default: version, batches (the last of each stream), folders (by bucket), told (what the writer noted)."""
        if version is None:
            every = self.versions()
            if not every:
                return {"version": -1, "batches": {}, "folders": {}, "told": {}}
            version = every[-1]
        stream = self._system().open(self._path(f"versions/{version:020d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        folders = self.manifest(version)["folders"]
        paths = [f"{self.path}/data/{f}/_bucket={b}" for b, f in folders.items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(*self.bucket_keys), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of some rows, at most as many as the table has."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())

    def committed(self, stream: str, batch: int) -> bool:
        return self.manifest()["batches"].get(stream, -1) >= batch

    def change(self, stream: str, batch: int, buckets: list[int], merged: Callable[[DataFrame], DataFrame], told: dict | None = None, before_commit: Callable[[], None] | None = None) -> bool:
        """Replaces the rows of some buckets by what ``merged`` makes of them; False if the batch was committed before."""
        last = self.manifest()
        if last["batches"].get(stream, -1) >= batch:
            return False
        folders = dict(last["folders"])
        if buckets:
            folder = uuid.uuid4().hex
            rows = merged(self.read(last["version"], buckets) if last["version"] >= 0 else self.read()).select(*self.schema.names).withColumn("_bucket", self.bucket())
            rows.repartition(max(1, len(buckets)), "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{folder}")
            there = {int(s.getPath().getName().split("=")[1]) for s in self._system().listStatus(self._path(f"data/{folder}")) if "=" in s.getPath().getName()}
            if there - set(buckets):
                raise ValueError(f"rows of other buckets: {sorted(there - set(buckets))[:5]}")
            for b in buckets:
                folders.pop(str(b), None)
            folders |= {str(b): folder for b in there}
        if before_commit:
            before_commit()
        self._commit({"version": last["version"] + 1, "batches": last["batches"] | {stream: batch}, "folders": folders, "told": last["told"] | (told or {})})
        return True

    def upsert(self, rows: DataFrame, stream: str, batch: int, told: dict | None = None, gone: F.Column | None = None, before_commit: Callable[[], None] | None = None) -> bool:
        """Takes in rows, one for each key: each replaces the row of its key. ``gone`` tells rows that only take theirs away."""
        rows = rows.persist()
        try:
            keys = rows.select(*(F.col(k).alias(f"_{k}") for k in self.keys))

            def merged(old: DataFrame) -> DataFrame:
                same = None
                for k in self.keys:
                    same = F.col(k).eqNullSafe(F.col(f"_{k}")) if same is None else same & F.col(k).eqNullSafe(F.col(f"_{k}"))
                new = rows if gone is None else rows.where(~F.coalesce(gone, F.lit(False)))
                return old.join(keys, same, "left_anti").unionByName(new.select(*self.schema.names))

            return self.change(stream, batch, self.touched(rows), merged, told, before_commit)
        finally:
            rows.unpersist()

    def _commit(self, manifest: dict) -> None:
        system = self._system()
        name = f"versions/{manifest['version']:020d}.json"
        part = self._path(f"versions/.{uuid.uuid4().hex}")
        out = system.create(part, False)
        try:
            out.write(json.dumps(manifest).encode())
        finally:
            out.close()
        none = self.spark.sparkContext._gateway.new_array(self._fs.Options.Rename, 0)
        context = self._fs.FileContext.getFileContext(self._path("").toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(part, self._path(name), none)
        except Exception as e:
            system.delete(part, False)
            raise RuntimeError(f"version {manifest['version']} is there already: another writer was first") from e

    def clear(self, keep: int = 2) -> None:
        """Deletes all but the last versions, and the folders that none of those names. Not while a writer or a reader of an older version is at work."""
        system, every = self._system(), self.versions()
        named = {f for v in every[-keep:] for f in self.manifest(v)["folders"].values()}
        for v in every[:-keep]:
            system.delete(self._path(f"versions/{v:020d}.json"), False)
        if system.exists(self._path("data")):
            for s in system.listStatus(self._path("data")):
                if s.getPath().getName() not in named:
                    system.delete(s.getPath(), True)
