"""A cache on disk in versions: buckets by key, a manifest for each version, and one rename that makes a version the current one.

    <folder>/data/<version>-<id>/bucket=<n>/*.parquet    a bucket as one version wrote it
    <folder>/manifest/<version>.json                     for each bucket, the folder that holds it now

A change rewrites only the buckets that its keys fall into; the new manifest names these and, for all others, the folders
of before. Nothing is seen until the manifest is renamed into its place, which fails if another writer took the
version: then the change is worked out again on what that one left. A reader keeps the version it began with.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import cache


class Conflict(Exception):
    """Other writers were faster, again and again."""


def refusal(schema: T.StructType, key: str = "photo_hash", path: str = "photo_path") -> Column:
    """Why a row may not be stored; null if it may. Keys, paths and times must be there, scores lie between 0 and 100, shares between
    0 and 1, and sizes and counts are not negative. The first reason by column counts."""
    reason = F.lit(None).cast("string")
    for field in reversed(schema.fields):
        c, n = F.col(field.name), field.name
        if n in (key, path, "analyzed_at"):
            reason = F.when(c.isNull(), f"{n} is missing").otherwise(reason)
        elif n.endswith("_score"):
            reason = F.when(c.isNull() | F.isnan(c) | ~c.between(0, 100), f"{n} is not between 0 and 100").otherwise(reason)
        elif n.endswith("_coverage"):
            reason = F.when(F.isnan(c) | ~c.between(0, 1), f"{n} is not between 0 and 1").otherwise(reason)
        elif n.endswith("_count") or n == "file_size":
            reason = F.when(c < 0, f"{n} is negative").otherwise(reason)
    return reason


class CacheStore:
    """A table of one row for each key. schema: DDL of its columns. buckets is set when the store is made; a bucket should hold some hundred MB at most."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, buckets: int = 64, key: str = "photo_hash") -> None:
        self.spark, self.folder, self.key, self.schema = spark, folder.rstrip("/"), key, T.StructType.fromDDL(schema)
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._files.mkdirs(self._path(f"{self.folder}/manifest"))
        known = self._manifest(self.version())
        self.buckets = known["buckets"] if known else buckets

    def version(self) -> int:
        """The current version; 0 before anything was stored."""
        names = [x.getPath().getName() for x in self._files.listStatus(self._path(f"{self.folder}/manifest"))]
        return max([int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_"))], default=0)

    def _manifest(self, version: int) -> dict | None:
        if not version:
            return None
        stream = self._files.open(self._path(f"{self.folder}/manifest/{version}.json"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the current version, or of an earlier one."""
        manifest = self._manifest(self.version() if version is None else version)
        return self._read(sorted(manifest["folders"].values()) if manifest else [])

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _changed(self, touched: Callable[[DataFrame], DataFrame], change: Callable[[DataFrame], DataFrame], tries: int = 5) -> int:
        """Rewrites the buckets that touched (a table with a bucket column, from the current rows) names, by change. Gives their number."""
        for _ in range(tries):
            version = self.version()
            manifest = self._manifest(version) or {"buckets": self.buckets, "folders": {}}
            folders = manifest["folders"]
            wanted = [str(r["bucket"]) for r in touched(self._read(sorted(folders.values()))).select("bucket").distinct().collect()]  # self.buckets at most
            if not wanted:
                return 0
            before = self._read([folders[b] for b in wanted if b in folders])
            place = f"{self.folder}/data/{version + 1}-{uuid.uuid4().hex}"
            after = change(before).select(*self.schema.names).withColumn("bucket", self.bucket())
            after.repartition("bucket").write.partitionBy("bucket").parquet(place)
            made = {x.getPath().getName().removeprefix("bucket=") for x in self._files.listStatus(self._path(place)) if x.isDirectory()}
            now = {b: f for b, f in folders.items() if b not in wanted} | {b: f"{place}/bucket={b}" for b in made}
            if self.commit(version + 1, {"buckets": self.buckets, "folders": now}):
                return len(wanted)
            self._files.delete(self._path(place), True)
        raise Conflict(f"version {self.version()} of {self.folder} was taken by others {tries} times")

    def commit(self, version: int, manifest: dict) -> bool:
        """Puts the manifest in place under a name that must not be there yet."""
        waiting = self._path(f"{self.folder}/manifest/.{version}-{uuid.uuid4().hex}")
        stream = self._files.create(waiting, True)
        stream.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        stream.close()
        there = self._path(f"{self.folder}/manifest/{version}.json")
        done = not self._files.exists(there) and self._files.rename(waiting, there)
        if not done:
            self._files.delete(waiting, False)
        return bool(done)

    def upsert(self, fresh: DataFrame) -> DataFrame:
        """Stores the rows that pass the checks in the place of those of the same key (the latest analysis stays); gives the refused ones with their reason."""
        judged = fresh.select(*self.schema.names).withColumn("reason", refusal(self.schema, self.key))
        good = judged.filter("reason is null").drop("reason")
        self._changed(lambda _: good.withColumn("bucket", self.bucket()), lambda before: cache.upserted(before, good, self.key))
        return judged.filter("reason is not null")

    def delete(self, keys: DataFrame) -> int:
        """Deletes the rows of the keys; gives their number."""
        hit = self.read().join(keys.select(self.key).distinct(), self.key, "left_semi")
        count = hit.count()
        if count:
            self._changed(lambda now: now.join(keys.select(self.key).distinct(), self.key, "left_semi").withColumn("bucket", self.bucket()), lambda before: cache.without(before, keys, self.key))
        return count

    def delete_expired(self, now: Column, days: int = 365) -> int:
        """Deletes rows older than the days; only buckets that hold such rows are written."""
        old = lambda rows: rows.filter(~cache.alive(F.col("analyzed_at"), now, days))
        count = old(self.read()).count()
        if count:
            self._changed(lambda rows: old(rows).withColumn("bucket", self.bucket()), lambda before: cache.without_expired(before, now, days))
        return count

    def clear(self) -> int:
        """Deletes all rows by a manifest without buckets; gives their number."""
        count, version = self.read().count(), self.version()
        if count and not self.commit(version + 1, {"buckets": self.buckets, "folders": {}}):
            raise Conflict(f"version {version + 1} was taken by another writer")
        return count

    def vacuum(self, keep: int = 2) -> int:
        """Deletes the folders that none of the last `keep` versions names, and older manifests. Gives the number of folders."""
        last = self.version()
        versions = range(max(1, last - keep + 1), last + 1)
        used = reduce(lambda a, b: a | b, ({f.rsplit("/", 1)[0] for f in self._manifest(v)["folders"].values()} for v in versions), set())
        data, gone = self._path(f"{self.folder}/data"), 0
        for x in self._files.listStatus(data) if self._files.exists(data) else ():
            if x.getPath().getName() not in {u.rsplit("/", 1)[1] for u in used} and int(x.getPath().getName().split("-")[0]) <= last:
                gone += bool(self._files.delete(x.getPath(), True))
        for v in range(1, versions.start):
            self._files.delete(self._path(f"{self.folder}/manifest/{v}.json"), False)
        return gone
