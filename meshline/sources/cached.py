"""Results kept under the fingerprint of their inputs, key by key: what has not changed is read, not computed again.

A result's rows lie in a folder of their own for each refresh; a manifest (``key``, ``fp``, ``version``) says which folder
has a key's rows and what they were computed from. A new manifest is written beside the old ones and moved into place in
one step, so readers see the old state or the new one, and a lost executor or driver leaves the old one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

ENTRY = "key long, fp string, version string"


class ResultStore:
    def __init__(self, spark: SparkSession, root: str, version: str = "1"):
        """``version`` is part of every stamp: entries of another one are misses."""
        self.spark, self.root, self.stamp = spark, root.rstrip("/"), version

    # --- files ---

    def _path(self, *names: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *names]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _last(self, name: str) -> int:
        path, fs = self._path(name, "manifest")
        if not fs.exists(path):
            return 0
        return max((int(s.getPath().getName()) for s in fs.listStatus(path) if s.getPath().getName().isdigit()), default=0)

    def entries(self, name: str) -> DataFrame:
        """The manifest: ``key``, ``fp`` (with the store's version), ``version`` of the rows."""
        last = self._last(name)
        return self.spark.read.schema(ENTRY).parquet(f"{self.root}/{name}/manifest/{last}") if last else self.spark.createDataFrame([], ENTRY)

    def _publish(self, name: str, entries: DataFrame, last: int) -> None:
        """Write a manifest aside and move it into place; fails if another one has come in between."""
        aside = f"aside-{uuid.uuid4().hex}"
        entries.coalesce(1).write.parquet(f"{self.root}/{name}/{aside}")
        source, fs = self._path(name, aside)
        target, _ = self._path(name, "manifest", str(last + 1))
        fs.mkdirs(target.getParent())
        if fs.exists(target) or not fs.rename(source, target):
            raise RuntimeError(f"{name} was changed by another writer")

    def _stamped(self, wanted: DataFrame) -> DataFrame:
        return wanted.select("key", F.concat(F.lit(f"{self.stamp}:"), "fp").alias("fp"))

    # --- reading ---

    def hits(self, name: str, wanted: DataFrame) -> DataFrame:
        """Those of ``wanted(key, fp)`` that the store has, without reading any rows."""
        return wanted.join(self._stamped(wanted).join(self.entries(name), ["key", "fp"], "left_semi").select("key"), "key", "left_semi")

    def missing(self, name: str, wanted: DataFrame) -> DataFrame:
        return wanted.join(self._stamped(wanted).join(self.entries(name), ["key", "fp"], "left_semi").select("key"), "key", "left_anti")

    def read(self, name: str, wanted: DataFrame) -> DataFrame | None:
        """Rows of the wanted keys whose stored fingerprint is the wanted one; None where nothing was ever stored."""
        path, fs = self._path(name, "data")
        if not fs.exists(path):
            return None
        live = self.entries(name).join(self._stamped(wanted), ["key", "fp"], "left_semi").select("key", "version")
        # the folder's rows are met by version and key: folders that no entry names are not read
        return self.spark.read.parquet(f"{self.root}/{name}/data").join(live, ["key", "version"], "left_semi").drop("version")

    # --- writing ---

    def put(self, name: str, fresh: DataFrame, rows: DataFrame) -> None:
        """Replace the entries of ``fresh(key, fp)`` by ``rows`` (with a ``key``); a key without rows loses its entry."""
        version, last = uuid.uuid4().hex, self._last(name)
        rows.write.parquet(f"{self.root}/{name}/data/version={version}")
        there = self.spark.read.schema(rows.schema).parquet(f"{self.root}/{name}/data/version={version}").select("key").distinct()
        new = self._stamped(fresh).join(there, "key", "left_semi").withColumn("version", F.lit(version))
        kept = self.entries(name).join(fresh.select("key"), "key", "left_anti")
        self._publish(name, kept.unionByName(new), last)

    def refresh(self, name: str, wanted: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Rows of all ``wanted(key, fp)``: ``compute`` gets the keys whose fingerprint is new, and only if there are any.

        A key for which it gives no rows is not stored, so it is asked for again next time.
        """
        left = self.missing(name, wanted)
        if left.head(1):
            self.put(name, left, compute(left.select("key")))
        return self.read(name, wanted)

    def put_selections(self, name: str, fresh: DataFrame, rows: DataFrame) -> None:
        """``put``, but a key without rows leaves an entry that another fingerprint made; of its own one, nothing is left."""
        others = self.entries(name).join(self._stamped(fresh), ["key", "fp"], "left_anti").select("key")
        empty = fresh.join(rows.select("key").distinct(), "key", "left_anti").join(others, "key", "left_semi")
        self.put(name, fresh.join(empty.select("key"), "key", "left_anti"), rows)

    def prune(self, name: str, keep: DataFrame) -> None:
        """Drop the entries of keys that ``keep(key)`` doesn't have."""
        last = self._last(name)
        self._publish(name, self.entries(name).join(keep.select("key").distinct(), "key", "left_semi"), last)
