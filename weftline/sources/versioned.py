"""A store of partitions that are replaced together or not at all.

A transaction stages its rows and the names of the partitions it replaces in a folder of its own,
checks them, and takes effect by one atomic rename: that of its entry into the log.  Until then
readers see the versions before; a transaction that failed leaves nothing but a folder which no
entry names.  Of two transactions with one number, the second finds the entry there and fails.
A partition's rows are those of the last transaction that named it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.constraints import counted, required

ENTRY = "%010d.json"


class Conflict(RuntimeError):
    """Another transaction took the number."""


class PartitionStore:
    """Rows by a partition column below ``path``: ``data/<id>/rows``, ``data/<id>/names``, ``log``."""

    def __init__(self, spark: SparkSession, path: str, by: str = "project"):
        self.spark, self.path, self.by = spark, path.rstrip("/"), by
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._jvm = spark.sparkContext._jvm.org.apache.hadoop.fs

    def _file(self, path: str):
        file = self._jvm.Path(path)
        return file.getFileSystem(self._conf), file

    def entries(self) -> dict[int, dict]:
        """The log: version to its entry (folder, counts). One small file a transaction."""
        store, folder = self._file(f"{self.path}/log")
        if not store.exists(folder):
            return {}
        names = sorted(f.getPath().getName() for f in store.listStatus(folder))
        files = [f"{self.path}/log/{n}" for n in names if n.endswith(".json") and not n.startswith(".")]
        if not files:
            return {}
        rows = self.spark.read.text(files, wholetext=True).collect()
        found = [json.loads(r[0]) for r in rows]
        return {e["version"]: e for e in sorted(found, key=lambda e: e["version"])}

    def version(self) -> int:
        """The last version, 0 for none."""
        return max(self.entries(), default=0)

    def _names(self, entries: Mapping[int, dict]) -> DataFrame:
        """(partition, version) of the last transaction that named each partition."""
        named = None
        for number, entry in entries.items():
            part = self.spark.read.parquet(f"{self.path}/data/{entry['folder']}/names").withColumn("__version", F.lit(number))
            named = part if named is None else named.unionByName(part)
        return named.groupBy(self.by).agg(F.max("__version").alias("__version"))

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows as of a version (the last); None for an empty store.

        Folders of partitions are pruned by the join with the names, which are few.
        """
        entries = {n: e for n, e in self.entries().items() if version is None or n <= version}
        if not entries:
            return None
        rows = None
        for number, entry in entries.items():
            part = self.spark.read.parquet(f"{self.path}/data/{entry['folder']}/rows").withColumn("__version", F.lit(number))
            rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
        if len(entries) == 1:
            return rows.drop("__version")
        names = self._names(entries).withColumnRenamed(self.by, "__name")
        return rows.join(names, rows[self.by].eqNullSafe(names["__name"]) & (rows["__version"] == names["__version"]), "left_semi").drop(
            "__version"
        )

    def replace(
        self,
        rows: DataFrame,
        names: DataFrame | None = None,
        rules: Mapping[str, Column] | None = None,
        counts: Mapping[str, Column] | None = None,
        check: Callable[[dict], None] | None = None,
    ) -> int:
        """Replaces whole partitions by ``rows`` and returns the version.

        ``names`` lists the partitions that go (those of ``rows``); one that is named and has no
        rows ends empty.  Rows of a partition that is not named are an error.  ``rules`` are
        checked row by row and ``counts`` are observed while the rows are staged, in the same
        pass; ``check`` takes the counts and raises to give the transaction up.
        """
        number, folder = self.version() + 1, uuid.uuid4().hex
        base = f"{self.path}/data/{folder}"
        try:
            staged, seen = counted(required(rows, rules or {}), {"rows": F.count(F.lit(1)), **(counts or {})})
            staged.write.partitionBy(self.by).parquet(f"{base}/rows")
            found = dict(seen.get)
            if found["rows"] == 0:  # a folder without rows has no schema of its own
                rows.limit(0).write.mode("overwrite").parquet(f"{base}/rows")
            kept = self.spark.read.schema(rows.schema).parquet(f"{base}/rows").select(self.by).distinct()
            names = kept if names is None else names.select(self.by).distinct()
            names.coalesce(1).write.parquet(f"{base}/names")
            written = self.spark.read.parquet(f"{base}/names").withColumnRenamed(self.by, "__name")
            stray = kept.join(written, kept[self.by].eqNullSafe(written["__name"]), "left_anti").first()
            if stray is not None:
                raise ValueError(f"rows of a partition that is not replaced: {stray[0]!r}")
            if check is not None:
                check(found)
            self._publish(number, {"version": number, "folder": folder, "counts": {k: v for k, v in found.items() if v is not None}})
        except BaseException:
            store, path = self._file(base)
            store.delete(path, True)
            raise
        return number

    def _publish(self, number: int, entry: dict) -> None:
        store, staged = self._file(f"{self.path}/log/.{uuid.uuid4().hex}")
        stream = store.create(staged, False)
        stream.write(bytearray(json.dumps(entry, default=str).encode()))
        stream.close()
        target = self._jvm.Path(f"{self.path}/log/{ENTRY % number}")
        context = self._jvm.FileContext.getFileContext(target.toUri(), self._conf)
        gateway = self.spark.sparkContext._gateway
        rename = getattr(self._jvm, "Options$Rename")
        options = gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            context.rename(context.makeQualified(staged), context.makeQualified(target), options)
        except Exception as error:
            store.delete(staged, False)
            if store.exists(target):
                raise Conflict(f"version {number} is there already") from error
            raise

    def vacuum(self) -> list[str]:
        """Deletes folders that the last version does not need, and returns their names.

        Not while a transaction runs: its folder has no entry yet.
        """
        entries = self.entries()
        needed = set()
        if entries:
            live = {r[0] for r in self._names(entries).select("__version").distinct().collect()} | {max(entries)}
            needed = {entries[n]["folder"] for n in live}
        store, data = self._file(f"{self.path}/data")
        gone = []
        for status in store.listStatus(data) if store.exists(data) else []:
            name = status.getPath().getName()
            if name not in needed:
                gone.append(name)
        for number, entry in entries.items():
            if entry["folder"] in gone:
                store.delete(self._jvm.Path(f"{self.path}/log/{ENTRY % number}"), False)
        for name in gone:
            store.delete(self._jvm.Path(f"{self.path}/data/{name}"), True)
        return gone
