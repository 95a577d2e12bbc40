"""Versioned snapshots of frames: the stores' sinks and transactions (SNK1, SNK11-SNK13, SNK15, SRC3-SRC9, IN5).

Parquet has no MERGE.  A store is a folder of numbered versions and of pointer files, of which the
one with the highest number counts.  A commit writes its tables beside the old ones, then a pointer
under another name, and renames that; until the rename readers see the old version, so a job that
fails at any point has changed nothing.  A second writer of the same version is refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Snapshots:
    """A store of named tables under one path of any file system that Spark can reach."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _pointers(self) -> list[int]:
        """The numbers of the versions that have a pointer."""
        at = self._path(self.path)
        if not self._fs.exists(at):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(at)]
        return sorted(int(n.split(".")[1]) for n in names if n.startswith("CURRENT.") and n.split(".")[1].isdigit())

    def _pointer(self) -> dict:
        """The pointer with the highest number; it is only there once it is whole."""
        held = self._pointers()
        if not held:
            return {"version": 0, "tables": {}}
        stream = self._fs.open(self._path(f"{self.path}/CURRENT.{held[-1]}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    @property
    def version(self) -> int:
        return self._pointer()["version"]

    def tables(self) -> list[str]:
        return sorted(self._pointer()["tables"])

    def read(self, table: str) -> DataFrame:
        """SRC5: a table of the current version; the version stays readable for the next ``keep`` commits."""
        tables = self._pointer()["tables"]
        if table not in tables:
            raise KeyError(table)
        return self.spark.read.parquet(f"{self.path}/{tables[table]}")

    def get(self, table: str, key: str, value) -> DataFrame:
        """SRC6: the row of one key; files are sorted by it, so minima and maxima rule most out."""
        df = self.read(table)
        return df.where(df[key] == value)

    def commit(self, new: dict[str, DataFrame], sort: dict[str, str] | None = None, partition: dict[str, str] | None = None) -> int:
        """SNK15: all tables of ``new`` at once; the others stay as they are."""
        held = self._pointer()
        version = held["version"] + 1
        tables = dict(held["tables"])
        for name, df in new.items():
            at = f"{name}/v{version}"
            if sort and name in sort:
                df = df.sortWithinPartitions(sort[name])
            w = df.write.mode("overwrite")
            if partition and name in partition:
                w = w.partitionBy(partition[name])
            w.parquet(f"{self.path}/{at}")
            tables[name] = at
        temp, at = self._path(f"{self.path}/_CURRENT.{version}.{uuid.uuid4().hex}"), self._path(f"{self.path}/CURRENT.{version}")
        stream = self._fs.create(temp, True)
        stream.write(bytearray(json.dumps({"version": version, "tables": tables}).encode()))
        stream.close()
        # Nothing is deleted or overwritten before the new pointer is there: until the rename the old one counts.
        if self._fs.exists(at) or not self._fs.rename(temp, at):
            self._fs.delete(temp, False)
            raise OSError(f"version {version} was committed by another writer, or {at} can't be written")
        self._clean(version)
        return version

    def _clean(self, version: int) -> None:
        """Removes pointers of more than ``keep`` commits ago and what none of the others names."""
        kept, tables = [], set()
        for v in self._pointers():
            at = self._path(f"{self.path}/CURRENT.{v}")
            if v < version - self.keep:
                self._fs.delete(at, False)
                continue
            kept.append(v)
            stream = self._fs.open(at)
            try:
                tables |= set(json.loads(bytes(stream.readAllBytes()).decode())["tables"].items())
            finally:
                stream.close()
        for name in {n for n, _ in tables}:
            for f in self._fs.listStatus(self._path(f"{self.path}/{name}")):
                number = f.getPath().getName().removeprefix("v")
                if number.isdigit() and int(number) < version and (name, f"{name}/v{number}") not in tables:
                    self._fs.delete(f.getPath(), True)

    def update(self, table: str, change: Callable[[DataFrame], DataFrame]) -> int:
        """A commit of one table as a function of its current rows."""
        return self.commit({table: change(self.read(table))})

    def clear(self, *tables: str) -> int:
        """SNK11: empty versions of tables."""
        return self.commit({t: self.read(t).limit(0) for t in tables})
