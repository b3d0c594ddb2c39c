"""Caches of tables by key: symbols of a tree, snapshots of a commit. A table is complete before it has its name."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

EXTRACTOR_VERSION = 1


class TableCache:
    """Parquet tables below ``root``, one folder per key, with the time of their last use beside them.

    ``keep`` newest tables stay; older ones, and those unused for longer than
    ``max_age`` seconds, go at ``clean``. A key holds the extractor's version, so a new extractor finds nothing of the old.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int = 4, max_age: float | None = None, version: int = EXTRACTOR_VERSION, clock: Callable[[], float] = time.time):
        self.spark, self.root, self.keep, self.max_age, self.version, self.clock = spark, root.rstrip("/"), keep, max_age, version, clock
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def place(self, *key: str) -> str:
        return f"{self.root}/{hashlib.sha256(json.dumps([self.version, *key]).encode()).hexdigest()}"

    def _touch(self, place: str) -> None:
        out = self._fs.create(self._path(f"{place}.used"), True)
        out.write(bytearray(repr(self.clock()).encode()))
        out.close()

    def _used(self, place: str) -> float:
        at = self._path(f"{place}.used")
        if not self._fs.exists(at):
            return 0.0
        stream = self._fs.open(at)
        try:
            return float(bytes(stream.readAllBytes()).decode() or 0)
        finally:
            stream.close()

    def lookup(self, *key: str) -> DataFrame | None:
        place = self.place(*key)
        if not self._fs.exists(self._path(place)):
            return None
        self._touch(place)
        return self.spark.read.parquet(place)

    def stage(self, df: DataFrame) -> str:
        """A complete copy under a name that no key has."""
        staged = f"{self.root}/.staged-{uuid.uuid4().hex}"
        df.write.parquet(staged)
        return staged

    def publish(self, staged: str, *key: str) -> DataFrame:
        """Gives a staged table its key; of two publishers of one key the first wins."""
        place = self.place(*key)
        self._touch(place)
        if self._fs.exists(self._path(place)) or not self._fs.rename(self._path(staged), self._path(place)):
            self._fs.delete(self._path(staged), True)
        return self.spark.read.parquet(place)

    def get(self, build: Callable[[], DataFrame], *key: str) -> DataFrame:
        """The table of the key, built if there is none."""
        found = self.lookup(*key)
        if found is None:
            found = self.publish(self.stage(build()), *key)
            self.clean()
        return found

    def clean(self) -> int:
        """Deletes what is too old or beyond the newest ``keep``; how many tables went."""
        places = [f"{self.root}/{s.getPath().getName()}" for s in self._fs.listStatus(self._path(self.root)) if s.isDirectory() and not s.getPath().getName().startswith(".")]
        newest = sorted(places, key=lambda p: (-self._used(p), p))
        old = [p for k, p in enumerate(newest) if k >= self.keep or self.max_age is not None and self.clock() - self._used(p) > self.max_age]
        for p in old:
            self._fs.delete(self._path(p), True)
            self._fs.delete(self._path(f"{p}.used"), False)
        return len(old)
