"""Versioned Parquet tables behind numbered manifests: a version is complete before a manifest names it, and a manifest is never changed."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Manifests that stay beside the newest one, for readers that have just listed them.
OLD_MANIFESTS = 8
_PUBLISHING = threading.Lock()


class Store:
    """Tables of one snapshot below ``root``: ``versions/<folder>/<table>`` and ``manifests/<number>.json``, of which the highest counts.

    Paths may be of any file system that Spark writes. A manifest is written under
    another name and renamed to the next number, which fails where another
    writer has taken it; the loser reads that one and tries the number after it. So a writer
    that stops at any point leaves the last complete manifest in force, and of several writers none loses a
    version. (File systems whose rename replaces files are safe for the writers of one process.)
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def _numbers(self) -> list[int]:
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())

    def _latest(self) -> tuple[int, dict]:
        while numbers := self._numbers():
            at = self._path(f"{self.root}/manifests/{numbers[-1]:010d}.json")
            if not self._fs.exists(at):  # cleaned since, so there is a newer one
                continue
            stream = self._fs.open(at)
            try:
                return numbers[-1], json.loads(bytes(stream.readAllBytes()).decode())
            finally:
                stream.close()
        return 0, {"current": None, "versions": []}

    def manifest(self) -> dict:
        return self._latest()[1]

    def _rename(self, fresh, at) -> bool:
        """Whether ``fresh`` became ``at``, which must not be there."""
        with _PUBLISHING:
            return not self._fs.exists(at) and self._fs.rename(fresh, at)

    def _publish(self, change: Callable[[dict], bool], attempts: int = 100) -> None:
        """Make ``change`` to the newest manifest; it says whether there is anything to change."""
        for _ in range(attempts):
            number, now = self._latest()
            if not change(now):
                return
            fresh = self._path(f"{self.root}/manifests/{uuid.uuid4().hex}.tmp")
            out = self._fs.create(fresh, True)
            out.write(bytearray(json.dumps(now).encode()))
            out.close()
            if self._rename(fresh, self._path(f"{self.root}/manifests/{number + 1:010d}.json")):
                for old in self._numbers()[:-OLD_MANIFESTS]:
                    self._fs.delete(self._path(f"{self.root}/manifests/{old:010d}.json"), False)
                return
            self._fs.delete(fresh, False)
        raise OSError(f"the manifest of {self.root} could not be published: other writers went first {attempts} times")

    def commit(self, tables: dict[str, DataFrame], version: str | None = None) -> str:
        """Write all tables, then make them current in one step. A version that is there already is left as it is."""
        version = version or uuid.uuid4().hex
        if version in [v["id"] for v in self.manifest()["versions"]]:
            return version
        folder = f"{version}-{uuid.uuid4().hex}"  # a commit that was stopped, or another of the same id, is never written over
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/versions/{folder}/{name}")

        def add(now: dict) -> bool:
            if version in [v["id"] for v in now["versions"]]:
                return False
            now["versions"].append({"id": version, "folder": folder, "at": time.time(), "tables": sorted(tables)})
            now["current"] = version
            return True

        self._publish(add)
        return version

    def read(self, table: str, version: str | None = None) -> DataFrame:
        now = self.manifest()
        version = version or now["current"]
        if version is None:
            raise LookupError(f"{self.root} holds no version yet")
        folder = next((v["folder"] for v in now["versions"] if v["id"] == version), None)
        if folder is None:
            raise LookupError(f"{self.root} holds no version {version}")
        return self.spark.read.parquet(f"{self.root}/versions/{folder}/{table}")

    def replace_files(self, table: str, fresh: DataFrame, gone: DataFrame, column: str = "file_path") -> DataFrame:
        """The current table without the rows of ``gone`` and of the files in ``fresh``, and with ``fresh``."""
        stale = fresh.select(column).unionByName(gone.select(column)).distinct()
        return self.read(table).join(stale, column, "left_anti").unionByName(fresh)

    def stale(self, window_seconds: float) -> bool:
        """Whether the last commit is older than the window."""
        versions = self.manifest()["versions"]
        return not versions or time.time() - versions[-1]["at"] > window_seconds

    def clean(self, keep: int = 4, dry_run: bool = False) -> list[str]:
        """Delete all but the newest ``keep`` versions, and what stopped commits left an hour ago or earlier; the current version always stays. Returns the versions it names."""
        gone: list[dict] = []

        def drop(now: dict) -> bool:
            older = now["versions"][:-keep] if keep else now["versions"]
            gone[:] = [v for v in older if v["id"] != now["current"]]
            now["versions"] = [v for v in now["versions"] if v not in gone]
            return bool(gone) and not dry_run

        self._publish(drop)
        at = self._path(f"{self.root}/versions")
        if not dry_run and self._fs.exists(at):
            held = {v["folder"] for v in self.manifest()["versions"]}
            named = {v["folder"] for v in gone}
            for f in self._fs.listStatus(at):
                name = f.getPath().getName()
                if name in named or name not in held and f.getModificationTime() < 1000 * (time.time() - 3600):
                    self._fs.delete(f.getPath(), True)
        return [v["id"] for v in gone]
