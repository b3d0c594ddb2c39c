"""Git trees and histories as Spark data sources. Repositories must be readable where tasks run."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomgraph.model import MAX_FILE_BYTES


_HUNK = re.compile(rb"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", re.M)


def git(repo: str, *args: str) -> bytes:
    return subprocess.run(["git", "-c", "safe.directory=*", "-C", repo, *args], check=True, capture_output=True).stdout


class Slice(InputPartition):
    def __init__(self, items: list[tuple]):
        super().__init__(len(items))
        self.items = items


def slices(items: list[tuple], size: int) -> list[Slice]:
    return [Slice(items[k : k + size]) for k in range(0, len(items), size)] or [Slice([])]


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.repo, self.revision, self.size = options["path"], options.get("revision", "HEAD"), int(options.get("filesPerPartition", "500"))

    def partitions(self) -> list[Slice]:
        rows = []
        for entry in git(self.repo, "ls-tree", "-r", "-l", "-z", self.revision).split(b"\0"):
            if entry:
                head, name = entry.split(b"\t", 1)
                mode, kind, blob, size = head.split()
                rows.append((name.decode("utf-8", "surrogateescape"), mode.decode(), kind.decode(), blob.decode(), size.decode()))
        return slices(rows, self.size)

    def read(self, partition: Slice) -> Iterator[tuple]:
        for name, mode, kind, blob, size in partition.items:
            reason = (
                "submodule" if kind == "commit" else "symlink" if mode == "120000" else "oversize" if int(size) > MAX_FILE_BYTES
                else "unsafe_name" if ".." in name.split("/") or any("\udc80" <= c <= "\udcff" for c in name) else None
            )
            safe = name.encode("utf-8", "replace").decode()
            yield (safe, blob, None if reason else git(self.repo, "cat-file", "blob", blob), reason)


class GitTree(DataSource):
    """Blobs of a revision: options path, revision, filesPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "git_tree"

    def schema(self) -> str:
        return "path string, blob string, content binary, skipped string"

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


class HistoryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.repo, self.tip, self.after = options["path"], options.get("tip", "HEAD"), options.get("after")
        self.limit, self.size = int(options.get("limit", "1000")), int(options.get("commitsPerPartition", "50"))

    def partitions(self) -> list[Slice]:
        span = f"{self.after}..{self.tip}" if self.after else self.tip
        found = git(self.repo, "rev-list", "--first-parent", "--reverse", "--parents", span).decode().split("\n")
        rows = [tuple(x.split()[:2]) if " " in x else (x, None) for x in found if x][: self.limit]
        return slices([(k, *r) for k, r in enumerate(rows)], self.size)

    def read(self, partition: Slice) -> Iterator[tuple]:
        for place, commit, parent in partition.items:
            at, message = git(self.repo, "show", "-s", "--format=%ct%x00%B", commit).decode("utf-8", "replace").split("\0", 1)
            base = parent or "4b825dc642cb6eb9a060e54bf8d69288fbee4904"  # the empty tree
            changes = git(self.repo, "diff-tree", "-r", "-M", "-C", "-z", "--name-status", base, commit).decode("utf-8", "replace").split("\0")
            k = 0
            while k < len(changes) - 1:
                kind = changes[k][0]
                moved = kind in "RC"
                old, new = changes[k + 1], changes[k + 2] if moved else changes[k + 1]
                yield (place, commit, parent, int(at), message.strip(), kind, None if kind == "A" else old, None if kind == "D" else new)
                k += 3 if moved else 2


class GitHistory(DataSource):
    """Changed files of the first-parent commits after a cursor, oldest first: options path, tip, after, limit."""

    @classmethod
    def name(cls) -> str:
        return "git_history"

    def schema(self) -> str:
        return "place long, commit string, parent string, at long, message string, change string, old_path string, new_path string"

    def reader(self, schema) -> HistoryReader:
        return HistoryReader(self.options)


def hunks(repo: str, old: str | None, new: str | None, *options: str) -> list[tuple[int, int, int, int]]:
    """(old first, old lines, new first, new lines) of what differs between two blobs; a missing side has no lines."""
    if old is None or new is None:
        n = len(git(repo, "cat-file", "blob", old or new).splitlines())
        return [] if not n else [(1, n, 0, 0)] if new is None else [(0, 0, 1, n)]
    found = _HUNK.findall(git(repo, "diff", "--no-color", "-U0", *options, old, new))
    return [(int(a), int(b or 1), int(c), int(d or 1)) for a, b, c, d in found]


class DeliveryReader(HistoryReader):
    def read(self, partition: Slice) -> Iterator[tuple]:
        for _, commit, parent in partition.items:
            base = parent or "4b825dc642cb6eb9a060e54bf8d69288fbee4904"  # the empty tree
            fields = git(self.repo, "diff-tree", "-r", "-M", "-C", "-z", "--raw", "--no-abbrev", base, commit).split(b"\0")
            k = 0
            while k < len(fields) - 1:
                _, _, old_blob, new_blob, kind = fields[k].decode().lstrip(":").split(" ")
                moved = kind[0] in "RC"
                old, new = (fields[k + j].decode("utf-8", "replace") for j in ((1, 2) if moved else (1, 1)))
                before, after = (None if not b.strip("0") else b for b in (old_blob, new_blob))
                changed = hunks(self.repo, before, after) if before != after else []
                spaces = bool(changed) and None not in (before, after) and not hunks(self.repo, before, after, "-w")
                yield (commit, parent, kind[0], None if before is None else old, None if after is None else new, changed, spaces)
                k += 3 if moved else 2


class GitDeliveries(DataSource):
    """Changed files of first-parent commits with renames, copies, changed line ranges, and whether only white space changed: options of git_history."""

    @classmethod
    def name(cls) -> str:
        return "git_deliveries"

    def schema(self) -> str:
        return (
            "commit string, parent string, change string, old_path string, new_path string, "
            "hunks array<struct<old_first: long, old_lines: long, new_first: long, new_lines: long>>, whitespace_only boolean"
        )

    def reader(self, schema) -> DeliveryReader:
        return DeliveryReader(self.options)


def register(spark: SparkSession) -> None:
    for source in (GitTree, GitHistory, GitDeliveries):
        spark.dataSource.register(source)


def default_base(repo: str) -> str:
    """The merge base of HEAD and its upstream, else of the remote's default branch, else the parent commit."""
    for other in ("@{upstream}", "origin/HEAD"):
        try:
            return git(repo, "merge-base", "HEAD", other).decode().strip()
        except subprocess.CalledProcessError:
            continue
    return git(repo, "rev-parse", "HEAD~1").decode().strip()
