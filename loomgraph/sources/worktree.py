"""Source trees on a file system: scan, difference with what is known, manifests."""

from __future__ import annotations

import contextlib
import fnmatch
import json
import os
import re
import tomllib
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomgraph.model import MAX_FILE_BYTES

# File endings of the languages, and directories and endings that a scan leaves out.
LANGUAGES = {
    "rs": "rust", "c": "c", "h": "c", "md": "markdown", "markdown": "markdown", "yaml": "config", "yml": "config", "toml": "config", "json": "config", "env": "config",
    "java": "java", "js": "javascript", "jsx": "javascript", "kt": "kotlin", "kts": "kotlin", "cs": "csharp", "go": "go", "py": "python", "rb": "ruby", "ts": "typescript", "tsx": "typescript",
}
SKIPPED_DIRS = (".git", "target", "node_modules", "dist", "build", ".venv", "venv", "__pycache__", ".next", "vendor")
SKIPPED_ENDINGS = ("png", "jpg", "jpeg", "gif", "ico", "pdf", "zip", "gz", "tar", "woff", "woff2", "ttf", "so", "dylib", "dll", "exe", "bin", "lock")


def language_of(path: Column) -> Column:
    ending = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.lit(None).cast("string")
    for name in sorted(set(LANGUAGES.values())):
        out = F.when(ending.isin(*[e for e, x in LANGUAGES.items() if x == name]), name).otherwise(out)
    return out


#: Files whose lines name what a scan leaves out below their directory.
IGNORE_FILES = (".gitignore", ".ignore")


def ignore_pattern(line: str, below: str) -> tuple[str, bool] | None:
    """A line of an ignore file in the directory ``below`` (empty, or with a slash at its end): a regex of paths, and whether it leaves out rather than takes back."""
    text = line.rstrip("\r\n").rstrip()
    takes_back = text.startswith("!")
    text = text[takes_back:]
    if not text or text.startswith("#"):
        return None
    folder, text = text.endswith("/"), text.strip("/") if text.startswith("/") else text.rstrip("/")
    anchored = line.lstrip("!").startswith("/") or "/" in text
    out, k = [], 0
    while k < len(text):
        if text.startswith("**/", k):
            out.append("(?:[^/]+/)*")
            k += 3
        elif text.startswith("/**", k) and k + 3 == len(text):
            out.append("/.*")
            k += 3
        elif text[k] == "*":
            out.append("[^/]*")
            k += 1
        elif text[k] == "?":
            out.append("[^/]")
            k += 1
        elif text[k] == "[" and "]" in text[k + 2 :]:
            end = text.index("]", k + 2)
            out.append("[" + text[k + 1 : end].replace("\\", "\\\\").replace("!", "^", 1 if text[k + 1] == "!" else 0) + "]")
            k = end + 1
        else:
            k += text[k] == "\\" and k + 1 < len(text)
            out.append(re.escape(text[k]))
            k += 1
    lead = re.escape(below) + ("" if anchored else "(?:.*/)?")
    return f"^{lead}{''.join(out)}{'/.*' if folder else '(?:/.*)?'}$", not takes_back


def walk(root: str, ignore: list[str]) -> Iterator[tuple[str, int, float]]:
    """(path below root, bytes, modification time) of the files of a tree, in order.

    Directories that are left out are not entered, symbolic links not followed. The last line that speaks of a path
    decides; ignore files of deeper directories go after those above, and ``ignore`` (globs of whole paths) after all.
    """
    globs = [re.compile(fnmatch.translate(g)) for g in ignore]

    def below(folder: str, rules: list[tuple[re.Pattern, bool]]) -> Iterator[tuple[str, int, float]]:
        try:
            entries = sorted(os.scandir(os.path.join(root, folder)), key=lambda e: e.name)
        except OSError:
            yield folder, -1, 0.0  # a directory that can't be read fails alone
            return
        for entry in entries:
            if entry.name in IGNORE_FILES and entry.is_file(follow_symlinks=False):
                with contextlib.suppress(OSError), open(entry.path, encoding="utf-8", errors="replace") as lines:
                    found = [ignore_pattern(line, folder) for line in lines]
                    rules = [*rules, *((re.compile(x[0]), x[1]) for x in found if x)]
        for entry in entries:
            path = folder + entry.name
            inside = entry.is_dir(follow_symlinks=False)
            spoken = [out for pattern, out in rules if pattern.match(path + "/" * inside)]
            if spoken and spoken[-1] or entry.is_symlink() or any(g.match(path) for g in globs):
                continue
            if inside:
                if entry.name not in SKIPPED_DIRS:
                    yield from below(path + "/", rules)
            elif entry.name.rsplit(".", 1)[-1].lower() not in SKIPPED_ENDINGS or "." not in entry.name:
                try:
                    at = entry.stat(follow_symlinks=False)
                    yield path, at.st_size, at.st_mtime
                except OSError:
                    yield path, -1, 0.0

    yield from below("", [])


class Files(InputPartition):
    def __init__(self, items: list[tuple[str, int, float]]):
        super().__init__(len(items))
        self.items = items


class WorktreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.ignore, self.files, self.bytes = options["path"], json.loads(options.get("ignore", "[]")), int(options.get("filesPerPartition", "500")), int(options.get("bytesPerPartition", str(64 << 20)))

    def partitions(self) -> list[Files]:
        out, size = [[]], 0
        for item in walk(self.root, self.ignore):
            size += max(0, item[1])
            if out[-1] and (len(out[-1]) == self.files or size > self.bytes):
                out.append([])
                size = max(0, item[1])
            out[-1].append(item)
        return [Files(x) for x in out]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path, size, at in partition.items:
            content, status = None, "oversize" if size > MAX_FILE_BYTES else "unreadable" if size < 0 else "found"
            if status == "found":
                try:
                    with open(os.path.join(self.root, path), "rb") as file:
                        content = file.read(MAX_FILE_BYTES + 1)
                    if len(content) > MAX_FILE_BYTES:
                        content, status = None, "oversize"
                except OSError:
                    status = "unreadable"
            safe = path.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
            yield safe, content, max(0, size), datetime.fromtimestamp(at, UTC), status


class Worktree(DataSource):
    """Files of a source tree: options path, ignore (a JSON list of globs), filesPerPartition, bytesPerPartition. The tree must be readable where tasks run."""

    @classmethod
    def name(cls) -> str:
        return "worktree"

    def schema(self) -> str:
        return "path string, content binary, byte_len long, modified timestamp, status string"

    def reader(self, schema) -> WorktreeReader:
        return WorktreeReader(self.options)


def scan(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    """path (below root), content, byte_len, modified, hash, lang, status of every file; status is found, oversize or unreadable.

    Contents of oversize files are not read, and a file or directory that can't be read fails alone. Ignore files of the
    tree hold for what lies below them. ``ignore``: further globs of paths below root.
    """
    spark.dataSource.register(Worktree)
    files = spark.read.format("worktree").option("path", root.removeprefix("file://").removeprefix("file:")).option("ignore", json.dumps(ignore or [])).load()
    return files.select("path", "content", "byte_len", "modified", F.sha2("content", 256).alias("hash"), language_of(F.col("path")).alias("lang"), "status")


def classify(known: DataFrame, found: DataFrame, full: bool = False) -> DataFrame:
    """(path, status): unchanged, modified, new or deleted, by content hash; a full scan takes all that exists for modified."""
    a, b = known.select(F.col("path").alias("a_path"), F.col("hash").alias("a_hash")), found.select(F.col("path").alias("b_path"), F.col("hash").alias("b_hash"))
    joined = a.join(b, a.a_path == b.b_path, "full_outer")
    same = F.lit(False) if full else F.col("a_hash").eqNullSafe(F.col("b_hash"))
    status = F.when(F.col("a_path").isNull(), "new").when(F.col("b_path").isNull(), "deleted").when(same, "unchanged").otherwise("modified")
    return joined.select(F.coalesce("a_path", "b_path").alias("path"), status.alias("status"))


def program_names(manifests: DataFrame) -> DataFrame:
    """(path, name) of the programs that Cargo.toml and pyproject.toml files (path, content) declare; broken ones give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    parsed = tomllib.loads(bytes(content).decode())
                except (tomllib.TOMLDecodeError, UnicodeDecodeError):
                    continue
                if path.endswith("Cargo.toml"):
                    names = [b.get("name") for b in parsed.get("bin", [])] or [parsed.get("package", {}).get("name")]
                else:
                    project = parsed.get("project", {})
                    names = [*project.get("scripts", {}), *parsed.get("tool", {}).get("poetry", {}).get("scripts", {})] or [project.get("name")]
                rows += [(path, n) for n in names if n]
            yield pd.DataFrame(rows, columns=["path", "name"])

    chosen = manifests.where(F.col("path").rlike(r"(?:^|/)(?:Cargo|pyproject)\.toml$"))
    return chosen.select("path", "content").mapInPandas(run, "path string, name string")


def read_window(files: DataFrame, max_bytes: int = 65536) -> DataFrame:
    """The bytes span_start..span_end of (content, span_start, span_end), at most ``max_bytes`` and ending between characters, as text."""
    from loomgraph.functions.terms import cut_utf8

    @F.pandas_udf("string")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda b: None if b is None else cut_utf8(bytes(b), max_bytes).decode("utf-8", "replace"))

    span = F.substring("content", F.col("span_start").cast("int") + 1, F.least(F.col("span_end") - F.col("span_start"), F.lit(max_bytes + 4)).cast("int"))
    return files.withColumns({"window": cut(span), "truncated": F.col("span_end") - F.col("span_start") > max_bytes})
