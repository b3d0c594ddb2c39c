"""The graph handle: tables of a snapshot, and one method per query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S
from loomgraph.model import CONFIDENCE, STRUCTURAL_KINDS, confidence_rank, within_floor
from loomgraph.operators import graph_joins as J
from loomgraph.operators import resolve as R
from loomgraph.operators import search as B
from loomgraph.operators import traverse as T
from loomgraph.operators.cut import cut
from loomgraph.sources.extract import extract
from loomgraph.sources.store import Store
from loomgraph.sources.worktree import classify, scan

TABLES = ("files", "symbols", "refs", "relations", "imports", "strings", "configs", "failures")


def tables_of(files: DataFrame, facts: DataFrame) -> dict[str, DataFrame]:
    """Relations of the graph from facts; references still unresolved."""
    pick = lambda kind: facts.where(F.col("fact") == kind)
    module = F.regexp_replace(F.regexp_replace(F.regexp_replace("file_path", r"\.[^./]+$", ""), r"(?:^|/)src(?=/)", ""), r"/(?:lib|main|mod|__init__|index)$", "")
    of_file = files.select(F.col("path").alias("file_path"), "lang")
    placed = lambda df: df.join(of_file, "file_path").withColumn("module", module)
    same = Window.partitionBy("file_path", "qualified", "kind").orderBy("span_start", "span_end")  # an id outlives edits that only move its symbol
    return {
        "files": files.select("path", "hash", "lang", "byte_len"),
        "symbols": placed(pick("symbol")).withColumn("nth", F.row_number().over(same)).select(F.xxhash64("file_path", "qualified", "kind", "nth").alias("id"), "file_path", "module", "lang", "name", "qualified", "kind", "span_start", "span_end", "line"),
        "refs": placed(pick("ref")).select(
            F.xxhash64("file_path", "name", "kind", "span_start", "span_end").alias("id"), F.col("file_path").alias("from_file"), "module", "lang", "name", "kind", "span_start", "span_end", "line",
            F.col("value").isNotNull().alias("receiver_unknown"), F.lit(None).cast("string").alias("target"),
        ),
        "relations": pick("relation").select("file_path", "name", "kind", "target", "span_start", "span_end"),
        "imports": pick("import").select(F.col("file_path").alias("from_file"), F.col("target").alias("target_path"), F.col("name").alias("target_symbol")),
        "strings": pick("string").select("file_path", "line", S.redact(F.col("value")).alias("value")),
        "configs": pick("config").select("file_path", "line", F.col("name").alias("key"), "kind"),
        "failures": pick("failure").select("file_path", F.col("value").alias("reason")),
    }


class Graph:
    """Queries over the current version of a store."""

    def __init__(self, store: Store, policy: str = "manual", window_seconds: float = 60.0, root: str | None = None):
        if policy not in ("manual", "on_read", "windowed"):
            raise ValueError(f"unknown policy {policy!r}")
        self.store, self.policy, self.window, self.root = store, policy, window_seconds, root
        self.resolved = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str, **options) -> Graph:
        return cls(Store(spark, path), **options)

    def sync(self, root: str | None = None, full: bool = False, version: str | None = None) -> dict[str, int]:
        """Bring the store to the tree at ``root``; one commit makes all current.

        Unchanged files keep their facts. Of references, those of new and modified files and those that ask
        a key whose definitions moved resolve anew (``resolved`` counts them), against the symbols that
        can answer them; all others keep their answers. The result equals that of a full build.
        """
        found = scan(self.store.spark, root or self.root).where("status = 'found'")
        first = self.store.manifest()["current"] is None
        known = found.select("path", "hash").limit(0) if first else self.store.read("files").select("path", "hash")
        diff = cut(classify(known, found, full))
        counts = {r["status"]: r["n"] for r in diff.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
        self.resolved = 0
        if not first and not set(counts) - {"unchanged"}:
            return counts
        todo = found.join(diff.where("status in ('new', 'modified')"), "path", "left_semi")
        facts = cut(extract(todo))
        fresh = tables_of(todo, facts)
        normal = lambda imports: imports.withColumn("target_path", S.normalize_module(F.col("target_path")))
        if first:
            stale, kept, changed = fresh["refs"], None, fresh
        else:
            touched = todo.select("path").unionByName(diff.where("status = 'deleted'").select("path")).distinct()
            column = {"files": "path", "refs": "from_file", "imports": "from_file"}
            old = {t: self.store.read(t) for t in TABLES}
            of = lambda t, how: old[t].join(touched, old[t][column.get(t, "file_path")] == touched.path, how)
            changed = {t: of(t, "left_anti").unionByName(fresh[t]) for t in TABLES if t != "refs"}
            others = of("refs", "left_anti")
            again = cut(R.dependents(of("symbols", "left_semi"), fresh["symbols"], others.drop("target_id", "confidence", "target"), normal(of("imports", "left_anti"))))
            stale, kept = fresh["refs"].drop("target").unionByName(again), others.join(again.select("id"), "id", "left_anti")
        stale = cut(stale.drop("target"))  # the extractors spell none
        self.resolved = stale.count()
        answered = R.resolve(stale, R.asked_symbols(stale, changed["symbols"]), normal(changed["imports"])).withColumn("target", F.lit(None).cast("string"))
        self.store.commit(changed | {"refs": answered if kept is None else kept.select(*answered.columns).unionByName(answered)}, version)
        return counts

    def ensure_synced(self) -> None:
        if self.root and (self.policy == "on_read" or self.policy == "windowed" and self.store.stale(self.window)):
            self.sync()

    def table(self, name: str) -> DataFrame:
        self.ensure_synced()
        return self.store.read(name)

    def edges(self) -> DataFrame:
        refs, symbols = self.table("refs"), self.table("symbols")
        inner = J.innermost(refs, symbols)
        joined = refs.join(inner, refs.id == inner.ref_id).where("target_id is not null and inner_id is not null")
        return joined.select(F.col("inner_id").alias("src"), F.col("target_id").alias("dst"), confidence_rank(F.col("confidence")).alias("category"), F.lit(0).alias("edge_class"), F.col("span_start").alias("ord"))

    def resolve_selector(self, selector: str) -> dict | None:
        """The symbol of ``symbol:path#name:kind``, a qualified match first."""
        body = selector.removeprefix("symbol:")
        if body == selector or "#" not in body or ":" not in body.split("#", 1)[1]:
            raise ValueError(f"not a symbol selector: {selector}")
        path, rest = body.split("#", 1)
        name, kind = rest.rsplit(":", 1)
        symbols = self.table("symbols").where((F.col("file_path") == path) & (F.col("kind") == kind))
        found = J.resolve_selectors(symbols.sparkSession.createDataFrame([(path, name, kind)], "file_path string, name string, kind string"), symbols).select(F.col("id").alias("r_id"))
        rows = symbols.join(found, F.col("id") == F.col("r_id")).drop("r_id").limit(1).collect()
        return rows[0].asDict() if rows else None

    def refs(self, selector: str, floor: str = "same_module", kind: str | None = None) -> dict:
        """Inbound references at or above ``floor``, how many were skipped, and the fuzzy ones where there are none."""
        target = self.resolve_selector(selector)
        if target is None:
            return {"entries": [], "skipped": 0, "fuzzy": False}
        all_refs = self.table("refs")
        bound = all_refs.where(F.col("target_id") == target["id"])
        if kind:
            if kind in STRUCTURAL_KINDS:
                bound = bound.limit(0)
            bound = bound.where(F.col("kind") == kind)
        keep = bound.where(within_floor(F.col("confidence"), floor)).orderBy("from_file", "span_start", "id").collect()
        skipped = bound.where(~within_floor(F.col("confidence"), floor)).count()
        fuzzy = not keep and floor != "fuzzy_name"
        if fuzzy:
            keep = all_refs.where((F.col("confidence") == "fuzzy_name") & (F.col("name") == target["name"]) & (F.col("kind") != "runtime_invocation")).orderBy("from_file", "span_start", "id").collect()
        return {"entries": [r.asDict() for r in keep], "skipped": skipped, "fuzzy": fuzzy}

    def callees(self, selector: str, hide_unresolved: bool = False) -> DataFrame:
        target = self.resolve_selector(selector)
        s = self.table("symbols")
        calls = J.callable_names(self.table("refs"), s) if hide_unresolved else self.table("refs")
        return J.enclosed_calls(s.where(F.col("id") == (target or {"id": None})["id"]), calls.select("id", "from_file", "name", "kind", "span_start", "span_end")).orderBy("span_start")

    def impact(self, selector: str, depth: int = 3, floor: str = "same_module", cap: int = T.NODE_CAP) -> tuple[DataFrame, bool]:
        target = self.resolve_selector(selector)
        if target is None:
            raise LookupError(selector)
        return T.impact(self.edges().where(F.col("category") <= CONFIDENCE[floor]), target["id"], depth, cap)

    def search(self, text: str, limit: int = 20, kind: str | None = None, lang: str | None = None) -> tuple[DataFrame, DataFrame]:
        """Symbols, strings and configuration keys that hold all words and quoted phrases of ``text``, best first, at most ``limit``; and one row: total (null if there are more) and truncated.

        ``kind`` is symbol, string or config and leaves the others out; ``lang`` is the file's.
        """
        if not text.strip() or limit < 1:
            raise ValueError("a query and a limit of one at least are needed")
        if kind not in (None, "symbol", "string", "config"):
            raise ValueError(f"unknown kind {kind!r}")
        symbols, strings, configs = self.table("symbols"), self.table("strings"), self.table("configs")
        key = lambda *columns: F.xxhash64(*columns)
        arms = {
            "symbol": symbols.select(F.col("id").alias("doc"), F.array("name", "qualified").alias("fields"), F.col("name").alias("label"), "qualified", F.col("file_path").alias("path"), "line"),
            "string": strings.select(key("file_path", "line", "value").alias("doc"), F.array("value").alias("fields"), F.col("value").alias("label"), F.lit(None).cast("string").alias("qualified"), F.col("file_path").alias("path"), "line"),
            "config": configs.select(key("file_path", "line", "key").alias("doc"), F.array("key").alias("fields"), F.col("key").alias("label"), F.lit(None).cast("string").alias("qualified"), F.col("file_path").alias("path"), "line"),
        }
        rows = None
        for name, arm in arms.items():
            if kind in (None, name):
                arm = arm.withColumn("kind", F.lit(name))
                rows = arm if rows is None else rows.unionByName(arm)
        rows = rows.dropDuplicates(["kind", "doc"])
        asked = rows.sparkSession.createDataFrame([(0, text)], "query int, text string")
        found = rows.join(self.table("files").where(F.col("lang") == lang).select("path"), "path", "left_semi") if lang else rows
        hits, state = B.phrase_search(rows, asked, limit, found.select("kind", "doc") if lang else None)
        out = hits.join(rows, ["kind", "doc"]).select("rank", "score", "kind", "label", "qualified", "path", "line").orderBy("rank")
        return out, state.select("total", "truncated")

    def overview(self, scope: str = "") -> DataFrame:
        return self.table("symbols").where(F.col("file_path").startswith(scope)).groupBy("lang", "kind").agg(F.count(F.lit(1)).alias("n")).orderBy("lang", "kind")

    def deps(self, scope: str) -> DataFrame:
        return J.dependencies(self.table("imports"), scope).orderBy("from_file", "target_path", F.asc_nulls_first("target_symbol"))

    def implementors(self, name: str) -> DataFrame:
        return self.table("relations").where(F.col("kind").isin(*STRUCTURAL_KINDS) & (S.trailing_segment(F.regexp_replace("target", r"\.", "::")) == name)).orderBy("file_path", "span_start")


def render(df: DataFrame, form: str = "table", limit: int = 50, emit: Callable[[str], None] = print) -> None:
    """At most ``limit`` rows as table, tsv, json or ndjson, with a notice if there are more."""
    import json

    rows = df.limit(limit + 1).collect()
    more, rows = len(rows) > limit, [r.asDict(recursive=True) for r in rows[:limit]]
    clean = lambda v: "" if v is None else str(v).replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n")
    if form == "json":
        emit(json.dumps({"rows": rows, "truncated": more}, default=str))
    elif form == "ndjson":
        for r in rows:
            emit(json.dumps(r, default=str))
    elif form == "tsv":
        emit("\t".join(df.columns))
        for r in rows:
            emit("\t".join(clean(r[c]) for c in df.columns))
    elif form == "table":
        cells = [df.columns, *[[clean(r[c]) for c in df.columns] for r in rows]]
        widths = [max(len(row[k]) for row in cells) for k in range(len(df.columns))]
        for row in cells:
            emit("  ".join(x.ljust(w) for x, w in zip(row, widths, strict=True)).rstrip())
        if more:
            emit(f"(first {limit} rows)")
    else:
        raise ValueError(f"unknown form {form!r}")
