"""Queries over requests, reports, caches, worktrees, Git repositories, streams and the remaining rungs."""

from __future__ import annotations

import subprocess
import uuid
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark.sql import functions as F

from loomgraph.operators import history as H
from loomgraph.operators import reexports as P
from loomgraph.operators import resolve as R
from loomgraph.operators.cut import shared_folder
from loomgraph.plans import evaluate as V
from loomgraph.plans import evidence as E
from loomgraph.plans import registered_graph as G
from loomgraph.plans import registered_more as M
from loomgraph.plans import registered_rank as K
from loomgraph.plans import report as Q
from loomgraph.plans.catalog import query
from loomgraph.plans.graph import Graph, render
from loomgraph.sources import fixtures as X
from loomgraph.sources import git_source
from loomgraph.sources.caches import TableCache
from loomgraph.sources.worktree import scan
from loomgraph.streaming import watch


def fresh_folder(spark, name: str) -> str:
    """The path of a new folder in the shared one, on whatever file system that is."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def local_folder(spark, name: str) -> Path:
    """A fresh folder for trees of small files that the driver itself writes and Git reads; the shared folder must be a mounted one."""
    at = fresh_folder(spark, name)
    if not at.startswith(("/", "file:")):
        raise ValueError(f"{at} is no folder of a mounted file system, as trees of files need")
    at = Path("/" + at.removeprefix("file:").lstrip("/"))
    at.mkdir(parents=True)
    return at


@query("join_import_module", """SELECT source || '/' || lang || '/' || doc_id || '.py' AS path, 'tests/' || doc_id || '.py' AS from_file, CASE doc_id % 4 WHEN 1 THEN 'basename_only' ELSE 'identified' END AS tier FROM documents""")
def join_import_module(spark, d):
    """Each document's module, imported by a longer path, by its stem, from the root, and by path and name."""
    docs = G.docs(spark, d)
    key, place = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    paths = docs.select(F.concat_ws("/", "source", "lang", F.concat(key, F.lit(".py"))).alias("path"))
    target = F.when(place == 0, F.concat_ws(".", "lang", key)).when(place == 1, key).when(place == 2, F.concat_ws("::", F.lit("crate"), "source", "lang", key)).otherwise(F.concat_ws(".", "source", "lang"))
    imports = docs.select(F.concat(F.lit("tests/"), key, F.lit(".py")).alias("from_file"), target.alias("target_path"), F.when(place == 3, key).alias("target_symbol"))
    return E.import_matches(paths, imports).select("path", "from_file", "tier")


@query("res_self_super", G.SYM_SQL + """, f AS (SELECT *, split_part(module, '/', -1) AS tail FROM symbols WHERE kind = 'function'),
m AS (SELECT tail, name, count(*) AS n, sum(id) AS s FROM f GROUP BY ALL), o AS (SELECT file_path, name, count(*) AS n, sum(id) AS s FROM f GROUP BY ALL)
SELECT f.id, CASE WHEN o.n = 1 THEN 'exact' WHEN m.n - o.n = 1 THEN 'same_module' ELSE 'fuzzy_name' END AS confidence, (CASE WHEN o.n = 1 THEN o.s WHEN m.n - o.n = 1 THEN m.s - o.s END)::BIGINT AS target_id
FROM f JOIN m USING (tail, name) JOIN o USING (file_path, name)""")
def res_self_super(spark, d):
    """Every line function, asked for by a path relative to its own file: a free item of that name that is one there is exact, else one of the module."""
    functions = G.symbols(spark, d).where("kind = 'function'").withColumn("lang", F.lit("rust"))
    spelled = F.concat(F.when(F.col("id") % 2 == 0, "self::").otherwise("super::"), F.col("name"))
    refs = functions.select("id", F.col("file_path").alias("from_file"), "module", "lang", "name", F.lit("call").alias("kind"), spelled.alias("target"))
    return R.resolve(refs, functions).select("id", "confidence", "target_id")


@query("res_trait_default", """WITH refs AS (SELECT p_partkey AS ref_id, p_brand AS type, 'm' || p_partkey % 1500 AS member, p_size % 5 = 0 AS scoped FROM part),
impls AS (SELECT DISTINCT p_brand AS type, p_type AS trait, CASE WHEN p_brand LIKE '%1' OR p_brand LIKE '%2' THEN p_brand ELSE p_name END AS file FROM part),
decl AS (SELECT p_partkey AS id, p_type AS trait, 'm' || p_partkey % 1500 AS member FROM part), fl AS (SELECT type, count(DISTINCT file) AS n FROM impls GROUP BY type),
d AS (SELECT type, member, count(*) AS n, min(id) AS i FROM (SELECT DISTINCT type, trait FROM impls) JOIN decl USING (trait) GROUP BY ALL)
SELECT ref_id, i AS target_id FROM refs JOIN d USING (type, member) JOIN fl USING (type) WHERE d.n = 1 AND (scoped OR fl.n = 1)""")
def res_trait_default(spark, d):
    part = X.table(spark, d, "part")
    member = F.concat(F.lit("m"), (F.col("p_partkey") % 1500).cast("string")).alias("member")
    refs = part.select(F.col("p_partkey").alias("ref_id"), F.col("p_brand").alias("type"), member, F.lit(None).cast("string").alias("trait"), (F.col("p_size") % 5 == 0).alias("scoped"))
    file = F.when(F.col("p_brand").rlike("[12]$"), F.col("p_brand")).otherwise(F.col("p_name"))
    impls = part.select(F.col("p_brand").alias("type"), F.col("p_type").alias("trait"), file.alias("file"))
    return P.trait_defaults(refs, impls, part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("trait"), member))


@query("validate_request", """SELECT conv_id, turn, CASE WHEN trim(coalesce(CASE WHEN turn % 3 = 0 THEN text END, 't' || turn)) = '' THEN 'query' WHEN conv_id % 110 < 1 OR conv_id % 110 > 100 THEN 'limit'
WHEN turn % 2 = 0 AND (turn % 3 = 0 OR turn % 4 = 0) THEN 'task_snapshot' WHEN conv_id % 7 = 0 AND turn % 5 <> 0 THEN 'word_index' END AS invalid FROM conversations WHERE turn % 3 <> 0 OR text IS NOT NULL""")
def validate_request(spark, d):
    """Turns as requests: texts or tasks, with limits, snapshots and options that fit or don't."""
    c = X.table(spark, d, "conversations").where((F.col("turn") % 3 != 0) | F.col("text").isNotNull())
    task = F.concat(F.lit("t"), F.col("turn").cast("string"))
    asked = c.select(
        "conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.col("text")).alias("query"), F.when(F.col("turn") % 3 != 0, task).alias("task"), (F.col("conv_id") % 110).alias("limit"),
        F.when(F.col("turn") % 2 == 0, F.when(F.col("turn") % 4 == 0, F.lit("other")).otherwise(task)).alias("snapshot"),
        F.when(F.col("turn") % 5 == 0, "word_index").otherwise("combined").alias("variant"), (F.col("conv_id") % 7 == 0).alias("options"),
    )
    return asked.select("conv_id", "turn", Q.invalid_request(*(F.col(x) for x in ("query", "task", "limit", "snapshot", "variant", "options"))).alias("invalid"))


@query("chg_report", "WITH " + X.SYMBOLS_SQL + """, s AS (SELECT id, file_path, line_no FROM symbols WHERE line_no > 0),
t AS (SELECT concat_ws('/', source, lang, doc_id) AS file_path, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
SELECT id, file_path AS path, greatest(line_no - 5, 1) AS first_shown, least(line_no + 5, len(ls)) AS last_shown, array_to_string(ls[greatest(line_no - 5, 1):least(line_no + 5, len(ls))], chr(10)) AS excerpt FROM s JOIN t USING (file_path)""")
def chg_report(spark, d):
    """Every line function with five lines around it."""
    docs = G.docs(spark, d)
    texts = docs.select(X.doc_path(F.col("source"), F.col("lang"), F.col("doc_id")).alias("path"), "text")
    spans = G.symbols(spark, d).where("line_no > 0").select("id", F.col("file_path").alias("path"), F.col("line_no").alias("first"), F.col("line_no").alias("last"))
    return Q.excerpts(spans, texts).select("id", "path", "first_shown", "last_shown", "excerpt")


@query("fit_to_bytes", "SELECT 2000 AS max_bytes, true AS fits, true AS truncated UNION ALL SELECT 1000000, true, false UNION ALL SELECT 10, false, true")
def fit_to_bytes(spark, d):
    """Nations as symbols with long lists, fitted to three sizes."""
    names = [r["n_name"] for r in X.table(spark, d, "nation").orderBy("n_nationkey").collect()]  # 25 rows
    rows = []
    for size in (2000, 1_000_000, 10):
        document = {"symbols": [{"selector": n, "status": "changed", "callers": names, "entry_points": names[:9], "candidate_tests": []} for n in names]}
        rows.append((size, Q.fit_to_bytes(document, size), document.get("truncated", False)))
    return spark.createDataFrame(rows, "max_bytes int, fits boolean, truncated boolean")


STORED = "stored AS (SELECT o_orderpriority AS repository, 'main' AS landing_branch, o_orderkey AS delivery_id, CASE o_orderstatus WHEN 'F' THEN 'verified' ELSE 'git_only' END AS evidence, o_totalprice AS total FROM orders)"


def stored(spark, d):
    evidence = F.when(F.col("o_orderstatus") == "F", "verified").otherwise("git_only")
    return X.table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("repository"), F.lit("main").alias("landing_branch"), F.col("o_orderkey").alias("delivery_id"), evidence.alias("evidence"), F.col("o_totalprice").alias("total")
    )


@query("hist_rebuild", "WITH " + STORED + """, top AS (SELECT min(o_orderpriority) AS p FROM orders), stays AS (SELECT * FROM stored WHERE repository <> (SELECT p FROM top) OR evidence <> 'git_only'),
fresh AS (SELECT repository, landing_branch, delivery_id * 3 AS delivery_id, 'git_only' AS evidence, total FROM stored WHERE repository = (SELECT p FROM top))
SELECT * FROM stays UNION ALL SELECT * FROM fresh WHERE delivery_id NOT IN (SELECT delivery_id FROM stays WHERE repository = (SELECT p FROM top))""")
def hist_rebuild(spark, d):
    """One priority's deliveries extracted anew, under ids that partly are those of verified ones."""
    known = stored(spark, d)
    scope = known.agg(F.min("repository").alias("p")).first()["p"]
    fresh = known.where(F.col("repository") == scope).withColumns({"delivery_id": F.col("delivery_id") * 3, "evidence": F.lit("git_only")})
    return H.rebuild(known, fresh, scope, "main")


@query("hist_backfill", "WITH " + STORED + """, s AS (SELECT *, CASE WHEN delivery_id % 3 <> 0 THEN delivery_id END AS line_lengths FROM stored),
c AS (SELECT delivery_id FROM s WHERE line_lengths IS NULL ORDER BY delivery_id LIMIT 1000)
SELECT delivery_id, CASE WHEN s.line_lengths IS NULL AND delivery_id IN (SELECT delivery_id FROM c) AND delivery_id % 7 <> 0 THEN delivery_id + 1 ELSE line_lengths END AS line_lengths FROM s""")
def hist_backfill(spark, d):
    """Deliveries without line lengths, filled from a second extraction that differs in every seventh."""
    known = stored(spark, d).withColumn("line_lengths", F.when(F.col("delivery_id") % 3 != 0, F.col("delivery_id")))
    fresh = stored(spark, d).withColumns({"total": F.when(F.col("delivery_id") % 7 == 0, F.col("total") + 1).otherwise(F.col("total")), "line_lengths": F.col("delivery_id") + 1})
    return H.backfill(known, fresh, "line_lengths", 1000).select("delivery_id", "line_lengths")


@query("eval_sweep", K.TRUTH + """, c AS (SELECT CASE variant WHEN 'bm25' THEN 1 ELSE 0 END AS cell, hits, relevant, CASE WHEN first = 1 THEN 1 ELSE 0 END AS top FROM cases)
SELECT cell, round(avg(hits / relevant), 6) AS mean_recall, round(avg(top), 6) AS mean_symbol_recall FROM c GROUP BY cell ORDER BY avg(hits / relevant) DESC, avg(top) DESC, cell LIMIT 1""")
def eval_sweep(spark, d):
    """Two cells: the runs; a case's symbol recall is whether its first rank is right."""
    cases = K.cases(spark, d).select(F.when(F.col("variant") == "bm25", 1).otherwise(0).alias("cell"), "hits", "relevant", F.when(F.col("first") == 1, 1).otherwise(0).alias("symbol_hits"), F.lit(1).alias("symbol_relevant"))
    return V.sweep(cases).select("cell", F.round("mean_recall", 6).alias("mean_recall"), F.round("mean_symbol_recall", 6).alias("mean_symbol_recall"))


@query("eval_corpus", K.TRUTH + """, f AS (SELECT item_id AS query, ntile(5) OVER (ORDER BY length(text), item_id) - 1 AS fold FROM benchmark WHERE item_id IN (SELECT query FROM truth))
SELECT fold, variant, count(*) AS cases, round(sum(hits) / sum(relevant), 6) AS recall, round(avg(hits / relevant), 6) AS mean_recall, round(avg(coalesce(1 / first, 0)), 6) AS mrr FROM cases JOIN f USING (query) GROUP BY ALL""")
def eval_corpus(spark, d):
    """Benchmark items as cases, in the order of their lengths."""
    cases = X.table(spark, d, "benchmark").select(F.col("item_id").alias("case_id"), F.length("text").alias("cutoff"), "text")
    found = V.corpus(cases, K.runs(spark, d).withColumnRenamed("run", "variant"), K.truth(spark, d))
    return found.select("fold", "variant", "cases", *(F.round(c, 6).alias(c) for c in ("recall", "mean_recall", "mrr")))


@query("eval_live_git", K.DEL + """, ids AS (SELECT DISTINCT delivery_id, day, distance, verified FROM deliveries), held AS (SELECT * FROM ids ORDER BY distance, delivery_id DESC LIMIT 500),
known AS (SELECT * FROM deliveries WHERE day < (SELECT min(day) FROM held)), st AS (SELECT file, count(DISTINCT delivery_id) AS n, min(distance) AS last FROM known GROUP BY file),
tops AS (SELECT 'frequency' AS variant, file, row_number() OVER (ORDER BY n DESC, file) AS rank FROM st UNION ALL SELECT 'recency', file, row_number() OVER (ORDER BY last, file) FROM st),
t AS (SELECT DISTINCT delivery_id, verified, file FROM deliveries WHERE delivery_id IN (SELECT delivery_id FROM held)),
r AS (SELECT delivery_id, verified, count(*) AS relevant FROM t GROUP BY ALL),
h AS (SELECT delivery_id, variant, count(*) AS hits, min(rank) AS first FROM t JOIN tops USING (file) WHERE rank <= 10 GROUP BY ALL),
c AS (SELECT r.*, v.variant, coalesce(hits, 0) AS hits, first FROM r CROSS JOIN (VALUES ('frequency'), ('recency')) v(variant) LEFT JOIN h USING (delivery_id, variant)),
co AS (SELECT *, 'all' AS cohort FROM c UNION ALL SELECT *, 'verified' FROM c WHERE verified)
SELECT variant, cohort, count(*) AS cases, round(avg(hits / relevant), 6) AS recall, round(avg(coalesce(1 / first, 0)), 6) AS mrr FROM co GROUP BY ALL""")
def eval_live_git(spark, d):
    """The newest 500 deliveries, predicted from those of earlier days."""
    return V.live_holdout(K.dv(spark, d), 500).select("variant", "cohort", "cases", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"))


@query("target_symbol_cache", "WITH " + X.SYMBOLS_SQL + " SELECT id, name, qualified, kind FROM symbols")
def target_symbol_cache(spark, d):
    """The symbols of one tree, built once and then found under its key."""
    cache = TableCache(spark, fresh_folder(spark, "symbols"))
    build = lambda: G.symbols(spark, d).select("id", "name", "qualified", "kind")
    cache.get(build, "tree-1")
    found = cache.lookup("tree-1")
    assert found is not None and cache.lookup("tree-2") is None
    return found


@query("snapshot_cache", "SELECT 's' || i AS snapshot, i IN (0, 3, 4) AS kept FROM range(5) t(i)")
def snapshot_cache(spark, d):
    """Five snapshots in a cache of three; the first was used last but two."""
    ticks = iter(range(100))
    cache = TableCache(spark, fresh_folder(spark, "snapshots"), keep=3, clock=lambda: float(next(ticks)))
    region = X.table(spark, d, "region")
    for k in range(5):
        if k == 3:
            cache.lookup("s0", "index-1")
        cache.publish(cache.stage(region), f"s{k}", "index-1")
    cache.clean()
    return spark.createDataFrame([(f"s{k}", cache.lookup(f"s{k}", "index-1") is not None) for k in range(5)], "snapshot string, kept boolean")


@query("event_source", "SELECT event_id, user_id, event_type FROM events WHERE event_type NOT IN ('view', 'read')")
def event_source(spark, d):
    """The events' file as a stream, filtered and written batch by batch."""
    at = fresh_folder(spark, "events")
    events = watch.event_source(spark, d, X.table(spark, d, "events").schema, "events.parquet")
    out = watch.relevant(events).select("event_id", "user_id", "event_type")
    out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/cp").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/out")


@query("stream_coalesce", "SELECT i::INT AS caller, (SELECT count(*) FROM documents) AS files FROM range(8) t(i)")
def stream_coalesce(spark, d):
    """Eight callers of one refresh."""
    shared = watch.Coalescer(lambda: G.docs(spark, d).count())
    with ThreadPoolExecutor(8) as pool:
        found = list(pool.map(lambda _: shared(), range(8)))
    return spark.createDataFrame(list(enumerate(found)), "caller int, files long")


@query("progress_phases", "WITH " + X.REFS_SQL + " SELECT 'extracting' AS phase, (SELECT count(*) FROM symbols) AS rows UNION ALL SELECT 'resolving', (SELECT count(*) FROM raw_refs)")
def progress_phases(spark, d):
    seen = []
    progress = watch.Progress(spark, lambda phase, rows: seen.append((phase, rows)))
    symbols = progress.phase("extracting", G.symbols(spark, d))
    progress.phase("resolving", R.resolve(X.raw_refs(G.docs(spark, d)), symbols))
    return spark.createDataFrame(seen, "phase string, rows long")


@query("graph_handle", "WITH " + X.SYMBOLS_SQL + " SELECT lang, kind, count(*) AS n FROM symbols GROUP BY ALL")
def graph_handle(spark, d):
    """The overview that a handle on a store with the documents' graph gives."""
    store = M.new_store(spark)
    store.commit({"symbols": G.symbols(spark, d)})
    return Graph.open(spark, store.root).overview()


@query("windowed_policy", "SELECT w AS window_seconds, w < 3600 AS stale FROM (VALUES (0.0::DOUBLE), (3600.0::DOUBLE)) t(w)")
def windowed_policy(spark, d):
    store = M.new_store(spark)
    store.commit({"region": X.table(spark, d, "region")})
    return spark.createDataFrame([(w, store.stale(w)) for w in (0.0, 3600.0)], "window_seconds double, stale boolean")


@query("sink_render", "SELECT 0 AS line, 'n_nationkey' || chr(9) || 'n_name' AS text UNION ALL SELECT n_nationkey + 1, n_nationkey || chr(9) || n_name FROM nation")
def sink_render(spark, d):
    lines = []
    render(X.table(spark, d, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey"), "tsv", 100, lines.append)
    return spark.createDataFrame(list(enumerate(lines)), "line int, text string")


def nation_tree(spark, d) -> tuple[Path, list]:
    """A small tree of one file for each of the 25 nations."""
    at = local_folder(spark, "tree")
    rows = X.table(spark, d, "nation").orderBy("n_nationkey").collect()
    for r in rows:
        (at / f"r{r['n_regionkey']}").mkdir(exist_ok=True)
        (at / f"r{r['n_regionkey']}" / f"n{r['n_nationkey']}.py").write_text(f"{r['n_name']}\nname = 1\n")
    return at, rows


@query("scan_worktree", "SELECT 'r' || n_regionkey || '/n' || n_nationkey || '.py' AS path, 'python' AS lang, 'found' AS status, (length(n_name) + 10)::BIGINT AS byte_len FROM nation WHERE n_regionkey <> 4 AND n_nationkey % 7 <> 3")
def scan_worktree(spark, d):
    """A tree whose ignore files leave out a directory and some files."""
    at, rows = nation_tree(spark, d)
    (at / ".gitignore").write_text("# left out\n/r4/\n")
    for region in {r["n_regionkey"] for r in rows}:
        (at / f"r{region}" / ".ignore").write_text("".join(f"n{r['n_nationkey']}.py\n" for r in rows if r["n_nationkey"] % 7 == 3))
    return scan(spark, str(at)).where("lang = 'python'").select("path", "lang", "status", "byte_len")


def nation_repository(spark, d) -> str:
    """The tree as a first commit; a second one renames, rewrites, indents and deletes files."""
    at, rows = nation_tree(spark, d)
    git = lambda *args: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", "-C", str(at), *args], check=True, capture_output=True)
    git("init", "-q", "-b", "main")
    git("add", "-A")
    git("commit", "-q", "-m", "first")
    for r in rows:
        file = at / f"r{r['n_regionkey']}" / f"n{r['n_nationkey']}.py"
        match r["n_nationkey"] % 5:
            case 1:
                file.write_text(f"{r['n_name']}\nname = 2\nmore\n")
            case 2:
                file.write_text(f"{r['n_name']}\n  name = 1\n")
            case 3:
                file.rename(file.with_name(f"moved{r['n_nationkey']}.py"))
            case 4:
                file.unlink()
    git("add", "-A")
    git("commit", "-q", "-m", "second")
    git_source.register(spark)
    return str(at)


@query("scan_git_tree", """SELECT 'r' || n_regionkey || CASE n_nationkey % 5 WHEN 3 THEN '/moved' ELSE '/n' END || n_nationkey || '.py' AS path, n_name AS head FROM nation WHERE n_nationkey % 5 <> 4""")
def scan_git_tree(spark, d):
    tree = spark.read.format("git_tree").option("path", nation_repository(spark, d)).load()
    return tree.where("skipped is null").select("path", F.element_at(F.split(F.decode("content", "UTF-8"), "\n"), 1).alias("head"))


@query("scan_git_history", """SELECT 0::BIGINT AS place, 'A' AS change, NULL AS old_path, 'r' || n_regionkey || '/n' || n_nationkey || '.py' AS new_path FROM nation UNION ALL
SELECT 1, CASE n_nationkey % 5 WHEN 3 THEN 'R' WHEN 4 THEN 'D' ELSE 'M' END, 'r' || n_regionkey || '/n' || n_nationkey || '.py',
CASE WHEN n_nationkey % 5 = 3 THEN 'r' || n_regionkey || '/moved' || n_nationkey || '.py' WHEN n_nationkey % 5 <> 4 THEN 'r' || n_regionkey || '/n' || n_nationkey || '.py' END FROM nation WHERE n_nationkey % 5 <> 0""")
def scan_git_history(spark, d):
    history = spark.read.format("git_history").option("path", nation_repository(spark, d)).load()
    return history.select("place", "change", "old_path", "new_path")


@query("hist_extract_delivery", """SELECT CASE n_nationkey % 5 WHEN 3 THEN 'R' WHEN 4 THEN 'D' ELSE 'M' END AS change, 'r' || n_regionkey || '/n' || n_nationkey || '.py' AS old_path, n_nationkey % 5 = 2 AS whitespace_only,
CASE n_nationkey % 5 WHEN 1 THEN '2,1,2,2' WHEN 2 THEN '2,1,2,1' WHEN 3 THEN '' ELSE '1,2,0,0' END AS hunks FROM nation WHERE n_nationkey % 5 <> 0""")
def hist_extract_delivery(spark, d):
    found = spark.read.format("git_deliveries").option("path", nation_repository(spark, d)).load().where("parent is not null")
    spelled = F.array_join(F.transform("hunks", lambda h: F.concat_ws(",", h.old_first, h.old_lines, h.new_first, h.new_lines)), ";")
    return found.select("change", "old_path", "whitespace_only", spelled.alias("hunks"))


@query("chg_default_base", "SELECT 'first' AS message")
def chg_default_base(spark, d):
    """Without an upstream or a remote, the parent commit."""
    repo = nation_repository(spark, d)
    message = git_source.git(repo, "show", "-s", "--format=%s", git_source.default_base(repo)).decode().strip()
    return spark.createDataFrame([(message,)], "message string")
