"""More queries: history, evidence, filters, evaluation, re-exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import scalars as S
from loomgraph.operators import graph_joins as J
from loomgraph.operators import history as H
from loomgraph.operators import reexports as P
from loomgraph.operators import resolve as RS
from loomgraph.operators import search as B
from loomgraph.operators import traverse as T
from loomgraph.plans import changes as C
from loomgraph.plans import evaluate as V
from loomgraph.plans import evidence as E
from loomgraph.plans import recommend as R
from loomgraph.plans import registered_graph as G
from loomgraph.plans import registered_rank as K
from loomgraph.plans import registered_scalars as L
from loomgraph.plans.catalog import query
from loomgraph.sources import fixtures as X
from loomgraph.sources import worktree as W


@query("ev_outbound", G.PATHS_SQL.replace("e AS (SELECT src, dst, min(category)", "e AS (SELECT dst AS src, src AS dst, min(category)"))
def ev_outbound(spark, d):
    turned = G.edges(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "category")
    return T.evidence_paths(turned, G.origins(spark, d), depth=3)


@query("ev_no_path_reasons", G.EDGES_SQL + " SELECT id AS origin, 'no_inbound_edge' AS reason FROM symbols WHERE kind = 'function' AND id NOT IN (SELECT dst FROM edges WHERE src <> dst)")
def ev_no_path_reasons(spark, d):
    return E.no_path_reasons(G.origins(spark, d), T.evidence_paths(G.edges(spark, d), G.origins(spark, d), depth=1))


@query("ev_entry_points", G.PATHS_SQL[: G.PATHS_SQL.rindex("SELECT origin, node, distance, array_to_string")] + """, paths AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3),
best AS (SELECT origin, node, min(distance) AS distance FROM paths GROUP BY ALL), inn AS (SELECT DISTINCT origin, nodes[-2] AS node FROM paths),
h AS (SELECT DISTINCT 'd' || length(event_type) % 7 AS handler FROM events)
SELECT * FROM (SELECT b.origin, b.node, distance, CASE WHEN handler IS NOT NULL THEN 'command' WHEN regexp_matches(name, '^[Tt]est') OR kind = 'test' THEN 'test' WHEN name = 'main' THEN 'main' WHEN inn.node IS NULL THEN 'uncalled' END AS rule
FROM best b JOIN symbols s ON s.id = b.node LEFT JOIN h ON handler = s.qualified LEFT JOIN inn ON inn.origin = b.origin AND inn.node = b.node) WHERE rule IS NOT NULL""")
def ev_entry_points(spark, d):
    return E.entry_points(G.ev_inbound(spark, d), G.symbols(spark, d), G.commands(spark, d))


TESTS_SQL = G.PATHS_SQL[: G.PATHS_SQL.rindex("SELECT origin, node, distance, array_to_string")] + """, paths AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3),
tests AS (SELECT id AS test_id, name AS test_name, file_path AS test_file FROM symbols WHERE regexp_matches(name, '^[Tt]est') OR kind = 'test'),
org AS (SELECT DISTINCT origin, name, file_path, doc_id FROM paths JOIN symbols ON id = origin)
SELECT origin, test_id, 'call_path' AS source FROM paths JOIN tests ON node = test_id
UNION SELECT origin, test_id, 'import_relationship' FROM org JOIN (SELECT test_id, split_part(test_file, '/', -1)::BIGINT + 1 AS doc FROM tests) t ON org.doc_id = t.doc
UNION SELECT origin, test_id, 'naming_heuristic' FROM org JOIN tests ON lower(name) = lower(regexp_replace(regexp_replace(test_name, '^(?:test_|Test|test)', ''), '(?:_test|Tests?|_spec|Spec)$', ''))
  WHERE regexp_replace(regexp_replace(test_name, '^(?:test_|Test|test)', ''), '(?:_test|Tests?|_spec|Spec)$', '') <> '' AND test_id <> origin"""


@query("ev_candidate_tests", TESTS_SQL)
def ev_candidate_tests(spark, d):
    """A file with a test imports the module of the document after it, by language and number."""
    docs, symbols = G.docs(spark, d), G.symbols(spark, d)
    testing = symbols.where(S.is_test_symbol(F.col("name"), F.col("kind"))).select(F.col("file_path").alias("from_file"), (F.col("doc_id") + 1).alias("next")).distinct()
    imports = testing.join(docs, F.col("next") == docs.doc_id).select("from_file", F.concat_ws(".", "lang", docs.doc_id.cast("string")).alias("target_path"))
    return E.candidate_tests(G.ev_inbound(spark, d), symbols, imports)


@query("q_runtime_invocations", G.EDGES_SQL + " SELECT ref_id, inner_id FROM inner_of")
def q_runtime_invocations(spark, d):
    refs = X.raw_refs(G.docs(spark, d)).withColumn("kind", F.lit("runtime_invocation"))
    return J.innermost(refs, G.symbols(spark, d))


@query("filter_language", "SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'de')")
def filter_language(spark, d):
    return X.files(G.docs(spark, d)).where(F.col("lang").isin("en", "de")).select("doc_id", "lang")


@query("filter_scope", "SELECT lang AS reason, count(*) AS removed FROM documents WHERE source <> 'src1' GROUP BY lang")
def filter_scope(spark, d):
    removed = X.files(G.docs(spark, d)).where(~F.col("path").startswith("src1/")).select(F.col("lang").alias("reason"), F.col("path").alias("item"))
    return C.filter_log(removed).select("reason", "removed")


@query("filter_change_kind", G.CHANGES_SQL + " HAVING status IN ('modified', 'signature_changed')")
def filter_change_kind(spark, d):
    return G.chg_pair_same(spark, d).where(F.col("status").isin("modified", "signature_changed"))


def rung(name: str, *statuses: str):
    @query(name, G.LADDER_SQL + " WHERE status IN (" + ", ".join(f"'{s}'" for s in statuses) + ")")
    def run(spark, d):
        return G.chg_ladder(spark, d).where(F.col("status").isin(*statuses))


rung("chg_pair_moved", "moved")
rung("chg_pair_renamed_file", "moved", "renamed")
rung("chg_pair_body_hash", "renamed")
rung("chg_uncertain_cross", "uncertain")
rung("chg_unpaired", "added", "removed")


@query("chg_out_of_scope", "WITH " + X.HEAD_SQL.strip() + ", a AS (SELECT concat_ws('/', source, lang, doc_id) AS path FROM documents), b AS (SELECT concat_ws('/', source, lang, doc_id) AS path FROM head_documents) SELECT path, 'deleted' AS reason FROM a WHERE path NOT IN (SELECT path FROM b)")
def chg_out_of_scope(spark, d):
    base = G.docs(spark, d)
    head = X.files(X.head_documents(base)).select("path")
    gone = X.files(base).join(head, "path", "left_anti").select(F.lit("deleted").alias("status"), F.col("path").alias("old_path"), F.lit(None).cast("string").alias("new_path"))
    return C.out_of_scope(gone, head)


@query("chg_selection", G.SYM_SQL + " SELECT qualified, count(*) AS n FROM symbols WHERE kind = 'module' GROUP BY qualified")
def chg_selection(spark, d):
    wanted = G.docs(spark, d).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("qualified"))
    return C.selection(G.symbols(spark, d), wanted)


@query("agg_test_selection", G.EDGES_SQL + " SELECT src AS test_id, min(category)::BIGINT AS strongest, count(DISTINCT dst) AS changed FROM edges GROUP BY src")
def agg_test_selection(spark, d):
    return C.test_selection(G.edges(spark, d))


@query("chg_analyse", G.EDGES_SQL + " SELECT dst AS symbol_id, src AS caller_id, count(*) OVER (PARTITION BY dst) AS callers_found FROM edges QUALIFY row_number() OVER (PARTITION BY dst ORDER BY category, src) <= 10")
def chg_analyse(spark, d):
    return C.callers(G.edges(spark, d))


@query("hist_attribute_side", "SELECT a.l_orderkey * 10 + a.l_linenumber AS change_id, b.l_orderkey * 10 + b.l_linenumber AS symbol_id FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber <= a.l_linenumber AND b.l_linenumber + 1 >= a.l_linenumber")
def hist_attribute_side(spark, d):
    """Lines of an order as one-line changes, and as symbols that span their own and the next line."""
    lines = X.table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").cast("string").alias("path"), F.col("l_linenumber").cast("long").alias("first"))
    changes = lines.select(F.col("id").alias("change_id"), "path", "first", F.col("first").alias("last"))
    return H.attribute_side(changes, lines.select(F.col("id").alias("symbol_id"), "path", "first", (F.col("first") + 1).alias("last")))


@query("hist_lineage_step", "SELECT o_orderkey AS seq, 'f' || o_custkey AS old_path, CASE WHEN o_orderstatus = 'F' THEN 'g' || o_custkey END AS new_path FROM orders WHERE o_orderstatus IN ('F', 'O')")
def hist_lineage_step(spark, d):
    o = X.table(spark, d, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "renamed").when(F.col("o_orderstatus") == "O", "deleted").otherwise("modified")
    name = lambda p: F.concat(F.lit(p), F.col("o_custkey").cast("string"))
    return H.lineage_steps(o.select(F.col("o_orderkey").alias("seq"), kind.alias("kind"), name("f").alias("old_path"), name("g").alias("new_path")))


@query("join_path_lineage", """WITH s AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT 'c' || o_custkey || '/' || (k - 1) AS path, o_orderkey - 1 AS seq, 'c' || o_custkey || '/' || n AS current FROM s""")
def join_path_lineage(spark, d):
    """Each customer's file is renamed by every order; where each name ends."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    o = X.table(spark, d, "orders").select("o_custkey", "o_orderkey", k.alias("k"))
    name = lambda n: F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("/"), n.cast("string"))
    steps = o.select(F.col("o_orderkey").alias("seq"), name(F.col("k") - 1).alias("old_path"), name(F.col("k")).alias("new_path"))
    return J.path_lineage(steps, steps.select(F.col("old_path").alias("path"), (F.col("seq") - 1).alias("seq")), rounds=64)


@query("hist_resolve_current", "SELECT p_partkey AS key, CASE WHEN n = 1 THEN 'live' WHEN n > 1 THEN 'ambiguous' ELSE 'deleted' END AS state FROM part LEFT JOIN (SELECT p_name, count(*) AS n FROM part WHERE p_size < 25 GROUP BY p_name) USING (p_name)")
def hist_resolve_current(spark, d):
    part = X.table(spark, d, "part")
    return H.resolve_current(part.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name")), part.where("p_size < 25").select(F.col("p_name").alias("name")))


@query("hist_status", "SELECT o_orderpriority AS scope, count(*) AS deliveries, count(*) FILTER (WHERE o_orderstatus = 'F') AS verified, min(o_orderdate) AS first_at, max(o_orderdate) AS last_at FROM orders GROUP BY 1")
def hist_status(spark, d):
    o = X.table(spark, d, "orders")
    return H.status(o.select(F.col("o_orderpriority").alias("scope"), (F.col("o_orderstatus") == "F").alias("verified"), F.col("o_orderdate").alias("at")))


def task_rows(spark, d):
    o = X.table(spark, d, "orders")
    known = F.when(F.col("o_orderstatus") == "F", "known_pre_execution").otherwise("uncertain")
    return o.select(F.col("o_custkey").alias("task_id"), F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("text"), known.alias("text_availability"), F.col("o_orderdate").alias("snapshot_at"), F.col("o_orderdate").alias("captured_at"))


ELIGIBLE = "WITH t AS (SELECT o_custkey AS task_id, 't' || o_orderkey AS text, o_orderdate, o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1998-01-01' AS eligible FROM orders) "


@query("pred_task_eligible", ELIGIBLE + "SELECT task_id, text, eligible FROM t")
def pred_task_eligible(spark, d):
    return H.task_eligible(task_rows(spark, d), "1998-01-01").select("task_id", "text", "eligible")


@query("rec_resolve_query", ELIGIBLE + "SELECT task_id, arg_min(text, (o_orderdate, text)) AS text FROM t WHERE eligible GROUP BY task_id")
def rec_resolve_query(spark, d):
    return H.resolve_query(H.task_eligible(task_rows(spark, d), "1998-01-01"))


@query("rec_eligible", K.DEL + " SELECT delivery_id, count(*) AS files FROM deliveries WHERE day < DATE '1998-01-01' GROUP BY delivery_id")
def rec_eligible(spark, d):
    return R.eligible(K.dv(spark, d), "1998-01-01").groupBy("delivery_id").agg(F.count(F.lit(1)).alias("files"))


@query("rec_lexical_baseline", K.TASK + f", q AS (SELECT item_id AS query, {K.TOKENS.format('text')} AS ts FROM benchmark), f AS (SELECT file, {K.TOKENS.format('file')} AS ts FROM (SELECT DISTINCT file FROM deliveries UNION SELECT file || '/readme.md' FROM deliveries)), m AS (SELECT query, file, count(*) AS c FROM (SELECT query, unnest(ts) AS t FROM q) JOIN (SELECT file, unnest(ts) AS t FROM f) USING (t) GROUP BY ALL) SELECT query, file, round(c / len(ts) * 0.08::DOUBLE * CASE WHEN file LIKE '%/readme.md' THEN 0.55::DOUBLE ELSE 1.0::DOUBLE END, 6) AS score FROM m JOIN q USING (query)")
def rec_lexical_baseline(spark, d):
    files = K.dv(spark, d).select("file").distinct()
    found = R.lexical_baseline(files.unionByName(files.select(F.concat("file", F.lit("/readme.md")).alias("file"))), K.items(spark, d))
    return found.select("query", "file", F.round("score", 6).alias("score"))


@query("rec_structure", G.REL_SQL + """, e AS (SELECT src AS seed, dst AS neighbor FROM rel UNION SELECT dst, src FROM rel), r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY neighbor) AS place FROM e WHERE seed LIKE 'nation::%'),
s AS (SELECT o_orderpriority AS query, 'nation::' || n_name AS seed, round(sum(o_totalprice) / 1e6, 2) AS score FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
k AS (SELECT * FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query ORDER BY seed) <= 20)
SELECT query, neighbor, round(sum(score * 0.08::DOUBLE), 4) AS score FROM k JOIN r USING (seed) WHERE place <= 6 GROUP BY ALL""")
def rec_structure(spark, d):
    """Nations score by the orders of a priority and hand on to what they are related with."""
    o, c, n = (X.table(spark, d, t) for t in ("orders", "customer", "nation"))
    sold = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    seeds = sold.groupBy(F.col("o_orderpriority").alias("query"), F.concat(F.lit("nation::"), "n_name").alias("seed")).agg(F.round(F.sum("o_totalprice") / 1e6, 2).alias("score"))
    return R.structure_scores(G.join_structure_neighbors(spark, d), seeds).select("query", "neighbor", F.round("score", 4).alias("score"))


@query("rec_freshness", "SELECT o_orderpriority AS scope, CASE WHEN max(o_orderdate) >= (SELECT max(o_orderdate) FROM orders) THEN 'current' ELSE 'stale' END AS freshness FROM orders GROUP BY 1")
def rec_freshness(spark, d):
    return R.freshness(X.table(spark, d, "orders").select(F.col("o_orderpriority").alias("scope"), F.col("o_orderdate").alias("at")))


@query("rec_fallbacks", K.DEL + " SELECT CASE WHEN n > 20 THEN 'label_over_max_files' ELSE 'used' END AS reason, count(*) AS deliveries FROM (SELECT delivery_id, count(DISTINCT file) AS n FROM deliveries GROUP BY ALL) GROUP BY 1")
def rec_fallbacks(spark, d):
    return R.label_reasons(K.dv(spark, d))


@query("rec_wi_labels", K.WORDS + " SELECT delivery_id, file, 1 / count(*) OVER (PARTITION BY delivery_id) AS weight FROM rows")
def rec_wi_labels(spark, d):
    from pyspark.sql import Window

    rows = R.index_window(K.dv(spark, d)).select("delivery_id", "file").distinct()
    return rows.withColumn("weight", 1 / F.count(F.lit(1)).over(Window.partitionBy("delivery_id")))


@query("win_rank_score", K.HISTORY + " SELECT query, file, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, file) AS rank FROM hist QUALIFY rank <= 100")
def win_rank_score(spark, d):
    return R.finalize(K.history(spark, d).select("query", "file", "score"), 100).select("query", "file", "rank")


@query("topk_search", K.BM25 + " SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, doc) AS rank FROM sc QUALIFY rank <= 21")
def topk_search(spark, d):
    return K.best(spark, d, 21).select("query", "doc", "rank")


@query("eval_prepend", K.RUNS + ", b AS (SELECT query, doc, min((CASE run WHEN 'bm25' THEN 0 ELSE 1 END, rank)) AS place FROM runs GROUP BY ALL) SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY place, doc) AS rank FROM b QUALIFY rank <= 50")
def eval_prepend(spark, d):
    both = K.runs(spark, d)
    return B.prepend(both.where("run = 'bm25'"), both.where("run = 'overlap'")).where("rank <= 50")


PAIRED_SQL = K.TRUTH + """, d AS (SELECT 0 AS g, query, a.hits / a.relevant - b.hits / b.relevant AS v FROM cases a JOIN cases b USING (query) WHERE a.variant = 'bm25' AND b.variant = 'overlap'),
""" + L.bootstrap_sql("SELECT g, v FROM d").replace("ORDER BY v) - 1 AS k", "ORDER BY query) - 1 AS k").replace("(SELECT g, v FROM d)", "d") + """,
verdicts AS (SELECT 'recall' AS metric, (SELECT count(*) FROM d) AS n, (SELECT avg(v) FROM d) AS mean_difference, low, high, CASE WHEN low > 0 THEN 'above' WHEN high < 0 THEN 'below' ELSE 'undecided' END AS verdict FROM ci)"""


@query("eval_paired", PAIRED_SQL + " SELECT metric, n, round(mean_difference, 6) AS mean_difference, round(low, 6) AS low, round(high, 6) AS high, verdict FROM verdicts")
def eval_paired(spark, d):
    found = V.paired(K.cases(spark, d), "bm25", "overlap")
    return found.select("metric", "n", *(F.round(c, 6).alias(c) for c in ("mean_difference", "low", "high")), "verdict")


@query("eval_gates", PAIRED_SQL + """ SELECT 'G1' AS gate, CASE WHEN coverage >= 0.5 AND verdict = 'above' THEN 'pass' ELSE 'fail' END AS state, coverage FROM verdicts, (SELECT avg(CASE WHEN hits > 0 THEN 1 ELSE 0 END) AS coverage FROM cases)""")
def eval_gates(spark, d):
    """G1 of all gates, as the SQL has it: bm25 against overlap, and the coverage of both runs' cases by right answers. These two runs have no existing rankings for G2 and no grid for G4."""
    cases = K.outcomes(spark, d)
    coverage = cases.agg(F.avg((F.col("hits") > 0).cast("double")).alias("c")).first()["c"] or 0.0
    found = V.gates(cases, V.Roles("bm25", ("overlap",), (), (), ("overlap",)), coverage=coverage)
    rows = [(r["gate"], r["state"], float(r["coverage"])) for r in found if r["gate"] == "G1"]
    return spark.createDataFrame(rows, "gate string, state string, coverage double")


@query("eval_grid", "SELECT boost, support FROM (VALUES (1.0::DOUBLE), (1.5::DOUBLE), (2.0::DOUBLE)) a(boost) CROSS JOIN (VALUES (1), (2)) b(support)")
def eval_grid(spark, d):
    return spark.createDataFrame([(c["boost"], c["support"]) for c in V.grid({"boost": [1.0, 1.5, 2.0, 1.0], "support": [1, 2]})], "boost double, support int")


@query("read_manifests", "SELECT 'p' || p_partkey || '/Cargo.toml' AS path, 'prog' || p_size AS name FROM part")
def read_manifests(spark, d):
    part = X.table(spark, d, "part")
    content = F.encode(F.concat(F.lit('[package]\nname = "prog'), F.col("p_size").cast("string"), F.lit('"\n')), "UTF-8")
    return W.program_names(part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit("/Cargo.toml")).alias("path"), content.alias("content")))


@query("q_program_names", "SELECT DISTINCT 'prog' || p_size AS name FROM part")
def q_program_names(spark, d):
    return read_manifests(spark, d).select("name").distinct()


@query("join_program_name", "SELECT e.event_id, p.name FROM (SELECT event_id, 'prog' || (user_id % 60) AS base FROM events) e JOIN (SELECT DISTINCT 'prog' || p_size AS name FROM part) p ON p.name = e.base")
def join_program_name(spark, d):
    sites = X.table(spark, d, "events").select("event_id", F.concat(F.lit("prog"), (F.col("user_id") % 60).cast("string")).alias("base"))
    return J.program_sites(sites, q_program_names(spark, d)).select("event_id", F.col("base").alias("name"))


@query("read_source_window", """WITH l AS (SELECT doc_id, text FROM documents WHERE strlen(text) > 65536),
c AS (SELECT doc_id, max(256 * k) AS c FROM l, range(257) t(k) WHERE strlen(left(text, 256 * k)) <= 65536 GROUP BY doc_id), f AS (SELECT doc_id, max(c + k) AS chars FROM l JOIN c USING (doc_id), range(256) t(k) WHERE strlen(left(text, c + k)) <= 65536 GROUP BY doc_id)
SELECT doc_id, coalesce(chars, length(text))::BIGINT AS chars, strlen(text) > 65536 AS truncated FROM documents LEFT JOIN f USING (doc_id)""")
def read_source_window(spark, d):
    """The first 64 KiB of every document, as ``show`` returns them, cut between characters."""
    docs = G.docs(spark, d)
    spans = docs.select("doc_id", F.encode("text", "UTF-8").alias("content"), F.lit(0).cast("long").alias("span_start"), F.octet_length("text").cast("long").alias("span_end"))
    return W.read_window(spans).select("doc_id", F.length("window").cast("long").alias("chars"), "truncated")


REEXPORTS_SQL = """WITH own AS (SELECT 'nation::' || n_name AS nation, 'region::' || r_name AS region, c_name AS name, c_custkey AS id FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
named AS (SELECT nation, CASE WHEN id % 7 = 0 THEN 'vip' || id % 5 ELSE name END AS called, id FROM own WHERE id % 7 = 0 OR id % 11 = 0),
reached AS (SELECT region AS module, name, id FROM own UNION SELECT 'world', called, id FROM named UNION SELECT 'world', name, id FROM own WHERE name NOT IN (SELECT called FROM named) UNION SELECT 'mirror', * EXCLUDE (module) FROM
  (SELECT 'world' AS module, called, id FROM named UNION SELECT 'world', name, id FROM own WHERE name NOT IN (SELECT called FROM named)))
SELECT module, name, CASE WHEN count(DISTINCT id) = 1 THEN min(id) END AS symbol_id, CASE WHEN count(DISTINCT id) = 1 THEN 'hit' ELSE 'ambiguous' END AS answer FROM reached GROUP BY ALL"""


@query("join_reexport_closure", REEXPORTS_SQL)
def join_reexport_closure(spark, d):
    """Regions re-export their nations, the world the regions and, explicitly and some under another name, customers; a mirror and the world re-export each other."""
    n, r, c = (X.table(spark, d, t) for t in ("nation", "region", "customer"))
    nation, region, nothing = F.concat(F.lit("nation::"), "n_name"), F.concat(F.lit("region::"), "r_name"), F.lit(None).cast("string")
    placed = n.join(r, n.n_regionkey == r.r_regionkey)
    step = lambda df, module, source, name=nothing, alias=nothing: df.select(module.alias("module"), source.alias("source_module"), name.alias("name"), alias.alias("alias")).distinct()
    world, mirror = F.lit("world"), F.lit("mirror")
    defined = c.join(n, c.c_nationkey == n.n_nationkey).select(nation.alias("module"), F.col("c_name").alias("name"), F.col("c_custkey").alias("symbol_id"))
    chosen = defined.where("symbol_id % 7 = 0 or symbol_id % 11 = 0")
    alias = F.when(F.col("symbol_id") % 7 == 0, F.concat(F.lit("vip"), (F.col("symbol_id") % 5).cast("string")))
    one = spark.range(1)
    steps = step(placed, region, nation).unionByName(step(r, world, region)).unionByName(step(one, mirror, world)).unionByName(step(one, world, mirror))
    steps = steps.unionByName(chosen.select(world.alias("module"), F.col("module").alias("source_module"), "name", alias.alias("alias")))
    return P.reexport_closure(steps, defined)


@query("res_reexport", "SELECT module, count(*) AS hits FROM (" + REEXPORTS_SQL + ") WHERE answer = 'hit' GROUP BY 1")
def res_reexport(spark, d):
    return join_reexport_closure(spark, d).where("answer = 'hit'").groupBy("module").agg(F.count(F.lit(1)).alias("hits"))


@query("res_type_member", """WITH s AS (SELECT p_partkey AS id, p_brand AS file, 'm' || p_size % 5 AS module, 'T' || lower(regexp_replace(p_type, '[^A-Za-z]', '', 'g')) AS type, lower(regexp_replace(p_name, '[^A-Za-z]', '_', 'g')) AS member, p_size % 3 + 1 AS tier FROM part),
j AS (SELECT a.id AS ref, a.file, a.module, b.id, b.tier, b.file AS b_file, b.module AS b_module FROM s a JOIN s b USING (type, member)),
n AS (SELECT ref, min(id) = max(id) AS sole, min(id) AS one, count(*) FILTER (WHERE file = b_file) AS here, count(*) FILTER (WHERE module = b_module) AS near, min(b_file) = max(b_file) AS one_file,
  min((tier, id)) FILTER (WHERE file = b_file) AS h0, min((tier, -id)) FILTER (WHERE file = b_file) AS h1, min((tier, id)) FILTER (WHERE module = b_module) AS n0, min((tier, -id)) FILTER (WHERE module = b_module) AS n1, min((tier, id)) AS a0, min((tier, -id)) AS a1 FROM j GROUP BY ref),
k AS (SELECT ref, CASE WHEN sole THEN 'exact' WHEN here > 0 THEN CASE WHEN h0[2] = -h1[2] THEN 'exact' END WHEN near > 0 THEN CASE WHEN n0[2] = -n1[2] THEN 'same_module' END WHEN a0[2] = -a1[2] AND one_file THEN 'exact' END AS confidence,
  CASE WHEN sole THEN one WHEN here > 0 THEN h0[2] WHEN near > 0 THEN n0[2] ELSE a0[2] END AS target FROM n)
SELECT ref AS id, coalesce(confidence, 'fuzzy_name') AS confidence, CASE WHEN confidence IS NOT NULL THEN target END AS target_id FROM k""")
def res_type_member(spark, d):
    """Parts as members of types, inherent, of a trait's impl or declared, each called on a receiver of its type, through the whole ladder."""
    p = X.table(spark, d, "part")
    kind, member = F.concat(F.lit("T"), F.lower(F.regexp_replace("p_type", "[^A-Za-z]", ""))), F.lower(F.regexp_replace("p_name", "[^A-Za-z]", "_"))
    bracketed = F.concat(F.lit("<"), kind, F.lit(">::"), member)
    qualified = F.when(F.col("p_size") % 3 == 0, bracketed).when(F.col("p_size") % 3 == 1, F.concat(F.lit("<"), kind, F.lit(" as Tr>::"), member)).otherwise(F.concat(kind, F.lit("::"), member))
    module = F.concat(F.lit("m"), (F.col("p_size") % 5).cast("string"))
    common = (F.col("p_partkey").alias("id"), module.alias("module"), F.lit("rust").alias("lang"), member.alias("name"))
    symbols = p.select(*common, F.col("p_brand").alias("file_path"), qualified.alias("qualified"), F.lit("method").alias("kind"))
    refs = p.select(*common, F.col("p_brand").alias("from_file"), bracketed.alias("target"), F.lit("call").alias("kind"), F.lit(True).alias("receiver_unknown"))
    return RS.resolve(refs, symbols).select("id", "confidence", "target_id")


@query("res_member_tiers", """WITH m AS (SELECT p_partkey AS id, p_brand AS file, p_type AS type, p_name AS name, CASE p_size % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS place FROM part),
j AS (SELECT a.id AS ref_id, a.file, b.id, b.file AS m_file, b.place FROM m a JOIN m b USING (type, name) QUALIFY rank() OVER (PARTITION BY a.id ORDER BY b.place) = 1),
n AS (SELECT ref_id, count(*) AS n, min(id) AS one, count(*) FILTER (WHERE m_file = file) AS nf, min(id) FILTER (WHERE m_file = file) AS own FROM j GROUP BY ref_id)
SELECT ref_id, CASE WHEN nf = 1 THEN own WHEN n = 1 THEN one END AS target_id, CASE WHEN nf = 1 THEN 'exact' WHEN n = 1 THEN 'import_resolved' ELSE 'fuzzy_name' END AS confidence FROM n""")
def res_member_tiers(spark, d):
    p = X.table(spark, d, "part")
    tier = F.when(F.col("p_size") % 3 == 0, "inherent").when(F.col("p_size") % 3 == 1, "trait_impl").otherwise("trait_decl")
    members = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("file"), F.col("p_type").alias("type"), F.col("p_name").alias("name"), tier.alias("tier"))
    return P.type_members(members.select(F.col("id").alias("ref_id"), "file", "type", "name"), members)


@query("fn_path_source", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'changed_symbol' WHEN p_size % 4 = 1 THEN 'call_path' WHEN p_size % 4 = 2 THEN 'import_relationship' ELSE 'reference_path' END AS source FROM part")
def fn_path_source(spark, d):
    kinds = F.when(F.col("p_size") % 4 == 0, F.array().cast("array<string>")).when(F.col("p_size") % 4 == 1, F.array(F.lit("resolved_call"))).when(F.col("p_size") % 4 == 2, F.array(F.lit("resolved_call"), F.lit("import_relationship"))).otherwise(F.array(F.lit("observed_reference")))
    return X.table(spark, d, "part").select("p_partkey", S.path_source(kinds).alias("source"))


@query("fn_base_weight", "SELECT l_orderkey, l_linenumber, round(CASE l_linenumber % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN greatest(l_quantity, 1) / 50 ELSE l_quantity / nullif(l_quantity + l_extendedprice, 0) END, 6) AS weight FROM lineitem")
def fn_base_weight(spark, d):
    mode = F.when(F.col("l_linenumber") % 3 == 0, "presence").when(F.col("l_linenumber") % 3 == 1, "symbol_fraction").otherwise("diff_share")
    weight = S.base_weight(mode, F.col("l_quantity"), F.lit(50.0), F.col("l_quantity") + F.col("l_extendedprice"))
    return X.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(weight, 6).alias("weight"))


def new_store(spark):
    import uuid

    from loomgraph.operators.cut import shared_folder
    from loomgraph.sources.store import Store

    return Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")


@query("sink_store", "WITH " + X.SYMBOLS_SQL + " SELECT path, lang, byte_len FROM files")
def sink_store(spark, d):
    """The files table through a store: written as a version, made current, read back."""
    store = new_store(spark)
    store.commit({"files": X.files(G.docs(spark, d)).select("path", "lang", "byte_len")})
    return store.read("files")


@query("stream_incremental_sync", K.SESSIONS)
def stream_incremental_sync(spark, d):
    """Bursts committed under a batch's id, twice as a replay would: the second commit changes nothing."""
    store = new_store(spark)
    for _ in range(2):
        store.commit({"bursts": K.stream_debounce(spark, d)}, "batch-0")
    return store.read("bursts")


@query("fn_whitespace_only", "SELECT conv_id, turn, contains(text, ' ') AS spaces_only FROM conversations")
def fn_whitespace_only(spark, d):
    c = X.table(spark, d, "conversations")
    return c.select("conv_id", "turn", S.whitespace_only(F.col("text"), F.replace("text", F.lit(" "), F.lit("  "))).alias("spaces_only"))


MENTIONS = G.SYM_SQL + """, w AS (SELECT item_id AS query, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS name FROM benchmark),
n AS (SELECT name, count(*) AS n FROM symbols WHERE kind = 'function' GROUP BY name)
SELECT w.query, s.id AS symbol_id FROM w JOIN n USING (name) JOIN symbols s USING (name) WHERE n <= 5 AND s.kind = 'function'"""


@query("fn_explicit_mentions", MENTIONS)
def fn_explicit_mentions(spark, d):
    """Symbols that an item names, of names that at most five symbols have."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    asked = K.items(spark, d).select("query", F.explode(words).alias("name"))
    s = G.symbols(spark, d).where("kind = 'function'").select("name", F.col("id").alias("symbol_id"))
    few = s.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n <= 5").select("name")
    return asked.join(few, "name").join(s, "name").select("query", "symbol_id")


@query("eval_mentions", MENTIONS.replace("SELECT w.query, s.id AS symbol_id", "SELECT w.query, s.id AS symbol_id, row_number() OVER (PARTITION BY w.query ORDER BY s.id) AS rank"))
def eval_mentions(spark, d):
    from pyspark.sql import Window

    return fn_explicit_mentions(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("symbol_id")).cast("long"))


@query("hist_pair_symbols", G.HEAD_GRAPH_SQL + """,
a AS (SELECT doc_id, id, qualified, kind, span_end - span_start AS sig FROM symbols WHERE kind = 'function'), b AS (SELECT doc_id, id, qualified, kind, span_end - span_start AS sig FROM h_symbols WHERE kind = 'function'),
ex AS (SELECT doc_id, x.i AS before_id, y.i AS after_id FROM (SELECT doc_id, qualified, kind, min(id) AS i FROM a GROUP BY ALL HAVING count(*) = 1) x JOIN (SELECT doc_id, qualified, kind, min(id) AS i FROM b GROUP BY ALL HAVING count(*) = 1) y USING (doc_id, qualified, kind)),
la AS (SELECT * FROM a WHERE (doc_id, id) NOT IN (SELECT (doc_id, before_id) FROM ex)), lb AS (SELECT * FROM b WHERE (doc_id, id) NOT IN (SELECT (doc_id, after_id) FROM ex)),
si AS (SELECT doc_id, x.i AS before_id, y.i AS after_id FROM (SELECT doc_id, kind, sig, min(id) AS i FROM la GROUP BY ALL HAVING count(*) = 1) x JOIN (SELECT doc_id, kind, sig, min(id) AS i FROM lb GROUP BY ALL HAVING count(*) = 1) y USING (doc_id, kind, sig))
SELECT doc_id AS delivery_id, before_id, after_id, 'exact' AS how FROM ex UNION ALL SELECT doc_id, before_id, after_id, 'signature' FROM si""")
def hist_pair_symbols(spark, d):
    """Line functions of each document before and after the edits."""
    side = lambda docs: X.symbols(docs).where("kind = 'function'").select(F.col("doc_id").alias("delivery_id"), "id", "qualified", "kind", (F.col("span_end") - F.col("span_start")).cast("string").alias("signature"))
    base = G.docs(spark, d)
    return H.pair_symbols(side(base), side(X.head_documents(base)))
