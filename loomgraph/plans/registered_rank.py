"""Queries over delivery history and retrieval: recommendation, search, evaluation, sessions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S
from loomgraph.operators import rankings as N
from loomgraph.operators import search as B
from loomgraph.operators.cut import cut
from loomgraph.plans import evaluate as E
from loomgraph.plans import recommend as R
from loomgraph.plans.catalog import query
from loomgraph.sources import fixtures as X

DEL = "WITH " + X.DELIVERIES_SQL
TASK = DEL + "," + X.TASKS_SQL
TOKENS = "list_distinct(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: CASE WHEN length(w) > 4 AND w[-1] = 's' THEN w[:-2] ELSE w END))"
TOTAL = "(SELECT count(DISTINCT delivery_id) FROM deliveries)"


def dv(spark, d):
    return X.deliveries(spark, d)


def items(spark, d):
    """Benchmark items as queries."""
    return X.table(spark, d, "benchmark").select(F.col("item_id").alias("query"), "text")


@query("scan_deliveries", DEL + " SELECT * FROM deliveries")
def scan_deliveries(spark, d):
    return dv(spark, d)


@query("agg_prevalence", DEL + " SELECT file, count(DISTINCT delivery_id) AS prevalence FROM deliveries GROUP BY file")
def agg_prevalence(spark, d):
    return R.prevalence(dv(spark, d))


@query("rec_frequency", DEL + f" SELECT file, count(DISTINCT delivery_id) / {TOTAL} AS score FROM deliveries GROUP BY file")
def rec_frequency(spark, d):
    return R.frequency(dv(spark, d))


@query("pred_visible_delivery", DEL + " SELECT DISTINCT delivery_id, day FROM deliveries WHERE day < DATE '1998-01-01'")
def pred_visible_delivery(spark, d):
    return R.eligible(dv(spark, d), "1998-01-01").select("delivery_id", "day").distinct()


@query("pred_excluded_path", DEL + " SELECT DISTINCT file FROM deliveries WHERE lower(split_part(file, '/', -1)) NOT IN ('cargo.lock', 'changelog.md')")
def pred_excluded_path(spark, d):
    return dv(spark, d).where(~F.lower(F.element_at(F.split("file", "/"), -1)).isin("cargo.lock", "changelog.md")).select("file").distinct()


PAIRS = DEL + """, rows AS (SELECT DISTINCT delivery_id, file FROM deliveries), p AS (SELECT file, count(*) AS n FROM rows GROUP BY file),
rules AS (SELECT a.file AS src, b.file AS dst, count(*) AS support FROM rows a JOIN rows b USING (delivery_id) WHERE a.file <> b.file GROUP BY ALL),
rated AS (SELECT src, dst, support, support / x.n AS confidence, (support / x.n) / (y.n / (SELECT count(DISTINCT delivery_id) FROM deliveries)) AS lift FROM rules JOIN p x ON x.file = src JOIN p y ON y.file = dst)"""


@query("rec_cochange", PAIRS + " SELECT src, dst, support, round(confidence, 6) AS confidence, round(lift, 6) AS lift FROM rated WHERE support >= 2")
def rec_cochange(spark, d):
    rules = R.cochange_rules(dv(spark, d), min_support=2)
    return rules.select("src", "dst", "support", F.round("confidence", 6).alias("confidence"), F.round("lift", 6).alias("lift"))


HISTORY = TASK + f""",
told AS (SELECT delivery_id, unnest({TOKENS.format("text")}) AS token FROM tasks),
asked AS (SELECT item_id AS query, {TOKENS.format("text")} AS ts FROM benchmark), q AS (SELECT query, len(ts) AS n, unnest(ts) AS token FROM asked),
sim AS (SELECT query, delivery_id, count(*) / max(n) AS s FROM q JOIN told USING (token) GROUP BY ALL),
br AS (SELECT delivery_id, count(*) AS b FROM deliveries GROUP BY ALL), pv AS (SELECT file, count(DISTINCT delivery_id) AS p FROM deliveries GROUP BY ALL),
con AS (SELECT query, delivery_id, file, s * pow(0.5, distance / 50) * (1 / sqrt(greatest(b, 1))) * (1 / (1 + 2 * p / {TOTAL})) * CASE WHEN verified THEN 1.0::DOUBLE ELSE 0.55::DOUBLE END AS c
        FROM sim JOIN deliveries USING (delivery_id) JOIN br USING (delivery_id) JOIN pv USING (file)),
hist AS (SELECT query, file, sum(c) AS score, count(DISTINCT delivery_id) AS deliveries, max(c) AS strongest FROM con GROUP BY ALL)"""


def history(spark, d):
    tasks, texts = X.task_texts(spark, d)
    return R.history_scores(dv(spark, d), tasks, items(spark, d), texts)


@query("rec_score_history", HISTORY + " SELECT query, file, round(score, 6) AS score, deliveries FROM hist")
def rec_score_history(spark, d):
    return history(spark, d).select("query", "file", F.round("score", 6).alias("score"), "deliveries")


@query("agg_score_accumulate", HISTORY + " SELECT query, count(*) AS destinations, round(sum(score), 4) AS total, max(deliveries) AS most FROM hist GROUP BY query")
def agg_score_accumulate(spark, d):
    return history(spark, d).groupBy("query").agg(F.count(F.lit(1)).alias("destinations"), F.round(F.sum("score"), 4).alias("total"), F.max("deliveries").alias("most"))


@query("rec_finalize", HISTORY + " SELECT query, file, round(score, 6) AS score, rank FROM (SELECT query, file, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, file) AS rank FROM hist WHERE score > 0) WHERE rank <= 10")
def rec_finalize(spark, d):
    return R.finalize(history(spark, d).select("query", "file", "score"))


@query("topk_seeds", HISTORY + " SELECT query, file FROM hist QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(strongest, 6) DESC, file) <= 256")
def topk_seeds(spark, d):
    order = Window.partitionBy("query").orderBy(F.desc(F.round("strongest", 6)), "file")
    return history(spark, d).withColumn("place", F.row_number().over(order)).where(F.col("place") <= R.SEEDS).select("query", "file")


@query("topk_structure_seeds", HISTORY + " SELECT query, file FROM hist WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query ORDER BY file) <= 20")
def topk_structure_seeds(spark, d):
    order = Window.partitionBy("query").orderBy("file")
    return history(spark, d).where("score > 0").withColumn("place", F.row_number().over(order)).where("place <= 20").select("query", "file")


COCHANGE = HISTORY + "," + PAIRS[len(DEL) + 1 :] + """,
seeds AS (SELECT query, file AS src, strongest FROM hist QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(strongest, 6) DESC, file) <= 256),
co AS (SELECT query, dst AS file, max(strongest * confidence * ln(1 + lift) * 0.25::DOUBLE) AS score FROM seeds JOIN rated USING (src) GROUP BY ALL),
total AS (SELECT query, file, sum(score) AS score FROM (SELECT query, file, score FROM hist UNION ALL SELECT * FROM co) GROUP BY ALL)"""


@query("rec_recommend", COCHANGE + " SELECT query, file, round(score, 6) AS score, rank FROM (SELECT query, file, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, file) AS rank FROM total WHERE score > 0) WHERE rank <= 10")
def rec_recommend(spark, d):
    tasks, texts = X.task_texts(spark, d)
    return R.recommend(dv(spark, d), tasks, items(spark, d), texts=texts)


WORDS = TASK + f""",
sized AS (SELECT delivery_id, min(distance) AS distance, count(DISTINCT file) AS n FROM deliveries GROUP BY ALL HAVING n <= 20),
win AS (SELECT delivery_id FROM sized ORDER BY distance, delivery_id LIMIT 4000),
rows AS (SELECT DISTINCT delivery_id, file FROM deliveries WHERE delivery_id IN (SELECT delivery_id FROM win)),
told AS (SELECT delivery_id, unnest({TOKENS.format("text")}) AS term FROM tasks WHERE delivery_id IN (SELECT delivery_id FROM win)),
df AS (SELECT term, count(*) AS df, (SELECT count(*) FROM win) AS n FROM told GROUP BY term HAVING count(*) <= 0.3::DOUBLE * (SELECT count(*) FROM win)),
mass AS (SELECT file, count(*) AS mass FROM rows GROUP BY ALL),
obs AS (SELECT term, file, count(*) AS obs FROM told JOIN rows USING (delivery_id) WHERE term IN (SELECT term FROM df) GROUP BY ALL HAVING count(*) >= 2),
idx AS (SELECT term, file, greatest(0, ln((obs + 1) / (df * mass / n + 1))) AS assoc FROM obs JOIN df USING (term) JOIN mass USING (file))"""


@query("rec_word_index", WORDS + f", asked AS (SELECT item_id AS query, unnest({TOKENS.format('text')}) AS term FROM benchmark) SELECT query, file, round(sum(assoc), 6) AS score FROM asked JOIN idx USING (term) WHERE assoc > 0 GROUP BY ALL")
def rec_word_index(spark, d):
    index = R.word_index(dv(spark, d), X.tasks(spark, d))
    return R.word_index_scores(index, items(spark, d)).select("query", "file", F.round("score", 6).alias("score"))


@query("rec_wi_window", WORDS + " SELECT * FROM rows")
def rec_wi_window(spark, d):
    return R.index_window(dv(spark, d)).select("delivery_id", "file").distinct()


@query("win_newest_n", WORDS + " SELECT delivery_id FROM win")
def win_newest_n(spark, d):
    return R.index_window(dv(spark, d)).select("delivery_id").distinct()


@query("agg_df_term", WORDS + " SELECT term, df FROM df")
def agg_df_term(spark, d):
    rows = R.index_window(dv(spark, d)).select("delivery_id").distinct()
    n = rows.count()
    told = X.tasks(spark, d).join(rows, "delivery_id", "left_semi").select(F.explode(S.tokens(F.col("text"))).alias("term"))
    return told.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") <= R.STOP_SHARE * F.lit(n))


@query("agg_context_mass", WORDS + " SELECT file, mass FROM mass")
def agg_context_mass(spark, d):
    return R.index_window(dv(spark, d)).select("delivery_id", "file").distinct().groupBy("file").agg(F.count(F.lit(1)).alias("mass"))


@query("agg_postings", WORDS + " SELECT term, file, obs FROM obs")
def agg_postings(spark, d):
    rows = R.index_window(dv(spark, d)).select("delivery_id", "file").distinct()
    told = X.tasks(spark, d).join(rows.select("delivery_id").distinct(), "delivery_id", "left_semi").select("delivery_id", F.explode(S.tokens(F.col("text"))).alias("term"))
    n = rows.select("delivery_id").distinct().count()
    kept = told.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") <= R.STOP_SHARE * F.lit(n)).select("term")
    return told.join(kept, "term", "left_semi").join(rows, "delivery_id").groupBy("term", "file").agg(F.count(F.lit(1)).alias("obs")).where("obs >= 2")


@query("agg_equivalent_boundary", DEL + " SELECT day, distance, min(delivery_id) FILTER (WHERE verified) AS verified_id, min(delivery_id) AS first_id, count(DISTINCT delivery_id) AS n FROM deliveries GROUP BY day, distance")
def agg_equivalent_boundary(spark, d):
    return R.equivalent_boundaries(dv(spark, d))


@query("win_first_parent_distance", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS steps, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders")
def win_first_parent_distance(spark, d):
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = X.table(spark, d, "orders")
    return o.select("o_custkey", "o_orderkey", (F.row_number().over(order) - 1).cast("long").alias("steps"), F.round(F.sum("o_totalprice").over(order.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"))


BM25 = r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS ts FROM documents),
st AS (SELECT count(*) AS n, avg(len(ts)) AS al FROM t),
asked AS (SELECT item_id AS query, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> ''))) AS term FROM benchmark),
po AS (SELECT doc_id, term, count(*) AS tf, max(l) AS l FROM (SELECT doc_id, len(ts) AS l, unnest(ts) AS term FROM t) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM po GROUP BY term),
sc AS (SELECT query, doc_id AS doc, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / al))) AS score, count(*) AS met
       FROM asked JOIN po USING (term) JOIN df USING (term), st GROUP BY ALL),
nt AS (SELECT query, count(*) AS n_terms FROM asked GROUP BY query)"""


def documents(spark, d):
    """Documents as rows that are searched."""
    return X.table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))


def best(spark, d, k: int, all_terms: bool = False):
    """The first k documents of each item by BM25."""
    return N.ranked(documents(spark, d), items(spark, d), k, all_terms=all_terms)


@query("eval_bm25", BM25 + ", r AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, doc) AS rank FROM sc) SELECT query, doc, round(score, 5) AS score, rank FROM r WHERE rank <= 10")
def eval_bm25(spark, d):
    return best(spark, d, 10).select("query", "doc", F.round("score", 5).alias("score"), "rank")


SEARCH_SQL = "WITH " + X.SYMBOLS_SQL + r""",
rows AS (SELECT 'symbol' AS kind, id AS doc, [name, qualified] AS fields FROM symbols UNION ALL SELECT 'string', doc_id * 1000000 + line_no, [line] FROM lines
  UNION ALL SELECT 'config', event_id, [event_type || '.' || coalesce(json_keys(props)[1], '')] FROM events),
tok AS (SELECT kind, doc, field, ws, unnest(generate_series(1, len(ws))) AS pos FROM (SELECT kind, doc, field, list_filter(regexp_split_to_array(lower(coalesce(fields[field], '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws
  FROM (SELECT *, unnest(generate_series(1, len(fields))) AS field FROM rows))),
place AS (SELECT kind, doc, field, pos, ws[pos] AS word FROM tok),
len_all AS (SELECT kind, doc, sum(len(list_filter(regexp_split_to_array(lower(coalesce(f, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')))::BIGINT AS length FROM (SELECT kind, doc, unnest(fields) AS f FROM rows) GROUP BY ALL),
st AS (SELECT kind, count(*) AS n_rows, avg(length) AS mean FROM len_all GROUP BY kind),
q AS (SELECT item_id AS query, regexp_extract_all(text, '[^\s]+') AS w FROM benchmark UNION ALL SELECT 1000000 + event_id, ['error', 'error.' ] FROM events WHERE event_id < 3),
ask AS (SELECT query, unnest(CASE WHEN query < 1000000 THEN [w[1] || ' ' || w[2], w[3]] ELSE w END) AS part, generate_subscripts(CASE WHEN query < 1000000 THEN [w[1] || ' ' || w[2], w[3]] ELSE w END, 1) AS phrase FROM q),
asked AS (SELECT * FROM (SELECT query, phrase, list_filter(regexp_split_to_array(lower(part), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM ask) WHERE len(ws) > 0),
wanted AS (SELECT query, phrase, len(ws) AS m, ws[k] AS word, k FROM (SELECT *, unnest(generate_series(1, len(ws))) AS k FROM asked)),
starts AS (SELECT query, phrase, kind, doc, field, pos - k AS start FROM place JOIN wanted USING (word) GROUP BY query, phrase, m, kind, doc, field, pos - k HAVING count(*) = m),
fr AS (SELECT query, phrase, kind, doc, count(*) AS f FROM starts GROUP BY ALL), df AS (SELECT query, phrase, kind, count(*) AS df FROM fr GROUP BY ALL),
sc AS (SELECT query, kind, doc, sum(greatest(ln((n_rows - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6::DOUBLE) * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))) AS score, count(*) AS met
  FROM fr JOIN df USING (query, phrase, kind) JOIN st USING (kind) JOIN len_all USING (kind, doc) GROUP BY ALL),
hits AS (SELECT query, kind, doc, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, kind, doc) AS rank FROM sc JOIN (SELECT query, count(*) AS phrases FROM asked GROUP BY query) USING (query) WHERE met = phrases)"""


def searched(spark, d):
    """Symbols, lines as strings and keys of events, asked for each item's first two words as a phrase and its third, and for words that many rows have."""
    docs, events = X.table(spark, d, "documents"), X.table(spark, d, "events")
    s, lines = X.symbols(docs), X.lines(docs)
    key = F.concat("event_type", F.lit("."), F.coalesce(F.get(F.json_object_keys("props"), F.lit(0)), F.lit("")))
    rows = s.select(F.lit("symbol").alias("kind"), F.col("id").alias("doc"), F.array("name", "qualified").alias("fields"))
    rows = rows.unionByName(lines.select(F.lit("string").alias("kind"), (F.col("doc_id") * 1_000_000 + F.col("line_no")).alias("doc"), F.array("line").alias("fields")))
    rows = rows.unionByName(events.select(F.lit("config").alias("kind"), F.col("event_id").alias("doc"), F.array(key).alias("fields")))
    w = F.split(F.trim("text"), r"\s+")
    asked = X.table(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.concat_ws(" ", F.concat(F.lit('"'), F.get(w, F.lit(0)), F.lit(" "), F.get(w, F.lit(1)), F.lit('"')), F.get(w, F.lit(2))).alias("text"))
    common = events.where("event_id < 3").select((F.col("event_id") + 1_000_000).alias("query"), F.lit("error error.").alias("text"))
    return B.phrase_search(rows, asked.unionByName(common))


@query("q_search", SEARCH_SQL + " SELECT query, rank, kind, doc, round(score, 5) AS score FROM hits WHERE rank <= 20")
def q_search(spark, d):
    return searched(spark, d)[0].select("query", "rank", "kind", "doc", F.round("score", 5).alias("score"))


@query("search_totals", SEARCH_SQL + " SELECT query, CASE WHEN coalesce(n, 0) <= 20 THEN coalesce(n, 0) END AS total, coalesce(n, 0) > 20 AS truncated FROM q LEFT JOIN (SELECT query, count(*) AS n FROM hits GROUP BY query) USING (query)")
def search_totals(spark, d):
    return searched(spark, d)[1]


@query("search_all_terms", BM25 + ", r AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, doc) AS rank FROM sc JOIN nt USING (query) WHERE met = n_terms) SELECT query, doc, round(score, 5) AS score, rank FROM r WHERE rank <= 20")
def search_all_terms(spark, d):
    return best(spark, d, 20, all_terms=True).select("query", "doc", F.round("score", 5).alias("score"), "rank")


@query("agg_pagination_counts", BM25 + " SELECT query, least(count(*), 21) AS probed, count(*) > 20 AS truncated FROM sc JOIN nt USING (query) WHERE met = n_terms GROUP BY query")
def agg_pagination_counts(spark, d):
    probe = best(spark, d, 21, all_terms=True)
    return probe.groupBy("query").agg(F.count(F.lit(1)).alias("probed"), (F.count(F.lit(1)) > 20).alias("truncated"))


@query("join_fts_rowid", BM25 + " SELECT po.doc_id AS doc, term, tf, source FROM po JOIN documents USING (doc_id)")
def join_fts_rowid(spark, d):
    docs = X.table(spark, d, "documents")
    asked = items(spark, d).select(F.explode(B.terms(F.col("text"))).alias("term")).distinct()
    hits = B.postings(docs.select(F.col("doc_id").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))).join(asked, "term", "left_semi")
    return hits.join(docs.select(F.col("doc_id").alias("doc"), "source"), "doc").select("doc", "term", "tf", "source")


RUNS = BM25 + """, r1 AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, doc) AS rank FROM sc QUALIFY rank <= 50),
r2 AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY met DESC, doc) AS rank FROM sc QUALIFY rank <= 50),
runs AS (SELECT *, 'bm25' AS run FROM r1 UNION ALL SELECT *, 'overlap' FROM r2)"""


def runs(spark, d):
    """Two rankings of the documents for each item: by BM25, and by the number of shared terms. One scoring gives both, computed once."""
    ranked = N.ranked(documents(spark, d), items(spark, d), 50, by=("score", "met"))
    return cut(ranked.select("query", "doc", "rank", F.when(F.col("by") == "score", "bm25").otherwise("overlap").alias("run")))


@query("eval_rrf", RUNS + " SELECT query, doc, round(sum(1 / (60 + rank)), 6) AS score FROM runs GROUP BY ALL")
def eval_rrf(spark, d):
    return B.reciprocal_rank_fusion(runs(spark, d)).select("query", "doc", F.round("score", 6).alias("score"))


@query("win_rrf", RUNS + ", f AS (SELECT query, doc, sum(1 / (60 + rank)) AS score FROM runs GROUP BY ALL) SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, doc) AS rank FROM f QUALIFY rank <= 10")
def win_rrf(spark, d):
    return B.top_k(B.reciprocal_rank_fusion(runs(spark, d)), 10).select("query", "doc", "rank")


@query("set_prepend_dedup", RUNS + ", b AS (SELECT query, doc, min((CASE run WHEN 'overlap' THEN 0 ELSE 1 END, rank)) AS place FROM runs GROUP BY ALL) SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY place, doc) AS rank FROM b")
def set_prepend_dedup(spark, d):
    both = runs(spark, d)
    return B.prepend(both.where("run = 'overlap'"), both.where("run = 'bm25'"))


@query("set_union_all", RUNS + " SELECT run, query, doc, rank FROM runs")
def set_union_all(spark, d):
    return runs(spark, d).select("run", "query", "doc", "rank")


TRUTH = RUNS + """, truth AS (SELECT DISTINCT item_id AS query, doc_id AS doc FROM benchmark JOIN documents ON contains(documents.text, benchmark.text) WHERE regexp_matches(benchmark.text, '[^\\s]')),
rel AS (SELECT query, count(*) AS relevant FROM truth GROUP BY query),
hit AS (SELECT run AS variant, query, count(*) AS hits, min(rank) AS first FROM runs JOIN truth USING (query, doc) WHERE rank <= 10 GROUP BY ALL),
cases AS (SELECT v.variant, query, coalesce(hits, 0) AS hits, relevant, first FROM rel CROSS JOIN (VALUES ('bm25'), ('overlap')) v(variant) LEFT JOIN hit USING (variant, query))"""


def truth(spark, d):
    """Documents that hold a whole item."""
    docs = X.table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    return cut(B.containing(docs, X.table(spark, d, "benchmark").select(F.col("item_id").alias("query"), "text")))


def cases(spark, d):
    return E.per_case(runs(spark, d).withColumnRenamed("run", "variant"), truth(spark, d))


def outcomes(spark, d):
    return E.outcomes(runs(spark, d).withColumnRenamed("run", "variant"), truth(spark, d))


@query("eval_truth", TRUTH + " SELECT query, doc FROM truth")
def eval_truth(spark, d):
    return truth(spark, d)


@query("eval_split", TRUTH + " SELECT variant, query, hits, relevant, first FROM cases")
def eval_split(spark, d):
    return cases(spark, d)


@query("eval_metrics", TRUTH + " SELECT variant, round(sum(hits) / sum(relevant), 6) AS recall, round(sum(hits) / (count(*) * 10), 6) AS precision, round(avg(hits / relevant), 6) AS mean_recall, round(avg(coalesce(1 / first, 0)), 6) AS mrr, count(*) AS cases FROM cases GROUP BY variant")
def eval_metrics(spark, d):
    m = E.metrics(cases(spark, d))
    return m.select("variant", *(F.round(c, 6).alias(c) for c in ("recall", "precision", "mean_recall", "mrr")), "cases")


@query("agg_eval_micro_macro", TRUTH + " SELECT variant, sum(hits)::BIGINT AS hits, sum(relevant)::BIGINT AS relevant, count(first) / count(*) AS coverage FROM cases GROUP BY variant")
def agg_eval_micro_macro(spark, d):
    """Of the whole readout, the columns of the SQL; its coverage is the share of cases that find something."""
    return E.readout(outcomes(spark, d)).select("variant", "hits", "relevant", F.col("found").alias("coverage"))


@query("agg_live_mrr", TRUTH + " SELECT variant, lang AS cohort, round(avg(1 / rank), 6) AS mrr, count(*) AS n FROM (SELECT run AS variant, lang, rank FROM runs JOIN truth USING (query, doc) JOIN documents ON doc_id = doc) GROUP BY ALL")
def agg_live_mrr(spark, d):
    docs = X.table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "lang")
    met = runs(spark, d).join(truth(spark, d), ["query", "doc"]).join(docs, "doc")
    return met.groupBy(F.col("run").alias("variant"), F.col("lang").alias("cohort")).agg(F.round(F.avg(1 / F.col("rank")), 6).alias("mrr"), F.count(F.lit(1)).alias("n"))




@query("eval_folds", "SELECT o_orderkey AS case_id, o_orderdate AS cutoff, ntile(5) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) - 1 AS fold FROM orders")
def eval_folds(spark, d):
    cases = X.table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderdate").alias("cutoff"), "o_orderpriority")
    return E.folds(cases, 5, "o_orderpriority").select("case_id", "cutoff", "fold")


SESSIONS = """
WITH e AS (SELECT user_id, ts, event_type, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 10 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
SELECT user_id, min(ts) AS opened, max(ts) + INTERVAL 10 MINUTE AS closed, count(*) AS events, bool_or(event_type = 'error') AS overflow FROM s GROUP BY user_id, k"""


@query("stream_debounce", SESSIONS)
def stream_debounce(spark, d):
    from loomgraph.streaming.watch import debounce

    out = debounce(X.table(spark, d, "events").select("user_id", "ts", "event_type"), "10 minutes")
    return out.select("user_id", "opened", "closed", "events", "overflow")


@query("stream_event_filter", "SELECT event_id, user_id, event_type FROM events WHERE event_type NOT IN ('view', 'read')")
def stream_event_filter(spark, d):
    from loomgraph.streaming.watch import relevant

    return relevant(X.table(spark, d, "events")).select("event_id", "user_id", "event_type")


@query("stream_overflow", SESSIONS.replace("SELECT user_id, min(ts)", "SELECT user_id, count(DISTINCT k) AS sessions FROM s WHERE event_type = 'error' GROUP BY user_id --"))
def stream_overflow(spark, d):
    return stream_debounce(spark, d).where("overflow").groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"))
