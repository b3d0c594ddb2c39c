"""What joins and shuffles form must follow their inputs: rows are counted in the plans that ran."""

from __future__ import annotations


def plan_nodes(df):
    """The operators of the plan that ran for ``df``, which is computed here."""
    df.collect()
    todo = [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            yield name, node
            todo += [node.children().apply(i) for i in range(node.children().size())]


def metric(node, name: str) -> int:
    found = node.metrics().get(name)
    return found.get().value() if found.isDefined() else 0


def most_rows(df) -> int:
    return max(metric(node, "numOutputRows") for _, node in plan_nodes(df))


def shuffled_rows(df) -> int:
    return sum(metric(node, "shuffleRecordsWritten") for name, node in plan_nodes(df) if name == "ShuffleExchangeExec")


def test_members_of_one_name_form_no_pairs(spark):
    from loomgraph.operators.reexports import type_members

    members = spark.range(2000).selectExpr("id", "concat('f', id % 50) as file", "'T' as type", "'m' as name", "if(id % 2 = 0, 'inherent', 'trait_impl') as tier")
    found = type_members(members.selectExpr("id as ref_id", "file", "type", "name"), members)
    assert most_rows(found) <= 3 * 2000
    assert found.count() == 2000 and {r["confidence"] for r in found.select("confidence").distinct().collect()} == {"fuzzy_name"}


def test_bm25_shuffles_documents_once_and_no_term(spark):
    from loomgraph.operators.search import bm25

    docs = spark.range(300).selectExpr("id as doc", "concat('w', id, ' a b c d e f g h i j k l m n o p q r s t') as text")
    queries = spark.range(40).selectExpr("id as query", "concat('w', id, ' a b c d e f g h i j k l m n o p q r s t') as text")
    found = bm25(docs, queries)
    assert shuffled_rows(found) <= 300 + 320 + 80  # documents, distinct terms of the queries, a few of statistics; a row per document and term would be 6,300
    assert found.count() == 300 * 40 and found.where("query = doc and met = 21").count() == 40 and found.where("met = 20").count() == 299 * 40
    few = bm25(docs.limit(30).unionByName(docs.limit(1)), queries).where("query = 0")  # a document in two rows counts as one
    assert few.count() == 30 and few.where("doc = 0").first()["met"] == 21


def test_search_beyond_what_is_handed_to_tasks(spark, monkeypatch):
    from loomgraph.operators import search as B

    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "alpha beta"), (3, None), (4, "")], "doc long, text string")
    queries = spark.createDataFrame([(1, "alpha beta gamma"), (2, "beta"), (3, "")], "query long, text string")
    rows = lambda: (sorted(tuple(r) for r in B.bm25(docs, queries).collect()), sorted(tuple(r) for r in B.containing(docs, queries).collect()))
    near = rows()
    monkeypatch.setattr(B, "HANDED_WORDS", 1)
    monkeypatch.setattr(B, "HANDED_ITEMS", 1)
    far = rows()
    assert far[1] == near[1] == [(1, 1), (2, 1), (2, 2)]
    assert [r[:2] + r[3:] for r in far[0]] == [r[:2] + r[3:] for r in near[0]] and all(abs(a[2] - b[2]) < 1e-12 for a, b in zip(*(x[0] for x in (near, far)), strict=True))


def test_containing_shuffles_no_words_or_texts(spark):
    from loomgraph.operators.search import containing

    docs = spark.range(300).selectExpr("id as doc", "concat('x', id, ' a b c d e f g h i j k l m n o p q r s t end') as text")
    items = spark.range(10).selectExpr("id as query", "concat('x', id, ' a b c') as text")
    found = containing(docs, items)
    assert shuffled_rows(found) <= 10
    assert sorted(tuple(r) for r in found.collect()) == [(k, k) for k in range(10)]


def history_case(spark):
    deliveries = spark.range(400).selectExpr("id as delivery_id", "id % 3 = 0 as verified", "if(id % 7 = 0, null, id) as distance", "explode(transform(sequence(0, 9), k -> concat('d/f', (id * 3 + k) % 30))) as file")
    words = " ".join(f"w{k}" for k in range(2))
    tasks = spark.range(400).selectExpr("id as delivery_id", f"concat('own', id % 200, ' {words}') as text")
    return deliveries, tasks, spark.range(25).selectExpr("id as query", f"concat('own', id, ' {words}') as text")


def test_history_forms_no_row_per_query_task_and_file(spark):
    from loomgraph.plans.recommend import history_scores

    found = history_scores(*history_case(spark))
    assert most_rows(found) <= 20_000  # a row per query, task and file would be 25 * 200 * 20 = 100,000
    assert found.count() == 25 * 30


def test_blocks_of_any_size_make_the_same_products(spark, monkeypatch):
    import collections

    import numpy as np

    from loomgraph.operators import products as P

    rng = np.random.default_rng(4)
    left = sorted({(int(t), int(q)) for t, q in zip(rng.integers(0, 40, 300), rng.integers(0, 12, 300), strict=True)})
    right = sorted({(int(t), int(f)) for t, f in zip(rng.integers(0, 40, 400), rng.integers(0, 30, 400), strict=True)})
    lt, lq = (np.array(c) for c in zip(*left, strict=True))
    rt, rf = (np.array(c) for c in zip(*right, strict=True))
    s, w, n = rng.random(len(lt)) + 0.1, rng.random(len(rt)), rng.integers(1, 5, len(rt)).astype(float)
    w[::5] = np.nan
    m = w / 2
    want = collections.defaultdict(lambda: [0.0, 0, -1.0])
    for a in range(len(lt)):
        for b in np.flatnonzero(rt == lt[a]):
            x = want[lq[a], rf[b]]
            x[1] += n[b]
            if not np.isnan(w[b]):
                x[0], x[2] = x[0] + s[a] * w[b], max(x[2], s[a] * m[b])
    for cells, strip in ((1, 1), (7, 3), (60, 128), (10**6, 5)):
        monkeypatch.setattr(P, "STRIP", strip)
        got = collections.defaultdict(lambda: [0.0, 0, -1.0])
        for a, b in P.blocks(lt, lq, rt, rf, cells):
            assert len(set(lq[a])) * len(set(rf[b])) <= max(cells, len(set(lq[a])))
            for q, f, score, count, most in zip(*P.product(lt[a], lq[a], s[a], rt[b], rf[b], w[b], n[b], m[b]), strict=True):
                x = got[q, f]
                x[1] += count
                if not np.isnan(score):
                    x[0], x[2] = x[0] + score, max(x[2], most)
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_phrases_meet_rows_where_they_are(spark, monkeypatch):
    from loomgraph.operators import search as B

    rows = spark.range(300).selectExpr("'s' as kind", "id as doc", "array(concat('the name', id, ' the the'), concat('x', id, ' the')) as fields")
    queries = spark.range(20).selectExpr("id as query", "concat('\"the name', id, ' the\" x', id) as text").unionByName(spark.createDataFrame([(50, "the the."), (51, '"the x7"'), (52, "?")], "query long, text string"))

    def found():
        hits, state = B.phrase_search(rows, queries)
        return sorted(tuple(r) for r in hits.collect()), sorted(tuple(r) for r in state.collect())

    dealt, real = [], B.dealt
    monkeypatch.setattr(B, "dealt", lambda df, *keys: dealt.append(df.count()) or real(df, *keys))
    near = found()
    assert sum(dealt) <= 2 * 300 + 2 * 4 * 300 + 3 * 20  # sizes of fields, "the" twice at its four places, the rare phrases
    monkeypatch.setattr(B, "HANDED_WORDS", 1)
    assert found() == near
    assert [r[0] for r in near[0] if r[0] < 50] == list(range(20)) and (50, None, True) in near[1] and (51, 0, False) in near[1] and (52, 0, False) in near[1]


def test_impacts_without_fallback_are_the_others(spark):
    from loomgraph.operators.traverse import impacts

    edges = spark.createDataFrame([(1, 2, 1, 0, "a", "call"), (3, 1, 3, 0, "b", "call"), (4, 5, 4, 0, "c", "call")], "src long, dst long, category int, edge_class int, ord string, kind string")
    origins = spark.createDataFrame([(2,), (5,)], "origin long")
    whole, bare = impacts(edges, origins)[0], impacts(edges, origins, fallback=False)[0]
    assert whole.where("fallback").count() == 1
    assert sorted(bare.collect()) == sorted(whole.where("not fallback").collect()) and bare.count() == 2


def test_candidate_tests_read_paths_once(spark):
    from loomgraph.plans.evidence import candidate_tests

    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    paths = spark.createDataFrame([(1, 2), (1, 3), (4, 3)], "origin long, node long").mapInPandas(counted, "origin long, node long")
    symbols = spark.createDataFrame([(1, "load", "function", "a/x.py"), (2, "test_load", "function", "t/y.py"), (3, "other", "function", "a/z.py"), (4, "save", "function", "a/w.py")], "id long, name string, kind string, file_path string")
    imports = spark.createDataFrame([("t/y.py", "w")], "from_file string, target_path string")
    found = candidate_tests(paths, symbols, imports).collect()
    assert sorted(tuple(r) for r in found) == [(1, 2, "call_path"), (1, 2, "naming_heuristic"), (4, 2, "import_relationship")]
    assert read.value == 3


def test_lines_are_told_apart_without_a_join(spark):
    from loomgraph.plans.changes import line_elements

    files = spark.createDataFrame([(1, "a\na\n"), (2, "é\n\nb"), (3, ""), (4, "\n")], "id long, text string")
    lines = line_elements(files)
    assert not [name for name, _ in plan_nodes(lines) if "Join" in name]
    assert {r["id"]: r["total"] for r in lines.collect()} == {1: 4, 2: 5, 4: 1} and all(r["w"] == r["total"] for r in lines.groupBy("id", "total").agg({"weight": "sum"}).toDF("id", "total", "w").collect())


def ranking_case(spark):
    import random

    rng = random.Random(5)
    text = lambda most: " ".join(rng.choice(["alpha", "Beta", "g-7", "delta", "étéx", "Key", "x" * 9, "eta"]) for _ in range(rng.randint(0, most)))
    docs = [(k, text(12)) for k in range(-20, 220)] + [(k, "alpha beta") for k in range(300, 360)] + [(400, None), (401, "")]
    rng.shuffle(docs)
    queries = [(k, text(4)) for k in range(12)] + [(3, "beta key"), (None, "alpha"), (20, ""), (21, None), (22, "missing")]
    return spark.createDataFrame(docs, "doc long, text string").repartition(5), spark.createDataFrame(queries, "query long, text string")


def test_rankings_equal_bm25_in_blocks_of_any_size(spark, monkeypatch):
    from loomgraph.operators import rankings as N
    from loomgraph.operators.search import bm25, top_k

    docs, queries = ranking_case(spark)
    docs = docs.cache()
    key = lambda r: tuple((x is None, x) for x in r)
    rows = lambda df: sorted(((*r[:2], round(r[2], 9), *r[3:]) for r in df.collect()), key=key)
    for whole in (False, True):
        scored = bm25(docs, queries, all_terms=whole)
        want = rows(top_k(scored, 7).select("query", "doc", "score", "met", "rank")), rows(top_k(scored.selectExpr("query", "doc", "score as s", "met", "double(met) as score"), 7).select("query", "doc", "s", "met", "rank"))
        for sizes in ((1_000_000, 1_000_000, 500, 200_000), (1, 1, 1, 1), (40, 30, 7, 90)):
            for name, value in zip(("CELLS", "GAINS", "DOCS", "HELD"), sizes, strict=True):
                monkeypatch.setattr(N, name, value)
            found = N.ranked(docs, queries, 7, by=("score", "met"), all_terms=whole).select("query", "doc", "score", "met", "rank", "by").collect()
            assert tuple(sorted(((*r[:2], round(r[2], 9), *r[3:5]) for r in found if r["by"] == by), key=key) for by in ("score", "met")) == want
    monkeypatch.setattr(N, "PLACES", 1)
    assert rows(N.ranked(docs, queries, 7, all_terms=True).select("query", "doc", "score", "met", "rank")) == want[0]


def test_rankings_of_repeated_and_missing_ids(spark):
    from loomgraph.operators.rankings import ranked

    docs = spark.createDataFrame([(1, "a b"), (1, "b c"), (None, "a c"), (2, "c")], "doc long, text string")
    found = ranked(docs, spark.createDataFrame([(1, "b c"), (2, "z")], "query long, text string"), 5, by=("met",)).collect()
    assert {(r["doc"], r["met"]) for r in found} == {(1, 2), (None, 1), (2, 1)} and len(found) == 3
    none = spark.createDataFrame([(1, " - ")], "query long, text string")
    assert ranked(docs.where("doc = 2"), none, 5).count() == 0 and ranked(docs.where("doc = 9"), docs.selectExpr("doc as query", "text"), 5).count() == 0


def test_rankings_hand_on_the_best_rows_alone(spark):
    from loomgraph.operators.rankings import ranked

    docs = spark.range(3000).selectExpr("id as doc", "concat('w', id, ' a b c d e f g') as text").repartition(3)
    queries = spark.range(20).selectExpr("id as query", "concat('w', id, ' a b c') as text")
    found = ranked(docs, queries, 5, by=("score", "met"))
    assert most_rows(found) <= 3000 and found.count() == 20 * 5 * 2  # a row per query and document would be 60,000
    assert found.where("by = 'score' and rank = 1 and query = doc and met = 4").count() == 20


def without_scores_of_all_documents(spark, monkeypatch, name):
    from loomgraph.operators import search
    from loomgraph.registry import QUERIES

    def scored(*_, **__):
        raise AssertionError("a row per query and document")

    monkeypatch.setattr(search, "bm25", scored)
    return QUERIES[name](spark, "/root/testdata/sf0.001")


def test_eval_paired_forms_no_row_per_query_and_document(spark, monkeypatch):
    assert without_scores_of_all_documents(spark, monkeypatch, "eval_paired").count() == 1


def test_eval_split_forms_no_row_per_query_and_document(spark, monkeypatch):
    assert {r["variant"] for r in without_scores_of_all_documents(spark, monkeypatch, "eval_split").collect()} == {"bm25", "overlap"}


def test_set_union_all_forms_no_row_per_query_and_document(spark, monkeypatch):
    found = without_scores_of_all_documents(spark, monkeypatch, "set_union_all")
    assert found.where("rank <= 50").count() == found.count() > 0 and {r["run"] for r in found.select("run").distinct().collect()} == {"bm25", "overlap"}


def test_eval_prepend_forms_no_row_per_query_and_document(spark, monkeypatch):
    assert 0 < without_scores_of_all_documents(spark, monkeypatch, "eval_prepend").groupBy("query").count().agg({"count": "max"}).first()[0] <= 50
