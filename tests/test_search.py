"""Search: documents that hold items, phrases, and the three indexes."""

import itertools
import math
import random
import re

from loomgraph.operators.search import containing, phrase_search


def test_items_of_any_length_find_their_documents(spark):
    docs = [(1, "alpha beta gamma"), (2, "twice beta, then more"), (3, "the alphabet"), (4, "beta\ntwice beta"), (5, None), (6, ""), (7, "one two three four five"), (8, "xone two three fourx")]
    items = [(1, "alpha"), (2, "twice beta"), (3, "one two three four"), (4, "missing here now"), (5, ""), (6, None), (7, "  "), (8, "a b"), (9, "beta "), (10, "e"), (11, "two three")]
    want = {(q, d) for (q, i), (d, t) in itertools.product(items, docs) if i and i.strip() and t is not None and i in t}
    found = containing(spark.createDataFrame(docs, "doc long, text string"), spark.createDataFrame(items, "query long, text string")).collect()
    assert sorted(map(tuple, found)) == sorted(want) and {(1, 1), (1, 3), (2, 2), (2, 4), (3, 7), (3, 8)} <= want


def test_containing_equals_brute_force(spark):
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("ab  c\n") for _ in range(rng.randint(0, n)))
    docs, items = [(k, text(30)) for k in range(60)], [(k, text(8)) for k in range(40)]
    want = {(q, d) for (q, i), (d, t) in itertools.product(items, docs) if i.strip() and i in t}
    found = containing(spark.createDataFrame(docs, "doc long, text string"), spark.createDataFrame(items, "query long, text string")).collect()
    assert sorted(map(tuple, found)) == sorted(want)


def test_phrases_over_three_indexes(spark):
    rows = [("symbol", 1, ["run_due", "crate::run_due"]), ("symbol", 2, ["due", "run::due"]), ("string", 1, ["the due run"]), ("string", 2, ["run due now, run due"]), ("config", 7, ["run", "due"]), ("config", 8, [None, "Run.Due"])]
    queries = [(0, '"run due"'), (1, "run due"), (2, "run-due"), (3, "due"), (4, " -- "), (5, None), (6, 'now "run due"'), (7, "\u00c9t\u00e9")]
    frame = spark.createDataFrame(rows, "kind string, doc long, fields array<string>")
    hits, state = phrase_search(frame, spark.createDataFrame(queries, "query long, text string"), limit=3)
    found = {}
    for r in hits.orderBy("rank").collect():
        found.setdefault(r["query"], []).append((r["kind"], r["doc"]))
    phrase = {("symbol", 1), ("symbol", 2), ("string", 2), ("config", 8)}
    assert set(found[0]) < phrase and len(found[0]) == 3 and set(found[2]) < phrase  # "due run" and words of two fields are no phrase
    assert found[6] == [("string", 2)] and set(found) == {0, 1, 2, 3, 6}
    assert {r["query"]: (r["total"], r["truncated"]) for r in state.collect()} == {0: (None, True), 1: (None, True), 2: (None, True), 3: (None, True), 4: (0, False), 5: (0, False), 6: (1, False), 7: (0, False)}
    assert phrase_search(frame, spark.createDataFrame(queries[:1], "query long, text string"), limit=4)[1].first()["total"] == 4


def test_phrase_scores_equal_plain_bm25(spark):
    rng = random.Random(7)
    rows = [(rng.choice("ab"), k, [" ".join(rng.choice(["x", "y", "z"]) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 2))]) for k in range(40)]
    queries = [(0, '"x y"'), (1, 'x "y z" z'), (2, '"x y x"')]
    got = {(r["query"], r["kind"], r["doc"]): r["score"] for r in phrase_search(spark.createDataFrame(rows, "kind string, doc long, fields array<string>"), spark.createDataFrame(queries, "query long, text string"), limit=1000)[0].collect()}
    want = {}
    for q, text in queries:
        phrases = [p.strip('"').split() for p in re.findall(r'"[^"]*"|[^\s"]+', text)]
        for kind in "ab":
            own = [(d, [f.split() for f in fields]) for k, d, fields in rows if k == kind]
            count = lambda fields, p: sum(f[i : i + len(p)] == p for f in fields for i in range(len(f)))
            length = {d: sum(map(len, fields)) for d, fields in own}
            mean = sum(length.values()) / len(own)
            for d, fields in own:
                n = [count(fields, p) for p in phrases]
                if all(n):
                    df = [sum(count(f, p) > 0 for _, f in own) for p in phrases]
                    want[q, kind, d] = sum(max(math.log((len(own) - x + 0.5) / (x + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length[d] / mean)) for f, x in zip(n, df, strict=True))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
