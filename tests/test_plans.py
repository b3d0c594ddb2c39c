import numpy as np

from loomgraph.operators import graph_joins as J
from loomgraph.operators import search as B
from loomgraph.plans import changes, evaluate, recommend

SNAP = "selector string, path string, name string, kind string, parent string, signature string, body string, hash string"


def snap(spark, rows):
    return spark.createDataFrame([(f"{p}#{n}:function", p, n, "function", "", s, b, h) for p, n, s, b, h in rows], SNAP)


def test_pairing_ladder(spark):
    base = snap(spark, [("a", "same", "s", "b0", "h0"), ("a", "mod", "s", "b1", "h1"), ("a", "sig", "s", "b2", "h2"), ("old", "move", "s", "b3", "h3"), ("a", "was", "s", "b4", "h4"), ("a", "gone", "s", "b5", "h5"), ("p", "cross", "s", "b6", "h6"), ("a", "dup", "s", "b7", "h7"), ("a", "dup", "s", "b8", "h8")])
    head = snap(spark, [("a", "same", "s", "b0", "h0"), ("a", "mod", "s", "x", "x1"), ("a", "sig", "t", "x", "x2"), ("new", "move", "s", "b3", "h3"), ("a", "now", "s", "b4", "x4"), ("a", "fresh", "s", "x", "x5"), ("q", "cross", "s", "z", "x6"), ("a", "dup", "s", "b7", "h7")])
    renames = spark.createDataFrame([("old", "new")], "old_path string, new_path string")
    got = {(r["status"], r["old_selector"] and r["old_selector"].split("#")[1][:-9], r["new_selector"] and r["new_selector"].split("#")[1][:-9]) for r in changes.changed_symbols(base, head, renames).collect()}
    assert got == {("modified", "mod", "mod"), ("signature_changed", "sig", "sig"), ("moved", "move", "move"), ("renamed", "was", "now"), ("removed", "gone", None), ("added", None, "fresh"), ("uncertain", "cross", None), ("uncertain", None, "cross"), ("uncertain", "dup", "dup")}


def test_ambiguous_groups_of_renamed_files_are_listed_once(spark):
    rows = lambda path, names: [(f"{path}#{n}{k}:function", path, n.split("@")[0], "function", "", "s", f"b{n}{k}", f"h{n}{k}") for k, n in enumerate(names)]
    base = spark.createDataFrame(rows("old", ["twin", "twin", "one", "left", "left2"]) + rows("solo", ["was"]), SNAP)
    head = spark.createDataFrame(rows("new", ["twin", "twin", "one", "r1", "r2"]) + rows("solo2", ["a", "b", "c"]), SNAP)
    renames = spark.createDataFrame([("old", "new"), ("solo", "solo2")], "old_path string, new_path string")
    got = {tuple(r) for r in changes.changed_symbols(base, head, renames).collect()}
    assert {r for r in got if r[0] != "uncertain"} == {("moved", "old#one2:function", "new#one2:function", None)}
    groups = {}
    for status, old, new, group in got:
        if status == "uncertain":
            groups.setdefault(group, (set(), set()))[0 if old else 1].add(old or new)
    assert {g: (len(a), len(b)) for g, (a, b) in groups.items()} == {"moved|new|twin|function": (2, 2), "renamed|new|function": (2, 2), "renamed|solo2|function": (1, 3)}


def test_file_changes(spark):
    files = lambda rows: spark.createDataFrame(rows, "path string, hash string")
    got = {tuple(r) for r in changes.file_changes(files([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4"), ("e", "4")]), files([("a", "1"), ("b", "x"), ("c2", "3"), ("d2", "4")])).collect()}
    assert got == {("modified", "b", "b", None), ("renamed", "c", "c2", 100), ("renamed", "d", "d2", 100), ("deleted", "e", None, None)}


def test_edited_renames_and_copies_equal_brute_force(spark):
    import hashlib
    import random
    from collections import Counter

    rng = random.Random(3)
    words = ["}", "", "return x", *(f"line number {k} of the file" for k in range(40))]
    make = lambda: "\n".join(rng.choice(words) for _ in range(rng.randint(0, 14)))
    base = {f"d{k % 3}/f{k}": make() for k in range(25)} | {"null": None}
    head = {}
    for path, text in base.items():
        lines = (text or "").split("\n")
        edited = "\n".join(rng.choice(words) if rng.random() < 0.25 else x for x in lines) + rng.choice(["", "\n"])
        fate = rng.random()
        if fate < 0.3:
            head[path] = text
        elif fate < 0.5:
            head[path] = edited
        elif fate < 0.85:
            head[f"moved/{path}"] = edited if fate > 0.6 else text
        if fate > 0.4 and fate < 0.55:
            head[f"copy/{path}x"] = edited
    head["fresh"] = "nothing like it\n" * 9

    def bag(text):
        lines = text.split("\n")
        return Counter({k: n for k, n in Counter((x, i < len(lines) - 1) for i, x in enumerate(lines)).items() if k[0] or k[1]})

    def score(a, b):
        weigh = lambda bag: sum(n * (len(x.encode()) + e) for (x, e), n in bag.items())
        larger = max(weigh(bag(a)), weigh(bag(b)))
        common = weigh(bag(a) & bag(b))
        return 100 * common // larger if larger and 100 * common >= 50 * larger else None

    text = lambda side, path: side[path] or ""
    want = [("modified", p, p, None) for p in base if p in head and text(base, p) != text(head, p)]
    gone, come = sorted(p for p in base if p not in head), sorted(p for p in head if p not in base)
    for key in (lambda p: p.split("/")[-1], lambda p: ""):
        for p in list(gone):
            if q := next((q for q in come if text(head, q) == text(base, p) and key(p) == key(q)), None):
                want.append(("renamed", p, q, 100))
                gone.remove(p), come.remove(q)
    sources = [p for p in base if p not in head or text(base, p) != text(head, p)]
    scores = {(p, q): s for p in sources for q in come if (s := score(text(base, p), text(head, q))) is not None}
    for p, q in sorted((pq for pq in scores if pq[0] in gone), key=lambda pq: (-scores[pq], *pq)):
        if p in gone and q in come:
            want.append(("renamed", p, q, scores[p, q]))
            gone.remove(p), come.remove(q)
    for q in list(come):
        if best := sorted((-s, p) for (p, t), s in scores.items() if t == q):
            want.append(("copied", best[0][1], q, -best[0][0]))
            come.remove(q)
    want += [("deleted", p, None, None) for p in gone] + [("added", None, q, None) for q in come]
    frame = lambda side: spark.createDataFrame([(p, hashlib.sha256((t or "").encode()).hexdigest(), t) for p, t in side.items()], "path string, hash string, text string")
    got = [tuple(r) for r in changes.file_changes(frame(base), frame(head)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {"copied", "renamed", "added", "deleted", "modified"} == {r[0] for r in want} and any(r[0] == "renamed" and r[3] < 100 for r in want)


def test_lineage_follows_later_renames_only(spark):
    steps = spark.createDataFrame([(1, "a", "b"), (2, "b", "c"), (3, "c", None), (5, "x", "y")], "seq long, old_path string, new_path string")
    origins = spark.createDataFrame([("a", 0), ("b", 1), ("b", 2), ("x", 5), ("x", 4)], "path string, seq long")
    assert {(r["path"], r["seq"], r["current"]) for r in J.path_lineage(steps, origins).collect()} == {("a", 0, None), ("b", 1, None), ("b", 2, "b"), ("x", 5, "x"), ("x", 4, "y")}


def test_recommend_variants(spark):
    import datetime

    day = datetime.date(2020, 1, 1)
    deliveries = spark.createDataFrame([(d, True, day, d, f) for d, fs in [(1, "ab"), (2, "ab"), (3, "c")] for f in fs], "delivery_id long, verified boolean, day date, distance long, file string")
    tasks = spark.createDataFrame([(1, "parse config"), (2, "parse other"), (3, "render page")], "delivery_id long, text string")
    queries = spark.createDataFrame([(0, "parse config")], "query long, text string")
    for variant in ("combined", "task_search_only", "frequency", "word_index"):
        got = [r["file"] for r in recommend.recommend(deliveries, tasks, queries, variant=variant).orderBy("rank").collect()]
        assert got[:2] == ["a", "b"] or variant == "word_index", variant
    rules = {(r["src"], r["dst"]): (r["support"], r["confidence"], r["lift"]) for r in recommend.cochange_rules(deliveries).collect()}
    assert rules == {("a", "b"): (2, 1.0, 1.5), ("b", "a"): (2, 1.0, 1.5)}


def test_bm25_and_fusions(spark):
    docs = spark.createDataFrame([(1, "run due now"), (2, "run run"), (3, "nothing")], "doc long, text string")
    queries = spark.createDataFrame([(0, "run due")], "query long, text string")
    assert [r["doc"] for r in B.top_k(B.bm25(docs, queries), 5).orderBy("rank").collect()] == [1, 2]
    assert [r["doc"] for r in B.bm25(docs, queries, all_terms=True).collect()] == [1]
    first = spark.createDataFrame([(0, 5, 1), (0, 2, 2)], "query long, doc long, rank long")
    second = spark.createDataFrame([(0, 2, 1), (0, 9, 2)], "query long, doc long, rank long")
    assert [r["doc"] for r in B.prepend(first, second).orderBy("rank").collect()] == [5, 2, 9]


def test_intervals_and_gates(spark):
    low, high = evaluate.bootstrap_interval(np.array([0.0, 1.0] * 50))
    assert 0.35 < low < 0.5 < high < 0.65 and evaluate.bootstrap_interval(np.array([1.0])) is None
    assert evaluate.bootstrap_interval(np.array([0.0, 1.0] * 50)) == (low, high)
    assert evaluate.gate({"a": "above", "b": "above"}, 0.6, ("a", "b")) == "pass" and evaluate.gate({"a": "above"}, 0.6, ("a", "b")) == "unevaluable" and evaluate.gate({"a": "above"}, 0.1, ("a",)) == "fail"
    assert len(evaluate.grid({"x": [1, 2], "y": [3, 3]})) == 2
    cases = spark.createDataFrame([("l", q, 1, 2, 1) for q in range(4)] + [("r", q, 0, 2, None) for q in range(4)], "variant string, query long, hits long, relevant long, first long")
    row = evaluate.paired(cases, "l", "r").first()
    assert (row["n"], row["mean_difference"], row["verdict"]) == (4, 0.5, "above")


def test_readout_has_every_metric_of_micro_and_macro(spark):
    """Answers, stale ones and cases without truth count beside hits; the sums are pooled, mean_recall is over cases with truth."""
    runs = [("a", 1, 10, 1), ("a", 1, 11, 2), ("a", 1, 12, 3), ("a", 2, 99, 1), ("a", 3, 98, 2), ("b", 1, 12, 1)]
    truth = [(1, 10), (1, 11), (1, 13), (1, 12), (2, 10)]
    runs, truth = spark.createDataFrame(runs, "variant string, query long, doc long, rank long"), spark.createDataFrame(truth, "query long, doc long")
    asked, live = spark.createDataFrame([(1,), (2,), (3,), (4,)], "query long"), spark.createDataFrame([(d,) for d in (10, 11, 12, 13, 98)], "doc long")
    latency = spark.createDataFrame([("a", 1, 1000), ("a", 1, 500), ("a", 2, 2500)], "variant string, query long, micros long")
    rows = {r["variant"]: r.asDict() for r in evaluate.readout(evaluate.outcomes(runs, truth, 2, asked, live, latency), 2).collect()}
    assert rows["a"] == {
        "variant": "a", "cases": 4, "hits": 2, "relevant": 5, "returned": 4, "recall": 0.4, "precision": 0.25, "cases_with_truth": 2, "mean_recall": 0.25,
        "cases_answered": 3, "coverage": 0.75, "found": 0.25, "stale_rate": 0.25, "mean_latency_ms": 2.0, "max_latency_ms": 2.5,
    }
    assert (rows["b"]["coverage"], rows["b"]["found"], rows["b"]["stale_rate"], rows["b"]["mean_latency_ms"]) == (0.25, 0.25, 0.0, None)
    plain = {r["variant"]: r for r in evaluate.readout(evaluate.outcomes(runs, truth, 2), 2).collect()}
    assert (plain["a"]["cases"], plain["a"]["coverage"], plain["a"]["stale_rate"]) == (2, 1.0, None)
    none = evaluate.readout(evaluate.outcomes(runs, truth.where("query < 0"), 2, asked), 2).where("variant = 'a'").first()
    assert (none["cases"], none["recall"], none["mean_recall"], none["coverage"]) == (4, None, None, 0.75)


def gate_cases(spark, hits):
    """Ten cases of each variant, with ten relevant; ``hits``: per variant, of each case."""
    rows = [(v, q, h, 10, 1 if h else None, 10 if h else 0, 0, None) for v, hs in hits.items() for q, h in enumerate(hs)]
    return spark.createDataFrame(rows, "variant string, query long, hits long, relevant long, first long, returned long, stale long, micros long")


def test_gates_are_all_read(spark):
    """G1 asks both rivals and names an alternative, G2 keeps the winner and names combinations, G4 keeps a setting if no level is worse."""
    roles = evaluate.Roles("w", ("f", "c"), ("s", "t"), ("p", "r"), ("c", "p", "r"))
    low, mid, high, top = ([x, x + 1] * 5 for x in (1, 3, 5, 7))
    state = lambda rows: [(r["gate"], r["state"]) for r in rows]
    good = evaluate.gates(gate_cases(spark, {"w": mid, "f": low, "c": low, "s": low, "t": low, "p": high, "r": mid}), roles)
    assert state(good) == [("G1", "pass"), ("G2", "pass")] and (good[0]["coverage"], good[0]["alternative"], good[1]["keep"], good[1]["combinations"]) == (1.0, None, "w", ["p"])
    bad = evaluate.gates(gate_cases(spark, {"w": mid, "f": low, "c": mid, "s": high, "t": top, "p": mid, "r": mid}), roles)
    assert state(bad) == [("G1", "fail"), ("G2", "fail")] and (bad[0]["alternative"], bad[1]["keep"], bad[1]["combinations"]) == ("c", "t", [])
    even = evaluate.gates(gate_cases(spark, {"w": mid, "f": low, "c": low, "s": mid, "t": low}), roles)
    assert state(even) == [("G1", "pass"), ("G2", "fail")] and even[1]["keep"] is None
    missing = gate_cases(spark, {"w": mid, "f": low, "s": low})
    assert state(evaluate.gates(missing, roles)) == [("G1", "unevaluable"), ("G2", "unevaluable")]
    assert state(evaluate.gates(missing, roles, k=5)) == [("G1", "unevaluable"), ("G2", "unevaluable")] and state(evaluate.gates(missing, roles, unavailable="none"))[0] == ("G1", "unevaluable")
    thin = evaluate.gates(gate_cases(spark, {"w": [0] * 6 + [9] * 4, "f": [0] * 10, "c": [0] * 10}), roles)
    assert (thin[0]["state"], thin[0]["coverage"]) == ("fail", 0.4)
    settings = (
        evaluate.Setting("weight", "presence", "share", ("2", "1")), evaluate.Setting("added", "1", "2", ("3", "1")), evaluate.Setting("still", "1"),
        evaluate.Setting("none", "1", "2", unavailable="no grid"), evaluate.Setting("far", "1", "2", ("9", "1")),
    )
    files, symbols = gate_cases(spark, {"1": mid, "2": high, "3": high}), gate_cases(spark, {"1": mid, "2": mid, "3": low})
    four = evaluate.gates(missing, roles, settings=settings, cell_files=files, cell_symbols=symbols)[2:]
    assert [(r["option"], r["state"], r["kept"]) for r in four] == [("weight", "pass", "share"), ("added", "fail", "1"), ("still", "fail", "1"), ("none", "unevaluable", "1"), ("far", "unevaluable", "1")]
