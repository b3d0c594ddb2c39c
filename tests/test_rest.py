"""Requests, reports, caches, ignore files, rungs, history and streams against small cases."""

import json
import subprocess
import threading
import time
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from loomgraph.operators.history import backfill, rebuild
from loomgraph.operators.reexports import trait_defaults
from loomgraph.operators.resolve import resolve
from loomgraph.plans.evaluate import live_holdout, sweep
from loomgraph.plans.evidence import import_matches
from loomgraph.plans.recommend import history_scores
from loomgraph.plans.report import excerpts, fit_to_bytes, invalid_request
from loomgraph.sources.caches import TableCache
from loomgraph.sources.worktree import ignore_pattern, scan
from loomgraph.streaming.watch import Cancelled, Coalescer, Progress


def test_import_tiers(spark):
    paths = [("src/net/http.rs",), ("pkg/a/__init__.py",), ("lib/src/mod.rs",), ("x.py",), ("",)]
    imports = [
        ("t1", "net.http", None), ("t2", "http", None), ("t3", "crate::net::http", None), ("t4", "crate::http", None), ("t5", "super::self::http", None), ("t6", "pkg/a", None), ("t7", "pkg", "a"),
        ("t8", "a", None), ("t9", "x", None), ("t10", "crate", None), ("t11", "other.http2", None), ("t12", "", None), ("t13", "lib::src", None),
    ]
    found = import_matches(spark.createDataFrame(paths, "path string"), spark.createDataFrame(imports, "from_file string, target_path string, target_symbol string")).collect()
    assert {(r["from_file"], r["path"], r["tier"]) for r in found} == {
        ("t1", "src/net/http.rs", "identified"), ("t2", "src/net/http.rs", "basename_only"), ("t3", "src/net/http.rs", "identified"), ("t4", "src/net/http.rs", "basename_only"),
        ("t5", "src/net/http.rs", "basename_only"), ("t6", "pkg/a/__init__.py", "identified"), ("t7", "pkg/a/__init__.py", "identified"), ("t8", "pkg/a/__init__.py", "basename_only"),
        ("t9", "x.py", "identified"), ("t13", "lib/src/mod.rs", "identified"),
    }


def test_same_module_by_shared_prefix_and_relative_paths(spark):
    symbols = spark.createDataFrame(
        [(1, "a.rs", "m::a", "rust", "f", "f", "function"), (2, "b.rs", "n::a", "rust", "g", "g", "function"), (3, "c.rs", "q", "rust", "h", "h", "function"), (4, "d.rs", "a", "go", "g", "g", "function")],
        "id long, file_path string, module string, lang string, name string, qualified string, kind string",
    )
    ref = lambda i, name, target=None, lang="rust": (i, "a.rs", "m::a", lang, name, "call", target)
    refs = [ref(1, "g"), ref(2, "h"), ref(3, "g", "self::g"), ref(4, "g", "super::g"), ref(5, "g", "other::g"), ref(6, "g", "self::g", "go"), ref(7, "g", lang="go")]
    found = resolve(spark.createDataFrame(refs, "id long, from_file string, module string, lang string, name string, kind string, target string"), symbols)
    got = {r["id"]: (r["confidence"], r["target_id"]) for r in found.collect()}
    assert got == {1: ("same_module", 2), 2: ("fuzzy_name", None), 3: ("same_module", 2), 4: ("same_module", 2), 5: ("fuzzy_name", None), 6: ("fuzzy_name", None), 7: ("same_module", 4)}


def test_trait_defaults(spark):
    impls = spark.createDataFrame([("T", "A", "x"), ("T", "B", "x"), ("U", "A", "x"), ("U", "A", "y"), ("V", "A", "x"), ("V", "C", "y")], "type string, trait string, file string")
    declared = spark.createDataFrame([(1, "A", "m"), (2, "B", "n"), (3, "A", "both"), (4, "B", "both"), (5, "C", "m")], "id long, trait string, member string")
    refs = spark.createDataFrame(
        [(1, "T", "m", None, False), (2, "T", "both", None, False), (3, "T", "both", "B", False), (4, "U", "m", None, False), (5, "U", "m", None, True), (6, "V", "m", "A", False), (7, "W", "m", None, True), (8, "T", "none", None, True)],
        "ref_id long, type string, member string, trait string, scoped boolean",
    )
    assert {tuple(r) for r in trait_defaults(refs, impls, declared).collect()} == {(1, 1), (3, 4), (5, 1), (6, 1)}


def test_rebuild_and_backfill(spark):
    schema = "repository string, landing_branch string, delivery_id long, evidence string, n long"
    stored = spark.createDataFrame([("r", "main", 1, "verified", 1), ("r", "main", 2, "git_only", 2), ("r", "dev", 3, "git_only", 3), ("q", "main", 2, "git_only", 4)], schema)
    fresh = spark.createDataFrame([("r", "main", 1, "git_only", 10), ("r", "main", 5, "git_only", 50), ("q", "main", 9, "git_only", 90)], schema)
    rows = lambda df: sorted((r["repository"], r["landing_branch"], r["delivery_id"], r["n"]) for r in df.collect())
    assert rows(rebuild(stored, fresh, "r", "main")) == [("q", "main", 2, 4), ("r", "dev", 3, 3), ("r", "main", 1, 1), ("r", "main", 5, 50)]
    assert rows(rebuild(stored, fresh, "r", "main", discard_verified=True)) == [("q", "main", 2, 4), ("r", "dev", 3, 3), ("r", "main", 1, 10), ("r", "main", 5, 50)]
    old = spark.createDataFrame([(1, "a", None), (2, "b", None), (3, None, None), (4, "d", 7), (5, "e", None), (6, "f", None)], "delivery_id long, files string, lines long")
    new = spark.createDataFrame([(1, "a", 10), (2, "other", 20), (3, None, 30), (4, "d", 40), (6, "f", 60)], "delivery_id long, files string, lines long")
    assert {r["delivery_id"]: r["lines"] for r in backfill(old, new, "lines", 4).collect()} == {1: 10, 2: None, 3: 30, 4: 7, 5: None, 6: None}


def test_fit_to_bytes():
    made = lambda: {"symbols": [{"selector": f"s{k}", "callers": list(range(40)), "entry_points": [1], "candidate_tests": []} for k in range(8)], "unresolved": ["u" * 10] * 30}
    whole = len(json.dumps(made(), separators=(",", ":")))
    for size in (whole, whole - 1, 1200, 900, 700):
        document = made()
        fits = fit_to_bytes(document, size)
        assert fits == (len(json.dumps(document, separators=(",", ":"))) <= size)
        assert fits and document.get("truncated", False) == (size < whole)
    document = made()
    assert not fit_to_bytes(document, 5) and document["symbols"] == document["unresolved"] == []


def test_invalid_requests(spark):
    rows = [("q", None, 10, None, "combined", False), (" \t", None, 10, None, "combined", False), (None, "t", None, "t", "combined", False), (None, "t", 0, None, "combined", False), (None, "t", 101, None, "combined", False)]
    rows += [(None, "t", 1, "u", "combined", False), ("q", None, 1, "q", "combined", False), ("q", None, 1, None, "combined", True), ("q", None, 1, None, "word_index", True), (None, None, 1, None, "combined", False)]
    asked = spark.createDataFrame(rows, "a string, b string, c int, d string, e string, f boolean")
    assert [r[0] for r in asked.select(invalid_request(*(F.col(x) for x in "abcdef"))).collect()] == [None, "query", None, "limit", "limit", "task_snapshot", "task_snapshot", "word_index", None, "query"]


def test_excerpts(spark):
    texts = spark.createDataFrame([("a", "\n".join(map(str, range(1, 10)))), ("b", None)], "path string, text string")
    spans = spark.createDataFrame([("a", 1, 1), ("a", 5, 6), ("a", 9, 9), ("a", 30, 31), ("b", 1, 1)], "path string, first long, last long")
    got = {(r["path"], r["first"]): (r["first_shown"], r["last_shown"], r["excerpt"]) for r in excerpts(spans, texts, 2).collect()}
    assert got == {("a", 1): (1, 3, "1\n2\n3"), ("a", 5): (3, 8, "3\n4\n5\n6\n7\n8"), ("a", 9): (7, 9, "7\n8\n9"), ("b", 1): (1, 1, "")}


def test_ignore_files_agree_with_git(spark, tmp_path):
    files = ["a.py", "b/a.py", "b/c/d.py", "b/c/e.md", "keep/x.py", "logs/1.py", "b/logs/2.py", "doc/a.md", "doc/sub/a.md", "x1.py", "x2.py", "b/__init__.py", "q[1].py", "target/t.py", "b/.env", "doc/sp ace.py"]
    for name in files:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    (tmp_path / ".gitignore").write_text("# c\n/a.py\nlogs/\ndoc/*.md\n!doc/a.md\nx[12].py\n!x2.py\nb/**/e.md\n\nq\\[1].py\n")
    (tmp_path / "b" / ".gitignore").write_text("d.py\n/c/zzz\n!nothing\n")
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    shown = subprocess.run(["git", "-C", str(tmp_path), "ls-files", "-o", "--exclude-standard"], check=True, capture_output=True, text=True).stdout.split("\n")
    found = {r["path"]: r["status"] for r in scan(spark, str(tmp_path)).collect()}
    assert set(found) == {x.strip('"') for x in shown if x and not x.startswith("target/")} and set(found.values()) == {"found"}
    assert {r["path"] for r in scan(spark, f"file:{tmp_path}", ["b/*", "*.md"]).collect()} == {x for x in found if not x.startswith("b/") and not x.endswith(".md")}
    assert ignore_pattern("  ", "") is None and ignore_pattern("# x", "") is None


def test_paths_fail_alone(spark, tmp_path, monkeypatch):
    from loomgraph.sources import worktree

    (tmp_path / "ok.py").write_text("x")
    (tmp_path / "gone.py").symlink_to(tmp_path / "nowhere")
    with open(tmp_path / "big.py", "wb") as file:
        file.truncate(worktree.MAX_FILE_BYTES + 1)
    got = {r["path"]: (r["status"], r["hash"] is None) for r in scan(spark, str(tmp_path)).collect()}
    assert got == {"ok.py": ("found", False), "big.py": ("oversize", True)}
    reader = worktree.WorktreeReader({"path": str(tmp_path)})
    assert [r[4] for r in reader.read(worktree.Files([("missing.py", 3, 0.0), ("ok.py", 1, 0.0), ("dir/", -1, 0.0)]))] == ["unreadable", "found", "unreadable"]


def test_table_cache(spark, tmp_path):
    now = [0.0]
    cache = TableCache(spark, str(tmp_path / "c"), keep=2, max_age=50, clock=lambda: now[0])
    built = []

    def build(n):
        return lambda: built.append(n) or spark.range(n)

    for n in (1, 2, 1, 3, 2):
        now[0] += 1
        assert cache.get(build(n), f"k{n}").count() == n
    assert built == [1, 2, 3, 2]  # 2 was used before 1, so 3 drove it out
    assert cache.publish(cache.stage(spark.range(9)), "k2").count() == 2  # the first publisher wins
    now[0] += 100
    assert cache.clean() == 2 and cache.lookup("k2") is None
    assert TableCache(spark, str(tmp_path / "c"), version=2).place("k") != cache.place("k")


def test_callers_share_one_refresh():
    calls, gate = [], threading.Event()

    def refresh():
        calls.append(1)
        gate.wait(10)
        if len(calls) == 2:
            raise ValueError("broken")
        return len(calls)

    shared, got = Coalescer(refresh), []

    def ask():
        try:
            got.append(shared())
        except ValueError as error:
            got.append(str(error))

    for _ in range(2):
        threads = [threading.Thread(target=ask) for _ in range(5)]
        for t in threads:
            t.start()
        time.sleep(0.3)
        gate.set()
        for t in threads:
            t.join()
        gate.clear()
    assert len(calls) == 2 and got == [1] * 5 + ["broken"] * 5


def test_progress_and_cancel(spark):
    seen = []
    progress = Progress(spark, lambda phase, rows: seen.append((phase, rows)))
    assert progress.phase("one", spark.range(7)).count() == 7 and seen == [("one", 7)]
    threading.Timer(2, progress.cancel).start()
    slow = spark.range(4, numPartitions=4).select(F.udf(lambda x: time.sleep(30) or x, "long")("id"))
    began = time.time()
    with pytest.raises(Cancelled):
        progress.phase("two", slow)
    assert time.time() - began < 25
    with pytest.raises(Cancelled):
        progress.phase("three", spark.range(1))


def test_sweep_takes_the_first_of_equals(spark):
    rows = [(2, 1, 2, 1, 1), (0, 1, 2, 0, 1), (1, 1, 2, 1, 1), (3, 0, 2, 1, 1)]
    assert sweep(spark.createDataFrame(rows, "cell int, hits int, relevant int, symbol_hits int, symbol_relevant int")).first()["cell"] == 1


def test_live_holdout(spark):
    rows = [(1, "2020-01-01", 9, True, "a"), (2, "2020-01-02", 8, False, "a"), (3, "2020-01-03", 7, True, "b"), (4, "2020-01-09", 1, True, "a"), (4, "2020-01-09", 1, True, "z"), (5, "2020-01-10", 0, False, "b")]
    d = spark.createDataFrame(rows, "delivery_id long, day string, distance long, verified boolean, file string").withColumn("day", F.to_date("day"))
    got = {(r["variant"], r["cohort"]): (r["cases"], r["recall"], r["mrr"]) for r in live_holdout(d, 2, k=1).collect()}
    assert got == {("frequency", "all"): (2, 0.25, 0.5), ("frequency", "verified"): (1, 0.5, 1.0), ("recency", "all"): (2, 0.5, 0.5), ("recency", "verified"): (1, 0.0, 0.0)}


def test_history_scores_against_brute_force(spark):
    deliveries = [(k, k % 2 == 0, k % 5, f"f{j}") for k in range(12) for j in range(k % 4 + 1)]
    tasks = [(k, ["fix the parser", "fix the lexer now", "docs", None][k % 4]) for k in range(12)]
    queries = [(1, "parser fix"), (2, "the docs now"), (3, "nothing here")]
    d = spark.createDataFrame(deliveries, "delivery_id long, verified boolean, distance long, file string")
    got = {(r["query"], r["file"]): r for r in history_scores(d, spark.createDataFrame(tasks, "delivery_id long, text string"), spark.createDataFrame(queries, "query long, text string")).collect()}
    breadth, prevalence = {}, {}
    for k, _, _, f in deliveries:
        breadth[k], prevalence[f] = breadth.get(k, 0) + 1, prevalence.get(f, 0) + 1
    want = {}
    for q, text in queries:
        for k, verified, distance, f in deliveries:
            shared = set(text.split()) & {w.rstrip("s") if len(w) > 4 else w for w in (tasks[k][1] or "").split()}
            if shared:
                weight = 0.5 ** (distance / 50) / breadth[k] ** 0.5 / (1 + 2 * prevalence[f] / 12) * (1.0 if verified else 0.55)
                want.setdefault((q, f), []).append(len(shared) / len(text.split()) * weight)
    assert set(got) == set(want)
    for key, parts in want.items():
        assert got[key]["score"] == pytest.approx(sum(parts)) and got[key]["deliveries"] == len(parts) and got[key]["strongest"] == pytest.approx(max(parts))


def test_accumulated_has_all_that_supports_a_destination(spark):
    """A delivery of several tasks counts once, with the most similar; equal rows are one task; sets, reasons and the first fallback come with the sums."""
    from loomgraph.plans.recommend import accumulated

    files = [(1, True, 0, "a", None), (1, True, 0, "b", "moved"), (2, False, 50, "a", "late"), (3, True, 100, "a", "later"), (4, True, 0, "c", None)]
    told = [(1, "fix parser"), (1, "fix lexer now"), (2, "parser"), (2, "parser"), (3, "fix parser"), (4, "docs")]
    d = spark.createDataFrame(files, "delivery_id long, verified boolean, distance long, file string, fallback string")
    tasks, queries = spark.createDataFrame(told, "delivery_id long, text string"), spark.createDataFrame([(7, "fix parser"), (8, "lexer")], "query long, text string")
    ubiquity = {"a": 1 / (1 + 2 * 3 / 4), "b": 1 / (1 + 2 * 1 / 4)}
    first = 2**-0.5 * 2**-0.5  # of two files and two tasks
    parts = {(7, "a"): {1: first, 2: 0.5 * 0.5 * 0.55, 3: 0.25}, (7, "b"): {1: first}, (8, "a"): {1: first}, (8, "b"): {1: first}}
    want = {key: {k: v * ubiquity[key[1]] for k, v in by.items()} for key, by in parts.items()}
    texts = {sha256(t.encode()).hexdigest(): t for _, t in told}
    whole, sums = ({(r["query"], r["file"]): r for r in df.collect()} for df in (accumulated(d, tasks, queries), history_scores(d, tasks, queries)))
    assert set(whole) == set(sums) == set(want)
    for key, by in want.items():
        got = whole[key]
        assert got["score"] == pytest.approx(sum(by.values())) == sums[key]["score"] and got["strongest"] == pytest.approx(max(by.values())) == sums[key]["strongest"]
        assert got["deliveries"] == sorted(by) and sums[key]["deliveries"] == len(by)
        assert [r["delivery_id"] for r in got["reasons"]] == sorted(by, key=by.get, reverse=True) and sum(r["contribution"] for r in got["reasons"]) == pytest.approx(got["score"])
        assert got["reasons"][0]["kind"] == "historical_change"
    assert {texts[t] for t in whole[7, "a"]["tasks"]} == {"fix parser", "fix lexer now", "parser"} and [texts[t] for t in whole[8, "a"]["tasks"]] == ["fix lexer now"]
    assert [(whole[k]["file_fallback"], whole[k]["fallback"]) for k in ((7, "a"), (7, "b"), (8, "a"))] == [(True, "late"), (True, "moved"), (False, None)]
    some = accumulated(d, tasks, queries, only=spark.createDataFrame([(7, "a"), (8, "c")], "query long, file string")).collect()
    assert some == [whole[7, "a"]]
