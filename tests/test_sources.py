import json
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from loomgraph.plans.graph import Graph, render
from loomgraph.sources import deliveries, extract, git_source, worktree
from loomgraph.sources.store import Store
from loomgraph.streaming.watch import debounce, relevant, sync_stream

CODE = {
    "src/a.py": "import os\nfrom b import helper\n\nclass Base(object):\n    def run(self):\n        return helper()\n\ndef main():\n    return Base().run() + main2()\n\ndef main2():\n    return 'a notable string'\n",
    "src/b.py": "def helper():\n    return 1\n",
    "README.md": "# Title\n\nsee [docs](http://x)\n\n## Part one\n```\ncode\n```\n# Next\n",
    "Cargo.toml": '[package]\nname = "prog"\n[dependencies.serde]\nversion = "1"\n',
    "lib.rs": "use std::fmt;\npub fn go() {\n    helper(1);\n}\nstruct Point { x: i32 }\n",
    "node_modules/x.js": "function hidden() {}\n",
    "broken.json": "{",
}


@pytest.fixture
def tree(tmp_path):
    for name, text in CODE.items():
        path = tmp_path / "tree" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return tmp_path / "tree"


def test_facts_by_language():
    facts = lambda name, lang: [dict(zip(extract.COLUMNS, f, strict=True)) for f in extract.facts_of(name, CODE[name].encode(), lang)]
    python = facts("src/a.py", "python")
    assert {(f["qualified"], f["kind"]) for f in python if f["fact"] == "symbol"} == {("Base", "class"), ("Base::run", "method"), ("main", "function"), ("main2", "function")}
    assert {f["name"] for f in python if f["fact"] == "ref"} == {"helper", "Base", "run", "main2"}
    assert any(f["fact"] == "relation" and f["target"] == "object" for f in python) and any(f["fact"] == "string" for f in python)
    heads = [(f["qualified"], f["span_start"], f["span_end"]) for f in facts("README.md", "markdown") if f["fact"] == "symbol"]
    assert heads == [("title", 0, 56), ("title::part-one", 31, 56), ("next", 56, 63)]
    assert {f["name"] for f in facts("Cargo.toml", "config")} == {"package", "package.name", "dependencies", "dependencies.serde", "dependencies.serde.version"}
    assert [f["fact"] for f in facts("broken.json", "config")] == ["failure"]
    assert {(f["name"], f["kind"]) for f in facts("lib.rs", "rust") if f["fact"] == "symbol"} == {("go", "function"), ("Point", "struct")}


def test_scan_and_programs(spark, tree):
    found = worktree.scan(spark, str(tree), ignore=["broken.*"])
    assert {r["path"] for r in found.collect()} == set(CODE) - {"node_modules/x.js", "broken.json"}
    assert [tuple(r) for r in worktree.program_names(found).collect()] == [("Cargo.toml", "prog")]


def test_graph_sync_and_queries(spark, tree, tmp_path):
    graph = Graph.open(spark, str(tmp_path / "store"))
    assert graph.sync(str(tree)) == {"new": 6}
    found = graph.refs("symbol:src/b.py#helper:function")
    assert [(r["from_file"], r["confidence"]) for r in found["entries"]] == [("src/a.py", "import_resolved")]
    assert {r["callee"] for r in graph.callees("symbol:src/a.py#main:function").collect()} == {"Base", "run", "main2"}
    nodes, truncated = graph.impact("symbol:src/b.py#helper:function")
    assert nodes.count() >= 1 and not truncated
    hits, state = graph.search("main2")
    assert hits.first()["qualified"] == "main2" and tuple(state.first()) == (1, False)
    assert {(r["kind"], r["label"]) for r in graph.search('"notable string"')[0].collect()} == {("string", "a notable string")} and graph.search('"string notable"')[0].count() == 0
    assert [r["label"] for r in graph.search("serde version")[0].collect()] == ["dependencies.serde.version"] and graph.search("serde", kind="symbol")[0].count() == 0
    hits, state = graph.search("helper", lang="rust")
    assert hits.count() == 0 and tuple(graph.search("package", limit=1)[1].first()) == (None, True)
    with pytest.raises(ValueError):
        graph.search(" ")
    assert graph.deps("src").count() == 2 and graph.implementors("object").count() == 1 and graph.table("failures").count() == 1
    # an edit: only the changed file is extracted anew, all references resolve as in a full build
    (tree / "src/b.py").write_text("def other():\n    return 1\n")
    (tree / "lib.rs").unlink()
    assert graph.sync(str(tree)) == {"unchanged": 4, "modified": 1, "deleted": 1}
    fresh = Graph.open(spark, str(tmp_path / "fresh"))
    fresh.sync(str(tree))
    for table in ("symbols", "refs", "imports"):
        pick = lambda g: sorted(map(str, g.table(table).select(*sorted(g.table(table).columns)).collect()))  # noqa: B023, E731
        assert pick(graph) == pick(fresh)
    assert graph.sync(str(tree)) == {"unchanged": 5} and graph.resolved == 0


def names_to_source(rng, names):
    """A module of functions, each of which calls some names; one in three begins with an import."""
    lines = [f"from {rng.choice(['m0', 'm1', 'pkg.m2'])} import {rng.choice(names)}"] if rng.random() < 0.3 else []
    for name in rng.sample(names, rng.randint(1, 4)):
        lines += ["", f"def {name}():", *(f"    {n}()" for n in rng.sample(names, rng.randint(0, 4))), "    pass"]
    return "\n".join(lines) + "\n"


def test_sync_after_random_edits_equals_a_full_build(spark, tmp_path):
    rng = random.Random(4)
    names = [f"f{k}" for k in range(9)]
    files = ["m0.py", "m1.py", "pkg/m2.py", "pkg/m3.py", "pkg/src/m4.py", "other/m0.py"]
    tree = tmp_path / "tree"
    for f in files:
        (tree / f).parent.mkdir(parents=True, exist_ok=True)
        (tree / f).write_text(names_to_source(rng, names))
    graph = Graph.open(spark, str(tmp_path / "store"))
    graph.sync(str(tree))
    total = graph.table("refs").count()
    assert graph.resolved == total
    fewer = False
    for step in range(2):
        for f in rng.sample(files, 2):
            if rng.random() < 0.25 and (tree / f).exists():
                (tree / f).unlink()
            elif rng.random() < 0.4 and (tree / f).exists():  # moves every span, changes no definition
                (tree / f).write_text("# moved\n" + (tree / f).read_text())
            else:
                (tree / f).write_text(names_to_source(rng, names))
        graph.sync(str(tree))
        fewer = fewer or graph.resolved < graph.table("refs").count()
        fresh = Graph.open(spark, str(tmp_path / f"fresh{step}"))
        fresh.sync(str(tree))
        for table in ("symbols", "refs", "imports"):
            columns = sorted(fresh.table(table).columns)
            assert sorted(map(str, graph.table(table).select(*columns).collect())) == sorted(map(str, fresh.table(table).select(*columns).collect())), (step, table)
    assert fewer


def test_sync_resolves_only_what_an_edit_can_change(spark, tmp_path):
    tree = tmp_path / "tree"
    (tree / "x").mkdir(parents=True)
    (tree / "y").mkdir()
    (tree / "x/m.py").write_text("def far():\n    near()\n\ndef user():\n    helper()\n    far()\n")
    (tree / "y/m.py").write_text("def helper():\n    pass\n")
    graph = Graph.open(spark, str(tmp_path / "store"))
    graph.sync(str(tree))
    (tree / "y/m.py").write_text("# a comment\n\ndef helper():\n    pass\n")  # the same definition further down
    graph.sync(str(tree))
    assert graph.resolved == 0
    (tree / "y/m.py").write_text("def helper2():\n    pass\n")
    graph.sync(str(tree))
    assert graph.resolved == 1  # the call of helper; those of near and far keep their answers


def test_store_commits_once_and_cleans(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    with pytest.raises(LookupError):
        store.read("t")
    for k in range(3):
        store.commit({"t": spark.range(k + 1)}, f"v{k}")
    assert store.commit({"t": spark.range(99)}, "v2") == "v2" and store.read("t").count() == 3
    assert store.clean(keep=1) == ["v0", "v1"] and store.read("t").count() == 3 and not store.stale(60)


def test_a_commit_that_stops_anywhere_leaves_the_last_version(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    store.commit({"t": spark.range(2)}, "v0")

    def stop(*_):
        raise KeyboardInterrupt

    for step in ("_publish", "_rename"):  # all tables written; the manifest written too, but not in its place
        with monkeypatch.context() as m:
            m.setattr(Store, step, stop)
            with pytest.raises(KeyboardInterrupt):
                store.commit({"t": spark.range(7)}, "v1")
        again = Store(spark, str(tmp_path / "s"))
        assert again.manifest()["current"] == "v0" and again.read("t").count() == 2
    assert store.commit({"t": spark.range(5)}, "v1") == "v1" and store.read("t").count() == 5


def test_no_writer_loses_a_version(spark, tmp_path, monkeypatch):
    store, other = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    first = Store._latest
    calls = []

    def late(self):  # another writer publishes after this one has read the manifest
        found = first(self)
        if self is store and not calls:
            calls.append(1)
        elif self is store and len(calls) == 1:
            calls.append(2)
            other.commit({"t": spark.range(1)}, "theirs")
        return found

    monkeypatch.setattr(Store, "_latest", late)
    store.commit({"t": spark.range(2)}, "ours")
    assert [v["id"] for v in store.manifest()["versions"]] == ["theirs", "ours"] and store.read("t", "theirs").count() == 1
    for k in range(20):
        store.commit({"t": spark.range(1)}, f"v{k}") if k < 3 else store._publish(lambda now: True)
    assert len(store._numbers()) <= 9 and store.manifest()["current"] == "v2"


def test_render_forms(spark):
    df = spark.createDataFrame([(1, "a\tb"), (2, None)], "n long, s string")
    out = []
    for form in ("table", "tsv", "json", "ndjson"):
        render(df, form, limit=1, emit=out.append)
    assert "(first 1 rows)" in out and "1\ta\\tb" in out and json.loads(out[-2]) == {"rows": [{"n": 1, "s": "a\tb"}], "truncated": True}


def test_git_sources(spark, tmp_path):
    repo = tmp_path / "repo"
    repo.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    (repo / "a.txt").write_text("one\ntwo\nthree\n")
    run("add", "."), run("commit", "-qm", "first")
    run("mv", "a.txt", "b.txt")
    (repo / "link").symlink_to("b.txt")
    run("add", "."), run("commit", "-qm", "second\n\nTask-Id: A-1")
    git_source.register(spark)
    blobs = {r["path"]: (r["skipped"], r["content"]) for r in spark.read.format("git_tree").option("path", str(repo)).load().collect()}
    assert blobs["link"] == ("symlink", None) and bytes(blobs["b.txt"][1]) == b"one\ntwo\nthree\n"
    changes = {(r["place"], r["change"], r["old_path"], r["new_path"]) for r in spark.read.format("git_history").option("path", str(repo)).load().collect()}
    assert changes == {(0, "A", None, "a.txt"), (1, "R", "a.txt", "b.txt"), (1, "A", None, "link")}
    assert len(git_source.default_base(str(repo))) == 40


def test_delivery_replays_and_conflicts(spark):
    base = dict(schema_version=2, repository="r", landing_branch="m", before_revision="a", after_revision="b", delivery_id="1", evidence="verified", delivered_at=("known", "x"), tasks=[("T", "t", "ghp_abcdefghijkl1234", "u")])
    make = lambda *rows: spark.createDataFrame([tuple({**base, **r}.values()) for r in rows], deliveries.ENVELOPE)
    accepted, rejected = deliveries.validate(make({}, {"delivery_id": "2", "schema_version": 1}, {"delivery_id": "3", "after_revision": "a"}))
    assert {r["reason"] for r in rejected.collect()} == {"schema_version", "empty_boundary"}
    assert accepted.first()["tasks"][0]["description"] == "[REDACTED_SECRET]"
    fresh, conflicts = deliveries.merge(accepted, accepted.unionByName(accepted.withColumn("evidence", F.lit("other"))))
    assert fresh.count() == 0 and conflicts.count() == 1


def test_debounce_stream_equals_batch(spark, tmp_path):
    rows = [(1, f"2020-01-01 00:{m:02}:00", "error" if m == 30 else "edit") for m in (0, 5, 14, 30)] + [(2, "2020-01-01 00:00:00", "view"), (1, "2020-01-02 00:00:00", "edit")]
    events = spark.createDataFrame(rows, "user_id long, ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(str(tmp_path / "in"))
    batch = {tuple(r) for r in debounce(relevant(events)).collect()}
    assert {(r[0], r[3], r[4]) for r in batch} == {(1, 3, False), (1, 1, True), (1, 1, False)}
    stream = debounce(relevant(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))), watermark="1 minute")
    seen = []
    query = sync_stream(stream, lambda df, full, batch_id: seen.extend((*map(tuple, df.collect()), full)), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert {x for x in seen if isinstance(x, tuple)} <= batch and len([x for x in seen if isinstance(x, tuple)]) >= 2 and True in seen


def test_every_query_is_registered_with_a_known_name():
    from loomgraph import registry

    assert registry.FLAGSHIP in registry.QUERIES and set(registry.ORACLE_SQL) <= set(registry.QUERIES)


def test_braces_in_literals_and_nesting():
    code = b"""// fn hidden() {
pub struct S { a: u8 }
impl S {
    fn one(&self) -> &'static str { let c = '{'; "}}}" /* } */ }
    fn two(&self)
    {
        call_me("not_me()"); // nor_me()
    }
}
fn last() { one() }
"""
    from loomgraph.sources.extract import facts_of

    found = [dict(zip(("path", "fact", "name", "qualified", "kind", "start", "end", "line"), f, strict=False)) for f in facts_of("a.rs", code, "rust")]
    symbols = {f["name"]: f for f in found if f["fact"] == "symbol"}
    assert "hidden" not in symbols and code[symbols["one"]["start"] : symbols["one"]["end"]].strip().endswith(b"*/ }")
    assert code[symbols["two"]["start"] : symbols["two"]["end"]].strip().endswith(b"nor_me()\n    }") and code[symbols["last"]["start"] : symbols["last"]["end"]] == b"fn last() { one() }"
    assert {f["name"] for f in found if f["fact"] == "ref"} == {"call_me", "one"}
    if "impl" in {f["kind"] for f in found if f["fact"] == "symbol"}:
        assert symbols["two"]["qualified"] == "S::two"


def test_facts_grow_with_the_file():
    import time

    from loomgraph.sources.extract import facts_of

    for path, lang, make in (
        ("a.rs", "rust", lambda n: b"fn f() { g() }\n" * n), ("a.rs", "rust", lambda n: b"fn f() {\n" * n), ("a.toml", "config", lambda n: b"".join(b"k%d = 1\n" % k for k in range(n))),
        ("a.md", "markdown", lambda n: b"".join(b"#" * (1 + k % 6) + b" h\n" for k in range(n))), ("a.md", "markdown", lambda n: b"# top\n" + b"## h\n" * n),
    ):
        spent = []
        for n in (2_000, 16_000):
            content, began = make(n), time.process_time()
            assert facts_of(path, content, lang)
            spent.append(time.process_time() - began)
        assert spent[1] < 24 * max(spent[0], 0.01), (path, spent)
