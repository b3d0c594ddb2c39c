import random

import pytest

from loomgraph.operators import graph_joins as J
from loomgraph.operators import history as H
from loomgraph.operators import reexports as P
from loomgraph.plans import evidence as E


def test_changes_go_to_the_innermost_symbols(spark):
    symbols = spark.createDataFrame([(1, "a", 1, 100), (2, "a", 10, 20), (3, "a", 30, 40), (4, "b", 1, 5)], "symbol_id long, path string, first long, last long")
    changes = spark.createDataFrame([(1, "a", 12, 13), (2, "a", 50, 60), (3, "a", 15, 35), (4, "c", 1, 1)], "change_id long, path string, first long, last long")
    assert {tuple(r) for r in H.attribute_side(changes, symbols).collect()} == {(1, 2), (2, 1), (3, 2), (3, 3), (4, None)}


def test_symbols_pair_exactly_before_by_signature(spark):
    schema = "delivery_id long, id long, qualified string, kind string, signature string"
    before = spark.createDataFrame([(1, 1, "f", "function", "f()"), (1, 2, "g", "function", "g()"), (1, 3, "twin", "function", "t()"), (1, 4, "twin", "function", "t()")], schema)
    after = spark.createDataFrame([(1, 11, "f", "function", "f(x)"), (1, 12, "h", "function", "g()"), (1, 13, "twin", "function", "t()")], schema)
    assert {tuple(r) for r in H.pair_symbols(before, after).collect()} == {(1, 1, 11, "exact"), (1, 2, 12, "signature")}


def test_states_and_eligibility(spark):
    live = spark.createDataFrame([("a",), ("b",), ("b",)], "name string")
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "key long, name string")
    assert {tuple(r) for r in H.resolve_current(old, live).collect()} == {(1, "live"), (2, "ambiguous"), (3, "deleted")}
    tasks = spark.createDataFrame([(1, "x", "known_pre_execution", "2020-01-01", "2020-01-02"), (1, "y", "known_pre_execution", "2020-01-01", "2020-01-01"), (1, "z", "uncertain", "2019-01-01", "2019-01-01"), (2, "w", "known_pre_execution", None, None)], "task_id long, text string, text_availability string, snapshot_at string, captured_at string")
    marked = H.task_eligible(tasks, "2021-01-01")
    assert [r["eligible"] for r in marked.collect()] == [True, True, False, False]
    assert [tuple(r) for r in H.resolve_query(marked).collect()] == [(1, "y")]
    assert [r["eligible"] for r in H.task_eligible(tasks, "2021-01-01", strict=False).collect()] == [True, True, True, False]


def test_reexports_follow_chains_and_cycles(spark):
    steps = spark.createDataFrame([("top", "mid", None), ("mid", "low", "f"), ("low", "top", None), ("two", "low", None), ("two", "other", None)], "module string, source_module string, name string")
    defined = spark.createDataFrame([("low", "f", 1), ("low", "g", 2), ("other", "f", 3)], "module string, name string, symbol_id long")
    got = {tuple(r) for r in P.reexport_closure(steps, defined).collect()}
    assert got == {("mid", "f", 1, "hit"), ("top", "f", 1, "hit"), ("two", "f", None, "ambiguous"), ("two", "g", 2, "hit")}


def test_reexport_closure_goes_to_the_end(spark):
    """A name that two definitions reach, one of them over sixty-six modules, is ambiguous; aliases and explicit names go before whole modules."""
    steps = [(f"m{k}", f"m{k + 1}", None, None) for k in range(66)] + [("m0", "near", "f", None), ("n0", "near", None, None), ("n0", "m1", None, None), ("al", "near", "f", "g"), ("al", "m60", None, None)]
    defined = [("m66", "f", 1), ("near", "f", 2), ("m66", "g", 3), ("m66", "h", 4)]
    got = {(r["module"], r["name"]): (r["answer"], r["symbol_id"]) for r in P.reexport_closure(spark.createDataFrame(steps, "module string, source_module string, name string, alias string"), spark.createDataFrame(defined, "module string, name string, symbol_id long")).collect()}
    assert got["m0", "f"] == ("hit", 2) and got["m0", "g"] == ("hit", 3) and got["n0", "f"] == ("ambiguous", None) and got["m1", "f"] == ("hit", 1)
    assert got["al", "g"] == ("hit", 2) and got["al", "f"] == ("hit", 1) and got["al", "h"] == ("hit", 4)


def plain_reexports(start, rows, ends, limit):
    pending, visited, found = [start], set(), set()
    while pending:
        path = pending.pop()
        if path in visited:
            continue
        visited.add(path)
        if len(visited) > limit:
            return ("ambiguous", None)
        if path != start and len(ends.get(path, ())) == 1:
            found |= ends[path]
        segments = path.split("::")
        for k in range(len(segments)):
            module, following, after = "::".join(segments[:k]), segments[k], segments[k + 1 :]
            own = [r for r in rows if r[0] == module]
            explicit = any(r[2] == following for r in own)
            for _, target, alias, source in own:
                if alias == following:
                    pending.append("::".join(x for x in [target, alias if source is None else source, *after] if x))
                elif alias is None and not explicit and module:
                    pending.append("::".join(x for x in [target, *segments[k:]] if x))
    return None if not found else ("hit", found.pop()) if len(found) == 1 else ("ambiguous", None)


def test_paths_follow_aliases_diamonds_and_cycles(spark):
    import random

    rows = [("a", "b", None, None), ("b", "c", "x", "y"), ("d", "b", "inner", ""), ("loop", "pool", None, None), ("pool", "loop", None, None), ("grow", "grow::grow", None, None), ("dia", "l", None, None), ("dia", "r", None, None), ("l", "end", None, None), ("r", "end", None, None), ("two", "l2", None, None), ("two", "r2", None, None), ("", "c", "top", "y")]
    rng = random.Random(4)
    rows += [("::".join(rng.choices("pqs", k=rng.randint(1, 2))), "::".join(rng.choices("pqs", k=rng.randint(1, 2))), rng.choice([None, None, "p", "f"]), rng.choice([None, "q", ""])) for _ in range(9)]
    ends = {"c::y": {1}, "b::z": {2}, "end::f": {3}, "l2::f": {4}, "r2::f": {5}, "pool::k": {6}, "same::f": {7, 8}, "p::f": {10}, "q::s::f": {11}, "s": {12}}
    starts = ["a::x", "a::z", "d::inner::z", "loop::k", "loop::none", "grow::f", "dia::f", "two::f", "plain", "top::x", "b::x"] + ["::".join(rng.choices("pqsf", k=rng.randint(2, 4))) for _ in range(25)]
    paths = spark.createDataFrame([(s,) for s in starts], "path string")
    found = P.follow_reexports(paths, spark.createDataFrame(rows, "module string, target string, alias string, source string"), spark.createDataFrame([(p, i) for p, ids in ends.items() for i in ids], "path string, symbol_id long"), limit=12)
    got = {r["path"]: (r["answer"], r["symbol_id"]) for r in found.collect()}
    want = {s: w for s in starts if "::" in s and (w := plain_reexports(s, rows, ends, 12)) is not None}
    assert got == want
    assert got["a::x"] == got["b::x"] == ("hit", 1) and got["d::inner::z"] == ("hit", 2) and got["dia::f"] == ("hit", 3) and got["two::f"] == ("ambiguous", None) and got["loop::k"] == ("hit", 6) and got["grow::f"] == ("ambiguous", None)


def test_members_by_tier_then_file(spark):
    members = spark.createDataFrame([(1, "a", "T", "m", "inherent"), (2, "b", "T", "m", "trait_impl"), (3, "a", "U", "m", "trait_impl"), (4, "b", "U", "m", "trait_impl")], "id long, file string, type string, name string, tier string")
    refs = spark.createDataFrame([(1, "z", "T", "m"), (2, "b", "U", "m"), (3, "z", "U", "m"), (4, "z", "V", "m")], "ref_id long, file string, type string, name string")
    assert {tuple(r) for r in P.type_members(refs, members).collect()} == {(1, 1, "import_resolved"), (2, 4, "exact"), (3, None, "fuzzy_name"), (4, None, "fuzzy_name")}


def test_entry_points_and_tests(spark):
    symbols = spark.createDataFrame([(1, "parse", "function", "src/a.py", "parse", "a"), (2, "test_parse", "function", "tests/test_a.py", "test_parse", "t"), (3, "main", "function", "src/m.py", "main", "m"), (4, "mid", "function", "src/m.py", "mid", "m"), (5, "go", "function", "src/m.py", "go", "m")], "id long, name string, kind string, file_path string, qualified string, module string")
    paths = spark.createDataFrame([(1, 4, 1, "1,4"), (1, 3, 2, "1,4,3"), (1, 5, 2, "1,4,5"), (1, 2, 1, "1,2")], "origin long, node long, distance long, path string")
    commands = spark.createDataFrame([("go",)], "handler_symbol string")
    assert {tuple(r) for r in E.entry_points(paths, symbols, commands).collect()} == {(1, 2, 1, "test"), (1, 3, 2, "main"), (1, 5, 2, "command")}
    imports = spark.createDataFrame([("tests/test_a.py", "a")], "from_file string, target_path string")
    assert {tuple(r) for r in E.candidate_tests(paths, symbols, imports).collect()} == {(1, 2, "call_path"), (1, 2, "import_relationship"), (1, 2, "naming_heuristic")}
    origins = spark.createDataFrame([(1,), (9,)], "origin long")
    assert [tuple(r) for r in E.no_path_reasons(origins, paths).collect()] == [(9, "no_inbound_edge")]


STEPS = "seq long, old_path string, new_path string"


def test_lineage_is_followed_to_its_end(spark):
    chain = [(k, f"c{k}", f"c{k + 1}") for k in range(100)]
    rnd = random.Random(4)
    tangled = [(rnd.randrange(60), f"p{rnd.randrange(6)}", rnd.choice([f"p{rnd.randrange(6)}", f"p{rnd.randrange(6)}", f"p{rnd.randrange(6)}", None])) for _ in range(90)]
    steps = chain + tangled
    asked = [("c0", -1), ("c0", 0), ("c90", 5), ("x", 1), (None, 1)] + [(f"p{k}", s) for k in range(6) for s in range(-1, 60, 7)]

    def end(path, at):
        while path is not None:
            later = [(s, n is not None, n) for s, o, n in steps if o == path and s > at]
            if not later:
                break
            at, _, path = min(later)
        return path

    got = J.path_lineage(spark.createDataFrame(steps, STEPS), spark.createDataFrame(asked, "path string, seq long"), rounds=8)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((p, s, end(p, s)) for p, s in asked), key=repr)
    with pytest.raises(RuntimeError):
        J.path_lineage(spark.createDataFrame(chain, STEPS), spark.createDataFrame(asked, "path string, seq long"), rounds=3).count()
