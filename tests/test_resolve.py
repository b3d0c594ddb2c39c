"""One small fixture per rung of the resolution ladder."""

from pyspark.sql import functions as F

from loomgraph.operators.resolve import dependents, resolve

SYMBOLS = "id long, file_path string, module string, lang string, name string, qualified string, kind string"
REFS = "id long, from_file string, module string, lang string, name string, kind string, target string, receiver_unknown boolean"
IMPORTS = "from_file string, target_path string, target_symbol string"


def answers(spark, symbols, refs, imports=None, reexports=None):
    found = resolve(
        spark.createDataFrame(refs, REFS), spark.createDataFrame([(i, f, m, "rust", n, q, k) for i, f, m, n, q, k in symbols], SYMBOLS), None if imports is None else spark.createDataFrame(imports, IMPORTS),
        None if reexports is None else spark.createDataFrame(reexports, "module string, target string, alias string, source string"),
    )
    return {r["id"]: (r["confidence"], r["target_id"]) for r in found.collect()}


def ref(i, name, file="a.rs", module="m::a", kind="call", target=None, unknown=False):
    return (i, file, module, "rust", name, kind, target, unknown)


SYMS = [(1, "a.rs", "m::a", "f", "f", "function"), (2, "b.rs", "m::b", "g", "g", "function"), (3, "c.rs", "m::a", "h", "h", "function"), (4, "d.rs", "m::b", "twin", "twin", "function"), (5, "e.rs", "n::b", "twin", "twin", "function"), (6, "a.rs", "m::a", "two", "x::two", "function"), (7, "a.rs", "m::a", "two", "y::two", "function"), (8, "b.rs", "m::b", "T", "T", "impl")]


def test_rungs(spark):
    got = answers(
        spark, SYMS,
        [
            ref(1, "f"), ref(2, "g"), ref(3, "h"), ref(4, "two"), ref(5, "f", kind="runtime_invocation"), ref(6, "f", unknown=True), ref(7, "g", target="b::g"), ref(8, "g", target="m::b::g"), ref(9, "T"), ref(10, "nothing"),
            ref(11, "two", target="x::two"), ref(12, "twin", target="b::twin"), ref(13, "g", kind="use", target="b::g"),
        ],
    )
    assert got[1] == ("exact", 1) and got[3] == ("same_module", 3)
    assert got[7] == got[8] == ("exact", 2) and got[11] == ("exact", 6)
    for k in (2, 4, 5, 6, 9, 10, 12, 13):
        assert got[k] == ("fuzzy_name", None), k


def test_imports_go_before_modules_and_ambiguity_stops(spark):
    imports = [("a.rs", "m::b", "g"), ("z.rs", "b", None), ("y.rs", "m::b", None), ("y.rs", "n::b", "twin")]
    got = answers(spark, SYMS, [ref(1, "g"), ref(2, "twin", file="z.rs", module="m::b"), ref(3, "twin", file="y.rs", module="q"), ref(4, "f")], imports)
    assert got == {1: ("import_resolved", 2), 2: ("fuzzy_name", None), 3: ("import_resolved", 5), 4: ("exact", 1)}


def test_incremental_equals_full(spark):
    before = [s for s in SYMS if s[0] != 3]
    after = [(*SYMS[0][:3], "f2", "f2", "function"), *SYMS[1:]]
    refs = [ref(1, "f"), ref(2, "f2"), ref(3, "h"), ref(4, "twin", target="m::b::twin"), ref(5, "g", file="x.rs", module="m::b")]
    frame = lambda rows: spark.createDataFrame([(i, f, m, "rust", n, q, k) for i, f, m, n, q, k in rows], SYMBOLS)
    raw = spark.createDataFrame(refs, REFS)
    stale = {r["id"] for r in dependents(frame(before), frame(after), raw).collect()}
    assert stale == {1, 2, 3}
    old, new = answers(spark, before, refs), answers(spark, after, refs)
    again = {r["id"]: (r["confidence"], r["target_id"]) for r in resolve(raw.where(F.col("id").isin(*stale)), frame(after)).collect()}
    assert {**old, **again} == new


def test_free_items_and_members_of_one_name(spark):
    symbols = [(1, "a.rs", "m::a", "run", "run", "function"), (2, "a.rs", "m::a", "run", "A::run", "method"), (3, "b.rs", "m::b", "go", "<B>::go", "method"), (4, "c.rs", "x::a", "stop", "stop", "function"), (5, "d.rs", "y::a", "stop", "<S>::stop", "method")]
    got = answers(spark, symbols, [ref(1, "run"), ref(2, "run", target="run"), ref(3, "run", target="A::run"), ref(4, "run", unknown=True), ref(5, "go"), ref(6, "stop"), ref(7, "run", target="crate::run"), ref(8, "run", target="std::process::run")])
    assert got[1] == got[2] == got[7] == ("exact", 1) and got[3] == ("exact", 2) and got[6] == ("same_module", 4)
    assert got[4] == got[5] == got[8] == ("fuzzy_name", None)


MEMBERS = [
    (1, "cfg.rs", "k::cfg", "load", "<Conf>::load", "method"), (2, "cfg.rs", "k::cfg", "load", "<Conf as Loader>::load", "method"), (3, "other.rs", "k::other", "load", "<Conf>::load", "method"),
    (4, "tr.rs", "k::tr", "hi", "Greet::hi", "method"), (5, "foo.rs", "k::foo", "Foo", "<Foo as Greet>", "impl"), (6, "one.rs", "k::one", "solo", "<One>::solo", "method"), (7, "tr.rs", "k::tr", "load", "Loader::load", "method"),
    (8, "p.rs", "p::two", "twin", "<Two>::twin", "method"), (9, "q.rs", "q::two", "twin", "<Two>::twin", "method"), (10, "free.rs", "k::free", "load", "load", "function"),
]


def test_members_of_types(spark):
    imports = [("i.rs", "crate::other", "Conf"), ("ext.rs", "reqwest", "Conf"), ("a.rs", "m::b", "g")]
    rows = [
        ref(1, "load", target="crate::k::cfg::Conf::load"), ref(2, "load", file="i.rs", target="<Conf>::load", unknown=True), ref(3, "load", file="ext.rs", target="Conf::load"), ref(4, "load", file="cfg.rs", module="k::cfg", target="<Conf>::load", unknown=True),
        ref(5, "load", target="<Conf>::load", unknown=True), ref(6, "hi", target="Foo::hi"), ref(7, "hi", target="<dyn Greet>::hi", unknown=True), ref(8, "solo", target="One::solo"), ref(9, "load", target="<k::cfg::Conf as Loader>::load"),
        ref(10, "twin", file="r.rs", module="z::two", target="Two::twin"), ref(11, "twin", file="p.rs", module="p::two", target="Two::twin"), ref(12, "nope", target="Gone::nope"), ref(13, "solo", target="<Gone>::solo"), ref(14, "load", file="s.rs", module="k::sub", target="super::cfg::Conf::load"),
    ]
    got = answers(spark, MEMBERS, rows, imports)
    assert got[1] == ("import_resolved", 1) and got[2] == ("import_resolved", 3) and got[4] == ("exact", 1) and got[14] == ("import_resolved", 1)
    assert got[3] == got[5] == got[10] == got[12] == ("fuzzy_name", None)  # a type from outside, two files, two modules of one name, nothing
    assert got[6] == got[7] == ("exact", 4) and got[8] == ("exact", 6) and got[9] == ("exact", 2) and got[11] == ("exact", 8)
    assert got[13][0] == "fuzzy_name"


def test_reexports_are_a_rung(spark):
    symbols = [(1, "in.rs", "k::inner", "f", "f", "function"), (2, "l.rs", "k::l", "two", "two", "function"), (3, "r.rs", "k::r", "two", "two", "function")]
    reexports = [("api", "k::inner", None, None), ("api", "k::inner", "g", "f"), ("both", "k::l", None, None), ("both", "k::r", None, None)]
    rows = [ref(1, "f", target="api::f"), ref(2, "g", target="crate::api::g"), ref(3, "two", target="both::two"), ref(4, "f", kind="use", target="api::f"), ref(5, "f", target="none::f")]
    got = answers(spark, symbols, rows, reexports=reexports)
    assert got[1] == got[2] == ("import_resolved", 1) and got[3] == got[4] == got[5] == ("fuzzy_name", None)


def test_dependents_of_members(spark):
    """An impl block that comes, a declaration that goes: the references that they answer are found, and resolving those alone equals resolving all."""
    frame = lambda rows: spark.createDataFrame([(i, f, m, "rust", n, q, k) for i, f, m, n, q, k in rows], SYMBOLS)
    refs = [ref(1, "hi", target="Foo::hi"), ref(2, "solo", target="One::solo"), ref(3, "load", target="k::cfg::Conf::load"), ref(4, "hi", target="<dyn Greet>::hi")]
    for before, after in (([s for s in MEMBERS if s[0] != 5], MEMBERS), (MEMBERS, [s for s in MEMBERS if s[0] not in (4, 1)])):
        stale = {r["id"] for r in dependents(frame(before), frame(after), spark.createDataFrame(refs, REFS)).collect()}
        old, new = answers(spark, before, refs), answers(spark, after, refs)
        assert {k for k in old if old[k] != new[k]} <= stale and 2 not in stale
