import random

from loomgraph.operators import traverse as T

EDGES = "src long, dst long, edge_class int, ord long"


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, 0, k) for k, (a, b) in enumerate(pairs)], EDGES)


def test_impact_order_depth_and_cycles(spark):
    found, truncated = T.impact(edges(spark, [(2, 1), (3, 1), (4, 3), (1, 4), (5, 4), (6, 5)]), 1, depth=3)
    assert [(r["node"], r["distance"]) for r in found.orderBy("place").collect()] == [(2, 1), (3, 1), (4, 2), (5, 3)] and not truncated


def test_impact_cap(spark):
    found, truncated = T.impact(edges(spark, [(k, 1) for k in range(2, 302)]), 1)
    assert found.count() == 200 and truncated
    found, truncated = T.impact(edges(spark, [(k, 1) for k in range(2, 202)]), 1)
    assert found.count() == 200 and not truncated


def test_reach_is_shortest(spark):
    origin = spark.createDataFrame([(1,)], "origin long")
    pairs = edges(spark, [(2, 1), (3, 2), (3, 1), (4, 3), (1, 4), (5, 4)])
    assert {(r["node"], r["distance"]) for r in T.reach(pairs, origin, 2).collect()} == {(2, 1), (3, 1), (4, 2)}
    assert {(r["node"], r["distance"]) for r in T.reach(pairs, origin, 1, "both").collect()} == {(2, 1), (3, 1), (4, 1)}


def test_call_tree_keeps_repeats(spark):
    roots = spark.createDataFrame([(1,)], "root long")
    tree = T.call_tree(edges(spark, [(1, 2), (1, 3), (2, 4), (3, 4), (4, 1)]), roots, depth=3)
    assert [(r["path"], r["distance"]) for r in tree.orderBy("place").collect()] == [("1", 0), ("1/2", 1), ("1/3", 1), ("1/2/4", 2), ("1/3/4", 2), ("1/2/4/1", 3), ("1/3/4/1", 3)]


def test_evidence_paths(spark):
    e = spark.createDataFrame([(2, 1, 1), (3, 1, 4), (3, 2, 1), (1, 3, 1), (4, 3, 2)], "src long, dst long, category int")
    got = {(r["path"], r["weakest"]) for r in T.evidence_paths(e, spark.createDataFrame([(1,)], "origin long")).collect()}
    assert got == {("1,2", 1), ("1,3", 4), ("1,2,3", 1), ("1,3,4", 4)}


def test_call_tree_orders_by_ids(spark):
    roots = spark.createDataFrame([(1,)], "root long")
    assert [r["node"] for r in T.call_tree(edges(spark, [(1, 100), (1, 9), (1, 10)]), roots, cap=3).orderBy("place").collect()] == [1, 9, 10]


def test_impacts_of_many_origins_equal_impact_of_each(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(rng.randint(1, 30), rng.choice([1, 2, 3, rng.randint(1, 30)]), rng.randint(1, 4), rng.randint(0, 1), k, rng.choice(["call", "type"])) for k in range(300)]
    e = spark.createDataFrame(rows, "src long, dst long, category int, edge_class int, ord long, kind string").cache()
    origins = spark.createDataFrame([(k,) for k in range(1, 34)], "origin long")
    for shares, floor, kind, cap in ((100_000, 3, None, 12), (7, 1, "call", 5)):
        monkeypatch.setattr(T, "SHARE_ROWS", shares)
        found, state = T.impacts(e, origins, depth=3, cap=cap, floor=floor, kind=kind)
        got = {}
        for r in found.orderBy("origin", "place").collect():
            got.setdefault(r["origin"], []).append((r["node"], r["distance"], r["place"], r["fallback"]))
        status = {r["origin"]: (r["visited"], r["truncated"], r["fallback"]) for r in state.collect()}
        own = [r for r in rows if kind is None or r[5] == kind]
        for o in range(1, 34):
            plain, truncated = plain_impact([r for r in own if r[2] <= floor], o, 3, cap)
            fallback = not plain
            if fallback:
                plain, truncated = plain_impact(own, o, 3, cap)
            assert got.get(o, []) == [(n, d, k, fallback) for k, (n, d) in enumerate(plain)], o
            assert status[o] == (len(plain), truncated, fallback and bool(plain))
    one, truncated = T.impact(e.where("category <= 3"), 2, cap=12)
    many, state = T.impacts(e, origins.where("origin = 2"), cap=12)
    assert [tuple(r) for r in one.orderBy("place").collect()] == [tuple(r) for r in many.orderBy("place").select("node", "distance", "place").collect()] and truncated == state.first()["truncated"]


def plain_impact(rows, origin, depth, cap):
    """Breadth first, one queue."""
    seen, found, queue = {origin}, [], [(origin, 0)]
    while queue:
        at, distance = queue.pop(0)
        if distance == depth:
            continue
        for _, _, src in sorted((r[3], r[4], r[0]) for r in rows if r[1] == at):
            if src in seen:
                continue
            if len(found) == cap:
                return found, True
            seen.add(src)
            found.append((src, distance + 1))
            queue.append((src, distance + 1))
    return found, False


def test_impacts_fall_back_to_names(spark):
    e = spark.createDataFrame([(2, 1, 1, 0, 1, "call")], "src long, dst long, category int, edge_class int, ord long, kind string")
    names = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "c")], "node long, name string")
    named = spark.createDataFrame([("c", 1, 0, 5, "call"), ("b", 4, 0, 6, "call"), ("b", 2, 0, 7, "call")], "name string, src long, edge_class int, ord long, kind string")
    found, state = T.impacts(e, spark.createDataFrame([(1,), (2,), (3,)], "origin long"), names=names, named=named)
    assert {(r["origin"], r["node"], r["distance"], r["fallback"]) for r in found.collect()} == {(1, 2, 1, False), (2, 4, 1, True), (2, 1, 2, True), (3, 1, 1, True), (3, 2, 2, True), (3, 4, 3, True)}
    assert {(r["origin"], r["visited"], r["fallback"]) for r in state.collect()} == {(1, 1, False), (2, 2, True), (3, 3, True)}
