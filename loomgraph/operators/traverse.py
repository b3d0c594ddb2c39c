"""Bounded traversals of the edge table, one frontier join per level."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.cut import cut

NODE_CAP = 200
#: Edges of one node that are ranked in one task.
SHARE_ROWS = 100_000


def reach(edges: DataFrame, origins: DataFrame, depth: int = 3, direction: str = "in") -> DataFrame:
    """(origin, node, distance): shortest distances up to ``depth`` from every origin, itself left out; breadth first, each node once per origin.

    edges: src, dst. Batch form: all origins at once and no cap on nodes, so the
    result doesn't depend on discovery order.
    """
    step = {"in": edges.select(F.col("dst").alias("at"), F.col("src").alias("next")), "out": edges.select(F.col("src").alias("at"), F.col("dst").alias("next"))}
    step["both"] = step["in"].unionByName(step["out"])
    moves = step[direction].where("at <> next").distinct()
    seen = origins.select("origin", F.col("origin").alias("node"), F.lit(0).cast("long").alias("distance"))
    frontier = seen
    for level in range(1, depth + 1):
        met = frontier.join(moves, frontier.node == moves.at).select("origin", F.col("next").alias("node")).distinct()
        frontier = met.join(seen.select("origin", "node"), ["origin", "node"], "left_anti").withColumn("distance", F.lit(level).cast("long"))
        seen = seen.unionByName(frontier)
    return seen.where("distance > 0")


def impact(edges: DataFrame, origin: int, depth: int = 3, cap: int = NODE_CAP) -> tuple[DataFrame, bool]:
    """One origin's neighbours in discovery order, cut at ``cap``, and whether more were met.

    edges: src, dst, edge_class, ord. Order: by the parent's place, then edge class,
    then ord. The frontier never exceeds ``cap`` rows, so each level joins a tiny side.
    """
    spark = edges.sparkSession
    found: list[tuple[int, int, int]] = []
    seen, frontier, truncated = {origin}, [(origin, 0)], False
    for level in range(1, (depth or 3) + 1):
        if not frontier or truncated:
            break
        parents = spark.createDataFrame(frontier, "at long, place int")
        met = edges.join(F.broadcast(parents), edges.dst == parents["at"])  # at most cap rows
        first = met.groupBy("src").agg(F.min(F.struct("place", "edge_class", "ord")).alias("order"))
        rows = first.orderBy("order", "src").limit(cap + len(seen) + 1).collect()
        nexts = []
        for r in rows:
            if r["src"] in seen:
                continue
            if len(found) == cap:
                truncated = True
                break
            seen.add(r["src"])
            found.append((r["src"], level, len(found)))
            nexts.append((r["src"], len(nexts)))
        frontier = nexts
    return spark.createDataFrame(found, "node long, distance int, place int"), truncated


def adjacency(edges: DataFrame, direction: str, cap: int) -> DataFrame:
    """(at, next, edge_class, ord, kind): each node's neighbours in order, no more than a traversal under ``cap`` can use.

    Of a node's neighbours at most cap + 1 are known (the origin and what was found) and
    cap + 1 new ones show that there are too many, so the first 2 * cap + 2 are enough. A hub's edges are ranked in shares first.
    """
    columns = ["edge_class", "ord", "kind"]
    inward, outward = edges.select(F.col("dst").alias("at"), F.col("src").alias("next"), *columns), edges.select(F.col("src").alias("at"), F.col("dst").alias("next"), *columns)
    # what a node calls comes after what calls it
    both = inward.unionByName(outward.withColumn("edge_class", F.col("edge_class") + 1_000_000))
    moves = {"in": inward, "out": outward, "both": both}[direction].where("at <> next")
    moves = cut(moves.groupBy("at", "next").agg(F.min(F.struct(*columns)).alias("first")).select("at", "next", "first.*"))
    largest = moves.groupBy("at").count().agg(F.max("count")).first()[0] or 0
    shares = -(-largest // SHARE_ROWS)
    for share in ([F.pmod(F.xxhash64("next"), F.lit(shares))] if shares > 1 else [], []):
        place = Window.partitionBy("at", *share).orderBy("edge_class", "ord", "next")
        moves = moves.withColumn("place", F.row_number().over(place)).where(F.col("place") <= 2 * cap + 2).drop("place")
    return cut(moves)


def impacts(
    edges: DataFrame, origins: DataFrame, depth: int = 3, cap: int = NODE_CAP, direction: str = "in", floor: int = 3, kind: str | None = None, names: DataFrame | None = None, named: DataFrame | None = None, fallback: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Every origin's neighbours as ``impact`` finds them for one, at most ``cap`` each.

    edges: src, dst, category (1 the strongest; those up to ``floor`` count), edge_class, ord (of any type), kind (with ``kind``
    only those of it). Returns (origin, node, distance, place, edge_kind, fallback) and, for every
    origin, (origin, visited, truncated, fallback). An origin that finds nothing under a floor below 4 is asked
    again with all edges and, where ``names`` (node, name) and ``named`` (name, src, edge_class, ord, kind) are given, with
    the unresolved references of a node's name; those meet nodes by the name, so no pair of a
    reference and a like-named symbol is formed beyond the cap. Without ``fallback`` none is asked again.
    """
    kinds = edges if kind is None else edges.where(F.col("kind") == kind)
    asked = cut(origins.select("origin").distinct())
    found, state = _impacts(adjacency(kinds.where(F.col("category") <= floor), direction, cap), asked, depth, cap, None)
    if floor < 4 and fallback:
        silent = cut(state.where("visited = 0").select("origin"))
        by_name = None
        if names is not None and named is not None and direction != "out":
            own = named if kind is None else named.where(F.col("kind") == kind)
            lists = adjacency(own.select(F.col("name").alias("dst"), F.col("src").cast("string").alias("src"), "edge_class", "ord", "kind"), "in", cap)
            by_name = (names, lists.withColumn("next", F.col("next").cast("long")))
        again, more = _impacts(adjacency(kinds, direction, cap), silent, depth, cap, by_name)
        found = found.withColumn("fallback", F.lit(False)).unionByName(again.withColumn("fallback", F.lit(True)))
        fell = more.where("visited > 0").withColumn("fallback", F.lit(True))
        state = state.join(fell.select("origin"), "origin", "left_anti").withColumn("fallback", F.lit(False)).unionByName(fell)
    else:
        found, state = found.withColumn("fallback", F.lit(False)), state.withColumn("fallback", F.lit(False))
    return found, state


def _impacts(moves: DataFrame, origins: DataFrame, depth: int, cap: int, by_name: tuple[DataFrame, DataFrame] | None) -> tuple[DataFrame, DataFrame]:
    """One run over prepared lists: a level joins the frontier with them, and keeps per origin the first new nodes in discovery order."""
    nobody = F.lit(None).cast("string")
    seen = origins.select("origin", F.col("origin").alias("node"), F.lit(0).alias("distance"), F.lit(0).cast("long").alias("place"), nobody.alias("edge_kind"))
    frontier = seen.select("origin", "node", "place", F.lit(0).cast("long").alias("taken"))
    over = None
    for level in range(1, (depth or 3) + 1):
        met = frontier.join(moves, frontier.node == moves["at"]).select("origin", "next", "taken", F.struct("place", "edge_class", "ord", "next", "kind").alias("way"))
        if by_name is not None:
            names, lists = by_name
            called = frontier.join(names.select(F.col("node").alias("n_node"), "name"), F.col("node") == F.col("n_node")).join(lists, F.col("name") == lists["at"])
            met = met.unionByName(called.where("next <> node").select("origin", "next", "taken", F.struct("place", "edge_class", "ord", "next", "kind").alias("way")))
        known = seen.select("origin", F.col("node").alias("next"), F.lit(True).alias("old"), F.lit(None).cast("long").alias("taken"))
        both = met.withColumn("old", F.lit(False)).unionByName(known, allowMissingColumns=True)
        fresh = both.groupBy("origin", "next").agg(F.max("old").alias("old"), F.max("taken").alias("taken"), F.min("way").alias("way")).where("not old")
        ranked = fresh.withColumn("nth", F.row_number().over(Window.partitionBy("origin").orderBy("way")).cast("long"))
        step = cut(ranked.where(F.col("nth") <= cap - F.col("taken") + 1))
        more = step.where(F.col("taken") + F.col("nth") > cap).select("origin")
        over = more if over is None else over.unionByName(more)
        kept = step.where(F.col("taken") + F.col("nth") <= cap)
        rows = kept.select("origin", F.col("next").alias("node"), F.lit(level).alias("distance"), (F.col("taken") + F.col("nth")).alias("place"), F.col("way.kind").alias("edge_kind"))
        seen = seen.unionByName(rows)
        taken = kept.groupBy("origin").agg(F.max(F.col("taken") + F.col("nth")).alias("taken"))
        frontier = rows.join(taken, "origin").join(more, "origin", "left_anti").select("origin", "node", "place", "taken")
        if step.isEmpty():
            break
    found = seen.where("distance > 0").withColumn("place", F.col("place") - 1)
    visited = found.groupBy("origin").agg(F.count(F.lit(1)).alias("visited"))
    state = origins.join(visited, "origin", "left").join(over.distinct().withColumn("truncated", F.lit(True)), "origin", "left")
    return found, state.select("origin", F.coalesce("visited", F.lit(0)).cast("long").alias("visited"), F.coalesce("truncated", F.lit(False)).alias("truncated"))


def call_tree(edges: DataFrame, roots: DataFrame, depth: int = 5, cap: int = NODE_CAP) -> DataFrame:
    """(root, path, node, distance): the call tree under each root, repeats kept, its first ``cap`` nodes breadth first.

    A path is the nodes' ids from the root, slash-joined; siblings are in the order of ids (numbers as numbers).
    """
    out = roots.select("root", F.array("root").alias("ids"), F.col("root").alias("node"), F.lit(0).cast("long").alias("distance"))
    level = out
    for k in range(1, depth + 1):
        children = level.join(edges.select("src", "dst").distinct(), level.node == edges.src)
        children = children.select("root", F.concat("ids", F.array("dst")).alias("ids"), F.col("dst").alias("node"), F.lit(k).cast("long").alias("distance"))
        place = Window.partitionBy("root").orderBy("ids")  # a root's level never keeps more than cap nodes
        level = children.withColumn("place", F.row_number().over(place)).where(F.col("place") <= cap).drop("place")
        out = out.unionByName(level)
    place = Window.partitionBy("root").orderBy("distance", "ids")
    out = out.withColumn("place", F.row_number().over(place).cast("long")).where(F.col("place") <= cap)
    return out.select("root", F.array_join(F.transform("ids", lambda n: n.cast("string")), "/").alias("path"), "node", "distance", "place")


def evidence_paths(edges: DataFrame, origins: DataFrame, depth: int = 3) -> DataFrame:
    """(origin, node, distance, path, weakest): every inbound edge ends a path, each node is expanded once per origin, cycles are cut.

    edges: src, dst, category (1 the strongest). path: node ids from the origin, comma-joined.
    """
    start = origins.select("origin", F.col("origin").alias("node"), F.array(F.col("origin")).alias("nodes"), F.lit(0).alias("weakest"))
    e = edges.groupBy("src", "dst").agg(F.min("category").alias("category"))
    out, frontier, expanded = None, start, start.select("origin", "node")
    for level in range(1, depth + 1):
        met = frontier.join(e, frontier.node == e.dst).where(~F.array_contains("nodes", F.col("src")))
        paths = met.select("origin", F.col("src").alias("node"), F.concat("nodes", F.array("src")).alias("nodes"), F.greatest("weakest", "category").alias("weakest"), F.lit(level).cast("long").alias("distance"))
        out = paths if out is None else out.unionByName(paths)
        fresh = paths.join(expanded, ["origin", "node"], "left_anti")
        frontier = fresh.groupBy("origin", "node").agg(F.min(F.struct("nodes", "weakest")).alias("p")).select("origin", "node", "p.nodes", "p.weakest")
        expanded = expanded.unionByName(frontier.select("origin", "node"))
    return out.select("origin", "node", "distance", F.array_join(F.transform("nodes", lambda n: n.cast("string")), ",").alias("path"), F.col("weakest").cast("long").alias("weakest"))
