"""Two snapshots compared symbol by symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.cut import cut


#: Per cent of the larger file's bytes that a rename or copy shares.
SIMILAR = 50


def line_elements(files: DataFrame) -> DataFrame:
    """(id, key, weight, total) of files (id, text): a row per line, told apart by a hash of the line and how often it came before; weights are bytes with the line feed."""
    lines = files.select("id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"), (F.length("text") - F.length(F.translate("text", "\n", ""))).alias("last"), F.octet_length("text").cast("long").alias("total"))
    weighed = lines.select("id", "at", F.xxhash64("line", F.col("at") < F.col("last")).alias("hash"), (F.octet_length("line") + (F.col("at") < F.col("last")).cast("int")).alias("weight"), "total").where("weight > 0")
    nth = F.row_number().over(Window.partitionBy("id", "hash").orderBy("at"))
    return weighed.withColumn("key", F.xxhash64("hash", nth)).select("id", "key", F.col("weight").cast("long").alias("weight"), "total")


def similar_files(sources: DataFrame, targets: DataFrame, least: int = SIMILAR) -> DataFrame:
    """(source, target, score): all pairs of files (id, text) whose common lines have ``least`` per cent or more of the larger one's bytes; the score is floored.

    Lines stand in one order, rare ones first. What a pair shares weighs too much to lie in the tail of
    either file that has less than that share, so it shares a line of both files' heads: heads meet by line in
    an inverted index, and only those pairs are scored, exactly. Lines are known by 64-bit hashes.
    """
    a, b = cut(line_elements(sources)), cut(line_elements(targets))
    df = a.select("key").unionByName(b.select("key")).groupBy("key").agg(F.count(F.lit(1)).alias("df"))

    def heads(x: DataFrame) -> DataFrame:
        before = F.sum("weight").over(Window.partitionBy("id").orderBy("df", "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("weight")
        return x.join(df, "key").withColumn("rest", F.col("total") - before).where(100 * F.col("rest") >= least * F.col("total")).select("id", "key", "total")

    ha, hb = heads(a).select(F.col("id").alias("source"), "key", F.col("total").alias("s_total")), heads(b).select(F.col("id").alias("target"), "key", F.col("total").alias("t_total"))
    near = ha.join(hb, "key").where(100 * F.least("s_total", "t_total") >= least * F.greatest("s_total", "t_total")).select("source", "target", F.greatest("s_total", "t_total").alias("larger")).distinct()
    shared = near.join(a.select(F.col("id").alias("source"), "key", "weight"), "source").join(b.select(F.col("id").alias("target"), "key"), ["target", "key"])
    score = F.floor(100 * F.sum("weight") / F.first("larger")).cast("long")
    return shared.groupBy("source", "target").agg(score.alias("score"), F.sum("weight").alias("common"), F.first("larger").alias("larger")).where(100 * F.col("common") >= least * F.col("larger")).select("source", "target", "score")


def best_matching(pairs: DataFrame) -> DataFrame:
    """(source, target, score): pairs one to one, greedily by score, then source, then target.

    A pair that is the best of both its ends is in that matching; each round takes all such
    pairs and drops what they touch, so there are as many rounds as the longest chain of rivals.
    """
    order = F.struct((-F.col("score")).alias("s"), F.col("source").alias("a"), F.col("target").alias("b"))
    left, taken = cut(pairs.select("source", "target", "score")), None
    while not left.isEmpty():
        of_source = left.groupBy("source").agg(F.min(order).alias("best")).select("source", F.col("best.b").alias("target"))
        of_target = left.groupBy("target").agg(F.min(order).alias("best")).select(F.col("best.a").alias("source"), "target")
        mutual = cut(left.join(of_source, ["source", "target"]).join(of_target, ["source", "target"]))
        taken = mutual if taken is None else taken.unionByName(mutual)
        left = cut(left.join(mutual.select("source"), "source", "left_anti").join(mutual.select("target"), "target", "left_anti"))
    return pairs.select("source", "target", "score").limit(0) if taken is None else taken


def file_changes(base: DataFrame, head: DataFrame, copies: bool = True, unchanged_sources: bool = False, least: int = SIMILAR) -> DataFrame:
    """(status, old_path, new_path, similarity) of base and head (path, hash, and text): added, deleted, modified, renamed, copied.

    Equal contents are renames first: of one file name in path order, then of any. Where there
    are texts (null: empty), what is left is paired by ``similar_files``: deleted with added files one to one as
    renames, best scores first; then added ones with the most similar changed file (with ``unchanged_sources``:
    any file) of the base as copies. A path on both sides is modified, never split.
    """
    texts = "text" in base.columns and "text" in head.columns
    own = lambda df, p: df.select(F.col("path").alias(f"{p}_path"), F.col("hash").alias(f"{p}_hash"), (F.coalesce("text", F.lit("")) if texts else F.lit("")).alias(f"{p}_text"))
    a, b = own(base, "old"), own(head, "new")
    joined = cut(a.join(b, a.old_path == b.new_path, "full_outer"))
    row = lambda status, similarity: (F.lit(status).alias("status"), F.col("old_path"), F.col("new_path"), similarity.cast("long").alias("similarity"))
    nothing = F.lit(None)
    gone, come = joined.where("new_path is null").select("old_path", F.col("old_hash").alias("hash")), joined.where("old_path is null").select("new_path", F.col("new_hash").alias("hash"))
    out = joined.where("old_path is not null and new_path is not null and old_hash <> new_hash").select(*row("modified", nothing))
    for same_name in (True, False):
        name = lambda path: F.element_at(F.split(path, "/"), -1) if same_name else F.lit("")  # noqa: B023, E731
        ranked = lambda df, path: df.withColumn("name", name(path)).withColumn("nth", F.row_number().over(Window.partitionBy("hash", "name").orderBy(path)))  # noqa: B023, E731
        equal = cut(ranked(gone, "old_path").join(ranked(come, "new_path"), ["hash", "name", "nth"]).select(*row("renamed", F.lit(100))))
        out = out.unionByName(equal)
        gone, come = gone.join(equal, "old_path", "left_anti"), come.join(equal, "new_path", "left_anti")
    if texts:
        changed = joined.where("old_path is not null and (new_path is null or old_hash <> new_hash)" if not unchanged_sources else "old_path is not null")
        sources = changed if copies else gone.join(joined.select("old_path", "old_text"), "old_path")
        targets = come.join(joined.select("new_path", "new_text"), "new_path")
        pairs = cut(similar_files(sources.select(F.col("old_path").alias("id"), F.col("old_text").alias("text")), targets.select(F.col("new_path").alias("id"), F.col("new_text").alias("text")), least))
        named = lambda df: df.withColumnsRenamed({"source": "old_path", "target": "new_path"})
        renamed = cut(named(best_matching(pairs.join(gone.select(F.col("old_path").alias("source")), "source", "left_semi"))).select(*row("renamed", F.col("score"))))
        out = out.unionByName(renamed)
        gone, come = gone.join(renamed, "old_path", "left_anti"), come.join(renamed, "new_path", "left_anti")
        if copies:
            rest = named(pairs).join(renamed.select("new_path"), "new_path", "left_anti")
            copied = rest.groupBy("new_path").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("old_path").alias("p"))).alias("best")).select("new_path", F.col("best.p").alias("old_path"), (-F.col("best.s")).alias("score"))
            copied = cut(copied.select(*row("copied", F.col("score"))))
            out, come = out.unionByName(copied), come.join(copied, "new_path", "left_anti")
    nobody = F.lit(None).cast("string")
    deleted, added = gone.select("old_path").withColumn("new_path", nobody), come.select("new_path").withColumn("old_path", nobody)
    return out.unionByName(deleted.select(*row("deleted", nothing))).unionByName(added.select(*row("added", nothing)))


def changed_symbols(base: DataFrame, head: DataFrame, renames: DataFrame) -> DataFrame:
    """(status, old_selector, new_selector, group_key) by the pairing ladder, each rung over what earlier rungs left.

    base, head: selector, path, name, kind, parent, signature, body, hash; renames:
    old_path, new_path (renamed and copied files). Rungs: one selector on both sides; one (name, kind) in a
    renamed file pair; one of a kind that is left there; same file, kind, parent and
    body but for the name; else uncertain where (name, kind) vanishes and appears, added or removed.
    Where a rung's key has several symbols on a side, they and those of the other side are one uncertain
    group, a row per member: later rungs don't see them. A symbol of a file that was copied too is paired in the first of its new files.
    """
    side = lambda df, p: df.select(*(F.col(c).alias(f"{p}_{c}") for c in ("selector", "path", "name", "kind", "parent", "signature", "body", "hash")))
    a, b = cut(side(base, "a")), cut(side(head, "b"))  # every rung reads both
    nothing = F.lit(None).cast("string")
    row = lambda status, old, new, group: (F.lit(status).alias("status"), old.alias("old_selector"), new.alias("new_selector"), group.alias("group_key"))
    old, new = F.col("a_selector"), F.col("b_selector")
    count_a, count_b = a.groupBy("a_selector").agg(F.count(F.lit(1)).alias("n_a")), b.groupBy("b_selector").agg(F.count(F.lit(1)).alias("n_b"))
    several = count_a.join(count_b, old == new).where("n_a > 1 or n_b > 1").select(F.col("a_selector").alias("selector"))
    same = a.join(b, old == new).join(several, old == F.col("selector"), "left_anti")
    status = F.when(F.col("a_signature") != F.col("b_signature"), "signature_changed").otherwise("modified")
    parts = [
        same.where("a_hash <> b_hash").select(status.alias("status"), old.alias("old_selector"), new.alias("new_selector"), nothing.alias("group_key")),
        several.select(*row("uncertain", F.col("selector"), F.col("selector"), F.concat(F.lit("same|"), "selector"))),
    ]
    left_a = a.join(count_b, old == new, "left_anti")
    left_b = b.join(count_a, new == old, "left_anti")

    def rung(left_a: DataFrame, left_b: DataFrame, seen_a: DataFrame, keys: list[tuple[str, str]], status: str, name: str) -> tuple[DataFrame, DataFrame]:
        """Pairs of keys that are unique on both sides, uncertain groups of the others; what is left. ``seen_a``: ``left_a``, with further columns that keys may name."""
        marks = [c for c, _ in keys if c != "a_body"]
        x = seen_a.groupBy(*(c for c, _ in keys)).agg(F.count(F.lit(1)).alias("n_x"), F.min("a_selector").alias("one_x"))
        y = left_b.groupBy(*(c for _, c in keys)).agg(F.count(F.lit(1)).alias("n_y"), F.min("b_selector").alias("one_y"))
        on = [F.col(p) == F.col(q) for p, q in keys]
        text = F.concat_ws("|", F.lit(name), *(F.col(c) for c in marks), *([F.md5("a_body")] if len(marks) < len(keys) else []))
        both = cut(x.join(y, on).withColumn("group_key", text))
        pairs = both.where("n_x = 1 and n_y = 1").groupBy("one_x").agg(F.min("one_y").alias("one_y"))
        many = both.where("n_x > 1 or n_y > 1")
        key_of = lambda k: [F.col(c).alias(f"k_{i}") for i, c in enumerate(q[k] for q in keys)]
        met = lambda k: [F.col(q[k]) == F.col(f"k_{i}") for i, q in enumerate(keys)]
        members_a = seen_a.join(many.select("group_key", *key_of(0)), met(0)).join(pairs, old == F.col("one_x"), "left_anti").select("a_selector", "group_key")
        members_b = left_b.join(many.select("group_key", *key_of(1)), met(1)).join(pairs, new == F.col("one_y"), "left_anti").select("b_selector", "group_key")
        out = cut(
            pairs.select(*row(status, F.col("one_x"), F.col("one_y"), nothing))
            .unionByName(members_a.select(*row("uncertain", old, nothing, F.col("group_key"))))
            .unionByName(members_b.select(*row("uncertain", nothing, new, F.col("group_key"))))
        )
        parts.append(out)
        gone = lambda x, selector, column: cut(x.join(out.select(F.col(column).alias("gone")), F.col(selector) == F.col("gone"), "left_anti"))
        return gone(left_a, "a_selector", "old_selector"), gone(left_b, "b_selector", "new_selector")

    ren = renames.select("old_path", "new_path")
    left_a, left_b = cut(left_a), cut(left_b)
    at = lambda x: x.join(ren, F.col("a_path") == F.col("old_path"))
    left_a, left_b = rung(left_a, left_b, at(left_a), [("new_path", "b_path"), ("a_name", "b_name"), ("a_kind", "b_kind")], "moved", "moved")
    left_a, left_b = rung(left_a, left_b, at(left_a), [("new_path", "b_path"), ("a_kind", "b_kind")], "renamed", "renamed")
    left_a, left_b = rung(left_a, left_b, left_a, [("a_path", "b_path"), ("a_kind", "b_kind"), ("a_parent", "b_parent"), ("a_body", "b_body")], "renamed", "body")
    names_a, names_b = left_a.select("a_name", "a_kind").distinct(), left_b.select("b_name", "b_kind").distinct()
    crossing = names_a.join(names_b, (F.col("a_name") == F.col("b_name")) & (F.col("a_kind") == F.col("b_kind"))).select(F.col("a_name").alias("x_name"), F.col("a_kind").alias("x_kind"))
    cross_a, cross_b = (F.col("a_name") == F.col("x_name")) & (F.col("a_kind") == F.col("x_kind")), (F.col("b_name") == F.col("x_name")) & (F.col("b_kind") == F.col("x_kind"))
    crossed = F.concat_ws("|", F.lit("cross"), "x_name", "x_kind")
    parts += [
        left_a.join(crossing, cross_a).select(*row("uncertain", old, nothing, crossed)),
        left_b.join(crossing, cross_b).select(*row("uncertain", nothing, new, crossed)),
        left_a.join(crossing, cross_a, "left_anti").select(*row("removed", old, nothing, nothing)),
        left_b.join(crossing, cross_b, "left_anti").select(*row("added", nothing, new, nothing)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def out_of_scope(changes: DataFrame, symbols: DataFrame) -> DataFrame:
    """Changed paths without symbols, and why."""
    path = F.coalesce("new_path", "old_path")
    bare = changes.withColumn("path", path).join(symbols.select("path").distinct(), "path", "left_anti")
    return bare.select("path", F.when(F.col("status") == "deleted", "deleted").otherwise("no_symbols").alias("reason"))


def test_selection(edges: DataFrame) -> DataFrame:
    """(test_id, strongest, changed): of each source, its strongest category and how many targets it reaches."""
    return edges.groupBy(F.col("src").alias("test_id")).agg(F.min("category").cast("long").alias("strongest"), F.countDistinct("dst").alias("changed"))


def selection(symbols: DataFrame, wanted: DataFrame) -> DataFrame:
    """(qualified, n): how many symbols each wanted name selects; names without any are left out."""
    return symbols.join(wanted.select("qualified").distinct(), "qualified", "left_semi").groupBy("qualified").agg(F.count(F.lit(1)).alias("n"))


def callers(edges: DataFrame, limit: int = 10) -> DataFrame:
    """(symbol_id, caller_id, callers_found): of each target the first ``limit`` sources by category, then id, and how many there are."""
    from pyspark.sql import Window

    part = Window.partitionBy("dst")
    placed = edges.withColumns({"place": F.row_number().over(part.orderBy("category", "src")), "callers_found": F.count(F.lit(1)).over(part)})
    return placed.where(F.col("place") <= limit).select(F.col("dst").alias("symbol_id"), F.col("src").alias("caller_id"), "callers_found")


def filter_log(removed: DataFrame, examples: int = 5) -> DataFrame:
    """(reason, removed, examples): the count of what a filter removed, and its first examples by name."""
    from pyspark.sql import Window

    ranked = removed.withColumn("place", F.row_number().over(Window.partitionBy("reason").orderBy("item")))
    return ranked.groupBy("reason").agg(
        F.count(F.lit(1)).alias("removed"), F.concat_ws(",", F.sort_array(F.collect_list(F.when(F.col("place") <= examples, F.col("item"))))).alias("examples")
    )
