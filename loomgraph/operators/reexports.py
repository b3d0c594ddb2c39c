"""Names that reach a module through re-exports, and members of types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.cut import cut

#: Paths after which a reference counts as ambiguous: aliases may spell ever longer ones.
PATHS = 64
#: Where a member of a type is defined, best first.
TIERS = {"inherent": 1, "trait_impl": 2, "trait_decl": 3}


def reexport_closure(reexports: DataFrame, definitions: DataFrame) -> DataFrame:
    """(module, name, symbol_id, answer) of every name that a module exposes and doesn't define: hit if one symbol is reached, ambiguous if several.

    reexports: module, source_module, name (in the source; null: all), and alias (what it is called here; null or no such column: its own name).
    definitions: module, name, symbol_id. A module's explicit re-export of a name goes before what it takes over as a
    whole. Rounds go on until nothing new is reached; exposed names are among those of the tables, so that happens, cycles or not.
    """
    reached = cut(definitions.select("module", "name", "symbol_id").distinct())
    alias = F.coalesce(F.col("alias"), F.col("name")) if "alias" in reexports.columns else F.col("name")
    steps = cut(reexports.select(F.col("module").alias("to"), F.col("source_module").alias("source"), F.col("name").alias("only"), alias.alias("called")))
    explicit, whole = steps.where("only is not null"), steps.where("only is null").select("to", "source")
    taken = explicit.select(F.col("to").alias("t_to"), F.col("called").alias("t_name")).distinct()
    fresh = reached
    while not fresh.isEmpty():
        named = fresh.join(explicit, (F.col("module") == F.col("source")) & (F.col("only") == F.col("name"))).select(F.col("to").alias("module"), F.col("called").alias("name"), "symbol_id")
        all_of = fresh.join(whole, F.col("module") == F.col("source")).join(taken, (F.col("to") == F.col("t_to")) & (F.col("name") == F.col("t_name")), "left_anti")
        met = named.unionByName(all_of.select(F.col("to").alias("module"), "name", "symbol_id")).distinct()
        fresh = cut(met.join(reached, ["module", "name", "symbol_id"], "left_anti"))
        reached = cut(reached.unionByName(fresh))
    direct = definitions.select("module", "name").distinct()
    answers = reached.join(direct, ["module", "name"], "left_anti").groupBy("module", "name").agg(F.countDistinct("symbol_id").alias("n"), F.min("symbol_id").alias("symbol_id"))
    return answers.select("module", "name", F.when(F.col("n") == 1, F.col("symbol_id")).alias("symbol_id"), F.when(F.col("n") == 1, "hit").otherwise("ambiguous").alias("answer"))


def follow_reexports(paths: DataFrame, reexports: DataFrame, definitions: DataFrame, limit: int = PATHS) -> DataFrame:
    """(path, symbol_id, answer) of spelled paths (path, ``::`` between segments) that lead through re-exports to one symbol (hit) or may lead to several (ambiguous); others have no row.

    reexports: module, target (a path), alias (a name; null: all of the target), source (the name at
    the target; null: the alias; empty: the target itself). definitions: path, symbol_id; a path that several
    symbols have leads nowhere. Each round rewrites every new path by each of its prefixes that is a module with
    re-exports: prefixes meet modules by equality. Where a module names the next segment, what it takes over as a whole is left out. A path is
    visited once per start, so cycles end; a start that visits more than ``limit`` paths is ambiguous.
    """
    ends = definitions.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("symbol_id").alias("symbol_id")).where("n = 1").select(F.col("path").alias("e_path"), "symbol_id")
    joined = lambda *parts: F.array_join(F.filter(F.array(*parts), lambda x: x != ""), "::")
    source = F.coalesce(F.col("source"), F.col("alias"))
    steps = cut(reexports.select(F.col("module").alias("m"), F.col("alias").alias("called"), F.when(F.col("alias").isNull(), F.col("target")).otherwise(joined(F.col("target"), source)).alias("leads")))
    explicit, whole = steps.where("called is not null"), steps.where("called is null and m <> ''").select("m", "leads")
    named = explicit.select(F.col("m").alias("x_m"), F.col("called").alias("x_called")).distinct()
    visited = cut(paths.where(F.col("path").contains("::")).select(F.col("path").alias("start"), "path").distinct())
    fresh, over = visited, visited.select("start").limit(0)
    while not fresh.isEmpty():
        parts = F.split("path", "::")
        cuts = fresh.select("start", parts.alias("ps"), F.explode(F.sequence(F.lit(0), F.size(parts) - 1)).alias("k"))
        rest = lambda k: F.array_join(F.slice("ps", k + 1, F.greatest(F.size("ps") - k, F.lit(0))), "::")
        at = cut(cuts.select("start", F.array_join(F.slice("ps", 1, F.col("k")), "::").alias("module"), F.get("ps", F.col("k")).alias("next"), rest(F.col("k")).alias("from_next"), rest(F.col("k") + 1).alias("after")))
        by_name = at.join(explicit, (F.col("module") == F.col("m")) & (F.col("next") == F.col("called"))).select("start", joined(F.col("leads"), F.col("after")).alias("path"))
        as_whole = at.join(named, (F.col("module") == F.col("x_m")) & (F.col("next") == F.col("x_called")), "left_anti").join(whole, F.col("module") == F.col("m"))
        met = by_name.unionByName(as_whole.select("start", joined(F.col("leads"), F.col("from_next")).alias("path"))).distinct()
        fresh = met.join(visited, ["start", "path"], "left_anti")
        visited = cut(visited.unionByName(fresh))
        over = cut(visited.groupBy("start").count().where(F.col("count") > limit).select("start"))
        fresh = cut(fresh.join(over, "start", "left_anti"))
    found = visited.where("path <> start").join(ends, F.col("path") == F.col("e_path")).groupBy("start").agg(F.countDistinct("symbol_id").alias("n"), F.min("symbol_id").alias("symbol_id"))
    hit = (F.col("n") == 1) & F.col("more").isNull()
    out = found.join(over.withColumn("more", F.lit(True)), "start", "full_outer")
    return out.select(F.col("start").alias("path"), F.when(hit, F.col("symbol_id")).alias("symbol_id"), F.when(hit, "hit").otherwise("ambiguous").alias("answer"))


def trait_defaults(refs: DataFrame, impls: DataFrame, declarations: DataFrame) -> DataFrame:
    """(ref_id, target_id) of references to ``Type::member`` that a trait's default body answers: the one declaration of the member among the traits that the type implements.

    refs: ref_id, type, member, trait (null: any), scoped (the type is named by a path or an import); impls: type, trait, file;
    declarations: id, trait, member. Without a scope the type must be implemented in one file only. Silent references have no row.
    Types and members are asked once each, and traits and files are counts, so a type with many impls makes no list.
    """
    asked = refs.select("type", "member", "trait", "scoped").distinct()
    wanted = asked.select(F.col("type"), "member", F.col("trait").alias("only"), "scoped")
    of_type = impls.select("type", "trait", "file").distinct()
    met = wanted.join(of_type, "type").where(F.col("only").isNull() | (F.col("only") == F.col("trait")))
    files = met.groupBy("type", "member", "only", "scoped").agg(F.countDistinct("file").alias("files"))
    found = met.select("type", "member", "only", "scoped", "trait").distinct().join(declarations.select("id", "trait", "member"), ["trait", "member"])
    found = found.groupBy("type", "member", "only", "scoped").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("target_id")).where("n = 1")
    keys = ["type", "member", "scoped"]
    same = lambda a, b: (a.type == b.type) & (a.member == b.member) & (a.scoped == b.scoped)
    sure = found.join(files, same(found, files) & found.only.eqNullSafe(files.only)).where(found.scoped | (F.col("files") == 1)).select(*(found[k] for k in keys), found.only, "target_id")
    return refs.join(sure, same(refs, sure) & refs.trait.eqNullSafe(sure.only)).select("ref_id", "target_id")


def type_members(refs: DataFrame, members: DataFrame) -> DataFrame:
    """(ref_id, target_id, confidence) of references to ``Type::name``: the best tier decides, one candidate in the own file is exact, one of all is import_resolved, else fuzzy.

    refs: ref_id, file, type, name; members: id, file, type, name, tier (a word of TIERS).
    """
    rank = F.lit(None).cast("int")
    for name, place in TIERS.items():
        rank = F.when(F.col("tier") == name, place).otherwise(rank)
    placed = members.select("id", F.col("file").alias("m_file"), "type", "name", F.coalesce(rank, F.lit(0)).alias("place"))
    # a row per type, name, place and file, however many members and references share a name
    files = placed.groupBy("type", "name", "place", "m_file").agg(F.count(F.lit(1)).alias("n_file"), F.min("id").alias("own"))
    best = files.groupBy("type", "name").agg(F.min("place").alias("place"))
    files = cut(files.join(best, ["type", "name", "place"], "left_semi"))
    n = files.groupBy("type", "name").agg(F.sum("n_file").alias("n"), F.min("own").alias("one"))
    own = files.select("type", "name", F.col("m_file").alias("file"), "n_file", "own")
    met = refs.select("ref_id", "file", "type", "name").join(n, ["type", "name"], "left").join(own, ["type", "name", "file"], "left")
    target = F.when(F.col("n_file") == 1, F.col("own")).when(F.col("n") == 1, F.col("one"))
    confidence = F.when(F.col("n_file") == 1, "exact").when(F.col("n") == 1, "import_resolved").otherwise("fuzzy_name")
    return met.select("ref_id", target.alias("target_id"), F.coalesce(F.when(F.col("n").isNotNull(), confidence), F.lit("fuzzy_name")).alias("confidence"))
