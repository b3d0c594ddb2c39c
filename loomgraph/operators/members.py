"""References that name a member of a type: ``<T>::m``, ``<T as Trait>::m``, ``path::T::m``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.cut import cut
from loomgraph.operators.reexports import trait_defaults

_BRACKETED = r"^<(dyn )?((?:[\w-]+::)*)([A-Z]\w*)(?:(?:::)?<.*>)?(?: as (?:[\w-]+::)*(\w+)(?:<.*>)?)?>::([a-z_]\w*)$"
_PLAIN = r"^((?:[\w-]+::)*)([A-Z]\w*)(?:(?:::)?<.*>)?::([a-z_]\w*)$"
_IMPL = r"^<(?:[\w-]+::)*(\w+)(?:<.*>)? as (?:[\w-]+::)*(\w+)(?:<.*>)?>$"


def parsed(qualified: Column) -> Column:
    """The path before the type, the type, trait (null if none), member, whether in brackets, whether a trait object; null for what names no member."""
    part = lambda pattern, k: F.regexp_extract(qualified, pattern, k)
    some = lambda c: F.when(c != "", c)
    path = lambda c: F.regexp_replace(c, "::$", "")
    row = lambda p, t, trait, m, bracketed, dyn: F.struct(p.alias("path"), t.alias("type"), trait.alias("trait"), m.alias("member"), bracketed.alias("bracketed"), dyn.alias("dyn"))
    return F.when(
        qualified.rlike(_BRACKETED), row(path(part(_BRACKETED, 2)), part(_BRACKETED, 3), some(part(_BRACKETED, 4)), part(_BRACKETED, 5), F.lit(True), part(_BRACKETED, 1) != "")
    ).when(qualified.rlike(_PLAIN) & ~qualified.startswith("<"), row(path(part(_PLAIN, 1)), part(_PLAIN, 2), F.lit(None).cast("string"), part(_PLAIN, 3), F.lit(False), F.lit(False)))


def absolute(path: Column, module: Column) -> Column:
    """A path as the file of ``module`` spells it, from the crate's root: crate, self and super are followed, ``-`` is ``_``."""
    own = F.split(F.regexp_replace(module, "/|\\.", "::"), "::")
    normal = F.regexp_replace(F.regexp_replace(path, "\\.", "::"), "-", "_")
    supers = (F.length(F.regexp_extract(normal, "^((?:super(?:::|$))*)", 1)) + 2) / 7
    rest = F.regexp_replace(normal, "^(?:super(?:::|$))*(?:self(?:::|$))?", "")
    base = F.slice(own, 1, F.greatest(F.size(own) - F.floor(supers).cast("int"), F.lit(0)))
    relative = F.array_join(F.filter(F.concat(base, F.array(rest)), lambda x: x != ""), "::")
    return F.when(normal.rlike("^crate(?:::|$)"), F.regexp_replace(normal, "^crate(?:::)?", "")).when(normal.rlike("^(?:self|super)(?:::|$)"), relative).otherwise(normal)


def member_contributions(symbols: DataFrame) -> DataFrame:
    """(rung, k1, k2, id): the keys by which symbols answer such references: type and member, a type's impl blocks, the members that traits declare."""
    p = symbols.where("lang = 'rust'").withColumn("p", parsed(F.col("qualified")))
    none = F.lit(None).cast("string")
    members = p.where("kind <> 'impl' and p is not null")
    impls = p.where("kind = 'impl'").withColumn("type", F.regexp_extract("qualified", _IMPL, 1)).where("type <> ''")
    return (
        members.select(F.lit("member").alias("rung"), F.col("p.type").alias("k1"), F.col("p.member").alias("k2"), "id")
        .unionByName(members.where("not p.bracketed").select(F.lit("declared").alias("rung"), F.col("p.member").alias("k1"), none.alias("k2"), "id"))
        .unionByName(impls.select(F.lit("impl").alias("rung"), F.col("type").alias("k1"), none.alias("k2"), "id"))
    )


def resolve_members(keys: DataFrame, symbols: DataFrame, imports: DataFrame | None) -> DataFrame:
    """(key, confidence, target_id) of those keys that this rung answers, fuzzy included; other keys go on down the ladder.

    keys: key, from_file, module, lang, name, target, is_use; symbols and imports as in ``resolve``. The modules that can
    hold the type come first: those of the path before it, else of the file's imports of its name. Candidates outside
    them are never asked. Then inherent members go before those of trait impls and these before traits'
    declarations, and only then do the own file and module decide between several. Per key and set of candidates one state is kept: the
    best tier with the least and greatest id in it, which merge in any order and are one where the candidate is. A member that none has may be a trait's
    default body. Names of packages are taken as modules' first segments.
    """
    asked = keys.where("lang = 'rust' and not is_use").withColumn("p", parsed(F.col("target"))).where("p is not null and p.member = name")
    asked = cut(asked.select("key", "from_file", "module", "p")).select("key", "from_file", "module", F.col("p.path").alias("path"), F.col("p.type").alias("type"), F.col("p.trait").alias("trait"), F.col("p.member").alias("member"), F.col("p.bracketed").alias("bracketed"), F.col("p.dyn").alias("dyn"))
    spelled = asked.where("path <> ''").select("key", absolute(F.col("path"), F.col("module")).alias("scope"))
    if imports is not None:
        named = imports.where("target_symbol is not null").select(F.col("from_file").alias("i_file"), F.col("target_symbol").alias("i_type"), "target_path")
        spelled = spelled.unionByName(asked.where("path = ''").join(named, (F.col("from_file") == F.col("i_file")) & (F.col("type") == F.col("i_type"))).select("key", absolute(F.col("target_path"), F.col("module")).alias("scope")))
    scopes = spelled.where("scope <> ''").groupBy("key").agg(F.collect_set("scope").alias("scopes"))  # as many as the file has imports of one name
    asked = cut(asked.join(scopes, "key", "left").withColumn("scoped", F.col("scopes").isNotNull()))

    own = cut(symbols.where("lang = 'rust' and kind <> 'impl'").select("id", "file_path", "module", parsed(F.col("qualified")).alias("p")).where("p is not null"))
    tier = F.when(F.col("p.bracketed") & F.col("p.trait").isNull(), 1).when(F.col("p.bracketed"), 2).otherwise(3)
    place = F.regexp_replace(F.concat_ws("::", F.lit(""), F.regexp_replace("module", "/|\\.", "::"), F.when(F.col("p.path") != "", F.col("p.path")), F.lit("")), "-", "_")
    offered = own.select(F.col("p.type").alias("type"), F.col("p.member").alias("member"), tier.alias("tier"), F.col("p.trait").alias("c_trait"), F.col("p.dyn").alias("c_dyn"), F.col("file_path").alias("file"), F.col("module").alias("c_module"), place.alias("place"), "id")
    offered = offered.groupBy("type", "member", "tier", "c_trait", "c_dyn", "file", "c_module", "place").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    met = asked.join(offered, ["type", "member"])
    met = met.where(~F.col("dyn") | (F.col("tier") == 3) | F.col("c_dyn")).where(F.col("trait").isNull() | (F.col("tier") == 3) | F.col("trait").eqNullSafe(F.col("c_trait")))
    tail = lambda c: F.element_at(F.split(c, "::|/"), -1)
    inside = F.col("scoped") & F.exists("scopes", lambda s: F.col("place").contains(F.concat(F.lit("::"), s, F.lit("::"))))
    met = met.withColumns({"inside": F.coalesce(inside, F.lit(False)), "here": F.col("file") == F.col("from_file"), "near": tail(F.col("c_module")) == tail(F.col("module"))})
    met = cut(met.select("key", "tier", "low", "high", "file", "inside", "here", "near"))

    def state(name: str, when: Column) -> list[Column]:
        return [F.min(F.when(when, F.struct("tier", "low"))).alias(f"{name}_low"), F.min(F.when(when, F.struct("tier", (-F.col("high")).alias("high")))).alias(f"{name}_high")]

    sets = {"all": F.lit(True), "in": F.col("inside"), "in_here": F.col("inside") & F.col("here"), "in_near": F.col("inside") & F.col("near"), "here": F.col("here"), "near": F.col("near")}
    states = cut(met.groupBy("key").agg(*(c for n, w in sets.items() for c in state(n, w)), F.min("low").alias("least"), F.max("high").alias("most"), F.min("file").alias("f0"), F.max("file").alias("f1")))
    one = lambda n: F.col(f"{n}_low.low") == -F.col(f"{n}_high.high")
    there = lambda n: F.col(f"{n}_low").isNotNull()
    answer = lambda confidence, n: F.struct(F.lit(confidence).alias("confidence"), F.col(f"{n}_low.low").cast("long").alias("target_id"))
    same_tier = lambda n: F.col(f"{n}_low.tier") == F.col("in_low.tier")
    sole = F.col("least") == F.col("most")
    scoped = F.when(one("in") & sole, answer("exact", "in")).when(one("in"), answer("import_resolved", "in")).when(one("in_here") & same_tier("in_here"), answer("exact", "in_here")).when(one("in_near") & same_tier("in_near"), answer("same_module", "in_near"))
    free = F.when(sole, answer("exact", "all")).when(there("here"), F.when(one("here"), answer("exact", "here"))).when(there("near"), F.when(one("near"), answer("same_module", "near"))).when(one("all") & (F.col("f0") == F.col("f1")), answer("exact", "all"))
    found = asked.join(states, "key", "left").withColumn("answer", F.when(F.col("scoped"), scoped).otherwise(free))

    blocks = symbols.where("lang = 'rust' and kind = 'impl'").select(F.regexp_extract("qualified", _IMPL, 1).alias("type"), F.regexp_extract("qualified", _IMPL, 2).alias("trait"), F.col("file_path").alias("file")).where("type <> ''")
    declared = own.where("not p.bracketed").select("id", F.col("p.type").alias("trait"), F.col("p.member").alias("member"))
    silent = found.where("answer is null and not dyn").select(F.col("key").alias("ref_id"), "type", "member", "trait", "scoped")
    defaults = trait_defaults(silent, blocks, declared).select(F.col("ref_id").alias("key"), F.col("target_id").alias("default_id"))
    found = found.join(defaults, "key", "left")
    goes_on = F.col("bracketed") & ~F.col("scoped") & F.col("least").isNull()  # a receiver's type may have it from outside the index
    out = found.where(F.col("answer").isNotNull() | F.col("default_id").isNotNull() | ~goes_on)
    confidence = F.coalesce("answer.confidence", F.when(F.col("default_id").isNotNull(), "exact"), F.lit("fuzzy_name"))
    return out.select("key", confidence.alias("confidence"), F.coalesce("answer.target_id", "default_id").alias("target_id"))
