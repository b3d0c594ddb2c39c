"""Reference resolution: a ladder of rungs, the first that answers wins.

References resolve once per distinct key; uniqueness is a count and a sum of ids
per group, so a name with thousands of candidates costs each partition one row.
A rung either answers, stays silent (the next is asked) or is ambiguous (the
ladder stops and the reference stays fuzzy).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.members import absolute, member_contributions, parsed, resolve_members
from loomgraph.operators.reexports import follow_reexports

KEY = ["from_file", "module", "lang", "name", "target", "is_use", "is_runtime", "receiver_unknown"]


def with_defaults(refs: DataFrame) -> DataFrame:
    """Adds the columns that a simple extractor leaves out."""
    out = refs
    for name, default in (("target", F.lit(None).cast("string")), ("receiver_unknown", F.lit(False))):
        if name not in out.columns:
            out = out.withColumn(name, default)
    return out.withColumns({"is_use": F.col("kind") == "use", "is_runtime": F.col("kind") == "runtime_invocation"})


def resolution_keys(refs: DataFrame) -> DataFrame:
    return with_defaults(refs).select(*KEY).distinct()


def module_suffixes(module: Column) -> Column:
    """``a::b::c`` as [a::b::c, b::c, c]."""
    parts = F.split(module, "::|/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat_ws("::", F.slice(parts, k, F.size(parts) - k + 1)))


def module_tail(module: Column) -> Column:
    """The last segment. Prefixes are the module with fewer and fewer leading segments, so two modules share one just where they share this."""
    return F.element_at(F.split(module, "::|/"), -1)


def is_member(qualified: Column) -> Column:
    """Whether a qualified name is a type's or trait's member: ``<T>::m``, ``<T as Trait>::m``, ``path::T::m``."""
    return qualified.rlike(r"^(?:<.*>|(?:.*::)?[A-Z]\w*(?:<.*>)?)::[a-z_]\w*$")


def names_free_item() -> Column:
    """Whether a Rust reference can only name an item outside types and traits: a plain or module-path call, or a type."""
    target = F.col("target")
    spelled = target.isNull() | ~(target.startswith("<") | target.startswith("Self::") | is_member(target))
    return (F.col("lang") == "rust") & ~F.col("is_use") & ~F.col("receiver_unknown") & spelled


def by_name_alone() -> Column:
    """Whether the bare name may decide: no unknown receiver, and no path, or one that starts in the own crate."""
    target = F.col("target")
    return ~F.col("receiver_unknown") & (target.isNull() | names_free_item() & (~target.contains("::") | target.rlike("^(?:crate|self|super)::")))


def unique(group: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Per key the number of symbols and, summed, their ids: the id where there is one."""
    return group.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{name}_n"), F.sum("id").alias(f"{name}_sum"))


def resolve(refs: DataFrame, symbols: DataFrame, imports: DataFrame | None = None, reexports: DataFrame | None = None) -> DataFrame:
    """``refs`` with target_id and confidence.

    Rungs: runtime programs are opaque; members of types; the own file; imports; qualified paths; self:: and super:: in the own module;
    public re-exports (``reexports``: module, target, alias, source as in ``follow_reexports``); the own module; else fuzzy.

    refs: id, from_file, module, lang, name, kind (and target, receiver_unknown);
    symbols: id, file_path, module, lang, name, qualified, kind;
    imports: from_file, target_path, target_symbol (null: the whole module), as ``::`` paths.
    """
    keyed = with_defaults(refs)
    keys = resolution_keys(refs)
    targets = symbols.where("kind <> 'impl'")
    free = ~is_member(F.col("qualified"))
    count = lambda x, by, name: x.groupBy(*by).agg(F.count(F.lit(1)).alias(f"{name}_n"), F.sum("id").alias(f"{name}_sum"), F.count(F.when(free, 1)).alias(f"{name}_fn"), F.sum(F.when(free, F.col("id"))).alias(f"{name}_fsum"))
    in_file = count(targets.select(F.col("file_path").alias("from_file"), "name", "id", "qualified"), ["from_file", "name"], "file")
    in_module = count(targets.select(module_tail(F.col("module")).alias("tail"), "lang", "name", "id", "qualified"), ["tail", "lang", "name"], "mod")
    rungs = keys.withColumns({"tail": module_tail(F.col("module")), "free": names_free_item(), "by_name": by_name_alone()})
    rungs = rungs.join(in_file, ["from_file", "name"], "left").join(in_module, ["tail", "lang", "name"], "left")
    none, nothing = F.lit(None).cast("long"), F.lit(None).cast("string")
    spelt = "target" in refs.columns  # without spelled targets four rungs have nothing to ask
    if spelt:
        own = unique(targets.select(F.col("file_path").alias("from_file"), "name", F.col("qualified").alias("target"), "id"), ["from_file", "name", "target"], "own")
        rungs = rungs.join(own, ["from_file", "name", "target"], "left").withColumn("key", F.xxhash64(*KEY))
        members = resolve_members(rungs, symbols, imports)
        rungs = rungs.join(members.select("key", F.col("confidence").alias("member_confidence"), F.col("target_id").alias("member_id")), "key", "left")
    else:
        rungs = rungs.withColumns({"own_n": none, "own_sum": none, "member_confidence": nothing, "member_id": none})

    if spelt:
        wanted = keys.where("target is not null and not is_use").select("target", "lang").distinct()
        spelled = targets.select("id", "lang", F.explode(F.transform(module_suffixes(F.col("module")), lambda m: F.concat_ws("::", m, "qualified"))).alias("target")).unionByName(
            targets.select("id", "lang", F.col("qualified").alias("target"))
        )
        by_path = unique(spelled.join(wanted, ["target", "lang"], "left_semi").distinct(), ["target", "lang"], "path")
        rungs = rungs.join(by_path, ["target", "lang"], "left")
    else:
        rungs = rungs.withColumns({"path_n": none, "path_sum": none})

    if imports is None:
        rungs = rungs.withColumns({"imp_n": none, "imp_sum": none})
    else:
        wanted = keys.select("from_file", "name", "lang").distinct()
        asked = imports.join(wanted, "from_file").where(F.col("target_symbol").isNull() | (F.col("target_symbol") == F.col("name")))
        asked = asked.select("from_file", "name", "lang", F.regexp_replace("target_path", r"\.|/", "::").alias("suffix"), F.col("target_symbol").isNotNull().alias("explicit"))
        offered = targets.select("id", "name", "lang", "file_path", F.explode(module_suffixes(F.col("module"))).alias("suffix"))
        met = asked.join(offered, ["name", "lang", "suffix"]).where("file_path <> from_file")
        first = met.groupBy("from_file", "name", "lang").agg(F.max("explicit").alias("best"))  # explicit imports go before whole modules
        met = met.join(first, ["from_file", "name", "lang"]).where("explicit = best").select("from_file", "name", "lang", "id").distinct()
        rungs = rungs.join(unique(met, ["from_file", "name", "lang"], "imp"), ["from_file", "name", "lang"], "left")

    if reexports is None or not spelt:
        rungs = rungs.withColumns({"re_answer": nothing, "re_id": none})
    else:
        rungs = rungs.withColumn("spelled", F.when((F.col("lang") == "rust") & ~F.col("is_use") & F.col("target").contains("::") & ~F.col("target").startswith("<"), absolute(F.col("target"), F.col("module"))))
        all_spelled = targets.where("lang = 'rust'").select("id", F.explode(F.transform(module_suffixes(F.col("module")), lambda m: F.concat_ws("::", m, "qualified"))).alias("path"))
        all_spelled = all_spelled.unionByName(targets.where("lang = 'rust'").select("id", F.col("qualified").alias("path"))).distinct()
        led = follow_reexports(rungs.where("spelled is not null").select(F.col("spelled").alias("path")).distinct(), reexports, all_spelled.select("path", F.col("id").alias("symbol_id")))
        rungs = rungs.join(led.select(F.col("path").alias("spelled"), F.col("answer").alias("re_answer"), F.col("symbol_id").alias("re_id")), "spelled", "left")

    # a free item's candidates are those outside types
    pick = lambda c: F.when(F.col("free"), F.coalesce(f"{c[0]}_f{c[1]}", F.lit(0))).otherwise(F.coalesce(f"{c[0]}_{c[1]}", F.lit(0)))
    file_n, file_sum = pick(("file", "n")), pick(("file", "sum"))
    others, other_sum = pick(("mod", "n")) - file_n, pick(("mod", "sum")) - file_sum
    bare = F.col("by_name")
    answer = lambda confidence, target: F.struct(F.lit(confidence).alias("confidence"), target.cast("long").alias("target_id"))
    fuzzy = answer("fuzzy_name", none)
    # self:: and super:: are relative to the caller: its module goes before what others re-export
    relative = (F.col("lang") == "rust") & F.col("target").rlike("^(?:self|super)::") & ~F.col("receiver_unknown")
    ladder = (
        F.when(F.col("is_runtime"), fuzzy)
        .when(F.col("member_confidence").isNotNull(), F.struct(F.col("member_confidence").alias("confidence"), F.col("member_id").cast("long").alias("target_id")))
        .when(F.col("own_n") == 1, answer("exact", F.col("own_sum")))
        .when(bare & (file_n == 1), answer("exact", file_sum))
        .when(F.col("imp_n") == 1, answer("import_resolved", F.col("imp_sum")))
        .when(F.col("imp_n") > 1, fuzzy)
        .when(~F.col("is_use") & (F.col("path_n") == 1), answer("exact", F.col("path_sum")))
        .when(relative & (others == 1), answer("same_module", other_sum))
        .when(F.col("re_answer") == "hit", answer("import_resolved", F.col("re_id")))
        .when(F.col("re_answer") == "ambiguous", fuzzy)
        .when(bare & (others == 1), answer("same_module", other_sum))
        .otherwise(fuzzy)
    )
    answers = rungs.select(*KEY, ladder.alias("answer")).select(*(F.col(k).alias(f"k_{k}") for k in KEY), "answer.confidence", "answer.target_id")
    same = None
    for k in KEY:
        test = keyed[k].eqNullSafe(answers[f"k_{k}"]) if k == "target" else keyed[k] == answers[f"k_{k}"]
        same = test if same is None else same & test
    return keyed.join(answers, same, "left").select(*refs.columns, "target_id", F.coalesce("confidence", F.lit("fuzzy_name")).alias("confidence"))


def contributions(symbols: DataFrame) -> DataFrame:
    """(rung, k1, k2, k3, id): every key of a rung's counts that a symbol enters. The ladder reads nothing else of the symbols."""
    targets = symbols.where("kind <> 'impl'")
    none = F.lit(None).cast("string")
    row = lambda rung, k1, k2, k3: (F.lit(rung).alias("rung"), F.col(k1).alias("k1"), F.col(k2).alias("k2"), (none if k3 is None else F.col(k3)).alias("k3"), "id")
    suffixed = targets.select("id", "lang", "name", "file_path", "qualified", F.explode(module_suffixes(F.col("module"))).alias("suffix"))
    spelled = suffixed.select("id", "lang", F.concat_ws("::", "suffix", "qualified").alias("target")).unionByName(targets.select("id", "lang", F.col("qualified").alias("target"))).distinct()
    return (
        targets.select(*row("file", "file_path", "name", None))
        .unionByName(targets.select(*row("own", "file_path", "name", "qualified")))
        .unionByName(targets.where(~is_member(F.col("qualified"))).withColumn("tail", module_tail(F.col("module"))).select(*row("free module", "tail", "lang", "name")))
        .unionByName(targets.withColumn("tail", module_tail(F.col("module"))).select(*row("module", "tail", "lang", "name")))
        .unionByName(spelled.select(*row("path", "target", "lang", None)))
        .unionByName(suffixed.select(*row("import", "suffix", "lang", "name")))
        .unionByName(member_contributions(symbols).select("rung", "k1", "k2", none.alias("k3"), "id"))
    )


def changed_keys(before: DataFrame, after: DataFrame) -> DataFrame:
    """(rung, k1, k2, k3): keys whose count or id sum moves from ``before`` to ``after``, by signed contributions. Symbols of untouched files may be left out of both."""
    signed = contributions(before).withColumn("sign", F.lit(-1)).unionByName(contributions(after).withColumn("sign", F.lit(1)))
    # ids as decimals: sums of 64-bit ids of both signs must not wrap to zero by chance
    moved = signed.groupBy("rung", "k1", "k2", "k3").agg(F.sum("sign").alias("n"), F.sum(F.col("sign") * F.col("id").cast("decimal(20,0)")).alias("ids"))
    return moved.where("n <> 0 or ids <> 0").select("rung", "k1", "k2", "k3")


def dependents(before: DataFrame, after: DataFrame, refs: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """References whose answer may differ after an edit of the symbols: those that ask a key whose counts moved.

    An answer is a function of the reference's key and of its rungs' counts and id sums, so all others keep theirs.
    References of files whose imports changed are not found here. Arguments as in ``resolve``.
    """
    from loomgraph.operators.cut import cut

    keys = cut(changed_keys(before, after))
    asked = with_defaults(refs).withColumn("tail", module_tail(F.col("module")))
    rung = lambda name, *columns: keys.where(F.col("rung").isin(name, f"free {name}", "own" if name == "file" else name)).select(*(F.col(f"k{k}").alias(c) for k, c in enumerate(columns, 1)))
    found = asked.join(rung("file", "from_file", "name"), ["from_file", "name"], "left_semi").select("id")
    found = found.unionByName(asked.join(rung("module", "tail", "lang", "name"), ["tail", "lang", "name"], "left_semi").select("id"))
    if "target" in refs.columns:
        found = found.unionByName(asked.where("target is not null and not is_use").join(rung("path", "target", "lang"), ["target", "lang"], "left_semi").select("id"))
        members = asked.where("lang = 'rust' and not is_use").withColumn("p", parsed(F.col("target"))).where("p is not null").select("id", "p.type", "p.member")
        found = found.unionByName(members.join(rung("member", "type", "member"), ["type", "member"], "left_semi").select("id"))
        found = found.unionByName(members.join(rung("declared", "member"), "member", "left_semi").select("id")).unionByName(members.join(rung("impl", "type"), "type", "left_semi").select("id"))
    if imports is not None:
        offered = rung("import", "suffix", "lang", "name")
        used = imports.select("from_file", "target_symbol", F.regexp_replace("target_path", r"\.|/", "::").alias("suffix")).join(offered, "suffix")
        used = used.where(F.col("target_symbol").isNull() | (F.col("target_symbol") == F.col("name"))).select("from_file", "lang", "name").distinct()
        found = found.unionByName(asked.join(used, ["from_file", "lang", "name"], "left_semi").select("id"))
    return refs.join(found.distinct(), "id", "left_semi")


def asked_symbols(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """The symbols that can answer a reference: of its name, or whose qualified name ends like its target."""
    tail = lambda c: F.element_at(F.split(c, "::"), -1)
    asked = with_defaults(refs)
    by_name = symbols.join(asked.select("name").distinct(), "name", "left_semi").select("id")
    ends = asked.where("target is not null").select(tail(F.col("target")).alias("end")).distinct()
    by_end = symbols.withColumn("end", tail(F.col("qualified"))).join(ends, "end", "left_semi").select("id")
    return symbols.join(by_name.unionByName(by_end).distinct(), "id", "left_semi")


RESOLVED_SQL = r""",
in_file AS (SELECT file_path, name, count(*) AS n, sum(id) AS s FROM symbols GROUP BY ALL),
in_module AS (SELECT split_part(module, '/', -1) AS tail, lang, name, count(*) AS n, sum(id) AS s FROM symbols GROUP BY ALL),
refs AS (
  SELECT r.*, CASE WHEN f.n = 1 THEN 'exact' WHEN m.n - coalesce(f.n, 0) = 1 THEN 'same_module' ELSE 'fuzzy_name' END AS confidence,
         (CASE WHEN f.n = 1 THEN f.s WHEN m.n - coalesce(f.n, 0) = 1 THEN m.s - coalesce(f.s, 0) END)::BIGINT AS target_id
  FROM raw_refs r LEFT JOIN in_file f ON f.file_path = r.from_file AND f.name = r.name
  LEFT JOIN in_module m ON m.tail = split_part(r.module, '/', -1) AND m.lang = r.lang AND m.name = r.name)"""
