"""Joins of references, symbols and relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.model import CALLABLE_KINDS
from loomgraph.operators.cut import cut

#: Bytes of the blocks in which references meet the symbols around them.
SPAN_BLOCK = 4096


def around(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """``refs`` with s_id and s_size of every symbol around them.

    A symbol stands in each block of SPAN_BLOCK bytes that it covers and a reference in the one where it starts, so both
    meet by file and block: a large file is many keys, and a reference meets only what reaches its block.
    """
    block = lambda at: F.floor(at / SPAN_BLOCK).cast("long")
    covered = F.explode(F.sequence(block(F.col("span_start")), block(F.greatest("span_end", "span_start"))))
    s = symbols.select(F.col("file_path").alias("s_file"), F.col("id").alias("s_id"), F.col("span_start").alias("s_start"), F.col("span_end").alias("s_end"), covered.alias("s_block"))
    met = refs.join(s, (refs.from_file == s.s_file) & (block(refs.span_start) == s.s_block) & (s.s_start <= refs.span_start) & (s.s_end >= refs.span_end))
    return met.select(*(refs[c] for c in refs.columns), "s_id", (F.col("s_end") - F.col("s_start")).alias("s_size"))


def innermost(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Each reference with the smallest symbol around it (ties: the least id), null at the top of a file."""
    best = around(refs, symbols).groupBy("id").agg(F.min(F.struct("s_size", "s_id")).alias("best")).select(F.col("id").alias("b_id"), F.col("best.s_id").alias("inner_id"))
    return refs.join(best, refs.id == best.b_id, "left").select(refs.id.alias("ref_id"), "inner_id")


def innermost_ranked(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """The same by rank, without the references at the top of a file."""
    order = Window.partitionBy("id").orderBy("s_size", "s_id")
    return around(refs, symbols).withColumn("place", F.row_number().over(order)).where("place = 1").select(F.col("id").alias("ref_id"), F.col("s_id").alias("inner_id"))


def program_sites(sites: DataFrame, names: DataFrame) -> DataFrame:
    """Invocation sites (with the base name that they call) of programs that the manifests declare."""
    return sites.join(names.select(F.col("name").alias("p_name")).distinct(), F.col("base") == F.col("p_name")).select(*sites.columns)


def single(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows whose keys no other row has."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return rows.withColumn("same", n).where("same = 1").drop("same")


def resolve_selectors(wanted: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file_path, name, kind, id) of selectors (file_path, name, kind): a symbol of that qualified name, else of that name, the first in the file. Two equi-joins, no OR."""
    s = symbols.select("file_path", "kind", "id", "span_start", F.col("name").alias("s_name"), "qualified")
    keys = ["file_path", "name", "kind"]
    exact = wanted.join(s.select("file_path", F.col("qualified").alias("name"), "kind", "span_start", "id"), keys).select(*keys, F.lit(False).alias("by_name"), "span_start", "id")
    named = wanted.join(s.select("file_path", F.col("s_name").alias("name"), "kind", "span_start", "id"), keys).select(*keys, F.lit(True).alias("by_name"), "span_start", "id")
    best = exact.unionByName(named).groupBy(*keys).agg(F.min(F.struct("by_name", "span_start", "id")).alias("best"))
    return best.select(*keys, F.col("best.id").alias("id"))


def source_windows(symbols: DataFrame, files: DataFrame, limit: int = 65536) -> DataFrame:
    """``symbols`` with window: the bytes of their span in files (path, content), ``limit`` at most."""
    body = files.select(F.col("path").alias("f_path"), "content")
    span = F.substring("content", F.col("span_start").cast("int") + 1, F.least(F.col("span_end") - F.col("span_start"), F.lit(limit)).cast("int"))
    return symbols.join(body, symbols.file_path == body.f_path).select(*(symbols[c] for c in symbols.columns), span.alias("window"))


def overview(files: DataFrame, symbols: DataFrame, limit: int = 20) -> DataFrame:
    """(path, lang, n): the files of most symbols, at most ``limit``, ties by path."""
    n = symbols.groupBy(F.col("file_path").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    return files.select("path", "lang").join(n, "path", "left").select("path", "lang", F.coalesce("n", F.lit(0)).cast("long").alias("n")).orderBy(F.desc("n"), "path").limit(limit)


def dependencies(imports: DataFrame, scope: str = "") -> DataFrame:
    """Distinct imports of the files at or below ``scope``."""
    within = F.lit(True) if not scope else (F.col("from_file") == scope) | F.col("from_file").startswith(scope.rstrip("/") + "/")
    return imports.where(within).distinct()


def enclosed_calls(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """Calls within each symbol's span, nested symbols' too: (symbol_id, ref_id, name, span_start). They meet by file and block, see ``around``."""
    return around(refs.where("kind = 'call'"), symbols).select(F.col("s_id").alias("symbol_id"), F.col("id").alias("ref_id"), F.col("name").alias("callee"), "span_start")


def inbound_targets(refs: DataFrame, symbols: DataFrame, fuzzy: bool = False) -> DataFrame:
    """(symbol_id, ref_id): references bound to a symbol, and with ``fuzzy`` those of its bare name; two equi-joins, no OR."""
    bound = refs.where("target_id is not null").select(F.col("target_id").alias("symbol_id"), F.col("id").alias("ref_id"))
    if not fuzzy:
        return bound
    named = refs.where("confidence = 'fuzzy_name' and kind <> 'runtime_invocation'").select("name", F.col("id").alias("ref_id"))
    return bound.unionByName(symbols.select("name", F.col("id").alias("symbol_id")).join(named, "name").select("symbol_id", "ref_id")).distinct()


def inbound_counts(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol_id, bound, named) for every symbol: references bound to it, and unresolved ones of its name. Counts join, so a common name costs a row."""
    bound = refs.where("target_id is not null").groupBy(F.col("target_id").alias("b_id")).agg(F.count(F.lit(1)).alias("bound"))
    named = refs.where("confidence = 'fuzzy_name' and kind <> 'runtime_invocation'").groupBy(F.col("name").alias("f_name")).agg(F.count(F.lit(1)).alias("named"))
    joined = symbols.join(bound, symbols.id == bound.b_id, "left").join(named, symbols.name == named.f_name, "left")
    return joined.select(F.col("id").alias("symbol_id"), F.coalesce("bound", F.lit(0)).cast("long").alias("bound"), F.coalesce("named", F.lit(0)).cast("long").alias("named"))


def hint_then_qualified(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Target of (id, target_qualified, target_symbol_hint): the hinted symbol if it still has that name, else the first of the name."""
    by_id = symbols.select(F.col("id").alias("hint_id"), F.col("qualified").alias("hint_q"))
    by_name = symbols.groupBy(F.col("qualified").alias("name_q")).agg(F.min("id").alias("first_id"))
    joined = refs.join(by_id, (refs.target_symbol_hint == by_id.hint_id) & (refs.target_qualified == by_id.hint_q), "left").join(by_name, refs.target_qualified == by_name.name_q, "left")
    return joined.select(*refs.columns, F.coalesce("hint_id", "first_id").alias("resolved_id"))


def callable_names(refs: DataFrame, symbols: DataFrame, exist: bool = True) -> DataFrame:
    """References whose name some callable symbol has (or none has)."""
    names = symbols.where(F.col("kind").isin(*CALLABLE_KINDS)).select("name").distinct()
    return refs.join(names, "name", "left_semi" if exist else "left_anti")


def command_handlers(commands: DataFrame, symbols: DataFrame) -> DataFrame:
    """Commands with their handler's span, or their own place where the handler is unknown."""
    s = symbols.select(F.col("qualified").alias("handler_q"), F.col("id").alias("handler_id"), F.col("span_start").alias("h_start"))
    return commands.join(s, commands.handler_symbol == s.handler_q, "left").select(*commands.columns, "handler_id", F.coalesce("h_start", "span_start").alias("at"))


def candidates_by_name(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Distinct (name, lang) keys of the references with their number of candidate symbols."""
    keys = refs.select("name", "lang").distinct()
    return keys.join(symbols.where("kind <> 'impl'").groupBy("name", "lang").agg(F.count(F.lit(1)).alias("candidates")), ["name", "lang"])


def structure_neighbors(seeds: DataFrame, edges: DataFrame, limit: int = 6) -> DataFrame:
    """(seed, neighbor, place): each seed's first ``limit`` distinct neighbours in either direction, by name."""
    from pyspark.sql import Window

    both = edges.select(F.col("src").alias("seed"), F.col("dst").alias("neighbor")).unionByName(edges.select(F.col("dst").alias("seed"), F.col("src").alias("neighbor")))
    near = both.join(seeds.select("seed").distinct(), "seed", "left_semi").where("seed <> neighbor").distinct()
    ranked = near.withColumn("place", F.row_number().over(Window.partitionBy("seed").orderBy("neighbor")).cast("long"))
    return ranked.where(F.col("place") <= limit)


def pair_selectors(base: DataFrame, head: DataFrame) -> DataFrame:
    """(selector, side) with side both, base or head."""
    a, b = base.select("selector").distinct().withColumn("in_base", F.lit(True)), head.select("selector").distinct().withColumn("in_head", F.lit(True))
    joined = a.join(b, "selector", "full_outer")
    return joined.select("selector", F.when(F.col("in_base") & F.col("in_head"), "both").when(F.col("in_base"), "base").otherwise("head").alias("side"))


def symbol_liveness(historical: DataFrame, live: DataFrame) -> DataFrame:
    """Historical symbols (key, path, qualified, kind, signature) with the live symbol they are now, and how that was found."""
    exact = live.groupBy("path", "qualified", "kind").agg(F.min("live_id").alias("exact_id"))
    by_name = live.groupBy("qualified", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("live_id").alias("name_id")).where("n = 1").drop("n")
    by_signature = live.groupBy("kind", "signature").agg(F.count(F.lit(1)).alias("n"), F.min("live_id").alias("sig_id")).where("n = 1").drop("n")
    joined = historical.join(exact, ["path", "qualified", "kind"], "left").join(by_name, ["qualified", "kind"], "left").join(by_signature, ["kind", "signature"], "left")
    how = F.when(F.col("exact_id").isNotNull(), "path").when(F.col("name_id").isNotNull(), "name").when(F.col("sig_id").isNotNull(), "signature").otherwise("gone")
    return joined.select("key", F.coalesce("exact_id", "name_id", "sig_id").alias("live_id"), how.alias("how"))


def path_lineage(steps: DataFrame, origins: DataFrame, rounds: int = 32) -> DataFrame:
    """Where each (path, seq) is now, following the renames of later steps (seq, old_path, new_path; a null new_path ends it).

    A step is followed by the first later step of its new path. Each round doubles how far
    every step is followed, so ``rounds`` are enough for 2**rounds renames; beyond that it raises.
    """
    from pyspark.sql import Window

    known = steps.where("old_path is not null and seq is not null").groupBy(F.col("old_path").alias("s_path"), F.col("seq").alias("s_seq")).agg(F.min(F.struct("new_path")).alias("to"))
    known = known.select("s_path", "s_seq", F.col("to.new_path").alias("new_path"))
    # rows that ask for the first later step of their path, and the steps themselves; of one seq, those that ask come first
    asked = origins.select("path", "seq").distinct().select(F.col("path").alias("on_path"), F.col("seq").alias("at"), F.lit(0).alias("row"), "path", F.lit(None).cast("string").alias("new_path"))
    chained = known.select(F.col("new_path").alias("on_path"), F.col("s_seq").alias("at"), F.lit(0).alias("row"), F.col("s_path").alias("path"), "new_path").where("new_path is not null")
    chained = chained.withColumn("kind", F.lit("step")).unionByName(asked.withColumn("kind", F.lit("origin")))
    there = known.select(F.col("s_path").alias("on_path"), F.col("s_seq").alias("at"), F.lit(1).alias("row"), F.col("s_path").alias("path"), "new_path", F.lit("there").alias("kind"))
    later = Window.partitionBy("on_path").orderBy(F.desc_nulls_last("at"), "row").rowsBetween(Window.unboundedPreceding, -1)
    first = F.last(F.when(F.col("row") == 1, F.col("at")), ignorenulls=True).over(later)
    placed = cut(chained.unionByName(there).withColumn("next", first).where("kind <> 'there'").withColumn("next", F.when(F.col("on_path").isNotNull() & F.col("at").isNotNull(), F.col("next"))))

    follows = placed.where("kind = 'step'").select(F.col("path").alias("s_path"), F.col("at").alias("s_seq"), "next")
    now = cut(known.join(follows, ["s_path", "s_seq"], "left").select("s_path", "s_seq", F.col("new_path").alias("current"), F.col("new_path").alias("next_path"), "next"))
    for _ in range(rounds):
        if now.where("next is not null").isEmpty():
            break
        hop = now.select(F.col("s_path").alias("h_path"), F.col("s_seq").alias("h_seq"), F.col("current").alias("h_current"), F.col("next_path").alias("h_next_path"), F.col("next").alias("h_next"))
        met = now.join(hop, (now.next_path == hop.h_path) & (now.next == hop.h_seq), "left")
        moved = lambda name: F.when(F.col("h_seq").isNotNull(), F.col(f"h_{name}")).otherwise(F.col(name)).alias(name)
        now = cut(met.select("s_path", "s_seq", moved("current"), moved("next_path"), F.col("h_next").alias("next")))
    else:
        if not now.where("next is not null").isEmpty():
            raise RuntimeError(f"lineage still moves after {rounds} rounds")
    starts = placed.where("kind = 'origin'").select("path", F.col("at").alias("seq"), "next")
    ends = starts.join(now.select("s_path", "s_seq", F.col("current").alias("end")), (starts.path == F.col("s_path")) & (starts.next == F.col("s_seq")), "left")
    return ends.select("path", "seq", F.when(F.col("s_seq").isNotNull(), F.col("end")).otherwise(F.col("path")).alias("current"))
