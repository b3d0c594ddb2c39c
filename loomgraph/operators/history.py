"""Operators over delivered changes: attribution, lineage, liveness, eligibility."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attribute_side(changes: DataFrame, symbols: DataFrame) -> DataFrame:
    """(change_id, symbol_id) of line ranges (change_id, path, first, last): the symbols that overlap a range, without those that strictly hold another one that does.

    symbols: symbol_id, path, first, last. A range without a symbol has a null symbol_id.
    """
    s = symbols.select("symbol_id", F.col("path").alias("s_path"), F.col("first").alias("s_first"), F.col("last").alias("s_last"))
    met = changes.join(s, (F.col("path") == F.col("s_path")) & (F.col("s_first") <= F.col("last")) & (F.col("s_last") >= F.col("first")))
    met = met.select("change_id", "symbol_id", "s_first", "s_last")
    inner = met.select(F.col("change_id").alias("i_change"), F.col("symbol_id").alias("i_id"), F.col("s_first").alias("i_first"), F.col("s_last").alias("i_last"))
    holds = (F.col("change_id") == F.col("i_change")) & (F.col("symbol_id") != F.col("i_id")) & (F.col("s_first") <= F.col("i_first")) & (F.col("s_last") >= F.col("i_last"))
    holds = holds & ((F.col("s_first") < F.col("i_first")) | (F.col("s_last") > F.col("i_last")))
    minimal = met.join(inner, holds, "left_anti").select("change_id", "symbol_id")
    return changes.select("change_id").distinct().join(minimal, "change_id", "left")


def pair_symbols(before: DataFrame, after: DataFrame) -> DataFrame:
    """(delivery_id, before_id, after_id, how): exact (qualified, kind) that is unique on both sides, else a unique (kind, signature) of what is left, else unmatched."""
    def unique(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        return df.groupBy("delivery_id", *keys).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias(name)).where("n = 1").drop("n")

    exact = unique(before, ["qualified", "kind"], "before_id").join(unique(after, ["qualified", "kind"], "after_id"), ["delivery_id", "qualified", "kind"]).select("delivery_id", "before_id", "after_id", F.lit("exact").alias("how"))
    left_a = before.join(exact, (before.delivery_id == exact.delivery_id) & (before.id == exact.before_id), "left_anti")
    left_b = after.join(exact, (after.delivery_id == exact.delivery_id) & (after.id == exact.after_id), "left_anti")
    like = unique(left_a, ["kind", "signature"], "before_id").join(unique(left_b, ["kind", "signature"], "after_id"), ["delivery_id", "kind", "signature"]).select("delivery_id", "before_id", "after_id", F.lit("signature").alias("how"))
    return exact.unionByName(like)


def rebuild(stored: DataFrame, fresh: DataFrame, repository: str, branch: str, discard_verified: bool = False) -> DataFrame:
    """The history after a scope (repository, branch) is rebuilt from ``fresh``: other scopes stay as they are, and so do the scope's deliveries that are more than Git's own record, unless discarded.

    Both: repository, landing_branch, delivery_id, evidence and alike further columns. Of one id, what stays goes before what is fresh.
    """
    scope = (F.col("repository") == repository) & (F.col("landing_branch") == branch)
    stays = stored.where(~F.coalesce(scope, F.lit(False)) | (F.lit(not discard_verified) & (F.col("evidence") != "git_only")))
    named = stays.where(scope).select("delivery_id").distinct()
    return stays.unionByName(fresh.where(scope).join(named, "delivery_id", "left_anti"))


def backfill(stored: DataFrame, fresh: DataFrame, column: str, limit: int) -> DataFrame:
    """``stored`` (delivery_id and a record) with ``column`` filled from ``fresh`` in at most ``limit`` deliveries that lack it, by id, where the records agree in all else."""
    rest = [c for c in stored.columns if c not in (column, "delivery_id")]
    chosen = stored.where(F.col(column).isNull()).select("delivery_id").orderBy("delivery_id").limit(limit).withColumn("chosen", F.lit(True))
    new = fresh.select(F.col("delivery_id").alias("f_id"), F.struct(*rest).alias("f_rest"), F.col(column).alias("f_value"))
    joined = stored.withColumn("own_rest", F.struct(*rest)).join(F.broadcast(chosen), "delivery_id", "left").join(new, F.col("delivery_id") == F.col("f_id"), "left")
    agrees = F.col("chosen") & F.col("own_rest").eqNullSafe(F.col("f_rest"))
    return joined.select(*(F.when(agrees, F.col("f_value")).otherwise(F.col(column)).alias(c) if c == column else F.col(c) for c in stored.columns))


def status(deliveries: DataFrame) -> DataFrame:
    """(scope, deliveries, verified, first_at, last_at) of deliveries (scope, verified, at)."""
    return deliveries.groupBy("scope").agg(F.count(F.lit(1)).alias("deliveries"), F.count(F.when(F.col("verified"), 1)).alias("verified"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def lineage_steps(changes: DataFrame) -> DataFrame:
    """(seq, old_path, new_path) of renames, and of deletions with a null new_path."""
    moved = changes.where(F.col("kind").isin("renamed", "deleted"))
    return moved.select("seq", "old_path", F.when(F.col("kind") == "renamed", F.col("new_path")).alias("new_path"))


def resolve_current(historical: DataFrame, live: DataFrame) -> DataFrame:
    """(key, state): live where one live path has the name, ambiguous where several have it, else deleted."""
    n = live.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    state = F.when(F.col("n") == 1, "live").when(F.col("n") > 1, "ambiguous").otherwise("deleted")
    return historical.join(n, "name", "left").select("key", state.alias("state"))


def task_eligible(tasks: DataFrame, cutoff: str, strict: bool = True) -> DataFrame:
    """Adds ``eligible``: the text is known from before execution (if strict), and its snapshot time is known and before the cutoff."""
    text = F.col("text_availability") == "known_pre_execution" if strict else F.lit(True)
    return tasks.withColumn("eligible", F.coalesce(text & F.col("snapshot_at").isNotNull() & (F.col("snapshot_at") < F.lit(cutoff).cast("timestamp")), F.lit(False)))


def resolve_query(tasks: DataFrame) -> DataFrame:
    """(task_id, text): each task's earliest captured eligible text; ties by text."""
    return tasks.where("eligible").groupBy("task_id").agg(F.min_by("text", F.struct("captured_at", "text")).alias("text"))
