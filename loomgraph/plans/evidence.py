"""Entry points and candidate tests of changed symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S
from loomgraph.operators.cut import cut


def module_segments(path: Column) -> Column:
    """Directories and the file's stem; ``pkg/__init__.py`` and ``pkg/mod.rs`` are ``pkg``."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    file = F.element_at(parts, -1)
    stem = F.split(file, r"\.").getItem(0)
    inner = F.slice(parts, 1, F.size(parts) - 1)
    index = (stem == "") | (stem == "__init__") | ((stem == "mod") & file.endswith(".rs"))
    return F.when(F.size(parts) == 0, parts).when(index, inner).otherwise(F.concat(inner, F.array(stem)))


def import_matches(paths: DataFrame, imports: DataFrame) -> DataFrame:
    """(path, from_file, target_path, target_symbol, tier) of imports that name the module at a path: ``identified``, or ``basename_only`` where just the stem of a longer path is given.

    An import names a module whose segments end with its own, alone or with the imported name; leading crate, super
    and self are no segments, and ``crate::`` matches what follows the last ``src`` where there is one. Suffixes of
    the modules meet imports by equality.
    """
    full = module_segments(F.col("path"))
    src = F.when(F.array_contains("full", "src"), F.size("full") - F.array_position(F.reverse("full"), "src").cast("int") + 1).otherwise(0)
    modules = paths.select("path").distinct().withColumn("full", full).where(F.size("full") > 0).withColumn("after", F.size("full") - src)
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size("full")), lambda k: F.struct(k.alias("length"), F.array_join(F.slice("full", F.size("full") - k + 1, k), "/").alias("name"))))
    ends = modules.select("path", F.size("full").alias("whole"), "after", suffix.alias("suffix")).select("path", "whole", "after", "suffix.length", "suffix.name")
    edges = imports.select("from_file", "target_path", "target_symbol").distinct()
    spelled = edges.select("*", F.explode(F.array_distinct(F.array("target_path", F.coalesce(F.concat_ws(".", "target_path", "target_symbol"), "target_path")))).alias("spec"))
    raw = F.filter(F.split("spec", "[/.:]"), lambda x: x != "")
    first = F.array_position(F.transform("raw", lambda x: ~x.isin("crate", "super", "self")), True).cast("int")
    asked = spelled.withColumn("raw", raw).withColumn("first", first).where("first > 0")
    asked = asked.select("from_file", "target_path", "target_symbol", (F.get("raw", F.lit(0)) == "crate").alias("rooted"), F.array_join(F.expr("slice(raw, first, size(raw))"), "/").alias("name"))
    met = asked.join(ends, "name").withColumn("room", F.when(F.col("rooted"), F.col("after")).otherwise(F.col("whole"))).where("length <= room")
    rank = F.when((F.col("length") == 1) & (F.col("room") > 1), 1).otherwise(2)
    best = met.groupBy("path", "from_file", "target_path", "target_symbol").agg(F.max(rank).alias("rank"))
    return best.select("path", "from_file", "target_path", "target_symbol", F.when(F.col("rank") == 2, "identified").otherwise("basename_only").alias("tier"))


def entry_points(paths: DataFrame, symbols: DataFrame, commands: DataFrame) -> DataFrame:
    """(origin, node, distance, rule) of evidence paths' ends: a command's handler, a test, a main function, or a symbol that nothing calls; the first rule that holds."""
    best = paths.groupBy("origin", "node").agg(F.min("distance").alias("distance"))
    inner = paths.select(F.col("origin").alias("i_origin"), F.element_at(F.split("path", ","), -2).cast("long").alias("i_node")).distinct()
    s = symbols.select("id", "name", "kind", "file_path", "qualified").join(commands.select(F.col("handler_symbol").alias("handler")).distinct(), F.col("qualified") == F.col("handler"), "left")
    met = best.join(s, best.node == s.id).join(inner, (best.origin == F.col("i_origin")) & (best.node == F.col("i_node")), "left")
    rule = F.when(F.col("handler").isNotNull(), "command").when(S.is_test_symbol(F.col("name"), F.col("kind")), "test").when(F.col("name") == "main", "main").when(F.col("i_node").isNull(), "uncalled")
    return met.select("origin", "node", "distance", rule.alias("rule")).where("rule is not null")


def candidate_tests(paths: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(origin, test_id, source) from three sources: a path of calls ends in a test, a test file imports the symbol's module, a test is named after it."""
    tests = symbols.where(S.is_test_symbol(F.col("name"), F.col("kind")) | S.is_test_path(F.col("file_path"))).select(F.col("id").alias("test_id"), F.col("name").alias("test_name"), F.col("file_path").alias("test_file"))
    tests = cut(tests)
    # one pass over the paths: their origins, each with the tests that a path ends in
    ends = cut(paths.select("origin", "node").join(tests.select(F.col("test_id").alias("node"), "test_id"), "node", "left").select("origin", "test_id").distinct())
    by_path = ends.where("test_id is not null").select("origin", "test_id", F.lit("call_path").alias("source"))
    origins = ends.select("origin").distinct().join(symbols.select("id", "name", F.col("file_path").alias("path")), F.col("origin") == F.col("id")).select("origin", "name", "path")
    origins = cut(origins)
    edges = imports if "target_symbol" in imports.columns else imports.withColumn("target_symbol", F.lit(None).cast("string"))
    named = import_matches(origins, edges).select("path", "from_file").distinct()
    by_import = origins.join(named, "path").join(tests, F.col("from_file") == F.col("test_file")).select("origin", "test_id", F.lit("import_relationship").alias("source"))
    by_name = origins.join(tests.withColumn("plain", F.lower(S.normalize_test_name(F.col("test_name")))), F.lower("name") == F.col("plain")).where(F.length("plain") > 0).where("test_id <> origin")
    by_name = by_name.select("origin", "test_id", F.lit("naming_heuristic").alias("source"))
    return by_path.unionByName(by_import).unionByName(by_name).dropDuplicates()


def no_path_reasons(origins: DataFrame, paths: DataFrame) -> DataFrame:
    """(origin, reason) of the origins without any inbound path."""
    return origins.join(paths.select("origin").distinct(), "origin", "left_anti").select("origin", F.lit("no_inbound_edge").alias("reason"))
