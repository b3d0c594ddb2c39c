"""Queries over sources and sinks that the driver's tables can stand for."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.plans.catalog import query
from loomgraph.sources import deliveries as D
from loomgraph.sources import extract as E
from loomgraph.sources import fixtures as X


def envelopes(spark, d):
    """One delivery envelope per order, as JSON."""
    o = X.table(spark, d, "orders")
    task = F.struct(F.concat(F.lit("T-"), F.col("o_custkey").cast("string")).alias("task_id"), F.col("o_orderpriority").alias("title"), F.lit("sent with ghp_abcdefghijkl1234").alias("description"), F.lit("known_pre_execution").alias("text_availability"))
    return o.select(
        F.when(F.col("o_orderkey") % 10 == 0, 1).otherwise(2).alias("schema_version"), F.lit("r").alias("repository"), F.lit("main").alias("landing_branch"),
        F.concat(F.lit("b"), F.col("o_orderkey").cast("string")).alias("before_revision"), F.concat(F.lit("a"), F.col("o_orderkey").cast("string")).alias("after_revision"),
        F.col("o_orderkey").cast("string").alias("delivery_id"), F.lit("verified").alias("evidence"),
        F.struct(F.lit("known").alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp")).alias("delivered_at"), F.array(task).alias("tasks"),
    )


@query("import_delivery", "SELECT o_orderkey::VARCHAR AS delivery_id, 'T-' || o_custkey AS task_id, 'sent with [REDACTED_SECRET]' AS description FROM orders WHERE o_orderkey % 10 <> 0")
def import_delivery(spark, d):
    accepted, _ = D.validate(envelopes(spark, d))
    fresh, _ = D.merge(accepted.limit(0), accepted)
    return fresh.select("delivery_id", F.col("tasks")[0]["task_id"].alias("task_id"), F.col("tasks")[0]["description"].alias("description"))


@query("eval_validate_case", "SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'schema_version' ELSE 'accepted' END AS reason, count(*) AS n FROM orders GROUP BY 1")
def eval_validate_case(spark, d):
    accepted, rejected = D.validate(envelopes(spark, d))
    both = accepted.select(F.lit("accepted").alias("reason")).unionByName(rejected.select("reason"))
    return both.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("extract_file")
def extract_file(spark, d):
    """Facts of the documents read as Markdown."""
    docs = X.table(spark, d, "documents")
    files = docs.select(F.concat(X.doc_path(F.col("source"), F.col("lang"), F.col("doc_id")), F.lit(".md")).alias("path"), F.encode("text", "UTF-8").alias("content"), F.lit("markdown").alias("lang"))
    facts = E.extract(files)
    return files.join(facts, files.path == facts.file_path, "left").groupBy("path").agg(F.count("fact").alias("facts"))
