"""Delivery envelopes: JSON in, validated, redacted and merged by id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.scalars import redact

ENVELOPE = (
    "schema_version int, repository string, landing_branch string, before_revision string, after_revision string, delivery_id string, evidence string, "
    "delivered_at struct<status: string, timestamp: string>, tasks array<struct<task_id: string, title: string, description: string, text_availability: string>>"
)
VERSION = 2


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENVELOPE).json(path)


def validate(envelopes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with a reason), task texts redacted."""
    reason = (
        F.when(F.col("schema_version").isNull() | (F.col("schema_version") != VERSION), "schema_version")
        .when(F.coalesce(F.col("delivery_id"), F.lit("")) == "", "delivery_id")
        .when(F.coalesce(F.col("after_revision"), F.lit("")) == "", "after_revision")
        .when(F.col("before_revision") == F.col("after_revision"), "empty_boundary")
        .when(~F.coalesce(F.col("delivered_at.status"), F.lit("unavailable")).isin("known", "uncertain", "unavailable"), "delivered_at")
    )
    marked = envelopes.withColumn("reason", reason)
    clean = F.transform("tasks", lambda t: t.withField("title", redact(t["title"])).withField("description", redact(t["description"])))
    return marked.where("reason is null").drop("reason").withColumn("tasks", clean), marked.where("reason is not null")


def merge(known: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to append, conflicts): a replay that is the same changes nothing, one that differs is a conflict."""
    seen = known.select(F.col("delivery_id").alias("k_id"), F.xxhash64(F.to_json(F.struct(*sorted(known.columns)))).alias("k_hash"))
    marked = fresh.dropDuplicates().withColumn("f_hash", F.xxhash64(F.to_json(F.struct(*sorted(fresh.columns)))))
    joined = marked.join(seen, marked.delivery_id == seen.k_id, "left")
    return joined.where("k_id is null").select(*fresh.columns), joined.where("k_id is not null and k_hash <> f_hash").select(*fresh.columns)
