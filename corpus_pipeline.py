"""A corpus pipeline of five stages over ``documents``, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import exact_dedup, near_dup, packing, secret_scan, toxicity
from loomgraph.llm.common import materialize, read_table
from loomgraph.llm.queries import tokenizer_path


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on their labels, finds toxic go.

    Null and empty texts and rows without an id are scored like others and stay, rows that repeat an id are judged each by
    its own text, further columns stay as they are; without labels of both kinds, or without documents, nothing goes.
    """
    return toxicity.drop_toxic(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays; rows that repeat an id too, and rows without one, are no exception.

    Null texts equal empty ones and those of white space alone; further columns stay as they are; no rows give none.
    """
    return exact_dedup.drop_copies(docs)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share five-word shingles at a Jaccard similarity of 0.8 or more, linked in chains, the least id stays.

    Texts without words, null ones too, and rows without an id stay; where an id repeats, each of its sets is a document. No rows give none.
    """
    return near_dup.drop_near_copies(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; n_chars follows the text, and stays as it was where the text is null. No document goes."""
    out = secret_scan.redact(docs)
    return out.withColumn("n_chars", F.when(out.text.isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens.

    Null and empty texts are one piece of one id, rows that repeat an id are packed each, null ids are kept; no rows give none.
    """
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dup", near_dup_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: The trained classifier, subword ids and the linear program are beyond SQL.
ORACLE_SQL = None
