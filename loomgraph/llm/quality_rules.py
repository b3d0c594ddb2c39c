"""Quality rules: a short-circuit cascade ordered by rejection per cost.

All of it is DataFrame expressions. Each rule is a condition over a row's
measures; its cost and the share of rows it rejects are estimated on a sample,
and the cascade asks the rules by rejection per cost, stopping at the first that
rejects. The order changes only the work, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import WHITE, whole_text

WINDOW = 5
#: Rows of the sample that costs and rejections are estimated on: the stated bound.
SAMPLE_ROWS = 1000


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[], Column]


def sum_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


#: Over the columns of ``measure``: conditions under which a text goes.
RULES = [
    Rule("few_words", lambda: F.col("n_words") < 10),
    Rule("repeated_words", lambda: 100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
    Rule("word_length", lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words"))),
    Rule("symbols", lambda: 100 * F.col("n_symbols") > 30 * F.col("n_words")),
    Rule("duplicate_lines", lambda: 10 * F.col("n_dup_lines") > 4 * F.col("n_lines")),
    Rule("shouting", lambda: 2 * F.length(F.regexp_replace("raw", r"\P{Lu}+", "")) > F.col("word_chars")),
]
BASE = ("few_words", "repeated_words")


def measure(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, raw, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    n = F.size("words")
    own = docs.select(docs[doc_id].cast("long").alias("doc_id"), whole_text(docs, text).alias("raw"))
    split = own.withColumns(
        {
            "words": F.filter(F.split("raw", f"[{WHITE}]+"), lambda w: w != ""),
            "lines": F.filter(F.split("raw", "\n"), lambda x: x.rlike(f"[^{WHITE}]")),
        }
    )
    counted = split.select(
        "doc_id",
        "raw",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("raw", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("codes"),
    )
    last = F.col("n_words").cast("int") - (WINDOW - 1)
    windows = F.when(
        last > 1,
        F.sort_array(
            F.transform(
                F.slice("codes", 1, F.greatest(last, F.lit(0))),
                lambda c, i: F.struct(F.xxhash64(c, *(F.get("codes", i + k) for k in range(1, WINDOW))).alias("w"), i.alias("p")),
            )
        ),
    ).otherwise(F.array().cast("array<struct<w:bigint,p:int>>"))
    sorted_windows = counted.withColumn("windows", windows).drop("codes")
    twice = F.transform(
        "windows",
        lambda s, k: F.when((s["w"] == F.get("windows", k - 1)["w"]) | (s["w"] == F.get("windows", k + 1)["w"]), s["p"]),
    )
    places = sorted_windows.withColumn("places", F.sort_array(F.filter(twice, lambda p: p.isNotNull()))).drop("windows")
    covered = sum_of(F.transform("places", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("places", k + 1) - p, F.lit(WINDOW))).cast("long")))
    return places.withColumn("n_repeat_words", covered).drop("places")


def cascade_order(docs: DataFrame, rules: list[Rule], rows: int = SAMPLE_ROWS, text: str = "text", doc_id: str = "doc_id", clock: Callable[[], float] = time.perf_counter) -> list[Rule]:
    """``rules`` by rejected share per second on a sample of at most ``rows`` rows.

    The sample is of whole documents, taken before anything is measured; a rule's
    time is that of its condition with all measures that it needs, less what a pass over the sample takes anyway.
    """
    total = docs.count()
    sample = docs.select(docs[doc_id], docs[text]).sample(min(1.0, 2 * rows / max(1, total)), seed=1).limit(rows).cache()
    try:
        n = max(1, sample.count())

        def timed(condition: Column) -> tuple[float, int]:
            seconds, rejected = [], 0
            for _ in range(2):
                began = clock()
                rejected = measure(sample, text, doc_id).agg(F.count(F.when(condition, 1)).alias("n")).first()["n"]
                seconds.append(clock() - began)
            return min(seconds), rejected

        idle, _ = timed(F.col("raw") == "")
        worth = []
        for place, rule in enumerate(rules):
            seconds, rejected = timed(rule.rejects())
            worth.append((-(rejected / n) / max(seconds - idle, 1e-3), place))
    finally:
        sample.unpersist()
    return [rules[place] for _, place in sorted(worth)]


def verdict(rules: list[Rule]) -> Column:
    """True if no rule rejects; later rules are not evaluated once one has."""
    out = F.lit(True)
    for rule in reversed(rules):
        out = F.when(F.coalesce(rule.rejects(), F.lit(False)), F.lit(False)).otherwise(out)
    return out


def apply_rules(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept per row.

    Null texts count as empty: no words, so they fail. Rows are independent, so
    repeats, ties and null ids pass through; an empty table gives no rows; further columns are ignored.
    """
    measured = measure(docs, text, doc_id)
    ordered = cascade_order(docs, RULES if rules is None else rules, text=text, doc_id=doc_id)
    base = [r for r in RULES if r.name in BASE]
    out = measured.withColumn("base_failed", ~verdict(base))
    out = out.withColumn("kept", ~F.col("base_failed") & verdict(ordered))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
