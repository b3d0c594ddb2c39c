"""Terms of task texts, and what commit messages carry."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing about a change's place.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "into", "is", "it", "its", "no", "not", "of", "on", "or", "so", "that", "the", "then", "this", "to", "was", "when", "with")
MESSAGE_BYTES = 4096


def term_sequence(text: Column) -> Column:
    """Terms in order, repeats kept.

    URLs, task ids, long hexadecimal words and numbers go; words split at joiners
    and at case boundaries, and the joined whole stays too; file endings go; plurals
    fold from four letters on; terms have 2 to 40 letters and are no stop words.
    """
    bare = F.regexp_replace(text, r"(?i)(?:https?://|www\.)\S+", " ")
    bare = F.regexp_replace(bare, r"\b[A-Z][A-Z0-9]*-\d+\b", " ")
    words = F.regexp_extract_all(bare, F.lit(r"[A-Za-z0-9]+(?:[_./:-]+[A-Za-z0-9]+)*"), F.lit(0))
    words = F.filter(words, lambda w: ~w.rlike(r"^\d+$") & ~(w.rlike("^[0-9a-fA-F]{7,}$") & w.rlike(r"\d")))
    stems = F.transform(words, lambda w: F.regexp_replace(w, r"\.(?:rs|py|js|ts|tsx|jsx|go|java|kt|cs|rb|c|h|md|toml|yaml|yml|json)$", ""))

    def parts(w: Column) -> Column:
        pieces = F.split(w, r"[_./:-]+|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
        return F.when(F.size(pieces) > 1, F.concat(pieces, F.array(F.element_at(F.split(w, "/"), -1)))).otherwise(pieces)

    low = F.transform(F.flatten(F.transform(stems, parts)), lambda w: F.lower(w))
    folded = F.transform(low, lambda w: F.when((F.length(w) >= 4) & w.rlike("[^siu]s$"), F.regexp_replace(w, "s$", "")).otherwise(w))
    return F.filter(folded, lambda w: (F.length(w) >= 2) & (F.length(w) <= 40) & ~w.isin(*STOP_WORDS) & ~w.rlike(r"^\d+$"))


def terms(text: Column) -> Column:
    return F.array_distinct(term_sequence(text))


def trailer_task_ids(message: Column) -> Column:
    """Ids on ``Task-Id:`` lines, comma-split."""
    lines = F.filter(F.split(message, "\n"), lambda x: x.rlike(r"(?i)^\s*task-id:"))
    ids = F.flatten(F.transform(lines, lambda x: F.split(F.regexp_replace(x, r"(?i)^\s*task-id:\s*", ""), r"\s*,\s*")))
    return F.array_distinct(F.filter(F.transform(ids, lambda x: F.trim(x)), lambda x: x != ""))


def cut_utf8(raw: bytes, limit: int) -> bytes:
    """At most ``limit`` bytes, ending between characters."""
    if len(raw) <= limit:
        return raw
    while limit and raw[limit] & 0xC0 == 0x80:
        limit -= 1
    return raw[:limit]


def commit_message_text(message: Column, limit: int = MESSAGE_BYTES) -> Column:
    """The message without its closing paragraph of trailers, cut at ``limit`` bytes."""
    body = F.regexp_replace(message, r"(?:\n\s*\n|\A)(?:[A-Za-z][A-Za-z-]*: [^\n]*(?:\n|\z))+\s*\z", "")

    @F.pandas_udf("string")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: t if t is None else cut_utf8(t.encode(), limit).decode())

    return cut(F.trim(body))
