"""Requests and reports of an analysis: validation, excerpts, and fitting an answer to a size."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a request may ask for, lines around a change, and the lists that an answer's symbols and the answer itself hold.
DEFAULT_LIMIT, MAX_LIMIT, CONTEXT_LINES = 10, 100, 5
SYMBOL_LISTS = ("callers", "entry_points", "candidate_tests")
STANDING_LISTS = ("not_analysed", "unresolved", "out_of_scope")


def invalid_request(query: Column, task_id: Column, limit: Column, snapshot_task: Column, variant: Column, word_options: Column) -> Column:
    """The field that makes a recommendation request invalid, or null: an empty input, a limit out of bounds, a snapshot of another task or beside a text, word options of another variant."""
    given = F.coalesce(query, task_id, F.lit(""))
    asked = F.coalesce(limit, F.lit(DEFAULT_LIMIT))
    return (
        F.when(F.trim(F.regexp_replace(given, r"\s+", " ")) == "", "query")
        .when((asked < 1) | (asked > MAX_LIMIT), "limit")
        .when(snapshot_task.isNotNull() & (query.isNotNull() | (snapshot_task != task_id)), "task_snapshot")
        .when(word_options & (variant != "word_index"), "word_index")
    )


def excerpts(spans: DataFrame, texts: DataFrame, context: int = CONTEXT_LINES) -> DataFrame:
    """``spans`` (path, first, last: lines from 1) with first_shown, last_shown and excerpt: the lines and ``context`` more on both sides."""
    lines = texts.select(F.col("path").alias("t_path"), F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    met = spans.join(lines, F.col("path") == F.col("t_path"))
    low, high = F.greatest(F.col("first") - context, F.lit(1)), F.least(F.col("last") + context, F.size("lines"))
    shown = met.withColumns({"first_shown": low.cast("long"), "last_shown": high.cast("long")}).where("last_shown >= first_shown")
    part = F.slice("lines", F.col("first_shown").cast("int"), (F.col("last_shown") - F.col("first_shown") + 1).cast("int"))
    return shown.select(*spans.columns, "first_shown", "last_shown", F.array_join(part, "\n").alias("excerpt"))


def fit_to_bytes(document: dict, max_bytes: int) -> bool:
    """Shrinks an answer in place until its JSON has at most ``max_bytes``; whether it fits. What was cut stands in ``truncation``.

    The symbols' longest lists are halved down to one entry; then the later half of the symbols becomes not analysed; then the standing lists are halved.
    """
    size = lambda: len(json.dumps(document, separators=(",", ":")).encode())
    symbols, cut = document.setdefault("symbols", []), set()
    while size() > max_bytes:
        longest = max((len(s.get(name, [])) for s in symbols for name in SYMBOL_LISTS), default=0)
        standing = max(len(document.get(name, [])) for name in STANDING_LISTS)
        if longest > 1:
            for s in symbols:
                for name in SYMBOL_LISTS:
                    del s.get(name, [])[longest // 2 :]
            cut.add("symbols[].lists")
        elif symbols:
            keep = len(symbols) // 2
            document.setdefault("not_analysed", []).extend({"selector": s.get("selector"), "status": s.get("status"), "reason": "max_response_bytes"} for s in symbols[keep:])
            del symbols[keep:]
            cut.add("symbols")
        elif standing:
            for name in STANDING_LISTS:
                del document.get(name, [])[standing // 2 :]
            cut.add(",".join(STANDING_LISTS))
        else:
            break
        document["summary"] = {"analysed_symbols": len(symbols), "not_analysed_symbols": len(document.get("not_analysed", [])), **{n: sum(len(s.get(n, [])) for s in symbols) for n in SYMBOL_LISTS}}
        document["truncation"] = sorted({*map(tuple, document.get("truncation", [])), *((what, "max_response_bytes", max_bytes) for what in cut)})
        document["truncated"] = True
    return size() <= max_bytes
