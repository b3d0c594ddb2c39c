"""Secret scans: patterns, and sliding-window Shannon entropy over candidate strings.

All of it is DataFrame expressions. A candidate is a maximal run of the base64
alphabet, its value what follows the last ``=`` or ``/`` in it; the class
(hexadecimal, digits, letters of both cases, or mixed letters and digits) sets the entropy
that a window must reach. Entropy moves from window to window by incremental
counts: the sum of c*log2(c) changes only by the character that enters and the
one that leaves. Candidates on the allow list, and those that a pattern already
found, are suppressed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import whole_text

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run of 16 or 32 and more is the same match as a run of any length that is then dropped if shorter.
ACCESS, HEX = r"AKIA[A-Z0-9]{12,}", r"[0-9a-f]{32,}"
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/=_-"
CANDIDATE = r"[A-Za-z0-9+/=_-]{20,}"
WINDOW = 20
#: Matches whose places are summed together.
RUN = 64
#: Bits a character that some window must reach, by class.
LEAST_BITS = {"hex": 3.0, "digits": 3.0, "letters": 3.95, "mixed": 3.7}
#: The part of a candidate that a name or path before it doesn't speak for; padding at the end aside.
VALUE = r"([^=/]*)=*$"
#: Values that are no secrets, and whole candidates that are none.
ALLOW_VALUES = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # UUID
    r"(?i)example|placeholder|changeme|dummy|redacted|your[_-]|x{8}|0{8}|(?:1234567)",
)
ALLOW_WHOLE = (r"^/?(?:[a-z]+[/_-])+[a-z]+[0-9]{0,4}$",)  # paths and names of plain words


def located(text: Column, pattern: str) -> Column:
    """All matches of ``pattern``, leftmost and not overlapping, as (start, end, match); code points, end exclusive.

    Places are sums of the lengths before: within runs of RUN matches, then over the
    runs, so that a text of many matches never copies a long array for each.
    """
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<start:int,end:int,match:string>>")
    start = lambda a, m: a["at"] + F.length(m["piece"])
    begin = F.struct(F.lit(0).alias("at"), empty.alias("spans"))
    walk = lambda run: F.aggregate(
        run,
        begin,
        lambda a, m: F.struct(
            (start(a, m) + F.length(m["match"])).alias("at"),
            F.concat(a["spans"], F.array(F.struct(start(a, m).alias("start"), (start(a, m) + F.length(m["match"])).alias("end"), m["match"].alias("match")))).alias("spans"),
        ),
    )
    zipped = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("piece"), found.alias("match"))
    runs = lambda z: F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / RUN).cast("int")), lambda k: walk(F.slice(z, k * RUN + 1, RUN)))
    moved = lambda spans, by: F.transform(spans, lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["match"].alias("match")))
    joined_runs = lambda rs: F.aggregate(
        rs,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,end:int,match:string>>>").alias("spans")),
        lambda a, r: F.struct((a["at"] + r["at"]).alias("at"), F.concat(a["spans"], F.array(moved(r["spans"], a["at"]))).alias("spans")),
        lambda a: F.flatten(a["spans"]),
    )
    return F.when(text.rlike(pattern), joined_runs(runs(zipped))).otherwise(empty)


def most_bits(candidate: Column) -> Column:
    """The largest Shannon entropy, in bits a character, of the windows of WINDOW characters."""
    share = F.array(*(F.lit(float(c * math.log2(c)) if c else 0.0) for c in range(WINDOW + 2)))
    codes = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    codes = F.filter(codes, lambda c: c >= 0)

    def step(a: Column, i: Column) -> Column:
        comes, goes = F.get(a["codes"], i), F.coalesce(F.get(a["codes"], i - WINDOW), F.lit(-1))
        n, m = F.get(a["counts"], comes), F.coalesce(F.get(a["counts"], goes), F.lit(0))
        same = comes == goes
        total = (
            F.when(same, a["total"])
            .when(goes < 0, a["total"] + F.get(share, n + 1) - F.get(share, n))
            .otherwise(a["total"] + F.get(share, n + 1) - F.get(share, n) + F.get(share, m - 1) - F.get(share, m))
        )
        counts = F.when(same, a["counts"]).otherwise(
            F.transform(a["counts"], lambda c, k: c + (k == comes).cast("int") - (k == goes).cast("int"))
        )
        bits = F.lit(math.log2(WINDOW)) - total / F.lit(float(WINDOW))
        best = F.when(i >= WINDOW - 1, F.greatest(a["best"], bits)).otherwise(a["best"])
        return F.struct(a["codes"].alias("codes"), counts.alias("counts"), total.alias("total"), best.alias("best"))

    begin = F.struct(codes.alias("codes"), F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"))
    return F.aggregate(F.sequence(F.lit(0), F.length(candidate) - 1), begin, step, lambda a: a["best"])


def may_be_secret(candidate: Column) -> Column:
    """Whether a candidate is of any class: it has letters and digits, or its value is 20 digits or letters of both cases (four of each) and more."""
    value = F.regexp_extract(candidate, VALUE, 1)
    return (candidate.rlike("[0-9]") & candidate.rlike("[A-Za-z]")) | value.rlike("^(?:[0-9]{20,}|[A-Za-z]{20,})$")


def suspicious(candidate: Column) -> Column:
    """Whether class and entropy make a secret of a candidate that the allow list does not speak for."""
    value = F.regexp_extract(candidate, VALUE, 1)
    allowed = F.lit(False)
    for column, patterns in ((value, ALLOW_VALUES), (candidate, ALLOW_WHOLE)):
        for pattern in patterns:
            allowed = allowed | column.rlike(pattern)
    digits = value.rlike("^[0-9]{20,}$")
    letters = value.rlike("^[A-Za-z]{20,}$") & value.rlike("(?:[A-Z][a-z]*){4}") & value.rlike("(?:[a-z][A-Z]*){4}")
    mixed = candidate.rlike("[0-9]") & candidate.rlike("[A-Za-z]")
    least = F.when(digits, LEAST_BITS["digits"]).when(letters, LEAST_BITS["letters"]).when(candidate.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$"), LEAST_BITS["hex"]).otherwise(LEAST_BITS["mixed"])
    return F.when((digits | letters | mixed) & ~allowed, most_bits(F.when(digits | letters, value).otherwise(candidate)) >= least).otherwise(F.lit(False))


def spans_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with the array columns ``_base`` and ``_added`` of (start, kind, end)."""
    raw = whole_text(docs, text)
    keyed = lambda spans, kind: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))
    value = lambda s: F.regexp_extract(s["match"], f"^{ASSIGN}$", 1)
    found = docs.withColumns(
        {
            "_assign": keyed(F.filter(located(raw, ASSIGN), lambda s: F.length(value(s)) >= 8), "assign"),
            "_access": keyed(located(raw, ACCESS), "access"),
            "_hex": keyed(located(raw, HEX), "hex"),
            "_candidates": F.filter(located(raw, CANDIDATE), lambda s: may_be_secret(s["match"])),
        }
    )
    based = found.withColumn("_base", F.sort_array(F.concat("_assign", "_access", "_hex")))
    free = F.filter("_candidates", lambda s: ~F.exists("_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    added = keyed(F.filter(free, lambda s: suspicious(s["match"])), "entropy")
    return based.withColumn("_added", F.when(F.size("_candidates") > 0, added).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))).drop("_candidates")


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans per row.

    Null texts are empty: no spans, and the hash of the empty text. Spans of one
    start are in the order of KINDS. Rows are independent, so repeats and null ids
    pass through; an empty table gives no rows; further columns are ignored.
    """
    found = spans_of(docs.select(docs[doc_id].cast("long").alias("doc_id"), whole_text(docs, text).alias("text")))
    return found.select(
        "doc_id",
        *(F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(joined(F.col("_base")), 256).alias("base_sha256"),
        joined(F.sort_array(F.concat("_base", "_added"))).alias("spans"),
    )


def redact(docs: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The rows of ``docs`` with every span of ``text`` replaced by ``mask``; other columns, and texts without spans (null ones too), as they were.

    Rows are independent: repeats and null ids pass through, and no column's name clashes with what is computed.
    """
    row = F.struct(*(docs[c] for c in docs.columns))
    found = spans_of(docs.select(row.alias("row"), whole_text(docs, text).alias("text")))
    spans = F.sort_array(F.concat("_base", "_added"))
    raw = F.col("text")
    walk = F.aggregate(
        F.col("spans"),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("done")),
        lambda a, s: F.when(
            s["start"] >= a["at"],
            F.struct(s["end"].alias("at"), F.concat(a["done"], F.substring(raw, a["at"] + 1, s["start"] - a["at"]), F.lit(mask)).alias("done")),
        ).otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["done"].alias("done"))),
        lambda a: F.concat(a["done"], F.substring(raw, a["at"] + 1, F.length(raw))),
    )
    masked = found.select("row", "text", spans.alias("spans"))
    new = F.when(F.size("spans") > 0, walk).otherwise(F.col("row")[text])
    return masked.select(*((new if c == text else F.col("row")[c]).alias(c) for c in docs.columns))
