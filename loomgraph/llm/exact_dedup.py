"""Exact dedup: counting quotient filters, merged by sorted remainders, then byte verification.

Plan. (1) The scan derives per row a 64-bit fingerprint of the normalised text,
its SHA-256 and its length; that narrow table goes to the shared folder.
(2) Each partition builds a counting quotient filter of its fingerprints, cut
into blocks of the quotient space; a block of a hot fingerprint holds one
remainder and a counter however many rows carry it. (3) The blocks of all
partitions merge by sorted remainders, without loss since whole fingerprints can
be rebuilt from quotient and remainder. (4) Rows whose fingerprint counts above
one are routed to verification, which groups by the normalised bytes themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import WHITE, fresh_name, materialize, whole_text

#: Rows whose fingerprints one merged block should hold, and fingerprints that a partition gathers before it counts them.
BLOCK_ROWS, GATHER_ROWS = 200_000, 1_000_000
#: Bits of the quotient within a block.
QUOTIENT_BITS = 10
#: Repeated fingerprints, eight bytes each, that may be sent to all rows.
BROADCAST_ROWS = 200_000
#: Rows from which on a fingerprint is hot: its rows are never brought together. There are at most rows / HOT_ROWS of them.
HOT_ROWS = 1_000_000


class CountingQuotientFilter:
    """A lossless counting quotient filter over the 64-bit fingerprints of one block.

    The highest ``bits`` bits of a fingerprint name its block, the next QUOTIENT_BITS
    are its quotient, the others its remainder. ``occupied`` has a bit per quotient,
    ``run_end`` marks the last slot of each quotient's run, ``remainders`` are sorted
    within a run, and ``counters`` holds the multiplicity of each slot.
    """

    def __init__(self, block: int, bits: int, occupied: np.ndarray, run_end: np.ndarray, remainders: np.ndarray, counters: np.ndarray):
        self.block, self.bits = block, bits
        self.occupied, self.run_end, self.remainders, self.counters = occupied, run_end, remainders, counters

    @classmethod
    def build(cls, block: int, bits: int, keys: np.ndarray, counts: np.ndarray) -> CountingQuotientFilter:
        """Of the block's distinct fingerprints, sorted, and their counts."""
        rest = 64 - bits - QUOTIENT_BITS
        quotient = ((keys >> np.uint64(rest)) & np.uint64((1 << QUOTIENT_BITS) - 1)).astype(np.int64)
        occupied = np.zeros(1 << QUOTIENT_BITS, bool)
        occupied[quotient] = True
        run_end = np.ones(len(keys), bool)
        run_end[:-1] = quotient[1:] != quotient[:-1]
        return cls(block, bits, occupied, run_end, keys & np.uint64((1 << rest) - 1), counts)

    def fingerprints(self) -> np.ndarray:
        """The whole fingerprints again, sorted."""
        rest = 64 - self.bits - QUOTIENT_BITS
        run = np.concatenate([[0], np.cumsum(self.run_end)[:-1]]).astype(np.int64) if len(self.run_end) else np.zeros(0, np.int64)
        quotient = np.flatnonzero(self.occupied)[run] if len(run) else run
        high = (self.block << QUOTIENT_BITS) | quotient
        return (high.astype(np.uint64) << np.uint64(rest)) | self.remainders

    def merge(self, *others: CountingQuotientFilter) -> CountingQuotientFilter:
        parts = [self, *others]
        return self.build(self.block, self.bits, *summed(np.concatenate([p.fingerprints() for p in parts]), np.concatenate([p.counters for p in parts])))

    def fields(self) -> tuple[bytes, bytes, bytes, bytes]:
        return np.packbits(self.occupied).tobytes(), np.packbits(self.run_end).tobytes(), self.remainders.tobytes(), self.counters.tobytes()

    @classmethod
    def of_fields(cls, block: int, bits: int, fields: tuple[bytes, bytes, bytes, bytes]) -> CountingQuotientFilter:
        remainders = np.frombuffer(fields[2], np.uint64)
        occupied = np.unpackbits(np.frombuffer(fields[0], np.uint8)).astype(bool)
        run_end = np.unpackbits(np.frombuffer(fields[1], np.uint8), count=len(remainders)).astype(bool)
        return cls(block, bits, occupied, run_end, remainders, np.frombuffer(fields[3], np.int64))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    unique, back = np.unique(keys, return_inverse=True)
    out = np.zeros(len(unique), np.int64)
    np.add.at(out, back, counts)
    return unique, out


def blocks_of(keys: np.ndarray, counts: np.ndarray, bits: int) -> Iterator[CountingQuotientFilter]:
    """A filter for each block that sorted distinct fingerprints fall in."""
    block = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(keys) else []
    for a, b in zip(starts, np.append(starts[1:], len(keys)) if len(keys) else [], strict=True):
        yield CountingQuotientFilter.build(int(block[a]), bits, keys[a:b], counts[a:b])


def repeated_fingerprints(fingerprints: DataFrame, column: str = "fp", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The fingerprints that more than one row has, as (``column``, rows)."""
    bits = max(0, int(np.ceil(np.log2(max(1, fingerprints.count()) / block_rows))))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, counts, more = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

        def gathered() -> tuple[np.ndarray, np.ndarray]:
            return summed(np.concatenate([keys, *more]), np.concatenate([counts, np.ones(sum(map(len, more)), np.int64)]))

        for batch in batches:
            more.append(batch[column].to_numpy(np.int64).view(np.uint64))
            if sum(map(len, more)) > max(GATHER_ROWS, len(keys)):
                (keys, counts), more = gathered(), []
        keys, counts = gathered()
        rows = [(f.block, *f.fields()) for f in blocks_of(keys, counts, bits)]
        for k in range(0, len(rows), 1000):
            yield pd.DataFrame(rows[k : k + 1000], columns=["block", "occupied", "run_end", "remainders", "counters"])

    def merge(key: tuple, segments: pd.DataFrame) -> pd.DataFrame:
        parts = [CountingQuotientFilter.of_fields(int(key[0]), bits, tuple(row)) for row in segments[["occupied", "run_end", "remainders", "counters"]].itertuples(index=False)]
        whole = parts[0].merge(*parts[1:])
        many = whole.counters > 1
        return pd.DataFrame({column: whole.fingerprints()[many].view(np.int64), "rows": whole.counters[many]})

    blocks = fingerprints.select(column).mapInPandas(build, "block int, occupied binary, run_end binary, remainders binary, counters binary")
    return blocks.groupBy("block").applyInPandas(merge, f"{column} long, rows long")


def normalised(raw: Column) -> Column:
    return F.regexp_replace(raw, f"[{WHITE}]+", "")


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", broadcast_rows: int = BROADCAST_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when the same after white space ``[\\x20\\x09-\\x0D]`` is
    deleted; null counts as the empty text, and all empty texts are one group.
    The row with the most code points in the original text, then the smallest
    doc_id, stays. Repeated rows with one doc_id count in group_size each and get
    the same answer; a null doc_id sorts after all others. An empty table gives no
    rows; further columns are ignored.
    """
    source = docs.select(docs[doc_id].cast("long").alias("doc_id"), whole_text(docs, text).alias("raw"))
    normal = source.select("doc_id", normalised(F.col("raw")).alias("norm"), F.length("raw").alias("points"))
    narrow = materialize(
        normal.select("doc_id", "points", F.xxhash64("norm").alias("fp"), F.unhex(F.sha2("norm", 256)).alias("sha")), "exact-fp"
    )
    repeated = materialize(repeated_fingerprints(narrow), "exact-rep")

    # Verification: up to a counted bound the repeated fingerprints, and then their groups, go to the rows; beyond it
    # only hot ones do, and the others meet their rows by key. The grouping collapses copies before its own exchange.
    keyed = normal.withColumn("fp", F.xxhash64("norm"))
    small = repeated.count() <= broadcast_rows
    if small:
        candidates = keyed.join(F.broadcast(repeated.select("fp")), "fp", "left_semi")
    else:
        hot, cold = F.broadcast(repeated.where(F.col("rows") > hot_rows).select("fp")), repeated.where(F.col("rows") <= hot_rows).select("fp").hint("merge")
        candidates = keyed.join(hot, "fp", "left_semi").unionByName(keyed.join(hot, "fp", "left_anti").join(cold, "fp", "left_semi"))
    first = F.struct((-F.col("points")).alias("points"), F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("keep"))
    groups = (
        candidates.groupBy("fp", "norm")
        .agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("group_size"))
        .select(F.col("fp").alias("g_fp"), F.unhex(F.sha2("norm", 256)).alias("g_sha"), F.col("first.keep").alias("keep"), "group_size")
    )
    same = lambda g: (narrow.fp == g.g_fp) & (narrow.sha == g.g_sha)
    if small:
        groups = F.broadcast(groups)
        joined = narrow.join(groups, same(groups), "left")
    else:
        groups = materialize(groups, "exact-groups")
        hot, cold = F.broadcast(groups.where(F.col("group_size") > hot_rows)), groups.where(F.col("group_size") <= hot_rows).hint("merge")
        joined = narrow.join(hot, same(hot)).unionByName(narrow.join(hot, same(hot), "left_anti").join(cold, same(cold), "left"))
    grouped = F.col("group_size").isNotNull()
    keep = F.when(grouped, F.col("keep")).otherwise(F.col("doc_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, unchanged, that stay: one of each group of equal texts, by the rule of ``exact_dedup``.

    Of rows that share the id and the normalised text, null ids too, the one of the
    most code points, then of the least text, stays. No rows give none; further columns, of whatever names, stay as they are.
    """
    found = materialize(exact_dedup(docs, text, doc_id).select("doc_id", "text_sha256", "kept"), "exact-found")
    own = docs[doc_id].cast("long")
    gone = found.where("not kept").select(F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_sha")).distinct()
    if found.groupBy("doc_id").count().where("count > 1").isEmpty():  # ids alone tell rows apart
        return docs.join(gone, own.eqNullSafe(gone.gone_id), "left_anti")
    sha = F.sha2(normalised(whole_text(docs, text)), 256)
    out = docs.join(gone, own.eqNullSafe(gone.gone_id) & (sha == gone.gone_sha), "left_anti")
    if found.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1").isEmpty():
        return out
    order = Window.partitionBy(own, sha).orderBy(F.length(whole_text(docs, text)).desc(), docs[text])
    place = fresh_name(docs, "place")
    return out.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).select(*docs.columns)
