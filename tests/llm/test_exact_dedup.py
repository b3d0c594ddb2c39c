import hashlib
import random
import re
from collections import defaultdict

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from pyspark.sql import functions as F

from loomgraph.llm.exact_dedup import CountingQuotientFilter, blocks_of, drop_copies, exact_dedup, repeated_fingerprints


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t or ""))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        out += [(i, keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for i, _ in members]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


def test_matches_brute_force_on_odd_rows(frame, odd):
    from tests.llm.conftest import ODD

    assert rows_of(exact_dedup(odd)) == brute(ODD)


def test_both_ways_of_verification_agree(frame):
    rnd = random.Random(1)
    rows = [(i, rnd.choice(["a b", "ab", "a  b ", "c", "", None, "d e f"]) if rnd.random() < 0.7 else f"own {i}") for i in range(400)]
    assert rows_of(exact_dedup(frame(rows))) == rows_of(exact_dedup(frame(rows), broadcast_rows=0)) == rows_of(exact_dedup(frame(rows), broadcast_rows=0, hot_rows=30)) == brute(rows)


def test_empty_table(frame):
    assert exact_dedup(frame([])).count() == 0


@given(st.lists(st.lists(st.integers(0, 2**64 - 1) | st.sampled_from([0, 1, 2**63, 2**64 - 1]), max_size=40), min_size=1, max_size=4))
def test_filters_merge_without_loss(parts):
    bits = 3
    merged = {}
    for p in parts:
        for f in blocks_of(*np.unique(np.array(p, np.uint64), return_counts=True), bits):
            f = CountingQuotientFilter.of_fields(f.block, bits, f.fields())
            merged[f.block] = merged[f.block].merge(f) if f.block in merged else f
    values, counts = np.unique(np.array([x for p in parts for x in p], np.uint64), return_counts=True)
    whole = [merged[b] for b in sorted(merged)]
    assert [x for f in whole for x in f.fingerprints().tolist()] == values.tolist() and [x for f in whole for x in f.counters.tolist()] == counts.tolist()


def test_many_blocks_and_gatherings_agree(spark, frame, monkeypatch):
    rnd = random.Random(3)
    rows = [(i, f"t {rnd.randrange(700)}" if i % 3 else "hot") for i in range(3000)]
    keys = frame(rows).repartition(3).select(F.xxhash64("text").alias("fp"))
    want = sorted((r["fp"], r["n"]) for r in keys.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").collect())
    monkeypatch.setattr("loomgraph.llm.exact_dedup.GATHER_ROWS", 100)
    for block_rows in (1, 50, 10**6):
        assert sorted(map(tuple, repeated_fingerprints(keys, block_rows=block_rows).collect())) == want


def test_ids_at_both_ends(frame):
    rows = [(-(2**63), "a b"), (2**63 - 1, "ab"), (0, "c"), (None, "c"), (None, None)]
    assert rows_of(exact_dedup(frame(rows))) == brute(rows)


def test_one_row_of_each_group_stays(frame):
    for rows, stay in (
        ([(1, "same text"), (3, "same text"), (3, "third")], [(1, "same text"), (3, "third")]),
        ([(1, "ab"), (1, "a b"), (1, "a  b"), (2, "ab")], [(1, "a  b")]),
        ([(None, "x"), (None, "x "), (None, None), (None, "")], [(None, None), (None, "x ")]),
        ([(7, "t"), (7, "t")], [(7, "t")]),
        ([], []),
    ):
        docs = frame(rows)
        kept = drop_copies(docs)
        assert kept.columns == docs.columns
        assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted(stay, key=repr)
