"""Vector codes against a plain k-means, exact ties, odd rows."""

import hashlib
import math

import numpy as np
import pytest

from loomgraph.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", "y") for i, v, y in rows], SCHEMA)


def plain(rows, parts=4, entries=256, rounds=4, scale=1024):
    """Python integers, one loop per thing that the contract says."""
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    kept = [(i, [math.floor(scale * x) for x in np.float32(v).tolist()], y) for i, v, y in sorted((r for r in rows if r[1] is not None), key=lambda r: (*order(r)[:2], [x if x is not None else 0 for x in r[1]])) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = -(-max(len(v) for _, v, _ in kept) // parts)
    kept = [(i, v + [0] * (parts * width - len(v)), y) for i, v, y in kept]
    cut = lambda v: [v[k * width : (k + 1) * width] for k in range(parts)]
    seeds = kept[:entries]
    books = [[cut(v)[k] for _, v, _ in seeds] for k in range(parts)]
    distance = lambda x, c: sum((p - q) ** 2 for p, q in zip(x, c, strict=True))
    near = lambda x, book: min(range(len(book)), key=lambda j: (distance(x, book[j]), j))
    for _ in range(rounds):
        for k in range(parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(near(cut(v)[k], books[k]), []).append(cut(v)[k])
            books[k] = [[sum(c) // len(groups[j]) for c in zip(*groups[j], strict=True)] if j in groups else e for j, e in enumerate(books[k])]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    out = []
    for i, v, y in kept:
        found = [near(x, books[k]) for k, x in enumerate(cut(v))]
        out.append((i, "".join(f"{j:02x}" for j in found), sum(distance(x, books[k][j]) for k, (x, j) in enumerate(zip(cut(v), found, strict=True))), y))
    of = {y: sum(r[2] for r in out if r[3] == y) for y in {r[3] for r in out}}
    return sorted(((i, c, e, of[y], digest) for i, c, e, y in out), key=str)


def test_search_equals_all_distances():
    rng = np.random.default_rng(0)
    for _ in range(40):
        d, k, n, r = int(rng.integers(1, 20)), int(rng.integers(1, 256)), int(rng.integers(1, 1500)), int(rng.choice([2, 50, 1000]))
        v, b = rng.integers(-r, r, (n, d)), rng.integers(-r, r, (k, d))  # small ranges make ties
        index, error = V.nearest(v, b)
        every = ((v[:, None, :] - b[None]) ** 2).sum(2)
        assert (index == every.argmin(1)).all() and (error == every.min(1)).all()


@pytest.mark.parametrize("n, broadcast", [(300, 200_000), (12, 0)])
def test_codes_equal_plain_k_means(spark, n, broadcast):
    rng = np.random.default_rng(n)
    rows = [(int(k * 7 % n), (rng.normal(size=8) / 4).astype("float32").tolist(), None if k % 5 == 0 else k % 3) for k in range(n)]
    rows += [(3, [0.0] * 8, 1), (3, [0.0] * 8, 1), (None, [-0.5] * 8, None), (4, None, 1), (5, [math.nan] + [0.0] * 7, 1), (6, [None] * 8, 1), (7, [math.inf] * 8, 2), (8, [0.25] * 6, 9), (9, [], 2)]
    got = V.compress(frame(spark, rows), broadcast_rows=broadcast, entries=16).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows, entries=16)


def test_empty_tables_and_large_components(spark):
    empty = frame(spark, [])
    assert V.compress(empty).collect() == [] and V.compress(frame(spark, [(1, None, 1)])).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert [tuple(r)[:4] for r in V.compress(frame(spark, [(1, [], 1)])).collect()] == [(1, "00000000", 0, 0)]
    with pytest.raises(ValueError):
        V.compress(frame(spark, [(1, [1e30] * 8, 1)]))


def test_decoding_gives_the_entries(spark):
    rows = [(k, [k / 8.0] * 4 + [1.0] * 4, 0) for k in range(6)]
    vectors = frame(spark, rows)
    books = V.train_codebooks(vectors)
    back = V.decode_codes(V.encode_vectors(vectors, books), books)
    assert {r["vec_id"]: r["vector"] for r in back.collect()} == {i: v for i, v, _ in rows}  # as many entries as vectors: nothing is lost
