"""Products of two sparse relations that share a key, as blocks of matrices inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cells of a dense block, and tasks that are multiplied at once.
CELLS, STRIP = 2_000_000, 128


def codes(*columns: pa.ChunkedArray) -> tuple[list[np.ndarray], pa.Array]:
    """The columns' values as places in one list of distinct values, and that list."""
    whole = pa.chunked_array([c for column in columns for c in column.chunks], columns[0].type).combine_chunks().dictionary_encode()
    places = whole.indices.to_numpy(zero_copy_only=False)
    return np.split(places, np.cumsum([len(c) for c in columns])[:-1]), whole.dictionary


def blocks(lt: np.ndarray, lq: np.ndarray, rt: np.ndarray, rf: np.ndarray, cells: int) -> Iterator[tuple[slice, slice]]:
    """Rows of both sides, each ordered by task, in blocks of consecutive tasks whose queries and files make at most ``cells`` pairs; a task alone beyond that is cut by files."""
    todo = [(0, len(lt), 0, len(rt))]
    while todo:
        a, b, c, d = todo.pop()
        if a == b or c == d:
            continue
        queries = len(np.unique(lq[a:b]))
        if queries * len(np.unique(rf[c:d])) <= cells:
            yield slice(a, b), slice(c, d)
        elif lt[a] == lt[b - 1]:
            first, last = c + np.searchsorted(rt[c:d], [lt[a], lt[a] + 1])  # one row per task and file
            step = max(1, cells // queries)
            yield from ((slice(a, b), slice(k, min(k + step, last))) for k in range(first, last, step))
        else:
            middle = lt[(a + b) // 2] if lt[(a + b) // 2] > lt[a] else lt[a] + 1  # tasks below it on one side
            x, y = a + np.searchsorted(lt[a:b], middle), c + np.searchsorted(rt[c:d], middle)
            todo += [(x, b, y, d), (a, x, c, y)]


def product(lt: np.ndarray, lq: np.ndarray, s: np.ndarray, rt: np.ndarray, rf: np.ndarray, w: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, ...]:
    """Queries, files, and for each pair of them that shares a task the sums of s * w and n and the greatest s * m; those that only nulls (nan) make are nan."""
    queries, q = np.unique(lq, return_inverse=True)
    files, f = np.unique(rf, return_inverse=True)
    shape = len(queries), len(files)
    score, count, known, strongest = np.zeros(shape), np.zeros(shape), np.zeros(shape), np.full(shape, -np.inf)
    tasks = np.unique(lt)
    given = ~np.isnan(w)
    w, m = np.where(given, w, 0.0), np.where(given, m, -np.inf)
    left, right = np.searchsorted(lt, [tasks, tasks + 1]), np.searchsorted(rt, [tasks, tasks + 1])
    for k in range(0, len(tasks), STRIP):
        part = tasks[k : k + STRIP]
        a, b, c, d = left[0][k], left[1][k + len(part) - 1], right[0][k], right[1][k + len(part) - 1]
        x, y = np.searchsorted(part, lt[a:b]), np.searchsorted(part, rt[c:d])
        met = part[np.minimum(y, len(part) - 1)] == rt[c:d]
        y, at = y[met], np.arange(c, d)[met]
        sims, has = np.zeros((shape[0], len(part))), np.zeros((shape[0], len(part)))
        sims[q[a:b], x], has[q[a:b], x] = s[a:b], 1
        dense = np.zeros((len(part), shape[1]))
        dense[y, f[at]] = w[at]
        score += sims @ dense
        dense[y, f[at]] = n[at]
        count += has @ dense
        dense[y, f[at]] = given[at]
        known += has @ dense
        for t in range(k, k + len(part)):
            i, j = slice(left[0][t], left[1][t]), slice(right[0][t], right[1][t])
            if j.start < j.stop:
                cell = np.ix_(q[i], f[j])
                strongest[cell] = np.maximum(strongest[cell], np.outer(s[i], m[j]))
    i, j = np.nonzero(count)
    unknown = known[i, j] == 0
    return queries[i], files[j], np.where(unknown, np.nan, score[i, j]), count[i, j].astype(np.int64), np.where(unknown, np.nan, strongest[i, j])


def products(shared: DataFrame, folded: DataFrame) -> DataFrame:
    """(query, file, score, n, strongest), parts of sums and maxima per query and file: similarity * weight and n summed and similarity * most at its greatest, over tasks of both sides.

    shared: query, task, similarity (positive), one row per query and task; folded: task, file, weight, n, most, one row per task and file. Tasks are dealt into shares by a hash; a share
    multiplies what its queries and files make in blocks of at most ``CELLS`` pairs and hands on a row per pair that meets.
    """
    spark = shared.sparkSession
    shares = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = lambda task: F.pmod(F.xxhash64(task), F.lit(shares)).alias("share")
    schema = T.StructType([shared.schema["query"], folded.schema["file"], T.StructField("score", T.DoubleType()), T.StructField("n", T.LongType()), T.StructField("strongest", T.DoubleType())])

    def multiply(left: pa.Table, right: pa.Table) -> pa.Table:
        (lt, rt), _ = codes(left["task"], right["task"])
        (lq,), queries = codes(left["query"])
        (rf,), files = codes(right["file"])
        values = lambda table, name: pc.cast(table[name], pa.float64()).to_numpy(zero_copy_only=False)
        x, y = np.argsort(lt, kind="stable"), np.argsort(rt, kind="stable")
        lt, lq, s = lt[x], lq[x], values(left, "similarity")[x]
        rt, rf, w, n, m = rt[y], rf[y], values(right, "weight")[y], values(right, "n")[y], values(right, "most")[y]
        parts = [[], [], [], [], []]
        for a, b in blocks(lt, lq, rt, rf, CELLS):
            for column, values_ in zip(parts, product(lt[a], lq[a], s[a], rt[b], rf[b], w[b], n[b], m[b]), strict=True):
                column.append(values_)
        empty = np.empty(0, np.int64)
        q, f, score, n, most = (np.concatenate(c) if c else empty for c in parts)
        return pa.table({"query": queries.take(pa.array(q)), "file": files.take(pa.array(f)), "score": pa.array(score.astype(float), from_pandas=True), "n": pa.array(n), "strongest": pa.array(most.astype(float), from_pandas=True)})

    # both sides may stem from one relation of tasks, so columns are named anew
    left = shared.select("query", F.col("task").alias("l_task"), "similarity").select(share("l_task"), "query", F.col("l_task").alias("task"), "similarity")
    right = folded.select(F.col("task").alias("r_task"), "file", "weight", "n", "most").select(share("r_task"), F.col("r_task").alias("task"), "file", "weight", "n", "most")
    both = left.groupBy("share").cogroup(right.groupBy("share"))
    return both.applyInArrow(multiply, schema)
