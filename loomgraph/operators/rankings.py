"""The best documents of each query, chosen inside tasks: no row is formed per query and document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.operators import search as S
from loomgraph.operators.cut import cut

#: Cells (documents by queries) and gains that are summed at once, documents that are split at once, and best rows that a task holds before it drops the others.
CELLS, GAINS, DOCS, HELD = 1_000_000, 1_000_000, 500, 200_000
#: Places in all rankings of a task; more queries than make so many are scored by shuffles.
PLACES = 200_000
#: Terms are runs of a-z and 0-9 in the bytes of lower-cased text; all else parts them.
PARTS = bytes(b if b in b"abcdefghijklmnopqrstuvwxyz0123456789" else 32 for b in range(256))
#: Names of the sums beside terms' document frequencies, which count from 1.
ROWS, TEXTS, LENGTH = 0, -1, -2


def counted(batches: Iterator[pa.RecordBatch], places: dict[bytes, int], docs: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per ``docs`` rows (doc, text): their docs, and lengths in terms (-1: null); row, place and count of each of their terms that has a place (from 1), by row and place."""
    width = len(places) + 1
    for batch in batches:
        for at in range(0, batch.num_rows, docs):
            part = batch.slice(at, docs)
            lengths, met, known = [], [], []
            for text in part.column(1).cast(pa.large_binary()).to_pylist():
                words = [] if text is None else text.translate(PARTS).split()
                found = list(filter(None, map(places.get, words)))
                lengths.append(-1 if text is None else len(words))
                known.append(len(found))
                met += found
            keys, tf = np.unique(np.repeat(np.arange(len(known)) * width, known) + np.array(met, np.int64), return_counts=True)
            yield part.column(0), np.array(lengths, np.int64), keys // width, keys % width, tf


class Best:
    """The first ``k`` rows of each of ``n`` queries by key descending, then doc."""

    def __init__(self, n: int, k: int, held: int):
        self.k, self.rows, self.held, self.most = k, [], 0, max(held, 4 * n * k)
        self.key, self.doc = np.full(n, np.iinfo(np.int64).min), np.full(n, np.iinfo(np.int64).max)  # of the last of k rows

    def add(self, q: np.ndarray, key: np.ndarray, doc: np.ndarray, score: np.ndarray, met: np.ndarray) -> None:
        least = self.key[q]
        new = np.flatnonzero(key >= least)
        new = new[(key[new] > least[new]) | (doc[new] < self.doc[q[new]])]
        self.rows.append(tuple(c[new] for c in (q, key, doc, score, met)))
        self.held += len(new)
        if self.held > self.most:
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        q, key, doc, score, met = (np.concatenate(c) for c in zip(*self.rows, strict=True))
        order = np.lexsort((doc, -key, q))
        place = np.arange(len(q)) - np.searchsorted(q[order], q[order])
        last = order[place == self.k - 1]
        self.key[q[last]], self.doc[q[last]] = key[last], doc[last]
        kept = order[place < self.k]
        self.rows, self.held = [tuple(c[kept] for c in (q, key, doc, score, met))], len(kept)
        return self.rows[0]


def first(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query", "by").orderBy(F.desc("key"), "doc")
    return rows.select("by", "query", "doc", "score", "met", F.row_number().over(order).cast("long").alias("rank")).where(F.col("rank") <= k)


def ranked(docs: DataFrame, queries: DataFrame, k: int, by: tuple[str, ...] = ("score",), all_terms: bool = False) -> DataFrame:
    """(by, query, doc, score, met, rank): the first ``k`` documents (doc, text) of each query by BM25's score, rounded to six places, or by the number of its terms that they have (``met``); ties by doc.

    What ``search.bm25`` followed by ``search.top_k`` returns. Texts are read twice and never shuffled: for the document frequencies of the queries' terms, then for scores, of
    which a task hands on its own first ``k`` a query. Documents whose ids repeat, are null or no whole numbers, and queries beyond the counted bounds, are scored by shuffles.
    """
    asked = cut(S.asked_terms(queries.where("query is not null") if all_terms else queries))  # a join by query counts the terms of all, which nulls do not meet
    n = asked.select("query").distinct().count()
    whole = isinstance(docs.schema["doc"].dataType, T.IntegralType)
    near = whole and n * k * len(by) <= PLACES and asked.limit(S.HANDED_WORDS + 1).count() <= S.HANDED_WORDS
    if not near or docs.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc is null").limit(1).count():
        each = F.explode(F.array(*(F.struct(F.lit(name).alias("by"), F.round(F.col(name).cast("double"), 6).alias("key")) for name in by))).alias("run")
        return first(S.bm25(docs, queries, all_terms=all_terms).select("query", "doc", "score", "met", each).select("*", "run.by", "run.key"), k)

    schema = T.StructType([T.StructField("by", T.StringType()), T.StructField("query", asked.schema["query"].dataType), *(T.StructField(c, T.DoubleType() if c == "score" else T.LongType()) for c in ("doc", "score", "met", "key"))])
    if not n:
        return first(docs.sparkSession.createDataFrame([], schema), k)
    wanted = asked.toArrow()  # at most ``HANDED_WORDS`` rows
    terms = wanted["term"].to_pylist()
    places = {term.encode(): i for i, term in enumerate(sorted(set(terms)), 1)}
    names = wanted["query"].combine_chunks().dictionary_encode("encode")
    term, query = np.array([places[t.encode()] for t in terms], np.int64), names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(term, kind="stable")
    asking, asking_at = query[order], np.searchsorted(term[order], np.arange(len(places) + 2))  # queries by their term's place, and where each place's begin
    needed = np.bincount(query, minlength=n) if all_terms else np.ones(n, np.int64)
    names, kind = names.dictionary, wanted.schema.field("query").type

    sizes = CELLS, GAINS, DOCS, HELD
    read = docs.select("doc", F.lower("text").alias("text"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows, texts, length = np.zeros(len(places) + 1, np.int64), 0, 0, 0
        for _, lengths, _, at, _ in counted(batches, places, sizes[2]):
            df += np.bincount(at, minlength=len(df))
            rows, texts, length = rows + len(lengths), texts + int((lengths >= 0).sum()), length + int(lengths[lengths > 0].sum())
        found = np.flatnonzero(df)
        yield pa.record_batch({"place": pa.array(np.concatenate([[ROWS, TEXTS, LENGTH], found])), "n": pa.array(np.concatenate([[rows, texts, length], df[found]]))})

    total = {r["place"]: r["n"] for r in read.mapInArrow(sums, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()}  # a row per term of the queries
    df = np.array([total.get(i, 0) for i in range(len(places) + 1)])
    idf = np.log(1 + (total.get(ROWS, 0) - df + 0.5) / (df + 0.5))
    mean = total.get(LENGTH, 0) / max(total.get(TEXTS, 0), 1)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = {name: Best(n, k, sizes[3]) for name in by}
        for docs_, lengths, row, at, tf in counted(batches, places, sizes[2]):
            ids = docs_.cast(pa.int64()).to_numpy(zero_copy_only=False)
            gain = idf[at] * tf * (S.K1 + 1) / (tf + S.K1 * (1 - S.B + S.B * lengths[row] / (mean or 1.0)))
            fan = asking_at[at + 1] - asking_at[at]
            ends = np.searchsorted(row, np.arange(len(ids) + 1))  # terms before each row
            before = np.concatenate([[0], np.cumsum(fan)])[ends]
            a = 0
            while a < len(ids):
                b = max(a + 1, min(a + sizes[0] // n, int(np.searchsorted(before, before[a] + sizes[1], side="right")) - 1))
                part = slice(ends[a], ends[b])
                reps = fan[part]
                owner = np.repeat(np.arange(part.start, part.stop), reps)
                nth = np.arange(len(owner)) - np.repeat(np.cumsum(reps) - reps, reps)
                cell = (row[owner] - a) * n + asking[asking_at[at[owner]] + nth]
                score, met = np.bincount(cell, gain[owner], (b - a) * n), np.bincount(cell, minlength=(b - a) * n)
                found = np.flatnonzero((met > 0) & (met >= np.tile(needed, b - a)))
                score, met, q, doc = score[found], met[found], found % n, ids[a + found // n]
                for name, top in tops.items():
                    top.add(q, np.floor(score * 1e6 + 0.5).astype(np.int64) if name == "score" else met, doc, score, met)
                a = b
        for name, top in tops.items():
            if top.rows:
                q, key, doc, score, met = top.cut()
                yield pa.record_batch({"by": pa.array([name] * len(q), pa.string()), "query": names.take(pa.array(q)).cast(kind), "doc": pa.array(doc), "score": pa.array(score), "met": pa.array(met), "key": pa.array(key)})

    return first(read.mapInArrow(best, schema), k)
