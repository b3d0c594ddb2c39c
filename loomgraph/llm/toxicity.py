"""Toxicity: averaged subword embeddings under a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams (hashed into a fixed
table), a window of words the mean of its words, and a linear layer with softmax
gives its class; misspellings share n-grams with what was seen in training. A
document counts as toxic as its most toxic window, so insults in long texts are
not averaged away; training alternates between choosing each toxic document's
window and gradient steps (Adagrad) on table and layer.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import byte_slices, fold_column, whole_text

BUCKETS, DIM = 1 << 17, 12
#: Documents of each label that training reads at most: the stated bound of the sample.
TRAIN_DOCS = 1500
WINDOW, STRIDE = 8, 4
#: Windows of most score of each clean document that a training round reads.
HARD = 3
CACHE_WORDS = 300_000
#: Text that is scored at a time.
SLICE_BYTES = 1_000_000
#: Windows, spread over the whole text, of each toxic document before anything is known.
FIRST = 8
SIZES = (3, 4, 5, 6)
BLOCK_WORDS = 20_000
_EDGES = ".,;:!?\"'()[]{}*#$%&|<>-_"


def words_of(text: str) -> list[str]:
    return [w for w in (x.strip(_EDGES) for x in text.lower().split()) if w]


def word_buckets(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By BLOCK_WORDS words: the buckets of each word's subwords, word after word, and how many each has.

    Subwords are the character n-grams of SIZES of the marked word, by bytes; a word
    shorter than a size is one gram of it. Grams are named by a 32-bit FNV hash.
    """
    for k in range(0, len(words), BLOCK_WORDS):
        marked = [f"<{w}>".encode("utf-8", "surrogatepass") for w in words[k : k + BLOCK_WORDS]]
        length = np.array([len(m) for m in marked], np.int64)
        raw = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint32)
        owner = np.repeat(np.arange(len(marked)), length)
        starts = np.cumsum(length) - length
        left = np.repeat(starts + length, length) - np.arange(len(raw))  # bytes from here to the word's end
        h = np.full(len(raw), 2166136261, np.uint32)
        word, bucket = [], []
        for size in range(1, max(SIZES) + 1):
            ahead = np.zeros(len(raw), np.uint32)
            ahead[: len(raw) - size + 1] = raw[size - 1 :]
            h = (h ^ ahead) * np.uint32(16777619)
            if size not in SIZES:
                continue
            named = ((h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1)).astype(np.int32)
            fit = np.flatnonzero(left >= size)
            whole = np.repeat(np.flatnonzero(length == size), sum(s > size for s in SIZES))
            word += [owner[fit], whole]
            bucket += [named[fit], named[starts[whole]]]
        at = np.concatenate(word)
        yield np.concatenate(bucket)[np.argsort(at, kind="stable")], np.bincount(at, minlength=len(marked))


def windows(n: int) -> list[tuple[int, int]]:
    """Overlapping windows over n words; one (perhaps empty) window at least."""
    return [(k, min(n, k + WINDOW)) for k in range(0, max(1, n - (WINDOW - STRIDE)), STRIDE)]


class SubwordSoftmax:
    def __init__(self, table: np.ndarray, layer: np.ndarray, bias: np.ndarray):
        self.table, self.layer, self.bias = table, layer, bias

    def bucket_logits(self) -> tuple[np.ndarray, float]:
        """The layer applied to the table: for two classes all of a text's score is a mean of these."""
        return (self.table @ (self.layer[:, 1] - self.layer[:, 0])).astype(np.float32), float(self.bias[1] - self.bias[0])

    @classmethod
    def fit(cls, texts: list[str], labels: list[int], rounds: int = 8, rate: float = 0.25, seed: int = 7) -> SubwordSoftmax:
        rng = np.random.default_rng(seed)
        table = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        layer = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32)
        bias = np.zeros(2, np.float32)
        if not any(map(words_of, texts)):
            return cls(table * 0, layer, bias)
        vocabulary: dict[str, int] = {}
        docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)], np.int64) for t in texts]
        flat, sizes = (np.concatenate(x) for x in zip(*word_buckets(list(vocabulary)), strict=True))
        starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        share = 1 / np.maximum(sizes, 1)
        spans = [[(k, a, b) for a, b in windows(len(d))] for k, d in enumerate(docs) if len(d)]
        y = np.array(labels)
        square = [np.full(BUCKETS, 1e-6, np.float32), np.full((DIM, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)]
        word_logit = np.zeros(len(vocabulary), np.float64)
        for turn in range(rounds):
            if turn:
                per_bucket = table @ (layer[:, 1] - layer[:, 0])
                word_logit = np.add.reduceat(per_bucket[flat], starts[:-1]) * share
            chosen = []
            for windows_of_doc in spans:
                k = windows_of_doc[0][0]
                sums = np.concatenate([[0], np.cumsum(word_logit[docs[k]])])
                score = [(sums[b] - sums[a]) / (b - a) for _, a, b in windows_of_doc]
                top = int(np.argmax(score)) if turn else int(rng.integers(len(score)))
                picks = {top} if y[k] else {*np.argsort(score)[-HARD:].tolist(), int(rng.integers(len(score)))} if turn else {top}
                if turn == 0 and y[k]:
                    picks = {round(x) for x in np.linspace(0, len(score) - 1, FIRST).tolist()}
                chosen += [windows_of_doc[p] for p in picks]
            order = rng.permutation(len(chosen))
            for at in range(0, len(order), 128):
                batch = [chosen[i] for i in order[at : at + 128]]
                tokens = np.concatenate([docs[k][a:b] for k, a, b in batch])
                owner = np.repeat(np.arange(len(batch)), [b - a for _, a, b in batch])
                weight = 1 / np.array([b - a for _, a, b in batch], np.float64)
                n = sizes[tokens]
                index = np.repeat(starts[tokens] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                bucket = flat[index]
                own = np.repeat(owner, n)
                scale = (np.repeat(share[tokens], n) * weight[own]).astype(np.float32)
                # mean vectors of the windows
                edges = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1])
                mean = np.add.reduceat(table[bucket] * scale[:, None], edges)
                truth = np.eye(2, dtype=np.float32)[y[[k for k, _, _ in batch]]]
                z = mean @ layer + bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                error = (p - truth) / len(batch)
                to_layer, to_bias = mean.T @ error, error.sum(0)
                to_mean = error @ layer.T
                # gradient of the table, bucket by bucket
                touched, back = np.unique(bucket, return_inverse=True)
                gradient = np.stack([np.bincount(back, scale * to_mean[own, d], len(touched)) for d in range(DIM)], axis=1).astype(np.float32)
                square[0][touched] += (gradient**2).mean(1)
                table[touched] -= rate * gradient / np.sqrt(square[0][touched])[:, None]
                square[1] += to_layer**2
                square[2] += to_bias**2
                layer -= rate * to_layer / np.sqrt(square[1])
                bias -= rate * to_bias / np.sqrt(square[2])
        return cls(table, layer, bias)


class Scorer:
    """Scores of whole texts, with a bounded cache of the words' logits."""

    def __init__(self, bucket_logit: np.ndarray, bias: float, shift: float = 0.0):
        self.bucket_logit, self.bias, self.shift, self.cache = bucket_logit, bias, shift, {}

    def learn(self, words: list[str]) -> None:
        """The logits of words as they stand in a text; NaN for one that has nothing but marks."""
        bare = [w.strip(_EDGES) for w in words]
        own = sorted(set(bare) - {""})
        value = dict.fromkeys(["", *own], np.nan)
        for k, (flat, sizes) in enumerate(word_buckets(own)):
            sums = np.add.reduceat(self.bucket_logit[flat].astype(np.float64), np.cumsum(sizes) - sizes)
            value.update(zip(own[k * BLOCK_WORDS : (k + 1) * BLOCK_WORDS], (sums / sizes).tolist(), strict=True))
        self.cache.update(zip(words, map(value.__getitem__, bare), strict=True))

    def logits(self, texts: list[str]) -> np.ndarray:
        """The most of each text's windows; a low constant for texts without words."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        split = [t.lower().split() for t in texts]
        self.learn(list(set().union(*split).difference(self.cache)))
        sizes = np.array([len(x) for x in split], np.int64)
        values = np.fromiter(map(self.cache.__getitem__, chain.from_iterable(split)), np.float64, int(sizes.sum()))
        own = ~np.isnan(values)
        sizes = np.bincount(np.repeat(np.arange(len(texts)), sizes)[own], minlength=len(texts))
        sums = np.concatenate([[0.0], np.cumsum(values[own])])
        out = np.full(len(texts), -8.0 if self.bias > -8 else self.bias)
        full = np.flatnonzero(sizes)
        if len(full):
            ends, n = np.cumsum(sizes)[full], sizes[full]
            count = -(-np.maximum(1, n - (WINDOW - STRIDE)) // STRIDE)
            first = np.cumsum(count) - count
            a = np.repeat(ends - n, count) + STRIDE * (np.arange(count.sum()) - np.repeat(first, count))
            b = np.minimum(np.repeat(ends, count), a + WINDOW)
            out[full] = np.maximum.reduceat((sums[b] - sums[a]) / (b - a), first) + self.bias - self.shift
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(texts), -30, 30)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, per_label: int, text: str = "text", doc_id: str = "doc_id") -> tuple[list[str], list[int]]:
    """At most ``per_label`` training documents of each label, the first by a hash of the id, fold 0 left out.

    Repeated labels count once; an id with both labels has none. Of an id's several texts the least is read.
    """
    marks = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label].cast("int").alias("y")).where(F.col("y").isin(0, 1) & (fold_column(F.col("doc_id"), folds) != 0))
    marks = marks.where("doc_id is not null").groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("y2")).where("y = y2").drop("y2")
    chosen = None
    for y in (0, 1):  # orderBy + limit keeps per_label rows a partition: no shuffle of the rest
        part = marks.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
        chosen = part if chosen is None else chosen.unionByName(part)
    source = docs.select(docs[doc_id].cast("long").alias("doc_id"), whole_text(docs, text).alias("raw"))
    # the sample's size is bounded by 2 * per_label ids
    rows = source.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("raw").alias("raw")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return [r["raw"] for r in rows], [r["y"] for r in rows]


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, per_label: int = TRAIN_DOCS, text: str = "text", doc_id: str = "doc_id") -> Scorer:
    """A scorer of the labels; where no label says toxic, or none says clean, or either table is empty, nothing is found toxic."""
    texts, y = labelled_sample(docs, labels, "toxic", folds, per_label, text, doc_id)
    if len(set(y)) < 2:
        return Scorer(np.zeros(BUCKETS, np.float32), -8.0)
    keep = [i for i in range(len(y)) if i % 5] if min(y.count(0), y.count(1)) >= 20 else list(range(len(y)))
    model = SubwordSoftmax.fit([texts[i] for i in keep], [y[i] for i in keep])
    scorer = Scorer(*model.bucket_logits())
    aside = sorted(set(range(len(y))) - set(keep))
    if aside:  # the cut of least error on training documents kept aside, a clean one found toxic weighing four times a toxic one missed
        logits = scorer.logits([texts[i] for i in aside])
        truth = np.array([y[i] for i in aside])
        order = np.sort(logits)
        cuts = (order[1:] + order[:-1]) / 2
        wrong = [((logits >= c) & (truth == 0)).sum() * 4 / max(1, (truth == 0).sum()) + ((logits < c) & (truth == 1)).sum() / max(1, (truth == 1).sum()) for c in cuts]
        least = np.flatnonzero(np.array(wrong) <= min(wrong) + 1e-9)
        scorer.shift = float(cuts[least[len(least) // 2]])
    scorer.cache.clear()  # the driver keeps the model alone
    return scorer


def score_column(spark: SparkSession, scorer: Scorer):
    """A vectorised function from text to score. The model it ships has a fixed size (BUCKETS numbers)."""
    shared = spark.sparkContext.broadcast((scorer.bucket_logit, scorer.bias, scorer.shift))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Scorer(*shared.value)
        for batch in batches:
            slices = [own.scores(batch.iloc[a:b].tolist()) for a, b in byte_slices(batch, SLICE_BYTES)]
            yield pd.Series(np.concatenate([np.zeros(0), *slices]), dtype="float64")

    return score


def score_documents(docs: DataFrame, scorer: Scorer, folds: int = 5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score, predicted per row.

    Null texts are empty; texts without words get a low constant score. Rows are
    independent, so repeats and ties get equal scores; a null id keeps its row; an
    empty table gives no rows; further columns are ignored.
    """
    ids = docs[doc_id].cast("long")
    scored = docs.select(ids.alias("doc_id"), score_column(docs.sparkSession, scorer)(whole_text(docs, text)).alias("score"))
    return scored.select("doc_id", (fold_column(F.col("doc_id"), folds) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, scorer: Scorer, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, unchanged, whose score is under ``threshold``: null texts as empty ones, every row by its own text whatever its id."""
    return docs.where(score_column(docs.sparkSession, scorer)(whole_text(docs, text)) < threshold)
