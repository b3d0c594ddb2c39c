"""Quality classifier: Bradley-Terry pairwise ranking over document features.

Preference pairs set a good document against a bad one; the logistic loss on the
difference of their features gives a linear strength, whose quantile at the share
of bad documents in training is the threshold. Scores are placed so that the
threshold falls on 0.3.

All labelled training documents are learnt from. Features are computed once, for
training and for scores. Shards of documents, dealt by a hash of the id, each fit
their pairs on features that all of them centre and scale alike; the model is the
mean of their weights, and the threshold is an exact quantile of all strengths.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import fold_column, materialize, whole_text

#: Documents that one shard learns from.
SHARD_DOCS = 20_000
#: Documents of the rarer label that a shard should have; if they don't reach, every shard has all of them.
RARE_DOCS = 50
#: Bins of the counts that narrow a quantile down, and values from which on it is looked up.
BINS, FEW_VALUES = 4096, 20_000
FEATURES = 16
THRESHOLD = 0.3
_SYMBOLS = str.maketrans("", "", "#*$%&|<>!?~^=+@_\\/{}[]")
_ENDS = re.compile(r"[.!?…]")


def features(text: str) -> list[float]:
    """Shares and rates of one whole text; all bounded, and defined for the empty text."""
    n = len(text)
    words = text.split()
    m = len(words)
    if not m:
        return [0.0] * FEATURES
    letters = sum(map(len, words))
    symbols = n - len(text.translate(_SYMBOLS))
    bars = text.count("|") / m
    shouts = text.count("!") / m
    upper = sum(w.isupper() and len(w) > 1 for w in words) / m
    odd = sum(not w[-1].isalnum() and w[-1] not in ".,;:" for w in words) / m
    bare = sum(not any(c.isalnum() for c in w[:3]) for w in words) / m
    distinct = len(set(words)) / m
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False)) / m
    pairs = len(set(zip(words, words[1:], strict=False))) / max(1, m - 1)
    runs = [tuple(words[k : k + 5]) for k in range(m - 4)]
    fives = len(set(runs)) / len(runs) if runs else 1.0
    lines = [x for x in text.split("\n") if x.strip()]
    line_repeat = 1 - len(set(lines)) / max(1, len(lines))
    digits = sum(w.isdigit() for w in words) / m
    mean = min(letters / m, 20) / 10
    short = 1.0 if m < 10 else 0.0
    ends = min(1.0, len(_ENDS.findall(text)) / m * 5)
    return [min(1.0, symbols / letters * 4), min(1.0, bars), min(1.0, shouts), upper, odd, bare, distinct, repeats, pairs, fives, line_repeat, digits, mean, short, ends, min(1.0, np.log1p(m) / 10)]


def expand(rows: np.ndarray) -> np.ndarray:
    """Features and their square roots: a small share of junk weighs too."""
    return np.hstack([rows, np.sqrt(np.clip(rows, 0, None))])


def fit_pairs(x: np.ndarray, labels: np.ndarray, pairs: int = 60_000, steps: int = 400, ridge: float = 1e-4, seed: int = 11) -> np.ndarray:
    """Weights from random pairs of a good row and a bad one; every row of ``x`` is in a pair."""
    rng = np.random.default_rng(seed)
    good, bad = (rng.permutation(np.flatnonzero(labels == y)) for y in (1, 0))
    pairs = max(pairs, len(good), len(bad))
    difference = x[np.resize(good, pairs)] - x[rng.permutation(np.resize(bad, pairs))]
    weights = np.zeros(x.shape[1])
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for t in range(1, steps + 1):  # Adam on the whole batch of pairs
        p = 1 / (1 + np.exp(np.clip(difference @ weights, -30, 30)))
        gradient = -(p @ difference) / pairs + ridge * weights
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        weights -= 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return weights


class BradleyTerry:
    def __init__(self, center: np.ndarray, scale: np.ndarray, weights: np.ndarray, threshold: float, sharpness: float = 1.0):
        self.center, self.scale, self.weights, self.threshold, self.sharpness = center, scale, weights, threshold, sharpness

    def strength(self, rows: np.ndarray) -> np.ndarray:
        return ((expand(rows) - self.center) / self.scale) @ self.weights

    def score(self, rows: np.ndarray) -> np.ndarray:
        z = self.sharpness * (self.strength(rows) - self.threshold) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    @classmethod
    def fit(cls, rows: np.ndarray, labels: np.ndarray, share_bad: float, pairs: int = 60_000, steps: int = 400, ridge: float = 1e-4, seed: int = 11) -> BradleyTerry:
        """``share_bad``: of the population; the sample's classes may be balanced otherwise."""
        wide = expand(rows) if len(rows) else np.zeros((1, 32))
        center, scale = wide.mean(0), wide.std(0) + 1e-3
        good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
        weights = np.zeros(wide.shape[1])
        if not len(good) or not len(bad):
            return cls(center, scale, weights, -1.0 if len(good) or not len(bad) else 1.0)
        x = (wide - center) / scale
        weights = fit_pairs(x, labels, pairs, steps, ridge, seed)
        strengths = x @ weights
        # quantile of the population's strengths: the sample's rows weighted to its shares
        w = np.where(labels == 1, (1 - share_bad) / len(good), share_bad / len(bad))
        order = np.argsort(strengths, kind="stable")
        cumulated = np.cumsum(w[order])
        at = min(len(order) - 1, int(np.searchsorted(cumulated, share_bad)))
        low = max(0, at - 1)
        return cls(center, scale, weights, float((strengths[order[at]] + strengths[order[low]]) / 2))


def describe(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, features) of every row's whole text, kept in the shared folder: 16 numbers a row."""

    @F.pandas_udf("array<double>")
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([features(t) for t in batch], dtype=object)

    return materialize(docs.select(docs[doc_id].cast("long").alias("doc_id"), measured(whole_text(docs, text)).alias("features")), "quality-features")


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64).reshape(len(column), FEATURES)


def labelled(described: DataFrame, labels: DataFrame, folds: int) -> DataFrame:
    """(doc_id, y, features) of all labelled documents but fold 0.

    Repeated labels count once; an id with both labels has none. Of an id's several texts the one of the least features is read.
    """
    marks = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("y")).where(F.col("y").isin(0, 1) & (fold_column(F.col("doc_id"), folds) != 0))
    marks = marks.where("doc_id is not null").groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("y2")).where("y = y2").drop("y2")
    return materialize(described.join(marks, "doc_id").groupBy("doc_id", "y").agg(F.min("features").alias("features")), "quality-labelled")


def moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of the expanded features, from sums per partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(1 + 4 * FEATURES)
        for batch in batches:
            wide = expand(matrix(batch["features"]))
            sums += np.concatenate([[len(wide)], wide.sum(0), (wide**2).sum(0)])
        yield pd.DataFrame({"place": range(len(sums)), "value": sums})

    found = rows.select("features").mapInPandas(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    sums = np.zeros(1 + 4 * FEATURES)
    for r in found:
        sums[r["place"]] = r["value"]
    mean, square = np.split(sums[1:] / max(1, sums[0]), 2)
    return mean, np.sqrt(np.maximum(0, square - mean**2)) + 1e-3


def value_at(values: DataFrame, rank: int) -> float:
    """The exact value of column ``v`` that ``rank`` others come before, by counts in ever finer bins."""
    low, high, n = values.agg(F.min("v"), F.max("v"), F.count("v")).first()
    while low < high and n > FEW_VALUES:
        place = F.floor((F.col("v") - F.lit(low)) / F.lit(high - low) * (BINS - 1))
        for r in sorted(values.where(F.col("v").between(low, high)).groupBy(place.alias("place")).agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect(), key=lambda r: r["place"]):
            if rank < r["n"]:
                low, high, n = r["low"], r["high"], r["n"]
                break
            rank -= r["n"]
    if low == high:
        return low
    return sorted(r["v"] for r in values.where(F.col("v").between(low, high)).collect())[rank]


def train_described(described: DataFrame, labels: DataFrame, folds: int = 5) -> BradleyTerry:
    """A model of the labels, from all documents that ``labelled`` gives; with one label alone, all documents score on its side of the threshold, and so they do, as good ones, without any."""
    rows = labelled(described, labels, folds)
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    center, scale = moments(rows)
    if len(counts) < 2:
        return BradleyTerry(center, scale, np.zeros(2 * FEATURES), 1.0 if 0 in counts else -1.0)
    shards = -(-sum(counts.values()) // SHARD_DOCS)
    rare = min(counts, key=counts.get)
    # a label of few rows goes to as many shards as give each about RARE_DOCS of it: one where there are enough
    copies = min(shards, max(1, -(-RARE_DOCS * shards // counts[rare])))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("doc_id")
        y = part["y"].to_numpy()
        if len(set(y.tolist())) < 2:
            return pd.DataFrame({"shard": [int(key[0])], "n": [0], "weights": [[0.0] * 2 * FEATURES]})
        return pd.DataFrame({"shard": [int(key[0])], "n": [len(part)], "weights": [fit_pairs((expand(matrix(part["features"])) - center) / scale, y).tolist()]})

    first, last = F.xxhash64("doc_id"), F.when(F.col("y") == rare, F.lit(copies - 1)).otherwise(F.lit(0))
    dealt = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), last))).withColumn("shard", F.pmod(first + F.col("copy"), F.lit(shards))).drop("copy")
    fitted = sorted(dealt.groupBy("shard").applyInPandas(run, "shard int, n long, weights array<double>").collect(), key=lambda r: r["shard"])
    weights = np.average([r["weights"] for r in fitted], axis=0, weights=[r["n"] for r in fitted])
    model = BradleyTerry(center, scale, weights, 0.0)

    @F.pandas_udf("double")
    def strength(column: pd.Series) -> pd.Series:
        return pd.Series(model.strength(matrix(column)), dtype="float64")

    strengths = materialize(rows.select(strength("features").alias("v")), "quality-strengths")
    # as many documents are below the threshold as are bad
    threshold = (value_at(strengths, counts[0] - 1) + value_at(strengths, counts[0])) / 2
    return BradleyTerry(center, scale, weights, threshold)


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, text: str = "text", doc_id: str = "doc_id") -> BradleyTerry:
    return train_described(describe(docs, text, doc_id), labels, folds)


def score_column(spark: SparkSession, model: BradleyTerry):
    """A vectorised function from text to score; the model is a few dozen numbers."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            rows = np.array([features(t) for t in batch], np.float64).reshape(len(batch), 16)
            yield pd.Series(model.score(rows), dtype="float64")

    return score


def score_documents(docs: DataFrame, model: BradleyTerry, folds: int = 5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score, predicted per row.

    Null texts are empty and texts without words have all features 0. Rows are
    independent, so repeats and ties get equal scores; a null id keeps its row; an
    empty table gives no rows; further columns are ignored.
    """
    ids = docs[doc_id].cast("long")
    return verdicts(docs.select(ids.alias("doc_id"), score_column(docs.sparkSession, model)(whole_text(docs, text)).alias("score")), folds)


def score_described(described: DataFrame, model: BradleyTerry, folds: int = 5) -> DataFrame:
    """What ``score_documents`` gives, from the features that ``describe`` keeps."""

    @F.pandas_udf("double")
    def score(column: pd.Series) -> pd.Series:
        return pd.Series(model.score(matrix(column)), dtype="float64")

    return verdicts(described.select("doc_id", score("features").alias("score")), folds)


def verdicts(scored: DataFrame, folds: int) -> DataFrame:
    return scored.select("doc_id", (fold_column(F.col("doc_id"), folds) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
