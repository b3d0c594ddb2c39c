import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import quality_ranking, toxicity
from loomgraph.llm.common import fold_column, fold_of

SYLLABLES = ["er", "th", "in", "on", "re", "ble", "st", "ou", "ti", "an"]


def word(rnd):
    return "".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(1, 4)))


def corpus(n, seed=1):
    """(doc_id, text), and (doc_id, quality, toxic) for each."""
    rnd = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        words = [word(rnd) for _ in range(rnd.choice([30, 80, 400]))]
        bad, toxic = rnd.random() < 0.3, rnd.random() < 0.3
        for _ in range(3 if toxic else 0):
            insult = rnd.choice(["scumbag", "worthless", "pathetic"])
            at = rnd.randrange(len(insult) - 1)
            words[rnd.randrange(len(words))] = insult if rnd.random() < 0.5 else insult[:at] + rnd.choice("xz") + insult[at + 1 :]
        text = "### ".join(words) if bad else " ".join(words) + "."
        rows.append((k, text))
        labels.append((k, int(not bad), int(toxic)))
    return rows, labels


def labels_frame(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(scored, labels, column):
    truth = {r[0]: r[column] for r in labels}
    held = [r for r in scored.collect() if r["held_out"]]
    assert held and all(r["held_out"] == (fold_of(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 for r in held)
    return np.mean([r["predicted"] == truth[r["doc_id"]] for r in held])


def test_toxicity_held_out(spark, frame):
    rows, labels = corpus(500)
    docs = frame(rows)
    model = toxicity.train(docs, labels_frame(spark, labels))
    scored = toxicity.score_documents(docs, model)
    assert accuracy(scored, labels, 2) > 0.93
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == scored.where("predicted = 0").count()


def test_unseen_misspellings_share_vectors():
    rnd = random.Random(2)
    clean = [" ".join(word(rnd) for _ in range(40)) for _ in range(150)]
    toxic = [" ".join([*(word(rnd) for _ in range(38)), "worthless", "worthlesss"]) for _ in range(150)]
    model = toxicity.SubwordSoftmax.fit(clean + toxic, [0] * 150 + [1] * 150)
    misspelt, clean = toxicity.Scorer(*model.bucket_logits()).scores(["er th on worthlezs in re", "er th on thonble in re"])
    assert misspelt > clean


def test_scores_against_brute_force(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK_WORDS", 7)
    rnd = np.random.default_rng(5)
    table, bias = rnd.normal(0, 1, toxicity.BUCKETS).astype(np.float32), 0.3

    def fnv(gram):
        h = 2166136261
        for c in gram:
            h = ((h ^ c) * 16777619) % 2**32
        return (h ^ h >> 15) % toxicity.BUCKETS

    def word_logit(w):
        raw = f"<{w}>".encode()
        grams = [raw[k : k + size] for size in (3, 4, 5, 6) for k in range(max(1, len(raw) - size + 1))]
        return np.mean([float(table[fnv(g)]) for g in grams])

    def logit(text):
        values = [word_logit(w) for w in toxicity.words_of(text)]
        spans = range(0, max(1, len(values) - 4), 4)
        return max(np.mean(values[k : k + 8]) for k in spans) + bias if values else -8.0

    words = ["a", "I", "été", "日本", "Word,", "***", "-", "(long-hyphened)", "scum", "abcd", "abc", "ab"]
    texts = ["", " \n", "***  --", *(" ".join(rnd.choice(words, n)) for n in (1, 2, 4, 5, 8, 9, 12, 13, 40, 41, 42, 43, 300))]
    scorer = toxicity.Scorer(table, bias)
    for _ in range(2):  # the second time from the cache
        assert np.allclose(scorer.logits(texts), [logit(t) for t in texts])
    assert len(scorer.logits([])) == 0


def test_without_both_labels_nothing_is_toxic(spark, frame):
    rows, labels = corpus(40)
    docs = frame(rows)
    for some in ([], [(i, q, 0) for i, q, _ in labels], [(i, q, 1) for i, q, _ in labels], [(i, q, None) for i, q, _ in labels]):
        model = toxicity.train(docs, labels_frame(spark, some) if some else spark.createDataFrame([], "doc_id long, quality int, toxic int"))
        assert {r["predicted"] for r in toxicity.score_documents(docs, model).collect()} == {0}
        assert toxicity.drop_toxic(docs, model).count() == len(rows)


def test_contradictory_and_repeated_labels(spark, frame):
    docs = frame([(1, "b"), (1, "a"), (2, "c"), (3, "d"), (4, "e"), (6, "f")])
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1), (3, 0), (4, 7), (6, None), (None, 1)], "doc_id long, toxic int")
    texts, y = toxicity.labelled_sample(docs, labels, "toxic", 10**9, 100)
    assert (texts, y) == (["a", "d"], [1, 0])


def test_quality_held_out(spark, frame):
    rows, labels = corpus(400)
    docs = frame(rows)
    scored = quality_ranking.score_documents(docs, quality_ranking.train(docs, labels_frame(spark, labels)))
    assert accuracy(scored, labels, 1) > 0.95


def test_quality_learns_from_all_labels(spark, frame, monkeypatch):
    rnd = random.Random(12)
    rows = [(k, " ".join(word(rnd) + rnd.choice(["", "", "###", "!", "|"]) for _ in range(rnd.randint(5, 40)))) for k in range(5000)]
    labels = [(k, int(rnd.random() < 0.4 + 0.3 * ("###" not in t)), 0) for k, t in rows]
    docs = frame(rows)
    for shard, few in ((20_000, 20_000), (700, 50)):
        monkeypatch.setattr(quality_ranking, "SHARD_DOCS", shard)
        monkeypatch.setattr(quality_ranking, "FEW_VALUES", few)
        scored = quality_ranking.score_documents(docs, quality_ranking.train(docs, labels_frame(spark, labels)))
        found = {r["doc_id"]: r["predicted"] for r in scored.where("not held_out").collect()}
        assert len(found) > 3900 and abs(list(found.values()).count(0) - sum(labels[k][1] == 0 for k in found)) <= 1


def test_quality_of_a_rare_label_in_many_shards(spark, frame, monkeypatch):
    rows, labels = corpus(400, seed=3)
    first = {q: [k for k, own, _ in labels if own == q] for q in (0, 1)}
    kept = {*first[0][:12], *first[1]}
    monkeypatch.setattr(quality_ranking, "SHARD_DOCS", 30)
    docs = frame(rows)
    model = quality_ranking.train(docs, labels_frame(spark, [r for r in labels if r[0] in kept]))
    score = {r["doc_id"]: r["score"] for r in quality_ranking.score_documents(docs, model).collect()}
    described = quality_ranking.describe(docs)
    assert {r["doc_id"]: r["score"] for r in quality_ranking.score_described(described, model).collect()} == pytest.approx(score)
    unseen = [k for k in first[0] if k not in kept]
    assert np.mean([score[k] for k in unseen]) < 0.5 * np.mean([score[k] for k in first[1]])


@pytest.mark.parametrize("operator", [toxicity, quality_ranking])
def test_odd_rows_and_few_labels(spark, frame, odd, operator):
    for labels in ([], [(4, 1, 0)], [(4, 1, 0), (8, 0, 1), (999, 0, 1), (7, None, None)]):
        model = operator.train(odd, labels_frame(spark, labels))
        scored = operator.score_documents(odd, model).collect()
        assert len(scored) == 11 and all(0 <= r["score"] <= 1 for r in scored)
        assert operator.score_documents(frame([]), model).count() == 0


def test_bradley_terry_threshold_is_the_quantile():
    rnd = np.random.default_rng(3)
    rows = np.clip(np.vstack([rnd.normal(0.7, 0.2, (200, 16)), rnd.normal(0.4, 0.2, (200, 16))]), 0, 1)
    labels = np.repeat([1, 0], 200)
    model = quality_ranking.BradleyTerry.fit(rows, labels, 0.5)
    strengths = model.strength(rows)
    assert abs((strengths < model.threshold).mean() - 0.5) < 0.02
    assert strengths[:200].mean() > strengths[200:].mean()


def test_folds_agree_between_engines(spark):
    ids = spark.createDataFrame([(k,) for k in [0, 1, 7, 123456789, None]], "doc_id long")
    assert all(r["f"] == fold_of(r["doc_id"], 5) for r in ids.select("doc_id", fold_column(F.col("doc_id"), 5).alias("f")).collect())
