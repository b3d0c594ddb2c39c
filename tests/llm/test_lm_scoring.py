import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomgraph.llm import lm_scoring as L
from loomgraph.llm.common import fold_of


def naive(train, keys, depth):
    """Context-tree weighting over dictionaries, one node at a time."""
    counts = defaultdict(lambda: [0, 0])
    for key in train:
        context, symbol = key[:-1], key[-1]
        for d in range(depth + 1):
            for k in range(8):
                counts[context[depth - d :], (1 << k) | (symbol >> (8 - k))][(symbol >> (7 - k)) & 1] += 1
    kt = {n: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1) for n, (a, b) in counts.items()}
    weighted, below = dict(kt), defaultdict(float)
    for d in range(depth, -1, -1):
        for (context, node), value in kt.items():
            if len(context) == d:
                if d < depth:
                    weighted[context, node] = np.logaddexp(value, below[context, node]) - math.log(2)
                if d:
                    below[context[1:], node] += weighted[context, node]
    out = []
    for key in keys:
        context, symbol, total = key[:-1], key[-1], 0.0
        for k in range(8):
            node, bit, one, deeper = (1 << k) | (symbol >> (8 - k)), (symbol >> (7 - k)) & 1, 0.5, False
            for d in range(depth, -1, -1):
                n = (context[depth - d :], node)
                if n in counts:
                    a, b = counts[n]
                    share = math.exp(kt[n] - math.log(2) - weighted[n]) if deeper else 1.0
                    one, deeper = share * (b + 0.5) / (a + b + 1) + (1 - share) * one, True
            total += math.log10(one if bit else 1 - one)
        out.append(total)
    return out


def grams(text, depth):
    raw = b"\0" * depth + b" ".join(L.tokens_of(text)) + b"\n"
    return [raw[k : k + depth + 1] for k in range(len(raw) - depth)]


def expected(rows, depth):
    known = [(i, t or "") for i, t in rows]
    held = [fold_of(i, 7) == 2 for i, _ in known]
    train = [t for (_, t), h in zip(known, held, strict=True) if not h]
    counts = Counter(w for t in train for w in [*L.tokens_of(t), b""])
    n, v = sum(counts.values()), len(counts)
    train_grams = [g for t in train for g in grams(t, depth)]
    flat = naive(train_grams, [g for _, t in known for g in grams(t, depth)], depth)
    out, at = [], 0
    for (i, t), h in zip(known, held, strict=True):
        words, size = [*L.tokens_of(t), b""], len(grams(t, depth))
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        out.append((i, h, len(words), sum(counts[w] > 0 for w in words), n, base, sum(flat[at : at + size])))
        at += size
    return sorted(out, key=repr)


def compare(df, rows, depth):
    got = sorted((tuple(r)[:7] for r in df.collect()), key=lambda r: repr(r[:5]))
    want = sorted(expected(rows, depth), key=lambda r: repr(r[:5]))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    key = lambda r: (repr(r[:5]), round(r[5], 4), round(r[6], 4))
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[5] == pytest.approx(w[5]) and g[6] == pytest.approx(w[6], rel=1e-6)


def test_matches_naive_trees(frame):
    rnd = random.Random(1)
    rows = [(k, " ".join("".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 5))) for _ in range(rnd.randint(0, 12)))) for k in range(60)]
    compare(L.score_corpus(frame(rows), depth=3, chunk_bytes=900), rows, 3)


def test_odd_rows(frame, odd):
    from tests.llm.conftest import ODD

    compare(L.score_corpus(odd, depth=2), ODD, 2)
    assert L.score_corpus(frame([])).count() == 0
    alone = next(k for k in range(100) if fold_of(k, 7) == 2)
    only = L.score_corpus(frame([(alone, "ab")])).collect()  # nothing to train on
    assert only[0]["train_tokens"] == 0 and only[0]["score"] == pytest.approx(3 * 8 * math.log10(0.5))


def test_predictions_sum_to_one():
    rnd = np.random.default_rng(2)
    text = bytes(rnd.choice(np.frombuffer(b"ab cd", np.uint8), 400))
    keys = L.gram_keys([text], 3)
    unique, n = np.unique(keys, return_counts=True)
    levels = L.deep_levels(unique, n, 3)
    two = levels[2]
    import pandas as pd

    node = ((two.node >> 8) & 255) * 256 + (two.node & 255)
    rows = pd.DataFrame({"node": node, "zeros": two.zeros, "ones": two.ones, "below": two.weighted}).groupby("node", as_index=False).sum()
    zero, one = L.upper_levels(rows)
    for context in (b"ab ", b"zzz", b"\0\0a"):
        base = int.from_bytes(context, "big") << 8
        total = (10 ** L.gram_log10(base + np.arange(256), levels | {0: zero, 1: one})).sum()
        assert total == pytest.approx(1)
