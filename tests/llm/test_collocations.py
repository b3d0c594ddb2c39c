"""Phrases against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from tests.llm.conftest import ODD

from loomgraph.llm import collocations as C


def plain(rows, least, words, top, percent):
    """(text, lang) rows: count every phrase, cut it everywhere, look at all longer ones."""
    said, total = {}, Counter()
    for text, lang in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(ws)
            for m in range(1, words + 1):
                for i in range(len(ws) - m + 1):
                    said.setdefault(lang, Counter())[tuple(ws[i : i + m])] += 1
    out = []
    for lang, f in said.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
            if any(len(q) > len(p) and inside(q) and 100 * b >= percent * a for q, b in candidates.items()):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, n, p.decode(), -a, l, r, total[lang], -s) for n, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def frame_of(spark, rows):
    return spark.createDataFrame([(t, lang, "x", 1, 2) for t, lang in rows], "text string, lang string, phrase string, n long, name long")


@pytest.mark.parametrize("chunk, bucket, ranked", [(32_000_000, 1_500_000, 5000), (300, 40, 7)])
def test_phrases_equal_plain_counts(spark, monkeypatch, chunk, bucket, ranked):
    for name, value in (("CHUNK_BYTES", chunk), ("SLICE_BYTES", max(60, chunk // 16)), ("BUCKET_WORDS", bucket), ("RANK_ROWS", ranked)):
        monkeypatch.setattr(C, name, value)
    rng = random.Random(5)
    phrases = ["New York City", "new york", "state of the art", "of the", "the the the", "é ß", "日本 語", "in the", "art of war", "x\x00y z"]
    rows = [(rng.choice([" ", ". ", ", ", "\n", "\t", "  "]).join(rng.choice(phrases) for _ in range(rng.randint(0, 25))), rng.choice(["en", "de", None, "x y"])) for _ in range(60)]
    rows += [*((t, "en") for _, t in ODD), rows[0], rows[0]]
    for least, words, top, percent in ((3, 4, 2000, 80), (5, 2, 3, 50), (2, 5, 10, 100)):
        got = C.mine(frame_of(spark, rows), least, words, top, percent).collect()
        assert sorted(map(tuple, got)) == plain(rows, least, words, top, percent)
        assert got[0].asDict().keys() == {"lang", "rank", "phrase", "a", "l", "r", "n", "score"}


def test_nothing_to_mine(spark):
    assert C.mine(frame_of(spark, [])).collect() == []
    assert C.mine(frame_of(spark, [(None, None), ("", "en"), (" .\n", "en"), ("one", "en")])).collect() == []


def test_packing_of_columns():
    rng = np.random.default_rng(0)
    for n in (0, 1, 500):
        values = rng.integers(-(2**62), 2**62, n)
        assert (C.unpacked(C.packed(values)) == values).all() and (C.unpacked(C.packed(np.sort(values // 2**40), True), True) == np.sort(values // 2**40)).all()
    assert C.unpacked_words(C.packed_words([b"a", b"\xff\x00"])) == [b"a", b"\xff\x00"]
